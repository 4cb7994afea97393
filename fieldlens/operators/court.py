"""Court geometry: boxes, projection, smoothing, distances, speeds and heatmaps."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructType

from fieldlens.constants import CANVAS_H, CANVAS_W, COURT_H, COURT_H_M, COURT_W, COURT_W_M, PITCH_LENGTH, PITCH_WIDTH
from fieldlens.scale import (
    SPAN, core_only, div_floor, positions as dense_positions, pyround, running, span_window, spread, with_halo,
)

PLAYER = ["video_id", "player_id"]


def truncate(value: Column) -> Column:
    """Integer part toward zero."""
    return value.cast("bigint")


def bbox_geometry(tracks: DataFrame) -> DataFrame:
    """Center, size and foot point of each box."""
    center_x = (F.col("x1") + F.col("x2")) / 2
    return tracks.select(
        "video_id", "frame_idx", "player_id",
        center_x.alias("center_x"), ((F.col("y1") + F.col("y2")) / 2).alias("center_y"),
        (F.col("x2") - F.col("x1")).alias("width"), (F.col("y2") - F.col("y1")).alias("height"),
        truncate(center_x).alias("foot_x"), truncate(F.col("y2")).alias("foot_y"),
    )


def crowd_filter(tracks: DataFrame, frames: DataFrame, share: float = 0.25) -> DataFrame:
    """Drop boxes that end in the top ``share`` of the frame."""
    sized = tracks.join(frames.select("video_id", "frame_idx", "height"), ["video_id", "frame_idx"])
    return sized.filter(F.col("y2") >= F.lit(share) * F.col("height")).drop("height")


def on_court_filter(tracks: DataFrame, positions: DataFrame) -> DataFrame:
    """Players on the outer edge of the court are off court: team 0 and sideline."""
    x, y = F.col("px"), F.col("py")
    edge = (x <= 0.5) | (x >= COURT_W - 0.5) | (y <= 0.5) | (y >= COURT_H - 0.5)
    edge = F.coalesce(edge, F.lit(False))
    keyed = positions.select("video_id", "frame_idx", "player_id", F.col("x").alias("px"), F.col("y").alias("py"))
    return (
        tracks.join(keyed, ["video_id", "frame_idx", "player_id"], "left")
        .withColumn("team", F.when(edge, F.lit(0)).otherwise(F.col("team")).cast("int"))
        .withColumn("is_sideline", edge | F.col("is_sideline"))
        .drop("px", "py")
    )


def homography_lookup(points: DataFrame, calibrations: DataFrame, bucket: int = 64) -> DataFrame:
    """Calibration valid at each point's frame.

    The range condition gets an equality on a frame bucket, so the join hashes on (video, bucket): a point meets at
    most the calibrations of 64 frames, and a long calibration is repeated once per 64 frames.
    """
    spread = calibrations.withColumn(
        "_bucket", F.explode(F.sequence(div_floor(F.col("frame_from"), bucket), div_floor(F.col("frame_to"), bucket)))
    )
    return (
        points.withColumn("_bucket", div_floor(F.col("frame_idx"), bucket))
        .join(spread, ["video_id", "_bucket"])
        .filter(F.col("frame_idx").between(F.col("frame_from"), F.col("frame_to")))
        .drop("_bucket")
    )


def _apply_matrix(x: Column, y: Column, h: Column) -> tuple[Column, Column]:
    w = h[6] * x + h[7] * y + h[8]
    return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w


def project_points(points: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Camera points (x, y) to court pixels; outside a 15 % margin dropped, the rest clamped to the court."""
    x, y = _apply_matrix(F.col("x"), F.col("y"), F.col("h"))
    margin_x, margin_y = COURT_W * 0.15, COURT_H * 0.15
    projected = homography_lookup(points, calibrations).withColumns({"_x": x, "_y": y})
    inside = F.col("_x").between(-margin_x, COURT_W * 1.15) & F.col("_y").between(-margin_y, COURT_H * 1.15)
    return projected.filter(inside).select(
        "video_id", "frame_idx", "player_id",
        F.greatest(F.lit(0.0), F.least(F.lit(float(COURT_W)), "_x")).alias("x"),
        F.greatest(F.lit(0.0), F.least(F.lit(float(COURT_H)), "_y")).alias("y"),
    )


def pitch_metric(ball: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Ball points to metres along and across the pitch; NULL outside the run-up and crease area."""
    x, y = _apply_matrix(F.col("cx"), F.col("cy"), F.col("h"))
    looked = homography_lookup(ball, calibrations).withColumns({"_x": x, "_y": y})
    inside = F.col("_x").between(-5, 26) & F.col("_y").between(-6, 6)
    return looked.select(
        "video_id", "frame_idx", F.when(inside, F.col("_x")).alias("mx"), F.when(inside, F.col("_y")).alias("my")
    )


def _on_template(x: Column, y: Column) -> Column:
    inside = x.between(0, 600) & y.between(0, 320)
    return F.when(inside, F.struct(truncate(x).alias("px"), truncate(y).alias("py")))


def pitch_minimap(points: DataFrame) -> DataFrame:
    """Metric pitch points (mx, my) to pixels of the 600x320 pitch template, NULL outside."""
    x = F.lit(120.0) + F.col("mx") / PITCH_LENGTH * 360.0
    y = F.lit(160.0) + F.col("my") / PITCH_WIDTH * 80.0
    pixel = _on_template(x, y)
    return points.withColumns({"minimap_x": pixel["px"], "minimap_y": pixel["py"]})


def pitch_minimap_camera(points: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Camera points (cx, cy) to the template through a camera-to-template matrix, NULL outside."""
    looked = homography_lookup(points, calibrations)
    pixel = _on_template(*_apply_matrix(F.col("cx"), F.col("cy"), F.col("h")))
    return looked.select("video_id", "frame_idx", pixel["px"].alias("minimap_x"), pixel["py"].alias("minimap_y"))


def pitch_minimap_list(points: DataFrame, path: str = "path") -> DataFrame:
    """Arrays of metric points (mx, my) to arrays of template pixels; points outside are dropped."""

    def pixel(p: Column) -> Column:
        return _on_template(
            F.lit(120.0) + p["mx"] / PITCH_LENGTH * 360.0, F.lit(160.0) + p["my"] / PITCH_WIDTH * 80.0
        )

    return points.withColumn(path, F.filter(F.transform(path, pixel), lambda p: p.isNotNull()))


def ground_map(points: DataFrame) -> DataFrame:
    """Metric points (mx, my) to the ground image, clamped to the boundary circle."""
    mx, my = F.col("mx"), F.col("my")
    half = PITCH_WIDTH / 2
    on_pitch = mx.between(0, PITCH_LENGTH) & (F.abs(my) <= half + 0.5)
    scale = 254.0 / 70.0
    x = F.when(on_pitch, F.lit(265.0) + my * (24.5 / half)).otherwise(F.lit(265.0) + my * scale)
    y = F.when(on_pitch, F.lit(185.0) + mx / PITCH_LENGTH * 155.0).otherwise(
        F.lit(263.0) + (mx - PITCH_LENGTH / 2) * scale
    )
    dx, dy = F.col("_gx") - 265.0, F.col("_gy") - 263.0
    dist = F.sqrt(dx * dx + dy * dy)
    return points.withColumns({"_gx": x, "_gy": y}).withColumns({
        "ground_x": F.when(dist > 250.0, F.rint(F.lit(265.0) + dx / dist * 250.0)).otherwise(F.rint("_gx")).cast("bigint"),
        "ground_y": F.when(dist > 250.0, F.rint(F.lit(263.0) + dy / dist * 250.0)).otherwise(F.rint("_gy")).cast("bigint"),
    }).drop("_gx", "_gy")


def px_to_meters(positions: DataFrame) -> DataFrame:
    return positions.withColumns({
        "x_m": F.col("x") * COURT_W_M / COURT_W, "y_m": F.col("y") * COURT_H_M / COURT_H,
    })


def keyframe_asof(frames: DataFrame, keypoints: DataFrame, stride: int = 10, batch_size: int | None = None) -> DataFrame:
    """Every frame takes the keypoints of the latest keyframe of its batch (an equality join)."""
    start = div_floor(F.col("frame_idx"), batch_size) * batch_size if batch_size else F.lit(0).cast("bigint")
    key = start + div_floor(F.col("frame_idx") - start, stride) * stride
    keyed = keypoints.withColumnRenamed("frame_idx", "keyframe_idx")
    return frames.withColumn("keyframe_idx", key).join(keyed, ["video_id", "keyframe_idx"], "left")


def player_step_distance(
    positions: DataFrame, deadband: float = 0.02, max_jump: float = 2.5, span: int = SPAN
) -> DataFrame:
    """Metres from a player's previous seen position; jitter, identity jumps and first sight count 0."""
    metres = px_to_meters(positions)
    seen = running(
        metres, PLAYER, "frame_idx", {"_prev": ("last", F.struct("x_m", "y_m"), False)}, span=span
    )
    dx, dy = F.col("x_m") - F.col("_prev.x_m"), F.col("y_m") - F.col("_prev.y_m")
    dist = F.sqrt(dx * dx + dy * dy)
    return seen.select(
        "video_id", "frame_idx", "player_id",
        F.when(dist.between(deadband, max_jump), dist).otherwise(F.lit(0.0)).alias("dist_m"),
    )


def player_speed(
    steps: DataFrame, fps: float = 30.0, frames: int = 10, min_present: int = 5, cap: float = 38.0, span: int = SPAN
) -> DataFrame:
    """km/h over the last ``frames`` frames, from the frames where the player was seen."""
    w = span_window(PLAYER, "frame_idx").rangeBetween(-(frames - 1), 0)
    haloed = with_halo(steps, "frame_idx", before=frames - 1, span=span)
    windowed = core_only(haloed.withColumns({"_sum": F.sum("dist_m").over(w), "_n": F.count("dist_m").over(w)}))
    kmh = F.col("_sum") / (F.col("_n") / F.lit(float(fps) if fps > 0 else 1.0)) * 3.6
    enough = (F.col("_n") >= min_present) & F.lit(fps > 0)
    return windowed.select(
        "video_id", "frame_idx", "player_id",
        F.when(enough, pyround(F.least(kmh, F.lit(cap)), 1)).otherwise(F.lit(0.0)).alias("speed_kmh"),
    )


def player_distance(steps: DataFrame) -> DataFrame:
    return steps.groupBy(*PLAYER).agg(pyround(F.sum("dist_m"), 2).alias("total_distance_m"))


def speed_stats(speeds: DataFrame) -> DataFrame:
    """Mean and maximum of the positive samples."""
    return speeds.filter("speed_kmh > 0").groupBy(*PLAYER).agg(
        pyround(F.avg("speed_kmh"), 1).alias("avg_speed_kmh"), F.max("speed_kmh").alias("max_speed_kmh"),
        F.count("*").alias("samples"),
    )


def leaderboard(player_stats: DataFrame) -> DataFrame:
    """Players of both teams by distance, longest first."""
    return player_stats.filter(F.col("team").isin(1, 2)).orderBy(
        F.col("total_distance_m").desc(), "video_id", "player_id"
    )


def ema(df: DataFrame, keys: list[str], axis: str, columns: list[str], alpha: float, span: int = SPAN) -> DataFrame:
    """Exponential moving average per key, started at the first value.

    Written as a sum with geometric weights inside blocks of rows, plus the exit value of the block before;
    a block is long enough for older blocks to weigh less than a double can show.
    """
    keep = 1.0 - alpha
    block = max(64, math.ceil(math.log(1e-18) / math.log(keep)))
    numbered = dense_positions(df, keys, axis, name="_pos", span=span).withColumns({
        "_block": div_floor(F.col("_pos"), block),
    }).withColumn("_i", (F.col("_pos") - F.col("_block") * block).cast("double"))
    weight = F.when(F.col("_pos") == 0, F.lit(1.0)).otherwise(F.lit(alpha))
    grow, shrink = F.pow(F.lit(keep), -F.col("_i")), F.pow(F.lit(keep), F.col("_i"))
    w = Window.partitionBy(*keys, "_block").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    ends = numbered.groupBy(*keys, "_block").agg(
        *[(F.pow(F.lit(keep), F.max("_i")) * F.sum(weight * F.col(c) * grow)).alias(f"_end_{c}") for c in columns]
    ).withColumn("_block", F.col("_block") + 1)
    local = numbered.withColumns({f"_sum_{c}": F.sum(weight * F.col(c) * grow).over(w) for c in columns})
    joined = local.join(ends, [*keys, "_block"], "left")
    smooth = {
        c: shrink * F.col(f"_sum_{c}") + F.coalesce(F.col(f"_end_{c}"), F.lit(0.0)) * shrink * F.lit(keep)
        for c in columns
    }
    others = [c for c in df.columns if c not in columns]
    return joined.select(*others, *[v.alias(c) for c, v in smooth.items()]).select(*df.columns)


def ema_positions(positions: DataFrame, alpha: float = 0.6, span: int = SPAN) -> DataFrame:
    return ema(positions, PLAYER, "frame_idx", ["x", "y"], alpha, span)


def presence_islands(
    df: DataFrame, keys: list[str], axis: str, max_gap: int = 1, name: str = "island", span: int = SPAN
) -> DataFrame:
    """Label rows by the first ``axis`` value of their island; an island ends where the next row is more than ``max_gap`` away."""
    w = span_window(keys, axis).rangeBetween(-max_gap, -1)
    marked = core_only(
        with_halo(df, axis, before=max_gap, span=span).withColumn("_near", F.count(F.lit(1)).over(w)), keep=True
    )
    start = F.when(F.col("_near") == 0, F.col(axis))
    return running(marked, keys, axis, {name: ("last", start, True)}, span=span).drop("_near")


def minimap_smoothing(positions: DataFrame, keep: float = 0.8, span: int = SPAN) -> DataFrame:
    """Average with weight ``keep`` on the previous value; a frame without the player starts afresh."""
    islands = presence_islands(positions, PLAYER, "frame_idx", 1, "_island", span)
    return ema(islands, [*PLAYER, "_island"], "frame_idx", ["x", "y"], 1.0 - keep, span).drop("_island")


def ball_ema(ball: DataFrame, frames: DataFrame, alpha: float = 0.5, max_coast: int = 30, span: int = SPAN) -> DataFrame:
    """Smoothed ball box; up to ``max_coast`` frames without ball keep the last box at confidence .5, then it starts afresh."""
    box = ["x1", "y1", "x2", "y2"]
    islands = presence_islands(ball.select("video_id", "frame_idx", *box, "conf"), ["video_id"], "frame_idx", max_coast + 1, "_island", span)
    smooth = ema(islands, ["video_id", "_island"], "frame_idx", box, alpha, span).drop("_island")
    spine = frames.select("video_id", "frame_idx").join(smooth, ["video_id", "frame_idx"], "left")
    seen = F.when(F.col("x1").isNotNull(), F.struct("frame_idx", *box))
    held = running(spine, ["video_id"], "frame_idx", {"_last": ("last", seen, True)}, span=span)
    return held.filter(F.col("frame_idx") - F.col("_last.frame_idx") <= max_coast).select(
        "video_id", "frame_idx", *[F.col(f"_last.{c}").alias(c) for c in box], F.coalesce("conf", F.lit(0.5)).alias("conf"),
        F.col("conf").isNull().alias("is_coasting"),
    )


def fill_positions(positions: DataFrame, frames: DataFrame, batch_size: int | None = 250, span: int = SPAN) -> DataFrame:
    """Every player of a batch in every frame of it: linear between the batch's sightings, nearest sighting outside.

    Batches are independent, so a player is filled only near its sightings, and (video, batch) spreads a long video over all tasks.
    ``batch_size=None`` takes a video as one batch.
    """
    if batch_size:
        batch = div_floor(F.col("frame_idx"), batch_size)
        keys = ["video_id", "_batch"]
        seen = positions.select("video_id", batch.alias("_batch"), "player_id", "frame_idx", "x", "y")
        spine = frames.select("video_id", batch.alias("_batch"), "frame_idx").join(seen.select(*keys, "player_id").distinct(), keys)
        both = spine.join(seen, [*keys, "player_id", "frame_idx"], "left")
        one = Window.partitionBy(*keys, "player_id").orderBy("frame_idx")
        here = F.when(F.col("x").isNotNull(), F.struct("frame_idx", "x", "y"))
        both = both.withColumns({
            "_a": F.last(here, ignorenulls=True).over(one.rowsBetween(Window.unboundedPreceding, 0)),
            "_b": F.first(here, ignorenulls=True).over(one.rowsBetween(0, Window.unboundedFollowing)),
        })
        return _between(both)
    players = positions.select(*PLAYER).distinct()
    spine = frames.select("video_id", "frame_idx").join(players, "video_id")
    seen = spine.join(positions.select("video_id", "frame_idx", "player_id", "x", "y"),
                      ["video_id", "frame_idx", "player_id"], "left")
    here = F.when(F.col("x").isNotNull(), F.struct("frame_idx", "x", "y"))
    both = running(seen, PLAYER, "frame_idx", {"_a": ("last", here, True)}, span=span, keep=True)
    both = running(both, PLAYER, "frame_idx", {"_b": ("last", here, True)}, span=span, reverse=True)
    return _between(both)


def _between(both: DataFrame) -> DataFrame:
    """Points between the sightings ``_a`` before and ``_b`` after."""
    gap = F.col("_b.frame_idx") - F.col("_a.frame_idx")
    t = (F.col("frame_idx") - F.col("_a.frame_idx")) / gap

    def lerp(c: str) -> Column:
        inside = (1 - t) * F.col(f"_a.{c}") + t * F.col(f"_b.{c}")
        return F.when(gap > 0, inside).otherwise(F.coalesce(F.col(f"_a.{c}"), F.col(f"_b.{c}"))).alias(c)

    return both.select("video_id", "frame_idx", "player_id", lerp("x"), lerp("y"))


def heatmap_point_filter(positions: DataFrame, tracks: DataFrame) -> DataFrame:
    """Court points inside the lines, not on the sideline and not of an official; carries the frame's team."""
    inside = F.col("x").between(1, COURT_W - 1) & F.col("y").between(1, COURT_H - 1)
    tags = tracks.select("video_id", "frame_idx", "player_id", "team", "is_sideline")
    joined = positions.filter(inside).join(tags, ["video_id", "frame_idx", "player_id"], "left")
    return joined.filter(
        ~F.coalesce(F.col("is_sideline"), F.lit(False)) & (F.coalesce(F.col("team"), F.lit(-1)) != 0)
    ).select("video_id", "frame_idx", "player_id", "x", "y", "team")


def heatmap_grid(
    points: DataFrame, votes: DataFrame, stats: DataFrame, totals: DataFrame, cell_px: int = 1, long_video: int | None = 90
) -> DataFrame:
    """Points per cell (a pixel, unless ``cell_px`` is larger) of the 2800x1500 canvas for team 1, team 2 and the match.

    ``votes`` (video, player, team) stand in for a missing frame team; ``stats`` (total_distance_m,
    avg_speed_kmh) mark stationary people, left out of videos of ``long_video`` frames or more (``totals``); with
    ``long_video=None`` they stay in all.
    """
    width, height = CANVAS_W, CANVAS_H
    px, py = truncate(F.col("x") / COURT_W * width), truncate(F.col("y") / COURT_H * height)
    inside = points.withColumns({"_px": px, "_py": py}).filter(F.col("_px").between(15, width - 16) & F.col("_py").between(15, height - 16))
    cells = inside.withColumns({"cell_x": div_floor(F.col("_px"), cell_px), "cell_y": div_floor(F.col("_py"), cell_px)})
    # points are counted before anything is joined to them: per track and cell, however long the video
    per_track = cells.groupBy(*PLAYER, "team", "cell_x", "cell_y").agg(F.count("*").alias("n"))
    if long_video is not None:
        still = (
            stats.join(totals.filter(F.col("total_frames") >= long_video).select("video_id"), "video_id", "left_semi")
            .filter((F.col("total_distance_m") < 3.0) | (F.col("avg_speed_kmh") < 0.8))
            .select(*PLAYER)
        )
        per_track = per_track.join(still, PLAYER, "left_anti")
    voted = per_track.join(votes.select(*PLAYER, F.col("team").alias("_voted")), PLAYER, "left")
    team = F.when(F.col("team").isin(1, 2), F.col("team")).otherwise(F.col("_voted"))
    # per-team counts first; the match layer is the sum of those few rows
    per_team = voted.withColumn("_team", team).filter(F.col("_team").isin(1, 2)).groupBy("video_id", "_team", "cell_x", "cell_y").agg(F.sum("n").alias("n"))
    layers = F.array(F.concat(F.lit("team_"), F.col("_team").cast("string")), F.lit("match"))
    return (
        per_team.withColumn("layer", F.explode(layers))
        .groupBy("video_id", "layer", "cell_x", "cell_y").agg(F.sum("n").cast("bigint").alias("n"))
    )


class HeatStencil:
    """Gaussian smoothing of the sparse cells of a layer, strip by strip of its lines; heat is mirrored at the borders."""

    def __init__(self, sigma_px: float, cell_px: int, strip: int):
        self.columns, self.lines, self.strip = CANVAS_W // cell_px, CANVAS_H // cell_px, strip
        self.sigma = sigma_px / cell_px
        self.radius = math.ceil(4 * self.sigma)
        d = np.arange(-self.radius, self.radius + 1)
        weights = np.exp(-(d * d) / (2 * self.sigma * self.sigma))
        self.weights = weights / weights.sum()

    def reach(self, first: int, stop: int, cells: np.ndarray, n: int) -> np.ndarray:
        """Weight of each cell (row) at the places from ``first`` to ``stop``: directly, and from its mirror images about both border cells."""
        out = np.zeros((len(cells), stop - first))
        for image, real in ((cells, True), (-cells, cells > 0), (2 * (n - 1) - cells, cells < n - 1)):
            near = np.flatnonzero((image + self.radius >= first) & (image - self.radius < stop) & real)
            if len(near):  # an image's row is a piece of one line of weights
                last = image[near].max()
                d = np.arange(first - last, stop - image[near].min())
                line = np.where(np.abs(d) <= self.radius, self.weights[np.clip(d, -self.radius, self.radius) + self.radius], 0.0)
                out[near] += np.lib.stride_tricks.sliding_window_view(line, stop - first)[last - image[near]]
        return out

    def smooth(self, cells: pa.Table) -> np.ndarray:
        """Heat of a layer; only lines and columns that hold points are multiplied.  The canvas bounds it, whatever the video."""
        xs, x_at = np.unique(cells["cell_x"].to_numpy(), return_inverse=True)
        ys, y_at = np.unique(cells["cell_y"].to_numpy(), return_inverse=True)
        counts = np.zeros((len(ys), len(xs)))
        counts[y_at, x_at] = cells["n"].to_numpy()
        along = counts @ self.reach(0, self.columns, xs, self.columns)
        heat = np.zeros((self.lines, self.columns))
        for first in range(0, self.lines, self.strip):
            stop = min(first + self.strip, self.lines)
            low, high = np.searchsorted(ys, (first - self.radius, stop + self.radius))
            np.matmul(self.reach(first, stop, ys[low:high], self.lines).T, along[low:high], out=heat[first:stop])
        return heat

    def layers(self, grid: DataFrame) -> DataFrame:
        """The cells dealt out by layer: there few bytes give much work."""
        return spread(grid, *LAYER)

    strips = layers  # a layer's strips are smoothed where its cells lie


LAYER = ["video_id", "layer"]


def heat_top(heat: np.ndarray, pct: float) -> float:
    """Percentile ``pct`` of the positive heat, exactly and interpolated as numpy does.

    Only values above a bound taken from every 61st are partitioned; if the bound turns out too high, all are.
    """
    flat = heat.reshape(-1)
    warm = np.count_nonzero(flat > 0)
    at = (warm - 1) * pct
    rank = flat.size - warm + math.floor(at)
    following = min(rank + 1, flat.size - 1)
    some, hot = flat[::61], flat
    guess = len(some) * rank // flat.size - len(some) // 200 - 2
    if guess > 0:
        hot = flat[flat >= np.partition(some, guess)[guess]]
        if len(hot) < flat.size - rank:
            hot = flat
    low, high = rank - (flat.size - len(hot)), following - (flat.size - len(hot))
    ranked = np.partition(hot, (low, high))
    return float(ranked[low] + (ranked[high] - ranked[low]) * (at - math.floor(at)))


#: Lists without nulls, which cost the engine fewer checks per number.
FLOATS = pa.list_(pa.field("element", pa.float32(), nullable=False))


def _heat_layers(cells: DataFrame, stencil: HeatStencil, pct: float, give: Callable, schema: str, lists: tuple[str, ...] = ()) -> DataFrame:
    """``give(heat, top)`` of every layer: the columns of ``schema``, and ``lists`` of floats, in one or more pieces.

    A layer is smoothed once; its percentile and all that follows come from the same heat.
    """

    def paint(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heat = stencil.smooth(pa.Table.from_batches(batches))
        video, layer = pa.scalar(key[0].as_py(), pa.int64()), pa.scalar(key[1].as_py(), pa.string())
        for out in give(heat, heat_top(heat, pct)):
            n = len(next(iter(out.values())))
            yield pa.RecordBatch.from_pydict({"video_id": pa.repeat(video, n), "layer": pa.repeat(layer, n), **{c: v if isinstance(v, pa.Array) else pa.array(v) for c, v in out.items()}})

    columns = StructType.fromDDL(f"video_id bigint, layer string, {schema}")
    for name in lists:
        columns.add(name, ArrayType(FloatType(), False))
    return cells.select(*LAYER, "cell_x", "cell_y", "n").groupBy(*LAYER).applyInArrow(paint, columns)


def _heat_ranks(cells: DataFrame, stencil: HeatStencil, pct: float) -> DataFrame:
    """Percentile ``pct`` of a layer's positive heat: video_id, layer, top."""
    return _heat_layers(cells, stencil, pct, lambda heat, top: [{"top": np.array([top])}], "top double")


def _painted(heat: np.ndarray, top: float) -> tuple[np.ndarray, np.ndarray]:
    """Density and opacity of heat."""
    density = np.minimum(heat / top, 1.0)
    return density, np.where(density >= 0.05, np.minimum(0.70, 0.20 + 0.50 * ((density - 0.05) / 0.95)), 0.0)


def heatmap_density(grid: DataFrame, sigma_px: float = 65.0, cell_px: int = 1, pct: float = 0.98, strip_px: int = 60) -> DataFrame:
    """Gaussian smoothing of the cell counts, scaled by a high percentile, with the overlay's opacity: one row per warm cell.

    A task holds one layer, which the canvas bounds, and smooths it ``strip_px`` lines at a time.
    """
    stencil = HeatStencil(sigma_px, cell_px, max(1, strip_px // cell_px))

    def give(heat, top):
        lines = max(1, (1 << 19) // stencil.columns)
        for first in range(0, stencil.lines, lines):
            y, x = np.nonzero(heat[first : first + lines])
            density, alpha = _painted(heat[y + first, x], top)
            yield {"cell_x": x, "cell_y": y + first, "density": density, "alpha": alpha}

    return _heat_layers(stencil.layers(grid), stencil, pct, give, "cell_x bigint, cell_y bigint, density double, alpha double")


def heatmap_lines(grid: DataFrame, sigma_px: float = 65.0, cell_px: int = 1, pct: float = 0.98, strip_px: int = 60) -> DataFrame:
    """The painted map of every layer, whole: all cells of ``heatmap_density``, in one row per run of warm cells of a line.

    ``density`` and ``alpha`` hold a number for each cell from ``cell_x`` on, in single precision like the painted images' own.
    """
    stencil = HeatStencil(sigma_px, cell_px, max(1, strip_px // cell_px))

    def give(heat, top):
        lines = max(1, (1 << 17) // stencil.columns)  # blocks that stay in the processor's cache
        for first in range(0, stencil.lines, lines):
            part = heat[first : first + lines]
            warm = np.zeros((len(part), stencil.columns + 2), bool)  # a cold cell at either end of a line
            warm[:, 1:-1] = part > 0
            edges = np.flatnonzero(warm.reshape(-1)[1:] != warm.reshape(-1)[:-1])
            if len(edges):
                y, x = np.divmod(edges[::2], stencil.columns + 2)
                begins = pa.array(np.append(0, np.cumsum(edges[1::2] - edges[::2])), pa.int32())
                density, alpha = (pa.ListArray.from_arrays(begins, v.astype(np.float32), FLOATS) for v in _painted(part[warm[:, 1:-1]], top))
                yield {"cell_y": y + first, "cell_x": x, "density": density, "alpha": alpha}

    return _heat_layers(stencil.layers(grid), stencil, pct, give, "cell_y bigint, cell_x bigint", ("density", "alpha"))


def heatmap_levels(grid: DataFrame, sigma_px: float = 65.0, cell_px: int = 1, pct: float = 0.98, strip_px: int = 60) -> DataFrame:
    """The painted map of every layer in figures: warm cells and summed opacity per level 0..255 of the colour scale."""
    stencil = HeatStencil(sigma_px, cell_px, max(1, strip_px // cell_px))

    def give(heat, top):
        cells, alphas = np.zeros(256, np.int64), np.zeros(256)
        for first in range(0, stencil.lines, 16):  # a few lines at a time stay in the processor's cache
            part = heat[first : first + 16].reshape(-1)
            density, alpha = _painted(part if part.all() else part[part > 0], top)
            level = (density * 255).astype(np.int64)
            cells += np.bincount(level, minlength=256)
            alphas += np.bincount(level, alpha, 256)
        seen = np.flatnonzero(cells)
        yield {"level": seen, "cells": cells[seen], "alpha": alphas[seen]}

    return _heat_layers(stencil.layers(grid), stencil, pct, give, "level bigint, cells bigint, alpha double")
