"""Ball possession, passes and interceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.scale import SPAN, core_only, div_floor, durable, positions, pyround, running, span_window, with_halo

FRAME = ["video_id", "frame_idx"]


def _point_distance(x: Column, y: Column) -> Column:
    return F.sqrt((F.col("bx") - x) * (F.col("bx") - x) + (F.col("by") - y) * (F.col("by") - y))


def _reach() -> Column:
    """Distance from the ball to the nearest anchor of the player box."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    mid_x, mid_y = x1 + (x2 - x1) / 2, y1 + (y2 - y1) / 2
    third = y1 + (y2 - y1) / 3
    anchors = [
        (mid_x, y1), (x2, y1), (x1, y1), (x2, mid_y), (x1, mid_y),
        (mid_x, mid_y), (x2, y2), (x1, y2), (mid_x, y2), (mid_x, third),
    ]
    nearest = [_point_distance(x, y) for x, y in anchors]
    beside = (F.col("by") > y1) & (F.col("by") < y2)
    above = (F.col("bx") > x1) & (F.col("bx") < x2)
    nearest.append(F.when(beside, F.least(F.abs(F.col("bx") - x1), F.abs(F.col("bx") - x2))))
    nearest.append(F.when(above, F.least(F.abs(F.col("by") - y1), F.abs(F.col("by") - y2))))
    return F.least(*nearest)


def _containment() -> Column:
    """Share of the ball box inside the player box."""
    width = F.least("x2", "bx2") - F.greatest("x1", "bx1")
    height = F.least("y2", "by2") - F.greatest("y1", "by1")
    area = (F.col("bx2") - F.col("bx1")) * (F.col("by2") - F.col("by1"))
    return F.when((width < 0) | (height < 0) | (area <= 0), F.lit(0.0)).otherwise(width * height / area)


def holder_candidates(tracks: DataFrame, ball: DataFrame, threshold: float = 120, containment: float = 0.8) -> DataFrame:
    """Per ball frame the player most likely holding it, -1 if none.

    Players that contain the ball come first, most contained ahead; else the nearest within ``threshold``.
    Join and aggregation share the (video, frame) partitioning.
    """
    box = ball.select(
        *FRAME, *[F.col(c).alias(f"b{c}") for c in ("x1", "y1", "x2", "y2")],
        ((F.col("x1") + F.col("x2")) / 2).alias("bx"), ((F.col("y1") + F.col("y2")) / 2).alias("by"),
    )
    pairs = box.join(tracks.select(*FRAME, "player_id", "x1", "y1", "x2", "y2"), FRAME, "left").withColumns(
        {"_inside": _containment(), "_reach": _reach()}
    )
    held = F.when(F.col("_inside") > containment, F.struct(F.lit(0).alias("tier"), (-F.col("_inside")).alias("score"), "player_id"))
    near = F.when(F.col("_reach") < threshold, F.struct(F.lit(1).alias("tier"), F.col("_reach").alias("score"), "player_id"))
    best = F.min(F.coalesce(held, near))
    return pairs.groupBy(*FRAME).agg(F.coalesce(best["player_id"], F.lit(-1)).cast("bigint").alias("candidate"))


def possession(
    candidates: DataFrame, frames: DataFrame, window: int = 5, grace: int = 3, batch_size: int | None = None,
    span: int = SPAN,
) -> DataFrame:
    """Holder per frame: majority of the last ``window`` ball frames, kept through short losses.

    ``batch_size`` restarts the state every so many frames.
    """
    keys = ["video_id"]
    if batch_size:
        batch = div_floor(F.col("frame_idx"), batch_size)
        candidates, frames = candidates.withColumn("_batch", batch), frames.withColumn("_batch", batch)
        keys.append("_batch")
    at = [*keys, "frame_idx"]

    numbered = positions(candidates.select(*at, "candidate"), keys, "frame_idx", name="_pos", span=span)
    w = span_window(keys, "_pos")
    lags = {f"_c{i}": F.lag("candidate", i).over(w) for i in range(window)}
    buffered = core_only(with_halo(numbered, "_pos", before=window - 1, span=span).withColumns(lags))
    buffer = [F.col(f"_c{i}") for i in range(window)]

    def votes(i: int) -> Column:
        return sum((F.coalesce(buffer[i] == other, F.lit(False)).cast("int") for other in buffer), F.lit(0))

    # most votes, then the earliest in the buffer (largest lag)
    mode = F.greatest(*[F.struct(votes(i).alias("n"), F.lit(i).alias("age"), buffer[i].alias("who")) for i in range(window)])
    full = F.col("_pos") >= window - 1
    sure = full & (mode["who"] != -1) & (mode["n"] >= window // 2)
    # narrow, and read four times below: written once rather than joined and voted again each time
    decided = durable(buffered.select(*at, full.alias("_full"), F.when(sure, mode["who"]).alias("_sure")))

    spine = frames.select(*at).join(decided, at, "left")
    miss = (F.col("_full").isNull() | (F.col("_full") & F.col("_sure").isNull())).cast("bigint")
    counted = running(spine, keys, "frame_idx", {"_missed": ("sum", miss, False)}, span=span, keep=True)
    confirmed = F.when(F.col("_sure").isNotNull(), F.struct("_sure", "_missed"))
    held = running(counted, keys, "frame_idx", {"_last": ("last", confirmed, True)}, span=span)
    recent = F.col("_full").isNotNull() | (F.col("_missed") - F.col("_last._missed") < grace)
    holder = F.when(F.col("_last").isNotNull() & recent, F.col("_last._sure")).otherwise(F.lit(-1))
    return held.select(*FRAME, holder.cast("bigint").alias("holder_id"))


def team_of_holder(possession: DataFrame, tracks: DataFrame, default: int = -1) -> DataFrame:
    """Team of the holder in that frame, ``default`` if the holder has no track there."""
    teams = tracks.select(*FRAME, F.col("player_id").alias("holder_id"), "team")
    return possession.join(teams, [*FRAME, "holder_id"], "left").withColumn(
        "team", F.coalesce(F.col("team"), F.lit(default)).cast("int")
    )


def ball_moves(possession: DataFrame, tracks: DataFrame, span: int = SPAN) -> DataFrame:
    """Passes and interceptions of every frame (pass_team, interception_team), from one pass over the holders.

    A pass: the team whose player received the ball from a team-mate of the frame before, else 0.  An interception: the team
    that took the ball from the last holder of the other team, else 0; frame 0 is never a last holder.
    """
    teams = team_of_holder(possession, tracks)
    here = F.struct("frame_idx", "holder_id", "team")
    holder = F.when((F.col("holder_id") != -1) & (F.col("frame_idx") >= 1), F.struct("holder_id", "team"))
    known = running(teams, ["video_id"], "frame_idx", {"_before": ("last", here, False), "_prev": ("last", holder, False)}, span=span)
    held = (F.col("holder_id") != -1) & (F.col("team") != -1)
    passed = (
        held & (F.col("_before.frame_idx") == F.col("frame_idx") - 1) & (F.col("_before.holder_id") != -1)
        & (F.col("holder_id") != F.col("_before.holder_id")) & (F.col("team") == F.col("_before.team"))
    )
    stolen = (
        held & (F.col("frame_idx") >= 1) & (F.col("holder_id") != F.col("_prev.holder_id"))
        & (F.col("_prev.team") != -1) & (F.col("team") != F.col("_prev.team"))
    )
    return known.select(*FRAME, *[
        F.when(happened, F.col("team")).otherwise(F.lit(0)).cast("int").alias(name)
        for name, happened in (("pass_team", passed), ("interception_team", stolen))
    ])


def passes(possession: DataFrame, tracks: DataFrame, span: int = SPAN) -> DataFrame:
    """Team whose player received the ball from a team-mate of the frame before, else 0."""
    return ball_moves(possession, tracks, span).drop("interception_team")


def interceptions(possession: DataFrame, tracks: DataFrame, span: int = SPAN) -> DataFrame:
    """Team that took the ball from the last holder of the other team, else 0."""
    return ball_moves(possession, tracks, span).drop("pass_team")


def possession_summary(possession: DataFrame, tracks: DataFrame) -> DataFrame:
    """Frames and share of possession per team."""
    teams = team_of_holder(possession.filter("holder_id <> -1"), tracks, default=0)
    counts = [F.count(F.when(F.col("team") == t, 1)).alias(f"team{t}_frames") for t in (1, 2)]
    total = F.col("team1_frames") + F.col("team2_frames")
    shares = {
        f"team{t}_pct": F.when(total > 0, pyround(F.col(f"team{t}_frames") / total * 100, 1)).otherwise(F.lit(0.0))
        for t in (1, 2)
    }
    return teams.groupBy("video_id").agg(*counts).withColumns(shares)


def possession_running(possession: DataFrame, tracks: DataFrame, span: int = SPAN) -> DataFrame:
    """Cumulative possession frames per team, as shown on screen."""
    teams = team_of_holder(possession, tracks, default=0)
    counts = {
        f"team{t}_frames": ("sum", ((F.col("holder_id") != -1) & (F.col("team") == t)).cast("bigint"), True) for t in (1, 2)
    }
    return running(teams, ["video_id"], "frame_idx", counts, span=span).select(*FRAME, "team1_frames", "team2_frames")


def pass_summary(moves: DataFrame, interceptions: DataFrame | None = None) -> DataFrame:
    """Passes and interceptions per team, from ``ball_moves`` or from ``passes`` and ``interceptions``."""
    if interceptions is not None:
        moves = moves.select("video_id", "pass_team", F.lit(0).alias("interception_team")).unionByName(
            interceptions.select("video_id", F.lit(0).alias("pass_team"), "interception_team"))
    return moves.groupBy("video_id").agg(
        *[F.count(F.when(F.col("pass_team") == t, 1)).alias(f"team{t}_passes") for t in (1, 2)],
        *[F.count(F.when(F.col("interception_team") == t, 1)).alias(f"team{t}_interceptions") for t in (1, 2)],
    )
