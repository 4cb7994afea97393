"""From ball tracks to deliveries: tracking, segmentation, bounces, impact, kinematics and outcome."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlens.constants import (
    AIR_DRAG, BALL_RADIUS, GRAVITY, PITCH_LENGTH, RELEASE_HEIGHT, RESTITUTION,
)
from fieldlens.fold import chunked_fold
from fieldlens.functions.machines import BallGate, KalmanBall
from fieldlens.operators.cricket import lbw_columns
from fieldlens.operators.highlights import greedy_spacing
from fieldlens.scale import SPAN, core_only, positions, pyround, running, span_window, with_halo

VIDEO = ["video_id"]
DELIVERY = ["video_id", "delivery_key"]


# ---- ball tracking -----------------------------------------------------------------------------------

def _candidate(conf: float, streak_conf: float, max_px: float, min_px: float) -> Column:
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    ratio = w / F.greatest(h, F.lit(1e-4))
    streak = (ratio > 1.3) | (ratio < 0.77)
    sized = w.between(min_px, max_px) & h.between(min_px, max_px)
    return sized & ((F.col("conf") >= conf) | (streak & (F.col("conf") >= streak_conf)))


def ball_candidate_filter(
    detections: DataFrame, conf: float = 0.20, streak_conf: float = 0.14, max_px: float = 75, min_px: float = 3
) -> DataFrame:
    """Ball boxes of plausible size that are confident enough, blurred streaks a little less."""
    return detections.filter((F.col("cls") == "ball") & _candidate(conf, streak_conf, max_px, min_px))


_GATED = T.StructType([
    T.StructField("frame_idx", T.LongType()), T.StructField("det_id", T.LongType()),
    T.StructField("cx", T.LongType()), T.StructField("cy", T.LongType()), T.StructField("conf", T.DoubleType()),
])


def ball_gate(
    candidates: DataFrame, max_px: float = 220, forget: int = 5, span: int = SPAN, warmup: int = 512
) -> DataFrame:
    """Best ball candidate per frame, not farther than ``max_px`` from the last accepted one.

    ``candidates`` are all ball boxes; those that fail the static filter only keep the frame counted.  The
    memory is cleared after ``forget`` frames with boxes but no accepted one.
    """
    boxes = candidates.filter("cls = 'ball'").select(
        *VIDEO, "frame_idx", "det_id", ((F.col("x1") + F.col("x2")) / 2).alias("cx"),
        ((F.col("y1") + F.col("y2")) / 2).alias("cy"), "conf", _candidate(0.20, 0.14, 75, 3).alias("ok"),
    )
    # one row per frame: its candidates, best first
    packed = boxes.groupBy(*VIDEO, "frame_idx").agg(
        F.to_json(F.array_sort(F.collect_list(
            F.when(F.col("ok"), F.struct((-F.col("conf")).alias("o"), "det_id", "cx", "cy", "conf"))
        ))).alias("boxes")
    )
    return chunked_fold(
        packed, VIDEO, "frame_idx", lambda: BallGate(max_px, forget), _GATED, span=span, warmup=warmup
    )


_TRACKED = T.StructType([
    T.StructField("frame_idx", T.LongType()), T.StructField("cx", T.LongType()), T.StructField("cy", T.LongType()),
    T.StructField("conf", T.DoubleType()), T.StructField("interpolated", T.BooleanType()),
    *[T.StructField(c, T.DoubleType()) for c in ("x1", "y1", "x2", "y2")],
])


def kalman_ball(
    ball: DataFrame, frames: DataFrame, fps: float = 30, max_jump: float = 150, max_missed: int = 10, span: int = SPAN,
    warmup: int = 512,
) -> DataFrame:
    """Ball track smoothed by a constant-velocity filter that bridges short losses and rejects jumps."""
    boxes = ball.select(*VIDEO, "frame_idx", "cx", "cy", "conf", "x1", "y1", "x2", "y2")
    spine = frames.select(*VIDEO, "frame_idx").join(boxes, [*VIDEO, "frame_idx"], "left")
    return chunked_fold(
        spine, VIDEO, "frame_idx", lambda: KalmanBall(fps, max_jump, max_missed), _TRACKED, span=span, warmup=warmup
    )


# ---- segmentation ------------------------------------------------------------------------------------

def deliveries_segment(
    ball: DataFrame, tracks: DataFrame, frames: DataFrame, dead_frames: int = 16, min_frames: int = 5, min_final: int = 4,
    span: int = SPAN,
) -> DataFrame:
    """Deliveries of each video: start, last ball frame, completion frame, ball frames.

    Ball frames form islands that end after ``dead_frames`` without ball.  A delivery starts at the first
    island frame with a batsman on screen; at the end of the video an unfinished one is forced.
    """
    return flights(ball, tracks, frames, dead_frames, min_frames, min_final, span).filter("counted").drop("counted")


def flights(
    ball: DataFrame, tracks: DataFrame, frames: DataFrame, dead_frames: int = 16, min_frames: int = 5, min_final: int = 4,
    span: int = SPAN,
) -> DataFrame:
    """Every flight of the ball, also those too short to be a delivery (``counted`` is False)."""
    batsman = tracks.filter("role = 'batsman'").select(*VIDEO, "frame_idx").distinct().withColumn("_bat", F.lit(True))
    seen = ball.select(*VIDEO, "frame_idx").distinct().join(batsman, [*VIDEO, "frame_idx"], "left")
    w = span_window(VIDEO, "frame_idx").rangeBetween(-dead_frames, -1)
    marked = core_only(with_halo(seen, "frame_idx", before=dead_frames, span=span).withColumn("_near", F.count(F.lit(1)).over(w)), keep=True)
    opens = F.when(F.col("_near") == 0, F.col("frame_idx"))
    islands = running(marked, VIDEO, "frame_idx", {"_island": ("last", opens, True)}, span=span)
    starts = islands.groupBy(*VIDEO, "_island").agg(
        F.min(F.when(F.col("_bat"), F.col("frame_idx"))).alias("start_frame"), F.max("frame_idx").alias("last_ball_frame")
    ).filter("start_frame IS NOT NULL")
    counts = islands.join(starts.select(*VIDEO, "_island", "start_frame"), [*VIDEO, "_island"]).filter(
        "frame_idx >= start_frame"
    ).groupBy(*VIDEO, "_island").agg(F.count("*").alias("ball_frames"))
    last = frames.groupBy(*VIDEO).agg(F.max("frame_idx").alias("_end"))
    done = F.col("last_ball_frame") + dead_frames
    whole = starts.join(counts, [*VIDEO, "_island"]).join(last, VIDEO).withColumn("forced", done > F.col("_end"))
    enough = F.col("ball_frames") >= F.when(F.col("forced"), min_final).otherwise(min_frames)
    return whole.select(
        *VIDEO, "start_frame", "last_ball_frame", F.least(done, F.col("_end")).alias("done_frame"), "ball_frames", "forced",
        enough.alias("counted"),
    )


def delivery_points(points: DataFrame, deliveries: DataFrame, span: int = SPAN) -> DataFrame:
    """Assign rows with a frame to the first delivery completed at or after it; ``delivery_key`` is its start.

    As-of join: completions are merged into the rows and carried backward, so no row meets more than one delivery.
    """
    marks = deliveries.select(*VIDEO, F.col("done_frame").alias("frame_idx"), F.struct("start_frame", "done_frame").alias("_d"))
    rows = points.withColumn("_row", F.struct(*points.columns)).select(*VIDEO, "frame_idx", "_row")
    merged = rows.unionByName(marks, allowMissingColumns=True).withColumn("_mark", F.col("_d").isNotNull())
    # a completion at the same frame counts for the rows of that frame
    filled = running(merged, VIDEO, "frame_idx", {"_next": ("last", F.col("_d"), True)}, ties=["_mark"], span=span, reverse=True)
    kept = filled.filter("NOT _mark AND _next IS NOT NULL")
    return kept.select("_row.*", F.col("_next.start_frame").alias("delivery_key"))


def role_first_hit(tracks: DataFrame, deliveries: DataFrame, role: str = "batsman", span: int = SPAN) -> DataFrame:
    """Box of the first frame of each delivery that shows ``role``; the smallest player id on a tie."""
    shown = delivery_points(tracks.filter(F.col("role") == role), deliveries, span)
    first = F.min(F.struct("frame_idx", "player_id", "x1", "y1", "x2", "y2"))
    return shown.groupBy(*DELIVERY).agg(first.alias("f")).select(*DELIVERY, "f.*")


def last_n_points(points: DataFrame, n: int, keys: list[str] | None = None) -> DataFrame:
    """The last ``n`` points of each delivery, rank 1 = latest.

    ``row_number <= n`` makes Spark keep only ``n`` rows per delivery in each task before the shuffle.
    """
    keys = keys or DELIVERY
    latest = Window.partitionBy(*keys).orderBy(F.col("frame_idx").desc())
    return points.withColumn("rank", F.row_number().over(latest).cast("bigint")).filter(F.col("rank") <= n)


# ---- bounce and impact -------------------------------------------------------------------------------

def _slope_angle(dx: Column, dy: Column) -> Column:
    slope = F.when(dx != 0, dy / dx).otherwise(F.lit(999.0))
    return F.degrees(F.atan(F.abs(slope)))


def bounce_points(delivery_points: DataFrame, refractory: int = 10, span: int = SPAN) -> DataFrame:
    """Points where the ball turns from falling to rising, at least ``refractory`` frames apart.

    Five points in a row decide; the middle one is the bounce, the last one is when it is noticed.
    """
    numbered = positions(delivery_points, DELIVERY, "frame_idx", name="_pos", span=span)
    w = span_window(DELIVERY, "_pos")
    lags = {f"_p{i}": F.lag(F.struct("frame_idx", "cx", "cy"), 4 - i).over(w) for i in range(4)}
    lags["_p4"] = F.struct("frame_idx", "cx", "cy")
    five = core_only(with_halo(numbered, "_pos", before=4, span=span).withColumns(lags))

    def d(a: int, b: int, axis: str) -> Column:
        return F.col(f"_p{b}.{axis}") - F.col(f"_p{a}.{axis}")

    turning = (d(0, 1, "cy") > 0) & (d(1, 2, "cy") >= 0) & (d(3, 4, "cy") < d(1, 2, "cy"))
    found = five.filter((F.col("_pos") >= 4) & turning)
    spaced = greedy_spacing(found.select(*DELIVERY, "frame_idx"), "frame_idx", refractory, DELIVERY)
    a_in, a_out = _slope_angle(d(0, 2, "cx"), d(0, 2, "cy")), _slope_angle(d(2, 4, "cx"), d(2, 4, "cy"))
    return found.join(spaced, [*DELIVERY, "frame_idx"]).select(
        *DELIVERY, F.col("frame_idx").alias("noticed_frame"), F.col("_p2.frame_idx").alias("bounce_frame"),
        F.col("_p2.cx").alias("bounce_x"), F.col("_p2.cy").alias("bounce_y"),
        pyround(a_in, 1).alias("angle_in"), pyround(a_out, 1).alias("angle_out"), pyround(F.abs(a_in - a_out), 1).alias("deflection"),
    )


def last_bounces(bounces: DataFrame) -> DataFrame:
    """The last bounce of each delivery."""
    return bounces.groupBy(*DELIVERY).agg(F.max("bounce_frame").alias("bounce_frame"))


def shot_context(delivery_points: DataFrame, bounces: DataFrame, span: int = SPAN) -> DataFrame:
    """Mark the ball points of a delivery as before or after impact.

    Impact is the first point four frames after the last bounce, else a fixed share of the points.
    """
    numbered = positions(delivery_points, DELIVERY, "frame_idx", name="point_idx", span=span)
    per = numbered.join(last_bounces(bounces), DELIVERY, "left").withColumn(
        "_hit", F.when(F.col("frame_idx") >= F.col("bounce_frame") + 4, F.col("point_idx"))
    )
    totals = per.groupBy(*DELIVERY).agg(F.count("*").alias("_n"), F.min("_hit").alias("_first"))
    n = F.col("_n")
    fallback = F.when(n >= 4, F.greatest(F.lit(2), F.floor(n * 0.60))).otherwise(F.greatest(F.lit(1), F.floor(n / 2)))
    split = totals.select(*DELIVERY, F.coalesce("_first", fallback).cast("bigint").alias("impact_idx"))
    return numbered.join(split, DELIVERY).withColumn("after_impact", F.col("point_idx") >= F.col("impact_idx"))


def batsman_zone_contact(delivery_points: DataFrame, batsmen: DataFrame, how: str = "inner") -> DataFrame:
    """Ball points near the first batsman box of their delivery (``batsmen`` as from ``role_first_hit``)."""
    box = batsmen.select(*DELIVERY, "x1", "y1", "x2", "y2")
    pad_top = F.col("y1") + (F.col("y2") - F.col("y1")) * 0.55
    cx, cy = F.col("cx"), F.col("cy")
    near_bat = cx.between(F.col("x1") - 50, F.col("x2") + 50) & cy.between(F.col("y1") - 30, F.col("y2") + 30)
    near_pads = cx.between(F.col("x1") - 20, F.col("x2") + 20) & cy.between(pad_top - 20, F.col("y2") + 20)
    return delivery_points.join(box, DELIVERY, how).withColumns({"bat_zone": near_bat, "pad_zone": near_pads}).drop("x1", "y1", "x2", "y2")


def bowled_check(delivery_points: DataFrame, stumps: DataFrame, px: float = 40) -> DataFrame:
    """Whether one of the last three ball points lies on the batsman's stumps (sx, sy)."""
    last = last_n_points(delivery_points.select(*DELIVERY, "frame_idx", "cx", "cy"), 3)
    dx, dy = F.col("cx") - F.col("sx"), F.col("cy") - F.col("sy")
    on = last.join(stumps.select(*DELIVERY, "sx", "sy"), DELIVERY).withColumn("_on", F.sqrt(dx * dx + dy * dy) < px)
    return on.groupBy(*DELIVERY).agg((F.max("_on") & (F.count("*") >= 3)).alias("bowled"))


def delivery_outcome(
    delivery_points: DataFrame, batsmen: DataFrame, stumps: DataFrame, shots: DataFrame, reviews: DataFrame | None = None,
    stump_px: float = 40, span: int = SPAN,
) -> DataFrame:
    """Outcome of each delivery: bowled, leg before, boundary, runs or dot.

    ``shots`` (shot_label) and ``reviews`` (pitch_x, pitch_y, stump_x, stump_z) are optional per delivery.  The
    pad point is fixed and the on-field call is OUT, as in the source rules; ``six`` needs the label
    ``loft_shot``, which the shot classifier never gives.
    """
    zoned = batsman_zone_contact(delivery_points.select(*DELIVERY, "frame_idx", "cx", "cy"), batsmen, "left")
    numbered = positions(zoned, DELIVERY, "frame_idx", name="_pos", span=span)
    w = span_window(DELIVERY, "_pos")
    steps = core_only(with_halo(numbered, "_pos", before=1, after=1, span=span).withColumns({
        "_dx1": F.col("cx") - F.lag("cx").over(w), "_dy1": F.col("cy") - F.lag("cy").over(w),
        "_dx2": F.lead("cx").over(w) - F.col("cx"), "_dy2": F.lead("cy").over(w) - F.col("cy"),
    }))
    turned = (F.col("_dx1") * F.col("_dx2") + F.col("_dy1") * F.col("_dy2") < 0) | (
        (F.abs(F.col("_dx2") - F.col("_dx1")) > 20) & (F.abs(F.col("_dy2") - F.col("_dy1")) > 20)
    )
    # one row per delivery: its number of points and its stumps
    known = delivery_points.groupBy(*DELIVERY).agg(F.count("*").alias("_n")).join(stumps.select(*DELIVERY, "sx", "sy"), DELIVERY, "left")
    sized = steps.join(known, DELIVERY)
    inner = (F.col("_n") >= 4) & (F.col("_pos") >= 1)
    bat = inner & (F.col("_pos") <= F.col("_n") - 3) & F.col("bat_zone") & turned
    pad = inner & F.col("pad_zone")
    sx, sy = F.col("cx") - F.col("sx"), F.col("cy") - F.col("sy")
    on_stumps = (F.col("_n") >= 3) & (F.col("_pos") >= F.col("_n") - 3) & (F.sqrt(sx * sx + sy * sy) < stump_px)
    at = F.struct("frame_idx", "cx", "cy", (F.col("_n") - F.col("_pos")).alias("left"))
    full = sized.groupBy(*DELIVERY).agg(
        F.min(F.when(bat, at)).alias("_bat"), F.min(F.when(pad, at)).alias("_pad"), F.max(at).alias("_end"), F.max(on_stumps).alias("bowled"),
    ).join(shots.select(*DELIVERY, "shot_label"), DELIVERY, "left")
    bat_frame = F.col("_bat.frame_idx")
    if reviews is not None:
        full = full.join(reviews.select(*DELIVERY, "pitch_x", "pitch_y", "stump_x", "stump_z"), DELIVERY, "left")
    else:
        full = full.withColumns({c: F.lit(None).cast("double") for c in ("pitch_x", "pitch_y", "stump_x", "stump_z")})
    ruling = lbw_columns({
        "pitch_x": F.col("pitch_x"), "pitch_y": F.col("pitch_y"), "impact_x": F.lit(0.02), "impact_y": F.lit(18.0),
        "stump_x": F.coalesce("stump_x", F.lit(0.01)), "stump_z": F.coalesce("stump_z", F.lit(0.55)),
        "hand": F.lit("RHB"), "on_field_call": F.lit("OUT"), "shot_offered": F.lit(True), "bat_edge": F.lit(False),
    })
    full = full.withColumns({f"_{c}": v for c, v in ruling.items()})
    bowled = F.coalesce("bowled", F.lit(False))
    hit, padded = F.col("_bat").isNotNull(), F.col("_bat").isNull() & F.col("_pad").isNotNull()
    leg_before = padded & ~bowled
    dx, dy = F.col("_end.cx") - F.col("_bat.cx"), F.col("_end.cy") - F.col("_bat.cy")
    label = F.coalesce("shot_label", F.lit(""))
    boundary = (F.sqrt(dx * dx + dy * dy) > 180) | label.isin("loft_shot", "pull_shot")
    six = (label == "loft_shot") & (dy < 0)
    outcome = (
        F.when(bowled, "wicket")
        .when(leg_before, F.when(F.col("_final_verdict") == "OUT", "lbw_wicket").otherwise("lbw_not_out"))
        .when(hit & (F.col("_bat.left") >= 3), F.when(boundary, F.when(six, "six").otherwise("four")).otherwise("runs"))
        .otherwise("dot_ball")
    )
    verdict = {c: F.when(leg_before, F.col(f"_{c}")) for c in ("pitching", "impact", "wickets", "final_verdict", "reasons")}
    return full.select(
        *DELIVERY, outcome.alias("outcome"), outcome.isin("wicket", "lbw_wicket").alias("is_wicket"),
        outcome.isin("four", "six").alias("is_boundary"),
        F.coalesce(bat_frame, F.when(padded, F.col("_pad.frame_idx"))).alias("impact_frame"), padded.alias("is_pad_impact"),
        *[v.alias(c) for c, v in verdict.items()],
    )


# ---- kinematics --------------------------------------------------------------------------------------

def reconstruct_3d(delivery_points: DataFrame, bounces: DataFrame, fps: float = 30.0, span: int = SPAN) -> DataFrame:
    """Height of each metric point (mx, my) from ballistic flight before and after the bounce.

    Time counts observed points.  Without a bounce among the points 65 % of the flight is taken.
    """
    numbered = positions(delivery_points.filter("mx IS NOT NULL"), DELIVERY, "frame_idx", name="point_idx", span=span)
    per = numbered.join(bounces.select(*DELIVERY, "bounce_frame"), DELIVERY, "left")
    at = F.max(F.when(F.col("frame_idx") == F.col("bounce_frame"), F.col("point_idx")))
    shape = per.groupBy(*DELIVERY).agg(F.count("*").alias("_n"), at.alias("_at"))
    guess = F.least(F.greatest(F.lit(1), F.floor(F.col("_n") * 0.65)), F.col("_n") - 1)
    shape = shape.select(*DELIVERY, F.greatest(F.lit(1), F.coalesce("_at", guess)).cast("double").alias("_b"))
    dt = 1.0 / max(fps, 1.0)
    tb = F.col("_b") * dt
    vz0 = (F.lit(BALL_RADIUS - RELEASE_HEIGHT) + 0.5 * GRAVITY * tb * tb) / F.greatest(tb, F.lit(1e-4))
    rebound = -(vz0 - GRAVITY * tb) * RESTITUTION
    idx = F.col("point_idx")
    t, tp = idx * dt, (idx - F.col("_b")) * dt
    z = F.when(idx <= F.col("_b"), F.lit(RELEASE_HEIGHT) + vz0 * t - 0.5 * GRAVITY * t * t).otherwise(
        F.lit(BALL_RADIUS) + rebound * tp - 0.5 * GRAVITY * tp * tp
    )
    return numbered.join(shape, DELIVERY).select(
        *DELIVERY, "frame_idx", "point_idx", "mx", "my", F.greatest(F.lit(BALL_RADIUS), z).alias("mz")
    )


def _kmh(dx: Column, dy: Column, dz: Column, frames: Column, fps: float) -> Column:
    speed = F.sqrt(dx * dx + dy * dy + dz * dz) / (frames * (1.0 / fps)) * 3.6
    # least and greatest skip NULLs, so a missing second point must be kept apart
    return F.when(speed.isNotNull(), F.greatest(F.lit(30.0), F.least(F.lit(175.0), speed)))


def delivery_speeds(points_3d: DataFrame, bounces: DataFrame, fps: float = 30.0, span: int = SPAN) -> DataFrame:
    """Release, bounce and crease speed of each delivery, from points three apart."""
    w = span_window(DELIVERY, "point_idx")
    ahead = F.lead(F.struct("frame_idx", "mx", "my", "mz"), 3).over(w)
    back = F.lag("frame_idx", 4).over(w)
    moved = core_only(with_halo(points_3d, "point_idx", before=4, after=3, span=span).withColumns({"_q": ahead, "_back": back}))
    speed = _kmh(
        F.col("_q.mx") - F.col("mx"), F.col("_q.my") - F.col("my"), F.col("_q.mz") - F.col("mz"),
        F.col("_q.frame_idx") - F.col("frame_idx"), fps,
    )
    timed = moved.withColumn("_v", speed).join(bounces.select(*DELIVERY, "bounce_frame"), DELIVERY, "left")
    early = F.when(F.col("point_idx") < 5, F.col("_v"))
    # the points from the bounce on are its first four: those whose fourth point back lies before the bounce
    late = F.col("_back").isNull() | (F.col("_back") < F.col("bounce_frame"))
    landed = F.when((F.col("frame_idx") >= F.col("bounce_frame")) & late, F.col("_v"))
    ends = F.struct("frame_idx", "mx", "my", "mz")
    per = timed.groupBy(*DELIVERY).agg(
        F.count("*").alias("_n"), F.percentile(early, 0.75).alias("_release"), F.percentile(landed, 0.5).alias("_landed"),
        F.min(ends).alias("_a"), F.max(ends).alias("_b"),
    )
    span_frames = F.greatest(F.lit(1), F.col("_b.frame_idx") - F.col("_a.frame_idx"))
    whole = _kmh(
        F.col("_b.mx") - F.col("_a.mx"), F.col("_b.my") - F.col("_a.my"), F.col("_b.mz") - F.col("_a.mz"), span_frames, fps
    )
    release = F.greatest(F.lit(40.0), F.least(F.lit(160.0), F.coalesce("_release", whole)))
    per = per.withColumn("_r", release)
    slower = F.col("_landed").between(30.0, 175.0) & (F.col("_landed") < F.col("_r"))
    bounce = F.when(slower, F.least(F.col("_landed"), F.col("_r") * 0.90)).otherwise(F.col("_r") * 0.85)
    per = per.withColumn("_s", bounce)
    crease = F.col("_s") * 0.95
    known = F.col("_n") >= 2
    columns = {
        "release_speed_kmh": pyround(F.col("_r"), 1), "bounce_speed_kmh": pyround(F.col("_s"), 1),
        "crease_speed_kmh": pyround(crease, 1), "avg_speed_kmh": pyround((F.col("_r") + F.col("_s") + crease) / 3.0, 1),
        "max_speed_kmh": pyround(F.col("_r"), 1),
        "pitch_deceleration_pct": pyround(F.greatest(F.lit(5.0), (F.col("_r") - F.col("_s")) / F.col("_r") * 100.0), 1),
        "time_in_air_sec": pyround(span_frames * (1.0 / fps), 2),
    }
    return per.select(*DELIVERY, *[F.when(known, v).otherwise(F.lit(0.0)).alias(c) for c, v in columns.items()])


def project_to_stumps(impacts: DataFrame, fps: float = 30, target_y: float = PITCH_LENGTH) -> DataFrame:
    """Point (stump_x, stump_z) where a ball at (x, y, z) with velocity (vx, vy, vz) crosses the stumps plane.

    At most 100 steps of gravity and drag, taken by a whole Arrow batch of balls at once; the crossing lies
    between the last two points.
    """
    dt = 1.0 / fps

    @F.pandas_udf("stump_x double, stump_z double")
    def fly(x: pd.Series, y: pd.Series, z: pd.Series, vx: pd.Series, vy: pd.Series, vz: pd.Series) -> pd.DataFrame:
        at = np.array([x, y, z], dtype=np.float64)
        v = np.array([vx, np.where(vy <= 1.0, 30.0, vy), vz], dtype=np.float64)
        before, after = at.copy(), at.copy()
        for _ in range(100):
            go = at[1] < target_y
            if not go.any():
                break
            p, u = at[:, go], v[:, go]
            moved = p + u * dt
            moved[2] = p[2] + (u[2] * dt - 0.5 * GRAVITY * dt * dt)
            pull = AIR_DRAG * np.sqrt((u * u).sum(axis=0)) * u
            pull[2] += GRAVITY
            v[:, go] = u - pull * dt
            at[:, go] = moved
            before[:, go] = after[:, go]
            after[:, go] = [moved[0], np.minimum(target_y, moved[1]), np.maximum(0.0, moved[2])]
        part = np.clip((target_y - before[1]) / np.maximum(1e-5, after[1] - before[1]), 0.0, 1.0)
        cross = before + part * (after - before)
        return pd.DataFrame({"stump_x": cross[0], "stump_z": np.maximum(0.0, cross[2])})

    flown = impacts.withColumn("_e", fly("x", "y", "z", "vx", "vy", "vz"))
    return flown.select(*impacts.columns, "_e.stump_x", "_e.stump_z")


def project_pixels(delivery_points: DataFrame, steps: int = 8) -> DataFrame:
    """Next pixels of the ball from the slope of its last four points and a gravity term."""
    last = last_n_points(delivery_points.select(*DELIVERY, "frame_idx", "cx", "cy"), 4)
    at = F.struct("cx", "cy")
    ends = last.groupBy(*DELIVERY).agg(
        F.count("*").alias("_n"), F.min_by(at, "frame_idx").alias("_a"), F.max_by(at, "frame_idx").alias("_b")
    ).filter("_n >= 3")
    i = F.col("step")
    dx = (F.col("_b.cx") - F.col("_a.cx")) / (F.col("_n") - 1)
    dy = (F.col("_b.cy") - F.col("_a.cy")) / (F.col("_n") - 1)
    return ends.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps)))).select(
        *DELIVERY, "step", (F.col("_b.cx") + dx * i).cast("bigint").alias("px"),
        (F.col("_b.cy") + dy * i + F.lit(0.25) * (i * i)).cast("bigint").alias("py"),
    )


def bezier_trail(delivery_points: DataFrame, max_points: int = 20) -> DataFrame:
    """Quadratic curve through the first, middle and last of the recent points; fewer than three are passed through."""
    last = last_n_points(delivery_points.select(*DELIVERY, "frame_idx", "cx", "cy"), max_points)
    counted = last.groupBy(*DELIVERY).agg(
        F.count("*").alias("_n"), F.array_sort(F.collect_list(F.struct("frame_idx", "cx", "cy"))).alias("_p")
    )
    n = F.col("_n")
    points = F.when(n >= 3, F.least(n * 2, F.lit(40))).otherwise(n).cast("int")
    p0, p1, p2 = F.get("_p", F.lit(0)), F.get("_p", F.floor(n / 2).cast("int")), F.get("_p", (n - 1).cast("int"))
    i, last_i = F.col("step"), F.col("_k") - 1
    t = F.when(i == last_i, F.lit(1.0)).otherwise(i * (F.lit(1.0) / last_i))

    def curve(axis: str) -> Column:
        bent = (1 - t) * (1 - t) * F.col("_p0")[axis] + 2 * (1 - t) * t * F.col("_p1")[axis] + t * t * F.col("_p2")[axis]
        return F.when(n >= 3, bent).otherwise(F.get("_p", i)[axis]).cast("bigint")

    return counted.withColumns({"_k": points, "_p0": p0, "_p1": p1, "_p2": p2}).withColumn(
        "step", F.explode(F.sequence(F.lit(0), F.col("_k") - 1))
    ).select(*DELIVERY, "step", curve("cx").alias("px"), curve("cy").alias("py"))
