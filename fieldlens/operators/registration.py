"""Court registration: keypoint checks, homography quality and continuity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlens.constants import court_reference
from fieldlens.fold import chunked_fold
from fieldlens.functions.columns import let
from fieldlens.functions.machines import HomographyCascade
from fieldlens.operators.court import homography_lookup
from fieldlens.scale import SPAN, positions, pyround, running, spread

FRAME = ["video_id", "frame_idx"]
KEYPOINTS = 18


def court_reference_table(spark: SparkSession) -> DataFrame:
    """The 18 court keypoints of the template (kp_idx, ref_x, ref_y)."""
    rows = [(i, float(x), float(y)) for i, x, y in court_reference()]
    return spark.createDataFrame(rows, "kp_idx bigint, ref_x double, ref_y double")


def _seen() -> Column:
    return (F.col("x") > 0) & (F.col("y") > 0) & (F.col("kp_idx") < KEYPOINTS)


def keypoint_observed(keypoints: DataFrame, min_points: int = 4) -> DataFrame:
    """Observed keypoints per frame and whether they are enough for a homography."""
    return keypoints.groupBy(*FRAME).agg(F.count(F.when(_seen(), 1)).alias("observed")).withColumn(
        "usable", F.col("observed") >= min_points
    )


def keypoint_carry_forward(keypoints: DataFrame, frames: DataFrame, conf: float = 0.6, span: int = SPAN) -> DataFrame:
    """Keypoints of every frame: unsure ones keep the last sure value, else the first one ever seen, else zero."""
    spine = frames.select(*FRAME).withColumn("kp_idx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(KEYPOINTS - 1).cast("bigint"))))
    seen = spine.join(keypoints.select(*FRAME, "kp_idx", "x", "y", "conf"), [*FRAME, "kp_idx"], "left")
    sure = F.when(F.col("conf") >= conf, F.struct("x", "y"))
    first = F.when(F.col("x").isNotNull(), F.struct("frame_idx", "x", "y"))
    filled = running(
        seen, ["video_id", "kp_idx"], "frame_idx", {"_sure": ("last", sure, True), "_first": ("min", first, True)}, span=span
    )
    value = lambda c: F.coalesce(F.col(f"_sure.{c}"), F.col(f"_first.{c}"), F.lit(0.0)).alias(c)
    return filled.select(*FRAME, "kp_idx", value("x"), value("y"))


def keypoint_ratio_validation(keypoints: DataFrame, reference: DataFrame, margin: float = 0.8) -> DataFrame:
    """Zero the keypoints whose distances to two others do not have the proportion they have on the court.

    Keypoints are judged in index order and a rejected one is no longer used, so each frame's at most 18
    points are folded with the set of rejected ones.
    """
    known = keypoints.join(F.broadcast(reference), "kp_idx")  # 18 rows, fixed
    point = F.struct("kp_idx", "x", "y", "ref_x", "ref_y")
    sets = spread(known.filter(_seen()), *FRAME).groupBy(*FRAME).agg(F.array_sort(F.collect_list(point)).alias("_p"))

    def dist(a: Column, b: Column, x: str, y: str) -> Column:
        return F.sqrt((a[x] - b[x]) * (a[x] - b[x]) + (a[y] - b[y]) * (a[y] - b[y]))

    def judge(bad: Column, p: Column) -> Column:
        others = F.filter("_p", lambda q: (q["kp_idx"] != p["kp_idx"]) & ~F.array_contains(bad, q["kp_idx"]))

        def wrong(two: Column) -> Column:
            j, k = F.get(two, F.lit(0)), F.get(two, F.lit(1))
            d_ik, t_ij, t_ik = dist(p, k, "x", "y"), dist(p, j, "ref_x", "ref_y"), dist(p, k, "ref_x", "ref_y")
            expected = t_ij / t_ik
            error = F.abs((dist(p, j, "x", "y") / d_ik - expected) / expected)
            return k.isNotNull() & (t_ij > 0) & (t_ik > 0) & ((d_ik == 0) | (error > margin))

        return F.when(let(F.slice(others, 1, 2), wrong), F.array_append(bad, p["kp_idx"])).otherwise(bad)

    none = F.array().cast("array<bigint>")
    bad = F.when(F.size("_p") >= 3, F.aggregate("_p", none, judge)).otherwise(none)
    judged = sets.select(*FRAME, bad.alias("_bad"))
    checked = keypoints.join(judged, FRAME, "left")
    invalid = F.coalesce(F.array_contains("_bad", F.col("kp_idx")), F.lit(False))
    return checked.select(
        *FRAME, "kp_idx", F.when(invalid, 0.0).otherwise(F.col("x")).alias("x"),
        F.when(invalid, 0.0).otherwise(F.col("y")).alias("y"), invalid.alias("rejected"),
    )


def homography_quality(keypoints: DataFrame, calibrations: DataFrame, reference: DataFrame, span: int = SPAN) -> DataFrame:
    """Mean reprojection distance per frame, with flags for mirrored matrices and reversed keypoint order."""
    known = keypoints.filter(_seen())
    looked = homography_lookup(known.join(F.broadcast(reference), "kp_idx"), calibrations)  # 18 rows, fixed
    h = F.col("h")
    w = h[6] * F.col("x") + h[7] * F.col("y") + h[8]
    px, py = (h[0] * F.col("x") + h[1] * F.col("y") + h[2]) / w, (h[3] * F.col("x") + h[4] * F.col("y") + h[5]) / w
    dx, dy = px - F.col("ref_x"), py - F.col("ref_y")
    error = looked.groupBy(*FRAME).agg(
        F.avg(F.sqrt(dx * dx + dy * dy)).alias("mean_error"), F.min(h[0] * h[4] - h[1] * h[3]).alias("_det"), F.count("*").alias("points")
    )
    # distance to the frame before, in the same and in reversed order
    seen = known.select(*FRAME).distinct()
    before = running(seen, ["video_id"], "frame_idx", {"_before": ("last", F.col("frame_idx"), False)}, span=span)
    old = known.select("video_id", F.col("frame_idx").alias("_before"), F.col("kp_idx").alias("_k"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    sides = F.array(F.struct(F.lit(False).alias("rev"), F.col("kp_idx").alias("k")), F.struct(F.lit(True).alias("rev"), (F.lit(KEYPOINTS - 1) - F.col("kp_idx")).alias("k")))
    turned = known.join(before, FRAME).withColumn("_s", F.explode(sides)).withColumns({"_k": F.col("_s.k"), "_rev": F.col("_s.rev")})
    moved = F.sqrt((F.col("x") - F.col("_x")) * (F.col("x") - F.col("_x")) + (F.col("y") - F.col("_y")) * (F.col("y") - F.col("_y")))
    order = turned.join(old, ["video_id", "_before", "_k"]).groupBy(*FRAME).agg(
        F.avg(F.when(~F.col("_rev"), moved)).alias("_same"), F.avg(F.when(F.col("_rev"), moved)).alias("_turned")
    )
    return error.join(order, FRAME, "left").select(
        *FRAME, "points", "mean_error", (F.col("_det") < 0).alias("is_flipped"),
        F.coalesce(F.col("_turned") < F.col("_same"), F.lit(False)).alias("is_reversed"),
    )


def homography_mode(keypoints: DataFrame, motion: DataFrame, frames: DataFrame, budget: int = 90, span: int = SPAN) -> DataFrame:
    """How each frame gets its homography: direct, cmc (camera motion), static or lost.

    ``motion`` holds the frames whose camera motion is known.  After ``budget`` frames without keypoints, or before
    the first direct one, a frame is lost.
    """
    direct = keypoint_observed(keypoints).filter("usable").select(*FRAME, F.lit(True).alias("_direct"))
    moving = motion.select(*FRAME, F.lit(True).alias("_moving"))
    spine = frames.select(*FRAME).join(direct, FRAME, "left").join(moving, FRAME, "left")
    numbered = positions(spine, ["video_id"], "frame_idx", name="_pos", span=span, keep=True)
    since = running(numbered, ["video_id"], "frame_idx", {"_at": ("last", F.when(F.col("_direct"), F.col("_pos")), True)}, span=span)
    age = F.col("_pos") - F.col("_at")
    mode = F.when(F.col("_direct"), "direct").when(age <= budget, F.when(F.col("_moving"), "cmc").otherwise("static")).otherwise("lost")
    return since.select(*FRAME, mode.alias("mode"))


_CASCADE = T.StructType([
    T.StructField("frame_idx", T.LongType()), T.StructField("mode", T.StringType()), T.StructField("h", T.ArrayType(T.DoubleType())),
])


def cascade_homography(calibrations: DataFrame, motion: DataFrame, frames: DataFrame, budget: int = 90, span: int = SPAN, warmup: int = 512) -> DataFrame:
    """Homography of every frame from per-frame direct ones (h) and camera motion (m), both 9 numbers.

    Matrix blending and scaling make each step depend on the one before, so this is a fold.
    """
    spine = frames.select(*FRAME).join(calibrations.select(*FRAME, "h"), FRAME, "left").join(motion.select(*FRAME, "m"), FRAME, "left")
    return chunked_fold(spine, ["video_id"], "frame_idx", lambda: HomographyCascade(budget), _CASCADE, span=span, warmup=warmup)


def tracking_continuity(modes: DataFrame) -> DataFrame:
    """Percent of frames per way of registration."""
    total = F.greatest(F.lit(1), F.count("*"))
    direct, lost = F.count(F.when(F.col("mode") == "direct", 1)), F.count(F.when(F.col("mode") == "lost", 1))
    fallback = F.count(F.when(F.col("mode").isin("cmc", "static"), 1))
    share = lambda n: pyround(n / total * 100, 2)
    return modes.groupBy("video_id").agg(
        F.count("*").alias("total_frames"), share(direct).alias("direct_keypoint_pct"), share(fallback).alias("optical_flow_cmc_pct"),
        share(direct + fallback).alias("overall_continuity_pct"), share(lost).alias("lost_frames_pct"),
    )
