"""Basketball shots: parabolic arcs of the ball and make or miss."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlens.fold import chunked_fold
from fieldlens.functions.columns import parabola, power_terms
from fieldlens.functions.machines import ShotTracker
from fieldlens.scale import CHUNK, SPAN, core_only, positions, span_window, with_halo

VIDEO = ["video_id"]


def rolling_parabola(ball: DataFrame, n: int = 45, min_n: int = 16, span: int = SPAN) -> DataFrame:
    """Parabola through the last ``n`` ball heights at every ball frame, and whether it is a shot arc.

    Blocks of about ``n`` points keep time small next to the window, so plain sums stay precise.
    """
    heights = ball.select(*VIDEO, "frame_idx", ((F.col("y1") + F.col("y2")) / 2).alias("_y"))
    numbered = positions(heights, VIDEO, "frame_idx", name="_pos", span=span)
    haloed = with_halo(numbered, "_pos", before=n - 1, span=max(64, n))
    block = Window.partitionBy(*VIDEO, CHUNK)
    ordered = span_window(VIDEO, "_pos")
    timed = haloed.withColumns({"_t0": F.min("frame_idx").over(block), "_y0": F.min("_y").over(block)})
    timed = timed.withColumns({"_t": (F.col("frame_idx") - F.col("_t0")).cast("double"), "_h": F.col("_y") - F.col("_y0")})
    # sums over the last n points as differences of running sums: one addition per row, not n
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    terms = power_terms(F.col("_t"), F.col("_h"))
    total = timed.withColumns({f"_s_{k}": F.sum(v).over(so_far) for k, v in terms.items()})
    window = total.withColumns({f"_{k}": F.col(f"_s_{k}") - F.coalesce(F.lag(f"_s_{k}", n).over(ordered), F.lit(0.0)) for k in terms})
    fit = core_only(window).filter(F.col("_n") >= min_n).withColumns(
        {f"_{k}": v for k, v in parabola({k: F.col(f"_{k}") for k in terms}).items()})
    arc = (F.col("_a") > 0.1) & (F.col("_r2") > 0.8)
    apex = F.col("_t0") - F.col("_b") / (2 * F.col("_a"))
    return fit.select(
        *VIDEO, "frame_idx", F.col("_n").cast("bigint").alias("points"), F.col("_a").alias("a"), F.col("_r2").alias("r2"),
        F.coalesce(arc, F.lit(False)).alias("is_arc"), F.when(arc, apex).alias("apex_frame"),
    )


def shot_arcs(ball: DataFrame, span: int = SPAN) -> DataFrame:
    """Frames on a shot arc and whether the ball falls; the set-based form that never clears its history."""
    arcs = rolling_parabola(ball, span=span).filter("is_arc")
    return arcs.withColumn("is_falling", F.col("apex_frame") < F.col("frame_idx"))


_SHOTS = T.StructType([
    T.StructField("frame_idx", T.LongType()), T.StructField("conf", T.DoubleType()), T.StructField("shot", T.StringType()),
])


def shot_state(ball: DataFrame, frames: DataFrame, span: int = SPAN, warmup: int = 512) -> DataFrame:
    """Shot confidence per frame (1.0 make, 0.5 miss, 0.6 in flight) and the result where a shot ends."""
    center = ball.select(*VIDEO, "frame_idx", ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"))
    spine = frames.select(*VIDEO, "frame_idx", "width", "height").join(center, [*VIDEO, "frame_idx"], "left")
    return chunked_fold(spine, VIDEO, "frame_idx", ShotTracker, _SHOTS, span=span, warmup=warmup)


def shot_frames(confidences: DataFrame, min_conf: float = 0.5) -> DataFrame:
    """Frames at or above the confidence; the report calls them shot events."""
    return confidences.groupBy(*VIDEO).agg(F.count(F.when(F.col("conf") >= min_conf, 1)).alias("shot_events"))
