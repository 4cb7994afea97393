"""Highlight moments: audio energy, spacing, interval merging and fusion with visual events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.scale import SPAN, core_only, div_floor, pyround, running, span_window, with_halo

VIDEO = ["video_id"]


def rms_energy(audio: DataFrame, window_s: float = 0.25, rate: int = 22050) -> DataFrame:
    """Root mean square per tumbling window; an unfinished last window is dropped.

    ``amplitude`` may be a number or an array of channels, which is averaged.
    """
    hop = int(window_s * rate)
    value = F.col("amplitude")
    if dict(audio.dtypes)["amplitude"].startswith("array"):
        value = F.aggregate(value, F.lit(0.0), lambda a, x: a + x) / F.size(value)
    windows = audio.groupBy(*VIDEO, div_floor(F.col("sample_idx"), hop).alias("window_idx")).agg(
        F.sqrt(F.avg(value * value)).alias("energy"), F.count("*").alias("_n")
    )
    return windows.filter(F.col("_n") == hop).select(
        *VIDEO, "window_idx", (F.col("window_idx") * window_s).alias("time_s"), "energy"
    )


def energy_threshold(energy: DataFrame, k: float = 2.0, min_windows: int = 4) -> DataFrame:
    """Mean, threshold (mean + k population deviations) per video with enough windows."""
    stats = energy.groupBy(*VIDEO).agg(
        F.avg("energy").alias("mean_energy"), F.stddev_pop("energy").alias("_dev"), F.count("*").alias("windows")
    )
    return stats.filter(F.col("windows") >= min_windows).select(
        *VIDEO, "mean_energy", (F.col("mean_energy") + k * F.col("_dev")).alias("threshold"), "windows"
    )


def greedy_spacing(
    events: DataFrame, col: str, min_gap: float, keys: list[str] | None = None, span_gaps: int = 4096
) -> DataFrame:
    """Keep an event if it lies at least ``min_gap`` after the last *kept* one.

    Each span of ``span_gaps`` gaps is folded alone for every event that can be its first kept one (those in
    its first gap); the chain of spans then tells which of these starts is real.  Equal to the serial walk.
    """
    keys = keys or VIDEO
    gap = F.lit(min_gap)
    span = float(min_gap * span_gaps)
    at = [*keys, "_chunk"]
    chunk = F.floor(F.col(col) / F.lit(span)).cast("bigint")
    spans = events.select(*keys, col).distinct().withColumn("_chunk", chunk).groupBy(*at).agg(
        F.array_sort(F.collect_list(col)).alias("_evs")
    )

    def walk(start: Column, collect: bool) -> Column:
        """Fold over the events at or after ``start``, which is kept."""
        if collect:
            return F.aggregate(
                "_evs", F.filter("_evs", lambda _: F.lit(False)),
                lambda kept, e: F.when(
                    (e >= start) & ((F.size(kept) == 0) | (e - F.element_at(kept, -1) >= gap)), F.array_append(kept, e)
                ).otherwise(kept),
            )
        return F.aggregate("_evs", start, lambda last, e: F.when(e - last >= gap, e).otherwise(last))

    first = F.get("_evs", F.lit(0))
    # an event kept earlier lies before the span, so only events within one gap of its start can be blocked
    starts = F.filter("_evs", lambda e: e < F.col("_chunk") * F.lit(span) + gap)
    later = F.filter("_evs", lambda e: e >= F.col("_chunk") * F.lit(span) + gap)
    options = F.concat(starts, F.slice(later, 1, 1))
    summary = spans.select(*at, F.transform(options, lambda s: F.struct(s.alias("start"), walk(s, False).alias("exit"))).alias("_opt"))
    chain = summary.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_chunk", "_opt"))).alias("_c"))

    def enter(last: Column, opt: Column) -> Column:
        return F.filter(opt, lambda o: last.isNull() | (o["start"] - last >= gap))

    null_last = F.lit(None).cast(events.schema[col].dataType)
    empty = F.array().cast(f"array<struct<_chunk:bigint,start:{events.schema[col].dataType.simpleString()}>>")
    followed = F.aggregate(
        "_c", F.struct(null_last.alias("last"), empty.alias("entries")),
        lambda acc, c: F.struct(
            F.coalesce(F.get(enter(acc["last"], c["_opt"]), F.lit(0))["exit"], acc["last"]).alias("last"),
            F.array_append(acc["entries"], F.struct(
                c["_chunk"].alias("_chunk"), F.get(enter(acc["last"], c["_opt"]), F.lit(0))["start"].alias("start"))).alias("entries"),
        ),
    )
    entries = chain.select(*keys, F.explode(followed["entries"]).alias("e")).select(*keys, "e._chunk", "e.start")
    kept = spans.join(entries.filter("start IS NOT NULL"), at)
    return kept.select(*keys, F.explode(walk(F.col("start"), True)).alias(col))


def audio_peaks(energy: DataFrame, threshold: DataFrame, fps: float = 30.0, min_gap_s: float = 2.0) -> DataFrame:
    """Windows above the threshold at least ``min_gap_s`` apart, as seconds and frames."""
    loud = energy.join(threshold.select(*VIDEO, "threshold"), VIDEO).filter(F.col("energy") > F.col("threshold"))
    kept = greedy_spacing(loud.select(*VIDEO, "time_s"), "time_s", min_gap_s)
    return kept.select(
        *VIDEO, pyround(F.col("time_s"), 2).alias("peak_time_s"), F.rint(F.col("time_s") * fps).cast("bigint").alias("frame_idx")
    )


def confidence_intervals(
    conf: DataFrame, fps: float = 30.0, before: int = 4, after: int = 2, min_conf: float = 0.5, span: int = SPAN
) -> DataFrame:
    """Runs of high confidence, widened by seconds before and after; an open run ends with the video."""
    high = F.col("conf") >= min_conf
    w = span_window(VIDEO, "frame_idx").rangeBetween(-1, -1)
    marked = core_only(with_halo(conf, "frame_idx", before=1, span=span).withColumn("_prev", F.max("conf").over(w)), keep=True)
    low = F.when(~high, F.col("frame_idx"))
    nexts = running(marked, VIDEO, "frame_idx", {"_stop": ("last", low, False)}, span=span, reverse=True)
    ends = conf.groupBy(*VIDEO).agg((F.max("frame_idx") + 1).alias("_n"))
    starts = nexts.filter(high & (F.coalesce(F.col("_prev"), F.lit(0.0)) < min_conf)).join(ends, VIDEO)
    return starts.select(
        *VIDEO, F.greatest(F.lit(0), F.col("frame_idx") - int(before * fps)).cast("bigint").alias("start_pos"),
        F.coalesce(F.least("_n", F.col("_stop") + int(after * fps)), F.col("_n")).cast("bigint").alias("end_pos"),
    )


def merge_intervals(intervals: DataFrame, keys: list[str] | None = None, span: float = float(SPAN)) -> DataFrame:
    """Union of overlapping or touching intervals (start_pos, end_pos)."""
    keys = keys or VIDEO
    reach = running(intervals, keys, "start_pos", {"_reach": ("max", F.col("end_pos"), False)}, ties=["end_pos"], span=span, keep=True)
    opens = F.when(F.col("_reach").isNull() | (F.col("start_pos") > F.col("_reach")), F.col("start_pos"))
    labeled = running(reach, keys, "start_pos", {"_from": ("last", opens, True)}, ties=["end_pos"], span=span)
    return labeled.groupBy(*keys, F.col("_from").alias("start_pos")).agg(F.max("end_pos").alias("end_pos"))


def clip_seconds(intervals: DataFrame, videos: DataFrame) -> DataFrame:
    """Frame intervals cut to seconds inside the video; clips up to .1 s are dropped.  ``videos``: fps, duration_s."""
    joined = intervals.join(videos.select(*VIDEO, "fps", "duration_s"), VIDEO)
    start = F.greatest(F.lit(0.0), F.col("start_pos") / F.col("fps"))
    end = F.least(F.col("end_pos") / F.col("fps"), F.col("duration_s") - 0.001)
    return joined.select(*VIDEO, start.alias("start_s"), end.alias("end_s")).filter("end_s > start_s + 0.1D")


def moment_intervals(moments: DataFrame, videos: DataFrame, before: float = 3, after: float = 3) -> DataFrame:
    """Seconds around each moment, inside the video; shorter than half a second is dropped."""
    joined = moments.join(videos.select(*VIDEO, "fps", "duration_s"), VIDEO)
    at = F.col("frame_idx") / F.col("fps")
    return joined.select(
        *VIDEO, F.greatest(F.lit(0.0), at - float(before)).alias("start_pos"),
        F.least(F.col("duration_s") - 0.05, at + float(after)).alias("end_pos"),
    ).filter("end_pos > start_pos + 0.5D")


def distinct_moments(moments: DataFrame) -> DataFrame:
    return moments.select(*VIDEO, "frame_idx").distinct()


def _tolerance(tol_s: float, fps: float) -> int:
    return int(tol_s * fps)


def _near(left: DataFrame, right: DataFrame, tol: int) -> DataFrame:
    """``left`` moments with ``_hit`` telling whether any ``right`` moment of the video is within ``tol`` frames.

    ``right`` shrinks to one row per bucket of ``tol`` frames (its first and last moment); a moment compares
    with its own bucket and the two beside it.  No pair of moments is ever built.
    """
    width = max(1, tol)
    ends = right.groupBy(*VIDEO, div_floor(F.col("frame_idx"), width).alias("_b")).agg(
        F.min("frame_idx").alias("_lo"), F.max("frame_idx").alias("_hi")
    )
    around = left.select(*VIDEO, "frame_idx").distinct().withColumn(
        "_b", F.explode(F.array(*[div_floor(F.col("frame_idx"), width) + i for i in (-1, 0, 1)]))
    )
    hit = (
        F.when(F.col("_hi") <= F.col("frame_idx"), F.col("frame_idx") - F.col("_hi") <= tol)
        .when(F.col("_lo") >= F.col("frame_idx"), F.col("_lo") - F.col("frame_idx") <= tol)
        .otherwise(F.col("_lo").isNotNull())
    )
    return around.join(ends, [*VIDEO, "_b"], "left").groupBy(*VIDEO, "frame_idx").agg(
        F.max(F.coalesce(hit, F.lit(False))).alias("_hit")
    )


def audio_visual_cooccurrence(visual: DataFrame, audio: DataFrame, tol_s: float = 2.5, fps: float = 30.0) -> DataFrame:
    """Visual moments with an audio moment within the tolerance."""
    return _near(visual, audio, _tolerance(tol_s, fps)).filter("_hit").drop("_hit")


def standalone_audio(visual: DataFrame, audio: DataFrame, tol_s: float = 2.5, fps: float = 30.0) -> DataFrame:
    """Audio moments away from visual ones, and from each audio moment already taken."""
    tol = _tolerance(tol_s, fps)
    alone = _near(audio, visual, tol).filter("NOT _hit").drop("_hit")
    return greedy_spacing(alone, "frame_idx", tol + 1)


def fuse_highlights(visual: DataFrame, audio: DataFrame, tol_s: float = 2.5, fps: float = 30.0) -> DataFrame:
    """Visual moments and the standalone audio moments, each once."""
    extra = standalone_audio(visual, audio, tol_s, fps)
    return visual.select(*VIDEO, "frame_idx").union(extra.select(*VIDEO, "frame_idx")).distinct()
