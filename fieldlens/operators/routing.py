"""Which sport a video shows, which frames to look at, and how a run is progressing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlens.constants import BASKETBALL_STAGES, CRICKET_STAGES, FINISHED
from fieldlens.fold import chunked_fold
from fieldlens.functions.machines import LogProgress
from fieldlens.scale import SPAN, durable

VIDEO = ["video_id"]


def sample_frames(videos: DataFrame, n: int = 5) -> DataFrame:
    """``n`` frame numbers per video, evenly from 10 % to 90 % of it."""
    step = 0.8 / (n - 1) if n > 1 else 0.0
    shares = F.array(*[F.lit(0.9 if n > 1 and i == n - 1 else 0.1 + i * step) for i in range(n)])
    picked = videos.filter("total_frames > 0").select(*VIDEO, "fps", "total_frames", F.posexplode(shares).alias("sample_no", "_p"))
    frame = (F.col("_p") * F.col("total_frames")).cast("bigint")
    return picked.select(*VIDEO, "sample_no", frame.alias("frame_idx"), (frame / F.col("fps")).alias("time_s"))


def subsample_frames(df: DataFrame, skip: int = 2, max_frames: int | None = None) -> DataFrame:
    """Every ``skip``-th frame below ``max_frames``."""
    kept = df.filter(F.col("frame_idx") % skip == 0)
    return kept.filter(F.col("frame_idx") < max_frames) if max_frames is not None else kept


def classify_frame(frame_stats: DataFrame) -> DataFrame:
    """Sport and confidence from the shares of grass and hardwood colour."""
    green, wood = F.col("green_ratio"), F.col("wood_ratio")
    grass = (green > 0.22) & (green > wood * 1.5)
    floor = (wood > 0.25) & (wood > green * 2.0)
    sure = lambda share: F.least(F.lit(0.98), F.lit(0.60) + share * 0.8)
    return frame_stats.withColumns({
        "sport": F.when(grass, "cricket").when(floor, "basketball").when(green >= wood, "cricket").otherwise("basketball"),
        "conf": F.when(grass, sure(green)).when(floor, sure(wood)).otherwise(0.65),
    })


def route_votes(frame_votes: DataFrame, min_conf: float = 0.60) -> DataFrame:
    """Sport most frames of a video vote for, if decisive and confident on average; else unknown."""
    counts = frame_votes.groupBy(*VIDEO, "sport").agg(
        F.count("*").alias("votes"), F.sum("conf").alias("_conf"), F.min("frame_idx").alias("_first")
    )
    best = F.min(F.struct((-F.col("votes")).alias("v"), "_first", "sport"))
    total = counts.groupBy(*VIDEO).agg(best.alias("b"), F.sum("votes").cast("bigint").alias("samples"), F.sum("_conf").alias("_conf"))
    mean = F.col("_conf") / F.col("samples")
    decisive = (-F.col("b.v") >= F.floor(F.col("samples") / 2) + 1) & (mean >= min_conf)
    return total.select(
        *VIDEO, F.when(decisive, F.col("b.sport")).otherwise("unknown").alias("sport"), (-F.col("b.v")).alias("votes"),
        "samples", mean.alias("avg_confidence"),
    )


# ---- run logs ----------------------------------------------------------------------------------------

_PROGRESS = T.StructType([
    T.StructField("line_no", T.LongType()), T.StructField("pct", T.LongType()), T.StructField("current", T.LongType()),
    T.StructField("known_total", T.LongType()),
])


def _match(pattern: str, group: int = 1, line: str = "line") -> Column:
    found = F.regexp_extract(line, pattern, group)
    return F.when(found != "", found)


def parse_log_lines(run_log: DataFrame) -> DataFrame:
    """What each line says, NULL where it says nothing.  Works on batches and streams alike."""
    line = F.col("line")
    of8, of7 = (F.regexp_extract("line", rf"\[([1-{k}])/{k}\]", 1) for k in (8, 7))
    is8, is7 = of8 != "", of7 != ""
    stage = F.when(is8, of8.cast("int")).when(is7, of7.cast("int"))
    names = lambda table, key: F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key.cast("int"))
    basketball = line.contains("Auto-detected sport: BASKETBALL") | line.contains("Defaulting to BASKETBALL")
    cricket = line.contains("Auto-detected sport: CRICKET")
    done = stage.isNull() & (line.contains("Pipeline execution complete!") | line.contains("Analytics Report Saved"))
    bar = line.contains("Processing") | line.contains("%|")
    progress = r"(\d+)%\|.*\|\s*(\d+)/(\d+)"
    fps = F.coalesce(_match(r"FPS=([0-9.]+)"), _match(r"([0-9.]+)\s*(?:frames/s|it/s)"))
    eta_given = _match(r"ETA=([0-9a-zA-Z\s:]+?)(?:,|$)")
    eta = F.trim(F.coalesce(eta_given, _match(r"<([0-9:]+)")))
    idle = F.when(eta_given.isNotNull(), eta.isin("0s", "00:00", "0", "")).otherwise(eta.isin("00:00", "0", ""))
    number = lambda c: c.cast("bigint")
    return run_log.withColumns({
        "sport": F.when(basketball, "basketball").when(cricket, "cricket"),
        "stage": stage,
        "stage_name": F.when(is8, names(BASKETBALL_STAGES, of8)).when(is7, names(CRICKET_STAGES, of7)).when(done, FINISHED),
        "total_stages": F.when(stage == 1, F.when(is8, 8).otherwise(7)).when(basketball, 8).when(cricket, 7),
        "completed": F.when(done, True),
        "declared": F.when(stage == 3, number(_match(r"Total Frames:\s*(\d+)"))),
        "finished_pct": F.when(stage == 5, F.lit(100).cast("bigint")),
        "pct": F.when(bar, number(_match(progress, 1))), "current": F.when(bar, number(_match(progress, 2))),
        "total": F.when(bar, number(_match(progress, 3))),
        "fps": F.when(bar, fps), "eta": F.when(bar & ~idle, eta),
        "vram": F.coalesce(_match(r"VRAM=([0-9a-zA-Z]+)"), F.trim(_match(r"GPU VRAM:\s*([0-9.]+\s*GB)"))),
    })


def run_log_parse(run_log: DataFrame, span: int = SPAN) -> DataFrame:
    """Latest status per run.

    Every field is the last one said, a map-side pre-aggregated ``max_by``.  Only the progress bar needs the
    lines in order: a bar whose total is far below the known one is a nested bar and does not count.
    """
    said = parse_log_lines(run_log)

    def last(column: str) -> Column:
        return F.max_by(column, F.when(F.col(column).isNotNull(), F.col("line_no"))).alias(column)

    fields = ("sport", "stage", "stage_name", "total_stages", "completed", "fps", "eta", "vram")
    ended = F.max(F.when(F.col("finished_pct").isNotNull(), F.col("line_no"))).alias("_ended")
    status = said.groupBy("run_id").agg(*[last(c) for c in fields], ended)
    bars = durable(said.filter("declared IS NOT NULL OR total IS NOT NULL").select("run_id", "line_no", "declared", "total", "pct", "current"))
    shown = chunked_fold(bars, ["run_id"], "line_no", LogProgress, _PROGRESS, span=span).groupBy("run_id").agg(
        last("pct"), last("current").alias("current_frame"), last("known_total").alias("total_frames"),
        F.max(F.when(F.col("pct").isNotNull(), F.col("line_no"))).alias("_shown"),
    )
    hundred = F.col("_ended").isNotNull() & (F.col("_shown").isNull() | (F.col("_ended") > F.col("_shown")))
    return status.join(shown, "run_id", "left").select(
        "run_id", *[c for c in fields if c != "completed"], F.coalesce("completed", F.lit(False)).alias("completed"),
        F.when(hundred, F.lit(100).cast("bigint")).otherwise(F.col("pct")).alias("progress_pct"), "current_frame", "total_frames",
    )
