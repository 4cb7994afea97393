"""Run logs as text files: numbered lines from a folder, as a table or as a stream.

A collector writes ``<path>/slice=<n>/<any name>.log`` with lines ``<run_id>|<line>``; the lines of a run lie in one file of a
slice, in the order they were written.  Empty lines count for nothing, a lone carriage return ends a line (progress bars).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldlens.scale import SPAN, durable, positions
from fieldlens.streaming.streams import ENDED, prepare

END_OF_RUN = "<end of run>"
_FILE = "_metadata.file_path"


def _slice() -> Column:
    return F.regexp_extract(_FILE, r"slice=(\d+)/[^/]*$", 1).cast("bigint").alias("slice")


def _said(rows: DataFrame) -> DataFrame:
    """Run and text of each raw line; lines without a run or a text are left out."""
    run, text = F.substring_index("value", "|", 1), F.expr("substring(value, instr(value, '|') + 1)")
    named = rows.filter(F.col("value").contains("|")).withColumns({"run_id": run.cast("bigint"), "line": F.rtrim(text, F.lit("\r\n"))})
    return named.filter("run_id IS NOT NULL AND line <> ''").drop("value")


def write_run_logs(run_log: DataFrame, path: str, lines_per_slice: int, lines_per_file: int = 1 << 14) -> None:
    """Lay out numbered lines as a collector would: slices by line number, a run's lines of a slice in one file.

    A slice has as many files as its lines fill, whatever the number of tasks: many short slices are not cut into ever smaller files.
    """
    number = F.floor(F.col("line_no") / lines_per_slice).cast("bigint").alias("slice")
    text = F.concat_ws("|", F.col("run_id").cast("string"), "line").alias("value")
    tasks = int(run_log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = run_log.select(number, "run_id", "line_no", text)
    files = lines.groupBy("slice").agg(F.ceil(F.count("*") / lines_per_file).cast("bigint").alias("_files"))  # one small row per slice
    dealt = lines.join(F.broadcast(files), "slice").withColumn("_file", F.pmod(F.xxhash64("run_id"), F.col("_files")))
    placed = dealt.repartition(tasks, "slice", "_file").sortWithinPartitions("slice", "_file", "run_id", "line_no")
    placed.select("slice", "value").write.mode("append").partitionBy("slice").text(path)


def run_logs(spark: SparkSession, path: str, span: int = SPAN) -> DataFrame:
    """Table (run_id, line_no, line) of a folder of log files of any size; ``line_no`` counts a run's lines from 0 across files.

    Spark reads a file in blocks and keeps the order inside a block.  Blocks are numbered by slice, file and place, one row each,
    so every line gets its place among all lines; the numbers within a run come from there span by span.
    """
    raw = spark.read.text(path).select(
        "value", _slice(), F.col(_FILE).alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    lines = durable(_said(raw))  # the ids are only good for one reading
    block = ["slice", "_file", "_block"]
    before = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    size = F.max("_id") - F.min("_id") + 1
    blocks = lines.groupBy(*block).agg(F.min("_id").alias("_first"), size.alias("_n")).select(
        *block, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    placed = lines.join(blocks, block).select("run_id", "line", (F.col("_offset") + F.col("_id") - F.col("_first")).alias("_at"))
    return positions(placed, ["run_id"], "_at", name="line_no", span=span).select("run_id", "line_no", "line")


def log_stream(spark: SparkSession, path: str, max_files: int | None = None, delay: str = "1 second", start: float = 86400.0) -> DataFrame:
    """Lines as files arrive: ``run_id``, ``slice``, ``at`` (place in the file), ``line``, with the slice as event time in seconds.

    A file travels as one row until it is split, so a collector must rotate its files well below the memory of a task.  A line
    ``END_OF_RUN`` in a later slice only moves the watermark.
    """
    prepare(spark)
    reader = spark.readStream.option("wholetext", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    files = reader.text(path).select("value", _slice())
    lines = files.select("slice", F.posexplode(F.split("value", "\r\n|\n|\r")).alias("at", "value"))
    timed = _said(lines).withColumn("event_time", F.timestamp_micros(((F.lit(start) + F.col("slice")) * 1_000_000).cast("bigint")))
    return timed.withColumns({ENDED: F.col("line") == END_OF_RUN, "at": F.col("at").cast("bigint")}).withWatermark("event_time", delay)
