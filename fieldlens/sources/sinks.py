"""Match reports as JSON: one summary document per video, and one line per player or delivery.

The reports of all videos are written by one job.  Lists that grow with the video (players, deliveries,
transcript) are JSON lines next to the summary instead of an array inside it, so no row holds a whole video.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.scale import durable, spread


def _write(df: DataFrame, path: str, salts: int = 8, finish: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Rows of a video go to at most ``salts`` files, whatever the number of tasks before; ``finish`` works on them where they lie then."""
    salt = F.pmod(F.xxhash64(*[c for c, kind in df.dtypes if not kind.startswith(("map", "struct"))]), F.lit(salts))
    dealt = spread(df, "video_id", *([salt] if salts > 1 else []))
    (finish(dealt) if finish else dealt).write.mode("overwrite").partitionBy("video_id").json(path)


def write_basketball_report(report: DataFrame, players: DataFrame, path: str, rows_per_file: int = 1 << 14) -> None:
    """``summary/video_id=…`` with team, dominance, shot and continuity blocks; ``players/video_id=…`` with one line each.

    A video has as many files of players as ``rows_per_file`` asks for, 8 at most.
    """
    _write(report, f"{path}/summary", 1)
    players = durable(players)  # one row per player
    most = players.groupBy("video_id").count().agg(F.max("count")).first()[0] or 0
    _write(players, f"{path}/players", min(8, -(-most // rows_per_file) or 1))


def write_cricket_report(
    report: DataFrame, deliveries: DataFrame, path: str, finish: Callable[[DataFrame], DataFrame] | None = None
) -> None:
    """``summary/video_id=…`` with summary and label counts; ``deliveries/video_id=…`` with one line each, commentary included.

    ``finish`` adds columns that follow from the row, like the commentary, when the rows are dealt to the files: long texts are not shuffled.
    """
    _write(report, f"{path}/summary", 1)
    _write(deliveries, f"{path}/deliveries", finish=finish)


def label_counts(distribution: DataFrame) -> DataFrame:
    """Label -> count maps per video; the labels are a fixed vocabulary."""
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n"))))
    maps = distribution.groupBy("video_id", "kind").agg(pairs.alias("counts"))
    names = {"line": "line", "length": "length", "shot_played": "shot_types"}
    return maps.groupBy("video_id").agg(F.struct(*[
        F.first(F.when(F.col("kind") == kind, F.col("counts")), ignorenulls=True).alias(name) for kind, name in names.items()
    ]).alias("tactical_distributions"))
