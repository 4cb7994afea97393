"""Files on disk: typed table scans, the catalogue of videos and the lookup of their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlens.constants import BASKETBALL_WORDS, CRICKET_WORDS, VIDEO_EXTENSIONS
from fieldlens.scale import pyround


_AT = ("video_id BIGINT", "frame_idx BIGINT")
_BOX = ("x1 DOUBLE", "y1 DOUBLE", "x2 DOUBLE", "y2 DOUBLE")
SCHEMAS = {name: ", ".join(fields) for name, fields in {
    "tracks": (*_AT, "player_id BIGINT", *_BOX, "conf DOUBLE", "team INT", "is_referee BOOLEAN", "is_sideline BOOLEAN", "jersey STRING"),
    "ball": (*_AT, *_BOX, "cx DOUBLE", "cy DOUBLE", "conf DOUBLE", "interpolated BOOLEAN"),
    "detections": (*_AT, "det_id BIGINT", "cls STRING", *_BOX, "conf DOUBLE"),
    "frames": (*_AT, "width INT", "height INT"),
    "positions": (*_AT, "player_id BIGINT", "x DOUBLE", "y DOUBLE"),
}.items()}


def scan_tracks(spark: SparkSession, path: str, schema: str | T.StructType = "tracks", fmt: str = "parquet") -> DataFrame:
    """Read a track-like table with a declared schema; column pruning and filters reach the files."""
    declared = SCHEMAS.get(schema, schema) if isinstance(schema, str) else schema
    return spark.read.schema(declared).format(fmt).load(path)


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """Paths, sizes and times of the files below ``path``; their content is not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select("path", "length", F.unix_micros("modificationTime").alias("mtime"))


def _dir_rank(folder: Column, folders: list[str]) -> Column:
    """Position of the folder in the search order, NULL if it is not searched."""
    ranked = F.create_map(*[x for i, f in enumerate(folders) for x in (F.lit(f), F.lit(i))])
    return F.element_at(ranked, folder)


def _parts(df: DataFrame) -> DataFrame:
    return df.withColumns({"_dir": F.regexp_extract("path", r"^(.*)/[^/]*$", 1), "_name": F.regexp_extract("path", r"([^/]*)$", 1)})


# result files: suffix after the video's name -> kind
KINDS = {
    "_annotated_web.mp4": "annotated_web", "_annotated.mp4": "annotated", "_analytics.json": "analytics",
    "_highlights.mp4": "highlights", "_team1_heatmap.jpg": "team1_heatmap", "_team2_heatmap.jpg": "team2_heatmap",
    "_pitch_map.jpg": "pitch_map", "_ground_radar.jpg": "ground_radar",
}


def _outputs(outputs: DataFrame, root: str) -> DataFrame:
    """Result files with place (out, basketball, cricket, stats), stem and kind."""
    places = {root: "out", f"{root}/basketball": "basketball", f"{root}/cricket": "cricket", f"{root}/cricket/stats": "stats"}
    suffix = F.regexp_extract("_name", "(" + "|".join(k.replace(".", r"\.") for k in KINDS) + ")$", 1)
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), suffix)
    place = F.element_at(F.create_map(*[F.lit(x) for kv in places.items() for x in kv]), F.col("_dir"))
    plain = F.regexp_extract("_name", r"^(.*)\.json$", 1)
    return _parts(outputs).withColumns({"_suffix": suffix, "place": place}).select(
        "path", "content", "place", "_name",
        F.when(F.col("_suffix") != "", F.expr("substring(_name, 1, length(_name) - length(_suffix))")).otherwise(plain).alias("stem"),
        F.when(F.col("_suffix") != "", kind).when(plain != "", "report").alias("kind"),
    ).filter("place IS NOT NULL AND kind IS NOT NULL")


def _found(places: list[str], kinds: list[str]) -> Column:
    return F.coalesce(F.max(F.col("place").isin(places) & F.col("kind").isin(kinds)), F.lit(False))


def _says_cricket(content: Column) -> Column:
    sport = F.get_json_object(content, "$.metadata.sport") == "cricket"
    listed = F.array_contains(F.json_object_keys(content), "deliveries")
    return F.coalesce(sport, F.lit(False)) | F.coalesce(listed, F.lit(False))


def _flags(outputs: DataFrame, root: str) -> DataFrame:
    """One row per stem telling which results exist; a stem has a handful of files."""
    known = _outputs(outputs, root)
    order = F.when(F.col("place") == "basketball", 0).when(F.col("place") == "out", 1)
    report = F.min_by("content", F.when(F.col("kind") == "analytics", order))
    return known.groupBy("stem").agg(
        _found(["basketball", "out"], ["annotated", "annotated_web"]).alias("bb_annotated"),
        _found(["basketball", "out"], ["analytics"]).alias("bb_analytics"),
        (_found(["cricket"], ["annotated", "annotated_web"]) | _found(["out"], ["annotated"])).alias("ck_annotated"),
        _found(["stats", "cricket"], ["report"]).alias("ck_analytics"),
        _found(["cricket"], ["annotated"]).alias("ck_video"), _found(["basketball", "out"], ["annotated"]).alias("bb_video"),
        F.coalesce(_says_cricket(report), F.lit(False)).alias("bb_says_cricket"),
    )


def _report_sport() -> Column:
    return F.when(F.col("ck_analytics"), "cricket").when(
        F.col("bb_analytics"), F.when(F.col("bb_says_cricket"), "cricket").otherwise("basketball")
    )


def video_catalog(files: DataFrame, outputs: DataFrame, data_root: str = "/data", out_root: str = "/out") -> DataFrame:
    """Every video once, with size, whether results exist and its sport; newest first.

    ``files``: path, length, mtime.  ``outputs``: path, content.
    """
    searched = [data_root, *[f"{data_root}/{d}" for d in ("videos", "basketball", "cricket", "videos/basketball", "videos/cricket")]]
    extension = F.lower(F.regexp_extract("_name", r"\.([^.]+)$", 1))
    videos = _parts(files).withColumn("_rank", _dir_rank(F.col("_dir"), searched)).filter(
        F.col("_rank").isNotNull() & extension.isin(*VIDEO_EXTENSIONS) & ~F.col("_name").startswith(".")
    )
    first = videos.groupBy(F.col("_name").alias("name")).agg(F.min(F.struct("_rank", "path", "_dir", "length", "mtime")).alias("f"))
    named = first.select("name", F.regexp_extract("name", r"^(.*)\.[^.]+$", 1).alias("stem"), "f.path", "f._dir", "f.length", "f.mtime")
    joined = named.join(_flags(outputs, out_root), "stem", "left")
    parent, stem = F.lower(F.regexp_extract("_dir", r"([^/]*)$", 1)), F.lower("stem")
    words = lambda ws: stem.rlike("|".join(ws))
    guess = (
        F.when(parent.contains("cricket") | words(CRICKET_WORDS), "cricket")
        .when(parent.contains("basketball") | words(BASKETBALL_WORDS), "basketball").otherwise("unknown")
    )
    both = (F.col("bb_annotated") & F.col("bb_analytics")) | (F.col("ck_annotated") & F.col("ck_analytics"))
    return joined.select(
        "name", "stem", "path", pyround(F.col("length") / (1024 * 1024), 1).alias("size_mb"),
        F.coalesce(both, F.lit(False)).alias("has_results"), F.coalesce(_report_sport(), guess).alias("detected_sport"), "mtime",
    ).orderBy(F.col("mtime").desc(), "name")


def resolve_results(videos: DataFrame, outputs: DataFrame, out_root: str = "/out") -> DataFrame:
    """Result files of each video (``stem``), from the folders of its sport in order; the web version first."""
    flags = _flags(outputs, out_root)
    sport = F.coalesce(_report_sport(), F.when(F.col("ck_video"), "cricket").when(F.col("bb_video"), "basketball"), F.lit("unknown"))
    known = flags.select("stem", sport.alias("sport"))
    places = {"cricket": ["cricket", "out"], "basketball": ["basketball", "out"], "unknown": ["basketball", "cricket", "out"]}
    rank = F.lit(None).cast("int")
    for name, order in places.items():
        for i, place in enumerate(order):
            rank = F.when((F.col("sport") == name) & (F.col("place") == place), i).otherwise(rank)
    files = _outputs(outputs, out_root).drop("content").join(known, "stem").withColumn("_rank", rank).filter("_rank IS NOT NULL")

    def pick(kind: str) -> Column:
        return F.min_by("path", F.when(F.col("kind") == kind, F.col("_rank"))).alias(kind)

    picked = files.groupBy("stem").agg(*[pick(k) for k in KINDS.values() if k != "analytics"])
    full = videos.select("stem").distinct().join(known, "stem", "left").join(picked, "stem", "left")
    return full.select(
        "stem", F.coalesce("sport", F.lit("unknown")).alias("sport"), F.coalesce("annotated_web", "annotated").alias("annotated_video"),
        F.col("annotated_web").isNotNull().alias("is_web_optimized"), F.col("highlights").alias("highlights_video"),
        *[F.when(F.coalesce("sport", F.lit("")) != other, F.col(c)).alias(c) for other, c in (
            ("cricket", "team1_heatmap"), ("cricket", "team2_heatmap"), ("basketball", "pitch_map"), ("basketball", "ground_radar"))],
    )
