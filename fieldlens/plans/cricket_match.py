"""The whole cricket chain: from raw detections to one row per delivery."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.operators import court, cricket as ck, deliveries as dv
from fieldlens.scale import SPAN, durable, shared_dir

FRAME, DELIVERY = ["video_id", "frame_idx"], dv.DELIVERY
# nominal point on the pad and velocity across and up, metres and metres a second
IMPACT_X, IMPACT_Y, IMPACT_Z, IMPACT_VX, IMPACT_VZ = 0.02, 18.0, 0.45, 0.01, 1.2


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table bucketed and sorted by delivery, in the folder that all executors share.

    Windows, groups and joins by delivery that read it need no further exchange.
    """
    spark = df.sparkSession
    table, buckets = f"fieldlens_{name}_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartition(buckets, *DELIVERY)
    placed.write.bucketBy(buckets, *DELIVERY).sortBy(*DELIVERY).option("path", f"{shared_dir(spark)}/{table}").saveAsTable(table)
    return spark.read.table(table)


@contextmanager
def where_they_lie(spark: SparkSession) -> Iterator[None]:
    """Jobs inside may join by (delivery, span) on tables placed by delivery alone.

    Not for rows keyed by video: there the span must stay part of the placement, or a long video would meet in one task.
    """
    conf = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "false")
    try:
        yield
    finally:
        spark.conf.set(conf, before)


def ball_track(detections: DataFrame, frames: DataFrame, fps: float = 30.0, span: int = SPAN) -> DataFrame:
    """Smoothed ball from raw detections: the candidate near the last one, then the filter."""
    boxes = detections.select(*FRAME, "det_id", "x1", "y1", "x2", "y2")
    gated = dv.ball_gate(detections, span=span).join(boxes, [*FRAME, "det_id"])
    return durable(dv.kalman_ball(gated, frames, fps, span=span))


def first_seen(rows: DataFrame, deliveries: DataFrame, columns: list[str], span: int = SPAN) -> DataFrame:
    """The first row of each delivery."""
    first = F.min(F.struct("frame_idx", *columns)).alias("f")
    return dv.delivery_points(rows, deliveries, span).groupBy(*DELIVERY).agg(first).select(*DELIVERY, *[f"f.{c}" for c in columns])


def cricket_match(
    detections: DataFrame, roles: DataFrame, frames: DataFrame, stumps: DataFrame, calibrations: DataFrame, fps: float = 30.0, span: int = SPAN,
) -> DataFrame:
    """Every delivery of every video with over, speeds, line and length, shot, outcome, chance of a wicket and commentary.

    ``detections`` are raw ball candidates, ``roles`` people with boxes, ``stumps`` (sx, sy) per frame, ``calibrations`` map
    pixels to metres along and across the pitch.  The ball points are stored bucketed by delivery once; everything after that
    is computed where they lie.  A delivery without a known bounce takes its first metric point for the length, 10 m without any.
    """
    track = ball_track(detections, frames, fps, span)
    found = durable(dv.deliveries_segment(track, roles, frames, span=span))
    metric = court.pitch_metric(track.select(*FRAME, "cx", "cy"), calibrations)
    seen = track.select(*FRAME, F.col("cx").cast("double"), F.col("cy").cast("double")).join(metric, FRAME, "left")
    points = stored(dv.delivery_points(seen, found, span), "points")
    people = stored(dv.role_first_hit(roles, found, span=span), "batsmen")
    wickets = stored(first_seen(stumps, found, ["sx", "sy"], span), "stumps")
    numbered = stored(ck.over_notation(found, "start_frame", span).withColumn("delivery_key", F.col("start_frame")), "numbered")
    with where_they_lie(points.sparkSession):
        return durable(_per_delivery(points, people, wickets, numbered, fps, span))  # one row per delivery


def _per_delivery(points: DataFrame, people: DataFrame, wickets: DataFrame, numbered: DataFrame, fps: float, span: int) -> DataFrame:
    """Everything that follows from the stored points of a delivery."""
    bounces = stored(dv.bounce_points(points, span=span), "bounces")
    last = dv.last_bounces(bounces)
    speeds = dv.delivery_speeds(dv.reconstruct_3d(points.select(*DELIVERY, "frame_idx", "mx", "my"), last, fps, span), last, fps, span)
    spots = F.struct("frame_idx", "mx", "my")
    known = F.col("mx").isNotNull()
    places = points.join(last, DELIVERY, "left").groupBy(*DELIVERY).agg(
        F.min(F.when(known, spots)).alias("_first"), F.max(F.when(known & (F.col("frame_idx") == F.col("bounce_frame")), spots)).alias("_bounce"))
    pixels = points.select(*DELIVERY, "frame_idx", "cx", "cy")
    shots = ck.shot_class(dv.shot_context(pixels, bounces, span).filter("after_impact"))

    base = numbered.join(places, DELIVERY).join(speeds, DELIVERY, "left").fillna(0.0, ["release_speed_kmh", "bounce_speed_kmh"])
    flown = dv.project_to_stumps(base.withColumns({
        "x": F.lit(IMPACT_X), "y": F.lit(IMPACT_Y), "z": F.lit(IMPACT_Z), "vx": F.lit(IMPACT_VX), "vy": F.col("bounce_speed_kmh") / 3.6,
        "vz": F.lit(IMPACT_VZ)}), fps)
    rated = stored(ck.expected_dismissal(flown.withColumns({
        "metric_x": F.col("_bounce.mx"), "metric_y": F.col("_bounce.my"), "seam_deg": F.lit(0.0)})).select(
            *DELIVERY, "start_frame", "done_frame", "ball_no", "over", "release_speed_kmh", "bounce_speed_kmh", "metric_x", "metric_y",
            F.col("_first.mx").alias("_first_x"), "stump_x", "stump_z", "xd_pct", "threat_level"), "rated")
    reviews = rated.select(*DELIVERY, F.col("metric_y").alias("pitch_x"), F.col("metric_x").alias("pitch_y"), "stump_x", "stump_z")
    outcomes = dv.delivery_outcome(pixels, people, wickets, shots, reviews, span=span)
    placed = ck.line_length(rated.withColumns({
        "metric_x": F.coalesce("metric_x", "_first_x", F.lit(10.0)), "metric_y": F.coalesce("metric_y", F.lit(0.0))}))
    # without a point after impact the classifier has nothing to go by
    full = placed.join(outcomes, DELIVERY).join(shots, DELIVERY, "left").withColumns({
        "shot_played": F.coalesce("shot_label", F.lit("defense")), "event_runs": F.lit(0)})
    return ck.commentary_line(ck.runs_of_outcome(full)).drop("_first_x", "shot_label", "event_runs")
