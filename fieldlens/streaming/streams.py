"""Structured Streaming jobs over tables that grow: sources, windowed and stateful operators, sinks."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from fieldlens.functions import machines as mc
from fieldlens.operators.routing import parse_log_lines

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_CONF = "spark.sql.streaming.stateStore.providerClass"


def prepare(spark: SparkSession) -> None:
    """Stateful operators keep their state in RocksDB."""
    if spark.conf.get(_CONF, None) != _ROCKSDB:
        spark.conf.set(_CONF, _ROCKSDB)


# ---- sources and sinks -------------------------------------------------------------------------------

def stream_tracks(
    spark: SparkSession, path: str, schema: T.StructType, fps: float = 30.0, max_files: int | None = None,
    delay: str = "10 seconds", at: str = "frame_idx", start: float = 0.0,
) -> DataFrame:
    """Rows of a growing folder with ``event_time`` (start of the video plus frame/fps) and a watermark.

    ``base_ts`` (seconds) is used where the table has it; else every video starts at ``start``.  The engine counts rows at
    the epoch itself as late for stateful operators, so videos fed to these need a later start.
    """
    prepare(spark)
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rows = reader.parquet(path)
    base = F.col("base_ts") if "base_ts" in schema.fieldNames() else F.lit(float(start))
    micros = ((base + F.col(at) / F.lit(float(fps))) * 1_000_000).cast("bigint")
    return rows.withColumn("event_time", F.timestamp_micros(micros)).withWatermark("event_time", delay)


def checkpointed_run(stream: DataFrame, path: str, checkpoint: str):
    """Process what has arrived and stop; a later call with the same checkpoint goes on from there."""
    query = (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def latest_run(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> None:
    """As ``checkpointed_run`` for results that change: every batch is written with its number.

    A repeated batch after a failure overwrites its own folder, so results are exactly once.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch_no", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .outputMode(mode).trigger(availableNow=True).start()
    )
    query.awaitTermination()


# ---- windowed ----------------------------------------------------------------------------------------

def audio_energy_stream(audio: DataFrame, window: str = "250 milliseconds", hop: int | None = None) -> DataFrame:
    """Root mean square of ``amplitude`` per tumbling window; ``hop`` gives out a window once it has that many samples."""
    energy = audio.groupBy("video_id", F.window("event_time", window).alias("w")).agg(
        F.sqrt(F.avg(F.col("amplitude") * F.col("amplitude"))).alias("energy"), F.count("*").alias("samples")
    )
    full = energy.filter(F.col("samples") == hop) if hop else energy
    return full.select("video_id", F.col("w.start").alias("start"), "energy", "samples")


def ball_sessions(ball: DataFrame, fps: float = 30.0, dead_frames: int = 16) -> DataFrame:
    """Flights as session windows over ball sightings (with ``has_batsman``) that end after the dead frames.

    A flight is given out when the watermark passes its end.  Rows of ``video_ends`` move it past the last one.
    """
    gap = f"{int(round((dead_frames + 1) / fps * 1000))} milliseconds"
    seen = F.col("frame_idx") if ENDED not in ball.columns else F.when(~F.col(ENDED), F.col("frame_idx"))
    return ball.groupBy("video_id", F.session_window("event_time", gap).alias("w")).agg(
        F.min(seen).alias("first_ball_frame"), F.max(seen).alias("last_ball_frame"),
        F.min(F.when(F.col("has_batsman"), seen)).alias("start_frame"), F.count(seen).alias("ball_frames"),
    ).filter("ball_frames > 0").select("video_id", "first_ball_frame", "last_ball_frame", "start_frame", "ball_frames")


def live_scoreboard(events: DataFrame) -> DataFrame:
    """Running possession frames, passes and interceptions per team (``team``, ``pass_team``, ``interception_team``)."""
    totals = [
        F.count(F.when(F.col(source) == t, 1)).alias(f"team{t}_{name}")
        for source, name in (("team", "frames"), ("pass_team", "passes"), ("interception_team", "interceptions")) for t in (1, 2)
    ]
    return events.groupBy("video_id").agg(*totals)


# ---- stateful ----------------------------------------------------------------------------------------

class _OrderedProcessor(StatefulProcessor):
    """One machine per key that steps over the rows in event-time order, however they arrive.

    Rows wait until the watermark passes them; then no earlier row can come any more.  All that a key has lies in one value, so a
    batch reads and writes it once; only rows above ``rows_near`` wait in a map state, packed by stretches of event time.  One timer
    per key stands at the first waiting row, so rows are given out without further input, and at the end of the key's idle time, when
    the machine closes what is open and the key's state is removed.
    """

    def __init__(
        self, make: Callable, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], fields: list[str], idle_us: int,
        stretch_us: int = 1_000_000, rows_per_batch: int = 1 << 14, rows_near: int = 1 << 10,
    ):
        self.make, self.keys, self.columns, self.fields = make, list(keys), list(columns), fields
        self.at, self.idle_us, self.stretch_us = [1 + columns.index(c) for c in order], idle_us, stretch_us
        self.rows_per_batch, self.rows_near = rows_per_batch, rows_near

    def init(self, handle):
        self.handle = handle
        self.kept = handle.getValueState("kept", "machine STRING, near STRING, part BIGINT, far BIGINT, last BIGINT, timer BIGINT")
        self.waiting = handle.getMapState("waiting", "stretch BIGINT, part BIGINT", "content STRING")

    def handleInputRows(self, key, rows, timerValues):
        kept = self.kept.get()
        machine, near, part, far, last, timer = kept or (None, "[]", 0, 0, None, None)
        near = json.loads(near)
        for batch in rows:
            said = [[None if v != v else v for v in batch[c].tolist()] for c in ("event_micros", *self.columns)]
            ended = batch[ENDED].tolist() if ENDED in batch else [False] * len(batch)
            for over, *row in zip(ended, *said):
                if over is True:  # only moves the watermark
                    continue
                row[0] = int(row[0])
                last = row[0] if last is None else max(last, row[0])
                near.append(row)
                if len(near) >= self.rows_near:  # packed away as they come, a large key's rows are never held together
                    part, far, near = *self._put_away(near, part, far), []
        yield from self._advance(key, machine, near, part, far, last, timer, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        kept = self.kept.get()
        if kept:
            machine, near, part, far, last, _ = kept
            yield from self._advance(key, machine, json.loads(near), part, far, last, None, timerValues.getCurrentWatermarkInMs() * 1000)

    def _put_away(self, rows: list, part: int, far: int) -> tuple[int, int]:
        for stretch, content in groupby(sorted(rows, key=lambda r: r[0]), key=lambda r: r[0] // self.stretch_us):
            self.waiting.updateValue((stretch, part), (json.dumps(list(content)),))
            part, far = part + 1, far + 1
        return part, far

    def _advance(
        self, key, state: str | None, near: list, part: int, far: int, last: int | None, timer: int | None, now: int
    ) -> Iterator[pd.DataFrame]:
        """Step over the waiting rows up to ``now``, then set the timer for what comes next."""
        if last is None:
            return
        machine, stepped, due, wait, given = self.make(), False, None, [], []
        if state is not None:
            machine.load(json.loads(state))
        places, here = {}, {}
        for place in sorted(tuple(k) for k in self.waiting.keys()) if far else ():
            places.setdefault(place[0], []).append(place)
        for row in near:
            here.setdefault(row[0] // self.stretch_us, []).append(row)
        for stretch in sorted({*places, *here}):
            rows, stored = here.get(stretch, []), places.get(stretch, [])
            if stretch * self.stretch_us > now:
                wait += rows
                due = min([r[0] for r in rows] + [stretch * self.stretch_us] * bool(stored) + [due] * (due is not None))
                continue
            if stored:  # those came first
                rows = [r for place in stored for r in json.loads(self.waiting.getValue(place)[0])] + rows
                for place in stored:
                    self.waiting.removeKey(place)
                far -= len(stored)
            for row in sorted((r for r in rows if r[0] <= now), key=lambda r: (r[0], *(r[i] for i in self.at))):
                given.extend(machine.step(dict(zip(self.columns, row[1:]))))
                stepped = True
                if len(given) >= self.rows_per_batch:
                    yield self._frame(key, given)
                    given = []
            rest = [r for r in rows if r[0] > now]
            wait += rest
            due = min([r[0] for r in rest], default=due)
        if stepped and hasattr(machine, "flush"):
            given.extend(machine.flush())
        over = due is None and now >= last + self.idle_us
        if over and hasattr(machine, "finish"):
            given.extend(machine.finish())
        following = None if over else -(-(last + self.idle_us if due is None else due) // 1000)
        if timer != following:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if following is not None:
                self.handle.registerTimer(following)
        if over:
            self.kept.clear()
            if part:
                self.waiting.clear()
        else:
            if len(wait) >= self.rows_near:
                part, far, wait = *self._put_away(wait, part, far), []
            self.kept.update((json.dumps(machine.state()) if stepped else state, json.dumps(wait), part, far, last, following))
        if given:
            yield self._frame(key, given)

    def _frame(self, key, given: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(*key, *g) for g in given], columns=[*self.keys, *self.fields])

    def close(self):
        pass


ENDED = "ended"


def video_ends(videos: DataFrame, frames_after: int) -> DataFrame:
    """One row per video that has ended, ``frames_after`` behind its last frame; its event time moves the watermark past the video."""
    return videos.select("video_id", (F.col("total_frames") - 1 + frames_after).alias("frame_idx"), F.lit(True).alias(ENDED))


def stateful_tracking(
    stream: DataFrame, make: Callable, out_schema: T.StructType, keys: Sequence[str] = ("video_id",),
    order: Sequence[str] = ("frame_idx",), idle: str = "1 second",
) -> DataFrame:
    """Run a step machine per key over a stream in event-time order: the same machine as in the batch fold, so the same results.

    Rows may arrive in any order within the watermark's delay; rows behind the watermark are dropped by the engine.  A row's
    results come out when the watermark has passed it.  A key without rows for ``idle`` event time is over: the machine's
    ``finish`` gives out what is open and its state is removed.  Rows with ``ended`` set only move the watermark.
    """
    prepare(stream.sparkSession)
    columns = [c for c in stream.columns if c not in (*keys, "event_time", ENDED)]
    schema = T.StructType([*[stream.schema[k] for k in keys], *out_schema.fields])
    number, unit = re.fullmatch(r"(\d+) (millisecond|second|minute|hour)s?", idle).groups()
    idle_us = int(number) * {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000}[unit] * 1000
    processor = _OrderedProcessor(make, keys, order, columns, out_schema.fieldNames(), idle_us)
    return stream.withColumn("event_micros", F.unix_micros("event_time")).groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )


def _schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


TRACKED = "frame_idx BIGINT, cx BIGINT, cy BIGINT, conf DOUBLE, interpolated BOOLEAN, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE"


def kalman_stream(spine: DataFrame, fps: float = 30.0) -> DataFrame:
    """Smoothed ball track as frames (with or without ball columns) arrive."""
    return stateful_tracking(spine, lambda: mc.KalmanBall(fps), _schema(TRACKED))


def possession_stream(candidates: DataFrame, window: int = 5, grace: int = 3) -> DataFrame:
    """Holder per frame as frames arrive; ``candidate`` is NULL without ball."""
    return stateful_tracking(candidates, lambda: mc.Possession(window, grace), _schema("frame_idx BIGINT, holder_id BIGINT"))


def speed_stream(steps: DataFrame, fps: float = 30.0, frames: int = 10, min_present: int = 5) -> DataFrame:
    """Speed of every player over a window sliding frame by frame, as steps arrive."""
    return stateful_tracking(
        steps, lambda: mc.SpeedWindow(fps, frames, min_present), _schema("frame_idx BIGINT, speed_kmh DOUBLE"), keys=("video_id", "player_id"))


def shot_stream(spine: DataFrame) -> DataFrame:
    return stateful_tracking(spine, mc.ShotTracker, _schema("frame_idx BIGINT, conf DOUBLE, shot STRING"))


def delivery_sessions(spine: DataFrame, dead_frames: int = 16, min_frames: int = 5) -> DataFrame:
    """Deliveries as they complete, from frames with ``has_ball`` and ``has_batsman``; an open one when its video is over."""
    return stateful_tracking(
        spine, lambda: mc.DeliverySession(dead_frames, min_frames),
        _schema("start_frame BIGINT, last_ball_frame BIGINT, done_frame BIGINT, ball_frames BIGINT"),
    )


def live_speed(points: DataFrame, fps: float = 30.0) -> DataFrame:
    """Speed of the delivery in flight on every fourth frame, from frames with or without metric point."""
    return stateful_tracking(points, lambda: mc.LiveSpeed(fps), _schema("frame_idx BIGINT, points BIGINT, speed_kmh DOUBLE"))


_STATUS = (
    "line_no BIGINT, sport STRING, stage INT, stage_name STRING, total_stages INT, completed BOOLEAN, fps STRING, eta STRING, "
    "vram STRING, progress_pct BIGINT, current_frame BIGINT, total_frames BIGINT")


def run_status_stream(lines: DataFrame, idle: str = "1 second") -> DataFrame:
    """Latest status per run, once per batch that brings it new lines.

    Lines with a number (``line_no``) step in its order; lines from ``logs.log_stream`` in that of their place in the files.
    """
    said = parse_log_lines(lines).drop("line")
    numbered = "line_no" in lines.columns
    return stateful_tracking(
        said, mc.RunStatus if numbered else mc.CountedRunStatus, _schema(_STATUS), keys=("run_id",),
        order=("line_no",) if numbered else ("slice", "at"), idle=idle)


def late_data(stream: DataFrame, keys: Sequence[str] = ("video_id", "frame_idx", "player_id")) -> DataFrame:
    """The rows that arrive before the watermark passes them, repeated ones once; the engine drops the late ones."""
    return stream.dropDuplicatesWithinWatermark(list(keys))


def batch_watermark(spark: SparkSession, checkpoint: str, number: int) -> int:
    """Milliseconds of the watermark under which the engine runs a batch, as it wrote it down before the batch began."""
    said = spark.read.text(f"{checkpoint}/offsets/{number}").select(F.get_json_object("value", "$.batchWatermarkMs").cast("bigint").alias("ms"))
    return said.agg(F.max("ms")).first()[0] or 0


def split_late(stream: DataFrame, path: str, checkpoint: str, window: str = "1 second", keys: Sequence[str] = ("video_id",)) -> None:
    """Set late rows aside as they arrive and count rows per window; what arrived earlier is not read again.

    A row at or behind the watermark of the batch that brings it is late.  Each batch writes its rows under ``rows``, split by
    ``is_late``, and its counts per window under ``windows``; a repeated batch overwrites both.
    """

    def write(batch: DataFrame, number: int) -> None:
        limit = batch_watermark(batch.sparkSession, checkpoint, number)
        late = (F.unix_micros("event_time") <= limit * 1000) & F.lit(limit > 0)
        batch.withColumn("is_late", late).write.mode("overwrite").partitionBy("is_late").parquet(f"{path}/rows/batch={number}")
        fresh = batch.sparkSession.read.schema(batch.schema.add("is_late", "boolean")).parquet(f"{path}/rows/batch={number}")
        counts = fresh.groupBy(*keys, F.window("event_time", window).getField("start").alias("start")).agg(
            F.count("*").alias("rows"), F.count_if("is_late").alias("late_rows"))
        counts.write.mode("overwrite").parquet(f"{path}/windows/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def window_counts(spark: SparkSession, path: str, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """Counts per window with late rows added; ``restated`` where these changed a window."""
    parts = spark.read.parquet(f"{path}/windows")
    return parts.groupBy(*keys, "start").agg(F.sum("rows").alias("rows"), F.sum("late_rows").alias("late_rows")).withColumn(
        "restated", F.col("late_rows") > 0)
