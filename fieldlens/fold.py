"""Sequential state machines over spans of a key, run in parallel and proved equal to one serial run.

Some rules (Kalman tracking, distance gating, the shot machine) cannot be written as windows: each step
needs the exact state left by the previous one.  Every span is folded in its own task, started ``warmup``
rows early so that its state has usually forgotten the start.  The state each span *entered* with is then
compared with the state its predecessor *left*.  Spans that differ are folded again from the true state
until none differs, so the result is always that of the serial run.

A machine that can say how a span maps any entry state to the exit state (``track``, ``carry``) needs no such chain of
repairs: the maps of all spans, one small row each, are applied one after the other, and all wrong spans are folded again at
once.  Only where the rule decides differently from the new state does a span's map change and a further round follow.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fieldlens.scale import CHUNK, CORE, SPAN, div_floor, durable, spread, with_halo

_EDGE = [
    T.StructField("_kind", T.StringType()),
    T.StructField("_entry", T.StringType()),
    T.StructField("_exit", T.StringType()),
    T.StructField("_map", T.StringType()),
]


def _span_folder(make: Callable, keys: Sequence[str], inputs: Sequence[str], schema: pa.Schema, rows_per_batch: int = 1 << 14):
    """Fold the spans of one task.

    Rows come sorted by span and order, in Arrow batches of any cut, so no span is ever held in memory.
    """
    n_out = len(schema) - len(keys) - 1 - len(_EDGE)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple] = []
        span, machine, entry = None, None, None

        def close():
            edge = json.dumps(machine.state())
            tracked = json.dumps(machine.map) if entry is not None and hasattr(machine, "track") else None
            ready.append((*span, *[None] * n_out, "edge", edge if entry is None else entry, edge, tracked))

        def emit():
            columns = list(zip(*ready))
            arrays = [pa.array(c, type=f.type) for c, f in zip(columns, schema)]
            ready.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        for batch in batches:
            cells = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            spans = zip(*(cells[k] for k in keys), cells[CHUNK])
            values = zip(*(cells[n] for n in inputs))
            for at, core, forced, row in zip(spans, cells[CORE], cells["_forced"], values):
                if at != span:
                    if span is not None:
                        close()
                    span, machine, entry = at, make(), None
                    if forced is not None:
                        machine.load(json.loads(forced))
                if core and entry is None:
                    entry = json.dumps(machine.state())
                    if hasattr(machine, "track"):
                        machine.track()
                outputs = machine.step(dict(zip(inputs, row)))
                if core:
                    ready.extend((*span, *o, "row", None, None, None) for o in outputs)
            if len(ready) >= rows_per_batch:
                yield emit()
        if span is not None:
            close()
        if ready:
            yield emit()

    return fold


def chunked_fold(
    df: DataFrame,
    keys: Sequence[str],
    axis: str,
    make: Callable,
    out_schema: T.StructType,
    *,
    ties: Sequence[str] = (),
    span: int = SPAN,
    warmup: int = 512,
) -> DataFrame:
    """Run ``make()`` machines over ``df`` per key; outputs follow ``out_schema`` after the key columns.

    A machine has ``step(row) -> list of output tuples``, ``state()`` and ``load(state)`` (JSON values).  It may have
    ``track()``, after which ``map`` describes the steps taken since, ``carry(state, map, exit)``, the state that these steps
    lead to from another one, and ``same(state, other)``.
    """
    warmup = min(warmup, span)
    order = [axis, *ties]
    key_fields = [df.schema[k] for k in keys]
    schema = T.StructType([*key_fields, T.StructField(CHUNK, T.LongType()), *out_schema.fields, *_EDGE])
    at = [*keys, CHUNK]
    inputs = [c for c in df.columns if c not in keys]
    folder = _span_folder(make, keys, inputs, to_arrow_schema(schema))

    def folded(rows: DataFrame) -> DataFrame:
        """Every span in one task, in order; a task holds many spans."""
        placed = spread(rows, *at).sortWithinPartitions(*at, *order)
        return durable(placed.mapInArrow(folder, schema))

    first = with_halo(df, axis, before=warmup, span=span).withColumn("_forced", F.lit(None).cast("string"))
    parts = [folded(first)]
    edges = _edges(parts[0], at, 0)
    wrong_type = T.StructType([*key_fields, T.StructField(CHUNK, T.LongType()), T.StructField("_forced", T.StringType())])
    walk = _span_walk(make, keys, to_arrow_schema(wrong_type))
    while True:
        walked = spread(edges.drop("_round"), *keys).sortWithinPartitions(*at)  # one row per span
        wrong = durable(walked.mapInArrow(walk, wrong_type))
        if wrong.isEmpty():
            break
        # only the wrong spans are folded again; the edges, one row per span, are replaced
        spans = df.withColumn(CHUNK, div_floor(F.col(axis), span)).withColumn(CORE, F.lit(True))
        parts.append(folded(spans.join(wrong, at)))
        fresh = _edges(parts[-1], at, len(parts) - 1)
        edges = durable(edges.join(wrong.select(*at), at, "left_anti").select(*edges.columns).unionByName(fresh))
    rows = [p.filter("_kind = 'row'").withColumn("_round", F.lit(n)) for n, p in enumerate(parts)]
    if len(rows) > 1:
        current = edges.select(*at, "_round")
        rows = [r.join(current, [*at, "_round"], "left_semi") for r in rows]
    result = rows[0]
    for more in rows[1:]:
        result = result.unionByName(more)
    return result.select(*keys, *out_schema.fieldNames())


def _span_walk(make: Callable, keys: Sequence[str], schema: pa.Schema):
    """Spans of a key that began in a state other than the one before them left, with that state.

    The edges come sorted by key and span in Arrow batches of any cut; a task walks over many keys.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, key, state = make(), None, None
        same = getattr(machine, "same", lambda x, y: x == y)
        for batch in batches:
            out = []
            for *at, entry, left, steps in zip(*(batch.column(c).to_pylist() for c in (*keys, CHUNK, "_entry", "_exit", "_map"))):
                left = json.loads(left)
                if at[:-1] != key:  # the first span of a key began as it had to
                    key = at[:-1]
                elif not same(state, json.loads(entry)):
                    out.append((*at, json.dumps(state)))
                    carried = machine.carry(state, json.loads(steps), left) if steps is not None else None
                    left = left if carried is None else carried
                state = left
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return walk


def _edges(part: DataFrame, at: Sequence[str], number: int) -> DataFrame:
    """Entry and exit state of every span of one round."""
    return part.filter("_kind = 'edge'").select(*at, "_entry", "_exit", "_map").withColumn("_round", F.lit(number))
