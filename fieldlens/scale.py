"""Ordered computation over keys that may be very large.

A plain ``Window.partitionBy(video_id).orderBy(frame_idx)`` sends a whole video to one task, so a
video holding a third of the rows would stall the job.  The helpers here cut the time axis of every
key into fixed spans and work on (key, span) instead:

* ``with_halo``  bounded look-back or look-ahead: the few rows next to a border are copied to the neighbour.
* ``running``    unbounded look-back: a local window per span, plus a carry taken from one summary row per span.
* ``positions``  dense 0-based row numbers, built on ``running``.

The spans are shuffled independently; only the one-row-per-span summaries meet in one window per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = 1 << 16
CHUNK = "_chunk"
CORE = "_core"


def pyround(value: Column, digits: int = 0) -> Column:
    """Half-even rounding of the binary value, as Python and numpy round."""
    if digits == 0:
        return F.rint(value)
    factor = float(10**digits)
    return F.rint(value * F.lit(factor)) / F.lit(factor)


def div_floor(value: Column, by: int) -> Column:
    return F.floor(value / F.lit(by)).cast("bigint")


def with_halo(df: DataFrame, axis: str, before: int = 0, after: int = 0, span: int = SPAN) -> DataFrame:
    """Assign spans of ``axis`` and copy rows within ``before``/``after`` of a border to the neighbour.

    Adds ``_chunk`` and ``_core`` (False for copies).  Needs ``before`` and ``after`` not above ``span``.
    """
    if max(before, after) > span:
        raise ValueError("the halo must not be wider than the span")
    chunk = div_floor(F.col(axis), span)
    offset = F.col(axis) - chunk * F.lit(span)
    targets = F.array(
        chunk,
        F.when(offset >= F.lit(span - before), chunk + 1) if before else F.lit(None).cast("bigint"),
        F.when(offset < F.lit(after), chunk - 1) if after else F.lit(None).cast("bigint"),
    )
    return (
        df.withColumn(CHUNK, F.explode(F.filter(targets, lambda c: c.isNotNull())))
        .withColumn(CORE, F.col(CHUNK) == div_floor(F.col(axis), span))
    )


def core_only(df: DataFrame, keep: bool = False) -> DataFrame:
    """Drop the copies; ``keep`` leaves the span column for a following ``running`` over the same axis."""
    return df.filter(CORE).drop(CORE) if keep else df.filter(CORE).drop(CHUNK, CORE)


def span_window(keys: Sequence[str], *order) -> Window:
    """Window over one span of each key; use after ``with_halo``."""
    return Window.partitionBy(*keys, CHUNK).orderBy(*order)


def running(
    df: DataFrame,
    keys: Sequence[str],
    axis: str,
    outputs: dict[str, tuple],
    *,
    ties: Sequence[str] = (),
    span: int | float = SPAN,
    reverse: bool = False,
    keep: bool = False,
) -> DataFrame:
    """Running aggregates in ``axis`` order (then ``ties``) per key, exact across spans.

    ``outputs`` maps a new column to ``(kind, column, inclusive)`` where kind is ``last`` (latest non-null
    value), ``sum``, ``max`` or ``min``.  ``reverse`` runs from the end, so ``last`` becomes "next non-null".

    ``keep`` leaves the span column in the result.  If the input has it (from ``keep`` in an earlier step over the same
    axis and span) the rows already lie together and are not shuffled again.
    """
    order_names = [axis, *ties]
    inputs = {f"_in_{n}": spec[1] for n, spec in outputs.items()}
    placed = CHUNK in df.columns
    if not placed:
        inputs[CHUNK] = F.floor(F.col(axis) / F.lit(span)).cast("bigint")
    base = df.withColumns(inputs)

    direction = (lambda c: F.col(c).desc()) if reverse else (lambda c: F.col(c).asc())
    local = Window.partitionBy(*keys, CHUNK).orderBy(*[direction(c) for c in order_names])
    across = Window.partitionBy(*keys).orderBy(direction(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)

    local_cols, totals, carries, merged = {}, [], {}, {}
    for name, (kind, _, inclusive) in outputs.items():
        source = F.col(f"_in_{name}")
        frame = local.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        here, carry = f"_here_{name}", f"_carry_{name}"
        if kind == "last":
            local_cols[here] = F.last(source, ignorenulls=True).over(frame)
            pick = F.min_by if reverse else F.max_by
            # without ties and field by field the buffers are plain numbers, so the summary hashes instead of sorting
            place = F.when(source.isNotNull(), F.struct(*order_names) if ties else F.col(axis))
            kept = base.schema[f"_in_{name}"].dataType
            if isinstance(kept, T.StructType):
                fields = kept.fieldNames()
                totals += [pick(source[f], place).alias(f"{carry}_{i}") for i, f in enumerate(fields)]
                totals.append(F.count(source).alias(f"{carry}_n"))
                whole = F.struct(*[F.col(f"{carry}_{i}").alias(f) for i, f in enumerate(fields)])
                carries[carry] = F.last(F.when(F.col(f"{carry}_n") > 0, whole), ignorenulls=True).over(across)
            else:
                totals.append(pick(source, place).alias(carry))
                carries[carry] = F.last(carry, ignorenulls=True).over(across)
            merged[name] = F.coalesce(F.col(here), F.col(carry))
        elif kind == "sum":
            local_cols[here] = F.sum(source).over(frame)
            totals.append(F.sum(source).alias(carry))
            carries[carry] = F.sum(carry).over(across)
            merged[name] = F.coalesce(F.col(here), F.lit(0)) + F.coalesce(F.col(carry), F.lit(0))
        elif kind in ("max", "min"):
            agg, best = (F.max, F.greatest) if kind == "max" else (F.min, F.least)
            local_cols[here] = agg(source).over(frame)
            totals.append(agg(source).alias(carry))
            carries[carry] = agg(carry).over(across)
            merged[name] = best(F.col(here), F.col(carry))
        else:
            raise ValueError(f"unknown kind {kind}")

    # the summary is pre-aggregated on the map side: one row per (key, span) is shuffled
    summary = base.groupBy(*keys, CHUNK).agg(*totals)
    summary = summary.select(*keys, CHUNK, *[v.alias(k) for k, v in carries.items()])
    joined = base.withColumns(local_cols).join(summary, [*keys, CHUNK], "left")
    extra = [CHUNK] if keep and not placed else []
    return joined.withColumns(merged).select(*[c for c in df.columns if keep or c != CHUNK], *extra, *outputs)


def positions(
    df: DataFrame, keys: Sequence[str], axis: str, *, ties: Sequence[str] = (), name: str = "pos", span: int = SPAN,
    keep: bool = False,
) -> DataFrame:
    """Dense 0-based row number per key in ``axis`` order."""
    out = running(df, keys, axis, {name: ("sum", F.lit(1).cast("bigint"), True)}, ties=ties, span=span, keep=keep)
    return out.withColumn(name, (F.col(name) - 1).cast("bigint"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows to the session's number of shuffle partitions.

    For steps that compute much per byte: there few bytes must not be coalesced into few tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share, as named by the cluster in ``spark.checkpoint.dir``.

    Where the session names none it lies in the warehouse, which every session has and all its machines reach.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        configured = f"{spark.conf.get('spark.sql.warehouse.dir')}/_fieldlens"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint that survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
