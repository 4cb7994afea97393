"""Packing documents into sequences of several permitted lengths."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.llm.common import text_of, words_of
from fieldlens.scale import durable

CAPACITIES = (512, 1024, 2048, 4096)
GROUP = 20_000


def cost(capacity: int, overhead: float = 32.0, attention: float = 16384.0) -> float:
    """Cost of a sequence: its tokens, their share of attention, and a fixed part."""
    return capacity + capacity * capacity / attention + overhead


def pack(lengths: np.ndarray, capacities: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit of ``lengths`` (in the order given) into bins of the permitted capacities.

    An item goes to the open bin with the least room that holds it.  If none does, the bin size is opened that costs least per
    token it can still get: its capacity or, if that is less, all tokens not yet packed.  In the end each bin shrinks to the
    least capacity that holds its contents.  Returns bin, offset per item and capacity per bin.
    """
    room: list[list[int]] = [[] for _ in range(capacities[-1] + 1)]
    open_rooms = 0  # bit r is set if a bin has r left
    free: list[int] = []
    used: list[int] = []
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    left = int(lengths.sum())
    prices = [(c, cost(c)) for c in capacities]
    for k, n in enumerate(map(int, lengths)):
        fitting = open_rooms >> n
        if fitting:
            r = n + (fitting & -fitting).bit_length() - 1
            at = room[r].pop()
            if not room[r]:
                open_rooms &= ~(1 << r)
        else:
            r = min(((price / min(c, left), c) for c, price in prices if c >= n))[1]
            at = len(used)
            used.append(0)
            free.append(0)
        bins[k], offsets[k] = at, used[at]
        used[at] += n
        r -= n
        free[at] = r
        left -= n
        if r:
            room[r].append(at)
            open_rooms |= 1 << r
    sizes = np.asarray(capacities)[np.searchsorted(capacities, used)] if used else np.empty(0, np.int64)
    return bins, offsets, sizes


def pieces_of(docs: DataFrame, id_col: str, text: str, longest: int) -> DataFrame:
    """Runs of at most ``longest`` words of each document: doc_id, piece, start, length."""
    sized = docs.select(F.col(id_col).alias("doc_id"), F.size(words_of(text_of(text))).alias("n"))
    last = F.greatest(F.ceil(F.col("n") / longest) - 1, F.lit(0)).cast("int")
    cut = sized.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("piece") * longest
    return cut.select("doc_id", "piece", start.cast("bigint").alias("start"), F.least(F.lit(longest), F.col("n") - start).cast("bigint").alias("length"))


def best_fit(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", capacities: tuple[int, ...] = CAPACITIES, group: int = GROUP,
) -> DataFrame:
    """Assign every word of every document to a sequence.

    Documents longer than the largest capacity are cut.  Pieces are dealt by hash to groups of about ``group``, never more
    than twice that, and each group is packed on its own, longest first, so memory per task is bounded at any size; with
    20,000 pieces a group, what separate groups waste is a few bins each.

    One row per piece: ``id_col``, piece, start (first word), length, bin, offset (in the bin), capacity.  Documents without
    words (null texts too) have one row with length 0 and no bin.  Null ids are packed like others, repeated rows are packed
    as often as they stand there, an empty table gives an empty result, other columns are ignored.
    """
    capacities = tuple(sorted(capacities))
    pieces = durable(pieces_of(docs, id_col, text, capacities[-1]))
    full = pieces.filter("length > 0")
    groups = max(1, math.ceil(full.count() / group))
    dealt = full.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "length"), F.lit(groups)))
    # many rows with one id share a hash: a group that they make too large is cut further
    place = F.row_number().over(Window.partitionBy("shard").orderBy("doc_id", "piece", "length"))
    dealt = dealt.withColumn("part", F.floor((place - 1) / (2 * group)))

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins, offsets, sizes = pack(rows["length"].to_numpy(), capacities)
        name = f"{rows['shard'].iloc[0]}-{rows['part'].iloc[0]}-"
        return pd.DataFrame({
            "doc_id": rows["doc_id"], "piece": rows["piece"], "start": rows["start"], "length": rows["length"],
            "bin": [name + str(b) for b in bins], "offset": offsets, "capacity": sizes[bins],
        })

    kind = pieces.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, piece int, start bigint, length bigint, bin string, offset bigint, capacity bigint"
    bins = dealt.groupBy("shard", "part").applyInPandas(packed, shape)
    empty = pieces.filter("length = 0").select(
        "*", F.lit(None).cast("string").alias("bin"), F.lit(None).cast("bigint").alias("offset"), F.lit(None).cast("bigint").alias("capacity"))
    return bins.unionByName(empty).withColumnRenamed("doc_id", id_col)
