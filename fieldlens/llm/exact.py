"""Exact deduplication with a split between heavy hitters and the rest."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.llm.common import SPACES, text_of
from fieldlens.scale import durable

COUNTERS = 1023


def text_digest(text: Column) -> Column:
    """SHA-256 of the text with every run of white space as one space."""
    return F.sha2(F.regexp_replace(text, SPACES, " "), 256)


def offer(kept: dict[str, int], seen: dict[str, int], counters: int) -> dict[str, int]:
    """Misra-Gries summary of what ``kept`` and ``seen`` stand for, with at most ``counters`` entries.

    Each count taken off one entry is taken off at least ``counters`` others as well, so an entry falls short of its true
    count by at most the number of rows divided by ``counters + 1``.
    """
    for value, n in seen.items():
        kept[value] = kept.get(value, 0) + n
    if len(kept) <= counters:
        return kept
    cut = heapq.nlargest(counters + 1, kept.values())[-1]
    return {value: n - cut for value, n in kept.items() if n > cut}


def frequent_candidates(digests: DataFrame, rows: int, counters: int = COUNTERS) -> DataFrame:
    """At most ``counters + 1`` digests, among them each with more than twice ``rows / (counters + 1)`` rows.

    Every task summarises its rows by ``offer``; the counts of a digest are then summed over the tasks.  Summed up they are
    too small by ``rows / (counters + 1)`` at most, and no more than ``counters + 1`` digests can reach that sum.
    """

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, int] = {}
        for batch in batches:
            seen = batch.column(0).value_counts()
            kept = offer(kept, dict(zip(seen.field(0).to_pylist(), seen.field(1).to_pylist(), strict=True)), counters)
        yield pa.RecordBatch.from_pydict(
            {"digest": pa.array(list(kept), pa.string()), "n": pa.array(list(kept.values()), pa.int64())})

    counted = digests.select("digest").mapInArrow(summary, "digest string, n bigint").groupBy("digest").agg(F.sum("n").alias("n"))
    return counted.filter((F.col("n") > 1) & (F.col("n") * (counters + 1) >= rows)).select("digest")


def digests_of(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return durable(docs.select(
        F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), text_digest(text_of(text)).alias("digest")))


def heavy_winners(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Exact size and least row of the candidates that do repeat: at most ``counters + 1`` rows of fixed size."""
    candidates = frequent_candidates(digests, digests.count(), counters)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    return durable(
        digests.join(F.broadcast(candidates), "digest").groupBy("digest")
        .agg(first.alias("first"), F.count("*").alias("group_size")).filter(F.col("group_size") > 1))


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", counters: int = COUNTERS,
) -> DataFrame:
    """The row that stays for every row, among rows whose texts are equal but for the kind and length of white space.

    Digests that stand in a large part of all rows are found by Misra-Gries summaries, counted exactly (a candidate that turns
    out to be rare is dropped) and broadcast: their rows, copies of heavy texts, are settled where they are read.  All other
    rows are grouped by an ordinary shuffle; there no digest has more than ``2 / (counters + 1)`` of the rows.  Texts are
    digested once and never shuffled.

    One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256.  Of equal texts the row with the smallest id
    stays; a null id comes after all others, and among rows that repeat an id with the same text one stays.  A null text is
    empty; all empty texts are one group, a text of blanks only is a text of one space.  An empty table gives an empty result,
    other columns are ignored.
    """
    digests = digests_of(docs, id_col, text)
    winners = heavy_winners(digests, counters)
    settled = digests.join(F.broadcast(winners), "digest", "left")
    alike = Window.partitionBy("digest")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    rest = settled.filter(F.col("first").isNull()).select(
        "id", "row", "digest", F.min(order).over(alike).alias("first"), F.count("*").over(alike).alias("group_size"))
    both = settled.filter(F.col("first").isNotNull()).select(rest.columns).unionByName(rest)
    return both.select(
        F.col("id").alias(id_col), F.col("first.id").alias("keep_id"), F.col("group_size").cast("bigint").alias("group_size"),
        (F.col("row") == F.col("first.row")).alias("kept"), F.col("digest").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; nulls, ties and repeated rows as in ``exact_duplicates``.

    Copies of heavy texts are removed where they are read, all other rows meet the ids that stay by their digest.  Of rows that
    repeat both the id and the text of the row that stays any one comes out.
    """
    free = [c for c in (f"_{k}" for k in range(len(docs.columns) + 6)) if c not in docs.columns]
    digest, heavy, first, key, stays, copies = free[:6]
    verdicts = exact_duplicates(docs, id_col, text, counters)
    winners = heavy_winners(digests_of(docs, id_col, text), counters).select(F.col("digest").alias(heavy), F.col("first.id").alias(first))
    stay = verdicts.filter(F.col(id_col).eqNullSafe(F.col("keep_id"))).groupBy(
        F.col("text_sha256").alias(key), F.col("keep_id").alias(stays)).agg(F.count("*").alias(copies))
    mine = docs.withColumn(digest, text_digest(text_of(text))).join(F.broadcast(winners), F.col(digest) == F.col(heavy), "left")
    mine = mine.filter(F.col(heavy).isNull() | F.col(id_col).eqNullSafe(F.col(first)))
    met = mine.join(stay, (F.col(digest) == F.col(key)) & F.col(id_col).eqNullSafe(F.col(stays)))
    once = met.filter(F.col(copies) == 1).select(docs.columns)
    return once.unionByName(met.filter(F.col(copies) > 1).dropDuplicates([id_col, digest]).select(docs.columns))


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM d WINDOW same AS (PARTITION BY text_sha256)
"""
