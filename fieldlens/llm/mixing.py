"""Mixing sources to target weights on a low-discrepancy schedule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.llm.common import free_names, text_key, text_of, words_of
from fieldlens.scale import positions

WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
BLOCK = 1024
CHUNK = 4096


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """One row per source: source, rank (by code point, null last), source_size, target.

    All sources share the words of the corpus by weight.  A target stops at ``max_passes`` times its source's size and the
    excess is shared again by weight, until none is above: in order of size per weight, a source is capped exactly if its
    share of what the capped ones before it leave is at least its cap.  The table has a row per source, so its windows are small.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sources.withColumn("rank", F.row_number().over(named) - 1)
    given = F.element_at(F.array(*[F.lit(w).cast("bigint") for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", given).withColumn("cap", F.col("source_size") * max_passes)
    by_need = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    earlier, later = by_need.rowsBetween(Window.unboundedPreceding, -1), by_need.rowsBetween(0, Window.unboundedFollowing)
    every = by_need.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = ranked.select(
        "*", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(earlier), F.lit(0))).alias("rest"),
        F.sum("weight").over(later).alias("weights"),
    ).withColumn("capped", F.col("cap").cast("double") * F.col("weights") <= F.col("weight").cast("double") * F.col("rest"))
    free = Window.orderBy(F.col("capped"), F.col("source_size") / F.col("weight"), "rank")
    free = free.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # the first source that is not capped sees the rest and the weights that all uncapped ones share
    shared = F.max(F.when(~F.col("capped"), F.struct("weights", "rest"))).over(free)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(
        (shared["rest"] * F.col("weight")).cast("double") / shared["weights"])
    return filled.select("source", "rank", "source_size", target.alias("target"))


def shuffled(sized: DataFrame) -> DataFrame:
    """Adds ``start``, the words before a document when its source is laid out in the order of the ids' digests.

    Offsets run within (source, first 16 bits of the digest); at most 65,536 sums per source are carried across.
    """
    keyed = sized.withColumn("digest", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    keyed = keyed.withColumn("slice", F.substring("digest", 1, 4))
    local = Window.partitionBy("source", "slice").orderBy("digest", "doc_id", "size")
    inside = F.coalesce(F.sum("size").over(local.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    across = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = keyed.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    carry = carry.select(F.col("source").alias("_source"), F.col("slice").alias("_slice"), F.coalesce(F.sum("words").over(across), F.lit(0)).alias("before"))
    on = F.col("source").eqNullSafe(F.col("_source")) & (F.col("slice") == F.col("_slice"))
    return keyed.withColumn("inside", inside).join(carry, on).select(*sized.columns, (F.col("inside") + F.col("before")).alias("start"))


def wanted_slots(targets: DataFrame, block: int) -> DataFrame:
    """Slots a source needs: whole passes over its blocks, then blocks up to its target, the last one cut."""
    size, words = F.col("source_size"), F.round("target").cast("bigint")
    some = targets.filter(size > 0).withColumn("words", words)
    some = some.withColumn("passes", F.expr("words div source_size")).withColumn("tail", F.expr("words % source_size"))
    some = some.withColumn("blocks", F.ceil(size / block)).withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("tail") / block))
    first = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return some.withColumns({"before": F.coalesce(F.sum("slots").over(first), F.lit(0)), "all": F.sum("slots").over(whole)})


def reversed_bits(value: Column, width: Column) -> Column:
    """The van der Corput point of ``value`` times ``2 ** width``."""
    return F.conv(F.reverse(F.lpad(F.bin(value), width, F.lit("0"))), 2, 10).cast("bigint")


def schedule(wanted: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per slot of the mix: slot (place in the mix), rank (of the source), turn, pass, block, words.

    Slot n has the van der Corput point of n in base 2; the cumulative shares of the sources map it to a source.  That map is
    taken backwards: a source's share is an interval of points and each point is the bit reversal of its slot, so slots are
    made without a join.  The turns of a source number its slots in order.  Slots beyond its need stay void; a source that
    the points leave a few short gets closing slots at the end.
    """
    width = F.greatest(F.ceil(F.log2(F.col("all"))), F.lit(1)).cast("int")
    points = F.pow(F.lit(2.0), width)
    bound = lambda c: F.ceil(c / F.col("all") * points).cast("bigint")
    some = wanted.filter("slots > 0").withColumns({
        "width": width, "low": bound(F.col("before")), "high": bound(F.col("before") + F.col("slots")),
    })
    chunks = some.filter("low < high").withColumn("chunk", F.explode(F.expr(f"sequence(low, high - 1, {CHUNK}L)")))
    chunks = chunks.repartition("rank", "chunk")
    point = F.explode(F.sequence("chunk", F.least(F.col("chunk") + CHUNK, F.col("high")) - 1))
    slots = chunks.select("rank", "width", "all", point.alias("point"))
    slots = slots.select("rank", reversed_bits(F.col("point"), F.col("width")).alias("slot"), "all").filter("slot < all")
    turns = positions(slots.select("rank", "slot"), ["rank"], "slot", name="turn")
    had = slots.groupBy("rank").agg(F.count("*").alias("had"))
    short = some.join(had, "rank", "left").withColumn("had", F.coalesce("had", F.lit(0).cast("bigint"))).filter("had < slots")
    earlier = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    short = short.withColumn("ahead", F.coalesce(F.sum(F.col("slots") - F.col("had")).over(earlier), F.lit(0)))
    closing = short.withColumn("turn", F.explode(F.sequence("had", F.col("slots") - 1)))
    closing = closing.select("rank", (F.col("all") + F.col("ahead") + F.col("turn") - F.col("had")).alias("slot"), "turn")
    needs = some.select("rank", "slots", "passes", "tail", "blocks", "source_size")
    slots = turns.unionByName(closing).join(needs, "rank").filter("turn < slots")
    slots = slots.withColumns({"pass": F.expr("turn div blocks"), "block": F.expr("turn % blocks")})
    ends = F.when(F.col("pass") < F.col("passes"), F.col("source_size")).otherwise(F.col("tail"))
    return slots.select("slot", "rank", "turn", "pass", "block", F.least(F.lit(block), ends - F.col("block") * block).alias("words"))


def mixture(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[int, ...] = WEIGHTS, max_passes: int = MAX_PASSES, block: int = BLOCK,
) -> DataFrame:
    """How many words of every document the mix takes.

    Each source's documents are shuffled (by a digest of the id) and cut into blocks of ``block`` words; the slots of
    ``schedule`` take the blocks in turn, pass after pass, until the source's target is met to the word.  A document's words
    are those of its parts in all taken blocks, so none is taken more than ``max_passes`` times.

    One row per input row: ``id_col``, size, source_size, target, taken.  A null text has no words, a null source is the last
    source, rows with one id and size are interchangeable, empty tables give empty results, other columns are ignored.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), F.size(words_of(text_of(text))).cast("bigint").alias("size"))
    taken = taken_words(sized, weights, max_passes, block)
    return taken.select(F.col("doc_id").alias(id_col), "size", "source_size", "target", "taken")


def taken_words(sized: DataFrame, weights: tuple[int, ...], max_passes: int, block: int) -> DataFrame:
    """``mixture`` for a table of doc_id, source and size (other columns are kept)."""
    targets = source_targets(sized, weights, max_passes)
    slots = schedule(wanted_slots(targets, block), block)
    full = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    takes = slots.join(targets.select("rank", "source_size"), "rank").groupBy("rank", "block").agg(
        F.sum(F.when(F.col("words") == full, 1).otherwise(0)).alias("whole"), F.max(F.when(F.col("words") < full, F.col("words"))).alias("cut"))
    of = targets.withColumnRenamed("source", "_source")
    placed = shuffled(sized).join(of, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    blocks = F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))
    parts = placed.filter("size > 0").withColumn("block", F.explode(blocks))
    parts = parts.join(takes, ["rank", "block"], "left")
    low, high = F.greatest("start", F.col("block") * block), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    cut = F.greatest(F.lit(0), F.least(high, F.col("block") * block + F.coalesce("cut", F.lit(0))) - low)
    kept = [*sized.columns, "source_size", "target"]
    some = parts.withColumn("part", F.coalesce("whole", F.lit(0)) * (high - low) + cut).groupBy(*kept, "start").agg(F.sum("part").alias("taken"))
    none = placed.filter("size = 0").select(*kept, F.lit(0).cast("bigint").alias("taken"))
    return some.select(*kept, F.col("taken").cast("bigint").alias("taken")).unionByName(none)


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The documents of the mix, whole: each as often as the words taken from it, divided by its size and rounded, say.

    Documents without words are left out, as no mix takes words from them.  Rows that repeat an id and text share their takes.
    """
    copies, i, of, k1, k2 = free_names(docs, 5)  # no name that ``docs`` has
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), F.size(words_of(text_of(text))).cast("bigint").alias("size"),
                        *[c.alias(n) for n, c in text_key(text_of(text)).items()])
    o = {"weights": WEIGHTS, "max_passes": MAX_PASSES, "block": BLOCK} | options
    times = F.floor(F.sum("taken") / F.first("size") / F.count("*") + F.lit(0.5)).cast("int")
    takes = taken_words(sized, **o).filter("size > 0").groupBy("doc_id", "source", "_k1", "_k2").agg(times.alias(copies))
    takes = takes.filter(F.col(copies) > 0).select(
        F.col("doc_id").alias(i), F.col("source").alias(of), F.col("_k1").alias(k1), F.col("_k2").alias(k2), copies)
    key = text_key(text_of(text))
    on = F.col(id_col).eqNullSafe(F.col(i)) & F.col(source).eqNullSafe(F.col(of)) & (key["_k1"] == F.col(k1)) & (key["_k2"] == F.col(k2))
    return docs.join(takes, on).withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM sized GROUP BY source),
share AS (
  SELECT rank, size, 3 * size AS cap, [5, 2, 1][rank % 3 + 1]::BIGINT AS weight, false AS capped, 0 AS round FROM s
  UNION ALL
  SELECT rank, size, cap, weight, capped OR cap::DOUBLE * free <= weight::DOUBLE * rest, round + 1
  FROM (SELECT *, sum(size) OVER () - coalesce(sum(cap) FILTER (capped) OVER (), 0) AS rest, sum(weight) FILTER (NOT capped) OVER () AS free FROM share)
  WHERE round < (SELECT count(*) FROM s)),
filled AS (SELECT * FROM share WHERE round = (SELECT max(round) FROM share)),
target AS (
  SELECT rank, size, CASE WHEN capped THEN cap::DOUBLE ELSE
    ((sum(size) OVER () - coalesce(sum(cap) FILTER (capped) OVER (), 0)) * weight)::DOUBLE / (sum(weight) FILTER (NOT capped) OVER ())::DOUBLE END AS target
  FROM filled),
laid AS (
  SELECT doc_id, s.rank, d.size, coalesce(sum(d.size) OVER (
    PARTITION BY s.rank ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized d JOIN s ON s.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, l.size, t.size AS source_size, target,
  CASE WHEN l.size = 0 THEN 0 ELSE (round(target)::BIGINT // t.size) * l.size
    + greatest(0, least(l.size, round(target)::BIGINT % t.size - start)) END::BIGINT AS taken
FROM laid l JOIN target t USING (rank)
"""
