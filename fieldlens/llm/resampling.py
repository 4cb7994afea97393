"""Importance resampling of documents towards a target distribution."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.llm.common import CRC32_SQL, crc32_sql, lower_ascii, text_of
from fieldlens.scale import durable

BUCKETS = 10_000
SEED = "2024"
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LAST = (1 << 63) - 1


def feature_words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), GAPS, -1), "")


def runs(words: Column, longest: int) -> Column:
    """All runs of 1 to ``longest`` consecutive words, joined by one space."""
    found = [words]
    for k in range(2, longest + 1):
        starts = F.when(F.size(words) >= k, F.sequence(F.lit(1), F.size(words) - k + 1)).otherwise(F.array().cast("array<int>"))
        found.append(F.transform(starts, lambda i, k=k: F.array_join(F.slice(words, i, k), " ")))
    return F.concat(*found) if longest > 1 else words


def bucket_of(feature: Column, buckets: int) -> Column:
    return F.crc32(feature.cast("binary")) % buckets


def bucket_counts(texts: DataFrame, text: str, buckets: int = BUCKETS, longest: int = 1) -> list[int]:
    """Features per bucket over whole texts; summed in the tasks first, at most ``buckets`` numbers come to the driver."""
    features = texts.select(F.explode(runs(feature_words(text_of(text)), longest)).alias("f"))
    counts = [0] * buckets
    for r in features.groupBy(bucket_of(F.col("f"), buckets).alias("b")).agg(F.count("*").alias("n")).collect():
        counts[r["b"]] = r["n"]
    return counts


def gains(corpus: Sequence[int], target: Sequence[int]) -> list[int]:
    """Thousandfold log ratio of the smoothed bucket shares, target to corpus, rounded down."""
    buckets, all_s, all_t = len(corpus), sum(corpus), sum(target)
    return [
        math.floor(1000 * math.log(float(t + 1) * float(all_s + buckets) / (float(s + 1) * float(all_t + buckets))))
        for s, t in zip(corpus, target, strict=True)
    ]


def scored(docs: DataFrame, per_bucket: Sequence[int], id_col: str, text: str, longest: int = 1, seed: str = SEED) -> DataFrame:
    """id, row, n_words, n_features, weight and score of every row; a bucket's gain is looked up in one constant array."""
    table = F.split(F.lit(",".join(map(str, per_bucket))), ",").cast("array<bigint>")
    zero = F.lit(0).cast("bigint")
    words = docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.monotonically_increasing_id().alias("row"), feature_words(text_of(text)).alias("words"))
    features = runs(F.col("words"), longest)
    total = F.aggregate(features, zero, lambda sum_, f: sum_ + F.get(table, bucket_of(f, len(per_bucket)).cast("int")))
    sums = words.select(
        "id", "row", F.size("words").cast("bigint").alias("n_words"), F.size(features).cast("bigint").alias("n_features"), total.alias("total"))
    # whole numbers throughout: a mean in doubles could round up to the next one
    mean = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(zero)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")
    return sums.withColumn("weight", mean.cast("bigint")).withColumn("score", F.col("weight") + noise).drop("total")


def cutoff(rows: DataFrame, keys: Sequence[Column], wanted: int, halvings: int = 4) -> list[int]:
    """Limits of the first ``wanted`` rows in ascending order of ``keys`` (whole numbers, together unique).

    A row is among them if its keys are not above the limits in that order; keys after the last limit don't matter.  The
    range of a key is halved until it is one value, by exact counts over all rows: ``halvings`` of them per job.  Only rows tied
    on a key take part for the next.  Needs 1 <= ``wanted`` <= number of rows; the driver holds a few numbers.
    """
    limits: list[int] = []
    for key in keys:
        low, high, n = rows.agg(F.min(key), F.max(key), F.count("*")).first()
        if n == wanted:
            return [*limits, high]
        while low < high:
            points = sorted({low + (high - low) * j // (1 << halvings) for j in range(1 << halvings)})
            counts = rows.agg(*[F.count_if(key <= p) for p in points]).first()
            full = next((j for j, c in enumerate(counts) if c >= wanted), len(points))
            low, high = points[full - 1] + 1 if full else low, points[full] if full < len(points) else high
        limits.append(low)
        below, up_to = rows.agg(F.count_if(key < low), F.count_if(key <= low)).first()
        if up_to == wanted:
            return limits
        wanted, rows = wanted - below, rows.filter(key == low)
    return limits


def within(keys: Sequence[Column], limits: Sequence[int]) -> Column:
    """Whether the keys are not above the limits, compared one after the other."""
    pairs = list(zip(keys, limits, strict=False))
    last = pairs[-1][0] <= pairs[-1][1]
    return reduce(lambda rest, p: (p[0] < p[1]) | ((p[0] == p[1]) & rest), reversed(pairs[:-1]), last)


def ranked(rows: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Ranks 1, 2, 3, ... in ``order``: rows are dealt by ranges, a range's ranks follow those of all ranges before it."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = durable(
        rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    # one row a range
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(ranges), "_part").withColumn(name, (F.col("_before") + F.col("_at") + 1).cast("bigint")).drop("_part", "_at", "_before")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", target_text: str = "text",
    share_pct: int = 10, min_words: int = 20, longest: int = 1, buckets: int = BUCKETS, seed: str = SEED,
) -> DataFrame:
    """Draw ``share_pct`` percent of the documents so that their words come to look like those of ``target``.

    Words are hashed to buckets; a bucket's gain is the log ratio of its smoothed shares in the target and in all documents, a
    document's weight the mean gain of its features.  Weight plus a Gumbel number from the hash of the id is the score, and the
    highest scores are drawn: sampling without replacement in proportion to the weights.  The cutoff comes from counts over
    the stored scores, never from a sort of all of them; only the drawn rows are dealt by ranges and ranked.

    One row per input row: ``id_col`` (whole numbers), n_words, n_features, weight, score, rank (null: not drawn).  Equal scores
    go to the smaller id, a null id comes after all others and hashes like an empty one, rows that repeat an id and a score are
    taken one by one.  A null text has no words; documents below ``min_words`` are scored but never drawn.  An empty target
    leaves smoothing alone, an empty table gives an empty result, other columns are ignored.
    """
    per_bucket = gains(bucket_counts(docs, text, buckets, longest), bucket_counts(target, target_text, buckets, longest))
    scores = durable(scored(docs, per_bucket, id_col, text, longest, seed))
    able = F.col("n_words") >= min_words
    keys = [-F.col("score"), F.coalesce(F.col("id"), F.lit(LAST)), F.col("row")]
    wanted = scores.filter(able).count() * share_pct // 100
    rank = F.lit(None).cast("bigint")
    if wanted:
        drawn = able & within(keys, cutoff(scores.filter(able), keys, wanted))
        out = ranked(scores.filter(drawn), keys).unionByName(scores.filter(~drawn).withColumn("rank", rank))
    else:
        out = scores.withColumn("rank", rank)
    return out.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", "rank")


def drawn_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns; with unique ids this is the drawn corpus."""
    ids = resample(docs, target, id_col, **options).filter("rank is not null").select(F.col(id_col).alias(id_col + "_drawn")).distinct()
    return docs.join(ids, docs[id_col].eqNullSafe(ids[id_col + "_drawn"]), "left_semi")


SQL = rf"""
WITH RECURSIVE {CRC32_SQL},
f AS (
  SELECT side, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM (SELECT 's' AS side, doc_id AS id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 't', 0, coalesce(text, '') FROM benchmark)),
n AS (SELECT side, id, w, count(*) AS n FROM f GROUP BY ALL),
b AS (SELECT w, {crc32_sql("w")} % 10000 AS bucket FROM (SELECT DISTINCT w FROM n), crc_table),
c AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 's'), 0) AS s, coalesce(sum(n) FILTER (side = 't'), 0) AS t
  FROM (SELECT range AS bucket FROM range(10000)) LEFT JOIN (n JOIN b USING (w)) USING (bucket) GROUP BY ALL),
g AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain
  FROM c),
w AS (
  SELECT id AS doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS total
  FROM n JOIN b USING (w) JOIN g USING (bucket) WHERE side = 's' GROUP BY ALL),
z AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features,
    coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0)::BIGINT AS weight,
    (weight + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM documents LEFT JOIN w USING (doc_id)),
r AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, 10 * count(*) OVER () // 100 AS wanted FROM z WHERE n_features >= 20)
SELECT doc_id, n_features AS n_words, n_features, weight, score, r.rank FROM z LEFT JOIN (SELECT * FROM r WHERE rank <= wanted) r USING (doc_id)
"""
