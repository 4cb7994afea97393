"""Document fingerprints by winnowing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.llm.common import let, text_of, words_of

LOW = (1 << 32) - 1
PRIME, BASE = (1 << 31) - 1, 1_000_003
PASSES = 3
K, W = 3, 1 << PASSES


def word_value(word: Column) -> Column:
    """28 bits of the word's digest."""
    return F.conv(F.substring(F.md5(word), 1, 7), 16, 10).cast("bigint")


def winnow(text: Column, k: int = K, passes: int = PASSES) -> Column:
    """Selected k-grams of ``text`` in order, each as ``hash << 32 | (2**32 - 1 - position)``.

    The polynomial hash of ``k`` words rolls over the text; of every window of ``2 ** passes`` k-grams the least hash is
    selected, the rightmost of equal ones (the position is stored inverted, so the plain minimum picks it).  Whatever
    ``k + 2 ** passes - 1`` words two texts share, they share a selected k-gram of it.  Fewer k-grams than a window make
    one window, fewer than ``k`` words one gram; a text without words selects nothing.
    """
    width = 1 << passes

    def roll(values: Column) -> Column:
        size = F.least(F.size(values), F.lit(k))

        def gram(i: Column) -> Column:
            h = F.lit(0).cast("bigint")
            for j in range(k):
                h = (h * BASE + F.coalesce(F.get(values, i + j), F.lit(0))) % PRIME
            return F.shiftleft(h, 32) + (F.lit(LOW) - i)

        return F.transform(F.sequence(F.lit(0), F.size(values) - size), gram)

    def least(grams: Column, shift: int, left: int) -> Column:
        if not left:
            return F.array_distinct(F.slice(grams, 1, F.greatest(F.size(grams) - (width - 1), F.lit(1))))
        paired = F.transform(grams, lambda x, i: F.least(x, F.get(grams, i + shift)))
        return let(paired, lambda g: least(g, shift * 2, left - 1))

    values = F.transform(words_of(text), word_value)
    none = F.expr("cast(array() as array<bigint>)")
    return let(values, lambda v: F.when(F.size(v) > 0, let(roll(v), lambda g: least(g, 1, passes))).otherwise(none))


def printed(selected: Column) -> Column:
    """``hash@position`` of each selected k-gram, in hexadecimal and words, joined by commas."""
    return F.array_join(
        F.transform(selected, lambda v: F.concat(F.lower(F.hex(F.shiftright(v, 32))), F.lit("@"), (F.lit(LOW) - v.bitwiseAND(LOW)).cast("string"))), ","
    )


def hashes(selected: Column) -> Column:
    return F.array_distinct(F.transform(selected, lambda v: F.shiftright(v, 32)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of hashes; two empty sets are alike."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, both / either).otherwise(F.lit(1.0))


SPAN = 1024
LAST_SPAN = -(1 << 60)


def with_next(rows: DataFrame, span: int = SPAN) -> DataFrame:
    """Adds ``own``, the fingerprint of ``text``, and ``next_text``, ``next_own`` of the row that follows in descending ``doc_id``.

    Rows meet in spans of ``span`` ids and are shuffled once; the first text of each span also serves the span before.
    """
    dealt = rows.withColumn("_span", F.coalesce(F.floor(F.col("doc_id") / span), F.lit(LAST_SPAN))).repartition("_span")
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie").desc()]
    local = Window.partitionBy("_span").orderBy(*order)
    inner = dealt.withColumn("own", winnow(F.col("text"))).withColumns({
        "_text": F.lead("text").over(local), "_own": F.lead("own").over(local), "_last": F.lead(F.lit(True)).over(local).isNull(),
    })
    heads = dealt.groupBy("_span").agg(F.max_by("text", F.struct("doc_id", "tie")).alias("_head"))
    across = Window.orderBy(F.col("_span").desc())
    heads = heads.select("_span", "_head", F.lead("_span").over(across).alias("_to"), F.first("_span").over(across).alias("_top"))
    after = heads.select(F.coalesce("_to", "_top").alias("_to"), F.col("_span").alias("_from"))
    heads = after.join(heads.select(F.col("_span").alias("_to"), "_head"), "_to").select(
        "_from", F.col("_head").alias("_head_text"), winnow(F.col("_head")).alias("_head_own"))
    joined = inner.join(heads, (F.col("_span") == F.col("_from")) & F.col("_last"), "left")
    return joined.select(
        *rows.columns, "own", F.coalesce("_text", "_head_text").alias("next_text"), F.coalesce("_own", "_head_own").alias("next_own"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Winnowing fingerprint of every text, of its edited text, and how alike they and the next document's are.

    The edited text has the last half of the code points (rounded down) replaced by the first as many, or all, of the next
    document's in descending ``id_col``; the last document takes the first one's.  One row per input row: ``id_col``,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.  A null text is empty; null ids come
    last, rows with equal ids are ordered by their text's digest; a table of one row is its own next document; an empty table
    gives an empty result and other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text).alias("text"))
    rows = with_next(rows.withColumn("tie", F.md5("text")))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.select(
        "doc_id", n.cast("bigint").alias("n_chars"), "own", "next_own",
        F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)).alias("edited"),
    )
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", "next_own", winnow(F.col("edited")).alias("changed"))
    mine = hashes(F.col("own"))
    return rows.select(
        F.col("doc_id").alias(id_col), "n_chars", "edited_sha256", printed(F.col("own")).alias("fingerprint"),
        printed(F.col("changed")).alias("edited_fingerprint"),
        let(mine, lambda a: likeness(a, hashes(F.col("changed")))).alias("near_edited"),
        let(mine, lambda a: likeness(a, hashes(F.col("next_own")))).alias("near_next"),
    )


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (
  SELECT doc_id, text, coalesce(lead(text) OVER o, first(text) OVER (ORDER BY doc_id DESC)) AS next_text,
    coalesce(lead(doc_id) OVER o, first(doc_id) OVER (ORDER BY doc_id DESC)) AS next_id
  FROM d WINDOW o AS (ORDER BY doc_id DESC)),
e AS (
  SELECT doc_id, next_id, length(text) AS n_chars, text,
    array_to_string(string_split(text, '')[1:length(text) - length(text) // 2], '') || array_to_string(string_split(next_text, '')[1:length(text) // 2], '') AS edited
  FROM n),
t AS (SELECT doc_id, 0 AS kind, text FROM e UNION ALL SELECT doc_id, 1, edited FROM e),
w AS (SELECT doc_id, kind, list_transform(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), lambda x: ('0x' || md5(x)[1:7])::BIGINT) AS v FROM t),
g AS (
  SELECT doc_id, kind, i, len(v) AS n,
    (((v[i + 1] * 1000003 + coalesce(v[i + 2], 0)) % 2147483647) * 1000003 + coalesce(v[i + 3], 0)) % 2147483647 AS h
  FROM (SELECT *, unnest(range(0, greatest(len(v) - 2, 1))) AS i FROM w WHERE len(v) > 0)),
m AS (
  SELECT doc_id, kind, i, count(*) OVER (PARTITION BY doc_id, kind) AS grams,
    min(h * 4294967296 + 4294967295 - i) OVER (PARTITION BY doc_id, kind ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS v
  FROM g),
s AS (SELECT DISTINCT doc_id, kind, v // 4294967296 AS h, 4294967295 - v % 4294967296 AS p FROM m WHERE i <= greatest(grams - 8, 0)),
f AS (
  SELECT doc_id, kind, string_agg(printf('%x', h::BIGINT) || '@' || p::BIGINT, ',' ORDER BY p) AS printed, list_distinct(list(h)) AS hs
  FROM s GROUP BY ALL),
k AS (
  SELECT e.*, coalesce(a.printed, '') AS fingerprint, coalesce(b.printed, '') AS edited_fingerprint,
    coalesce(a.hs, []) AS ah, coalesce(b.hs, []) AS bh, coalesce(c.hs, []) AS ch
  FROM e LEFT JOIN f a ON a.doc_id = e.doc_id AND a.kind = 0 LEFT JOIN f b ON b.doc_id = e.doc_id AND b.kind = 1
  LEFT JOIN f c ON c.doc_id = e.next_id AND c.kind = 0)
SELECT doc_id, n_chars::BIGINT AS n_chars, sha256(edited) AS edited_sha256, fingerprint, edited_fingerprint,
  CASE WHEN len(ah) + len(bh) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(ah, bh))::DOUBLE / (len(ah) + len(bh) - len(list_intersect(ah, bh))) END AS near_edited,
  CASE WHEN len(ah) + len(ch) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(ah, ch))::DOUBLE / (len(ah) + len(ch) - len(list_intersect(ah, ch))) END AS near_next
FROM k
"""
