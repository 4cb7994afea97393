"""Quality rules with cross-document line frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.llm.common import SPACES, let, text_of, words_of
from fieldlens.scale import durable

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"


def normalised(line: Column) -> Column:
    """Lower case, digits as 0, white space squeezed: lines that differ in a date or a counter count as one."""
    return F.trim(F.lower(F.translate(F.regexp_replace(line, SPACES, " "), "123456789", "0" * 9)))


def repeated_words(words: Column, window: int = 3) -> Column:
    """Words inside windows of ``window`` words that occur twice or more in the text."""

    def covered(sorted_grams: Column) -> Column:
        twice = F.filter(
            sorted_grams,
            lambda x, k: F.coalesce(F.get(sorted_grams, k - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(sorted_grams, k + 1)["h"] == x["h"], F.lit(False)),
        )
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))
        return F.aggregate(
            starts, zero,
            lambda a, s: F.struct(
                (s + window).alias("end"), (a["n"] + s + window - F.greatest(a["end"], s)).cast("bigint").alias("n")
            ),
            lambda a: a["n"],
        )

    def count(ws: Column) -> Column:
        grams = F.transform(
            F.sequence(F.lit(0), F.size(ws) - window),
            lambda i: F.struct(F.xxhash64(*[F.get(ws, i + j) for j in range(window)]).alias("h"), i.alias("i")),
        )
        return F.when(F.size(ws) >= window, let(F.sort_array(grams), covered)).otherwise(F.lit(0).cast("bigint"))

    return let(words, count)


def lines_with_words(lines: Column) -> Column:
    return F.filter(lines, lambda x: F.translate(x, WHITE, "") != "")


def base_rules(text: Column) -> dict[str, Column]:
    """Counts of the fixed rules for one text."""
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    lines = lines_with_words(F.split(text, "\n", -1))
    return {
        "n_words": F.size(words_of(text)).cast("bigint"),
        "word_chars": F.length(F.translate(text, WHITE, "")).cast("bigint"),
        "n_symbols": symbols.cast("bigint"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
        "n_repeat_words": repeated_words(words_of(text)),
    }


def line_totals(text: Column) -> Column:
    """One entry per distinct normalised line: its hash and the words in all its occurrences."""

    def runs(rows: Column) -> Column:
        firsts = F.filter(
            F.sequence(F.lit(0), F.size(rows) - 1),
            lambda i: F.coalesce(F.get(rows, i - 1)["line"] != F.get(rows, i)["line"], F.lit(True)),
        )
        return let(firsts, lambda starts: F.transform(starts, lambda p, j: F.struct(
            F.get(rows, p)["line"].alias("line"),
            (F.get(rows, p)["words"] * (F.coalesce(F.get(starts, j + 1), F.size(rows)) - p)).cast("bigint").alias("words"),
        )))

    rows = F.transform(
        lines_with_words(F.split(text, "\n", -1)),
        lambda x: F.struct(F.xxhash64(normalised(x)).alias("line"), F.size(words_of(x)).alias("words")),
    )
    empty = F.expr("cast(array() as array<struct<line:bigint,words:bigint>>)")
    return let(F.sort_array(rows), lambda r: F.when(F.size(r) > 0, runs(r)).otherwise(empty))


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source",
    max_docs: int = 5, max_share_pct: int = 10, most_docs: int = 50, min_left_pct: int = 30,
) -> DataFrame:
    """Fixed rules per text, and rejection of documents that mostly consist of their host's common lines.

    A line (normalised and hashed) is common in a host when it stands in more than ``max_docs`` of the host's documents, and in
    more than ``max_share_pct`` percent of them or more than ``most_docs``; the limit doesn't rise any more with large hosts.
    Common lines are removed; a document with less than ``min_left_pct`` percent of its words left is depleted and rejected.

    One row per input row: ``id_col``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    n_removed_words, kept.  Every row is a document, copies of a text as well.  A null text is empty and fails the base rule, a
    null host is a host of its own, repeated rows each get their own (equal) row, an empty table gives an empty result and
    other columns are ignored.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(host).alias("host"), text_of(text).alias("text"))
    # 128 bits stand for a row, repeated rows share them; a null and a missing value hash alike, so the gaps are told apart
    gaps = F.concat(*[F.col(c).isNull().cast("string") for c in ("doc_id", "host")])
    row = {"_a": F.xxhash64("doc_id", "host", "text", gaps), "_b": F.xxhash64(F.lit(1), "doc_id", "host", "text", gaps)}
    source = source.withColumns(row).withColumn("_h", F.xxhash64("host", F.col("host").isNull()))
    lines = durable(
        source.select("_a", "_b", "_h", F.explode(line_totals(F.col("text"))).alias("e"))
        .select("_a", "_b", "_h", F.col("e.line").alias("line"), F.col("e.words").alias("words")))
    hosts = source.groupBy("_h").agg(F.count("*").alias("n_docs"))
    # one row per document and line, summed before the shuffle: the documents that hold the line
    frequent = lines.groupBy("_h", "line").agg(F.count("*").alias("n")).filter(F.col("n") > max_docs)
    common = frequent.join(hosts, "_h").filter(
        (F.col("n") * 100 > F.col("n_docs") * max_share_pct) | (F.col("n") > most_docs)).select("_h", "line")
    removed = lines.join(common, ["_h", "line"]).groupBy("_a", "_b").agg(F.sum("words").alias("total"))
    repeated = source.groupBy("_a", "_b").agg(F.count("*").alias("copies")).filter("copies > 1")
    removed = removed.join(repeated, ["_a", "_b"], "left").select(
        "_a", "_b", (F.col("total") / F.coalesce("copies", F.lit(1))).cast("bigint").alias("removed"))
    rows = source.select("doc_id", "_a", "_b", *[c.alias(n) for n, c in base_rules(F.col("text")).items()])
    rows = rows.join(removed, ["_a", "_b"], "left")
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    left = F.col("n_words") - F.col("n_removed_words")
    return (
        rows.withColumn("n_removed_words", F.coalesce(F.col("removed"), F.lit(0).cast("bigint")))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (left * 100 >= F.col("n_words") * min_left_pct))
        .select(
            F.col("doc_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "base_failed", "n_removed_words", "kept",
        )
    )


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, text FROM d),
g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n
  FROM (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w))),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY ALL),
l AS (
  SELECT doc_id, source, line, trim(lower(regexp_replace(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), '[1-9]', '0', 'g')), ' ') AS norm,
    len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d)),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l WHERE words > 0 GROUP BY ALL),
hosts AS (SELECT source, count(*) AS n FROM d GROUP BY ALL),
common AS (
  SELECT l.source, l.norm FROM l JOIN hosts h ON h.source IS NOT DISTINCT FROM l.source
  WHERE words > 0 GROUP BY l.source, l.norm, h.n
  HAVING count(DISTINCT doc_id) > 5 AND (count(DISTINCT doc_id) * 100 > h.n * 10 OR count(DISTINCT doc_id) > 50)),
gone AS (
  SELECT l.doc_id, sum(words) AS n FROM l JOIN common c ON c.source IS NOT DISTINCT FROM l.source AND c.norm = l.norm GROUP BY ALL),
base AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_removed_words
  FROM w LEFT JOIN r USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT *, NOT base_failed AND 100 * (n_words - n_removed_words) >= 30 * n_words AS kept FROM judged
"""
