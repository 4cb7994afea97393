"""Grouping of spelling variants by neighbourhoods over a reduced alphabet."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.llm.common import CRC32_SQL, crc32_sql, lower_ascii, text_of
from fieldlens.scale import durable, spread

LETTERS = [chr(c) for c in (*range(0x61, 0x7B), *range(0xC0, 0x100))]
GAPS = r"[^A-Za-zÀ-ÿ]+"
ALPHABETS = (4, 8, 16, 32)
LONG = 32  # words of this length and above share an alphabet
CROWD = 32


def symbol(letter: str, symbols: int) -> str:
    return chr(ord("A") + ord(letter) % symbols)


def reduced(word: Column, symbols: int) -> Column:
    """The word with every letter hashed to one of a few symbols."""
    return F.translate(word, "".join(LETTERS), "".join(symbol(c, symbols) for c in LETTERS))


def vocabulary(docs: DataFrame, id_col: str, text: str, min_length: int, min_count: int, every: int) -> DataFrame:
    """(word, n) over whole texts, after the planted deletions."""
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.explode(F.array_remove(F.split(lower_ascii(text_of(text)), GAPS, -1), "")).alias("w"),
    )
    h = F.crc32(F.concat("id", F.lit(":"), "w").cast("binary"))
    runs = runs.filter(F.length("w") >= min_length).withColumn("h", h)
    at = (F.col("h") % F.length("w")).cast("int")
    shorter = F.concat(F.col("w").substr(F.lit(1), at), F.col("w").substr(at + 2, F.length("w")))
    words = runs.select(F.when(F.col("h") % every == 0, shorter).otherwise(F.col("w")).alias("word"))
    return words.filter(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def alphabet_sizes(words: DataFrame, crowd: int = CROWD) -> dict[int, int]:
    """Number of symbols per word length: the fewest that give no reduced word more than ``crowd`` words, else the most.

    The driver gets at most ``LONG`` times the number of alphabets rows.
    """
    forms = words.select(
        F.least(F.length("word"), F.lit(LONG)).alias("length"),
        F.explode(F.array(*[F.struct(F.lit(s).alias("symbols"), reduced(F.col("word"), s).alias("form")) for s in ALPHABETS])).alias("r"),
    )
    crowds = forms.groupBy("length", "r.symbols", "r.form").agg(F.count("*").alias("n")).groupBy("length", "symbols").agg(F.max("n").alias("n"))
    found: dict[int, int] = {}
    for r in sorted(crowds.collect(), key=lambda r: r["symbols"]):
        if r["length"] not in found and (r["n"] <= crowd or r["symbols"] == ALPHABETS[-1]):
            found[r["length"]] = r["symbols"]
    return found


def neighbours(word: str, sizes: Mapping[int, int], tables: Mapping[int, Mapping[int, str]]) -> tuple[str, set[str]]:
    """The reduced word, and its one-edit neighbourhood over the symbols of the neighbour's length.

    Being near is mutual, so an edge is made at one end: at the longer word by deletion, at the smaller symbol by replacement.
    Lengths without words have no alphabet and no neighbours.
    """
    n, found = len(word), set()
    size = sizes[min(n, LONG)]
    own = word.translate(tables[size])
    for i, c in enumerate(own):
        found.update(own[:i] + chr(s) + own[i + 1:] for s in range(ord(c) + 1, ord("A") + size))
    if (size := sizes.get(min(n - 1, LONG))) is not None:
        form = word.translate(tables[size])
        found.update(form[:i] + form[i + 1:] for i in range(n))
    return own, found


def near_pairs(words: DataFrame, sizes: Mapping[int, int]) -> DataFrame:
    """(word, n, near, near_n): every two words one edit apart, in both directions."""
    tables = {s: {ord(c): symbol(c, s) for c in LETTERS} for s in ALPHABETS}

    def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                keys, own, rows = [], [], []
                for k, w in enumerate(batch.column(0).to_pylist()):
                    form, around = neighbours(w, sizes, tables)
                    keys += [form, *around]
                    own += [True, *[False] * len(around)]
                    rows += [k] * (len(around) + 1)
                taken = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.string()), pa.array(own, pa.bool_()), batch.column(0).take(taken), batch.column(1).take(taken)],
                    names=["key", "own", "a", "n_a"])

    made = spread(words, "word").select("word", "n").mapInArrow(generate, "key string, own boolean, a string, n_a bigint")
    length = F.least(F.length("word"), F.lit(LONG))
    forms = [F.when(length.isin([k for k, v in sizes.items() if v == s]), reduced(F.col("word"), s)) for s in ALPHABETS]
    targets = words.select(F.coalesce(*forms).alias("key"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    met = made.join(targets, "key").filter((~F.col("own") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    ends = F.array(
        F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    return met.select(F.explode(ends).alias("e")).select("e.*")


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root) for every word that has a form, by doubling the steps: rows at their end take no further part.

    Counts at least double from a word to its form, so there are at most log2 of the largest count steps, and the rounds are
    the log2 of that.
    """
    step = durable(forms.select("word", F.col("form").alias("to")))
    done, rest = [], step
    while True:
        further = step.select(F.col("word").alias("to"), F.col("to").alias("next"))
        moved = durable(rest.join(further, "to", "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNull().alias("end")))
        done.append(moved.filter("end").select("word", F.col("to").alias("root")))
        rest = moved.filter("not end").select("word", "to")
        if rest.isEmpty():
            break
        step = durable(step.join(further, "to", "left").select("word", F.coalesce("next", "to").alias("to")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def spelling_groups(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text",
    min_length: int = 5, min_count: int = 3, every: int = 97, ratio: int = 2, crowd: int = CROWD,
) -> DataFrame:
    """Words with the more frequent word one edit away (form) and the end of that chain (root).

    Words are maximal runs of letters in lower case (A-Z only); in one of ``every`` occurrences, told by a hash of id and word, a
    letter is dropped.  Letters are hashed to a few symbols, as few as leave no reduced word with more than ``crowd`` words of
    its length; the reduced words' whole one-edit neighbourhoods are joined to the reduced vocabulary, and the pairs met are
    verified on the words themselves.

    One row per word of at least ``min_length`` letters and ``min_count`` occurrences: word, n, n_near, form, form_n, root.  A
    form has at least ``ratio`` times the word's count; of several the most frequent, then the first by code point.  Null and
    empty texts have no words, a null id hashes like an empty one, repeated rows count each, an empty table gives an empty
    result, other columns are ignored.
    """
    words = durable(vocabulary(docs, id_col, text, min_length, min_count, every))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near")))
    near = near_pairs(words, alphabet_sizes(words, crowd)).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    judged = words.join(near, "word", "left")
    good = -F.col("best.less") >= F.col("n") * ratio
    judged = durable(judged.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(good, F.col("best.near")).alias("form"), F.when(good, -F.col("best.less")).alias("form_n")))
    roots = last_forms(judged.filter("form is not null"))
    return judged.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


SQL = rf"""
WITH RECURSIVE {CRC32_SQL},
r AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS w FROM documents),
k AS (SELECT doc_id, w, count(*) AS n FROM r WHERE length(w) >= 5 GROUP BY ALL),
h AS (SELECT w, n, {crc32_sql("k")} AS h FROM (SELECT *, coalesce(doc_id::VARCHAR, '') || ':' || w AS k FROM k), crc_table),
o AS (SELECT CASE WHEN h % 97 = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM o WHERE length(word) >= 5 GROUP BY ALL HAVING sum(n) >= 3),
d AS MATERIALIZED (
  SELECT DISTINCT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, a.n, v.word, v.n FROM d a JOIN v ON v.word = a.rest
  UNION SELECT v.word, v.n, a.word, a.n FROM d a JOIN v ON v.word = a.rest),
q AS (
  SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS best, max(near_n) AS best_n FROM p GROUP BY ALL),
j AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= 2 * v.n THEN best END AS form,
    CASE WHEN best_n >= 2 * v.n THEN best_n END AS form_n
  FROM v LEFT JOIN q USING (word)),
c AS (
  SELECT word, coalesce(form, word) AS last, form IS NOT NULL AS more FROM j
  UNION ALL SELECT c.word, j.form, true FROM c JOIN j ON j.word = c.last WHERE c.more AND j.form IS NOT NULL),
e AS (SELECT c.word, c.last FROM c JOIN j ON j.word = c.last WHERE j.form IS NULL)
SELECT j.*, e.last AS root FROM j JOIN e USING (word)
"""
