"""Language identification by Bayesian fusion of text, declaration, address and host."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlens.llm.common import free_names, let, salted_left_join, text_key, text_of
from fieldlens.scale import durable

GRAMS = 1 << 13
SLICES = 64
UNKNOWN = "und"
OTHER = "other"


def gram_ids(text: str) -> np.ndarray:
    """Hashed byte trigrams of the whole text in lower case."""
    b = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return b[:0]
    return ((b[:-2] * np.uint32(2654435761)) ^ (b[1:-1] * np.uint32(40503)) ^ (b[2:] * np.uint32(69069))) >> np.uint32(7) & np.uint32(GRAMS - 1)


def labelled_sample(rows: DataFrame, per_language: int, max_languages: int) -> DataFrame:
    """At most ``per_language`` different texts of each label, those with the least digests, for ``max_languages`` labels."""
    keyed = rows.filter(F.col("declared").isNotNull() & (F.length("text") > 0)).withColumn("digest", F.xxhash64("text"))
    # within slices first: a label that holds most rows sends at most SLICES x per_language of them to one task
    least = keyed.select("declared", "digest").distinct().withColumn("slice", F.pmod("digest", F.lit(SLICES)))
    least = least.withColumn("place", F.row_number().over(Window.partitionBy("declared", "slice").orderBy("digest")))
    ranked = least.filter(F.col("place") <= per_language).withColumn(
        "place", F.row_number().over(Window.partitionBy("declared").orderBy("digest")))
    last = ranked.filter(F.col("place") <= per_language).groupBy("declared").agg(F.max("digest").alias("last"), F.count("*").alias("n"))
    last = last.withColumnRenamed("declared", "_label").orderBy(F.col("n").desc(), "_label").limit(max_languages)
    chosen = keyed.join(F.broadcast(last), (F.col("declared") == F.col("_label")) & (F.col("digest") <= F.col("last")))
    return chosen.select("declared", "text", "digest").dropDuplicates(["declared", "digest"])


def train(rows: DataFrame, per_language: int, max_languages: int, smoothing: float) -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities of the hashed trigrams; the last row is the uniform background ``und``."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for label, text in zip(batch["declared"], batch["text"], strict=True):
                totals[label] = totals.get(label, 0) + np.bincount(gram_ids(text), minlength=GRAMS)
        for label, n in totals.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"label": label, "gram": at, "n": n[at]})

    grams = labelled_sample(rows, per_language, max_languages).mapInPandas(count, "label string, gram long, n long")
    grams = grams.groupBy("label", "gram").agg(F.sum("n").alias("n")).toPandas()  # at most labels x GRAMS rows
    languages = sorted(set(grams["label"]))
    n = np.zeros((len(languages), GRAMS))
    n[[languages.index(x) for x in grams["label"]], grams["gram"].to_numpy(int)] = grams["n"]
    logs = np.log((n + smoothing) / (n.sum(1, keepdims=True) + smoothing * GRAMS))
    return [*languages, UNKNOWN], np.vstack([logs, np.full((1, GRAMS), -np.log(GRAMS))])


def scorer(logs: np.ndarray, weight: float):
    table = np.ascontiguousarray(logs.T)

    @F.pandas_udf(T.StructType([T.StructField("ll", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType())]))
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sums, sizes = [], []
            for text in texts:
                ids = gram_ids(text)
                seen = np.bincount(ids, minlength=GRAMS) @ table * weight
                sums.append(seen - seen.max() if len(seen) else seen)
                sizes.append(len(ids))
            yield pd.DataFrame({"ll": sums, "n": sizes})

    return score


def best(values: Column) -> Column:
    """Index of the first largest entry."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def shares(cells: DataFrame, key: str, n_languages: int, parent: str, strength: float) -> DataFrame:
    """Smoothed language shares per ``key``: counts plus ``strength`` times the parent's shares.

    ``cells`` has key, guess, n and the parent's shares, an array column that is the same for all rows of a key.
    """
    counts = [F.sum(F.when(F.col("guess") == i, F.col("n")).otherwise(0)) for i in range(n_languages)]
    grouped = cells.groupBy(key).agg(F.array(*counts).alias("c"), F.sum("n").alias("all"), F.first(parent).alias("p"))
    share = F.transform("c", lambda x, i: (x + strength * F.get("p", i)) / (F.col("all") + strength))
    return grouped.select(key, share.alias("share"))


def identify(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", declared: str | None = "lang", host: str | None = "source",
    per_language: int = 500, max_languages: int = 256, smoothing: float = 0.5, text_weight: float = 0.25, strength: float = 20.0, min_confidence: float = 0.6,
) -> DataFrame:
    """Language of every document from four kinds of evidence.

    * text: naive Bayes on hashed byte trigrams, trained on at most ``per_language`` labelled texts per language (of
      ``max_languages`` languages, those with most labelled texts; other declarations count as one) and scaled by ``text_weight`` because neighbouring trigrams overlap;
    * the declared language: how often each language carries each declaration, over all documents;
    * the address suffix (last part of a dotted host): how often each language stands under each suffix;
    * the host: language shares of the host, smoothed towards those of its domain (last two parts), these towards all documents'.

    Counts of the last three use the language that the text alone suggests and come from grouped sums.  Missing evidence
    contributes nothing.  A uniform background model (``und``) stands for text that is no language.

    One row per input row: ``id_col``, _host, _declared, _k1, _k2 (to find the row again), language, confidence, n_grams, kept.
    ``kept`` is false for texts without trigrams, ``und`` and a posterior below ``min_confidence``.  Null texts are empty and
    rejected, null hosts and declarations are missing evidence, repeated rows get equal rows, an empty table or one without
    any label gives ``und`` for all, other columns are ignored.
    """
    none = F.lit(None).cast("string")
    rows = docs.select(
        F.col(id_col).alias("doc_id"), text_of(text).alias("text"), (F.col(declared) if declared else none).alias("declared"),
        (F.lower(host) if host else none).alias("host"), (F.col(host) if host else none).alias("_host"),
    )
    languages, logs = train(rows, per_language, max_languages, smoothing)
    size = len(languages)
    known = F.array(*[F.lit(x) for x in languages])
    label = F.when(F.col("declared").isNull(), none).otherwise(F.when(F.array_contains(known, F.col("declared")), F.col("declared")).otherwise(OTHER))
    scored = rows.select("doc_id", "host", "_host", F.col("declared").alias("_declared"), label.alias("label"),
                         *[c.alias(n) for n, c in text_key(F.col("text")).items()], scorer(logs, text_weight)("text").alias("s"))
    scored = durable(scored.select("*", "s.ll", "s.n", best(F.col("s.ll")).alias("guess")).drop("s"))

    cells = scored.filter("n > 0").groupBy("host", "label", "guess").agg(F.count("*").alias("n"))
    parts = F.split("host", r"\.")
    dotted = F.size(parts) > 1
    cells = cells.withColumns({
        "suffix": F.when(dotted, F.element_at(parts, -1)), "domain": F.when(dotted, F.array_join(F.slice(parts, -2, 2), ".")).otherwise(F.col("host")),
    })
    counts = F.array(*[F.coalesce(F.sum(F.when(F.col("guess") == i, F.col("n"))), F.lit(0)) for i in range(size)])
    # one row per declaration among the languages: their number bounds it and the row of all
    declarations = cells.filter(F.col("label").isNotNull()).groupBy("label").agg(counts.alias("c"))
    told = cells.filter(F.col("label").isNotNull()).agg(counts.alias("t")).first()["t"]
    total = [float(x) + size + 1 for x in told]
    declarations = declarations.select("label", F.transform("c", lambda c, i: F.log((c + 1.0) / F.get(F.array(*map(F.lit, total)), i))).alias("by_label"))
    sums = cells.agg(counts.alias("c"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    overall = [(x + 1.0 / size) / (sums["n"] + 1.0) for x in sums["c"]]
    all_share = F.array(*map(F.lit, overall))
    cells = cells.withColumn("all_share", all_share)
    domains = shares(cells, "domain", size, "all_share", strength).withColumnRenamed("share", "domain_share")
    suffixes = shares(cells.filter(F.col("suffix").isNotNull()), "suffix", size, "all_share", strength).withColumnRenamed("share", "suffix_share")
    named = cells.filter(F.col("host").isNotNull()).join(domains, "domain")
    hosts = shares(named, "host", size, "domain_share", strength)
    places = named.groupBy("host").agg(F.first("suffix").alias("suffix"), F.first("all_share").alias("all_share"))
    hosts = hosts.join(places, "host").join(suffixes, "suffix", "left")
    # P(suffix | language) up to a factor that no language changes
    address = F.when(F.col("suffix_share").isNull(), F.transform("share", lambda x: F.log(x))).otherwise(
        F.transform("share", lambda x, i: F.log(x) + F.log(F.get("suffix_share", i)) - F.log(F.get("all_share", i))))
    hosts = hosts.select("host", address.alias("by_host"))

    fused = salted_left_join(scored, hosts, ["host"], F.col("_k1")).join(F.broadcast(declarations), "label", "left")
    zero = F.array(*[F.lit(0.0)] * size)
    prior, said = F.coalesce("by_host", F.transform(all_share, lambda x: F.log(x))), F.coalesce("by_label", zero)
    fused = fused.withColumn("total", F.transform("ll", lambda x, i: x + F.get(said, i) + F.get(prior, i)))
    confidence = let(F.array_max("total"), lambda m: 1.0 / F.aggregate("total", F.lit(0.0), lambda a, x: a + F.exp(x - m)))
    fused = fused.withColumns({"language": F.get(known, best(F.col("total"))), "confidence": confidence})
    kept = (F.col("n") > 0) & (F.col("language") != UNKNOWN) & (F.col("confidence") >= min_confidence)
    return fused.select(
        F.col("doc_id").alias(id_col), "_host", "_declared", "_k1", "_k2",
        F.when(F.col("n") > 0, F.col("language")).otherwise(UNKNOWN).alias("language"), "confidence", F.col("n").alias("n_grams"), kept.alias("kept"))


def language_id(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``identify`` without the columns that only serve to find the row again."""
    return identify(docs, id_col, **options).drop("_host", "_declared", "_k1", "_k2")


def keep_languages(docs: DataFrame, id_col: str = "doc_id", text: str = "text", declared: str = "lang", host: str = "source", **options) -> DataFrame:
    """The documents whose language is known well enough, with all their columns.

    Null, empty and other texts without letters have no language and go; very long texts are judged by all their letters.  A
    null host or declaration is a value of its own, rows that repeat id, host, declaration and text share a fate, an empty table
    stays empty.  Only keys are joined, under names that ``docs`` doesn't have.
    """
    i, h, d, k1, k2 = free_names(docs, 5)
    gone = identify(docs, id_col, text, declared, host, **options).filter("NOT kept").select(
        F.col(id_col).alias(i), F.col("_host").alias(h), F.col("_declared").alias(d), F.col("_k1").alias(k1), F.col("_k2").alias(k2))
    key = text_key(text_of(text))
    on = (F.col(id_col).eqNullSafe(F.col(i)) & F.col(host).eqNullSafe(F.col(h)) & F.col(declared).eqNullSafe(F.col(d))
          & (key["_k1"] == F.col(k1)) & (key["_k2"] == F.col(k2)))
    return docs.join(gone, on, "left_anti")


def page_evidence(pages: DataFrame, url: str = "url", html: str = "html", id_col: str = "page_id") -> DataFrame:
    """Visible text, declared language and host of raw pages, as ``identify`` takes them.

    One row per page, repeated ones too; other columns are left out.  A null page has an empty text, a page without a declared
    language or an address without a host has null there, an empty table gives an empty result.
    """
    visible = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"<[^>]*>", " ")
    lang = F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)<html[^>]*\blang=[\"']?([a-z]+)", 1))
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z]+://([^/:?#]+)", 1))
    return pages.select(
        F.col(id_col), visible.alias("text"), F.when(lang != "", lang).alias("lang"), F.when(host != "", host).alias("host"))
