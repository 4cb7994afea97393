"""Removal of repeated passages with prefix-partitioned suffix trees."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlens.llm.common import text_of, words_of
from fieldlens.llm.near import mix, word_hashes
from fieldlens.scale import durable

WINDOW, PREFIX = 50, 8
GROUP = 40_000  # suffixes of a subtree's task
HOT = 5_000  # suffixes with one prefix, beyond which it is lengthened
ID_BYTES = 6
CHUNK = 400_000


def sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours, by doubling."""
    span, out = 1, v
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def anchors_of(words: np.ndarray) -> np.ndarray:
    """For every window of WINDOW words its anchor: the least hash of a run of PREFIX words in it.

    Equal windows have equal anchors, so a window can only repeat where its anchor does.
    """
    n = len(words) - PREFIX + 1
    h = np.zeros(n, np.uint64)
    for j in range(PREFIX):
        h = mix(h * np.uint64(3) + words[j:j + n])
    return sliding_least(h, WINDOW - PREFIX + 1), h


def chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row range, words and row offsets of parts of a batch with about CHUNK words."""
    lists = batch.column("w")
    offsets = np.asarray(lists.offsets).astype(np.int64)
    words = np.asarray(lists.values).view(np.uint64)
    begin = 0
    for i in range(1, len(offsets)):
        if offsets[i] - offsets[begin] >= CHUNK or i == len(offsets) - 1:
            yield begin, i, words[offsets[begin]:offsets[i]], offsets[begin:i + 1] - offsets[begin]
            begin = i


def whole_windows(offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that lie inside one row, and their rows."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.arange(max(n - WINDOW + 1, 0))
    inside = row[at] == row[at + WINDOW - 1] if len(at) else np.zeros(0, bool)
    return at[inside], row[at[inside]]


def list_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, w to the different neighbouring anchors of each document: anchor, doc_id."""
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        for a, _, words, offsets in chunks(batch):
            at, row = whole_windows(offsets, len(words))
            if not len(at):
                continue
            least = anchors_of(words)[0][at]
            new = np.ones(len(at), bool)
            new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(least[new].view(np.int64)), pa.array(ids[a + row[new]].astype(np.int64))], ["anchor", "doc_id"])


def list_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, w, anchors and counts (sorted by anchor) to runs of windows that share a repeated anchor.

    A run has its prefix (the anchor), how often that occurs, doc_id, the first window's start and the words of all its windows
    in ID_BYTES bytes each: the suffixes of one subtree that neighbour each other are sent once.
    """
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        seen = batch.column("seen")
        seen_at = np.asarray(seen.offsets)
        keys, counts = np.asarray(seen.values.field("anchor")).view(np.uint64), np.asarray(seen.values.field("n"))
        for a, b, words, offsets in chunks(batch):
            at, row = whole_windows(offsets, len(words))
            if not len(at):
                continue
            least = anchors_of(words)[0][at]
            part = slice(seen_at[a], seen_at[b])
            # a document's own anchors only: (row, anchor) pairs are matched by one sorted lookup
            owner = np.repeat(np.arange(b - a), np.diff(seen_at[a:b + 1]))
            known = mix(keys[part] ^ mix(owner.astype(np.uint64)))
            order = np.argsort(known)
            known, many = known[order], counts[part][order]
            mine = mix(least ^ mix(row.astype(np.uint64)))
            place = np.minimum(np.searchsorted(known, mine), max(len(known) - 1, 0))
            hit = known[place] == mine if len(known) else np.zeros(len(mine), bool)
            if not hit.any():
                continue
            at, row, least, many = at[hit], row[hit], least[hit], many[place[hit]]
            new = np.ones(len(at), bool)
            new[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at)) - 1
            raw = words.view(np.uint8).reshape(-1, 8)[:, :ID_BYTES].tobytes()
            blobs = [raw[s * ID_BYTES:(e + WINDOW) * ID_BYTES] for s, e in zip(at[first].tolist(), at[last].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                pa.array(least[first].view(np.int64)), pa.array(many[first]), pa.array(ids[a + row[first]].astype(np.int64)),
                pa.array((at[first] - offsets[row[first]]).astype(np.int64)), pa.array(blobs, pa.binary())], ["anchor", "n", "doc_id", "start", "words"])


def subtree_nodes(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Node at depth WINDOW of the suffix tree for the suffixes at ``starts``: equal numbers for equal next WINDOW words.

    The tree is built by doubling: the rank of a suffix at depth 2d is the rank of its pair of ranks at depth d, so ranks are
    the tree's nodes at that depth in the order of the sorted suffixes.  No hashing: pairs are compared as numbers.
    """
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    depth = 1
    while depth * 2 <= WINDOW:
        pair = rank[:-depth] * (len(rank) + 1) + rank[depth:]
        rank, depth = np.unique(pair, return_inverse=True)[1].astype(np.int64), depth * 2
    rest = WINDOW - depth
    return np.unique(rank[starts] * (len(rank) + 1) + rank[starts + rest], return_inverse=True)[1]


def repeats(rows: pd.DataFrame) -> pd.DataFrame:
    """Runs of one subtree task to doc_id, start, end, k1, k2: repeated passages, and open windows of lengthened prefixes.

    The leaves below a node of depth WINDOW are the places of one repeated passage; those of documents above the least doc_id
    are removed.  Where a prefix is spread over several tasks, the places with the task's least doc_id stay open: they are
    returned as single windows with a key of all their words.
    """
    blobs = rows["words"].tolist()
    sizes = np.array([len(x) // ID_BYTES for x in blobs])
    words = np.zeros((sizes.sum(), 8), np.uint8)
    words[:, :ID_BYTES] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, ID_BYTES)
    words = words.view(np.uint64).ravel()
    begins = np.cumsum(sizes) - sizes
    windows = sizes - WINDOW + 1
    run = np.repeat(np.arange(len(sizes)), windows)
    inside = np.arange(len(run)) - np.repeat(np.cumsum(windows) - windows, windows)
    starts = begins[run] + inside
    node = subtree_nodes(words, starts)
    doc = rows["doc_id"].to_numpy()[run]
    place = rows["start"].to_numpy()[run] + inside
    least = np.full(node.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, node, doc)
    gone = doc > least[node]
    # neighbouring removed windows of a run make one passage
    at = np.flatnonzero(gone)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (run[at[1:]] != run[at[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1 if len(at) else first
    none = np.zeros(len(first), np.int64)
    out = [pd.DataFrame({"doc_id": doc[at[first]], "start": place[at[first]], "end": place[at[last]] + WINDOW, "k1": none, "k2": none, "open": False})]
    left = np.flatnonzero(~gone & (rows["n"].to_numpy()[run] > HOT))
    if len(left):
        # one place per node and document is enough to settle what is open for others, but each place needs its own answer
        k1, k2 = np.zeros(len(left), np.uint64), np.full(len(left), 0x9E3779B97F4A7C15, np.uint64)
        for j in range(WINDOW):
            w = words[starts[left] + j]
            k1, k2 = mix(k1 * np.uint64(3) + w), mix((k2 ^ w) * np.uint64(5) + np.uint64(j))
        out.append(pd.DataFrame({"doc_id": doc[left], "start": place[left], "end": place[left] + WINDOW, "k1": k1.view(np.int64), "k2": k2.view(np.int64), "open": True}))
    return pd.concat(out)


@F.pandas_udf(T.StructType([T.StructField("removed", T.LongType()), T.StructField("digest", T.StringType())]))
def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Text and passages (start, end) to the words removed and the digest of those left."""
    for texts, passages in batches:
        removed, digests = [], []
        for text, spans in zip(texts, passages, strict=True):
            words, kept, end = text.encode("utf-8", "replace").split(), [], 0
            for span in sorted((s["start"], s["end"]) for s in spans):
                kept += words[end:max(span[0], end)]
                end = max(end, span[1])
            kept += words[end:]
            removed.append(len(words) - len(kept))
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pd.DataFrame({"removed": removed, "digest": digests})


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Passages (doc_id, start, end in words) whose windows of WINDOW words all start in a document with a smaller id too.

    ``docs``: doc_id (bigint, not null), text.
    """
    hashed = docs.select("doc_id", word_hashes(F.col("text")).alias("w")).filter(F.size("w") >= WINDOW)
    anchors = hashed.mapInArrow(list_anchors, "anchor bigint, doc_id bigint").distinct()
    counts = anchors.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1")
    seen = anchors.join(counts, "anchor").groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "n")).alias("seen"))
    seen = durable(seen)
    total = seen.agg(F.sum(F.size("seen"))).first()[0] or 0
    groups = max(1, math.ceil(total * 1.1 / GROUP))

    place = docs.join(seen, "doc_id").select("doc_id", word_hashes(F.col("text")).alias("w"), "seen")
    runs = place.mapInArrow(list_suffixes, "anchor bigint, n bigint, doc_id bigint, start bigint, words binary")
    # a frequent prefix goes on through the document's digits: its subtree is shared by several tasks
    longer = F.when(F.col("n") > HOT, F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / HOT))).otherwise(F.lit(0))
    runs = runs.withColumn("group", F.pmod(F.xxhash64("anchor", longer), F.lit(groups)))
    found = runs.groupBy("group").applyInPandas(repeats, "doc_id bigint, start bigint, end bigint, k1 bigint, k2 bigint, open boolean")
    found = durable(found)
    same = Window.partitionBy("k1", "k2")
    settled = found.filter("open").withColumn("least", F.min("doc_id").over(same)).filter("doc_id > least")
    return found.filter("NOT open").select("doc_id", "start", "end").unionByName(settled.select("doc_id", "start", "end"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Remove passages of 50 words or more that a document with a smaller id has as well.

    Suffixes are taken at the windows whose anchor (least run of PREFIX words) repeats; the anchor is the prefix that deals them
    to tasks of about GROUP suffixes, a prefix more frequent than HOT is dealt on in parts.  Each task builds the subtree of its
    suffixes down to depth WINDOW; nodes with several documents below are the repeats.  Parts of one prefix are settled by the
    whole window as key, after each part has kept one document per node only, so a passage in a third of all documents meets as
    one row per part.

    One row per input row: ``id_col``, n_words, n_removed, kept_sha256.  Null and empty texts have no words.  A row without id is
    never removed from and makes nothing a repeat; rows that repeat an id do not make each other repeats; an empty table gives
    an empty result and other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text).alias("text"))
    known = rows.filter(F.col("doc_id").isNotNull())
    passages = repeated_passages(known).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("passages"))
    marked = known.join(passages, "doc_id", "left")
    n_words = F.size(words_of(F.col("text"))).cast("bigint")
    hit = marked.filter(F.col("passages").isNotNull()).select("doc_id", n_words.alias("n_words"), cut("text", "passages").alias("c"))
    hit = hit.select("doc_id", "n_words", F.col("c.removed").alias("n_removed"), F.col("c.digest").alias("kept_sha256"))
    untouched = marked.filter(F.col("passages").isNull()).select("doc_id", "text").unionByName(rows.filter(F.col("doc_id").isNull()))
    untouched = untouched.select(
        "doc_id", n_words.alias("n_words"), F.lit(0).cast("bigint").alias("n_removed"), F.sha2(F.array_join(words_of(F.col("text")), " "), 256).alias("kept_sha256"))
    return hit.unionByName(untouched).withColumnRenamed("doc_id", id_col)


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first FROM w) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM r)),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM d),
kept AS (
  SELECT w.doc_id, count(*) FILTER (g.p IS NOT NULL) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY w.p) FILTER (g.p IS NULL), '') AS text
  FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.p = w.p GROUP BY ALL)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
