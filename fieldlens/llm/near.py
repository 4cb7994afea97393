"""Near-duplicates by Order MinHash and banded alignment."""

from __future__ import annotations

import math
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.llm.common import free_names, salted_left_join, text_key, text_of, words_of
from fieldlens.scale import durable, shared_dir

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 14, 2
BLOCK = 1000  # holders of a run, about, that meet as many others in one task
CHUNK = 400_000  # words that are hashed at once
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of SHINGLE words of each text (one of all words if there are fewer), and how many each text has."""
    counts = np.maximum(sizes - SHINGLE + 1, (sizes > 0).astype(sizes.dtype))
    firsts = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    ends = np.repeat(starts + sizes, counts)
    h = np.zeros(len(firsts), np.uint64)
    for j in range(SHINGLE):
        at = firsts + j
        h = mix(h * np.uint64(3) + np.where(at < ends, words[np.minimum(at, len(words) - 1)], np.uint64(0)))
    return h, counts


def occurrence_labels(grams: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """How often the same gram stands earlier in the same text."""
    order = np.lexsort((grams, owner))
    g, o = grams[order], owner[order]
    fresh = np.ones(len(g), bool)
    fresh[1:] = (g[1:] != g[:-1]) | (o[1:] != o[:-1])
    begins = np.flatnonzero(fresh)
    labels = np.empty(len(g), np.uint64)
    labels[order] = np.arange(len(g)) - np.repeat(begins, np.diff(np.append(begins, len(g))))
    return labels


def order_minhash(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Band keys of each text (all non-empty): BANDS columns, each of ROWS samples.

    A sample takes the two least of the occurrence-labelled grams under its own hash and keeps them in text order.
    """
    owner = np.repeat(np.arange(len(counts)), counts)
    labelled = mix(grams + occurrence_labels(grams, owner) * np.uint64(0x9E3779B97F4A7C15))
    begins = np.cumsum(counts) - counts
    keys = np.zeros((len(counts), BANDS), np.uint64)
    for sample in range(BANDS * ROWS):
        v = mix(labelled ^ np.uint64((sample + 1) * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF))
        first = np.minimum.reduceat(v, begins)
        at_first = np.flatnonzero(v == first[owner])
        v[at_first] = FULL
        second = np.minimum.reduceat(v, begins)
        at_second = np.flatnonzero(v == second[owner])
        # labelled grams differ within a text, so each text has one place (a lone gram has itself as both)
        place1, place2 = np.empty(len(counts), np.int64), np.empty(len(counts), np.int64)
        place1[owner[at_first]], place2[owner[at_second]] = at_first, at_second
        early, late = np.minimum(place1, place2), np.maximum(place1, place2)
        band = sample // ROWS
        keys[:, band] = mix(mix(mix(keys[:, band] + labelled[early]) + labelled[late]) + np.uint64(band))
    return keys.view(np.int64)


def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, _k1, _k2, w (word hashes, not empty) to doc_id, _k1, _k2, keys."""
    for batch in batches:
        lists = batch.column("w")
        offsets = np.asarray(lists.offsets)
        words = np.asarray(lists.values).view(np.uint64)
        sizes = np.diff(offsets).astype(np.int64)
        cuts = [0]
        for i, end in enumerate(offsets[1:], 1):
            if end - offsets[cuts[-1]] >= CHUNK or i == len(sizes):
                cuts.append(i)
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            part = words[offsets[a]:offsets[b]]
            grams, counts = shingles(part, (offsets[a:b] - offsets[a]).astype(np.int64), sizes[a:b])
            keys = order_minhash(grams, counts)
            column = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * BANDS, pa.int32()), pa.array(keys.ravel()))
            same = [batch.column(c).slice(a, b - a) for c in ("doc_id", "_k1", "_k2")]
            yield pa.RecordBatch.from_arrays([*same, column], ["doc_id", "_k1", "_k2", "keys"])


def word_hashes(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def aligned(a: list, b: list, similarity: float = SIMILARITY) -> float:
    """Matches of the best alignment of two sequences within a band, over their union: m / (len(a) + len(b) - m).

    If the value is at least ``similarity``, the two differ in so few places that the alignment never leaves the band, so it
    is exact there; pairs that cannot reach it get 0.  Rows of the alignment are bit vectors.
    """
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < similarity * max(n, m):
        return 0.0
    odd = int((n + m) * (1 - similarity) / (1 + similarity)) + 1  # unmatched entries of both at most
    head = 0
    while head < min(n, m) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    x, y = a[head:n - tail], b[head:m - tail]
    matches = head + tail
    if x and y:
        at: dict = {}
        for j, s in enumerate(y):
            at[s] = at.get(s, 0) | 1 << j
        ones = (1 << len(y)) - 1
        band = (1 << 2 * odd + 1) - 1
        v = ones
        for i, s in enumerate(x):
            hit = at.get(s, 0)
            if hit:
                hit &= band << i - odd if i >= odd else band >> odd - i
                u = v & hit
                v = (v + u | v - u) & ones
        matches += len(y) - v.bit_count()
    value = matches / (n + m - matches)
    return value if value >= similarity else 0.0


def runs_of(text: str) -> list:
    words = text.encode("utf-8", "replace").split()
    if len(words) <= SHINGLE:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[i:i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)]


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs a, b with both texts to the pairs that are alike."""
    last, runs = None, []
    for batch in batches:
        keep = []
        for i, (a, x, y) in enumerate(zip(batch.column("a"), batch.column("text_a"), batch.column("text_b"), strict=True)):
            if a != last:
                last, runs = a, runs_of(x.as_py())
            if aligned(runs, runs_of(y.as_py())):
                keep.append(i)
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], ["a", "b"])


def links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are alike.  A text that many pairs share is split off by the engine's skew join."""
    left = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = left.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(verified, "a bigint, b bigint")


def stored(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read again: a checkpoint keeps the size estimate of its plan, whose digits double with every round of joins."""
    path = f"{shared_dir(df.sparkSession)}/components-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """Least vertex of each vertex's component: v, label.  One job per round, rounds in the logarithm of the diameter or so."""
    both = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("label")))
    while True:
        near = salted_left_join(both, labels.select(F.col("v").alias("b"), "label"), ["b"], F.col("a"))
        near = near.groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        step = labels.join(near, "v").select("v", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("v").alias("low"), F.col("label").alias("far"))
        new = stored(salted_left_join(step, jump, ["low"], F.col("v")).select("v", "label", F.least("low", F.coalesce("far", "low")).alias("next")))
        changed = not new.filter("next < label").isEmpty()
        labels = new.select("v", F.col("next").alias("label"))
        if not changed:
            return labels


def apart_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, with label, of the buckets that hold several components; main (the largest one) and size of the bucket."""
    named = salted_left_join(members, labels.select(F.col("v").alias("node"), "label"), ["node"], F.col("key"))
    named = named.withColumn("label", F.coalesce("label", "node"))
    parts = named.groupBy("band", "key", "label").agg(F.count("*").alias("n"))
    several = parts.groupBy("band", "key").agg(
        F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("size"), F.count("*").alias("parts")).filter("parts > 1")
    return durable(salted_left_join(named, several.drop("parts"), ["band", "key"], F.col("node")).filter(F.col("main").isNotNull()))


def labelled_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, label, w (word hashes) to node, label, runs (how many) and the occurrence-labelled runs, one row each."""
    for batch in batches:
        for i in range(batch.num_rows):
            words = np.asarray(batch.column("w")[i].values).view(np.uint64)
            grams, counts = shingles(words, np.zeros(1, np.int64), np.array([len(words)]))
            runs = mix(grams + occurrence_labels(grams, np.zeros(len(grams), np.int64)) * np.uint64(0x9E3779B97F4A7C15))
            for start in range(0, len(runs), CHUNK):
                part = runs[start:start + CHUNK].view(np.int64)
                same = [pa.array(np.full(len(part), batch.column(c)[i].as_py(), np.int64)) for c in ("node", "label")]
                yield pa.RecordBatch.from_arrays([*same, pa.array(np.full(len(part), counts[0], np.int64)), pa.array(part)], ["node", "label", "runs", "run"])


def cross_pairs(apart: DataFrame, texts: DataFrame) -> DataFrame:
    """All pairs of the nodes left apart that lie in different components and can be alike.

    Two texts of n and m runs that align to 0.8 share at least 4/9 of n + m.  All texts put their runs in one order, those that
    few of these texts hold first.  Two alike texts share one of the first fifth, and one more, of each one's runs; from the
    first shared one on, both have room for all the matches that they need.  So texts meet on such a run if their lengths are
    within 4:5 and the rest of either is long enough, in blocks of about BLOCK by BLOCK where many hold it.
    """
    named = apart.select("node", "label").distinct().join(texts, "node")
    runs = durable(named.select("node", "label", word_hashes(F.col("text")).alias("w")).mapInArrow(
        labelled_runs, "node bigint, label bigint, runs bigint, run bigint"))
    held = runs.groupBy("run").agg(F.count("*").alias("held")).filter("held > 1")
    shared = runs.join(held, "run")  # a hot run is split off by the engine's skew join
    rarity = Window.partitionBy("node").orderBy("held", "run")
    shared = shared.withColumns({"place": F.row_number().over(rarity), "common": F.count("*").over(Window.partitionBy("node"))})
    # runs that one text alone holds come first and match nothing
    rest = F.col("common") - F.col("place") + 1
    size = F.floor(F.log(F.col("runs").cast("double")) / F.lit(math.log(1.25))).cast("bigint")
    front = shared.filter(rest * 5 >= F.col("runs") * 4)
    front = durable(front.select("node", "label", "runs", rest.alias("rest"), "run", size.alias("size")))
    # a text meets those of its own class of lengths and of the next one
    left = front.withColumn("cell", F.explode(F.array("size", F.col("size") + 1)))
    crowds = left.groupBy("run", "cell").agg(F.count("*").alias("n"), F.min("label").alias("x"), F.max("label").alias("y"))
    crowds = crowds.filter("x < y").select("run", "cell", F.ceil(F.col("n") / BLOCK).alias("pieces"))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1))
    own = F.pmod(F.xxhash64("node"), F.col("pieces"))
    left = left.join(crowds, ["run", "cell"]).withColumns({"p": own, "q": every}).drop("pieces")
    right = front.withColumnRenamed("size", "cell").join(crowds, ["run", "cell"]).withColumns({"p": every, "q": own}).drop("pieces")
    x, y = left.alias("x"), right.alias("y")
    meet = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("run", "cell", "p", "q")]
    once = (F.col("x.size") < F.col("x.cell")) | (F.col("x.node") < F.col("y.node"))
    enough = F.least("x.rest", "y.rest") * 9 >= (F.col("x.runs") + F.col("y.runs")) * 4
    on = [*meet, once, F.col("x.label") != F.col("y.label"), enough]
    pairs = x.join(y, on).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    return pairs.distinct()


def classified(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """doc_id, _k1, _k2 (key of the text), words (has any), class_id, kept for every row."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text).alias("text")).withColumns(text_key(F.col("text")))
    hashed = rows.withColumn("w", word_hashes(F.col("text"))).filter(F.size("w") > 0).select("doc_id", "_k1", "_k2", "w")
    nodes = hashed.mapInArrow(sketches, "doc_id bigint, _k1 bigint, _k2 bigint, keys array<bigint>")
    nodes = nodes.groupBy("_k1", "_k2").agg(F.min("doc_id").alias("least"), F.first("keys").alias("keys"))
    nodes = durable(nodes.withColumn("node", F.monotonically_increasing_id()))
    follow = [F.get("keys", F.pmod(F.col("band") + i, F.lit(BANDS)).cast("int")).alias(f"then{i}") for i in (1, 2)]
    bands = nodes.select("node", "keys", F.posexplode("keys").alias("band", "key")).select("node", "band", "key", *follow)
    shared = bands.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1")
    members = salted_left_join(bands, shared, ["band", "key"], F.col("node")).filter(F.col("n").isNotNull())
    degrees = members.groupBy("node").agg(F.sum("n").alias("degree"))
    members = durable(members.drop("n").join(degrees, "node"))
    # the member that meets most others over all bands is most likely the text that the others were made from
    central = F.max_by("node", F.struct("degree", -F.col("node")))
    leaders = members.groupBy("band", "key").agg(central.alias("leader"))
    led = salted_left_join(members.select("band", "key", "node"), leaders, ["band", "key"], F.col("node"))

    # one row for each text that shares a bucket, that of its least id
    wanted = nodes.join(members.select("node").distinct(), "node").select("node", F.col("least").alias("_least"), F.col("_k1").alias("_n1"), F.col("_k2").alias("_n2"))
    same = (F.col("_k1") == F.col("_n1")) & (F.col("_k2") == F.col("_n2")) & F.col("doc_id").eqNullSafe(F.col("_least"))
    texts = durable(rows.join(wanted, same).select("node", "text").dropDuplicates(["node"]))  # read for every comparison
    pair = [F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")]
    pairs = led.filter("node <> leader").select(F.col("leader").alias("x"), F.col("node").alias("y")).select(*pair).distinct()
    pairs = durable(pairs)
    found = durable(links(pairs, texts))
    labels = components(found)

    # what the comparison with the leaders left apart
    apart = apart_members(members, labels)
    order = Window.partitionBy("band", "key").orderBy("then1", "then2", "node")
    beside = apart.select("node", "label", F.lag("node").over(order).alias("y"), F.lag("label").over(order).alias("other"))
    beside = beside.filter("label <> other").select(F.col("node").alias("x"), "y")
    small = apart.filter("label <> main")
    second = small.groupBy("band", "key").agg(central.alias("y"), F.max_by("label", F.struct("degree", -F.col("node"))).alias("other"))
    others = salted_left_join(small.select("band", "key", "node", "label"), second, ["band", "key"], F.col("node"))
    others = others.filter("label <> other").select(F.col("node").alias("x"), "y")
    more = beside.unionByName(others).select(*pair).distinct()
    more = durable(more.join(pairs, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        found = durable(found.unionByName(links(more, texts)))
        labels = components(found)
        apart = apart_members(members.drop("then1", "then2", "degree"), labels)
    # every pair that the centres and neighbours left apart
    rest = cross_pairs(apart, texts).join(pairs.unionByName(more), ["a", "b"], "left_anti")
    linked = durable(links(durable(rest), texts))
    if not linked.isEmpty():
        labels = components(found.unionByName(linked))

    named = nodes.join(labels.select(F.col("v").alias("node"), "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    # of a class the text with the least id stays, texts without any id last
    stays = F.min_by(F.struct("least", "_k1", "_k2"), F.struct(F.col("least").isNull().alias("none"), "least", "_k1", "_k2"))
    best = named.groupBy("label").agg(stays.alias("best"))
    classes = salted_left_join(named.select("label", "_k1", "_k2"), best, ["label"], F.col("_k1")).select("_k1", "_k2", "best")
    out = salted_left_join(rows.select("doc_id", "_k1", "_k2"), classes, ["_k1", "_k2"], F.xxhash64("doc_id"))
    mine = (F.col("best._k1") == F.col("_k1")) & (F.col("best._k2") == F.col("_k2")) & F.col("best.least").eqNullSafe(F.col("doc_id"))
    alone = F.col("best").isNull()
    return out.select(
        "doc_id", "_k1", "_k2", (~alone).alias("words"), F.when(alone, F.col("doc_id")).otherwise(F.col("best.least")).alias("class_id"),
        (alone | mine).alias("kept"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Classes of documents whose five-word runs align to 80 % or more.

    Equal texts are one node.  Order MinHash gives each node BANDS keys; nodes that share one lie in one bucket.  Every node is
    compared with the most central member of each of its buckets.  In buckets that then still hold several components, nodes
    are compared with their neighbour when sorted by their next keys (so with the one they share most keys with), and those
    outside the largest component with the most central one of them.  Nodes of buckets that even then hold several components
    meet on their rarest runs (``cross_pairs``), which any two alike texts of them have in common.  So any two texts that share a
    bucket are compared, connected or too unlike by an exact bound; the pairs inside a component are never listed.  Classes are
    the components of the verified links.

    One row per input row: ``id_col`` (bigint), class_id (least id of the class), kept (it is that document; rows that repeat
    its id and text as well).  Null and empty texts have no words: each stands alone, equal ones too.  Rows that share an id
    but not the text are different documents.  Null ids come after all others; a class without any id has none, and one text of
    it is kept.  Repeated rows share a class; an empty table gives an empty result; other columns are ignored.
    """
    return classified(docs, id_col, text).select(F.col("doc_id").alias(id_col), "class_id", "kept")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, that with the least id; nulls and ties as in ``near_duplicates``.

    Rows that repeat both id and text of the one that stays come out once, rows without words all stay.  Only the keys of rows
    are joined, under names that ``docs`` doesn't have.
    """
    name = free_names(docs, 5)
    verdict = classified(docs, id_col, text).groupBy("doc_id", "_k1", "_k2").agg(
        F.first("kept").alias("kept"), F.max(F.when(F.col("words"), 1)).isNotNull().alias("words"), F.count("*").alias("copies"))
    verdict = verdict.filter("kept").select(
        F.col("doc_id").alias(name[0]), F.col("_k1").alias(name[1]), F.col("_k2").alias(name[2]), (F.col("words") & (F.col("copies") > 1)).alias(name[3]))
    key = list(text_key(text_of(text)).values())
    stay = docs.join(
        verdict, F.col(id_col).cast("bigint").eqNullSafe(F.col(name[0])) & (key[0] == F.col(name[1])) & (key[1] == F.col(name[2])))
    once = stay.filter(F.col(name[3])).dropDuplicates([name[0], name[1], name[2]])
    return stay.filter(~F.col(name[3])).select(docs.columns).unionByName(once.select(docs.columns))
