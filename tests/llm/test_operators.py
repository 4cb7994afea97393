"""The training-data operators on hard rows, against brute force, and the pipeline's decisions."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldlens.llm import langid, mixing, near, packing, quality, scoring, secrets, sharding, substrings, winnow

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _salt int, node string, words string, key string"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
HARD = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", "a"), (4, "one", None, "a"), (5, LONG, "en", None),
    (6, LONG, "en", "b"), (None, "no id here at all", "fr", "b"), (None, None, "fr", "b"), (7, "same row", "en", "a"), (7, "same row", "en", "a"),
    (8, "é ñ 漢字 \U0001F600 token = \"abcdef0123456789abcdef0123456789\" end", "xx", "c"), (9, "x " * 300, "en", "a"),
]
OPERATORS = {
    "quality": quality.quality_rules, "language": langid.language_id, "packing": packing.best_fit, "substrings": substrings.remove_repeats,
    "mixing": mixing.mixture, "secrets": secrets.secret_scan, "near": near.near_duplicates, "winnow": winnow.fingerprints,
    "scoring": scoring.pseudo_likelihood, "sharding": sharding.extendible_shards,
}
STAGES = dict(corpus_pipeline.STAGES)


def table(spark, rows):
    return spark.createDataFrame([(*r, None, 1, "n", "w", "k") for r in rows], SCHEMA)


def texts(spark, values, source="s"):
    return table(spark, [(i, t, "en", source) for i, t in enumerate(values)])


def prose(rng, n, vocabulary=5000):
    return [f"v{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.mark.parametrize("name", OPERATORS)
def test_hard_rows(spark, name):
    got = OPERATORS[name](table(spark, HARD)).collect()
    if name == "packing":
        assert sum(r["piece"] == 0 for r in got) == len(HARD)
    else:
        assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in HARD)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](table(spark, [])).collect() == []


@pytest.mark.parametrize("name", STAGES)
def test_stage_on_hard_and_empty_rows(spark, name):
    docs = table(spark, HARD)
    out = STAGES[name](spark, docs, SF)
    out.collect()
    assert STAGES[name](spark, table(spark, []), SF).collect() == []
    if name != "packing":
        assert out.columns == docs.columns


@pytest.mark.parametrize("name", STAGES)
def test_stage_with_every_temporary_name(spark, name):
    docs = table(spark, HARD)
    taken = ["_spans", "_s_id", "_s1", "_s2", "_copies", "_m_id", "_m1", "_m2", "_gone", "_g_id", "_g1", "_g2", "_k1", "_k2", "_x0", "_x1", "_x2",
             "_x3", "_x4", "_host", "_declared", "label", "least", "size", "rank", "start", "end", "kind", "live", "row", "digest", "_least", "_n1"]
    extra = docs.withColumns({c: F.lit(3) for c in taken})
    plain, wide = STAGES[name](spark, docs, SF), STAGES[name](spark, extra, SF)
    assert sorted(map(repr, wide.select(plain.columns).collect())) == sorted(map(repr, plain.collect()))


def test_common_lines_deplete(spark):
    rng = random.Random(1)
    menu = "Home About Contact and all the other entries of a long menu " * 6
    good = [" ".join(prose(rng, 80)) + "\n" + menu.strip() + f" {i}" for i in range(20)]
    thin = [menu.strip() + f" {i}\nshort rest {i}" for i in range(20)]
    kept = {r["doc_id"]: r for r in quality.quality_rules(texts(spark, good + thin)).collect()}
    assert all(kept[i]["n_removed_words"] > 0 and kept[i]["kept"] for i in range(20))
    assert not any(kept[i]["kept"] for i in range(20, 40))


def test_copies_make_their_lines_common(spark):
    rng = random.Random(9)
    page = "\n".join(" ".join(prose(rng, 12)) for _ in range(6))
    rows = [(i, page, "en", "h") for i in range(90)] + [(100 + i, " ".join(prose(rng, 70)), "en", "h") for i in range(10)]
    rows += [(300, page, "en", "other"), (300, page, "en", "other"), (None, page, "en", None)]
    got = quality.quality_rules(table(spark, rows)).collect()
    assert {r["n_removed_words"] for r in got if r["doc_id"] is not None and r["doc_id"] < 90} == {72}
    assert all(r["n_removed_words"] == 0 and r["kept"] for r in got if r["doc_id"] is None or r["doc_id"] >= 100)
    # the limit doesn't rise with the host
    many = [(i, page, "en", "h") for i in range(60)] + [(100 + i, " ".join(prose(rng, 60)), "en", "h") for i in range(1000)]
    got = quality.quality_rules(table(spark, many)).filter("not kept").collect()
    assert {r["doc_id"] for r in got} == set(range(60))
    twice = [(1, page, "en", "h")] * 7
    assert {r["n_removed_words"] for r in quality.quality_rules(table(spark, twice)).collect()} == {72}


def test_language_evidence(spark):
    pages = spark.createDataFrame([
        (i, f"https://www.site{i % 3}.{t}/x", f"<html lang='{t}'><style>p{{}}</style><p>{w}</p></html>")
        for i, (t, w) in enumerate([("de", "der hund und die katze sind nicht hier"), ("fr", "le chien et la souris ne sont pas ici")] * 30)
    ] + [(100, "https://new.site.de/", "<p>ok</p>"), (101, "https://new.site.fr/", "<p>ok</p>")], "page_id bigint, url string, html string")
    got = {r["page_id"]: r for r in langid.language_id(langid.page_evidence(pages), "page_id", host="host").collect()}
    assert (got[100]["language"], got[101]["language"]) == ("de", "fr")  # the suffix decides what the text cannot


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r["language"] for r in langid.language_id(docs, declared="lang", per_language=20).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert np.mean([got[i] == truth[i] for i in truth]) > 0.97


def brute_pack(lengths, capacities):
    bins = []
    left = sum(lengths)
    for n in lengths:
        open_bins = [b for b in bins if b["room"] >= n]
        if open_bins:
            b = min(open_bins, key=lambda b: b["room"])
        else:
            c = min((c for c in capacities if c >= n), key=lambda c: (packing.cost(c) / min(c, left), c))
            bins.append(b := {"room": c, "used": 0})
        b["room"] -= n
        b["used"] += n
        left -= n
    return sorted(b["used"] for b in bins)


def test_packing(spark):
    rng = random.Random(2)
    docs = texts(spark, [" ".join(prose(rng, rng.randrange(0, 90))) for _ in range(200)])
    got = packing.best_fit(docs, capacities=(8, 16, 32)).toPandas()
    full = got[got.length > 0]
    for _, b in full.groupby("bin"):
        b = b.sort_values("offset")
        assert (b.offset.to_numpy() == np.concatenate([[0], b.length.cumsum()[:-1]])).all()
        assert b.length.sum() <= b.capacity.iloc[0] and not any(c >= b.length.sum() for c in (8, 16, 32) if c < b.capacity.iloc[0])
    lengths = full.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True]).length.tolist()
    assert sorted(full.groupby("bin").length.sum()) == brute_pack(lengths, (8, 16, 32))
    sizes = {r["doc_id"]: len((r["text"] or "").split()) for r in docs.collect()}
    assert got.groupby("doc_id").length.sum().to_dict() == sizes


def test_substrings_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    passage, other = prose(rng, 70), prose(rng, 50)
    docs = []
    for i in range(30):
        words = prose(rng, rng.randrange(20, 200))
        for p in (passage, other, passage[5:54]):
            if rng.random() < 0.5:
                at = rng.randrange(len(words))
                words[at:at] = p
        docs.append(words)
    docs.append(docs[3])
    windows = {}
    for i, w in enumerate(docs):
        for k in range(len(w) - 49):
            windows.setdefault(tuple(w[k:k + 50]), i)
    want = {}
    for i, w in enumerate(docs):
        gone = {p for k in range(len(w) - 49) if windows[tuple(w[k:k + 50])] < i for p in range(k, k + 50)}
        want[i] = (len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest())
    for hot in (substrings.HOT, 3):
        monkeypatch.setattr(substrings, "HOT", hot)
        spread = substrings.remove_repeats(texts(spark, [" ".join(w) for w in docs])).collect()
        assert {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in spread} == want


def test_mix_reaches_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 7 > 0, F.col("source")))
    got = mixing.mixture(docs, block=64).toPandas()
    per = got.assign(source=docs.toPandas().set_index("doc_id").source.reindex(got.doc_id).fillna("").to_numpy()).groupby("source")
    assert (abs(per.taken.sum() - per.target.first()) <= 1).all() and (got.taken <= 3 * got["size"]).all()
    assert abs(per.target.first().sum() - got["size"].sum()) < 1e-3
    sized = docs.select("doc_id", "source", F.size(F.split("text", r"\s+")).cast("bigint").alias("size"))
    wanted = mixing.wanted_slots(mixing.source_targets(sized), 64)
    slots = mixing.schedule(wanted, 64).toPandas().sort_values("slot")
    assert slots.slot.is_unique and set(slots.groupby("rank").size()) == {r["slots"] for r in wanted.filter("slots > 0").collect()}
    share = slots.groupby("rank").size() / len(slots)
    head = slots.head(len(slots) // 2).groupby("rank").size() / (len(slots) // 2)
    assert (abs(head.reindex(share.index).fillna(0) - share) < 0.02).all()  # any part of the mix has the shares of the whole


def test_ownership(spark):
    shared, own, bare = "Zx9" + "abcdefgh1234567890", "Qw7" + "mnbvcxzl0987654321", "Kp5trewqasdfgh7654321zxc"
    rows = [(i, f"code token = {shared} done", "en", f"owner{i}") for i in range(5)] + [(9, f"my token: {own} and {bare} here", "en", "owner1")]
    got = {r["doc_id"]: r for r in secrets.secret_scan(table(spark, rows)).collect()}
    assert (got[0]["n_live"], got[0]["n_examples"]) == (0, 1) and got[9]["n_live"] == 2
    at = rows[-1][1].index(bare)
    assert got[9]["spans"].endswith(f"bare:{at}:{at + len(bare)}")
    masked = {r["doc_id"]: r["text"] for r in secrets.redact(table(spark, rows)).collect()}
    assert masked[9] == "my [SECRET] and [SECRET] here" and masked[0] == rows[0][1]


def test_a_sample_key_of_one_owner_is_no_secret(spark):
    key, own = "Ab1" + "cdefghij0123456789", "Zy9" + "xwvutsrq9876543210"
    rows = [(i, f"token = {key} end", "en", "one") for i in range(30)] + [(100, f"token = {own} end", "en", "one")]
    got = {r["doc_id"]: r for r in secrets.secret_scan(table(spark, rows)).collect()}
    assert (got[0]["n_live"], got[0]["n_examples"], got[0]["n_owners"], got[0]["n_repos"]) == (0, 1, 1, 30)
    assert (got[100]["n_live"], got[100]["n_examples"], got[100]["n_repos"]) == (1, 0, 1)
    masked = {r["doc_id"]: r["text"] for r in secrets.redact(table(spark, rows)).collect()}
    assert masked[0] == rows[0][1] and masked[100] == "[SECRET] end"


def test_redact_masks_all_base_spans(spark):
    short, word, number, key = "hunter2x", "correcthorsebattery", "1234567890" * 3, "AKIA" + "QWERTYUIOPASDFGH"
    rows = [(i, "set password = changeme now", "en", f"owner{i}") for i in range(3)]
    rows += [(8, f"a password = {short} b token: {word} c {number} d {key} e", "en", "owner1"), (9, "abcdefghijklmnopqrstuvwxyz stays", "en", "owner1")]
    masked = {r["doc_id"]: r["text"] for r in secrets.redact(table(spark, rows)).collect()}
    assert masked[8] == "a [SECRET] b [SECRET] c [SECRET] d [SECRET] e"
    assert masked[0] == rows[0][1] and masked[9] == rows[-1][1]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_alignment_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        a = [rng.randrange(60) for _ in range(rng.randrange(1, 60))]
        b = list(a)
        for _ in range(rng.randrange(8)):
            at = rng.randrange(len(b) + 1)
            b[at:at + rng.randrange(2)] = [rng.randrange(60)] * rng.randrange(2)
        m = lcs(a, b)
        value = m / (len(a) + len(b) - m) if b else 0.0
        assert near.aligned(a, b) == (value if value >= 0.8 else 0.0)


def test_near_duplicates(spark):
    rng = random.Random(5)
    bases = [prose(rng, 120) for _ in range(40)]
    docs = [list(b) for b in bases]
    for b in bases[:20]:
        for _ in range(3):
            copy = list(b)
            copy[rng.randrange(len(copy))] = "edited"
            docs.append(copy)
    docs += [bases[0], bases[0]]
    got = {r["doc_id"]: r for r in near.near_duplicates(texts(spark, [" ".join(w) for w in docs])).collect()}
    for i in range(40):
        assert got[i]["class_id"] == i and got[i]["kept"]
    for k in range(60):
        assert got[40 + k]["class_id"] == k // 3 and not got[40 + k]["kept"]
    assert got[100]["class_id"] == got[101]["class_id"] == 0


def test_families_on_a_shared_passage(spark, monkeypatch):
    """Sixty pairs made from one passage: most links lie between texts that are neither central nor neighbours."""
    rng = random.Random(0)
    base, docs = prose(rng, 120), []
    for f in range(60):
        family = list(base)
        family[rng.randrange(120)] = f"f{f}x{rng.randrange(10**6)}"
        for _ in range(2):
            copy = list(family)
            copy[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
            docs.append(" ".join(copy))
    runs, least = [near.runs_of(d) for d in docs], list(range(120))
    for i in range(120):
        for j in range(i):
            if least[i] != least[j] and near.aligned(runs[i], runs[j]):
                x, y = sorted((least[i], least[j]))
                least = [x if c == y else c for c in least]
    monkeypatch.setattr(near, "BLOCK", 20, raising=False)  # several pieces a bucket
    got = {r["doc_id"]: r["class_id"] for r in near.near_duplicates(texts(spark, docs)).collect()}
    assert [got[i] for i in range(120)] == least


def test_rare_runs_miss_no_pair(spark, monkeypatch):
    """The pairs that meet on rare runs against all pairs, with lengths across classes and runs that most texts hold."""
    rng = random.Random(8)
    base, docs = prose(rng, 150), []
    for _ in range(70):
        words = list(base[rng.randrange(20):150 - rng.randrange(20)])
        for _ in range(rng.randrange(9)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        docs.append(" ".join(words))
    docs = list(dict.fromkeys(docs)) + ["a b c", "a b c d e f a b c d e f"]
    runs = [near.runs_of(d) for d in docs]
    want = {(i, j) for j in range(len(docs)) for i in range(j) if near.aligned(runs[i], runs[j])}
    monkeypatch.setattr(near, "BLOCK", 20)
    texts_ = spark.createDataFrame(list(enumerate(docs)), "node bigint, text string")
    got = {tuple(r) for r in near.cross_pairs(texts_.select("node", F.col("node").alias("label")), texts_).collect()}
    assert want <= got and 50 < len(want) and len(got) < len(docs) * (len(docs) - 1) / 2


def test_near_duplicates_with_repeated_and_null_ids(spark):
    rng = random.Random(12)
    a, b, c = (prose(rng, 60) for _ in range(3))
    edit = lambda w: " ".join([*w[:-1], "edited"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(c)), (None, edit(a)), (None, edit(c)), (3, edit(b)), (2, " ".join(c)), (4, ""), (4, "")]
    lone = prose(rng, 60)
    rows += [(None, " ".join(lone)), (None, " ".join(lone)), (None, edit(lone))]
    docs = table(spark, [(i, t, "en", "s") for i, t in rows])
    for extra in ("_gone", "_x0", "_k1", "least", "kept"):
        docs = docs.withColumn(extra, F.lit(7))
    out = near.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert Counter(i for i, _ in kept) == {1: 2, 2: 1, 4: 2, None: 1}
    assert {t for i, t in kept if i == 1} == {" ".join(a), " ".join(b)}
    got = Counter((r["doc_id"], r["class_id"], r["kept"]) for r in near.near_duplicates(docs).collect())
    assert got[(None, 1, False)] == got[(None, 2, False)] == got[(3, 1, False)] == 1
    assert got[(None, None, True)] + got[(None, None, False)] == 3 and got[(None, None, True)] in (1, 2)


def test_winnow_guarantee(spark):
    rng = random.Random(6)
    shared = prose(rng, winnow.K + winnow.W - 1)
    pairs = [(" ".join(prose(rng, 40) + shared + prose(rng, 30)), " ".join(prose(rng, 25) + shared + prose(rng, 60))) for _ in range(30)]
    df = spark.createDataFrame(pairs, "a string, b string")
    both = F.size(F.array_intersect(winnow.hashes(winnow.winnow(F.col("a"))), winnow.hashes(winnow.winnow(F.col("b")))))
    assert df.select(F.min(both)).first()[0] > 0


def test_network_beats_frequencies():
    rng = np.random.default_rng(0)
    ids = [scoring.EDGE]
    for _ in range(20_000):
        ids.append((ids[-1] * 7 + 3 + rng.integers(0, 2)) % 40)
    w = scoring.windows(np.array([*ids, scoring.EDGE]))
    train, held = w[:15_000], w[15_000:]
    counts = np.bincount(train, minlength=scoring.CLASSES**3).astype(float).reshape(-1, scoring.CLASSES)
    table = scoring.train(counts)
    plain = np.log((counts.sum(0) + 0.5) / (counts.sum() + 0.5 * scoring.CLASSES))
    assert table[held].mean() > plain[held % scoring.CLASSES].mean() + 1


def test_shards_split_only_where_needed(spark):
    rng = random.Random(7)
    docs = texts(spark, ["x" * rng.randrange(1, 400) for _ in range(300)] + ["y" * 5000])
    got = sharding.extendible_shards(docs, limit_bytes=2000, step=2).toPandas()
    size = defaultdict(int)
    for r in got.itertuples():
        size[r.shard] += r.n_bytes
    for shard, total in size.items():
        assert total <= 2000 or (got.shard == shard).sum() == 1
        parent = shard[:-1]
        assert not shard or sum(v for k, v in size.items() if k.startswith(parent)) > 2000
    names = sorted(size)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False))
    same = table(spark, [(1, "z" * 300, "en", "s")] * 30)
    pages = sharding.extendible_shards(same, limit_bytes=1000).groupBy("shard", "page").agg(F.sum("n_bytes").alias("n")).collect()
    assert max(r["n"] for r in pages) <= 1000


def test_pipeline_is_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = STAGES["language ID"](spark, docs, SF)
    one = STAGES["near-duplicates"](spark, kept, SF).collect()
    runs = {r["doc_id"]: near.runs_of(r["text"]) for r in kept.collect()}
    classes = {i: i for i in runs}

    def root(i):
        while classes[i] != i:
            i = classes[i]
        return i

    at = defaultdict(set)
    for i, run in runs.items():
        for g in run:
            at[g].add(i)
    for a, b in {(a, b) for s in at.values() for a in s for b in s if a < b}:
        if near.aligned(runs[a], runs[b]):
            x, y = sorted((root(a), root(b)))
            classes[y] = x
    assert sorted(r["doc_id"] for r in one) == sorted(i for i in runs if root(i) == i)
    whole = spark.createDataFrame(one, docs.schema)
    masked = STAGES["secrets"](spark, whole, SF)
    mixed = STAGES["source mix"](spark, masked, SF)
    words = sum(len((r["text"] or "").split()) for r in mixed.collect())
    packed = STAGES["packing"](spark, mixed, SF)
    assert packed.agg(F.sum("length")).first()[0] == words
    assert corpus_pipeline.run(spark, SF).agg(F.sum("length")).first()[0] == words
