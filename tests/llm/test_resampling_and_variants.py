"""Exact dedup, importance resampling and spelling variants against brute force, on hard rows and skewed ones."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fieldlens.llm import exact, resampling, spelling

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id int, row string, digest string, word string, n string, _part int"
LONG = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}x{i % 31}" for i in range(60_000))
HARD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, LONG), (6, LONG), (None, "no id here at all"), (None, "no  id here at all"),
    (7, "same row"), (7, "same row"), (7, "same id, other text"), (8, "é ñ 漢字 \U0001F600 Élan éLAN élan"), (9, "x " * 300), (10, " "), (11, "y" * 200_000),
]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, "r", "d", "w", "n", 2) for i, t in rows], SCHEMA)


def prose(rng, n, vocabulary=400):
    return " ".join(f"v{rng.randrange(vocabulary)}" for _ in range(n))


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = Counter()
    for text, ids in groups.items():
        first = min((i for i in ids if i is not None), default=None)
        digest, left = hashlib.sha256(text.encode()).hexdigest(), True
        for i in ids:
            out[(i, first, len(ids), left and i == first, digest)] += 1
            left = left and i != first
    return out


@pytest.mark.parametrize("counters", [1, 3, 1023])
def test_exact_duplicates(spark, counters):
    rng = random.Random(1)
    rows = HARD + [(100 + i, rng.choice(["hot text", "hot\ttext", "hot \n text", prose(rng, 3, 4), prose(rng, 5)])) for i in range(400)]
    rng.shuffle(rows)
    got = exact.exact_duplicates(table(spark, rows).repartition(7), counters=counters)
    assert Counter(tuple(r) for r in got.collect()) == brute_exact(rows)
    docs = table(spark, rows)
    kept = exact.drop_exact_duplicates(docs, counters=counters)
    assert kept.columns == docs.columns
    want = Counter((k[0], k[4]) for k, n in brute_exact(rows).items() if k[3] for _ in range(n))
    assert Counter((r["doc_id"], hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "").encode()).hexdigest()) for r in kept.collect()) == want


def test_misra_gries_bound(spark):
    rng = random.Random(2)
    rows = ["a"] * 300 + ["b"] * 120 + [f"r{rng.randrange(500)}" for _ in range(580)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(r,) for r in rows], "digest string").repartition(5)
    for counters in (2, 4, 10, 50):
        got = {r["digest"] for r in exact.frequent_candidates(df, len(rows), counters).collect()}
        assert len(got) <= counters + 1
        assert {v for v, n in Counter(rows).items() if n > 2 * len(rows) / (counters + 1)} <= got
    kept = {}
    for k in range(0, len(rows), 10):
        kept = exact.offer(kept, Counter(rows[k:k + 10]), 4)
    assert len(kept) <= 4 and all(0 <= Counter(rows)[v] - n <= len(rows) / 5 for v, n in kept.items())


def features(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_resample(rows, target, share, least):
    bucket = lambda w: zlib.crc32(w.encode()) % 10000
    s, t = (Counter(bucket(w) for text in side for w in features(text)) for side in ([r[1] for r in rows], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))
    out = []
    for i, text in rows:
        fs = features(text)
        weight = sum(gain(bucket(w)) for w in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = Counter((*r, k + 1) for k, r in enumerate(able[:len(able) * share // 100]))
    left = Counter(out) - Counter(able[:len(able) * share // 100])
    return drawn + Counter({(*r, None): n for r, n in left.items()})


@pytest.mark.parametrize("share", [0, 10, 50, 100])
def test_resample(spark, share):
    rng = random.Random(3)
    rows = HARD + [(100 + i, prose(rng, rng.randrange(10, 60))) for i in range(150)] + [(50, "same words " * 20)] * 9
    target = [prose(rng, 50, 40) for _ in range(10)] + [None, ""]
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(table(spark, rows), bench, share_pct=share).collect()
    key = ("doc_id", "n_features", "weight", "score", "rank")
    assert Counter(tuple(r[c] for c in key) for r in got) == brute_resample(rows, target, share, 20)


def test_cutoff_among_ties(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(3), rng.choice([-2**62, 5, 6, 2**62]), k) for k in range(200)]
    df = spark.createDataFrame(rows, "a bigint, b bigint, c bigint")
    keys = [F.col("a"), F.col("b"), F.col("c")]
    for wanted in (1, 7, 66, 150, 200):
        limits = resampling.cutoff(df, keys, wanted)
        assert sorted(tuple(r) for r in df.filter(resampling.within(keys, limits)).collect()) == sorted(rows)[:wanted]


def test_longer_runs_and_no_target(spark):
    docs = table(spark, [(1, "a b c"), (2, "a"), (3, None)])
    none = spark.createDataFrame([], "text string")
    got = {r["doc_id"]: r["n_features"] for r in resampling.resample(docs, none, longest=3, min_words=1, share_pct=100).collect()}
    assert got == {1: 6, 2: 1, 3: 0}


def test_drawn_documents(spark):
    rng = random.Random(5)
    docs = table(spark, [(i, prose(rng, 40)) for i in range(50)])
    bench = spark.createDataFrame([(prose(rng, 50, 40),)], "text string")
    ids = {r["doc_id"] for r in resampling.resample(docs, bench).collect() if r["rank"]}
    got = resampling.drawn_documents(docs, bench)
    assert got.columns == docs.columns and {r["doc_id"] for r in got.collect()} == ids and len(ids) == 5


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_spelling(rows, every=97):
    counts = Counter()
    for i, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for w in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    form, near = {}, {}
    for w, n in words.items():
        found = sorted(((-m, v) for v, m in words.items() if one_edit(v, w)))
        near[w], form[w] = len(found), found[0][1] if found and -found[0][0] >= 2 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, near[w], words.get(form[w])))
    return out


@pytest.mark.parametrize("crowd", [1, 3, 32])
def test_spelling_brute_force(spark, crowd):
    rng = random.Random(6)
    letters = "abeiélmÿ×"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 9))) for _ in range(25)] + ["z" * 40, "z" * 41, "z" * 30 + "y" * 12]
    words = []
    for k, w in enumerate(base):
        words += [w] * (4 + 40 * (k % 4))
        for _ in range(12):
            at, c = rng.randrange(len(w) + 1), rng.choice(letters)
            v = rng.choice([w[:at] + c + w[at:], w[:at] + w[at + 1:], w[:at] + c + w[at + 1:]])
            words += [v.upper() if rng.random() < 0.3 and v.isascii() else v] * rng.randrange(1, 9)
            w = v if rng.random() < 0.5 else w
    rng.shuffle(words)
    rows = HARD[:4] + HARD[6:] + [(20 + i, "1 ".join(words[i::60])) for i in range(60)]
    got = spelling.spelling_groups(table(spark, rows), crowd=crowd)
    key = ("word", "form", "root", "n", "n_near", "form_n")
    assert {tuple(r[c] for c in key) for r in got.collect()} == brute_spelling(rows)
    assert any(r[1] and r[2] != r[1] for r in brute_spelling(rows))  # chains of forms


def test_chains_end_at_the_last_form(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(37)], "word string, form string")
    assert {tuple(r) for r in spelling.last_forms(forms).collect()} == {(f"w{i}", "w37") for i in range(37)}


@pytest.mark.parametrize("rows", [HARD, []])
def test_hard_rows_and_empty_tables(spark, rows):
    docs, bench = table(spark, rows), spark.createDataFrame([], "text string")
    assert Counter(r["doc_id"] for r in exact.exact_duplicates(docs).collect()) == Counter(r[0] for r in rows)
    assert Counter(r["doc_id"] for r in resampling.resample(docs, bench).collect()) == Counter(r[0] for r in rows)
    assert len(spelling.spelling_groups(docs).collect()) == len(brute_spelling(rows))
