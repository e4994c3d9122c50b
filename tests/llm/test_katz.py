"""The Katz model against a recursive brute force."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderpulse.llm import katz


def brute(rows):
    """Scores by the definition: {index: (held, n_tokens, n_known, N, base, score)}, and the model's function P(w | v)."""
    def words(t):
        return [w.decode() for w in (t or "").encode().lower().split()]

    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    uni, bi, ctx = Counter(), Counter(), Counter()
    for (_, t), h in zip(rows, held):
        if not h:
            seq = [None, *words(t), "\0end"]
            uni.update(seq[1:])
            bi.update(zip(seq, seq[1:]))
            ctx.update(seq[:-1])
    n, v = sum(uni.values()), len(uni)

    def star(counter):
        coc = Counter(counter.values())
        return katz.discounted([coc[r] for r in range(1, katz.K + 2)])

    s1, s2 = star(uni), star(bi)
    cut = lambda c, s: s[c] if c <= katz.K else c - katz.HALF
    unknown = 1 - sum(cut(c, s1) for c in uni.values()) / n if n else 1.0
    after = {}
    for (a, b), r in bi.items():
        after.setdefault(a, {})[b] = r

    def p1(w):
        return cut(uni[w], s1) / n if w in uni else unknown

    def p(w, a):
        if a not in after:
            return p1(w)
        if w in after[a]:
            return cut(after[a][w], s2) / ctx[a]
        left = 1 - sum(cut(r, s2) for r in after[a].values()) / ctx[a]
        return left / (1 - sum(p1(x) for x in after[a])) * p1(w)

    found = []
    for (i, t), h in zip(rows, held):
        seq = [None, *words(t), "\0end"]
        base = sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (v + 1))) for w in seq[1:])
        score = sum(math.log10(p(w, a)) for a, w in zip(seq, seq[1:]))
        found.append((i, h, len(seq) - 1, sum(w in uni for w in seq[1:]), n, base, score))
    return found, p, uni, after


def corpus(seed, size, vocabulary=40, longest=30):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(vocabulary)]
    rank = 1 / np.arange(1, vocabulary + 1)
    return [(i, " ".join(rng.choice(words, rng.integers(0, longest), p=rank / rank.sum()))) for i in range(size)]


CASES = {
    "zipf": corpus(1, 300),
    "odd": [(None, "A b\tc\x0bA"), (1, None), (2, ""), (2, ""), (3, "É é a \x1c a"), (4, "a b " * 400), (4, "a b " * 400), (7, "new words b"), (9, "x " * 5000)] + corpus(2, 40, 12, 9),
    "copies": [(i, "same text here") for i in range(200)] + [(i, f"other {i} text here") for i in range(200, 260)],
    "empty": [],
    "one": [(0, "a a a")],
}


@pytest.mark.parametrize("name", CASES)
def test_scores(spark, name):
    rows = CASES[name]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string").repartition(3)
    got = katz.score(docs.withColumn("held", katz.held_out(F.col("doc_id")))).collect()
    want = brute(rows)[0]
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    assert len(got) == len(want)
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9, abs=1e-9)


def test_rare_words_and_cold_pairs_take_the_buckets(spark, monkeypatch):
    """With no word known beforehand everything goes through the buckets and gives the same scores."""
    rows = CASES["odd"]
    monkeypatch.setattr(katz, "KNOWN", 0)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = katz.score(docs.withColumn("held", katz.held_out(F.col("doc_id")))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(brute(rows)[0], key=key)):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


@pytest.mark.parametrize("name", ["zipf", "odd"])
def test_heavy_words_keep_the_scores(spark, monkeypatch, name):
    """With buckets for 20 pairs most words are heavy, as second words and as first ones."""
    rows = CASES[name]
    monkeypatch.setattr(katz, "BUCKET", 20)
    monkeypatch.setattr(katz, "HOT", 4)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = katz.score(docs.withColumn("held", katz.held_out(F.col("doc_id")))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(brute(rows)[0], key=key), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


def test_no_bucket_follows_one_word(spark, monkeypatch):
    """300 words of a share below 1/256 each, all far more frequent than a bucket is meant for: neither a second word nor
    the back-offs of a first one fill a bucket."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 300, 100))) for i in range(300)]
    monkeypatch.setattr(katz, "BUCKET", 20)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held", katz.held_out(F.col("doc_id"))).repartition(2).cache()
    voc = katz.Vocabulary(katz.unigrams(docs), docs.where("not held").count())
    voc.pairs = katz.count_hot_pairs(docs, voc)
    buckets = -(-voc.n // 20)
    sent = katz._send(docs, voc, buckets).where(F.col("kind") == katz._TO_SECOND).collect()
    sizes, late = Counter(), Counter()
    for r in sent:
        sizes[r["dest"]] += len(katz.unpack(r["blob"])[8])
    assert sum(sizes.values()) > 20_000 and max(sizes.values()) < 60
    met = katz._grouped(katz._send(docs, voc, buckets), 8, katz._second_words(spark.sparkContext.broadcast(voc), buckets))
    for r in met.where(F.col("kind") == katz._TO_FIRST).collect():
        late[r["dest"]] += len(katz.unpack(r["blob"])[-3])
    assert sum(late.values()) > 3000 and max(late.values()) < 60


def test_probabilities_sum_to_one():
    _, p, uni, after = brute(CASES["zipf"])
    for a in [None, "w0", "w1", "w30", "never"]:
        assert sum(p(w, a) for w in [*uni, "unknown word"]) == pytest.approx(1, abs=1e-9)


def test_discounts_stay_inside():
    for coc in ([0] * 6, [5, 0, 0, 0, 0, 0], [1, 9, 1, 9, 1, 9], [100, 40, 20, 10, 7, 5], [3, 3, 3, 3, 3, 3]):
        star = katz.discounted(coc)
        assert all(0 < star[r] < r for r in range(1, katz.K + 1))


def brute3(rows):
    """Scores of the recursion over triples, pairs and words, and P(w | u, v)."""
    def words(t):
        return [w.decode() for w in (t or "").encode().lower().split()]

    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    _, p, uni, after = brute(rows)
    tri = Counter()
    for (_, t), h in zip(rows, held):
        if not h:
            seq = [None, *words(t), "\0end"]
            tri.update(zip(seq, seq[1:], seq[2:]))
    coc = Counter(tri.values())
    star = katz.discounted([coc[r] for r in range(1, katz.K + 2)])
    cut = lambda c: star[c] if c <= katz.K else c - katz.HALF
    after3 = {}
    for (a, b, c), r in tri.items():
        after3.setdefault((a, b), {})[c] = r

    def p3(w, a, b):
        if (seen := after3.get((a, b))) is None:
            return p(w, b)
        total = sum(seen.values())
        if w in seen:
            return cut(seen[w]) / total
        return (1 - sum(map(cut, seen.values())) / total) / (1 - sum(p(x, b) for x in seen)) * p(w, b)

    found = []
    for (i, t), h in zip(rows, held):
        seq = [None, *words(t), "\0end"]
        found.append((i, h, len(seq) - 1, math.log10(p(seq[1], None)) + sum(math.log10(p3(c, a, b)) for a, b, c in zip(seq, seq[1:], seq[2:]))))
    return found, p3, uni, after3


@pytest.mark.parametrize("name, limits", [
    ("odd", {}), ("copies", {}), ("empty", {}), ("one", {}), ("odd", {"KNOWN": 0}), ("odd", {"BUCKET": 50, "HOT": 4}),
    ("zipf", {"BUCKET": 200, "HOT": 60, "KNOWN": 30, "CHUNK": 9000}),
])
def test_triples_match_the_recursion(spark, monkeypatch, name, limits):
    rows = CASES[name]
    for k, x in limits.items():
        monkeypatch.setattr(katz, k, x)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = katz.score(docs.withColumn("held", katz.held_out(F.col("doc_id"))), order=3)
    got = [(r["doc_id"], r["held_out"], r["n_tokens"], r["score"]) for r in got.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[3])
    for g, w in zip(sorted(got, key=key), sorted(brute3(rows)[0], key=key), strict=True):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3], rel=1e-9, abs=1e-9)


def test_triple_probabilities_sum_to_one():
    _, p3, uni, after3 = brute3(CASES["zipf"])
    for a, b in [*list(after3)[:20], ("w0", "never"), ("never", "w0")]:
        assert sum(p3(w, a, b) for w in [*uni, "unknown word"]) == pytest.approx(1, abs=1e-9)


def test_query_scores_triples(spark, tmp_path):
    rows = corpus(5, 60, 15, 12)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    from orderpulse.llm.queries import QUERIES

    got = {r["doc_id"]: r["score"] for r in QUERIES["op1_katz_backoff"](spark, str(tmp_path)).collect()}
    assert got == {r[0]: pytest.approx(r[3], rel=1e-9) for r in brute3(rows)[0]}


def test_triples_send_few_bytes(spark, monkeypatch):
    """What goes to the buckets of triples, and what they hand on, is a few bytes for each token."""
    monkeypatch.setattr(katz, "BUCKET", 40_000)
    rows, grouped = [], katz._grouped

    def noted(sent, parts, solve):
        rows.append(sent)
        return grouped(sent, parts, solve)

    monkeypatch.setattr(katz, "_grouped", noted)
    ranks = np.minimum(np.random.default_rng(7).zipf(1.3, (2000, 100)), 20_000)
    docs = spark.createDataFrame([(i, " ".join(f"w{x}" for x in row)) for i, row in enumerate(ranks.tolist())], "doc_id long, text string").repartition(3)
    got = katz.score(docs.withColumn("held", katz.held_out(F.col("doc_id"))), order=3)
    assert got.count() == 2000
    size = [x.agg(F.sum(F.length("blob"))).first()[0] / (101 * 2000) for x in rows]
    assert sum(size) < 8, size
