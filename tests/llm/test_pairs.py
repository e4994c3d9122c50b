"""SimHash, embeddings and components against brute force."""

import math

import numpy as np
import pytest
import xxhash

from orderpulse.llm import embeddings, simhash
from orderpulse.llm.common import components, forest


def reach(n, links):
    least = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return least


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if sum(h >> bit & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def texts():
    rng = np.random.default_rng(5)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 400, 120)) for _ in range(40)]
    near = [" ".join([*b.split()[:60], "changed", *b.split()[61:]]) for b in base[:20]]
    return [None, "", " \t\n", "one", "ONE", "Two words", "É a b", "é a b", *base, *near, *base[:5], "a b c " * 3000, "a\x0bb\x0cc d"]


def test_fingerprints():
    for t in texts():
        assert simhash.fingerprint(t) & (1 << 64) - 1 == slow_fingerprint(t)


def test_simhash_groups(spark):
    rows = [(i if i != 3 else None, t, "x", 7) for i, t in enumerate(texts())] + [(9, texts()[9], "x", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string, FP long").repartition(3)
    marked = simhash.fingerprints(docs.select("doc_id", "text"))
    got = {(r["doc_id"], r["fp"]): r["component_id"] for r in marked.join(simhash.groups(marked, tile=8), "fp").collect()}
    fps = [slow_fingerprint(r[1]) for r in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3]
    root = reach(len(rows), links)
    for k, r in enumerate(rows):
        ids = [x[0] for j, x in enumerate(rows) if root[j] == root[k] and x[0] is not None]
        signed = fps[k] - (1 << 64) if fps[k] >> 63 else fps[k]
        assert got[r[0], signed] == (min(ids) if ids else None)
    kept = simhash.dedup(docs, tile=8)
    assert kept.columns == docs.columns
    firsts = {min([rows[j][0] for j in range(len(rows)) if root[j] == g and rows[j][0] is not None], default=None) for g in set(root)}
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == sorted((x is None, x or 0) for x in firsts)


def test_simhash_tiles_find_every_link():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    flips = [np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for k in rng.integers(0, 6, 300)]
    every = np.unique(np.concatenate([a, a ^ np.array(flips)]))
    u, v = simhash.linked(every, every)
    got = reach(len(every), list(zip(np.searchsorted(every, u), np.searchsorted(every, v))))
    x, y = np.nonzero(np.bitwise_count(every[:, None] ^ every[None, :]) <= 3)
    assert got == reach(len(every), list(zip(x.tolist(), y.tolist())))


def test_empty_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.dedup(docs).count() == 0


@pytest.mark.parametrize("links", [[], [(k, k + 1) for k in range(60)], [(0, k) for k in range(1, 50)], [(k, (k * 7) % 101) for k in range(101)], [(5, 5)]])
def test_components(spark, links):
    edges = spark.createDataFrame([(a, b) for a, b in links], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    want = reach(101, [(a, b) for a, b in links])
    nodes = sorted({x for a, b in links if a != b for x in (a, b)})
    assert sorted(got) == nodes
    for a in nodes:
        for b in nodes:
            assert (got[a] == got[b]) == (want[a] == want[b])


def test_forest_keeps_groups():
    u, v = np.array([1, 5, 9, 2]), np.array([5, 9, 12, 3])
    a, b = forest(u, v)
    assert sorted(zip(a.tolist(), b.tolist())) == [(3, 2), (5, 1), (9, 1), (12, 1)]


def vectors():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    rows = [(k, x.tolist(), k % 3) for k, x in enumerate(base)]
    for k in range(60, 160):
        x = base[k % 60] + rng.normal(size=16) * rng.choice([0.01, 0.04, 0.06, 0.2])
        rows.append((k, (x * rng.choice([1.0, 3.0])).tolist(), (k % 60) % 3))
    rows += [(200 + k, base[0].tolist(), 0) for k in range(30)]
    rows += [(300, None, 0), (301, [0.0] * 16, 0), (302, [math.nan] * 16, 0), (303, [math.inf, *[1.0] * 15], 0), (304, [None, *[1.0] * 15], 0), (305, base[0].tolist(), None), (306, [1.0, 2.0], 0), (307, [2.0, 4.0], 0), (308, [], 0)]
    return rows + [(400 + k, base[0].tolist(), 1) for k in range(2)]


@pytest.mark.parametrize("block", [4096, 8])
def test_embeddings(spark, block):
    rows = vectors()
    frame = spark.createDataFrame([(i, x, y, 1) for i, x, y in rows], "vec_id long, embedding array<float>, label int, n_links int").repartition(3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(frame, block=block).collect()}
    fine = [x is not None and y is not None and len(x) > 0 and all(v is not None and math.isfinite(v) for v in x) and any(x) for _, x, y in rows]
    unit = [np.array(x, np.float32).astype(float) / np.linalg.norm(np.array(x, np.float32).astype(float)) if f else None for (_, x, _), f in zip(rows, fine)]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if fine[a] and fine[b] and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98]
    root = reach(len(rows), links)
    for k, (i, _, _) in enumerate(rows):
        n = sum(k in link for link in links)
        assert got[i] == (n, min(r[0] for j, r in enumerate(rows) if root[j] == root[k]))
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0


@pytest.mark.parametrize("bound", [simhash.BROADCAST_ROWS, 0])
def test_dedup_of_repeated_and_null_ids(spark, monkeypatch, bound):
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", bound)
    one, two, three = ("alpha beta gamma delta", "one two three four five", "red green blue black white")
    rows = [(5, one, 2), (5, one, 1), (7, one, 0), (5, two, 4), (9, two, 3), (None, three, 1), (None, three, 0), (4, "", 0), (8, None, 0), (None, "", 1), (11, "no other text is like this", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tied int")
    kept = [tuple(r) for r in simhash.dedup(docs).collect()]
    # Both groups of id 5 share their least id, so one row of the two is left.
    assert sorted(kept, key=str) == sorted([(5, one, 1), (None, three, 0), (4, "", 0), (11, "no other text is like this", 6)], key=str)
