"""Spelling variants against brute force."""

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np

from orderpulse.llm import spelling


def slow_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def slow_variants(n):
    near = {w: [] for w in n}
    for a, b in combinations(n, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    found = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        found.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return found


def noisy(rng, word):
    i, c = int(rng.integers(0, len(word))), "abéß"[int(rng.integers(0, 4))]
    return [word[:i] + word[i + 1:], word[:i] + c + word[i:], word[:i] + c + word[i + 1:], word][int(rng.integers(0, 4))]


def test_variants(spark):
    rng = np.random.default_rng(3)
    base = ["thousand", "ciónque", "aaaaaaaa", "aabbaabb", "straßenname", "ÀÉÎÕÜÿ×÷", "enlargement"]
    rows = [(i, " ".join(noisy(rng, base[int(k)]) for k in rng.integers(0, len(base), 60)), 1) for i in range(60)]
    rows += [(7, "Thousand thousand-THOUSAND's " * 300, 1), (None, None, 1), (None, "enlargement enlargements " * 4, 1), (8, "", 1), (9, "a" * 5000 + " " + "a" * 5001 + " " + "a" * 5000 + " " + "a" * 5001, 1)]
    rows += [(100 + i, "mississippi " * 100 + "mississippo " * 5 + ("mississippos " if i < 3 else ""), 1) for i in range(12)]  # a chain
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, word int").repartition(4)
    n = slow_words([r[:2] for r in [*rows, rows[0]]])
    expected = slow_variants(n)
    assert sum(r[1] is not None for r in expected) > 20 and any(r[1] != r[2] for r in expected if r[1])
    got = [tuple(r) for r in spelling.variants(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_every_number_of_partitions_gives_each_pair_once(spark):
    rng = np.random.default_rng(4)
    words = sorted({"".join("abcdefg"[int(x)] for x in rng.integers(0, 7, int(k))) for k in rng.integers(7, 9, 900)})
    # Neighbours of every kind, doubled letters among them, for which both halves stay as they were.
    words = sorted({*words, *(noisy(rng, w) for w in words[:300]), *(w[:4] + w[3:] for w in words[:300])} - {w for w in words if len(w) < 5})
    vocabulary = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    expected = {frozenset(p) for p in combinations(words, 2) if one_edit(*p)}
    for parts in (4, 7):
        got = [frozenset((r["a"], r["b"])) for r in spelling.near(vocabulary, parts).collect()]
        assert len(got) == len(set(got)) and set(got) == expected


def test_empty_table_and_sizes(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert [spelling.partitions_for(n) for n in (0, 1_000_000, 20_000_000, 300_000_000)] == [4, 4, 5, 6]
