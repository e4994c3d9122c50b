"""The whole pipeline over small tables: stages keep, drop and pack what they should."""

import numpy as np
import pytest

import corpus_pipeline
from orderpulse.llm import decontaminate, simhash


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    prose = lambda k: " ".join(f"word{x} and the" for x in rng.integers(0, 900, k))
    junk = lambda k: " ".join(f"{x}$$ ### &&" for x in rng.integers(0, 900, k))
    passage = prose(20)
    rows = [(i, prose(40) if i % 2 else junk(40)) for i in range(300)]
    copied = prose(60)
    rows += [(400 + i, copied) for i in range(30)] + [(500, f"{prose(30)} {passage} {prose(30)}"), (600, None), (601, ""), (None, prose(40)), (700, prose(40)), (700, None)]
    rows += [(800, " ".join([prose(40)] * 300))]
    base = str(tmp_path_factory.mktemp("tables"))
    docs = [(i, t, "en", "s", len(t or ""), 1) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, length int").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(250)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.settle(stage(spark, docs, folder), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            kept[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_filter", "near_dedup", "decontamination", "packed"]
    assert not {i for i in range(0, 300, 2)} & set(kept["quality_filter"]) and {i for i in range(1, 300, 2)} <= set(kept["quality_filter"])
    assert 400 in kept["near_dedup"] and not set(range(401, 430)) & set(kept["near_dedup"]) and {i for i in range(1, 300, 2)} <= set(kept["near_dedup"])
    assert 500 in kept["near_dedup"] and 500 not in kept["decontamination"] and 800 in kept["decontamination"]
    pieces = docs.collect()
    assert {r["doc_id"] for r in pieces} == set(kept["decontamination"])
    room = {}
    for r in pieces:
        room.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in room.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:])) and sum(x[1] for x in parts) <= 1024
    by_doc = {}
    for r in pieces:
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r["length"])
    assert all(sum(v) % k[1] == 0 for k, v in by_doc.items())


def test_stages_by_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 40 or doc_id >= 400")
    ids = {r["doc_id"]: r["text"] or "" for r in docs.where("doc_id <> 700").collect()}
    prints = {i: simhash.fingerprint(t) & (1 << 64) - 1 for i, t in ids.items()}
    least = dict(zip(ids, ids))
    for _ in range(5):
        for a in ids:
            for b in ids:
                if (prints[a] ^ prints[b]).bit_count() <= 3:
                    least[a] = least[b] = min(least[a], least[b])
    got = {r["doc_id"] for r in simhash.dedup(docs.where("doc_id <> 700")).collect()}
    assert got == set(least.values())
    clean = decontaminate.clean(docs.where("doc_id <> 700"), spark.read.parquet(f"{folder}/benchmark.parquet"))
    assert {r["doc_id"] for r in clean.collect()} == set(ids) - {500}


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
