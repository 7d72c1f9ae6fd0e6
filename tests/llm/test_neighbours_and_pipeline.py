import numpy as np
import pytest
from pyspark.sql import functions as F


def brute(ids, vectors, query, k):
    norms = np.sqrt((vectors * vectors).sum(1))
    scores = (vectors * vectors[query]).sum(1) / (norms * norms[query])
    keep = np.flatnonzero(ids != ids[query])
    return keep[np.lexsort((ids[keep], -scores[keep]))[:k]], scores


def test_recall_against_brute_force(spark):
    from prismlake.llm.neighbours import nearest

    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    data = table.toPandas()
    ids, vectors = data["vec_id"].to_numpy(), np.stack(data["embedding"]).astype(float)
    got = nearest(table, F.col("vec_id") % 50 == 0).toPandas()
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        best, scores = brute(ids, vectors, q, 5)
        mine = got[got["query_id"] == ids[q]].sort_values("rank")
        assert mine["rank"].tolist() == [1, 2, 3, 4, 5]
        assert np.abs(mine["score"] - scores[np.searchsorted(ids, mine["vec_id"])]).max() < 1e-12
        hits += len(set(mine["vec_id"]) & set(ids[best]))
        total += 5
    assert hits / total >= 0.95


def test_edge_cases(spark):
    from prismlake.llm.neighbours import nearest

    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, nan]), (6, [inf, 1.0]),
            (7, [None, 1.0]), (None, [1.0, 1.0]), (8, [1.0, 1.0]), (9, [1.0, 2.0, 3.0]), (50, []), (10, [-1.0, 0.0])]
    table = spark.createDataFrame([(i, v, "x", 1.0, 2) for i, v in rows], "vec_id long, embedding array<float>, id string, score double, rank int")
    got = [tuple(r) for r in nearest(table, F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    assert [(q, k, v) for q, k, v, _ in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 8), (0, 4, 10)]
    assert [s for *_, s in got][:2] == [1.0, 1.0] and got[3][3] == -1.0
    assert nearest(table.where("1 = 0"), F.col("vec_id") % 50 == 0).count() == 0


def test_blocks_find_the_same(spark, monkeypatch):
    from prismlake.llm import neighbours

    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    whole = neighbours.nearest(table, F.col("vec_id") % 50 == 0).toPandas()
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 100)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 3)
    split = neighbours.nearest(table, F.col("vec_id") % 50 == 0).toPandas()
    key = ["query_id", "rank"]
    assert whole.sort_values(key).to_numpy().tolist() == split.sort_values(key).to_numpy().tolist()


def test_pipeline_stages(spark, tricky, nothing):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from prismlake.llm.common import materialize
    from prismlake.llm.pii import find_pii
    from prismlake.llm.simhash import simhash_components

    for docs in (tricky, nothing):
        columns = docs.columns
        kept = []
        for name, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, ""))
            if name != "packing":
                assert docs.columns == columns
            kept.append((name, docs))
        if not kept[0][1].isEmpty():
            first, second, third, fourth, last = (d for _, d in kept)
            assert {4, 5, 6}.isdisjoint(r["doc_id"] for r in first.collect())
            groups = simhash_components(second)
            assert groups.count() == groups.select("component_id").distinct().count()
            assert third.count() == second.count() and third.where("text like '%shared30%'").isEmpty()
            assert find_pii(fourth).where(F.size("spans") > 0).isEmpty() and not fourth.where("text like '%[EMAIL]%'").isEmpty()
            assert fourth.where("n_chars <> length(text)").isEmpty()
            assert {r["doc_id"] for r in last.collect()} == {r["doc_id"] for r in fourth.collect()}


def test_subpackage_is_only_used_by_the_entry():
    import re
    from pathlib import Path

    root = Path(__file__).resolve().parents[2] / "prismlake"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"prismlake\.llm|from \.+llm", path.read_text()), path
