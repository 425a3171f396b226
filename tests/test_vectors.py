"""Pooling, embedding of pending messages, and neighbours by brute force and by cells."""

import numpy as np
import pytest

from tessella.operators import vectors
from tessella.plans import extra
from tessella.sources import store


def test_pooling():
    found = np.array([[[1.0, 0.0, 9.0], [3.0, 4.0, 9.0], [100.0, 100.0, 100.0]], [[0.0, 0.0, 0.0]] * 3])
    mask = np.array([[1, 1, 0], [0, 0, 0]])
    mean = np.array([2.0, 2.0, 9.0])
    assert vectors.pooled(found, mask, 5)[0].tolist() == [*np.rint(mean / np.linalg.norm(mean) * 127).astype(int).tolist(), 0, 0]
    assert vectors.pooled(found, mask, 2)[0].tolist() == [90, 90] and not vectors.pooled(found, mask, 5)[1].any()
    assert vectors.pooled(np.array([[3.0, 4.0]]), None, 2).tolist() == [[76, 102]] and vectors.pooled(np.ones((2, 3, 1024))).shape == (2, 1024)


def test_only_pending_messages_are_embedded(spark, tmp_path):
    at, log = f"file://{tmp_path}/tables", str(tmp_path / "asked")
    schema = "session_id string, sequence long, role string, content string, timestamp string, tool_name string, project string"
    texts = [f"text {i}" for i in range(10)] + ["", None, "  ", "bad luck"]
    store.upsert_messages(spark, at, spark.createDataFrame([("s", i, "user", t, "2026-01-01T00:00:00Z", None, "p") for i, t in enumerate(texts)], schema).coalesce(1))

    def model(given, fail="bad luck"):
        with open(log, "a") as f:
            f.write("".join(f"{t}\n" for t in given))
        if fail in given:
            raise RuntimeError("no luck")
        return np.array([[[len(t), float(t.split()[-1] == "3"), 1.0]] * 2 for t in given]), np.ones((len(given), 2))

    assert store.pending(spark, at).count() == 11
    n = store.embed(spark, at, model, batch=2)
    left = {r["content"] for r in store.pending(spark, at).collect()}
    asked = open(log).read().split("\n")[:-1]
    assert n == 11 - len(left) and "bad luck" in left and len(left) <= 2 and asked.count("bad luck") == 2
    assert store.embed(spark, at, lambda given: model(given, "-"), batch=100, parts=2) == len(left) and store.pending(spark, at).count() == 0
    assert len(open(log).read().split("\n")) - 1 == len(asked) + len(left)
    row = store.table(spark, at, "vectors").first()
    assert len(row["embedding"]) == 1024 and abs(sum(x * x for x in row["embedding"]) ** 0.5 - 127) < 2


@pytest.fixture()
def close_by(spark, tmp_path):
    """Vectors that 8-bit integers do not tell apart, the nearest last."""
    spark.createDataFrame([(i, [1.0, y]) for i, y in enumerate([0.0, 0.0036, 0.003, 0.002])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(9, "nothing", "en", "web")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_neighbours_by_whole_vectors(spark, close_by):
    assert [tuple(r) for r in extra.knn(spark, close_by).collect()] == [(0, 0.0), (3, 2e-06), (2, 4e-06), (1, 6e-06)]


def test_fused_ranks_are_those_of_whole_vectors(spark, close_by):
    assert [r["id"] for r in extra.hybrid_rrf(spark, close_by).collect()] == [0, 3, 2, 1]


@pytest.mark.parametrize("cells", [None, 2])
def test_cells_find_the_nearest(spark, data, tmp_path, cells):
    held = extra._quantised(spark, data).cache()
    index = vectors.Cells(spark, f"file://{tmp_path}/cells")
    index.build(held, cells)
    rows = {r["message_id"]: np.array(r["embedding"], dtype=float) for r in held.collect()}
    found = index.nearest(held.where("message_id % 100 = 0").selectExpr("message_id as query_id", "embedding as query"), 10).collect()
    hits = total = 0
    for q in {r["query_id"] for r in found}:
        exact = sorted((round(1 - float(v @ rows[q]) / float(np.linalg.norm(v) * np.linalg.norm(rows[q])), 6) + 0.0, i) for i, v in rows.items())[:10]
        mine = sorted((r["distance"], r["message_id"]) for r in found if r["query_id"] == q)
        assert len(mine) == 10 and all(abs(d - (1 - rows[i] @ rows[q] / (np.linalg.norm(rows[i]) * np.linalg.norm(rows[q])))) < 1e-5 for d, i in mine)
        hits, total = hits + sum(d <= exact[-1][0] for d, _ in mine), total + 10
    assert total == 10 * sum(i % 100 == 0 for i in rows) and hits / total >= (0.9 if cells is None else 1.0)
    index.build(held.limit(0))
    assert index.nearest(held.selectExpr("message_id as query_id", "embedding as query")).count() == 0
    held.unpersist()
