"""The pipeline on the smallest test data: each stage's columns and decisions."""

import corpus_pipeline as p
from pyspark.sql import functions as F

from tessella.functions.shared import written
from tessella.llm import decontaminate, jaccard


def test_stages(spark, data):
    folder = data.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [docs]
    for name, stage in p.STAGES[:-1]:
        docs = written(stage(spark, docs, folder), "stage")
        assert docs.columns == p.COLUMNS and 0 < docs.count() <= seen[-1].count(), name
        seen.append(docs)
    assert jaccard.jaccard_components(seen[3], 5, 80, 100).where("component_id != doc_id").count() == 0
    hit = decontaminate.contamination(seen[4], spark.read.parquet(f"{folder}/benchmark.parquet")).where(F.size("starts") > 0)
    assert hit.count() == 0
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    kept = seen[1].join(labels, "doc_id")
    assert kept.where("quality = 1").count() >= 0.95 * seen[0].join(labels, "doc_id").where("quality = 1").count()
    out = p.run(spark, folder)
    assert out.count() == seen[4].count() and out.where("not round_trip").count() == 0


def test_nulls(spark, data):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some words are here", "en", "s", 19)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("label", F.lit(1))
    for _, stage in p.STAGES:
        docs = written(stage(spark, docs, data), "stage")
    assert docs.count() == 3


def through(spark, data, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("x") for c in ("label", "node", "score", "row_hash", "starts", "n")})
    out = []
    for _, stage in p.STAGES:
        docs = written(stage(spark, docs, data), "stage")
        out.append(docs.collect())
    return out


def test_long_repeated_and_tied_documents(spark, data):
    say = lambda seed, n: " ".join(f"word{(seed * 7919 + i * i) % 9973}" for i in range(n))
    row = lambda i, t: (i, t, "en", "s", len(t))
    long = say(1, 60_000)
    near = " ".join(["new", *long.split()[1:]])
    rows = [row(4, long), row(3, near), row(8, say(2, 60)), row(8, say(2, 60)), row(7, say(2, 60)), row(9, say(3, 60))]
    quality, lines, kept, clean, tokens = through(spark, data, rows)
    assert len(quality) == len(lines) == 6
    assert sorted(r["doc_id"] for r in kept) == sorted(r["doc_id"] for r in tokens) == [3, 7, 9]
    assert next(r for r in tokens if r["doc_id"] == 3)["n_tokens"] > 60_000


def test_empty_table(spark, data):
    assert through(spark, data, []) == [[]] * 5
