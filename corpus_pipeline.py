"""From raw documents to token ids: quality, line dedup, near duplicates, benchmark decontamination, tokenisation.

Each stage is a function of (spark, docs, sf_dir). It works on all that the stage
before it kept; all stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.shared import discard, written
from tessella.llm import decontaminate, jaccard, line_dedup, quality, sentencepieces

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.scored(docs.select(*COLUMNS), model).where("predicted = 1").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeats of three-line windows; those of which nothing is left go."""
    found = line_dedup.line_dedup(docs.select(*COLUMNS))
    kept = found.where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group that similarities of 0.8 or more (five-word shingles) join.

    Rows with a null id stay; rows that share an id stay or go together.
    """
    groups = jaccard.jaccard_components(docs, 5, 80, 100).where("component_id != doc_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(groups, "doc_id", "left_anti").select(*COLUMNS)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = found.where(F.size("starts") > 0).select("doc_id", F.xxhash64("text").alias("row_hash")).distinct()
    rows = docs.select(*COLUMNS).withColumn("row_hash", F.xxhash64(F.col("text").cast("string")))
    same = rows["doc_id"].eqNullSafe(hit["doc_id"]) & (rows["row_hash"] == hit["row_hash"])
    return rows.join(hit, same, "left_anti").select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document's pieces."""
    return sentencepieces.encode_texts(docs, sentencepieces.model_bytes())


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("SentencePiece encoding", token_stage),
]

#: SQL expresses neither the classifier's nor the tokenizer's stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        kept = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            kept = written(kept, f"stage{number}")
            discard(docs)  # nothing reads the stage before any more
        docs = kept
    return docs
