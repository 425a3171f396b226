"""Full-text search without an index, by BM25, and rank fusion.

``bm25`` reads the documents themselves, for tables that are searched once (a
task's worktrees and errors); messages and corpora have a stored index
(``inverted``). A query is a handful of terms, which travel to the texts, and
nothing but hits and two sums is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.words import term_of, tokens

K1, B, RRF = 1.2, 0.75, 60
def corpus_size(docs: DataFrame, *columns: str) -> DataFrame:
    """One row: n documents and their mean length."""
    return docs.select(F.size(tokens(*columns)).alias("l")).agg(F.count("*").alias("n_docs"), F.avg("l").alias("mean"))


def bm25(docs: DataFrame, terms: list[str], *columns: str, stems: bool = False) -> DataFrame:
    """term, id, score of each document that has a term; lower is better, as in the usual full-text index."""
    wanted = [term_of(t, stems) for t in terms]
    hits = docs.select("id", tokens(*columns, stems=stems).alias("t")).select("id", F.size("t").alias("length"), F.explode(F.array(*map(F.lit, dict.fromkeys(wanted)))).alias("term"), "t")
    hits = hits.select("id", "term", "length", F.size(F.filter("t", lambda x: x == F.col("term"))).alias("tf")).where("tf > 0")
    n = hits.groupBy("term").agg(F.count("*").alias("n"))
    idf = F.greatest(F.log((F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(1e-6))
    score = -idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return hits.join(F.broadcast(n), "term").crossJoin(F.broadcast(corpus_size(docs, *columns))).select("term", "id", score.alias("score"))


def search(docs: DataFrame, terms: list[str], *columns: str, limit: int = 20, stems: bool = False) -> DataFrame:
    """id, score of the best documents that have all terms."""
    scored = bm25(docs, terms, *columns, stems=stems).groupBy("id").agg(F.sum("score").alias("score"), F.count("*").alias("found"))
    return scored.where(F.col("found") == len(dict.fromkeys(term_of(t, stems) for t in terms))).select("id", F.round("score", 6).alias("score")).orderBy("score", "id").limit(limit)


def snippet(text: Column) -> Column:
    return F.when(F.length(text) <= 220, text).otherwise(F.concat(F.substring(text, 1, 217), F.lit("...")))


def fused(first: DataFrame, second: DataFrame, limit: int = 20) -> DataFrame:
    """id, score: two ranked lists (id, rank) joined by summed 1 / (60 + rank)."""
    both = first.select("id", F.col("rank").alias("a")).join(second.select("id", F.col("rank").alias("b")), "id", "full_outer")
    part = lambda c: F.coalesce(1 / (RRF + F.col(c)), F.lit(0.0))
    return both.select("id", F.round(part("a") + part("b"), 8).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def ranked(df: DataFrame, *order) -> DataFrame:
    """A list that is already cut to its best rows, with ranks from 1."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
