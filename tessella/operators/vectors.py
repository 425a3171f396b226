"""Vectors of messages: pooling and quantising of a model's output, exact neighbours, and an index of cells.

A model is a function of the caller's; what it gives is pooled, padded or cut to
``DIM`` numbers, brought to length one and stored as 8-bit integers. Distances are
computed on the numbers that a table has: of stored vectors those integers, of
others what they are given as.

The index puts every vector into the cell of its nearest centre; a question opens
the nearest cells only and ranks what is in them by their exact distances.
Centres are fitted on a sample of ``SAMPLE`` rows at most, all rows are indexed.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.shared import read_text, write_text

DIM = 1024
#: Rows that centres are fitted on at most, centres at most, and cells that a question opens.
SAMPLE, MOST_CELLS, PROBES = 100_000, 4_096, 8
#: Texts that a model gets at once, and how often a batch is tried.
BATCH, TRIES = 64, 2
#: A model: texts -> numbers of each text's tokens (n, tokens, d) and their mask (n, tokens), or of each text (n, d) and None.
Model = Callable[[list[str]], tuple[np.ndarray, np.ndarray | None]]


def pooled(found: np.ndarray, mask: np.ndarray | None = None, dim: int = DIM) -> np.ndarray:
    """Vectors of 8-bit integers: the mean over the tokens that the mask names, padded with zeros or cut to ``dim``, of length one."""
    found = np.asarray(found, dtype=np.float64)
    if found.ndim == 3:
        weights = np.ones(found.shape[:2]) if mask is None or not np.size(mask) else np.asarray(mask, dtype=np.float64)
        found = (found * weights[..., None]).sum(axis=1) / np.maximum(weights.sum(axis=1), 1.0)[:, None]
    out = np.zeros((len(found), dim))
    out[:, : min(dim, found.shape[1])] = found[:, :dim]
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.rint(out / np.where(norm == 0, 1.0, norm) * 127).astype(np.int8)


def embedded(texts: DataFrame, model: Model, batch: int = BATCH, tries: int = TRIES, dim: int = DIM) -> DataFrame:
    """message_id, embedding of ``texts`` (id, content) in batches; a batch that fails ``tries`` times has no rows, so its texts stay pending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in batches:
            for at in range(0, held.num_rows, batch):
                part = held.slice(at, batch)
                for _ in range(tries):
                    try:
                        vectors = pooled(*model(part.column("content").to_pylist()), dim)
                        break
                    except Exception:  # whatever a model raises
                        vectors = None
                if vectors is not None and len(vectors) == part.num_rows:
                    flat = pa.array(vectors.reshape(-1))
                    yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, dim, dtype=np.int32)), flat)], names=["message_id", "embedding"])

    return texts.select(F.col("id").cast("long").alias("id"), F.trim("content").alias("content")).mapInArrow(run, "message_id long, embedding array<tinyint>")


def quantised(vector: Column) -> Column:
    """A unit vector of 8-bit integers."""
    double = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(double, F.lit(0.0), lambda a, x: a + x * x))
    scaled = lambda x: F.rint(x / F.when(norm > 0, norm).otherwise(1.0) * 127)
    return F.transform(double, lambda x: F.greatest(F.lit(-128.0), F.least(F.lit(127.0), scaled(x))).cast("tinyint"))


def _inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    """Cosine distance of two vectors, to six digits; sums over 8-bit integers are whole numbers, so they are exact."""
    return F.round(1 - _inner(a, b) / (F.sqrt(_inner(a, a)) * F.sqrt(_inner(b, b))), 6) + F.lit(0.0)


def nearest(vectors: DataFrame, query: DataFrame, limit: int = 20) -> DataFrame:
    """message_id, distance of the nearest of all ``vectors``, in the numbers that they have, to ``query`` (one row: query); none where it has no row."""
    met = vectors.crossJoin(F.broadcast(query.limit(1)))
    return met.select("message_id", distance(F.col("embedding"), F.col("query")).alias("distance")).orderBy("distance", "message_id").limit(limit)


class Cells:
    """An index of vectors at ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, vectors: DataFrame, cells: int | None = None, seed: int = 7) -> None:
        """Indexes all ``vectors`` (message_id, embedding of 8-bit integers); as many cells as the root of their number, unless given."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        n = vectors.count()
        sample = vectors.sample(min(1.0, SAMPLE / n), seed).limit(SAMPLE) if n > SAMPLE else vectors
        centres = [list(vectors.first()["embedding"])] if n == 1 else []
        if n > 1:
            kmeans = KMeans(k=max(2, min(cells or int(n**0.5), MOST_CELLS, n)), seed=seed, maxIter=10, featuresCol="v", predictionCol="cell")
            centres = [c.tolist() for c in kmeans.fit(sample.select(array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("v"))).clusterCenters()]
        write_text(self.spark, f"{self.path}/centres.json", json.dumps(centres))
        own = self._near(F.col("embedding"), 1)
        vectors.select("message_id", "embedding", F.get(own, F.lit(0)).alias("cell")).repartitionByRange("cell", "message_id").sortWithinPartitions("cell").write.mode("overwrite").parquet(f"{self.path}/vectors")

    def _near(self, vector: Column, probes: int) -> Column:
        """The nearest cells of a vector, nearest first."""
        centres = self.spark.sparkContext.broadcast(np.array(json.loads(read_text(self.spark, f"{self.path}/centres.json")), dtype=np.float64))  # at most MOST_CELLS rows

        @F.pandas_udf("array<int>")
        def cells(found: pd.Series) -> pd.Series:
            at = centres.value
            if not len(found) or not len(at):
                return pd.Series([[] for _ in found])
            far = (at**2).sum(axis=1)[None, :] - 2 * np.stack([np.asarray(v, dtype=np.float64) for v in found]) @ at.T
            return pd.Series(list(np.argsort(far, axis=1, kind="stable")[:, :probes].astype(np.int32)))

        return cells(vector)

    def nearest(self, queries: DataFrame, limit: int = 20, probes: int = PROBES) -> DataFrame:
        """query_id, rank, message_id, distance: the nearest vectors of each of ``queries`` (query_id, query), among the ``probes`` nearest cells."""
        asked = queries.select("query_id", "query", F.explode(self._near(F.col("query"), probes)).alias("cell"))
        met = self.spark.read.parquet(f"{self.path}/vectors").join(asked, "cell").select("query_id", "message_id", distance(F.col("embedding"), F.col("query")).alias("distance"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "message_id"))
        return met.withColumn("rank", rank).where(F.col("rank") <= limit).select("query_id", "rank", "message_id", "distance")
