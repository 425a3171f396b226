"""Quality classifier by compression: a text is like the class whose dictionary compresses it better.

Two zstandard dictionaries are trained, one on whole texts labelled good and one
on whole texts labelled bad. A text is cut into blocks (all of it, no prefix);
each block is compressed on its own with either dictionary, so that a long text
keeps leaning on the dictionaries instead of on its own beginning. The
difference of the compressed sizes, less what the dictionaries differ by on text
that speaks for neither class, is normalised by the raw size and turned into a
probability by a logistic curve; the curve's slope and that bias a byte are
fitted on labelled texts. The length alone says nothing: a text whose difference
is the bias scores the prior, however long it is.

Fitting takes a bounded sample of the labelled rows: in the order of a hash of
the id, ``per_class`` rows of each label or as many as ``SAMPLE_BYTES`` hold,
each with its whole text. Scoring covers every row in one map without a shuffle.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of a block, of a dictionary, and the compression level.
BLOCK, DICTIONARY, LEVEL = 256, 256 * 1024, 3
#: Bytes of a segment that training chooses, of what it compares, and of the pieces that texts are given to it in.
SEGMENT, COMPARED, PIECE = 64, 8, 8192
#: Bytes of neutral text that every text is taken to have besides its own, so that very short ones stay near the prior.
NEUTRAL = 100
#: Bounds of the sample: rows a label, and bytes a label of their whole texts (at least one row is taken).
PER_CLASS, SAMPLE_BYTES = 1500, 64 << 20
THRESHOLD = 0.3
SLICE = 256


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    #: The curve's slope, and minus the slope times the dictionaries' bias a byte; both 0 means that a class had no sample and every text scores the prior.
    weights: tuple[float, float]
    #: Log-odds of a good text among the labelled ones.
    prior: float

    def score(self, text: bytes | None) -> float:
        """Probability of quality 1; null and empty texts get the prior."""
        x = self.prior
        if any(self.weights):
            x += sum(w * z for w, z in zip(self.weights, features(text, self.good, self.bad)))
        return 1 / (1 + math.exp(-x)) if x >= 0 else 1 - 1 / (1 + math.exp(x))


@lru_cache(maxsize=8)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(dictionary)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False)


def features(text: bytes | None, good: bytes, bad: bytes) -> tuple[float, float]:
    """(size with the bad dictionary - size with the good one) and raw size, both over the raw size and ``NEUTRAL``; zeros for null and empty texts."""
    if not text:
        return 0.0, 0.0
    a, b = _compressor(good).compress, _compressor(bad).compress
    blocks = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]
    size = len(text) + NEUTRAL
    return sum(len(b(x)) - len(a(x)) for x in blocks) / size, len(text) / size


def dictionary_of(texts: list[bytes], size: int = DICTIONARY) -> bytes:
    """A dictionary of at most ``size`` bytes trained on the whole texts; of little text, the text itself."""
    pieces = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    if sum(map(len, pieces)) > 2 * size and len(pieces) > 8:
        return zstandard.train_dictionary(size, pieces, k=SEGMENT, d=COMPARED, level=LEVEL).as_bytes()
    return b"\n".join(pieces)


def fit_curve(z: np.ndarray, y: np.ndarray, offset: float) -> tuple[float, float]:
    """Weights of the logistic curve of greatest likelihood through ``offset``, lightly held towards 0 (Newton's method)."""
    scale = z.std(axis=0) + 1e-12
    z, w, penalty = z / scale, np.zeros(2), np.eye(2) * 1e-2
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w + offset, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return tuple((w / scale).tolist())


def fit(rows: list[tuple[int, bytes]], counts: dict[int, int]) -> Model:
    """A model from (label, text) pairs.

    The curve is fitted on texts scored with dictionaries of the other half of
    the sample; the model's dictionaries are built from all of it. ``counts`` are
    all labelled rows by label: the sample has as many rows of either, so the
    curve's offset is moved to the labels' true odds.
    """
    prior = math.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1))
    by = {y: [t for label, t in rows if label == y and t] for y in (0, 1)}
    if min(map(len, by.values())) < 4:
        return Model(b"", b"", (0.0, 0.0), prior)
    z, y = [], []
    for half in (0, 1):
        good, bad = dictionary_of(by[1][half::2]), dictionary_of(by[0][half::2])
        for label, texts in by.items():
            z += [features(t, good, bad) for t in texts[1 - half :: 2]]
            y += [float(label)] * len(texts[1 - half :: 2])
    weights = fit_curve(np.array(z), np.array(y), math.log(len(by[1]) / len(by[0])))
    return Model(dictionary_of(by[1]), dictionary_of(by[0]), weights, prior)


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most_bytes: int = SAMPLE_BYTES) -> tuple[list[tuple[int, bytes]], dict[int, int]]:
    """Labelled texts, whole, in the order of a hash of the id: ``per_class`` of each label, fewer where they exceed ``most_bytes``; and all rows by label. None is held out."""
    free = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("doc_id").isNotNull() & free & F.col("quality").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    picked = [known.where(f"quality = {y}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    ids = picked[0].unionByName(picked[1])  # at most 2 * per_class rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text") > 0)
    sizes = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "quality").agg(F.max(F.octet_length("text")).alias("n"))
    before = F.sum("n").over(Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    within = sizes.withColumn("before", F.coalesce(before, F.lit(0))).where((F.col("before") + F.col("n") <= most_bytes) | (F.col("before") == 0)).select("doc_id", "quality")
    rows = texts.join(F.broadcast(within), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"]))
    return [(r["quality"], r["text"].encode()) for r in rows], counts


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    return fit(*sample(docs, labels, per_class))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of ``docs`` with ``score`` (0 to 1; higher: quality 1 likelier) and ``predicted``, other columns kept.

    Null and empty texts score the prior; very long ones are read whole; repeated
    rows stay and score alike; an empty table gives no rows; columns named score
    or predicted are replaced.
    """
    out = docs.drop("score", "predicted").withColumn("score", F.lit(0.0))
    names = out.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                texts = part.column("text").cast(pa.binary()).to_pylist()
                scores = [model.score(t) for t in texts]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:-1]), pa.array(scores, pa.float64())], names=names)

    return out.mapInArrow(run, out.schema).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels)
    found = scored(docs.select("doc_id", F.col("text").cast("string").alias("text")), model)
    return found.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), "score", "predicted")
