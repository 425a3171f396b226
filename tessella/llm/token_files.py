"""Token counts of documents in flat, unindexed token files.

A token file is a run of 16-bit identifiers; an end-of-document identifier closes
each document. ``count_tokens`` cuts files into blocks, finds the separators of a
block with one vectorised comparison, and sends on a small summary: how many
separators, how long the pieces at both ends, how long the documents between. A
prefix scan of the separator counts (a running sum per file) numbers each piece's
document, and pieces of one number add up, however many blocks a document spans.

``write_tokens`` writes such files with Spark's own committed text writer: each
record is a document's bytes and the record separator is the end-of-document
identifier, so no executor touches a local path. A document's id stands at its
front in reserved identifiers (hexadecimal digits above the vocabulary), which
are not counted; files without them give documents by file and ordinal.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.shared import shared_dir

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How that vocabulary cuts a text before merging; a fixed value of the published encoding.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50256
#: Reserved identifiers: DIGIT + d is a hexadecimal digit of an id, NO_ID stands for a null id.
DIGIT, NO_ID, FIRST_RESERVED = 60000, 60016, 60000
#: Identifiers in a block, and documents in a file.
BLOCK, FILE_DOCS = 1 << 16, 1000
SLICE = 256


def vocabulary_bytes(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=2)
def encoding_of(vocabulary: bytes) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def header(doc_id: int | None) -> np.ndarray:
    digits = [NO_ID] if doc_id is None else [DIGIT + int(d, 16) for d in f"{doc_id & (1 << 64) - 1:x}"]
    return np.array(digits, dtype="<u2")


def read_header(ids: np.ndarray) -> tuple[int, int | None]:
    """Length of the header at the front of ``ids`` and the id in it (None: no header or a null id)."""
    n = 0
    while n < min(len(ids), 16) and ids[n] >= FIRST_RESERVED:
        n += 1
        if ids[n - 1] == NO_ID:
            return n, None
    if not n:
        return 0, None
    value = int("".join(f"{int(x) - DIGIT:x}" for x in ids[:n]), 16)
    return n, value - (1 << 64) if value >> 63 else value


def write_tokens(docs: DataFrame, path: str, vocabulary: bytes) -> None:
    """Writes each row's tokens; null and empty texts have none; repeated rows are written as often; very long texts are read whole; an empty table gives no documents; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding_of(vocabulary).encode_ordinary
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                out = [header(i).tobytes() + np.array(encode(t or ""), dtype="<u2").tobytes() for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "value binary")
    end = END.to_bytes(2, "little").decode("latin-1")
    rows.select(F.col("value").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", end).option("maxRecordsPerFile", FILE_DOCS).text(path)


def block_summaries(ids: np.ndarray, end: int, block: int) -> Iterator[tuple[int, int, int, int, list[int], list[int], list[int | None]]]:
    """For each block of a file: number, separators, tokens before the first and after the last of them, lengths between, and header length and id after each.

    Block 0 also has, in front, the header that begins the file.
    """
    for number, at in enumerate(range(0, len(ids), block)):
        part = ids[at : at + block]
        ends = np.flatnonzero(part == end)
        begins = ([0] if not at else []) + (ends + at + 1).tolist()
        heads = [read_header(ids[b : b + 16]) for b in begins]
        if len(ends):
            yield number, len(ends), int(ends[0]), len(part) - 1 - int(ends[-1]), (np.diff(ends) - 1).tolist(), [h[0] for h in heads], [h[1] for h in heads]
        else:
            yield number, 0, len(part), 0, [], [h[0] for h in heads], [h[1] for h in heads]


def count_tokens(spark: SparkSession, path: str, end: int = END, block: int = BLOCK) -> DataFrame:
    """One row for each document in the files: file, ordinal (from 0 in its file), doc_id (null without a header), n_tokens, closed.

    Two separators in a row enclose a document of no tokens. Tokens after the
    last separator are a document that is not ``closed``; an empty file has none,
    an empty folder gives no rows; documents may be as long as a file. A file is
    one row of Spark's ``binaryFile`` source, so it must stay below 2 GB.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids = np.frombuffer(batch.column("content").slice(k, 1)[0].as_buffer(), dtype="<u2")
                rows = list(block_summaries(ids, end, block))
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()))
                    cols = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column("path")[k].as_py()] * len(rows)), *cols], names=["file", "block", "ends", "left", "right", "inner", "head_sizes", "head_ids"])

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    blocks = files.mapInArrow(scan, "file string, block long, ends long, left long, right long, inner array<long>, head_sizes array<long>, head_ids array<long>")
    running = Window.partitionBy("file").orderBy("block")
    base = F.coalesce(F.sum("ends").over(running.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")
    numbered = blocks.select("*", base, (F.max("block").over(Window.partitionBy("file")) == F.col("block")).alias("final"))
    piece = lambda ordinal, tokens, doc, closed: F.struct(ordinal.cast("long").alias("ordinal"), tokens.cast("long").alias("tokens"), doc.cast("long").alias("doc_id"), closed.alias("ends_here"))
    none, first = F.lit(None), F.when(F.col("block") == 0, 0).otherwise(1)
    sides = F.array(piece(F.col("base"), F.col("left"), none, F.col("ends") > 0), piece(F.col("base") + F.col("ends"), F.col("right"), none, F.lit(False)))
    inner = F.transform("inner", lambda n, i: piece(F.col("base") + 1 + i, n, none, F.lit(True)))
    heads = F.transform("head_sizes", lambda n, i: piece(F.col("base") + first + i, -n, F.get("head_ids", i), F.lit(False)))
    pieces = numbered.select("file", F.explode(F.concat(sides, inner, heads)).alias("p")).select("file", "p.*")
    docs = pieces.groupBy("file", "ordinal").agg(F.sum("tokens").alias("n_tokens"), F.max("doc_id").alias("doc_id"), F.max("ends_here").alias("closed"), F.max(F.abs("tokens")).alias("_any"))
    return docs.where("closed or _any > 0").select("file", "ordinal", "doc_id", "n_tokens", "closed")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token files, and the tokens of each counted in these files."""
    import uuid

    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, vocabulary_bytes())
    return count_tokens(spark, path).select("doc_id", "n_tokens")
