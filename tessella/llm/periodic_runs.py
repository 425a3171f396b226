"""Periodic run detection: stretches of words that repeat with a period three times or more, by a harmonic grid.

For each period p the places p, 2p, 3p, ... are a grid; a run of period p is at
least three periods long, so it matches itself p words later over two periods,
and therefore at two grid places that follow each other. Each such pair of
places is extended forward and backward by longest common extensions, which are
range minima over the common prefixes of a suffix array, of the words and of the
words reversed. Over all periods there are n/1 + n/2 + n/3 + ... pairs, so a
text of n words takes about n log n steps, however long or repetitive it is.
Runs of a multiple of their smallest period cover the same stretch as with that
period, of which the least stays.

A document is read whole in one task; suffix arrays are only built where two
grid places match, and take about 300 bytes a word while they are used.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: A run has this many words and this many periods at least.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Grid places looked at at once, and bytes of text that a batch of results holds.
GRID, BATCH_BYTES = 1 << 20, 1 << 23
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


class Extensions:
    """Longest common extensions of pairs of places, by a suffix array and range minima over its common prefixes."""

    def __init__(self, ids: np.ndarray):
        n = self.n = len(ids)
        ranks, step = [np.unique(ids, return_inverse=True)[1].astype(np.int32)], 1
        while ranks[-1].max(initial=0) < n - 1:
            after = np.zeros(n, dtype=np.int64)
            after[: n - step] = ranks[-1][step:].astype(np.int64) + 1
            key = ranks[-1].astype(np.int64) * (n + 1) + after
            order = np.argsort(key, kind="stable")
            new = np.empty(n, dtype=np.int32)
            new[order] = np.cumsum(np.diff(key[order], prepend=key[order[0]]) != 0)
            ranks.append(new)
            step *= 2
        self.rank = ranks[-1]
        suffixes = np.empty(n, dtype=np.int64)
        suffixes[self.rank] = np.arange(n)
        # Neighbours' common prefixes, longest doubled length first; places of equal rank hold that many words.
        common = np.zeros(n, dtype=np.int64)
        a, b = suffixes[:-1].copy(), suffixes[1:].copy()
        for k in range(len(ranks) - 1, -1, -1):
            inside = np.flatnonzero(np.maximum(a, b) < n)
            same = inside[ranks[k][a[inside]] == ranks[k][b[inside]]]
            a[same] += 1 << k
            b[same] += 1 << k
        common[1:] = a - suffixes[:-1]
        levels = [common.astype(np.int32)]
        while 2 << len(levels) - 1 < n:
            half, last = 1 << len(levels) - 1, levels[-1]
            level = last.copy()
            level[: n - half] = np.minimum(last[: n - half], last[half:])
            levels.append(level)
        self.least = np.stack(levels)

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from the different places a and b on are the same; 0 at the end of the text."""
        out = np.zeros(len(a), dtype=np.int64)
        at = np.flatnonzero(np.maximum(a, b) < self.n)
        low, high = self.rank[a[at]].astype(np.int64), self.rank[b[at]].astype(np.int64)
        low, high = np.minimum(low, high) + 1, np.maximum(low, high)
        k = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out[at] = np.minimum(self.least[k, low], self.least[k, high - (1 << k) + 1])
        return out


def grid(ids: np.ndarray, periods: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places x and periods p where the words at x, x + p and x + 2p are the same and x is a multiple of p."""
    n = len(ids)
    counts = (n - 1) // np.arange(1, periods + 1) - 1
    ends = np.cumsum(counts)
    low = 0
    while low < periods:
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + GRID, "right")))
        own = counts[low:high]
        p = np.repeat(np.arange(low + 1, high + 1), own)
        x = (np.arange(len(p)) - np.repeat(np.cumsum(own) - own, own)) * p
        middle = ids[x + p]
        hit = np.flatnonzero((ids[x] == middle) & (middle == ids[x + 2 * p]))
        if len(hit):
            yield x[hit], p[hit]
        low = high


def runs_of(words: list) -> list[tuple[int, int, int]]:
    """start, length and smallest period of each run, by start and period."""
    n = len(words)
    if n < LEAST_WORDS:
        return []
    known: dict = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    ahead = back = None
    found = []
    for x, p in grid(ids, n // LEAST_PERIODS):
        if ahead is None:
            ahead, back = Extensions(ids), Extensions(ids[::-1])
        start = x - back.forward(n - x, n - x - p)
        end = x + p + ahead.forward(x, x + p)
        long = end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * p)
        if long.any():
            found.append(np.unique(np.stack([start[long], end[long], p[long]], axis=1), axis=0))
    if not found:
        return []
    every = np.unique(np.concatenate(found), axis=0)  # by start, end and period: of one stretch, the least period is first
    first = np.append(True, (every[1:, :2] != every[:-1, :2]).any(axis=1))
    return sorted((s, e - s, p) for s, e, p in every[first].tolist())


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def periodic_runs(docs: DataFrame, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and the collapsed text of each row.

    Runs have 24 words and three periods at least and are as long as their
    period holds. Words are what white space of ASCII parts; null and empty texts
    have none, no runs and an empty collapsed text. ``edit`` may change a
    document's words first. Texts are read whole whatever their length; repeated
    rows each get their own, equal, result; null doc_ids stay null; an empty
    table gives no rows; other columns are ignored.
    """

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            words = WORD.findall((text.as_py() or "").encode())
            words = edit(doc, words) if edit else words
            runs = runs_of(words)
            yield doc, len(words), [dict(zip(("start", "length", "period"), r)) for r in runs], collapsed(words, runs)

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        doc, n, runs, text = zip(*held)
        columns = [pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(runs, pa.list_(RUN)), pa.array(text, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for row in rows(batch):
                held.append(row)
                size += 100 + len(row[3])
                if size > BATCH_BYTES:
                    yield batch_of(held)
                    held, size = [], 0
            if held:
                yield batch_of(held)

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(search, SCHEMA)


def planted(doc: int | None, words: list[bytes]) -> list[bytes]:
    """The query's edit: a tenth of the documents, by their id's hash, repeat their own words from some place on."""
    if doc is None or not words:
        return words
    h, n = zlib.crc32(str(doc).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def best(runs: Column) -> Column:
    """The run of the greatest exact exponent; of equal ones the first."""
    return F.reduce(runs, F.get(runs, F.lit(0)), lambda a, x: F.when(x["length"] * a["period"] > a["length"] * x["period"], x).otherwise(a))


def digest(found: DataFrame) -> DataFrame:
    """The columns that the query returns."""
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    top = found.withColumn("top", best(F.col("runs")))
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), F.col("top.length").alias("length"), F.col("top.period").alias("period"),
        F.expr("1000 * top.length div top.period").alias("exponent_milli"), F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), planted))
