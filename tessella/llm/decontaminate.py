"""Benchmark decontamination: a prefix-filtered containment join of item windows with document words.

Both sides are cut into words; an item yields one window per run of ``window``
consecutive words (an item with fewer words is one window). A document holds a
window only if it holds every one of its words, so the window's rarest word (by
document frequency over the whole corpus) is a sufficient prefix: only
occurrences of that word start a comparison. The word's place in the window
bounds where the window may begin, its length bounds where it may end, and what
is left is compared word by word.

The join has two physical forms, chosen by the benchmark's size, with one result.
A benchmark of at most ``FEW_WORDS`` words is an index that every executor gets,
and documents are read in place. A larger one stays a table: windows and the
occurrences of prefix words in documents, with the words around them, are
shuffled by the prefix word and compared where they meet. There, what is sent to
executors is a Bloom filter of fixed size, over the benchmark's words and then
over the prefix words, so that other words are not shuffled; where it fills up it
lets more words pass, never fewer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.shared import written

#: Words are runs of ASCII letters and digits and of all non-ASCII characters; A-Z are lower-cased first.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SLICE = 256
#: Words of a benchmark up to which its index is broadcast (about 1 kB each in the driver, 0.1 kB sent).
FEW_WORDS = 200_000
#: Bits of the Bloom filter (8 MB) and how many a word sets.
BLOOM_BITS, BLOOM_HASHES = 1 << 26, 3
STATE = ["doc_id", "text", "n_words", "starts", "ends", "items"]
STATE_SCHEMA = "doc_id long, text string, n_words long, starts array<int>, ends array<int>, items array<string>"


def words_of(text: bytes | None) -> list[bytes]:
    return WORD.findall(text.lower()) if text else []


def item_windows(text: bytes | None, window: int) -> list[tuple[bytes, ...]]:
    """The distinct windows of one item."""
    w = words_of(text)
    if not w:
        return []
    if len(w) < window:
        return [tuple(w)]
    return list(dict.fromkeys(zip(*(w[i:] for i in range(window)))))


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


class WindowIndex:
    """Windows of some items, by their rarest word."""

    def __init__(self, items: list[tuple[str, bytes]], frequency: dict[bytes, int], window: int):
        self.codes: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        self.items: list[str] = []
        for item, text in items:
            number = len(self.items)
            self.items.append(item)
            for win in item_windows(text, window):
                key = tuple(self.codes.setdefault(x, len(self.codes) + 1) for x in win)
                found.setdefault(key, set()).add(number)
        rank = np.zeros(len(self.codes) + 1, dtype=np.int64)
        for word, code in self.codes.items():
            rank[code] = frequency.get(word, 0)
        self.is_prefix = np.zeros(len(self.codes) + 1, dtype=bool)
        #: By prefix word: (its place in the window, the window's codes, its items).
        self.by_prefix: dict[int, list[tuple[int, np.ndarray, list[int]]]] = {}
        for key, owners in found.items():
            place = min(range(len(key)), key=lambda i: (rank[key[i]], key[i], i))
            self.is_prefix[key[place]] = True
            self.by_prefix.setdefault(key[place], []).append((place, np.array(key, dtype=np.int64), sorted(owners)))

    def hits(self, words: list[bytes]) -> tuple[list[int], list[int], list[str]]:
        """Spans (start, end) of the windows that occur and the items they belong to."""
        get = self.codes.get
        codes = np.array([get(w, 0) for w in words], dtype=np.int64)
        spans: set[tuple[int, int]] = set()
        items: set[int] = set()
        for at in np.flatnonzero(self.is_prefix[codes]).tolist() if len(codes) else ():
            for place, win, owners in self.by_prefix[int(codes[at])]:
                start, end = at - place, at - place + len(win)
                if start >= 0 and end <= len(codes) and (codes[start:end] == win).all():
                    spans.add((start, end))
                    items.update(owners)
        ordered = merged(sorted(spans))
        return [s for s, _ in ordered], [e for _, e in ordered], sorted(self.items[i] for i in items)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, those that overlap or touch joined."""
    out: list[tuple[int, int]] = []
    for s, e in spans:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def word_frequencies(docs: DataFrame, words: list[bytes]) -> dict[bytes, int]:
    """In how many documents each of the given words occurs, over all documents."""
    wanted = docs.sparkSession.sparkContext.broadcast(frozenset(words))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[bytes, int] = {}
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                for text in texts_of(batch.slice(k, SLICE), "text"):
                    for w in wanted.value.intersection(words_of(text)):
                        own[w] = own.get(w, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), pa.array(list(own.values()), pa.int64())], ["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["word"]): r["n"] for r in rows}


def scan_block(docs: DataFrame, items: list[tuple[str, bytes]], frequency: dict[bytes, int], window: int) -> DataFrame:
    """``contamination`` of a benchmark that every executor gets as an index."""
    index = docs.sparkSession.sparkContext.broadcast(WindowIndex(items, frequency, window))
    kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                out = [(len(words), *index.value.hits(words)) for words in map(words_of, texts_of(part, "text"))]
                if out:
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text").cast(pa.string()), *(pa.array(c, t) for c, t in zip(zip(*out), kinds))], names=STATE)

    return docs.mapInArrow(scan, STATE_SCHEMA)


def bloom_places(word: bytes) -> list[int]:
    h = xxhash.xxh3_128_intdigest(word)
    return [(h >> 32 * k) % BLOOM_BITS for k in range(BLOOM_HASHES)]


def bloom_of(words: DataFrame) -> np.ndarray:
    """Filter of the column ``word``: 64-bit parts, set in tasks and joined by Spark; at most BLOOM_BITS / 64 rows reach the driver."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks: dict[int, int] = {}
            for word in texts_of(batch, "word"):
                for at in bloom_places(word):
                    masks[at >> 6] = masks.get(at >> 6, 0) | 1 << (at & 63)
            yield pa.RecordBatch.from_arrays([pa.array(list(masks), pa.int64()), pa.array(np.array(list(masks.values()), dtype=np.uint64).view(np.int64))], names=["part", "mask"])

    rows = words.mapInArrow(places, "part long, mask long").groupBy("part").agg(F.bit_or("mask").alias("mask")).toPandas()
    out = np.zeros(BLOOM_BITS // 64, dtype=np.uint64)
    out[rows["part"].to_numpy(dtype=np.int64)] = rows["mask"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


class Passing:
    """Which words pass a filter; remembers the words of a task."""

    def __init__(self, bloom: np.ndarray):
        self.bloom, self.known = bloom, {}

    def __call__(self, word: bytes) -> bool:
        out = self.known.get(word)
        if out is None:
            if len(self.known) >= 500_000:
                self.known.clear()
            out = self.known[word] = all(int(self.bloom[at >> 6]) >> (at & 63) & 1 for at in bloom_places(word))
        return out


def window_table(benchmark: DataFrame, window: int) -> DataFrame:
    """window (its words, joined by spaces), items: each distinct window once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), texts_of(batch, "text")):
                wins = [b" ".join(w).decode() for w in item_windows(text, window)]
                if wins:
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(wins), pa.string()), pa.array(wins, pa.string())], names=["item", "window"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("item is not null and text is not null")
    return rows.mapInArrow(cut, "item string, window string").distinct()


def occurrences(docs: DataFrame, bloom: np.ndarray, reach: int) -> DataFrame:
    """word, doc_id, row_hash, at, off, around: each place of a word that passes the filter, with ``reach`` words on either side."""
    sent = docs.sparkSession.sparkContext.broadcast(bloom)
    fields = [("word", pa.string()), ("doc_id", pa.int64()), ("row_hash", pa.int64()), ("at", pa.int32()), ("off", pa.int32()), ("around", pa.list_(pa.string()))]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = Passing(sent.value)
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part, rows = batch.slice(k, SLICE), []
                for doc, row, text in zip(part.column("doc_id").to_pylist(), part.column("row_hash").to_pylist(), texts_of(part, "text")):
                    words = words_of(text)
                    for at in (i for i, w in enumerate(words) if passes(w)):
                        low = max(0, at - reach)
                        rows.append((words[at].decode(), doc, row, at, at - low, [w.decode() for w in words[low : at + reach + 1]]))
                        if len(rows) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])

    return docs.mapInArrow(scan, "word string, doc_id long, row_hash long, at int, off int, around array<string>")


def document_counts(docs: DataFrame, bloom: np.ndarray) -> DataFrame:
    """word, n: in how many documents each word that passes the filter occurs, over all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(bloom)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes, own = Passing(sent.value), {}
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                for text in texts_of(batch.slice(k, SLICE), "text"):
                    for w in set(filter(passes, words_of(text))):
                        own[w] = own.get(w, 0) + 1
                if len(own) > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in own]), pa.array(list(own.values()), pa.int64())], ["word", "n"])
                    own = {}
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in own], pa.string()), pa.array(list(own.values()), pa.int64())], ["word", "n"])

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def shuffled_hits(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """doc_id, row_hash, spans, items of the documents that hold a window: both sides meet by the prefix word."""
    windows = written(window_table(benchmark, window), "windows")
    words = windows.select("window").distinct().select("window", F.posexplode(F.split("window", " ")).alias("place", "word"))
    counts = document_counts(docs, bloom_of(words.select("word").distinct()))
    prefix = words.join(counts, "word", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "place")).alias("p"))
    prefixes = written(prefix.where("p.n > 0").select("p.word", "window", "p.place", F.size(F.split("window", " ")).alias("length")), "prefixes")
    found = occurrences(docs, bloom_of(prefixes.select("word").distinct()), window - 1)
    start = F.col("off") - F.col("place")
    same = F.array_join(F.slice("around", F.greatest(start, F.lit(0)) + 1, F.col("length")), " ") == F.col("window")
    met = found.join(prefixes, "word").where((start >= 0) & same)
    spans = met.select("doc_id", "row_hash", "window", (F.col("at") - F.col("place")).alias("start"), F.col("length").alias("n")).distinct()
    named = spans.join(windows, "window").groupBy("doc_id", "row_hash").agg(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end"))).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    return written(named, "contamination")


def shuffled(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """``contamination`` of a large benchmark."""
    keyed = docs.withColumn("row_hash", F.xxhash64("text"))
    hits = shuffled_hits(keyed, benchmark, window).withColumnsRenamed({"doc_id": "hit_id", "row_hash": "hit_hash"})
    met = keyed.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("row_hash") == F.col("hit_hash")), "left")
    kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part, out = batch.slice(k, SLICE), []
                for text, spans, items in zip(texts_of(part, "text"), part.column("spans").to_pylist(), part.column("items").to_pylist()):
                    ordered = merged(sorted((x["start"], x["end"]) for x in spans or ()))
                    out.append((len(words_of(text)), [a for a, _ in ordered], [b for _, b in ordered], items or []))
                if out:
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text").cast(pa.string()), *(pa.array(c, t) for c, t in zip(zip(*out), kinds))], names=STATE)

    return met.select("doc_id", "text", "spans", "items").mapInArrow(close, STATE_SCHEMA)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, few_words: int = FEW_WORDS) -> DataFrame:
    """One row per document row: doc_id, text, n_words, the merged hit spans (starts, ends) and the items found.

    Null and empty texts have no words and no hits; very long ones are read
    whole; items without an id, text or words are skipped; an item id that comes
    twice is one item with the windows of both rows; other columns of either
    table are ignored; an empty benchmark hits nothing, an empty table gives no
    rows; repeated rows each get their own, equal, result. ``few_words`` chooses
    the physical form only.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # No item has more words than half its bytes and one.
    size = benchmark.agg(F.coalesce(F.sum(F.floor(F.octet_length(F.col("text").cast("string")) / 2) + 1), F.lit(0)).alias("n")).first()["n"]
    if size > few_words:
        return shuffled(base, benchmark, window)
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").collect()
    items = [(r["item"], r["text"].encode()) for r in rows]
    vocabulary = list({w for _, text in items for w in words_of(text)})
    return scan_block(base, items, word_frequencies(base, vocabulary) if vocabulary else {}, window)


def digest(found: DataFrame) -> DataFrame:
    """The columns that the query returns."""
    hit = F.expr("aggregate(zip_with(starts, ends, (s, e) -> e - s), 0L, (a, x) -> a + x)")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item, w, least(len(w), 10) AS l FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, l, array_to_string(w[i:i + l - 1], ' ') AS win FROM (SELECT item, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM bl)),
ls AS (SELECT DISTINCT l FROM bw),
dw AS (SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS win FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, ls WHERE len(w) >= l)),
h AS (SELECT DISTINCT doc_id, dw.l, i, item FROM dw JOIN bw ON dw.win = bw.win AND dw.l = bw.l),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""
