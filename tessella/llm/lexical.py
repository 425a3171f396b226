"""Ranked lexical search: postings as a term-bucketed table, joined with the items' terms, scored in whole numbers.

A task turns its documents into blocks and gives one row for each term of a
block, with the numbers, occurrences and lengths of the documents that hold it;
rows are dealt into buckets by the term, and a term that is dense in its block by
the block too, so no bucket fills up with a common word. Within a bucket rows are
sorted by term.

Items' terms join the postings in two steps, with the same result as one. Every
term can add at most its weight times SATURATED to a score. The postings of each
item's rarest terms give scores of which the k-th is a lower limit; an item's
most common terms, as long as together they stay below a part of that limit,
cannot lift a document into the first k on their own. So only the other terms'
postings are opened and summed by item and document, documents that could not
reach the limit with all common terms leave, and the common terms are looked up
for those that stay.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.shared import discard, written
from tessella.llm.decontaminate import words_of

#: Postings of a block, about.
BLOCK = 1_500_000
#: Whole numbers of the score: a term's contribution is below its weight times SATURATED.
SATURATED = 1_000_000
#: Postings of an item's rarest terms that are scored for the limit, and the part of it that common terms may reach.
SEED, COMMON_PART = 2_000, 0.6
#: Rows of items' terms up to which they are broadcast (under 100 bytes each).
FEW_TERMS = 200_000
ROW = "term string, block long, m int, docs array<int>, tf array<int>, n array<int>, ids array<long>"
KINDS = [pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]


class Block:
    """Documents of a task, turned to rows of terms."""

    def __init__(self, number: int):
        self.number, self.codes, self.code, self.tf, self.sizes, self.n, self.ids = number, {}, [], [], [], [], []

    def add(self, doc: int | None, words: list[bytes]) -> None:
        counts, codes = Counter(words), self.codes
        self.code += [codes.setdefault(w, len(codes)) for w in counts]
        self.tf += counts.values()
        self.sizes.append(len(counts))
        self.n.append(len(words))
        self.ids.append(doc)

    def rows(self) -> pa.RecordBatch:
        """A row for each term, and one of the null term with all documents' ids and lengths."""
        code, n = np.array(self.code, dtype=np.int64), np.array(self.n, dtype=np.int32)
        order = np.argsort(code, kind="stable")
        docs = np.repeat(np.arange(len(n), dtype=np.int32), self.sizes)[order]
        m, own = np.bincount(code), np.arange(len(n), dtype=np.int32)
        ends = np.concatenate([[0], np.cumsum(m), [len(code) + len(n)]]).astype(np.int32)
        lists = lambda flat, rest: pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([flat, rest]).astype(np.int32)))
        none = np.zeros(len(m) + 2, dtype=np.int32)
        none[-1] = len(n)
        terms = pa.concat_arrays([pa.array(list(self.codes), pa.binary()).cast(pa.string()), pa.array([None], pa.string())])
        columns = [terms, pa.array([self.number] * len(terms), pa.int64()), pa.array(np.append(m, len(n)).astype(np.int32)), lists(docs, own), lists(np.array(self.tf, dtype=np.int32)[order], own), lists(n[docs], n), pa.ListArray.from_arrays(pa.array(none), pa.array(self.ids, pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=ROW.replace(",", "").split()[::2])


def postings(docs: DataFrame) -> DataFrame:
    """The index of all ``docs``, a written table: term, block, m (documents), docs (their numbers in the block), tf, n (lengths), ids, bucket."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        block = Block(number)
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                if words := words_of((text.as_py() or "").encode()):
                    block.add(doc, words)
                    if len(block.code) >= BLOCK:
                        yield block.rows()
                        block = Block(block.number + 1)
        if block.n:
            yield block.rows()

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bucket = F.xxhash64("term", F.pmod(F.xxhash64("block"), F.col("m")))
    dealt = base.mapInArrow(blocks, ROW).withColumn("bucket", bucket)
    return written(dealt.repartition("bucket").sortWithinPartitions("term"), "postings")


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term, times of the items that have an id and terms."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item_id"), batch.column("text")):
                counts = Counter(words_of((text.as_py() or "").encode()))
                if counts:
                    yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(counts), item.type), pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=["item_id", "term", "times"])

    kind = items.schema["item_id"].dataType.simpleString()
    rows = items.where("item_id is not null").select("item_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(terms, f"item_id {kind}, term string, times long").groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def gain(tf: str, n: str) -> Column:
    """A term's share of SATURATED in a document; ``total`` and ``words`` are those of the corpus."""
    return F.expr(f"(1000000000L * {tf}) div (1000L * {tf} + 8L * (25 + (75L * {n} * total) div words))")


def opened(index: DataFrame, terms: DataFrame) -> DataFrame:
    """item_id, block, doc, n, part: what ``terms`` add to the score of each document that holds them."""
    met = index.select("term", "block", "docs", "tf", "n").join(terms, "term")
    one = met.select("item_id", "block", "worth", "total", "words", F.explode(F.arrays_zip("docs", "tf", "n")).alias("p"))
    return one.select("item_id", "block", F.col("p.docs").alias("doc"), F.col("p.n").alias("n"), (F.col("worth") * gain("p.tf", "p.n")).alias("part"))


def best_of(scores: DataFrame, k: int) -> DataFrame:
    """item_id, found, score: how many of each item's first ``k`` there are, and the last one's score; tasks keep k rows of an item before they meet."""
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score")))
    return scores.withColumn("place", place).where(F.col("place") <= k).groupBy("item_id").agg(F.count("*").alias("found"), F.min("score").alias("score"))


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``k`` highest-scoring documents, equal scores by ascending doc_id.

    Documents without terms (null, empty, signs alone) are no part of the
    corpus; each row is a document, so repeated rows have ranks of their own;
    null doc_ids come last among equal scores. Items without an id or terms have
    no rows; an item id that comes twice is one item with the terms of both
    rows. Texts are read whole; other columns are ignored; an empty table of
    either kind gives no rows.
    """
    index = postings(docs)
    asked = written(item_terms(items), "asked")
    few = asked.count() <= FEW_TERMS
    sent = lambda table: F.broadcast(table) if few else table
    total = index.where("term is null").select("m", F.expr("aggregate(n, 0L, (a, x) -> a + x)").alias("w")).agg(F.sum("m").alias("total"), F.sum("w").alias("words"))
    counts = index.where("term is not null").select("term", "m").join(sent(asked.select("term").distinct()), "term").groupBy("term").agg(F.sum("m").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * F.col("total") + 2.0) / (2.0 * F.col("df") + 1.0)))
    worth = asked.join(counts, "term").crossJoin(F.broadcast(total)).withColumn("worth", weight * F.col("times")).where("worth > 0")
    rarest, common = Window.partitionBy("item_id").orderBy("df", "term"), Window.partitionBy("item_id").orderBy("worth", F.desc("df"), "term")
    terms = worth.withColumn("sooner", F.sum("df").over(rarest) - F.col("df")).withColumn("most", SATURATED * F.sum("worth").over(common))
    terms = written(terms, "terms")

    first = opened(index, sent(terms.where(F.col("sooner") < SEED))).groupBy("item_id", "block", "doc").agg(F.sum("part").alias("score"))
    limits = best_of(first, k).where(F.col("found") >= k).select("item_id", F.col("score").alias("limit"))
    split = terms.join(limits, "item_id", "left").withColumn("limit", F.coalesce("limit", F.lit(0))).withColumn("late", F.col("most") < F.col("limit") * COMMON_PART)
    split = written(split, "split")
    rest = split.groupBy("item_id").agg(F.first("limit").alias("limit"), F.coalesce(F.max(F.when(F.col("late"), F.col("most"))), F.lit(0)).alias("most"))
    sums = opened(index, sent(split.where("not late"))).groupBy("item_id", "block", "doc").agg(F.first("n").alias("n"), F.sum("part").alias("score"))
    able = written(sums.join(sent(rest), "item_id").where(F.col("score") + F.col("most") >= F.col("limit")).drop("limit", "most"), "able")
    # The common terms of those that stay, in the rows of their blocks.
    wanted = able.join(sent(split.where("late").select("item_id", "term", "worth", "total", "words")), "item_id")
    held = index.select("term", "block", "docs", "tf").join(sent(split.where("late").select("term").distinct()), "term")
    found = wanted.join(held, ["term", "block"]).withColumn("tf", F.get("tf", (F.array_position("docs", F.col("doc")) - 1).cast("int"))).where("tf is not null")
    late = found.select("item_id", "block", "doc", (F.col("worth") * gain("tf", "n")).alias("score"))
    whole = able.select("item_id", "block", "doc", "score").unionByName(late).groupBy("item_id", "block", "doc").agg(F.sum("score").alias("score"))
    whole = written(whole.where("score > 0"), "scores")
    # Ids are looked up for documents that are not below the k-th score, however many have it.
    kth = best_of(whole, k).select("item_id", F.when(F.col("found") >= k, F.col("score")).otherwise(F.lit(0)).alias("limit"))
    named = whole.join(sent(kth), "item_id").where("score >= limit").join(index.where("term is null").select("block", "ids"), "block").withColumn("doc_id", F.get("ids", F.col("doc")))
    last = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "block", "doc")
    out = named.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
    out = written(out, "ranked")
    discard(index, asked, terms, split, able, whole)
    return out


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY doc_id, term),
n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY doc_id),
c AS (SELECT count(*) AS total, CAST(sum(n) AS BIGINT) AS words FROM n),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
i AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term),
w AS (SELECT item_id, term, times, CAST(floor(1000 * ln((2.0::DOUBLE * total + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT) AS weight FROM i JOIN f USING (term), c),
s AS (SELECT item_id, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * total) // words)))) AS BIGINT) AS score FROM w JOIN p USING (term) JOIN n USING (doc_id), c GROUP BY item_id, doc_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
