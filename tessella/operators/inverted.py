"""A stored inverted index: postings with places and block maxima, in buckets of words, and what is asked of them.

``add`` turns documents into blocks, inside the tasks that read them, and writes
one row for each word of a block: the documents that hold it, how often, where,
their lengths, and the block's greatest frequency and least length, which bound
what the block can add to a score. Rows lie in folders by segment (one for each
``add``) and by a bucket of the word's first letters, sorted by word; a question
reads the buckets of its words or beginnings of words only, and within them the
row groups that Parquet's statistics leave.

Documents that belong together (a session's messages) have one owner, ``id``
divided by ``span``. Where a later segment has an owner, its rows in earlier ones
are no longer seen; ``merge`` puts all that is seen into one segment.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.shared import discard, names_in, read_text, remove, write_text, written
from tessella.operators import query_text, words

K1, B = 1.2, 0.75
BUCKETS = 64
#: Documents of a block, and blocks that are scored first to learn which others can still matter.
BLOCK, FIRST = 1_024, 4
#: Words of documents whose rows of a bucket go to one task when they are written, and owners whose sizes do.
TASK_WORDS, TASK_OWNERS = 32_000_000, 2_000_000
#: Letters of a word that name its bucket; a beginning of fewer letters is looked for in all buckets.
LETTERS = 2
ROW = "term string, block long, m int, most_tf int, least_length int, ids array<long>, tf array<int>, lengths array<int>, places array<array<int>>"


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(term, 1, LETTERS)), F.lit(BUCKETS)).cast("int")


def _back(by: int):
    return lambda place: place - by


class _Block:
    """Documents of a task, turned to rows of words."""

    def __init__(self, number: int):
        self.number, self.codes, self.code, self.doc, self.places, self.ids, self.lengths = number, {}, [], [], [], [], []

    def add(self, doc: int, fields: list[list[str]]) -> None:
        own: dict[str, list[int]] = {}
        at = 0
        for field in fields:
            for word in field:
                own.setdefault(word, []).append(at)
                at += 1
            at += 1  # a phrase does not go on from one column to the next
        self.code += [self.codes.setdefault(w, len(self.codes)) for w in own]
        self.doc += [len(self.ids)] * len(own)
        self.places += own.values()
        self.ids.append(doc)
        self.lengths.append(sum(map(len, fields)))

    def rows(self) -> pa.RecordBatch:
        order = np.argsort(np.array(self.code, dtype=np.int64), kind="stable")
        held, ids, lengths = np.array(self.doc, dtype=np.int64)[order], np.array(self.ids, dtype=np.int64), np.array(self.lengths, dtype=np.int32)
        places = [self.places[i] for i in order.tolist()]
        tf = np.array(list(map(len, places)), dtype=np.int32)
        m = np.bincount(self.code, minlength=len(self.codes))
        starts = np.concatenate([[0], np.cumsum(m)]).astype(np.int32)
        lists = lambda flat: pa.ListArray.from_arrays(pa.array(starts), flat)
        at = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(tf)]).astype(np.int32)), pa.array(np.concatenate(places).astype(np.int32)))
        bounds = [np.maximum.reduceat(tf, starts[:-1]), np.minimum.reduceat(lengths[held], starts[:-1])]
        columns = [pa.array(list(self.codes)), pa.array(np.full(len(m), self.number, dtype=np.int64)), pa.array(m.astype(np.int32)), *map(pa.array, bounds), lists(pa.array(ids[held])), lists(pa.array(tf)), lists(pa.array(lengths[held])), lists(at)]
        return pa.RecordBatch.from_arrays(columns, names=["term", "block", "m", "most_tf", "least_length", "ids", "tf", "lengths", "places"])


def blocks(docs: DataFrame, columns: tuple[str, ...], stems: bool) -> DataFrame:
    """Rows of words of ``docs`` (id and text columns); documents without words have none."""
    kind = ROW

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = _Block(TaskContext.get().partitionId() << 32)
        for batch in batches:
            texts = [batch.column(c).to_pylist() for c in columns]
            for doc, *fields in zip(batch.column("id").to_pylist(), *texts):
                cut_up = [words.split(f, stems) for f in fields if f]
                if any(cut_up):
                    block.add(doc, cut_up)
                if len(block.ids) >= BLOCK:
                    yield block.rows()
                    block = _Block(block.number + 1)
        if block.ids:
            yield block.rows()

    return docs.select("id", *(F.col(c).cast("string").alias(c) for c in columns)).mapInArrow(cut, kind)


class Inverted:
    """An index at ``path``; ``stems``: of words' stems; ``span``: ids of an owner."""

    def __init__(self, spark: SparkSession, path: str, columns: tuple[str, ...] = ("content", "role", "tool_name"), stems: bool = True, span: int | None = None, segments: list[int] | None = None):
        self.spark, self.path, self.columns, self.stems, self.span, self.given = spark, path.rstrip("/"), columns, stems, span, segments
        self._known: tuple = (None, None)
        self._frames: dict[tuple, DataFrame] = {}

    # What is stored.

    def segments(self) -> list[int]:
        """The segments that count: those given, or those of the last ``add``."""
        if self.given is not None:
            return self.given
        found = read_text(self.spark, f"{self.path}/segments.json")
        return json.loads(found)["segments"] if found else []

    def _owner(self) -> Column:
        return F.floor(F.col("id") / self.span).cast("long") if self.span else F.lit(0).cast("long")

    def _write(self, number: int, rows: DataFrame, sizes: DataFrame) -> None:
        owners, n_words = sizes.agg(F.count("*"), F.coalesce(F.sum("words"), F.lit(0))).first()
        parts = 1 + n_words // TASK_WORDS
        found = rows.withColumn("bucket", bucket_of(F.col("term")))
        # Every bucket is dealt by blocks, so a task's rows do not grow with the documents, and a frequent word's are many tasks'.
        dealt = found.repartition("bucket") if parts == 1 else found.repartitionById(BUCKETS * parts, (F.col("bucket") * parts + F.pmod(F.xxhash64("block"), F.lit(parts))).cast("int"))
        dealt.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/segment={number}")
        sizes.coalesce(1 + owners // TASK_OWNERS).write.mode("overwrite").parquet(f"{self.path}/sizes/segment={number}")

    def add(self, docs: DataFrame) -> None:
        """Indexes ``docs``; owners that are indexed already are replaced. What is asked meanwhile sees the index as it was: the list of segments is written last."""
        held = self.segments()
        number = self.write(docs)
        write_text(self.spark, f"{self.path}/segments.json", json.dumps({"segments": [*held, number] if self.span else [number]}))

    def write(self, docs: DataFrame) -> int:
        """Writes ``docs`` as a segment that does not count yet, and returns its number."""
        number = 1 + max((int(n.removeprefix("segment=")) for n in names_in(self.spark, f"{self.path}/sizes") if n.startswith("segment=")), default=0)
        found = docs.select("id", *(F.size(words.tokens(c)).alias(c) for c in self.columns))
        length = reduce(lambda a, b: a + b, (F.col(c) for c in self.columns))
        sizes = written(found.select(self._owner().alias("owner"), length.cast("long").alias("n")).groupBy("owner").agg(F.count("*").alias("n_docs"), F.sum("n").alias("words")), "sizes")
        self._write(number, blocks(docs, self.columns, self.stems), sizes)
        discard(sizes)
        return number

    def merge(self, most: int = 8) -> bool:
        """``merged`` of the index's own list of segments; the old ones are deleted at the next merge."""
        held = self.segments()
        now = self.merged(held, most)
        if now == held:
            return False
        write_text(self.spark, f"{self.path}/segments.json", json.dumps({"segments": now}))
        for old in range(1, min(held)):
            for part in ("postings", "sizes"):
                remove(self.spark, f"{self.path}/{part}/segment={old}")
        return True

    def merged(self, segments: list[int], most: int) -> list[int]:
        """``segments``, or where there are more than ``most``, the number of one that is written with what is seen of them."""
        if len(segments) <= most:
            return segments
        return [Inverted(self.spark, self.path, self.columns, self.stems, self.span, segments)._merge()]

    def _merge(self) -> int:
        number = max(self.segments()) + 1
        rows = self._seen(self._rows(F.lit(True)))
        block = F.struct("term", "segment", "block")
        one = rows.groupBy(block.alias("b")).agg(F.count("*").cast("int").alias("m"), F.max("tf").alias("most_tf"), F.min("length").alias("least_length"), F.array_sort(F.collect_list(F.struct("id", "tf", "length", "places"))).alias("p"))
        flat = one.select("b.term", F.xxhash64("b.segment", "b.block").alias("block"), "m", "most_tf", "least_length", *(F.col(f"p.{c}").alias(n) for c, n in (("id", "ids"), ("tf", "tf"), ("length", "lengths"), ("places", "places"))))
        sizes = written(self._live_sizes().select("owner", "n_docs", "words"), "sizes")
        self._write(number, flat, sizes)
        discard(sizes)
        return number

    def _read(self, part: str) -> DataFrame:
        held = self.segments()
        if not held:
            kind = f"{ROW}, segment int, bucket int" if part == "postings" else "owner long, n_docs long, words long, segment int"
            return self.spark.createDataFrame([], kind)
        # The files of a list of segments never change: they are listed once.
        if (part, tuple(held)) not in self._frames:
            self._frames = {k: v for k, v in self._frames.items() if k[1] == tuple(held)} | {(part, tuple(held)): self._opened(part, held)}
        return self._frames[part, tuple(held)]

    def _opened(self, part: str, held: list[int]) -> DataFrame:
        try:
            return self.spark.read.option("basePath", f"{self.path}/{part}").parquet(*(f"{self.path}/{part}/segment={s}" for s in held))
        except AnalysisException as e:  # segments without a word
            if part == "sizes" or "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return self.spark.createDataFrame([], f"{ROW}, segment int, bucket int")

    def _live_sizes(self) -> DataFrame:
        return self._read("sizes").groupBy("owner").agg(F.max_by(F.struct("segment", "n_docs", "words"), "segment").alias("s")).select("owner", "s.*")

    def size(self) -> DataFrame:
        """One row: n_docs, and mean, the words of a document."""
        return self._live_sizes().agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), (F.sum("words") / F.sum("n_docs")).alias("mean"))

    # What is read for a question.

    def _rows(self, test: Column, *more: str) -> DataFrame:
        """Postings, one row for each word and document, of rows that pass ``test``; with the columns ``more`` of their rows."""
        rows = self._read("postings").where(test)
        zipped = F.explode(F.arrays_zip("ids", "tf", "lengths", "places")).alias("p")
        return rows.select("term", "segment", "block", *more, zipped).select("term", "segment", "block", *more, F.col("p.ids").alias("id"), F.col("p.tf").alias("tf"), F.col("p.lengths").alias("length"), F.col("p.places").alias("places"))

    def _seen(self, rows: DataFrame) -> DataFrame:
        """Without what later segments replace."""
        if len(self.segments()) < 2:
            return rows
        live = self._live_sizes().select("owner", "segment")
        return rows.withColumn("owner", self._owner()).join(live, ["owner", "segment"], "left_semi").drop("owner")

    def _of(self, *terms: str) -> Column:
        """Rows of words: their buckets, then the words."""
        first = self.spark.range(1).select(*(bucket_of(F.lit(t)).alias(f"b{i}") for i, t in enumerate(terms))).first()
        return F.col("bucket").isin(*set(first)) & F.col("term").isin(*terms)

    def _from(self, beginning: str) -> Column:
        """Rows of words with a beginning, a range of words in one bucket (or in all, of a short one)."""
        test = (F.col("term") >= beginning) & (F.col("term") < beginning + chr(0x10FFFF))
        return test if len(beginning) < LETTERS else test & (F.col("bucket") == self.spark.range(1).select(bucket_of(F.lit(beginning))).first()[0])

    def _of_corpus(self) -> tuple[int, float]:
        """n_docs and mean, asked for once a list of segments."""
        key = tuple(self.segments())
        if self._known[0] != key:
            self._known = key, self.size().first()
        return self._known[1]["n_docs"], self._known[1]["mean"] or 1.0

    def _gain(self, tf: str, length: str) -> Column:
        mean = F.lit(self._of_corpus()[1])
        return F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * F.col(length) / mean))

    def _idf(self, n: Column) -> Column:
        n_docs = F.lit(self._of_corpus()[0])
        return F.greatest(F.log((n_docs - n + 0.5) / (n + 0.5)), F.lit(1e-6))

    def _n_of(self, terms: list[str]) -> dict[str, int]:
        """In how many documents each of some words is: from the rows' counts, or where later segments replace others, by documents."""
        test = self._of(*terms)
        one = self._read("postings").where(test).groupBy("term").agg(F.sum("m").alias("n"))
        if len(self.segments()) > 1:
            one = self._seen(self._rows(test).select("term", "segment", "id")).groupBy("term").agg(F.count("*").alias("n"))
        return {r["term"]: r["n"] for r in one.collect()}

    def _weight(self, n: dict[str, int]) -> Column:
        """A term's weight, of words whose documents are counted."""
        return self._idf(F.element_at(F.create_map(*(F.lit(x) for pair in n.items() for x in pair)), F.col("term")))

    def counts(self) -> DataFrame:
        """term, n_docs, n of every word."""
        rows = self._seen(self._rows(F.lit(True)).drop("places"))
        return rows.groupBy("term").agg(F.count("*").alias("n_docs"), F.sum("tf").alias("n"))

    def scored(self, terms: list[str]) -> DataFrame:
        """term, id, score of each document that has a term; lower is better, as in the usual full-text index."""
        wanted = list(dict.fromkeys(words.term_of(t, self.stems) for t in terms))
        if not (n := self._n_of(wanted)):
            return self.spark.createDataFrame([], "term string, id long, score double")
        hits = self._seen(self._rows(self._of(*n)).drop("places"))
        return hits.select("term", "id", (-self._weight(n) * self._gain("tf", "length")).alias("score"))

    def best(self, terms: list[str], limit: int = 20) -> DataFrame:
        """id, score of the best documents that have all terms.

        Blocks that hold all terms are ordered by the most that they can score;
        the first few are opened, and of the others only those that can reach the
        last of what they gave.
        """
        wanted = list(dict.fromkeys(words.term_of(t, self.stems) for t in terms))
        n = self._n_of(wanted)
        if len(n) < len(wanted):
            return self.spark.createDataFrame([], "id long, score double")
        test, index = self._of(*wanted), self._read("postings")
        bounds = index.where(test).select("segment", "block", (self._weight(n) * self._gain("most_tf", "least_length")).alias("most"))
        able = bounds.groupBy("segment", "block").agg(F.sum("most").alias("most"), F.count("*").alias("found")).where(F.col("found") == len(wanted)).drop("found")

        def scores(of: DataFrame) -> DataFrame:
            opened = index.where(test).join(of.select("segment", "block"), ["segment", "block"], "left_semi")
            one = opened.select("term", "segment", F.explode(F.arrays_zip("ids", "tf", "lengths")).alias("p")).select("term", "segment", F.col("p.ids").alias("id"), F.col("p.tf").alias("tf"), F.col("p.lengths").alias("length"))
            part = self._seen(one).select("id", (-self._weight(n) * self._gain("tf", "length")).alias("score"))
            return part.groupBy("id").agg(F.sum("score").alias("score"), F.count("*").alias("found")).where(F.col("found") == len(wanted)).select("id", F.round("score", 6).alias("score"))

        sooner = able.orderBy(F.desc("most"), "segment", "block").limit(FIRST)
        last = scores(sooner).orderBy("score").limit(limit).agg(F.count("*").alias("n"), F.max("score").alias("score")).first()
        # Scores are negative and rounded; a block's bound may miss them by the rounding.
        rest = able.where(F.col("most") >= -last["score"] - 1e-5) if last["n"] >= limit else able
        return scores(rest).orderBy("score", "id").limit(limit)

    def matching(self, question: str) -> DataFrame:
        """id, score of documents that match words, "phrases", beginnings*, AND, OR, NOT and brackets; lower is better.

        Each phrase counts by how often and in how many documents it comes, as in
        the usual full-text index.
        """
        tree = query_text.parsed(question, self.stems)
        phrases = query_text.phrases(tree)
        slots = [(i, j, word, starts and j == len(found) - 1) for i, (_, found, starts) in enumerate(phrases) for j, word in enumerate(found)]
        if not slots:
            return self.spark.createDataFrame([], "id long, score double")
        tests = [(self._from if begins else self._of)(word) for *_, word, begins in slots]
        rows = self._seen(self._rows(reduce(lambda a, b: a | b, tests)))
        here = [F.col("term").startswith(word) if begins else F.col("term") == word for *_, word, begins in slots]
        held = rows.groupBy("id").agg(F.first("length").alias("length"), *(F.flatten(F.collect_list(F.when(test, F.col("places")))).alias(f"s{k}") for k, test in enumerate(here)))
        number = {(i, j): k for k, (i, j, *_) in enumerate(slots)}

        def often(i: int, size: int) -> Column:
            shifted = [F.transform(F.col(f"s{number[i, j]}"), _back(j)) for j in range(size)]
            return F.size(reduce(F.array_intersect, shifted) if size > 1 else shifted[0])

        times = held.select("id", "length", *(often(i, len(found)).alias(f"t{i}") for i, (_, found, _) in enumerate(phrases) if found))
        filled = [i for i, (_, found, _) in enumerate(phrases) if found]
        n = times.agg(*(F.count(F.when(F.col(f"t{i}") > 0, 1)).alias(f"n{i}") for i in filled))
        known = times.crossJoin(F.broadcast(n))
        score = reduce(lambda a, b: a + b, (-self._idf(F.col(f"n{i}")) * self._gain(f"t{i}", "length") for i in filled))
        test = query_text.test(tree, {id(p): F.col(f"t{i}") > 0 for i, p in enumerate(phrases) if p[1]})
        return known.where(test).select("id", F.round(score, 6).alias("score"))

    def by_keywords(self, keywords: list[str], limit: int = 10, per_keyword: int | None = None, recency: DataFrame | None = None, among: DataFrame | None = None) -> DataFrame:
        """id, hits, best_rank: documents by how many keywords find them among their best hits, then by ``recency`` (id, at: latest first) where given, else by rank; of the ids in ``among``, if given."""
        rank = F.row_number().over(Window.partitionBy("term").orderBy("score", "id"))
        scored = self.scored(keywords)
        scored = scored if among is None else scored.join(among.select("id"), "id", "left_semi")
        found = scored.withColumn("rank", rank).where(F.col("rank") <= (per_keyword or 3 * limit))
        merged = found.groupBy("id").agg(F.count("*").alias("hits"), F.min("rank").alias("best_rank"))
        if recency is None:
            return merged.orderBy(F.desc("hits"), "best_rank", "id").limit(limit)
        met = merged.join(recency.select("id", "at"), "id", "left")  # keywords times hits rows at most
        return met.orderBy(F.desc("hits"), F.col("at").desc_nulls_last(), F.desc("id")).limit(limit).drop("at")
