"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range
(``1 / FRACTION``), whatever the text's length. So the union of sketches is the
sketch of the joined documents, sketches of very unequal documents compare
fairly, and the share of one's hashes that another has estimates containment.
What a sketch says rests on about ``n / FRACTION`` hashes of a text of n
shingles: the error of a likeness is near ``sqrt(FRACTION * s * (1 - s) / n)``.
A sketch also names its whole text by a hash; where two sketches hold no hash at
all, that decides whether they are alike.

Built of DataFrame functions only. The next document in ascending doc_id is
found on narrow rows, range-partitioned and numbered partition by partition;
texts are shuffled once, and of the next document only the part that is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.shared import discard, written

FRACTION, WORDS = 4, 3
#: Hashes are signed: the lowest 1/FRACTION of the range ends here.
LIMIT = -(2**63) + 2**64 // FRACTION
#: Stands for a null doc_id in joins; it sorts first.
NO_ID = -(2**63)
#: Rows of a range that are numbered in one task.
RANGE_ROWS = 200_000


def with_sketch(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with column ``name``: struct(whole: names the text's words, hashes: sorted).

    Shingles are runs of ``WORDS`` words (all words of a shorter text). Null,
    empty and blank texts have whole 0 and no hashes.
    """
    w, h, s = (f"_{name}_{x}" for x in "whs")
    df = df.withColumn(w, F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "[ \\t-\\r]+"), lambda x: x != ""))
    df = df.withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
    many = F.transform(F.sequence(F.lit(1), F.size(h) - (WORDS - 1)), lambda i: F.xxhash64(*(F.get(h, i - 1 + k) for k in range(WORDS))))
    few = F.when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(s, F.when(F.size(h) >= WORDS, many).otherwise(few))
    hashes = F.array_sort(F.array_distinct(F.filter(s, lambda x: x < LIMIT)))
    whole = F.when(F.size(h) > 0, F.xxhash64(h)).otherwise(F.lit(0).cast("long"))
    return df.withColumn(name, F.struct(whole.alias("whole"), hashes.alias("hashes"))).drop(w, h, s)


def printed(sketch: str) -> Column:
    """A sketch as text: what names its text, a colon and its hashes, 16 hex digits each."""
    return F.concat(F.lpad(F.lower(F.hex(f"{sketch}.whole")), 16, "0"), F.lit(":"), F.array_join(F.transform(f"{sketch}.hashes", lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), ""))


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of two sketched documents; where neither holds a hash, 1 for the same words, else 0."""
    common = F.size(F.array_intersect(f"{a}.hashes", f"{b}.hashes"))
    union = F.size(f"{a}.hashes") + F.size(f"{b}.hashes") - common
    return F.when(union > 0, common / union).when(F.col(f"{a}.whole") == F.col(f"{b}.whole"), 1.0).otherwise(0.0)


def containment(a: str, b: str) -> Column:
    """Estimated share of a's shingles that b has; 1 where a's sketch holds none."""
    size = F.size(f"{a}.hashes")
    return F.when(size == 0, 1.0).otherwise(F.size(F.array_intersect(f"{a}.hashes", f"{b}.hashes")) / size)


def merged(a: str, b: str) -> Column:
    """The sketch of both documents together; its name is of the two."""
    return F.struct(F.xxhash64(f"{a}.whole", f"{b}.whole").alias("whole"), F.array_sort(F.array_union(f"{a}.hashes", f"{b}.hashes")).alias("hashes"))


def previous(rows: DataFrame) -> DataFrame:
    """Distinct (doc_id, row_hash, n_chars) with those of the row before in ascending order; the first row's is the last row."""
    once = written(rows.dropDuplicates(["doc_id", "row_hash"]), "keys")
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), once.count() // RANGE_ROWS)
    ranged = written(once.repartitionByRange(parts, "doc_id", "row_hash").withColumn("part", F.spark_partition_id()), "ranges")
    row = F.struct("doc_id", "row_hash", "n_chars")
    ends = ranged.groupBy("part").agg(F.max(row).alias("end"))  # a row for each partition
    every = Window.orderBy("part")
    ends = ends.select("part", F.coalesce(F.lag("end").over(every), F.last("end").over(every.rowsBetween(0, Window.unboundedFollowing))).alias("end"))
    before = F.lag(row).over(Window.partitionBy("part").orderBy("doc_id", "row_hash"))
    out = written(ranged.withColumn("before", before).join(F.broadcast(ends), "part").select("doc_id", "row_hash", F.coalesce("before", "end").alias("before")), "order")
    discard(once, ranged)
    return out


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, n_chars, edited, next, next_id, next_chars): the text whose last quarter the next document's beginning replaces, and the next's sketch, id and length.

    Documents are in ascending doc_id (nulls first, ties by a hash of the text;
    rows that share both are one document, each with its own equal result); the
    last one is followed by the first, a single one by itself. Null texts are
    empty, very long ones are read whole, an empty table gives no rows, other
    columns are ignored.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = base.withColumns({"row_hash": F.xxhash64("text"), "n_chars": F.length("text").cast("long"), "doc_key": F.coalesce("doc_id", F.lit(NO_ID))})
    order = previous(base.select(F.col("doc_key").alias("doc_id"), "row_hash", "n_chars")).withColumnsRenamed({"doc_id": "doc_key"})
    # Both joins read the same columns of the same rows, so that texts are shuffled once for the two.
    heads = base.join(order, ["doc_key", "row_hash"]).select(
        F.col("before.doc_id").alias("doc_key"), F.col("before.row_hash").alias("row_hash"), "text", F.floor(F.col("before.n_chars") / 4).cast("int").alias("n"), F.col("doc_id").alias("next_id"), F.col("n_chars").alias("next_chars"))
    heads = with_sketch(heads, "text", "next").select("doc_key", "row_hash", "next", F.expr("substring(text, 1, n)").alias("head"), "next_id", "next_chars")
    heads = heads.groupBy("doc_key", "row_hash").agg(*(F.first(c).alias(c) for c in ("next", "head", "next_id", "next_chars")))
    met = base.join(heads, ["doc_key", "row_hash"])
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 4) as int))"), "head")
    return met.select("doc_id", "text", "n_chars", edited.alias("edited"), "next", "next_id", "next_chars")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    met = with_sketch(with_sketch(met, "text", "own"), "edited", "changed")
    sha = F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256")
    likes = (likeness("own", "changed").alias("near_edited"), likeness("own", "next").alias("near_next"))
    return met.select("doc_id", "n_chars", sha, printed("own").alias("fingerprint"), printed("changed").alias("edited_fingerprint"), *likes, "next_id", "next_chars")
