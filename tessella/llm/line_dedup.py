"""Line dedup: repeated windows of three consecutive lines are removed where they come later.

Every three consecutive lines make a window, known by a 128-bit hash of the
lines (white space at their ends does not count). The first place of a window is
the least (doc_id, text hash, line) over all documents; each later place covers
its three lines, the covered lines of overlapping places are merged, and a
document keeps the lines that none covers. A removed line always has an equal
line at an earlier place, and the earliest of these stays.

Built of DataFrame functions only. Places are combined before they are shuffled
(a minimum and a maximum per window), so a passage that millions of documents
share is a small aggregate; the join that finds its later places reads a written
table, which leaves both sides open to adaptive skew splitting. Documents are
shuffled once, to meet their covered lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.shared import written

BLANKS = " \t\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def windows(docs: DataFrame) -> DataFrame:
    """Places of all windows that are not blank: wa, wb (hash), doc_id, row_hash, line (from 0)."""
    trimmed = F.transform(_lines(F.col("text")), lambda x: F.btrim(x, F.lit(BLANKS)))
    hashed = docs.select("doc_id", "row_hash", F.transform(trimmed, lambda x: F.xxhash64(x)).alias("a"), F.transform(trimmed, lambda x: F.xxhash64(F.lit(1), x)).alias("b"))
    blank = hashed.sparkSession.range(1).select(F.xxhash64(F.lit("")).alias("h")).first()["h"]
    three = F.transform(
        F.when(F.size("a") >= 3, F.sequence(F.lit(1), F.size("a") - 2)),
        lambda i: F.when(
            (F.get("a", i - 1) != blank) | (F.get("a", i) != blank) | (F.get("a", i + 1) != blank),
            F.struct(F.xxhash64(F.get("a", i - 1), F.get("a", i), F.get("a", i + 1)).alias("wa"), F.xxhash64(F.get("b", i - 1), F.get("b", i), F.get("b", i + 1)).alias("wb")),
        ),
    )
    return hashed.select("doc_id", "row_hash", F.posexplode(three).alias("line", "w")).where("w is not null").select("w.wa", "w.wb", "doc_id", "row_hash", "line")


def line_dedup(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` with its text without later repeats, and n_lines and n_removed; other columns kept.

    Null texts stay null and have no lines; an empty text is one line; documents
    of under three lines have no windows and stay whole; windows of three blank
    lines are never removed. Rows that share doc_id and text count as one place
    and get the same result; null doc_ids come before all others; very long texts
    are read whole; an empty table gives no rows. Columns named row_hash, n_lines
    or n_removed are replaced.
    """
    base = docs.drop("row_hash", "n_lines", "n_removed").withColumn("row_hash", F.xxhash64("text"))
    places = windows(base.select("doc_id", "text", "row_hash"))
    place = F.struct("doc_id", "row_hash", "line")
    repeated = places.groupBy("wa", "wb").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").select("wa", "wb", "first")
    later = places.join(written(repeated, "windows"), ["wa", "wb"]).where(place > F.col("first"))
    covered = later.groupBy(F.col("doc_id").alias("c_id"), F.col("row_hash").alias("c_hash")).agg(F.collect_set("line").alias("starts"))
    met = base.join(covered, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("row_hash") == F.col("c_hash")), "left")
    at = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + 2))))
    split = met.withColumn("_lines", F.when(F.col("text").isNotNull(), _lines(F.col("text")))).withColumn("_covered", at)
    kept = split.withColumn("_kept", F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_covered")))
    text = F.when(F.col("_covered").isNull(), F.col("text")).otherwise(F.array_join(F.transform("_kept", lambda i: F.get("_lines", i)), "\n"))
    out = kept.withColumns({"text": text, "n_lines": F.coalesce(F.size("_lines"), F.lit(0)).cast("long"), "n_removed": F.coalesce(F.size("_covered"), F.lit(0)).cast("long")})
    return out.select(*(c for c in base.columns if c != "row_hash"), "n_lines", "n_removed")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_lines", "n_removed", "text")


SQL = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
p AS (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS i FROM l WHERE len(lines) >= 3),
w AS (SELECT doc_id, i, trim(lines[i], ' ' || chr(9) || chr(13)) AS a, trim(lines[i + 1], ' ' || chr(9) || chr(13)) AS b, trim(lines[i + 2], ' ' || chr(9) || chr(13)) AS c FROM p),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) AS n FROM w WHERE a || b || c != ''),
cov AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM r WHERE n > 1),
k AS (SELECT x.doc_id, x.i, x.line FROM (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM l) x LEFT JOIN cov ON cov.doc_id = x.doc_id AND cov.i = x.i WHERE cov.i IS NULL),
t AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM k GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM cov GROUP BY doc_id)
SELECT l.doc_id, CAST(coalesce(len(l.lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed,
  CASE WHEN n.n IS NULL THEN l.text ELSE coalesce(t.text, '') END AS text
FROM l LEFT JOIN t USING (doc_id) LEFT JOIN n USING (doc_id)
"""
