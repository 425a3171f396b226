"""Mixing sources to target weights: hash-random keys, a range sort within each source, prefix sums and a cut at the budget.

Sources share the mix by weight; a share stops at ``epochs`` times its source's
size and what is left over goes to the others by weight, until none is above.
Each row gets a random key of its id and text. Rows are range-partitioned by
source and key, so a source that holds a third of all rows is many ranges; words
are summed up along the ranges in two steps (sums of ranges, then inside each
range), and a source's cut is the row at which its budget ends. A source whose
budget is above its size is taken whole once or more, then up to the cut.

Only keys and sizes are shuffled; texts are read in place and meet one row of
their source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.ranges import running
from tessella.functions.shared import discard, written

#: Words of a text.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, EPOCHS, SEED = (3, 1, 2), 1.5, 2, "mix"
#: Sources up to which their cuts are broadcast (under 200 bytes each).
FEW_SOURCES = 100_000


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, epochs: int) -> DataFrame:
    """source, source_size, target of ``sizes`` (source, source_size): the level up to which all shares are filled is found in the order of their limits."""
    placed = running(sizes, [F.col("source").asc_nulls_last()], {"place": F.lit(1)})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    limited = placed.withColumn("weight", weight.cast("long")).withColumn("most", F.col("source_size") * epochs).withColumn("ratio", F.col("most") / F.col("weight"))
    filled = written(running(limited, [F.col("ratio"), F.col("place")], {"full": F.col("most"), "heavy": F.col("weight")}), "levels")
    total = filled.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights"))
    # A source is below its limit if the level of those not yet full is; the first of them in this order gives the level.
    levels = filled.crossJoin(F.broadcast(total)).withColumn("left", F.lit(share) * F.col("words") - F.col("full")).withColumn("open", F.col("weights") - F.col("heavy"))
    level = levels.where(F.col("left") * F.col("weight") <= F.col("most") * F.col("open")).agg(F.min_by(F.struct("left", "open"), F.struct("ratio", "place")).alias("level"))
    share_of = F.col("level.left") * F.col("weight") / F.col("level.open")
    return filled.crossJoin(F.broadcast(level)).select("source", "source_size", F.coalesce(F.least(F.col("most").cast("double"), share_of), F.col("most").cast("double")).alias("target"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """Every row of ``docs`` with size (its words), source_size, target (of its source) and taken (its words in the mix, repeats counted).

    Sources are weighted in the order of their code points, null last, as a
    source of its own. Of each source just its target's whole words are taken
    (rounded): the row at the cut is taken in part, unless several rows have one
    id and text there, which then share what is left in equal whole parts. Null
    and empty texts have size 0 and nothing taken; null ids are ids like others;
    very long texts are counted whole; other columns are kept, those of the four
    names replaced; an empty table gives no rows. Nothing depends on how rows are
    partitioned, so reruns agree.
    """
    kept = docs.drop("size", "source_size", "target", "taken")
    text = F.col("text").cast("string")
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5(text), F.lit("")))
    base = kept.withColumn("size", F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")).withColumn("_key", F.unhex(F.md5(named)))
    rows = written(base.groupBy(F.col("source"), F.col("_key").alias("key"), "size").agg(F.count("*").alias("copies")), "keys")
    words = F.col("size") * F.col("copies")
    sources = written(targets(rows.groupBy("source").agg(F.sum(words).alias("source_size")), weights, share, epochs), "targets")
    budget = F.least(F.round("target").cast("long"), F.col("source_size") * epochs)
    rest = sources.withColumn("whole", F.when(F.col("source_size") > 0, F.expr("cast(round(target) as long) div source_size")).otherwise(F.lit(0)))
    rest = rest.withColumn("whole", F.least("whole", F.lit(epochs))).withColumn("rest", budget - F.col("whole") * F.col("source_size"))
    summed = written(running(rows, [F.col("source").asc_nulls_last(), F.col("key")], {"before": words}), "sums")
    begins = summed.groupBy("source").agg(F.min("before").alias("begin"))
    same = lambda a, b: a.eqNullSafe(b)
    ends = rest.join(begins.withColumnRenamed("source", "_of"), same(F.col("source"), F.col("_of"))).drop("_of")
    few = sources.count() <= FEW_SOURCES
    sent = lambda table: F.broadcast(table) if few else table
    at = F.col("before") - F.col("begin")
    met = summed.join(sent(ends.withColumnRenamed("source", "_of")), same(F.col("source"), F.col("_of")))
    cuts = met.where((at <= F.col("rest")) & (F.col("rest") < at + words)).select(F.col("source").alias("_cut_of"), F.col("key").alias("_cut"), F.expr("(rest - (before - begin)) div copies").alias("_part"))
    plan = ends.join(cuts, same(F.col("source"), F.col("_cut_of")), "left").select(F.col("source").alias("_of"), "source_size", "target", F.col("whole").alias("_whole"), "_cut", "_part")
    plan = written(plan, "mix")
    out = base.join(sent(plan), same(F.col("source"), F.col("_of")))
    more = F.when(F.col("_key") < F.col("_cut"), F.col("size")).when(F.col("_key") == F.col("_cut"), F.col("_part")).otherwise(F.lit(0))
    discard(rows, summed, sources)
    return out.select(*kept.columns, "size", "source_size", "target", (F.col("size") * F.col("_whole") + more).alias("taken"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, 2 * source_size AS most, CASE place % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s),
f AS (SELECT *, sum(most) OVER o - most AS full_, sum(weight) OVER o - weight AS heavy FROM w WINDOW o AS (ORDER BY most / weight, place ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, 1.5::DOUBLE * (SELECT sum(source_size) FROM f)::DOUBLE - full_::DOUBLE AS left_, (SELECT sum(weight) FROM f) - heavy AS open_ FROM f),
v AS (SELECT left_, open_ FROM l WHERE left_ * weight <= most * open_ ORDER BY most / weight, place LIMIT 1),
t AS (SELECT source, source_size, coalesce(least(most::DOUBLE, (SELECT left_ FROM v) * weight / (SELECT open_ FROM v)), most::DOUBLE) AS target FROM l),
b AS (SELECT *, least(CAST(round(target) AS BIGINT), 2 * source_size) AS budget FROM t),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS whole FROM b),
p AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) - size AS before_ FROM d)
SELECT doc_id, size, source_size, target, CAST(size * whole + greatest(0, least(size, budget - whole * source_size - before_)) AS BIGINT) AS taken
FROM p JOIN e ON p.source IS NOT DISTINCT FROM e.source
"""
