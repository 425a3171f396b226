"""Graph measures over one space of nodes with typed edges: PageRank, communities and shortest paths, by iterated joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.shared import discard, written


def node(kind: str, name: Column) -> Column:
    """A node's name in the common space."""
    return F.concat(F.lit(f"{kind}: "), name)


def whole(touched: DataFrame, co_change: DataFrame, causes: DataFrame, tested_by: DataFrame, involves: DataFrame) -> DataFrame:
    """src, dst, weight of all edges: sessions touch files and involve concepts; files change together, cause errors and are tested by others."""
    file, session, error, concept = (lambda c, kind=kind: node(kind, F.col(c)) for kind in ("File", "Session", "Error", "Concept"))
    edge = lambda df, a, b, n: df.select(a.alias("src"), b.alias("dst"), n.cast("long").alias("weight"))
    parts = [
        edge(touched, session("session_id"), file("path"), F.col("reads") + F.col("writes")), edge(co_change, file("file_a"), file("file_b"), F.col("co_sessions")), edge(causes, file("path"), error("pattern"), F.col("n")),
        edge(tested_by, file("source"), file("test_file"), F.col("co_sessions")), edge(involves, session("session_id"), concept("concept"), F.col("n")),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    """src, dst, weight of an undirected graph, each edge in both directions; edges without weights weigh 1."""
    weighed = edges if "weight" in edges.columns else edges.select("src", "dst").distinct().withColumn("weight", F.lit(1).cast("long"))
    turned = weighed.select("src", "dst", "weight").unionByName(weighed.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return turned.where("src != dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def pagerank(edges: DataFrame, rounds: int = 100, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """node, rank, until the ranks of all nodes together change by less than ``tolerance`` or ``rounds`` are over; nodes without outgoing edges spread their rank evenly."""
    edges = written(edges.select("src", "dst").distinct(), "graph")
    degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
    nodes = written(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().join(degree.withColumnRenamed("src", "node"), "node", "left"), "nodes")
    n = nodes.count()
    ranks = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    held: DataFrame | None = None
    for number in range(rounds):
        given = edges.join(ranks, edges["src"] == ranks["node"]).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("degree")).alias("given"))
        loose = ranks.where("degree is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("loose"))
        new = nodes.join(given, "node", "left").crossJoin(F.broadcast(loose)).select("node", "degree", ((1 - damping) / n + damping * (F.coalesce("given", F.lit(0.0)) + F.col("loose") / n)).alias("rank"))
        if number % 4 < 3 and number < rounds - 1:
            ranks = new
            continue
        # Every fourth round is a table, compared with the one before it.
        new = written(new, "ranks")
        change = None if held is None or tolerance <= 0 else new.join(held.select("node", F.col("rank").alias("was")), "node").agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0]
        if held is not None:
            discard(held)
        held = ranks = new
        if change is not None and change < tolerance:
            break
    return ranks.select("node", "rank")


def communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """node, community by label propagation: the heaviest label among neighbours, the least of equals; until no label changes or ``rounds`` are over."""
    near = written(both_ways(edges), "graph")
    labels = written(near.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node")), "labels")
    best = Window.partitionBy("node").orderBy(F.desc("n"), "community")
    for _ in range(rounds):
        counted = near.join(labels, near["dst"] == labels["node"]).groupBy(F.col("src").alias("node"), "community").agg(F.sum("weight").alias("n"))
        new = written(counted.withColumn("at", F.row_number().over(best)).where("at = 1").select("node", "community"), "labels")
        same = new.join(labels.withColumnRenamed("community", "was"), "node").where("community != was").isEmpty()
        discard(labels)
        labels = new
        if same:
            break
    return labels


def shortest_paths(edges: DataFrame, start: str, end: str, most: int = 6, limit: int = 5) -> DataFrame:
    """path, hops: up to ``limit`` shortest undirected paths of at most ``most`` edges, searched from both ends.

    The smaller of the two fronts goes on; nodes that its side has reached
    before are left out. A node keeps the ``limit`` first paths that lead to it.
    """
    spark = edges.sparkSession
    near = written(both_ways(edges).select("src", "dst"), "graph")
    first = Window.partitionBy("node").orderBy("path")
    fronts = [spark.createDataFrame([(x, x)], "node string, path string") for x in (start, end)]
    seen = [f.select("node") for f in fronts]
    sizes = [1, 1]
    for hops in range(most + 1):
        ways = fronts[0].join(fronts[1].withColumnRenamed("path", "rest"), "node")
        # The meeting node ends one path and begins the other.
        onward = F.expr("substr(rest, length(node) + 1)")
        found = written(ways.select(F.concat("path", onward).alias("path"), F.lit(hops).alias("hops")).orderBy("path").limit(limit), "paths")
        if not found.isEmpty() or hops == most or not all(sizes):
            return found
        side = int(sizes[1] < sizes[0])
        step = fronts[side].join(near, fronts[side]["node"] == near["src"])
        longer = F.concat("path", F.lit(" > "), "dst") if side == 0 else F.concat("dst", F.lit(" > "), "path")
        new = step.select(F.col("dst").alias("node"), longer.alias("path")).join(seen[side], "node", "left_anti")
        fronts[side] = written(new.withColumn("at", F.row_number().over(first)).where(f"at <= {limit}").drop("at"), "front")
        seen[side] = written(seen[side].unionByName(fronts[side].select("node").distinct()), "seen")
        sizes[side] = fronts[side].count()
    raise AssertionError("the last round returns")
