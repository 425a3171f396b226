"""Connected components of an edge table, by contraction of edges over written tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.shared import discard, written


def _order(node: Column, turn: int) -> Column:
    """What nodes are ordered by in a round: themselves at first, then anew by a hash."""
    return F.struct(F.lit(0).alias("h") if turn == 0 else F.xxhash64(F.lit(turn), node).alias("h"), node.alias("node"))


def components(edges: DataFrame) -> DataFrame:
    """node, label: for each node of ``edges`` (a, b, of any one type that sorts) the one node that stands for all it reaches.

    Each round sends every node to the first, in the round's order, among itself
    and its neighbours, replaces the ends of all edges by where they were sent,
    and drops loops and repeats; so the edge table shrinks until none is left,
    after a number of rounds that grows with the logarithm of the nodes whatever
    the graph's shape (the order is a new hash each time). The rounds' maps are
    then composed. Targets are combined before they are shuffled, and every round
    is a written table. No edges give no rows; loops and repeated edges are
    ignored.
    """
    pair = lambda df: df.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).dropDuplicates()
    live = written(pair(edges.select("a", "b")), "edges")
    maps: list[DataFrame] = []
    while not live.isEmpty() or not maps:
        turn = len(maps)
        ends = live.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(live.select(F.col("b").alias("node"), F.col("a").alias("near")))
        first = ends.groupBy("node").agg(F.min(_order(F.col("near"), turn)).alias("near"))
        maps.append(written(first.select("node", F.least(_order(F.col("node"), turn), F.col("near"))["node"].alias("label")), "sent"))
        at = lambda side: maps[-1].select(F.col("node").alias(side), F.col("label").alias(f"{side}_label"))  # noqa: B023, E731
        sent = live.join(at("a"), "a").join(at("b"), "b").select(F.col("a_label").alias("a"), F.col("b_label").alias("b"))
        held, live = live, written(pair(sent), "edges")
        discard(held)
    found = maps[0]
    for later in maps[1:]:
        further = later.select(F.col("node").alias("label"), F.col("label").alias("further"))
        found = found.join(further, "label", "left").select("node", F.coalesce("further", "label").alias("label"))
    out = written(found, "components")
    discard(live, *maps)
    return out
