"""Every plan against DuckDB on the smallest test data, and hazards on hand-made rows."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = [n for n in entry.oracle_sql() if n.startswith("q_")]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", OWN)
def test_same_as_duckdb(spark, data, duck, name):
    df = entry.queries()[name](spark, data)
    columns = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert mine == theirs


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 10


def test_graph_measures(spark, data):
    ranks = entry.queries()["q_pagerank"](spark, data).collect()
    assert len(ranks) == 20 and all(r["rank"] > 0 for r in ranks)


def test_pagerank_of_a_star(spark):
    from tessella.operators import graph

    edges = spark.createDataFrame([("a", "hub"), ("b", "hub"), ("c", "hub")], "src string, dst string")
    ranks = {r["node"]: r["rank"] for r in graph.pagerank(edges).collect()}
    assert ranks["hub"] == max(ranks.values()) and abs(sum(ranks.values()) - 1) < 1e-6
    exact = {r["node"]: r["rank"] for r in graph.pagerank(edges, rounds=40, tolerance=0).collect()}
    assert all(abs(exact[k] - v) < 1e-5 for k, v in ranks.items())


def test_shortest_path_and_communities(spark):
    from tessella.operators import graph

    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "x"), ("x", "d")], "src string, dst string")
    assert [tuple(r) for r in graph.shortest_paths(edges, "a", "d").collect()] == [("a > x > d", 2)]
    assert graph.shortest_paths(edges, "a", "nowhere").collect() == []
    assert [tuple(r) for r in graph.shortest_paths(edges, "a", "a").collect()] == [("a", 0)]
    line = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(7)] + [("n0", "m1"), ("m1", "n2")], "src string, dst string")
    assert [tuple(r) for r in graph.shortest_paths(line, "n0", "n6").collect()] == [(" > ".join(["n0", second, *(f"n{i}" for i in range(2, 7))]), 6) for second in ("m1", "n1")]
    assert graph.shortest_paths(line, "n0", "n7").collect() == [] and graph.shortest_paths(line, "n0", "n7", most=7).count() == 2
    two = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z")], "src string, dst string")
    found = {r["node"]: r["community"] for r in graph.communities(two).collect()}
    assert found["a"] == found["b"] == found["c"] != found["x"] == found["y"]


def test_gap_is_strict(spark):
    from tessella.plans import registry

    rows = [("1", "t", 0, "p"), ("2", "t", 599, "p"), ("3", "t", 1199, "p"), ("4", "t", 1200, None)]
    calls = spark.createDataFrame(rows, "id string, timestamp string, ts_s long, project string")
    found = registry.run("sessionize", {"calls": calls}).orderBy("ordinal").collect()
    assert [r["turns"] for r in found] == [2, 1]
