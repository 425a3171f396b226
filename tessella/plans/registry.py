"""The queries that the driver runs, by name, and their SQL for DuckDB."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.plans import binding, catalog


NAMES = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


def run(name: str, tables: dict, **params) -> DataFrame:
    """The plan ``name`` over the given tables (a dict of DataFrames), with its arguments or their defaults."""
    plan = catalog.PLANS[name]
    names = set(NAMES.findall(plan))
    if unknown := set(params) - names:
        raise TypeError(f"plan {name} takes no {', '.join(sorted(unknown))}")
    used = {t: tables[t] for t in names - set(catalog.PARAMS)}
    spark = next(iter(used.values())).sparkSession
    return spark.sql(plan, **used, **{p: params.get(p, catalog.PARAMS[p]) for p in names & set(catalog.PARAMS)})


#: Arguments of queries over the test data, in which files are seldom read again.
OVER_TEST_DATA: dict[str, dict[str, int | str]] = {"read_loops": {"most_reads": 1}}


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(name, binding.bound(spark, sf_dir), **OVER_TEST_DATA.get(name, {}))


#: What each view is made of.
NEEDS = {"messages": ["ev"], "sessions": ["messages"], "artifacts": ["messages"]}


def with_views(plan: str) -> str:
    """A plan as one DuckDB statement, its arguments put in and the views that it uses in front."""
    plan = catalog.to_duckdb(NAMES.sub(lambda m: catalog.quoted(catalog.PARAMS[m[1]]) if m[1] in catalog.PARAMS else m[0], plan))
    used: list[str] = []

    def need(view: str) -> None:
        for other in NEEDS.get(view, []):
            need(other)
        if view not in used:
            used.append(view)

    for view in sorted(set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", plan))):
        need(view)
    body = re.sub(r"(?<!\{)\{(\w+)\}(?!\})", lambda m: m[1], plan).replace("{{", "{").replace("}}", "}")
    views = ", ".join(f"{v} AS ({binding.ORACLE[v]})" for v in used)
    return f"WITH {views} SELECT * FROM ({body})" if "LIMIT" not in body[-12:] or body.startswith("WITH") else f"WITH {views} {body}"


def queries() -> dict:
    from tessella.plans import extra

    return {f"q_{name}": _query(name) for name in catalog.PLANS} | extra.QUERIES


def oracle_sql() -> dict[str, str]:
    from tessella.plans import extra, oracles

    same = {f"q_{name}": with_views(plan) for name, plan in catalog.PLANS.items() if name not in oracles.APART}
    return same | {f"q_{name}": with_views(sql) for name, sql in oracles.APART.items()} | extra.ORACLES
