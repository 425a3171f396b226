"""Versions of a deployment's tables: a change of several tables is seen whole or not at all.

A table's rows lie in immutable folders, one for each bucket of its key that a
change wrote; a version is a small file that names, for each table, its columns
and the folder of each bucket. A change reads and writes the buckets of its keys
only and is committed by creating the next version's file, which fails if another
change was first (``Conflict``); readers go on with the version that they began
with. What streams have taken in is noted in the same file, so a batch that
comes again after a failure is known. Creating must be exclusive in the store:
HDFS and local folders rename that way.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.shared import discard, names_in, read_text, remove, write_text, written

#: Buckets of a new store; a change rewrites whole buckets, so large stores take more.
BUCKETS = 64
TRIES = 5
Result = TypeVar("Result")


class Conflict(RuntimeError):
    """Another change was committed since this one began."""


def _numbers(spark: SparkSession, store: str) -> list[int]:
    return sorted(int(n.removesuffix(".json")) for n in names_in(spark, f"{store}/versions") if n.removesuffix(".json").isdigit())


def version(spark: SparkSession, store: str, number: int | None = None) -> tuple[int, dict]:
    """The number and content of a version, the latest by default; 0 and nothing before the first."""
    number = number or max(_numbers(spark, store), default=0)
    found = read_text(spark, f"{store}/versions/{number:010d}.json") if number else None
    return (number, json.loads(found)) if found else (0, {"buckets": BUCKETS, "tables": {}, "streams": {}, "notes": {}})


def _read(spark: SparkSession, store: str, table: dict, buckets: set[int] | None = None) -> DataFrame:
    kind = T.StructType.fromJson(table["schema"])
    folders = [f"{store}/{folder}/bucket={b}" for b, folder in table["folders"].items() if buckets is None or int(b) in buckets]
    return spark.read.schema(kind).parquet(*folders) if folders else spark.createDataFrame([], kind)


def table(spark: SparkSession, store: str, name: str, number: int | None = None) -> DataFrame | None:
    """A stored table, as of a version; None if it is not there."""
    held = version(spark, store, number)[1]["tables"].get(name)
    return _read(spark, store, held) if held else None


class Change:
    """Changes of some tables, over the version that was the latest when it began."""

    def __init__(self, spark: SparkSession, store: str, buckets: int | None = None):
        self.spark, self.store = spark, store.rstrip("/")
        self.number, self.content = version(spark, self.store)
        if buckets and not self.number:
            self.content["buckets"] = buckets

    def table(self, name: str) -> DataFrame | None:
        held = self.content["tables"].get(name)
        return _read(self.spark, self.store, held) if held else None

    def _bucket(self, key: str):
        return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(self.content["buckets"])).cast("int")

    def _put(self, name: str, rows: DataFrame, key: str, joined: Callable[[DataFrame | None, DataFrame], DataFrame]) -> None:
        """Writes the buckets of the keys of ``rows`` anew: what ``joined`` makes of their stored rows and the new ones."""
        rows = written(rows, name)
        held = self.content["tables"].get(name)
        touched = {r[0] for r in rows.select(self._bucket(key)).distinct().collect()}  # numbers of buckets
        out = joined(_read(self.spark, self.store, held, touched) if held else None, rows)
        folder = f"data/{name}/{uuid.uuid4().hex}"
        # Rebalanced, so that a hot key's rows are written by several tasks.
        out.withColumn("bucket", self._bucket(key)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.store}/{folder}")
        folders = dict(held["folders"]) if held else {}
        there = {int(n.removeprefix("bucket=")) for n in names_in(self.spark, f"{self.store}/{folder}") if n.startswith("bucket=")}
        folders = {b: f for b, f in folders.items() if int(b) not in touched} | {str(b): folder for b in there}
        self.content["tables"][name] = {"schema": out.schema.jsonValue(), "folders": folders}
        discard(rows)

    def replace(self, name: str, rows: DataFrame, key: str) -> None:
        """Puts ``rows`` in place of all stored rows of their keys; columns that either side lacks are null."""

        def joined(held: DataFrame | None, new: DataFrame) -> DataFrame:
            return new if held is None else held.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)

        self._put(name, rows, key, joined)

    def update(self, name: str, changes: DataFrame, key: str) -> None:
        """Inserts or updates one row a key: a change's columns where they are not null, else the stored ones."""

        def joined(held: DataFrame | None, new: DataFrame) -> DataFrame:
            if held is None:
                return new
            columns = [*held.columns, *(c for c in new.columns if c not in held.columns)]
            met = held.alias("h").join(new.alias("n"), key, "full_outer")
            side = lambda c, df, at: [F.col(f"{at}.{c}")] if c in df.columns else []
            return met.select(*(F.col(c) if c == key else F.coalesce(*side(c, new, "n"), *side(c, held, "h")).alias(c) for c in columns))

        self._put(name, changes, key, joined)

    def append(self, name: str, rows: DataFrame, key: str) -> None:
        """Adds ``rows`` to what is stored: a bucket's old rows are read once and written with the new."""
        self._put(name, rows, key, lambda held, new: new if held is None else held.unionByName(new, allowMissingColumns=True))

    def insert(self, name: str, rows: DataFrame, key: str, order: str | None = None) -> None:
        """Adds rows of keys that are not stored yet; of several new ones of a key, that of the least ``order``."""

        def joined(held: DataFrame | None, new: DataFrame) -> DataFrame:
            one = F.min_by(F.struct("*"), order or key)
            once = new.groupBy(F.col(key).alias("_key")).agg(one.alias("r")).select("r.*")
            return once if held is None else held.unionByName(once.join(held.select(key), key, "left_anti"), allowMissingColumns=True)

        self._put(name, rows, key, joined)

    def drop(self, *names: str) -> None:
        """Tables as if they had never been."""
        for name in names:
            self.content["tables"].pop(name, None)

    def commit(self, **notes) -> int:
        """Makes the change the next version and returns its number; ``Conflict`` if there is one already."""
        self.content["notes"] = self.content.get("notes", {}) | notes
        if not write_text(self.spark, f"{self.store}/versions/{self.number + 1:010d}.json", json.dumps(self.content), overwrite=False):
            raise Conflict(f"version {self.number + 1} is there already")
        return self.number + 1


def changed(spark: SparkSession, store: str, do: Callable[[Change], Result], tries: int = TRIES) -> Result:
    """What ``do`` returns after its changes are committed; done again, over the new latest version, where another change was first."""
    for left in range(tries, 0, -1):
        change = Change(spark, store)
        out = do(change)
        try:
            change.commit()
            return out
        except Conflict:
            if left == 1:
                raise
    raise AssertionError("no tries")


def vacuum(spark: SparkSession, store: str, keep: int = 10) -> int:
    """Deletes all versions but the last ``keep`` and the folders that none of those names; returns how many folders went. Not while a change is being made."""
    numbers = _numbers(spark, store)
    used = {f for n in numbers[-keep:] for t in version(spark, store, n)[1]["tables"].values() for f in t["folders"].values()}
    gone = [f for name in names_in(spark, f"{store}/data") for f in (f"data/{name}/{x}" for x in names_in(spark, f"{store}/data/{name}")) if f not in used]
    for n in numbers[:-keep]:
        remove(spark, f"{store}/versions/{n:010d}.json")
    for folder in gone:
        remove(spark, f"{store}/{folder}")
    return len(gone)
