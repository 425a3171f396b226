"""``python -m tessella TABLES PLAN``: prints a plan's result over stored tables; ``index TRANSCRIPTS`` (``--full``: all files again), ``watch TRANSCRIPTS``, ``clean-names``, ``brief PROJECT``, ``search QUESTION``, ``find EXPRESSION``, ``session ID``, ``artifacts ID``, ``insights``, ``plans``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessella.api import History
from tessella.plans import binding, catalog
from tessella.sources import store
from tessella.sources.transcripts import exported


def main() -> None:
    parser = argparse.ArgumentParser(prog="tessella", description=__doc__)
    parser.add_argument("tables", help="folder of the stored tables")
    parser.add_argument("question", help="a plan's name, or: index, watch, clean-names, plans, insights, brief, search, find, session, artifacts")
    parser.add_argument("argument", nargs="?", default="")
    parser.add_argument("--full", action="store_true", help="index files again whose size is as it was")
    parser.add_argument("--kind", choices=tuple(store.READERS), default="chat", help="whose transcripts are indexed")
    parser.add_argument("--set", action="append", default=[], metavar="NAME=VALUE", help="an argument of the plan")
    parser.add_argument("--export", help="write the result to this folder instead")
    parser.add_argument("--format", choices=("json", "csv"), default="json")
    given = parser.parse_args()
    if given.question == "plans":
        print("\n".join(catalog.PLANS))
        return
    spark = SparkSession.builder.appName("tessella").getOrCreate()
    if given.question in ("index", "clean-names"):
        print(store.index(spark, given.argument, given.tables, given.full, given.kind) if given.question == "index" else store.rename_projects(spark, given.tables))
        return
    if given.question == "watch":
        from tessella.streaming import tail

        tail.follow(spark, given.argument, given.tables, f"{given.tables}/watch").awaitTermination()
        return
    history = History(binding.stored(spark, given.tables))
    if given.question == "brief":
        print(history.brief(given.argument))
    elif given.question == "insights":
        print(json.dumps(history.insights(), indent=1, default=str))
    else:
        one = {"search": history.search, "find": history.find, "artifacts": lambda s: history.tables["artifacts"].where(F.col("session_id") == s).orderBy("sequence", "id"), "session": lambda s: history.tables["messages"].where(F.col("session_id").startswith(s)).orderBy("session_id", "sequence")}
        df = one[given.question](given.argument) if given.question in one else history.ask(given.question, **{k: int(v) if v.lstrip("-").isdigit() else v for k, v in (x.split("=", 1) for x in getattr(given, "set"))})
        exported(df, given.export, given.format) if given.export else df.show(100, truncate=120)


if __name__ == "__main__":
    main()
