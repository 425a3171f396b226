"""The stored tables of a deployment: indexing of transcripts, upserts by key, and bulk corrections.

Every function is one change of the store (``versions``): the messages,
artifacts and sessions of what was indexed, and their part of the search index,
are seen together or not at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.ranges import running
from tessella.functions.shared import discard, written
from tessella.functions.text import clean_project_name
from tessella.operators.artifacts import extract_artifacts, unique_artifacts
from tessella.operators import vectors
from tessella.operators.inverted import Inverted
from tessella.sources import transcripts
from tessella.sources.versions import Change, changed, table, version

__all__ = ["Change", "changed", "embed", "index", "insert_by_key", "pending", "rename_projects", "replace_by_key", "search_index", "session_file", "table", "update_by_key", "upsert_messages"]
#: Places of a session's messages within its block of ids, which is one owner of the search index.
PLACES = 1 << 24
#: Segments of the search index up to which it is not merged.
SEGMENTS = 8


def replace_by_key(spark: SparkSession, store: str, name: str, rows: DataFrame, key: str) -> None:
    changed(spark, store, lambda change: change.replace(name, rows, key))


def update_by_key(spark: SparkSession, store: str, name: str, changes: DataFrame, key: str) -> None:
    changed(spark, store, lambda change: change.update(name, changes, key))


def insert_by_key(spark: SparkSession, store: str, name: str, rows: DataFrame, key: str, order: str | None = None) -> None:
    changed(spark, store, lambda change: change.insert(name, rows, key, order))


def search_index(spark: SparkSession, store: str, notes: dict | None = None) -> Inverted:
    """The search index of the stored messages, as of the latest version or the one that ``notes`` are of."""
    notes = version(spark, store)[1].get("notes", {}) if notes is None else notes
    return Inverted(spark, f"{store}/search", span=PLACES, segments=notes.get("segments", []))


def _numbered_sessions(new: DataFrame, held: DataFrame | None) -> DataFrame:
    """New sessions with the number that their ids begin with: the one they had, or the next, in order of time."""
    if held is None:
        held = new.sparkSession.createDataFrame([], "session_id string, number long")
    top = held.agg(F.coalesce(F.max("number"), F.lit(0)).alias("top"))
    met = written(new.join(held.select("session_id", "number"), "session_id", "left"), "sessions")
    fresh = running(met.where("number is null"), [F.col("created_at"), F.col("session_id")], {"before": F.lit(1)}).crossJoin(F.broadcast(top))
    numbered = fresh.withColumn("number", (F.col("top") + F.col("before") + 1).cast("long")).drop("top", "before")
    return met.where("number is not null").unionByName(numbered)


def _put_messages(change: Change, rows: DataFrame, about: DataFrame | None) -> None:
    """Replaces the sessions of ``rows`` in the three tables and the search index; ``about``: filepath and file_size_bytes by session_id, where known."""
    spark, store = change.spark, change.store
    facts = rows.groupBy("session_id").agg(F.max("project").alias("project"), F.count("*").alias("message_count"), F.min("timestamp").alias("created_at"), F.max("timestamp").alias("updated_at"))
    if about is not None:
        facts = facts.join(about, "session_id", "left")
    sessions = written(_numbered_sessions(facts, change.table("sessions")), "sessions")
    numbers = sessions.select("session_id", "number")
    ided = written(rows.drop("id", "project").join(numbers, "session_id").withColumn("id", F.col("number") * PLACES + F.col("sequence")).drop("number"), "messages")
    change.replace("messages", ided, "session_id")
    # A session without artifacts loses those it had.
    found = unique_artifacts(extract_artifacts(ided))
    none = sessions.select("session_id").join(found.select("session_id").distinct(), "session_id", "left_anti")
    change.replace("artifacts", found.unionByName(none, allowMissingColumns=True), "session_id")
    change.update("sessions", sessions, "session_id")
    search = search_index(spark, store, change.content.get("notes", {}))
    change.content["notes"] = change.content.get("notes", {}) | {"segments": search.merged([*search.segments(), search.write(ided)], SEGMENTS)}
    discard(sessions, ided)


#: Readers of the agents' transcripts by the name of their kind.
READERS = {"chat": transcripts.chat_messages, "calls": transcripts.call_messages, "editor": transcripts.editor_messages}


def index(spark: SparkSession, path: str, store: str, full: bool = False, kind: str = "chat") -> int:
    """Indexes transcripts of a kind (``READERS``) below ``path`` into the tables below ``store``; returns how many files were read.

    A file whose stored size is still its size is passed over, unless ``full``.
    A session that is read again replaces all its rows. A function-call
    transcript may name its session itself; it is known by its path.
    """
    files = transcripts.discovered(spark, path).select("path", "file", "length")

    def do(change: Change) -> int:
        held, new = change.table("sessions"), files
        if held is not None and not full:
            new = files.join(held.select(F.col("filepath").alias("file"), F.col("file_size_bytes").alias("length")), ["file", "length"], "left_anti")
        found = [r["path"] for r in new.select("path").collect()]  # names of files, as Spark's own listing holds them
        if not found:
            return 0
        read = READERS[kind](spark, found)
        read = read if "project" in read.columns else read.withColumn("project", F.lit(None).cast("string"))
        rows = written(read, "indexed")
        about = written(new, "files")
        files_of = rows.groupBy("session_id").agg(F.min("file").alias("filepath")).join(about.select(F.col("file").alias("filepath"), F.col("length").alias("file_size_bytes")), "filepath")
        _put_messages(change, rows.drop("file"), files_of)
        discard(rows, about)
        return len(found)

    return changed(spark, store, do)


def upsert_messages(spark: SparkSession, store: str, new: DataFrame, stream: str | None = None, batch: int | None = None) -> bool:
    """Adds messages, the new one where both have a session's sequence number, and counts their sessions again.

    Fit for ``foreachBatch``: with the stream's name and the batch's number, a
    batch that was taken in already is not taken again (False). Rows without a
    sequence number (then with ``place``, their order) continue their session.
    """

    def do(change: Change) -> bool:
        if stream is not None and change.content["streams"].get(stream, -1) >= batch:
            return False
        held, sessions = change.table("messages"), change.table("sessions")
        touched = written(new, "touched")
        rows = touched
        if held is not None:
            old = held.join(touched.select("session_id").distinct(), "session_id", "left_semi")
            if sessions is not None:
                old = old.join(sessions.select("session_id", "project"), "session_id", "left")
            if "place" in touched.columns:
                ends = old.groupBy("session_id").agg((F.max("sequence") + 1).alias("next"))
                rows = _continued(touched, ends)
            rows = transcripts.merged_messages(old, rows)
        elif "place" in touched.columns:
            rows = _continued(touched, None)
        if "project" not in rows.columns:
            rows = rows.withColumn("project", F.lit(None).cast("string"))
        _put_messages(change, rows, None)
        if stream is not None:
            change.content["streams"][stream] = batch
        discard(touched)
        return True

    return changed(spark, store, do)


def _continued(rows: DataFrame, ends: DataFrame | None) -> DataFrame:
    """``rows`` with sequence numbers that follow what their session has, in the order of ``place``."""
    from pyspark.sql import Window

    own = F.row_number().over(Window.partitionBy("session_id").orderBy("place")) - 1
    met = rows.withColumn("next", F.lit(0).cast("long")) if ends is None else rows.join(ends, "session_id", "left")
    return met.withColumn("sequence", (F.coalesce("next", F.lit(0)) + own).cast("long")).drop("next", "place")


def pending(spark: SparkSession, store: str) -> DataFrame:
    """id, content of the stored messages with a text and without a vector."""
    rows = table(spark, store, "messages").where("content is not null and trim(content) != ''").select("id", "content")
    held = table(spark, store, "vectors")
    return rows if held is None else rows.join(held.select(F.col("message_id").alias("id")), "id", "left_anti")


def embed(spark: SparkSession, store: str, model: vectors.Model, batch: int = vectors.BATCH, parts: int = 1) -> int:
    """Gives the pending messages vectors, in ``parts`` changes of the store, so that a run that is stopped goes on where it was; returns how many it gave.

    Messages of a batch for which the model fails twice stay pending.
    """
    given = 0
    for part in range(parts):
        own = pending(spark, store).where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part)
        rows = written(vectors.embedded(own, model, batch), "vectors")
        if n := rows.count():
            replace_by_key(spark, store, "vectors", rows, "message_id")
        discard(rows)
        given += n
    return given


def rename_projects(spark: SparkSession, store: str) -> int:
    """Cleans the names of all stored projects; returns how many sessions changed."""

    def do(change: Change) -> int:
        clean = change.table("sessions").withColumn("clean", clean_project_name(F.col("project"))).where("project is not null and clean != project")
        rows = written(clean.withColumn("project", F.col("clean")).drop("clean"), "renamed")
        n = rows.count()
        if n:
            change.replace("sessions", rows, "session_id")
        discard(rows)
        return n

    return changed(spark, store, do)


def session_file(spark: SparkSession, path: str, session_id: str) -> str | None:
    """The transcript of a session, by the file's name, or else the file changed last; None if there are none."""
    files = transcripts.discovered(spark, path)
    best = files.orderBy(F.col("path").endswith(f"/{session_id}.jsonl").desc(), F.desc("modified"), "path").select("path").first()
    return best["path"] if best else None
