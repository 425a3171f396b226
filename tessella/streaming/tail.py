"""Streaming: growing transcripts, sessions of calls by gap, de-duplication.

The built-in file source does not look again at a file it has read, so
``TranscriptTail`` is a source of its own: its offset is the number of bytes
read of each file, only whole lines are taken (a partial last line waits), and a
file that became shorter or begins otherwise is read again from its beginning.
Files are listed and read through Arrow's file systems (local folders, HDFS and
object stores), and only the bytes that were added are read; large backlogs are
taken in batches, a file in pieces of whole lines.
"""

from __future__ import annotations

import fnmatch
import json
import re
import time
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from tessella.functions.shared import discard, written
from tessella.sources import store, transcripts

#: Bytes of a file's beginning that tell it from another file of its name.
HEAD = 256
#: Bytes read at a time in search of a line's end.
STEP = 1 << 16
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Piece(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class TranscriptTail(DataSource):
    """``spark.readStream.format("transcript_tail").option("path", "folder/*.jsonl")``: session_id, project, file, position, line.

    Options: ``startingPosition`` ("beginning", "end"); ``activeSeconds``, files
    at rest for longer when first seen give only what is added from then on;
    ``maxBytesPerBatch``, after which a batch ends, but with one line at least.
    """

    @classmethod
    def name(cls) -> str:
        return "transcript_tail"

    def schema(self) -> str:
        return "session_id string, project string, file string, position long, line string"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Reader(self.options)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Reader(DataSourceStreamReader):
    def __init__(self, options):
        path = options["path"]
        self.prefix = path[: len(path) - len(opened(path)[1])] if "://" in path else ""
        self.store, self.pattern = opened(path)
        get = lambda name, default: options.get(name.lower(), options.get(name, default))
        self.active, self.most = int(get("activeSeconds", 0)), int(get("maxBytesPerBatch", 1 << 40))
        self.from_end = get("startingPosition", "beginning") == "end"
        #: What the last planned batch ended with; unknown after a restart, until a batch is planned.
        self.at: dict[str, list[int]] | None = None

    def _found(self) -> list[fs.FileInfo]:
        fixed = re.split(r"[*?\[]", self.pattern)[0].rpartition("/")[0] or "/"
        infos = self.store.get_file_info(fs.FileSelector(fixed, recursive=True, allow_not_found=True))
        depth = self.pattern.count("/")
        return sorted((i for i in infos if i.is_file and i.path.count("/") == depth and fnmatch.fnmatchcase(i.path, self.pattern)), key=lambda i: i.path)

    def _line_end(self, path: str, low: int, high: int) -> int:
        """Where the last whole line of a file between two places ends; ``low`` if there is none."""
        with self.store.open_input_file(path) as f:
            while high > low:
                step = min(high - low, STEP)
                f.seek(high - step)
                found = f.read(step).rfind(b"\n")
                if found >= 0:
                    return high - step + found + 1
                high -= step
        return low

    def _next_line_end(self, path: str, low: int, high: int) -> int:
        with self.store.open_input_file(path) as f:
            f.seek(low)
            while low < high and (block := f.read(min(STEP, high - low))):
                found = block.find(b"\n")
                if found >= 0:
                    return low + found + 1
                low += len(block)
        return high

    def _head(self, path: str, size: int) -> int:
        with self.store.open_input_file(path) as f:
            return zlib.crc32(f.read(min(HEAD, size)))

    def _ends(self) -> dict[str, list[int]]:
        """Of each file: where the batch's last whole line ends, and how long and which its beginning is."""
        out, taken, left = {}, False, self.most if self.at is not None else 1 << 62
        for info in self._found():
            path, size = info.path, info.size
            start, length, head = (self.at or {}).get(path, [None, 0, 0])
            fresh = start is None
            if not fresh and (size < start or self._head(path, length) != head):
                start = 0  # cut or replaced: it is read anew
            elif fresh:
                resting = self.active and time.time() - info.mtime_ns / 1e9 > self.active
                start = self._line_end(path, 0, size) if resting or (self.at is None and self.from_end) else 0
            end = self._line_end(path, start, size) if size > start else start
            if end - start > left:
                whole = self._line_end(path, start, start + left)
                end = whole if whole > start or taken else self._next_line_end(path, start, end)
            left, taken = max(0, left - (end - start)), taken or end > start
            # The beginning is that of what was read, so that growth alone does not change it.
            length = length if length == HEAD and start else min(HEAD, end)
            out[path] = [end, length, self._head(path, length), start]
        return out

    def initialOffset(self) -> dict:  # noqa: N802
        self.at = {}
        if self.from_end:
            self.at = {i.path: [e := self._line_end(i.path, 0, i.size), n := min(HEAD, e), self._head(i.path, n)] for i in self._found()}
        return {"files": json.dumps(self.at)}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"files": json.dumps({p: x[:3] for p, x in self._ends().items()})}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        self.at, pieces = after, []
        now = {i.path: i for i in self._found()}
        for path, (stop, length, head) in after.items():
            if path in before:
                begin, known, was = before[path]
                if stop < begin or (known and known == length and head != was):
                    begin = 0
            else:
                info = now.get(path)
                resting = self.active and info is not None and time.time() - info.mtime_ns / 1e9 > self.active
                begin = stop if resting else 0
            if stop > begin:
                pieces.append(Piece(path, begin, stop))
        return pieces

    def read(self, piece: Piece):
        folder, _, name = piece.path.rpartition("/")
        with opened(self.prefix + piece.path)[0].open_input_stream(piece.path) if piece.start == 0 else _from(opened(self.prefix + piece.path)[0], piece) as f:
            at, held = piece.start, b""
            while at + len(held) < piece.end and (block := f.read(min(STEP, piece.end - at - len(held)))):
                *whole, held = (held + block).split(b"\n")
                for line in whole:
                    if line.strip():
                        yield name.removesuffix(".jsonl"), folder.rpartition("/")[2], self.prefix + piece.path, at, line.decode(errors="replace")
                    at += len(line) + 1

    def commit(self, end: dict) -> None:
        return None


def _from(store_of: fs.FileSystem, piece: Piece):
    f = store_of.open_input_file(piece.path)
    f.seek(piece.start)
    return f


def sessions_of_calls(calls: DataFrame, gap_seconds: int = 600, late: str = "30 minutes") -> DataFrame:
    """Sessions of a stream of calls (project, at: timestamp, cost_estimate_usd): a gap of ``gap_seconds`` or more begins a new one.

    Spark joins events that are a gap apart exactly, so the window is a
    microsecond shorter.
    """
    window = F.session_window("at", f"{gap_seconds * 1_000_000 - 1} microseconds")
    return calls.withWatermark("at", late).groupBy(window.alias("w"), "project").agg(F.count("*").alias("turns"), F.round(F.sum("cost_estimate_usd"), 6).alias("cost"), F.min("at").alias("started_at"), F.max("at").alias("ended_at")).drop("w")


class _Online(StatefulProcessor):
    """A project's session: when it was last seen, its turns and tokens; gone once no call can continue it."""

    def __init__(self, gap_seconds: int):
        self.gap = gap_seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "session string, began double, seen double, turns long, tokens long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        now = self.session.get() if self.session.exists() else None
        session, began, seen, turns, tokens = now if now else (None, 0.0, 0.0, 0, 0)
        calls, out = pd.concat(list(rows)).sort_values(["at", "id"]), []
        ended = lambda: (key[0], None, pd.Timestamp(seen, unit="s"), session, turns, tokens, True)
        for r in calls.itertuples():
            at = r.at.timestamp()
            if session is None or at - seen >= self.gap:
                if session is not None:
                    out.append(ended())
                session, began, seen, turns, tokens = r.id, at, at, 0, 0
            seen, turns, tokens = max(seen, at), turns + 1, tokens + (0 if pd.isna(r.input_tokens) else int(r.input_tokens))
            out.append((key[0], r.id, r.at, session, turns, tokens, False))
        self.session.update((session, began, seen, turns, tokens))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(int((seen + self.gap) * 1000))
        yield pd.DataFrame(out, columns=ONLINE)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        if self.session.exists():
            session, _, seen, turns, tokens = self.session.get()
            self.session.clear()
            yield pd.DataFrame([(key[0], None, pd.Timestamp(seen, unit="s"), session, turns, tokens, True)], columns=ONLINE)

    def close(self) -> None:
        return None


ONLINE = ["project", "id", "at", "session_id", "turn_number", "cumulative_input_tokens", "ended"]


def online_sessions(calls: DataFrame, gap_seconds: int = 600, late: str = "30 minutes") -> DataFrame:
    """Each call of a stream (project, id, at: timestamp, input_tokens) with its session_id (of the session's first call), turn_number and cumulative_input_tokens so far, and a row for each session that ``ended`` (its last time, turns and tokens, no id).

    Kept per project, one short row, until the watermark says that no call can
    continue the session; then it ends and leaves the state. A gap of
    ``gap_seconds`` or more begins a new one. Calls of a batch are taken in the
    order of their times; a call that comes after later ones counts in the
    session that is open; calls later than ``late`` are dropped. The session must
    keep its state in RocksDB (``STATE_STORE``).
    """
    calls.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    timely = calls.withWatermark("at", late).select("project", "id", "at", "input_tokens")
    out = "project string, id string, at timestamp, session_id string, turn_number long, cumulative_input_tokens long, ended boolean"
    return timely.groupBy("project").transformWithStateInPandas(_Online(gap_seconds), out, "append", "EventTime")


def follow(spark: SparkSession, folder: str, tables: str, checkpoint: str, every: str = "10 seconds", active_seconds: int = 7200, most_bytes: int = 1 << 30) -> StreamingQuery:
    """Keeps the stored tables up to date with the transcripts below ``folder``: looks every so often, and takes in the lines that were added.

    New lines continue their session's numbers. A batch is one change of the
    store that also notes the batch, so after a failure it is taken in once.
    Files at rest for ``active_seconds`` when first seen wait until they grow.
    """
    spark.dataSource.register(TranscriptTail)
    lines = spark.readStream.format("transcript_tail").option("path", f"{folder}/*/*.jsonl").option("activeSeconds", str(active_seconds)).option("maxBytesPerBatch", str(most_bytes)).load()

    def take(batch: DataFrame, number: int) -> None:
        parsed = batch.select("session_id", "project", "file", F.struct("file", "position").alias("place"), F.try_parse_json("line").alias("v")).where("v is not null")
        rows = written(transcripts.chat_rows(parsed).drop("sequence", "file"), "lines")
        if not rows.isEmpty():
            store.upsert_messages(spark, tables, rows, stream=checkpoint, batch=number)
        discard(rows)

    return lines.writeStream.foreachBatch(take).trigger(processingTime=every).option("checkpointLocation", checkpoint).start()


def distinct_calls(calls: DataFrame, late: str = "30 minutes") -> DataFrame:
    """Each call once, by id, among those that come within the watermark."""
    return calls.withWatermark("at", late).dropDuplicatesWithinWatermark(["id"])


def message_counts(messages: DataFrame) -> DataFrame:
    """Running number of messages of each session."""
    return messages.groupBy("session_id").agg(F.count("*").alias("message_count"))
