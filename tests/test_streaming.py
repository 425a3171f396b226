from pyspark.sql import functions as F

from tessella.streaming import tail


def test_tail_takes_whole_lines_and_sees_cut_files(spark, tmp_path):
    spark.dataSource.register(tail.TranscriptTail)
    log = tmp_path / "a.jsonl"
    log.write_bytes(b"one\ntwo\nhal")
    stream = spark.readStream.format("transcript_tail").option("path", f"{tmp_path}/*.jsonl").load()
    query = stream.writeStream.format("memory").queryName("tailed").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
        lines = lambda: [r["line"] for r in spark.sql("select line from tailed order by position, line").collect()]
        assert lines() == ["one", "two"]
        with log.open("ab") as f:
            f.write(b"f\nthree\n")
        query.processAllAvailable()
        assert lines() == ["one", "two", "half", "three"]
        log.write_bytes(b"new\n")
        query.processAllAvailable()
        assert "new" in lines()
    finally:
        query.stop()


def test_sessions_and_distinct_calls(spark, tmp_path):
    rows = [("1", "p", 5000, 1.0), ("1", "p", 5000, 1.0), ("2", "p", 5599, 1.0), ("3", "p", 6199, 1.0), ("4", "q", 100_000, 0.0)]
    spark.createDataFrame(rows, "id string, project string, s long, cost_estimate_usd double").write.parquet(str(tmp_path / "in"))
    calls = spark.readStream.schema("id string, project string, s long, cost_estimate_usd double").parquet(str(tmp_path / "in")).withColumn("at", F.timestamp_seconds("s"))
    for name, df in (("sessions", tail.sessions_of_calls(calls)), ("calls", tail.distinct_calls(calls))):
        q = df.writeStream.outputMode("append").format("memory").queryName(f"t_{name}").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r["turns"] for r in spark.sql("select * from t_sessions").collect()) == [1, 3]
    assert spark.sql("select * from t_calls").count() == 4


def test_online_sessions_end_and_leave_the_state(spark, tmp_path):
    schema = "id string, project string, s long, input_tokens long"
    parts = [[("a", "p", 1000, 5), ("b", "p", 1599, 7)], [("c", "p", 2198, 1), ("d", "p", 2798, 2), ("e", "q", 2000, None)], [("f", "r", 9000, 1)], [("g", "r", 9100, 1), ("late", "p", 2900, 9)]]
    (tmp_path / "in").mkdir()
    calls = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("at", F.timestamp_seconds("s"))
    query = tail.online_sessions(calls, late="10 minutes").writeStream.outputMode("append").format("memory").queryName("t_online").option("checkpointLocation", str(tmp_path / "cp")).start()
    states = []
    try:
        for rows in parts:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            query.processAllAvailable()
            states.append(sum(o["numRowsTotal"] for o in query.lastProgress["stateOperators"]))
    finally:
        query.stop()
    rows = spark.sql("select * from t_online").collect()
    found = {r["id"]: (r["session_id"], r["turn_number"], r["cumulative_input_tokens"]) for r in rows if r["id"]}
    assert found == {"a": ("a", 1, 5), "b": ("a", 2, 12), "c": ("a", 3, 13), "d": ("d", 1, 2), "e": ("e", 1, 0), "f": ("f", 1, 1), "g": ("f", 2, 2)}
    assert sorted((r["session_id"], r["turn_number"], r["cumulative_input_tokens"]) for r in rows if r["ended"]) == [("a", 3, 13), ("d", 1, 2), ("e", 1, 0)]
    assert states[-1] <= states[0]  # one project again


def test_follow_keeps_tables_up_to_date(spark, tmp_path):
    import json
    import os

    from tessella.plans import binding

    folder = tmp_path / "projects" / "-home-p"
    folder.mkdir(parents=True)
    say = lambda n: json.dumps({"type": "user", "timestamp": f"2026-05-01T00:00:0{n}Z", "message": {"content": f"line {n}"}}) + "\n"
    (folder / "s.jsonl").write_text(say(1))
    (folder / "old.jsonl").write_text(say(2))
    os.utime(folder / "old.jsonl", (0, 0))
    query = tail.follow(spark, str(tmp_path / "projects"), f"file://{tmp_path}/store", str(tmp_path / "cp"), every="0 seconds")
    try:
        query.processAllAvailable()
        (folder / "s.jsonl").write_text(say(1) + say(3))
        query.processAllAvailable()
    finally:
        query.stop()
    counts = {r["session_id"]: r["message_count"] for r in binding.stored(spark, f"file://{tmp_path}/store")["sessions"].collect()}
    assert counts == {"s": 2}


def test_follow_continues_sessions_exactly_once(spark, tmp_path):
    import json

    from tessella.api import History
    from tessella.plans import binding
    from tessella.sources import store, versions

    logs, at, cp = tmp_path / "projects" / "-home-p", f"file://{tmp_path}/store", str(tmp_path / "cp")
    logs.mkdir(parents=True)
    say = lambda name, *ns: "".join(json.dumps({"type": "user", "timestamp": f"2026-05-01T00:00:{n:02d}Z", "message": {"content": f"{name} line{n}"}}) + "\n" for n in ns)

    def run(change):
        query = tail.follow(spark, str(tmp_path / "projects"), at, cp, every="0 seconds", most_bytes=100)
        try:
            query.processAllAvailable()
            change()
            query.processAllAvailable()
        finally:
            query.stop()
        return [p["numInputRows"] for p in query.recentProgress]

    def grow(name, *ns):
        with (logs / f"{name}.jsonl").open("a") as f:
            f.write(say(name, *ns))

    grow("a", 1, 2)
    first = run(lambda: (grow("a", 3), grow("b", 1)))
    second = run(lambda: grow("a", 4, 5))  # after a restart
    assert sum(first) == 4 and sum(second) == 2 and max(first) < 4  # lines that were added, in several batches
    rows = {(r["session_id"], r["sequence"], r["content"]) for r in store.table(spark, at, "messages").collect()}
    assert rows == {("b", 0, "b line1"), *(("a", n - 1, f"a line{n}") for n in range(1, 6))}
    assert {r["session_id"]: (r["message_count"], r["project"]) for r in binding.stored(spark, at)["sessions"].collect()} == {"a": (5, "-home-p"), "b": (1, "-home-p")}
    assert History(binding.stored(spark, at)).find("line4").first()["session_id"] == "a"
    # The batch again, as after a failure between the commit and the checkpoint.
    number = versions.version(spark, at)[1]["streams"][cp]
    again = spark.createDataFrame([("a", "x", 9)], "session_id string, content string, place long")
    assert store.upsert_messages(spark, at, again, stream=cp, batch=number) is False and store.table(spark, at, "messages").count() == 6


def test_tail_batches_end_with_lines(tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b"0123456789\n" * 30 + b"part")
    (tmp_path / "b.jsonl").write_bytes(b"x" * 500 + b"\n")
    reader = tail._Reader({"path": f"{tmp_path}/*.jsonl", "maxBytesPerBatch": "100"})
    at, got, sizes = reader.initialOffset(), [], []
    while (end := reader.latestOffset()) != at:
        pieces = reader.partitions(at, end)
        sizes.append(sum(p.end - p.start for p in pieces))
        got += [(r[0], r[3], len(r[4])) for p in pieces for r in reader.read(p)]
        at = end
    assert got == [*(("a", 11 * i, 10) for i in range(30)), ("b", 0, 500)] and sizes[:3] == [99] * 3 and sum(sizes) == 831
    (tmp_path / "b.jsonl").write_bytes(b"y" * 600 + b"\n")  # another file of that name, and longer
    assert [(p.start, p.end) for p in reader.partitions(at, reader.latestOffset())] == [(0, 601)]
