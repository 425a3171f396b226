"""From transcripts to stored tables and the reports over them."""

import json

from pyspark.sql import functions as F

from tessella.api import History
from tessella.operators.artifacts import extract_artifacts, unique_artifacts
from tessella.plans import binding
from tessella.sources import store


def transcript(folder, name, turns):
    """A session in which each turn is a question and an answer that edits a file."""
    folder.mkdir(parents=True, exist_ok=True)
    events = []
    for n, (question, file) in enumerate(turns):
        events.append({"type": "user", "timestamp": f"2026-03-0{n + 1}T08:00:00Z", "message": {"content": question}})
        events.append({"type": "assistant", "timestamp": f"2026-03-0{n + 1}T08:01:00Z", "message": {"content": [{"type": "text", "text": f"working on {question}"}, {"type": "tool_use", "id": f"t{n}", "name": "Edit", "input": {"file_path": file}}], "usage": {"input_tokens": 40, "output_tokens": 9}}})
    (folder / f"{name}.jsonl").write_text("".join(json.dumps(e) + "\n" for e in events))


def test_index_to_brief(spark, tmp_path):
    logs, at = tmp_path / "projects", f"file://{tmp_path}/tables"
    transcript(logs / "-home-dev-shop", "s1", [("repair the checkout", "/shop/pay.py"), ("test the checkout", "/shop/test_pay.py")])
    transcript(logs / "-home-dev-blog", "s2", [("write a feed", "/blog/feed.py")])
    assert store.index(spark, str(logs), at) == 2 and store.index(spark, str(logs), at) == 0
    first = {r["session_id"]: r for r in binding.stored(spark, at)["sessions"].collect()}
    assert first["s1"]["message_count"] == 6 and first["s2"]["project"] == "-home-dev-blog"
    transcript(logs / "-home-dev-shop", "s1", [("repair the checkout", "/shop/pay.py"), ("test the checkout", "/shop/test_pay.py"), ("ship the checkout", "/shop/ship.py")])
    assert store.index(spark, str(logs), at) == 1 and store.index(spark, str(logs), at, full=True) == 2
    tables = binding.stored(spark, at)
    assert tables["messages"].count() == 12 == tables["messages"].select("id").distinct().count()
    assert {r["session_id"]: r["number"] for r in tables["sessions"].collect()} == {k: r["number"] for k, r in first.items()}
    assert {r["target"] for r in tables["artifacts"].collect()} == {"/shop/pay.py", "/shop/test_pay.py", "/shop/ship.py", "/blog/feed.py"}
    history = History(tables)
    text = history.brief("-home-dev-shop")
    assert "/shop/pay.py" in text and "/blog/feed.py" not in text and "repair the checkout" in text
    found = history.search("how did we repair the checkout", project="-home-dev-shop").collect()
    assert found and {r["session_id"] for r in found} == {"s1"} and history.search("feed", project="-home-dev-shop").count() == 0
    assert [r["session_id"] for r in history.sessions(min_messages=0, sort="messages").collect()] == ["s1", "s2"]
    assert history.ask("session_by_prefix", prefix="s2").first()["session_id"] == "s2"
    assert store.session_file(spark, str(logs), "s2").endswith("/s2.jsonl") and store.session_file(spark, str(logs), "none").endswith(".jsonl")


def test_upserts(spark, tmp_path):
    at = f"file://{tmp_path}/tables"
    schema = "session_id string, sequence long, role string, content string, timestamp string, tool_name string, token_usage_in long, token_usage_out long, cache_read_tokens long, cache_create_tokens long, project string"
    row = lambda s, n, text: (s, n, "user", text, f"2026-01-01T00:00:0{n}Z", None, 1, 1, 0, 0, "-home-u-projects-app")
    store.upsert_messages(spark, at, spark.createDataFrame([row("a", 0, "one"), row("b", 0, "other")], schema))
    store.upsert_messages(spark, at, spark.createDataFrame([row("a", 0, "new"), row("a", 1, "two")], schema))
    tables = binding.stored(spark, at)
    assert {(r["session_id"], r["sequence"], r["content"]) for r in tables["messages"].collect()} == {("a", 0, "new"), ("a", 1, "two"), ("b", 0, "other")}
    assert {r["session_id"]: r["message_count"] for r in tables["sessions"].collect()} == {"a": 2, "b": 1}
    assert store.rename_projects(spark, at) == 2 and store.rename_projects(spark, at) == 0
    assert {r["project"] for r in binding.stored(spark, at)["sessions"].collect()} == {"app"}
    trees = spark.createDataFrame([(1, "fix/a", "active", None), (2, "fix/b", "active", None)], "id long, branch_name string, status string, resolved_at string")
    store.update_by_key(spark, at, "worktrees", trees, "id")
    store.update_by_key(spark, at, "worktrees", spark.createDataFrame([(2, "passed", "now")], "id long, status string, resolved_at string"), "id")
    assert {tuple(r) for r in binding.stored(spark, at)["worktrees"].select("id", "branch_name", "status", "resolved_at").collect()} == {(1, "fix/a", "active", None), (2, "fix/b", "passed", "now")}
    vectors = spark.createDataFrame([(7, [1, 2])], "message_id long, embedding array<int>")
    store.replace_by_key(spark, at, "vectors", vectors, "message_id")
    store.replace_by_key(spark, at, "vectors", spark.createDataFrame([(7, [3]), (8, [4])], vectors.schema), "message_id")
    assert {(r["message_id"], r["embedding"][0]) for r in binding.stored(spark, at)["vectors"].collect()} == {(7, 3), (8, 4)}


def test_artifacts_of_python_literals_and_repeats(spark):
    rows = [(1, "Edit", "{'file_path': '/b.py', 'replace_all': False, 'limit': None}"), (2, "Edit", '{"file_path": "/c.py", "replace_all": true}'), (3, "Read", "tool_use:Read(file_path=/d.py, limit=3)"), (4, "Edit", "{'file_path': '/b.py', 'old': True}"), (5, "Bash", "not a dict")]
    messages = spark.createDataFrame([(i, "s", i % 3, "assistant", c, None, t) for i, t, c in rows], "id long, session_id string, sequence long, role string, content string, timestamp string, tool_name string")
    found = extract_artifacts(messages)
    assert {(r["id"], r["target"]) for r in found.collect()} == {(1, "/b.py"), (2, "/c.py"), (3, "/d.py"), (4, "/b.py")}
    assert {r["id"] for r in unique_artifacts(found).collect()} == {1, 2, 3}
    assert unique_artifacts(found.where(F.lit(False))).count() == 0


def test_a_change_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    import pytest

    from tessella.sources import versions

    at = f"file://{tmp_path}/tables"
    row = lambda s, n, text: (s, n, "user", text, f"2026-01-01T00:00:0{n}Z", None, 1, 1, 0, 0, "p")
    schema = "session_id string, sequence long, role string, content string, timestamp string, tool_name string, token_usage_in long, token_usage_out long, cache_read_tokens long, cache_create_tokens long, project string"
    store.upsert_messages(spark, at, spark.createDataFrame([row("a", 0, "one")], schema))
    before = History(binding.stored(spark, at))
    kept = versions.Change.update

    def failing(self, name, *rest):
        if name == "sessions":
            raise RuntimeError("lost between two tables")
        return kept(self, name, *rest)

    monkeypatch.setattr(versions.Change, "update", failing)
    with pytest.raises(RuntimeError):
        store.upsert_messages(spark, at, spark.createDataFrame([row("a", 1, "two"), row("b", 0, "other")], schema))
    monkeypatch.setattr(versions.Change, "update", kept)
    assert [r["content"] for r in store.table(spark, at, "messages").collect()] == ["one"] and store.table(spark, at, "sessions").count() == 1
    assert History(binding.stored(spark, at)).find("two").count() == 0
    # Two changes over one version: the second is done again over the first.
    first, second = versions.Change(spark, at), versions.Change(spark, at)
    frame = lambda i, s: spark.createDataFrame([(i, s)], "id long, status string")
    first.update("worktrees", frame(1, "active"), "id")
    second.update("worktrees", frame(2, "active"), "id")
    first.commit()
    with pytest.raises(versions.Conflict):
        second.commit()
    tried = []

    def do(change):
        tried.append(change.number)
        if len(tried) == 1:
            store.update_by_key(spark, at, "worktrees", frame(3, "passed"), "id")
        change.update("worktrees", frame(2, "active"), "id")

    store.changed(spark, at, do)
    assert len(tried) == 2 and {tuple(r) for r in store.table(spark, at, "worktrees").collect()} == {(1, "active"), (2, "active"), (3, "passed")}
    store.insert_by_key(spark, at, "worktrees", spark.createDataFrame([(3, "failed", "x"), (4, "new", "y"), (4, "newer", "z")], "id long, status string, note string"), "id", order="note")
    assert {tuple(r) for r in store.table(spark, at, "worktrees").where("id > 2").collect()} == {(3, "passed", None), (4, "new", "y")}
    # An older version is read as it was until it is cleared away.
    assert [r["content"] for r in before.tables["messages"].collect()] == ["one"]
    assert versions.vacuum(spark, at, keep=1) > 0 and store.table(spark, at, "worktrees").count() == 4 and store.table(spark, at, "messages").count() == 1


def test_all_kinds_of_transcripts_are_indexed(spark, tmp_path):
    at = f"file://{tmp_path}/tables"
    (tmp_path / "calls").mkdir(), (tmp_path / "editor").mkdir()
    transcript(tmp_path / "projects" / "-home-dev-shop", "s1", [("repair the checkout", "/shop/pay.py")])
    events = [{"timestamp": "2026-01-02T00:00:00Z", "type": "session_meta", "payload": {"id": "own-id", "cwd": "/home/dev/blog"}}, {"timestamp": "2026-01-02T00:00:01Z", "type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "write a feed"}]}}, {"timestamp": "2026-01-02T00:00:02Z", "type": "response_item", "payload": {"type": "function_call", "name": "read_file", "arguments": '{"file_path": "/blog/feed.py"}', "call_id": "c"}}]
    (tmp_path / "calls" / "rollout.jsonl").write_text("".join(json.dumps(e) + "\n" for e in events))
    (tmp_path / "editor" / "hook.jsonl").write_text(json.dumps({"hook_type": "afterFileEdit", "file_path": "/shop/ui.ts", "diff": "+x", "timestamp": "2026-01-03T00:00:00Z"}) + "\n")
    for folder, kind in (("projects", "chat"), ("calls", "calls"), ("editor", "editor")):
        assert store.index(spark, str(tmp_path / folder), at, kind=kind) == 1 and store.index(spark, str(tmp_path / folder), at, kind=kind) == 0
    tables = binding.stored(spark, at)
    assert {(r["session_id"], r["project"], r["message_count"]) for r in tables["sessions"].collect()} == {("s1", "-home-dev-shop", 3), ("own-id", "blog", 2), ("hook", None, 2)}
    assert {r["target"] for r in tables["artifacts"].collect()} == {"/shop/pay.py", "/blog/feed.py", "/shop/ui.ts"}
    assert {r["session_id"] for r in History(tables).find("feed OR ui").collect()} == {"own-id", "hook"}
