import pytest

from tessella import api
from tessella.plans import binding


@pytest.fixture(scope="module")
def history(spark, data):
    """The test data's tables, kept in memory while these tests ask many questions of them."""
    bound = binding.bound(spark, data)
    tables = {name: bound[name].cache() for name in binding.TABLES}
    yield api.History(tables)
    for df in tables.values():
        df.unpersist()


def test_history(history):
    text = history.brief("-Users-dev-code-app1")
    assert "## Key files" in text and "## Dangerous files" in text
    assert history.enrichment("-Users-dev-code-app1").startswith("<project-history>")
    assert history.file_history("/src/mod1/f1.py")["reads"] > 0 and history.file_history("/none") is None
    assert history.search("how did the step failed with code", limit=5).count() > 0
    assert history.recall("add a button") is None
    # Filters by name may be left out.
    assert history.ask("artifacts_filter", project="", kind="").count() == 100 and {r["target"] for r in history.ask("artifacts_filter", project="", kind="", target="/src/mod1/f1.py").collect()} == {"/src/mod1/f1.py"}
    assert {r["project"] for r in history.ask("list_sessions", min_messages=0, of_project="-Users-dev-code-app1").collect()} == {"-Users-dev-code-app1"}
    assert set(history.insights()) >= {"tool_usage", "topics"}


def test_briefs_and_filters(history):
    import json

    project = "-Users-dev-code-app1"
    parts = json.loads(history.brief(project, form="json"))
    assert parts["project"] == project and len(parts["Key files"]) == 10 and parts["Last session"] and parts["Overview"][0]["sessions"] > 0
    assert "## Common errors" not in history.brief(project, slim=True) and history.brief_variant(project, "baseline") is None
    found = history.search("the step failed with code", role="user", limit=5).collect()
    assert found and {r["role"] for r in found} == {"user"}
    one = history.search("the step failed with code", session_id=found[0]["session_id"], limit=5).collect()
    assert {r["session_id"] for r in one} == {found[0]["session_id"]}
    assert history.precision("the step failed with code", {r["session_id"] for r in found}, k=5) <= 1.0 and history.precision("zzz qqq", set()) == 0.0
    assert history.hybrid(["step", "failed"], None, limit=4).count() == 4
    vector = [float(x) for x in history.tables["vectors"].first()["embedding"]]
    assert history.hybrid(["step"], vector, limit=4).count() >= 1


def test_renderers():
    assert api.bar(0.5, 4) == "██░░" and api.short_number(1234) == "1.2K" and api.sparkline([0, 7]) == "▁█" and api.sparkline([]) == ""


def test_reports(history):
    from tessella import reports

    found = reports.similar_history(history, "repair the order webhook")
    assert len(found["worktrees"]) == 5 and reports.similar_history(history, "a b")["errors"] == []
    one = history.tables["cycles"].first()["worktree_id"]
    assert "cycle" in reports.correction_brief(history, one)
    assert reports.compared(history, "e1", "e2").count() >= 1 and "messages" in reports.monitor(history)


def test_call_records_and_experiments(spark, tmp_path):
    import json

    from tessella.sources import calls

    request = json.dumps({"model": "m", "system": [{"text": "Working directory: /x/shop"}], "messages": [1, 2]})
    response = json.dumps({"usage": {"input_tokens": 1000, "output_tokens": 100}, "stop_reason": "end_turn", "content": [{"type": "tool_use", "name": "Read"}, {"type": "text", "text": "x"}]})
    rows = calls.call_records(spark.createDataFrame([("1", "t", request, response), ("2", "t", "{", None)], "id string, timestamp string, request string, response string")).orderBy("id").collect()
    r = rows[0]
    assert (r["model"], r["message_count"], r["cost_estimate_usd"], r["tools_used"], r["project"], r["stop_reason"]) == ("m", 2, 0.0225, '["Read"]', "shop", "end_turn")
    assert rows[1]["input_tokens"] == 0 and rows[1]["model"] is None
    (tmp_path / "a.json").write_text(json.dumps({"experimentId": "e1", "task": "t", "enriched": {"status": "passed", "durationMs": 80, "correctionCycles": 2}, "baseline": {"status": "passed", "duration_ms": 100}}))
    (tmp_path / "b.json").write_text(json.dumps({"experiment_id": "e2", "enriched_status": "failed", "baseline_status": "passed"}))
    found = {r["experiment_id"]: r for r in calls.experiments(spark, str(tmp_path / "*.json")).collect()}
    assert found["e1"]["outcome"] == "enriched_wins" and found["e1"]["duration_delta_pct"] == -20.0 and found["e1"]["enriched_cycles"] == 2
    assert found["e2"]["outcome"] == "baseline_wins"
    twice = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b")], "key string, at int, v string")
    assert calls.first_by_key(twice, "key", order="at").first()["v"] == "a" and calls.last_by_key(twice, "key", order="at").first()["v"] == "b"
