"""Writers of worktrees, cycles, checkpoints, calls and measures, and the plans over what they wrote."""

import json

import pytest

from tessella.api import History
from tessella.plans import binding
from tessella.sources import store, versions, worktrees


def test_from_a_worktree_to_its_results(spark, tmp_path):
    at, now = f"file://{tmp_path}/tables", "2026-02-01T00:00:00+00:00"
    assert worktrees.set_status(spark, at, spark.createDataFrame([(1, "passed")], "id long, status string")) == 0
    rows = [("fix/a", "repair a", "2026-02-01T00:00:10Z"), ("fix/b", None, None), ("fix/b", None, None)]
    # A column of a name that the running sums use, and an id that the store gives anew.
    made = worktrees.add_worktrees(spark, at, spark.createDataFrame([(*r, 7, 99) for r in rows], "branch_name string, task_description string, created_at string, before long, id long"), now)
    assert [(r["id"], r["branch_name"], r["base_branch"], r["status"]) for r in made.orderBy("id").collect()] == [(1, "fix/b", "main", "active"), (2, "fix/b", "main", "active"), (3, "fix/a", "main", "active")]
    more = worktrees.add_worktrees(spark, at, spark.createDataFrame([("fix/c",)], "branch_name string"), now)
    assert [r["id"] for r in more.collect()] == [4]
    worktrees.add_cycles(spark, at, spark.createDataFrame([(3, 2, "passed", "2026-02-01T00:01:00Z"), (3, 1, "failed", "2026-02-01T00:00:30Z"), (4, 1, None, None)], "worktree_id long, cycle_number long, outcome string, created_at string"), now)
    assert [(r["id"], r["worktree_id"], r["cycle_number"]) for r in store.table(spark, at, "cycles").orderBy("id").collect()] == [(1, 3, 1), (2, 3, 2), (3, 4, 1)]
    shas = [(3, "sha1", ["/a.py"], "2026-02-01T00:00:40Z"), (3, "sha2", ["/a.py", "/b.py"], "2026-02-01T00:00:50Z"), (4, "sha3", None, None)]
    worktrees.add_checkpoints(spark, at, spark.createDataFrame(shas, "worktree_id long, git_sha string, files array<string>, created_at string"), now)
    status = spark.createDataFrame([(3, "failed", "2026-02-01T00:01:30Z"), (3, "passed", "2026-02-01T00:01:50Z"), (4, "active", None), (77, "passed", None), (None, "passed", None)], "id long, status string, at string")
    assert worktrees.set_status(spark, at, status, now) == 2
    assert worktrees.set_status(spark, at, spark.createDataFrame([(3, "active")], "id long, status string"), now) == 1
    found = {r["id"]: r for r in store.table(spark, at, "worktrees").collect()}
    # The time of an earlier end stays, and nothing is made for an id that is not stored.
    assert set(found) == {1, 2, 3, 4} and found[3]["status"] == "active" and found[3]["resolved_at"] == "2026-02-01T00:01:50Z" and found[4]["resolved_at"] is None
    assert worktrees.set_variant(spark, at, spark.createDataFrame([(3, "a", None), (4, "b", '{"k":1}')], "id long, ab_variant_label string, ab_brief_metadata string")) == 2
    assert worktrees.set_variant(spark, at, spark.createDataFrame([(4, None, '{"k":2}')], "id long, ab_variant_label string, ab_brief_metadata string")) == 1
    history = History(binding.stored(spark, at))
    result = {r["id"]: r for r in history.ask("worktree_result").collect()}
    # From the worktree's making to its end, which is later than its cycles and checkpoints.
    assert (result[3]["duration_seconds"], result[3]["cycles"], result[3]["failures"], result[3]["snapshot_files"]) == (100, 2, 1, 2)
    assert result[1]["duration_seconds"] == 0 and result[4]["ab_variant_label"] == "b"
    assert {r["worktree_id"]: (r["id"], r["git_sha"]) for r in history.ask("latest_checkpoint").collect()} == {3: (2, "sha2"), 4: (3, "sha3")}
    assert worktrees.put_results(spark, at, history.ask("worktree_result")) == 4
    kept = {r["id"]: r for r in store.table(spark, at, "worktrees").collect()}
    assert json.loads(kept[3]["results_json"])["duration_seconds"] == 100 and kept[4]["ab_brief_metadata"] == '{"k":2}'


def test_what_is_refused_is_not_stored(spark, tmp_path):
    at = f"file://{tmp_path}/tables"
    with pytest.raises(ValueError, match="1 rows have no branch"):
        worktrees.add_worktrees(spark, at, spark.createDataFrame([("fix/a",), (None,)], "branch_name string"))
    with pytest.raises(ValueError, match="status"):
        worktrees.add_worktrees(spark, at, spark.createDataFrame([("fix/a", "done")], "branch_name string, status string"))
    with pytest.raises(ValueError, match="outcome"):
        worktrees.add_cycles(spark, at, spark.createDataFrame([(1, 1, "merged")], "worktree_id long, cycle_number long, outcome string"))
    with pytest.raises(ValueError, match="worktree"):
        worktrees.add_checkpoints(spark, at, spark.createDataFrame([(None, "sha")], "worktree_id long, git_sha string"))
    with pytest.raises(ValueError, match="status"):
        worktrees.set_status(spark, at, spark.createDataFrame([(1, None)], "id long, status string"))
    assert versions.version(spark, at)[0] == 0
    assert worktrees.add_worktrees(spark, at, spark.createDataFrame([], "branch_name string")).count() == 0


def test_calls_and_measures(spark, tmp_path):
    at = f"file://{tmp_path}/tables"
    calls = "id string, timestamp string, model string"
    worktrees.add_calls(spark, at, spark.createDataFrame([("c1", "t2", "late"), ("c1", "t1", "early"), ("c2", "t1", "x")], calls))
    worktrees.add_calls(spark, at, spark.createDataFrame([("c1", "t0", "again"), ("c3", "t3", "y")], calls))
    assert {(r["id"], r["model"]) for r in store.table(spark, at, "calls").collect()} == {("c1", "early"), ("c2", "x"), ("c3", "y")}
    frame = lambda rows: (spark.createDataFrame([(s, n) for s, n in rows], "session_id string, total_turns long"), spark.createDataFrame([(s, i) for s, n in rows for i in range(n)], "session_id string, turn long"))
    worktrees.put_metrics(spark, at, *frame([("s1", 3), ("s2", 1)]))
    worktrees.put_metrics(spark, at, *frame([("s1", 2)]))
    assert {tuple(r) for r in store.table(spark, at, "session_metrics").select("session_id", "total_turns").collect()} == {("s1", 2), ("s2", 1)}
    assert sorted(tuple(r) for r in store.table(spark, at, "turn_metrics").select("session_id", "turn").collect()) == [("s1", 0), ("s1", 1), ("s2", 0)]
