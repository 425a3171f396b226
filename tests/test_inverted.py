"""The stored index, search expressions and snippets against a full-text index, and the upkeep of the index."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from tessella.api import History
from tessella.operators import inverted, query_text, snippets, words
from tessella.plans import binding, extra

WORDS = ["alpha", "beta", "gamma", "delta", "alphabet", "Gammon", "naïve", "failing", "failed", "x1", "words", "word"]
EXPRESSIONS = [
    "alpha", "alpha beta", "alpha NOT beta", '"alpha beta"', "alp* OR delta", "alpha AND beta OR gamma", "alpha OR beta AND gamma", "alpha OR beta NOT gamma", "alpha beta NOT gamma delta", "(alpha OR beta) AND gamma", "alpha NOT (beta OR gamma)",
    '"alpha bet"*', '"alpha gam" *', "alpha + beta", '"..." alpha', '"..."', '"..." OR alpha', "user", '"beta user"', '"word failed"', "NAIVE", "alpha NOT beta NOT gamma", "gamma AND alpha NOT beta AND delta", '"words failing" OR x1', "fail*", "nowhere",
]


@pytest.fixture(scope="module", params=[False, True], ids=["words", "stems"])
def both(request, spark, tmp_path_factory):
    """A full-text index and ours over the same rows."""
    r, stems = random.Random(3), request.param
    rows = [(i, " ".join(r.choice(WORDS[: 6 + i % 7]) + r.choice(["", ".", ", ", "-"]) for _ in range(r.randrange(0, 25))), r.choice(["user", "assistant"])) for i in range(90)]
    rows += [(100, None, "user"), (101, "", None), (102, "delta alpha", None), (103, "beta gamma alphabet", "user")]
    con = sqlite3.connect(":memory:")
    con.execute(f"create virtual table t using fts5(content, role, tokenize='{'porter ' * stems}unicode61')")
    con.executemany("insert into t(rowid, content, role) values (?, ?, ?)", rows)
    kept, inverted.BLOCK = inverted.BLOCK, 16
    index = inverted.Inverted(spark, f"file://{tmp_path_factory.mktemp('index')}", ("content", "role"), stems)
    index.add(spark.createDataFrame(rows, "id long, content string, role string").repartition(3))
    yield con, index
    inverted.BLOCK = kept


@pytest.mark.parametrize("question", EXPRESSIONS)
def test_expressions_are_those_of_a_full_text_index(both, question):
    con, index = both
    want = dict(con.execute("select rowid, bm25(t) from t where t match ?", (question,)).fetchall())
    mine = {r["id"]: r["score"] for r in index.matching(question).collect()}
    assert mine.keys() == want.keys() and all(abs(mine[i] - s) < 1e-5 for i, s in want.items())


@pytest.mark.parametrize("terms", [["gamma", "gammon"], ["x1"], ["naive", "failing"], ["alpha", "nowhere"]])
@pytest.mark.parametrize("first", [1, 4])
def test_best_of_all_words(both, terms, first, monkeypatch):
    con, index = both
    monkeypatch.setattr(inverted, "FIRST", first)
    want = {i: s for i, s in con.execute("select rowid, bm25(t) from t where t match ?", (" ".join(terms),))}
    mine = index.best(terms, 5).collect()
    assert len(mine) == min(5, len(want)) and all(abs(want[r["id"]] - r["score"]) < 1e-5 for r in mine)
    assert [round(r["score"], 4) for r in mine] == [round(s, 4) for s in sorted(want.values())[:5]]


def test_only_the_buckets_of_the_words_are_read(both):
    _, index = both
    plan = index._rows(index._of("alpha"))._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:200] and "EqualTo(term,alpha)" in plan


def test_a_frequent_word_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "BLOCK", 8)
    docs = spark.createDataFrame([(i, f"alpha beta w{i % 7} " + "alpha " * (i % 5)) for i in range(800)], "id long, content string").repartition(4)
    answers, files = [], []
    for n, words_of_a_task in enumerate((10_000_000, 250)):
        monkeypatch.setattr(inverted, "TASK_WORDS", words_of_a_task)
        index = inverted.Inverted(spark, f"file://{tmp_path}/{n}", ("content",), stems=False)
        index.add(docs)
        rows = index._read("postings").where("term = 'alpha'").groupBy(F.input_file_name()).agg(F.sum("m").alias("m")).collect()
        files.append([r["m"] for r in rows])
        answers.append([sorted(map(tuple, x.collect())) for x in (index.best(["alpha", "w3"]), index.counts(), index.by_keywords(["alpha", "w3"]), index.matching('"alpha beta" NOT w1'))])
    assert answers[0] == answers[1] and len(files[0]) == 1 and len(files[1]) > 4 and sum(files[1]) == 800 and max(files[1]) < 320


def test_texts_are_not_shuffled_to_a_few_hits(spark, data):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = extra.decisions(spark, data)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_expressions_that_are_none():
    for text in ("", "alpha AND", "OR beta", "(alpha", "alpha)", "()", "alpha + ", "NOT alpha"):
        with pytest.raises(query_text.QuerySyntaxError):
            query_text.parsed(text)
    assert query_text.parsed("pay.py") == ("phrase", ["pay", "py"], False)


@pytest.mark.parametrize("stems", [False, True])
def test_snippets_are_those_of_a_full_text_index(stems):
    r = random.Random(5)
    vocabulary = ["alpha", "beta", "gamma", "delta", "Éta"] + [f"w{i}" for i in range(60)]
    texts = [r.choice(["", "(", "\n"]) + "".join(r.choice(vocabulary if r.random() < 0.3 else vocabulary[5:]) + r.choice([" ", " ", " ", ". ", ": ", ".\n  ", "- ", ".", "." + " " * 70]) for _ in range(r.randrange(1, 200))) for _ in range(200)]
    con = sqlite3.connect(":memory:")
    con.execute(f"create virtual table t using fts5(content, tokenize='{'porter ' * stems}unicode61')")
    con.executemany("insert into t(rowid, content) values (?, ?)", list(enumerate(texts)))
    for question in ("alpha", '"alpha beta" OR gamma', "alpha beta gamma", "alp* OR w1*", '"w1 w2"* OR eta', 'alpha OR "alpha beta" OR "beta gamma"'):
        phrases = [(found, begins) for _, found, begins in query_text.phrases(query_text.parsed(question, stems))]
        for size in (48, 10, 5):
            for i, want in con.execute(f"select rowid, snippet(t, 0, '>>>', '<<<', '...', {size}) from t where t match ?", (question,)):
                assert snippets.excerpt(texts[i], phrases, stems, size) == want
    assert snippets.excerpt("", [(["alpha"], False)]) == "" and snippets.excerpt("only this", [(["alpha"], False)]) == "only this"


def test_words_are_the_same_in_tasks_and_columns(spark):
    texts = ["Éclair NAÏVE straße Łódź", "a_b c-d 3.5 x²", "", "日本語 mixed ΣΑΣ"]
    found = spark.createDataFrame([(t,) for t in texts], "x string").select("x", words.tokens("x").alias("t")).collect()
    assert [(r["x"], words.split(r["x"])) for r in found] == [(r["x"], r["t"]) for r in found]


def test_upkeep(spark, tmp_path):
    index = inverted.Inverted(spark, f"file://{tmp_path}/search", ("content",), stems=False, span=100)
    assert index.segments() == [] and index.matching("alpha").count() == 0 and index.best(["alpha"]).count() == 0
    frame = lambda rows: spark.createDataFrame(rows, "id long, content string")
    index.add(frame([(100, "alpha beta"), (101, "alpha"), (200, "alpha gamma")]))
    index.add(frame([(100, "beta beta"), (300, "delta alpha")]))  # the first owner again, with less
    ids = lambda q: {r["id"] for r in index.matching(q).collect()}
    assert ids("alpha") == {200, 300} and ids("beta") == {100} and tuple(index.size().first()) == (3, 2.0)
    before = {q: sorted(map(tuple, index.matching(q).collect())) for q in ("alpha", "beta OR delta", '"delta alpha"')}
    assert {r["id"] for r in index.best(["alpha"]).collect()} == {200, 300} and {r["term"]: (r["n_docs"], r["n"]) for r in index.counts().collect()}["beta"] == (1, 2)
    assert not index.merge() and index.merge(1) and len(index.segments()) == 1
    assert before == {q: sorted(map(tuple, index.matching(q).collect())) for q in before}
    index.add(frame([(200, "")]))
    assert ids("alpha") == {300} and ids("gamma") == set()


def test_search_in_stored_tables(spark, tmp_path):
    from tests.test_store import transcript

    from tessella.sources import store

    logs, at = tmp_path / "projects", f"file://{tmp_path}/tables"
    transcript(logs / "-home-dev-shop", "s1", [("repair the checkout failures", "/shop/pay.py"), ("we decided on a queue because retries of the webhook were lost", "/shop/queue.py")])
    transcript(logs / "-home-dev-blog", "s2", [("repair the feed", "/blog/feed.py")])
    store.index(spark, str(logs), at)
    history = History(binding.stored(spark, at))
    found = history.find('repair AND (checkout OR feed) NOT "repair the feed"').collect()
    assert {(r["session_id"], r["project"]) for r in found} == {("s1", "-home-dev-shop")} and ">>>repair<<< the >>>checkout<<< failures" in found[0]["snippet"]
    assert {r["session_id"] for r in history.find("repairing", project="-home-dev-blog").collect()} == {"s2"}
    assert {r["role"] for r in history.find("check*", role="user").collect()} == {"user"}
    assert history.search("how did we repair it", limit=1).first()["session_id"] in ("s1", "s2")
    assert history.decisions().first()["beginning"].startswith("working on we decided")
    # A session that grows replaces its rows; segments are merged in time.
    for n in range(3):
        transcript(logs / "-home-dev-blog", "s2", [("write the feed", "/blog/feed.py"), *[(f"more of it {i}", "/blog/x.py") for i in range(n + 1)]])
        store.index(spark, str(logs), at)
    history = History(binding.stored(spark, at))
    assert history.find('"repair the feed"').count() == 0 and history.find('"write the feed"').count() == 2
    assert store.search_index(spark, at).merge(2) and History(binding.stored(spark, at)).find('"write the feed"').count() == 2


def test_the_latest_of_equal_hits_stay(spark):
    rows = [(i, "s", i, "user", f"the webhook again {'x ' * (i % 7)}", f"2026-01-{i:02d}", None) for i in range(1, 29)]
    messages = spark.createDataFrame(rows, "id long, session_id string, sequence long, role string, content string, timestamp string, tool_name string")
    sessions = spark.createDataFrame([("s", "p")], "session_id string, project string")
    found = History({"messages": messages, "sessions": sessions}).search("webhook", limit=3).collect()
    assert len(found) == 3 and [r["timestamp"] for r in found] == sorted((r["timestamp"] for r in found), reverse=True) and found[0]["timestamp"] == "2026-01-28"
