import sqlite3

from pyspark.sql import functions as F

from tessella.functions import rewrite, text
from tessella.operators import search, words


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column).first()[0]


def test_project_names(spark):
    cases = {"-home-user-Desktop-development-big-app": "big-app", "-home-user-Desktop-development": "development", "app": "app", "-home-user-x": "-home-user-x", "": ""}
    for raw, want in cases.items():
        assert one(spark, text.clean_project_name(F.col("x")), x=raw) == want


def test_prompts_and_sentences(spark):
    assert one(spark, text.project_of_prompt(F.col("x")), x="Primary working directory: /home/me/shop/\nmore") == "shop"
    assert one(spark, text.next_step_sentences(F.col("x")), x="Short next. We should now write the missing tests. Nothing here to see at all") == ["We should now write the missing tests"]
    assert one(spark, text.is_boilerplate(F.col("x")), x="  Thanks, done") is True
    assert one(spark, text.line_change(F.col("x"), F.col("y")), x="a\nb", y="c") == "+1/-2"


def test_rewriting(spark):
    say = lambda question, f: rewrite.answers(spark, question, f)
    assert say("Where do we log the deposit webhook failures?", rewrite.keywords) == ["log", "deposit", "webhook", "failures"]
    assert say("who was that", rewrite.keywords) == ["that", "who", "was"]
    assert rewrite.search_terms(spark, "a bug in Auth") == ["bug", "auth", "error", "fix", "broke", "broken", "fail", "authentication"]
    assert say("Remember when we moved the tables?", rewrite.recall_topic) == "moved the tables"
    assert say("So we did this before?", rewrite.recall_topic) == "before"
    assert say("please add a button", rewrite.recall_topic) is None
    assert say('dry-run "two words" ""', rewrite.quoted_query) == '"dry-run" "two words"'


def test_marks_are_folded(spark):
    assert one(spark, words.tokens("x"), x="Éclair NAÏVE straße Łódź") == ["eclair", "naive", "straße", "łodz"] and words.plain("Éclair") == "eclair"


def test_scores_are_those_of_a_full_text_index(spark):
    texts = ["alpha beta gamma", "alpha alpha delta and more words here", "beta only", "nothing of note", "gamma alpha beta beta"]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(content, tokenize='unicode61')")
    con.executemany("insert into t(rowid, content) values (?, ?)", list(enumerate(texts)))
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    for terms in (["delta"], ["beta", "gamma"], ["alpha"]):
        want = con.execute("select rowid, bm25(t) from t where t match ?", (" ".join(terms),)).fetchall()
        mine = {r["id"]: r["score"] for r in search.search(docs, terms, "content").collect()}
        assert mine.keys() == dict(want).keys()
        assert all(abs(mine[i] - s) < 1e-5 for i, s in want)


def test_stems_are_those_of_a_full_text_index(spark):
    texts = ["Relational databases were failing", "a failed relation of the database", "hopping ponies, generalizations", "the pony hopped generally", "naïve café owners owning"]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(content, tokenize='porter unicode61')")
    con.executemany("insert into t(rowid, content) values (?, ?)", list(enumerate(texts)))
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    for terms in (["fails", "database"], ["hop"], ["general"], ["owner"], ["cafes"]):
        want = dict(con.execute("select rowid, bm25(t) from t where t match ?", (" ".join(terms),)).fetchall())
        mine = {r["id"]: r["score"] for r in search.search(docs, terms, "content", stems=True).collect()}
        assert mine.keys() == want.keys() and all(abs(mine[i] - s) < 1e-5 for i, s in want.items())


def test_fusion_and_snippets(spark):
    a = spark.createDataFrame([(1, 1)], "id long, rank int")
    b = spark.createDataFrame([(2, 1), (1, 2)], "id long, rank int")
    assert [r["id"] for r in search.fused(a, b).collect()] == [1, 2]
    assert one(spark, search.snippet(F.col("x")), x="y" * 300) == "y" * 217 + "..."
