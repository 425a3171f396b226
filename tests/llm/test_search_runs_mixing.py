"""Ranked search, periodic runs and mixing against brute force on small fixtures, with nulls, empty and very long texts, ties, repeats, clashing columns and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import lexical, mixing, periodic_runs

SCHEMA = "doc_id long, text string, source string"
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute_ranked(rows, items, k=10):
    docs = [(i, Counter(w), len(w)) for i, t, *_ in rows if (w := terms_of(t))]
    total, words, df = len(docs), sum(n for *_, n in docs), Counter(t for _, c, _ in docs for t in c)
    out = set()
    by_item = {}
    for item, text in items:
        by_item.setdefault(item, Counter()).update(terms_of(text))
    for item, asked in by_item.items():
        scores = []
        for i, c, n in docs:
            m = 25 + 75 * n * total // words
            s = sum(q * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, q in asked.items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out |= {(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)} if item is not None else set()
    return out


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    common = [f"c{i}" for i in range(12)]
    rows = []
    for i in range(300):
        words = [r.choice(common) if r.random() < 0.7 else f"Wört{int(r.paretovariate(0.6)) % 500}" for _ in range(r.randrange(1, 120))]
        rows.append((i, " ".join(words) + ("!" if i % 3 else " 7-x"), "s"))
    rows += [(900 + i, rows[3][1], "s") for i in range(40)] + [(None, rows[5][1], "s"), (None, None, None), (950, "", "s"), (951, " .,- ", "s"), (7, rows[7][1], "s"), (952, "c1 " * 30_000, "s")]
    items = [(j, " ".join(rows[r.randrange(300)][1].split()[:25])) for j in range(12)] + [(50, rows[3][1]), (51, "nowhere at all"), (52, None), (53, ""), (None, "c1 c2"), (54, "c1 C1 c2"), (54, "c3"), (55, rows[5][1])]
    return rows, items


@pytest.mark.parametrize("seed, part, block", [(lexical.SEED, lexical.COMMON_PART, lexical.BLOCK), (1, 0.99, 700), (10**9, 0.0, 50)])
def test_ranked_search(spark, corpus, monkeypatch, seed, part, block):
    rows, items = corpus
    monkeypatch.setattr(lexical, "SEED", seed)
    monkeypatch.setattr(lexical, "COMMON_PART", part)
    monkeypatch.setattr(lexical, "BLOCK", block)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("term", F.lit("x")).withColumn("score", F.lit(1)).withColumn("item_id", F.lit(1))
    found = lexical.ranked(docs, spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)).withColumn("term", F.lit(0)))
    got = [tuple(r) for r in found.collect()]
    assert set(got) == brute_ranked(rows, items) and len(got) == len(set(got))


def test_ranked_search_by_shuffled_terms(spark, corpus, monkeypatch):
    rows, items = corpus
    monkeypatch.setattr(lexical, "FEW_TERMS", 0)
    found = lexical.ranked(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(str(i), t) for i, t in items if i is not None], "item_id string, text string"), 3)
    assert {tuple(r) for r in found.collect()} == {(str(i), *x) for i, *x in brute_ranked(rows, items, 3)}


def test_ranked_search_of_nothing(spark, corpus):
    rows, items = corpus
    docs, asked = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    assert lexical.ranked(docs.limit(0), asked).count() == 0 and lexical.ranked(docs, asked.limit(0)).count() == 0


def brute_runs(w):
    n, out = len(w), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            s = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            if i > s and i + p - s >= max(24, 3 * p):
                out.setdefault((s, i + p), p)
            i += 1
    return sorted((s, e - s, p) for (s, e), p in out.items())


def test_runs_equal_brute_force(monkeypatch):
    r = random.Random(2)
    for turn in range(600):
        monkeypatch.setattr(periodic_runs, "GRID", 40 if turn % 2 else 1 << 20)
        w = [r.randrange(r.choice([1, 2, 3, 30])) for _ in range(r.randrange(150))]
        for _ in range(r.randrange(3)):
            a, p = r.randrange(150), r.randrange(1, 30)
            for i in range(a + p, min(len(w), a + r.randrange(100))):
                w[i] = w[i - p]
        assert periodic_runs.runs_of(w) == brute_runs(w), w


def test_extensions():
    r = np.random.RandomState(4)
    for n, k in ((1, 1), (2, 1), (50, 2), (64, 1), (300, 3)):
        ids = r.randint(0, k, n)
        found = periodic_runs.Extensions(ids)
        pairs = [(a, b) for a in range(n + 1) for b in range(n + 1) if a != b]
        a, b = (np.array(x) for x in zip(*pairs))
        plain = [next((i for i in range(n) if max(x, y) + i >= n or ids[x + i] != ids[y + i]), n) for x, y in pairs]
        assert found.forward(a, b).tolist() == plain


def brute_digest(doc, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc is not None and (h := zlib.crc32(str(doc).encode())) % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    top = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    milli = None if top[0] is None else 1000 * top[1] // top[2]
    return (doc, len(runs), *top, milli, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_periodic_runs(spark):
    r = random.Random(9)
    rows = [(i, " ".join(f"w{r.randrange(40)}é" for _ in range(r.randrange(300))), "s") for i in range(150)]
    rows += [(1000, "x y\n" * 200 + "z " + "a b c\t" * 9, "s"), (1001, None, "s"), (1002, "", "s"), (1003, "\x0b \r", None), (None, "q " * 40, "s"), (5, rows[5][1], "s"), (5, rows[5][1], "s"), (1004, "a b " * 12 + "c " + "d e " * 12, "s"), (1005, "long " * 3000, "s")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"runs": F.lit(1), "collapsed": F.lit("x"), "n_words": F.lit(0)})
    found = [tuple(x) for x in periodic_runs.digest(periodic_runs.periodic_runs(docs, periodic_runs.planted)).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[-1])
    assert sorted(found, key=key) == sorted((brute_digest(i, t) for i, t, _ in rows), key=key)
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0
    own = {x["doc_id"]: x for x in periodic_runs.periodic_runs(docs).where("doc_id >= 1000").collect()}
    assert own[1004]["collapsed"] == "a b c d e" and [tuple(x) for x in own[1004]["runs"]] == [(0, 24, 2), (25, 24, 2)]


def brute_mixed(rows, weights, share, epochs):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    whole = {s: sum(size(t) for _, t, x in rows if x == s) for s in sources}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    target, full, left = {}, set(), share * sum(whole.values())
    while True:
        level = Fraction(left - epochs * sum(whole[s] for s in full)) / max(1, sum(weight[s] for s in sources if s not in full))
        above = {s for s in sources if s not in full and level * weight[s] > epochs * whole[s]}
        if not above:
            break
        full |= above
    for s in sources:
        target[s] = float(epochs * whole[s] if s in full else level * weight[s])
    return size, whole, target


@pytest.mark.parametrize("few", [100_000, 0])
def test_mixing(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW_SOURCES", few)
    r = random.Random(3)
    rows = [(i, "w " * r.randrange(200), r.choice("aaaaaabbcé")) for i in range(400)] + [(400, "x " * 40_000, "zz"), (401, None, "b"), (402, "", None), (None, "q r", None), (None, "q r", None), (7, "q r", None), (403, "", "only empty")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"size": F.lit("x"), "taken": F.lit(1), "key": F.lit(2), "copies": F.lit(0)})
    found = mixing.mixed(docs)
    got = found.collect()
    size, whole, target = brute_mixed(rows, mixing.WEIGHTS, Fraction(3, 2), 2)
    assert len(got) == len(rows) and found.columns == ["doc_id", "text", "source", "key", "copies", "size", "source_size", "target", "taken"]
    taken = Counter()
    for x in got:
        assert x["size"] == size(x["text"]) and x["source_size"] == whole[x["source"]] and abs(x["target"] - target[x["source"]]) < 1e-6
        assert 0 <= x["taken"] <= 2 * x["size"]
        taken[x["source"]] += x["taken"]
    assert all(abs(taken[s] - target[s]) <= (0.5 if s is not None else 2) for s in whole)
    # At most one row of a source is neither taken as often as its source allows nor once less.
    for s in "abcé":
        steps = Counter(Fraction(x["taken"], x["size"]) for x in got if x["source"] == s and x["size"])
        assert sum(n for step, n in steps.items() if step.denominator > 1) <= 1 and max(steps) - min(steps) <= 1
    again = mixing.mixed(docs.repartition(7, "text")).collect()
    assert sorted((str(x["doc_id"]), x["text"] or "", x["taken"]) for x in got) == sorted((str(x["doc_id"]), x["text"] or "", x["taken"]) for x in again)


def test_mixing_by_other_weights_and_of_nothing(spark):
    rows = [(i, "w " * 10, "abc"[i % 3]) for i in range(90)]
    docs = spark.createDataFrame(rows, SCHEMA)
    taken = {x["source"]: x["n"] for x in mixing.mixed(docs, (5, 1), 0.5, 1, "other").groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    assert taken == {"a": 205, "b": 41, "c": 205}
    assert mixing.mixed(docs.limit(0)).count() == 0 and mixing.mixed(docs.withColumn("text", F.lit(None).cast("string"))).agg(F.sum("taken")).first()[0] == 0


def test_running_sums(spark):
    rows = [(i * 7919 % 1000, i) for i in range(1000)]
    found = {x["a"]: x["before"] for x in mixing.running(spark.createDataFrame(rows, "a long, b long"), [F.col("a")], {"before": F.col("b")}).collect()}
    total = 0
    for a, b in sorted(rows):
        assert found[a] == total
        total += b


def test_tags_with_open_quotes_take_linear_time():
    import time

    from tessella.llm import html_text

    def tags(source):
        scanner, out, at = html_text.Tags(source), [], 0
        while at < len(source) and (m := scanner.next(at)):
            out.append(m[3:])
            at = m[1]
        return out

    began = time.perf_counter()
    for part in ('<a "', "<a title='", "<a ", "<a<a", "</", "<!-", "<!--", "<a x='\">\""):
        for end in ("", ">", '">', "'>"):
            tags(part * (1_000_000 // len(part)) + end)
    assert time.perf_counter() - began < 30
    assert tags('<a href="x>y" id=\'z\'>t</a><br/><!-- <b> --><p class="open>text</p>') == [("a", " href=\"x>y\" id='z'"), ("a", ""), ("br", "/"), ("", ""), ("p", ' class="open'), ("p", "")]
