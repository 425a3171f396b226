"""The corpus operators against brute force on small fixtures, with nulls, empty and very long texts, ties, repeats, clashing columns and empty tables."""

import base64
import datetime
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import components, decontaminate, fingerprints, html_text, jaccard, line_dedup, pseudonyms, quality, sentencepieces, sharding, token_files

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed, k=400):
    r = random.Random(seed)
    return [f"w{r.randrange(k)}é" if r.random() < 0.1 else f"w{r.randrange(k)}" for _ in range(n)]


def table(spark, texts, schema=SCHEMA):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], schema)


@pytest.fixture(scope="module")
def texts():
    base = words(200, 1)
    near = base[:100] + ["new"] + base[100:]
    far = [w if i % 5 else "x" + w for i, w in enumerate(base)]
    chain = near[:50] + ["other"] + near[50:]
    rows = [(0, " ".join(base)), (1, " ".join(near)), (2, " ".join(far)), (3, " ".join(base)), (4, None), (5, ""), (6, " \n\t"), (7, "One two"), (8, "one TWO"), (9, " ".join(chain)), (10, "word " * 30000), (11, " ".join(words(300, 2)))]
    many = words(60, 3)
    for i in range(150):  # a group of near copies that no single tile holds
        w = list(many)
        for j in range(i % 5):
            w[(7 * i + 11 * j) % len(w)] = f"edit{i}_{j}"
        rows.append((100 + i, " ".join(w)))
    return rows


def brute_components(rows, width, num, den):
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = frozenset(zip(*(w[k:] for k in range(width)))) if len(w) >= width else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {(i, len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("width, num, den", [(3, 90, 100), (5, 80, 100)])
def test_jaccard(spark, texts, width, num, den):
    found = jaccard.jaccard_components(table(spark, texts), width, num, den)
    assert {tuple(r) for r in found.collect()} == brute_components(texts, width, num, den)


def test_jaccard_in_small_tiles(spark, texts, monkeypatch):
    monkeypatch.setattr(jaccard, "SETS", 16)
    monkeypatch.setattr(jaccard, "LEAST_TILE", 4)
    monkeypatch.setattr(jaccard, "TILE", 20)
    monkeypatch.setattr(jaccard, "POINTS", 16)
    monkeypatch.setattr(jaccard, "COMMON", 3)
    found = jaccard.jaccard_components(table(spark, texts), 3, 90, 100)
    assert {tuple(r) for r in found.collect()} == brute_components(texts, 3, 90, 100)


def test_jaccard_of_nothing_and_null_ids(spark):
    assert jaccard.jaccard_components(table(spark, []), 3, 90, 100).count() == 0
    rows = [(None, "a b c d"), (3, "a b c d"), (None, "x y z"), (3, "a b c d")]
    found = jaccard.jaccard_components(table(spark, rows).withColumn("node", F.lit(0)).withColumn("n", F.lit("n")), 3, 90, 100).collect()
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in found if r["component_id"]) == [(-1, 2, 3), (3, 2, 3), (3, 2, 3)]
    assert [r["n_shingles"] for r in found if r["component_id"] is None] == [1]


def test_jaccard_through_shared_and_null_ids(spark):
    a, b = words(200, 31), words(200, 32)
    near = lambda w, k: " ".join([*w[:k], "new", *w[k:]])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (1, near(a, 50)), (2, near(b, 50)), (None, near(a, 90)), (7, near(near(a, 90).split(), 120)), (5, ""), (8, "x y z"), (8, "x y z"), (8, None)]
    found = jaccard.jaccard_components(table(spark, rows), 3, 90, 100).collect()
    assert {(r["doc_id"], r["n_shingles"] > 0, r["component_id"]) for r in found} == {(5, True, 1), (1, True, 1), (2, True, 1), (None, True, 1), (7, True, 1), (5, False, 5), (8, True, 8), (8, False, 8)}
    assert len(found) == len(rows)


def test_jaccard_of_a_repeated_row_and_long_texts(spark):
    long = words(40_000, 41, 10**6)
    rows = [(4, "one two three four five")] * 300 + [(2, " ".join(long)), (3, " ".join([*long[:9], "new", *long[9:]])), (9, "one two three four five")]
    found = {tuple(r) for r in jaccard.jaccard_components(table(spark, rows), 3, 90, 100).collect()}
    assert found == {(4, 3, 4), (9, 3, 4), *((i, n, 2) for i, n, _ in brute_components(rows[-3:-1], 3, 90, 100))}


@pytest.mark.parametrize("m", [500, 1000, 2000])
@pytest.mark.parametrize("sizes", ["one", "several"])
def test_edges_of_a_bucket_are_fewer_than_its_members(spark, m, sizes):
    base = [f"w{i}" for i in range(90)]
    texts = [" ".join(base[: i % 90] + [f"edit{i}"] + base[i % 90 + 1 :] + ["more"] * (sizes == "several" and i % 3)) for i in range(m)]
    sets = [jaccard.shingles(t.encode(), 3) for t in texts]
    rows = [(1, jaccard.set_key(s), len(s), None, jaccard.packed(jaccard.point_of(s))) for s in sets]
    frame = spark.createDataFrame(rows, "token long, node binary, n long, label binary, point binary")
    edges = jaccard.bucket_edges(frame.drop("point"), frame.select("node", "point"), 80, 100)
    # Sets of one size are one bucket; of several sizes, each set is in at most two.
    assert edges.count() <= (m - 1 if sizes == "one" else 2 * (m - 1))
    assert jaccard.components(edges).select("label").distinct().count() == 1


@pytest.mark.parametrize("num, den", [(80, 100), (90, 100)])
def test_linked_sizes_share_a_bucket(spark, num, den):
    members = spark.createDataFrame([(1, bytes([0, n // 256, n % 256]), n, None) for n in range(1, 1500)], "token long, node binary, n long, label binary")
    found = {}
    for r in jaccard.sized(members, num, den).collect():
        found.setdefault(r["n"], set()).add(r["bucket"])
    for n in range(1, 1500):
        for other in range(n, min(1499, n * den // num) + 1):
            assert found[n] & found[other], (n, other)


def test_boxes_never_lose_a_pair():
    r = np.random.RandomState(3)
    base = np.unique(r.randint(0, 2**62, 400).astype(np.uint64))
    sets = [np.unique(np.concatenate([r.choice(base, int(r.randint(150, 390)), replace=False), r.randint(0, 2**62, 9).astype(np.uint64)])) for _ in range(60)]
    parts = [list(range(k, 60, 12)) for k in range(12)]
    boxes = [jaccard.box_of([jaccard.point_of(sets[i]) for i in p], np.array([len(sets[i]) for i in p])) for p in parts]
    low, high, side = np.array([b[1] for b in boxes]), np.array([b[2] for b in boxes]), np.zeros(12, dtype=int)
    labels = jaccard.boxes_admitted([b[0] for b in boxes], low, high, np.arange(12), side, False, 80, 100)
    for x in range(12):
        for y in range(x):
            if any(jaccard.is_link(sets[i], sets[j], 80, 100) for i in parts[x] for j in parts[y]):
                assert labels[x] == labels[y]


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, shape):
    r = random.Random(5)
    edges = {"path": [(i, i + 1) for i in range(300)], "star": [(900, i) for i in range(300)], "random": [(r.randrange(400), r.randrange(400)) for _ in range(250)], "none": [(1, 1)]}[shape]
    found = {x["node"]: x["label"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[root(a)] = root(b)
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    assert set(found) == set(nodes) and all(found[x] in nodes and root(found[x]) == root(x) for x in nodes)
    assert len(set(found.values())) == len({root(x) for x in nodes})


def test_bound_never_loses_a_link():
    r = np.random.RandomState(0)
    base = np.unique(r.randint(0, 2**62, 300).astype(np.uint64))
    sets = [np.sort(np.concatenate([r.choice(base, 290, replace=False), r.randint(0, 2**62, k).astype(np.uint64)])) for k in range(0, 40)]
    sizes = np.array([len(s) for s in sets])
    tree = jaccard.CountTree(np.stack([jaccard.counts(s, 64) for s in sets]), sizes, 90, 100)
    for a in range(len(sets)):
        partners = set(tree.partners(a).tolist())
        for b in range(a + 1, len(sets)):
            both = len(np.intersect1d(sets[a], sets[b]))
            assert 100 * both < 90 * (sizes[a] + sizes[b] - both) or b in partners


def brute_lines(rows):
    places = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        lines = [x.strip(" \t\r") for x in (t or "").split("\n")] if t is not None else []
        for k in range(len(lines) - 2):
            if any(lines[k : k + 3]):
                places.setdefault(tuple(lines[k : k + 3]), []).append((i, k))
    gone = {(i, k + j) for v in places.values() for i, k in v[1:] for j in range(3)}
    return {(i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) if any(g[0] == i for g in gone) else t) for i, t in rows}


def test_line_dedup(spark):
    rows = [(1, "a\nb\nc\nd\ne"), (2, "x\nb \nc\n d\ny\nz"), (3, "q\nq\nq\nq\nq\nq"), (4, "a\nb"), (5, None), (6, ""), (7, "\n\n\n\n\n"), (8, "\n\n\n\n\n"), (9, "a\nb\nc\nd\ne"), (10, "line\n" * 5000), (11, "c\nd\ny\nz\nu")]
    found = line_dedup.line_dedup(table(spark, rows).withColumn("row_hash", F.lit(1)).withColumn("n_lines", F.lit("old")))
    assert {(r["doc_id"], r["text"]) for r in found.collect()} == brute_lines(rows)
    assert {r["n_removed"] for r in found.where("doc_id = 9").collect()} == {5} and found.where("doc_id = 5").first()["n_lines"] == 0
    twice = line_dedup.line_dedup(table(spark, [(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc")]))
    assert {(r["doc_id"], r["text"]) for r in twice.collect()} == {(None, "a\nb\nc"), (1, "")}
    assert line_dedup.line_dedup(table(spark, [])).count() == 0


def test_decontamination(spark):
    item = "One two THREE four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([("1", item, 0), ("2", "short one", 0), ("3", None, 0), (None, item, 0), ("4", "", 0)], "item_id string, text string, n_words int")
    rows = [(1, "x one, two-three four five six seven eight nine ten! y"), (2, "one two three four five six seven eight nine x ten"), (3, None), (4, ""), (5, "a short ONE b short"), (6, ("pad " * 20000) + item), (7, item + " " + item), (7, item + " " + item)]
    docs = table(spark, rows)

    def brute(text):
        cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        w, hit, items = cut(text), set(), set()
        for i, t in (("1", item), ("2", "short one")):
            x = cut(t)
            size = min(10, len(x))
            for win in {tuple(x[k : k + size]) for k in range(len(x) - size + 1)}:
                for k in range(len(w) - size + 1):
                    if tuple(w[k : k + size]) == win:
                        hit |= set(range(k, k + size))
                        items.add(i)
        return len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)

    for few in (decontaminate.FEW_WORDS, 0):  # the index that is sent, and the shuffled join
        found = decontaminate.digest(decontaminate.contamination(docs.withColumn("row_hash", F.lit("x")).withColumn("word", F.lit("y")), bench, few_words=few)).collect()
        assert sorted(tuple(r) for r in found) == sorted((i, *brute(t)) for i, t in rows)
    none = decontaminate.digest(decontaminate.shuffled(docs.select("doc_id", "text"), bench.limit(0), 10)).collect()
    assert len(none) == len(rows) and not any(r["contaminated"] for r in none)
    none = decontaminate.digest(decontaminate.contamination(docs, bench.limit(0))).collect()
    assert len(none) == len(rows) and not any(r["contaminated"] for r in none)
    assert decontaminate.contamination(table(spark, []), bench).count() == 0


def test_quality(spark, data):
    docs, labels = spark.read.parquet(f"{data.replace('0.001', '0.1')}/documents.parquet"), spark.read.parquet(f"{data.replace('0.001', '0.1')}/labels.parquet")
    found = quality.scored(docs, quality.train(docs, labels)).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    rows = found.select("score", "predicted", "quality").collect()
    good, bad = [r["predicted"] for r in rows if r["quality"] == 1], [r["predicted"] for r in rows if r["quality"] == 0]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.1
    order = sorted(rows, key=lambda r: r["score"])
    ranks = sum(i for i, r in enumerate(order, 1) if r["quality"] == 1)
    assert (ranks - len(good) * (len(good) + 1) / 2) / (len(good) * len(bad)) > 0.99


def test_quality_edges(spark):
    docs = table(spark, [(1, None), (2, ""), (3, "fine"), (3, "fine")]).withColumn("score", F.lit("old"))
    labels = spark.createDataFrame([(3, 1), (None, 0), (2, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    rows = quality.scored(docs, model).collect()
    assert len(rows) == 4 and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
    assert quality.scored(table(spark, []), model).count() == 0
    assert quality.Model(b"", b"", (0.0, 0.0), 0.0).score(b"x") == 0.5


def test_quality_of_long_texts(spark):
    rows = [(i, " ".join(f"{'good' if i % 2 else 'bad'}{(i * 7 + k) % 90}" for k in range(4000))) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    picked, counts = quality.sample(table(spark, rows), labels)
    assert len(picked) == sum(counts.values()) > 20 and {t.decode() for _, t in picked} <= {t for _, t in rows}
    model = quality.fit(picked, counts)
    assert any(model.weights) and model.score(rows[1][1].encode()) > 0.5 > model.score(rows[0][1].encode())
    some, _ = quality.sample(table(spark, rows), labels, most_bytes=100_000)
    assert 2 <= len(some) < len(picked) and {y for y, _ in some} == {0, 1} and len(quality.sample(table(spark, rows), labels, most_bytes=1)[0]) == 2


def test_length_alone_says_nothing_of_quality(spark, data):
    folder = data.replace("0.001", "0.1")
    model = quality.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    assert len(model.good) <= quality.DICTIONARY and len(model.bad) <= quality.DICTIONARY
    slope, bias = model.weights
    for n in (10, 1000, 100_000):  # a difference of the dictionaries' own bias
        z = (-bias / slope * n / (n + quality.NEUTRAL), n / (n + quality.NEUTRAL))
        assert abs(slope * z[0] + bias * z[1]) < 1e-9
    # Held-out texts cut to one length are told apart as well.
    held = spark.read.parquet(f"{folder}/documents.parquet").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("length(text) > 600 and crc32(cast(doc_id as string)) % 5 = 0")
    rows = [(model.score(r["text"][:600].encode()), r["quality"]) for r in held.collect()]
    good, bad = [s for s, y in rows if y], [s for s, y in rows if not y]
    assert len(bad) > 20 and sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad)) > 0.95


def test_html(spark):
    page = '<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><nav><a href=x>Menu</a></nav><header>Site</header><div class="content post-17"><h1>Head &amp; more</h1><p>First <b>bold</b>ly&nbsp; and\n on. It is a long paragraph of text.<br>After<p>Second one is also long enough.</p><div class="ad-box">Buy</div><form>F</form><aside>A</aside><script>var a="</p>";</script><!-- c --><div id="comments"><p>Reader says a lot of things here, more than all the others did, and more, and more.</p></div></div><div class="cookie-notice">C</div><footer>F</footer>'
    other = page.replace("post-17", "post-4").replace("First", "Other")
    short = '<html><body class="has-sidebar"><div class="content post-9"><p>Tiny.</p></div><div class="x"><p>A longer text that is elsewhere on this page, and only here it is.</p></div></body>'
    rows = [(1, "http://a.org/1", page), (2, "https://user@A.org:80/2", other), (3, "http://a.org/3", short), (4, None, None), (5, "bad", ""), (6, "http://b.org", "just text &lt;here"), (7, "http://c.org", "<p" + "<" * 5000 + "<p>x</p>"), (8, "http://c.org", '<div class="a' * 300 + "<p>y</p>")]
    found = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))).collect()}
    assert found[1] == "Head & more First boldly and on. It is a long paragraph of text. After Second one is also long enough."
    assert found[2] == found[1].replace("First", "Other") and found[3] == "Tiny."
    assert found[4] == found[5] == "" and found[6] == "just text <here"
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_in_parts(spark):
    say = lambda word, n: f"{word} " * n
    sections = lambda a, b: f"<body><nav><a href=x>Menu</a></nav><article><h1>A heading of thirty letters or so</h1><section class=a><p>{say('one', a)}</section><section class=b><p>{say('two', b)}</section></article><div class=footer>F</div>"
    parts = f"<body><h1>Title</h1><div class=text><p>{say('one', 90)}</div><ul><li><a href=x>Link</a></ul><div class=text><p>{say('two', 3)}</div>"
    cells = f"<body><table><tr><td><p>{say('one', 90)}</td><td><a href=x>Link</a></td></tr><tr><td><p>{say('two', 60)}</td></tr></table>"
    rows = [(1, "http://s.org/1", sections(150, 100)), (2, "http://s.org/2", sections(300, 2)), (3, "http://s.org/3", sections(100, 100)), (4, "http://p.org/1", parts), (5, "http://t.org/1", cells)]
    found = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for page, a, b in ((1, 150, 100), (2, 300, 2), (3, 100, 100)):
        assert found[page] == f"A heading of thirty letters or so {say('one', a)}{say('two', b)}".strip()
    assert found[4] == f"Title {say('one', 90)}{say('two', 3)}".strip()
    assert found[5].split().count("one") == 90 and found[5].split().count("two") == 60


def test_html_in_containers_named_like_noise():
    body = "A paragraph of the article that is long enough to be its main text. " * 5
    text = lambda source: html_text.Page(source).main(None)
    for name in ("post category-advertising", "tag-social", "share-enabled", "side-by-side", "search-results"):
        page = f'<body><nav><a href=x>Menu</a></nav><div class="{name}"><p>{body}</p><div class="share-buttons">Share it</div></div><div class="page-footer">Small print</div></body>'
        assert text(page) == body.strip(), name
        parts = f'<body><div class=all>{"".join(f"""<div class="{name}"><p>{i} {body}</p></div>""" for i in range(8))}</div></body>'
        assert text(parts).count("its main text") == 40, name
    # Whole words and known forms stay noise, also where they hold most text; the largest is taken where nothing else is left.
    assert text(f'<body><div class=post><p>Short article.</p></div><div class="comment-list"><p>{body}</p></div></body>') == "Short article."
    assert text(f'<body><ul><li><a href=x>Link</a></ul><div class="promo"><p>{body}</p></div><div class="cookie-notice">C</div></body>') == body.strip()
    assert text('<body><div class="site-nav"><a href=x>Menu</a></div><p>Text.</p></body>') == "Text."


def test_html_of_markup_that_names_noise_otherwise():
    body = "A paragraph of the article that is long enough to be its main text. " * 5
    talk = "<p>A reader says something here.</p>" * 4
    text = lambda source: html_text.Page(source).main(None)
    for name in ("userComments", "cmt-list", "more-stories related", "kommentare", "seitenleiste", "post-comments"):
        assert text(f'<body><div class="text"><p>{body}</p><div class="{name}">{talk}</div></div></body>') == body.strip(), name
    assert text(f"<body><form action=x><article><h1>Head</h1><p>{body}</p></article></form></body>") == f"Head {body.strip()}"
    assert text(f'<article><h1>T</h1><div class="search-results-study notice-of-ruling"><p>{body}</p></div></article>') == f"T {body.strip()}"


def test_html_of_what_a_host_repeats(spark):
    say = lambda i: f"Story {i} tells of things that no other page has, at some length and in its own words. " * 3
    page = lambda i, also="": f"<body><div class=zone><span class=k9>All rights are with the owners of this site and nobody else.</span></div><div class=body><p>{say(i)}</p>{also}</div><div class=zone><p class=q>Call us at any time of the day, we are here for you.</p></div></body>"
    rows = [(i, "http://n.org/x", page(i)) for i in range(6)] + [(9, "http://n.org/9", page(9, "<p class=q>Call</p>"))]
    copies = [(100 + i, "http://copies.org/x", f"<body><div class=body><p>{say(77)}</p></div></body>") for i in range(8)]
    found = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows + copies, "page_id long, url string, html string")).collect()}
    assert all(found[i] == say(i).strip() for i in range(6)) and all(found[100 + i] == say(77).strip() for i in range(8))


def test_html_of_deep_and_wide_pages_is_linear():
    import resource
    import time

    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    assert html_text.Page("<div>" * 200_000 + "deep").main(None) == "deep"
    assert html_text.Page("<span>x" * 100_000 + "</b>" * 100_000).main(None).count("x") == 100_000
    assert html_text.Page("<table>" + "<tr><td>cell of text</td></tr>" * 20_000).main(None).count("cell") == 20_000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000 and time.time() - began < 60


def plain_map(shards, slots):
    """Shards of slots by the rule said plainly: each new shard takes its share, one by one from the shard with most slots (of equals the least), first those that a hash of slot and count puts first."""
    owner = [0] * slots
    for count in range(2, shards + 1):
        moved = set()
        for _ in range(slots // count):
            sizes = {k: sum(o == k for s, o in enumerate(owner) if s not in moved) for k in range(count - 1)}
            fullest = min(sizes, key=lambda k: (-sizes[k], k))
            moved.add(min((s for s, o in enumerate(owner) if o == fullest and s not in moved), key=lambda s: int.from_bytes(hashlib.sha256(f"{s}:{count}".encode()).digest()[:8])))
        owner = [count - 1 if s in moved else o for s, o in enumerate(owner)]
    return owner


@pytest.mark.parametrize("part_rows", [100_000, 7])
def test_sharding(spark, monkeypatch, tmp_path, part_rows):
    monkeypatch.setattr(sharding, "PART_ROWS", part_rows)
    rows = [(i, "t" * (i % 50)) for i in range(600)] + [(None, None), (None, ""), *[(7, "again")] * 50, (8, "long " * 50_000)]
    path = f"file://{tmp_path}/map"
    docs = table(spark, rows).withColumn("shard", F.lit("s")).withColumn("row", F.lit("r"))
    found = sharding.assigned(docs, 6, slots=64, path=path).collect()
    place = {r["i"]: r["s"] for r in spark.createDataFrame([(i,) for i in {r[0] for r in rows}], "i long").select("i", sharding.slot_of(F.col("i"), 64).alias("s")).collect()}
    owner, more = plain_map(6, 64), plain_map(7, 64)
    want = [(str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), owner[place[i]], more[place[i]], place[i]) for i, t in rows]
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"], r["shard"], r["grown_shard"], r["virtual_slot"]) for r in found) == sorted(want)
    for s in range(6):
        mine = sorted(r["slot"] for r in found if r["shard"] == s)
        assert mine == list(range(len(mine)))
    held = {v: sum(n for _, n, *_, slot in want if slot == v) for v in set(place.values())}
    assert all(r["slot_bytes"] == held[r["virtual_slot"]] for r in found)
    assert sharding.load_map(spark, path, 1) == owner and sharding.load_map(spark, path) == more
    assert spark.read.parquet(path).where("version = 2").count() == 64 // 7
    assert sharding.assigned(table(spark, []), 40).count() == 0


def test_slot_maps(spark, tmp_path):
    owner = sharding.first_map(40)
    more = sharding.grown(owner, 41)
    assert sharding.first_map(41) == more and sum(a != b for a, b in zip(owner, more)) == sharding.SLOTS // 41
    share = [owner.count(s) for s in range(40)]
    assert max(share) - min(share) <= 2
    sizes = [1000 if s % 97 == 0 else 10 for s in range(sharding.SLOTS)]
    load = lambda o: [sum(z for z, s in zip(sizes, o) if s == k) for k in range(40)]
    even = sharding.rebalanced(owner, sizes)
    assert max(load(even)) <= max(1.02 * sum(sizes) / 40, 0) + 1000 and max(load(even)) <= max(load(owner))
    path = f"file://{tmp_path}/map"
    with pytest.raises(Exception):
        sharding.store_map(spark, path, 2, more)
    sharding.store_map(spark, path, 1, owner)
    sharding.store_map(spark, path, 2, more)
    found = sharding.records(table(spark, [(i, "x" * (i % 300)) for i in range(2000)]))
    totals = sharding.slot_bytes(sharding.slot_totals(found))
    assert sum(totals) == sum(16 + i % 300 for i in range(2000))
    third = sharding.rebalanced(more, totals)
    sharding.store_map(spark, path, 3, third)
    assert [sharding.load_map(spark, path, v) for v in (1, 2, 3)] == [owner, more, third] and sharding.load_map(spark, path) == third
    with pytest.raises(ValueError):
        sharding.store_map(spark, path, 3, owner)


def plain_pair(key, kind, a, b, sizes):
    """The permutation of a pair, in plain Python."""
    move = lambda r, other: int(hashlib.sha256(f"{key}|{kind}|{r}|{other}".encode()).hexdigest()[:8], 16)
    for r in range(1, 9):
        if r % 2:
            a = (a + move(r, b)) % sizes[0]
        else:
            b = (b + move(r, a)) % sizes[1]
    return a, b


def plain_digits(key, kind, d):
    k = len(d) // 2
    a, b = plain_pair(key, f"{kind}{len(d)}", int(d[:k]), int(d[k:]), (10**k, 10 ** (len(d) - k)))
    return f"{a:0{k}}{b:0{len(d) - k}}"


def luhn(d):
    return sum(x - 9 if x > 9 else x for x in (int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(d)))) % 10


def test_pseudonyms_link_equal_values_and_agree_with_plain_python(spark):
    rows = ["4417 7442 8035 1547", "4417744280351547", "4417-7442-8035-1547", "(555) 123-4567", "555-123-4567", "555.123.4567", "123-45-6789", "97.51.17.173", "2024-02-29", "2024/02/29"]
    got = [r["text"] for r in pseudonyms.pseudonymised(table(spark, list(enumerate(rows))), "k").orderBy("doc_id").collect()]
    bare = [re.sub(r"\D", "", t) for t in got]
    assert len(set(bare[:3])) == len(set(bare[3:6])) == 1 and [re.sub(r"\d", "0", t) for t in got] == [re.sub(r"\d", "0", t) if i != 7 else re.sub(r"\d", "0", got[7]) for i, t in enumerate(rows)]
    body = plain_digits("k", "card", "441774428035154")
    assert bare[0][:15] == body and luhn(bare[0]) == 0 and bare[3] == plain_digits("k", "phone", "5551234567")
    a, b = plain_pair("k", "ssn", 122 * 99 + 44, 6788, (898 * 99, 9999))
    area = a // 99 + (2 if a // 99 >= 665 else 1)
    assert got[6] == f"{area:03}-{a % 99 + 1:02}-{b + 1:04}"
    a, b = plain_pair("k", "ip", 97 * 256 + 51, 17 * 256 + 173, (65536, 65536))
    assert got[7] == f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    place = (datetime.date(2024, 2, 29) - datetime.date(1900, 1, 1)).days
    a, b = plain_pair("k", "date", place // 365, place % 365, (200, 365))
    assert got[8] == str(datetime.date(1900, 1, 1) + datetime.timedelta(days=a * 365 + b)) == got[9].replace("/", "-")
    with pytest.raises(ValueError):
        pseudonyms.pseudonymised(table(spark, []), "")


def test_pseudonyms_stay_in_their_format(spark):
    r = random.Random(8)
    numbers = sorted({f"{r.choice([x for x in range(1, 900) if x != 666]):03}-{r.randrange(1, 100):02}-{r.randrange(1, 10000):04}" for _ in range(3000)} | {"001-01-0001", "899-99-9999", "665-99-9999", "667-01-0001"})
    new = [r["v"] for r in spark.createDataFrame([(x,) for x in numbers], "v string").select(pseudonyms.ssn(F.col("v"), "k").alias("v")).collect()]
    assert len(set(new)) == len(numbers) and all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}", x) for x in new)


def test_pseudonyms_of_texts_that_repeat_labels(spark):
    rows = [(1, "a@b" + ".c" * 500_000 + ".com"), (2, "x" * 300 + "@" * 300_000), (3, "a@b" + ".1" * 300_000), (4, "Mail a.b@c-d.example.org. Or e@f.gh.9, not g@h.i"), (5, "k@x.m3.example.com")]
    by = {r["doc_id"]: r for r in pseudonyms.pseudonymised(table(spark, rows), "k").collect()}
    assert by[1]["n_private"] in (0, 1) and by[2]["n_private"] == by[3]["n_private"] == 0
    assert re.fullmatch(r"Mail \w\.\w@\w-\w\.\w{7}\.org\. Or \w@\w\.gh\.9, not g@h\.i", by[4]["text"]) and "a.b@" not in by[4]["text"]
    assert by[5]["n_private"] == 1 and by[5]["text"].endswith(".com")


def brute_sketch(spark, texts):
    """whole and hashes of each text, by plain Python over hashes that Spark gives one at a time."""
    one, three = {}, {}
    cut = lambda t: [w for w in re.split("[ \t-\r]+", t or "") if w]
    every = sorted({w for t in texts for w in cut(t)})
    one = {r["w"]: r["h"] for r in spark.createDataFrame([(w,) for w in every or ["x"]], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    runs = sorted({run for w in map(cut, texts) for run in zip(w, w[1:], w[2:])})
    frame = spark.createDataFrame([(*r, *(one[w] for w in r)) for r in runs] or [("", "", "", 0, 0, 0)], "a string, b string, c string, x long, y long, z long")
    three = {(r["a"], r["b"], r["c"]): r["h"] for r in frame.select("a", "b", "c", F.xxhash64("x", "y", "z").alias("h")).collect()}
    short = {t: [one[w] for w in cut(t)] for t in texts if 0 < len(cut(t))}
    whole = {r["t"]: r["h"] for r in spark.createDataFrame(list(short.items()) or [("", [0])], "t string, v array<bigint>").select("t", F.xxhash64("v").alias("h")).collect()}
    out = {}
    for t in texts:
        w = cut(t)
        found = {three[tuple(w[k : k + 3])] for k in range(len(w) - 2)} if len(w) >= 3 else {whole[t]} if w else set()
        out[t] = (whole[t] if w else 0, sorted(h for h in found if h < -(2**63) + 2**62))
    return out


def test_fingerprints(spark):
    rows = [(i, " ".join(words(40 + 30 * i, i))) for i in range(12)] + [(20, None), (21, ""), (22, "tiny text"), (23, "tiny text"), (23, "tiny text"), (24, "é" * 9), (25, " \n"), (None, "has no id at all"), (30, " ".join(words(20000, 9, 10**6)))]
    df = fingerprints.with_next(table(spark, rows).withColumn("row_hash", F.lit("x")).withColumn("next", F.lit(1)))
    df = fingerprints.with_sketch(fingerprints.with_sketch(df, "text", "own"), "edited", "changed")
    found = df.select("doc_id", "n_chars", "edited", "next_id", "own", "changed", fingerprints.printed("own").alias("f"), fingerprints.likeness("own", "changed").alias("near"), fingerprints.likeness("own", "next").alias("next")).collect()
    assert len(found) == len(rows)
    order = list(dict.fromkeys((i, t or "") for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0]))))
    after = {order[k]: order[(k + 1) % len(order)] for k in range(len(order))}
    text = {i: t or "" for i, t in rows}
    edited = {i: t[: len(t) - len(t) // 4] + after[i, t][1][: len(t) // 4] for i, t in text.items()}
    sketches = brute_sketch(spark, [*text.values(), *edited.values()])

    def like(a, b):
        (x, a), (y, b) = sketches[a], sketches[b]
        union = set(a) | set(b)
        return len(set(a) & set(b)) / len(union) if union else float(x == y)

    for r in found:
        own, (next_id, follows) = text[r["doc_id"]], after[r["doc_id"], text[r["doc_id"]]]
        assert r["n_chars"] == len(own) and r["edited"] == edited[r["doc_id"]] and r["next_id"] == next_id
        assert (r["own"]["whole"], r["own"]["hashes"]) == sketches[own] and (r["changed"]["whole"], r["changed"]["hashes"]) == sketches[r["edited"]]
        assert r["near"] == like(own, r["edited"]) and r["next"] == like(own, follows)
        assert r["f"] == "".join(f"{h & (1 << 64) - 1:016x}" + ":" * (k == 0) for k, h in enumerate([sketches[own][0], *sketches[own][1]]))
    assert len({r["f"] for r in found if r["doc_id"] in (22, 23)}) == 1
    assert fingerprints.with_next(table(spark, [])).count() == 0


def test_sketches_merge_and_contain(spark):
    w = words(20000, 5, 10**6)
    df = spark.createDataFrame([(" ".join(w), " ".join(w[:2000]), " ".join(w[18000:]))], "a string, b string, c string")
    for c in "abc":
        df = fingerprints.with_sketch(df, c, f"s{c}")
    r = df.select(fingerprints.containment("sb", "sa").alias("in"), fingerprints.containment("sa", "sb").alias("of"), F.size(fingerprints.merged("sb", "sc")["hashes"]).alias("n")).first()
    assert r["in"] > 0.99 and abs(r["of"] - 0.1) < 0.03 and abs(r["n"] - 4000 / fingerprints.FRACTION) < 120


def test_token_counts(spark, tmp_path):
    rows = [(5, "hello world"), (-3, None), (None, "x"), (7, ""), (2**62, "long " * 70_000), (8, "<|endoftext|>")] + [(i, f"doc {i}") for i in range(100, 150)]
    encode = token_files.encoding_of(token_files.vocabulary_bytes()).encode_ordinary
    path = f"file://{tmp_path}/tokens"
    token_files.write_tokens(table(spark, rows), path, token_files.vocabulary_bytes())
    for block in (7, 1 << 16):
        found = token_files.count_tokens(spark, path, block=block).collect()
        assert sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["closed"]) for r in found)) == sorted((i is None, i or 0, len(encode(t or "")), True) for i, t in rows)


def test_token_counts_of_repeats_and_nothing(spark, tmp_path):
    vocabulary = token_files.vocabulary_bytes()
    docs = table(spark, [(1, "one two"), (1, "one two"), (1, None)]).withColumn("value", F.lit("v")).withColumn("file", F.lit("f"))
    token_files.write_tokens(docs, f"file://{tmp_path}/a", vocabulary)
    assert sorted(r["n_tokens"] for r in token_files.count_tokens(spark, f"file://{tmp_path}/a").collect()) == [0, 2, 2]
    token_files.write_tokens(table(spark, []), f"file://{tmp_path}/b", vocabulary)
    assert token_files.count_tokens(spark, f"file://{tmp_path}/b").count() == 0


@pytest.mark.parametrize("block", [1, 2, 3, 64])
def test_plain_token_files(spark, tmp_path, block):
    r = random.Random(block)
    ids = [9 if r.random() < 0.3 else r.randrange(9) for _ in range(200)] + [1]
    (tmp_path / "a.bin").write_bytes(np.array(ids, dtype="<u2").tobytes())
    (tmp_path / "empty.bin").write_bytes(b"")
    want = "".join("|" if x == 9 else "x" for x in ids).split("|")
    found = token_files.count_tokens(spark, f"file://{tmp_path}", end=9, block=block).orderBy("ordinal").collect()
    assert [x["n_tokens"] for x in found] == [len(w) for w in want] and [x["closed"] for x in found] == [True] * (len(want) - 1) + [False]


def test_sentencepieces_like_the_library(spark):
    import sentencepiece

    model = sentencepieces.model_bytes()
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    rows = [(i, " ".join(words(50, i))) for i in range(20)] + [(90, None), (91, ""), (92, "  two  spaces "), (93, "日本語 😀 naïve\n\ttab"), (94, "a" * 50_000), (95, "Hello, world! 12345")]
    found = sentencepieces.encode_texts(table(spark, rows), model)
    ids = {r["doc_id"]: r for r in found.collect()}
    for i, t in rows:
        assert ids[i]["round_trip"] and (ids[i]["ids"] == (None if t is None else library.encode(t)))
    assert {(r["doc_id"], r["text"]) for r in sentencepieces.decode_ids(found, model).collect()} == set(rows)
    assert sentencepieces.encode_texts(table(spark, []), model).count() == 0


def test_chunks_of_sentencepieces_end_where_no_piece_goes_on():
    codec = sentencepieces.Codec(sentencepieces.Model.parse(sentencepieces.model_bytes()))
    said, ends = [f"{a}{b}" for a in ("house", "tion", "sea") for b in ("s", "bank", "lich", "ment")], [".", ",", ");", "?!", ":\n", "…", "数", "7"]
    text = " ".join(w + e for w in said for e in ends)
    assert codec.encode(text) == codec._ids(codec.normalised(text)) and len(codec.known) <= len(said) + 12 < len(said) * len(ends)
    r = random.Random(11)
    parts = [*said, *ends, " ", "  ", "\n\n", "▁", "▁▁", "─────", "الع", "数据获取一个", "\u0000", "🙂", "é", "\u0301", "[^-]\\", "3.14", "\t", "стран"]
    for _ in range(300):
        text = "".join(r.choice(parts) for _ in range(r.randrange(30)))
        assert codec.encode(text) == codec._ids(codec.normalised(text))
    for fallback in (False, True):  # a small model with characters that have no piece of their own
        pieces = ["<unk>", "ab", "a", "b", "▁", "▁a", "xy", "x", ".", ".."] + [f"<0x{i:02X}>" for i in range(256)] * fallback
        types = [sentencepieces.UNKNOWN] + [sentencepieces.NORMAL] * 9 + [sentencepieces.BYTE] * 256 * fallback
        small = sentencepieces.Codec(sentencepieces.Model(pieces, [-float(i) for i in range(len(pieces))], types, sentencepieces.BPE, fallback))
        for _ in range(300):
            text = "".join(r.choice("abxy. z??") for _ in range(r.randrange(20)))
            assert small.encode(text) == small._ids(small.normalised(text))
        said = [None, "", "ab", " a  b ", "a▁b", "?z", "▁", "abxy..", None]
        lists = pa.array([None if t is None else small.encode(t) for t in said], pa.list_(pa.int32()))
        got = small.round_trips(lists, pa.array(said))
        assert got == [small.decode(small.encode(t)) == (t or "") for t in said] and got[:3] == [True] * 3 and not got[4]


def test_sentencepieces_of_repeats_and_clashing_columns(spark):
    docs = table(spark, [(1, "same text"), (1, "same text"), (None, "same text")]).withColumn("ids", F.lit("x")).withColumn("n_tokens", F.lit(9))
    rows = sentencepieces.encode_texts(docs, sentencepieces.model_bytes()).collect()
    assert len(rows) == 3 and len({tuple(r["ids"]) for r in rows}) == 1 and {r["n_tokens"] for r in rows} == {len(rows[0]["ids"])}


def test_viterbi_of_a_unigram_model():
    r = random.Random(1)
    pieces = ["<unk>", *{"".join(r.choice("ab▁") for _ in range(r.randrange(1, 5))) for _ in range(40)}, "a", "b", "▁"]
    pieces = list(dict.fromkeys(pieces))
    m = sentencepieces.Model(pieces, [0.0] + [-r.random() * 5 for _ in pieces[1:]], [sentencepieces.UNKNOWN] + [sentencepieces.NORMAL] * (len(pieces) - 1))
    codec = sentencepieces.Codec(m)
    score = dict(zip(pieces[1:], m.scores[1:]))
    for _ in range(200):
        text = "".join(r.choice("ab▁c") for _ in range(r.randrange(1, 9)))
        best = {0: 0.0}
        for end in range(1, len(text) + 1):
            ways = [best[s] + score[text[s:end]] for s in range(end) if text[s:end] in score]
            ways += [best[end - 1] + codec.lowest] if text[end - 1] not in score else []
            best[end] = max(ways)
        got = codec.likeliest(text)
        assert abs(sum(codec.lowest if i < 0 else m.scores[i] for i in got) - best[len(text)]) < 1e-9
        assert "".join("c" if i < 0 else pieces[i] for i in got) == text
