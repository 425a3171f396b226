"""Queries of search, vectors, text functions and graph measures, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import rewrite, text
from tessella.functions.shared import new_path
from tessella.operators import graph, search, vectors
from tessella.operators.inverted import Inverted
from tessella.plans import binding, catalog, oracles, registry

TERMS = ["tion", "ther"]
#: Rounds of the ranks and of the labels in the queries.
ROUNDS, SPREAD = 20, 5
QUESTION = "how did we fix tion and thon near ther"


def _tables(spark: SparkSession, sf_dir: str) -> dict:
    return binding.bound(spark, sf_dir)


def fts_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binding.corpus_index(spark, sf_dir).best(TERMS)


def fts_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by stems, which SQL cannot make (tested against a full-text index with stems)."""
    return binding.corpus_index(spark, sf_dir, stems=True).best(TERMS)


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and occurrences of every word, of an index that is built anew."""
    index = Inverted(spark, new_path(spark, "search"), stems=False)
    index.add(_tables(spark, sf_dir)["corpus"])
    return index.counts()


def boolean_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binding.corpus_index(spark, sf_dir).matching('tion "of the" NOT thon OR eau*').select("id")


def ranked_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An expression with brackets and a phrase, ranked by how often and in how many documents its phrases come."""
    return binding.corpus_index(spark, sf_dir).matching('("of the" OR tion) AND ther NOT thon').orderBy("score", "id").limit(20)


def nl_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binding.corpus_index(spark, sf_dir).by_keywords(rewrite.search_terms(spark, QUESTION))


def recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    topic = rewrite.answers(spark, QUESTION, rewrite.recall_topic)
    return binding.corpus_index(spark, sf_dir).by_keywords(rewrite.search_terms(spark, topic), limit=3, per_keyword=15)


def _query_vector(held: DataFrame) -> DataFrame:
    """The vector that others are compared with here: one row, or none."""
    return held.where("message_id = 0").select(F.col("embedding").alias("query")).limit(1)


def _quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir)["vectors"].select("message_id", vectors.quantised(F.col("embedding")).alias("embedding"))


def quantize_int8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quantised(spark, sf_dir).select("message_id", F.array_join(F.transform("embedding", lambda x: x.cast("string")), ",").alias("vector"))


def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours among all vectors, by the distances of the vectors as they are given."""
    held = _tables(spark, sf_dir)["vectors"]
    return vectors.nearest(held, _query_vector(held))


def knn_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of every vector whose id is divisible by 100, through an index of all (no SQL: its recall is tested)."""
    held, index = _quantised(spark, sf_dir), vectors.Cells(spark, new_path(spark, "cells"))
    index.build(held)
    return index.nearest(held.where("message_id % 100 = 0").select(F.col("message_id").alias("query_id"), F.col("embedding").alias("query")), 10)


def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _tables(spark, sf_dir)["vectors"]
    near = search.ranked(vectors.nearest(held, _query_vector(held), 60), "distance", "message_id").withColumnRenamed("message_id", "id")
    found = search.ranked(binding.corpus_index(spark, sf_dir).best(TERMS, 60), "score", "id")
    return search.fused(found, near)


def clean_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("-home-user-"), F.when(F.col("conv_id") % 3 == 0, "Desktop-development-").when(F.col("conv_id") % 3 == 1, "projects-").otherwise("tmp-"), F.lit("app-"), F.col("conv_id"))
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", raw.alias("raw")).distinct().select("conv_id", text.clean_project_name(F.col("raw")).alias("project"))


def next_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five distinct sentences of each session that look ahead (here: have words of the test texts)."""
    talk = _tables(spark, sf_dir)["messages"].where("role = 'assistant' and tool_name is null")
    found = talk.select("session_id", "sequence", F.posexplode(text.next_step_sentences(F.col("content"), binding.STEP_WORDS)).alias("place", "step"))
    once = found.groupBy("session_id", "step").agg(F.min(F.struct("sequence", "place")).alias("at"))
    number = F.row_number().over(Window.partitionBy("session_id").orderBy("at"))
    return once.withColumn("number", number).where("number <= 5").select("session_id", "number", "step")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct beginnings of the best messages for each decision word (here: words of the test texts), by their best rank."""
    docs = _tables(spark, sf_dir)["corpus"]
    rank = F.row_number().over(Window.partitionBy("term").orderBy("score", "id"))
    best = binding.corpus_index(spark, sf_dir).scored(list(binding.DECISION_WORDS)).withColumn("rank", rank).where("rank <= 5")
    met = docs.join(F.broadcast(best), "id").where((F.length("content") >= 50) & ~text.is_boilerplate(F.col("content")))
    return met.groupBy(F.substring("content", 1, 200).alias("beginning")).agg(F.min("rank").alias("rank")).orderBy("rank", "beginning").limit(10)


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many messages and sessions each concept comes."""
    talk = _tables(spark, sf_dir)["messages"].select("session_id", F.explode(text.concepts_in(F.col("content"), binding.CONCEPT_WORDS)).alias("concept"))
    return talk.groupBy("concept").agg(F.count("*").alias("frequency"), F.count_distinct("session_id").alias("sessions"))


def concept_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that sessions of a concept touched (here: each message's role and tool stand for concepts, as test sessions with files have no prose)."""
    t = _tables(spark, sf_dir)
    named = F.explode(text.concepts_in(F.concat_ws(" ", "role", "tool_name"), ("assistant", "user", "bash", "edit", "read", "write")))
    of_session = t["messages"].select("session_id", named.alias("concept")).distinct()
    files = t["artifacts"].where("artifact_type like 'file%'").select("session_id", F.col("target").alias("path")).distinct()
    return of_session.join(files, "session_id").groupBy("concept", "path").agg(F.count("*").alias("sessions"))


def extract_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to five keywords of each user message."""
    talk = _tables(spark, sf_dir)["messages"].where("role = 'user'")
    return talk.select("id", F.array_join(rewrite.keywords(F.col("content")), " ").alias("keywords"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes and edges: sessions, files, errors and concepts."""
    t = _tables(spark, sf_dir)
    named = t["messages"].select("session_id", F.explode(text.concepts_in(F.col("content"), binding.CONCEPT_WORDS)).alias("concept"))
    involves = named.groupBy("session_id", "concept").agg(F.count("*").alias("n"))
    return graph.whole(*(registry.run(p, t) for p in ("graph_touched", "graph_co_change", "causes_error", "tested_by")), involves)


def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of the highest rank, over all nodes, after twenty rounds."""
    ranks = graph.pagerank(_edges(spark, sf_dir), rounds=ROUNDS, tolerance=0).where("node like 'File: %'")
    return ranks.select(F.expr("substr(node, 7)").alias("node"), F.round("rank", 6).alias("rank")).orderBy(F.desc("rank"), "node").limit(20)


def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of all nodes with how many of each kind they have."""
    found = graph.communities(_edges(spark, sf_dir), rounds=SPREAD)
    kinds = (F.count_if(F.col("node").startswith(k)).alias(f"{k.lower()}s") for k in ("File", "Session", "Error", "Concept"))
    return found.groupBy("community").agg(F.count("*").alias("size"), *kinds).orderBy(F.desc("size"), "community").limit(10)


def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths between the two most frequent concepts."""
    ends = [r["concept"] for r in concepts(spark, sf_dir).orderBy(F.desc("frequency"), "concept").limit(2).collect()]
    return graph.shortest_paths(_edges(spark, sf_dir), *(f"Concept: {e}" for e in ends))


QUERIES = {f"q_{f.__name__}": f for f in (fts_search, fts_stems, postings, boolean_search, ranked_expression, nl_search, recall, quantize_int8, knn, knn_cells, hybrid_rrf, clean_project, next_steps, decisions, concepts, concept_files, extract_keywords, pagerank, communities, shortest_path)}

_TOKENS = r"list_filter(regexp_split_to_array(strip_accents(lower(concat_ws(' ', content, role, tool_name))), '[^\p{L}\p{N}]+'), lambda x: x != '')"
_DOCS = f"corpus AS ({binding.ORACLE['corpus']}), d AS (SELECT id, content, {_TOKENS} AS t FROM corpus), size AS (SELECT count(*) AS n_docs, avg(len(t)) AS mean FROM d)"


def _bm25(terms: list[str]) -> str:
    listed = ", ".join(f"('{t.lower()}')" for t in dict.fromkeys(terms))
    return (
        f"hit AS (SELECT id, term, len(t) AS l, len(list_filter(t, lambda x: x = term)) AS tf FROM d, (VALUES {listed}) q(term)), h AS (SELECT * FROM hit WHERE tf > 0), n AS (SELECT term, count(*) AS n FROM h GROUP BY term), "
        "b AS (SELECT h.term, id, -greatest(ln((n_docs - n + 0.5E0) / (n + 0.5E0)), 1e-6) * tf * 2.2E0 / (tf + 1.2E0 * (0.25E0 + 0.75E0 * l / mean)) AS score FROM h JOIN n USING (term), size)"
    )


def _search(limit: int) -> str:
    return f"SELECT id, round(score, 6) AS score FROM (SELECT id, sum(score) AS score, count(*) AS c FROM b GROUP BY id) WHERE c = {len(TERMS)} ORDER BY score, id LIMIT {limit}"


def _keyword(terms: list[str], limit: int, each: int) -> str:
    return f"WITH {_DOCS}, {_bm25(terms)} SELECT id, count(*) AS hits, min(rank) AS best_rank FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY score, id) AS rank FROM b) WHERE rank <= {each} GROUP BY id ORDER BY hits DESC, best_rank, id LIMIT {limit}"


_V = "v AS (SELECT vec_id AS message_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), q AS (SELECT e AS qe FROM v WHERE message_id = 0)"
_NEAR = "SELECT message_id, round(1 - list_inner_product(e, qe) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(qe, qe))), 6) + 0.0E0 AS distance FROM v, q ORDER BY distance, message_id LIMIT {n}"
_STOP = ", ".join(f"'{w}'" for w in sorted(rewrite.STOPWORDS))
_PADDED = r"' ' || array_to_string(t, ' ') || ' '"

ORACLES = {
    "q_fts_search": f"WITH {_DOCS}, {_bm25(TERMS)} {_search(20)}",
    "q_postings": f"WITH {_DOCS} SELECT term, count(DISTINCT id) AS n_docs, count(*) AS n FROM (SELECT id, unnest(t) AS term FROM d) GROUP BY term",
    "q_boolean_search": f"WITH {_DOCS} SELECT id FROM (SELECT id, {_PADDED} AS p FROM d) WHERE (contains(p, ' tion ') AND contains(p, ' of the ') AND NOT contains(p, ' thon ')) OR contains(p, ' eau')",
    "q_nl_search": _keyword(["fix", "tion", "thon", "near", "ther"], 10, 30),
    "q_recall": _keyword(["tion", "thon", "near", "ther"], 3, 15),
    "q_quantize_int8": "WITH v AS (SELECT vec_id AS message_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings) SELECT message_id, array_to_string(list_transform(e, lambda x: CAST(CAST(greatest(-128.0, least(127.0, round_even(x / sqrt(list_inner_product(e, e)) * 127, 0))) AS INT) AS VARCHAR)), ',') AS vector FROM v",
    "q_knn": f"WITH {_V} {_NEAR.format(n=20)}",
    "q_hybrid_rrf": f"WITH {_DOCS}, {_bm25(TERMS)}, {_V}, f AS (SELECT id, row_number() OVER (ORDER BY score, id) AS rank FROM ({_search(60)})), n2 AS (SELECT message_id AS id, row_number() OVER (ORDER BY distance, message_id) AS rank FROM ({_NEAR.format(n=60)})) SELECT id, round(coalesce(1.0E0 / (60 + f.rank), 0) + coalesce(1.0E0 / (60 + n2.rank), 0), 8) AS score FROM f FULL JOIN n2 USING (id) ORDER BY score DESC, id LIMIT 20",
    "q_clean_project": "SELECT DISTINCT conv_id, CASE WHEN conv_id % 3 = 2 THEN '-home-user-tmp-app-' || conv_id ELSE 'app-' || conv_id END AS project FROM conversations",
}
# Occurrences of each phrase: words by place, and pairs of neighbours in one column.
_TIMES = "len(list_filter(t, lambda x: x = '{w}'))"
_PAIRS = "len(list_filter(list_zip(t, t[2:]), lambda x: x[1] = 'of' AND x[2] = 'the'))"
_GAIN = "-greatest(ln((n_docs - n{i} + 0.5E0) / (n{i} + 0.5E0)), 1e-6) * t{i} * 2.2E0 / (t{i} + 1.2E0 * (0.25E0 + 0.75E0 * l / mean))"
ORACLES["q_ranked_expression"] = (
    f"WITH {_DOCS}, c AS (SELECT id, len(t) AS l, {_PAIRS} AS t0, {_TIMES.format(w='tion')} AS t1, {_TIMES.format(w='ther')} AS t2, {_TIMES.format(w='thon')} AS t3 FROM d), "
    "n AS (SELECT count(*) FILTER (t0 > 0) AS n0, count(*) FILTER (t1 > 0) AS n1, count(*) FILTER (t2 > 0) AS n2, count(*) FILTER (t3 > 0) AS n3 FROM c) "
    f"SELECT id, round({' + '.join('(' + _GAIN.format(i=i) + ')' for i in range(4))}, 6) AS score FROM c, n, size WHERE (t0 > 0 OR t1 > 0) AND t2 > 0 AND NOT t3 > 0 ORDER BY score, id LIMIT 20"
)
# The first five distinct words in order: positions at which a word comes first.
ORACLES["q_extract_keywords"] = registry.with_views(
    f"SELECT id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i)[1:5], ' ') AS keywords FROM (SELECT id, CASE WHEN len(w) > 0 THEN w ELSE list_transform(list_sort(list_transform(a, lambda x, i: struct_pack(n := -length(x), i := i, x := x)))[1:3], lambda y: y.x) END AS w "
    f"FROM (SELECT id, a, list_filter(a, lambda x: x NOT IN ({_STOP})) AS w FROM (SELECT id, regexp_extract_all(lower(content), '[a-z_][a-z0-9_.-]*') AS a FROM {{messages}} WHERE role = 'user')))"
)
_AHEAD = " OR ".join(f"contains(lower(x), '{w}')" for w in binding.STEP_WORDS)
ORACLES["q_next_steps"] = registry.with_views(
    f"SELECT session_id, number, step FROM (SELECT session_id, step, row_number() OVER (PARTITION BY session_id ORDER BY sequence, place) AS number FROM (SELECT session_id, step, sequence, place FROM (SELECT session_id, sequence, generate_subscripts(v, 1) AS place, unnest(v) AS step FROM "
    f"(SELECT session_id, sequence, list_transform(list_filter(list_transform(string_split(replace(content, chr(10), '. '), '. '), lambda x: trim(x)), lambda x: length(x) >= 20 AND ({_AHEAD})), lambda x: left(x, 200)) AS v FROM {{messages}} WHERE role = 'assistant' AND tool_name IS NULL)) "
    "QUALIFY row_number() OVER (PARTITION BY session_id, step ORDER BY sequence, place) = 1)) WHERE number <= 5"
)
_PLAIN = " OR ".join(f"starts_with(lower(trim(content)), '{p.replace(chr(39), chr(39) * 2)}')" for p in (*text.BOILERPLATE, "{", "["))
ORACLES["q_decisions"] = f"WITH {_DOCS}, {_bm25(list(binding.DECISION_WORDS))}, r AS (SELECT id, row_number() OVER (PARTITION BY term ORDER BY score, id) AS rank FROM b) SELECT left(content, 200) AS beginning, min(rank) AS rank FROM r JOIN corpus USING (id) WHERE rank <= 5 AND length(content) >= 50 AND NOT ({_PLAIN}) GROUP BY 1 ORDER BY rank, beginning LIMIT 10"
ORACLES["q_concepts"] = registry.with_views("SELECT concept, count(*) AS frequency, count(DISTINCT session_id) AS sessions FROM {messages}, (VALUES " + ", ".join(f"('{w}')" for w in binding.CONCEPT_WORDS) + ") c(concept) WHERE list_contains(string_split(regexp_replace(lower(content), CASE WHEN contains(concept, '/') THEN '[^a-z0-9_/]+' ELSE '[^a-z0-9_]+' END, ' ', 'g'), ' '), concept) GROUP BY concept")
ORACLES["q_concept_files"] = registry.with_views("SELECT concept, target AS path, count(DISTINCT session_id) AS sessions FROM (SELECT session_id, role AS concept FROM {messages} UNION ALL SELECT session_id, lower(tool_name) FROM {messages} WHERE tool_name IS NOT NULL) JOIN {artifacts} USING (session_id) WHERE starts_with(artifact_type, 'file') GROUP BY 1, 2")
_INVOLVES = "SELECT session_id, concept, count(*) AS n FROM {messages}, (VALUES " + ", ".join(f"('{w}')" for w in binding.CONCEPT_WORDS) + ") c(concept) WHERE list_contains(string_split(regexp_replace(lower(content), CASE WHEN contains(concept, '/') THEN '[^a-z0-9_/]+' ELSE '[^a-z0-9_]+' END, ' ', 'g'), ' '), concept) GROUP BY ALL"
_GRAPH = (
    "u AS (SELECT 'Session: ' || session_id AS src, 'File: ' || path AS dst, reads + writes AS weight FROM ({graph_touched}) UNION ALL SELECT 'File: ' || file_a, 'File: ' || file_b, co_sessions FROM ({graph_co_change}) UNION ALL SELECT 'File: ' || path, 'Error: ' || pattern, n FROM ({causes_error}) "
    "UNION ALL SELECT 'File: ' || source, 'File: ' || test_file, co_sessions FROM ({tested_by}) UNION ALL SELECT 'Session: ' || session_id, 'Concept: ' || concept, n FROM ({involves})), "
    "g AS MATERIALIZED (SELECT src, dst, CAST(sum(weight) AS BIGINT) AS weight FROM u GROUP BY ALL), two AS MATERIALIZED (SELECT src, dst, CAST(sum(weight) AS BIGINT) AS weight FROM (SELECT * FROM g UNION ALL SELECT dst, src, weight FROM g) WHERE src != dst GROUP BY ALL)"
)
for _name in ("graph_touched", "graph_co_change", "causes_error", "tested_by"):
    _GRAPH = _GRAPH.replace(f"{{{_name}}}", catalog.to_duckdb(oracles.APART.get(_name, catalog.PLANS[_name])))
_GRAPH = _GRAPH.replace("{involves}", _INVOLVES)
_RANKS = ", ".join(
    f"r{i + 1} AS MATERIALIZED (SELECT v.node, v.degree, 0.15E0 / n + 0.85E0 * (coalesce(given, 0) + loose / n) AS rank FROM v LEFT JOIN (SELECT dst, sum(rank / degree) AS given FROM g JOIN r{i} ON r{i}.node = g.src GROUP BY dst) x ON x.dst = v.node, (SELECT coalesce(sum(rank), 0) AS loose FROM r{i} WHERE degree IS NULL), (SELECT count(*) AS n FROM v))"
    for i in range(ROUNDS)
)
ORACLES["q_pagerank"] = registry.with_views(
    f"WITH {_GRAPH}, v AS MATERIALIZED (SELECT node, degree FROM (SELECT src AS node FROM g UNION SELECT dst FROM g) LEFT JOIN (SELECT src, count(*) AS degree FROM g GROUP BY src) ON src = node), r0 AS (SELECT node, degree, 1.0E0 / (SELECT count(*) FROM v) AS rank FROM v), {_RANKS} "
    f"SELECT substr(node, 7) AS node, round(rank, 6) AS rank FROM r{ROUNDS} WHERE starts_with(node, 'File: ') ORDER BY rank DESC, node LIMIT 20"
)
_LABELS = ", ".join(
    f"l{i + 1} AS MATERIALIZED (SELECT node, community FROM (SELECT src AS node, community, row_number() OVER (PARTITION BY src ORDER BY sum(weight) DESC, community) AS nth FROM two JOIN l{i} ON l{i}.node = two.dst GROUP BY src, community) WHERE nth = 1)"
    for i in range(SPREAD)
)
_KINDS = ", ".join(f"count(*) FILTER (starts_with(node, '{k}')) AS {k.lower()}s" for k in ("File", "Session", "Error", "Concept"))
ORACLES["q_communities"] = registry.with_views(f"WITH {_GRAPH}, l0 AS (SELECT DISTINCT src AS node, src AS community FROM two), {_LABELS} SELECT community, count(*) AS size, {_KINDS} FROM l{SPREAD} GROUP BY community ORDER BY size DESC, community LIMIT 10")
#: Hops from either end by walks, then the paths that come one hop nearer at each step.
ORACLES["q_shortest_path"] = registry.with_views(
    f"WITH RECURSIVE {_GRAPH}, top AS (SELECT concept, row_number() OVER (ORDER BY n DESC, concept) AS nth FROM (SELECT concept, sum(n) AS n FROM ({_INVOLVES}) GROUP BY concept)), a AS (SELECT 'Concept: ' || concept AS node FROM top WHERE nth = 1), z AS (SELECT 'Concept: ' || concept AS node FROM top WHERE nth = 2), "
    "f(node, d) AS (SELECT node, 0 FROM a UNION SELECT dst, d + 1 FROM f JOIN two ON src = node WHERE d < 6), b(node, d) AS (SELECT node, 0 FROM z UNION SELECT dst, d + 1 FROM b JOIN two ON src = node WHERE d < 6), "
    "near AS (SELECT node, min(d) AS d FROM b GROUP BY node), whole AS (SELECT min(d) AS d FROM f WHERE node = (SELECT node FROM z)), "
    "p(node, path, hops) AS (SELECT node, node, 0 FROM a UNION ALL SELECT two.dst, path || ' > ' || two.dst, hops + 1 FROM p JOIN two ON two.src = p.node JOIN near n ON n.node = two.dst, whole WHERE n.d = whole.d - hops - 1) "
    "SELECT path, CAST(hops AS INT) AS hops FROM p, whole WHERE hops = whole.d AND node = (SELECT node FROM z) ORDER BY path LIMIT 5"
)
