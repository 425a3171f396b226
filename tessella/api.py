"""The engine's questions as Python functions over its tables, and the reports made of them."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import rewrite, text
from tessella.functions.shared import new_path
from tessella.operators import query_text, search, snippets, vectors, words
from tessella.operators.inverted import Inverted
from tessella.plans import registry

#: Least length of a brief worth adding to a prompt (fixed value).
SHORTEST_BRIEF = 80


class History:
    """Answers over a dict of tables (``plans.binding.stored`` or ``bound``)."""

    def __init__(self, tables: dict):
        self.tables = tables
        self._index: Inverted | None = None

    @property
    def index(self) -> Inverted:
        """The messages' search index: the stored one, or one that is built when first asked for."""
        if self._index is None:
            if stored := getattr(self.tables, "search_index", None):
                self._index = stored()
            else:
                spark = self.tables["messages"].sparkSession
                self._index = Inverted(spark, new_path(spark, "search"))
                self._index.add(self._corpus())
        return self._index

    def ask(self, plan: str, **params) -> DataFrame:
        """Any plan of the catalog, with its arguments (``catalog.PARAMS`` has their defaults)."""
        return registry.run(plan, self.tables, **params)

    def of_project(self, project: str) -> History:
        """The same history, of one project's sessions only."""
        sessions = self.tables["sessions"].where(F.col("project") == project)
        mine = {t: self.tables[t].join(sessions.select("session_id"), "session_id", "left_semi") for t in ("messages", "artifacts")}
        whole = self.tables

        class Own(dict):
            def __missing__(self, name: str) -> DataFrame:
                return whole[name]

        return History(Own(mine | {"sessions": sessions}))

    def _corpus(self) -> DataFrame:
        return self.tables["messages"].select("id", "content", "role", "tool_name", "session_id", "sequence", "timestamp")

    def _among(self, project: str | None, role: str | None, session_id: str | None) -> DataFrame | None:
        """ids of the messages of a project, role or session; None if none is named."""
        docs = self.tables["messages"]
        for column, value in (("role", role), ("session_id", session_id)):
            docs = docs.where(F.col(column) == value) if value else docs
        if project:
            docs = docs.join(self.tables["sessions"].where(F.col("project") == project).select("session_id"), "session_id", "left_semi")
        return docs.select("id") if project or role or session_id else None

    def _shown(self, found: DataFrame, phrases: list[tuple[list[str], bool]]) -> DataFrame:
        """Hits (few rows with id) with their messages, projects and the part of the text around what was found."""
        met = self._corpus().join(F.broadcast(found), "id").join(self.tables["sessions"].select("session_id", "project"), "session_id", "left")
        return met.withColumn("snippet", snippets.snippet(F.col("content"), phrases, self.index.stems))

    def find(self, expression: str, limit: int = 20, project: str | None = None, role: str | None = None, session_id: str | None = None) -> DataFrame:
        """Messages that match an expression of words, "phrases", beginnings*, AND, OR, NOT and brackets, best first."""
        found, among = self.index.matching(expression), self._among(project, role, session_id)
        found = found if among is None else found.join(among, "id", "left_semi")
        tree = query_text.parsed(expression, self.index.stems)
        shown = self._shown(found.orderBy("score", "id").limit(limit), [(w, begins) for _, w, begins in query_text.phrases(tree)])
        return shown.orderBy("score", "id").select(F.col("id").alias("message_id"), "session_id", "sequence", "project", "role", "tool_name", "timestamp", "score", "snippet", "content")

    def search(self, question: str, project: str | None = None, limit: int = 10, role: str | None = None, session_id: str | None = None) -> DataFrame:
        """Messages that answer a question: by keywords found, then the latest first; of one role or session, if named; a project's own are searched alone, so its hits are not cut by those of others."""
        terms = rewrite.search_terms(self.tables["messages"].sparkSession, question)
        recency = self.tables["messages"].select("id", F.coalesce("timestamp", F.lit("")).alias("at"))
        found = self.index.by_keywords(terms, limit, recency=recency, among=self._among(project, role, session_id))
        phrases = [([words.term_of(w, self.index.stems) for w in words.split(t)], False) for t in terms]
        order = (F.desc("hits"), F.desc(F.coalesce("timestamp", F.lit(""))), F.desc("id"))
        return self._shown(found, phrases).orderBy(*order).select("session_id", "sequence", "project", "role", "timestamp", "hits", "snippet")

    def decisions(self, project: str | None = None, limit: int = 10) -> DataFrame:
        """beginning, rank: distinct beginnings of the best answers for each word of decisions that are long enough and say something."""
        docs = self.tables["messages"].where("role = 'assistant' and tool_name is null")
        among = self._among(project, "assistant", None)
        best = [self.index.matching(f'"{w}"').join(among, "id", "left_semi").orderBy("score", "id").limit(5) for w in text.DECISIONS]
        ranks = [search.ranked(b, "score", "id").select("id", "rank") for b in best]  # five rows each
        every = ranks[0]
        for more in ranks[1:]:
            every = every.unionByName(more)
        met = docs.join(F.broadcast(every), "id").where((F.length("content") >= 50) & ~text.is_boilerplate(F.col("content")))
        return met.groupBy(F.substring("content", 1, 200).alias("beginning")).agg(F.min("rank").alias("rank")).orderBy("rank", "beginning").limit(limit)

    def hybrid(self, terms: list[str], vector: list[float] | None, limit: int = 20) -> DataFrame:
        """Messages by words and by a vector, their ranks fused; by words alone where there is no vector or none is stored."""
        docs = self._corpus()
        found = search.ranked(self.index.best(terms, 3 * limit), "score", "id")
        held = None
        if vector is not None:
            try:
                held = self.tables["vectors"]
            except (AnalysisException, KeyError):
                held = None
        if held is None or held.isEmpty():
            best = found.select("id", F.round(1 / (search.RRF + F.col("rank")), 8).alias("score")).limit(limit)
        else:
            if held.schema["embedding"].dataType.elementType.simpleString() != "tinyint":
                held = held.withColumn("embedding", vectors.quantised(F.col("embedding")))
            query = docs.sparkSession.createDataFrame([([float(x) for x in vector],)], "v array<double>").select(vectors.quantised(F.col("v")).alias("query"))
            near = search.ranked(vectors.nearest(held, query, 3 * limit), "distance", "message_id").withColumnRenamed("message_id", "id")
            best = search.fused(found, near, limit)
        return docs.join(F.broadcast(best), "id").select("id", "session_id", "sequence", "role", "timestamp", "score", search.snippet(F.col("content")).alias("snippet")).orderBy(F.desc("score"), "id")

    def recall(self, message: str) -> DataFrame | None:
        """The three best messages on the past work that a message speaks of; None if it speaks of none."""
        topic = rewrite.answers(self.tables["messages"].sparkSession, message, rewrite.recall_topic)
        return self.search(topic, limit=3) if topic else None

    def file_history(self, path: str) -> dict | None:
        rows = self.ask("file_history").where(F.col("target") == path).collect()
        return rows[0].asDict() if rows else None

    def sessions(self, min_messages: int = 5, sort: str = "recent") -> DataFrame:
        """Sessions of more messages than so many, by ``recent``, ``messages`` or ``tokens``."""
        return self.ask("list_sessions", min_messages=min_messages, sort=sort)

    def danger_zones(self) -> DataFrame:
        return self.ask("danger_zones")

    def insights(self) -> dict[str, list[dict]]:
        """The eight overview results, each a few rows."""
        parts = ("tool_usage", "role_breakdown", "projects", "cache_efficiency", "hourly_activity", "error_sessions", "expensive_per_message", "topics")
        return {p: [r.asDict() for r in self.ask(p).collect()] for p in parts}

    #: A brief's sections: title, plan, and how a row is shown; the first ``SLIM`` of them make a slim brief.
    SECTIONS = (
        ("Key files", "key_files_read", lambda r: f"{r['path']} ({r['n']} reads in {r['sessions']} sessions)"),
        ("Most changed", "key_files_modified", lambda r: f"{r['path']} ({r['n']} changes)"),
        ("Dangerous files", "danger_zones", lambda r: f"{r['path']} (errors to writes {r['ratio']})"),
        ("Changed together", "co_change", lambda r: f"{r['file_a']} and {r['file_b']} ({r['co_sessions']} sessions)"),
        ("Known errors", "known_errors", lambda r: f"{r['error_text']} ({r['occurrences']} times)"),
        ("Common errors", "common_errors", lambda r: f"{r['error_text']} ({r['occurrences']} times)"),
        ("Recent intents", "session_intents", lambda r: (r["intent"] or "").splitlines()[0] if r["intent"] else ""),
        ("Last session", "last_session_summary", lambda r: f"{r['session_id']}: {r['edited'] or 0} files ({r['files'] or '-'}), first command {r['first_command'] or '-'}"),
        ("Cost profile", "cost_profile", lambda r: f"{r['exploration_pct']} % looking, {r['mutation_pct']} % changing, {r['execution_pct']} % running"),
    )
    SLIM = 5

    def brief_parts(self, project: str, slim: bool = False) -> dict[str, list[dict]]:
        """A project's brief as data: the overview and each section's rows, all of them short lists."""
        own = self.of_project(project)
        parts = {"Overview": [r.asDict() for r in own.ask("project_overview").collect()]}
        for title, plan, _ in self.SECTIONS[: self.SLIM if slim else None]:
            parts[title] = [r.asDict() for r in own.ask(plan).collect()]
        return parts

    def brief(self, project: str, form: str = "markdown", slim: bool = False) -> str:
        """A project's brief in Markdown or JSON."""
        parts = self.brief_parts(project, slim)
        if form == "json":
            return json.dumps({"project": project, **parts}, indent=1, default=str)
        lines = [f"# {project}", ""]
        for r in parts["Overview"]:
            lines += [f"{r['sessions']} sessions, {r['messages']} messages, ${r['cost_estimate']:.2f}, {r['first_session']} to {r['last_session']}", ""]
        for title, _, show in self.SECTIONS:
            if rows := parts.get(title):
                lines += [f"## {title}", *(f"- {show(r)}" for r in rows), ""]
        return "\n".join(lines)

    def brief_variant(self, project: str, variant: str) -> str | None:
        """What an arm of an experiment is told: nothing (``baseline``), a slim brief or the whole one (``full``)."""
        if variant == "baseline":
            return None
        return self.brief(project, slim=variant != "full")

    def precision(self, question: str, sessions: set[str], k: int = 5) -> float:
        """Which share of a question's first k hits is in the sessions that should be found."""
        found = [r["session_id"] for r in self.search(question, limit=k).collect()]
        return sum(s in sessions for s in found) / len(found) if found else 0.0

    def enrichment(self, project: str) -> str | None:
        """The brief as a block for a prompt; None if there is too little to say."""
        text = self.brief(project)
        return f"<project-history>\n{text}\n</project-history>" if len(text) >= SHORTEST_BRIEF else None


def bar(ratio: float, width: int = 16) -> str:
    full = round(max(0.0, min(1.0, ratio)) * width)
    return "█" * full + "░" * (width - full)


def short_number(n: float) -> str:
    for size, unit in ((1e9, "B"), (1e6, "M"), (1e3, "K")):
        if n >= size:
            return f"{n / size:.1f}{unit}"
    return str(int(n))


def sparkline(values: list[float]) -> str:
    top = max(values, default=0)
    return "".join("▁▂▃▄▅▆▇█"[min(7, int(v / top * 7))] if top else "▁" for v in values)
