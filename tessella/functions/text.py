"""Column functions over names, texts and costs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folders after which a project's own name begins (fixed values).
BASE_FOLDERS = ("development", "desktop", "projects", "plugins", "marketplaces", "worktrees")
#: Words that make a sentence a next step (fixed values).
NEXT_STEPS = ("next", "todo", "should", "need to", "will", "plan to", "remaining", "left to", "follow up", "follow-up")
#: Words that make a message a decision, and beginnings that show it is not (fixed values).
DECISIONS = ("chose", "decided", "because", "instead of", "trade-off", "architecture", "pattern", "approach", "design")
BOILERPLATE = (
    "thanks", "thank you", "let's /compact", "let's compact", "entered plan mode", "exited plan mode", "/compact", "plan mode", "sure,", "sure!",
    "i'll ", "let me ", "sounds good", "great,", "great!", "ok,", "okay,", "the user wants", "the user is asking", "i need to",
)
#: Where a system prompt names its project (fixed values).
PROJECT_LINES = (r"(?i)working directory[:\s]+([^\n]+)", r"(?i)project[:\s]+([^\n]+)")


def clean_project_name(raw: Column) -> Column:
    """What follows the last base folder of an encoded path; the raw name where there is none."""
    parts = F.filter(F.split(raw, "-"), lambda p: p != "")
    marks = F.transform(parts, lambda p, i: F.when(F.lower(p).isin(*BASE_FOLDERS), i).otherwise(-1))
    last = F.array_max(marks)
    rest = F.slice(parts, last + 2, F.greatest(F.size(parts) - last - 1, F.lit(0)))
    name = F.when(F.size(rest) > 0, F.array_join(rest, "-")).otherwise(F.get(parts, last))
    return F.when(raw.startswith("-") & (F.size(parts) > 0) & (last >= 0), name).otherwise(raw)


def short_project(raw: Column) -> Column:
    return F.element_at(F.split(raw, "-"), -1)


def short_path(path: Column) -> Column:
    """The last two steps of a path."""
    return F.array_join(F.slice(F.reverse(F.slice(F.reverse(F.split(path, "/")), 1, 2)), 1, 2), "/")


def project_of_prompt(prompt: Column) -> Column:
    """The last step of the folder that a system prompt names; null if none."""
    found = F.coalesce(*(F.nullif(F.trim(F.regexp_extract(prompt, p, 1)), F.lit("")) for p in PROJECT_LINES))
    return F.element_at(F.filter(F.split(F.rtrim(found), "/"), lambda x: x != ""), -1)


def token_estimate(text: Column) -> Column:
    return F.coalesce(F.floor(F.length(text) / 4), F.lit(0)).cast("long")


def is_boilerplate(text: Column) -> Column:
    low = F.lower(F.trim(text))
    tests = [low.startswith(p) for p in (*BOILERPLATE, "{", "[")]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def next_step_sentences(text: Column, words: tuple[str, ...] = NEXT_STEPS) -> Column:
    """Sentences of 20 characters or more that have one of the words, cut at 200."""
    sentences = F.transform(F.split(F.regexp_replace(text, "\n", ". "), r"\. "), lambda s: F.trim(s))
    ahead = F.filter(sentences, lambda s: (F.length(s) >= 20) & F.lower(s).rlike("|".join(words)))
    return F.transform(ahead, lambda s: F.substring(s, 1, 200))


def concepts_in(text: Column, words: tuple[str, ...]) -> Column:
    """Which of the words a text has as whole words, each once."""
    either = "|".join(re.escape(w) for w in words)
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"(?<![a-z0-9_])({either})(?![a-z0-9_])"), F.lit(1)))


def length_category(turns: Column) -> Column:
    return F.when(turns < 10, "short").when(turns <= 30, "medium").otherwise("long")


def call_cost(input_tokens: Column, output_tokens: Column, cache_read: Column, cache_create: Column) -> Column:
    """Dollars (15, 75, 1.5 and 18.75 a million tokens)."""
    return F.round((input_tokens * 15.0 + output_tokens * 75.0 + cache_read * 1.5 + cache_create * 18.75) / 1e6, 6)


def exit_code(output: Column, is_error: Column) -> Column:
    """The exit code that a command's output names; 0 for other output without an error."""
    named = F.try_to_number(F.nullif(F.regexp_extract(output, r"^Exit code (\d+)", 1), F.lit("")), F.lit("999999")).cast("int")
    return F.coalesce(named, F.when((F.length(output) > 0) & ~is_error, 0))


def line_change(old: Column, new: Column) -> Column:
    """+added/-removed lines of an edit."""
    n = lambda c: F.when(F.length(c) > 0, F.regexp_count(c, F.lit("\n")) + 1).otherwise(0)
    return F.concat(F.lit("+"), n(F.coalesce(new, F.lit(""))), F.lit("/-"), n(F.coalesce(old, F.lit(""))))
