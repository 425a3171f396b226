"""Search expressions: words, "phrases", beginnings*, AND, OR, NOT and brackets.

NOT binds more than AND, AND more than OR, and words that follow each other
belong together before all of them, as in the usual full-text index. A word with
signs inside is a phrase of its parts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.operators import words

PART = re.compile(r'\s*(?:(?P<bracket>[()])|"(?P<quoted>(?:[^"]|"")*)"(?P<qstar>\s*\*)?|(?P<plus>\+)|(?P<bare>[^\s()"+*]+)(?P<bstar>\*)?|(?P<stray>\*))')


class QuerySyntaxError(ValueError):
    pass


class _Reader:
    def __init__(self, text: str, stems: bool):
        self.parts = [m for m in PART.finditer(text) if not m["stray"]]
        self.at, self.stems = 0, stems

    def next(self, *names: str) -> bool:
        """Whether the next part is an operator or bracket of that name, which is then behind us."""
        here = self.parts[self.at] if self.at < len(self.parts) else None
        if here and (here["bare"] in names or here["bracket"] in names or here["plus"] in names):
            self.at += 1
            return True
        return False

    def phrase(self) -> tuple | None:
        here = self.parts[self.at] if self.at < len(self.parts) else None
        if here is None or here["bracket"] or here["plus"] or here["bare"] in ("AND", "OR", "NOT"):
            return None
        self.at += 1
        quoted = here["quoted"] is not None
        found = words.split(here["quoted"].replace('""', '"') if quoted else here["bare"])
        starts = bool(here["qstar"] or here["bstar"])
        if self.stems:  # a beginning is no word with a stem
            found = [w if starts and i == len(found) - 1 else words.term_of(w, True) for i, w in enumerate(found)]
        return "phrase", found, starts

    def one(self) -> tuple | None:
        if self.next("("):
            inner = self.any_of()
            if inner is None or not self.next(")"):
                raise QuerySyntaxError("a bracket is open, or empty")
            return inner
        out = self.phrase()
        while out and self.next("+"):
            more = self.phrase()
            if more is None:
                raise QuerySyntaxError("nothing follows +")
            out = ("phrase", out[1] + more[1], more[2])
        return out

    def together(self) -> tuple | None:
        out = self.one()
        while (more := self.one()) is not None:
            if out[0] == "phrase" and not out[1]:
                out = more
            elif more[0] != "phrase" or more[1]:
                out = ("and", out, more)
        return out

    def _chain(self, name: str, side) -> tuple | None:
        out = side()
        while self.next(name):
            more = side()
            if out is None or more is None:
                raise QuerySyntaxError(f"{name} needs something on both sides")
            out = (name.lower(), out, more)
        return out

    def all_of(self) -> tuple | None:
        return self._chain("AND", lambda: self._chain("NOT", self.together))

    def any_of(self) -> tuple | None:
        return self._chain("OR", self.all_of)


def parsed(text: str, stems: bool = False) -> tuple:
    """The expression as ("phrase", words, begins) leaves under ("and" | "or" | "not", left, right)."""
    reader = _Reader(text, stems)
    tree = reader.any_of()
    if tree is None or reader.at < len(reader.parts):
        raise QuerySyntaxError(f"no search expression: {text!r}")
    return tree


def phrases(tree: tuple) -> list[tuple]:
    """The leaves, from left to right."""
    return [tree] if tree[0] == "phrase" else [*phrases(tree[1]), *phrases(tree[2])]


def test(tree: tuple, holds: dict[int, Column]) -> Column:
    """Whether a document matches, of columns that say so of each leaf; a phrase without words is in none."""
    if tree[0] == "phrase":
        return holds.get(id(tree), F.lit(False))
    left, right = (test(side, holds) for side in tree[1:])
    return left & right if tree[0] == "and" else left | right if tree[0] == "or" else left & ~right
