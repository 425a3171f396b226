"""The part of a text around what was found in it, with marks, as the usual full-text index cuts it.

Of all stretches of ``SIZE`` words that begin at a hit or at the sentence of one,
the best has the most different phrases, then the most hits; a sentence's
beginning counts above hits alone. Done for the rows that a search returns, in
Arrow batches.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.operators import words

OPEN, CLOSE, GAP, SIZE = ">>>", "<<<", "...", 48
#: What a phrase's first hit, another hit, the text's beginning and a sentence's beginning count.
NEW, AGAIN, BEGINNING, SENTENCE = 1000, 1, 120, 100
BLANKS = " \t\n\r"


def hits_of(terms: list[str], phrases: list[tuple[list[str], bool]]) -> list[tuple[int, int, int]]:
    """Place, number and length of every phrase (its words, and whether the last is a beginning only) in ``terms``, by place."""
    at: dict[str, list[int]] = {}
    for i, t in enumerate(terms):
        at.setdefault(t, []).append(i)
    out = []
    for number, (found, begins) in enumerate(phrases):
        if found:
            fits = lambda i, k: i < len(terms) and (terms[i].startswith(found[k]) if begins and k == len(found) - 1 else terms[i] == found[k])  # noqa: B023, E731
            starts = at.get(found[0], []) if len(found) > 1 or not begins else range(len(terms))
            out += [(i, number, len(found)) for i in starts if all(fits(i + k, k) for k in range(len(found)))]
    return sorted(out)


def sentences(text: str, starts: list[int]) -> list[int]:
    """Numbers of the words that begin a sentence."""
    out = [0] if starts else []
    for i, start in enumerate(starts[1:], 1):
        before = text[:start] if start < 64 else text[start - 64 : start]
        bare = before.rstrip(BLANKS)
        if not bare and start >= 64:
            bare = text[:start].rstrip(BLANKS)
        if bare != before and bare.endswith((".", ":")):
            out.append(i)
    return out


def excerpt(text: str, phrases: list[tuple[list[str], bool]], stems: bool = False, size: int = SIZE) -> str:
    """The best ``size`` words of ``text`` with marks around its hits; the first ones where nothing is found."""
    tokens = list(words.WORD.finditer(text))
    terms = [words.term_of(m.group(), stems) for m in tokens]
    found, n = hits_of(terms, phrases), len(tokens)
    places = [h[0] for h in found]

    def window(start: int) -> tuple[int, int]:
        """What a stretch counts, and where it begins if its hits are put in its middle."""
        own, seen, score = found[bisect_left(places, start) : bisect_left(places, start + size)], set(), 0
        for _, number, _ in own:
            score += AGAIN if number in seen else NEW
            seen.add(number)
        middle = own[0][0] - int((size - (own[-1][0] + own[-1][2] - own[0][0])) / 2) if own else start
        return score, max(0, min(middle, n - size))

    best, begin = 0, 0
    heads = sentences(text, [m.start() for m in tokens]) if found and n > size else []
    for place, *_ in found:
        score, start = window(place)
        if score > best:
            best, begin = score, start
        if heads and (head := heads[bisect_right(heads, place) - 1]) < place:
            score = window(head)[0] + (SENTENCE if head else BEGINNING)
            if score > best:
                best, begin = score, head
    end = begin + size - 1
    spans: list[list[int]] = []
    for place, _, length in found:
        if place < begin or place > end:
            continue
        if spans and place <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], min(end, place + length - 1))
        else:
            spans.append([place, min(end, place + length - 1)])
    at, out = tokens[begin].start() if begin else 0, GAP if begin else ""
    for first, last in spans:
        out += text[at : tokens[first].start()] + OPEN + text[tokens[first].start() : tokens[last].end()] + CLOSE
        at = tokens[last].end()
    return out + (text[at:] if end >= n - 1 else text[at : tokens[end].end()] + GAP)


def snippet(text: Column, phrases: list[tuple[list[str], bool]], stems: bool = False, size: int = SIZE) -> Column:
    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else excerpt(t, phrases, stems, size))

    return cut(text)
