"""Words of texts, as a full-text index has them: folded, without marks, and stemmed on request; as columns and in tasks."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.stem import stem, stemmed

SEPARATORS = r"[^\p{L}\p{N}]+"
WORD = re.compile(r"[^\W_]+")
#: Small letters of the Latin blocks that are a letter with marks, and that letter, by the rule of Unicode's decompositions.
MARKED = [(c, base) for c in map(chr, range(0xDF, 0x250)) if c == c.lower() and (base := unicodedata.normalize("NFD", c)[0]) != c]
_PLAIN = str.maketrans(dict(MARKED))


def folded(text: Column) -> Column:
    """Lower-cased, without the marks of Latin letters."""
    return F.translate(F.lower(text), "".join(c for c, _ in MARKED), "".join(base for _, base in MARKED))


def plain(term: str) -> str:
    """What ``folded`` makes of a text."""
    return term.lower().translate(_PLAIN)


def tokens(*columns: str, stems: bool = False) -> Column:
    """The words of the columns' texts; with ``stems``, their stems."""
    found = F.filter(F.split(folded(F.concat_ws(" ", *columns)), SEPARATORS), lambda t: t != "")
    return stemmed(found) if stems else found


def split(text: str, stems: bool = False) -> list[str]:
    """``tokens`` of one text, in a task."""
    found = WORD.findall(plain(text))
    return [stem(w) for w in found] if stems else found


def term_of(word: str, stems: bool) -> str:
    return stem(plain(word)) if stems else plain(word)
