"""Main text of HTML pages by consensus on host paths.

Each page scores its containers (text in paragraphs, less text in links), widens
the best one to the element that holds the other parts of its text too, and
votes for that element's generalised path: tag and first class of every element
from the root, digits made alike. Votes are summed per host and path in Spark,
and the path with most votes of a host is its consensus. Pages are then
extracted again from all elements on that path, with the heading before them; a
page that has none, or none with text, falls back on its own best container.

Hosts also agree on what is not main text: a path outside articles whose texts
are, for the most part, the same on several pages with different main texts
(copies of one page say nothing) belongs to the site and not to its pages, and
its texts are left out. What a page's own markup names as menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles and reader comments
is left out too. Where a class only begins or ends with such a word, and for
forms, that holds if it has a minor part of the page's text; a page with nothing
else has the largest of what was left out.

A path is known by a hash that is chained from element to element, so deep pages
take no more memory than flat ones.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.shared import discard, written

#: Where a comment, a tag (its slash and name) or another mark begins; what is between a name and the tag's end, quotes closed; quotes and ends.
MARK = re.compile(r"<(?:(?P<comment>!--)|(?P<slash>/?)(?P<name>[a-zA-Z][^\s/>]*)|[!?/])")
ATTRIBUTES = re.compile(r"""(?:[^>"']+|"[^"]*"|'[^']*')*+>""")
QUOTES = re.compile(r"[\"'>]")
#: Characters in which a tag usually ends; a longer one is looked up.
NEAR = 4_096
CLASS = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
#: Fixed values of the HTML standard: elements without content, with raw text, and that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
BLOCKS = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul caption".split())
#: Elements that a new one of the same kind closes, and the elements that bound the search for it.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("table ul ol dl select body html article section div td th tbody thead blockquote main aside".split())
#: Elements and words in class, id or role that mark what is not main text.
SKIPPED = frozenset("nav header footer aside script style noscript template iframe button select textarea input svg canvas object menu dialog head title".split())
NOISE = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead banner footer sidebar side aside widget ad ads advert adverts advertisement advertising sponsor sponsored promo promotion "
    "notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login form search comment comments commentlist discussion disqus replies reply respond "
    "related recommended recommendation share sharing social toolbar pagination pager complementary contentinfo trending "
    "cmt cmts kommentar kommentare commentaire commentaires comentario comentarios seitenleiste kopfzeile werbung anzeige publicite publicidad barre".split()
)
QUALIFIERS = frozenset("has with no is without hide show".split())
#: Words that make a known form with a noise word, like ``comment-list``.
FORMS = frozenset("list area section box container wrapper wrap block thread item items inner holder slot unit link links user reader visitor site page top bottom left right main more stories post blog article entry news story".split())
#: Share of the page's text outside links from which elements of one path are not noise by a class that only begins or ends with a noise word.
MAJOR = 0.25
CONTAINERS = frozenset("article main section div td body html blockquote center table".split())
#: What a container gets of its own paragraphs' and of its children's paragraphs' text.
OWN, CHILD, ARTICLE = 1.0, 0.5, 1.25
#: Share of a container's text that a part of it may leave out and still stand for it; of the body's text.
REST, BODY_REST = 0.05, 0.1
#: A text is a host's own if so many pages of different main texts have it on one path, and a path if so great a share of its texts are.
HOST_PAGES, HOST_SHARE = 3, 0.8
#: Texts that a task remembers, so as not to pass them on twice.
REMEMBERED = 200_000
SLICE = 64
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def chained(path: int, part: str) -> int:
    """The path of an element from its parent's and its own tag and class: 64 bits, signed."""
    return xxhash.xxh3_64_intdigest(part.encode(errors="replace"), seed=path & (1 << 64) - 1) - (1 << 63)


def hash_of(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode(errors="replace")) - (1 << 63)


class Tags:
    """The tags of a page, one after the other, in time that grows with its length whatever its quotes.

    A tag ends at the first ``>`` outside quotes; where its quotes are never
    closed, at the first one.
    """

    def __init__(self, source: str):
        self.source, self.last = source, source.rfind(">")
        self.places: list[int] | None = None

    def _ends(self) -> None:
        """For each quote and ``>``, where a tag ends whose attributes go on there: read from the page's end, once."""
        found = [(m.start(), m[0]) for m in QUOTES.finditer(self.source)]
        self.places, self.ends = [at for at, _ in found], [-1] * (len(found) + 1)
        following: dict[str, int] = {}
        for i in range(len(found) - 1, -1, -1):
            at, mark = found[i]
            if mark == ">":
                self.ends[i] = at + 1
            else:
                self.ends[i] = self.ends[following[mark] + 1] if mark in following else -1
                following[mark] = i

    def _end(self, at: int) -> int:
        """Where the tag ends whose name ends at ``at``; -1 if there is no more ``>``."""
        if m := ATTRIBUTES.match(self.source, at, at + NEAR):
            return m.end()
        if self.places is None:
            self._ends()
        end = self.ends[bisect_left(self.places, at)]
        return end if end >= 0 else self.source.find(">", at) + 1 or -1

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """start, end, whether it closes, name and attributes of the next tag; comments and the like have no name."""
        for m in MARK.finditer(self.source, at):
            if m["comment"]:
                end = self.source.find("-->", m.end())
                return m.start(), end + 3 if end >= 0 else len(self.source), False, "", ""
            if m.start() > self.last:
                begin = self.source.find("<!--", m.start())  # no tag ends any more, a comment without an end may begin
                return None if begin < 0 else (begin, len(self.source), False, "", "")
            end = self._end(m.end()) if m["name"] else self.source.find(">", m.end()) + 1 or -1
            if end > 0:
                return m.start(), end, bool(m["slash"]), m["name"] or "", self.source[m.end() : end - 1] if m["name"] else ""
        return None


class Page:
    """Elements of a page in document order, and its texts, without those that stand on one of ``theirs``, the host's own paths."""

    def __init__(self, source: str, theirs: frozenset[int] = frozenset()):
        #: Of each element: tag, generalised path, parent, end (the number after its last descendant), left out, nearest container, whether in an article.
        self.tag, self.path, self.parent, self.end, self.out, self.box, self.inside = ["#page"], [0], [-1], [0], [False], [0], [False]
        #: Tag and class of each element, as its path has them.
        self.part: list[str] = [""]
        #: (element, block number, text, inside a link)
        self.texts: list[tuple[int, int, str, bool]] = []
        #: Elements that their class, id or role marks as noise: whether by a whole word or known form.
        self.noise: dict[int, bool] = {}
        #: How many elements of a tag are open.
        self.open: dict[str, int] = {}
        self._read(source)
        if theirs:
            self.texts = [x for x in self.texts if self.inside[x[0]] or self.path[x[0]] not in theirs]
        if self.noise:
            self._leave_out()

    def named_path(self, element: int) -> str:
        parts = []
        while element > 0:
            parts.append(self.part[element])
            element = self.parent[element]
        return "/".join(["", *reversed(parts)])

    def _close(self, stack: list[int], depth: int) -> None:
        while len(stack) > depth:
            element = stack.pop()
            self.end[element] = len(self.tag)
            self.open[self.tag[element]] = self.open.get(self.tag[element], 1) - 1

    def _read(self, source: str) -> None:
        stack, block, at, links = [0], 0, 0, 0
        size, tags = len(source), Tags(source)
        while at < size:
            m = tags.next(at)
            text = source[at : m[0] if m else size]
            if text and not text.isspace() and not self.out[stack[-1]]:
                self.texts.append((stack[-1], block, html.unescape(text), links > 0))
            elif text and self.texts and not self.out[stack[-1]]:
                self.texts.append((stack[-1], block, " ", links > 0))
            if not m:
                break
            _, at, closing, name, attributes = m
            if not name:
                continue
            tag = name.lower()
            if tag in BLOCKS:
                block += 1
            if closing:
                for depth in range(len(stack) - 1, 0, -1) if self.open.get(tag) else ():
                    if self.tag[stack[depth]] == tag:
                        self._close(stack, depth)
                        break
                links = max(0, links - 1) if tag == "a" else links
                continue
            if tag in BLOCKS and tag != "br":
                self._imply(stack, tag)
            self._open(stack, tag, attributes)
            if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
                self._close(stack, len(stack) - 1)
            elif tag in RAW:
                stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>|\Z", re.I).search(source, at)
                at = stop.end()
                self._close(stack, len(stack) - 1)
            elif tag == "a":
                links += 1
        self._close(stack, 0)

    def _imply(self, stack: list[int], tag: str) -> None:
        """Closes what a new block closes: an open paragraph, or an item of the same list or row."""
        closed = CLOSED_BY.get(tag, set()) | {"p"}
        if not any(self.open.get(t) for t in closed):
            return
        for depth in range(len(stack) - 1, 0, -1):
            t = self.tag[stack[depth]]
            if t in closed:
                self._close(stack, depth)
                return
            if t in SCOPE:
                return

    def _open(self, stack: list[int], tag: str, attributes: str) -> None:
        cls, noise = "", 0
        for name, *values in CLASS.findall(attributes):
            value = values[0] or values[1] or values[2]
            if name.lower() == "class":
                cls = re.sub(r"\d+", "#", value.lower().split()[0]) if value.split() else ""
            noise = max([noise, *(self._noisy([w.lower() for w in WORDS.findall(token)]) for token in value.split())])
        up = stack[-1]
        element = len(self.tag)
        stack.append(element)
        self.tag.append(tag)
        self.open[tag] = self.open.get(tag, 0) + 1
        self.part.append(f"{tag}{'.' * bool(cls)}{cls}")
        self.path.append(chained(self.path[up], self.part[-1]))
        self.parent.append(up)
        self.end.append(0)
        self.out.append(self.out[up] or tag in SKIPPED)
        self.box.append(element if tag in CONTAINERS else self.box[up])
        self.inside.append(self.inside[up] or tag in ("article", "main"))
        if not self.out[-1] and (noise or tag == "form") and tag not in ("html", "body", "article", "main"):
            self.noise[element] = noise == 2

    @staticmethod
    def _noisy(words: list[str]) -> int:
        """Whether a class, like ``site-footer`` but not ``with-sidebar``, names something to leave out: 2 if all its words do or are of a known form, 1 if its first or last does."""
        if not words or words[0] in QUALIFIERS or not (words[0] in NOISE or words[-1] in NOISE):
            return 0
        return 2 if all(w in NOISE or w in FORMS for w in words) else 1

    def _leave_out(self) -> None:
        """Drops the texts of noise."""
        sure = self._marked({e for e, whole in self.noise.items() if whole})
        size = self._summed(self._own(sure))
        shares: dict[str, int] = {}
        for e, whole in self.noise.items():
            if not whole and not sure[e]:
                shares[self.path[e]] = shares.get(self.path[e], 0) + size[e]
        minor = lambda e: sure[e] or not shares[self.path[e]] or shares[self.path[e]] < MAJOR * size[0]
        noise = {e for e in self.noise if minor(e)}
        out = self._marked(noise)
        if noise and not any(self._own(out)):
            # Of each noise element, what is in no other one inside it.
            nearest, own = list(range(len(self.tag))), dict.fromkeys(noise, 0)
            for e in range(1, len(nearest)):
                nearest[e] = e if e in noise else nearest[self.parent[e]]
            for e, n in enumerate(self._own([not x for x in out])):
                if n:
                    own[nearest[e]] += n
            largest = min(own, key=lambda e: (-own[e], e))
            if own[largest] > sum(len(text.strip()) for e, _, text, _ in self.texts if not out[e]):
                while largest > 0:
                    noise.discard(largest)
                    largest = self.parent[largest]
                out = self._marked(noise)
        self.out = [a or b for a, b in zip(self.out, out)]
        self.texts = [x for x in self.texts if not out[x[0]]]

    def _own(self, out: list[bool]) -> list[int]:
        """Of each element, the characters of its own texts outside links; 0 for those in ``out``."""
        own = [0] * len(self.tag)
        for e, _, text, link in self.texts:
            own[e] += 0 if link or out[e] else len(text.strip())
        return own

    def _marked(self, elements: set[int]) -> list[bool]:
        """Of each element, whether it is one of ``elements`` or in one."""
        out = [False] * len(self.tag)
        for e in range(1, len(out)):
            out[e] = e in elements or out[self.parent[e]]
        return out

    def scores(self) -> dict[int, float]:
        """Containers and their scores."""
        size: dict[int, float] = {}
        for element, _, text, link in self.texts:
            n = len(text.strip())
            size[self.box[element]] = size.get(self.box[element], 0.0) + (-n if link else n)
        out: dict[int, float] = {}
        for element, n in size.items():
            out[element] = out.get(element, 0.0) + OWN * n * (ARTICLE if self.tag[element] in ("article", "main") else 1)
            if element:
                up = self.box[self.parent[element]]
                out[up] = out.get(up, 0.0) + CHILD * n
        return out

    def prose(self) -> list[int]:
        """Of each element, the characters outside links in those of its blocks that are not mostly links."""
        plain: dict[int, int] = {}
        for _, block, text, link in self.texts:
            n = len(text.strip())
            plain[block] = plain.get(block, 0) + (-n if link else n)
        out = [0] * len(self.tag)
        for element, block, text, link in self.texts:
            if not link and plain[block] > 0:
                out[element] += len(text.strip())
        return self._summed(out)

    def _summed(self, own: list[int]) -> list[int]:
        """Of each element, the sum over itself and all that it holds."""
        for element in range(len(own) - 1, 0, -1):
            own[self.parent[element]] += own[element]
        return own

    def _filled(self) -> list[int]:
        """Of each element, how many of its texts are not blank."""
        out = [0] * len(self.tag)
        for element, _, text, _ in self.texts:
            out[element] += bool(text.strip())
        return self._summed(out)

    def best(self) -> int:
        """The container of the greatest score, the first of equals, widened to its text's other parts; the whole page if none scores."""
        scores = self.scores()
        top = min(scores, key=lambda e: (-scores[e], e), default=0)
        return self._widened(top) if scores.get(top, 0) > 0 else 0

    def _widened(self, element: int) -> int:
        """The container around an element that holds the parts beside it: up to its article or main, and where more than a rest is outside."""
        prose, up = self.prose(), self.parent[element]
        while up > 0 and self.tag[element] not in ("article", "main"):
            if self.tag[up] in CONTAINERS:
                outer = self.tag[up] in ("body", "html")
                part = self.tag[element] in ("section", "blockquote") and not outer
                if part or self.tag[up] in ("article", "main") or prose[up] - prose[element] > (BODY_REST if outer else REST) * prose[up]:
                    element = up
            up = self.parent[up]
        return element

    def own_texts(self) -> Iterator[tuple[int, str]]:
        """(path, text) of the elements outside articles that have text of their own."""
        own: dict[int, list[str]] = {}
        for element, _, text, _ in self.texts:
            if not self.inside[element]:
                own.setdefault(element, []).append(text)
        for element, parts in own.items():
            if text := " ".join("".join(parts).split()):
                yield self.path[element], text

    def on_path(self, path: int | None) -> list[int]:
        """The elements on a path that have text; only the best one where all are mostly links."""
        filled = self._filled() if path is not None else []
        found = [e for e in range(1, len(filled)) if not self.out[e] and self.path[e] == path and filled[e]]
        prose = self.prose() if len(found) > 1 else []
        if len(found) > 1 and not any(prose[e] for e in found):
            scores = self.scores()
            return [min(found, key=lambda e: (-scores.get(e, 0.0), e))]
        return [e for e in found if prose[e]] if len(found) > 1 else found

    def main(self, path: int | None) -> str:
        """The page's main text: of the elements on the path, or else of those on its best container's own path."""
        elements = self.on_path(path)
        if not elements:
            top = self.best()
            elements = self.on_path(self.path[top]) or [top]
        return self.text(self._heading(elements) + elements)

    def _heading(self, elements: list[int]) -> list[int]:
        """The heading before elements that hold none: the last h1, or else the last h2 beside them or around them."""
        first, filled = elements[0], self._filled()
        inside = {self.tag[e] for x in elements for e in range(x, self.end[x])}
        for level in ("h1", "h2"):
            found = [e for e in range(1, first) if self.tag[e] == level and not self.out[e] and filled[e]]
            if level == "h2":
                found = [e for e in found if first < self.end[self.parent[e]]]
            if level in inside or found:
                return [] if level in inside else found[-1:]
        return []

    def text(self, elements: list[int]) -> str:
        """Blocks of elements in page order, white space made one space."""
        blocks: dict[int, list[str]] = {}
        held = {e for x in elements for e in range(x, self.end[x])}
        for e, block, text, _ in self.texts:
            if e in held:
                blocks.setdefault(block, []).append(text)
        return " ".join(t for parts in blocks.values() if (t := " ".join("".join(parts).split())))


def host_of(url: str = "url"):
    return F.coalesce(F.regexp_extract(F.lower(F.col(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))


VOTE = [("host", pa.string()), ("kind", pa.int32()), ("path", pa.int64()), ("text", pa.int64()), ("main", pa.int64()), ("score", pa.float64()), ("named", pa.string())]


def votes(pages: DataFrame) -> DataFrame:
    """What each page says of its host's paths.

    kind 1: the path (and its name) of the best container, with its score; pages
    without text do not vote. kind 2: hashes of the texts that elements outside
    articles have of their own, and of the page's main text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                out = []
                for host, source in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                    page = Page(source or "")
                    if top := page.best():
                        out.append((host, 1, page.path[top], None, None, page.scores()[top], page.named_path(top)))
                        main = hash_of(page.text([top]))
                        for path, text in page.own_texts():
                            row = (host, 2, path, hash_of(text), main, None, None)
                            if row not in seen:
                                if len(seen) >= REMEMBERED:
                                    seen.clear()
                                seen.add(row)
                                out.append(row)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), VOTE)], names=[n for n, _ in VOTE])

    schema = "host string, kind int, path long, text long, main long, score double, named string"
    return pages.select(host_of().alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(run, schema)


def consensus(pages: DataFrame) -> DataFrame:
    """host, path, named: the path with most votes, then the greatest summed score, then the least; theirs: the paths of the host's own texts."""
    said = written(votes(pages), "votes")
    tally = said.where("kind = 1").groupBy("host", "path").agg(F.count("*").alias("n"), F.round(F.sum("score"), 3).alias("total"), F.min("named").alias("named"))
    best = tally.groupBy("host").agg(F.max_by(F.struct("path", "named"), F.struct("n", "total", -F.col("path"))).alias("best"))
    texts = said.where("kind = 2").groupBy("host", "path", "text").agg(F.count_distinct("main").alias("mains"))
    shares = texts.groupBy("host", "path").agg(F.sum("mains").alias("n"), F.sum(F.when(F.col("mains") >= HOST_PAGES, F.col("mains")).otherwise(0)).alias("same"))
    theirs = shares.where(F.col("same") >= HOST_SHARE * F.col("n")).groupBy("host").agg(F.array_sort(F.collect_list("path")).alias("theirs"))
    out = written(best.join(theirs, "host", "left").select("host", "best.path", "best.named", "theirs"), "hosts")
    discard(said)
    return out


def extract(pages: DataFrame) -> DataFrame:
    """One row for each row of ``pages``: page_id, url, text (empty if none), path (of the host, null without votes).

    Null and empty pages have empty texts; very long and deep ones are read
    whole; pages without a readable url share one host; ties between paths are
    decided by their hashes; repeated rows stay; an empty table gives no rows;
    other columns are ignored. A bare text without markup is its own main text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                texts = []
                for source, path, theirs in zip(*(part.column(c).to_pylist() for c in ("html", "path", "theirs"))):
                    texts.append(Page(source or "", frozenset(theirs or ())).main(path))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), part.column("named")], names=["page_id", "url", "text", "path"])

    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    met = base.withColumn("host", host_of()).join(consensus(base), "host", "left").select("page_id", "url", "html", "path", "theirs", "named")
    return met.mapInArrow(run, "page_id long, url string, text string, path string")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
