"""N-gram Jaccard join: count vectors in an R-tree, exact verification, and the components that links form.

A document is the set of its distinct word shingles. Shingles are hashed into
groups, and the group counts are a point; the sum of the lesser coordinates of
two points bounds how many shingles their documents share. Points are packed
into an R-tree, whose boxes' upper corners bound whole subtrees; pairs that the
bound admits are verified on the sets.

A tree over a whole corpus would compare nearly everything with everything (in
as many dimensions as the bound needs, boxes overlap), so trees are built where
a pair can be at all: sets that are similar enough share a token of their
prefixes, that is of the first ``n - ceil(t n) + 1`` tokens in an order common to
all. Common tokens come last in that order, so that passages which many
documents share bring no one together.

What is joined are sets, named by 128 bits; equal sets are one node.

1. Common tokens are counted (any set of them gives right results).
2. Prefix tokens that two sets of like sizes share make buckets; buckets of the
   same members are one. Trees over the members' points find pairs that the bound admits. A
   bucket adds no more edges than it has members less one: each chunk of a large
   bucket joins its own members first, and only the boxes of what it joined meet
   those of other chunks. Few of the tokens are taken first; buckets all of whose
   members these have joined are not looked at again.
3. Components of these pairs are blocks: all links lie inside blocks. Each
   member's set is shipped to its block, and trees there find and verify links.
   Links that only confirm a known connection are skipped, not looked for. In
   large blocks, members are compared with one of them, the hub; those linked to
   it need not meet each other, only those that are not.
4. The components of the links, and of sets that share a doc_id, are the result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.shared import discard, written
from tessella.llm.components import components

#: A token is common if so many documents have it in their prefix, counted by task. Of common tokens the most frequent are
#: taken, as many as this broadcast table holds (8 bytes each); the others keep their places in the order, which costs
#: larger buckets, never links.
COMMON, MOST_COMMON = 50, 1_000_000
#: One of so many tokens is taken first.
FIRST_OF = 8
#: Members of a chunk of a bucket (points) and of a block (sets), points of a leaf.
POINTS, SETS, LEAF = 512, 128, 16
#: Members of a tile's side in blocks of more than SETS members, and shingles of its hub times members that bound it.
LEAST_TILE, TILE, TILE_SHINGLES = 32, 512, 1 << 21
#: Sets in blocks up to which their names are broadcast to fetch their texts (about 100 bytes each).
FEW_NODES = 200_000
#: Names and edges that a task remembers, so as not to pass them on twice.
REMEMBERED = 500_000
SLICE = 256
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = x + M1
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words (A-Z lower-cased; white space is ASCII); of all words if there are fewer."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    k = min(width, len(w))
    n = len(w) - k + 1
    out = mixed(w[:n] + np.uint64(k))
    for i in range(1, k):
        out = mixed(out ^ w[i : i + n])
    return np.unique(out)


def set_key(s: np.ndarray) -> bytes:
    """A 128-bit name of a set."""
    return xxhash.xxh3_128_digest(s.tobytes())


def least_share(n: int | np.ndarray, num: int, den: int):
    """How many of its n shingles a set shares with any set linked to it, at least."""
    return -(-num * n // den)


def needed(a, b, num: int, den: int):
    """How many shingles sets of a and b must share: the least i with den * i >= num * (a + b - i)."""
    return -(-num * (a + b) // (den + num))


def prefix(s: np.ndarray, num: int, den: int, common: np.ndarray) -> np.ndarray:
    """The set's first tokens, common ones last, that it must share one of with any set linked to it."""
    size = len(s) - least_share(len(s), num, den) + 1 if len(s) else 0
    if len(common) and len(s):
        at = np.searchsorted(common, s)
        is_common = common[np.minimum(at, len(common) - 1)] == s
        s = np.concatenate([s[~is_common], s[is_common]])
    return s[:size]


def groups_for(n: int) -> int:
    """Coordinates of a set's point: a power of two near an eighth of its size."""
    return 1 << min(12, max(5, (n // 8).bit_length()))


def counts(s: np.ndarray, groups: int) -> np.ndarray:
    return np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups)


def folded(point: np.ndarray, groups: int) -> np.ndarray:
    return point.reshape(-1, groups).sum(axis=0)


class CountTree:
    """Points packed into leaves by splitting the widest coordinate; boxes are upper corners and least sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, num: int, den: int):
        self.points, self.sizes, self.num, self.den = points, sizes, num, den
        self.leaves: list[np.ndarray] = []
        self._pack(np.arange(len(sizes)))
        self.upper = np.stack([points[x].max(axis=0) for x in self.leaves])
        self.least = np.array([sizes[x].min() for x in self.leaves])
        self.most = np.array([sizes[x].max() for x in self.leaves])

    def _pack(self, members: np.ndarray) -> None:
        if len(members) <= LEAF:
            self.leaves.append(members)
            return
        spread = np.concatenate([self.points[members], self.sizes[members][:, None]], axis=1)
        axis = int(np.argmax(spread.max(axis=0) - spread.min(axis=0)))
        order = members[np.argsort(spread[:, axis], kind="stable")]
        half = (len(order) // 2 + LEAF - 1) // LEAF * LEAF if len(order) > 2 * LEAF else len(order) // 2
        self._pack(order[:half])
        self._pack(order[half:])

    def partners(self, q: int, labels: np.ndarray | None = None) -> np.ndarray:
        """Members after q that the bound admits as linked to it; with ``labels``, of other labels only."""
        point, size = self.points[q], self.sizes[q]
        low, high = least_share(size, self.num, self.den), size * self.den // self.num
        if len(self.leaves) == 1:
            found = np.arange(q + 1, len(self.sizes))
        else:
            boxes = (self.most >= low) & (self.least <= high)
            boxes[boxes] = np.minimum(self.upper[boxes], point).sum(axis=1) >= needed(size, np.maximum(self.least[boxes], low), self.num, self.den)
            if not boxes.any():
                return np.empty(0, dtype=np.int64)
            found = np.concatenate([self.leaves[i] for i in np.flatnonzero(boxes)])
            found = found[found > q]
        if labels is not None:
            found = found[labels[found] != labels[q]]
        n = self.sizes[found]
        found, n = found[(n >= low) & (n <= high)], n[(n >= low) & (n <= high)]
        return found[np.minimum(self.points[found], point).sum(axis=1) >= needed(size, n, self.num, self.den)]


def point_of(s: np.ndarray) -> bytes:
    """A set's point as bytes; none if a count is above 255 (then nothing bounds the set)."""
    c = counts(s, groups_for(len(s)))
    return c.astype(np.uint8).tobytes() if c.max(initial=0) < 256 else b""


def packed(point: bytes) -> bytes:
    """A point as it travels: small counts take few bits each."""
    return zlib.compress(point, 1)


def admitted(points: list[bytes], sizes: np.ndarray, labels: np.ndarray, num: int, den: int) -> np.ndarray:
    """``labels`` (members' places, equal where they are joined already) after joining all pairs that the bound admits: the least of each part."""
    bound = [i for i, p in enumerate(points) if p]
    if len(bound) < len(points):  # an unbounded set may be linked with any
        return np.full(len(points), labels.min()) if len(points) > 1 else labels
    if len(points) == 2:
        a, b = (np.frombuffer(p, dtype=np.uint8) for p in points)
        small, large = sorted(sizes.tolist())
        if labels[0] == labels[1] or small < least_share(large, num, den):
            return labels
        groups = min(len(a), len(b))
        a, b = (x if len(x) == groups else folded(x.astype(np.int64), groups) for x in (a, b))
        return np.full(2, labels.min()) if int(np.minimum(a, b).sum()) >= needed(small, large, num, den) else labels
    labels = labels.copy()
    # Linked sets' points have as many coordinates, or few times as many: each such class is folded to its own least number.
    for groups in sorted({len(points[i]) for i in bound}):
        own = np.array([i for i in bound if groups <= len(points[i]) <= groups << ((den // num).bit_length())])
        if len(own) < 2 or (labels[own] == labels[own[0]]).all():
            continue
        tree = CountTree(np.stack([folded(np.frombuffer(points[i], dtype=np.uint8).astype(np.int64), groups) for i in own]), sizes[own], num, den)
        for q in range(len(own)):
            found = tree.partners(q, labels[own])
            if len(found):
                parts = np.unique(labels[own[np.append(found, q)]])
                labels[np.isin(labels, parts)] = parts[0]
                if (labels[own] == labels[own[0]]).all():
                    break
    return labels


def box_of(points: list[bytes], sizes: np.ndarray) -> tuple[bytes, int, int]:
    """Upper corner of points (32-bit counts, in the least of their numbers of groups; none if one is unbounded), least and greatest size."""
    if not all(points):
        return b"", int(sizes.min()), int(sizes.max())
    groups = min(map(len, points))
    upper = np.max([folded(np.frombuffer(p, dtype=np.uint8).astype(np.int32), groups) for p in points], axis=0)
    return upper.astype(np.int32).tobytes(), int(sizes.min()), int(sizes.max())


def boxes_admitted(uppers: list[bytes], low: np.ndarray, high: np.ndarray, labels: np.ndarray, side: np.ndarray, cross: bool, num: int, den: int) -> np.ndarray:
    """``labels`` after joining boxes between which the bound admits a pair; with ``cross``, only boxes of different sides meet."""
    labels = labels.copy()
    free = np.array([not u for u in uppers])
    groups = np.array([len(u) // 4 or 1 << 30 for u in uppers])
    points = {g: np.stack([folded(np.frombuffer(u, dtype=np.int32).astype(np.int64), g) if len(u) >= 4 * g else np.zeros(g, dtype=np.int64) for u in uppers]) for g in sorted(set(groups.tolist()) - {1 << 30})}
    for q in range(len(uppers) - 1):
        rest = np.arange(q + 1, len(uppers))
        rest = rest[(labels[rest] != labels[q]) & ((side[rest] != side[q]) | (not cross))]
        fit = (high[rest] >= least_share(low[q], num, den)) & (high[q] >= least_share(low[rest], num, den))
        rest, near = rest[fit], []
        for g in np.unique(np.minimum(groups[rest], groups[q])).tolist():
            own = rest[np.minimum(groups[rest], groups[q]) == g]
            if g == 1 << 30:
                near.append(own)
                continue
            bound = np.minimum(points[g][own], points[g][q]).sum(axis=1)
            near.append(own[(bound >= needed(low[q], low[own], num, den)) | free[own] | free[q]])
        found = np.concatenate(near) if near else rest
        if len(found):
            parts = np.unique(labels[np.append(found, q)])
            labels[np.isin(labels, parts)] = parts[0]
    return labels


def is_link(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


def linked(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets."""
    sizes = np.array([len(s) for s in sets])
    groups = groups_for(int(np.median(sizes)))
    tree = CountTree(np.stack([counts(s, groups) for s in sets]).astype(np.int32), sizes, num, den)
    labels, out = np.arange(len(sets)), []
    for q in range(len(sets)):
        for x in tree.partners(q, labels).tolist():
            if labels[q] != labels[x] and is_link(sets[q], sets[x], num, den):
                labels[labels == labels[x]] = labels[q]
                out.append((q, x))
    return out


def linked_apart(more: list[np.ndarray], less: list[np.ndarray], sizes: np.ndarray, side: np.ndarray, cross: bool, num: int, den: int, joined: np.ndarray) -> list[tuple[int, int]]:
    """``linked`` for sets given by what they have more than their hub and what they lack of it; with ``cross``, between the two sides.

    Two sets differ by as much as their differences from the hub do. What a set
    has more and what it lacks are counted apart, coarsely and then finely, and
    the counts' distance is no more than the sets' own. Those ``joined`` (to the
    hub) are of one label from the beginning.
    """
    groups = 1 << min(11, max(6, int(np.median([len(m) + len(x) for m, x in zip(more, less)])).bit_length()))
    fine = np.stack([np.concatenate([counts(m, groups), counts(x, groups)]) for m, x in zip(more, less)]).astype(np.int16)
    coarse = fine.reshape(len(more), 2, -1, 32).sum(axis=2).reshape(len(more), -1).astype(np.int16)
    labels, out = np.arange(len(more)), []
    if joined.any():
        labels[joined] = labels[joined].min()
    differ = lambda a, b: len(a) + len(b) - 2 * len(np.intersect1d(a, b, assume_unique=True))
    for q in range(len(more) - 1):
        rest = np.flatnonzero(labels[q + 1 :] != labels[q]) + q + 1
        if cross:
            rest = rest[side[rest] != side[q]]
        most = sizes[rest] + sizes[q] - 2 * needed(sizes[q], sizes[rest], num, den)
        for points in (coarse, fine):
            near = np.abs(points[rest] - points[q]).sum(axis=1, dtype=np.int64) <= most
            rest, most = rest[near], most[near]
        for x, limit in zip(rest.tolist(), most.tolist()):
            if labels[q] != labels[x] and differ(more[q], more[x]) + differ(less[q], less[x]) <= limit:
                labels[labels == labels[x]] = labels[q]
                out.append((q, x))
    return out


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """Rows as Python values, one at a time; Spark bounds the bytes of a batch."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield [batch.column(c)[k].as_py() for c in range(batch.num_columns)]


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, SLICE):
            yield batch.slice(k, SLICE)


def common_tokens(docs: DataFrame, width: int, num: int, den: int) -> np.ndarray:
    """Tokens that many prefixes hold, over all documents; those that come once in a task's documents are not passed on."""
    none = np.empty(0, dtype=np.uint64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def passed() -> pa.RecordBatch:
            token, n = np.unique(np.concatenate(held), return_counts=True)
            token, n = token[n > 1], n[n > 1]
            return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], names=["token", "n"])

        for part in slices(batches):
            for text in part.column("text").cast(pa.binary()).to_pylist():
                held.append(prefix(shingles(text, width), num, den, none))
                size += len(held[-1])
            if size > 4_000_000:
                yield passed()
                held, size = [], 0
        if held:
            yield passed()

    found = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    rows = found.orderBy(F.desc("n"), "token").limit(MOST_COMMON).select("token").toPandas()
    return np.sort(rows["token"].to_numpy(dtype=np.int64).view(np.uint64))


def features(docs: DataFrame, width: int, num: int, den: int, common: np.ndarray) -> DataFrame:
    """doc_id, row_hash (of the text), n, node (the set's name) of each row; tokens (prefix) and point where ``first``: once for each node and task."""
    shared = docs.sparkSession.sparkContext.broadcast(common)
    fields = ["doc_id", "row_hash", "n", "node", "tokens", "point", "first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for part in slices(batches):
            sets = [shingles(t, width) for t in part.column("text").cast(pa.binary()).to_pylist()]
            nodes, first = [set_key(s) for s in sets], []
            for node in nodes:
                first.append(node not in seen)
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(node)
            none = np.empty(0, dtype=np.uint64)
            tokens = [prefix(s, num, den, shared.value) if f else none for s, f in zip(sets, first)]
            offsets = np.cumsum([0, *map(len, tokens)], dtype=np.int32)
            flat = np.concatenate(tokens).view(np.int64)
            points = [packed(point_of(s)) if f else None for s, f in zip(sets, first)]
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            columns = [part.column("doc_id"), part.column("row_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.binary()), lists, pa.array(points, pa.binary()), pa.array(first)]
            yield pa.RecordBatch.from_arrays(columns, names=fields)

    return docs.select("doc_id", "row_hash", "text").mapInArrow(run, "doc_id long, row_hash long, n long, node binary, tokens array<long>, point binary, first boolean")


EDGE = [("a", pa.binary()), ("b", pa.binary())]
CLUSTER = [("token", pa.int64()), ("root", pa.binary()), ("upper", pa.binary()), ("low", pa.int64()), ("high", pa.int64())]


def batch_of(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


class Once:
    """Says of edges whether a task passes them on for the first time, as far as it remembers."""

    def __init__(self):
        self.seen: set[tuple[bytes, bytes]] = set()

    def __call__(self, edge: tuple[bytes, bytes]) -> bool:
        if edge in self.seen:
            return False
        if len(self.seen) >= REMEMBERED:
            self.seen.clear()
        self.seen.add(edge)
        return True


def sized(members: DataFrame, num: int, den: int) -> DataFrame:
    """``members`` (token, node, n, label) with ``bucket``: a token and a class of sizes with the next one.

    Sizes of linked sets are in one class or in two that follow each other (a
    class is a little wider than the ratio that links allow), so each member is
    in two buckets, and sets of too different sizes meet in none.
    """
    place = F.floor(F.log(F.col("n").cast("double")) / (math.log(den / num) * (1 + 1e-6)))
    return members.select(F.explode(F.array(F.xxhash64("token", place), F.xxhash64("token", place - 1))).alias("bucket"), "node", "n", F.when(F.col("label") != F.col("node"), F.col("label")).alias("label"))


def bucket_edges(members: DataFrame, points: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (a, b) between labels whose components hold all links inside the buckets of ``members`` (token, node, n, label).

    ``points``: node, point. Of buckets that have the same members one is taken
    (told by their number and two hashes), and none whose members have one label.
    """
    # A label that is the node itself is null on the way. Most buckets have one member: they go by their number alone, before anything else is shuffled.
    every, named, labelled = sized(members, num, den), F.xxhash64("node"), F.xxhash64(F.coalesce("label", "node"))
    several = every.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1").select("bucket")
    rows = written(every.join(several, "bucket"), "rows")
    sums = (F.count("*").alias("m"), F.bit_xor(named).alias("all"), F.min(named).alias("hub"), F.min(labelled).alias("low"), F.max(labelled).alias("high"))
    buckets = rows.groupBy("bucket").agg(*sums).where("low != high")
    buckets = written(buckets.groupBy("m", "all", "hub").agg(F.min("bucket").alias("bucket")).select("bucket", "m", "hub"), "buckets")
    inside = written(rows.join(buckets, "bucket").select(F.col("bucket").alias("token"), "node", "n", "label", "m", (named == F.col("hub")).alias("is_hub")), "inside")
    discard(rows)
    held = points.join(inside.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("point").alias("point"))
    chunks = F.ceil(F.col("m") / POINTS).cast("int")
    # The hub goes to every chunk and is first there, so that what is joined to it has one root throughout.
    own = F.when(F.col("is_hub"), F.sequence(F.lit(0), chunks - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), chunks).cast("int")))
    dealt = inside.join(held, "node").select("token", F.explode(own).alias("c"), chunks.alias("k"), F.struct("node", "n", "label", "point", "is_hub").alias("member"))
    chunked = dealt.groupBy("token", "c").agg(F.first("k").alias("k"), F.collect_list("member").alias("members"))  # about POINTS members

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new = Once()
        for token, _, k, chunk in rows_of(batches):
            chunk.sort(key=lambda m: (not m["is_hub"], m["node"]))
            names = [m["label"] or m["node"] for m in chunk]
            place: dict[bytes, int] = {}
            labels = np.array([place.setdefault(x, i) for i, x in enumerate(names)])
            points, sizes = [zlib.decompress(m["point"]) for m in chunk], np.array([m["n"] for m in chunk])
            labels = admitted(points, sizes, labels, num, den)
            rows = [(*e, None, None, None, None, None) for i, x in enumerate(labels.tolist()) if names[i] != names[x] and new(e := (names[i], names[x]))]
            if k > 1:
                for x in np.unique(labels).tolist():
                    part = np.flatnonzero(labels == x)
                    rows.append((None, None, token, names[x], *box_of([points[i] for i in part], sizes[part])))
            if rows:
                yield batch_of(rows, EDGE + CLUSTER)

    found = written(chunked.mapInArrow(search, "a binary, b binary, token long, root binary, upper binary, low long, high long"), "forests")
    clusters = found.where("token is not null").select("token", "root", "upper", "low", "high")
    several = clusters.groupBy("token").agg(F.count("*").alias("m"), (F.min("root") != F.max("root")).alias("open")).where("open").select("token", "m")
    chunks = F.ceil(F.col("m") / POINTS).cast("int")
    dealt = clusters.join(several, "token").withColumn("c", F.pmod(F.xxhash64("root", "low", "high"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    tiles = dealt.groupBy("token", F.least("c", "other").alias("x"), F.greatest("c", "other").alias("y")).agg(F.collect_list(F.struct("root", "upper", "low", "high", "c")).alias("boxes"))  # about 2 * POINTS boxes

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new = Once()
        for _, x, y, boxes in rows_of(batches):
            boxes.sort(key=lambda m: (m["root"], m["c"]))
            place: dict[bytes, int] = {}
            labels = np.array([place.setdefault(m["root"], i) for i, m in enumerate(boxes)])
            low, high, side = (np.array([m[c] for m in boxes]) for c in ("low", "high", "c"))
            labels = boxes_admitted([m["upper"] for m in boxes], low, high, labels, side, x != y, num, den)
            edges = [e for i, x in enumerate(labels.tolist()) if boxes[i]["root"] != boxes[x]["root"] and new(e := (boxes[i]["root"], boxes[x]["root"]))]
            if edges:
                yield batch_of(edges, EDGE)

    edges = found.where("a is not null").select("a", "b").unionByName(tiles.mapInArrow(meet, "a binary, b binary"))
    out = written(edges.dropDuplicates(), "candidates")
    discard(buckets, inside, found)
    return out


def candidate_blocks(found: DataFrame, num: int, den: int) -> DataFrame:
    """node, label: the blocks; all links between different sets lie inside one."""
    once = found.where("n > 0 and first")
    rows = once.select("node", "n", F.explode("tokens").alias("token"))
    shared = written(rows.groupBy("token").count().where("count > 1").select("token"), "tokens")
    members = written(rows.join(shared, "token").groupBy("token", "node").agg(F.first("n").alias("n")), "members")
    is_first = F.pmod(F.xxhash64("token"), F.lit(FIRST_OF)) == 0
    points = once.select("node", "point")
    first_edges = bucket_edges(members.where(is_first).withColumn("label", F.lit(None).cast("binary")), points, num, den)
    first = components(first_edges)
    rest = members.where(~is_first).join(first, "node", "left")
    edges = bucket_edges(rest.select("token", "node", "n", "label"), points, num, den)
    out = components(edges.unionByName(first.select(F.col("node").alias("a"), F.col("label").alias("b"))))
    discard(shared, members, first_edges, first, edges)
    return out


LINK = [*EDGE, ("tile", pa.int32()), ("joined", pa.bool_()), ("n", pa.int64()), ("more", pa.binary()), ("less", pa.binary())]


def block_links(docs: DataFrame, found: DataFrame, blocks: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Links (a, b) that join what is linked inside each block of ``blocks`` (node, label)."""
    sizes = blocks.groupBy("label").agg(F.count("*").alias("m"))
    texts_at = found.where("first").groupBy("node").agg(F.min(F.struct("row_hash", "doc_id")).alias("at"))
    table = written(blocks.join(sizes, "label").join(texts_at, "node").select("node", "label", "m", F.col("at.row_hash").alias("at_hash"), F.col("at.doc_id").alias("at_id")), "blocks")
    same = (F.col("row_hash") == F.col("at_hash")) & F.col("doc_id").eqNullSafe(F.col("at_id"))
    texts = docs.join(F.broadcast(table) if table.count() <= FEW_NODES else table, same)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for part in slices(batches):
            rows = []
            for node, label, m, text in zip(*(part.column(c).to_pylist() for c in ("node", "label", "m")), part.column("text").cast(pa.binary()).to_pylist()):
                if node not in seen:
                    s = shingles(text, width)
                    if set_key(s) == node:  # else another text of that hash
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add(node)
                        rows.append((node, label, m, s.tobytes()))
            if rows:
                yield batch_of(rows, [("node", pa.binary()), ("label", pa.binary()), ("m", pa.int64()), ("s", pa.binary())])

    members = texts.select("node", "label", "m", "text").mapInArrow(sets, "node binary, label binary, m long, s binary")
    chunks = F.ceil(F.col("m") / SETS).cast("int")
    own = F.array(F.pmod(F.xxhash64("node"), chunks).cast("int"))
    dealt = members.withColumn("c", F.explode(F.when(F.col("node") == F.col("label"), F.sequence(F.lit(0), chunks - 1)).otherwise(own)))
    # About SETS members; repeated rows, which several tasks may have read, are one member of the set.
    once = dealt.groupBy("label", "c").agg(F.first("m").alias("m"), F.collect_set(F.struct("node", "s")).alias("members"))

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for label, c, m, chunk in rows_of(batches):
            chunk.sort(key=lambda x: x["node"])
            held = [np.frombuffer(x["s"], dtype=np.uint64) for x in chunk]
            if m <= SETS:
                out = [(chunk[i]["node"], chunk[j]["node"], None, None, None, None, None) for i, j in linked(held, num, den)]
            else:
                hub = next(s for x, s in zip(chunk, held) if x["node"] == label)
                tile = max(LEAST_TILE, min(TILE, TILE_SHINGLES // len(hub)))
                out = [(label, label, tile, True, len(hub), b"", b"")] if not c else []
                for x, s in zip(chunk, held):
                    if x["node"] != label:
                        joined = is_link(s, hub, num, den)
                        out.append((x["node"], label, tile, joined, len(s), np.setdiff1d(s, hub, assume_unique=True).tobytes(), np.setdiff1d(hub, s, assume_unique=True).tobytes()))
            if out:
                yield batch_of(out, LINK)

    linked_in = written(once.mapInArrow(inside, "a binary, b binary, tile int, joined boolean, n long, more binary, less binary"), "links")
    discard(table)
    edges = linked_in.where("a != b and (tile is null or joined)").select("a", "b")
    large = linked_in.where("tile is not null")
    if large.where("not joined").isEmpty():
        return edges
    # Members that the hub is not linked to meet each other and the others.
    stats = large.groupBy("b").agg(F.sum(F.when(F.col("joined"), 0).otherwise(1)).alias("u"), F.sum(F.when(F.col("joined"), 1).otherwise(0)).alias("j"), F.max("tile").alias("tile")).where("u > 0")
    met = large.drop("tile").join(stats, "b")
    parts = lambda c: F.ceil(F.col(c) / F.col("tile")).cast("int")
    place = lambda c: F.pmod(F.xxhash64("a"), parts(c)).cast("int")
    pair = lambda x, y, kind: F.struct(x.alias("x"), y.alias("y"), F.lit(kind).alias("kind"))
    others, with_joined = F.sequence(F.lit(0), parts("u") - 1), F.sequence(F.lit(0), parts("j") - 1)
    apart = F.concat(F.transform(others, lambda o: pair(F.least(place("u"), o), F.greatest(place("u"), o), "apart")), F.transform(with_joined, lambda y: pair(place("u"), y, "joined")))
    tile = F.when(F.col("joined"), F.transform(others, lambda x: pair(x, place("j"), "joined"))).otherwise(apart)
    dealt = met.select("b", F.explode(tile).alias("t"), F.struct("a", "joined", "n", "more", "less", F.when(F.col("joined"), -1).otherwise(place("u")).alias("c")).alias("member"))
    tiles = dealt.groupBy("b", "t").agg(F.collect_list("member").alias("members"))  # about 2 * tile

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t, tile in rows_of(batches):
            tile.sort(key=lambda m: m["a"])
            more, less = ([np.frombuffer(m[c], dtype=np.uint64) for m in tile] for c in ("more", "less"))
            sizes, side, joined = (np.array([m[c] for m in tile]) for c in ("n", "c", "joined"))
            cross = t["kind"] == "joined" or t["x"] != t["y"]
            if out := linked_apart(more, less, sizes, side, cross, num, den, joined):
                yield batch_of([(tile[i]["a"], tile[j]["a"]) for i, j in out], EDGE)

    return edges.unionByName(written(tiles.mapInArrow(between, "a binary, b binary"), "between"))


def jaccard_components(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """doc_id, n_shingles, component_id of each row; texts link if den * |both| >= num * |either|.

    Null and blank texts have no shingles and are their own component, whatever
    others there are. A doc_id stands for all its rows: where several texts have
    one id, what is linked to any of them is linked through it. Rows with a null
    doc_id link as others do, but are not one document; their component is the
    least id that they reach, null if there is none. Repeated rows stay, very
    long texts are read whole, an empty table gives no rows, other columns are
    ignored.
    """
    text = F.col("text").cast("string")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("row_hash"))
    found = written(features(base, width, num, den, common_tokens(base, width, num, den)), "features")
    blocks = candidate_blocks(found, num, den)
    links = block_links(base, found, blocks, width, num, den)
    rows = found.where("n > 0").select("doc_id", "node", "n")
    several = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("last")).where("b != last").select("doc_id", "b")
    by_id = rows.join(several, "doc_id").select(F.col("node").alias("a"), "b")
    labels = components(links.unionByName(by_id))
    least = rows.groupBy("node").agg(F.min("doc_id").alias("least")).join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "least")
    least = written(least, "least")
    classes = least.groupBy("label").agg(F.min("least").alias("component_id"))
    full = rows.join(least.select("node", "label").join(classes, "label").select("node", "component_id"), "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = found.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.unionByName(empty)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked where sets of 3-word shingles have a Jaccard similarity of 0.9 or more."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 90, 100)
