"""N-gram Jaccard join with prefix trees.

Texts become sets of 64-bit shingle hashes, ordered by hash. Equal sets are one node (grouped by a hash of the set), so
copies are counted once. Two sets A, B with similarity t or more differ in at most D = (1-t)/(1+t) * (|A|+|B|) members.
The hash order is cut into D + s segments: at least s of them are equal in both sets, and two of these that are not empty
are found by their hashes (a set with more than s - 2 empty segments publishes those too). Equal
segments are shared edges of the prefix trees; they are all that is compared across the corpus. Members that a share of
all texts hold (the lines that every page has) are left out of the segments of all sets, which changes no argument above.

1. Every task publishes (segment hash, node) for its own texts; where many of them have a segment, they are linked to the
   smallest on the spot. So a segment that a third of all rows share is a few rows for each task.
2. Nodes that share two segments are linked; components of these candidate links are formed. Segments of more nodes than
   can be paired make a star of links.
3. Texts of nodes with candidates only are brought together by candidate component. There a path-compressed trie holds
   the sets in a common order (most frequent member first, so that paths are shared). Breadth-first from each set, the
   trie is walked with running overlaps; a subtree is left when what remains cannot reach the threshold or when all its
   sets are already linked. Overlaps are exact, so links are exactly those of the definition.
4. A candidate component of more than `block` nodes (or MEMBERS times as many shingles) is split by candidates of its own
   (`refined`), then cut into blocks in the order of sizes; each pair of blocks whose sizes allow links becomes a group of
   its own, ROUND block distances at a time; links of all pairs are then joined to components. No group is unbounded, no
   pair is lost, and no text is copied more than 2 * ROUND times at once.

Null and empty texts have the empty set, which links with nothing. Repeated rows share their node. Extra columns of the
input are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.shared import U64, as_long, durable, mix, pieces, release, row_key, salt, text_bytes, word_hashes

#: Ratio of successive length classes: every set publishes for its own class, a few also for the next.
CLASS_RATIO = 1.5
#: Rows that a task gathers before it publishes them.
GATHER = 1 << 18
#: Nodes of a key that a task passes on one by one; twice as many are paired with each other, more become a star.
FEW = 32
#: Buckets of the counts that rule out pairs; members on one edge of a trie, so that long edges are left early.
SKETCH, EDGE = 512, 48
#: Parts of the shuffle of segments for each usual one.
SHARES = 4
#: Members of a set on average at which a block is full.
MEMBERS = 300
#: Differences of block numbers that are compared at a time.
ROUND = 4


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts end to end, and their m + 1 offsets. A text of fewer than n words has
    its whole sequence as its one shingle."""
    data, offsets = text_bytes(column)
    w, doc = word_hashes(data, offsets)
    m = len(column)
    counts = np.bincount(doc, minlength=m)
    first = np.concatenate([[0], np.cumsum(counts)])
    factors = [salt(k + 1) | U64(1) for k in range(n)]
    full = np.flatnonzero(doc[: max(0, len(w) - n + 1)] == doc[n - 1 :]) if len(w) >= n else np.zeros(0, np.int64)
    h = np.full(len(full), salt(100 + n))
    for k in range(n):
        h += w[full + k] * factors[k]
    owner = doc[full]
    for size in range(1, n):
        short = np.flatnonzero(counts == size)
        one = np.full(len(short), salt(100 + size))
        for k in range(size):
            one += w[first[short] + k] * factors[k]
        h, owner = np.concatenate([h, one]), np.concatenate([owner, short])
    order = np.argsort(owner, kind="stable")
    h, owner = mix(h[order]), owner[order]
    ends = np.searchsorted(owner, np.arange(m + 1))
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a > 1:
            h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[keep], owner[keep]
    return h, np.searchsorted(owner, np.arange(m + 1))


def set_nodes(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each set: its node."""
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(h + salt(7)), dtype=U64)])
    return mix(sums[ends[1:]] - sums[ends[:-1]] + np.diff(ends).astype(U64) * salt(8))


class Segments:
    """Lengths, classes and numbers of segments for one threshold (a percentage)."""

    def __init__(self, percent: int):
        self.percent = percent
        top = 1 << 26
        bounds = [1]
        while bounds[-1] < top:
            bounds.append(max(bounds[-1] + 1, math.ceil(bounds[-1] * CLASS_RATIO)))
        self.bounds = np.array(bounds)  # class c: bounds[c] <= length < bounds[c + 1]
        self.differ = np.array([(100 - percent) * 2 * (b - 1) // (100 + percent) for b in bounds[1:]])
        # segments over D: two, and as many as are likely to be empty in the shortest set of the class or its partners
        self.spare = np.array([self._spare(int(d), percent / 100 * b) for d, b in zip(self.differ, bounds[:-1], strict=True)])
        # the shortest set that can have a different partner: L / (L + 1) must reach the threshold
        self.least = math.ceil(percent / (100 - percent) - 1e-9) if percent < 100 else top

    @staticmethod
    def _spare(differ: int, shortest: float) -> int:
        spare = 3
        for _ in range(30):
            many = differ + spare
            empty = many * math.exp(-shortest / many)
            spare = min(max(3, math.ceil(2 + empty + 3 * empty**0.5)), 3 + differ // 2)
        return spare

    def publish(self, h: np.ndarray, ends: np.ndarray, nodes: np.ndarray, common: np.ndarray, parts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Segment hashes and their nodes; members in `common` (sorted) are left out of the segments. Sets of different
        `parts` share no hash."""
        sizes = np.diff(ends)
        if len(common) and len(h):
            rare = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] != h
            h, ends = h[rare], np.concatenate([[0], np.cumsum(rare)])[ends]
        kept = np.diff(ends)
        own = np.searchsorted(self.bounds, sizes, "right") - 1
        nxt = np.searchsorted(self.bounds, sizes * 100 // self.percent, "right") - 1
        keys, whose = [], []
        # the own class of a larger partner is any from this set's own to that of its largest partner
        for step in range(int((nxt - own).max(initial=0)) + 1):
            classes = own + step
            docs = np.flatnonzero((sizes >= self.least) & (classes <= nxt))
            if not len(docs):
                continue
            length = kept[docs]
            at = np.repeat(ends[:-1][docs] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
            token, d = h[at], np.repeat(np.arange(len(docs)), length)
            differ = self.differ[classes[docs]]
            spare = self.spare[classes[docs]]
            many = (differ + spare).astype(U64)
            seg = ((token >> U64(32)) * many[d]) >> U64(32)
            start = np.ones(len(token), bool)
            start[1:] = (d[1:] != d[:-1]) | (seg[1:] != seg[:-1])
            start = np.flatnonzero(start)
            sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(token + salt(9)), dtype=U64)])
            stop = np.append(start[1:], len(token))[: len(start)]
            who, segment = d[start], seg[start]
            tag = mix(classes[docs].astype(U64) * salt(10) + salt(11) + (0 if parts is None else mix(parts[docs])))
            keys.append(mix(sums[stop] - sums[start] + mix(tag[who] + segment * salt(12))))
            whose.append(nodes[docs][who])
            filled = np.bincount(who, minlength=len(docs))
            for k in np.flatnonzero(many.astype(np.int64) - filled > spare - 2):  # rare: empty segments could be what is equal
                empty = np.setdiff1d(np.arange(int(many[k]), dtype=U64), segment[who == k])
                keys.append(mix(mix(tag[k] + empty * salt(12))))
                whose.append(np.full(len(empty), nodes[docs[k]]))
        if not keys:
            return np.zeros(0, U64), np.zeros(0, U64)
        return np.concatenate(keys), np.concatenate(whose)


def combine(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row for each key and node. Of more than FEW nodes of a key only the smallest stays, marked as standing for
    many, and each other one is tied to it by two keys of their own."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
    keys, nodes = keys[fresh], nodes[fresh]
    start = np.ones(len(keys), bool)
    start[1:] = keys[1:] != keys[:-1]
    group = np.cumsum(start) - 1
    low = nodes[start][group] if len(keys) else nodes
    hot = np.bincount(group)[group] > FEW if len(keys) else start
    other = hot & ~start
    x = np.unique(np.stack([nodes[other], low[other]]), axis=1) if other.any() else np.zeros((2, 0), U64)
    ties = [mix(x[0] * salt(k) + mix(x[1] + salt(k + 1))) for k in (13, 15)]
    keep = ~other
    marks = np.concatenate([hot[keep], np.zeros(4 * x.shape[1], bool)])
    return np.concatenate([keys[keep], ties[0], ties[0], ties[1], ties[1]]), np.concatenate([nodes[keep], x[0], x[1], x[0], x[1]]), marks


class Trie:
    """A path-compressed trie over sorted sets, with the number of sets not yet linked below every node."""

    def __init__(self, sets: list[list[int]], percent: int):
        self.sets, self.percent = sets, percent
        order = sorted(range(len(sets)), key=sets.__getitem__)
        # node: [members of its edge, last member, children, sets that end here, shortest, longest, unlinked, parent]
        self.leaf: list[list] = [[]] * len(sets)
        self.root = [[], -1, [], [], 0, 0, len(sets), None]
        todo = [(self.root, 0, len(order), 0)]
        while todo:
            parent, lo, hi, depth = todo.pop()
            while lo < hi and len(sets[order[lo]]) == depth:
                parent[3].append(order[lo])
                self.leaf[order[lo]] = parent
                lo += 1
            while lo < hi:
                first = sets[order[lo]][depth]
                to = bisect_right(order, first, lo, hi, key=lambda i, d=depth: sets[i][d])
                a, b = sets[order[lo]], sets[order[to - 1]]
                end = depth + 1
                while end < len(a) and end < len(b) and a[end] == b[end] and end - depth < EDGE:
                    end += 1
                sizes = [len(sets[i]) for i in order[lo:to]]
                node = [a[depth:end], a[end - 1], [], [], min(sizes), max(sizes), to - lo, parent]
                parent[2].append((node, end))
                todo.append((node, lo, to, end))
                lo = to

    def unlink(self, i: int) -> None:
        """Set i is linked: it is looked for no more."""
        node = self.leaf[i]
        node[3].remove(i)
        while node is not None:
            node[6] -= 1
            node = node[7]

    def partners(self, q: int) -> list[int]:
        """Unlinked sets whose similarity with set q reaches the threshold."""
        mine = self.sets[q]
        members, size, p = frozenset(mine), len(mine), self.percent
        found = []
        todo = [(self.root, 0, 0)]
        while todo:
            node, depth, overlap = todo.pop()
            for i in node[3]:
                if (100 + p) * overlap >= p * (size + depth) and i != q:
                    found.append(i)
            for child, end in node[2]:
                if not child[6]:
                    continue
                now = overlap + len(members.intersection(child[0]))
                rest = min(child[5] - end, size - bisect_right(mine, child[1]))
                if (100 + p) * (now + rest) >= p * (size + child[4]):
                    todo.append((child, end, now))
        return found


def near(sets: list[np.ndarray], percent: int) -> list[list[int]]:
    """Parts of the sets such that no link joins two parts.

    Members are counted in SKETCH buckets by hash. The differences of two sets' counts add up to no more than the number
    of members in which the sets differ, so pairs above what the threshold allows cannot be links.
    """
    n = len(sets)
    if n < 3:
        return [list(range(n))]
    counts = np.zeros((n, SKETCH), np.int32)
    for i, s in enumerate(sets):
        counts[i] = np.bincount((s & U64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
    sizes = np.array([len(s) for s in sets])
    left = np.arange(n)
    parts = []
    while len(left):
        part, todo = [int(left[0])], [int(left[0])]
        left = left[1:]
        while todo and len(left):
            i = todo.pop()
            differ = np.concatenate([np.abs(counts[left[k : k + 512]] - counts[i]).sum(axis=1) for k in range(0, len(left), 512)])
            on = differ * (100 + percent) <= (100 - percent) * (sizes[left] + sizes[i])
            found = left[on].tolist()
            part += found
            todo += found
            left = left[~on]
        parts.append(part)
    return parts


def linked(sets: list[np.ndarray], percent: int) -> list[int]:
    """For each set the first set of its component, over all pairs that reach the threshold."""
    root = list(range(len(sets)))
    for part in near(sets, percent):
        if len(part) > 1:
            for i, r in zip(part, _linked([sets[i] for i in part], percent), strict=True):
                root[i] = part[r]
    return root


def _linked(sets: list[np.ndarray], percent: int) -> list[int]:
    known, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(known), np.int64)
    rank[np.lexsort((known, -times))] = np.arange(len(known))
    ranked = np.split(rank[place], np.cumsum([len(s) for s in sets])[:-1])
    trie = Trie([np.sort(r).tolist() for r in ranked], percent)
    root = [-1] * len(sets)
    for i in range(len(sets)):
        if root[i] >= 0:
            continue
        root[i] = i
        trie.unlink(i)
        todo = [i]
        while todo and trie.root[6]:
            for j in trie.partners(todo.pop()):
                root[j] = i
                trie.unlink(j)
                todo.append(j)
    return root


def nodes(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, id, n_shingles long, node long, null for the empty set) of every row, written to the shared folder."""
    kept = docs.select(row_key(id_col, text_col).alias("rid"), F.col(id_col), F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "__text", 1 << 20):
            h, ends = shingle_sets(batch.column("__text"), n)
            size = np.diff(ends)
            node = pa.array(as_long(set_nodes(h, ends)), pa.int64(), mask=size == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), node], ["rid", id_col, "n_shingles", "node"])

    return durable(kept.mapInArrow(run, f"rid long, `{id_col}` {kept.schema[1].dataType.simpleString()}, n_shingles long, node long"), "nodes")


def common_shingles(docs: DataFrame, n: int, share: float = 0.002, text_col: str = "text") -> np.ndarray:
    """Hashes of shingles that about `share` of all texts or more hold: at most (mean set size / share) of them.

    Tasks count among every few thousand of their own texts and name what is common there; the counts are then added up.
    Which shingles are named affects cost only, never which pairs are found.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts = [], 0

        def out() -> pa.RecordBatch:
            h, count = np.unique(np.concatenate(held), return_counts=True)
            on = count >= max(6, share * texts)
            return pa.RecordBatch.from_arrays([pa.array(np.append(as_long(h[on]), 0)), pa.array(np.append(count[on], 0)), pa.array(np.append(np.zeros(on.sum(), np.int64), texts))], ["h", "n", "texts"])

        for batch in pieces(batches, "__text", 1 << 20):
            held.append(shingle_sets(batch.column("__text"), n)[0])
            texts += batch.num_rows
            if sum(map(len, held)) >= 4 * GATHER and texts >= 1000:
                yield out()
                held, texts = [], 0
        if texts:
            yield out()
        release()

    rows = docs.select(F.col(text_col).cast("string").alias("__text")).mapInArrow(run, "h long, n long, texts long")
    found = durable(rows.groupBy("h").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts")), "common")
    total = found.agg(F.sum("texts")).first()[0] or 0
    kept = found.where((F.col("n") >= max(30, share * total)) & (F.col("h") != 0)).select("h").toArrow()["h"].to_numpy()
    return np.sort(kept.astype(np.int64).view(U64))


def frequent_shingles(texts: DataFrame, n: int, least: int, most: int = 1 << 22) -> np.ndarray:
    """Hashes of the shingles that `least` of the texts or more hold; the count is raised until they are `most` at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def out() -> pa.RecordBatch:
            h, count = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(as_long(h)), pa.array(count)], ["h", "n"])

        for batch in pieces(batches, "text", 1 << 20):
            held.append(shingle_sets(batch.column("text"), n)[0])
            if sum(map(len, held)) >= 4 * GATHER:
                yield out()
                held = []
        if held:
            yield out()
        release()

    counts = texts.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    counts = durable(counts, "frequent")
    levels = sorted(((r.level, r.many) for r in counts.groupBy(F.floor(F.log2("n")).alias("level")).agg(F.count("*").alias("many")).collect()), reverse=True)
    total, low = 0, least
    for level, many in levels:
        total += many
        if total > most:
            low = 1 << (level + 1)
            break
    kept = counts.where(F.col("n") >= low).select("h").toArrow()["h"].to_numpy()
    return np.sort(kept.astype(np.int64).view(U64))


def candidates(docs: DataFrame, n: int, percent: int, text_col: str = "text", common: np.ndarray | None = None, part: str | None = None) -> DataFrame:
    """Edges (a, b) between nodes that share two segments; every pair that reaches the threshold is connected by them.

    `common`: hashes of members that segments leave out, else those of `common_shingles`. `part`: a column (long); texts
    of different parts are not compared.
    """
    segments = Segments(percent)
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, n, text_col=text_col) if common is None else common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, whose, held = [], [], 0

        def out() -> pa.RecordBatch:
            k, w, many = combine(np.concatenate(keys), np.concatenate(whose))
            return pa.RecordBatch.from_arrays([pa.array(as_long(k)), pa.array(as_long(w)), pa.array(many)], ["key", "node", "many"])

        for batch in pieces(batches, "__text", 1 << 20):
            h, ends = shingle_sets(batch.column("__text"), n)
            of = np.asarray(batch.column("__part")).view(U64) if part else None
            k, w = segments.publish(h, ends, set_nodes(h, ends), common.value, of)
            keys.append(k)
            whose.append(w)
            held += len(k)
            if held >= GATHER:
                yield out()
                keys, whose, held = [], [], 0
        if held:
            yield out()
        release()

    rows = docs.select(F.col(text_col).cast("string").alias("__text"), *([F.col(part).alias("__part")] if part else [])).mapInArrow(run, "key long, node long, many boolean")
    # dealt out first: tasks have counted already, and sets built next to the Python workers would take memory twice
    # and in many parts: few rows of each task are sorted in memory at a time
    parts = SHARES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = rows.repartition(parts, "key").groupBy("key").agg(F.array_sort(F.collect_set("node")).alias("nodes"), F.bool_or("many").alias("many")).where(F.size("nodes") > 1)
    few = (F.size("nodes") <= 2 * FEW) & ~F.col("many")
    rest = F.transform("nodes", lambda x, i: F.struct(x.alias("a"), F.when(few, F.slice("nodes", i + 2, 2 * FEW)).otherwise(F.array().cast("array<long>")).alias("b")))
    star = F.array(F.struct(F.get("nodes", F.lit(0)).alias("a"), F.slice("nodes", 2, F.size("nodes")).alias("b")))
    pairs = by.select(F.explode(F.when(few, rest).otherwise(star)).alias("p"), F.when(few, 1).otherwise(2).alias("w")).select("p.a", F.explode("p.b").alias("b"), "w")
    return pairs.groupBy("a", "b").agg(F.sum("w").alias("w")).where("w > 1").select("a", "b")


def refined(moved: DataFrame, parts: DataFrame, large: DataFrame, n: int, percent: int) -> DataFrame:
    """(node, root, size), the components of `large` split by candidates that leave out what many of their own sets hold.

    Candidates of the whole corpus are tied together by segments that are a star each. The more texts there are, the more
    segments of one or two widespread shingles are stars, so chance components grow faster than the input. Every pair that
    reaches the threshold is connected by these candidates too, so what they part has no link.
    """
    inside = durable(moved.join(large, "root").select("node", "root", "text"), "inside")
    again = components(candidates(inside, n, percent, common=frequent_shingles(inside, n, 2 * FEW), part="root"))
    kept = parts.join(large, "root", "left_anti").select("node", "root", "size")
    return durable(kept.union(again.join(parts.select("node", "size"), "node").select("node", "root", "size")), "refined")


def blocked(parts: DataFrame, cost: Column, percent: int) -> tuple[DataFrame, DataFrame]:
    """(node, root, block) and (root, i, j): blocks of sets in the order of their sizes, of about cost 1 each, and the
    pairs of blocks, one with itself included, whose sizes allow links."""
    level = parts.groupBy("root", "size").agg(F.count("*").alias("many"), F.min(cost).alias("cost"))
    before = Window.partitionBy("root").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    level = level.withColumn("start", F.coalesce(F.sum(F.col("many") * F.col("cost")).over(before), F.lit(0.0)))
    place = F.floor(F.col("start") + F.pmod(F.xxhash64("node"), F.col("many")) * F.col("cost")).cast("int")
    chosen = durable(parts.join(level, ["root", "size"]).select("node", "root", "size", place.alias("block")), "blocks")
    spans = chosen.groupBy("root", "block").agg(F.min("size").alias("low"), F.max("size").alias("high"))
    i, j = spans.select("root", F.col("block").alias("i"), "high"), spans.select("root", F.col("block").alias("j"), "low")
    fit = (F.col("i") <= F.col("j")) & (F.col("low") * percent <= F.col("high") * 100)
    return chosen, i.join(j, "root").where(fit).select("root", "i", "j")


def join(docs: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", block: int = 1000) -> DataFrame:
    """(rid, id, n_shingles long, component_id, class) of every row; component_id is the smallest id linked, itself included.

    `class` (long) tells components apart that share an id, as rows of one id and unlike texts do; null for empty texts.
    """
    docs = docs.select(id_col, text_col)
    all_nodes = nodes(docs, n, id_col, text_col)
    chance = components(candidates(docs, n, percent, text_col))
    chance = durable(chance, "candidates")
    first = all_nodes.where("node is not null").groupBy("node").agg(F.min("rid").alias("rid"), F.max("n_shingles").alias("size"))
    texts = docs.select(row_key(id_col, text_col).alias("rid"), F.col(text_col).cast("string").alias("text"))
    # one text for each set that has candidates; what follows reads these only
    moved = durable(texts.join(chance.join(first, "node").hint("shuffle_hash"), "rid").select("node", "root", "size", "text"), "moved")
    parts = moved.select("node", "root", "size").distinct()
    cost = F.greatest(F.lit(1.0 / block), F.col("size") / (block * MEMBERS))
    large = parts.groupBy("root").agg(F.sum(cost).alias("cost")).where("cost > 1").select("root")
    if large.head(1):
        parts = refined(moved, parts, large, n, percent)
    chosen, pairs = blocked(parts, cost, percent)
    found, reach = None, 0
    most = pairs.agg(F.max(F.col("j") - F.col("i"))).first()[0] or 0
    while reach <= most:  # so many pairs of blocks at a time that no text is there more than 2 * ROUND times at once
        now = pairs.where((F.col("j") - F.col("i")).between(reach, reach + ROUND - 1)).withColumn("g", F.xxhash64("root", "i", "j"))
        ends = now.select("root", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"), "g")
        groups = moved.select("node", "text").join(chosen.join(ends, ["root", "block"]).select("node", "g").hint("shuffle_hash"), "node").select("g", "node", "text")
        links = durable(groups.repartition("g").sortWithinPartitions("g", "node").mapInArrow(_verify(n, percent), "a long, b long"), "links")
        found = links if found is None else found.union(links)
        reach += ROUND
    links = found
    roots = components(links)
    lowest = all_nodes.groupBy("node").agg(F.min(id_col).alias("low"))
    named = roots.join(lowest, "node").groupBy("root").agg(F.min("low").alias("low"))
    labels = lowest.where("node is not null").join(roots, "node", "left").join(named.withColumnRenamed("low", "all_low"), "root", "left").select("node", F.coalesce("all_low", "low").alias("component_id"), F.coalesce("root", "node").alias("class"))
    out = all_nodes.join(labels, "node", "left")
    return out.select("rid", F.col(id_col), "n_shingles", F.coalesce("component_id", F.when(F.col("node").isNull(), F.col(id_col))).alias("component_id"), "class")


def representatives(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The row of smallest id of each class of linked texts (null ids first; among equal ids the smallest row key).

    Texts without words are linked with nothing, so all of them stay. Of rows that repeat each other one stays. Rows that
    share an id but not a class are judged apart.
    """
    groups = join(docs, n, percent, id_col, text_col, **options)
    one = groups.groupBy("class", F.when(F.col("class").isNull(), F.col("rid")).alias("alone")).agg(F.min(F.struct(F.col(id_col).alias("id"), "rid"))["rid"].alias("__rid"))
    rows = docs.withColumn("__rid", row_key(id_col, text_col))
    return rows.join(one.select("__rid").hint("shuffle_hash"), "__rid", "left_semi").dropDuplicates(["__rid"]).select(docs.columns)


def _verify(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, members, sets = None, [], []

        def links() -> pa.RecordBatch:
            root = linked(sets, percent) if len(sets) > 1 else []
            edges = [(members[r], members[i]) for i, r in enumerate(root) if r != i]
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in edges], pa.int64()), pa.array([b for _, b in edges], pa.int64())], ["a", "b"])

        for batch in pieces(batches, "text"):
            h, ends = shingle_sets(batch.column("text"), n)
            actual = as_long(set_nodes(h, ends)).tolist()
            for k, (g, node) in enumerate(zip(batch.column("g").to_pylist(), batch.column("node").to_pylist(), strict=True)):
                if g != group:
                    if len(sets) > 1:
                        yield links()
                    group, members, sets = g, [], []
                if actual[k] == node and (not members or members[-1] != node):  # repeated rows come one after the other
                    members.append(node)
                    sets.append(h[ends[k] : ends[k + 1]].copy())
        if len(sets) > 1:
            yield links()
        release()

    return run
