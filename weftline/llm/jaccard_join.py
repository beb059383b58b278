"""Exact n-gram Jaccard join in metric regions: pivots, triangle-inequality windows, recursion.

Links are pairs of documents whose sets of word shingles are within Jaccard distance EPS = 1 - SIMILARITY.

1. First regions. The pivots are single shingles, and a set lies in the regions of its shingles that come first in a fixed
   order; the window that makes this exact is its first floor(EPS n) + 1 shingles: two sets without a common one there are
   further apart than EPS. Shingles that many documents share come last in the order, so that they make no regions unless
   a set has little else. A screen drops the shingles that only one set has before anything is dealt out.
2. Regions with the same members count once. In each region a histogram of each set bounds what two sets can share, which
   rejects, exactly, nearly all pairs that only share a passage; large regions are dealt by the sets' sizes and in blocks for
   that. What is left makes loose components.
3. Each loose component is joined exactly: documents are taken as pivots, each is compared with all members and linked with
   those within EPS, until every pair that isn't connected yet has had one of the two as pivot. A component of over
   MOST_SHINGLES is divided first: pivots create Voronoi regions, a document goes to its nearest pivot's region and, by the
   triangle inequality, to every region whose pivot is at most 2 EPS further; what is far from all pivots makes one region of
   its own. Regions that are still too large are joined in blocks.

Sets are told apart by 64-bit ids, which a second id of each set verifies; if two unlike sets ever share one, all ids are made
anew from another seed. Shingles are compared by 64-bit hashes.

Only components are asked for, so a group of m near copies takes about m comparisons and m rows, never m squared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, quality, screen
from .components import components

WORDS = 5
#: Links have 100 * intersection >= PER_CENT * union.
PER_CENT = 75
#: Bits of the screens (8 MB and 1 MB), documents from which a shingle comes last, members from which a region is dealt by size, members of a block then.
SCREEN_BITS, ORDER_BITS, COMMON, SMALL, BLOCK = 26, 23, 64, 128, 1024
MOST_SHINGLES, PIVOTS = 2_000_000, 8

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _C[4]
    h = (h ^ (h >> np.uint64(29))) * _C[5]
    return h ^ (h >> np.uint64(32))


def _begins(raw: np.ndarray) -> np.ndarray:
    """Where words begin in a stretch of a text: after a blank, and at its first byte unless that is one."""
    gap = _SPACE[raw]
    out = ~gap
    out[1:] &= gap[:-1]
    return out


def word_hashes(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of a block of texts, and where it begins."""
    if len(starts) == 2 and len(raw) > common.PIECE:  # one very long text
        parts = []
        for first, end, _ in common.word_pieces(raw, _begins, 0):
            h, begin = _word_hashes(raw[first:end], np.array([0, end - first]))
            parts.append((h, begin + first))
        return np.concatenate([x for x, _ in parts] or [np.zeros(0, np.uint64)]), np.concatenate([x for _, x in parts] or [np.zeros(0, np.int64)])
    return _word_hashes(raw, starts)


def _word_hashes(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = _LOWER[raw]
    gap = _SPACE[raw]
    first = ~gap
    at_start = np.zeros(len(raw), bool)
    at_start[starts[:-1][starts[:-1] < len(raw)]] = True
    first[1:] &= gap[:-1] | at_start[1:]
    begin = np.flatnonzero(first)
    last = ~gap
    last[:-1] &= gap[1:] | at_start[1:]
    stop = np.flatnonzero(last) + 1
    up, down = quality.powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return finish((total[stop] - total[begin]) * down[begin] + (stop - begin).astype(np.uint64) * _C[0]), begin


def shingle_sets(raw: np.ndarray, starts: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text of a block."""
    n_texts = len(starts) - 1
    if not len(raw):
        return [np.zeros(0, np.uint64)] * n_texts
    h, begin = word_hashes(raw, starts)
    edge = np.searchsorted(begin, starts)
    if len(h) >= words:
        rows = np.zeros(len(h) - words + 1, np.uint64)
        for k in range(words):
            rows = rows * _C[1] + h[k : len(h) - words + 1 + k]
        rows = finish(rows + np.uint64(words))
    out = []
    for k in range(n_texts):
        a, b = edge[k], edge[k + 1]
        if b - a >= words:
            own = np.sort(rows[a : b - words + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            with np.errstate(over="ignore"):
                one = np.uint64(0)
                for x in h[a:b]:
                    one = one * _C[1] + x
                out.append(finish(np.array([one + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def window(n: int) -> int:
    """How many of its n shingles, in the order, a set must show so that no link is missed."""
    return n - -(-PER_CENT * n // 100) + 1


def ordered(own: np.ndarray, late: screen.Screen) -> np.ndarray:
    m = late.has(own)
    return np.concatenate([own[~m], own[m]])[: window(len(own))] if len(own) else own


def set_id(own: np.ndarray, seed: int = 0) -> int:
    """A 64-bit identifier of a set; another seed gives another, unrelated one."""
    with np.errstate(over="ignore"):
        h = np.uint64(len(own)) * _C[2] + np.sum(finish(own * _C[3] + _C[0] + np.uint64(seed) * _C[1]), dtype=np.uint64)
    return int(finish(np.array([h], np.uint64)).view(np.int64)[0])


def histogram_size(n: int) -> int:
    """Buckets: a half to a fourth of n, from 1024 on a fourth to an eighth, which tells sets of unlike texts apart and is a small share of a set's bytes."""
    return 1 << max(5, min(14, int(n).bit_length() - (2 if n < 1024 else 3)))


def histogram(own: np.ndarray) -> bytes:
    counts = np.bincount((own & np.uint64(histogram_size(len(own)) - 1)).astype(np.int64), minlength=histogram_size(len(own)))
    return counts.astype(np.uint8 if counts.max() < 256 else np.uint32).tobytes()


def read_histogram(data: bytes, n: int) -> np.ndarray:
    size = histogram_size(n)
    return np.frombuffer(data, np.uint8 if len(data) == size else np.uint32).astype(np.int32)


def need(n: np.ndarray, m) -> np.ndarray:
    """The least intersection that links sets of n and m."""
    return -(-PER_CENT * (n + m) // (100 + PER_CENT))


def late_shingles(docs: DataFrame, text_col: str) -> screen.Screen:
    """Marks of the shingles of COMMON documents and more, as far as a task's block of texts has them thrice."""

    def run(batches):
        parts, size = [], 0

        def out():
            values, n = screen.counted(np.concatenate(parts))
            keep = n >= 3
            return pa.RecordBatch.from_arrays([pa.array(values[keep].view(np.int64)), pa.array(n[keep])], ["h", "n"])

        for batch in batches:
            for _, _, raw, starts in common.byte_blocks(common.binary_texts(batch, "text")):
                parts += shingle_sets(raw, starts)
                size += sum(map(len, parts[-(len(starts) - 1) :]))
                if size > 2_000_000:
                    yield out()
                    parts, size = [], 0
        if parts:
            yield out()

    many = common.arrow_map(docs.select(F.col(text_col).alias("text")), run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return screen.of_values(many.filter(F.col("n") >= COMMON), "h", ORDER_BITS)


def signatures(docs: DataFrame, id_col: str, text_col: str, seed: int = 0) -> DataFrame:
    """doc_id, node (set id, null for an empty set), check (another id), n, window (shingles that screens let through) and histogram of each row."""
    sc = docs.sparkSession.sparkContext
    late = sc.broadcast(late_shingles(docs, text_col))

    def hashes(raw, starts):
        got = [ordered(x, late.value) for x in shingle_sets(raw, starts)]
        return np.concatenate(got) if got else np.zeros(0, np.uint64)

    once, _ = screen.shared(docs, text_col, hashes, SCREEN_BITS)
    twice = sc.broadcast(once)
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("node", T.LongType()), T.StructField("check", T.LongType()), T.StructField("n", T.LongType()), T.StructField("window", T.ArrayType(T.LongType())), T.StructField("histogram", T.BinaryType())])

    def run(batches):
        for batch in batches:
            for first, end, raw, starts in common.byte_blocks(common.binary_texts(batch, "__text")):
                nodes, checks, sizes, windows, histograms = [], [], [], [], []
                for own in shingle_sets(raw, starts):
                    w = ordered(own, late.value)
                    w = w[twice.value.has(w)]
                    nodes.append(set_id(own, seed) if len(own) else None)
                    checks.append(set_id(own, seed + 1) if len(own) else None)
                    sizes.append(len(own))
                    windows.append(w.view(np.int64))
                    histograms.append(histogram(own) if len(w) else None)
                yield pa.RecordBatch.from_arrays([batch.column("__id").slice(first, end - first), pa.array(nodes, pa.int64()), pa.array(checks, pa.int64()), pa.array(sizes, pa.int64()), pa.array(windows, pa.list_(pa.int64())), pa.array(histograms, pa.binary())], schema.names)

    return common.written(common.arrow_map(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), run, schema), "signatures")


class Forest:
    """Union-find over 0 to m - 1, the least member as label."""

    def __init__(self, m: int):
        self.up = list(range(m))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)

    def labels(self) -> np.ndarray:
        return np.array([self.find(k) for k in range(len(self.up))])


def fitting(hists: list[np.ndarray], n: np.ndarray, forest: Forest) -> None:
    """Joins the members (in order of n) that the histograms can't tell apart; those joined already aren't compared."""
    last = np.searchsorted(n, 100 * n // PER_CENT, "right")
    wide: dict[int, tuple[int, np.ndarray]] = {}  # of a number of buckets, the first member that has it, and all members' histograms
    sizes = np.array([len(x) for x in hists])
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        wide[int(size)] = int(own[0]), np.stack([hists[k] for k in own])
    folded = {size // 2: (first, h.reshape(len(h), 2, -1).sum(axis=1)) for size, (first, h) in wide.items()}
    labels = np.arange(len(n))
    for i in range(len(n) - 1):
        js = np.arange(i + 1, last[i])
        js = js[labels[js] != labels[i]]
        own = hists[i].astype(np.int32)
        for table, part in ((wide, js[sizes[js] == len(own)]), (folded, js[sizes[js] == 2 * len(own)])):
            step = max(1, (1 << 20) // len(own))
            for k in range(0, len(part), step):
                some = part[k : k + step]
                first, h = table[len(own)]
                both = np.minimum(h[some - first], own).sum(axis=1)
                for j in some[both >= need(n[some], n[i])]:
                    if labels[j] != labels[i]:
                        forest.join(i, int(j))
                        labels[(labels == labels[i]) | (labels == labels[j])] = min(labels[i], labels[j])


def loose_links(batches):
    """Of each group of a region's members, links of each node with the first of its loose component: what the histograms can't tell apart."""
    for_out: tuple[list, list] = ([], [])
    for _, group in common.whole_groups(batches, "h"):
        n = group.column("n").to_numpy()
        order = np.argsort(n, kind="stable")
        n, nodes = n[order], group.column("node").to_numpy()[order]
        data = group.column("histogram").to_pylist()
        forest = Forest(len(n))
        fitting([read_histogram(data[k], int(m)) for k, m in zip(order, n, strict=True)], n, forest)
        for k, top in enumerate(forest.labels()):
            if top != k:
                for_out[0].append(nodes[top])
                for_out[1].append(nodes[k])
        if len(for_out[0]) > 20000:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in for_out], ["a", "b"])
            for_out = ([], [])
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in for_out], ["a", "b"])


def _large_groups(rows: DataFrame, large: DataFrame, shapes: DataFrame) -> DataFrame:
    """h (a group), node, n and histogram of the groups in which the members of large regions (h) are compared.

    Sets of sizes that a link allows lie in one layer of sizes or in the layers beside, so a member is compared with its own
    layer and the one below. A layer of over BLOCK members is dealt in blocks, a group for each two of them: only histograms
    are repeated for that.
    """
    members = rows.join(large.select("h"), "h").join(shapes.select("node", "n"), "node")
    layer = F.floor(F.log(F.col("n").cast("double")) / float(np.log(1.005 * 100 / PER_CENT)))
    members = members.select("h", "node", F.explode(F.array(layer, layer + 1)).alias("layer"))
    sizes = members.groupBy("h", "layer").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    own = F.pmod(F.xxhash64(F.lit(9), "node"), F.col("blocks"))
    dealt = members.join(sizes, ["h", "layer"]).select("h", "layer", "node", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    group = F.xxhash64("h", "layer", F.least("own", "other"), F.greatest("own", "other"))
    return dealt.select(group.alias("h"), "node").join(shapes, "node").select("h", "node", "n", "histogram")


def loose_components(sigs: DataFrame) -> DataFrame:
    """node and label of the nodes that may have links."""
    rows = sigs.filter("size(window) > 0").select("node", F.explode("window").alias("h")).groupBy("h", "node").agg(F.lit(1).alias("one")).drop("one")
    rows = common.written(rows, "regions")
    regions = rows.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("least"), F.max("node").alias("most"), F.bit_xor("node").alias("all"))  # ids are hashes: their xor tells member sets apart, and packs well where there is one
    regions = common.written(regions.filter("m > 1"), "sizes")
    same = common.written(regions.groupBy("m", "least", "most", "all").agg(F.min("h").alias("h")).select("h", "m"), "same")
    common.unwrite(regions)
    large = common.written(same.filter(F.col("m") > SMALL).select("h"), "large")
    shapes = sigs.filter("histogram is not null").select("node", "n", "histogram").dropDuplicates(["node"])
    members = rows.join(same.filter(F.col("m") <= SMALL).select("h"), "h").join(shapes, "node").select("h", "node", "n", "histogram")
    found = []  # one after the other, so that the shuffle files of one are gone before the next
    for groups in (members, _large_groups(rows, large, shapes)):
        links = common.arrow_map(groups.repartition("h").sortWithinPartitions("h"), loose_links, "a long, b long")
        found.append(common.written(links.distinct(), "loose"))
    common.unwrite(rows)
    links = found[0].unionByName(found[1])
    return components(links)


def overlaps(ids: np.ndarray, starts: np.ndarray, mark: np.ndarray, own: np.ndarray) -> np.ndarray:
    """How many of own each set (ids from starts) has; mark is a scratch of False for each id."""
    mark[own] = True
    out = common.sums(mark[ids], starts).astype(np.int64)
    mark[own] = False
    return out


def solve(sets: list[np.ndarray], forest: Forest | None = None, pivots: int = PIVOTS, sweep: int = 64) -> Forest:
    """The exact components of some sets, by pivots, Voronoi regions and recursion."""
    m = len(sets)
    forest = forest or Forest(m)
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    n = np.array([len(x) for x in sets])
    starts = np.concatenate([[0], np.cumsum(n)])
    _solve(np.arange(m), ids, starts, n, np.zeros(len(values), bool), forest, pivots, sweep)
    return forest


def _solve(members, ids, starts, n, mark, forest, pivots, sweep) -> None:
    own_ids = np.concatenate([ids[starts[k] : starts[k + 1]] for k in members])
    own_n = n[members]
    own_starts = np.concatenate([[0], np.cumsum(own_n)])
    done = np.zeros(len(members), bool)

    def compare(k: int) -> np.ndarray:
        done[k] = True
        both = overlaps(own_ids, own_starts, mark, own_ids[own_starts[k] : own_starts[k + 1]])
        for j in np.flatnonzero(both >= need(own_n, own_n[k])):
            forest.join(int(members[j]), int(members[k]))
        return 1 - both / np.maximum(1, own_n + own_n[k] - both)

    def open_() -> np.ndarray:
        """Members that may still have links outside their component: all but the largest component's."""
        labels = np.array([forest.find(int(k)) for k in members])
        tops, count = np.unique(labels, return_counts=True)
        return np.flatnonzero((labels != tops[count.argmax()]) & ~done)

    if len(members) > sweep:
        distance = np.array([compare(int(k)) for k in np.linspace(0, len(members) - 1, pivots).astype(int)])
        if len(open_()):
            eps = 1 - PER_CENT / 100
            near = distance.min(axis=0)
            inside = distance <= near + 2 * eps + 1e-9
            if (inside.sum(axis=1) <= 0.7 * len(members)).all():
                for cell in inside:
                    part = members[cell]
                    if len({forest.find(int(k)) for k in part}) > 1:
                        _solve(part, ids, starts, n, mark, forest, pivots, sweep)
                return
    while len(left := open_()):
        compare(int(left[0]))


def _solve_groups(batches):
    """node and label (least node of its component in the group) of each group's nodes."""
    for _, group in common.whole_groups(batches, "label"):
        nodes = group.column("node").to_numpy()
        nodes, first = np.unique(nodes, return_index=True)  # in order, so that the first is the least
        data = group.column("shingles")
        sets = [np.frombuffer(data[int(k)].as_buffer(), np.uint64) for k in first]
        top = solve(sets).labels()
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[top])], ["node", "label"])


def _divide(big: DataFrame) -> DataFrame:
    """Links (a, b) of the groups (label, node, shingles) that are too large for one task."""
    rows = common.written(big.withColumn("size", F.octet_length("shingles") / 8), "large")
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("m"))
    spread = F.pmod(F.xxhash64(F.lit(3), F.col("node")), F.lit(1 << 20)) / float(1 << 20)
    pivots = rows.join(sizes, "label").filter(spread * F.col("m") < PIVOTS).select("label", F.struct("node", "shingles").alias("pivot"))
    pivots = pivots.groupBy("label").agg(F.slice(F.array_sort(F.collect_list("pivot")), 1, 4 * PIVOTS).alias("pivots"))
    near = T.StructType([T.StructField(x, T.LongType()) for x in ("label", "node", "cell", "pivot")])
    eps = 1 - PER_CENT / 100
    far = 1 - 2 * eps  # a set that is further from all pivots would lie in every region: such ones make one region, with those that are within EPS of being such

    def place(batches):
        for batch in batches:
            out: list[tuple] = []
            for label, node, data, own in zip(*(batch.column(c).to_pylist() for c in ("label", "node", "shingles", "pivots")), strict=True):
                s = np.frombuffer(data, np.uint64)
                d, linked = [], []
                for p in own or ():
                    q = np.frombuffer(p["shingles"], np.uint64)
                    both = len(np.intersect1d(s, q, assume_unique=True))
                    d.append(1 - both / (len(s) + len(q) - both))
                    linked.append(both >= need(len(s), len(q)))
                least = min(d, default=1.0)
                out += [(label, node, k, own[k]["node"] if linked[k] else None) for k in range(len(d)) if least <= far and d[k] <= least + 2 * eps + 1e-9]
                if least > far - eps - 1e-9:
                    out.append((label, node, -1, None))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(4)], near.names)

    placed = rows.select("label", "node", "shingles").join(pivots, "label", "left")
    placed = common.written(common.arrow_map(placed, place, near), "cells")
    found = placed.filter("pivot is not null and pivot <> node").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    top = components(found)
    cells = placed.select("label", "cell", "node").join(top.withColumnRenamed("label", "top"), "node", "left").withColumn("top", F.coalesce("top", "node"))
    cells = cells.join(rows.select("node", "size"), "node")
    tops = cells.groupBy("label", "cell", "top").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("size"))
    of_cell = tops.groupBy("label", "cell").agg(F.max(F.struct("m", "top")).getField("top").alias("main"), F.count(F.lit(1)).alias("tops"), F.sum("size").alias("size"), F.max(F.struct("m", "size")).getField("size").alias("most"))
    of_cell = of_cell.filter("tops > 1").withColumn("blocks", F.ceil(F.col("size") / MOST_SHINGLES)).withColumn("strips", F.ceil((F.col("size") - F.col("most") + 1) / MOST_SHINGLES))
    cells = cells.join(of_cell.drop("size", "most", "tops"), ["label", "cell"]).select("label", "cell", "node", "top", "main", "blocks", "strips")
    block = F.pmod(F.xxhash64(F.lit(5), "node"), F.col("blocks"))
    strip = F.pmod(F.xxhash64(F.lit(7), "node"), F.col("strips"))
    # every member that is not of the main component meets every member: strips of the former by blocks of all
    one = cells.select("label", "cell", "node", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("strips") - 1)).alias("strip"))
    two = cells.filter("top <> main").select("label", "cell", "node", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), strip.alias("strip"))
    task = F.xxhash64("label", "cell", "block", "strip")
    parts = one.unionByName(two).select(task.alias("label"), "node").distinct().join(rows.select("node", "shingles"), "node").select("label", "node", "shingles")
    more = common.arrow_map(parts.repartition("label").sortWithinPartitions("label"), _solve_groups, "node long, label long")
    return found.unionByName(more.filter("node <> label").select(F.col("label").alias("a"), F.col("node").alias("b")))


def exact_labels(docs: DataFrame, loose: DataFrame, text_col: str, seed: int = 0) -> DataFrame:
    """node and label of the nodes with links."""
    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast(screen.of_values(loose, "node", ORDER_BITS))

    def run(batches):
        sent: set[int] = set()
        for batch in batches:
            for _, _, raw, starts in common.byte_blocks(common.binary_texts(batch, "text")):
                sets = [x for x in shingle_sets(raw, starts) if len(x)]
                nodes = np.array([set_id(x, seed) for x in sets], np.int64)
                keep = [k for k in np.flatnonzero(wanted.value.has(nodes.view(np.uint64))) if nodes[k] not in sent] if len(sets) else []
                if len(sent) < 200_000:
                    sent.update(nodes[keep].tolist())
                yield pa.RecordBatch.from_arrays([pa.array(nodes[keep] if len(sets) else [], pa.int64()), pa.array([sets[k].tobytes() for k in keep], pa.binary())], ["node", "shingles"])

    sets = common.arrow_map(docs.select(F.col(text_col).alias("text")), run, "node long, shingles binary")
    sets = common.written(sets.join(loose, "node").dropDuplicates(["node"]).select("label", "node", "shingles"), "sets")
    sizes = sets.groupBy("label").agg(F.sum(F.octet_length("shingles") / 8).alias("size"))
    large = common.written(sizes.filter(F.col("size") > MOST_SHINGLES).select("label"), "large")
    small = sets.join(large, "label", "left_anti").repartition("label").sortWithinPartitions("label")
    labels = common.arrow_map(small, _solve_groups, "node long, label long")
    if large.limit(1).count():
        labels = labels.unionByName(components(_divide(sets.join(large, "label", "left_semi"))))
    labels = common.written(labels, "labels")
    common.unwrite(sets)
    return labels


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id, n_shingles, component_id (the least id that links reach, its own included).

    Null texts and texts without words have empty sets, are linked with nothing and are their own component; equal sets
    are linked. Rows that repeat an id are alike; a null id takes part, but names a component only if no other id does.
    Empty docs give no rows; other columns are not read.
    """
    for seed in range(0, 200, 2):
        sigs = signatures(docs, id_col, text_col, seed)
        nodes = sigs.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("m"), F.min("check").alias("lo"), F.max("check").alias("hi"))
        nodes = common.written(nodes, "nodes")
        if not nodes.filter("lo <> hi").limit(1).count():
            break
        common.unwrite(sigs)  # two unlike sets have one id: another seed tells them apart
    labels = exact_labels(docs, loose_components(sigs), text_col, seed)
    named = nodes.join(labels, "node", "left").select("node", "least", "m", F.coalesce("label", "node").alias("label"))
    tops = named.groupBy("label").agg(F.min("least").alias("component_id"), F.sum("m").alias("size"))
    map_ = named.join(tops.filter("size > 1"), "label").select("node", "component_id")
    map_ = common.written(map_, "map")
    common.unwrite(nodes)
    out = sigs.select("doc_id", "n", "node").join(map_, "node", "left")
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose component has a smaller id; all columns stay, and so do rows with a null id."""
    gone = jaccard_components(docs, id_col, text_col).filter(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(common.spread(common.table(spark, sf_dir, "documents")))


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * o.i >= 75 * (p.n + q.n - o.i)
), r AS (
  SELECT doc_id, doc_id AS c FROM w
  UNION
  SELECT r.doc_id, e.y FROM r JOIN e ON r.c = e.x
)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
