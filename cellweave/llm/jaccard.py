"""N-gram Jaccard join in the metric space of Jaccard distance, and the components of its links.

Texts become sets of word shingles; texts with equal sets are one class. Two classes link when intersection / union reaches the
threshold, i.e. when their distance is at most tau = 1 - threshold.

Unrelated texts all lie at distance 1 from each other and from any pivot, where no triangle inequality can tell them apart, so
regions are found through shared shingles first: two linked sets must share l of the first few of their shingles in any common order
(with m shingles, l of the first m - ceil(threshold * m) + l). Shingles known to be frequent come last in that order, which keeps
passages that many texts share out of the way. All classes with the same early shingle and sizes without a gap that no link can
span belong to the region of the smallest class among them.

A region of at most BLOCK classes is joined by one task: the early shingles part it into groups that share l of them, and only these
get whole sets, equal groups once. A larger region is split over tables until its parts are that small. A round draws up to
SPLIT_PIVOTS of its classes and takes the exact distance of every member to each, in tasks of CHUNK members. Members within R of a
pivot form its Voronoi cell; a set y of another cell q goes into the cell of p too, if d(y, p) - d(y, q) <= 2 tau and d(y, p) <=
R + tau, which by the triangle inequality hold for every y within tau of a set of p's cell. Members beyond R of all pivots are the
remainder, which takes the members beyond R - tau of their pivot too. Each of these is a region of the next round. Members within tau
of a pivot are linked to it, and pivots that share such members, or members of an earlier round's group, make one group: pairs inside a group are connected already
and need no comparison, and a region that is one group is finished. Where cells hardly shrink, because all members are near each
other, the region stays whole, and the next round draws its pivots from members without a group; after ROUNDS of these, what is still
without the largest group is compared with the whole region in blocks, as many as it takes.

Within a task a group is joined in the same way: pivots (farthest first), cells with windows, recursively, and what no window and no
group decides is compared exactly by counting common shingles. Every task gives the links of a spanning forest, and how many pairs
were decided by windows, by groups and by comparison. Components are found by large-star and small-star steps over tables.

Order, frequency table and pivots only decide where sets meet, never whether they link; every pair that can link meets, whatever
its partners, so that no link between different texts is lost.

Defined results: null or blank texts have the empty set and link with nothing; texts below k words have one shingle, the whole
sequence; texts of any length are taken whole; a null doc_id joins no component (component_id null); rows that share a doc_id count
as one vertex; repeated rows are given each; an empty table gives no rows; columns other than doc_id and text, whatever their names,
do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.llm.common import Steps, as_bytes, join_spread, materialize, parts, small_batches

#: Frequent shingles that the order knows at most; eight bytes each are broadcast.
HEAVY = 1 << 18
#: Members of a region that one task compares; larger regions are split.
BLOCK = 128
#: Pivots of a split at most, members that a task measures against them, the reach R of a pivot in tau,
#: a part's largest share of its region that is worth a split, and rounds without one before blocks.
SPLIT_PIVOTS = 64
CHUNK = 1024
REACH = 3
SHRINK = 0.7
ROUNDS = 2
#: Rows of sets and of numbers that a file of an intermediate table holds.
SET_ROWS = 2000
PAIR_ROWS = 100_000
#: Within a task: members that are compared at once, and pivots of a step.
LEAF = 64
PIVOTS = 4
#: Regions are joined in parts that hold so many times the shingles of all texts, so that disk does not grow with the regions of a text.
PART = 0.5
#: Bits of the bitmap that tells which texts are still needed.
MARKS = 1 << 23
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingles(raw: bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit names of the k-word shingles of UTF-8 text, A-Z lower-cased."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh3_64_intdigest
    w = np.fromiter(map(h, words), np.uint64, len(words))
    n = min(k, len(w))
    with np.errstate(over="ignore"):
        s = np.full(len(w) - n + 1, n, np.uint64)
        for i in range(n):
            s = _finish(s * _MIX[0] + w[i : len(w) - n + 1 + i])
    return np.unique(s)


def class_of(s: np.ndarray) -> tuple[int, int]:
    """128-bit name of a set."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64).tolist())


def early_common(m: int) -> int:
    """How many early shingles a set of m must share with whatever it links to."""
    return 1 + m // 40


def prefix_length(m: int, percent: int) -> int:
    """With the first so many shingles of both, linked sets share early_common of the smaller one at least."""
    return min(m, m - -(-percent * m // 100) + early_common(m))


class UnionFind:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)


class Region:
    """Sets of a task, joined recursively. met counts pairs to decide, by_window, by_group and compared how they were decided."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, self.tau = percent, 1 - percent / 100
        self.size = np.array([len(s) for s in sets], np.int64)
        names, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        column = np.cumsum(counts > 1) - 1  # only shingles of two sets or more matter
        keep = counts[inverse] > 1
        row = np.repeat(np.arange(len(sets)), self.size)[keep]
        col = column[inverse[keep]]
        self.columns, bounds = int((counts > 1).sum()), np.searchsorted(row, np.arange(len(sets) + 1))
        self.of = [col[a:b] for a, b in zip(bounds, bounds[1:])]
        self.met = self.by_window = self.by_group = self.compared = 0

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common shingles of each of a with each of b."""
        used = np.unique(np.concatenate([self.of[i] for i in a])) if len(a) else np.zeros(0, np.int64)
        where = np.full(self.columns + 1, -1, np.int64)
        where[used] = np.arange(len(used))
        total = np.zeros((len(a), len(b)), np.float32)
        step = max(256, (8 << 20) // max(1, len(a) + len(b)))
        left, right = [where[self.of[i]] for i in a], [x[x >= 0] for x in (where[self.of[i]] for i in b)]
        for at in range(0, len(used), step):
            wide = min(step, len(used) - at)
            total += self._dense(left, at, wide) @ self._dense(right, at, wide).T
        return total.astype(np.int64)

    @staticmethod
    def _dense(rows: list[np.ndarray], at: int, wide: int) -> np.ndarray:
        out = np.zeros((len(rows), wide), np.float32)
        for i, x in enumerate(rows):
            x = x[(x >= at) & (x < at + wide)]
            out[i, x - at] = 1
        return out

    def measure(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances of each of a to each of b, and which of these pairs link."""
        both = self.common(a, b)
        union = self.size[a][:, None] + self.size[b][None, :] - both
        return 1 - both / union, 100 * both >= self.percent * union

    def join(self, core: np.ndarray, window: np.ndarray, found: UnionFind, inner: bool = True) -> None:
        """Links between core and window and, if inner, between core and core."""
        everyone, n = np.concatenate([core, window]), len(core)
        self.met += n * len(window) + (n * (n - 1) // 2 if inner else 0)
        self._join(core, window, found, inner)

    def _join(self, core: np.ndarray, window: np.ndarray, found: UnionFind, inner: bool) -> None:
        everyone, n = np.concatenate([core, window]), len(core)
        pairs = n * len(window) + (n * (n - 1) // 2 if inner else 0)
        if not pairs:
            return
        if len({found.root(i) for i in everyone.tolist()}) == 1:
            self.by_group += pairs
            return
        pivots, dist = [], []
        far = np.full(n, np.inf)
        while len(pivots) < min(PIVOTS, n):
            p = core[int(far.argmax())]
            d, linked = self.measure(np.array([p]), everyone)
            for i in everyone[linked[0]].tolist():
                found.join(int(p), i)
            pivots.append(p)
            dist.append(d[0])
            far = np.minimum(far, d[0][:n])
        d = np.array(dist)
        if len(everyone) > LEAF and n > PIVOTS:
            home, near, is_core = d.argmin(0), d.min(0), np.arange(len(everyone)) < n
            cells = []
            for p in range(len(pivots)):
                own = is_core & (home == p)
                # of two cells the first takes the other's boundary; window members meet cores of any cell
                edge = (d[p] - near <= 2 * self.tau + 1e-9) & ~own & (~is_core | (inner & (home > p)))
                cells.append((everyone[own], everyone[edge]))
            left = sum(len(a) * len(b) + (len(a) * (len(a) - 1) // 2 if inner else 0) for a, b in cells)
            if left <= 0.7 * pairs:
                self.by_window += pairs - left
                for a, b in cells:
                    self._join(a, b, found, inner)
                return
        for at in range(0, n, 512):
            self._compare(everyone, at, min(n, at + 512), n, d, found, inner)

    def _compare(self, everyone: np.ndarray, first: int, stop: int, n: int, d: np.ndarray, found: UnionFind, inner: bool) -> None:
        """Exactly those pairs of everyone[first:stop] with later members that neither distances to pivots nor groups decide."""
        i, j = np.arange(first, stop)[:, None], np.arange(len(everyone))[None, :]
        mine = (j > i) if inner else (j >= n) & (i < n)
        near = np.ones(mine.shape, bool)
        for row in d:
            near &= abs(row[first:stop, None] - row[None, :]) <= self.tau + 1e-9
        root = np.array([found.root(x) for x in everyone.tolist()])
        differ = root[first:stop, None] != root[None, :]
        self.by_window += int((mine & ~near).sum())
        self.by_group += int((mine & near & ~differ).sum())
        todo = mine & near & differ
        self.compared += int(todo.sum())
        rows, cols = np.flatnonzero(todo.any(1)), np.flatnonzero(todo.any(0))
        if len(rows):
            a, b = np.nonzero(self.measure(everyone[rows + first], everyone[cols])[1] & todo[np.ix_(rows, cols)])
            for x, y in zip(everyone[rows + first][a].tolist(), everyone[cols][b].tolist()):
                found.join(x, y)


def forest(sets: list[np.ndarray], core: np.ndarray, labels: list[int | None], percent: int, inner: bool = True) -> tuple[list[tuple[int, int]], tuple[int, int, int, int]]:
    """Edges (i, root) that connect what links within core, if inner, and between core and the others, and the four counts of Region. Sets with equal labels are connected already."""
    found, first = UnionFind(len(sets)), {}
    for i, label in enumerate(labels):
        if label is not None:
            found.join(first.setdefault(label, i), i)
    if len(sets) == 2 and inner and core.all():
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        if 100 * both >= percent * (len(sets[0]) + len(sets[1]) - both):
            found.join(0, 1)
        counts = (1, 0, 0, 1)
    else:
        region = Region(sets, percent)
        region.join(np.flatnonzero(core), np.flatnonzero(~core), found, inner)
        counts = (region.met, region.by_window, region.by_group, region.compared)
    return [(i, r) for i in range(len(sets)) if (r := found.root(i)) != i], counts


def _survey(k: int):
    """Rows of kind 0: (doc_id, th, n_shingles, class) of each document; of kind 1: shingles that stand in several texts of a batch and in how many."""

    def run(batches):
        for b in batches:
            sets = [shingles(t, k) for t in b.column(1).to_pylist()]
            names = [class_of(s) for s in sets]
            n = pa.array([len(s) for s in sets], pa.int64())
            hi, lo = (pa.array([c[i] for c in names], pa.int64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(sets), pa.int32()), b.column(0), b.column(2), n, hi, lo], ["kind", "doc_id", "th", "n", "hi", "lo"])
            once = list({c: s for c, s in zip(names, sets)}.values())
            found, counts = np.unique(np.concatenate(once) if once else np.zeros(0, np.uint64), return_counts=True)
            found, counts = found[counts > 1], counts[counts > 1]
            if len(found):
                zero = np.zeros(len(found), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(zero.astype(np.int32) + 1), pa.array(zero), pa.array(zero), pa.array(counts.astype(np.int64)), pa.array(found.view(np.int64)), pa.array(zero)], ["kind", "doc_id", "th", "n", "hi", "lo"])

    return run


def _prefixes(k: int, percent: int, heavy):
    """(h, hi, lo, n): the early shingles of each class of n shingles once a task, frequent ones last in the order."""

    def run(batches):
        names, ranks = heavy.value
        seen: set[tuple[int, int]] = set()
        for b in batches:
            out_h, out_c, lengths, sizes = [], [], [], []
            for raw in b.column(0).to_pylist():
                s = shingles(raw, k)
                c = class_of(s)
                if not len(s) or c in seen:
                    continue
                if len(seen) < 500_000:
                    seen.add(c)
                if len(names):
                    at = np.minimum(np.searchsorted(names, s), len(names) - 1)
                    rank = np.where(names[at] == s, ranks[at], 0)
                    s = s[np.lexsort((s, rank))]
                sizes.append(len(s))
                s = s[: prefix_length(len(s), percent)]
                out_h.append(s)
                out_c.append(c)
                lengths.append(len(s))
            if out_h:
                c = np.repeat(np.array(out_c, np.int64), lengths, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_h).view(np.int64)), pa.array(c[:, 0].copy()), pa.array(c[:, 1].copy()), pa.array(np.repeat(np.array(sizes, np.int32), lengths))], ["h", "hi", "lo", "n"])

    return run


def _regions(percent: int):
    """Early shingles (h, hi, lo, n) sorted by all of (h, n, hi, lo) to those of classes that are not alone, with the smallest class of the region (k_hi, k_lo): classes that share h, and whose sizes no gap parts that a link cannot span."""

    def found(h, hi, lo, n):
        keep = np.r_[True, (h[1:] != h[:-1]) | (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]
        h, hi, lo, n = h[keep], hi[keep], lo[keep], n[keep].astype(np.int64)
        run = np.cumsum(np.r_[True, (h[1:] != h[:-1]) | (100 * n[:-1] < percent * n[1:])]) - 1
        keep = np.bincount(run)[run] > 1
        h, hi, lo, n, run = h[keep], hi[keep], lo[keep], n[keep], run[keep]
        if not len(h):
            return None
        order = np.lexsort((lo, hi, run))
        lead = order[np.r_[True, run[order][1:] != run[order][:-1]]]  # the smallest class of each run
        first = lead[np.cumsum(np.r_[True, run[1:] != run[:-1]]) - 1]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (h, hi, lo, n.astype(np.int32), hi[first], lo[first])], ["h", "hi", "lo", "n", "k_hi", "k_lo"])

    def run(batches):
        held, rows = [], 0
        for b in batches:
            held.append([b.column(c).to_numpy() for c in range(4)])
            rows += b.num_rows
            if rows < 1 << 17:
                continue
            columns = [np.concatenate(x) for x in zip(*held)]
            stop = int(np.searchsorted(columns[0], columns[0][-1]))  # what shares the last shingle may go on
            if stop:
                out = found(*(x[:stop] for x in columns))
                if out is not None:
                    yield out
            held = [[x[stop:] for x in columns]]
            rows = len(held[0][0])
        if rows:
            out = found(*(np.concatenate(x) for x in zip(*held)))
            if out is not None:
                yield out

    return run


def _mark(col: str):
    return F.pmod(F.xxhash64(col), F.lit(MARKS))


def _marks(homes: DataFrame) -> np.ndarray:
    """A bitmap of MARKS bits over hashes of the documents whose text is still needed; the others need not be moved. Bits shared by chance only move more."""
    at = _mark("rep")
    words = homes.select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(rep), {MARKS}) % 64 as int))").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(MARKS // 64, np.int64)
    for r in words.collect():  # at most MARKS / 64 rows
        out[r.w] = r.bits
    return out.view(np.uint64)


def _meet(percent: int):
    """Of a region, the groups of classes that share enough early shingles to link; a group is named by its members."""

    def run(key, table):
        names = [np.array(x, np.int64).view(np.uint64) for x in table.column("hs").to_pylist()]
        need = 1 + table.column("n").to_numpy().astype(np.int64) // 40
        region, found, every = Region(names, percent), UnionFind(len(names)), np.arange(len(names))
        a, b = np.nonzero(region.common(every, every) >= np.minimum(need[:, None], need[None, :]))
        for x, y in zip(a.tolist(), b.tolist()):
            found.join(x, y)
        groups: dict[int, list[int]] = {}
        for x in range(len(names)):
            groups.setdefault(found.root(x), []).append(x)
        hi, lo = table.column("hi").to_numpy(), table.column("lo").to_numpy()
        out: list[tuple] = []
        for members in groups.values():
            if len(members) > 1:
                who = np.array(sorted((int(hi[x]), int(lo[x])) for x in members), np.int64)
                k = np.frombuffer(xxhash.xxh3_128_digest(who.tobytes()), np.int64).tolist()
                out += [(*k, *row) for row in who.tolist()]
        return pa.table([pa.array([r[c] for r in out], pa.int64()) for c in range(4)], ["k_hi", "k_lo", "hi", "lo"])

    return run


_FOUND = "a long, b long, met long, by_window long, by_group long, compared long"


def _join_cell(percent: int):
    """A row an edge, and one with the counts and no edge."""

    def run(key, table):
        ids, core = table.column("rep").to_numpy(), table.column("core").to_numpy(zero_copy_only=False).astype(bool)
        inner = table.column("inner")[0].as_py()
        edges, counts = [], (0, 0, 0, 0)
        if len(ids) > 1 and core.any():
            sets = [np.frombuffer(x, np.uint64) for x in table.column("names").to_pylist()]
            edges, counts = forest(sets, core, table.column("label").to_pylist(), percent, inner)
        pick = lambda x: [None, *(int(ids[e[x]]) for e in edges)]
        return pa.table({"a": pa.array(pick(0), pa.int64()), "b": pa.array(pick(1), pa.int64()), **{c: pa.array([v] + [0] * len(edges), pa.int64()) for c, v in zip(("met", "by_window", "by_group", "compared"), counts)}})

    return run


_PLACED = "k_hi long, k_lo long, rep long, core boolean, label long, names binary, salt int, near array<long>, cells array<int>, home int"


def _place(percent: int):
    """Members of a region beside its pivots: the pivots that each links to (near), the cells that it goes to, and which of these is its Voronoi cell (home)."""

    def run(key, members, pivots):
        order = np.argsort(pivots.column("rep").to_numpy())
        ids, names = pivots.column("rep").to_numpy()[order], pivots.column("names").take(pa.array(order)).to_pylist()
        n, near, cells, homes = len(ids), [], [], []
        if members.num_rows:
            sets = [np.frombuffer(x, np.uint64) for x in [*names, *members.column("names").to_pylist()]]
            region = Region(sets, percent)
            d, linked = region.measure(np.arange(n, len(sets)), np.arange(n))
            least, tau, reach = d.min(1), region.tau + 1e-9, REACH * region.tau
            homes = np.where(least <= reach, d.argmin(1), n)  # cell n is the remainder
            core = members.column("core").to_numpy(zero_copy_only=False).astype(bool)
            edge = (d - least[:, None] <= 2 * tau) & (d <= reach + tau)
            # of two cells the first takes the other's boundary; members that are no core meet cores of any cell
            edge &= ~core[:, None] | (np.arange(n)[None, :] <= homes[:, None])
            edge &= ~core[:, None] | (homes[:, None] < n)  # the remainder's own members meet the cells there
            cells = [np.flatnonzero(e).tolist() for e in np.c_[edge, least > reach - tau]]
            near = [ids[x].tolist() for x in linked]
        kept = {c: members.column(c) for c in ("k_hi", "k_lo", "rep", "core", "label", "names", "salt")}
        return pa.table({**kept, "near": pa.array(near, pa.list_(pa.int64())), "cells": pa.array(cells, pa.list_(pa.int32())), "home": pa.array(homes, pa.int32())})

    return run


def _grouped(key, table):
    """(k_hi, k_lo, pivot, group): groups that the pivots of a region form through members they share, named by the least label in them, or else the least pivot."""
    up: dict[int, int] = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    rows = list(zip(table.column("near").to_pylist(), table.column("label").to_pylist()))
    for near, _ in rows:
        for p in near[1:]:
            a, b = root(near[0]), root(p)
            up[max(a, b)] = min(a, b)
        root(near[0])
    label: dict[int, int] = {}
    for near, x in rows:
        if x is not None:
            label[root(near[0])] = min(x, label.get(root(near[0]), x))
    pivots, (hi, lo) = list(up), (x.as_py() for x in key[:2])
    return pa.table({"k_hi": pa.array([hi] * len(pivots), pa.int64()), "k_lo": pa.array([lo] * len(pivots), pa.int64()), "pivot": pa.array(pivots, pa.int64()), "group": pa.array([label.get(root(p), root(p)) for p in pivots], pa.int64())})


_KEY = ["k_hi", "k_lo"]
_CELL = [*_KEY, "rep", "core", "label", "names"]


def _named(*by):
    """The key of a part of a region."""
    return [F.xxhash64(*_KEY, *by).alias("k_hi"), F.xxhash64(*by, *_KEY[::-1]).alias("k_lo")]


def _upto(n: str):
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def _in_blocks(level: DataFrame, steps: Steps, turn: int, files: int) -> DataFrame:
    """Regions that no pivots part: what is without the largest group, in blocks, beside all other members, in chunks of BLOCK."""
    free = F.col("label").isNull() | F.col("most").isNull() | (F.col("label") != F.col("most"))
    level = level.withColumn("free", free)
    dealt = level.groupBy(*_KEY).agg(F.ceil(F.count_if("free") / BLOCK).cast("int").alias("nb"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("nc"), F.count(F.lit(1)).alias("rows"))
    level = join_spread(level, steps.table(dealt, f"dealt{turn}", files), _KEY, "rows")
    level = level.withColumn("b", F.when(F.col("free"), F.pmod(F.xxhash64("rep"), "nb")).otherwise(F.col("nb")).cast("int")).withColumn("c", F.pmod(F.xxhash64("rep", F.lit(1)), "nc").cast("int"))
    rest = ["rep", "label", "names"]
    cores = level.where("free").select(*_KEY, *rest, "b", _upto("nc").alias("c"), F.lit(True).alias("core"))
    others = level.where("b > 0").select(*_KEY, *rest, _upto("b").alias("b"), "c", F.lit(False).alias("core"))
    return cores.unionByName(others).select(*_named("b", "c"), *rest, "core", (F.col("c") == 0).alias("inner"))


def split_regions(level: DataFrame, percent: int, steps: Steps, done: Callable[[], None] = lambda: None) -> tuple[list[DataFrame], list[DataFrame]]:
    """Regions (k_hi, k_lo, rep, core, label, names), split by pivots over tables until one task can join a part.

    Gives tables of links (a, b) to pivots, and of cells (k_hi, k_lo, rep, core, label, names, inner) for one task each. done is
    called when the first level is not read any more; sets stand on disk twice at most, in a level and placed beside its pivots.
    """
    links, ready, turn = [], [], 0
    level = level.select(*_CELL, F.lit(0).alias("tries"))
    rows = level.count()
    while True:
        files, few = 1 + rows // SET_ROWS, 1 + rows // PAIR_ROWS
        # a region is finished without cores or as one group, and small enough, stuck or to be split otherwise
        sizes = level.groupBy(*_KEY).agg(
            F.count(F.lit(1)).alias("m"), F.count_if("core").alias("cores"), F.count("label").alias("labelled"), F.min("label").alias("least"), F.max("label").alias("greatest"), F.mode("label", True).alias("most"),
            F.max("tries").alias("turns"))
        one = (F.col("labelled") == F.col("m")) & (F.col("least") == F.col("greatest"))
        kind = F.when(F.col("m") <= BLOCK, "ready").when(F.col("turns") >= ROUNDS, "blocks").otherwise("split")
        sizes = steps.table(sizes.where((F.col("cores") > 0) & ~F.coalesce(one, F.lit(False))).select(*_KEY, "m", "most", "turns", F.ceil(F.col("m") / CHUNK).cast("int").alias("ways"), kind.alias("kind")), f"sizes{turn}", few)
        kinds = {r.kind for r in sizes.select("kind").distinct().collect()}
        of = lambda kind: join_spread(level, sizes.where(F.col("kind") == kind), _KEY, "m")  # noqa: B023, E731
        if "ready" in kinds:
            ready.append(steps.table(of("ready").select(*_CELL, F.lit(True).alias("inner")), f"ready{turn}", files))
        if "blocks" in kinds:
            ready.append(steps.table(_in_blocks(of("blocks").select(*_CELL, "most"), steps, turn, few), f"blocks{turn}", 4 * files))
        before = (lambda turn=turn: steps.drop(f"level{turn - 1}")) if turn else done
        if "split" not in kinds:
            before()
            return links, ready
        parted = of("split")
        first = (F.col("label").isNotNull(), F.xxhash64("rep", F.lit(turn)), F.col("rep"))
        pivots = parted.where("core").select(*_KEY, "rep", "label", "names", "ways").withColumn("salt", F.pmod(F.xxhash64("rep"), "ways"))
        for by in ([*_KEY, "salt"], _KEY):  # of each share of a region first, so that no task sees a whole region
            pivots = pivots.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*first))).where(F.col("rank") <= SPLIT_PIVOTS)
        pivots = steps.table(pivots.select(*_KEY, "rep", "names", "ways"), f"pivots{turn}", files)
        salted = parted.withColumn("salt", F.pmod(F.xxhash64("rep"), "ways").cast("int")).groupBy(*_KEY, "salt")
        placed = salted.cogroup(pivots.withColumn("salt", _upto("ways")).groupBy(*_KEY, "salt")).applyInArrow(_place(percent), _PLACED)
        placed = steps.table(placed, f"placed{turn}", files)
        before()
        steps.drop(f"pivots{turn}")
        links.append(steps.table(placed.select(F.col("rep").alias("a"), F.explode("near").alias("b")).where("a <> b"), f"near{turn}", few))
        groups = placed.where(F.size("near") > 0).groupBy(*_KEY, "near").agg(F.min("label").alias("label")).groupBy(*_KEY).applyInArrow(_grouped, "k_hi long, k_lo long, pivot long, group long")
        ways = sizes.select(*_KEY, "ways", "m", "turns")
        groups = groups.join(ways, _KEY).select(*_KEY, "pivot", "group", _upto("ways").alias("salt"))
        widest = placed.select(*_KEY, F.explode("cells").alias("cell")).groupBy(*_KEY, "cell").agg(F.count(F.lit(1)).alias("n")).groupBy(*_KEY).agg(F.max("n").alias("n"))
        control = widest.join(ways, _KEY).select(*_KEY, (F.col("n") <= SHRINK * F.col("m")).alias("parts"), "turns", _upto("ways").alias("salt"))
        marked = placed.withColumn("pivot", F.try_element_at("near", F.lit(1))).join(groups, [*_KEY, "pivot", "salt"], "left").withColumn("label", F.coalesce("group", "label")).join(control, [*_KEY, "salt"])
        # a region that the pivots part goes on as its cells, another one whole
        marked = marked.withColumn("cell", F.explode(F.when(F.col("parts"), F.col("cells")).otherwise(F.array(F.lit(-1)))))
        part = lambda by, whole: F.when(F.col("parts"), by).otherwise(whole)
        names = [part(x, F.col(k)).alias(k) for x, k in zip(_named("cell", F.lit(turn)), _KEY)]
        core = F.col("core") & (~F.col("parts") | (F.col("cell") == F.col("home")))
        level = steps.table(marked.select(*names, "rep", core.alias("core"), "label", "names", part(F.lit(0), F.col("turns") + 1).alias("tries")), f"level{turn}", 2 * files)
        rows = level.count()
        steps.drop(f"placed{turn}")
        turn += 1


def class_links(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, links): rows (doc_id, th, n, hi, lo) of docs (doc_id, text), th being a hash of the text, classes (hi, lo, rep) with rep the smallest doc_id, links (a, b) between reps.

    links also has a row with null a and b for each joined region, in which met counts its pairs and by_window, by_group and compared how they were decided.
    """
    spark = docs.sparkSession
    small_batches(spark)
    steps = Steps(spark, "jaccard")
    n = parts(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("b"), F.xxhash64("text").alias("th"))
    survey = steps.table(rows.mapInArrow(_survey(k), "kind int, doc_id long, th long, n long, hi long, lo long"), "survey")
    own = survey.where("kind = 0").select("doc_id", "th", "n", "hi", "lo")
    classes = steps.table(own.where("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n")), "classes")

    most = survey.where("kind = 1").groupBy("hi").agg(F.sum("n").alias("n")).where("n >= 8").orderBy(F.desc("n"), "hi").limit(HEAVY).collect()  # at most HEAVY rows
    most.sort(key=lambda r: r.hi & (1 << 64) - 1)
    heavy = spark.sparkContext.broadcast((np.array([r.hi for r in most], np.int64).view(np.uint64), np.array([r.n for r in most], np.int64)))

    early = rows.select("b").mapInArrow(_prefixes(k, percent, heavy), "h long, hi long, lo long, n int")
    met = early.repartition(n, "h").sortWithinPartitions("h", "n", "hi", "lo")
    met = steps.table(met.mapInArrow(_regions(percent), "h long, hi long, lo long, n int, k_hi long, k_lo long"), "met")
    few = 1 + met.count() // (10 * PAIR_ROWS)
    early_of = met.groupBy("hi", "lo").agg(F.max("n").alias("n"), F.collect_list("h").alias("hs"))  # at most a prefix each
    members = steps.table(met.select(*_KEY, "hi", "lo").distinct(), "members", few)
    sizes = steps.table(members.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("m")), "sizes", few)
    small = members.join(sizes.where(F.col("m") <= BLOCK), _KEY).join(early_of, ["hi", "lo"])
    groups = small.groupBy(*_KEY).applyInArrow(_meet(percent), "k_hi long, k_lo long, hi long, lo long").distinct().withColumn("large", F.lit(False))
    large = join_spread(members, sizes.where(F.col("m") > BLOCK), _KEY, "m").select(*_KEY, "hi", "lo", F.lit(True).alias("large"))
    named = groups.unionByName(large).join(classes, ["hi", "lo"]).where("rep is not null")
    homes = steps.table(named.groupBy("rep", "hi", "lo", classes.n).agg(F.collect_list(F.struct(*_KEY, "large")).alias("homes")), "homes")
    steps.drop("met", "members", "sizes")

    placed, total = homes.agg(F.sum(F.size("homes") * F.col("n"))).head()[0] or 0, own.agg(F.sum("n")).head()[0] or 0
    ways = max(1, math.ceil(placed / max(1, PART * total)))
    links = None
    for way in range(ways):
        own_homes = homes
        if ways > 1:
            own_homes = homes.withColumn("homes", F.filter("homes", lambda h: F.pmod(F.xxhash64(h["k_hi"], h["k_lo"]), F.lit(ways)) == way)).where(F.size("homes") > 0)  # noqa: B023
        found = _region_links(rows, own_homes, k, percent, steps, str(way))
        links = found if links is None else links.unionByName(found)
    steps.drop("homes")
    return own, classes, links


def _region_links(rows: DataFrame, homes: DataFrame, k: int, percent: int, steps: Steps, part: str) -> DataFrame:
    """links of class_links within the regions of homes (rep, hi, lo, homes), written; sets are dropped."""
    spark = rows.sparkSession
    wanted = spark.sparkContext.broadcast(_marks(homes))

    def sift(batches):
        marks = wanted.value
        for b in batches:
            at = b.column(2).to_numpy()
            yield b.filter(pa.array((marks[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1)).select(["rep", "b"])

    texts = rows.where("doc_id is not null").select(F.col("doc_id").alias("rep"), "b", _mark("doc_id").alias("at")).mapInArrow(sift, "rep long, b binary")
    text = texts.hint("merge").join(homes, "rep")

    def spread(batches):
        last = None
        for b in batches:
            out, size = [], 0
            for rep, raw, hi, lo, homes_of in zip(*(b.column(c).to_pylist() for c in ("rep", "b", "hi", "lo", "homes"))):
                s = shingles(raw, k)
                if class_of(s) == (hi, lo) and last != (rep, hi, lo):  # repeated rows stand together
                    last = (rep, hi, lo)
                    data = s.tobytes()
                    out += [(rep, h["k_hi"], h["k_lo"], h["large"], data) for h in homes_of]
                    size += len(data) * len(homes_of)
                    if size > 4 << 20:
                        yield table(out)
                        out, size = [], 0
            if out:
                yield table(out)

    def table(out):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)], ["rep", *_KEY, "large", "names"])

    cells = steps.table(text.mapInArrow(spread, "rep long, k_hi long, k_lo long, large boolean, names binary"), f"cells{part}")
    wanted.unpersist()
    cells = cells.withColumn("core", F.lit(True)).withColumn("label", F.lit(None).cast("long")).withColumn("inner", F.lit(True))
    joined = lambda t: t.groupBy(*_KEY).applyInArrow(_join_cell(percent), _FOUND)
    links = steps.table(joined(cells.where("not large").select(*_CELL, "inner")), f"links{part}")
    if not homes.where(F.exists("homes", lambda h: h["large"])).isEmpty():
        regions = Steps(spark, "regions")
        near, todo = split_regions(cells.where("large").select(*_CELL), percent, regions, lambda: steps.drop(f"cells{part}"))
        for i, t in enumerate(todo):  # one at a time, so that no two are shuffled at once
            links = links.unionByName(steps.table(joined(t), f"links{part}-{i}"))
        for i, t in enumerate(near):
            links = links.unionByName(steps.table(t, f"near{part}-{i}"), True)
        regions.close()
    steps.drop(f"cells{part}")
    return links


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(v, component): the smallest vertex that each vertex of links (a, b) reaches, by large-star and small-star rounds. Edges of a hub are met where they are."""
    steps = Steps(links.sparkSession, "components")
    edges = steps.table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())
    before, last = mark(edges), "edges"
    for turn in range(most_rounds):
        files = 1 + 2 * before[0] // PAIR_ROWS  # no table of a round is larger than both directions of the edges
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = steps.table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")), f"least{turn}", files)
        large = join_spread(both, least, ["u"], "n").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = steps.table(large, f"large{turn}", files)
        low = steps.table(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), f"low{turn}", files)
        small = join_spread(large, low, ["u"], "n").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = steps.table(small, f"small{turn}", files)
        steps.drop(f"least{turn}", f"large{turn}", f"low{turn}", last)
        last, after = f"small{turn}", mark(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("v"), F.col("v").alias("component"))


def _judged(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, th, n, rep, component) of each row of docs (doc_id, text)."""
    rows, classes, links = class_links(docs, k, percent)
    found = components(links.where("a is not null").select("a", "b"))
    named = classes.join(found, classes.rep == found.v, "left").select("hi", "lo", "rep", F.coalesce("component", "rep").alias("component"))
    own = F.col("doc_id").isNotNull()
    return rows.join(named, ["hi", "lo"], "left").select("doc_id", "th", "n", F.when(own, F.coalesce("rep", "doc_id")).alias("rep"), F.when(own, F.coalesce("component", "doc_id")).alias("component"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) of docs (doc_id, text): class_id is the smallest doc_id with the same set."""
    return _judged(docs, k, percent).select("doc_id", F.col("n").alias("n_shingles"), F.col("rep").alias("class_id"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs (any columns, among them doc_id and text) that stay when each component keeps its smallest doc_id.

    Of rows with equal doc_id and text, words in it, one stays; rows without doc_id or without words stay. A doc_id with two texts
    loses only that which has a near copy of smaller doc_id.
    """
    near = materialize(_judged(docs.select("doc_id", "text"), k, percent).where("doc_id is not null and n > 0"), "judged")
    th = F.xxhash64("text")
    gone = near.where("component <> doc_id").select("doc_id", F.col("th").alias("cw__th")).distinct()
    stay = docs.withColumn("cw__th", th).join(gone, ["doc_id", "cw__th"], "left_anti")
    again = near.where("component = doc_id").groupBy("doc_id", F.col("th").alias("cw__th")).agg(F.count(F.lit(1)).alias("cw__n")).where("cw__n > 1")
    if not again.isEmpty():
        again = again.select("doc_id", "cw__th")
        once = stay.join(again, ["doc_id", "cw__th"], "left_semi").dropDuplicates(["doc_id", "cw__th"])
        stay = stay.join(again, ["doc_id", "cw__th"], "left_anti").unionByName(once)
    return stay.select(*docs.columns)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, 4, 85).select("doc_id", "n_shingles", "component_id")


ORACLE_OP4 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE [array_to_string(ws[i:i + 3], ' ') for i in range(1, len(ws) - 2)] END)) AS sh FROM w),
c AS (SELECT md5(array_to_string(sh, chr(10))) AS name, min(doc_id) AS rep, any_value(sh) AS sh, len(any_value(sh)) AS n FROM s WHERE len(sh) > 0 GROUP BY name),
x AS (SELECT rep, n, unnest(sh) AS g FROM c),
e AS (SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(rep, component_id) USING KEY (rep) AS (SELECT rep, rep FROM c
  UNION SELECT b.b, min(r.component_id) FROM reach r JOIN both_ways b ON b.a = r.rep JOIN recurring.reach t ON t.rep = b.b WHERE r.component_id < t.component_id GROUP BY b.b)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(reach.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN c ON len(s.sh) > 0 AND c.name = md5(array_to_string(s.sh, chr(10))) LEFT JOIN reach ON reach.rep = c.rep
"""
