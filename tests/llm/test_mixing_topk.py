"""Mixing against its laws; top-k against brute force."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from cellweave.llm import mixing, topk


def targets_by_hand(size, order, weights=(3, 1, 2), share=1.5, most=2.0):
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    want, full = share * sum(size.values()), set()
    while True:
        left = want - sum(most * size[s] for s in full)
        open_w = sum(w[s] for s in order if s not in full)
        level = left / open_w if open_w else 0
        over = {s for s in order if s not in full and level * w[s] > most * size[s] + 1e-9}
        if not over:
            return {s: most * size[s] if s in full else level * w[s] for s in order}
        full |= over


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, row long, source string, text string, size string, p int, target int")


def test_mix(spark):
    rng = random.Random(0)
    rows = []
    for i in range(3000):
        s = rng.choice(["a", "a", "a", "b", "B", "é", None, "c", "z"])
        t = None if rng.random() < 0.02 else " ".join("w" for _ in range(rng.choice([0, 1, 5, 40, 40, 300])))
        rows.append((i, 0, s, t, "x", 1, 2))
    rows += [(5000 + i, 0, "empty", "" if i % 2 else " \x0b\n", "x", 1, 2) for i in range(5)]
    df = frame(spark, rows)
    got = mixing.mix(df).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    source, size = {r[0]: r[2] for r in rows}, {r[0]: len((r[3] or "").split()) for r in rows}
    total, taken, target, fraction = defaultdict(int), defaultdict(int), {}, defaultdict(list)
    for r in got:
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.taken == r.copies * r.size and 0 <= r.taken <= 2 * r.size
        total[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        fraction[s].append(r.copies)
    order = sorted([s for s in total if s is not None], key=lambda s: s.encode()) + [None]
    for s, t in targets_by_hand(total, order).items():
        assert math.isclose(target[s], t, rel_tol=1e-9, abs_tol=1e-6)
        ratio = t / total[s] if total[s] else 0
        assert abs(sum(fraction[s]) - ratio * len(fraction[s])) < 1.0001  # counts to one document
        assert set(fraction[s]) <= {math.floor(ratio), math.floor(ratio) + 1}
        assert abs(taken[s] - t) <= 2 * 300
    again = {r.doc_id: r.taken for r in mixing.mix(df.repartition(13, "text")).collect()}
    assert again == {r.doc_id: r.taken for r in got}
    assert mixing.mix(df.limit(0)).count() == 0


def test_mix_repeated_rows_and_tree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF", 2)
    monkeypatch.setattr(mixing, "FAN", 3)
    rows = [(i % 50, i, "s" if i % 3 else "t", "w " * (1 + i % 7), "", 0, 0) for i in range(200)] + [(None, 1000, "s", "w w", "", 0, 0)]
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.row) for r in got) == sorted((-1 if r[0] is None else r[0], r[1]) for r in rows)


def test_rounding_is_unbiased(spark):
    n, p = 64, 0.3
    hits = np.zeros(n)
    items = spark.range(n * 100).selectExpr("cast(id div 64 as string) source", "1L source_size", "0.0D target", "0L base", "cast((id % 64) div 16 as int) bin", "0L leaf", "id % 64 size", "xxhash64(id, 99) h", "id doc_id", "0L row", f"{p}D p")
    for r in mixing.pivotal_round(items, ["source", "source_size", "target", "base"], 1).collect():
        assert r.p in (0.0, 1.0)
        hits[r.size] += r.p
    assert abs(hits.mean() / 100 - p) < 0.01 and hits.min() > 12 and hits.max() < 50


def brute(rows, k):
    fits = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v)
    sound = [(i, np.floor(64 * np.array([float(np.float32(x)) for x in v])).astype(int)) for i, v in rows if i is not None and fits(v)]
    out = []
    for q, qv in sound:
        if q % 20 == 0:
            n = lambda c: int(sum(a * b for a, b in zip(qv.tolist(), c.tolist())))
            best = sorted([(-n(c), i) for i, c in sound if i != q])[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 0.12, 16).tolist()) for i in range(400)]
    rows += [(i, [0.25] * 16) for i in range(400, 480)] + [(i, [0.0] * 16) for i in range(480, 485)]
    rows += [(500, None), (501, [None] + [0.1] * 15), (502, [float("nan")] * 16), (503, [float("inf")] + [0.0] * 15), (None, [0.1] * 16), (7, [0.5] * 16), (520, [-1.0, 1.0]), (521, [])]
    rows += [(560, [262143.98] * 16), (561, [-262143.9] * 16), (562, [262144.0] * 16), (563, [3e5] + [-3e5] * 15), (564, [-1e6, 5.0]), (580, [1e9] + [0.0] * 15), (581, [-1e8] * 3)]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "vec_id long, embedding array<float>, score int")
    v = topk.quantised(df)
    for block, group in ((1 << 16, 512), (100, 512), (100, 3)):
        monkeypatch.setattr(topk, "QUERY_ROWS", group)
        monkeypatch.setattr(topk, "TASK_QUERIES", 4 * group)
        got = sorted(tuple(r) for r in topk.top_k(v, v.where("vec_id % 20 = 0"), 20, block_rows=block).collect())
        assert got == brute(rows, 20)
    few = topk.quantised(df.where("vec_id in (0, 1, 2)"))
    assert len(topk.top_k(few, few.where("vec_id % 20 = 0"), 20).collect()) == 2
    none = topk.quantised(df.limit(0))
    assert topk.top_k(none, none, 20).count() == 0


def test_large_integers_are_exact_or_an_error(spark):
    index = topk.BitSlices.build(np.arange(3), np.array([[2**40, -(2**62)], [-(2**40), 2**62 - 1], [2**63 - 1, -(2**63)]]))
    ids, score = index.top(np.array([2, 1]), 2, np.array([2]))
    assert dict(zip(ids.tolist(), score.tolist())) == {0: 2**41 - 2**62, 1: 2**62 - 1 - 2**41}
    ids, score = index.top(np.array([1, 1]), 3)
    assert dict(zip(ids.tolist(), score.tolist())) == {0: 2**40 - 2**62, 1: 2**62 - 1 - 2**40, 2: -1}
    with pytest.raises(OverflowError):
        index.top(np.array([2**20, 1]), 1)
    with pytest.raises(Exception, match="64-bit"):
        topk.quantised(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>")).collect()
    wide = spark.createDataFrame([(i, [float(i)] * 20_000) for i in (0, 1, 2)], "vec_id long, embedding array<double>")
    v = topk.quantised(wide)
    assert [r.score for r in topk.top_k(v, v.where("vec_id = 1"), 5).orderBy("rank").collect()] == [2 * 64 * 64 * 20_000, 0]


def test_slices_select_ties_by_id():
    rng = np.random.default_rng(1)
    for n in (1, 63, 64, 65, 500):
        values = rng.integers(-3, 3, (n, 5))
        index = topk.BitSlices.build(np.arange(n) * 2, values)
        index = topk.BitSlices.from_bytes(index.ids, *index.to_bytes())
        for q in rng.integers(-9, 9, (6, 5)):
            for k in (1, 7, 600):
                ids, score = index.top(q, k, np.array([0]))
                want = sorted((-int(s), i * 2) for i, s in enumerate(values @ q) if i)[:k]
                assert sorted(zip((-score).tolist(), ids.tolist())) == want
