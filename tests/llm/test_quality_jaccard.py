"""Quality rules and the Jaccard join against plain Python."""

import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.llm import jaccard, quality

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    wins = Counter(zip(w, w[1:], w[2:]))
    marked = {i + k for i in range(len(w) - 2) if wins[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for x in text.split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(marked)


def odd_texts():
    rng = random.Random(1)
    out = [None, "", " \n\x0b", "a b a b a b a b", "a a a a", "x\nx\n x\nx", "é # é # é # é", "\x1c \x85 a", "one", "b " * 60_000]
    return out + ["".join(rng.choice("aab# \n") for _ in range(rng.randrange(120))) for _ in range(200)]


def test_counts():
    for t in odd_texts():
        assert quality.counts_of(t)[:5] == base(t), repr(t)[:60]


def test_judge(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(100_000 + i, t) for i, t in enumerate(odd_texts())] + [(None, "null id " * 30)], "doc_id long, text string")
    docs = docs.unionByName(more)
    rows = {r.doc_id: r for r in quality.judge(docs.selectExpr("*", "1 as kept", "'x' as quality")).collect()}
    for r in docs.collect():
        g = rows[r.doc_id]
        b = base(r.text)
        assert tuple(g)[1:6] == b and g.base_failed == (b[0] < 50 or 100 * b[4] > 50 * b[0])
        assert not (g.base_failed and g.kept) and g.kept == (not g.base_failed and g.quality >= 0.5)
    kept = {r.doc_id for r in quality.keep_good(docs).collect()}
    assert kept == {i for i, r in rows.items() if r.kept}
    assert quality.judge(docs.limit(0)).count() == 0 and quality.keep_good(docs.limit(0)).count() == 0


def em_by_hand(patterns, rounds=100):
    """Posterior of each vote pattern {votes: documents} by the textbook loop over documents, with the operator's start, smoothing and clip."""
    n, kinds = len(next(iter(patterns))), ("bad", "good")
    total = sum(patterns.values())
    share = [[1 + sum(w for v, w in patterns.items() if v[r] == x) for x in range(3)] for r in range(n)]
    share = [[x / sum(row) for x in row] for row in share]
    start = [[[0.0] * 3 for _ in kinds] for _ in range(n)]
    for r in range(n):
        for c in (0, 1):
            start[r][c] = [(1 - share[r][2]) * (0.8 if x == c else 0.2) for x in (0, 1)] + [share[r][2]]
    table, prior = start, 0.8

    def post(v):
        good, bad = prior, 1 - prior
        for r in range(n):
            good, bad = good * table[r][1][v[r]], bad * table[r][0][v[r]]
        return good / (good + bad)

    for _ in range(rounds):
        p = {v: post(v) for v in patterns}
        fresh = []
        for r in range(n):
            rows = [[3 * start[r][c][x] + sum(w * (p[v] if c else 1 - p[v]) for v, w in patterns.items() if v[r] == x) for x in range(3)] for c in (0, 1)]
            rows = [[x / sum(row) for x in row] for row in rows]
            for c in (0, 1):
                if rows[c][c] < rows[1 - c][c]:
                    rows[0][c] = rows[1][c] = (rows[0][c] + rows[1][c]) / 2
            fresh.append([[x / sum(row) for x in row] for row in rows])
        prior = min(0.99, max(0.01, (sum(w * p[v] for v, w in patterns.items()) + 0.8) / (total + 1)))
        table = fresh
    return {v: post(v) for v in patterns}


def test_verdicts_against_em_by_hand(spark):
    """kept and quality of every document against votes by plain conditions and an EM without numpy."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    # name: value of (count, by), good bound, bad bound
    bounds = [("n_symbols", "n_words", 0.03, 0.15), ("n_marks", "n_words", 0.05, 0.2), ("n_upper", "n_letters", 0.15, 0.3), ("n_bare", "n_words", 0.02, 0.1), ("n_ends", "n_words", 0.04, 0.005), ("word_chars", "n_words", 9.0, 14.0), ("n_dup_lines", "n_lines", 0.05, 0.3), ("n_repeat_words", "n_words", 0.1, 0.35)]
    votes, base_of = {}, {}
    for r in docs.collect():
        c = dict(zip(quality.COUNTS, quality.counts_of(r.text)))
        base_of[r.doc_id] = c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]
        vote = []
        for a, by, good, bad in bounds:
            x = c[a] / c[by] if c[by] else None
            up = bad > good
            vote.append(2 if x is None else 0 if (x >= bad if up else x <= bad) else 1 if (x <= good if up else x >= good) else 2)
        votes[r.doc_id] = tuple(vote)
    post = em_by_hand(Counter(v for i, v in votes.items() if not base_of[i]))
    rows = quality.judge(docs).collect()
    assert len(rows) == len(votes) and any(not r.kept and not r.base_failed for r in rows)
    for r in rows:
        if not r.base_failed:
            assert abs(r.quality - post[votes[r.doc_id]]) < 1e-4 and r.kept == (post[votes[r.doc_id]] >= 0.5)


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality is not null")
    rows = quality.judge(docs).where("not base_failed").join(labels, "doc_id").select(labels.quality.alias("q"), "kept").collect()
    good = [r.kept for r in rows if r.q == 1]
    bad = [r.kept for r in rows if r.q == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.1


def test_em_finds_accuracies():
    rng = np.random.default_rng(0)
    n, acc = 20_000, np.array([0.95, 0.9, 0.85, 0.75, 0.6])
    truth = rng.random(n) < 0.7
    right = rng.random((n, 5)) < acc
    votes = np.where(right, truth[:, None], ~truth[:, None]).astype(np.int64)
    votes[rng.random((n, 5)) < 0.3] = quality.ABSTAIN
    pats, weights = np.unique(votes, axis=0, return_counts=True)
    m = quality.fit(pats, weights.astype(float))
    assert abs(m.prior - 0.7) < 0.03
    said = m.table[:, quality.GOOD, quality.GOOD] / (1 - m.table[:, quality.GOOD, quality.ABSTAIN])
    assert np.abs(said - acc).max() < 0.05
    assert np.mean((m.posterior(votes) >= 0.5) == truth) > 0.9


def sets_of(text, k):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, percent):
    sets = [(i, sets_of(t, k)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, (i, s) in enumerate(sets):
        for j, t in sets[a + 1 :]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return sorted((i, len(s), root(i)) for i, s in sets)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def near_rows():
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    rows = []
    for g in range(12):
        base = [rng.choice(vocab) for _ in range(rng.choice([30, 100, 250]))]
        rows += [edited(rng, base, rng.randrange(6)) for _ in range(rng.choice([2, 5, 20]))]
    hot = [rng.choice(vocab) for _ in range(120)]
    rows += [edited(rng, hot, rng.randrange(4)) for _ in range(150)]
    rows += [passage + " " + " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 30, 200]))) for _ in range(80)]
    rows += [None, "", " \t", "one", "One", "one two", "a b c", "A b\nC", "a b c d", "x " * 20_000, "x " * 30_000, " ".join(vocab), " ".join(vocab) + " end"]
    rows += rows[:9]
    rows = list(enumerate(rows))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k, percent, block, rounds", [(4, 85, 128, 3), (5, 80, 12, 2), (4, 85, 5, 0)])
def test_near_duplicates(spark, monkeypatch, k, percent, block, rounds):
    """Regions joined by one task each, split by pivots over tables, and compared in blocks: always the links of brute force."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    monkeypatch.setattr(jaccard, "SPLIT_PIVOTS", 4)
    rows = near_rows()
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in rows] + [(None, "w1 w2 w3 w4 w5", 1, "x")], "doc_id long, text string, n int, component_id string").repartition(7)
    got = jaccard.near_duplicates(df, k, percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == brute(rows, k, percent)
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    stay = sorted(-1 if r.doc_id is None else r.doc_id for r in jaccard.keep_one(df, k, percent).collect())
    assert stay == [-1] + sorted(i for i, _, c in brute(rows, k, percent) if i == c)
    assert jaccard.near_duplicates(df.limit(0), k, percent).count() == 0


def test_keep_one_of_repeated_rows(spark):
    text = lambda x: " ".join(f"{x}{i}" for i in range(30))
    rows = [(1, text("a")), (1, text("a")), (5, text("a")), (5, text("b")), (6, text("b")), (7, None), (7, None), (None, text("a")), (8, " ")]
    df = spark.createDataFrame([(t, i, "x") for i, t in rows], "text string, doc_id long, cw__n string")
    assert sorted((r.doc_id or -1, (r.text or "-")[0]) for r in jaccard.keep_one(df).collect()) == [(-1, "a"), (1, "a"), (5, "b"), (7, "-"), (7, "-"), (8, " ")]
    assert jaccard.keep_one(df).columns == df.columns


def test_real_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df, 4, 85).collect()) == brute(rows, 4, 85)


def spread_sets(rng, groups=12, most=30, edits=14):
    """Sets around shared bases, which themselves share a third of their names."""
    shared, sets = rng.integers(0, 1 << 60, 30).astype(np.uint64), []
    for _ in range(groups):
        b = np.concatenate([shared, rng.integers(0, 1 << 60, 50).astype(np.uint64)])
        for _ in range(rng.integers(5, most)):
            s = b.copy()
            at = rng.integers(0, 80, rng.integers(0, edits))
            s[at] = rng.integers(0, 1 << 60, len(at)).astype(np.uint64)
            sets.append(np.unique(s))
    return sets


def linked_by_hand(sets, percent, pairs):
    up = jaccard.UnionFind(len(sets))
    for i, j in pairs:
        c = len(np.intersect1d(sets[i], sets[j]))
        if percent * (len(sets[i]) + len(sets[j]) - c) <= 100 * c:
            up.join(i, j)
    return [up.root(i) for i in range(len(sets))]


def test_windows_and_groups_decide_pairs_within_a_task():
    """All pairs are accounted for, few are compared, and the links are those of all pairs."""
    sets = spread_sets(np.random.default_rng(3))
    n = len(sets)
    edges, (met, by_window, by_group, compared) = jaccard.forest(sets, np.ones(n, bool), [None] * n, 85)
    mine = jaccard.UnionFind(n)
    for i, r in edges:
        mine.join(i, r)
    assert [mine.root(i) for i in range(n)] == linked_by_hand(sets, 85, [(i, j) for i in range(n) for j in range(i)])
    assert met == n * (n - 1) // 2 == by_window + by_group + compared
    assert by_window > 0.5 * met and compared < 0.25 * met


def test_core_and_window_of_a_task():
    """Links between core and the others, with and without those inside core, and with members that are connected already."""
    rng = np.random.default_rng(4)
    sets = spread_sets(rng, 6, 20)
    n = len(sets)
    for part in (0.1, 0.5, 0.9):
        core = rng.random(n) < part
        for inner in (True, False):
            pairs = [(i, j) for i in range(n) for j in range(i) if core[i] != core[j] or inner and core[i]]
            for labels in ([None] * n, [7 if i < n // 8 else None for i in range(n)]):
                edges, _ = jaccard.forest(sets, core, labels, 85, inner)
                mine = jaccard.UnionFind(n)
                for i, r in edges:
                    mine.join(i, r)
                want = jaccard.UnionFind(n)
                for i, r in enumerate(linked_by_hand(sets, 85, pairs)):
                    want.join(i, r)
                first = next((i for i, x in enumerate(labels) if x), 0)
                for i, x in enumerate(labels):
                    if x:
                        want.join(first, i)
                got, expected = [mine.root(i) for i in range(n)], [want.root(i) for i in range(n)]
                if inner:
                    assert got == expected
                else:  # links to pivots inside core may be found as well; no wanted link is lost and no wrong one made
                    whole = linked_by_hand(sets, 85, [(i, j) for i in range(n) for j in range(i)])
                    assert all(got[i] == got[r] for i, r in enumerate(expected))
                    if not any(labels):
                        assert all(whole[i] == whole[r] for i, r in enumerate(got))


def test_windows_between_tasks(spark, monkeypatch):
    """A large region is split by pivots: cells with their windows hold every link and far fewer pairs than the region; a dense one is finished by groups."""
    from cellweave.llm.common import Steps

    monkeypatch.setattr(jaccard, "BLOCK", 40)
    monkeypatch.setattr(jaccard, "SPLIT_PIVOTS", 8)
    rng = np.random.default_rng(5)
    sparse = spread_sets(rng, 20, 40)
    base = np.sort(rng.integers(0, 1 << 60, 200).astype(np.uint64))
    dense = [np.unique(np.r_[base[rng.random(200) > 0.02], rng.integers(0, 1 << 60, 2).astype(np.uint64)]) for _ in range(300)]
    for sets, share in ((sparse, 0.4), (dense, 0.05)):
        n = len(sets)
        level = spark.createDataFrame([(1, 2, i, True, None, x.tobytes()) for i, x in enumerate(sets)], "k_hi long, k_lo long, rep long, core boolean, label long, names binary")
        near, ready = jaccard.split_regions(level, 85, Steps(spark, "test"))
        assert near and all(t.groupBy("k_hi", "k_lo").count().where("count > 80").isEmpty() for t in ready)
        mine, pairs = jaccard.UnionFind(n), 0
        for t in near:
            for r in t.collect():
                mine.join(r.a, r.b)
        for t in ready:
            for r in t.groupBy("k_hi", "k_lo").applyInArrow(jaccard._join_cell(85), jaccard._FOUND).collect():
                pairs += r.met
                if r.a is not None:
                    mine.join(r.a, r.b)
        assert [mine.root(i) for i in range(n)] == linked_by_hand(sets, 85, [(i, j) for i in range(n) for j in range(i)])
        assert pairs < share * n * (n - 1) / 2, (pairs, n)


def test_regions_of_shared_shingles():
    """Streamed in batches of any size: classes that share a shingle, in runs without a gap in size, named by the smallest."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    rows = sorted({(int(h), 1 + int(c) * 13 % 59, int(c) * 7 % 50 - 20, int(c)) for h, c in zip(rng.integers(-40, 40, 900), rng.integers(0, 90, 900))})
    rows = sorted(rows + rows[::5])
    want = set()
    for h in {r[0] for r in rows}:
        of = sorted({r for r in rows if r[0] == h}, key=lambda r: (r[1], r[2], r[3]))
        runs = [[of[0]]]
        for a, b in zip(of, of[1:]):
            runs.append([b]) if 100 * a[1] < 85 * b[1] else runs[-1].append(b)
        for x in runs:
            low = min((r[2], r[3]) for r in x)
            want |= {(h, r[2], r[3], r[1], *low) for r in x if len(x) > 1}
    for size in (1, 7, 2000):
        parts = [rows[i : i + size] for i in range(0, len(rows), size)]
        batches = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in p], pa.int32() if c == 1 else pa.int64()) for c in (0, 2, 3, 1)], ["h", "hi", "lo", "n"]) for p in parts]
        got = [tuple(x[c] for c in ("h", "hi", "lo", "n", "k_hi", "k_lo")) for b in jaccard._regions(85)(iter(batches)) for x in b.to_pylist()]
        assert len(got) == len(set(got)) and set(got) == want


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(180)] + [(500, x) for x in range(501, 700)] + [(7, 7)]
    up = {x: x for e in edges for x in e}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r.v: r.component for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up if root(x) != x}


def _disk_blocks(spark):
    return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()


def test_written_tables_leave_no_shuffle_files(spark):
    from cellweave.core import Steps as GridSteps
    from cellweave.core import materialize as grid_materialize
    from cellweave.llm.common import materialize

    df = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count()
    for write in (materialize, grid_materialize, GridSteps(spark, "test").table):
        before = _disk_blocks(spark)
        written = write(df, "released")
        until = time.monotonic() + 10  # files are deleted in the background
        while _disk_blocks(spark) > before and time.monotonic() < until:
            time.sleep(0.1)
        assert _disk_blocks(spark) <= before
        assert len(written.collect()) == 100


def test_regions_in_parts_give_the_same_links(spark, monkeypatch):
    words = lambda i, skip: " ".join(f"w{i % 7}x{j}" for j in range(80) if j != skip)
    docs = spark.createDataFrame([(i, words(i, 70 + i % 9)) for i in range(300)], "doc_id long, text string")
    want = {tuple(r) for r in jaccard.near_duplicates(docs, 4, 85).collect()}
    monkeypatch.setattr(jaccard, "PART", 0.1)
    ways = []
    links = jaccard._region_links
    monkeypatch.setattr(jaccard, "_region_links", lambda *a: ways.append(a[-1]) or links(*a))
    assert {tuple(r) for r in jaccard.near_duplicates(docs, 4, 85).collect()} == want
    assert len(ways) > 1 and len({r[-1] for r in want}) == 7
