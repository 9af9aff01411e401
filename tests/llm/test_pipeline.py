"""Each stage of the pipeline on its own input against plain Python."""

from collections import Counter

import pytest

import hashlib

import numpy as np

import corpus_pipeline
from cellweave.llm import quality
from cellweave.llm.common import materialize
from tests.llm.test_lines_warc_sharding import first_kept
from tests.llm.test_quality_jaccard import brute
from tests.llm.test_tokens import whole_ids

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(9001, "short", "en", "src1", 5), (9002, None, None, None, None), (None, "no id " * 40, "en", None, 3)], docs.schema)
    docs, out = docs.unionByName(more), []
    first = docs.where("doc_id = 1 or doc_id = 7")
    docs = docs.unionByName(first)
    for name, f in corpus_pipeline.STAGES:
        out.append(docs)
        docs = materialize(f(spark, docs, SF), name)
    return [*out, docs]


def test_columns(stages):
    for s in stages[1:-1]:
        assert s.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_stage(stages):
    want = Counter()
    judged = {(r.doc_id, r.n_words): r.kept for r in quality.judge(stages[0]).collect()}
    rows = stages[0].collect()
    for r in rows:
        if judged[(r.doc_id, len((r.text or "").encode().split()))]:
            want[tuple(r)] += 1
    assert Counter(tuple(r) for r in stages[1].collect()) == want


def test_line_stage(stages):
    want = first_kept([(r.doc_id, r.text) for r in stages[1].collect()], 10)
    assert Counter((-1 if r.doc_id is None else r.doc_id, r.text) for r in stages[2].collect()) == want
    assert all(r.n_chars == len(r.text) for r in stages[2].collect() if r.text is not None and r.doc_id is not None)


def test_jaccard_stage(stages):
    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    once = sorted(set(r for r in rows if r[0] is not None))
    stay = {i for i, n, c in brute(once, 5, 80) if i == c}
    words = {i for i, n, _ in brute(once, 5, 80) if n}
    want = Counter(i for i, _ in rows if i is None or i in stay and i not in words) + Counter(i for i in stay & words)
    assert Counter(r.doc_id for r in stages[3].collect()) == want


def test_mixing_stage(stages):
    before, after = Counter(tuple(r) for r in stages[3].collect()), Counter(tuple(r) for r in stages[4].collect())
    assert set(after) <= set(before) and all(after[k] <= 2 * before[k] for k in after)
    words = lambda c: sum(len(k[1].encode().split()) * n for k, n in c.items())
    assert abs(words(after) - 1.5 * words(before)) < 0.1 * words(before)


def test_last_stage(stages):
    rows = [(r.doc_id, r.text) for r in stages[4].collect()]
    ids, tok = whole_ids([t for _, t in rows])
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = Counter((i, len(x), sha(np.array(x, "<u4").tobytes()), sha(tok.decode(x, skip_special_tokens=False).encode())) for (i, _), x in zip(rows, ids))
    assert want == Counter(tuple(r) for r in stages[5].collect())


def test_stages_on_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, f in corpus_pipeline.STAGES:
        out = f(spark, docs, SF)
        assert out.count() == 0
        docs = out if "text" in out.columns else docs


CLASH = ["row", "b", "th", "line", "lines", "n", "hi", "lo", "rep", "size", "shard", "names", "key", "p", "copies", "sig", "kept"]


def test_stages_with_clashing_columns_and_long_texts(spark):
    """Columns of any name come through with their values, and long texts are not cut."""
    words = lambda i, n: " ".join(f"word{i}x{j}, and then." for j in range(n))
    rows = [(i, words(i, 60), "en", f"s{i % 3}") for i in range(40)] + [(100, words(100, 60_000), "en", "s0"), (101, words(100, 60_000) + " end", "en", "s1"), (102, words(0, 60), "en", "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", *[f"concat('{c}', doc_id) as {c}" for c in CLASH])
    columns = docs.columns
    for name, f in corpus_pipeline.STAGES[:4]:
        docs = materialize(f(spark, docs, SF), name)
        assert docs.columns == columns
        assert all(r[c] == f"{c}{r.doc_id}" for r in docs.collect() for c in CLASH)
        if name == "ngram_jaccard":
            assert {r.doc_id for r in docs.collect()} == {*range(40), 100}
    long = [len(r.text) for r in docs.where("doc_id = 100").collect()]
    assert set(long) <= {len(words(100, 60_000))}
    ids, _ = whole_ids([words(100, 60_000)])
    out = corpus_pipeline.bpe_encoding(spark, docs, SF).where("doc_id = 100").collect()
    assert [r.n_tokens for r in out] == [len(ids[0])] * len(long)


def test_one_of_many_copies_stays_whole(spark):
    """Line dedup and near-duplicate removal together keep the text of one of 12 exact copies, and no emptied rows."""
    copy = "\n".join(" ".join(f"w{7 * i + j}" for j in range(7)) for i in range(6))
    other = {i: "share this page\n" + " ".join(f"own{i}x{j}" for j in range(20)) for i in range(100, 103)}
    rows = [(i, copy, "en", "src1", len(copy)) for i in range(20, 32)] + [(i, t, "en", "src2", len(t)) for i, t in other.items()]
    rows += [(i, "share this page\n" + " ".join(f"more{i}x{j}" for j in range(20)), "en", "src3", None) for i in range(200, 209)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, f in corpus_pipeline.STAGES[1:3]:
        docs = materialize(f(spark, docs, SF), name)
    out = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
    assert out.pop(20) == (copy, len(copy))
    assert sorted(out) == [*range(100, 103), *range(200, 209)]
    assert out.pop(100)[0] == other.pop(100)  # the first of its documents keeps the common line
    assert all(out[i][0] == t.split("\n")[1] for i, t in other.items())
