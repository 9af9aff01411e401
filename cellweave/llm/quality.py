"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them, a posterior decides.

Each rule looks at a few counts of the whole text and votes good (1), bad (0) or abstains (2). The votes of all documents are
counted by pattern; there are at most 3 ** len(RULES) patterns, so the counts fit on the driver whatever the corpus. There EM
estimates, without labels, how common good documents are and how each rule votes on good and on bad ones (rules being independent
given the class), starting from rules that are right four times in five. A document is kept when the posterior probability of
good quality is at least `threshold`; no single rule decides.

Base counts (fixed by contract): words are runs without ASCII blanks. base_failed is n_words < 50 or more than half of the words in
3-word windows that occur twice.

Defined results: null text has no words and fails the base; texts of any length are read whole; repeated rows are judged alike and
each counts; a table without rows gives none; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import BLANKS, materialize, small_batches

SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
BAD, GOOD, ABSTAIN = 0, 1, 2
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks", "n_ends", "n_bare"]


def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, n)
    v = len(names)
    if v == n:
        return 0
    if v < 1 << 20:
        keys = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
    else:
        keys = np.unique(ids[:-2] * v + ids[1:-1], return_inverse=True)[1] * v + ids[2:]
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(s), bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = order[twice]
    marked = np.zeros(n, bool)
    for k in range(3):
        marked[at + k] = True
    return int(marked.sum())


def counts_of(text: str | None) -> tuple[int, ...]:
    """The numbers of COUNTS."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip(BLANKS)]
    without = lambda chars: len(raw) - len(raw.translate(None, chars))
    return (
        len(words), len(text) - without(BLANKS), without(SYMBOLS), len(lines) - len(set(lines)), repeat_words(words),
        len(lines), without(_UPPER), without(_LETTERS), raw.count(b"!") + raw.count(b"?"), sum(raw.count(c) for c in (b". ", b".\n", b", ", b",\n")) - sum(raw.count(c) for c in (b". |", b", |")),
        sum(raw.count(c) for c in (b" | ", b" - ", b" * ", b" # ", b" > ")),
    )


@dataclass(frozen=True)
class Rule:
    """Votes bad where value >= bad (or <= bad if low_is_bad), good on the other side of good, and abstains between and where value is undefined."""

    name: str
    value: Callable[[dict], np.ndarray]
    good: float
    bad: float

    def votes(self, c: dict[str, np.ndarray]) -> np.ndarray:
        x = self.value(c)
        with np.errstate(invalid="ignore"):
            is_bad, is_good = (x >= self.bad, x <= self.good) if self.bad > self.good else (x <= self.bad, x >= self.good)
        return np.where(np.isnan(x), ABSTAIN, np.where(is_bad, BAD, np.where(is_good, GOOD, ABSTAIN))).astype(np.int64)


def _per(a: str, b: str) -> Callable[[dict], np.ndarray]:
    return lambda c: np.where(c[b] > 0, c[a] / np.maximum(c[b], 1), np.nan)


RULES = (
    Rule("symbols", _per("n_symbols", "n_words"), good=0.03, bad=0.15),
    Rule("marks", _per("n_marks", "n_words"), good=0.05, bad=0.2),
    Rule("capitals", _per("n_upper", "n_letters"), good=0.15, bad=0.3),
    Rule("cells", _per("n_bare", "n_words"), good=0.02, bad=0.1),
    Rule("sentences", _per("n_ends", "n_words"), good=0.04, bad=0.005),
    Rule("long words", _per("word_chars", "n_words"), good=9.0, bad=14.0),
    Rule("equal lines", _per("n_dup_lines", "n_lines"), good=0.05, bad=0.3),
    Rule("repetition", _per("n_repeat_words", "n_words"), good=0.1, bad=0.35),
)


@dataclass
class Model:
    """prior: share of good documents; table[rule, class, vote]: how often a rule votes so on a class."""

    prior: float
    table: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(good) for rows of votes."""
        odds = np.full(len(votes), np.log(self.prior) - np.log1p(-self.prior))
        for r in range(votes.shape[1]):
            odds += np.log(self.table[r, GOOD, votes[:, r]]) - np.log(self.table[r, BAD, votes[:, r]])
        return 1 / (1 + np.exp(-odds))


def fit(patterns: np.ndarray, weights: np.ndarray, rounds: int = 100, prior: float = 0.8, right: float = 0.8) -> Model:
    """EM over distinct vote patterns (rows) and how many documents have each.

    Counts are smoothed by one pseudo-document a cell in proportion to the start, and a rule never becomes evidence against what it
    votes for: such likelihood ratios are clipped at one.
    """
    n_rules = patterns.shape[1]
    casts = np.array([[weights[patterns[:, r] == v].sum() for v in range(3)] for r in range(n_rules)], float).reshape(n_rules, 3)
    share = (casts + 1) / (casts + 1).sum(1, keepdims=True)
    table = np.zeros((n_rules, 2, 3))
    for cls in (BAD, GOOD):
        table[:, cls, ABSTAIN] = share[:, ABSTAIN]
        table[:, cls, cls] = (1 - share[:, ABSTAIN]) * right
        table[:, cls, 1 - cls] = (1 - share[:, ABSTAIN]) * (1 - right)
    model = Model(prior, table)
    start = table.copy()
    if not len(patterns):
        return model
    for _ in range(rounds):
        p = model.posterior(patterns)
        new = start.copy() * 3
        for r in range(n_rules):
            for v in range(3):
                at = patterns[:, r] == v
                new[r, GOOD, v] += (weights[at] * p[at]).sum()
                new[r, BAD, v] += (weights[at] * (1 - p[at])).sum()
        new /= new.sum(2, keepdims=True)
        for cls in (BAD, GOOD):
            low = new[:, cls, cls] < new[:, 1 - cls, cls]
            both = (new[low, 0, cls] + new[low, 1, cls]) / 2
            new[low, 0, cls] = new[low, 1, cls] = both
        new /= new.sum(2, keepdims=True)
        total = (weights * p).sum()
        prior = float(np.clip((total + 0.8) / (weights.sum() + 1), 0.01, 0.99))
        done = abs(new - model.table).max() < 1e-9 and abs(prior - model.prior) < 1e-9
        model = Model(prior, new)
        if done:
            break
    return model


def votes_of(counts: dict[str, np.ndarray]) -> np.ndarray:
    return np.stack([r.votes(counts) for r in RULES], 1)


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])


def _columns(texts: list[str | None]) -> dict[str, np.ndarray]:
    rows = np.array([counts_of(t) for t in texts], np.int64).reshape(-1, len(COUNTS))
    return {k: rows[:, i] for i, k in enumerate(COUNTS)}


_CODES = 3 ** np.arange(len(RULES), dtype=np.int64)


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, *COUNTS, base_failed, pattern) of docs (doc_id, text); pattern codes the votes in base 3."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            c = _columns(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, c.values()), pa.array(base_failed(c)), pa.array(votes_of(c) @ _CODES)], ["doc_id", *COUNTS, "base_failed", "pattern"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, pattern long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def fit_patterns(measured: DataFrame) -> Model:
    """The model of all documents that pass the base; collects at most 3 ** len(RULES) rows."""
    rows = measured.where("not base_failed").groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).orderBy("pattern").collect()
    codes = np.array([r.pattern for r in rows], np.int64)
    return fit(codes[:, None] // _CODES % 3, np.array([r.n for r in rows], float))


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, *COUNTS, base_failed, quality, kept): quality is the posterior probability of a good document."""
    measured = materialize(measure(docs), "measured")
    model = fit_patterns(measured)

    def run(batches):
        for b in batches:
            p = model.posterior(b.column("pattern").to_numpy()[:, None] // _CODES % 3)
            kept = ~b.column("base_failed").to_numpy(zero_copy_only=False) & (p >= threshold)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ["doc_id", *COUNTS, "base_failed"]), pa.array(p), pa.array(kept)], ["doc_id", *COUNTS, "base_failed", "quality", "kept"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, quality double, kept boolean"
    return measured.mapInArrow(run, schema)


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs (any columns, among them text) that are kept; texts are measured twice rather than moved."""
    small_batches(docs.sparkSession)
    model = fit_patterns(measure(docs.select(F.lit(0).alias("doc_id"), "text")))
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            c = _columns(b.column(at).to_pylist())
            yield b.filter(pa.array(~base_failed(c) & (model.posterior(votes_of(c)) >= threshold)))

    return docs.mapInArrow(run, docs.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality", "kept")
