"""What each filter of a chain removes in every order of the chain, from counts of failure masks.

Documents are reduced to one bit a failed filter; how many documents of a part have each mask (and how many of them are good or
toxic by label) is all that any order needs: 2**n cells a part. Permutations are visited by adjacent transpositions, so that from
one order to the next a single pair of neighbours changes places. Only these two steps are counted anew from the cells, and only
what is kept between them changes; the steps before and after see the same documents as in the order before. Shapley sums are
added up along the walk.

Whether a text repeats one of a smaller doc_id needs no join of documents: rows are counted by (digest of the text, part, labels)
before they meet, all rows of a text have the same other bits, and of each text only those with its smallest doc_id pass. So a
text with a third of all rows is a handful of counts.

Defined results: null text is the empty text, null lang the empty part; rows that occur twice are two documents, and neither is
the smaller; a null doc_id has no labels, fails no E and makes no other text fail it; labels other than 1, and documents without
labels, are neither good nor toxic; of several labels of one doc_id a 1 counts; texts of any length are read whole; a table without
rows has no parts and gives no rows; columns other than doc_id, text and lang, whatever their names, do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.llm.common import as_bytes, map_batches, small_batches

LETTERS = "ABCDE"
#: Orders of more filters are too many rows to be of use to anyone (8! = 40,320 a part).
MOST_FILTERS = 8
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_SYMBOLS = b"#$%&*|"
_TAILS = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that start no code point
MEASURES = ("n", "good", "toxic")


def own_failures(data: bytes) -> int:
    """Bits of the filters that look at one text (UTF-8) alone: A few words, B repeated words, C capitals, D symbols."""
    words = data.split()
    n = len(words)
    few = n < 200
    repeats = 100 * len(set(words)) < 50 * n
    capitals = 100 * (len(data) - len(data.translate(None, _UPPER))) > 3 * len(data.translate(None, _TAILS))
    symbols = len(data) != len(data.translate(None, _SYMBOLS))
    return few | repeats << 1 | capitals << 2 | symbols << 3


def _judged(batch: pa.RecordBatch) -> pa.RecordBatch:
    doc_id, part, texts = batch.columns
    masks, digests = [], []
    for data in texts:
        data = data.as_py()
        masks.append(own_failures(data))
        digests.append(hashlib.sha256(data).digest())
    return pa.RecordBatch.from_arrays([doc_id, part, pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "mask", "digest"])


def failure_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of a part with each set of failures, E (bit 16) included; masks of no document are left out."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), as_bytes().alias("data"))
    judged = map_batches(rows, _judged, "doc_id long, part string, mask int, digest binary")
    alike = judged.groupBy("doc_id", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("n"))  # rows that occur twice are one row from here on
    is_one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    labelled = alike.join(known, "doc_id", "left").select("doc_id", "part", "mask", "digest", "n", flag("good"), flag("toxic"))
    numbered = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
    classes = labelled.groupBy("digest", "mask", "part", "good", "toxic").agg(F.sum("n").alias("n"), F.min(numbered).alias("least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnumbered"))
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))  # a text has four classes a part at most
    passing = F.col("unnumbered") + F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0)
    split = classes.withColumn("passing", passing).select(
        "part", "good", "toxic", F.explode(F.array(F.struct(F.col("mask"), F.col("passing").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("passing")).alias("n")))).alias("cell")
    )
    n = F.col("cell.n")
    return split.where(n > 0).groupBy("part", F.col("cell.mask").alias("mask")).agg(F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic"))


def adjacent_swaps(n: int) -> Iterator[int]:
    """Positions i such that swapping i and i + 1 in turn visits every order of n things once, beginning from the given one."""
    if n < 2:
        return
    inner, count = adjacent_swaps(n - 1), 0
    while True:
        down = count % 2 == 0  # the last thing travels through the others' order, to the left and to the right in turn
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        swap = next(inner, None)
        if swap is None:
            return
        yield swap + 1 if down else swap  # the travelling thing stands at the front after its way down
        count += 1


class Audit:
    """All orders of n filters over one part's cells, counts[measure][mask]."""

    def __init__(self, counts: np.ndarray, n: int):
        if not 1 <= n <= MOST_FILTERS:
            raise ValueError(f"between 1 and {MOST_FILTERS} filters")
        self.counts, self.n = counts, n
        self.masks = np.arange(1 << n)
        self.fails = [int(counts[0][(self.masks >> f) & 1 == 1].sum()) for f in range(n)]
        self.alone = [int(counts[0][1 << f]) for f in range(n)]
        self.total = int(counts[0].sum())
        self.shapley = [0] * n

    def step(self, f: int, before: int) -> tuple[int, ...]:
        """Documents, good ones and toxic ones that filter f removes after the filters of the mask `before`."""
        return tuple(self.counts[:, self.masks & (before | 1 << f) == 1 << f].sum(axis=1).tolist())

    def walk(self) -> Iterator[tuple[tuple[int, ...], list[tuple[int, ...]], list[int]]]:
        """(order, what each step removes, kept after each step) of every order; shapley is whole once the walk is over."""
        order = list(range(self.n))
        before = [0, *accumulate((1 << f for f in order[:-1]), int.__or__)]
        removed = [self.step(f, b) for f, b in zip(order, before)]
        kept = [self.total - x for x in accumulate(r[0] for r in removed)]
        swaps = adjacent_swaps(self.n)
        while True:
            for f, r in zip(order, removed):
                self.shapley[f] += r[0]
            yield tuple(order), list(removed), list(kept)
            i = next(swaps, None)
            if i is None:
                return
            order[i], order[i + 1] = order[i + 1], order[i]
            before[i + 1] = before[i] | 1 << order[i]
            removed[i], removed[i + 1] = self.step(order[i], before[i]), self.step(order[i + 1], before[i + 1])
            kept[i] = (kept[i - 1] if i else self.total) - removed[i][0]


_ROWS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _audited(letters: str):
    names = [c.split()[0] for c in _ROWS.split(", ")]
    n = len(letters)

    def of(part: str, cells: list[dict]) -> pa.RecordBatch:
        counts = np.zeros((len(MEASURES), 1 << n), np.int64)
        for cell in cells:
            counts[:, cell["mask"]] = [cell[m] for m in MEASURES]
        audit = Audit(counts, n)
        rows = []
        for order, removed, kept in audit.walk():
            name = "".join(letters[f] for f in order)
            rows += [(f, name, i + 1, kept[i], *removed[i]) for i, f in enumerate(order)]
        which, name, step, left, gone, good, toxic = map(list, zip(*rows))
        redundant = [audit.fails[f] - g for f, g in zip(which, gone)]
        columns = [[part] * len(rows), name, step, left, gone, redundant, [audit.alone[f] for f in which], good, toxic, [audit.shapley[f] for f in which]]
        kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part, cells in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist()):
            yield of(part, cells)

    return run


def audit_orders(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """A row for each part, order and step, from cells (part, mask, n, good, toxic); bit i of a mask is the filter letters[i]."""
    if not 1 <= len(letters) <= MOST_FILTERS:
        raise ValueError(f"between 1 and {MOST_FILTERS} filters")
    of_part = cells.groupBy("part").agg(F.collect_list(F.struct("mask", *MEASURES)).alias("cells"))  # 2**n at most
    return map_batches(of_part, _audited(letters), _ROWS)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    return audit_orders(failure_cells(docs, labels))


ORACLE_OP13 = r"""
WITH t AS (SELECT d.doc_id, coalesce(d.lang, '') AS part, coalesce(d.text, '') AS s FROM documents d),
w AS (SELECT *, regexp_extract_all(s, '[^\x20\x09-\x0D]+') AS ws FROM t),
lab AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
f AS (SELECT w.part, coalesce(lab.good, 0) AS good, coalesce(lab.toxic, 0) AS toxic, {
    'A': len(ws) < 200, 'B': 100 * len(list_distinct(ws)) < 50 * len(ws), 'C': 100 * length(regexp_replace(s, '[^A-Z]', '', 'g')) > 3 * length(s),
    'D': regexp_matches(s, '[#$%&*|]'), 'E': coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY s), false)} AS fails FROM w LEFT JOIN lab ON w.doc_id = lab.doc_id),
bits AS (SELECT part, good, toxic, fails.A::INT AS a, fails.B::INT AS b, fails.C::INT AS c, fails.D::INT AS d, fails.E::INT AS e FROM f),
cells AS (SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM bits GROUP BY 1, 2),
x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(l, bit)),
o AS (SELECT p.l || q.l || r.l || s.l || u.l AS filter_order, [p.bit, q.bit, r.bit, s.bit, u.bit] AS bs FROM x p, x q, x r, x s, x u
  WHERE p.bit + q.bit + r.bit + s.bit + u.bit = 31 AND len(list_distinct([p.bit, q.bit, r.bit, s.bit, u.bit])) = 5),
st AS (SELECT filter_order, k AS step, bs[k] AS bit, CAST(coalesce(list_sum(bs[1:k - 1]), 0) AS INT) AS before FROM o, range(1, 6) r(k)),
g AS (SELECT c.part, st.filter_order, st.step, st.bit,
    sum(CASE WHEN c.mask & (st.before | st.bit) = 0 THEN c.n ELSE 0 END) AS kept,
    sum(CASE WHEN c.mask & st.before = 0 AND c.mask & st.bit > 0 THEN c.n ELSE 0 END) AS removed,
    sum(CASE WHEN c.mask & st.before > 0 AND c.mask & st.bit > 0 THEN c.n ELSE 0 END) AS redundant,
    sum(CASE WHEN c.mask = st.bit THEN c.n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN c.mask & st.before = 0 AND c.mask & st.bit > 0 THEN c.good ELSE 0 END) AS good_lost,
    sum(CASE WHEN c.mask & st.before = 0 AND c.mask & st.bit > 0 THEN c.toxic ELSE 0 END) AS toxic_lost
  FROM cells c, st GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM g
"""
