"""Exact top-k by inner product over a bit-sliced index.

Vectors are quantised to integers and stored by blocks of rows. A block keeps, for every attribute, one bitmap a binary digit over
its rows (two's complement, so that the last slice counts negatively); these slices are the table that is written, once. A query adds
the slices of all attributes, weighted by its own digits, with bitmap arithmetic: a carry-save adder takes three bitmaps of equal
weight to one of that weight and one of the next, until each weight has one bitmap left. These are the slices of the score. The top
rows are then selected from the most significant slice downward: rows with the digit set that fit into k are in, rows without it drop
out once k others have it. Where rows stay tied at the boundary, the smaller vec_ids win (rows of a block are in vec_id order), so
that the result is exact.

Queries travel to the stored slices: a task reads one block's slices and lets a share of the queries pass by, a few hundred in
memory at a time. A block goes to several tasks only as far as the cluster would otherwise stand idle or a task would see more than
TASK_QUERIES. Each meeting leaves at most k rows a query; a task keeps the best k of its own before they move, and the rest is
ranked per query.

Slices and sums have as many digits as they need, so that the choice is exact for any integers. Scores are 64-bit integers: one among
the chosen that is not ends the job with an error, as does a component that is no 64-bit integer once it is quantised.

Defined results: vectors null or with null or non-finite components, or with a null vec_id, take no part; rows with the query's
vec_id are not its candidates; vectors of another length than the query's are padded with zeros, and any length is taken (blocks hold
fewer rows then); repeated vec_ids each count; an empty table gives no rows; columns other than vec_id and embedding, whatever their
names, do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.llm.common import materialize, parts, small_batches

#: Rows of a block at most, and components of a block at most while it is built.
BLOCK_ROWS = 1 << 16
BLOCK_VALUES = 1 << 23
#: Queries that travel together, and that one task lets pass a block at most.
QUERY_ROWS = 512
TASK_QUERIES = 1 << 16
#: Quantised components and scores are 64-bit integers.
LARGEST = 1 << 63


class BitSlices:
    """The index of one block: slices[d][b] is a bitmap (64-bit words) of digit b of attribute d."""

    def __init__(self, ids: np.ndarray, dims: int, slices: list[list[np.ndarray]]):
        self.ids, self.dims, self.slices = ids, dims, slices
        self.words = (len(ids) + 63) // 64

    @classmethod
    def build(cls, ids: np.ndarray, values: np.ndarray) -> BitSlices:
        """ids ascending; values int64 (rows, attributes)."""
        words = (len(ids) + 63) // 64
        slices = []
        for d in range(values.shape[1]):
            v = values[:, d]
            digits = max(int(abs(int(v.min()))).bit_length(), int(abs(int(v.max()))).bit_length()) + 1 if len(v) else 1
            own = []
            for b in range(digits):
                bits = np.zeros(words * 64, np.uint8)
                bits[: len(v)] = (v >> b) & 1
                own.append(np.packbits(bits, bitorder="little").view(np.uint64))
            slices.append(own)
        return cls(ids, values.shape[1], slices)

    def to_bytes(self) -> tuple[bytes, bytes]:
        """The number of slices of each attribute, and all slices in order."""
        flat = [x for own in self.slices for x in own]
        return bytes(map(len, self.slices)), np.concatenate(flat).tobytes() if flat else b""

    @classmethod
    def from_bytes(cls, ids: np.ndarray, digits: bytes, data: bytes) -> BitSlices:
        words = (len(ids) + 63) // 64
        flat = np.frombuffer(data, np.uint64).reshape(-1, words) if words else np.zeros((0, 0), np.uint64)
        bounds = np.cumsum([0, *digits]).tolist()
        return cls(ids, len(digits), [list(flat[a:b]) for a, b in zip(bounds, bounds[1:])])

    def scores(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices of score + offset, least significant first; offset makes all values non-negative and equals what _offset gives."""
        columns: dict[int, list[np.ndarray]] = {}
        base = 0
        for d, q in enumerate(query.tolist()):
            if not q or d >= self.dims:
                continue
            own = self.slices[d]
            for b, bitmap in enumerate(own):
                weight = q * (-(1 << b) if b == len(own) - 1 else 1 << b)
                if weight < 0:  # w * x = |w| * (not x) - |w|
                    base += weight
                    bitmap, weight = ~bitmap, -weight
                at = 0
                while weight:
                    if weight & 1:
                        columns.setdefault(at, []).append(bitmap)
                    weight >>= 1
                    at += 1
        out, w = [], 0
        self.base = base
        while columns:
            held = columns.pop(w, [])
            carry = columns.get(w + 1, [])
            while len(held) >= 3:
                a, b, c = held.pop(), held.pop(), held.pop()
                x = a ^ b
                y = a & b
                x2 = x & c
                x ^= c
                y |= x2
                held.insert(0, x)
                carry.append(y)
            if len(held) == 2:
                a, b = held
                held = [a ^ b]
                carry.append(a & b)
            out.append(held[0] if held else np.zeros(self.words, np.uint64))
            if carry:
                columns[w + 1] = carry
            w += 1
        return out

    def top(self, query: np.ndarray, k: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(vec_ids, scores) of the k best rows; skip: positions of rows that are no candidates."""
        sums = self.scores(query)
        n = len(self.ids)
        live = np.full(self.words, ~np.uint64(0))
        if n % 64:
            live[-1] = (np.uint64(1) << np.uint64(n % 64)) - np.uint64(1)
        if skip is not None:
            for p in skip.tolist():
                live[p >> 6] &= ~(np.uint64(1) << np.uint64(p & 63))
        sure = np.zeros(self.words, np.uint64)
        have = 0
        for s in reversed(sums):
            ones = live & s
            c = int(np.bitwise_count(ones).sum())
            if have + c > k:
                live = ones
            else:
                sure |= ones
                have += c
                live &= ~s
                if have == k:
                    live[:] = 0
                    break
        at = _positions(sure)
        if have < k:
            at = np.concatenate([at, _positions(live, k - have)])  # tied at the boundary: smaller vec_ids first
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        digits = [((s[word] >> bit) & np.uint64(1)).astype(np.int64) for s in sums]
        if len(sums) < 62 and -self.base < 1 << 62:
            score = np.full(len(at), self.base, np.int64)
            for w, d in enumerate(digits):
                score += d << w
            return self.ids[at], score
        exact = [self.base + sum(int(d[i]) << w for w, d in enumerate(digits)) for i in range(len(at))]
        if any(not -LARGEST <= x < LARGEST for x in exact):
            raise OverflowError("a score among the best is no 64-bit integer")
        return self.ids[at], np.array(exact, np.int64)


def _positions(bitmap: np.ndarray, most: int | None = None) -> np.ndarray:
    """Positions of set bits in ascending order, the first `most`."""
    words = np.flatnonzero(bitmap)
    if most is not None:
        words = words[:most]
    bits = np.unpackbits(bitmap[words].view(np.uint8).reshape(len(words), 8), axis=1, bitorder="little") if len(words) else np.zeros((0, 64), np.uint8)
    r, c = np.nonzero(bits)
    found = words[r] * 64 + c
    return found if most is None else found[:most]


def _gathered(table) -> tuple[np.ndarray, np.ndarray]:
    """vec_ids and values (rows, attributes) of a group, in vec_id order."""
    ids = table.column("vec_id").to_numpy()
    lists = table.column("v").combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    wide = max(1, int(lengths.max(initial=0)))
    flat = lists.flatten().to_numpy()
    values = np.zeros((len(ids), wide), np.int64)
    values[np.repeat(np.arange(len(ids)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    order = np.lexsort((*values.T[::-1], ids))
    return ids[order].astype("<i8"), values[order]


_PACKED = "block long, ids binary, digits binary, data binary"


def _row(key, ids: np.ndarray, digits: bytes, data: bytes):
    return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "ids": pa.array([ids.tobytes()], pa.binary()), "digits": pa.array([digits], pa.binary()), "data": pa.array([data], pa.binary())})


def _sliced(key, table):
    """A block's rows as one row with its slices."""
    ids, values = _gathered(table)
    return _row(key, ids, *BitSlices.build(ids, values).to_bytes())


def _asked(key, table):
    """A group of queries as one row with their values."""
    ids, values = _gathered(table)
    return _row(key, ids, b"", values.astype("<i8").tobytes())


def _meet(k: int):
    """Rows sorted by block, part and kind: the slices of a block (kind 0), then the queries that it meets."""

    def run(batches):
        index = None
        for batch in batches:
            for kind, ids, digits, data in zip(*(batch.column(c).to_pylist() for c in ("kind", "ids", "digits", "data"))):
                rows = np.frombuffer(ids, "<i8")
                if kind == 0:
                    index = BitSlices.from_bytes(rows, digits, data)
                    continue
                out = []
                for q, vec in zip(rows.tolist(), np.frombuffer(data, "<i8").reshape(len(rows), -1)):
                    a, b = np.searchsorted(index.ids, q, "left"), np.searchsorted(index.ids, q, "right")
                    found, score = index.top(vec, k, np.arange(a, b) if b > a else None)
                    out.append((np.full(len(found), q), found, score))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out]).astype(np.int64)) for i in range(3)], ["query_id", "vec_id", "score"])

    return run


def quantised(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """(vec_id, v): integer vectors floor(scale * x); rows without a sound vector are left out."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    sound = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall("embedding", finite)

    def digit(x: Column) -> Column:
        v = F.lit(scale) * x.cast("double")
        return F.when((v >= -float(LARGEST)) & (v < float(LARGEST)), F.floor(v)).otherwise(F.raise_error(F.lit("a quantised component is no 64-bit integer")).cast("long"))

    return vectors.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", digit).alias("v"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) for vectors and queries (vec_id, v: array of long)."""
    spark = vectors.sparkSession
    small_batches(spark)
    vectors = materialize(vectors, "vectors")
    total, wide = vectors.agg(F.count(F.lit(1)), F.max(F.size("v"))).head()
    asked, n = queries.count(), parts(spark)
    fit = max(1, BLOCK_VALUES // max(1, wide or 1))
    blocks, groups = max(1, -(-total // min(block_rows, fit))), max(1, -(-asked // min(QUERY_ROWS, fit)))
    ways = max(1, -(-asked // TASK_QUERIES), min(-(-n // blocks), groups))  # tasks that a block's slices go to
    number = lambda df, m: df.withColumn("block", F.pmod(F.monotonically_increasing_id() + F.spark_partition_id(), F.lit(m)))
    index = materialize(number(vectors, blocks).groupBy("block").applyInArrow(_sliced, _PACKED), "slices")
    asks = number(queries, groups).groupBy("block").applyInArrow(_asked, _PACKED)
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    slices = index.select("block", every(ways).alias("way"), F.lit(0).alias("kind"), "ids", "digits", "data")
    passing = asks.select(every(blocks).alias("block"), F.pmod("block", F.lit(ways)).alias("way"), F.lit(1).alias("kind"), "ids", "digits", "data")
    tasks = max(1, min(blocks * ways, 100_000))
    met = slices.unionByName(passing).repartition(tasks, "block", "way").sortWithinPartitions("block", "way", "kind")
    found = met.mapInArrow(_meet(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return top_k(vectors, vectors.where("vec_id % 20 = 0"), 20)


ORACLE_OP6 = """
WITH v AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
