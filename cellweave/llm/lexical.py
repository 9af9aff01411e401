"""Ranked lexical search over a sharded index of compressed postings, document at a time.

A shard is what one task reads until it has SHARD_TERMS terms or SHARD_DOCS documents; texts are indexed where they are read and
never move. Within a shard documents are numbered in the order of their doc_ids; the postings of a term are the gaps between these
numbers and the occurrences, both as variable-length bytes, in one row. A row without term holds the shard's doc_ids and lengths.

A search first takes the postings of the queries' terms out of the index, and counts from them in how many documents each term is.
Shards then meet the queries: the postings of a query's terms are merged through a heap of cursors keyed by their next document.
The least document opens a window of WINDOW numbers; every cursor inside leaves the heap, adds its scores of the window and goes
back with the first document behind it, so a document's score is whole when its window closes. It then enters a heap bounded to k
results, keyed by score, then smaller doc_id. The best k of every shard are merged in one ranking per query.

Defined results: null text is a text without terms; documents without terms count for nothing and are never found; rows with equal
doc_ids are documents each; rows with a null doc_id or item_id take no part; rows with equal item_ids are one item with the terms of
all of them; texts of any length are indexed whole (a document alone may fill a shard); a term in all documents may have weight 0,
and documents with nothing else are not found; an empty table of documents or items gives no rows; columns other than those named
do not matter.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.llm.common import as_bytes, materialize, new_path, parts, small_batches

#: A shard holds so many terms (repeats counted) or documents, and one document more at most.
SHARD_TERMS = 1 << 22
SHARD_DOCS = 1 << 16
WINDOW = 1 << 14
#: Items of one block of queries, and terms of a query set up to which it is broadcast.
BLOCK_ITEMS = 256
BROADCAST_TERMS = 1 << 20
#: Every byte that is no part of a term as a blank, A-Z as a-z. Bytes of characters beyond ASCII are parts of terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(data: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return data.translate(_FOLD).split()


def varbytes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative values at seven bits a byte, least first, the high bit set where more follows; and the number of bytes of each."""
    values = values.astype(np.uint64)
    lengths = np.ones(len(values), np.int64)
    for k in range(1, 10):
        more = values >> np.uint64(7 * k)
        if not more.any():
            break
        lengths += more > 0
    at = np.cumsum(lengths) - lengths
    out = np.zeros(int(lengths.sum()), np.uint8)
    for k in range(int(lengths.max(initial=0))):
        own = lengths > k
        seven = (values[own] >> np.uint64(7 * k)) & np.uint64(127)
        out[at[own] + k] = seven.astype(np.uint8) | np.where(lengths[own] > k + 1, 128, 0).astype(np.uint8)
    return out, lengths


def from_varbytes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), starts)


def _binary(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """One binary value for each length, in a row of bytes."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())


_INDEX = "shard long, term binary, docs long, total long, places binary, counts binary"
_NAMES = [c.split()[0] for c in _INDEX.split(", ")]


class ShardBuilder:
    def __init__(self, shard: int):
        self.shard = shard
        self.vocab: defaultdict[bytes, int] = defaultdict()
        self.vocab.default_factory = self.vocab.__len__
        self.ids: list[np.ndarray] = []
        self.docs: list[int] = []
        self.lengths: list[int] = []
        self.held = 0

    def add(self, doc_id: int, data: bytes) -> None:
        words = terms_of(data)
        if words:
            self.ids.append(np.fromiter(map(self.vocab.__getitem__, words), np.int32, len(words)))
            self.docs.append(doc_id)
            self.lengths.append(len(words))
            self.held += len(words)

    def full(self) -> bool:
        return self.held >= SHARD_TERMS or len(self.docs) >= SHARD_DOCS

    def rows(self, size: int = 20_000) -> Iterator[pa.RecordBatch]:
        """The row of documents, then a row for each term in order."""
        if not self.docs:
            return
        n, lengths = len(self.docs), np.array(self.lengths, np.int64)
        order = np.lexsort((lengths, np.array(self.docs, np.int64)))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        sizes, _ = varbytes(lengths[order])
        ids = np.array(self.docs, "<i8")[order]
        yield pa.RecordBatch.from_arrays([pa.array([self.shard]), pa.array([None], pa.binary()), pa.array([n]), pa.array([self.held]), pa.array([ids.tobytes()], pa.binary()), pa.array([sizes.tobytes()], pa.binary())], _NAMES)
        names = list(self.vocab)
        by_name = sorted(range(len(names)), key=names.__getitem__)
        rank = np.empty(len(names), np.int64)
        rank[by_name] = np.arange(len(names))
        pairs, counts = np.unique(rank[np.concatenate(self.ids)] * n + np.repeat(place, lengths), return_counts=True)
        term, where = pairs // n, pairs % n
        first = np.flatnonzero(np.diff(term, prepend=-1))
        gaps = np.diff(where, prepend=0)
        gaps[first] = where[first]
        held = [np.add.reduceat(x, first) for x in (np.ones(len(term), np.int64), counts)]
        packed = []
        for values in (gaps, counts):
            data, wide = varbytes(values)
            packed.append(_binary(data, np.add.reduceat(wide, first)))
        table = pa.table([pa.array(np.full(len(first), self.shard)), pa.array([names[i] for i in by_name], pa.binary()), *map(pa.array, held), *packed], _NAMES)
        yield from table.to_batches(size)


def _indexer(batches):
    part, seq = TaskContext.get().partitionId(), 0
    shard = ShardBuilder(part << 32)
    for batch in batches:
        for doc_id, data in zip(batch.column(0), batch.column(1)):
            shard.add(doc_id.as_py(), data.as_py())
            if shard.full():
                yield from shard.rows()
                seq += 1
                shard = ShardBuilder(part << 32 | seq)
    yield from shard.rows()


class Postings:
    """One shard's documents and the postings of the terms asked for; scores of a posting are reckoned once for all queries."""

    def __init__(self, docs: bytes, lengths: bytes, all_docs: int, all_terms: int):
        self.docs = np.frombuffer(docs, "<i8")
        n = from_varbytes(lengths)
        self.norm = 20 * (50 + (50 * n * all_docs) // all_terms)
        self.packed: dict[bytes, tuple[bytes, bytes]] = {}
        self.read: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}

    def of(self, term: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        """Documents of a term, ascending, and what one unit of weight scores in each."""
        if term not in self.read:
            if term not in self.packed:
                return None
            places, counts = self.packed.pop(term)
            at, tf = np.cumsum(from_varbytes(places)), from_varbytes(counts)
            self.read[term] = at, (1_000_000_000 * tf) // (1000 * tf + self.norm[at])
        return self.read[term]

    def top(self, terms: list[bytes], weights: list[int], k: int) -> list[tuple[int, int]]:
        """(score, place) of the k best documents with a score above 0, best first; of equal scores the smaller place."""
        cursors = [(*found, w) for t, w in zip(terms, weights) if w > 0 and (found := self.of(t)) is not None]
        heap = [(int(at[0]), c, 0) for c, (at, _, _) in enumerate(cursors)]
        heapq.heapify(heap)
        best: list[tuple[int, int]] = []  # (score, -place), the worst first
        while heap:
            low = heap[0][0]
            sums = np.zeros(WINDOW, np.int64)
            while heap and heap[0][0] < low + WINDOW:
                _, c, start = heapq.heappop(heap)
                at, unit, w = cursors[c]
                stop = start + int(np.searchsorted(at[start : start + WINDOW], low + WINDOW))
                sums[at[start:stop] - low] += w * unit[start:stop]
                if stop < len(at):
                    heapq.heappush(heap, (int(at[stop]), c, stop))
            able = np.flatnonzero(sums > (best[0][0] if len(best) == k else 0))  # equal scores of later documents do not enter
            if len(able) > k:
                worth = sums[able]
                able = able[worth >= np.partition(worth, len(worth) - k)[len(worth) - k]]
            for place in able.tolist():
                entry = int(sums[place]), -(low + place)
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return [(score, -place) for score, place in sorted(best, reverse=True)]


def _search(k: int, all_docs: int, all_terms: int):
    """Rows sorted by shard and kind: a shard's documents (0), its postings (1), then the queries (2)."""

    def run(batches):
        shard = None
        for batch in batches:
            out = [], [], []
            for kind, item, term, places, counts, terms, weights in zip(*(batch.column(c) for c in ("kind", "item_id", "term", "places", "counts", "terms", "weights"))):
                kind = kind.as_py()
                if kind == 0:
                    shard = Postings(places.as_py(), counts.as_py(), all_docs, all_terms)
                elif kind == 1:
                    shard.packed[term.as_py()] = places.as_py(), counts.as_py()
                else:
                    found = shard.top(terms.as_py(), weights.as_py(), k)
                    out[0].extend([item.as_py()] * len(found))
                    out[1].extend(shard.docs[[p for _, p in found]].tolist() if found else ())
                    out[2].extend(s for s, _ in found)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["item_id", "doc_id", "score"])

    return run


class LexicalIndex:
    """An index in a folder of the shared storage; it opens again by its folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @classmethod
    def build(cls, docs: DataFrame, folder: str | None = None) -> LexicalIndex:
        """Index docs (doc_id, text) where they are read."""
        spark = docs.sparkSession
        small_batches(spark)
        folder = folder or new_path(spark, "lexical")
        rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("data"))
        materialize(rows.mapInArrow(_indexer, _INDEX), "lexical", folder)
        return cls(spark, folder)

    def table(self) -> DataFrame:
        return self.spark.read.schema(_INDEX).parquet(self.folder)

    def search(self, items: DataFrame, k: int = 50) -> DataFrame:
        """(item_id, rank, doc_id, score): of every item (item_id, text) the k best documents."""
        spark, index = self.spark, self.table()
        small_batches(spark)
        pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
        folded = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        words = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.explode(F.regexp_extract_all(folded, F.lit(pattern), F.lit(0))).alias("word"))
        asked = materialize(words.select("item_id", F.encode("word", "UTF-8").alias("term")).distinct(), "asked")
        found = materialize(index.where("term is not null").join(asked.select("term").distinct(), "term", "left_semi"), "postings")
        shards = index.where("term is null")
        all_docs, all_terms = shards.agg(F.sum("docs"), F.sum("total")).head()
        spread = found.groupBy("term").agg(F.sum("docs").alias("df"))
        weight = F.floor(1000 * F.log((2.0 * F.lit(all_docs or 0) + 2) / (2.0 * F.col("df") + 1)))
        weighed = asked.join(spread, "term").select("item_id", "term", weight.cast("long").alias("w")).where("w > 0")
        queries = weighed.groupBy("item_id").agg(F.collect_list(F.struct("term", "w")).alias("q")).select("item_id", F.col("q.term").alias("terms"), F.col("q.w").alias("weights"))
        queries = materialize(queries, "queries")
        none = lambda kind, name: F.lit(None).cast(kind).alias(name)
        stored = shards.unionByName(found).select("shard", F.when(F.col("term").isNull(), 0).otherwise(1).alias("kind"), none("long", "item_id"), "term", "places", "counts", none("array<binary>", "terms"), none("array<long>", "weights"))
        n_items, n_terms = queries.agg(F.count(F.lit(1)), F.sum(F.size("terms"))).head()
        blocks = max(1, -(-n_items // BLOCK_ITEMS))
        in_blocks = queries.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))
        every = shards.select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        asks = every.join(F.broadcast(in_blocks) if (n_terms or 0) <= BROADCAST_TERMS else in_blocks, "block")
        passing = asks.select("shard", F.lit(2).alias("kind"), "item_id", none("binary", "term"), none("binary", "places"), none("binary", "counts"), "terms", "weights")
        met = stored.unionByName(passing).repartition(parts(spark), "shard").sortWithinPartitions("shard", "kind", "item_id")
        top = met.mapInArrow(_search(k, all_docs or 0, all_terms or 1), "item_id long, doc_id long, score long")
        best = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
        return top.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    return LexicalIndex.build(docs).search(items, 50)


ORACLE_OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents WHERE doc_id IS NOT NULL),
size AS (SELECT r, doc_id, len(ws) AS n FROM d WHERE len(ws) > 0),
al AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM size),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM d) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE item_id IS NOT NULL),
w AS (SELECT item_id, term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT) AS w FROM q JOIN df USING (term), al),
s AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)))) AS BIGINT) AS score
  FROM w JOIN tf USING (term) JOIN size USING (r), al GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 50
"""
