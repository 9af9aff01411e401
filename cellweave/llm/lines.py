"""Line deduplication with sharded cuckoo filters over exact reference counts.

State (Parquet in one folder, so that any executor can be lost and `LineStore.open` finds it again):

* ``refs``: one row per distinct line key with the number of documents that hold it;
* ``filters``: one cuckoo filter per shard over the keys whose count reaches ``min_docs``;
* ``state``: one row per finished change; the last names the version that counts.

``insert`` adds documents, ``delete`` takes documents out again; both merge signed counts, so that the two undo each other in either
order. ``clean`` drops every line whose key is common. The number of shards doubles with the common keys, so that a shard's filter
stays near SHARD_KEYS keys whatever the table. A filter answers "surely not common"; its hits are looked up in the exact table, so
false positives never drop a line. Filters of at most ``FILTER_BYTES`` in all are broadcast and meet the lines where they are;
larger ones stay in their shards, and the lines are sent there.

A key with more documents than HOT_SHARE of a task's fair number of common lines is known by name (there are at most
tasks / HOT_SHARE of these) and decided without a lookup, so that no task gets all documents of one common line.

Defined results: null or empty text is one empty line; texts and lines of any length are read whole; a key without code points
never counts; repeated rows are documents of their own; rows with a null doc_id are kept and cleaned like others; a table without
rows gives none and leaves the counts as they are; columns other than doc_id and text, whatever their names, do not matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import BLANKS, as_bytes, delete_path, materialize, new_path, parts, small_batches

#: Shards at least, and common keys of a shard at which their number doubles.
SHARDS = 64
SHARD_KEYS = 1 << 16
#: Filters that are broadcast at most, in all.
FILTER_BYTES = 8 << 20
HOT_SHARE = 0.25
SLOTS = 4
KICKS = 200
#: Distinct keys a task counts in memory before it passes them on.
FLUSH = 100_000


class CuckooFilter:
    """16-bit fingerprints, four slots a bucket, partial-key cuckoo hashing. Keys are pairs of unsigned 64-bit words."""

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        assert buckets & (buckets - 1) == 0
        self.mask = np.uint64(buckets - 1)
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table

    @classmethod
    def sized(cls, n: int) -> CuckooFilter:
        return cls(1 << max(2, int(np.ceil(np.log2(max(1, n) / (SLOTS * 0.85))))))

    @staticmethod
    def _prints(lo):
        fp = (lo >> np.uint64(48)).astype(np.uint16)
        return np.where(fp == 0, np.uint16(1), fp)

    def _bucket(self, hi):
        return (hi >> np.uint64(20)) & self.mask  # the low bits choose the shard

    def _other(self, i, fp):
        with np.errstate(over="ignore"):
            return (i ^ (fp.astype(np.uint64) * np.uint64(0x5BD1E9955BD1E995) >> np.uint64(17))) & self.mask

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        fp = self._prints(lo)
        i = self._bucket(hi)
        j = self._other(i, fp)
        return (self.table[i] == fp[:, None]).any(1) | (self.table[j] == fp[:, None]).any(1)

    def _place(self, i: int, fp: int) -> bool:
        row = self.table[i]
        for s in range(SLOTS):
            if row[s] == 0:
                row[s] = fp
                return True
        return False

    def insert(self, hi: np.ndarray, lo: np.ndarray) -> bool:
        """False when a key finds no place; the filter must then be rebuilt larger."""
        fps = self._prints(lo)
        first = self._bucket(hi)
        second = self._other(first, fps)
        for i, j, fp in zip(first.tolist(), second.tolist(), fps.tolist()):
            if self._place(i, fp) or self._place(j, fp):
                continue
            at = j
            for kick in range(KICKS):
                s = (fp + kick) % SLOTS
                fp, self.table[at, s] = int(self.table[at, s]), fp
                at = int(self._other(np.array([at], np.uint64), np.array([fp], np.uint16))[0])
                if self._place(at, fp):
                    break
            else:
                return False
        return True

    def delete(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """Take out keys that were inserted."""
        fps = self._prints(lo)
        first = self._bucket(hi)
        second = self._other(first, fps)
        for i, j, fp in zip(first.tolist(), second.tolist(), fps.tolist()):
            for at in (i, j):
                found = np.flatnonzero(self.table[at] == fp)
                if len(found):
                    self.table[at, found[0]] = 0
                    break

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        table = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        return cls(len(table), table)


def line_key(line: bytes) -> bytes:
    return line.strip(BLANKS).lower()  # bytes.lower() changes A-Z only


def digests(lines: list[bytes]) -> list[bytes]:
    """128-bit digests of the keys; empty for keys without code points."""
    h = xxhash.xxh3_128_digest
    return [h(k) if k else b"" for k in map(line_key, lines)]


def _words(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    w = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
    return w[:, 0].copy(), w[:, 1].copy()


def _count_keys(batches):
    """(hi, lo, n): in how many documents of this task each key occurs."""
    seen: dict[bytes, int] = {}

    def out():
        hi, lo = _words(list(seen))
        return pa.RecordBatch.from_arrays([pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), pa.array(list(seen.values()), pa.int64())], ["hi", "lo", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            for d in set(digests(text.split(b"\n"))):
                if d:
                    seen[d] = seen.get(d, 0) + 1
            if len(seen) >= FLUSH:
                yield out()
                seen.clear()
    if seen:
        yield out()


class LineStore:
    """Reference counts and filters under one folder. Each change writes a new version and leaves the one before for frames that still read it."""

    def __init__(self, spark: SparkSession, path: str | None = None, min_docs: int = 10, shards: int = SHARDS):
        """A new, empty store; shards is a power of two and the least number of them."""
        self.spark, self.path, self.min_docs, self.least, self.shards = spark, path or new_path(spark, "lines"), min_docs, shards, shards
        self.version, self.refs, self.filters = 0, None, None

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> LineStore:
        """The store that finished changes have left in a folder."""
        last = spark.read.parquet(f"{path}/state").orderBy(F.desc("version")).first()
        store = cls(spark, path, last.min_docs, last.least)
        store.version, store.shards = last.version, last.shards
        store._load()
        return store

    def _load(self) -> None:
        self.refs = self.spark.read.schema("hi long, lo long, refs long, old long").parquet(f"{self.path}/refs-{self.version}").where("refs <> 0").select("hi", "lo", "refs")
        self.filters = self.spark.read.schema("shard int, bits binary").parquet(f"{self.path}/filters-{self.version}")

    def _delta(self, docs: DataFrame, sign: int) -> DataFrame:
        small_batches(self.spark)
        counted = docs.select(as_bytes().alias("b")).mapInArrow(_count_keys, "hi long, lo long, n long")
        return counted.groupBy("hi", "lo").agg((F.lit(sign) * F.sum("n")).alias("n"))

    def insert(self, docs: DataFrame) -> LineStore:
        return self._merge(self._delta(docs, 1))

    def delete(self, docs: DataFrame) -> LineStore:
        return self._merge(self._delta(docs, -1))

    def _shard(self):
        return F.pmod("hi", F.lit(self.shards)).cast("int")

    def _merge(self, delta: DataFrame) -> LineStore:
        change = delta.select("hi", "lo", F.lit(0).cast("long").alias("old"), "n")
        if self.refs is not None:
            held = self.refs.select("hi", "lo", F.col("refs").alias("old"), F.lit(0).cast("long").alias("n"))
            change = held.unionByName(change).groupBy("hi", "lo").agg(F.sum("old").alias("old"), F.sum("n").alias("n"))
        merged = change.select("hi", "lo", (F.col("old") + F.col("n")).alias("refs"), "old").where("refs <> 0 or old <> 0")
        version, before = self.version + 1, self.filters
        changed = materialize(merged, "refs", f"{self.path}/refs-{version}")
        common = F.col("refs") >= self.min_docs
        hot = changed.where(common)
        shards, keys = self.least, hot.count()
        while keys > shards * SHARD_KEYS:
            shards *= 2
        again = before is None or shards != self.shards
        self.shards = shards
        crossed = changed.where(common != (F.col("old") >= self.min_docs)).select(self._shard().alias("shard"), "hi", "lo", common.alias("into"))
        filters = self._built(hot) if again else self._refilter(before, crossed, hot)
        materialize(filters, "filters", f"{self.path}/filters-{version}")
        self.spark.createDataFrame([(version, self.min_docs, self.least, shards)], "version int, min_docs int, least int, shards int").coalesce(1).write.mode("append").parquet(f"{self.path}/state")
        self.version = version
        self._load()
        for name in ("refs", "filters", "grown"):
            delete_path(self.spark, f"{self.path}/{name}-{version - 2}")
        return self

    def _built(self, hot: DataFrame) -> DataFrame:
        return hot.select(self._shard().alias("shard"), "hi", "lo").groupBy("shard").applyInArrow(_built, "shard int, bits binary")

    def _refilter(self, filters: DataFrame, crossed: DataFrame, hot: DataFrame) -> DataFrame:
        """Filters after the keys that became common went in and those that ceased to be went out. A filter that overflows is built anew from the exact table."""
        grown = crossed.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(_changed, "shard int, bits binary, ok boolean")
        grown = materialize(grown, "grown", f"{self.path}/grown-{self.version + 1}")
        again = hot.withColumn("shard", self._shard()).join(grown.where("not ok").select("shard"), "shard", "left_semi")
        return grown.where("ok").select("shard", "bits").unionByName(self._built(again))

    def _often(self, n: int) -> set[bytes]:
        """Keys of so many documents that one task should not look up all of them; at most n / HOT_SHARE."""
        hot = self.refs.where(F.col("refs") >= self.min_docs)
        fair = HOT_SHARE * (hot.agg(F.sum("refs")).head()[0] or 0) / n
        return {int(r.hi).to_bytes(8, "little", signed=True) + int(r.lo).to_bytes(8, "little", signed=True) for r in hot.where(F.col("refs") > fair).select("hi", "lo").collect()}

    def common_lines(self, docs: DataFrame) -> DataFrame:
        """(doc_id, th, line, hi, lo): lines whose key is common, by document and position. th is a digest of the text: with it, repeated doc_ids stay apart."""
        small_batches(self.spark)
        n, context = parts(self.spark), self.spark.sparkContext
        rows = docs.select("doc_id", as_bytes().alias("b"))
        often = context.broadcast(self._often(n))
        shards, size = self.shards, self.filters.agg(F.sum(F.octet_length("bits"))).head()[0] or 0
        if size <= FILTER_BYTES:
            held = context.broadcast({r.shard: bytes(r.bits) for r in self.filters.collect()})
            hits = rows.mapInArrow(lambda bs: _probe(bs, held, often, shards), _HIT)
        else:
            keyed = rows.mapInArrow(lambda bs: _keyed(bs, often), _HIT)
            shard = F.when(F.col("sure"), F.pmod(F.xxhash64("th", "line"), F.lit(shards)).cast("int")).otherwise(self._shard())
            keyed = keyed.select(shard.alias("shard"), F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("bits"), *_HIT_COLUMNS)
            filters = self.filters.select("shard", F.lit(0).alias("kind"), "bits", *[F.lit(None).cast(t).alias(c) for c, t in _HIT_TYPES])
            hits = keyed.unionByName(filters).repartition(n, "shard").sortWithinPartitions("shard", "kind").mapInArrow(_sift, _HIT)
        # keys that need no lookup get a key of their own, so that they do not meet
        k_hi = F.when(F.col("sure"), F.xxhash64("th", "line")).otherwise(F.col("hi"))
        hot = self.refs.where(F.col("refs") >= self.min_docs).select(F.col("hi").alias("h_hi"), F.col("lo").alias("h_lo"))
        found = hits.withColumn("k_hi", k_hi).join(hot, (F.col("k_hi") == F.col("h_hi")) & (F.col("lo") == F.col("h_lo")), "left")
        return found.where("sure or h_hi is not null").select("doc_id", "th", "line", "hi", "lo")

    def clean(self, docs: DataFrame) -> DataFrame:
        """(doc_id, text, n_lines, n_dropped, kept): kept is the text without its common lines; text may be null."""
        drops = self.common_lines(docs).groupBy("doc_id", "th").agg(F.collect_set("line").alias("drops"))
        drops = drops.select(F.col("doc_id").alias("d_id"), F.col("th").alias("d_th"), "drops")
        whole = docs.select("doc_id", "text", F.unhex(F.md5(as_bytes())).alias("th"))
        joined = whole.join(drops, whole.doc_id.eqNullSafe(drops.d_id) & (whole.th == drops.d_th), "left").select("doc_id", "text", "drops")
        return joined.mapInArrow(_drop, "doc_id long, text string, n_lines long, n_dropped long, kept string")

    def clean_rows(self, docs: DataFrame, keep_first: bool = False) -> DataFrame:
        """docs (any columns, among them doc_id and text) with common lines gone from text, and n_chars, if there, brought up to date. A null text stays null.

        With keep_first the first of the lines with a common key stays in the document of the smallest doc_id that holds it, so that
        nothing goes from the corpus for good, and rows of which no more than blanks is left go.
        """
        found = self.common_lines(docs)
        if keep_first:
            found = materialize(found, "found")
            place = F.struct("doc_id", "th", "line")
            first = found.groupBy("hi", "lo").agg(F.min(place).alias("p")).select(F.col("p.doc_id").alias("f_id"), F.col("p.th").alias("f_th"), F.col("p.line").alias("f_line"))
            found = found.join(first, found.doc_id.eqNullSafe(first.f_id) & (found.th == first.f_th) & (found.line == first.f_line), "left_anti")
        drops = found.groupBy("doc_id", "th").agg(F.collect_set("line").alias("drops"))
        drops = drops.select(F.col("doc_id").alias("cw__id"), F.col("th").alias("cw__th"), F.col("drops").alias("cw__drops"))
        joined = docs.join(drops, docs.doc_id.eqNullSafe(drops.cw__id) & (F.unhex(F.md5(as_bytes())) == drops.cw__th), "left").drop("cw__id", "cw__th")
        schema, names = docs.schema, docs.columns
        at = {n: i for i, n in enumerate(names)}

        def run(batches):
            for b in batches:
                arrays, drops_of = [b.column(i) for i in range(len(names))], b.column(len(names)).to_pylist()
                texts = [_without(t, d) for t, d in zip(arrays[at["text"]].to_pylist(), drops_of)]
                if "n_chars" in at:
                    arrays[at["n_chars"]] = pa.array([old if t is None else len(t) for t, old in zip(texts, arrays[at["n_chars"]].to_pylist())], arrays[at["n_chars"]].type)
                arrays[at["text"]] = pa.array(texts, arrays[at["text"]].type)
                out = pa.RecordBatch.from_arrays(arrays, names)
                yield out.filter(pa.array([not d or bool(t.encode().strip(BLANKS)) for t, d in zip(texts, drops_of)])) if keep_first else out

        return joined.mapInArrow(run, schema)


def _without(text: str | None, drops: list[int] | None) -> str | None:
    if not drops or text is None:
        return text
    gone = set(drops)
    return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)


def _built(key, table):
    hi, lo = (table.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo"))
    made = CuckooFilter.sized(len(hi))
    while not made.insert(hi, lo):
        made = CuckooFilter(2 * len(made.table))
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([made.to_bytes()], pa.binary())})


def _changed(key, crossed, held):
    shard = key[0].as_py()
    bits, ok = (held.column("bits")[0].as_py() if held.num_rows else None), True
    if crossed.num_rows:
        hi, lo = (crossed.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo"))
        into = crossed.column("into").to_numpy(zero_copy_only=False)
        if not bits:
            ok = False
        else:
            f = CuckooFilter.from_bytes(bits)
            f.delete(hi[~into], lo[~into])
            ok = f.insert(hi[into], lo[into])
            bits = f.to_bytes()
    return pa.table({"shard": pa.array([shard], pa.int32()), "bits": pa.array([bits], pa.binary()), "ok": pa.array([ok])})


_HIT_TYPES = [("doc_id", "long"), ("th", "binary"), ("line", "int"), ("hi", "long"), ("lo", "long"), ("sure", "boolean")]
_HIT_COLUMNS = [c for c, _ in _HIT_TYPES]
_HIT = ", ".join(f"{c} {t}" for c, t in _HIT_TYPES)


def _occurrences(batch, often: set[bytes], hit) -> pa.RecordBatch | None:
    """The lines of a batch whose key is in often (sure) or passes hit(hi, lo)."""
    ids, keys, line, doc = batch.column(0), [], [], []
    texts = batch.column(1).to_pylist()
    for i, text in enumerate(texts):
        for n, d in enumerate(digests(text.split(b"\n"))):
            if d:
                keys.append(d)
                line.append(n)
                doc.append(i)
    if not keys:
        return None
    hi, lo = _words(keys)
    sure = np.fromiter((k in often for k in keys), bool, len(keys))
    at = np.flatnonzero(sure | hit(hi, lo))
    if not len(at):
        return None
    rows = np.array(doc)[at]
    th = {i: hashlib.md5(texts[i]).digest() for i in set(rows.tolist())}
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(rows)), pa.array([th[i] for i in rows.tolist()], pa.binary()), pa.array(np.array(line, np.int32)[at]), pa.array(hi[at].view(np.int64)), pa.array(lo[at].view(np.int64)), pa.array(sure[at])], _HIT_COLUMNS
    )


def _probe(batches, filters, often, shards: int):
    """Hits of the lines of whole documents with all filters at hand."""
    held = {k: CuckooFilter.from_bytes(v) for k, v in filters.value.items()}

    def hit(hi, lo):
        out, shard = np.zeros(len(hi), bool), np.mod(hi.view(np.int64), shards)
        for s in np.unique(shard).tolist():
            if s in held:
                at = np.flatnonzero(shard == s)
                out[at] = held[s].contains(hi[at], lo[at])
        return out

    for batch in batches:
        found = _occurrences(batch, often.value, hit)
        if found is not None:
            yield found


def _keyed(batches, often):
    """All lines of documents, to be sent to their filters."""
    for batch in batches:
        found = _occurrences(batch, often.value, lambda hi, lo: np.ones(len(hi), bool))
        if found is not None:
            yield found


def _sift(batches):
    """Hits of lines sorted by shard, each shard led by its filter (kind 0); one filter is held at a time."""
    at, held = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        shard, kind = (batch.column(c).to_numpy() for c in ("shard", "kind"))
        edges = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1]), True]).tolist()
        for a, b in zip(edges, edges[1:]):
            if shard[a] != at:
                at, held = shard[a], None
            if kind[a] == 0:
                held = CuckooFilter.from_bytes(batch.column("bits")[a].as_py())
                continue
            some = batch.slice(a, b - a)
            hit = some.column("sure").to_numpy(zero_copy_only=False)
            if held is not None:
                hit = hit | held.contains(*(some.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo")))
            yield some.filter(pa.array(hit)).select(_HIT_COLUMNS)


def _drop(batches):
    for batch in batches:
        n_lines, n_dropped, kept = [], [], []
        for text, drops in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            n_lines.append((text or "").count("\n") + 1)
            n_dropped.append(len(set(drops or ())))
            kept.append(_without(text, drops) or "")
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "text", "n_lines", "n_dropped", "kept"])


def dedup_lines(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """Build a store from docs and clean the same docs."""
    return LineStore(docs.sparkSession, min_docs=min_docs).insert(docs).clean(docs)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return dedup_lines(docs, 10).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


ORACLE_OP7 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
hot AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= 10)
SELECT doc_id, count(*) AS n_lines, count(hot.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE hot.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN hot USING (key) GROUP BY rid, doc_id
"""
