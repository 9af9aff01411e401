"""BPE encoding and decoding with content-defined chunk reuse.

Texts are cut where a rolling hash over the last WINDOW bytes hits a pattern, at blanks only, so that a passage has the same
chunks wherever it stands. Documents are sent to the task of their least chunk hash, which brings documents with common chunks
together; a chunk is encoded once in a task and its ids and decoded text are used again. A hash that too many documents share is
dealt out to several tasks.

Joins of chunks are then repaired: the words around a join are encoded together, and where the ids differ from those of the two
chunks, or where the tokenizer may look beyond blanks, the stretch between the nearest blanks on both sides is encoded anew. It
counts when the ids at its edges agree, that is, when each chunk's ids are those of its parts put together; chunks that do not agree
are joined to their neighbours and encoded again, until all agree or one chunk is left. So the ids are those of the whole text
whatever the cuts, and the work is linear but for texts that never agree (n log n).

Defined results: null is the empty text, with no ids and an empty decoded text; texts of any length are encoded whole, a text without
blanks as one chunk; repeated rows are encoded each (from the same chunks); a null doc_id stays null; a table without rows gives
none; columns other than doc_id and text, whatever their names, do not matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import materialize, parts, small_batches
from cellweave.llm.words import WordEncoder

WINDOW = 32
#: One in so many blanks is a cut: chunks of about half a KB of prose.
ONE_IN = 64
#: Bytes of chunks that a task keeps.
KEEP_BYTES = 96 << 20
#: A signature with more than this share of a partition's fair number of rows is dealt out.
HOT_SHARE = 0.25
_ODD = 0x9E3779B97F4A7C15
_INV = pow(_ODD, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    held = _powers.get(name)
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 16), base, np.uint64)
        held[0] = 1
        held = np.multiply.accumulate(held)
        if n <= 1 << 22:
            _powers[name] = held
    return held[:n]


def cuts(data: np.ndarray, window: int = WINDOW, one_in: int = ONE_IN) -> np.ndarray:
    """Positions of blanks that end a chunk (the blank opens the next one). data: UTF-8 bytes as uint8."""
    blank = np.flatnonzero((data == 32) | (data == 10))
    blank = blank[blank >= window]
    if not len(blank):
        return blank
    with np.errstate(over="ignore"):
        sums = np.cumsum(data * _power("up", _ODD, len(data)), dtype=np.uint64)
        before = np.where(blank > window, sums[blank - window - 1], np.uint64(0))
        h = (sums[blank - 1] - before) * _power("down", _INV, len(data))[blank - 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    found = blank[(h >> np.uint64(32)) % np.uint64(one_in) == 0]
    return found


def chunk(text: str, window: int = WINDOW, one_in: int = ONE_IN) -> list[bytes]:
    """Chunks that joined give the text's UTF-8 bytes."""
    raw = text.encode()
    if len(raw) <= window:
        return [raw] if raw else []
    at = [0, *cuts(np.frombuffer(raw, np.uint8), window, one_in).tolist(), len(raw)]
    return [raw[a:b] for a, b in zip(at, at[1:]) if b > a]


def signature(text: str | None) -> int:
    """The least hash of the text's chunks as a signed 64-bit number; 0 for no text."""
    h = xxhash.xxh3_64_intdigest
    least = min((h(c) for c in chunk(text or "")), default=1 << 63)
    return least - (1 << 63)


class ChunkCoder:
    """Encodes and decodes texts through chunks that are kept up to KEEP_BYTES."""

    def __init__(self, enc: WordEncoder, one_in: int = ONE_IN, window: int = WINDOW):
        self.enc, self.one_in, self.window = enc, one_in, window
        self.kept: dict[bytes, tuple[bytes, str, bytes, bytes]] = {}
        self.size = self.encoded = 0
        self.agreed: dict[tuple[bytes, bytes], bool] = {}

    def code(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(ids as the encoder's little-endian bytes, decoded text) of each text."""
        out, group, size = [], [], 0
        for t in texts:
            group.append(t)
            size += len(t)
            if size >= 2 << 20:
                out += self._code(group)
                group, size = [], 0
        return out + self._code(group)

    def _code(self, texts: list[str]) -> list[tuple[bytes, str]]:
        if self.size > KEEP_BYTES:
            self.kept, self.size = {}, 0
        if len(self.agreed) > 200_000:
            self.agreed = {}
        h = xxhash.xxh3_128_digest
        docs = [chunk(t, self.window, self.one_in) for t in texts]
        keys = [[h(c) for c in d] for d in docs]
        new: dict[bytes, bytes] = {}
        for ks, cs in zip(keys, docs):
            for k, c in zip(ks, cs):
                if k not in self.kept:
                    new[k] = c
        self._encode(new)
        if not (self.enc.joins_with_space and self.enc.safe):
            return [self._repaired(cs, ks) for ks, cs in zip(keys, docs)]
        joins = {(self.kept[a][3], self.kept[b][2]) for ks in keys for a, b in zip(ks, ks[1:])}
        self._judge([j for j in joins if j not in self.agreed])
        return [self._whole(ks, cs) for ks, cs in zip(keys, docs)]

    def _encode(self, new: dict[bytes, bytes]) -> None:
        texts = [c.decode() for c in new.values()]
        ids = self.enc.encode(texts)
        decoded = self.enc.tok.decode_batch([self.enc.ids(x).tolist() for x in ids], skip_special_tokens=False) if texts else []
        self.encoded += len(texts)
        for (k, c), i, d in zip(new.items(), ids, decoded):
            words = c.split()
            self.kept[k] = (i, d, words[0] if words else b"", words[-1] if words else b"")
            self.size += len(i) + len(d) + len(c) // 8 + 200

    def _judge(self, joins: list[tuple[bytes, bytes]]) -> None:
        """Do the words beside a cut give the same ids together as apart?"""
        both = self.enc.encode_many([f"{a.decode()} {b.decode()}" for a, b in joins])
        one = self.enc.encode_many([x.decode() for j in joins for x in j])
        for n, j in enumerate(joins):
            self.agreed[j] = both[n] == one[2 * n] + one[2 * n + 1]

    def _whole(self, keys: list[bytes], chunks: list[bytes]) -> tuple[bytes, str]:
        held = [self.kept[k] for k in keys]
        if all(self.agreed[(a[3], b[2])] for a, b in zip(held, held[1:])):
            return b"".join(x[0] for x in held), " ".join(x[1] for x in held if x[1])
        return self._repaired(chunks, keys)

    def _repaired(self, chunks: list[bytes], keys: list[bytes]) -> tuple[bytes, str]:
        ids = repaired(self.enc, chunks, [self.kept[k][0] for k in keys])
        return ids, self.enc.tok.decode(self.enc.ids(ids).tolist(), skip_special_tokens=False)


def _edges(text: str) -> tuple[int, int]:
    """The first and the last position where a blank follows another character; (0, 0) if there is none."""
    first = next((i for i in range(1, len(text)) if text[i].isspace() and not text[i - 1].isspace()), 0)
    last = next((i for i in range(len(text) - 1, 0, -1) if text[i].isspace() and not text[i - 1].isspace()), 0)
    return first, last


def repaired(enc: WordEncoder, chunks: list[bytes], ids: list[bytes]) -> bytes:
    """Ids of the joined chunks. The stretch over each join, between the nearest blanks, is encoded anew and counts when the ids at its edges agree with those of the chunks; other chunks grow by their neighbours."""
    pieces, known = [c.decode() for c in chunks], list(ids)
    while len(pieces) > 1:
        last = len(pieces) - 1
        spans = [_edges(t) for t in pieces]
        spans = [(0 if n == 0 else a, len(t) if n == last else b) for n, ((a, b), t) in enumerate(zip(spans, pieces))]
        parts = enc.encode_many([x for (a, b), t in zip(spans, pieces) for x in (t[:a], t[a:b], t[b:])])
        bad = [(n > 0 and not a) or (n < last and not b) or known[n] != b"".join(parts[3 * n : 3 * n + 3]) for n, (a, b) in enumerate(spans)]
        if not any(bad):
            stretches = enc.encode_many([s[b:] + t[:a] for s, t, (_, b), (a, _) in zip(pieces, pieces[1:], spans, spans[1:])])
            return b"".join(parts[3 * n + 1] + (stretches[n] if n < last else b"") for n in range(last + 1))
        grown, fresh, n = [], [], 0
        while n <= last:
            if n < last and (bad[n] or bad[n + 1] and n + 1 == last):
                grown.append(pieces[n] + pieces[n + 1])
                fresh.append(None)
                n += 2
            else:
                grown.append(pieces[n])
                fresh.append(known[n])
                n += 1
        again = iter(enc.encode_many([t for t, x in zip(grown, fresh) if x is None]))
        pieces, known = grown, [next(again) if x is None else x for x in fresh]
    return known[0] if known else b""


def _coder(tokenizer: str):
    def run(batches):
        enc = WordEncoder.at(tokenizer)
        coder = ChunkCoder(enc)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            coded = coder.code(texts)
            n = [len(i) // enc.type.itemsize for i, _ in coded]
            ids = [hashlib.sha256(enc.ids(i).astype("<u4")).hexdigest() for i, _ in coded]
            dec = [hashlib.sha256(d.encode()).hexdigest() for _, d in coded]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(dec)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids_and_texts(tokenizer: str):
    def run(batches):
        enc = WordEncoder.at(tokenizer)
        coder = ChunkCoder(enc)
        kind = pa.list_(pa.int32())
        for batch in batches:
            coded = coder.code([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([enc.ids(i).astype(np.int32) for i, _ in coded], kind), pa.array([d for _, d in coded], pa.string())], ["doc_id", "ids", "decoded"])

    return run


def by_common_chunks(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) repartitioned so that documents with common chunks meet in a task; hot signatures are dealt out."""
    spark = docs.sparkSession
    small_batches(spark)
    n = parts(spark)

    def signed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([signature(t) for t in b.column(1).to_pylist()], pa.int64())], ["doc_id", "text", "sig"])

    def only_signs(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([signature(t) for t in b.column(0).to_pylist()], pa.int64())], ["sig"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = materialize(rows.select("text").mapInArrow(only_signs, "sig long").groupBy("sig").agg(F.count(F.lit(1)).alias("n")), "signs")
    total = counts.agg(F.sum("n")).head()[0] or 0
    fair = max(1, HOT_SHARE * total / n)
    hot = {r.sig: min(n, -(-r.n // int(fair + 1))) for r in counts.where(F.col("n") > fair).collect()}  # at most n / HOT_SHARE rows
    ways = spark.createDataFrame(list(hot.items()), "h_sig long, h_ways long")
    signed_rows = rows.mapInArrow(signed, "doc_id long, text string, sig long").join(F.broadcast(ways), F.col("sig") == F.col("h_sig"), "left")
    deal = F.pmod(F.xxhash64("doc_id", "text"), F.coalesce("h_ways", F.lit(1)))
    return signed_rows.repartition(n, "sig", deal).select("doc_id", "text")


def encode_decode(docs: DataFrame, tokenizer: str, digests: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of docs (doc_id, text), or (doc_id, ids, decoded) with digests=False."""
    routed = by_common_chunks(docs)
    if digests:
        return routed.mapInArrow(_coder(tokenizer), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return routed.mapInArrow(_ids_and_texts(tokenizer), "doc_id long, ids array<int>, decoded string")


def op10_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
