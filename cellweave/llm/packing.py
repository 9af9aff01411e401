"""Token ids on disk, packed to the fixed width that the vocabulary needs.

A file holds documents in ascending doc_id order: a header, the packed ids in blocks of BLOCK ids, each starting at a whole byte,
then the index: doc_ids, starts of documents (in ids), byte offsets of blocks, and a footer with the lengths. Because the width is
fixed and blocks start at known bytes, any range of ids is found by arithmetic and unpacked by numpy at once.

Files are written by the tasks of a range partitioning; a manifest row counts only when its task attempt is committed, and only
files of the manifest are ever opened, so that what lost executors left half-written changes nothing. The start of a file in the
whole corpus is the sum over the files before it.

Defined results: null text is the empty text and has the end id alone; texts of any length are encoded whole (a file holds one
document at least, so that one of more than FILE_IDS ids has a file of its own); null doc_ids come first; rows with equal doc_ids
are in the order of a hash of their texts; a table without rows gives no file and no rows; columns other than doc_id and text,
whatever their names, do not matter.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.llm.common import materialize, new_path, open_shared, parts, read_shared, small_batches
from cellweave.llm.words import WordEncoder

MAGIC = b"CWTOKS01"
BLOCK = 1 << 14
FILE_IDS = 4 << 20
_FOOTER = struct.Struct("<BIIQQQ8s")  # bits, block, vocabulary, documents, ids, bytes of packed ids, magic
NO_ID = -(1 << 63)


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids in `bits` bits each, least significant first, filled up to a whole byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(spread.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int, first: int = 0) -> np.ndarray:
    """n ids from the first-th on."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n, first * bits // 8).astype(np.uint32)
    at = (np.arange(first, first + n, dtype=np.int64)) * bits
    raw = np.frombuffer(data + b"\0" * 8, np.uint8)
    byte = at >> 3
    word = np.zeros(n, np.uint64)
    for k in range((bits + 14) // 8):
        word |= raw[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return ((word >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


class TokenFile:
    """A packed file in memory (or anything sliceable, such as mmap)."""

    @staticmethod
    def build(doc_ids: list[int | None], docs: list[np.ndarray], vocab: int) -> bytes:
        bits = max(1, (vocab - 1).bit_length())
        ids = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
        blocks = [pack(ids[i : i + BLOCK], bits) for i in range(0, len(ids), BLOCK)]
        offsets = np.cumsum([len(MAGIC), *map(len, blocks)]).astype("<u8")
        starts = np.cumsum([0, *map(len, docs)]).astype("<u8")
        names = np.array([NO_ID if d is None else d for d in doc_ids], "<i8")
        body = b"".join(blocks)
        return MAGIC + body + names.tobytes() + starts.tobytes() + offsets.tobytes() + _FOOTER.pack(bits, BLOCK, vocab, len(docs), len(ids), len(body), MAGIC)

    def __init__(self, data):
        self.data = data
        self.bits, self.block, self.vocab, self.n_docs, self.n_ids, size, magic = _FOOTER.unpack(data[len(data) - _FOOTER.size :])
        if magic != MAGIC or data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token file")
        at = len(MAGIC) + size
        n_blocks = -(-self.n_ids // self.block)
        if len(data) != at + 8 * (2 * self.n_docs + 1 + n_blocks + 1) + _FOOTER.size:
            raise ValueError("token file is cut")
        self.doc_ids = np.frombuffer(data, "<i8", self.n_docs, at)
        self.starts = np.frombuffer(data, "<u8", self.n_docs + 1, at + 8 * self.n_docs)
        self.offsets = np.frombuffer(data, "<u8", n_blocks + 1, at + 8 * (2 * self.n_docs + 1))

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the file; only the blocks in question are touched."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        a, b = start // self.block, (stop - 1) // self.block
        out = []
        for k in range(a, b + 1):
            lo, hi = max(start, k * self.block), min(stop, (k + 1) * self.block)
            out.append(unpack(self.data[int(self.offsets[k]) : int(self.offsets[k + 1])], self.bits, hi - lo, lo - k * self.block))
        return np.concatenate(out)

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def _writer(folder: str, tokenizer: str, end_id: int | None):
    def run(batches):
        enc = WordEncoder.at(tokenizer)
        part, name, seq, names, docs, held = TaskContext.get().partitionId(), uuid.uuid4().hex, 0, [], [], 0
        end = np.array([] if end_id is None else [end_id], np.uint32)

        def flush():
            nonlocal seq, names, docs, held
            file = f"{part:06d}-{seq:05d}-{name}.tok"
            with open_shared(f"{folder}/files/{file}") as f:
                f.write(TokenFile.build(names, docs, enc.vocab))
            row = pa.RecordBatch.from_arrays([pa.array([file]), pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(docs)], pa.int64()), pa.array([held], pa.int64())], ["file", "part", "seq", "n_docs", "n_ids"])
            seq, names, docs, held = seq + 1, [], [], 0
            return row

        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, data in zip(batch.column(0).to_pylist(), enc.encode(texts)):
                ids = np.concatenate([enc.ids(data), end]).astype(np.uint32)
                names.append(doc_id)
                docs.append(ids.astype(enc.type))
                held += len(ids)
                if held >= FILE_IDS:
                    yield flush()
        if docs:
            yield flush()

    return run


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int | None = 1, folder: str | None = None) -> tuple[str, DataFrame]:
    """Write docs (doc_id, text) in ascending doc_id order; returns the folder and the manifest (file, part, seq, n_docs, n_ids)."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or new_path(spark, "tokens")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange(parts(spark), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    manifest = ordered.mapInArrow(_writer(folder, tokenizer, end_id), "file string, part int, seq int, n_docs long, n_ids long")
    return folder, materialize(manifest, "manifest", f"{folder}/manifest")


def _reader(folder: str):
    def run(batches):
        for batch in batches:
            for file, begin in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = TokenFile(read_shared(f"{folder}/files/{file}"))
                whole = t.ids(0, t.n_ids).astype("<u4")
                bounds = t.starts.astype(np.int64)
                crc = [zlib.crc32(whole[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t.doc_ids, mask=t.doc_ids == NO_ID), pa.array(bounds[:-1] + begin), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    return run


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of the manifest. A task opens one file at a time."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    starts = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long").alias("begin"))
    return starts.repartition(parts(spark), "file").mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, manifest = write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), 1)
    return read_tokens(spark, folder, manifest)
