"""Token counts: lengths only, in Arrow batches.

Texts are split at safe boundaries, i.e. before a blank that follows another character. No piece of the model crosses such a
boundary (checked when the model is loaded), and the blank itself is what the model puts before each text, so that the sum over
the parts is the count of the whole. Parts of more than LONG characters, such as texts without blanks, are split again between two
characters that stand side by side in no piece of the model, since merges never cross these; such a part is counted with the
character before it, whose own count is then taken off. Equal parts of a task are counted once; the library gets the others in
batches balanced by bytes. Texts with the model's own blank sign or with null characters, and models that fail the checks, are
counted whole.

Defined results: null counts as the empty text, which has no tokens; texts of any length are counted whole; repeated rows are counted
each; a null doc_id stays null; a table without rows gives none; columns other than doc_id and text, whatever their names, do not
matter.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import map_batches, small_batches

SIGN = "\u2581"
#: Bytes of text that the library gets at once.
BATCH_BYTES = 1 << 20
#: Parts that a worker remembers.
REMEMBER = 600_000
#: Parts without blanks of more characters are split again.
LONG = 2000
_SPACED = re.compile(" +[^ ]*")


class PieceCounter:
    _loaded: dict[str, PieceCounter] = {}

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        one = self.sp.encode("a")
        self.space = len(self.sp.encode("a ")) - len(one)
        self.safe = not any(SIGN in p.lstrip(SIGN) for p in pieces) and self.space == 1 and self.sp.id_to_piece(one[0]).startswith(SIGN) and len(self.sp.encode(" a")) == len(one) + 1
        #: Characters side by side in a piece; all other neighbours are safe to part where the model changes no characters.
        self.pairs = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        odd = "\ufb01\u2460e\u0301\u00e9\uff21\u212b\u3000\u00a0\u1100\u1161\t\n"
        self.apart = self.safe and self.sp.decode(self.sp.encode(odd)) == odd
        self.known: dict[str, int] = {"": self.space}

    @classmethod
    def at(cls, path: str) -> PieceCounter:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def parts(self, text: str) -> list[str]:
        """Parts whose counts add up to that of a non-empty text. An empty part stands for a single last blank."""
        if not self.safe or SIGN in text or "\0" in text:
            return [text]
        found = text.split(" ")
        if "" in found:
            found = [x[1:] for x in _SPACED.findall(" " + text)]
        return found

    def cuts(self, part: str) -> list[str]:
        """Pieces of a long part, each but the first led by the last character of the one before."""
        out, at = [], 0
        for i in range(1, len(part)):
            if i - at >= LONG and part[i - 1 : i + 1] not in self.pairs:
                out.append(part[max(0, at - 1) : i])
                at = i
        return [*out, part[max(0, at - 1) :]]

    def learn(self, parts: set[str]) -> None:
        if len(self.known) > REMEMBER:
            self.known = {"": self.space}
        batch, size = [], 0
        for p in parts.difference(self.known):
            if self.apart and len(p) > LONG and SIGN not in p and "\0" not in p:
                self._count_long(p)
                continue
            batch.append(p)
            size += len(p) if p.isascii() else len(p.encode())
            if size >= BATCH_BYTES:
                self._count(batch)
                batch, size = [], 0
        self._count(batch)

    def _count(self, batch: list[str]) -> None:
        if batch:
            self.known.update(zip(batch, map(len, self.sp.encode(batch, num_threads=1))))

    def _count_long(self, part: str) -> None:
        cuts, total = self.cuts(part), 0
        for i in range(0, len(cuts), 256):
            total += sum(map(len, self.sp.encode(cuts[i : i + 256], num_threads=1)))
        lead = {c[0]: len(self.sp.encode(c[0])) for c in cuts[1:]}
        self.known[part] = total - sum(lead[c[0]] for c in cuts[1:])

    def counts(self, texts: list[str | None]) -> list[int]:
        """Token counts; works off the texts in groups balanced by bytes, so that what is held stays bounded."""
        out, group, size = [], [], 0
        for t in texts:
            group.append(self.parts(t) if t else None)
            size += len((t or "").encode())
            if size >= 4 * BATCH_BYTES:
                out += self._group(group)
                group, size = [], 0
        return out + self._group(group)

    def _group(self, group: list[list[str] | None]) -> list[int]:
        wanted: set[str] = set()
        for g in group:
            if g:
                wanted.update(g)
        if len(self.known) > REMEMBER:
            self.known = {"": self.space}
        self.learn(wanted)
        get = self.known.__getitem__
        return [sum(map(get, g)) if g else 0 for g in group]


def count_tokens(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of docs (doc_id, text); model is the path of a sentencepiece model that executors have too."""
    small_batches(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counter = PieceCounter.at(model)
        texts = batch.column(1).to_pylist()
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counter.counts(texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return map_batches(rows, run, "doc_id long, n_bytes long, n_tokens long")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).withColumn("over_limit", F.col("n_tokens") > 4096)
