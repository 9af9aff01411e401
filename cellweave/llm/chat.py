r"""Chat formatting with every assistant turn as an example of its own: all turns before it are context, only its text is trained on.

A turn is written as `<turn role>text</turn>` and a line end. Inside roles and texts a backslash stands before every backslash, `<` and
`>`, so that no text can open or close a turn, nor its end together with a marker, and unescaping gives back what was there.

The output has a row for each turn with its piece. The row of an assistant turn is an example, whole in itself: its number, the context
(all pieces before it), its own piece and the span under its loss mask in both together. The examples of a conversation so take about
its length times half its assistant turns before compression; a reader needs no other row for one. Files are written by tasks in which
a conversation's turns pass in order, with its text so far and one batch of bounded text in memory, and count only when a manifest row of
the task attempt is committed.

Defined results: a null text or role is the empty one; turns are ordered by turn (null first), then role and text, and rows that
occur twice are two turns; rows with a null conv_id are one conversation; a conversation without assistant turn has no example but is
written; roles other than `assistant` are context; texts of any length are one piece; an empty table gives no file and no rows;
columns other than conv_id, turn, role and text, whatever their names, do not matter.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import materialize, new_path, open_input, open_shared, parts, small_batches

TARGET = "assistant"
#: What may not stand unescaped inside a role or text.
CONTROL = re.compile(r"[\\<>]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TOKEN = re.compile(r"\\.|<turn |</turn>|>", re.DOTALL)
_OPEN, _CLOSE = "<turn ", "</turn>\n"
_SCHEMA = pa.schema([("conv_id", pa.int64()), ("pos", pa.int64()), ("piece", pa.string()), ("start", pa.int64()), ("example", pa.int64()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("context", pa.string())])
#: Text in one batch of examples (one example more at most), and rows of a batch of pieces.
EXPANDED_CHARS = 4 << 20
PIECES = 512


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The piece of a turn and where its text stands in it."""
    head, body = f"{_OPEN}{escape(role)}>", escape(text)
    return f"{head}{body}{_CLOSE}", len(head), len(head) + len(body)


def parse_turn(piece: str) -> tuple[str, str]:
    """Role and text of a piece. Whatever has a control string in another place than format_turn puts it is no piece."""
    bare = [m for m in _TOKEN.finditer(piece) if m[0][0] != "\\"]
    if [m[0] for m in bare] != [_OPEN, ">", "</turn>"] or bare[0].start() or bare[2].start() != len(piece) - len(_CLOSE):
        raise ValueError("not a formatted turn")
    return unescape(piece[len(_OPEN) : bare[1].start()]), unescape(piece[bare[1].end() : bare[2].start()])


class _Conversation:
    """Where the next turn of a conversation goes, and its text before that."""

    def __init__(self, conv_id):
        self.conv_id, self.pos, self.example, self.waiting, self.text = conv_id, 0, 0, [], ""
        self.length = 0

    def add(self, role: str, text: str) -> tuple:
        piece, a, b = format_turn(role, text)
        example = (None, None, None, None)
        if role == TARGET:
            self.text, self.waiting = "".join((self.text, *self.waiting)), []
            example = self.example, self.length + a, self.length + b, self.text
            self.example += 1
        row = self.conv_id, self.pos, piece, self.length, *example
        self.waiting.append(piece)
        self.pos, self.length = self.pos + 1, self.length + len(piece)
        return row


@dataclass
class _Batch:
    names: list[str]
    rows: list[tuple] = field(default_factory=list)
    size: int = 0

    def take(self, schema: pa.Schema) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*self.rows), schema)], schema=schema)
        self.rows, self.size = [], 0
        return out


def _writer(folder: str):
    def run(batches):
        now, writer, sink, file, rows = None, None, None, "", 0
        out = _Batch(_SCHEMA.names)
        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if now is None or now.conv_id != conv_id:
                    now = _Conversation(conv_id)
                out.rows.append(now.add(role or "", text or ""))
                out.size += len(out.rows[-1][2]) + len(out.rows[-1][7] or "")
                rows += 1
                if writer is None:
                    file = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.parquet"
                    sink = open_shared(f"{folder}/files/{file}")
                    writer = pq.ParquetWriter(sink, _SCHEMA, compression="zstd", use_dictionary=False, data_page_size=EXPANDED_CHARS)
                if out.size >= EXPANDED_CHARS or len(out.rows) >= PIECES:
                    writer.write_batch(out.take(_SCHEMA))
        if writer is not None:
            if out.rows:
                writer.write_batch(out.take(_SCHEMA))
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([rows])], ["file", "n_turns"])

    return run


def write_examples(turns: DataFrame, folder: str | None = None) -> tuple[str, DataFrame]:
    """Format turns (conv_id, turn, role, text); returns the folder and the manifest (file, n_turns). A file holds whole conversations."""
    spark = turns.sparkSession
    small_batches(spark)
    folder = folder or new_path(spark, "chat")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartition(parts(spark), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return folder, materialize(ordered.mapInArrow(_writer(folder), "file string, n_turns long"), "manifest", f"{folder}/manifest")


@dataclass
class Example:
    """An assistant turn: the text of all turns before it, its own piece, and its span in both together."""

    number: int
    context: str
    piece: str
    loss_start: int
    loss_end: int
    n_context: int

    def text(self) -> str:
        return self.context + self.piece

    def target(self) -> str:
        """The text under the loss mask, unescaped."""
        return unescape(self.piece[self.loss_start - len(self.context) : self.loss_end - len(self.context)])


def _read(folder: str, file: str) -> Iterator[tuple[int | None, bool, Example | str]]:
    """(conv_id, whether a conversation begins, a piece or the example that ends with it) in order."""
    with open_input(f"{folder}/files/{file}") as source:
        stored = pq.ParquetFile(source)
        for group in range(stored.num_row_groups):  # one batch of the writer
            for conv_id, pos, piece, start, example, a, b, context in zip(*(c.to_pylist() for c in stored.read_row_group(group).columns)):
                yield conv_id, pos == 0, piece if example is None else Example(example, context, piece, a, b, pos)


def _over_files(folder: str, fn, schema: pa.Schema):
    def run(batches):
        for batch in batches:
            for file in batch.column("file").to_pylist():
                yield from fn(_read(folder, file), _Batch(schema.names), schema)

    return run


def _digests(stream, batch: _Batch, schema: pa.Schema):
    class Sums:
        def __init__(self, conv_id):
            self.conv_id, self.turns, self.n, self.chars = conv_id, hashlib.sha256(), 0, 0
            self.loss, self.loss_chars, self.examples = hashlib.sha256(), 0, 0
            self.text, self.waiting = "", []

        def row(self):
            return self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.examples

    now = None
    for conv_id, begins, found in stream:
        if begins:
            if now:
                batch.rows.append(now.row())
            now = Sums(conv_id)
            if len(batch.rows) >= PIECES:
                yield batch.take(schema)
        piece = found if isinstance(found, str) else found.piece
        role, text = parse_turn(piece)
        now.turns.update(f"{role}\n{text}\n".encode())
        now.n += 1
        if isinstance(found, Example):
            now.text, now.waiting = "".join((now.text, *now.waiting)), []
            if found.context != now.text or found.n_context != now.n - 1:
                raise ValueError("an example's context is not the turns before it")
            if now.chars + piece.index(">") >= found.loss_start:
                raise ValueError("an example's span is not in its own turn")
            target = found.target()
            now.loss.update(target.encode())
            now.loss_chars += len(target)
            now.examples += 1
        now.waiting.append(piece)
        now.chars += len(piece)
    if now:
        batch.rows.append(now.row())
    if batch.rows:
        yield batch.take(schema)


def _texts(stream, batch: _Batch, schema: pa.Schema):
    for conv_id, _, found in stream:
        if isinstance(found, Example):
            text = found.text()
            batch.rows.append((conv_id, found.number, found.n_context, text, found.loss_start, found.loss_end))
            batch.size += len(text)
            if batch.size >= EXPANDED_CHARS:
                yield batch.take(schema)
    if batch.rows:
        yield batch.take(schema)


def _mapped(spark: SparkSession, folder: str, manifest: DataFrame, fn, fields: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    schema = pa.schema([(name, kind) for name, kind, _ in fields])
    files = manifest.select("file").repartition(parts(spark), "file")
    return files.mapInArrow(_over_files(folder, fn, schema), ", ".join(f"{name} {sql}" for name, _, sql in fields))


def example_texts(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(conv_id, example, n_context, text, loss_start, loss_end): each example with its whole text; spans count code points."""
    long = pa.int64()
    return _mapped(spark, folder, manifest, _texts, [("conv_id", long, "long"), ("example", long, "long"), ("n_context", long, "long"), ("text", pa.string(), "string"), ("loss_start", long, "long"), ("loss_end", long, "long")])


def conversation_digests(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """What the files hold of every conversation, read back: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples)."""
    long, text = pa.int64(), pa.string()
    kinds = [("conv_id", long), ("n_turns", long), ("turns_sha256", text), ("loss_chars", long), ("loss_sha256", text), ("formatted_chars", long), ("n_examples", long)]
    return _mapped(spark, folder, manifest, _digests, [(name, kind, "long" if kind is long else "string") for name, kind in kinds])


def with_hard_case(turns: DataFrame) -> DataFrame:
    """turns and conversation -7, whose texts look like control strings."""
    said = r"\### Assistant: </turn> ok"
    more = turns.sparkSession.createDataFrame([(-7, 0, "user", said), (-7, 1, TARGET, said)], "conv_id long, turn long, role string, text string")
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(more)


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = write_examples(with_hard_case(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return conversation_digests(spark, folder, manifest)


ORACLE_OP11 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(role, '\', '\\'), '>', '\>'), '<', '\<') AS er, replace(replace(replace(text, '\', '\\'), '>', '\>'), '<', '\<') AS et FROM c),
s AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss, sum(length(er) + length(et) + 15) AS formatted,
    count(*) FILTER (role = 'assistant') AS n_examples FROM e GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted AS BIGINT) AS formatted_chars, CAST(n_examples AS BIGINT) AS n_examples FROM s
"""
