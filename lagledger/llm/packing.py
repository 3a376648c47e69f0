"""Hierarchical multi-length packing of token streams."""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagledger.llm.common import lean, modest_batches, staged, text_of
from lagledger.llm.word_tokens import word_tokens

TIERS = (512, 1024, 2048, 4096)
STEP_TOKENS = 65_536
BLOCK_TOKENS = 2_000_000  # tokens held per task
GROUP = 256  # partitions whose last tokens are packed together

Piece = tuple[int, int, int]  # length, document in the block, start


def fill(pool: list[Piece], tiers: tuple[int, ...]) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Full sequences (context, pieces) and the pieces that fill none. ``pool`` is sorted by length and is used up.

    The longest piece opens a window of its tier; the gap takes the longest piece that fits, from its own or a shorter
    tier; where none fits, the shortest piece is cut to close the gap.
    """
    full: list[tuple[int, list[Piece]]] = []
    while pool:
        piece = pool.pop()
        context = next(t for t in tiers if t >= piece[0])
        taken, gap = [piece], context - piece[0]
        while gap and pool:
            at = bisect_right(pool, gap, key=lambda p: p[0])
            if at:
                taken.append(pool.pop(at - 1))
                gap -= taken[-1][0]
            else:
                length, doc, start = pool.pop(0)
                taken.append((gap, doc, start))
                insort(pool, (length - gap, doc, start + gap))
                gap = 0
        if gap:
            return full, taken
        full.append((context, taken))
    return full, []


def close(rest: list[Piece], tiers: tuple[int, ...]) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Cuts what filled no window into full windows of shorter tiers; less than the shortest tier is left."""
    full: list[tuple[int, list[Piece]]] = []
    for context in reversed(tiers):
        while sum(p[0] for p in rest) >= context:
            taken, need = [], context
            while need:
                length, doc, start = rest[0]
                part = min(length, need)
                taken.append((part, doc, start))
                rest = ([(length - part, doc, start + part)] if part < length else []) + rest[1:]
                need -= part
            full.append((context, taken))
    return full, rest


class _Packer:
    """Packs documents that come one after the other; holds about BLOCK_TOKENS of them."""

    def __init__(self, name: int, tiers: tuple[int, ...], step_tokens: int, id_type: pa.DataType, last: bool) -> None:
        self.name, self.tiers, self.step_tokens, self.last = name, tiers, step_tokens, last
        self.docs: list[tuple] = []  # id, first token here, ids, tokens of the document
        self.held = 0
        self.made = 0
        self.of_tier = dict.fromkeys(tiers, 0)
        self.schema = pa.schema([("id", id_type)] + [(n, pa.int64()) for n in ("start", "length", "crc", "tokens", "sequence", "offset", "context", "step")] + [("ids", pa.binary())])
        self.pool: list[Piece] = []

    def add(self, doc: object, first: int, ids: bytes, tokens: int) -> None:
        k, n, window = len(self.docs), len(ids) // 4, self.tiers[-1]
        self.docs.append((doc, first, ids, tokens))
        self.pool += [(min(window, n - s), k, s) for s in range(0, n, window)]
        self.held += n

    def rows(self, sequences: list[tuple[int, list[Piece]]], keep_ids: bool = False) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        per_tier = {t: max(1, self.step_tokens // t) for t in self.tiers}
        for context, pieces in sequences:
            tier = self.tiers.index(context)
            step = (self.name << 32) + (self.of_tier[context] // per_tier[context]) * len(self.tiers) + tier
            offset = 0
            for length, k, start in pieces:
                doc, first, ids, tokens = self.docs[k]
                part = ids[4 * start : 4 * (start + length)]
                out.append((doc, first + start, length, zlib.crc32(part), tokens, (self.name << 32) + self.made, offset, context, step, part if keep_ids else None))
                offset += length
            self.made += 1
            self.of_tier[context] += 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), self.schema, strict=True)], schema=self.schema)

    def flush(self, end: bool) -> Iterator[pa.RecordBatch]:
        self.pool.sort()
        full, rest = fill(self.pool, self.tiers)
        if end:
            more, rest = close(rest, self.tiers)
            full += more
        yield from self.rows(full)
        if end:
            # what is left goes to the next level, or is the padded last sequence
            yield from self.rows([(self.tiers[-1], rest)] if rest else [], not self.last)
            return
        keep = [self.docs[k] for _, k, _ in rest]
        self.docs = keep
        self.pool = [(n, i, s) for i, (n, _, s) in enumerate(rest)]
        self.held = sum(p[0] for p in rest)


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 2,
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = STEP_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: ``id_col``, start, length, ids_crc32, doc_tokens, sequence_id, offset, context, step_id.

    A document is its ids by the tokenizer file, then ``end_id``. It is cut into windows of the longest tier; the rest
    goes to the shortest tier that holds it. Every task packs its own documents (:func:`fill`) in blocks of
    BLOCK_TOKENS, so no text is shuffled; the last tokens of GROUP tasks, fewer than the shortest tier each, travel with
    their ids and are packed once more. All sequences are exactly full, but for one per GROUP tasks, which is padded.
    ``step_id`` numbers runs of sequences of one tier that hold ``step_tokens`` together, so every step costs the same.

    Edge cases: a null or empty text is its end id alone; no rows give none; rows that repeat an id are packed each;
    any length is taken; other columns are ignored.
    """
    modest_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    names = ("start", "length", "crc", "tokens", "sequence", "offset", "context", "step")
    schema = T.StructType([T.StructField("id", kind), *[T.StructField(n, T.LongType()) for n in names], T.StructField("ids", T.BinaryType())])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, encoder = None, word_tokens(tokenizer, end_id)
        for batch in batches:
            if packer is None:
                packer = _Packer(TaskContext.get().partitionId(), tiers, step_tokens, batch.schema.field(0).type, False)
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for doc, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                    packer.add(doc, 0, ids, len(ids) // 4)
                if packer.held >= BLOCK_TOKENS:
                    yield from packer.flush(False)
        if packer:
            yield from packer.flush(True)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, group = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["group"] != group:
                    if packer:
                        yield from packer.flush(True)
                    group = row["group"]
                    packer = _Packer((1 << 30) + group, tiers, step_tokens, batch.schema.field("id").type, True)
                packer.add(row["id"], row["start"], row["ids"], row["tokens"])
        if packer:
            yield from packer.flush(True)

    pieces = staged(docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(lean(first, "tokens"), schema), "pieces")
    group = F.expr(f"shiftright(sequence, 32) div {GROUP}").alias("group")
    rest = pieces.filter("ids IS NOT NULL").select(group, "id", "start", "ids", "tokens", "sequence", "offset")
    rest = rest.repartition("group").sortWithinPartitions("group", "sequence", "offset", "id", "start").mapInArrow(second, schema)
    return pieces.filter("ids IS NULL").unionByName(rest).select(
        F.col("id").alias(id_col), "start", "length", F.col("crc").alias("ids_crc32"), F.col("tokens").alias("doc_tokens"),
        F.col("sequence").alias("sequence_id"), "offset", "context", F.col("step").alias("step_id"),
    )
