"""Removal of every long byte string that occurs more than once, by suffix arrays over the text that can repeat."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagledger.llm.common import modest_batches, staged
from lagledger.llm.suffix_order import repeated_starts
from lagledger.session import broadcast_if_small

WIDTH = 200  # bytes that must repeat
GRAM = 64  # bytes of an anchor; a power of two
PIECE = 1 << 20  # windows of one text looked at together
RUN = 4_096  # windows of one block
TEXT = 1_500_000  # bytes of blocks ordered together
MOST = 1_000_000  # bytes of one anchor's blocks; the windows of a larger one are counted in Spark
MOST_SENT = 1_000_000  # rows of at most 48 bytes that may go to every executor; more are shuffled
EMPTY = hashlib.sha256(b"").hexdigest()
_A, _B, _C = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0xD6E8FEB86659FD93))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def gram_codes(text: np.ndarray, gram: int, factor: np.uint64 = _A) -> np.ndarray:
    """64-bit codes of all runs of ``gram`` bytes, each from the codes of its two halves."""
    codes, size = _mixed((text.astype(np.uint64) + np.uint64(1)) * factor), 1
    while size < gram:
        codes = _mixed(codes[:-size] * factor + codes[size:])
        size *= 2
    return codes


def sliding(x: np.ndarray, width: int, of: np.ufunc) -> np.ndarray:
    """``of`` (minimum or maximum) over all runs of ``width`` values."""
    size = 1
    while 2 * size <= width:
        x = of(x[:-size], x[size:])
        size *= 2
    return of(x[: len(x) - width + size], x[width - size :])


def window_codes(text: np.ndarray, width: int, gram: int, factor: np.uint64) -> np.ndarray:
    """Codes of all windows, from the codes of the runs that cover them."""
    grams = gram_codes(text, gram, factor)
    n = len(text) - width + 1
    out = np.zeros(n, np.uint64)
    for at in [*range(0, width - gram, gram), width - gram]:
        out = _mixed(out * factor + grams[at : at + n])
    return out


def anchors(text: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor code of each window, its least gram code, and the codes of all places that are an anchor."""
    grams = gram_codes(text, gram)
    inside = width - gram + 1
    least = sliding(grams, inside, np.minimum)
    edge = np.zeros(inside - 1, np.uint64)
    used = sliding(np.concatenate((edge, least, edge)), inside, np.maximum) == grams
    return least, grams[used]


def _pieces(text: bytes, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Parts of a text that hold PIECE windows each; every window lies in one part."""
    whole = np.frombuffer(text, np.uint8)
    for at in range(0, len(whole) - width + 1, PIECE):
        yield at, whole[at : at + PIECE + width - 1]


def _scan(batches: Iterator[pa.RecordBatch], width: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = part.column(1).to_pylist()
            found = [[anchors(piece, width, gram)[1] for _, piece in _pieces(t, width)] for t in texts]
            ends = np.cumsum([0] + [sum(map(len, f)) for f in found])
            codes = np.concatenate([c for f in found for c in f] or [np.zeros(0, np.uint64)])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(codes.view(np.int64)))],
                names=["id", "n", "digest", "anchors"],
            )


def _block_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["digest", "at", "anchor", "one", "two", "block"])


def _blocks(batches: Iterator[pa.RecordBatch], width: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Of texts with their repeated anchors: runs of windows with one such anchor, with all their bytes."""
    rows, held = [], 0
    for batch in batches:
        for digest, text, known in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            known = np.sort(np.array(known, np.int64).view(np.uint64))
            for begin, piece in _pieces(text, width):
                least = anchors(piece, width, gram)[0]
                place = np.searchsorted(known, least)
                place[place == len(known)] = 0
                start = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
                stop = np.append(start[1:], len(least))
                good = known[place[start]] == least[start]
                for a, b, code in zip(start[good].tolist(), stop[good].tolist(), least[start[good]].view(np.int64).tolist(), strict=True):
                    for x in range(a, b, RUN):
                        block = text[begin + x : begin + min(x + RUN, b) + width - 1]
                        key = xxhash.xxh3_128_intdigest(block)
                        one, two = (v - (v >> 63 << 64) for v in (key >> 64, key & 0xFFFFFFFFFFFFFFFF))
                        rows.append((digest, begin + x, code, one, two, block))
                        held += len(block)
                        if held > 4_000_000:
                            yield _block_rows(rows)
                            rows, held = [], 0
    if rows:
        yield _block_rows(rows)


def _runs(flags: np.ndarray) -> list[dict]:
    step = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return [{"a": a, "b": b} for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True)]


_SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _marked(rows: list[tuple], width: int) -> pa.RecordBatch:
    """Orders the suffixes of some blocks (one, two, copies, bytes), all blocks of their anchors, and marks repeated windows."""
    sizes = np.array([len(r[3]) for r in rows])
    begin = np.concatenate(([0], np.cumsum(sizes)))
    starts = np.ones(begin[-1], bool)
    for end in begin[1:]:
        starts[end - width + 1 : end] = False
    again = repeated_starts(np.frombuffer(b"".join(r[3] for r in rows), np.uint8), starts, width)
    out = []
    for (one, two, copies, block), a in zip(rows, begin[:-1], strict=True):
        n = len(block) - width + 1
        spans = [{"a": 0, "b": n}] if copies > 1 else _runs(again[a : a + n])
        if spans:
            out.append((one, two, spans))
    columns = zip(*out, strict=True) if out else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), _SPANS), strict=True)], names=["one", "two", "spans"])


def _ordered(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows come by anchor; texts are cut between anchors, at about TEXT bytes."""
    rows, held, own, own_held, now = [], 0, [], 0, None
    for batch in batches:
        for anchor, one, two, copies, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if anchor != now:
                if held and held + own_held > TEXT:
                    yield _marked(rows, width)
                    rows, held = [], 0
                rows.extend(own)
                held, own, own_held, now = held + own_held, [], 0, anchor
            own.append((one, two, copies, block))
            own_held += len(block)
    for part in ([rows, own] if held + own_held > TEXT else [rows + own]):
        if part:
            yield _marked(part, width)


def _exploded(batches: Iterator[pa.RecordBatch], width: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Every window of a block with two codes."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            rows = list(zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True))
            found = [[window_codes(np.frombuffer(r[3], np.uint8), width, gram, f).view(np.int64) for f in (_A, _C)] for r in rows]
            sizes = [len(f[0]) for f in found]
            columns = [np.repeat(np.array([r[k] for r in rows]), sizes) for k in range(3)]
            columns += [np.concatenate([np.arange(n) for n in sizes]), *(np.concatenate([f[k] for f in found]) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["one", "two", "copies", "start", "first", "second"])


def _cut(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Of texts with the ranges of starts to go: bytes removed, maximal runs, digest of what is left."""
    for batch in batches:
        out = []
        for digest, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ends = sorted((s["a"], s["b"] + width - 1) for s in spans)
            gone: list[list[int]] = []
            for a, b in ends:
                if gone and a <= gone[-1][1]:
                    gone[-1][1] = max(b, gone[-1][1])
                else:
                    gone.append([a, b])
            left, at = hashlib.sha256(), 0
            for a, b in gone:
                left.update(text[at:a])
                at = b
            left.update(text[at:])
            out.append((digest, sum(b - a for a, b in gone), left.hexdigest(), [{"a": a, "b": b} for a, b in gone]))
        kinds = [pa.binary(), pa.int64(), pa.string(), _SPANS]
        columns = zip(*out, strict=True) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["digest", "gone", "kept", "spans"])


def remove_repeated_bytes(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, most: int = MOST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, n_bytes, n_removed, n_spans, kept_sha256, removed (maximal runs [a, b) of bytes).

    Texts are UTF-8 bytes; a byte goes when it is covered by a string of ``width`` bytes that also starts anywhere else, in
    this text or another one. All occurrences go.

    1. Texts that several rows hold go whole where they are long enough; one of these rows takes part for the others.
    2. The anchor of a window of ``width`` bytes is the least code among its runs of ``gram`` bytes. Equal windows have
       equal anchors, so windows whose anchor has one place in the corpus are unique and leave. Spark counts the anchors,
       about one per 70 bytes.
    3. What is left are blocks: neighbouring windows with one anchor, with all their bytes. Equal blocks are one text with
       a count, combined before they are shuffled.
    4. Blocks are dealt by anchor, since windows of different anchors differ, so each task orders a part of the suffix
       array that no other task shares: triples of the sampled positions are sorted and named, names are ordered in the same
       way until they stand for ``width`` bytes, the remaining positions are merged in, and neighbours are compared byte
       by byte (:mod:`lagledger.llm.suffix_order`). About TEXT bytes are ordered at once.
    5. Anchors whose distinct blocks exceed ``most`` bytes are too large for one task. Their windows get codes of 128 bits
       and are counted in Spark instead: any number of them, over all tasks.
    6. Ranges of repeated starts return to their texts and merge into maximal runs.

    Edge cases: a null text is empty; texts below ``width`` bytes are never cut; rows are documents of their own, also
    those that repeat an id or have none, and equal texts get equal results; a text that repeats itself (such as one long
    run of a letter) goes; bytes are never decoded, so a cut may fall inside a character; other columns are ignored.
    Anchors of long texts are computed in parts of PIECE windows; the bytes of one document are held by a task at a time.
    """
    modest_batches(docs.sparkSession)
    low = F.lit(-(1 << 63))
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), low).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    scan = staged(base.mapInArrow(partial(_scan, width=width, gram=gram), "id long, n long, digest binary, anchors array<long>"), "anchors")
    copies = scan.filter(F.col("n") >= width).groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    copies = staged(copies.select("digest", "rep"), "copies")

    def first_rows(df: DataFrame) -> DataFrame:
        """Rows without a copy, and of equal texts those with the smallest id."""
        return df.join(broadcast_if_small(copies, MOST_SENT), "digest", "left").filter("rep IS NULL OR rep = id").drop("rep")

    key = F.xxhash64("digest").alias("doc")  # texts that share it only share their anchors
    places = first_rows(scan.filter(F.col("n") >= width)).select(key, F.explode("anchors").alias("anchor"))
    repeated = staged(places.groupBy("anchor").agg(F.count(F.lit(1)).alias("places")).filter("places > 1").select("anchor"), "repeated")
    known = staged(places.join(repeated, "anchor", "left_semi").groupBy("doc").agg(F.collect_set("anchor").alias("known")), "known")

    texts = base.filter(F.length("text") >= width).withColumn("digest", F.unhex(F.sha2("text", 256)))
    some = first_rows(texts.withColumn("doc", key).join(broadcast_if_small(known.select("doc"), 4 * MOST_SENT), "doc", "left_semi"))
    blocks = some.join(known, "doc").select("digest", "text", "known")
    schema = "digest binary, at long, anchor long, one long, two long, block binary"
    blocks = staged(blocks.mapInArrow(partial(_blocks, width=width, gram=gram), schema), "blocks")

    distinct = staged(blocks.groupBy("anchor", "one", "two", "block").agg(F.count(F.lit(1)).alias("copies")), "distinct")
    large = distinct.groupBy("anchor").agg(F.sum(F.length("block")).alias("bytes")).filter(F.col("bytes") > most).select("anchor")
    large = staged(large, "large")
    sent = broadcast_if_small(large, MOST_SENT)
    small = distinct.join(sent, "anchor", "left_anti").select("anchor", "one", "two", "copies", "block")
    marks = small.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(partial(_ordered, width=width), "one long, two long, spans array<struct<a:long,b:long>>")
    if not large.isEmpty():
        windows = distinct.join(sent, "anchor", "left_semi").select("one", "two", "copies", "block")
        windows = windows.mapInArrow(partial(_exploded, width=width, gram=gram), "one long, two long, copies long, start long, first long, second long")
        windows = staged(windows, "windows")
        again = staged(windows.groupBy("first", "second").agg(F.sum("copies").alias("places")).filter("places > 1").select("first", "second"), "again")
        span = F.struct(F.col("start").alias("a"), (F.col("start") + 1).alias("b"))
        marks = marks.unionByName(windows.join(again, ["first", "second"], "left_semi").groupBy("one", "two").agg(F.collect_list(span).alias("spans")))
    marks = staged(marks, "marks")

    moved = F.transform("spans", lambda s: F.struct((s["a"] + F.col("at")).alias("a"), (s["b"] + F.col("at")).alias("b")))
    starts = blocks.select("digest", "at", "one", "two").join(marks, ["one", "two"]).select("digest", moved.alias("spans"))
    starts = staged(starts.groupBy("digest").agg(F.flatten(F.collect_list("spans")).alias("spans")), "starts")
    cut = texts.join(broadcast_if_small(starts.select("digest"), MOST_SENT), "digest", "left_semi")
    cut = cut.join(broadcast_if_small(copies, MOST_SENT), "digest", "left_anti").join(starts, "digest").select("digest", "text", "spans")
    cut = cut.mapInArrow(partial(_cut, width=width), "digest binary, gone long, kept string, spans array<struct<a:long,b:long>>")

    out = scan.select("id", "n", "digest").join(copies, "digest", "left").join(cut, "digest", "left")
    none = F.array().cast("array<struct<a:long,b:long>>")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("n").alias("b")))
    copy = F.col("rep").isNotNull()
    return out.select(
        F.when(F.col("id") != low, F.col("id")).alias(id_col),
        F.col("n").alias("n_bytes"),
        F.when(copy, F.col("n")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce(F.size("spans"), F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(EMPTY)).otherwise(F.coalesce("kept", F.lower(F.hex("digest")))).alias("kept_sha256"),
        F.when(copy, whole).otherwise(F.coalesce("spans", none)).alias("removed"),
    )
