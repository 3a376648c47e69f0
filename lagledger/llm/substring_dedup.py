"""Removal of passages whose words already occur earlier in the corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagledger.llm.common import staged, text_of
from lagledger.llm.word_codes import SECOND, owners, split, window_codes, word_codes
from lagledger.session import broadcast_if_small

WIDTH = 20  # words per window
GRAM = 8  # words per anchor
MOST_SENT = 4_000_000  # ids that may go to every executor; more are shuffled
_EMPTY = hashlib.sha256(b"").hexdigest()


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def window_anchors(codes: np.ndarray, owner: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of each window inside one text, place and code of its anchor: the leftmost smallest of its gram codes."""
    n = len(codes) - width + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    grams = window_codes(codes, gram)
    grams ^= grams >> np.uint64(31)
    best, place = grams[:n].copy(), np.arange(n)
    for k in range(1, width - gram + 1):
        less = grams[k : n + k] < best
        np.copyto(best, grams[k : n + k], where=less)
        place[less] = np.flatnonzero(less) + k
    starts = np.flatnonzero(owner[:n] == owner[width - 1 :])
    return starts, place[starts], best[starts]


def _scan(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """Per row: words, digest of all words, codes of its anchors (a code as often as it has places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                words = [split(t) for t in part.column(1).to_pylist()]
                owner = owners(words)
                starts, place, code = window_anchors(word_codes(words), owner, width, gram)
                place, first = np.unique(place, return_index=True)
                ends = np.searchsorted(owner[place], np.arange(len(words) + 1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array([_digest(w) for w in words]),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(code[first].view(np.int64)))],
                    names=["id", "n", "digest", "anchors"],
                )

    return docs.mapInArrow(run, "id long, n long, digest string, anchors array<long>")


def _windows(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """Of rows with the codes of their repeated anchors: windows that have one, and whether the document had it before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, known in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                codes = word_codes([split(text)])
                starts, _, code = window_anchors(codes, np.zeros(len(codes), np.int8), width, gram)
                starts = starts[np.isin(code, np.array(known, np.int64).view(np.uint64))]
                one, two = window_codes(codes, width)[starts], window_codes(codes, width, SECOND)[starts] >> np.uint64(32)
                order = np.lexsort((starts, two, one))
                same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
                again = np.zeros(len(starts), bool)
                again[order[1:][same]] = True
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(starts), doc)), pa.array(starts.astype(np.int64)), pa.array(one.view(np.int64)),
                     pa.array(two.astype(np.uint32).view(np.int32)), pa.array(again)],
                    names=["id", "start", "one", "two", "again"],
                )

    return docs.mapInArrow(run, "id long, start long, one long, two int, again boolean")


def _cut(docs: DataFrame, width: int) -> DataFrame:
    """Of rows with the starts of windows to go: digest of all words, intervals removed, and what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, starts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = split(text)
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, np.array(starts, np.int64), 1)
                np.add.at(edge, np.array(starts, np.int64) + width, -1)
                gone = np.concatenate(([0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]))
                step = np.diff(gone)
                spans = [{"start": a, "end": b} for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True)]
                kept, at = [], 0
                for span in spans:
                    kept += words[at : span["start"]]
                    at = span["end"]
                kept += words[at:]
                out.append((doc, _digest(words), len(words) - len(kept), _digest(kept), spans))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            names = ["id", "digest", "removed", "kept", "spans"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], names=names)

    return docs.mapInArrow(run, "id long, digest string, removed long, kept string, spans array<struct<start:long,end:long>>")


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, n_words, n_removed, kept_sha256, removed (maximal word intervals, end exclusive).

    A word goes when a window of ``width`` words covers it whose words also start earlier: in a row with a smaller id, or
    earlier in the same row.

    1. Rows with the words of an earlier row go whole (when they hold a window) and take no further part.
    2. Every window has an anchor, the smallest code among its ``gram``-word grams. Equal windows have equal anchors, so
       Spark counts anchors, about one per seven words, and only windows whose anchor has several places can repeat.
    3. Those windows get a Rabin-Karp code of 64 and one of 32 bits and are counted in Spark; each one's first document
       stays. Counts and joins are by code, so a passage in a third of all rows is combined before it is shuffled and
       its join is split by AQE.
    4. The windows to go, gathered per document, merge into maximal intervals.

    Edge cases: a null text has no words; fewer than ``width`` words are never cut; rows that repeat an id count as one
    document, so they do not cut each other; a null id comes before all others; other columns are ignored. Texts are
    split, never cut short. Equal codes of 96 bits are taken for equal windows.
    """
    low = F.lit(-(1 << 63))
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), low).alias("id"), text_of(text_col).alias("text"))
    scan = staged(_scan(base, width, gram), "anchors")

    firsts = scan.filter(F.col("n") >= width).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    copies = scan.select("id", "digest").join(firsts, "digest").filter("id > first").select("id", "digest").distinct()
    copies = staged(copies, "copies")
    rest = scan.join(broadcast_if_small(copies, MOST_SENT), ["id", "digest"], "left_anti")

    anchors = rest.select("id", "digest", F.explode("anchors").alias("anchor"))
    repeated = anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("places")).filter("places > 1").select("anchor")
    repeated = staged(repeated, "repeated")  # a table of its own, so that AQE can split the join of a hot anchor
    found = anchors.select("id", "anchor").join(repeated, "anchor", "left_semi").groupBy("id").agg(F.collect_set("anchor").alias("known"))
    found = staged(found, "found")
    texts = base.join(broadcast_if_small(found.select("id"), MOST_SENT), "id", "left_semi").join(found, "id").select("id", "text", "known")
    windows = staged(_windows(texts, width, gram), "windows")

    once = windows.filter("NOT again")
    earliest = once.groupBy("one", "two").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    later = once.join(staged(earliest, "earliest"), ["one", "two"]).filter("id > first").select("id", "start")
    starts = later.unionByName(windows.filter("again").select("id", "start")).groupBy("id").agg(F.collect_set("start").alias("starts"))
    starts = staged(starts, "starts")
    cut = base.join(broadcast_if_small(starts.select("id"), MOST_SENT), "id", "left_semi").join(starts, "id").select("id", "text", "starts")
    cut = _cut(cut, width).dropDuplicates(["id", "digest"])

    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n").alias("end")))
    out = scan.select("id", "n", "digest").join(cut, ["id", "digest"], "left").join(copies.withColumn("copy", F.lit(True)), ["id", "digest"], "left")
    none = F.array().cast("array<struct<start:long,end:long>>")
    return out.select(
        F.when(F.col("id") != low, F.col("id")).alias(id_col),
        F.col("n").alias("n_words"),
        F.when(F.col("copy"), F.col("n")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.lit(_EMPTY)).otherwise(F.coalesce("kept", "digest")).alias("kept_sha256"),
        F.when(F.col("copy"), whole).otherwise(F.coalesce("spans", none)).alias("removed"),
    )
