"""Language identification by n-gram Bloom filters that answer for all languages at once."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagledger.llm.common import HASH_BITS, cached, draw, lean, modest_batches, own_names, staged, text_of
from lagledger.session import broadcast_if_small

ORDERS = (3, 4)
FIT_ROWS = 2_000  # labelled documents per language that the filters are fitted on
GRAMS = 4_000  # most frequent n-grams per language and order
SLOT_BITS = 17
SEGMENT = 1 << 20  # characters handled at once; n-grams do not span its borders
UNKNOWN = "und"
LEAST_GRAMS = 40  # a text with as many n-grams, none of them known to any filter, is in no learned language
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PROBES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Per code point: its lower-case letter, or a space for all that is no letter."""
    table = np.full(sys.maxunicode + 1, 32, np.uint32)
    for c in range(sys.maxunicode + 1):
        if 0xD800 <= c < 0xE000:
            continue
        if (ch := chr(c)).isalpha():
            table[c] = ord(ch.lower()[0])
    return table


cached("letters", _letters.cache_clear)


def segments(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, letter) arrays of about SEGMENT characters: each text in lower case, every run of other characters one space."""
    rows: list[int] = []
    parts: list[str] = []
    held = 0

    def made() -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer("".join(f" {p} " for p in parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        row = np.repeat(np.array(rows, np.int64), [len(p) + 2 for p in parts])
        letter = _letters()[raw]
        twice = np.zeros(len(letter), bool)
        twice[1:] = (letter[1:] == 32) & (letter[:-1] == 32) & (row[1:] == row[:-1])
        return row[~twice], letter[~twice]

    for i, text in enumerate(texts):
        for at in range(0, len(text), SEGMENT):
            parts.append(text[at : at + SEGMENT])
            rows.append(i)
            held += len(parts[-1])
            if held >= SEGMENT:
                yield made()
                rows, parts, held = [], [], 0
    if parts:
        yield made()


def grams(row: np.ndarray, letter: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, 64-bit code) of each n-gram that has a letter."""
    n = len(letter) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    wide = letter.astype(np.uint64)
    code = wide[:n].copy()
    for k in range(1, order):
        code = code * _MIX + wide[k : n + k]
    inside = row[:n] == row[order - 1 :]
    return row[:n][inside], code[inside]


def _slots(code: np.ndarray, bits: int) -> list[np.ndarray]:
    folded = code ^ (code >> np.uint64(29))
    return [(folded * p) >> np.uint64(64 - bits) for p in _PROBES]


@dataclass(frozen=True)
class LanguageFilters:
    """``slots[order][word][slot]``: bit l of a word says that language 64 * word + l set this slot."""

    languages: tuple[str, ...]
    orders: tuple[int, ...]
    bits: int
    slots: dict[int, np.ndarray]
    false_rate: dict[int, np.ndarray]

    @staticmethod
    def build(languages: list[str], orders: tuple[int, ...], bits: int, members: dict[int, tuple[np.ndarray, np.ndarray]]) -> LanguageFilters:
        words = -(-max(1, len(languages)) // 64)
        slots, rates = {}, {}
        for order in orders:
            lang, code = members.get(order, (np.zeros(0, np.int64), np.zeros(0, np.uint64)))
            sliced = np.zeros((words, 1 << bits), np.uint64)
            for slot in _slots(code, bits):
                np.bitwise_or.at(sliced, (lang // 64, slot), np.uint64(1) << (lang % 64).astype(np.uint64))
            load = np.array([((sliced[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(languages))])
            slots[order], rates[order] = sliced, load ** len(_PROBES)
        return LanguageFilters(tuple(languages), orders, bits, slots, rates)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[int], list[float]]:
        """Language, score, number of n-grams and corrected hits of all languages per text.

        Per order, the slots of an n-gram are ANDed: the bits left are all the languages that may contain it. A
        language's hits h among n n-grams hold about (n - true) * f false ones at its filter's false positive rate f,
        so true = (h - n f) / (1 - f). The language with the largest sum over the orders wins (ties: the first name);
        the score is its part of all languages' sums.
        """
        count, many = len(texts), len(self.languages)
        hits = {o: np.zeros((many, count)) for o in self.orders}
        seen = {o: np.zeros(count) for o in self.orders}
        has = np.zeros(count, bool)
        for row, letter in segments(texts):
            has[row[letter != 32]] = True
            for o in self.orders:
                at, code = grams(row, letter, o)
                seen[o] += np.bincount(at, minlength=count)
                first, second = _slots(code, self.bits)
                for word, sliced in enumerate(self.slots[o]):
                    mask = sliced[first] & sliced[second]
                    for k in range(64 * word, min(many, 64 * word + 64)):
                        hits[o][k] += np.bincount(at[((mask >> np.uint64(k % 64)) & np.uint64(1)).astype(bool)], minlength=count)
        if not many:
            return [UNKNOWN] * count, [0.0] * count, [0] * count, [0.0] * count
        true = sum(np.clip((hits[o] - seen[o] * self.false_rate[o][:, None]) / (1 - np.minimum(self.false_rate[o], 0.99))[:, None], 0, None) for o in self.orders)
        best, total = true.argmax(0), true.sum(0)
        score = np.where(total > 0, true.max(0) / np.where(total > 0, total, 1), 1 / many)
        names = [self.languages[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)]
        return names, np.where(has, score, 0.0).tolist(), sum(seen.values()).astype(np.int64).tolist(), total.tolist()


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(
    labelled: DataFrame, orders: tuple[int, ...] = ORDERS, fit_rows: int = FIT_ROWS, n_grams: int = GRAMS, bits: int = SLOT_BITS,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> LanguageFilters:
    """Filters from at most ``fit_rows`` labelled rows per language (a seeded draw), each text whole.

    Only the chosen ids, at most ``fit_rows`` a language, go to the texts. A language with many rows is first cut at a draw
    that some 2 * ``fit_rows`` of them stay below, so that no task ranks all rows of a language. N-grams are counted in Spark and the
    ``n_grams`` most frequent of each language and order come back.
    """
    modest_batches(labelled.sparkSession)
    known = labelled.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    order = Window.partitionBy("lang").orderBy("draw", "id")
    ids = known.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), draw("fit", F.col(id_col)).alias("draw"))
    sizes = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    below = F.col("draw") < F.lit(float((2 * fit_rows + 100) << HASH_BITS)) / F.col("rows")
    ids = ids.join(broadcast_if_small(sizes), "lang").filter(below).drop("rows")
    ids = ids.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= fit_rows).select("id", "lang").distinct()
    texts = known.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), text_of(text_col).alias("text"))
    texts = texts.join(broadcast_if_small(ids), ["id", "lang"], "left_semi").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for row, letter in segments(batch.column(1).to_pylist()):
                for o in orders:
                    at, code = grams(row, letter, o)
                    names = langs[at] if len(at) else at
                    for lang in dict.fromkeys(names):
                        gram, n = np.unique(code[names == lang], return_counts=True)
                        yield pa.RecordBatch.from_pydict({
                            "lang": pa.array([lang] * len(gram), pa.string()), "ord": pa.array([o] * len(gram), pa.int32()),
                            "gram": gram.view(np.int64), "n": n.astype(np.int64),
                        })

    counts = texts.mapInArrow(lean(count, "letters"), "lang string, ord int, gram long, n long").groupBy("lang", "ord", "gram").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("lang", "ord").orderBy(F.desc("n"), "gram")
    best = counts.withColumn("r", F.row_number().over(top)).filter(F.col("r") <= n_grams).select("lang", "ord", "gram").toPandas()
    languages = sorted(set(best["lang"]))
    number = {name: k for k, name in enumerate(languages)}
    members = {}
    for o in orders:
        of = best[best["ord"] == o]
        members[o] = (of["lang"].map(number).to_numpy(np.int64), of["gram"].to_numpy(np.int64).view(np.uint64))
    return LanguageFilters.build(languages, orders, bits, members)


def predict_language(docs: DataFrame, filters: LanguageFilters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, lang_pred, score, n_grams, hits (corrected, of all languages).

    Edge cases: a null text, one without a letter, or filters fitted on nothing give ``und`` and score 0; letters that
    no filter knows give the first language and an even score; text of any length is read whole; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_grams", T.LongType()), T.StructField("hits", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                lang, score, n, hits = shared.value.predict(part.column(1).to_pylist())
                told = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(n, pa.int64()), pa.array(hits, pa.float64())]
                yield pa.RecordBatch.from_arrays([part.column(0), *told], names=schema.names)

    return docs.select(F.col(id_col), text_of(text_col).alias("text")).mapInArrow(lean(run, "letters"), schema)


def _labelled(docs: DataFrame, id_col: str, lang_col: str) -> DataFrame:
    return docs.filter(~held_out(F.col(id_col))) if lang_col in docs.columns else docs.limit(0).withColumn(lang_col, F.lit(None).cast("string"))


@own_names
def identify_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language can be told, with all their columns.

    Rejected are texts without a letter, and texts of LEAST_GRAMS n-grams or more that meet no filter once false positives
    are taken off. Shorter texts without a hit say too little and stay. The rejected ids go against the rows and the texts
    stay where they are. Rows that repeat an id share one fate: kept if one of them is. With no label to learn
    from, no row is rejected.
    """
    filters = fit(_labelled(docs, id_col, lang_col), id_col=id_col, text_col=text_col, lang_col=lang_col)
    if not filters.languages:
        return docs
    told = predict_language(docs, filters, id_col, text_col)
    known = (F.col("lang_pred") != UNKNOWN) & ((F.col("n_grams") < LEAST_GRAMS) | (F.col("hits") > 0))
    fate = told.groupBy(F.col(id_col).alias("__id")).agg(F.max(known).alias("__known")).filter("NOT __known").select("__id")
    return docs.join(broadcast_if_small(staged(fate, "rejected"), 4_000_000), docs[id_col].eqNullSafe(F.col("__id")), "left_anti")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fits on the labelled rows that are not held out and predicts all: ``id_col``, held_out, lang_pred, score."""
    filters = fit(_labelled(docs, id_col, lang_col), id_col=id_col, text_col=text_col, lang_col=lang_col)
    return predict_language(docs, filters, id_col, text_col).select(id_col, held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score")
