"""Set-similarity self-join of documents on word shingles, filtered under several global orders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagledger.llm.common import lean, modest_batches, own_names, staged, text_of
from lagledger.llm.components import components
from lagledger.llm.word_codes import MULTIPLIER, owners, scatter, split, window_codes, word_codes
from lagledger.session import broadcast_if_small

WORDS = 3  # per shingle
PERCENT = 90  # 100 * intersection >= PERCENT * union
ORDERS = 2
BUCKETS = 1 << 18  # counters per order
MOST_COUNT = (1 << 24) - 1  # counts above it are one class of the order, sorted by hash
MOST_SENT = 4_000_000  # ids that may go to every executor; more are shuffled
_LOW = -(1 << 63)


def shingle_sets(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, code) of the distinct shingles of each text, sorted. Fewer words than ``width`` are one shingle."""
    words = [split(t, lower=True) for t in texts]
    codes, owner = word_codes(words), owners(words)
    grams = window_codes(codes, width)
    inside = owner[: len(grams)] == owner[width - 1 :]
    at, code = owner[: len(grams)][inside], grams[inside]
    sizes = np.array([len(w) for w in words], np.int64)
    for length in range(1, width):
        few = np.flatnonzero(sizes == length)
        if len(few):
            first = np.searchsorted(owner, few)
            short = codes[first].copy()
            for k in range(1, length):
                short = short * MULTIPLIER + codes[first + k]
            at, code = np.concatenate((at, few)), np.concatenate((code, scatter(short, length)))
        by_text = np.argsort(at, kind="stable")
        at, code = at[by_text], code[by_text]
    ends = np.searchsorted(at, np.arange(len(words) + 1)).tolist()
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        code[a:b].sort()
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (code[1:] != code[:-1])
    return at[new], code[new]


def _bucket(code: np.ndarray, order: int) -> np.ndarray:
    return (scatter(code, order) >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1)


def _counts(docs: DataFrame, width: int, orders: int) -> np.ndarray:
    """How many shingles of all documents fall into each bucket, a row per order: the global orders, rare first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((orders, BUCKETS), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                _, code = shingle_sets(batch.slice(at, 256).column(1).to_pylist(), width)
                for k in range(orders):
                    total[k] += np.bincount(_bucket(code, k), minlength=BUCKETS)
        flat = total.ravel()
        some = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(flat[some])], names=["bucket", "n"])

    rows = docs.mapInArrow(lean(run, "words"), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(orders * BUCKETS, np.int64)
    got = rows.toArrow()  # at most orders * BUCKETS numbers
    total[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return total.reshape(orders, BUCKETS)


def _profiles(docs: DataFrame, counts: np.ndarray, width: int, percent: int) -> DataFrame:
    """Per row: set size, digest of the set, and its first shingles under each global order."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    orders = len(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                many = part.num_rows
                at, code = shingle_sets(part.column(1).to_pylist(), width)
                ends = np.searchsorted(at, np.arange(many + 1))
                n = np.diff(ends)
                digests = [xxhash.xxh3_128_digest(code[a:b].tobytes()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                columns = [part.column(0), pa.array(n), pa.array(digests, pa.binary())]
                lengths = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
                bounds = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
                for k in range(orders):
                    # rare first, then by a hash of 40 bits, then by code (a stable sort of codes in their order)
                    key = np.minimum(shared.value[k][_bucket(code, k)], MOST_COUNT).astype(np.uint64) << np.uint64(40)
                    key |= scatter(code, orders + k) >> np.uint64(24)
                    first = np.zeros(int(bounds[-1]), np.uint64)
                    for d, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                        first[bounds[d] : bounds[d + 1]] = code[a:b][np.argsort(key[a:b], kind="stable")[: lengths[d]]]
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(first.view(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "digest", *[f"prefix{k}" for k in range(orders)]])

    return docs.mapInArrow(lean(run, "words"), "id long, n long, digest binary, " + ", ".join(f"prefix{k} array<long>" for k in range(orders)))


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                at, code = shingle_sets(part.column(1).to_pylist(), width)
                ends = np.searchsorted(at, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(code.view(np.int64)))], names=["id", "codes"])

    return docs.mapInArrow(lean(run, "words"), "id long, codes array<long>")


def _prefix(n: str, percent: int) -> str:
    """How many of n tokens the prefix has (SQL)."""
    return f"({n} - ({percent} * {n} + 99) div 100 + 1)"


def _overlap(a: str, b: str, percent: int) -> str:
    """How many tokens similar sets of sizes a and b share at least (SQL)."""
    return f"(({percent} * ({a} + {b}) + {99 + percent}) div {100 + percent})"


def _least_shared(a: str, b: str, percent: int) -> str:
    """How many tokens the prefixes of similar sets of sizes a and b share under any global order, at least (SQL).

    Similar sets share s = ceil(percent * (a + b) / (100 + percent)) tokens. Before the k-th shared token lie at most a - s
    others in one set and b - s in the other, so prefixes of a - s + k and b - s + k tokens hold k shared ones.
    """
    return f"(least({_prefix(a, percent)} - {a}, {_prefix(b, percent)} - {b}) + {_overlap(a, b, percent)})"


def _filtered(pairs: DataFrame, profiles: DataFrame, orders: list[int], percent: int) -> DataFrame:
    """Of candidate pairs (a, b), those whose prefixes share enough tokens under every one of the given orders."""
    if not orders:
        return pairs.select("a", "b")
    columns = [f"prefix{k}" for k in orders]
    left = profiles.select(F.col("id").alias("a"), F.col("n").alias("n_a"), *[F.col(c).alias(f"a_{c}") for c in columns])
    right = profiles.select(F.col("id").alias("b"), F.col("n").alias("n_b"), *[F.col(c).alias(f"b_{c}") for c in columns])
    both = pairs.select("a", "b").join(left, "a").join(right, "b").filter(_sizes_allow("n_a", "n_b", percent))
    for c in columns:
        both = both.filter(F.size(F.array_intersect(f"a_{c}", f"b_{c}")) >= F.expr(_least_shared("n_a", "n_b", percent)))
    return both.select("a", "b")


def _verified(pairs: DataFrame, base: DataFrame, width: int, percent: int, repeated: bool) -> DataFrame:
    """Pairs whose whole sets are similar enough. Sets are made again, from whole texts, for documents in a pair only."""
    ids = pairs.select(F.col("a").alias("id")).distinct().union(pairs.select("b").distinct()).distinct()
    sets = _sets(base.join(broadcast_if_small(ids, MOST_SENT), "id", "left_semi"), width)
    sets = staged(sets.dropDuplicates(["id"]) if repeated else sets, "sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("codes").alias("a_codes")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("codes").alias("b_codes")), "b"
    )
    shared = F.size(F.array_intersect("a_codes", "b_codes"))
    union = F.size("a_codes") + F.size("b_codes") - shared
    return both.filter(100 * shared.cast("long") >= percent * union.cast("long")).select("a", "b")


def _sizes_allow(a: str, b: str, percent: int) -> str:
    return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"


def near_copies(
    docs: DataFrame, width: int = WORDS, percent: int = PERCENT, orders: int = ORDERS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: ``id_col``, n_shingles, component_id (smallest id reachable by links).

    Words are lower-cased (A-Z); a set holds the distinct shingles of ``width`` words; two rows link when the Jaccard
    similarity of their sets is at least ``percent`` / 100.

    1. Shingles of all documents are counted in BUCKETS counters per order. Each order sorts by its own counter, rare
       first, then by its own hash.
    2. Rows with equal sets form a class (combined before the shuffle); its smallest id takes part from here on.
    3. Similar sets share a token among their first n - ceil(n * percent / 100) + 1 tokens under every order. Tokens of
       the first order that one class alone has are dropped. Within a token and a band of sizes each class meets the one
       with the most common tokens, and is paired with the one it meets most often; pairs whose prefixes share enough
       tokens under every order (:func:`_least_shared`) are verified on whole sets; links make components.
    4. All pairs of different components follow that share a token under the first order with enough of either set left
       behind it, and pass the same filters and check. Pairs inside one component cannot change a result and are never
       formed.

    So a group of n near copies costs about n pairs, and no link between different components is lost.

    Edge cases: a text without words has an empty set and no link; rows that repeat an id
    get one row each, and their texts, compared one by one, are links of one document; ids are whole numbers; a null id is left out of links with others but has its own row; other columns are ignored. Shingle codes
    have 64 bits: inside a pair of documents equal codes are taken for equal shingles.
    """
    modest_batches(docs.sparkSession)
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LOW)).alias("id"), text_of(text_col).alias("text"))
    profiles = staged(_profiles(base, _counts(base, width, orders), width, percent), "profiles")
    spans = profiles.filter(f"id != {_LOW}").groupBy("id").agg(F.min("digest").alias("low"), F.max("digest").alias("high"))
    if not spans.filter("low != high").isEmpty():
        return _linked_by_row(docs, id_col, text_col, width=width, percent=percent, orders=orders)
    classes = profiles.filter(f"n > 0 AND id != {_LOW}").groupBy("digest").agg(F.min("id").alias("class"))
    classes = staged(classes, "classes")
    others = profiles.select("id", "digest").join(classes, "digest").filter("id > class").select("id")
    heads = profiles.filter(f"n > 0 AND id != {_LOW}").join(broadcast_if_small(staged(others.distinct(), "copies"), MOST_SENT), "id", "left_anti")
    repeated = not heads.groupBy("id").count().filter("count > 1").isEmpty()
    heads = heads.dropDuplicates(["id"]) if repeated else heads

    # What is left of the set from a token on: the first shared token of a pair has at least the pair's overlap left.
    tokens = heads.select("id", "n", F.posexplode("prefix0").alias("place", "token")).withColumn("left", F.col("n") - F.col("place")).drop("place")
    common = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("token")
    common = staged(common, "common")  # a table of its own, so that AQE can split the join of a hot token
    shared = staged(tokens.join(common, "token", "left_semi"), "shared")
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(-np.log(percent / 100))).alias("band")
    banded = shared.select("id", "n", "token", band)
    # A text that others were copied from shares more of its prefix than they do: it makes the better centre.
    known = shared.groupBy("id").agg(F.count(F.lit(1)).alias("known"))
    centre = F.max(F.struct("known", (-F.col("id")).alias("id")))
    stars = banded.join(known, "id").groupBy("token", "band").agg(centre.alias("c"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    stars = stars.select("token", "band", (-F.col("c.id")).alias("a"))
    met = banded.join(stars, ["token", "band"]).filter("id != a").groupBy("id", "a").agg(F.count(F.lit(1)).alias("tokens"))
    pairs = met.groupBy("id").agg(F.max_by("a", F.struct("tokens", -F.col("a"))).alias("a")).select("a", F.col("id").alias("b"))
    first = staged(_verified(staged(_filtered(pairs, heads, list(range(orders)), percent), "stars"), base, width, percent, repeated), "links")

    roots = components(first)
    labelled = shared.join(roots, shared["id"] == roots["node"], "left").select("id", "n", "token", "left", F.coalesce("root", "id").alias("comp"))
    labelled = staged(labelled, "labelled")
    groups = labelled.groupBy("token", "comp").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("left").alias("left"))
    several = groups.groupBy("token").agg(F.count(F.lit(1)).alias("comps")).filter("comps > 1").select("token")
    groups = staged(groups.join(several, "token", "left_semi"), "groups")
    other = groups.select("token", F.col("comp").alias("comp_b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"), F.col("left").alias("left_b"))
    meet = groups.join(other, "token").filter(
        f"comp < comp_b AND 100 * high >= {percent} * low_b AND 100 * high_b >= {percent} * low AND least(left, left_b) >= {_overlap('low', 'low_b', percent)}"
    )
    meet = meet.select("token", "comp", "comp_b", "low_b")
    one = meet.join(labelled.withColumnRenamed("left", "left_a").withColumnRenamed("n", "n_a"), ["token", "comp"]).filter(f"left_a >= {_overlap('n_a', 'low_b', percent)}")
    one = one.select("token", "comp_b", F.col("id").alias("a"), "n_a", "left_a")
    two = labelled.select("token", F.col("comp").alias("comp_b"), F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("left").alias("left_b"))
    pairs = one.join(two, ["token", "comp_b"]).filter(f"{_sizes_allow('n_a', 'n_b', percent)} AND least(left_a, left_b) >= {_overlap('n_a', 'n_b', percent)}")
    pairs = pairs.select("a", "b").distinct()
    second = _verified(staged(_filtered(pairs, heads, list(range(orders)), percent), "between"), base, width, percent, repeated)

    roots = components(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(second))
    found = classes.join(roots, classes["class"] == roots["node"], "left").select("digest", F.coalesce("root", "class").alias("comp"))
    out = profiles.select("id", "n", "digest").join(found, "digest", "left")
    linked = F.col("n") > 0
    return out.select(
        F.when(F.col("id") != _LOW, F.col("id")).alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id") != _LOW, F.when(linked, F.col("comp")).otherwise(F.col("id"))).alias("component_id"),
    )


def _numbered(docs: DataFrame, id_col: str) -> DataFrame:
    """Numbers the rows, so that an id may have several texts. A null id has no number and so links nothing."""
    return staged(docs.withColumn("__row", F.when(F.col(id_col).isNotNull(), F.monotonically_increasing_id())), "numbered")


def _linked_by_row(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """:func:`near_copies` where ids have several texts: rows are compared, then components that share an id are one.

    A row without words is linked with nothing and so names its own id.
    """
    rows = _numbered(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "id")
    found = staged(near_copies(rows, id_col="__row", text_col="text", **options), "found")
    named = staged(found.join(rows.select("__row", "id"), "__row"), "named")
    words = named.filter("n_shingles > 0").select("id", "component_id").distinct()
    first = words.groupBy("id").agg(F.min("component_id").alias("a"))
    roots = components(words.join(first, "id").select("a", F.col("component_id").alias("b")))
    whole = named.join(roots, named["component_id"] == roots["node"], "left").withColumn("comp", F.coalesce("root", "component_id"))
    least = whole.filter("n_shingles > 0").groupBy("comp").agg(F.min("id").alias("least"))
    linked = whole.join(least, "comp", "left").select(F.col("id").alias(id_col), "n_shingles", F.coalesce("least", "id").alias("component_id"))
    nobody = F.lit(None).cast("long")
    return linked.unionByName(found.filter("__row IS NULL").select(nobody.alias(id_col), "n_shingles", nobody.alias("component_id")))


@own_names
def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are the smallest id of their component, with all their columns.

    Where ids repeat, each row is compared by its own text, and the smallest (id, digest of the text) of a component stays.
    """
    ids = docs.select(F.col(id_col).alias("__id"))
    if not ids.filter("__id IS NOT NULL").groupBy("__id").count().filter("count > 1").isEmpty():
        return _drop_by_row(docs, id_col, text_col, **options)
    gone = near_copies(docs, id_col=id_col, text_col=text_col, **options).filter(f"{id_col} != component_id").select(F.col(id_col).alias("__gone"))
    return docs.join(broadcast_if_small(staged(gone.distinct(), "gone"), MOST_SENT), docs[id_col] == F.col("__gone"), "left_anti")


def _drop_by_row(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    rows = _numbered(docs, id_col)
    found = near_copies(rows, id_col="__row", text_col=text_col, **options).filter("__row IS NOT NULL")
    names = rows.select("__row", F.struct(F.col(id_col).alias("id"), F.sha2(text_of(text_col), 256).alias("digest")).alias("__name"))
    named = staged(found.select("__row", "component_id").join(names, "__row"), "named")
    best = named.groupBy("component_id").agg(F.min("__name").alias("__best"))
    gone = named.join(best, "component_id").filter("__name != __best").select(F.col("__row").alias("__gone"))
    return rows.join(broadcast_if_small(staged(gone, "gone"), MOST_SENT), F.col("__row") == F.col("__gone"), "left_anti").drop("__row")
