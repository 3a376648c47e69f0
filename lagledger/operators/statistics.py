"""Group comparisons on epoch values. Descriptive for one recording only."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import wraps
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lagledger.operators.labelings import share_of_labelings, tail_of_labelings
from lagledger.operators.quantiles import HOT_ROWS, quantiles
from lagledger.operators.scan import Slicing, given_keys, plain_keys, scan
from lagledger.session import cut_lineage

# One cell per group; a group above max_rows is cut at value quantiles.
BY_VALUE = Slicing(width=1e300)
EXACT_LABELINGS = 250_000
WHOLE_ROWS = 130  # whole numbers of 38 digits hold all labelings
EXACT_MEDIAN_ROWS = 10_000
RANKS = 64  # lower ranks per row of the pair table
DRAWS = 5_000  # draws per block of random numbers
RANK_BLOCK = 65_536  # ranks per row of work of the hash draws
BLOCKS = 32  # such rows per task
SPREAD = 6.0  # standard deviations from the middle of a bracket to its ends
MASK = 4294967295
MIDDLES = ["_c0", "_c1", "_k0", "_k1"]  # central ranks of the candidates and of the controls
# The cautions that every comparison carries.
CAUTIONS = (
    "Epochs, not phoneme tokens, are the comparison unit to reduce pseudoreplication.",
    "Speaker identity is confounded with each participant's device, network path, and Meet jitter buffer.",
    "The permutation p-value is exploratory because participant streams are not randomized or exchangeable.",
    "A difference can establish a stream-specific A/V anomaly, not its cause or the speaker's identity.",
)


def null_keys(compute: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A comparison by keys in which NULL is a key of its own."""

    @wraps(compute)
    def run(values: DataFrame, keys: Sequence[str], *args, **options) -> DataFrame:
        prefix = "_key"
        while any(c.startswith(prefix) for c in values.columns):
            prefix += "_"
        named, own = plain_keys(values, keys, prefix)
        out = compute(named, own, *args, **options)
        return out if own == list(keys) else out.select(*given_keys(keys, own, prefix), *[c for c in out.columns if c not in own])

    return run


def mix32(value: Column) -> Column:
    """Integer hash of a 32-bit value with plain BIGINT arithmetic (any SQL engine can repeat it)."""
    for _ in range(2):
        mixed = F.shiftright(value, 16).bitwiseXOR(value) * F.lit(73244475)
        value = mixed.bitwiseAND(F.lit(4294967295))
    return F.shiftright(value, 16).bitwiseXOR(value)


def draw(seed: int | Column, replicate: Column, slot: Column) -> Column:
    """32-bit draw for (seed, replicate, slot); independent of partitioning."""
    return _slot_draw(_stream(seed, replicate), slot)


def _stream(seed: int | Column, replicate: Column) -> Column:
    start = seed if isinstance(seed, Column) else F.lit(seed)
    return mix32((replicate.cast("long") * F.lit(31) + start).bitwiseAND(F.lit(MASK)))


def _slot_draw(stream: Column, slot: Column) -> Column:
    return mix32(stream.bitwiseXOR(mix32(slot.cast("long").bitwiseAND(F.lit(MASK)))))


def _replicates(sizes: DataFrame, iterations: int, seed: int | Column) -> DataFrame:
    """One row per group and replicate: the columns of ``sizes``, _b and _stream, the replicate's part of every hash."""
    b = F.explode(F.sequence(F.lit(0), F.lit(iterations - 1)))
    return sizes.withColumn("_b", b).withColumn("_stream", _stream(seed, F.col("_b")))


def _hashed(wanted: DataFrame, upto: Column) -> DataFrame:
    """One row per replicate and rank below ``upto``, with its draw ``_u``.

    Draws depend on ranks only, so no value travels: blocks of ranks are dealt out evenly, whatever the groups, and each
    task makes its ranks itself.
    """
    blocks = F.ceil(upto / F.lit(RANK_BLOCK))
    number, draws = (x or 0 for x in wanted.agg(F.sum(blocks), F.sum(upto)).first())
    # Blocks of small groups are far from full: their draws count, not their number.
    full = -(-int(draws) // (RANK_BLOCK * BLOCKS))
    tasks = min(-(-number // BLOCKS), max(2 * full, int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    first = F.col("_block") * F.lit(RANK_BLOCK)
    ranks = F.sequence(first, F.least(first + F.lit(RANK_BLOCK), upto) - F.lit(1))
    work = wanted.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - F.lit(1))))
    dealt = work.repartition(max(1, tasks)).withColumn("_rank", F.explode(ranks))
    return dealt.withColumn("_u", _slot_draw(F.col("_stream"), F.col("_rank")))


def _places(counts: DataFrame, by: list[str], places: dict[str, Column]) -> DataFrame:
    """The value at each place (from 0) of every ``by``, from counts ``_w`` per value ``_x``; NULL where it is not held.

    A NULL ``_x`` counts what lies below all others without naming it.
    """
    order = Window.partitionBy(*by).orderBy(F.asc_nulls_first("_x")).rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.withColumn("_upto", F.sum("_w").over(order))
    holds = lambda r: (F.col("_upto") > r) & (F.col("_upto") - F.col("_w") <= r)
    return upto.groupBy(*by).agg(*[F.max(F.when(holds(r), F.col("_x"))).alias(n) for n, r in places.items()])


def _in_brackets(wanted: DataFrame, by: list[str], find: Callable[[DataFrame], DataFrame], whole: dict[str, Column]) -> DataFrame:
    """``find(wanted)``; replicates whose bracket did not hold all places are found again with the ``whole`` range."""
    found = cut_lineage(find(wanted))
    found = found.dropna(subset=[c for c in found.columns if c not in by])
    missed = wanted.join(found.select(*by), by, "left_anti")
    return found if missed.isEmpty() else found.unionByName(find(missed.withColumns(whole)))


def _resampled_middles(sizes: DataFrame, by: list[str], iterations: int, seed: int | Column) -> DataFrame:
    """(by, _b, _lo, _hi): the middle ranks that each resample picks.

    A resample's middle pick lies near n / 2, at a standard deviation of sqrt(n) / 2 ranks: picks below a bracket are only
    counted, those inside are ordered, those above are dropped.
    """
    n, one = F.col("_n"), [*by, "_b"]
    half = F.sqrt(n) * F.lit(SPREAD / 2) + F.lit(2)
    pick = F.floor(F.col("_u") * n / F.lit(4294967296.0))

    def find(wanted: DataFrame) -> DataFrame:
        picks = _hashed(wanted, n).withColumn("_pick", pick).filter(F.col("_pick") <= F.col("_to"))
        named = F.when(F.col("_pick") >= F.col("_from"), F.col("_pick")).alias("_x")
        counts = picks.groupBy(*one, "_n", named).agg(F.count(F.lit(1)).alias("_w"))
        return _places(counts, [*one, "_n"], {"_lo": F.floor((n - 1) / 2), "_hi": F.ceil((n - 1) / 2)}).drop("_n")

    bracket = {"_from": F.floor(n / 2 - half), "_to": F.ceil(n / 2 + half)}
    return _in_brackets(_replicates(sizes, iterations, seed).withColumns(bracket), one, find, {"_from": F.lit(0).cast("long"), "_to": n})


def _hashed_labelings(sizes: DataFrame, keys: list[str], iterations: int, seed: int | Column) -> DataFrame:
    """(keys, _b, _c0, _c1, _k0, _k1): the middle ranks of both sides of each labeling.

    The k rows with the smallest draws are the candidates. The kth smallest draw is looked for in a bracket round
    k / n; knowing it, a rank tells its side by itself, and the middle ranks of each side are looked for round n / 2, in
    a bracket by the size of that side.
    """
    n, k, one = F.col("_n"), F.col("_k"), [*keys, "_b"]
    u, rank = F.col("_u"), F.col("_rank")
    first, last = F.col("_from"), F.col("_to")

    def cut(wanted: DataFrame) -> DataFrame:
        named = F.when(u >= first, F.struct("_u", "_rank")).alias("_x")
        counts = _hashed(wanted, n).filter(u <= last).groupBy(*one, "_n", "_k", "_stream", named).agg(F.count(F.lit(1)).alias("_w"))
        return _places(counts, [*one, "_n", "_k", "_stream"], {"_cut": k - 1})

    p = k / n
    half = (F.sqrt(p * (F.lit(1) - p) / n) * F.lit(SPREAD) + F.lit(SPREAD * SPREAD) / n) * F.lit(4294967296.0)
    middle = p * F.lit(4294967296.0)
    bracket = {"_from": F.floor(middle - half), "_to": F.ceil(middle + half)}
    drawn = _replicates(sizes.select(*keys, "_n", "_k"), iterations, seed).withColumns(bracket)
    cuts = _in_brackets(drawn, one, cut, {"_from": F.lit(0).cast("long"), "_to": F.lit(MASK)})

    def middles(wanted: DataFrame) -> DataFrame:
        mine = (u < F.col("_cut._u")) | ((u == F.col("_cut._u")) & (rank <= F.col("_cut._rank")))
        own = lambda c: F.when(F.col("_in"), F.col(f"_c{c}")).otherwise(F.col(f"_k{c}"))
        rows = _hashed(wanted, F.greatest("_c_to", "_k_to") + 1).withColumn("_in", mine)
        # What lies above a side's bracket is one count at n, which is no rank; a filter would make the draws twice.
        named = F.when(rank >= own("_from"), F.when(rank <= own("_to"), rank).otherwise(n)).alias("_x")
        counts = rows.groupBy(*one, "_n", "_k", "_in", named).agg(F.count(F.lit(1)).alias("_w"))
        m = F.when(F.col("_in"), k).otherwise(n - k)
        sides = _places(counts, [*one, "_n", "_k", "_in"], {"_lo": F.floor((m - 1) / 2), "_hi": F.floor(m / 2)})
        side = lambda c, own: F.max(F.when((F.col("_in") == F.lit(own)) & (F.col(c) < n), F.col(c)))
        return sides.groupBy(*one).agg(side("_lo", True).alias("_c0"), side("_hi", True).alias("_c1"), side("_lo", False).alias("_k0"), side("_hi", False).alias("_k1"))

    def round_middle(side: str, m: Column) -> dict[str, Column]:
        half = n * F.sqrt(F.lit(1) / m - F.lit(1) / n) * F.lit(SPREAD / 2) + F.lit(2)
        return {f"{side}_from": F.greatest(F.floor(n / 2 - half), F.lit(0)), f"{side}_to": F.least(F.ceil(n / 2 + half), n - 1)}

    ends = {f"{side}{c}": x for side in ("_c", "_k") for c, x in (("_from", F.lit(0).cast("long")), ("_to", n - 1))}
    return _in_brackets(cuts.withColumns(round_middle("_c", k) | round_middle("_k", n - k)), one, middles, ends)


def _central(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the lower and upper middle of n values, from 0."""
    return (n - 1) // 2, n // 2


def _middle_uniforms(rng: np.random.Generator, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two middle order statistics of n uniform numbers (the same number twice where n is odd)."""
    low, high = _central(n)
    first = rng.beta(low + 1, n - low)
    step = rng.random(len(n)) ** (1.0 / np.maximum(n - low - 1, 1))
    return first, np.where(high > low, 1.0 - (1.0 - first) * step, first)


def _others_below(rng: np.random.Generator, x: tuple[np.ndarray, np.ndarray], w: tuple[np.ndarray, np.ndarray], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many of n uniform numbers, with middle order statistics ``w``, lie below each of ``x`` (x[0] <= x[1])."""
    low, high = _central(n)
    share = lambda part, whole: np.clip(np.where(whole > 0, part / np.where(whole > 0, whole, 1.0), 0.0), 0.0, 1.0)
    a0, a1 = np.minimum(x[0], w[0]), np.minimum(x[1], w[0])
    below0 = rng.binomial(low, share(a0, w[0]))
    below1 = below0 + rng.binomial(low - below0, share(a1 - a0, w[0] - a0))
    rest = n - high - 1
    c0, c1 = np.maximum(x[0] - w[1], 0.0), np.maximum(x[1] - w[1], 0.0)
    above0 = rng.binomial(rest, share(c0, 1.0 - w[1]))
    above1 = above0 + rng.binomial(rest - above0, share(c1 - c0, 1.0 - w[1] - c0))
    middle = lambda v: (v > w[0]).astype(np.int64) + ((v > w[1]) & (high > low))
    return below0 + middle(x[0]) + above0, below1 + middle(x[1]) + above1


def _drawn(sizes: DataFrame, keys: list[str], iterations: int, seed: int | Column, ranks: Sequence[str], kernel) -> DataFrame:
    """(keys, _b, one column per rank): ``kernel(rng, size columns of each draw)`` in blocks of DRAWS draws.

    A resample's medians depend on its middle ranks only, and their distribution is known, so a draw costs a few random
    numbers however many rows there are. The generator of a block is seeded by (seed, key, block).
    """
    blocks = -(-iterations // DRAWS)
    start = seed if isinstance(seed, Column) else F.lit(seed)
    own = F.crc32(F.to_json(F.struct(F.lit(0).alias("_"), *keys), {"ignoreNullFields": "false"}).cast("binary"))
    names = [c for c in sizes.columns if c not in keys]
    work = sizes.withColumns({"_seed": start.cast("long"), "_own": own}).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in sizes.select(*keys).schema]
    schema = ", ".join([*fields, "_b long", *[f"`{r}` long" for r in ranks]])

    def run(frames):
        for frame in frames:
            for row in frame.itertuples(index=False):
                row = dict(zip(frame.columns, row))
                first = int(row["_block"]) * DRAWS
                many = min(DRAWS, iterations - first)
                rng = np.random.default_rng([abs(int(row["_seed"])), int(row["_own"]), int(row["_block"])])
                made = kernel(rng, *[np.full(many, int(row[c]), np.int64) for c in names])
                out = pd.DataFrame({"_b": first + np.arange(many), **dict(zip(ranks, made))})
                for c in keys:
                    out[c] = pd.Series([row[c]] * many, dtype=frame[c].dtype)
                yield out[[*keys, "_b", *ranks]]

    return work.repartition(*keys, "_block").mapInPandas(run, schema)


@null_keys
def cliffs_delta(values: DataFrame, keys: Sequence[str], group: str, value: str) -> DataFrame:
    """P(candidate > control) + ties/2, and 2p - 1, from cumulative counts of equal values.

    No pair is formed: for each distinct value the controls below it are a
    running sum.
    """
    steps = values.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count_if(F.col(group) == "candidate").alias("_c"), F.count_if(F.col(group) == "control").alias("_k")
    )
    upto = scan(steps, list(keys), value, BY_VALUE, running={"_below": F.col("_k")})
    score = F.col("_c") * (F.col("_below") - F.col("_k") + F.col("_k") / F.lit(2.0))
    table = upto.groupBy(*keys).agg(
        F.sum(score).alias("_s"), F.sum("_c").alias("_nc"), F.sum("_k").alias("_nk")
    )
    p = F.try_divide(F.col("_s"), F.col("_nc") * F.col("_nk"))
    return table.select(
        *keys, p.alias("probability_candidate_greater"), (F.lit(2.0) * p - F.lit(1.0)).alias("cliffs_delta")
    )


@null_keys
def bootstrap_median_difference(
    values: DataFrame, keys: Sequence[str], group: str, value: str, *, iterations: int, seed: int | Column, draws: str = "ranks"
) -> DataFrame:
    """Percentile interval of the resampled median difference and its share above zero.

    Values get a dense rank per group, and a resample's median needs only its
    two middle ranks. ``draws="ranks"`` draws those two directly, whatever the
    number of rows; ``"hash"`` draws every row of every resample from a hash
    that SQL can repeat: rows x iterations draws in tasks of equal size, of
    which only those near the middle are kept.
    """
    keys = list(keys)
    by = [*keys, group]
    known = values.filter(F.col(value).isNotNull()).select(*by, value)
    ranked = scan(known, by, value, BY_VALUE, index="_rank")
    sizes = known.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    if draws == "ranks":
        def kernel(rng, n):
            return [np.minimum((u * n).astype(np.int64), n - 1) for u in _middle_uniforms(rng, n)]

        middle = _drawn(sizes, by, iterations, seed, ["_lo", "_hi"], kernel)
    else:
        sizes = cut_lineage(sizes.filter(F.col(group).isin("candidate", "control")))
        middle = _resampled_middles(sizes, by, iterations, seed)
    return _bootstrap_interval(middle, ranked, keys, by, group, value, iterations)


def _bootstrap_interval(middle: DataFrame, ranked: DataFrame, keys: list[str], by: list[str], group: str, value: str, iterations: int) -> DataFrame:
    looked = middle.select(*by, "_b", F.explode(F.array("_lo", "_hi")).alias("_rank")).join(
        ranked, [*by, "_rank"]
    ).groupBy(*by, "_b").agg(F.avg(value).alias("_m"))
    pairs = looked.groupBy(*keys, "_b").agg(
        F.max(F.when(F.col(group) == "candidate", F.col("_m"))).alias("_c"),
        F.max(F.when(F.col(group) == "control", F.col("_m"))).alias("_k"),
    ).withColumn("_d", F.col("_c") - F.col("_k"))
    return quantiles(
        pairs.filter(F.col("_d").isNotNull()), keys, "_d", {"ci_low": 0.025, "ci_high": 0.975},
        extra=[F.avg((F.col("_d") > 0).cast("double")).alias("bootstrap_share_above_zero")],
        max_rows=None if iterations <= HOT_ROWS else HOT_ROWS,
    )


def _ranked_pool(values: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    pool = values.filter(F.col(value).isNotNull()).select(
        *keys, F.col(group).alias("_g"), F.col(value).cast("double").alias("_v")
    )
    # Which of two equal values gets the lower rank does not change any median.
    ranked = scan(pool, keys, "_v", BY_VALUE, index="_rank")
    sizes = quantiles(
        pool.withColumn("_cv", F.when(F.col("_g") == "candidate", F.col("_v"))), keys, "_cv", {"_mc": 0.5},
        extra=[F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_g") == "candidate").alias("_k")],
    ).join(
        quantiles(pool.filter(F.col("_g") == "control"), keys, "_v", {"_mk": 0.5}), keys
    ).withColumn("_observed", F.col("_mc") - F.col("_mk")).drop("_mc", "_mk")
    return ranked.join(sizes, keys)


@null_keys
def label_permutation(
    values: DataFrame, keys: Sequence[str], group: str, value: str, *, iterations: int, seed: int | Column, draws: str = "ranks"
) -> DataFrame:
    """One-sided label permutation share, (hits + 1) / (total + 1).

    All labelings when there are at most 250 000 of them (so a group has few
    rows), else ``iterations`` random ones. ``draws="ranks"`` draws the middle
    ranks of both sides of a labeling, whatever the number of rows; ``"hash"``
    takes the k rows with the smallest draws of a hash that SQL can repeat.
    """
    keys = list(keys)
    pool = cut_lineage(_ranked_pool(values, keys, group, value).filter((F.col("_k") > 0) & (F.col("_k") < F.col("_n"))))
    few = pool.filter(labelings(F.col("_n"), F.col("_k")) <= EXACT_LABELINGS)
    many = pool.filter(labelings(F.col("_n"), F.col("_k")) > EXACT_LABELINGS)

    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in pool.select(*keys).schema]
        + ["hits long", "total long"]
    )
    exact = few.groupBy(*keys).applyInPandas(_enumerate_labelings(keys), schema)

    if draws == "ranks":
        random = _random_labelings(many, keys, iterations, seed)
    else:
        sizes = cut_lineage(many.groupBy(*keys).agg(F.max("_n").alias("_n"), F.max("_k").alias("_k")))
        random = _labeling_hits(_hashed_labelings(sizes, keys, iterations, seed), many, keys)
    return exact.unionByName(random).withColumn("permutation_p", (F.col("hits") + 1) / (F.col("total") + 1))


def _random_labelings(pool: DataFrame, keys: list[str], iterations: int, seed: int | Column) -> DataFrame:
    """(keys, hits, total) over random labelings of a ranked pool."""
    sizes = pool.groupBy(*keys).agg(F.max("_n").alias("_n"), F.max("_k").alias("_k"))

    def kernel(rng, n, k):
        mine, theirs = _middle_uniforms(rng, k), _middle_uniforms(rng, n - k)
        a, b = _others_below(rng, mine, theirs, n - k), _others_below(rng, theirs, mine, k)
        return [r + c for r, c in zip((*_central(k), *_central(n - k)), (*a, *b))]

    return _labeling_hits(_drawn(sizes, keys, iterations, seed, MIDDLES, kernel), pool, keys)


def _labeling_hits(at: DataFrame, pool: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, hits, total) from the middle ranks of both sides of each labeling."""
    sides = F.array(*[F.struct(F.lit(r < "_d").alias("mine"), F.col(r).alias("_rank")) for r in MIDDLES])
    looked = at.select(*keys, "_b", F.explode(sides).alias("_side")).select(*keys, "_b", "_side.mine", "_side._rank").join(pool.select(*keys, "_rank", "_v", "_observed"), [*keys, "_rank"])
    stats = looked.groupBy(*keys, "_b").agg(
        (F.avg(F.when(F.col("mine"), F.col("_v"))) - F.avg(F.when(~F.col("mine"), F.col("_v")))).alias("_stat"), F.max("_observed").alias("_observed")
    )
    return stats.groupBy(*keys).agg(F.count_if(F.col("_stat") >= F.col("_observed") - F.lit(1e-12)).alias("hits"), F.count(F.lit(1)).alias("total"))


def labelings(n: Column, k: Column) -> Column:
    """C(n, k), stopped at one above the enumeration limit (DOUBLE)."""
    small = F.least(k, n - k)
    steps = F.when(small <= 40, F.sequence(F.lit(1), F.greatest(small, F.lit(1)).cast("int"))).otherwise(
        F.array(F.lit(0))
    )
    grow = F.aggregate(
        steps, F.lit(1.0),
        lambda acc, i: F.when(acc > EXACT_LABELINGS, acc).otherwise(F.round(acc * (n - small + i) / i)),
    )
    return F.when(small == 0, F.lit(1.0)).when(small > 40, F.lit(EXACT_LABELINGS + 1.0)).otherwise(grow)


def _enumerate_labelings(keys: list[str]):
    """Kernel for groups with at most 250 000 labelings."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import itertools

        import numpy as np

        pdf = pdf.sort_values("_rank")
        v = pdf["_v"].to_numpy()
        n, k, observed = len(v), int(pdf["_k"].iloc[0]), float(pdf["_observed"].iloc[0])
        hits = total = 0
        picks = itertools.combinations(range(n), k)
        size = max(1, 4_000_000 // n)
        while block := list(itertools.islice(picks, size)):
            chosen = np.zeros((len(block), n), dtype=bool)
            chosen[np.arange(len(block))[:, None], np.asarray(block)] = True
            inside = np.broadcast_to(v, chosen.shape)[chosen].reshape(len(block), k)
            outside = np.broadcast_to(v, chosen.shape)[~chosen].reshape(len(block), n - k)
            stat = np.median(inside, axis=1) - np.median(outside, axis=1)
            hits += int((stat >= observed - 1e-12).sum())
            total += len(block)
        return pdf[keys].head(1).assign(hits=hits, total=total)

    return run


@null_keys
def exact_median_permutation(
    values: DataFrame, keys: Sequence[str], group: str, value: str, *, iterations: int = 100_000, seed: int | Column = 1729,
    most_exact: int = EXACT_MEDIAN_ROWS,
) -> DataFrame:
    """Exact tail share of the median difference over all labelings (no +1).

    Labelings are counted by pairs of central ranks (:mod:`lagledger.operators.labelings`), not listed. Up to WHOLE_ROWS
    rows the counts are whole numbers, ``tail`` and ``total``. Larger groups give ``exact_p`` alone, to about ten digits:
    each group's ranks are dealt out in rows of RANKS ranks, every row's share is computed by its own task from logarithms
    of binomials, and the shares are summed. Groups above ``most_exact`` rows get ``iterations`` random labelings and
    ``method = 'sampled'``.
    """
    keys = list(keys)
    pool = _ranked_pool(values, keys, group, value).filter((F.col("_k") > 0) & (F.col("_k") < F.col("_n")))
    base = [f"`{f.name}` {f.dataType.simpleString()}" for f in pool.select(*keys).schema]
    whole = F.least(F.lit(WHOLE_ROWS), F.lit(most_exact))
    counted = pool.filter(F.col("_n") <= whole).groupBy(*keys).applyInPandas(_count_labelings(keys), ", ".join([*base, "tail string", "total string", "exact_p double"]))
    number = lambda c: F.col(c).cast("decimal(38,0)").alias(c)
    done = counted.select(*keys, number("tail"), number("total"), "exact_p", F.lit("exact").alias("method"))

    nothing = F.lit(None).cast("decimal(38,0)")
    larger = pool.filter((F.col("_n") > whole) & (F.col("_n") <= most_exact)).groupBy(*keys).agg(
        F.sort_array(F.collect_list("_v")).alias("_values"), F.max("_k").alias("_k"), F.max("_observed").alias("_observed")
    )
    pairs = larger.withColumn("_first", F.explode(F.sequence(F.lit(0), F.size("_values") - 1, F.lit(RANKS))))
    shares = pairs.repartition(*keys, "_first").mapInPandas(_rank_shares(keys), ", ".join([*base, "share double"]))
    summed = shares.groupBy(*keys).agg(F.least(F.sum("share"), F.lit(1.0)).alias("exact_p"))
    summed = summed.select(*keys, nothing.alias("tail"), nothing.alias("total"), "exact_p", F.lit("exact").alias("method"))

    sampled = _random_labelings(pool.filter(F.col("_n") > most_exact), keys, iterations, seed).select(
        *keys, F.col("hits").cast("decimal(38,0)").alias("tail"), F.col("total").cast("decimal(38,0)").alias("total"),
        (F.col("hits") / F.col("total")).alias("exact_p"), F.lit("sampled").alias("method"),
    )
    return done.unionByName(summed).unionByName(sampled)


def _rank_shares(keys: list[str]):
    def run(frames):
        for frame in frames:
            share = [
                share_of_labelings(np.asarray(v, np.float64), int(k), float(o), int(f), int(f) + RANKS)
                for v, k, o, f in zip(frame["_values"], frame["_k"], frame["_observed"], frame["_first"], strict=True)
            ]
            yield frame[keys].assign(share=share)

    return run


def _count_labelings(keys: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rank")
        n, k = len(pdf), int(pdf["_k"].iloc[0])
        tail, total = tail_of_labelings(pdf["_v"].tolist(), k, float(pdf["_observed"].iloc[0]))
        if total != comb(n, k):
            raise RuntimeError("labeling count does not add up")
        return pdf[keys].head(1).assign(tail=str(tail), total=str(total), exact_p=tail / total)

    return run


@F.pandas_udf(StringType())
def _binomial_text(n: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) else str(comb(int(a), int(b))) for a, b in zip(n, k)])


def binomial(n: Column, k: Column) -> Column:
    """Exact C(n, k) as a decimal text, whatever its size."""
    return _binomial_text(n.cast("long"), k.cast("long"))


@null_keys
def compare_groups(
    epochs: DataFrame,
    keys: Sequence[str],
    *,
    group: str = "grp",
    value: str = "median_lag_ms",
    margin_ms: float,
    fps: float = 24.0,
    iterations: int = 20_000,
    permutations: int = 100_000,
    seed: int | Column = 1729,
    draws: str = "ranks",
) -> DataFrame:
    """Medians, difference, effect size, interval and permutation share per key.

    A key with one group only keeps its counts and has NULL comparisons. The
    reported probability is the smaller of the pairwise and bootstrap ones. Every row carries the fixed cautions in one text.
    """
    keys = list(keys)
    sides = []
    for name in ("candidate", "control"):
        side = epochs.filter(F.col(group) == name)
        sides.append(
            quantiles(
                side, keys, value, {f"{name}_median_ms": 0.5},
                extra=[
                    F.count(value).alias(f"{name}_epoch_count"),
                    F.sum("event_count").alias(f"{name}_event_count"),
                    F.avg((F.col(value) > margin_ms).cast("double")).alias(f"{name}_fraction_over_margin"),
                ],
            )
        )
    table = sides[0].join(sides[1], keys, "full")
    difference = F.col("candidate_median_ms") - F.col("control_median_ms")
    both = difference.isNotNull()
    table = (
        table.join(cliffs_delta(epochs, keys, group, value), keys, "left")
        .join(
            bootstrap_median_difference(epochs, keys, group, value, iterations=iterations, seed=seed, draws=draws), keys, "left"
        )
        .join(
            label_permutation(epochs, keys, group, value, iterations=permutations, seed=seed + 1, draws=draws).select(
                *keys, "permutation_p"
            ),
            keys, "left",
        )
    )
    counts = [f"{s}_{c}_count" for s in ("candidate", "control") for c in ("epoch", "event")]
    return table.fillna(0, subset=counts).select(
        *keys, *counts, "candidate_median_ms", "control_median_ms",
        difference.alias("median_difference_ms"),
        (difference * F.lit(fps / 1000.0)).alias("median_difference_frames"),
        F.when(both, F.struct(F.col("ci_low").alias("lo"), F.col("ci_high").alias("hi"))).alias("bootstrap_ci95"),
        F.when(both, F.least("probability_candidate_greater", "bootstrap_share_above_zero")).alias(
            "probability_candidate_greater"
        ),
        F.when(both, F.col("cliffs_delta")).alias("cliffs_delta"),
        "permutation_p",
        F.when(both, F.col("candidate_fraction_over_margin")).alias("candidate_fraction_over_margin"),
        F.when(both, F.col("control_fraction_over_margin")).alias("control_fraction_over_margin"),
        F.lit(" | ".join(CAUTIONS)).alias("cautions"),
    )


@null_keys
def compare_metrics(
    epochs: DataFrame, keys: Sequence[str], metrics: Sequence[str], *, group: str = "grp", iterations: int = 20_000, seed: int | Column
) -> DataFrame:
    """Candidate minus control per key and metric, one grouped job for all metrics.

    Each metric is compared on its own; nothing combines metrics.
    """
    long = epochs.select(*keys, group, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        [*keys, group], list(metrics), "metric", "value"
    ).filter(F.col("value").isNotNull())
    by = [*keys, "metric"]
    medians = long.filter(F.col(group) == "candidate").transform(
        lambda d: quantiles(d, by, "value", {"candidate_median": 0.5}, extra=[F.count("value").alias("candidate_epochs")])
    ).join(
        quantiles(
            long.filter(F.col(group) == "control"), by, "value", {"control_median": 0.5},
            extra=[F.count("value").alias("control_epochs")],
        ),
        by, "full",
    )
    return (
        medians.withColumn("median_difference", F.col("candidate_median") - F.col("control_median"))
        .join(cliffs_delta(long, by, group, "value"), by, "left")
        .join(bootstrap_median_difference(long, by, group, "value", iterations=iterations, seed=seed), by, "left")
        .join(exact_median_permutation(long, by, group, "value", seed=seed), by, "left")
        .fillna(0, subset=["candidate_epochs", "control_epochs"])
    )
