"""Bootstrap, permutation and stratum queries on epoch values."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagledger.functions.numeric import lag_ms, r6
from lagledger.operators import statistics as st
from lagledger.operators.epochs import epoch_summary, in_strata
from lagledger.operators.nearest import nearest_join
from lagledger.operators.quantiles import quantiles
from lagledger.plans.catalogue import Catalogue
from lagledger.plans.standins import CLIPS_SQL, DAILY, E_SQL, GROUP_SQL, HOUR_US, VIEW_SQL, WEEK_US, clips, group_of, stream
from lagledger.plans.synchrony import LEDGER_SQL, LIMIT_US, MARGIN_MS, epochs_of
from lagledger.session import cut_lineage

cat = Catalogue()
CAUTIONS_SQL = "'" + " | ".join(st.CAUTIONS).replace("'", "''") + "'"
B = 200  # of the queries that SQL repeats draw by draw; the full ones take the published numbers
ALL = ["stratum"]
MASK = 4294967295


def mix_sql(x: str) -> str:
    for _ in range(2):
        x = f"(xor(({x}) >> 16, ({x})) * 73244475 & {MASK})"
    return f"xor(({x}) >> 16, ({x}))"


def draw_sql(seed: int, b: str, slot: str) -> str:
    return f"SELECT *, {mix_sql('z')} AS d FROM (SELECT *, xor({mix_sql('y')}, {mix_sql('w')}) AS z FROM (SELECT *, ({b} * 31 + {seed}) & {MASK} AS y, ({slot}) & {MASK} AS w FROM {{src}}))"


def all_epochs(spark, folder):
    return cut_lineage(epochs_of(spark, folder).withColumn("stratum", F.lit("all")))


BOOT_SQL = f"""bs AS (SELECT unnest(range({B})) AS b), rk AS (SELECT grp, median_lag_ms AS v, row_number() OVER (PARTITION BY grp ORDER BY median_lag_ms) - 1 AS r, count(*) OVER (PARTITION BY grp) AS n FROM mid),
dr AS ({draw_sql(1729, 'b', 'r').format(src='(SELECT * FROM rk CROSS JOIN bs)')}), pk AS (SELECT grp, b, floor(d * n / 4294967296.0)::BIGINT AS p FROM dr),
bm AS (SELECT pk.grp, b, median(v) AS m FROM pk JOIN rk ON rk.grp = pk.grp AND rk.r = pk.p GROUP BY ALL), bd AS (SELECT b, max(m) FILTER (grp = 'candidate') - max(m) FILTER (grp = 'control') AS d FROM bm GROUP BY 1)"""


@cat.query(
    "q2_bootstrap_median_diff",
    f"WITH {LEDGER_SQL}, {BOOT_SQL} SELECT round(quantile_cont(d, 0.025), 3) AS ci_low, round(quantile_cont(d, 0.975), 3) AS ci_high, round(avg((d > 0)::INT), 6) AS share_above_zero FROM bd",
)
def bootstrap(spark, folder):
    b = st.bootstrap_median_difference(all_epochs(spark, folder), ALL, "grp", "median_lag_ms", iterations=B, seed=1729, draws="hash")
    return b.select(F.round("ci_low", 3).alias("ci_low"), F.round("ci_high", 3).alias("ci_high"), r6("bootstrap_share_above_zero").alias("share_above_zero"))


@cat.query("q2_bootstrap_full")
def bootstrap_full(spark, folder):
    return st.bootstrap_median_difference(all_epochs(spark, folder), ALL, "grp", "median_lag_ms", iterations=20_000, seed=1729)


@cat.query("q3_permutation_full")
def permutation_full(spark, folder):
    return st.label_permutation(all_epochs(spark, folder), ALL, "grp", "median_lag_ms", iterations=100_000, seed=1730)


@cat.query("q5_compare_groups_full")
def compared_full(spark, folder):
    return st.compare_groups(all_epochs(spark, folder), ALL, margin_ms=MARGIN_MS, seed=1729)


@cat.query("q4_sampled_median_permutation")
def sampled(spark, folder):
    """One group of all epochs, labelings drawn."""
    return st.exact_median_permutation(all_epochs(spark, folder), ALL, "grp", "median_lag_ms", seed=1729, most_exact=0)


@cat.query("q4_exact_of_all_epochs")
def exact_of_all(spark, folder):
    """One group of all epochs, labelings counted by pairs of central ranks."""
    return st.exact_median_permutation(all_epochs(spark, folder), ALL, "grp", "median_lag_ms", seed=1729)


PERM_SQL = f"""pb AS (SELECT unnest(range({B})) AS b), pr AS (SELECT median_lag_ms AS v, row_number() OVER (ORDER BY median_lag_ms) - 1 AS r, (SELECT count(*) FROM mid WHERE grp = 'candidate') AS k FROM mid),
pd AS ({draw_sql(1730, 'b', 'r').format(src='(SELECT * FROM pr CROSS JOIN pb)')}), pc AS (SELECT b, v, row_number() OVER (PARTITION BY b ORDER BY d, r) <= k AS i FROM pd),
ps AS (SELECT b, median(v) FILTER (i) - median(v) FILTER (NOT i) AS s FROM pc GROUP BY 1), po AS (SELECT median(median_lag_ms) FILTER (grp = 'candidate') - median(median_lag_ms) FILTER (grp = 'control') AS o FROM mid)"""


@cat.query(
    "q3_label_permutation",
    f"WITH {LEDGER_SQL}, {PERM_SQL} SELECT count(*) FILTER (s >= o - 1e-12) AS hits, count(*) AS total, round((count(*) FILTER (s >= o - 1e-12) + 1) / (count(*) + 1), 6) AS permutation_p FROM ps, po",
)
def permutation(spark, folder):
    p = st.label_permutation(all_epochs(spark, folder), ALL, "grp", "median_lag_ms", iterations=B, seed=1730, draws="hash")
    return p.select("hits", "total", r6("permutation_p").alias("permutation_p"))


# Five weeks of two groups: few epochs, so all labelings can be listed in SQL.
WEEK_SQL = f"""ev AS ({E_SQL}), wk AS (SELECT event_type AS stratum, {GROUP_SQL} AS grp, t // {WEEK_US} AS w, median(value) AS median_value, avg(value) AS mean_value FROM ev GROUP BY ALL)"""
ENUM_SQL = """ix AS (SELECT {key} AS key, v, grp, row_number() OVER (PARTITION BY {key} ORDER BY v) - 1 AS r, count(*) OVER (PARTITION BY {key}) AS n, count(*) FILTER (grp = 'candidate') OVER (PARTITION BY {key}) AS k FROM {src}),
ob AS (SELECT key, median(v) FILTER (grp = 'candidate') - median(v) FILTER (grp = 'control') AS o FROM ix GROUP BY 1),
ms AS (SELECT DISTINCT key, k, unnest(range((2 ** n)::BIGINT)) AS m FROM ix), lb AS (SELECT ix.key, m, median(v) FILTER ((m >> r) & 1 = 1) - median(v) FILTER ((m >> r) & 1 = 0) AS s FROM ix JOIN ms ON ms.key = ix.key WHERE bit_count(m) = ms.k GROUP BY ALL),
ex AS (SELECT lb.key, count(*) FILTER (s >= o - 1e-12 * greatest(1, abs(o))) AS tail, count(*) AS total, count(*) FILTER (s >= o - 1e-12) AS hits FROM lb JOIN ob ON ob.key = lb.key GROUP BY 1)"""


def weekly(spark, folder):
    w = stream(spark, folder).withColumn("grp", group_of()).withColumn("w", F.floor(F.col("t") / WEEK_US))
    return cut_lineage(
        quantiles(
            w.select(F.col("event_type").alias("stratum"), "grp", "w", "value"), ["stratum", "grp", "w"], "value", {"median_value": 0.5},
            extra=[F.avg("value").alias("mean_value")],
        )
    )


@cat.query(
    "q3_all_labelings",
    f"WITH {WEEK_SQL}, sv AS (SELECT stratum, grp, median_value AS v FROM wk), {ENUM_SQL.format(key='stratum', src='sv')} SELECT key AS stratum, hits, total, round((hits + 1) / (total + 1), 6) AS permutation_p FROM ex",
)
def listed(spark, folder):
    p = st.label_permutation(weekly(spark, folder), ALL, "grp", "median_value", iterations=B, seed=1)
    return p.select("stratum", "hits", "total", r6("permutation_p").alias("permutation_p"))


@cat.query(
    "q4_exact_median_permutation",
    f"WITH {WEEK_SQL}, sv AS (SELECT stratum, grp, median_value AS v FROM wk), {ENUM_SQL.format(key='stratum', src='sv')} SELECT key AS stratum, tail, total, round(tail / total, 6) AS exact_p, 'exact' AS method FROM ex",
)
def exact(spark, folder):
    p = st.exact_median_permutation(weekly(spark, folder), ALL, "grp", "median_value")
    return p.select("stratum", F.col("tail").cast("long").alias("tail"), F.col("total").cast("long").alias("total"), r6("exact_p").alias("exact_p"), "method")


@cat.query(
    "q5_compare_groups",
    f"""WITH {LEDGER_SQL}, {BOOT_SQL}, {PERM_SQL}, g AS (SELECT count(*) FILTER (grp = 'candidate') AS cn, count(*) FILTER (grp = 'control') AS kn, sum(event_count) FILTER (grp = 'candidate') AS ce,
 median(median_lag_ms) FILTER (grp = 'candidate') AS cm, median(median_lag_ms) FILTER (grp = 'control') AS km, avg((median_lag_ms > {MARGIN_MS})::INT) FILTER (grp = 'candidate') AS cf FROM mid),
pw AS (SELECT avg(CASE WHEN a.median_lag_ms > b.median_lag_ms THEN 1.0 WHEN a.median_lag_ms = b.median_lag_ms THEN 0.5 ELSE 0.0 END) AS p FROM mid a JOIN mid b ON a.grp = 'candidate' AND b.grp = 'control')
SELECT cn AS candidate_epoch_count, kn AS control_epoch_count, ce::BIGINT AS candidate_event_count, round(cm, 3) AS candidate_median_ms, round(cm - km, 3) AS median_difference_ms, round((cm - km) * 24 / 1000, 3) AS median_difference_frames,
 round((SELECT quantile_cont(d, 0.025) FROM bd), 3) AS ci_low, round(least(p, (SELECT avg((d > 0)::INT) FROM bd)), 6) AS probability, round(2 * p - 1, 6) AS cliffs_delta, round(cf, 6) AS candidate_fraction_over_margin,
 round((SELECT (count(*) FILTER (s >= o - 1e-12) + 1) / (count(*) + 1) FROM ps, po), 6) AS permutation_p, {CAUTIONS_SQL} AS cautions FROM g, pw""",
)
def compared(spark, folder):
    c = st.compare_groups(all_epochs(spark, folder), ALL, margin_ms=MARGIN_MS, iterations=B, permutations=B, seed=1729, draws="hash")
    k = lambda n: F.round(n, 3)
    return c.select(
        "candidate_epoch_count", "control_epoch_count", "candidate_event_count", k("candidate_median_ms").alias("candidate_median_ms"),
        k("median_difference_ms").alias("median_difference_ms"), k("median_difference_frames").alias("median_difference_frames"),
        k("bootstrap_ci95.lo").alias("ci_low"), r6("probability_candidate_greater").alias("probability"), r6("cliffs_delta").alias("cliffs_delta"),
        r6("candidate_fraction_over_margin").alias("candidate_fraction_over_margin"), r6("permutation_p").alias("permutation_p"), "cautions",
    )


@cat.query(
    "q6_compare_metrics",
    f"""WITH {WEEK_SQL}, sv AS (SELECT stratum || '/median_value' AS sm, grp, median_value AS v FROM wk UNION ALL SELECT stratum || '/mean_value', grp, mean_value FROM wk), {ENUM_SQL.format(key='sm', src='sv')},
cd AS (SELECT a.sm, 2 * avg(CASE WHEN a.v > b.v THEN 1.0 WHEN a.v = b.v THEN 0.5 ELSE 0.0 END) - 1 AS delta FROM sv a JOIN sv b ON a.sm = b.sm AND a.grp = 'candidate' AND b.grp = 'control' GROUP BY 1)
SELECT split_part(ex.key, '/', 1) AS stratum, split_part(ex.key, '/', 2) AS metric, round(o, 6) AS median_difference, round(delta, 6) AS cliffs_delta, round(tail / total, 6) AS exact_p FROM ex JOIN ob ON ob.key = ex.key JOIN cd ON cd.sm = ex.key""",
)
def metrics(spark, folder):
    m = st.compare_metrics(weekly(spark, folder), ALL, ["median_value", "mean_value"], seed=7)
    return m.select("stratum", "metric", r6("median_difference").alias("median_difference"), r6("cliffs_delta").alias("cliffs_delta"), r6("exact_p").alias("exact_p"))


STRATA = {"primary": ["click"], "secondary": ["purchase"], "pooled": ["click", "purchase"]}
STRATA_SQL = f"""c AS ({E_SQL} WHERE event_type IN ('click', 'purchase')), v AS ({VIEW_SQL}),
m AS (SELECT c.*, v.t AS vt, row_number() OVER (PARTITION BY c.event_id ORDER BY abs(v.t - c.t), v.t, v.event_id) AS rn FROM c JOIN v USING (user_id)),
l AS (SELECT user_id, event_type, {GROUP_SQL} AS grp, t // {WEEK_US} AS w, (vt - t) / 1000 AS lag FROM m WHERE rn = 1 AND abs(vt - t) <= {LIMIT_US}),
s AS (SELECT *, CASE event_type WHEN 'click' THEN 'primary' ELSE 'secondary' END AS stratum FROM l UNION ALL SELECT *, 'pooled' FROM l),
ep AS (SELECT stratum, user_id, grp, w, median(lag) AS m, count(*) AS n FROM s GROUP BY ALL),
dl AS (SELECT a.stratum, 2 * avg(CASE WHEN a.m > b.m THEN 1.0 WHEN a.m = b.m THEN 0.5 ELSE 0.0 END) - 1 AS delta FROM ep a JOIN ep b ON a.stratum = b.stratum AND a.grp = 'candidate' AND b.grp = 'control' GROUP BY 1)"""


@cat.query(
    "q7_run_strata",
    f"""WITH {STRATA_SQL} SELECT stratum, count(*) FILTER (grp = 'candidate') AS candidate_epochs, count(*) FILTER (grp = 'control') AS control_epochs, sum(n)::BIGINT AS events,
 round(median(m) FILTER (grp = 'candidate') - median(m) FILTER (grp = 'control'), 3) AS median_difference_ms, round(any_value(delta), 6) AS cliffs_delta FROM ep JOIN dl USING (stratum) GROUP BY 1""",
)
def strata(spark, folder):
    """All strata in one grouped job; every stratum has its own random stream."""
    a = stream(spark, folder).filter(F.col("event_type").isin("click", "purchase"))
    v = stream(spark, folder, "view").select("user_id", "t", F.col("event_id").alias("view_id"))
    near = nearest_join(a, v, ["user_id"], "t", DAILY, tie="view_id", max_distance=LIMIT_US)
    gap = lag_ms((F.col("match.t") - F.col("t")) / 1e6, F.lit(0.0))
    rows = near.select(
        F.col("user_id").alias("speaker"), group_of().alias("grp"), F.floor(F.col("t") / WEEK_US).alias("epoch_id"), "event_type", gap.alias("lag_ms")
    )
    parts = cut_lineage(in_strata(rows, "event_type", STRATA))
    e = cut_lineage(epoch_summary(parts, margin_ms=MARGIN_MS, keys=["stratum", "speaker", "grp", "epoch_id"]))
    seed = F.abs(F.hash("stratum")) % 100_000
    c = st.compare_groups(e, ALL, margin_ms=MARGIN_MS, seed=seed)
    return c.select(
        "stratum", F.col("candidate_epoch_count").alias("candidate_epochs"), F.col("control_epoch_count").alias("control_epochs"),
        (F.col("candidate_event_count") + F.col("control_event_count")).alias("events"), F.round("median_difference_ms", 3).alias("median_difference_ms"),
        r6("cliffs_delta").alias("cliffs_delta"),
    )


@cat.query(
    "f15_binomial",
    """WITH g AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), h AS (SELECT label, n, label AS k FROM g)
SELECT label, n, list_reduce(list_prepend(1::HUGEINT, range(1, k + 1)::HUGEINT[]), lambda a, i: a * (n - k + i) // i)::VARCHAR AS labelings FROM h""",
)
def labelings(spark, folder):
    g = clips(spark, folder).groupBy(F.col("group_id").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("label", "n", st.binomial(F.col("n"), F.col("label")).alias("labelings"))
