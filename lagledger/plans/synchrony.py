"""Nearest event, signed lag, ledger, epochs and group comparison (batch run)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagledger.functions.numeric import direction, lag_ms, r6
from lagledger.operators import statistics as stats
from lagledger.operators.epochs import epoch_summary
from lagledger.operators.nearest import nearest_join
from lagledger.operators.rules import passes, reasons
from lagledger.plans.catalogue import Catalogue
from lagledger.session import cut_lineage
from lagledger.plans.standins import CLICK_SQL, DAILY, GROUP_SQL, HOUR_US, VIEW_SQL, WEEK_US, group_of, stream
from lagledger.operators.scan import scan

cat = Catalogue()
LIMIT_US = 48 * HOUR_US
MARGIN_MS = 2.0 * 3_600_000.0


def lag_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Every click with its nearest view, signed lag, reasons and status."""
    clicks = stream(spark, folder, "click")
    views = stream(spark, folder, "view").select("user_id", "t", F.col("event_id").alias("view_id"))
    matched = nearest_join(clicks, views, ["user_id"], "t", DAILY, tie="view_id")
    lag = lag_ms((F.col("match.t") - F.col("t")) / 1e6, F.lit(0.0))
    return matched.select(
        "event_id", "user_id", "t", "value",
        F.col("user_id").alias("speaker"), group_of().alias("grp"),
        F.floor(F.col("t") / WEEK_US).alias("epoch_id"),
        F.col("match.view_id").alias("view_id"), F.col("match.t").alias("view_t"), lag.alias("lag_ms"),
    ).withColumn(
        "exclusion_reasons",
        reasons(
            (F.col("view_id").isNull(), "no_visual_event"),
            (F.abs("lag_ms") > LIMIT_US / 1000.0, "visual_event_too_far"),
        ),
    ).withColumn("measurable", passes("exclusion_reasons"))


LEDGER_SQL = f"""c AS ({CLICK_SQL}), v AS ({VIEW_SQL}),
m AS (SELECT c.event_id, v.event_id AS view_id, v.t AS view_t,
   row_number() OVER (PARTITION BY c.event_id ORDER BY abs(v.t - c.t), v.t, v.event_id) AS rn
  FROM c JOIN v USING (user_id)),
ledger AS (SELECT c.event_id, c.user_id, c.t, c.value, c.user_id AS speaker, {GROUP_SQL} AS grp,
   c.t // {WEEK_US} AS epoch_id, m.view_id, m.view_t,
   (m.view_t - c.t) / 1e6 * 1000.0 AS lag_ms
  FROM c LEFT JOIN m ON m.event_id = c.event_id AND m.rn = 1),
used AS (SELECT * FROM ledger WHERE lag_ms IS NOT NULL AND abs(lag_ms) <= {LIMIT_US / 1000.0}),
mid AS (SELECT speaker, grp, epoch_id, median(lag_ms) AS median_lag_ms, count(*) AS event_count,
   avg(CASE WHEN lag_ms > {MARGIN_MS} THEN 1.0 ELSE 0.0 END) AS fraction_over_margin
  FROM used GROUP BY ALL)"""


@cat.query(
    "j4_nearest_join",
    f"WITH {LEDGER_SQL} SELECT event_id, view_id, view_t - t AS gap_us FROM ledger",
)
def nearest_view(spark, folder):
    return lag_ledger(spark, folder).select("event_id", "view_id", (F.col("view_t") - F.col("t")).alias("gap_us"))


def nameless(spark, folder, kind: str):
    """Events of one type; every fifth user has no name, so that these users share the NULL key."""
    return stream(spark, folder, kind).select(F.when(F.col("user_id") % 5 != 0, F.col("user_id")).alias("user_id"), "event_id", "t")


@cat.query(
    "j4_null_keys",
    f"""WITH c AS (SELECT event_id, t, CASE WHEN user_id % 5 <> 0 THEN user_id END AS k FROM ({CLICK_SQL})), v AS (SELECT event_id, t, CASE WHEN user_id % 5 <> 0 THEN user_id END AS k FROM ({VIEW_SQL})),
m AS (SELECT c.event_id, v.event_id AS view_id, row_number() OVER (PARTITION BY c.event_id ORDER BY abs(v.t - c.t), v.t, v.event_id) AS rn FROM c JOIN v ON c.k IS NOT DISTINCT FROM v.k)
SELECT c.event_id, k IS NULL AS nameless, view_id FROM c LEFT JOIN m ON m.event_id = c.event_id AND rn = 1""",
)
def nearest_of_null_keys(spark, folder):
    views = nameless(spark, folder, "view").withColumnRenamed("event_id", "view_id")
    found = nearest_join(nameless(spark, folder, "click"), views, ["user_id"], "t", DAILY, tie="view_id")
    return found.select("event_id", F.col("user_id").isNull().alias("nameless"), F.col("match.view_id").alias("view_id"))


@cat.query(
    "w7_null_keys",
    f"""SELECT event_id, lag(event_id) OVER w AS previous_id, lead(event_id) OVER w AS next_id, row_number() OVER w - 1 AS place
FROM (SELECT event_id, t, CASE WHEN user_id % 5 <> 0 THEN user_id END AS k FROM ({CLICK_SQL})) WINDOW w AS (PARTITION BY k ORDER BY t, event_id)""",
)
def neighbours_of_null_keys(spark, folder):
    e = F.col("event_id")
    out = scan(nameless(spark, folder, "click"), ["user_id"], "t", DAILY, ties=["event_id"], before={"previous_id": e}, after={"next_id": e}, index="place")
    return out.select("event_id", "previous_id", "next_id", "place")


@cat.query(
    "j4_backward_asof",
    f"""WITH c AS ({CLICK_SQL}), v AS ({VIEW_SQL})
SELECT c.event_id, v.event_id AS view_id FROM c ASOF LEFT JOIN v ON c.user_id = v.user_id AND c.t >= v.t""",
)
def backward(spark, folder):
    views = stream(spark, folder, "view").select("user_id", "t", F.col("event_id").alias("view_id"))
    found = nearest_join(
        stream(spark, folder, "click"), views, ["user_id"], "t", DAILY, tie="view_id", direction="backward"
    )
    return found.select("event_id", F.col("match.view_id").alias("view_id"))


@cat.query(
    "f6_lag_direction",
    f"""WITH {LEDGER_SQL} SELECT event_id, round(lag_ms, 6) AS lag_ms,
 CASE WHEN lag_ms IS NULL THEN 'unavailable' WHEN lag_ms < -{MARGIN_MS} THEN 'video_leads'
      WHEN lag_ms > {MARGIN_MS} THEN 'video_lags' ELSE 'near' END AS direction,
 round(sqrt((value / 2) * (value / 2) + 25.0), 6) AS uncertainty FROM ledger""",
)
def lag_direction(spark, folder):
    from lagledger.functions.numeric import lag_uncertainty_ms

    return lag_ledger(spark, folder).select(
        "event_id", r6("lag_ms").alias("lag_ms"), direction("lag_ms", MARGIN_MS).alias("direction"),
        r6(lag_uncertainty_ms("value", F.lit(5.0))).alias("uncertainty"),
    )


@cat.query(
    "p2_exclusion_reasons",
    f"""WITH {LEDGER_SQL} SELECT event_id,
 concat_ws(',', CASE WHEN view_id IS NULL THEN 'no_visual_event' END,
   CASE WHEN abs(lag_ms) > {LIMIT_US / 1000.0} THEN 'visual_event_too_far' END) AS reasons,
 (lag_ms IS NOT NULL AND abs(lag_ms) <= {LIMIT_US / 1000.0}) AS measurable FROM ledger""",
)
def exclusion_reasons(spark, folder):
    return lag_ledger(spark, folder).select(
        "event_id", F.concat_ws(",", "exclusion_reasons").alias("reasons"), "measurable"
    )


def epochs_of(spark, folder) -> DataFrame:
    # The ledger feeds the medians and the deviations: compute it once.
    ledger = cut_lineage(lag_ledger(spark, folder))
    return epoch_summary(ledger, margin_ms=MARGIN_MS, probe=speaker_weeks(spark, folder))


def speaker_weeks(spark, folder) -> DataFrame:
    """Cheap upper bound on rows per epoch for the hot-group check."""
    return stream(spark, folder, "click").select(
        F.col("user_id").alias("speaker"), group_of().alias("grp"), F.floor(F.col("t") / WEEK_US).alias("epoch_id")
    )


@cat.query(
    "a1_epoch_summary",
    f"""WITH {LEDGER_SQL} SELECT mid.speaker, mid.grp, mid.epoch_id, mid.event_count,
 round(mid.median_lag_ms, 6) AS median_lag_ms, round(mid.fraction_over_margin, 6) AS fraction_over_margin,
 round(median(abs(used.lag_ms - mid.median_lag_ms)), 6) AS mad_lag_ms
FROM mid JOIN used USING (speaker, grp, epoch_id) GROUP BY ALL""",
)
def epoch_table(spark, folder):
    e = epochs_of(spark, folder)
    return e.select(
        "speaker", "grp", "epoch_id", "event_count", r6("median_lag_ms").alias("median_lag_ms"),
        r6("fraction_over_margin").alias("fraction_over_margin"), r6("mad_lag_ms").alias("mad_lag_ms"),
    )


@cat.query(
    "q1_cliffs_delta",
    f"""WITH {LEDGER_SQL}, pairs AS (SELECT a.median_lag_ms AS c, b.median_lag_ms AS k
  FROM mid a JOIN mid b ON a.grp = 'candidate' AND b.grp = 'control')
SELECT round(avg(CASE WHEN c > k THEN 1.0 WHEN c = k THEN 0.5 ELSE 0.0 END), 6) AS probability_candidate_greater,
 round(2 * avg(CASE WHEN c > k THEN 1.0 WHEN c = k THEN 0.5 ELSE 0.0 END) - 1, 6) AS cliffs_delta FROM pairs""",
)
def cliffs(spark, folder):
    e = epochs_of(spark, folder).withColumn("stratum", F.lit("all"))
    d = stats.cliffs_delta(e, ["stratum"], "grp", "median_lag_ms")
    return d.select(
        r6("probability_candidate_greater").alias("probability_candidate_greater"), r6("cliffs_delta").alias("cliffs_delta")
    )


@cat.query(
    "p8_direction",
    f"""WITH {LEDGER_SQL} SELECT CASE WHEN lag_ms IS NULL THEN 'unavailable' WHEN lag_ms < -{MARGIN_MS} THEN 'video_leads' WHEN lag_ms > {MARGIN_MS} THEN 'video_lags' ELSE 'near' END AS direction,
 count(*) AS events FROM ledger GROUP BY 1""",
)
def directions(spark, folder):
    ledger = lag_ledger(spark, folder)
    return ledger.groupBy(direction("lag_ms", MARGIN_MS).alias("direction")).agg(F.count(F.lit(1)).alias("events"))


@cat.query(
    "j12_pairwise",
    f"""WITH {LEDGER_SQL} SELECT a.epoch_id, count(*) AS pairs, round(avg(CASE WHEN a.median_lag_ms > b.median_lag_ms THEN 1.0 WHEN a.median_lag_ms = b.median_lag_ms THEN 0.5 ELSE 0.0 END), 6) AS probability
FROM mid a JOIN mid b ON a.epoch_id = b.epoch_id AND a.grp = 'candidate' AND b.grp = 'control' GROUP BY 1""",
)
def pairwise(spark, folder):
    """Wins and ties of all candidate-control pairs per week, counted without forming a pair."""
    e = cut_lineage(epochs_of(spark, folder))
    sizes = e.groupBy("epoch_id").agg(
        (F.count_if(F.col("grp") == "candidate") * F.count_if(F.col("grp") == "control")).alias("pairs")
    )
    d = stats.cliffs_delta(e, ["epoch_id"], "grp", "median_lag_ms")
    return sizes.join(d, "epoch_id").select("epoch_id", "pairs", r6("probability_candidate_greater").alias("probability"))
