"""Ledger, key-check, ordering and rater queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagledger.functions import text as tx
from lagledger.functions.numeric import r6
from lagledger.operators import agreement as ag
from lagledger.operators import ledger as lg
from lagledger.operators import ranking as rk
from lagledger.operators import timeline as tl
from lagledger.operators.epochs import disposition_counts, in_strata, reason_counts
from lagledger.operators.rules import passes, reasons
from lagledger.operators.scan import scan
from lagledger.plans.catalogue import Catalogue
from lagledger.plans.standins import CLICK_SQL, DAILY, DAY_US, E_SQL, GROUP_SQL, HOUR_US, VIEW_SQL, Slicing, group_of, stream, table
from lagledger.plans.synchrony import LEDGER_SQL, LIMIT_US, lag_ledger

cat = Catalogue()
BY_KEY = Slicing(width=1_000_000)


def annotations(spark, folder):
    """Line items reduced to one row per order; orders with few lines have none."""
    return table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("lines")
    ).filter(F.col("lines") >= 3)


ANN_SQL = "a AS (SELECT l_orderkey AS o_orderkey, sum(l_quantity) AS quantity, count(*) AS lines FROM lineitem GROUP BY 1 HAVING count(*) >= 3)"


@cat.query(
    "j1_ledger_join",
    f"""WITH {ANN_SQL} SELECT o_orderkey, o_orderstatus, quantity,
 CASE WHEN lines IS NULL THEN 'no_annotation' ELSE '' END AS reasons FROM orders LEFT JOIN a USING (o_orderkey)""",
)
def ledger(spark, folder):
    # Unknown keys would fail the strict join: annotate known orders only.
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    known = annotations(spark, folder).join(orders.select("o_orderkey"), "o_orderkey", "left_semi")
    out = lg.ledger_join(orders, known, "o_orderkey")
    return out.select(
        "o_orderkey", "o_orderstatus", F.col("annotation.quantity").alias("quantity"),
        F.concat_ws(",", "join_reasons").alias("reasons"),
    )


@cat.query(
    "j1_join_audit",
    f"""WITH {ANN_SQL} SELECT count(o.o_orderkey) AS ledger_rows, count(*) FILTER (o.o_orderkey IS NOT NULL AND lines IS NOT NULL) AS annotated,
 count(*) FILTER (lines IS NULL) AS unannotated, count(*) FILTER (o.o_orderkey IS NULL) AS unknown, 0::BIGINT AS duplicated
FROM orders o FULL JOIN a USING (o_orderkey)""",
)
def audit(spark, folder):
    return lg.join_audit(table(spark, folder, "orders"), annotations(spark, folder), "o_orderkey")


@cat.query(
    "x1_same_ids",
    """WITH a AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_totalprice > 100000), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 30)
SELECT k, 'left_only' AS side FROM a ANTI JOIN b USING (k) UNION ALL SELECT k, 'right_only' FROM b ANTI JOIN a USING (k)""",
)
def same_ids(spark, folder):
    a = table(spark, folder, "orders").filter("o_totalprice > 100000").select(F.col("o_orderkey").alias("k"))
    b = table(spark, folder, "lineitem").filter("l_quantity > 30").select(F.col("l_orderkey").alias("k"))
    return lg.key_differences(a, b, ["k"])


@cat.query("x2_unique_key", "SELECT l_orderkey, count(*) AS copies FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicates(spark, folder):
    return lg.duplicate_keys(table(spark, folder, "lineitem"), ["l_orderkey"])


@cat.query(
    "x3_unused_keys",
    "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey",
)
def unused(spark, folder):
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, folder, "customer").select("c_custkey").join(orders, "c_custkey", "left_anti")


@cat.query(
    "x4_strata",
    f"""WITH e AS ({E_SQL}), s AS (SELECT *, 'primary' AS stratum FROM e WHERE event_type = 'click' UNION ALL
 SELECT *, 'secondary' FROM e WHERE event_type = 'view' UNION ALL SELECT *, 'pooled' FROM e WHERE event_type IN ('click', 'view'))
SELECT stratum, {GROUP_SQL} AS grp, count(*) AS events, round(sum(value), 4) AS total FROM s GROUP BY ALL""",
)
def strata(spark, folder):
    out = in_strata(
        stream(spark, folder), "event_type", {"primary": ["click"], "secondary": ["view"], "pooled": ["click", "view"]}
    )
    return out.groupBy("stratum", group_of().alias("grp")).agg(
        F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("total")
    )


@cat.query(
    "x5_target_times",
    f"""WITH c AS ({CLICK_SQL}), g AS (SELECT user_id, unnest(range(min(t), max(t) + 1, {DAY_US})) AS t FROM c GROUP BY user_id),
o AS (SELECT user_id, t + d AS t FROM c, (VALUES (-{HOUR_US}), (0), ({HOUR_US})) x(d)), b AS (SELECT user_id, min(t) AS lo, max(t) AS hi FROM c GROUP BY 1)
SELECT DISTINCT user_id, round(t / 1e6, 6) AS time_s FROM (SELECT * FROM g UNION ALL SELECT * FROM o) JOIN b USING (user_id) WHERE t BETWEEN lo AND hi""",
)
def target_times(spark, folder):
    from lagledger.operators.tokens import target_times as times

    c = stream(spark, folder, "click").select("user_id", "t")
    return times(c, ["user_id"], "t", step=DAY_US, offsets=(-HOUR_US, 0, HOUR_US)).select(
        "user_id", r6(F.col("t") / 1e6).alias("time_s")
    )


@cat.query(
    "x12_group_consistency",
    """WITH j AS (SELECT c_nationkey AS group_id, c_mktsegment AS label, 'c' || c_custkey AS clip_id, c_acctbal AS start_s, c_acctbal + c_custkey % 3 AS end_s FROM customer),
g AS (SELECT group_id, count(DISTINCT label) > 1 AS many FROM j GROUP BY 1)
SELECT clip_id, concat_ws(',', CASE WHEN many THEN 'group_has_several_labels' END, CASE WHEN start_s < 0 THEN 'negative_start' END,
 CASE WHEN end_s <= start_s THEN 'empty_interval' END) AS reasons FROM j JOIN g USING (group_id)""",
)
def group_consistency(spark, folder):
    from lagledger.operators.compare import group_consistency as check

    c = table(spark, folder, "customer").select(
        F.col("c_nationkey").alias("group_id"), F.col("c_mktsegment").alias("label"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("clip_id"),
        F.col("c_acctbal").alias("start_s"), (F.col("c_acctbal") + F.col("c_custkey") % 3).alias("end_s"),
    )
    return check(c, "label").select("clip_id", F.concat_ws(",", "consistency_reasons").alias("reasons"))


@cat.query(
    "f13_valid_names",
    """SELECT p_partkey, regexp_full_match(p_brand, '[A-Za-z0-9][A-Za-z0-9._-]*') AS id_ok,
 CASE WHEN regexp_full_match('#' || substr(sha256(p_name), 1, p_size % 4 + 4), '#[0-9A-Fa-f]{6}') THEN upper('#' || substr(sha256(p_name), 1, p_size % 4 + 4)) END AS color,
 regexp_full_match(sha256(p_name), '[0-9a-f]{64}') AS sha_ok FROM part""",
)
def names(spark, folder):
    p = table(spark, folder, "part")
    sha = F.sha2("p_name", 256)
    color = F.concat(F.lit("#"), sha.substr(F.lit(1), F.col("p_size") % 4 + 4))
    return p.select("p_partkey", tx.valid_id("p_brand").alias("id_ok"), tx.valid_color(color).alias("color"), tx.valid_sha(sha).alias("sha_ok"))


SHUFFLE_SQL = "s AS (SELECT o_orderkey, o_custkey, o_orderstatus, row_number() OVER (ORDER BY sha256('7:' || o_orderkey), o_orderkey) AS blind_order FROM orders)"


@cat.query(
    "t3_blind_shuffle",
    f"""WITH {SHUFFLE_SQL} SELECT o_orderkey, blind_order,
 'AR-' || CASE WHEN blind_order < 10000 THEN lpad(blind_order::VARCHAR, 4, '0') ELSE blind_order::VARCHAR END AS blind_id FROM s""",
)
def shuffled(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey")
    return rk.blind_shuffle(o, "o_orderkey", 7).select("o_orderkey", "blind_order", "blind_id")


@cat.query(
    "j9_unblind",
    f"""WITH {SHUFFLE_SQL} SELECT 'AR-' || CASE WHEN blind_order < 10000 THEN lpad(blind_order::VARCHAR, 4, '0') ELSE blind_order::VARCHAR END AS blind_id,
 o_orderkey, o_orderstatus AS status, n_name FROM s JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""",
)
def unblinded(spark, folder):
    from lagledger.session import cut_lineage

    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    # The key is a stored artifact: it is read by three checks and the join.
    key = cut_lineage(rk.blind_shuffle(o, "o_orderkey", 7).select("blind_id", "o_orderkey", "o_orderstatus"))
    reviews = key.select("blind_id", F.col("o_orderstatus").alias("status"))
    who = table(spark, folder, "customer").join(
        table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).select(F.col("c_custkey").alias("o_custkey"), "n_name")
    ledger_rows = o.join(who, "o_custkey").select("o_orderkey", "n_name")
    return lg.unblind(reviews, key.drop("o_orderstatus"), ledger_rows, "blind_id", "o_orderkey").select(
        "blind_id", "o_orderkey", "status", "n_name"
    )


@cat.query(
    "t6_chronological",
    """WITH l AS (SELECT o_orderkey, epoch_us(o_orderdate) AS t, lag(epoch_us(o_orderdate)) OVER (ORDER BY o_orderkey) AS p FROM orders)
SELECT o_orderkey FROM l WHERE t < p""",
)
def chronology(spark, folder):
    from lagledger.functions.numeric import micros

    o = table(spark, folder, "orders").select("o_orderkey", micros("o_orderdate").alias("t"))
    return rk.chronology_breaks(o, "t", "o_orderkey", BY_KEY).select("o_orderkey")


@cat.query(
    "w21_assemble_timeline",
    """WITH o AS (SELECT o_custkey, o_orderkey, floor(o_totalprice * 10)::BIGINT AS n FROM orders),
c AS (SELECT *, row_number() OVER w - 1 AS i, 4800 + sum(n + 240) OVER w - 240 AS f FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
z AS (SELECT o_custkey, max(f) AS last, max(i) AS i FROM c GROUP BY 1),
p AS (SELECT o_custkey, 1 + 2 * i AS position, 'clip' AS phase, o_orderkey AS clip, f - n AS s, f AS e FROM c
 UNION ALL SELECT o_custkey, 2 * i, 'gap', NULL, f - n - 240, f - n FROM c WHERE i > 0
 UNION ALL SELECT o_custkey, 0, 'intro', NULL, 0, 4800 FROM z UNION ALL SELECT o_custkey, 2 * i + 2, 'outro', NULL, last, last + 1000 FROM z
 UNION ALL SELECT o_custkey, 2 * i + 3, 'pad', NULL, last + 1000, ((last + 1000 + 1999) // 2000) * 2000 FROM z)
SELECT o_custkey, position::BIGINT AS position, phase, clip, s::BIGINT AS start_sample, e::BIGINT AS end_sample FROM p WHERE e > s""",
)
def timeline(spark, folder):
    o = table(spark, folder, "orders").select(
        "o_custkey", "o_orderkey", F.floor(F.col("o_totalprice") * 10).alias("n")
    )
    return tl.assemble_timeline(o, ["o_custkey"], "o_orderkey", "n", BY_KEY, intro=4800, gap=240, outro=1000, frame=2000)


@cat.query(
    "a21_class_counts",
    """SELECT p AS o_orderpriority, count(o_orderkey) AS events FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW'), ('6-NONE')) v(p)
LEFT JOIN orders ON o_orderpriority = p GROUP BY 1""",
)
def classes(spark, folder):
    allowed = spark.createDataFrame(
        [(c,) for c in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NONE")], "o_orderpriority string"
    )
    return lg.class_counts(table(spark, folder, "orders"), "o_orderpriority", allowed)


@cat.query(
    "a4_disposition_counts",
    f"""WITH {LEDGER_SQL}, b AS (SELECT grp, speaker::VARCHAR AS sp, view_id IS NOT NULL AS attempted, coalesce(abs(lag_ms) <= {LIMIT_US / 1000}, false) AS measurable FROM ledger)
SELECT CASE GROUPING(grp, sp) WHEN 3 THEN 'overall' WHEN 1 THEN 'group' ELSE 'speaker' END AS scope, coalesce(grp, sp, 'all') AS name,
 count(*) AS selected, count(*) FILTER (attempted) AS attempted, count(*) FILTER (measurable) AS measurable FROM b GROUP BY GROUPING SETS ((), (grp), (sp))""",
)
def dispositions(spark, folder):
    return disposition_counts(
        lag_ledger(spark, folder), "grp", "speaker", {"attempted": F.col("view_id").isNotNull(), "measurable": F.col("measurable")}
    )


@cat.query(
    "a5_reason_counts",
    f"""WITH {LEDGER_SQL}, r AS (SELECT unnest(list_filter([CASE WHEN view_id IS NULL THEN 'no_visual_event' END,
 CASE WHEN abs(lag_ms) > {LIMIT_US / 1000} THEN 'visual_event_too_far' END, CASE WHEN value < 5 THEN 'weak_event' END], lambda x: x IS NOT NULL)) AS reason FROM ledger)
SELECT reason, count(*) AS events FROM r GROUP BY 1""",
)
def counted_reasons(spark, folder):
    more = lag_ledger(spark, folder).withColumn(
        "exclusion_reasons", F.concat("exclusion_reasons", reasons((F.col("value") < 5, "weak_event")))
    )
    return reason_counts(more)


@cat.query(
    "a20_run_health",
    f"""SELECT user_id, count(*) AS rows, count(*) FILTER (event_type = 'error') AS errors,
 CASE WHEN count(*) = count(*) FILTER (event_type = 'error') THEN 'FAIL' ELSE 'PASS' END AS health
FROM (SELECT *, epoch_us(ts) // {DAY_US} AS d FROM events) GROUP BY user_id, d""",
)
def health(spark, folder):
    e = stream(spark, folder).select(
        "user_id", F.floor(F.col("t") / DAY_US).alias("d"),
        F.when(F.col("event_type") == "error", "processing_error").otherwise("done").alias("status"),
    )
    return lg.run_health(e, ["user_id", "d"]).drop("d")


@cat.query(
    "t4_first_n",
    f"""WITH c AS ({CLICK_SQL}), s AS (SELECT event_id, value >= 20 AS ok, sum((value >= 20)::INT) OVER (ORDER BY t, event_id) AS seen FROM c)
SELECT event_id, CASE WHEN NOT ok THEN 'excluded' WHEN seen <= 500 THEN 'selected' ELSE 'deferred' END AS status FROM s""",
)
def first_rows(spark, folder):
    c = stream(spark, folder, "click").select("event_id", "t", "value")
    return rk.first_n(c, 500, "t", DAILY, eligible=F.col("value") >= 20, ties=["event_id"]).select("event_id", "status")


@cat.query(
    "t5_spread_pick",
    f"""WITH e AS ({E_SQL}), n AS (SELECT event_id, row_number() OVER (ORDER BY t, event_id) - 1 AS position, count(*) OVER () AS n FROM e),
k AS (SELECT unnest(range(36)) AS pick), p AS (SELECT pick, floor(pick * (SELECT count(*) - 1 FROM e) / 35)::BIGINT AS position FROM k)
SELECT pick::INTEGER AS pick, position, event_id FROM n JOIN p USING (position)""",
)
def spread(spark, folder):
    e = stream(spark, folder).select("event_id", "t")
    return rk.spread_pick(e, 36, "t", DAILY, ties=["event_id"]).select("pick", "position", "event_id")


@cat.query(
    "t8_pick_by_priority",
    f"""WITH e AS ({E_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type <> 'view', abs(value - 40), -t) AS rn FROM e)
SELECT user_id, event_id, event_type FROM r WHERE rn = 1""",
)
def priority(spark, folder):
    e = stream(spark, folder)
    best = rk.pick_by_priority(e, "user_id", [F.col("event_type") != "view", F.abs(F.col("value") - 40), -F.col("t")])
    return best.select("user_id", "event_id", "event_type")


@cat.query(
    "r4_resume",
    """WITH d AS (SELECT event_id FROM events WHERE event_type IN ('click', 'view')) SELECT event_id FROM events ANTI JOIN d USING (event_id)""",
)
def todo(spark, folder):
    e = stream(spark, folder).select("event_id", "event_type")
    done = e.filter(F.col("event_type").isin("click", "view")).select("event_id", F.lit("abc").alias("config_sha256"))
    return lg.resume(e, done, "event_id", "abc").select("event_id")


@cat.query(
    "r5_materialize_ledger",
    """SELECT event_id, CASE WHEN event_type = 'click' THEN 'processed' WHEN event_type = 'view' AND value > 40 THEN 'processing_error' WHEN value < 10 THEN 'excluded'
 WHEN value > 80 THEN 'deferred' ELSE 'pending' END AS status FROM events""",
)
def materialized(spark, folder):
    e = stream(spark, folder)
    done = e.filter((F.col("event_type") == "click") | ((F.col("event_type") == "view") & (F.col("value") > 40))).select(
        "event_id", F.when(F.col("event_type") == "click", "processed").otherwise("processing_error").alias("status")
    )
    return lg.materialize_ledger(e, done, "event_id", F.col("value") >= 10, F.col("value") > 80).select("event_id", "status")


@cat.query(
    "j10_tolerance_match",
    f"""WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS rk FROM ({CLICK_SQL})), b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS rk FROM ({VIEW_SQL}))
SELECT a.event_id, CASE WHEN NOT EXISTS (SELECT 1 FROM b WHERE b.user_id = a.user_id) THEN 'no_source_candidate'
 WHEN NOT EXISTS (SELECT 1 FROM b WHERE b.user_id = a.user_id AND abs(b.t - a.t) <= {HOUR_US}) THEN 'time_differs_from_source' ELSE '' END AS reasons FROM a""",
)
def tolerance(spark, folder):
    ranked = lambda kind: scan(
        stream(spark, folder, kind).select("user_id", "event_id", "t"), ["user_id"], "t", DAILY, ties=["event_id"], index="rk"
    )
    out = lg.tolerance_matches(ranked("click"), ranked("view"), "user_id", "rk", "t", HOUR_US)
    return out.select("event_id", F.concat_ws(",", "match_reasons").alias("reasons"))


BAD_LINES = {"positive_quantity": "l_quantity <= 0", "modest_discount": "l_discount > 0.08", "known_line": "nullif(l_linenumber, 7) > 7", "first_lines": "l_linenumber > 1"}


@cat.query(
    "x20_table_checks",
    "WITH r AS ("
    + " UNION ALL ".join(
        f"""SELECT {i} AS position, '{n}' AS name, count(*) FILTER ({bad}) AS violations, count(*) FILTER (({bad}) IS NULL) AS undecided,
 (SELECT '{{"l_orderkey":' || l_orderkey || ',"l_linenumber":' || l_linenumber || '}}' FROM lineitem WHERE {bad} ORDER BY l_orderkey, l_linenumber LIMIT 1) AS details FROM lineitem"""
        for i, (n, bad) in enumerate(BAD_LINES.items())
    )
    + """), s AS (SELECT *, CASE WHEN name = 'first_lines' AND (SELECT violations FROM r WHERE name = 'modest_discount') > 0 THEN 'SKIPPED' WHEN undecided > 0 THEN 'ERROR' WHEN violations > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM r)
SELECT position, name, violations, details, CASE WHEN undecided > 0 THEN undecided || ' rows undecided' END AS error, status, (SELECT CASE WHEN bool_and(status = 'PASS') THEN 'PASS' ELSE 'FAIL' END FROM s) AS overall FROM s""",
)
def line_checks(spark, folder):
    rules = {n: F.expr(bad) for n, bad in BAD_LINES.items()}
    return lg.table_checks(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"], rules, {"first_lines": "modest_discount"})


@cat.query(
    "x20_run_checks",
    """WITH v AS (SELECT 0 AS position, 'unique_orders' AS name, (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS violations, NULL AS needs
 UNION ALL SELECT 1, 'unique_lines', (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)), NULL
 UNION ALL SELECT 2, 'known_orders', (SELECT count(*) FROM lineitem ANTI JOIN orders ON l_orderkey = o_orderkey), 'unique_orders'
 UNION ALL SELECT 3, 'one_line_each', (SELECT count(*) FROM lineitem WHERE l_linenumber > 1), 'unique_lines'),
s AS (SELECT *, CASE WHEN needs IN (SELECT name FROM v WHERE violations > 0) THEN 'SKIPPED' WHEN violations > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM v)
SELECT position, name, violations, status, (SELECT CASE WHEN bool_and(status = 'PASS') THEN 'PASS' ELSE 'FAIL' END FROM s) AS overall FROM s""",
)
def checks(spark, folder):
    o, l = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    return lg.run_checks(
        {
            "unique_orders": lg.duplicate_keys(o, ["o_orderkey"]),
            "unique_lines": lg.duplicate_keys(l, ["l_orderkey"]),
            "known_orders": l.join(o.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti"),
            "one_line_each": l.filter("l_linenumber > 1"),
        },
        {"known_orders": "unique_orders", "one_line_each": "unique_lines"},
    )


# Two raters per document from the label table, a third from the parity of both.
VOTES_SQL = """v AS (SELECT doc_id, 'a' AS rater, CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END AS vote FROM labels
 UNION ALL SELECT doc_id, 'b', CASE WHEN toxic = 1 THEN 'yes' ELSE 'no' END FROM labels
 UNION ALL SELECT doc_id, 'c', CASE WHEN doc_id % 5 = 0 THEN 'ambiguous' WHEN doc_id % 2 = 0 THEN 'yes' ELSE 'no' END FROM labels)"""


def votes(spark, folder):
    l = table(spark, folder, "labels")
    yes = lambda c: F.when(c, "yes").otherwise("no")
    each = F.explode(
        F.array(
            F.struct(F.lit("a").alias("rater"), yes(F.col("quality") == 1).alias("vote")),
            F.struct(F.lit("b").alias("rater"), yes(F.col("toxic") == 1).alias("vote")),
            F.struct(
                F.lit("c").alias("rater"),
                F.when(F.col("doc_id") % 5 == 0, "ambiguous").otherwise(yes(F.col("doc_id") % 2 == 0)).alias("vote"),
            ),
        )
    ).alias("v")
    return l.select("doc_id", each).select("doc_id", "v.*")


@cat.query(
    "a10_majority",
    f"""WITH {VOTES_SQL}, c AS (SELECT doc_id, count(*) AS raters, count(*) FILTER (vote = 'yes') AS y, count(*) FILTER (vote = 'no') AS n, count(*) FILTER (vote = 'ambiguous') AS m FROM v GROUP BY 1)
SELECT doc_id, y AS yes_votes, n AS no_votes, CASE WHEN y >= 2 THEN 'yes' WHEN n >= 2 THEN 'no' ELSE 'ambiguous' END AS consensus, greatest(y, n, m) = raters AS unanimous FROM c""",
)
def majority(spark, folder):
    return ag.majority(votes(spark, folder), "doc_id", "vote").select("doc_id", "yes_votes", "no_votes", "consensus", "unanimous")


PAIR_SQL = f"""{VOTES_SQL}, p AS (SELECT a.rater AS rater_a, b.rater AS rater_b, a.vote AS x, b.vote AS y FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.rater < b.rater),
k AS (SELECT rater_a, rater_b, count(*) AS items, avg((x = y)::INT) AS o, avg((x = 'yes')::INT) * avg((y = 'yes')::INT) + avg((x = 'no')::INT) * avg((y = 'no')::INT)
 + avg((x = 'ambiguous')::INT) * avg((y = 'ambiguous')::INT) AS e FROM p GROUP BY ALL)"""


@cat.query(
    "a12_cohen_kappa",
    f"WITH {PAIR_SQL} SELECT rater_a, rater_b, items, round(o, 6) AS observed, round(e, 6) AS expected, round((o - e) / (1 - e), 6) AS kappa FROM k",
)
def kappa(spark, folder):
    pairs = ag.rater_pairs(votes(spark, folder), "doc_id", "rater", "vote")
    k = ag.cohen_kappa(pairs, "vote_a", "vote_b", ("yes", "no", "ambiguous"), ["rater_a", "rater_b"])
    return k.select("rater_a", "rater_b", "items", r6("observed").alias("observed"), r6("expected").alias("expected"), r6("kappa").alias("kappa"))


@cat.query(
    "a13_fleiss_kappa",
    f"""WITH {VOTES_SQL}, i AS (SELECT doc_id, count(*) AS r, count(*) FILTER (vote = 'yes') AS y, count(*) FILTER (vote = 'no') AS n, count(*) FILTER (vote = 'ambiguous') AS m FROM v GROUP BY 1),
g AS (SELECT count(*) AS items, avg((y * y + n * n + m * m - r) / (r * (r - 1))) AS o, (sum(y) / sum(r)) ** 2 + (sum(n) / sum(r)) ** 2 + (sum(m) / sum(r)) ** 2 AS e FROM i)
SELECT items, round(o, 6) AS observed, round(e, 6) AS expected, round((o - e) / (1 - e), 6) AS kappa FROM g""",
)
def fleiss(spark, folder):
    k = ag.fleiss_kappa(votes(spark, folder), "doc_id", "vote", ("yes", "no", "ambiguous"))
    return k.select("items", r6("observed").alias("observed"), r6("expected").alias("expected"), r6("kappa").alias("kappa"))


AGREE_SQL = """r AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'ambiguous' WHEN quality = 1 THEN 'strong_contact' ELSE 'no_visible_contact' END AS h,
 CASE WHEN toxic = 1 THEN 'no_visible_contact' WHEN doc_id % 2 = 0 THEN 'weak_contact' ELSE 'strong_contact' END AS m,
 CASE doc_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN 'ambiguous' ELSE 'not_applicable' END AS hp, toxic = 1 AS mp FROM labels)"""


@cat.query(
    "a14_machine_agreement",
    f"""WITH {AGREE_SQL} SELECT doc_id, CASE WHEN h = 'ambiguous' THEN h WHEN h = m THEN 'match' ELSE 'mismatch' END AS category_agreement,
 CASE WHEN h = 'ambiguous' THEN h WHEN (h = 'strong_contact') = (m <> 'no_visible_contact') THEN 'match' ELSE 'mismatch' END AS presence_agreement,
 CASE WHEN hp IN ('true', 'false') AND h = 'strong_contact' THEN CASE WHEN (hp = 'true') = mp THEN 'match' ELSE 'mismatch' END
 WHEN hp = 'ambiguous' THEN 'ambiguous' ELSE 'not_applicable' END AS post_only_agreement FROM r""",
)
def agreement(spark, folder):
    d, q, t = F.col("doc_id"), F.col("quality"), F.col("toxic")
    rows = table(spark, folder, "labels").select(
        "doc_id",
        F.when(d % 5 == 0, "ambiguous").when(q == 1, "strong_contact").otherwise("no_visible_contact").alias("h"),
        F.when(t == 1, "no_visible_contact").when(d % 2 == 0, "weak_contact").otherwise("strong_contact").alias("m"),
        F.when(d % 4 == 0, "true").when(d % 4 == 1, "false").when(d % 4 == 2, "ambiguous").otherwise("not_applicable").alias("hp"),
        (t == 1).alias("mp"),
    )
    return ag.machine_agreement(rows, "h", "m", "hp", "mp").select(
        "doc_id", "category_agreement", "presence_agreement", "post_only_agreement"
    )


@cat.query(
    "p14_followup_rule",
    """SELECT doc_id FROM labels WHERE quality = 0 OR toxic = 1""",
)
def followup(spark, folder):
    rows = table(spark, folder, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, "yes").otherwise("no").alias("contact"),
        F.when(F.col("toxic") == 1, "after_only").otherwise("before").alias("timing"),
    )
    return ag.needs_followup(rows, "contact", "timing").select("doc_id")


@cat.query(
    "f17_first_alias",
    """WITH x AS (SELECT doc_id, CASE WHEN quality = 1 THEN ' Yes ' ELSE '' END AS a, CASE WHEN toxic = 1 THEN 'no' WHEN doc_id % 2 = 0 THEN 'yes' END AS b FROM labels),
y AS (SELECT doc_id, nullif(lower(trim(a)), '') AS a, nullif(lower(trim(b)), '') AS b FROM x)
SELECT doc_id, coalesce(a, b) AS value, coalesce(a <> b, false) AS conflict FROM y""",
)
def first_alias(spark, folder):
    l = table(spark, folder, "labels")
    a = F.when(F.col("quality") == 1, " Yes ").otherwise("")
    b = F.when(F.col("toxic") == 1, "no").when(F.col("doc_id") % 2 == 0, "yes")
    got = tx.first_alias(a, b)
    return l.select("doc_id", got["value"].alias("value"), got["conflict"].alias("conflict"))


@cat.query(
    "f18_contact_alias",
    """SELECT doc_id, CASE WHEN quality = 1 THEN 'yes' WHEN toxic = 1 THEN 'no' ELSE 'ambiguous' END AS contact FROM labels""",
)
def contact_alias(spark, folder):
    raw = F.when(F.col("quality") == 1, "Contact").when(F.col("toxic") == 1, "no_contact").otherwise(" ambiguous")
    return table(spark, folder, "labels").select("doc_id", tx.contact_alias(raw).alias("contact"))
