"""Ledger joins and key checks: nothing is dropped, every miss is a reason or a violation row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagledger.operators.rules import passes, reasons


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def key_differences(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys on one side only, with the side; empty when both key sets are equal."""
    sides = left.select(*keys, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(*keys, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    # One grouped pass instead of two anti joins; copies fold map-side.
    seen = sides.groupBy(*keys).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    return seen.filter(F.col("_l") + F.col("_r") == 1).select(
        *keys, F.when(F.col("_l") == 1, "left_only").otherwise("right_only").alias("side")
    )


def require_none(violations: DataFrame, guarded: DataFrame, message: str) -> DataFrame:
    """``guarded`` unchanged, or a failed query where ``violations`` has a row.

    The check is an uncorrelated scalar subquery: it runs once, inside the
    query, with no driver step and no join.
    """
    count = violations.limit(1).agg(F.count(F.lit(1)).alias("_bad")).select(
        F.when(F.col("_bad") > 0, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True)).alias("_ok")
    )
    return guarded.filter(count.scalar())


def ledger_join(
    ledger: DataFrame, annotations: DataFrame, key: str, *, strict: bool = True, missing: str = "no_annotation"
) -> DataFrame:
    """All ledger rows with their annotation struct, or a reason where there is none.

    ``strict`` fails on duplicate keys on either side and on unknown
    annotation keys.
    """
    value = F.struct(*[F.col(c) for c in annotations.columns if c != key]).alias("annotation")
    joined = ledger.join(annotations.select(key, value), key, "left").withColumn(
        "join_reasons", reasons((F.col("annotation").isNull(), missing))
    )
    if not strict:
        return joined
    joined = require_none(duplicate_keys(ledger, [key]), joined, "duplicate ledger key")
    joined = require_none(duplicate_keys(annotations, [key]), joined, "duplicate annotation key")
    unknown = annotations.select(key).join(ledger.select(key), key, "left_anti")
    return require_none(unknown, joined, "annotation for an unknown event")


def join_audit(ledger: DataFrame, annotations: DataFrame, key: str) -> DataFrame:
    """One row of counts: ledger, annotated, unannotated, unknown, duplicated."""
    both = ledger.groupBy(key).agg(F.count(F.lit(1)).alias("_l")).join(
        annotations.groupBy(key).agg(F.count(F.lit(1)).alias("_a")), key, "full"
    )
    l, a = F.col("_l").isNotNull(), F.col("_a").isNotNull()
    return both.agg(
        F.sum("_l").alias("ledger_rows"), F.count_if(l & a).alias("annotated"), F.count_if(l & ~a).alias("unannotated"),
        F.count_if(a & ~l).alias("unknown"), F.count_if((F.col("_l") > 1) | (F.col("_a") > 1)).alias("duplicated"),
    )


def token_join(tokens: DataFrame, manifest: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Exact join on a composite key; the manifest label overrides the interval label. A key twice in the manifest fails the query."""
    right = manifest.select(*keys, F.col(label).alias("_label"), F.lit(True).alias("_found"))
    out = require_none(duplicate_keys(manifest, keys), tokens.join(right, list(keys), "left"), "manifest key used twice")
    return (
        out.withColumn("label_source", F.when(F.col("_found") & F.col("_label").isNotNull(), "manifest").otherwise("interval"))
        .withColumn("manifest_reasons", reasons((F.col("_found").isNull(), "missing_from_manifest")))
        .withColumn(label, F.coalesce("_label", label))
        .drop("_label", "_found")
    )


def unused_manifest(tokens: DataFrame, manifest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Manifest rows that no token has asked for."""
    return manifest.join(tokens.select(*keys).distinct(), list(keys), "left_anti")


def unblind(reviews: DataFrame, key: DataFrame, ledger: DataFrame, blind: str, event: str) -> DataFrame:
    """Restore metadata; review ids and key ids must be the same set, key one-to-one."""
    joined = reviews.join(key, blind).join(ledger, event)
    joined = require_none(key_differences(reviews, key, [blind]), joined, "review ids and key ids differ")
    joined = require_none(duplicate_keys(key, [blind]), joined, "blind id used twice")
    return require_none(duplicate_keys(key, [event]), joined, "event has two blind ids")


def tolerance_matches(
    left: DataFrame, right: DataFrame, event: str, rank: str, time: str, tolerance: float = 1e-6
) -> DataFrame:
    """Left candidates that some source candidate of the same event meets within tolerance; the others get a reason.

    The rank is not compared: a left list may hold a part of the source's candidates. Both sides meet on time buckets of
    the tolerance's width, a source candidate in its own and the two next to it.
    """
    width = max(tolerance, 1e-9) * 2
    bucket = F.floor(F.col(time) / width)
    near = right.select(event, F.col(time).alias("_t"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_bucket"))
    meets = left.select(event, rank, time, bucket.alias("_bucket")).join(near, [event, "_bucket"]).filter(F.abs(F.col(time) - F.col("_t")) <= tolerance)
    meets = meets.select(event, rank, time).distinct().withColumn("_meets", F.lit(True))
    known = right.select(event).distinct().withColumn("_known", F.lit(True))
    out = left.join(meets, [event, rank, time], "left").join(known, event, "left")
    return out.withColumn(
        "match_reasons",
        reasons(
            (F.col("_known").isNull(), "no_source_candidate"),
            (F.col("_known").isNotNull() & F.col("_meets").isNull(), "time_differs_from_source"),
        ),
    ).withColumn("matched", passes("match_reasons")).drop("_meets", "_known")


def resolve_group(rows: DataFrame, config: DataFrame, speaker: str, own: str, interval: str) -> DataFrame:
    """Row group, else the configured group of the speaker, else the interval group.

    ``config`` is (speaker, config_group), one row per configured speaker.
    """
    out = rows.join(config, speaker, "left")
    mine, conf = F.col(own), F.col("config_group")
    return out.withColumns(
        {
            "resolved_group": F.coalesce(mine, conf, F.col(interval)),
            "group_source": F.when(mine.isNotNull(), "row").when(conf.isNotNull(), "configuration")
            .when(F.col(interval).isNotNull(), "interval").otherwise("none"),
            "group_reasons": reasons((mine.isNotNull() & conf.isNotNull() & (mine != conf), "group_mismatch")),
        }
    ).drop("config_group")


def reconcile(actual: DataFrame, expected: DataFrame, keys: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """Rows that are on one side only or differ in a column (numbers within tolerance)."""
    names = [c for c in actual.columns if c not in keys and c in expected.columns]
    types = dict(actual.dtypes)
    a = actual.select(*keys, F.struct(*names).alias("_a"))
    b = expected.select(*keys, F.struct(*names).alias("_b"))
    both = a.join(b, list(keys), "full")

    def differs(n: str) -> Column:
        x, y = F.col(f"_a.{n}"), F.col(f"_b.{n}")
        if types[n] in {"double", "float"}:
            return ~F.coalesce(F.abs(x - y) <= tolerance, x.isNull() & y.isNull())
        return ~x.eqNullSafe(y)

    present = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return both.select(
        *keys,
        reasons(
            (F.col("_b").isNull(), "unexpected"), (F.col("_a").isNull(), "missing"),
            *[(present & differs(n), f"{n}_differs") for n in names],
        ).alias("differences"),
    ).filter(F.size("differences") > 0)


def resume(events: DataFrame, done: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """Events not yet attempted under this configuration; another configuration is refused."""
    todo = events.join(done.filter(F.col("config_sha256") == fingerprint).select(key), key, "left_anti")
    other = done.filter(F.col("config_sha256") != fingerprint)
    return require_none(other, todo, "done events belong to another configuration")


def materialize_ledger(tokens: DataFrame, done: DataFrame, key: str, eligible: Column, deferred: Column) -> DataFrame:
    """Every token exactly once: processed, excluded, deferred or pending."""
    out = tokens.join(done.select(key, F.col("status").alias("_done")), key, "left")
    return out.withColumn(
        "status",
        F.when(F.col("_done").isNotNull(), F.col("_done")).when(~eligible, "excluded").when(deferred, "deferred").otherwise("pending"),
    ).drop("_done")


def run_health(ledger: DataFrame, keys: Sequence[str]) -> DataFrame:
    """FAIL iff there are target rows and all of them ended in processing_error."""
    errors = F.count_if(F.col("status") == "processing_error")
    return ledger.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), errors.alias("errors")).withColumn(
        "health", F.when((F.col("rows") > 0) & (F.col("rows") == F.col("errors")), "FAIL").otherwise("PASS")
    )


def class_counts(rows: DataFrame, label: str, allowed: DataFrame) -> DataFrame:
    """Count per allowed class, zeros included. ``allowed`` is one column named like the label."""
    counted = rows.groupBy(label).agg(F.count(F.lit(1)).alias("events"))
    return allowed.select(label).distinct().join(counted, label, "left").fillna(0, subset=["events"])


def table_checks(rows: DataFrame, keys: Sequence[str], rules: dict[str, Column], needs: dict[str, str] | None = None) -> DataFrame:
    """(position, name, violations, details, error, status, overall) of many rules of one table, from one aggregate over one scan.

    A rule is true on a bad row. ``details`` is the smallest key of a bad row as JSON; a rule that is NULL on some rows
    decides nothing about them and ends as ERROR. A rule whose prerequisite did not pass is SKIPPED. An empty table passes.
    """
    needs = needs or {}
    made = []
    for i, bad in enumerate(rules.values()):
        made += [F.count_if(bad).alias(f"_v{i}"), F.min(F.when(bad, F.struct(*keys))).alias(f"_d{i}"), F.count_if(bad.isNull()).alias(f"_u{i}")]
    found = [
        F.struct(
            F.lit(i).alias("position"), F.lit(n).alias("name"), F.col(f"_v{i}").alias("violations"), F.to_json(f"_d{i}").alias("details"),
            F.when(F.col(f"_u{i}") > 0, F.concat(F.col(f"_u{i}").cast("string"), F.lit(" rows undecided"))).alias("error"),
        )
        for i, n in enumerate(rules)
    ]
    own = {}
    for i, n in enumerate(rules):
        result = F.when(F.col(f"_u{i}") > 0, "ERROR").when(F.col(f"_v{i}") > 0, "FAIL").otherwise("PASS")
        own[n] = F.when(own[needs[n]] != "PASS", "SKIPPED").otherwise(result) if n in needs else result
    overall = F.when(F.forall(F.array(*own.values()), lambda s: s == "PASS"), "PASS").otherwise("FAIL")
    listed = F.array(*[F.struct(f.alias("c"), own[n].alias("status")) for f, n in zip(found, rules)])
    return rows.agg(*made).select(overall.alias("overall"), F.explode(listed).alias("r")).select("r.c.*", "r.status", "overall")


def run_checks(checks: dict[str, DataFrame], needs: dict[str, str] | None = None) -> DataFrame:
    """(name, violations, status) per check; a check whose prerequisite failed is skipped.

    Each check is a DataFrame of violations; prerequisites must come earlier.
    """
    needs = needs or {}
    parts = [
        v.agg(F.count(F.lit(1)).alias("violations")).select(
            F.lit(i).alias("position"), F.lit(n).alias("name"), "violations", F.lit(needs.get(n)).cast("string").alias("needs")
        )
        for i, (n, v) in enumerate(checks.items())
    ]
    table = parts[0]
    for p in parts[1:]:
        table = table.unionByName(p)
    # One row per named check: a handful of rows, whatever the data size.
    own = Window.partitionBy(F.lit(0))
    failed = F.collect_set(F.when(F.col("violations") > 0, F.col("name"))).over(own)
    done = table.withColumn("_failed", failed).withColumn(
        "status",
        F.when(F.coalesce(F.array_contains("_failed", F.col("needs")), F.lit(False)), "SKIPPED")
        .when(F.col("violations") > 0, "FAIL").otherwise("PASS"),
    )
    return done.withColumn(
        "overall", F.when(F.min(F.col("status") == "PASS").over(own), "PASS").otherwise("FAIL")
    ).select("position", "name", "violations", "status", "overall")
