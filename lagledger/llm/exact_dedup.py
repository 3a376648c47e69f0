"""Exact duplicates by skew-safe combining, whole content compared at every stage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagledger.llm.common import own_names
from lagledger.session import broadcast_if_small, cut_lineage

SALTS = 16
MOST_SENT = 4_000_000  # ids that may go to every executor; more are shuffled


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256.

    Texts are equal when every character is; null counts as empty; of equal texts the largest id stays.

    1. Local: each map task combines its own rows by (digest, salt, text). The salt is the task's number modulo
       ``salts``, so a group with a third of all rows leaves each task as one row and meets in ``salts`` places.
    2. Salted groups are merged by (digest, salt, text).
    3. The winners of the salts meet by digest and are combined by (digest, text).

    The text is part of the grouping key each time, so two texts with one digest stay apart. Only the digest returns to
    the rows (AQE splits the partition of a hot digest); digests that hold several texts take the text along as well.

    Edge cases: no rows give no rows; rows that repeat an id and a text count as rows of their own and get equal
    results; a null id never wins against a given one; other columns are ignored, whatever their names.
    """
    base = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    base = base.withColumn("__digest", F.sha2("__text", 256))
    salted = (
        base.withColumn("__salt", F.spark_partition_id() % salts)
        .groupBy("__digest", "__salt", "__text")
        .agg(F.max("__id").alias("__keep"), F.count(F.lit(1)).alias("__n"))
    )
    winners = salted.repartition("__digest").groupBy("__digest", "__text").agg(F.max("__keep").alias("__keep"), F.sum("__n").alias("__n"))
    by_digest = cut_lineage(
        winners.groupBy("__digest").agg(F.max("__keep").alias("__keep"), F.max("__n").alias("__n"), F.count(F.lit(1)).alias("__texts"))
    )
    one = by_digest.filter("__texts = 1").drop("__texts")
    rows = base.select("__id", "__digest").join(one, "__digest")
    shared = by_digest.filter("__texts > 1").select("__digest")
    if not shared.isEmpty():
        few = base.join(shared, "__digest", "left_semi")
        sizes = few.groupBy("__digest", "__text").agg(F.max("__id").alias("__keep"), F.count(F.lit(1)).alias("__n"))
        rows = rows.unionByName(few.join(sizes, ["__digest", "__text"]).drop("__text"))
    return rows.select(
        F.col("__id").alias(id_col),
        F.col("__keep").alias("keep_id"),
        F.col("__n").alias("group_size"),
        F.col("__id").eqNullSafe(F.col("__keep")).alias("kept"),
        F.col("__digest").alias("text_sha256"),
    )


@own_names
def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_groups` keeps, with all their columns; of rows that repeat an id and a text, one.

    An id without a kept row goes as a whole, so only ids go against the rows. They are sent to the texts where they are
    few, and meet them in a shuffle otherwise. Rows of an id with several rows, one of them kept, go by id and digest;
    null counts as an id there.
    """
    groups = cut_lineage(exact_groups(docs, id_col, text_col).select(F.col(id_col).alias("__id"), "kept", F.col("text_sha256").alias("__sha")))
    fates = groups.groupBy("__id").agg(F.max("kept").alias("__some"), F.count(F.lit(1)).alias("__rows")).filter("NOT __some OR __rows > 1")
    fates = cut_lineage(fates)
    same = docs[id_col].eqNullSafe(F.col("__id"))
    rows = docs.join(broadcast_if_small(fates.filter("NOT __some").select("__id"), MOST_SENT), same, "left_anti")
    several = fates.filter("__some").select("__id")
    if several.isEmpty():
        return rows
    several = broadcast_if_small(several, MOST_SENT)
    text = F.coalesce(F.col(text_col), F.lit(""))
    mixed = rows.join(several, same, "left_semi").withColumn("__text", text).withColumn("__digest", F.sha2("__text", 256))
    known = several.withColumnRenamed("__id", "__several")
    pairs = groups.join(known, F.col("__id").eqNullSafe(F.col("__several")), "left_semi").groupBy("__id", "__sha")
    pairs = cut_lineage(pairs.agg(F.max("kept").alias("__kept"), F.count(F.lit(1)).alias("__rows")).filter("NOT __kept OR __rows > 1"))
    both = same & (F.col("__digest") == F.col("__sha"))
    mixed = mixed.join(pairs.filter("NOT __kept"), both, "left_anti")
    twice = pairs.filter("__kept")
    once = mixed.join(twice, both, "left_anti").unionByName(mixed.join(twice, both, "left_semi").dropDuplicates([id_col, "__text"]))
    return rows.join(several, same, "left_anti").unionByName(once.drop("__text", "__digest"))
