"""Shards that each match the mixture of sources: proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagledger.llm.common import HASH_BITS, cells_for, draw, key_of, running, text_of
from lagledger.session import cut_lineage


def interleaved_shards(
    docs: DataFrame, shards: int = 24, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """One row per input row: ``id_col``, source, size, text_crc32, law, shard, slot, grown_shard.

    Rows of each source are shuffled by a seeded draw and ranked; rank r of n gets the fraction (2r - 1) / 2n; all rows
    sorted by fraction are cut into ``shards`` runs whose row counts differ by one at most (law ``rows``). Each run
    then holds every source in its share of the whole, to within one row.

    Both orders are cut into cells, so neither a hot source nor the whole table is ordered in one task.

    Edge cases: a null text has size 8; null sources form a stratum of their own; rows that repeat an id are ranked one
    after the other; with fewer rows than shards some shards stay empty; other columns are ignored.
    """
    text = text_of(text_col)
    rows = cut_lineage(
        docs.select(
            F.col(id_col).alias("__id"),
            F.col(source_col).alias("__source"),
            key_of(F.col(source_col)).alias("__key"),
            (F.octet_length(text) + 8).cast("long").alias("__size"),
            F.crc32(text.cast("binary")).alias("__crc"),
            draw(seed, F.col(id_col)).alias("__draw"),
        )
    )
    total = rows.count()
    cells = cells_for(total)
    ties = ["__draw", "__id", "__size", "__crc"]
    rows = rows.withColumn("__cell", F.floor(F.col("__draw") / (1 << HASH_BITS) * cells))
    rows = running(rows, ["__key"], "__cell", ties, {"__before": F.lit(1)}).drop("__cell")
    sizes = rows.groupBy("__key").agg(F.count(F.lit(1)).alias("__rows"))
    rows = rows.join(sizes, "__key").withColumn("__fraction", (2 * F.col("__before") + 1) / (2 * F.col("__rows")))
    rows = rows.withColumn("__cell", F.least(F.floor(F.col("__fraction") * cells), F.lit(cells - 1)))
    rows = running(rows, [], "__cell", ["__fraction", "__draw", "__id", "__key"], {"__rank": F.lit(1)})
    shard = F.expr(f"(__rank * {shards}) div {max(total, 1)}")
    first = F.expr(f"(__shard * {max(total, 1)} + {shards - 1}) div {shards}")
    return rows.withColumn("__shard", shard).select(
        F.col("__id").alias(id_col),
        F.col("__source").alias("source"),
        F.col("__size").alias("size"),
        F.col("__crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("__shard").cast("int").alias("shard"),
        (F.col("__rank") - first).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
