"""Readers for nested event documents, keyed CSV, clip manifests and file fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lagledger.functions import text as tx
from lagledger.operators.ledger import duplicate_keys, require_none
from lagledger.operators.scan import Slicing, scan
from lagledger.sources import fingerprints as fp

# Default group colours, used in order of first appearance.
DEFAULT_COLORS = ("#0072B2", "#D55E00", "#009E73", "#CC79A7", "#E69F00", "#56B4E9", "#6A3D9A", "#A6761D")


def events_of(documents: DataFrame, raw: str, element: str, list_keys: Sequence[str] = ("events", "annotations"), ident: str | None = None) -> DataFrame:
    """Events of JSON documents held as text: the first alias that holds a list wins.

    A document without any list fails the query. ``element`` is the DDL of one
    event.
    """
    doc = F.try_parse_json(raw)
    lists = [F.try_variant_get(doc, f"$.{k}", f"array<{element}>") for k in list_keys]
    found = F.coalesce(*lists)
    checked = F.when(found.isNull(), F.raise_error(F.lit("document holds no event list")).cast(f"array<{element}>")).otherwise(found)
    keep = [ident] if ident else []
    return documents.select(*keep, F.posexplode(checked).alias("position", "event")).select(*keep, "position", "event.*")


def read_events(spark: SparkSession, path: str, element: str, list_keys: Sequence[str] = ("events", "annotations")) -> DataFrame:
    """Nested JSON documents from files, one document per file."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    return events_of(files, "value", element, list_keys, "file")


def read_keyed_csv(spark: SparkSession, path: str, key: str, schema: StructType | str | None = None) -> DataFrame:
    """Header CSV whose key is present, non-blank and unique; an empty file fails."""
    reader = spark.read.option("header", True)
    rows = (reader.schema(schema) if schema is not None else reader).csv(path)
    if key not in rows.columns:
        raise ValueError(f"CSV has no column {key}")
    rows = rows.withColumn(key, F.trim(F.col(key).cast("string")))
    blank = rows.filter(F.col(key).isNull() | (F.col(key) == ""))
    empty = rows.agg(F.count(F.lit(1)).alias("n")).filter("n = 0")
    out = require_none(blank, rows, "blank key in CSV")
    out = require_none(duplicate_keys(rows, [key]), out, "duplicate key in CSV")
    return require_none(empty, out, "CSV has no rows")


def normalize_manifest(clips: DataFrame, groups: DataFrame | None, position: str, common_source: str | None = None) -> DataFrame:
    """Clip rows with old and new field names to one form, with group order and colour.

    Groups are ordered by first appearance among the clips; a group without a
    colour takes the next default.
    """
    have = set(clips.columns)
    pick = lambda *names: F.coalesce(*[F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in have], F.lit(None))
    base = clips.select(
        position, pick("clip_id", "id").alias("clip_id"), pick("group_id", "group").alias("group_id"), pick("clip_label", "label").alias("_label"),
        pick("display_color_hex", "group_color_hex").alias("_color"), F.coalesce(pick("source"), F.lit(common_source)).alias("source"),
        F.coalesce(pick("start_s").try_cast("double"), F.lit(0.0)).alias("start_s"), pick("end_s").try_cast("double").alias("end_s"),
    )
    first = base.groupBy("group_id").agg(
        F.min(position).alias("_first"), F.max(tx.valid_color("_color")).alias("_own"),
        (F.min(tx.valid_color("_color")) != F.max(tx.valid_color("_color"))).alias("_mixed"),
    )
    if groups is not None:
        first = first.join(groups.select("group_id", tx.valid_color("color").alias("_listed")), "group_id", "left")
    else:
        first = first.withColumn("_listed", F.lit(None).cast("string"))
    placed = scan(first, [], "_first", Slicing(width=1_000_000), index="group_order")
    default = F.get(F.array(*[F.lit(c) for c in DEFAULT_COLORS]), (F.col("group_order") % len(DEFAULT_COLORS)).cast("int"))
    named = placed.select("group_id", "group_order", F.coalesce("_own", "_listed", default).alias("display_color_hex"), "_mixed")
    from lagledger.operators.rules import reasons

    return base.join(named, "group_id").withColumn("clip_label", F.coalesce("_label", "clip_id")).withColumn(
        "manifest_reasons",
        reasons(
            (~F.coalesce(tx.valid_id("clip_id"), F.lit(False)), "invalid clip id"),
            (~F.coalesce(tx.valid_id("group_id"), F.lit(False)), "invalid group id"),
            (F.col("_color").isNotNull() & tx.valid_color("_color").isNull(), "invalid colour"),
            (F.col("_mixed"), "inconsistent group colours"), (F.col("source").isNull(), "no source"),
            ((F.col("start_s") < 0) | (F.col("end_s") <= F.col("start_s")), "invalid interval"),
        ),
    ).drop("_label", "_color", "_mixed")


def fingerprint_files(spark: SparkSession, glob: str) -> DataFrame:
    """Name, size, modification time and SHA-256 of every file that is not empty (contents stay on the executors).

    A file of up to ``fingerprints.WHOLE`` bytes is one value of one task; the bytes of a larger one are hashed in rounds
    (:mod:`lagledger.sources.fingerprints`), whatever its size. Packed files (.gz and the like), and all files where Python
    has no OpenSSL, stay one value, which Spark bounds by 2 GB.
    """
    limit = fp.WHOLE if fp.openssl() else fp.LARGEST_VALUE
    files = spark.read.format("binaryFile").load(glob)
    about = [F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")]
    whole = files.filter(fp.in_one_value(limit)).select(*about, F.sha2("content", 256).alias("sha256"))
    large = files.filter(~fp.in_one_value(limit)).select(F.col("_metadata.file_path").alias("path"), *about)
    if large.isEmpty():
        return whole
    return whole.unionByName(large.join(fp.chained_digests(spark, glob, large, limit), "path").drop("path"))
