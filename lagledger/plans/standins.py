"""How the driver tables stand for the inputs of the operators.

Time-stamped events stand for audio and visual observations of a speaker: a
user is a speaker, a click an acoustic event, a view a visual one, a week an
epoch. Lags are hours here, so thresholds are scaled where a query needs it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lagledger.functions.numeric import micros
from lagledger.operators.scan import Slicing

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US
WEEK_US = 7 * DAY_US
DAILY = Slicing(width=DAY_US)
WEEKLY = Slicing(width=WEEK_US)


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A driver table; its schema is read from the footer once per process."""
    path = f"{folder}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def stream(spark: SparkSession, folder: str, event_type: str | None = None) -> DataFrame:
    """(user_id, event_id, event_type, t in µs, value) of one event type or all."""
    events = table(spark, folder, "events")
    if event_type is not None:
        events = events.filter(F.col("event_type") == event_type)
    return events.select("user_id", "event_id", "event_type", micros("ts").alias("t"), "value")


def group_of(user: str = "user_id"):
    return F.when(F.col(user) % 3 == 0, "candidate").otherwise("control")


E_SQL = "SELECT user_id, event_id, event_type, epoch_us(ts) AS t, value FROM events"
CLICK_SQL = f"{E_SQL} WHERE event_type = 'click'"
VIEW_SQL = f"{E_SQL} WHERE event_type = 'view'"
GROUP_SQL = "CASE WHEN user_id % 3 = 0 THEN 'candidate' ELSE 'control' END"


def clips(spark: SparkSession, folder: str) -> DataFrame:
    """One 64-sample frame per row: (clip_id, frame_index, group_id, samples)."""
    return table(spark, folder, "embeddings").select(
        F.floor(F.col("vec_id") / 10).alias("clip_id"),
        (F.col("vec_id") % 10).alias("frame_index"),
        F.col("label").alias("group_id"),
        "vec_id",
        F.col("embedding").cast("array<double>").alias("samples"),
    )


CLIPS_SQL = """SELECT vec_id // 10 AS clip_id, vec_id % 10 AS frame_index, label AS group_id, vec_id,
 list_transform(embedding, lambda x: x::DOUBLE) AS samples FROM embeddings"""
