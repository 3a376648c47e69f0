"""Results of a stream, each event once per configuration; a failed event becomes an error row and the run goes on."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType, LongType

DONE, FAILED = "done", "processing_error"
CONFIG, STREAM, BATCH = "config_sha256", "stream", "batch_id"
Process = Callable[[pd.DataFrame], pd.DataFrame]


class ConfigurationMismatch(ValueError):
    """The folder holds results of another configuration."""


def result_schema(made: StructType) -> StructType:
    """Columns of ``made`` with status and error."""
    return StructType([*[StructField(f.name, f.dataType) for f in made], StructField("status", StringType()), StructField("error", StringType())])


def attempt(events: DataFrame, key: str, process: Process, made: StructType) -> DataFrame:
    """One row per event: the columns of ``made`` and status ``done``, or the key, ``processing_error`` and the error.

    ``process`` takes many events as a pandas frame and returns a row for each. In events that raise together the first one
    that fails is found by halving, what lies before it is kept, and the search goes on behind it with as many events as
    lay between failures so far: an event that fails costs about log2 of that distance more calls, and no other event is
    lost. An event without a key, or for which no row comes back, is an error row as well. ``made`` must hold the key.
    """
    schema, names = result_schema(made), made.fieldNames()

    def failed(frame: pd.DataFrame, why: object) -> pd.DataFrame:
        return pd.DataFrame({**{n: [None] * len(frame) for n in names}, key: frame[key].to_numpy(), "status": FAILED, "error": why})

    def tried(frame: pd.DataFrame, seen: dict[str, int]) -> Iterator[pd.DataFrame]:
        alike: dict[tuple, list[pd.DataFrame]] = {}  # results by column types, so that none is widened
        why: dict[int, str] = {}

        def fails(first: int, stop: int) -> str | None:
            try:
                out = process(frame.iloc[first:stop])
            except Exception as error:  # whatever an event's data may raise
                return f"{type(error).__name__}: {error}"
            out = out[names]
            alike.setdefault(tuple(out.dtypes), []).append(out)
            return None

        at, size = 0, max(1, seen["events"] // seen["failed"]) if seen["failed"] else len(frame)
        while at < len(frame):
            first, stop = at, min(len(frame), at + size)
            error = fails(first, stop)
            at, size = stop, 2 * size
            if error is None:
                continue
            known = stop  # where the latest failing call ended
            while stop - first > 1:
                middle = (first + stop) // 2
                if (here := fails(first, middle)) is None:
                    first = middle
                    known = None
                else:
                    stop = known = middle
                    error = here
            if known is None:  # not yet called by itself
                error = fails(first, stop)
            if error is not None:
                why[first] = error
                seen["failed"] += 1
            at, size = stop, max(1, (seen["events"] + stop) // max(1, seen["failed"]))
        seen["events"] += len(frame)
        for parts in alike.values():
            yield pd.concat(parts, ignore_index=True).assign(status=DONE, error=None)
        if why:
            yield failed(frame.iloc[list(why)], list(why.values()))
        made_keys = {k for parts in alike.values() for part in parts for k in part[key]}
        rest = frame.drop(frame.index[list(why)])
        lost = rest[~rest[key].isin(made_keys)]
        if len(lost):
            yield failed(lost, "no result")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = {"events": 0, "failed": 0}
        for frame in frames:
            nameless = frame[key].isna()
            if nameless.any():
                yield failed(frame[nameless], "no key")
                frame = frame[~nameless]
            if len(frame):
                yield from tried(frame.reset_index(drop=True), seen)

    return events.mapInPandas(run, schema)


@dataclass(frozen=True)
class ResultSink:
    """Micro-batches to Parquet under ``folder``/configuration/stream/batch.

    A batch owns its folder and overwrites it, so a batch that is run again after a crash, in whole or in part, leaves the
    same rows. The stream's id is part of the path: it lasts as long as the checkpoint, and a stream with a new one
    starts its batches at 0 again without touching older results. Events that other batches have attempted under this
    configuration are skipped.
    """

    folder: str
    key: str
    fingerprint: str
    process: Process
    made: StructType

    def schema(self) -> StructType:
        return StructType([*result_schema(self.made).fields, StructField(CONFIG, StringType()), StructField(STREAM, StringType()), StructField(BATCH, LongType())])

    def open(self, spark: SparkSession) -> None:
        """Makes the folder where it is new; refuses results of another configuration."""
        spark.createDataFrame([], self.schema()).write.mode("append").partitionBy(CONFIG, STREAM, BATCH).parquet(self.folder)
        others = self.results(spark).filter(F.col(CONFIG) != self.fingerprint).select(CONFIG).limit(1).collect()
        if others:
            raise ConfigurationMismatch(f"{self.folder} holds results of configuration {others[0][0]}, not of {self.fingerprint}")

    def results(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema()).parquet(self.folder)

    def write(self, batch: DataFrame, stream: str, number: int) -> None:
        spark = batch.sparkSession
        known = self.results(spark).filter(F.col(CONFIG) == self.fingerprint).filter((F.col(STREAM) != stream) | (F.col(BATCH) != number))
        named = batch.filter(F.col(self.key).isNotNull()).dropDuplicates([self.key]).join(known.select(self.key), self.key, "left_anti")
        todo = named.unionByName(batch.filter(F.col(self.key).isNull()))
        made = attempt(todo.select(*batch.columns), self.key, self.process, self.made)
        made.write.mode("overwrite").parquet(f"{self.folder}/{CONFIG}={self.fingerprint}/{STREAM}={stream}/{BATCH}={number}")

    def __call__(self, batch: DataFrame, number: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        self.write(batch, stream, number)


def resume_stream(
    events: DataFrame, key: str, folder: str, checkpoint: str, fingerprint: str, process: Process, made: StructType
) -> tuple[StreamingQuery, DataFrame]:
    """Process what the stream has and the checkpoint has not seen; returns the ended query and all results so far.

    Results hold the columns of ``made``, status, error, config_sha256, stream and batch_id. Start it again with the same
    ``checkpoint`` to go on where it stopped; a folder with results of another ``fingerprint`` is refused before any
    event is read.
    """
    sink = ResultSink(folder, key, fingerprint, process, made)
    sink.open(events.sparkSession)
    query = events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query, sink.results(events.sparkSession)
