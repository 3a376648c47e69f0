"""Chunk continuity as running state per source."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "source long, chunk_id long, missing_pts boolean, gap boolean, overlap boolean, reversed boolean"


class GapProcessor(StatefulProcessor):
    """State: end of everything before and start of the last chunk (three numbers per source).

    A micro-batch hands over a source's rows in pieces; they are put in chunk
    order first, so keep micro-batches small (``maxFilesPerTrigger``).
    """

    def __init__(self, tolerance: int) -> None:
        self.tolerance = tolerance

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "end long, start long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.last.get() if self.last.exists() else None
        end, start = (known[0], known[1]) if known else (None, None)
        out = []
        for r in pd.concat(list(rows)).sort_values("chunk_id").itertuples(index=False):
            missing = pd.isna(r.start)
            begin = end if missing else int(r.start)
            if begin is None:
                out.append((int(key[0]), int(r.chunk_id), True, False, False, False))
                continue
            delta = 0 if end is None else begin - end
            overlap = end is not None and delta < -self.tolerance
            out.append(
                (
                    int(key[0]), int(r.chunk_id), bool(missing), end is not None and delta > self.tolerance, overlap,
                    not missing and start is not None and begin < start,
                )
            )
            stop = begin + int(r.duration)
            start = min(end, stop) if overlap else begin
            end = stop if end is None else max(end, stop)
        if end is not None:
            self.last.update((end, start))
        yield pd.DataFrame(out, columns=["source", "chunk_id", "missing_pts", "gap", "overlap", "reversed"])

    def close(self) -> None:
        pass


def stream_gaps(chunks: DataFrame, tolerance: int) -> DataFrame:
    """Stream of (source, chunk_id, start, duration) to chunk flags. Needs the RocksDB state store."""
    return chunks.groupBy("source").transformWithStateInPandas(
        statefulProcessor=GapProcessor(tolerance), outputStructType=OUTPUT, outputMode="Append", timeMode="None"
    )
