"""SHA-256 of files that are too large for one task: their bytes in rounds, the hash state handed from round to round."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagledger.session import shared_folder

WHOLE = 128 << 20  # bytes of a file up to which it is one value of one task, and of a larger file's round
LARGEST_VALUE = (1 << 31) - 1  # Spark's own bound of one value
BLOCK = 1 << 20
STATE_BYTES = 112  # SHA256_CTX of openssl/sha.h, plain memory
MARK = b"\xef\xbb\xbf"  # the text source leaves it out at the start of a file
# Spark's text source unpacks these, so they are hashed as one value.
PACKED = r"\.(gz|bz2|deflate|lz4|snappy|zst|passthrough)$"


def openssl() -> ctypes.CDLL | None:
    """The OpenSSL that hashlib itself uses; None where Python has none or it lacks the plain SHA-256 calls."""
    try:
        import _hashlib

        library = ctypes.CDLL(_hashlib.__file__)
        return library if all(hasattr(library, f"SHA256_{call}") for call in ("Init", "Update", "Final")) else None
    except (ImportError, AttributeError, OSError):
        return None


class Chain:
    """SHA-256 that goes on from a state kept as bytes (hashlib gives its state to nobody)."""

    def __init__(self, library: ctypes.CDLL, state: bytes | None = None):
        self._library = library
        self._context = ctypes.create_string_buffer(state or b"", STATE_BYTES)
        if state is None:
            library.SHA256_Init(self._context)

    def update(self, data: pa.Buffer) -> None:
        self._library.SHA256_Update(self._context, ctypes.c_void_p(data.address), ctypes.c_size_t(data.size))

    def state(self) -> bytes:
        return self._context.raw

    def hexdigest(self) -> str:
        digest = ctypes.create_string_buffer(32)
        self._library.SHA256_Final(digest, ctypes.create_string_buffer(self.state(), STATE_BYTES))
        return digest.raw.hex()


def in_one_value(limit: int) -> Column:
    """Files hashed as one value (a filter that Spark applies to the list of files)."""
    return (F.col("_metadata.file_size") <= limit) | F.col("_metadata.file_path").rlike(PACKED)


def _blocks(per_round: int):
    """Kernel: the lines of each split, ends included, as blocks of bytes with their place and round.

    A block that runs past its split's end stays in the last round of the split, so rounds rise with the order of bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            paths, starts, sizes, lines = (batch.column(c) for c in ("path", "start", "size", "line"))
            wide = np.int64 if pa.types.is_large_binary(lines.type) else np.int32
            _, offsets, data = lines.buffers()
            offsets = np.frombuffer(offsets, wide)[lines.offset : lines.offset + len(lines) + 1]
            ends = sorted({e for c in (paths, starts) for e in pc.run_end_encode(c).run_ends.to_pylist()})
            for first, end in zip([0, *ends], ends):
                split = (paths[first].as_py(), starts[first].as_py())
                if split != last:
                    last, seen = split, 0
                rows = []
                for at in range(int(offsets[first]), int(offsets[end]), BLOCK):
                    n = min(BLOCK, int(offsets[end]) - at)
                    position = split[1] + min(seen, sizes[first].as_py() - 1)
                    rows.append((*split, seen, n, position // per_round, data.slice(at, n).to_pybytes()))
                    seen += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), *[pa.int64()] * 4, pa.binary()))], ["path", "start", "place", "n", "round", "block"]
                )

    return run


def _advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kernel: one round's blocks of each file, in order, into the state they come with."""
    library = openssl()
    if library is None:
        raise RuntimeError("an executor's Python has no OpenSSL with plain SHA-256 calls")
    path = chain = None
    size = done = 0

    def result() -> pa.RecordBatch:
        digest = chain.hexdigest() if done == size else None
        return pa.RecordBatch.from_arrays(
            [pa.array([path], pa.string()), pa.array([chain.state()], pa.binary()), pa.array([done], pa.int64()), pa.array([digest], pa.string())],
            ["path", "new_state", "new_done", "new_sha256"],
        )

    for batch in batches:
        for i, own in enumerate(batch.column("path").to_pylist()):
            if own != path:
                if chain is not None:
                    yield result()
                path, size, done, state, marked = (batch.column(c)[i].as_py() for c in ("path", "size", "done", "state", "marked"))
                chain = Chain(library, state)
                if state is None and marked:
                    chain.update(pa.py_buffer(MARK))
                    done = len(MARK)
            block = batch.column("block")[i].as_buffer()
            # The last line of a file got an end that may not be there.
            block = block.slice(0, min(block.size, size - done))
            chain.update(block)
            done += block.size
    if chain is not None:
        yield result()


def chained_digests(spark: SparkSession, glob: str, large: DataFrame, limit: int) -> DataFrame:
    """(path, sha256) of the files ``large`` (path, size), whose sizes are above ``limit``.

    The text source reads a file in splits by any path that Spark opens; lines end at byte 10 alone, and their bytes stay as
    they are. Blocks are staged by round, about ``limit`` bytes of each file; a round reads its own blocks only and takes the
    states of the round before, so no task reads much more than that of a file, and the whole is read a fixed number of
    times. A stretch without byte 10 is one line, in one task, of at most 2 GB.
    """
    sizes = [r["size"] for r in large.select("size").collect()]  # of total / limit files at most
    lines = spark.read.option("lineSep", "\n").text(glob).filter(~in_one_value(limit)).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_block_length").alias("size"),
        F.concat("value", F.lit("\n")).cast("binary").alias("line"),
    )
    folder = f"{shared_folder(spark).rstrip('/')}/fingerprints-{uuid.uuid4().hex}"
    schema = "path string, start long, place long, n long, round long, block binary"
    lines.mapInArrow(_blocks(limit), schema).write.option("compression", "none").partitionBy("round").parquet(f"{folder}/blocks")
    staged = spark.read.schema(schema).parquet(f"{folder}/blocks")

    def kept(states: DataFrame, name: str) -> DataFrame:
        """Written once; a checkpoint would compute the round twice."""
        states.write.parquet(f"{folder}/{name}")
        return spark.read.schema(states.schema).parquet(f"{folder}/{name}")

    # Bytes that the lines lack: a mark at the start (3), less the end after a last line without one (1).
    lacking = F.col("size") - F.col("held")
    checked = F.when(~lacking.isin(-1, 0, 2, 3), F.raise_error(F.concat(F.lit("bytes missing or changed in "), "path")).cast("boolean")).otherwise(lacking >= 2)
    held = staged.groupBy("path").agg(F.sum("n").alias("held"))
    states = kept(
        large.select("path", "size").join(held, "path", "left").fillna(0, subset=["held"]).select(
            "path", "size", checked.alias("marked"), F.lit(None).cast("binary").alias("state"), F.lit(0).cast("long").alias("done"), F.lit(None).cast("string").alias("sha256")
        ),
        "before",
    )
    for k in range(-(-max(sizes) // limit)):
        going = F.broadcast(states.filter(F.col("sha256").isNull()).drop("sha256"))
        tasks = 2 * sum(s > k * limit for s in sizes)
        blocks = staged.filter(F.col("round") == k).join(going, "path").repartition(tasks, "path").sortWithinPartitions("path", "start", "place")
        new = blocks.mapInArrow(_advance, "path string, new_state binary, new_done long, new_sha256 string")
        own = ["state", "done", "sha256"]
        # One row per large file.
        states = kept(states.join(F.broadcast(new), "path", "left").select("path", "size", "marked", *[F.coalesce(f"new_{c}", c).alias(c) for c in own]), f"after{k}")
    missing = F.raise_error(F.concat(F.lit("bytes missing or changed in "), "path")).cast("string")
    return states.select("path", F.coalesce("sha256", missing).alias("sha256"))
