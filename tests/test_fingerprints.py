"""Files above the bound of one value are hashed in rounds and give what hashlib gives."""

import gzip
import hashlib
import random

import pytest

from lagledger.sources import fingerprints as fp
from lagledger.sources import readers

MARK = b"\xef\xbb\xbf"
r = random.Random(7)
CASES = {
    "random.bin": r.randbytes(50_000),
    "ended.bin": r.randbytes(9_999) + b"\n",
    "ends at a round.bin": r.randbytes(12_000),
    "no end of line.bin": b"x" * 20_000,
    "long line.bin": r.randbytes(5_000) + b"\n" + b"\x00" * 17_000 + b"\n" + r.randbytes(3_000),
    "only ends.bin": b"\n" * 8_000,
    "crlf.bin": b"a\r\n\rb" * 3_000,
    "marked.bin": MARK + r.randbytes(7_000),
    "marked, ended.bin": MARK + MARK + b"\n" + r.randbytes(7_000) + b"\n",
    "mark at the end.bin": r.randbytes(7_000) + b"\n" + MARK,
    "odd %20#é[1].bin": r.randbytes(6_000),
    "small.bin": b"abc",
    "mark only.bin": MARK,
}


@pytest.fixture
def small_values(spark, monkeypatch):
    """Values of files above 6 400 bytes are refused, as Spark refuses those above 2 GB."""
    settings = {"spark.sql.sources.binaryFile.maxLength": "6400", "spark.sql.files.maxPartitionBytes": "2500"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    monkeypatch.setattr(fp, "WHOLE", 4_000)
    monkeypatch.setattr(fp, "BLOCK", 700)
    yield
    for key in settings:
        spark.conf.unset(key)


def test_digests_of_large_files(spark, tmp_path, small_values):
    for name, data in CASES.items():
        (tmp_path / name).write_bytes(data)
    packed = gzip.compress(r.randbytes(5_000))
    (tmp_path / "packed.bin.gz").write_bytes(packed)
    got = {x["name"]: (x["size"], x["sha256"]) for x in readers.fingerprint_files(spark, str(tmp_path / "*")).collect()}
    want = {n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in [*CASES.items(), ("packed.bin.gz", packed)]}
    assert got == want


def test_blocks_of_a_round_are_bounded(spark, tmp_path, small_values, monkeypatch):
    """One task used to read all of a file."""
    (tmp_path / "a.bin").write_bytes(r.randbytes(40_000))
    monkeypatch.setattr(fp, "shared_folder", lambda spark: str(tmp_path / "staged"))
    readers.fingerprint_files(spark, str(tmp_path / "*.bin")).collect()
    folder, = (tmp_path / "staged").iterdir()
    per_round = [x["n"] for x in spark.read.parquet(str(folder / "blocks")).groupBy("round").agg({"n": "sum"}).toDF("round", "n").collect()]
    assert len(per_round) == 10 and sum(per_round) in (40_000, 40_001) and max(per_round) <= 2 * 4_000


def test_a_state_goes_on_in_another_chain():
    import pyarrow as pa

    library = fp.openssl()
    data = r.randbytes(1_000)
    chain = fp.Chain(library)
    for at in range(0, 1_000, 77):
        chain = fp.Chain(library, chain.state())
        chain.update(pa.py_buffer(data[at : at + 77]))
    assert chain.hexdigest() == chain.hexdigest() == hashlib.sha256(data).hexdigest()
