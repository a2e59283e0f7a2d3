"""Block hashes against plain hashing, in whole files and in ranges."""
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import hashing as hs

def name():
    return F.regexp_replace(F.col("path"), "^.*/", "")


def plain(data, block):
    return [hashlib.sha256(data[a:a + block]).hexdigest() for a in range(0, max(len(data), 1), block)]


def plain_root(hashes, fan):
    while len(hashes) > 1:
        hashes = [hashlib.sha256("".join(hashes[a:a + fan]).encode()).hexdigest() for a in range(0, len(hashes), fan)]
    return hashes[0]


@pytest.mark.parametrize("whole", [1 << 30, 0])
def test_block_hashes(spark, tmp_path, whole, monkeypatch):
    """Whole files and ranged reads give the same hashes; lengths around block borders, a prime one."""
    monkeypatch.setattr(hs, "TASK_BLOCKS", 3)
    rng, files = random.Random(2), {}
    for n in (1, 63, 64, 65, 192, 200, 641, 1000, 64 * 7, 4999):
        files[f"f{n}"] = rng.randbytes(n)
        (tmp_path / f"f{n}").write_bytes(files[f"f{n}"])
    if whole == 0:
        whole = 10                                             # everything but the tiniest files goes by ranges
    df = hs.block_hashes(spark, str(tmp_path), name(), block=64, whole=whole)
    got = {}
    for r in sorted(df.collect()):
        got.setdefault(r["file"], []).append(r["sha256"])
    assert got == {n: plain(d, 64) for n, d in files.items()}
    roots = {r["file"]: r["sha256"] for r in hs.roots(df, fan=4).collect()}
    assert roots == {n: plain_root(plain(d, 64), 4) for n, d in files.items()}
    assert roots["f63"] == hashlib.sha256(files["f63"]).hexdigest()


def test_one_changed_byte_names_its_block(spark, tmp_path):
    data = bytearray(random.Random(5).randbytes(1000))
    (tmp_path / "a").write_bytes(data)
    (tmp_path / "b").write_bytes(b"other")
    before = spark.createDataFrame(hs.block_hashes(spark, str(tmp_path), name(), 64, 10).collect(), hs.BLOCKS)
    assert hs.differences(before, hs.block_hashes(spark, str(tmp_path), name(), 64)).count() == 0
    data[777] ^= 1
    (tmp_path / "a").write_bytes(data)
    (tmp_path / "b").unlink()
    (tmp_path / "c").write_bytes(b"new")
    got = {tuple(r) for r in hs.differences(before, hs.block_hashes(spark, str(tmp_path), name(), 64, 10)).collect()}
    assert got == {("a", 777 // 64, "altered"), ("b", 0, "absent"), ("c", 0, "added")}


def test_divisor():
    for n in (1, 2, 12, 97, 4999, 65536, 3 * 65537, 10 ** 9):
        for most in (1, 7, 64, 1 << 16):
            assert hs.divisor(n, most) == max(d for d in range(1, min(n, most) + 1) if n % d == 0)
