"""Tagged containers written to disk and read back: whole, in chunks, deflated or not, and damaged."""

import struct

import numpy as np
import pytest

from gridlark.sources import granules as S

AOD, QA = "grid1km:Optical_Depth_055", "grid1km:AOD_QA"


def arrays(n, side=5, seed=0):
    rng = np.random.default_rng(seed)
    shape = (side, side) if n == 0 else (n, side, side)
    return {AOD: rng.integers(-28672, 5000, shape).astype("i2"), QA: rng.integers(0, 65536, shape).astype("u2"), "grid5km:AOD_QA": np.zeros((2, 2), "u2")}


@pytest.mark.parametrize("chunk", [None, (1, 5, 5), (1, 2, 3), (4, 8, 8)])
@pytest.mark.parametrize("deflate", [True, False])
@pytest.mark.parametrize("n", [0, 1, 3])
def test_round_trip(n, deflate, chunk):
    for block in (1, 8, 500):
        found = arrays(n)
        raw, word = S.planes(S.packed(found, chunk, deflate, block), AOD, QA, 5)
        assert raw.shape == word.shape == (max(n, 1), 5, 5)
        assert (raw.reshape(found[AOD].shape) == found[AOD]).all() and (word.reshape(found[QA].shape) == found[QA]).all()


def test_wrong_shapes_and_names():
    a = arrays(2)
    with pytest.raises(S.BadGranule, match="disagree"):
        S.planes(S.packed(a | {QA: a[QA][:1]}), AOD, QA)
    with pytest.raises(S.BadGranule, match="not 1200 x 1200"):
        S.planes(S.packed(a), AOD, QA, 1200)
    with pytest.raises(S.BadGranule, match="0 variables are named grid1km:AOD_QA, of 2"):
        S.planes(S.packed({AOD: a[AOD], "grid5km:AOD_QA": a[QA]}), AOD, QA)
    with pytest.raises(S.BadGranule, match="2 variables"):
        S.Container(S.packed(a)).named("AOD_QA")
    for kind in ("f4", "f8", "i1", "u1", "i4", "u4"):
        b = np.arange(6).reshape(2, 3).astype(kind)
        assert (S.Container(S.packed({"g:x": b}, (1, 2))).named("g:x") == b).all()


def test_damage_is_told():
    whole = S.packed(arrays(2), (1, 2, 2))
    with pytest.raises(S.BadGranule, match="not a tagged container"):
        S.Container(b"CDF\x01" + whole[4:])
    looped = bytearray(whole)
    struct.pack_into(">i", looped, 6, 4)
    with pytest.raises(S.BadGranule, match="chain"):
        S.Container(bytes(looped))
    for cut in range(0, len(whole), 37):  # whatever is missing, nothing but a told problem or the right planes
        try:
            raw, _ = S.planes(whole[:cut], AOD, QA)
        except (S.BadGranule, struct.error):
            continue
        assert (raw == arrays(2)[AOD]).all()
    rng = np.random.default_rng(1)
    for _ in range(200):
        hurt = bytearray(whole)
        hurt[rng.integers(4, len(hurt))] ^= 1 << rng.integers(8)
        try:
            S.planes(bytes(hurt), AOD, QA)
        except (S.BadGranule, struct.error, ValueError, MemoryError):
            pass


def test_scan_of_files(spark, tmp_path):
    want = set()
    for k in range(4):
        found = arrays(k, 6, k)
        (tmp_path / f"g{k}.hdf").write_bytes(S.packed(found, (1, 4, 4)))
        for (o, r, c), v in np.ndenumerate(found[AOD].reshape(-1, 6, 6)):
            want.add((f"g{k}.hdf", o, r, c, int(v), int(found[QA].reshape(-1, 6, 6)[o, r, c])))
    files = spark.read.format("binaryFile").load(f"file://{tmp_path}/*.hdf")
    got = S.pixels(files, side=6, lines=4).collect()
    assert {(r.path.rsplit("/", 1)[-1], r.obs, r.row, r.col, r.raw, r.quality) for r in got} == want and len(got) == len(want)
    (tmp_path / "bad.hdf").write_bytes(b"\x0e\x03\x13\x01")
    told = {r.path.rsplit("/", 1)[-1]: r for r in S.described(spark.read.format("binaryFile").load(f"file://{tmp_path}/*.hdf")).collect()}
    assert told["bad.hdf"].problem == "broken chain of descriptors" and told["g2.hdf"].shape == [2, 6, 6] and len(told["g2.hdf"].variables) == 3
    with pytest.raises(Exception, match="bad.hdf: broken chain"):
        S.pixels(spark.read.format("binaryFile").load(f"file://{tmp_path}/*.hdf")).count()
    assert S.pixels(files.where("1 = 0")).count() == 0
