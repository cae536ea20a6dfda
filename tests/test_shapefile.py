"""Zipped shapefiles written to disk and read back: whole, by ranges, and damaged."""

import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from gridlark.sources import shapefile as S

SQUARE = [[(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0)], [(0.5, 0.5), (1.0, 0.5), (1.0, 1.0)]]


def rows(n):
    return [(None if k == 7 else [[(x + k, y) for x, y in r] for r in SQUARE], {"Start": f"2020{k % 366 + 1:03d} 1546", "Density": [" heavy", "LIGHT", "Medium"][k % 3], "Satellite": f"é{k}"}) for k in range(n)]


def changed(archive, ending, change):
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(archive)) as old, zipfile.ZipFile(out, "w") as new:
        for name in old.namelist():
            data = bytearray(old.read(name))
            new.writestr(name, bytes(change(data) or data) if name.endswith(ending) else bytes(data))
    return out.getvalue()


def test_round_trip_by_ranges(spark, tmp_path):
    found = rows(60)
    (tmp_path / "a.zip").write_bytes(S.packed(found))
    (tmp_path / "b.zip").write_bytes(S.packed(found[:3]))
    (tmp_path / "notes.txt").write_text("not an archive")
    files = S.archives(spark, f"file://{tmp_path}")
    whole = [tuple(r) for r in S.features(files).orderBy("path", "record").collect()]
    for size in (1, 7, 30):
        assert [tuple(r) for r in S.features(files, size).orderBy("path", "record").collect()] == whole
    assert len(whole) == 63 and [r[1] for r in whole] == [*range(60), *range(3)]
    for (path, k, rings, attributes, problem), (want, table) in zip(whole, found + found[:3]):
        assert attributes == {n: v.strip() for n, v in table.items()}
        assert problem == ("no shape" if want is None else None)
        assert (rings and [[(p["x"], p["y"]) for p in r] for r in rings]) == want


def test_damaged_records_spoil_no_others(spark, tmp_path):
    archive = S.packed(rows(8)[:7])
    size = struct.unpack_from(">i", zipfile.ZipFile(io.BytesIO(archive)).read("shapes.shp"), S.HEAD + 4)[0] * 2 + S.RECORD_HEAD

    def damage(data):
        at = lambda k: S.HEAD + k * size + S.RECORD_HEAD
        struct.pack_into("<d", data, at(1) + 44 + 8, 99.0)  # its first ring doesn't close
        struct.pack_into("<i", data, at(2), 3)  # a line
        struct.pack_into("<i", data, at(3) + 40, 10**6)  # more points than there are
        struct.pack_into("<d", data, at(4) + 44 + 8 + 16, float("nan"))
        struct.pack_into("<i", data, at(5) + 44 + 4, 0)  # an empty part
        return data[: at(6) + 50]

    def deleted(data):
        _, head, width, _ = S.fields_of(bytes(data))
        data[head] = ord("*")

    (tmp_path / "x.zip").write_bytes(changed(archive, ".shp", damage))
    (tmp_path / "y.zip").write_bytes(changed(archive, ".dbf", deleted))
    (tmp_path / "z.zip").write_bytes(b"PK not really")
    (tmp_path / "w.zip").write_bytes(changed(archive, ".shp", lambda data: data[:40] and b"\0" * 200))
    got = {(r["path"][-5], r["record"]): r["problem"] for r in S.features(S.archives(spark, f"file://{tmp_path}"), 2).collect()}
    assert {k: got["x", k] for k in range(7)} == {0: None, 1: "ring not closed", 2: "shape type 3", 3: "truncated record", 4: "point without a place", 5: "parts out of order", 6: "truncated record"}
    assert [got["y", k] for k in range(7)] == ["deleted", *[None] * 6]
    assert got["z", 0].startswith("archive: BadZipFile") and got["w", 0] == "archive: ValueError: not a shapefile"


def test_days_and_classes(spark, tmp_path):
    found = rows(6)
    found[1][1]["Start"] = "2021001 0000"
    found[2][1]["Start"] = "2020400 1546"
    found[3][1]["Start"] = ""
    found[5][1]["Start"] = "2020060 2359"
    (tmp_path / "a.zip").write_bytes(S.packed(found))
    got = S.dated(S.features(S.archives(spark, f"file://{tmp_path}")), 2020).orderBy("record").collect()
    assert [r["state"] for r in got] == ["kept", "other year", "no date", "no date", "kept", "kept"]
    assert [str(r["day"]) for r in got if r["state"] == "kept"] == ["2020-01-01", "2020-01-05", "2020-02-29"]
    assert [r["density"] for r in got] == ["Heavy", "Light", "Medium"] * 2
    empty = S.dated(S.features(S.archives(spark, f"file://{tmp_path}").where(F.lit(False))))
    assert empty.count() == 0


@pytest.mark.parametrize("shape", [b"", b"\0\0", struct.pack("<i", 5), struct.pack("<i4dii", 5, 0, 0, 0, 0, 0, 0)])
def test_truncated_shapes(shape):
    with pytest.raises(ValueError, match="truncated record"):
        S.polygon(shape)
