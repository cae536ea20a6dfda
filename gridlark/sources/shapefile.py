"""Polygon features out of zipped shapefiles, with bad records as counted rejects.

Archives are scanned as binary files, so any store that Spark reads will do. The index file of an archive cuts it into ranges of
records; ranges are dealt out over the cluster and read one by one, so a large archive is no task of its own after it is unpacked.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: file code, its version, the shape types without and with a polygon, sizes of the heads.
FILE_CODE, VERSION, NO_SHAPE, POLYGON = 9994, 1000, 0, 5
HEAD, RECORD_HEAD, FIELD = 100, 8, 32

_RANGE = "path string, first long, shapes binary, table binary, fields string, problem string"
_POINTS = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
_FEATURE = pa.schema([("path", pa.string()), ("record", pa.int64()), ("rings", _POINTS), ("attributes", pa.map_(pa.string(), pa.string())), ("problem", pa.string())])
_FEATURE_DDL = "path string, record long, rings array<array<struct<x:double,y:double>>>, attributes map<string,string>, problem string"


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the zip archives under a path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path).select("path", "content")


def _member(names: Iterable[str], ending: str) -> str:
    found = sorted(n for n in names if n.lower().endswith(ending))
    if len(found) != 1:
        raise ValueError(f"{len(found)} members end in {ending}")
    return found[0]


def fields_of(table: bytes) -> tuple[int, int, int, list[tuple[str, str, int]]]:
    """(records, bytes of the head, bytes of a record, fields as name, kind and width) of an attribute table."""
    n, head, width = struct.unpack_from("<IHH", table, 4)
    fields = []
    for at in range(FIELD, head - 1, FIELD):
        if table[at] == 0x0D:
            break
        fields.append((table[at : at + 11].split(b"\0")[0].decode("ascii", "replace"), chr(table[at + 11]), table[at + 16]))
    return n, head, width, fields


def record_ranges(path: str, content: bytes, size: int) -> Iterator[tuple]:
    """(path, first record, bytes of its shapes, bytes of its attributes, fields, problem) for every `size` records of an archive.

    An archive that can't be opened is one row with its problem. Each shape's bytes follow a word with their number, so that a
    wrong length in one record spoils no other; records beyond the end of the file come out empty.
    """
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            shapes, index, table = (z.read(_member(z.namelist(), e)) for e in (".shp", ".shx", ".dbf"))
        if struct.unpack_from(">i", shapes)[0] != FILE_CODE:
            raise ValueError("not a shapefile")
        n, head, width, fields = fields_of(table)
    except Exception as e:  # noqa: BLE001
        yield path, 0, None, None, None, f"archive: {type(e).__name__}: {e}"
        return
    places = np.frombuffer(index[HEAD : HEAD + (len(index) - HEAD) // 8 * 8], dtype=">i4").reshape(-1, 2).astype(np.int64) * 2
    names = "\t".join(f"{name}\0{kind}\0{wide}" for name, kind, wide in fields)
    for first in range(0, len(places), size):
        some = [shapes[a + RECORD_HEAD : a + RECORD_HEAD + b] if a >= HEAD and b >= 0 else b"" for a, b in places[first : first + size].tolist()]
        yield path, first, b"".join(struct.pack("<I", len(s)) + s for s in some), table[head + first * width : head + min(first + size, n) * width], names, None


def polygon(shape: bytes) -> list[list[tuple[float, float]]] | None:
    """Rings of a record's shape, the last point not repeated; None for a record without a shape. Raises ValueError for what can't be read."""
    if len(shape) < 4:
        raise ValueError("truncated record")
    kind = struct.unpack_from("<i", shape)[0]
    if kind == NO_SHAPE:
        return None
    if kind != POLYGON:
        raise ValueError(f"shape type {kind}")
    if len(shape) < 44:
        raise ValueError("truncated record")
    parts, points = struct.unpack_from("<ii", shape, 36)
    if parts < 1 or points < 1 or len(shape) < 44 + 4 * parts + 16 * points:
        raise ValueError("truncated record")
    starts = [*np.frombuffer(shape, "<i4", parts, 44).tolist(), points]
    xy = np.frombuffer(shape, "<f8", 2 * points, 44 + 4 * parts).reshape(-1, 2)
    if starts[0] != 0 or any(a >= b for a, b in zip(starts, starts[1:])):
        raise ValueError("parts out of order")
    if not np.isfinite(xy).all():
        raise ValueError("point without a place")
    rings = []
    for a, b in zip(starts, starts[1:]):
        if b - a < 4 or (xy[a] != xy[b - 1]).any():
            raise ValueError("ring not closed")
        rings.append([(x, y) for x, y in xy[a : b - 1].tolist()])
    return rings


def attributes(row: bytes, fields: Sequence[tuple[str, str, int]]) -> dict[str, str]:
    out, at = {}, 1
    for name, _, width in fields:
        out[name] = row[at : at + width].decode("utf-8", "replace").strip(" \0")
        at += width
    return out


def range_features(path: str, first: int, shapes: bytes, table: bytes, names: str) -> Iterator[tuple]:
    """(path, record, rings, attributes, problem) of each record of a range; a deleted record is a problem too."""
    fields = [(a, b, int(c)) for a, b, c in (f.split("\0") for f in names.split("\t"))] if names else []
    width, at, k = 1 + sum(w for _, _, w in fields), 0, 0
    while at < len(shapes):
        n = struct.unpack_from("<I", shapes, at)[0]
        row, rings, problem = table[k * width : (k + 1) * width], None, None
        try:
            rings = polygon(shapes[at + 4 : at + 4 + n])
            if rings is None:
                problem = "no shape"
            elif len(row) < width:
                problem = "no attributes"
            elif row[:1] == b"*":
                problem = "deleted"
        except ValueError as e:
            problem = str(e)
        yield path, first + k, None if problem else [[{"x": x, "y": y} for x, y in r] for r in rings], list(attributes(row, fields).items()), problem
        at, k = at + 4 + n, k + 1


def features(files: DataFrame, size: int = 5000) -> DataFrame:
    """(path, record, rings, attributes, problem) of every record of the archives (path, content); rings are null where there is a problem."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("path", pa.string()), ("first", pa.int64()), ("shapes", pa.binary()), ("table", pa.binary()), ("fields", pa.string()), ("problem", pa.string())])
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                for row in record_ranges(path, content or b"", size):  # one range a batch, so that an archive never stands twice in memory
                    yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, row))], schema=kinds)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = [(row["path"], 0, None, [], row["problem"])] if row["problem"] else range_features(row["path"], row["first"], row["shapes"], row["table"], row["fields"])
                yield pa.RecordBatch.from_pylist([dict(zip(_FEATURE.names, f)) for f in found], schema=_FEATURE)

    ranges = files.select("path", "content").mapInArrow(unpack, _RANGE)
    return ranges.repartition("path", "first").mapInArrow(read, _FEATURE_DDL)


def dated(found: DataFrame, year: int | None = None, start: str = "Start", density: str = "Density") -> DataFrame:
    """The features with their UTC day and density class, and why a record is left out, if it is (state: kept, or the reason).

    Starts look like `2020001 1546`: year, day of the year, hours and minutes. Records of a neighbouring year are left out.
    """
    day = F.expr(f"to_date(try_to_timestamp(attributes['{start}'], 'yyyyDDD HHmm'))")
    out = found.withColumn("day", day).withColumn("density", F.initcap(F.trim(F.element_at("attributes", density))))
    other = F.lit(False) if year is None else F.year("day") != year
    state = F.when(F.col("problem").isNotNull(), F.lit("unreadable")).when(F.col("day").isNull(), "no date").when(other, "other year").otherwise("kept")
    return out.withColumn("state", state)


# ---- writing, for fixtures and for handing shapes on --------------------------------------------------------------------


def packed(rows: Sequence[tuple[list, dict[str, str]]], name: str = "shapes", widths: dict[str, int] | None = None) -> bytes:
    """A zip archive of polygons (rings or None, attributes) with index and attribute table."""
    fields = widths or {k: max([len(v.encode()) for _, a in rows for v in [a[k]]] or [1]) or 1 for k in (rows[0][1] if rows else {})}
    shapes, index, table, at = [], [], [], HEAD
    for k, (rings, found) in enumerate(rows):
        if rings is None:
            body = struct.pack("<i", NO_SHAPE)
        else:
            closed = [[*r, r[0]] for r in rings]
            xy = np.array([p for r in closed for p in r], dtype="<f8").reshape(-1, 2)
            starts = np.cumsum([0, *map(len, closed)])[:-1].astype("<i4")
            body = struct.pack("<i4dii", POLYGON, *xy.min(0), *xy.max(0), len(closed), len(xy)) + starts.tobytes() + xy.tobytes()
        shapes.append(struct.pack(">ii", k + 1, len(body) // 2) + body)
        index.append(struct.pack(">ii", at // 2, len(body) // 2))
        at += len(shapes[-1])
        table.append(b" " + b"".join(found[f].encode()[:w].ljust(w) for f, w in fields.items()))
    head = lambda n: struct.pack(">i5ii", FILE_CODE, 0, 0, 0, 0, 0, n // 2) + struct.pack("<ii8d", VERSION, POLYGON, *[0.0] * 8)
    width = 1 + sum(fields.values())
    dbf = struct.pack("<4BIHH20x", 3, 0, 1, 1, len(rows), FIELD * (len(fields) + 1) + 1, width)
    dbf += b"".join(f.encode()[:10].ljust(11, b"\0") + b"C" + bytes(4) + bytes([w]) + bytes(15) for f, w in fields.items()) + b"\r" + b"".join(table) + b"\x1a"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(f"{name}.shp", head(at) + b"".join(shapes))
        z.writestr(f"{name}.shx", head(HEAD + 8 * len(index)) + b"".join(index))
        z.writestr(f"{name}.dbf", dbf)
    return out.getvalue()
