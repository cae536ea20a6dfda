"""Science granules: named planes out of tagged containers with chained descriptors, chunks and deflate.

A container starts with its magic number and a chain of descriptor blocks; each descriptor gives an element's tag, number, place
and length (all big-endian). Groups list their members and have a name and a class; a variable's group holds a numeric group, which
holds its dimensions and its data. Data stand there as they are, deflated, or in chunks that a table lists, each deflated or not.
Files are scanned as binary files; a granule's pixels leave it a few lines at a time.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format: magic number, tags of elements, the bit of a special element and its kinds, the coder for deflate.
MAGIC = b"\x0e\x03\x13\x01"
NOTHING, NUMBER_TYPE, COMPRESSED, CHUNK, NUMERIC_GROUP, DIMENSIONS, DATA, TABLE_HEAD, TABLE, GROUP = 1, 106, 40, 61, 720, 701, 702, 1962, 1963, 1965
SPECIAL, IS_COMPRESSED, IS_CHUNKED, DEFLATE = 0x4000, 3, 5, 4
KINDS = {5: "f4", 6: "f8", 20: "i1", 21: "u1", 22: "i2", 23: "u2", 24: "i4", 25: "u4"}
LITTLE_ENDIAN = 4
#: Groups that stand between a grid and its variables and are no part of a name.
BETWEEN = frozenset({"Data Fields", "Geolocation Fields", "Grid Attributes"})


class BadGranule(ValueError):
    """A container that can't be read, or without the planes asked for."""


class Container:
    """The elements of a container in memory."""

    def __init__(self, content: bytes):
        if content[:4] != MAGIC:
            raise BadGranule("not a tagged container")
        self.content, self.places, self.special = content, {}, set()
        at, seen = 4, set()
        while at:
            if at in seen or at + 6 > len(content):
                raise BadGranule("broken chain of descriptors")
            seen.add(at)
            n, following = struct.unpack_from(">hi", content, at)
            if n < 0 or at + 6 + 12 * n > len(content):
                raise BadGranule("broken chain of descriptors")
            for tag, ref, place, size in struct.iter_unpack(">HHii", content[at + 6 : at + 6 + 12 * n]):
                if tag & ~SPECIAL != NOTHING:
                    self.places[tag & ~SPECIAL, ref] = (place, size)
                    if tag & SPECIAL:
                        self.special.add((tag & ~SPECIAL, ref))
            at = following

    def element(self, tag: int, ref: int) -> bytes:
        place, size = self.places.get((tag, ref), (-1, -1))
        if place < 0 or size < 0 or place + size > len(self.content):
            raise BadGranule(f"element {tag}/{ref} is missing or cut off")
        return self.content[place : place + size]

    def groups(self) -> dict[int, tuple[str, str, list[tuple[int, int]]]]:
        """Of each group its name, class and members."""
        out = {}
        for tag, ref in self.places:
            if tag == GROUP:
                raw = self.element(tag, ref)
                n = struct.unpack_from(">H", raw)[0]
                tags, refs = struct.unpack_from(f">{n}H", raw, 2), struct.unpack_from(f">{n}H", raw, 2 + 2 * n)
                name, at = self._text(raw, 2 + 4 * n)
                kind, _ = self._text(raw, at)
                out[ref] = name, kind, list(zip(tags, refs))
        return out

    @staticmethod
    def _text(raw: bytes, at: int) -> tuple[str, int]:
        n = struct.unpack_from(">H", raw, at)[0]
        return raw[at + 2 : at + 2 + n].decode("utf-8", "replace"), at + 2 + n

    def variables(self) -> dict[str, int]:
        """The number of each variable's numeric group by its full name: the groups around it, from the outside in."""
        groups = self.groups()
        around = {ref: outer for outer, (_, _, members) in groups.items() for tag, ref in members if tag == GROUP}
        out = {}
        for ref, (name, _, members) in groups.items():
            for tag, inner in members:
                if tag == NUMERIC_GROUP:
                    parts, at = [name], around.get(ref)
                    while at is not None and len(parts) < 32:
                        parts.append(groups[at][0])
                        at = around.get(at)
                    out[":".join(p for p in reversed(parts) if p not in BETWEEN)] = inner
        return out

    def named(self, ending: str) -> np.ndarray:
        """The one variable whose name ends so; the same field of another grid has another ending."""
        found = [v for name, v in self.variables().items() if name == ending or name.endswith(":" + ending)]
        if len(found) != 1:
            raise BadGranule(f"{len(found)} variables are named {ending}, of {len(self.variables())}")
        return self.array(found[0])

    def array(self, group: int) -> np.ndarray:
        members = dict(struct.iter_unpack(">HH", self.element(NUMERIC_GROUP, group)))
        if DIMENSIONS not in members or DATA not in members:
            raise BadGranule(f"variable {group} has no data")
        raw = self.element(DIMENSIONS, members[DIMENSIONS])
        rank = struct.unpack_from(">h", raw)[0]
        shape = struct.unpack_from(f">{rank}i", raw, 2)
        tag, ref = struct.unpack_from(">HH", raw, 2 + 4 * rank)
        _, kind, _, order = self.element(tag, ref)[:4]
        if kind not in KINDS:
            raise BadGranule(f"number type {kind}")
        dtype = np.dtype(("<" if order == LITTLE_ENDIAN else ">") + KINDS[kind])
        return self._values(DATA, members[DATA], shape, dtype).reshape(shape)

    def _bytes(self, tag: int, ref: int) -> bytes:
        """An element's bytes, inflated if it is a compressed one."""
        raw = self.element(tag, ref)
        if (tag, ref) not in self.special:
            return raw
        code, _, size, inner, _, coder = struct.unpack_from(">hhiHHH", raw)
        if code != IS_COMPRESSED or coder != DEFLATE:
            raise BadGranule(f"special element of kind {code}, coder {coder}")
        try:
            out = zlib.decompress(self.element(COMPRESSED, inner))
        except zlib.error as e:
            raise BadGranule(f"element {tag}/{ref}: {e}") from e
        if len(out) != size:
            raise BadGranule(f"element {tag}/{ref} holds {len(out)} bytes, not {size}")
        return out

    def _values(self, tag: int, ref: int, shape: Sequence[int], dtype: np.dtype) -> np.ndarray:
        raw = self.element(tag, ref)
        if (tag, ref) in self.special and struct.unpack_from(">h", raw)[0] == IS_CHUNKED:
            return self._chunks(raw, shape, dtype)
        found = self._bytes(tag, ref)
        if len(found) != int(np.prod(shape)) * dtype.itemsize:
            raise BadGranule(f"{len(found)} bytes of data for shape {tuple(shape)}")
        return np.frombuffer(found, dtype)

    def _chunks(self, raw: bytes, shape: Sequence[int], dtype: np.dtype) -> np.ndarray:
        """Chunks put in their places; those that the table doesn't list hold the fill value."""
        head = struct.unpack_from(">hiBiiiiHHHHi", raw)
        table, rank = (head[7], head[8]), head[11]
        at = struct.calcsize(">hiBiiiiHHHHi")
        sizes = [struct.unpack_from(">iii", raw, at + 12 * k)[2] for k in range(rank)]
        at += 12 * rank
        fill = raw[at + 4 : at + 4 + struct.unpack_from(">i", raw, at)[0]]
        if rank != len(shape) or min(sizes, default=1) < 1 or table[0] != TABLE_HEAD:
            raise BadGranule("broken head of chunks")
        out = np.full(shape, np.frombuffer(fill, dtype)[0] if len(fill) == dtype.itemsize else 0, dtype=dtype)
        rows = self.element(*table)
        n = struct.unpack_from(">hi", rows)[1]
        record = struct.Struct(f">{rank}iHH")
        for *origin, tag, ref in record.iter_unpack(self.element(TABLE, table[1])[: n * record.size]):
            found = np.frombuffer(self._bytes(tag, ref), dtype)
            if len(found) != np.prod(sizes):
                raise BadGranule(f"a chunk of {len(found)} values, not {np.prod(sizes)}")
            to = tuple(slice(o * s, min((o + 1) * s, m)) for o, s, m in zip(origin, sizes, shape))
            out[to] = found.reshape(sizes)[tuple(slice(0, t.stop - t.start) for t in to)]
        return out.ravel()


def planes(content: bytes, value: str, quality: str, side: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(raw, quality) with one plane an observation; a flat plane counts as one. Raises where they disagree or the tile has another side."""
    box = Container(content)
    both = [a[None] if a.ndim == 2 else a for a in (box.named(value), box.named(quality))]
    if both[0].ndim != 3 or both[0].shape != both[1].shape:
        raise BadGranule(f"planes of {both[0].shape} and {both[1].shape} disagree")
    if side is not None and both[0].shape[1:] != (side, side):
        raise BadGranule(f"a tile of {both[0].shape[1:]}, not {side} x {side}")
    return both[0], both[1]


_PIXEL = pa.schema([("path", pa.string()), ("obs", pa.int32()), ("row", pa.int32()), ("col", pa.int32()), ("raw", pa.int32()), ("quality", pa.int32())])


def pixels(files: DataFrame, value: str = "grid1km:Optical_Depth_055", quality: str = "grid1km:AOD_QA", side: int | None = None, lines: int = 128) -> DataFrame:
    """(path, obs, row, col, raw, quality) of every pixel of the granules (path, content); one that can't be read raises, with its path."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                try:
                    raw, word = planes(content or b"", value, quality, side)
                except (BadGranule, struct.error) as e:
                    raise BadGranule(f"{path}: {e}") from e
                for k in range(len(raw)):
                    for at in range(0, raw.shape[1], lines):
                        part = raw[k, at : at + lines]
                        row, col = np.indices(part.shape)
                        columns = [np.full(part.size, k), row.ravel() + at, col.ravel(), part.ravel(), word[k, at : at + lines].ravel()]
                        yield pa.RecordBatch.from_arrays([pa.array([path] * part.size), *[pa.array(c.astype(np.int32)) for c in columns]], schema=_PIXEL)

    return files.select("path", "content").mapInArrow(explode, "path string, obs int, row int, col int, raw int, quality int")


def described(files: DataFrame, value: str = "grid1km:Optical_Depth_055") -> DataFrame:
    """(path, variables, shape, problem) of each granule: what is in it, and why it can't be read if it can't."""

    @F.udf("variables array<string>, shape array<int>, problem string")
    def look(content: bytes):
        try:
            box = Container(bytes(content or b""))
            return sorted(box.variables()), list(box.named(value).shape), None
        except (BadGranule, struct.error) as e:
            return None, None, str(e)

    return files.select("path", look("content").alias("_d")).select("path", "_d.*")


# ---- writing, for fixtures -----------------------------------------------------------------------------------------------


def packed(variables: dict[str, np.ndarray], chunk: Sequence[int] | None = None, deflate: bool = True, block: int = 8) -> bytes:
    """A container of the named arrays (`grid:field`), whole or in chunks, with descriptor blocks of `block` entries."""
    elements: list[tuple[int, int, bytes]] = []

    def put(tag: int, raw: bytes) -> int:
        elements.append((tag, len(elements) + 1, raw))
        return len(elements)

    def data(tag: int, raw: bytes) -> int:
        if not deflate:
            return put(tag, raw)
        inner = put(COMPRESSED, zlib.compress(raw))
        return put(tag | SPECIAL, struct.pack(">hhiHHHH", IS_COMPRESSED, 0, len(raw), inner, 0, DEFLATE, 6))

    text = lambda s: struct.pack(">H", len(s.encode())) + s.encode()
    group = lambda name, kind, members: put(GROUP, struct.pack(">H", len(members)) + b"".join(struct.pack(">H", t) for t, _ in members) + b"".join(struct.pack(">H", r) for _, r in members) + text(name) + text(kind) + bytes(8))
    grids: dict[str, list[tuple[int, int]]] = {}
    for name, array in variables.items():
        array = array.astype(array.dtype.newbyteorder(">"))
        kind = next(k for k, v in KINDS.items() if v == array.dtype.str[1:])
        kind_ref = put(NUMBER_TYPE, bytes([1, kind, array.itemsize * 8, 1]))
        shape = put(DIMENSIONS, struct.pack(f">h{array.ndim}iHH", array.ndim, *array.shape, NUMBER_TYPE, kind_ref))
        if chunk is None:
            where = data(DATA, array.tobytes())
        else:
            sizes, rows = list(chunk)[-array.ndim :], b""
            for origin in np.ndindex(*[-(-m // s) for m, s in zip(array.shape, sizes)]):
                part = array[tuple(slice(o * s, (o + 1) * s) for o, s in zip(origin, sizes))]
                full = np.zeros(sizes, array.dtype)
                full[tuple(slice(0, n) for n in part.shape)] = part
                rows += struct.pack(f">{array.ndim}iHH", *origin, CHUNK, data(CHUNK, full.tobytes()))
            n = int(np.prod([-(-m // s) for m, s in zip(array.shape, sizes)]))
            table = put(TABLE_HEAD, struct.pack(">hi", 0, n))
            elements.append((TABLE, table, rows))
            head = struct.pack(">hiBiiiiHHHHi", IS_CHUNKED, 0, 1, 0, array.nbytes, int(np.prod(sizes)) * array.itemsize, array.itemsize, TABLE_HEAD, table, 0, 0, array.ndim)
            head += b"".join(struct.pack(">iii", 0, m, s) for m, s in zip(array.shape, sizes)) + struct.pack(">i", array.itemsize) + bytes(array.itemsize)
            where = put(DATA | SPECIAL, head)
        numeric = put(NUMERIC_GROUP, struct.pack(">HHHH", DIMENSIONS, shape, DATA, where))
        grid, _, field = name.rpartition(":")
        grids.setdefault(grid, []).append((GROUP, group(field, "Var0.0", [(NUMERIC_GROUP, numeric)])))
    for grid, members in grids.items():
        group(grid, "GRID", [(GROUP, group("Data Fields", "GRID Vgroup", members))])
    blocks = [elements[k : k + block] for k in range(0, len(elements), block)]
    places, at = [], len(MAGIC)
    for some in blocks:
        places.append(at)
        at += 6 + 12 * len(some) + sum(len(raw) for _, _, raw in some)
    out = MAGIC
    for k, some in enumerate(blocks):
        at = places[k] + 6 + 12 * len(some)
        out += struct.pack(">hi", len(some), places[k + 1] if k + 1 < len(places) else 0)
        for tag, ref, raw in some:
            out += struct.pack(">HHii", tag, ref, at, len(raw))
            at += len(raw)
        out += b"".join(raw for _, _, raw in some)
    return out
