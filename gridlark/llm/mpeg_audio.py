"""MPEG audio media columns: resynchronising frame parser, tags, variable-bitrate tables, checksums, durations, seek offsets.

`parse` reads any byte string as MPEG 1, 2 or 2.5 audio, layers I to III: it skips ID3v2, ID3v1 and APE tags, finds the
first header that a second one confirms, follows the chain of frame lengths, and looks for the next confirmed header
whenever the chain breaks. `store_payload` writes bytes losslessly into the ancillary data of a silent layer III stream, one
192-byte unit a frame, with a checksum in each frame, an Info table in front and an ID3 tag at either end.

Checksums are verified in all three layers. Samples that an encoder's delay and padding fields tell to drop don't count in the
duration. Free-format frames (no bit rate in the header) aren't followed: they count as skipped bytes.

Cases: null and empty bytes have no frames, zero duration and no offsets; bytes without a confirmed header likewise, all of
them counted as skipped; a cut last frame is counted as truncated and has no offset; equal bytes give equal rows; extra
columns of the input are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import text_of

# Fixed values of the MPEG audio standards, ISO/IEC 11172-3 and 13818-3: kbit/s by version group and layer, Hz by version.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 25: (11025, 12000, 8000)}
VERSION_OF_BITS = {0: 25, 2: 2, 3: 1}

#: Bits of a layer II allocation field by subband, as (bits, subbands) runs: tables a to d of version 1, and that of version 2.
ALLOCATION = {
    "a": ((4, 11), (3, 12), (2, 4)), "b": ((4, 11), (3, 12), (2, 7)), "c": ((4, 2), (3, 6)), "d": ((4, 2), (3, 10)), "lsf": ((4, 4), (3, 7), (2, 19)),
}

UNIT = 192
_FRAME = 240  # bytes of a frame at 80 kbit/s and 48 kHz
_HEADER = bytes((0xFF, 0xFA, 0x64, 0xC0))  # version 1, layer III, checksum present, 80 kbit/s, 48 kHz, mono
_SIDE = 17
_BODY = 4 + 2 + _SIDE
_COVERED = np.array([2, 3, *range(6, 6 + _SIDE)])

SCHEMA = (
    "n_frames long, n_samples long, sample_rate int, channels int, duration_num long, duration_den long, duration_s double, "
    "crc_checked long, crc_bad long, resyncs long, skipped_bytes long, truncated int, vbr_kind string, vbr_frames long, "
    "vbr_bytes long, vbr_toc array<int>, tags array<string>, frame_offsets array<long>"
)


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        out = np.where(out & 0x8000, (out << 1) ^ 0x8005, out << 1) & 0xFFFF
    return out.astype(np.uint16)


_CRC = _crc_table()


@lru_cache(maxsize=8)
def _crc_parts(n: int) -> tuple[np.ndarray, np.uint16]:
    """A checksum over n bytes is the exclusive or of a part for each place and byte value, and of one constant."""

    def after(part: np.ndarray, steps: int) -> np.ndarray:
        for _ in range(steps):
            part = (part << np.uint16(8)) ^ _CRC[part >> np.uint16(8)]
        return part

    parts = np.stack([after(_CRC, n - 1 - k) for k in range(n)])
    return parts, after(np.array([0xFFFF], dtype=np.uint16), n)[0]


def crc16(columns: np.ndarray) -> np.ndarray:
    """The frames' checksums; columns: a row of covered bytes for each frame."""
    parts, constant = _crc_parts(columns.shape[1])
    return np.bitwise_xor.reduce(parts[np.arange(columns.shape[1]), columns], axis=1) ^ constant


def _header_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By the 16 bits after the sync byte (second and third header byte): frame length without padding slot, samples, Hz; 0: invalid."""
    length, samples, hertz = (np.zeros(1 << 16, dtype=np.int32) for _ in range(3))
    for second in range(0xE0, 0x100):
        version, layer = VERSION_OF_BITS.get(second >> 3 & 3), 4 - (second >> 1 & 3)
        if version is None or layer == 4:
            continue
        kbits = BITRATES[(1, layer)] if version == 1 else BITRATES[(2, min(layer, 2))]
        per = 384 if layer == 1 else 1152 if layer == 2 or version == 1 else 576
        for third in range(256):
            b, r, pad = third >> 4, third >> 2 & 3, third >> 1 & 1
            if not 0 < b < 15 or r == 3:
                continue
            rate = RATES[version][r]
            n = (12 * kbits[b] * 1000 // rate + pad) * 4 if layer == 1 else per // 8 * kbits[b] * 1000 // rate + pad
            k = second << 8 | third
            length[k], samples[k], hertz[k] = n, per, rate
    return length, samples, hertz


_LENGTH, _SAMPLES, _HERTZ = _header_tables()


def _int(b: bytes) -> int:
    return int.from_bytes(b, "big")


def _tags(data: bytes) -> tuple[int, int, list[str]]:
    """(first byte of audio, end of audio, tags) without the tags at either end."""
    at, end, tags = 0, len(data), []
    while data[at : at + 3] == b"ID3" and len(data) - at >= 10 and not any(x & 0x80 for x in data[at + 6 : at + 10]):
        size = sum(x << s for x, s in zip(data[at + 6 : at + 10], (21, 14, 7, 0)))
        tags.append(f"ID3v2.{data[at + 3]}")
        step = 4 if data[at + 3] >= 3 else 3
        pos, stop = at + 10, min(at + 10 + size, end)
        while pos + step * 2 + 2 * (step == 4) <= stop and data[pos : pos + 1].isalnum():
            name, raw = data[pos : pos + step], data[pos + step : pos + 2 * step]
            n = sum(x << s for x, s in zip(raw, (21, 14, 7, 0))) if data[at + 3] == 4 else _int(raw)
            body = data[pos + 2 * step + 2 * (step == 4) :][: min(n, stop - pos)]
            if name[:1] == b"T" and body:
                text = body[1:].decode("utf-16" if body[0] == 1 else "utf-8" if body[0] == 3 else "latin-1", "replace")
                tags.append(f"{name.decode('latin-1')}={text.rstrip(chr(0))}")
            pos += 2 * step + 2 * (step == 4) + n
        at += 10 + size + 10 * bool(data[at + 5] & 0x10)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        tags.append("ID3v1=" + data[end - 125 : end - 95].rstrip(b"\0 ").decode("latin-1"))
        end -= 128
    if end - at >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        tags.append("APEv2")
        end -= min(int.from_bytes(data[end - 20 : end - 16], "little") + 32 * (data[end - 9] >> 7), end - at)
    return min(at, end), end, tags


def _side_bytes(second: int, fourth: int) -> int:
    mono = fourth >> 6 == 3
    return (17 if mono else 32) if second >> 3 & 3 == 3 else (9 if mono else 17)


def _vbr(frame: bytes) -> tuple[str, int, int, list[int], int] | None:
    """A Xing, Info or VBRI table in the first frame: (kind, frames, bytes, seek table, samples to drop at both ends)."""
    if 4 - (frame[1] >> 1 & 3) == 3:
        for at in (4 + _side_bytes(frame[1], frame[3]) + 2 * (not frame[1] & 1), 4 + _side_bytes(frame[1], frame[3])):
            kind = frame[at : at + 4]
            if kind in (b"Xing", b"Info"):
                flags, at, n, size, toc = _int(frame[at + 4 : at + 8]), at + 8, -1, -1, []
                if flags & 1:
                    n, at = _int(frame[at : at + 4]), at + 4
                if flags & 2:
                    size, at = _int(frame[at : at + 4]), at + 4
                if flags & 4:
                    toc, at = list(frame[at : at + 100]), at + 100
                encoder = frame[at + 4 * bool(flags & 8) :][:24]  # nine bytes of name, then fields; delay and padding have twelve bits each
                gap = _int(encoder[21:24]) if len(encoder) == 24 and encoder[:4] in (b"LAME", b"Lavf", b"Lavc") else 0
                return kind.decode(), n, size, toc, (gap >> 12) + (gap & 0xFFF)
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        n, width, scale = _int(frame[54:56]), _int(frame[58:60]), _int(frame[56:58])
        toc = [_int(frame[62 + k * width : 62 + (k + 1) * width]) * scale for k in range(n)] if width else []
        return "VBRI", _int(frame[50:54]), _int(frame[46:50]), toc, 0
    return None


def _protected(frame: bytes) -> int:
    """Bits after the checksum that it covers, in layer I the allocation, in layer II the allocation and the scale factor selection."""
    layer, mode = 4 - (frame[1] >> 1 & 3), frame[3] >> 6
    n_channels, bound = (1 if mode == 3 else 2), (4 * ((frame[3] >> 4 & 3) + 1) if mode == 1 else 32)
    if layer == 1:
        return 4 * (32 if n_channels == 1 else 32 + bound)
    version, third = VERSION_OF_BITS[frame[1] >> 3 & 3], frame[2]
    if version == 1:
        each, hertz = BITRATES[(1, 2)][third >> 4] // n_channels, RATES[1][third >> 2 & 3]
        name = ("d" if hertz == 32000 else "c") if each <= 48 else "a" if hertz == 48000 or each <= 80 else "b"
    else:
        name = "lsf"
    widths = [bits for bits, n in ALLOCATION[name] for _ in range(n)]
    bits, size = int.from_bytes(frame[6:], "big"), 8 * (len(frame) - 6)
    at = used = 0
    for band, width in enumerate(widths):
        fields = n_channels if band < bound else 1
        for _ in range(fields):
            if bits >> max(size - at - width, 0) & (1 << width) - 1:
                used += n_channels // fields
            at += width
    return at + 2 * used


def crc_of(frame: bytes, n_bits: int) -> int:
    """The checksum over the header's last two bytes and n_bits bits behind the checksum's own place."""
    state = 0xFFFF
    whole = frame[2:4] + frame[6 : 6 + n_bits // 8]
    for byte in whole:
        state = (state << 8 & 0xFFFF) ^ int(_CRC[state >> 8 ^ byte])
    for k in range(n_bits % 8):
        top = state >> 15 ^ (frame[6 + n_bits // 8] >> 7 - k & 1)
        state = (state << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return state


def frames_of(data: bytes) -> dict:
    """Offsets, lengths and header codes of all whole frames, and what was skipped between them."""
    first, end, tags = _tags(data)
    buf = np.frombuffer(data, dtype=np.uint8)
    out = {"tags": tags, "resyncs": 0, "skipped": 0, "truncated": 0}
    at = np.flatnonzero(buf[first : max(first, end - 3)] == 0xFF) + first
    code = buf[at + 1].astype(np.int32) << 8 | buf[at + 2]
    at, code = at[(ok := _LENGTH[code] > 0)], code[ok]
    length = _LENGTH[code]
    stop = at + length
    # A following header counts only if version, layer and sampling rate agree.
    alike = code & 0x1E0C | (code & 0xE000)
    follow = np.searchsorted(at, stop)
    inside = np.minimum(follow, max(len(at) - 1, 0))
    chained = (follow < len(at)) & (at[inside] == stop) & (alike[inside] == alike) if len(at) else np.zeros(0, bool)
    sure = chained | (stop == end)
    confirmed = np.flatnonzero(sure)
    nxt, good, stops, starts = inside.tolist(), chained.tolist(), stop.tolist(), at.tolist()
    picked: list[int] = []
    cursor, k = first, int(confirmed[0]) if len(confirmed) else None
    while k is not None:
        gap = starts[k] - cursor
        if gap:
            out["skipped"] += gap
            out["resyncs"] += bool(picked)
        while good[k]:
            picked.append(k)
            k = nxt[k]
        inner = np.searchsorted(confirmed, k, side="right")
        if not sure[k] and inner < len(confirmed) and starts[confirmed[inner]] < stops[k]:
            cursor = starts[k]  # a confirmed header stands inside: this one was chance
        elif stops[k] <= end:  # the last of a chain: whole, though nothing follows it
            picked.append(k)
            cursor = stops[k]
        else:
            out["truncated"] += 1
            cursor = starts[k] + 4
        later = confirmed[np.searchsorted(at[confirmed], max(cursor, starts[k] + 1)) :]
        k = int(later[0]) if len(later) else None
    out["skipped"] += max(0, end - cursor)
    picked = np.asarray(picked, dtype=np.int64)
    return out | {"at": at[picked], "length": length[picked], "code": code[picked]}


def parse(data: bytes | None) -> dict:
    """All columns of SCHEMA for one byte string; the Info frame counts neither as audio nor as a seek offset."""
    data = bytes(data or b"")
    f = frames_of(data)
    at, length, code = f["at"], f["length"], f["code"]
    buf = np.frombuffer(data, dtype=np.uint8)
    checked = bad = 0
    covered = np.flatnonzero((code & 0x0100 == 0) & (4 - (code >> 9 & 3) == 3)) if len(at) else np.zeros(0, np.int64)
    if len(covered):
        mono, v1 = buf[at[covered] + 3] >> 6 == 3, code[covered] >> 11 & 3 == 3
        side = np.where(v1, np.where(mono, 17, 32), np.where(mono, 9, 17))
        for n in np.unique(side):
            pos = at[covered[side == n]]
            cols = np.concatenate([np.array([2, 3]), np.arange(6, 6 + n)])
            want = buf[pos + 4].astype(np.uint16) << np.uint16(8) | buf[pos + 5]
            checked, bad = checked + len(pos), bad + int((crc16(buf[pos[:, None] + cols]) != want).sum())
    for k in np.flatnonzero((code & 0x0100 == 0) & (4 - (code >> 9 & 3) < 3)) if len(at) else ():
        frame = data[at[k] : at[k] + length[k]]
        n_bits = _protected(frame)
        if 6 + (n_bits + 7) // 8 <= len(frame):
            checked, bad = checked + 1, bad + (crc_of(frame, n_bits) != _int(frame[4:6]))
    table = _vbr(data[at[0] : at[0] + length[0]]) if len(at) else None
    audio = slice(1, None) if table else slice(None)
    samples, rates = _SAMPLES[code[audio]], _HERTZ[code[audio]]
    spent = sum((Fraction(int(samples[rates == r].sum()), int(r)) for r in np.unique(rates)), Fraction(0))
    dropped = min(table[4], int(samples.sum())) if table and len(rates) else 0
    spent -= Fraction(dropped, int(rates[0])) if dropped else 0
    return {
        "n_frames": len(samples), "n_samples": int(samples.sum()), "sample_rate": int(rates[0]) if len(rates) else 0,
        "channels": (1 if data[at[0] + 3] >> 6 == 3 else 2) if len(at) else 0,
        "duration_num": spent.numerator, "duration_den": spent.denominator, "duration_s": float(spent),
        "crc_checked": checked, "crc_bad": bad, "resyncs": f["resyncs"], "skipped_bytes": f["skipped"], "truncated": f["truncated"],
        "vbr_kind": table[0] if table else None, "vbr_frames": table[1] if table else None, "vbr_bytes": table[2] if table else None,
        "vbr_toc": table[3] if table else None, "tags": f["tags"], "frame_offsets": at[audio].tolist(),
    }


def _id3v2(frames: dict[str, str]) -> bytes:
    body = b"".join(k.encode() + (len(v) + 1).to_bytes(4, "big") + b"\0\0\0" + v.encode("latin-1") for k, v in frames.items())
    return b"ID3\x03\0\0" + bytes(len(body) >> s & 0x7F for s in (21, 14, 7, 0)) + body


def store_payload(payload: bytes, title: str = "payload") -> bytes:
    """A playable silent stream whose frames carry the payload; its length must be a positive multiple of UNIT."""
    if not payload or len(payload) % UNIT:
        raise ValueError(f"the payload's length must be a positive multiple of {UNIT}")
    n = len(payload) // UNIT
    frames = np.zeros((n + 1, _FRAME), dtype=np.uint8)
    frames[:, :4] = np.frombuffer(_HEADER, dtype=np.uint8)
    frames[1:, _BODY : _BODY + UNIT] = np.frombuffer(payload, dtype=np.uint8).reshape(n, UNIT)
    total = (n + 1) * _FRAME
    toc = np.minimum(255, (_FRAME + n * _FRAME * np.arange(100) // 100) * 256 // total).astype(np.uint8).tobytes()
    info = b"Info" + (7).to_bytes(4, "big") + n.to_bytes(4, "big") + total.to_bytes(4, "big") + toc
    frames[0, _BODY : _BODY + len(info)] = np.frombuffer(info, dtype=np.uint8)
    sums = crc16(frames[:1, _COVERED])[0]  # the covered bytes are alike in all frames
    frames[:, 4], frames[:, 5] = sums >> 8, sums & 0xFF
    tail = b"TAG" + title.encode("latin-1", "replace")[:30].ljust(30, b"\0") + bytes(94) + b"\xff"
    return _id3v2({"TIT2": title, "TLEN": str(n * 24)}) + frames.tobytes() + tail


def load_payload(media: bytes, parsed: dict | None = None) -> bytes:
    """The payload of a stream made by store_payload, taken from the frames that the parser finds."""
    offsets = np.asarray((parsed or parse(media))["frame_offsets"], dtype=np.int64)
    return np.frombuffer(media, dtype=np.uint8)[offsets[:, None] + np.arange(_BODY, _BODY + UNIT)].tobytes() if len(offsets) else b""


def padded(raw: bytes) -> bytes:
    return raw + b" " * ((-len(raw)) % UNIT if raw else UNIT)


def feature(p: dict) -> str:
    seek = zlib.crc32(np.asarray(p["frame_offsets"], dtype="<i8").tobytes())
    return (
        f"frames={p['n_frames']};samples={p['n_samples']};hz={p['sample_rate']};ch={p['channels']};"
        f"duration={p['duration_num']}/{p['duration_den']};crc={p['crc_checked'] - p['crc_bad']}/{p['crc_checked']};"
        f"vbr={p['vbr_kind']}:{p['vbr_frames']}:{p['vbr_bytes']};resyncs={p['resyncs']};skipped={p['skipped_bytes']};"
        f"tags={','.join(p['tags'])};seek_crc32={seek:08x}"
    )


def audio_columns(df: DataFrame, bytes_col: str = "content"):
    """Column expression: struct of SCHEMA for a binary column."""

    @F.pandas_udf(SCHEMA)
    def columns(media: pd.Series) -> pd.DataFrame:
        rows = [parse(x) for x in media]
        return pd.DataFrame({k: pd.Series([r[k] for r in rows], dtype=object) for k in (rows[0] if rows else parse(None))})

    return columns(F.col(bytes_col).cast("binary"))


def stored(df: DataFrame, text_col: str = "text"):
    """Column expression: the text's padded bytes as a stream, binary."""

    @F.pandas_udf("binary")
    def media(texts: pd.Series) -> pd.Series:
        return pd.Series([store_payload(padded(t.encode())) for t in texts], dtype=object)

    return media(text_of(text_col))


_DIGEST = (
    "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "feature string, n_frames long, duration_num long, duration_den long, duration_s double, frame_offsets array<long>"
)


def _digest(text: str) -> tuple:
    raw = text.encode()
    media = store_payload(padded(raw))
    p = parse(media)
    back = load_payload(media, p)
    return (
        len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(),
        feature(p), p["n_frames"], p["duration_num"], p["duration_den"], p["duration_s"], p["frame_offsets"],
    )


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text, reads it back and returns one row of digests for it; a stream lives only while its row is made."""

    @F.pandas_udf(_DIGEST)
    def digests(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_digest(t) for t in texts], columns=[c.split()[0] for c in _DIGEST.split(", ")])

    return docs.select(F.col(id_col), digests(text_of(text_col)).alias("_m")).select(id_col, "_m.*")
