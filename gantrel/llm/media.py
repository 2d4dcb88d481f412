"""Media columns: payloads in ISO media containers, and a box walker that never decodes them.

``mux`` lays a payload out as an uncompressed video track: one 8x8 frame of 8-bit samples for each 64 bytes.
``probe`` walks the nested boxes of any such file, decodes the sample tables of every track and reports codec,
duration and the byte ranges of key frames.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import as_bytes

FRAME = 64
TIMESCALE, FRAME_TICKS = 25_000, 1_000
CHUNK_FRAMES = 32
#: Levels of nesting that a path names; deeper boxes are walked all the same.
DEPTH = 32
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"}
_MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, flags: int, *parts: bytes, version: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of the frame size."""
    return data + bytes(-len(data) % FRAME if data else FRAME)


def mux_bytes(payload: bytes) -> bytes:
    """A container whose media data is the payload, unchanged; every 32nd frame opens a chunk and is a key frame."""
    frames = len(payload) // FRAME
    n_chunks = -(-frames // CHUNK_FRAMES)
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomqt  ")
    wide = len(payload) + 4096 + 12 * n_chunks >= 2**32
    head = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) if wide else struct.pack(">I4s", 8 + len(payload), b"mdat")
    first = len(ftyp) + len(head)
    offsets = first + CHUNK_FRAMES * FRAME * np.arange(n_chunks, dtype=np.int64)
    ticks = frames * FRAME_TICKS
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", 8, 8, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))
    runs = [(1, CHUNK_FRAMES, 1)] if n_chunks > 1 or frames == CHUNK_FRAMES else []
    if frames % CHUNK_FRAMES:
        runs.append((n_chunks, frames % CHUNK_FRAMES, 1))
    table = _full(b"co64", 0, struct.pack(">I", n_chunks), offsets.astype(">u8").tobytes()) if wide else _full(b"stco", 0, struct.pack(">I", n_chunks), offsets.astype(">u4").tobytes())
    stbl = _box(
        b"stbl",
        _full(b"stsd", 0, struct.pack(">I", 1), entry),
        _full(b"stts", 0, struct.pack(">III", 1, frames, FRAME_TICKS)),
        _full(b"stss", 0, struct.pack(">I", n_chunks), (1 + CHUNK_FRAMES * np.arange(n_chunks)).astype(">u4").tobytes()),
        _full(b"stsc", 0, struct.pack(">I", len(runs)), *[struct.pack(">III", *r) for r in runs]),
        _full(b"stsz", 0, struct.pack(">II", FRAME, frames)),
        table,
    )
    minf = _box(b"minf", _full(b"vmhd", 1, bytes(8)), _box(b"dinf", _full(b"dref", 0, struct.pack(">I", 1), _full(b"url ", 1))), stbl)
    times = struct.pack(">QQIQ", 0, 0, TIMESCALE, ticks)
    mdia = _box(b"mdia", _full(b"mdhd", 0, times, struct.pack(">HH", 0x55C4, 0), version=1), _full(b"hdlr", 0, bytes(4), b"vide", bytes(12), b"frames\0"), minf)
    tkhd = _full(b"tkhd", 7, struct.pack(">QQIIQ", 0, 0, 1, 0, ticks), bytes(8), struct.pack(">hhHH", 0, 0, 0, 0), _MATRIX, struct.pack(">II", 8 << 16, 8 << 16), version=1)
    mvhd = _full(b"mvhd", 0, times, struct.pack(">IHH", 0x10000, 0x100, 0), bytes(8), _MATRIX, bytes(24), struct.pack(">I", 2), version=1)
    return b"".join((ftyp, head, payload, _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))))


def walk(data: bytes) -> Iterator[tuple[str, int, int]]:
    """(path, body start, body end) of every box, parents first. 64-bit and to-the-end sizes are followed; a box that
    claims more bytes than its parent has ends the walk of that parent. Boxes may nest to any depth."""
    stack = [(0, len(data), "")]
    while stack:
        start, end, path = stack.pop()
        if start + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1 and start + 16 <= end:
            size, body = struct.unpack_from(">Q", data, start + 8)[0], start + 16
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            continue
        name = f"{path}/{kind.decode('latin-1')}" if path.count("/") < DEPTH else path
        yield name, body, start + size
        stack.append((start + size, end, path))
        if kind in CONTAINERS:
            stack.append((body, start + size, name))


def _numbers(data: bytes, at: int, end: int, kind: str, count: int) -> np.ndarray:
    dtype = np.dtype(kind)
    return np.frombuffer(data, dtype, max(0, min(count, (end - at) // dtype.itemsize)), at) if at < end else np.zeros(0, dtype)


def probe_bytes(data: bytes) -> list[dict]:
    """One record for each track: kind, codec, size, duration in milliseconds, sample count, and the byte ranges of
    key frames and of chunks. Empty for data that holds no track; a track without a table counts no samples. Tables that
    claim more than their box holds, or point outside the data, give what is there."""
    tracks: list[dict] = []
    for path, at, end in walk(data):
        kind = path[-4:]
        if kind == "trak":
            tracks.append({"boxes": {}})
        elif tracks and "/moov/trak/" in path:
            tracks[-1]["boxes"].setdefault(kind, (at, end))
    return [_track(data, t["boxes"]) for t in tracks]


def _track(data: bytes, boxes: dict[str, tuple[int, int]]) -> dict:
    none = np.zeros(0, np.int64)
    out = {"kind": "", "codec": "", "width": 0, "height": 0, "duration_ms": 0, "samples": 0, "key_offsets": none, "key_sizes": none, "chunk_offsets": none, "chunk_sizes": none}

    def field(name: str, at: int, kind: str) -> tuple | None:
        b = boxes.get(name)
        return struct.unpack_from(kind, data, b[0] + at) if b and b[0] + at + struct.calcsize(kind) <= b[1] else None

    if got := field("hdlr", 8, "4s"):
        out["kind"] = got[0].decode("latin-1")
    if version := field("mdhd", 0, "B"):
        if times := field("mdhd", 20, ">IQ") if version[0] == 1 else field("mdhd", 12, ">II"):
            out["duration_ms"] = min(times[1] * 1000 // times[0], 2**63 - 1) if times[0] else 0
    if got := field("stsd", 12, "4s"):
        out["codec"] = got[0].decode("latin-1")
    if out["kind"] == "vide" and (got := field("stsd", 40, ">HH")):
        out["width"], out["height"] = got
    offsets = "co64" if "co64" in boxes else "stco"
    counts = [field("stsz", 4, ">II"), field("stsc", 4, ">I"), field(offsets, 4, ">I")]
    if None in counts:
        return out
    (size, count), (n_runs,), (n_chunks,) = counts
    (z, z_end), (c, c_end), (o, o_end) = boxes["stsz"], boxes["stsc"], boxes[offsets]
    chunk_at = _numbers(data, o + 8, o_end, ">u8" if offsets == "co64" else ">u4", n_chunks).astype(np.uint64)
    chunk_at = chunk_at[chunk_at <= len(data)].astype(np.int64)
    runs = _numbers(data, c + 8, c_end, ">u4", 3 * n_runs).astype(np.int64)
    runs = runs[: len(runs) // 3 * 3].reshape(-1, 3)
    runs = runs[(runs[:, 0] >= 1) & (runs[:, 0] <= len(chunk_at))]
    if not len(runs) or not len(chunk_at) or (np.diff(runs[:, 0]) <= 0).any() or runs[0, 0] != 1:
        return out
    per_chunk = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0] - 1, len(chunk_at))))
    listed = None if size else _numbers(data, z + 12, z_end, ">u4", count).astype(np.int64)
    total = count if size else len(listed)
    bound = len(data) // size if size else total  # no more samples of one size than the data has room for
    first = np.minimum(np.concatenate(([0], np.cumsum(np.minimum(per_chunk, total)))), min(total, bound))
    samples = int(first[-1])
    begin = (lambda i: i * size) if size else (lambda i, sums=np.concatenate(([0], np.cumsum(listed))): sums[i])
    if "stss" in boxes:
        n_keys = field("stss", 4, ">I")
        keys = _numbers(data, boxes["stss"][0] + 8, boxes["stss"][1], ">u4", n_keys[0] if n_keys else 0).astype(np.int64) - 1
        keys = keys[(keys >= 0) & (keys < samples)]
    else:
        keys = np.arange(samples)
    chunk_of = np.searchsorted(first, keys, side="right") - 1
    key_sizes = np.full(len(keys), size, np.int64) if size else listed[keys]
    used = np.diff(first) > 0
    return out | {"samples": samples, "key_offsets": chunk_at[chunk_of] + begin(keys) - begin(first[chunk_of]), "key_sizes": key_sizes, "chunk_offsets": chunk_at[: len(used)][used], "chunk_sizes": (begin(first[1:]) - begin(first[:-1]))[used]}


def payload_of(data: bytes, track: dict) -> bytes:
    """The track's media bytes in order, joined from its chunks' byte ranges."""
    at, size = track["chunk_offsets"], track["chunk_sizes"]
    if len(at) and (at[1:] == at[:-1] + size[:-1]).all():
        return data[int(at[0]) : int(at[-1] + size[-1])]
    return b"".join(data[a : a + n] for a, n in zip(at.tolist(), size.tolist()))


PROBE = "struct<tracks:int,kind:string,codec:string,width:int,height:int,duration_ms:bigint,samples:bigint,keyframes:array<struct<offset:bigint,size:bigint>>>"
PAYLOAD = "struct<payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint>"


def _mux(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([mux_bytes(pad(b)) for b in as_bytes(batch)], pa.binary())


def _probe(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    blank = {"kind": None, "codec": None, "width": 0, "height": 0, "duration_ms": 0, "samples": 0}
    kinds = [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    for batch in batches:
        rows, firsts = [], []
        for data in as_bytes(batch):
            tracks = probe_bytes(data)
            t = tracks[0] if tracks else blank
            rows.append((len(tracks), *(t[c] for c in blank)))
            firsts.append(tracks[0] if tracks else None)
        arrays = [pa.array(list(c), k) for c, k in zip(list(zip(*rows)) or [[]] * 7, kinds)]
        yield pa.StructArray.from_arrays([*arrays, _key_frames(firsts)], names=["tracks", *blank, "keyframes"])


def _payload(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        rows = []
        for data in as_bytes(batch):
            tracks = probe_bytes(data)
            body = payload_of(data, tracks[0]) if tracks else b""
            rows.append((len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-FRAME:])))
        cols = list(zip(*rows)) or [[]] * 3
        yield pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int64()))], names=["payload_bytes", "payload_sha256", "tail_crc32"])


def _key_frames(tracks: list[dict | None]) -> pa.ListArray:
    """The byte ranges of each track's key frames."""
    key = pa.struct([("offset", pa.int64()), ("size", pa.int64())])
    none = [np.zeros(0, np.int64)]
    at, size = ([t[name] if t else none[0] for t in tracks] for name in ("key_offsets", "key_sizes"))
    flat = pa.StructArray.from_arrays([pa.array(np.concatenate(none + x), pa.int64()) for x in (at, size)], fields=list(key))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, at)]), pa.int32()), flat)


def _round_trip(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    names = ["media_bytes", "media_sha256", "payload_bytes", "payload_sha256", "tail_crc32", "feature", "codec", "duration_ms", "keyframes"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for batch in batches:
        rows, tracks = [], []
        for content in as_bytes(batch):
            data = mux_bytes(pad(content))
            track = probe_bytes(data)[0]
            body = payload_of(data, track)
            rows.append((len(data), hashlib.sha256(data).hexdigest(), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-FRAME:]), describe(track), track["codec"].strip(), track["duration_ms"]))
            tracks.append(track)
        yield pa.StructArray.from_arrays([*[pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 8, kinds)], _key_frames(tracks)], names=names)


def describe(track: dict) -> str:
    """Codec, frame size, duration, samples, number of key frames and the bytes they span, as one string."""
    at, size = track["key_offsets"], track["key_sizes"]
    span = f"{at[0]}-{at[-1] + size[-1]}" if len(at) else "none"
    return f"codec={track['codec'].strip()};size={track['width']}x{track['height']};ms={track['duration_ms']};samples={track['samples']};keys={len(at)};span={span}"


def mux(content: Column) -> Column:
    """Store text (as UTF-8) or binary content in a container. Null and empty content become one frame of zeros."""
    return F.arrow_udf(_mux, "binary")(content)


def probe(media: Column) -> Column:
    """Number of tracks, and of the first one kind, codec, size, duration, sample count and the byte range of each key
    frame, from the boxes alone. Data without a track, empty or null gives tracks 0, null kind and codec, and no ranges."""
    return F.arrow_udf(_probe, PROBE)(media)


def payload_digest(media: Column) -> Column:
    """Length, SHA-256 and CRC-32 of the last frame of the first track's media bytes, read through its chunk table."""
    return F.arrow_udf(_payload, PAYLOAD)(media)


ROUND_TRIP = "struct<media_bytes:bigint,media_sha256:string,payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,feature:string,codec:string,duration_ms:bigint,keyframes:array<struct<offset:bigint,size:bigint>>>"


def round_trip(content: Column) -> Column:
    """``mux``, then what ``payload_digest`` and ``probe`` find in the stored bytes, in one pass, so that containers do
    not travel between processes. Null and empty content as in ``mux``."""
    return F.arrow_udf(_round_trip, ROUND_TRIP)(content)
