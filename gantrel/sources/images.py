"""PNG and GIF files written and probed without an imaging library: lossless PNG by zlib, GIF frames as literal codes."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_PNG = b"\x89PNG\r\n\x1a\n"
_MODES = {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}
PROBE = "struct<format:string,mode:string,width:int,height:int,frames:int,durations_ms:array<int>,loop:int,error:string>"


def encode_png(pixels: np.ndarray) -> bytes:
    """A PNG of height x width x 1, 3 or 4 bytes."""
    height, width, channels = pixels.shape
    kind = {1: 0, 3: 2, 4: 6}[channels]
    rows = np.concatenate((np.zeros((height, 1), np.uint8), pixels.astype(np.uint8).reshape(height, -1)), axis=1)

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    return _PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def _literal_codes(indexes: np.ndarray) -> bytes:
    """GIF image data of 7-bit indexes as 8-bit codes that refer to nothing before; the table is cleared before it grows
    past 8 bits."""
    out = bytearray()
    for start in range(0, len(indexes), 100):
        out += b"\x80" + indexes[start : start + 100].astype(np.uint8).tobytes()
    out += b"\x81"
    blocks = [bytes([len(out[i : i + 255])]) + bytes(out[i : i + 255]) for i in range(0, len(out), 255)]
    return b"\x07" + b"".join(blocks) + b"\x00"


def encode_gif(frames: Sequence[np.ndarray], palette: np.ndarray, durations_ms: Sequence[int], loop: int = 0, disposals: Sequence[int] | None = None) -> bytes:
    """A GIF that keeps every frame, equal neighbours included. Frames hold indexes below 128 into the palette; durations
    are kept in hundredths of a second."""
    height, width = frames[0].shape
    table = np.zeros((128, 3), np.uint8)
    table[: len(palette)] = palette
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF6, 0, 0), table.tobytes(), b"\x21\xff\x0bNETSCAPE2.0\x03\x01", struct.pack("<H", loop), b"\x00"]
    for i, frame in enumerate(frames):
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", (disposals[i] if disposals else 0) << 2, durations_ms[i] // 10, 0) + b"\x00")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, height, 0) + _literal_codes(frame.reshape(-1)))
    return b"".join(out) + b"\x3b"


def _gif_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    body = []
    while data[at]:
        body.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(body), at + 1


def probe(data: bytes) -> dict:
    """Format, mode, size, frames, durations and loop from a file's headers and blocks, without decoding. Damaged files of
    either format, and all others, have an error and no more than their format."""
    out: dict = dict.fromkeys(("format", "mode", "width", "height", "frames", "durations_ms", "loop", "error"))
    try:
        if data[:8] == _PNG:
            out["format"] = "PNG"
            width, height, depth, kind = struct.unpack_from(">IIBB", data, 16)
            if data[12:16] != b"IHDR" or zlib.crc32(data[12:29]) != struct.unpack_from(">I", data, 29)[0]:
                raise ValueError("damaged header")
            return out | {"mode": _MODES.get(kind), "width": width, "height": height, "frames": 1}
        if data[:6] in (b"GIF87a", b"GIF89a"):
            out["format"] = "GIF"
            width, height, flags = struct.unpack_from("<HHB", data, 6)
            at, pending, durations, loop, frames = 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0), 0, [], None, 0
            while data[at] != 0x3B:
                if data[at] == 0x21:
                    body, end = _gif_blocks(data, at + 2)
                    if data[at + 1] == 0xF9:
                        pending = 10 * struct.unpack_from("<H", body, 1)[0]
                    elif body[:11] == b"NETSCAPE2.0":
                        loop = struct.unpack_from("<H", body, 12)[0]
                    at = end
                elif data[at] == 0x2C:
                    local = data[at + 9]
                    _, at = _gif_blocks(data, at + 11 + (3 << (local & 7) + 1 if local & 0x80 else 0))
                    frames, pending = frames + 1, durations.append(pending) or 0
                else:
                    raise ValueError("unknown block")
            if not frames:
                raise ValueError("no frame")
            return out | {"mode": "P", "width": width, "height": height, "frames": frames, "durations_ms": durations, "loop": loop}
        return out | {"error": "not an image"}
    except (IndexError, struct.error, ValueError) as e:
        return out | {"error": str(e) or "damaged"}


def probed(content: Column) -> Column:
    """``probe`` of a binary column, as a struct."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("format", pa.string()), ("mode", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("frames", pa.int32()), ("durations_ms", pa.list_(pa.int32())), ("loop", pa.int32()), ("error", pa.string())])
        for batch in batches:
            yield pa.array([probe(v.as_py() or b"") for v in batch], kind)

    return F.arrow_udf(run, PROBE)(content)
