"""Encapsulated pixel data: fragments, offset tables, frames; RLE and deflate frame codecs."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from itertools import accumulate

import numpy as np

from voxelake.errors import SyntaxUnknownError

_ITEM, _END = b"\xfe\xff\x00\xe0", b"\xfe\xff\xdd\xe0"


def itemise(fragment: bytes) -> bytes:
    return _ITEM + struct.pack("<I", len(fragment)) + fragment


def fragments_of(data: bytes) -> list[tuple[int, bytes]]:
    """(offset, bytes) of every item up to the sequence delimiter."""
    out, at = [], 0
    while at + 8 <= len(data):
        mark, length = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if mark == _END:
            break
        if mark != _ITEM or length == 0xFFFFFFFF or at + 8 + length > len(data):
            raise ValueError(f"no whole item at {at}")
        out.append((at, data[at + 8 : at + 8 + length]))
        at += 8 + length
    return out


def split_offsets(data: bytes) -> tuple[list[int], bytes]:
    """(basic offset table, the fragments' bytes)."""
    if data[:4] != _ITEM or len(data) < 8:
        raise ValueError("pixel data must begin with its offset table")
    n = int.from_bytes(data[4:8], "little")
    if n % 4 or 8 + n > len(data):
        raise ValueError("the offset table's length is wrong")
    return list(struct.unpack(f"<{n // 4}I", data[8 : 8 + n])), data[8 + n :]


def frames_of(data: bytes, n: int = 1, eot: tuple[list[int], list[int]] | None = None) -> list[bytes]:
    """The frames: by extended table, basic table, one fragment a frame, or end-of-image marks."""
    table, rest = split_offsets(data)
    if eot:
        if any(o + 8 + size > len(rest) for o, size in zip(*eot, strict=True)):
            raise ValueError("the extended offset table points beyond the data")
        return [rest[o + 8 : o + 8 + size] for o, size in zip(*eot, strict=True)]
    parts = fragments_of(rest)
    if table:
        out: list[list[bytes]] = [[]]
        for at, body in parts:
            if len(out) < len(table) and at >= table[len(out)]:
                out.append([])
            out[-1].append(body)
        return [b"".join(f) for f in out]
    if len(parts) == 1:
        return [parts[0][1]]
    if len(parts) == n:
        return [b for _, b in parts]
    if n == 1:
        return [b"".join(b for _, b in parts)]
    out = [[]]
    for _, body in parts:
        out[-1].append(body)
        if b"\xff\xd9" in body[-10:]:
            out.append([])
    frames = [b"".join(f) for f in out if f]
    if len(frames) != n:
        raise ValueError(f"{len(parts)} fragments can't be told apart as {n} frames")
    return frames


def fragment(frame: bytes, n: int) -> list[bytes]:
    """n parts of even length, the last padded."""
    if n < 1 or n > (len(frame) + 1) // 2:
        raise ValueError("too many fragments")
    size = len(frame) // n
    size += size % 2
    parts = [frame[i * size : (i + 1) * size] for i in range(n - 1)] + [frame[(n - 1) * size :]]
    return [p + b"\0" * (len(p) % 2) for p in parts]


def single_frame(data: bytes, index: int, n: int = 1, eot: tuple[list[int], list[int]] | None = None) -> bytes:
    """One frame. With a table only the frame's own bytes are cut out; else its fragments are looked for."""
    if index < 0 or index >= (len(eot[0]) if eot else max(n, 1)):
        raise ValueError(f"there is no frame {index}")
    table, rest = split_offsets(data)
    if eot:
        at, size = eot[0][index], eot[1][index]
        if at + 8 + size > len(rest):
            raise ValueError("the extended offset table points beyond the data")
        return rest[at + 8 : at + 8 + size]
    if index < len(table):
        to = table[index + 1] if index + 1 < len(table) else len(rest)
        return b"".join(b for _, b in fragments_of(rest[table[index] : to]))
    found = frames_of(data, n)
    if index >= len(found):
        raise ValueError(f"there is no frame {index}")
    return found[index]


def count_fragments(data: bytes) -> int:
    """The fragments after the offset table."""
    return len(fragments_of(split_offsets(data)[1]))


def extended_table(offsets: bytes | None, lengths: bytes | None) -> tuple[list[int], list[int]] | None:
    """Offsets and lengths of (7FE0,0001) and (7FE0,0002); None where they are absent or don't agree."""
    n = len(offsets or b"") // 8
    if not n or len(lengths or b"") // 8 != n:
        return None
    return tuple(list(struct.unpack(f"<{n}Q", x[: 8 * n])) for x in (offsets, lengths))


def _starts(parts: list[bytes], first: int = 0) -> list[int]:
    """Where each part begins once they are joined."""
    return list(accumulate((len(p) for p in parts[:-1]), initial=first)) if parts else []


def encapsulate(frames: list[bytes], per_frame: int = 1, table: bool = True) -> bytes:
    """Offset table (empty unless wanted), then every frame's fragments."""
    bodies = [b"".join(itemise(p) for p in fragment(f, per_frame)) for f in frames]
    return itemise(struct.pack(f"<{len(frames)}I", *_starts(bodies)) if table else b"") + b"".join(bodies)


def encapsulate_extended(frames: list[bytes]) -> tuple[bytes, list[int], list[int]]:
    """(pixel data with an empty basic table, extended offsets, extended lengths)."""
    bodies = [itemise(f + b"\0" * (len(f) % 2)) for f in frames]
    return itemise(b"") + b"".join(bodies), _starts(bodies), [len(f) for f in frames]


def _packbits(row: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(row)
    while i < n:
        j = i + 1
        while j < n and row[j] == row[i] and j - i < 128:
            j += 1
        if j - i > 1:
            out += bytes((257 - (j - i), row[i]))
            i = j
            continue
        j = i + 1
        while j < n and j - i < 128 and not (j + 1 < n and row[j] == row[j + 1]):
            j += 1
        out += bytes((j - i - 1,)) + row[i:j]
        i = j
    return bytes(out)


def _unpackbits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        c = data[i]
        if c < 128:
            out += data[i + 1 : i + 2 + c]
            i += 2 + c
        elif c > 128:
            out += data[i + 1 : i + 2] * (257 - c)
            i += 2
        else:
            i += 1
    return bytes(out[:size])


def rle_encode(frame: bytes, rows: int, columns: int, samples: int, bits: int) -> bytes:
    """PS3.5 Annex G: a header of 16 words, then a segment per byte of a sample, high byte first."""
    wide = bits // 8
    if len(frame) != rows * columns * samples * wide:
        raise ValueError(f"{len(frame)} bytes instead of {rows * columns * samples * wide}")
    segments = []
    for s in range(samples):
        for b in reversed(range(wide)):
            plane = frame[s * wide + b :: samples * wide]
            seg = b"".join(_packbits(plane[i : i + columns]) for i in range(0, len(plane), columns or 1))
            segments.append(seg + b"\0" * (len(seg) % 2))
    return struct.pack("<16I", len(segments), *_starts(segments, 64), *([0] * (15 - len(segments)))) + b"".join(segments)


def rle_decode(data: bytes, rows: int, columns: int, samples: int, bits: int) -> bytes:
    """The inverse, samples interleaved."""
    head = struct.unpack("<16I", data[:64])
    n, wide = head[0], bits // 8
    if n != samples * wide:
        raise ValueError(f"{n} segments instead of {samples * wide}")
    ends = [*head[2 : n + 1], len(data)]
    out = bytearray(rows * columns * n)
    for k in range(n):
        seg = _unpackbits(data[head[k + 1] : ends[k]], rows * columns)
        if len(seg) < rows * columns:
            raise ValueError("a segment is too short")
        out[k // wide * wide + wide - 1 - k % wide :: n] = seg
    return bytes(out)


#: Frame codecs by transfer syntax: (decode, encode), each of (bytes, rows, columns, samples, bits).
CODECS: dict[str, tuple[Callable, Callable]] = {
    "1.2.840.10008.1.2.5": (rle_decode, rle_encode),
    "1.2.840.10008.1.2.8.1": (lambda d, *_: zlib.decompress(d, -15), lambda d, *_: (lambda c: c.compress(d) + c.flush())(zlib.compressobj(wbits=-15))),
}


def register_codec(uid: str, decode: Callable, encode: Callable) -> None:
    """Add a codec, such as one of the JPEG family where a library is at hand. Operators take the
    codecs registered on the driver along into their tasks (`registered`)."""
    CODECS[uid] = (decode, encode)


def registered() -> dict[str, tuple[Callable, Callable]]:
    """A copy of all codecs, to be pickled with a task's function."""
    return dict(CODECS)


def decode_frame(uid: str, data: bytes, rows: int, columns: int, samples: int, bits: int, codecs: dict | None = None) -> bytes:
    known = CODECS if codecs is None else codecs
    if uid not in known:
        raise SyntaxUnknownError(uid, "unsupported transfer syntax")
    return known[uid][0](data, rows, columns, samples, bits)


def encode_frame(uid: str, data: bytes, rows: int, columns: int, samples: int, bits: int, codecs: dict | None = None) -> bytes:
    known = CODECS if codecs is None else codecs
    if uid not in known:
        raise SyntaxUnknownError(uid, "unsupported transfer syntax")
    return known[uid][1](data, rows, columns, samples, bits)


def unpack_samples(data: bytes, bits: int, signed: bool, little: bool = True) -> np.ndarray:
    if bits not in (8, 16):
        raise ValueError("samples take 8 or 16 bits")
    return np.frombuffer(data, np.dtype(f"{'<' if little else '>'}{'i' if signed else 'u'}{bits // 8}")).astype(np.float64)


def interleave(data: bytes, samples: int, wide: int) -> bytes:
    """Planes to pixels."""
    return np.frombuffer(data, np.uint8).reshape(samples, -1, wide).transpose(1, 0, 2).tobytes()


def planes(data: bytes, samples: int, wide: int) -> bytes:
    """Pixels to planes."""
    return np.frombuffer(data, np.uint8).reshape(-1, samples, wide).transpose(1, 0, 2).tobytes()
