"""DICOM dataset bytes to flat elements and back. Plain Python; Spark calls it batch by batch."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

from voxelake.codec import charsets
from voxelake.dictionary import SEED, TRANSFER_SYNTAXES, Dictionary
from voxelake.errors import EncodingError, InvalidDicomError, MetaError, SyntaxUnknownError

ITEM, ITEM_END, SEQ_END, PIXEL_DATA, CHARSET = 0xFFFEE000, 0xFFFEE00D, 0xFFFEE0DD, 0x7FE00010, 0x00080005
UNDEFINED = 0xFFFFFFFF
MAX_DEPTH = 100
#: Representations whose explicit length takes four bytes.
LONG = frozenset("OB OD OF OL OV OW SQ SV UC UN UR UT UV".split())
#: Those of two bytes, as they are written.
_SHORT = {vr.encode(): vr for vr in "AE AS AT CS DA DS DT FD FL IS LO LT PN SH SL SS ST TM UI UL US".split()}
NUMBERS = {"US": "H", "SS": "h", "UL": "I", "SL": "i", "UV": "Q", "SV": "q", "FL": "f", "FD": "d"}
TEXT = frozenset("AE AS CS DA DS DT IS LO LT PN SH ST TM UC UI UR UT".split())
WHOLE = frozenset("LT ST UT UR".split())  # never split at a backslash
ENCODED = frozenset("LO LT PN SH ST UC UT".split())  # under the character set of the dataset
NUL_PADDED = frozenset("UI OB OD OF OL OV OW UN".split())
#: Bytes of one number of a representation, for a change of byte order.
WIDTHS = {**{vr: struct.calcsize(c) for vr, c in NUMBERS.items()}, "AT": 2, "OW": 2, "OL": 4, "OF": 4, "OD": 8, "OV": 8}


@dataclass
class Diagnostic:
    kind: str
    tag: int | None
    vr: str | None
    offset: int
    path: tuple
    need: int | None = None
    have: int | None = None
    message: str | None = None


@dataclass(slots=True)
class Element:
    """One element; `path` holds the (sequence tag, item) pairs above it."""

    path: tuple
    tag: int
    vr: str
    raw: bytes | None
    offset: int = 0
    length: int = 0
    undefined: bool = False
    deferred: bool = False
    charsets: list | None = None
    creator: str | None = None


@dataclass
class Reader:
    """Reads one byte string, or a `FileBytes` of which only what is looked at is fetched. Options as
    for `read_dicom`; `values`: the tags whose bytes are wanted, all where None."""

    data: bytes
    implicit: bool
    little: bool
    tags: frozenset | None = None
    stop_before_pixels: bool = False
    defer_size: int = 0
    dictionary: Dictionary = field(default_factory=lambda: SEED)
    values: frozenset | None = None
    elements: list = field(default_factory=list)
    diagnostics: list = field(default_factory=list)

    def u16(self, at: int) -> int:
        return int.from_bytes(self.data[at : at + 2], "little" if self.little else "big")

    def u32(self, at: int) -> int:
        return int.from_bytes(self.data[at : at + 4], "little" if self.little else "big")

    def tag(self, at: int) -> int:
        if not self.little:
            return self.u32(at)
        both = int.from_bytes(self.data[at : at + 4], "little")
        return (both & 0xFFFF) << 16 | both >> 16

    def say(self, kind: str, tag, vr, at: int, path: tuple, need=None, have=None) -> None:
        self.diagnostics.append(Diagnostic(kind, tag, vr, at, path, need, have))

    def header(self, at: int, end: int, tag: int, creators: dict) -> tuple[str, int, int] | None:
        """(vr, length, header size); None with a diagnostic where bytes are missing. Two bytes
        that are no VR make that element implicit."""
        if not self.implicit:
            raw = self.data[at + 4 : at + 6]
            vr = _SHORT.get(raw)
            if vr is not None:
                return (vr, self.u16(at + 6), 8) if at + 8 <= end else None
            if len(raw) == 2 and raw.isalpha() and raw.isupper():
                vr = raw.decode()
                if vr not in LONG:
                    return (vr, self.u16(at + 6), 8) if at + 8 <= end else None
                return (vr, self.u32(at + 8), 12) if at + 12 <= end else None
        if at + 8 > end:
            return None
        return self.dictionary.vr(tag, creators.get((tag >> 16, (tag & 0xFFFF) >> 8))), self.u32(at + 4), 8

    def read(self, at: int, end: int, path: tuple = (), sets: list | None = None, closing: bool = False, only_group: int | None = None) -> int:
        """Elements from `at`; returns the place after the last one read."""
        creators: dict = {}
        while at < end:
            if at + 8 > end:
                self.say("truncated_header", None, None, at, path, 8, end - at)
                return end
            tag = self.tag(at)
            if only_group is not None and tag >> 16 != only_group:
                return at
            if tag in (ITEM_END, SEQ_END):
                return at + 8 if closing else at
            if self.stop_before_pixels and tag == PIXEL_DATA and not path:
                return end
            head = self.header(at, end, tag, creators)
            if head is None:
                self.say("truncated_header", tag, None, at, path, 12, end - at)
                return end
            vr, length, size = head
            body = at + size
            keep = self.tags is None or tag in self.tags or tag >> 16 == 2 or tag == CHARSET
            keep = keep and not (self.stop_before_pixels and tag == PIXEL_DATA)  # an item's: what follows it still counts
            if vr == "SQ" or (vr == "UN" and length == UNDEFINED):
                place = len(self.elements)
                mark = Element(path, tag, "SQ", None, body, length if length != UNDEFINED else 0, length == UNDEFINED, charsets=sets)
                self.elements.append(mark)
                implicit = self.implicit
                if vr == "UN":
                    self.implicit = True  # unknown sequences are implicit inside
                stop = end if length == UNDEFINED else min(body + length, end)
                if length != UNDEFINED and body + length > end:
                    self.say("truncated_value", tag, vr, body, path, length, end - body)
                at = self.items(body, stop, (*path, tag), sets, length == UNDEFINED)
                self.implicit = implicit
                if not keep:
                    del self.elements[place:]
                continue
            if length == UNDEFINED:
                stop = self.encapsulated_end(body, end)
                if keep:
                    late = bool(self.defer_size) and stop - body > self.defer_size
                    asked = not late and (self.values is None or tag in self.values)
                    self.elements.append(Element(path, tag, vr, self.data[body:stop] if asked else None, body, stop - body, True, late, sets))
                at = min(stop + 8, end)
                continue
            if body + length > end:
                self.say("truncated_value", tag, vr, body, path, length, end - body)
                return end
            late = bool(self.defer_size) and length > self.defer_size and tag != CHARSET
            asked = keep and not late and (self.values is None or tag in self.values)
            raw = self.data[body : body + length] if asked or tag == CHARSET or (tag >> 16 & 1 and 0x10 <= tag & 0xFFFF <= 0xFF) else None
            if tag >> 16 & 1 and 0x10 <= tag & 0xFFFF <= 0xFF:
                creators[tag >> 16, tag & 0xFF] = raw.decode("latin-1").strip(" \0")
            if tag == CHARSET:
                sets = raw.decode("latin-1").rstrip(" \0").split("\\")
            if keep:
                self.elements.append(Element(path, tag, vr, raw, body, length, False, late, sets, creators.get((tag >> 16, (tag & 0xFFFF) >> 8))))
            at = body + length
        return at

    def items(self, at: int, end: int, path: tuple, sets: list | None, undefined: bool) -> int:
        """The items of a sequence; `path` ends with its tag."""
        if len(path) > MAX_DEPTH:
            raise ValueError("sequences nest too deeply")
        n = 0
        while at < end:
            if at + 8 > end:
                self.say("truncated_item", path[-1], "SQ", at, path[:-1], 8, end - at)
                return end
            tag, length = self.tag(at), self.u32(at + 4)
            if tag == SEQ_END:
                return at + 8
            if tag != ITEM:
                return at
            body = at + 8
            stop = end if length == UNDEFINED else body + length
            if stop > end:
                self.say("truncated_item", path[-1], "SQ", body, path[:-1], length, end - body)
                stop = end
            here = (*path[:-1], (path[-1], n))
            got = self.read(body, stop, here, sets, length == UNDEFINED)
            at = got if length == UNDEFINED else stop
            n += 1
        return at

    def encapsulated_end(self, at: int, end: int) -> int:
        """Where the sequence delimiter of fragments begins (or `end`)."""
        mark = struct.pack("<HHI" if self.little else ">HHI", 0xFFFE, 0xE0DD, 0)
        here = at
        while here + 8 <= end:
            tag, length = self.tag(here), self.u32(here + 4)
            if tag == SEQ_END:
                return here
            if tag != ITEM or length == UNDEFINED:
                break
            here += 8 + length
        found = self.data.find(mark[:4], at, end)
        return end if found < 0 else found


def syntax(uid: str | None) -> tuple[bool, bool, bool]:
    """(implicit, little endian, deflated) of a transfer syntax; unknown ones are explicit little endian."""
    return uid == "1.2.840.10008.1.2", uid != "1.2.840.10008.1.2.2", uid == "1.2.840.10008.1.2.1.99"


def inflate(data: bytes) -> tuple[bytes, str | None]:
    """(what could be inflated, what went wrong)."""
    d, out = zlib.decompressobj(-15), bytearray()
    try:
        for at in range(0, len(data), 4096):
            out += d.decompress(data[at : at + 4096])
        out += d.flush()
    except zlib.error as x:
        return bytes(out), f"damaged deflated data: {x}"
    return bytes(out), None if d.eof else "the deflated data end too early"


def _read(data: bytes, at: int, implicit: bool, little: bool, deflated: bool, options: dict) -> Reader:
    body, fault = inflate(data[at:]) if deflated else (data, None)
    r = Reader(body, implicit, little, **options)
    r.read(0 if deflated else at, len(body))
    if fault:
        r.diagnostics.append(Diagnostic("invalid_value", None, None, len(body), (), message=fault))
    return r


def parse_dataset(data: bytes, uid: str, **options) -> Reader:
    """A bare dataset of a known transfer syntax."""
    if uid not in TRANSFER_SYNTAXES:
        raise SyntaxUnknownError(uid)
    implicit, little, deflated = syntax(uid)
    return _read(data, 0, implicit, little, deflated, options)


def parse_file(data: bytes, force: bool = False, **options) -> tuple[dict, Reader]:
    """(facts of the file, reader with meta and dataset elements) of a Part 10 byte string."""
    part10 = len(data) >= 132 and data[128:132] == b"DICM"
    if not part10 and not force:
        raise InvalidDicomError("no DICM prefix")
    at = 132 if part10 else 0
    meta = Reader(data, False, True)
    if data[at : at + 2] == b"\x02\x00":
        meta.implicit = not data[at + 4 : at + 6].isalpha()
        at = meta.read(at, len(data), only_group=2)
    uid = next((e.raw.decode("latin-1").rstrip(" \0") for e in meta.elements if e.tag == 0x00020010), None)
    implicit, little, deflated = syntax(uid)
    vr_of = options.get("dictionary", SEED).vr
    if uid is None:
        implicit, little = True, True
        if len(data) >= at + 6 and data[at + 4 : at + 6].isalpha() and data[at + 4 : at + 6].isupper():
            implicit, little = False, not (data[at] == 0 and data[at + 1] and vr_of(int.from_bytes(data[at : at + 2], "big") << 16 | int.from_bytes(data[at + 2 : at + 4], "big")) != "UN")
    r = _read(data, at, implicit, little, deflated, options)
    if uid is not None and uid not in TRANSFER_SYNTAXES:
        r.say("invalid_value", 0x00020010, "UI", 0, ())
    sets = next((e.raw.decode("latin-1").rstrip(" \0").split("\\") for e in r.elements if e.tag == CHARSET and not e.path and e.raw), None)
    facts = {"preamble": data[:128] if part10 else None, "transfer_syntax": uid, "implicit_vr": implicit, "little_endian": little, "charsets": sets}
    r.elements[:0] = meta.elements
    r.diagnostics[:0] = meta.diagnostics
    return facts, r


def values_of(vr: str, raw: bytes | None, little: bool, sets: list | None = None) -> list[str] | None:
    """The values of an element as text, one entry a value; None for byte representations."""
    if raw is None or vr in ("SQ", "OB", "OD", "OF", "OL", "OV", "OW", "UN") or " or " in vr:
        return None
    if vr in NUMBERS:
        code = NUMBERS[vr]
        size = struct.calcsize(code)
        if len(raw) % size and vr not in ("FL", "FD"):
            raise ValueError(f"{len(raw)} bytes are no multiple of {size}")
        n = len(raw) // size
        return [repr(v) for v in struct.unpack(f"{'<' if little else '>'}{n}{code}", raw[: n * size])]
    if vr == "AT":
        if len(raw) % 4:
            raise ValueError("tags take four bytes each")
        order = "little" if little else "big"
        return [f"{int.from_bytes(raw[i : i + 2], order):04X}{int.from_bytes(raw[i + 2 : i + 4], order):04X}" for i in range(0, len(raw), 4)]
    text = charsets.decode(raw, sets, b"^=\\" if vr == "PN" else b"\\\r\n\t\f") if vr in ENCODED else raw.decode("latin-1")
    text = text.rstrip(" \0")
    if not text:
        return []
    parts = [text] if vr in WHOLE else text.split("\\")
    return [p.strip(" ") for p in parts] if vr in ("AE", "CS", "DS", "IS", "LO", "SH") else [p.rstrip(" \0") for p in parts]


def swapped(vr: str, raw: bytes, undefined: bool = False) -> bytes:
    """A value in the other byte order. Encapsulated data, text and plain bytes are the same in both."""
    size = WIDTHS.get(vr, 1)
    if size == 1 or undefined:
        return raw
    if len(raw) % size:
        raise ValueError(f"{len(raw)} bytes of {vr} are no multiple of {size}")
    return b"".join(raw[i : i + size][::-1] for i in range(0, len(raw), size)) if size != 2 else _swap_pairs(raw)


def _swap_pairs(raw: bytes) -> bytes:
    out = bytearray(raw)
    out[0::2], out[1::2] = raw[1::2], raw[0::2]
    return bytes(out)


def to_raw(vr: str, values: list, little: bool, sets: list | None = None) -> bytes:
    """Value bytes of text or number values, padded to even length. Text that the character sets can't
    hold is an error."""
    if vr in NUMBERS:
        kind = float if vr in ("FL", "FD") else int
        return struct.pack(f"{'<' if little else '>'}{len(values)}{NUMBERS[vr]}", *(kind(v) for v in values))
    if vr == "AT":
        order = "little" if little else "big"
        return b"".join(int(v[:4], 16).to_bytes(2, order) + int(v[4:], 16).to_bytes(2, order) for v in values)
    text = "\\".join("" if v is None else str(v) for v in values)
    return pad(vr, charsets.encode(text, sets, "^=\\" if vr == "PN" else "\\\r\n\t\f") if vr in ENCODED else text.encode("latin-1"))


def pad(vr: str, raw: bytes) -> bytes:
    return raw + (b"\0" if vr in NUL_PADDED else b" ") if len(raw) % 2 else raw


def element_bytes(tag: int, vr: str, raw: bytes, implicit: bool, little: bool, undefined: bool = False) -> bytes:
    """Header and value of one element; undefined length gets its delimiter."""
    order = "<" if little else ">"
    raw = raw if undefined or vr == "SQ" else pad(vr, raw)
    length = UNDEFINED if undefined else len(raw)
    head = struct.pack(f"{order}HH", tag >> 16, tag & 0xFFFF)
    if implicit:
        head += struct.pack(f"{order}I", length)
    elif vr in LONG:
        head += vr.encode() + b"\0\0" + struct.pack(f"{order}I", length)
    else:
        if length > 0xFFFF:
            return element_bytes(tag, "UN", raw, implicit, little)
        head += vr.encode() + struct.pack(f"{order}H", length)
    return head + raw + (struct.pack(f"{order}HHI", 0xFFFE, 0xE0DD, 0) if undefined else b"")


def encode_dataset(elements: list[tuple], uid: str) -> bytes:
    """Bytes of (path, tag, vr, raw, undefined) tuples of one dataset, in any order.

    path holds (sequence tag, item) pairs; sequences are implied by the paths below them, and empty
    ones given as elements of VR SQ. Retired group lengths are dropped.
    """
    if uid not in TRANSFER_SYNTAXES:
        raise SyntaxUnknownError(uid)
    implicit, little, deflated = syntax(uid)
    root: dict = {}
    for path, tag, vr, raw, undefined in elements:
        at = root
        if len(path) > MAX_DEPTH:
            raise ValueError("sequences nest too deeply")
        for seq, item in path:
            at = at.setdefault(seq, {}).setdefault(item, {})
        if vr == "SQ":
            at.setdefault(tag, {})
        elif not (tag & 0xFFFF == 0 and tag >> 16 > 6):
            at[tag] = (vr, raw, undefined)

    def write(ds: dict) -> bytes:
        out = bytearray()
        for tag in sorted(ds):
            v = ds[tag]
            if isinstance(v, dict):
                body = b"".join(struct.pack("<HHI" if little else ">HHI", 0xFFFE, 0xE000, len(b)) + b for b in (write(v[i]) for i in sorted(v)))
                out += element_bytes(tag, "SQ", body, implicit, little)
            else:
                out += element_bytes(tag, v[0], v[1] or b"", implicit, little, bool(v[2]))
        return bytes(out)

    body = write(root)
    if deflated:
        c = zlib.compressobj(wbits=-15)
        body = c.compress(body) + c.flush()
        body += b"\0" * (len(body) % 2)
    return body


#: Fixed value: this implementation's UID under the UUID root.
IMPLEMENTATION_UID, IMPLEMENTATION_NAME = "2.25.329800735698586629295641978511506172918", "VOXELAKE_1"


def encode_file(elements: list[tuple], uid: str, sop_class: str | None, sop_instance: str | None, preamble: bytes | None = None, meta_among: bool = False) -> bytes:
    """A Part 10 file: preamble, complete group 2 with its length, dataset. Groups 0 and 2 have no
    place among the elements, unless `meta_among` says that group 2 there is the file's own: it then
    goes before what is made here, but for its length and transfer syntax. A missing required element
    is an error."""
    given = {t: (vr, raw) for p, t, vr, raw, *_ in elements if not p and t >> 16 == 2}
    elements = [e for e in elements if e[0] or e[1] >> 16 != 2] if meta_among else elements
    if any(not p and t >> 16 in (0, 2) for p, t, *_ in elements):
        raise MetaError("groups 0000 and 0002 don't belong to the dataset")
    meta = {0x00020001: ("OB", b"\0\1"), 0x00020002: ("UI", (sop_class or "").encode()), 0x00020003: ("UI", (sop_instance or "").encode()), 0x00020010: ("UI", uid.encode()),
            0x00020012: ("UI", IMPLEMENTATION_UID.encode()), 0x00020013: ("SH", IMPLEMENTATION_NAME.encode())}
    meta = {t: v for t, v in {**meta, **{t: v for t, v in given.items() if t not in (0x00020000, 0x00020010)}}.items() if v[1]}
    if missing := missing_meta(set(meta)):
        raise MetaError("the file meta information lacks " + ", ".join(f"({t >> 16:04X},{t & 0xFFFF:04X})" for t in missing))
    body = b"".join(element_bytes(t, vr, raw, False, True) for t, (vr, raw) in sorted(meta.items()))
    return (preamble or bytes(128)) + b"DICM" + element_bytes(0x00020000, "UL", struct.pack("<I", len(body)), False, True) + body + encode_dataset(elements, uid)


#: What a complete group 2 must hold.
REQUIRED_META = (0x00020001, 0x00020002, 0x00020003, 0x00020010, 0x00020012)


def missing_meta(tags: set[int]) -> list[int]:
    """Required elements of group 2 that are not among `tags`; groups other than 2 are an error."""
    if any(t >> 16 != 2 for t in tags):
        raise MetaError("only group 0002 belongs to the file meta information")
    return [t for t in REQUIRED_META if t not in tags]


def write_encoding(meta_uid: str | None, implicit: bool | None = None, little: bool | None = None) -> tuple[bool, bool]:
    """(implicit, little endian) to write with: the file meta's transfer syntax, which options must
    not contradict, else both options. Known UIDs that are no transfer syntax are an error, private
    ones need both options; implicit big endian does not exist."""
    if meta_uid in TRANSFER_SYNTAXES:
        want = syntax(meta_uid)[:2]
        if (implicit, little) != (None, None) and (implicit if implicit is not None else want[0], little if little is not None else want[1]) != want:
            raise EncodingError("the options contradict the transfer syntax")
        return want
    if meta_uid is not None and meta_uid.startswith("1.2.840.10008."):
        raise EncodingError(f"{meta_uid} is no transfer syntax")
    if implicit is None or little is None:
        raise EncodingError("without a known transfer syntax both options are needed")
    if implicit and not little:
        raise EncodingError("implicit big endian does not exist")
    return implicit, little
