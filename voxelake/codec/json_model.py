"""Whole datasets, nested ones included, to and from the DICOM JSON model. The only implementation;
the DataFrame operators call it batch by batch."""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Callable, Iterator

from voxelake.codec.dataset import NUMBERS, Reader, values_of
from voxelake.dictionary import SEED, Dictionary

_NUMERIC = frozenset(NUMBERS) | {"DS", "IS"}
_WHOLE, _FRACTION = re.compile(r" *[+-]?[0-9]+ *"), re.compile(r" *[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)? *")
_BYTES = frozenset("OB OD OF OL OV OW UN".split())
_GROUPS = ("Alphabetic", "Ideographic", "Phonetic")

BulkWriter = Callable[[str, str, bytes], str]
BulkReader = Callable[[int, str, str], bytes]


def json_element(vr: str, strings: list | None, raw: bytes | None, items: list | None, bulk: str | None = None) -> dict:
    """One element: vr with Value, InlineBinary or `bulk` as its BulkDataURI; empty ones only vr."""
    out: dict = {"vr": vr}
    if vr == "SQ":
        if items:
            out["Value"] = items
    elif strings:
        out["Value"] = [_value(vr, s) for s in strings]
    elif raw and strings is None:
        if bulk is not None:
            out["BulkDataURI"] = bulk
        else:
            out["InlineBinary"] = base64.b64encode(raw).decode()
    return out


def _value(vr: str, s: str | None):
    """One JSON value. Numbers that JSON can't write as such (not a number, out of range) stay text."""
    if s is None or s == "":
        return None
    if vr == "PN":
        return {k: v for k, v in zip(_GROUPS, s.split("="), strict=False) if v}
    if vr in _NUMERIC:
        if _WHOLE.fullmatch(s) and vr not in ("FL", "FD", "DS"):
            return int(s)
        if vr in ("FL", "FD", "DS") and _FRACTION.fullmatch(s) and abs(number := float(s)) != float("inf"):
            return number
    return s


def dataset_json(elements: list[dict], bulk_bytes: int | None = None, bulk_base: str | BulkWriter | None = None) -> str:
    """JSON text of one dataset from rows with path, tag, vr, strings, raw; keys in order.

    Byte values longer than `bulk_bytes` become BulkDataURI: `bulk_base` and their place, or what the
    function `bulk_base` makes of (place, vr, bytes).
    """
    root: dict = {}
    for e in elements:
        at = root
        for step in e["path"] or ():
            held = at.get(step["tag"])
            if held is None or "items" not in held:
                held = at[step["tag"]] = {"vr": "SQ", "items": {}}
            at = held["items"].setdefault(step["item"], {})
        if e["vr"] == "SQ":
            at.setdefault(e["tag"], {"vr": "SQ", "items": {}})
        else:
            at[e["tag"]] = e

    def write(ds: dict, where: str) -> dict:
        out = {}
        for tag in sorted(ds):
            v, key = ds[tag], f"{tag:08X}"
            here = f"{where}/{key}"
            items = [write(v["items"][i], f"{here}/{i}") for i in sorted(v["items"])] if "items" in v else None
            bulk, raw = None, v.get("raw")
            if bulk_base is not None and bulk_bytes is not None and raw and len(raw) > bulk_bytes:
                bulk = bulk_base(here, v["vr"], raw) if callable(bulk_base) else bulk_base + here
            out[key] = json_element(v["vr"], v.get("strings"), raw, items, bulk)
        return out

    return json.dumps(write(root, ""), ensure_ascii=False, separators=(",", ":"))


def _text(vr: str | None, v) -> str | None:
    """A JSON value as the text of an element's value."""
    if v is None or v == "":
        return None
    if isinstance(v, dict):
        return "=".join(str(v.get(g) or "") for g in _GROUPS).rstrip("=") if any(g in v for g in _GROUPS) else json.dumps(v, ensure_ascii=False)
    if isinstance(v, bool):
        return "true" if v else "false"
    if vr == "AT" and re.fullmatch("[0-9A-Fa-f]{1,8}", str(v)):
        return str(v).upper().zfill(8)
    return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)


class _Number(str):
    """A number as it is written."""


def json_elements(text: str, dictionary: Dictionary = SEED, bulk_reader: BulkReader | None = None) -> Iterator[tuple]:
    """(path, tag, vr, strings, raw, bulk_uri, error) of every element of one JSON dataset, or of each
    dataset of a list (the path of those begins with (0, its place)), keys in order.

    Unknown bytes (UN) are read by the dictionary where it knows better. What doesn't follow the model
    keeps what can be read and says why in error: keys that are no tags, several value keys, a Value
    that is no list, bytes that are no base64.
    """
    top = json.loads(text, parse_int=_Number, parse_float=_Number)
    for i, ds in enumerate(top if isinstance(top, list) else [top]):
        yield from _dataset(ds, ((0, i),) if isinstance(top, list) else (), dictionary, bulk_reader)


def _dataset(ds, path: tuple, dictionary: Dictionary, bulk_reader: BulkReader | None) -> Iterator[tuple]:
    if not isinstance(ds, dict):
        if ds is not None:
            yield path, None, None, None, None, None, "an item must be an object"
        return
    for key in sorted(ds):
        if not re.fullmatch("[0-9A-Fa-f]{1,8}", key):
            yield path, None, None, None, None, None, f"{key!r} is no tag"
            continue
        yield from _element(int(key, 16), ds[key], path, dictionary, bulk_reader)


def _element(tag: int, e, path: tuple, dictionary: Dictionary, bulk_reader: BulkReader | None) -> Iterator[tuple]:
    if not isinstance(e, dict):
        yield path, tag, None, None if e is None else [_text(None, e)], None, None, "an element must be an object"
        return
    vr = e.get("vr") if isinstance(e.get("vr"), str) else None
    held = [k for k in ("Value", "InlineBinary", "BulkDataURI") if e.get(k) is not None]
    error = f"several value keys: {', '.join(held)}" if len(held) > 1 else None
    if not held:
        yield path, tag, vr, None if vr in _BYTES or vr == "SQ" else [], None, None, None
    elif held[0] == "Value":
        values = e["Value"]
        if not isinstance(values, list):
            error, values = error or "Value must be a list", [values]
        items = vr == "SQ" or any(isinstance(v, dict) and any(re.fullmatch("[0-9A-Fa-f]{1,8}", k) for k in v) for v in values)
        yield path, tag, "SQ" if items else vr, None if items else [_text(vr, v) for v in values], None, None, error
        for i, v in enumerate(values if items else ()):
            yield from _dataset(v, (*path, (tag, i)), dictionary, bulk_reader)
    else:
        text = e[held[0]]
        text = text[0] if isinstance(text, list) and text else text
        if not isinstance(text, str):
            yield path, tag, vr, None, None, None, error or f"{held[0]} must be a string"
        elif held[0] == "BulkDataURI":
            raw = bulk_reader(tag, vr or "UN", text) if bulk_reader else None
            yield path, tag, vr, None, raw, text, error
        else:
            try:
                raw = base64.b64decode(text, validate=True)
            except (binascii.Error, ValueError):
                yield path, tag, vr, None, None, None, error or "InlineBinary is no base64"
                return
            yield from _unknown(tag, vr, raw, path, error, dictionary)


def _unknown(tag: int, vr: str | None, raw: bytes, path: tuple, error: str | None, dictionary: Dictionary) -> Iterator[tuple]:
    """Inline bytes; those of UN as what the dictionary says, a sequence as implicit little endian."""
    known = dictionary.vr(tag) if vr == "UN" else "UN"
    if known == "SQ":
        r = Reader(raw, True, True, dictionary=dictionary)
        r.items(0, len(raw), (tag,), None, False)
        yield path, tag, "SQ", None, None, None, error or (f"damaged sequence: {r.diagnostics[0].kind}" if r.diagnostics else None)
        for e in r.elements:
            yield (*path, *e.path), e.tag, e.vr, values_of(e.vr, e.raw, True, e.charsets), e.raw, None, None
        return
    if known in _BYTES or " or " in known:
        yield path, tag, vr if known == "UN" else known, None, raw, None, error
        return
    try:
        strings = values_of(known, raw, True)
    except (ValueError, LookupError) as x:
        yield path, tag, vr, None, raw, None, error or str(x)
        return
    yield path, tag, known, strings, raw, None, error
