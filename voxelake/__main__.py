"""python -m voxelake show|read FILE [-t TAG]... [--top N] [--no-meta] [--debug]: the elements of one file, one line each.
python -m voxelake readcopy FROM TO: read a file, write it anew and compare."""

from __future__ import annotations

import argparse
import sys

from voxelake.codec.dataset import encode_file, parse_file, values_of
from voxelake.dictionary import SEED, parse_tag
from voxelake.log import disable, enable, logger


def lines(data: bytes, tags: list[int] | None = None, meta: bool = True, top: int | None = None):
    """The lines of a dump of one file; with `top` no more elements than that."""
    facts, r = parse_file(data, force=True)
    logger("reader").debug("parsed elements=%d diagnostics=%d transfer_syntax=%s", len(r.elements), len(r.diagnostics), facts["transfer_syntax"])
    shown = [e for e in r.elements if (meta or e.tag >> 16 != 2) and (not tags or e.tag in tags)]
    for e in shown[:top]:
        try:
            v = values_of(e.vr, e.raw, r.little or e.tag >> 16 == 2, e.charsets)
        except (ValueError, LookupError):
            v = None
        text = "\\".join(v) if v is not None else f"Array of {len(e.raw)} bytes" if e.raw else ""
        yield f"{'  ' * len(e.path)}({e.tag >> 16:04X},{e.tag & 0xFFFF:04X}) {SEED.keyword(e.tag):36} {e.vr}: {text if len(text) <= 64 else text[:61] + '...'}"


def copied(data: bytes) -> bytes:
    """The file written anew from its elements, its own meta information kept."""
    facts, r = parse_file(data)
    body = [(e.path, e.tag, e.vr, e.raw, e.undefined and e.vr != "SQ") for e in r.elements]
    meta = {e.tag: (e.raw or b"").decode("latin-1").rstrip(" \0") for e in r.elements if e.tag >> 16 == 2 and not e.path}
    logger("writer").debug("writing elements=%d", len(body))
    return encode_file(body, facts["transfer_syntax"] or "1.2.840.10008.1.2", meta.get(0x00020002), meta.get(0x00020003), facts["preamble"], meta_among=True)


def readcopy(source: str, target: str) -> int:
    """0 where the copy holds as many elements of the dataset as the file."""
    with open(source, "rb") as f:
        data = f.read()
    count = lambda b: sum(e.tag >> 16 != 2 for e in parse_file(b)[1].elements)
    print(f"Read {count(data)} elements from {source}")
    with open(target, "wb") as f:
        f.write(copied(data))
    print(f"Written to {target}")
    with open(target, "rb") as f:
        again = count(f.read())
    print(f"Read {again} elements from {target}")
    if again != count(data):
        print("the number of elements has changed", file=sys.stderr)
    return int(again != count(data))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="voxelake")
    p.add_argument("command", choices=["show", "read", "readcopy"])
    p.add_argument("file")
    p.add_argument("target", nargs="?")
    p.add_argument("-t", "--tag", action="append", default=[])
    p.add_argument("--top", type=int)
    p.add_argument("--no-meta", action="store_true")
    p.add_argument("--debug", action="store_true")
    a = p.parse_args(argv)
    handler = enable() if a.debug else None
    try:
        if a.command == "readcopy":
            if a.target is None:
                p.error("readcopy needs the file to write")
            return readcopy(a.file, a.target)
        with open(a.file, "rb") as f:
            for line in lines(f.read(), [parse_tag(t) for t in a.tag], not a.no_meta, a.top):
                print(line)
    except (OSError, ValueError) as x:
        print(f"error: {x}", file=sys.stderr)
        return 1
    finally:
        if handler is not None:
            disable(handler)
    return 0


if __name__ == "__main__":
    sys.exit(main())
