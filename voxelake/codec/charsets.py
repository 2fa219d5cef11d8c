"""Bytes to text and back under DICOM character sets, with ISO 2022 code extensions."""

from __future__ import annotations

import re

#: Fixed values (public DICOM PS3.3 C.12): set -> Python codec, set -> escape sequences.
CODECS = {
    "ISO_IR 6": "latin-1", "ISO_IR 100": "latin-1", "ISO_IR 101": "iso8859-2", "ISO_IR 109": "iso8859-3", "ISO_IR 110": "iso8859-4", "ISO_IR 126": "iso8859-7",
    "ISO_IR 127": "iso8859-6", "ISO_IR 138": "iso8859-8", "ISO_IR 144": "iso8859-5", "ISO_IR 148": "iso8859-9", "ISO_IR 166": "cp874", "ISO_IR 13": "shift_jis",
    "ISO_IR 192": "utf-8", "GB18030": "gb18030", "GBK": "gbk", "ISO_IR 87": "iso2022_jp", "ISO_IR 159": "iso2022_jp_2", "ISO_IR 149": "euc_kr", "ISO_IR 58": "gb2312",
}
ESCAPES = {
    "ISO_IR 6": b"\x1b(B", "ISO_IR 13": b"\x1b)I", "ISO_IR 87": b"\x1b$B", "ISO_IR 159": b"\x1b$(D", "ISO_IR 149": b"\x1b$)C", "ISO_IR 58": b"\x1b$)A", "ISO_IR 100": b"\x1b-A",
    "ISO_IR 101": b"\x1b-B", "ISO_IR 109": b"\x1b-C", "ISO_IR 110": b"\x1b-D", "ISO_IR 126": b"\x1b-F", "ISO_IR 127": b"\x1b-G", "ISO_IR 138": b"\x1b-H", "ISO_IR 144": b"\x1b-L",
    "ISO_IR 148": b"\x1b-M", "ISO_IR 166": b"\x1b-T",
}
_BY_ESCAPE = {**{v: k for k, v in ESCAPES.items()}, b"\x1b(J": "ISO_IR 13"}
_FRAGMENT = re.compile(rb"^[^\x1b]+|\x1b[^\x1b]*", re.S)


def base_name(name: str) -> str:
    """ISO 2022 IR n and ISO_IR n name the same repertoire; empty is the default."""
    n = (name or "").strip().upper()
    m = re.fullmatch(r"ISO[ _-]?(?:2022[ _-]?)?IR[ _-]?(\d+)", n)
    n = f"ISO_IR {m[1]}" if m else n
    return n if n in CODECS else "ISO_IR 6"


def decode(data: bytes, sets: list[str] | None, delimiters: bytes = b"") -> str:
    """Text of `data`. Fragments after a known escape use its set; a delimiter ends that and
    returns to the first set. Bytes that a set lacks become U+FFFD."""
    names = [base_name(s) for s in sets or []] or ["ISO_IR 6"]
    first = names[0]
    if b"\x1b" not in data:
        return data.decode(CODECS[first], "replace")
    allowed = {*names, "ISO_IR 6"}
    out = []
    for piece in _FRAGMENT.findall(data):
        name, body = first, piece
        for esc, known in _BY_ESCAPE.items():
            if piece.startswith(esc):
                name, body = (known if known in allowed else first), piece[len(esc) :]
                break
        cut = next((i for i, b in enumerate(body) if b in delimiters), len(body)) if name not in ("ISO_IR 87", "ISO_IR 159") else len(body)
        head, tail = body[:cut], body[cut:]
        if name in ("ISO_IR 87", "ISO_IR 159"):
            out.append((ESCAPES[name] + head).decode(CODECS[name], "replace"))
        else:
            out.append(head.decode(CODECS[name], "replace"))
        out.append(tail.decode(CODECS[first], "replace"))
    return "".join(out)


def _bytes(text: str, name: str, errors: str = "strict") -> bytes:
    """Bytes of `text` in one set. JIS X 0201 has one byte a character; its Python codec knows more."""
    data = text.encode("ascii" if name == "ISO_IR 6" else CODECS[name], errors)
    if name == "ISO_IR 13" and len(data) != len(text):
        if errors == "strict":
            raise UnicodeEncodeError("JIS X 0201", text, 0, len(text), "not in this set")
        return b"".join(b if len(b := c.encode(CODECS[name], errors)) == 1 else b"?" for c in text)
    return data


def encode(text: str, sets: list[str] | None, delimiters: str = "", errors: str = "strict") -> bytes:
    """Bytes of `text`: in the first set if it fits, else each run in the first set that holds it,
    with its escape; runs end at delimiters. Characters that no set holds are an error (a ValueError),
    or become ? where `errors` is "replace"."""
    names = [base_name(s) for s in sets or []] or ["ISO_IR 6"]
    try:
        return _bytes(text, names[0])
    except UnicodeEncodeError:
        if len(names) == 1:
            return _bytes(text, names[0], errors)
    out = bytearray()
    for part in re.split(f"([{re.escape(delimiters)}])", text) if delimiters else [text]:
        while part:
            for name in names:
                n = _fits(part, name)
                if n:
                    break
            else:
                name, n = names[0], 1
            run, part = part[:n], part[n:]
            data = _bytes(run, name, errors)
            if name == names[0] or CODECS[name].startswith("iso2022"):
                out += data
            else:
                out += ESCAPES.get(name, b"") + data
    return bytes(out)


def _fits(text: str, name: str) -> int:
    for i, c in enumerate(text):
        try:
            _bytes(c, name)
        except UnicodeEncodeError:
            return i
    return len(text)
