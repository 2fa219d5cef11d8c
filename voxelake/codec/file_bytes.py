"""A file as a byte string of which only the parts that are looked at are fetched."""

from __future__ import annotations

from collections import OrderedDict
from typing import BinaryIO

BLOCK, KEPT = 1 << 16, 8


class FileBytes:
    """Slices of a seekable file. Small ones come from blocks kept at hand, long ones are read as they
    are; skipped values cost no reading."""

    def __init__(self, file: BinaryIO, size: int):
        self.file, self.size, self.fetched = file, size, 0
        self.blocks: OrderedDict[int, bytes] = OrderedDict()

    def __len__(self) -> int:
        return self.size

    def _fetch(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        got = self.file.read(n)
        self.fetched += len(got)
        return got

    def _block(self, i: int) -> bytes:
        if i not in self.blocks:
            self.blocks[i] = self._fetch(i * BLOCK, BLOCK)
            if len(self.blocks) > KEPT:
                self.blocks.popitem(last=False)
        return self.blocks[i]

    def __getitem__(self, at: int | slice) -> int | bytes:
        if isinstance(at, int):
            return self[at : at + 1][0]
        start, stop, step = at.indices(self.size)
        if step != 1:
            raise ValueError("only plain slices")
        if stop <= start:
            return b""
        if stop - start > BLOCK:
            return self._fetch(start, stop - start)
        first, last = start // BLOCK, (stop - 1) // BLOCK
        joined = self._block(first) if first == last else self._block(first) + self._block(last)
        return joined[start - first * BLOCK : stop - first * BLOCK]

    def find(self, what: bytes, start: int = 0, end: int | None = None) -> int:
        """The first place of `what`, looked for block by block."""
        end = self.size if end is None else min(end, self.size)
        while start < end:
            part = self[start : min(start + BLOCK, end)]
            at = part.find(what)
            if at >= 0:
                return start + at
            if start + len(part) >= end:
                return -1
            start += max(len(part) - len(what) + 1, 1)
        return -1
