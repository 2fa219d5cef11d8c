"""Encoding of a corpus with a public byte-level BPE vocabulary.

Each word of the split pattern is merged in a contiguous rank array: the boundaries of its parts
and the rank of each adjacent pair. The minimum is found by scanning, one boundary is deleted and
the two neighbouring ranks are looked up again. Long words, where repeated scans would be
quadratic, take the same merges in the same order from a heap.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the split pattern of the vocabulary. White space is spelt as the property, since
#: the regex library's \s also takes the four separator control characters.
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Words of more bytes than this take the heap. Both ways give the same ids.
SHORT_WORD = 96
#: Words of more bytes than this are not remembered; a worker forgets all words beyond CACHE_WORDS.
CACHED_BYTES, CACHE_WORDS = 40, 300_000
_NONE = 1 << 60


def default_vocabulary() -> str:
    """Path of byte_bpe_50k's rank file, where the package of public tokenizers is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file: a base64 token and its id a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word by repeated scans of the rank array."""
    n = len(word)
    starts = list(range(n + 1))
    pair = [ranks.get(word[i : i + 2], _NONE) for i in range(n - 1)]
    while pair:
        least = min(pair)
        if least == _NONE:
            break
        i = pair.index(least)
        del starts[i + 1]
        del pair[i]
        if i < len(pair):
            pair[i] = ranks.get(word[starts[i] : starts[i + 2]], _NONE)
        if i:
            pair[i - 1] = ranks.get(word[starts[i - 1] : starts[i + 1]], _NONE)
    return [ranks[word[a:b]] for a, b in zip(starts, starts[1:])]  # noqa: B905


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges (least rank, leftmost first) with a heap and linked parts: n log n."""
    n = len(word)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = bytearray(b"\x01") * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if not alive[i] or j >= n or end[j] != stop:
            continue
        alive[j] = 0
        end[i], after[i] = stop, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(word[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if (h := before[i]) >= 0 and (r := ranks.get(word[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = after[i]
    return out


class Encoder:
    """Text to ids; remembers the words it has met, up to a bound."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.known, self.split = ranks, {}, regex.compile(SPLIT).findall

    def word(self, w: str) -> list[int]:
        b = w.encode()
        ids = [self.ranks[b]] if b in self.ranks else (merge_short if len(b) <= SHORT_WORD else merge_long)(b, self.ranks)
        if len(b) <= CACHED_BYTES:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            self.known[w] = ids
        return ids

    def parts(self, text: str | None) -> list[list[int]]:
        """The ids of each word; empty for null and empty text."""
        if not text:
            return []
        get = self.known.get
        return [get(w) or self.word(w) for w in self.split(text)]

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.parts(text)))


def _run(shared, counts_only: bool, name: str, out: str):
    """The Arrow pass: the first column stays, the second (text) becomes ids or their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                words = [encoder.parts(t) for t in part.column(1).to_pylist()]
                sizes = np.fromiter((sum(map(len, w)) for w in words), np.int64, len(words))
                if counts_only:
                    col = pa.array(sizes)
                else:
                    flat = np.fromiter(chain.from_iterable(chain.from_iterable(words)), np.int32, int(sizes.sum()))
                    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                    col = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(part.columns) if i != 1), col], names=[*(n for i, n in enumerate(part.schema.names) if i != 1), out])

    return run


def _encoded(docs: DataFrame, keep: list[str], text: str, vocabulary: str | None, out: str, kind: str) -> DataFrame:
    spark = docs.sparkSession
    # bounded: a vocabulary of 50,256 tokens, about 1 MB
    shared = spark.sparkContext.broadcast(read_ranks(vocabulary or default_vocabulary()))
    chosen = docs.select(keep[0], text, *keep[1:])
    fields = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return chosen.mapInArrow(_run(shared, kind == "bigint", keep[0], out), f"{fields}, {out} {kind}")


def encode_corpus(docs: DataFrame, *, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(key, ids): the ids of each whole text without special tokens.

    Null and empty texts give an empty list; special-token strings in a text are ordinary text.
    Null and repeated keys and further columns of any name are harmless. One narrow pass.
    """
    return _encoded(docs, [key], text, vocabulary, "ids", "array<int>")


def count_tokens(docs: DataFrame, *, keep: list[str], text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """`keep` columns and `tokens`, the number of ids of each whole text (0 for null and empty)."""
    return _encoded(docs, keep, text, vocabulary, "tokens", "bigint")


def token_statistics(encoded: DataFrame) -> DataFrame:
    """How often each id occurs in the corpus: (token_id, uses), pre-aggregated before the shuffle."""
    return encoded.select(F.explode("ids").alias("token_id")).groupBy("token_id").agg(F.count("*").alias("uses"))
