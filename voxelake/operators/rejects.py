"""Delimited lines into typed rows, with every reason for each line that can't be loaded.

Structural indexing: a batch of lines is one byte buffer. The mask of quotes and its running
parity tell which commas delimit; differences of the running count give the quotes of each field.
All checks are array operations over the batch; no Python loop runs over lines or fields.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ("kind", "tag", "vr", "offset", "path", "need", "have", "note")
#: The five kinds of diagnostic.
KINDS = ("truncated_header", "truncated_value", "truncated_item", "deferred_value_unreadable", "invalid_value")
MAX_BIGINT = "9223372036854775807"
_QUOTE, _COMMA, _CR, _LF, _SPACE, _TAB = 34, 44, 13, 10, 32, 9


def split_lines(lines: pa.StringArray | pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, list[pa.Array]]:
    """(quoting is broken, number of columns, the eight columns' texts) of a batch of lines.

    Texts are unquoted and without blanks around; they are null for lines without exactly eight
    columns or with broken quoting. A null line has no column.
    """
    n = len(lines)
    filled = pc.fill_null(lines.cast(pa.large_string()), "")
    offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + n + 1]
    data = filled.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    base = int(offsets[0]) if n else 0
    raw = raw[base : int(offsets[-1])] if n else raw
    start, end = offsets[:-1] - base, (offsets[1:] - base).copy()
    for char in (_LF, _CR):  # one final line feed, then one carriage return
        last = np.zeros(n, bool)
        some = end > start
        last[some] = raw[end[some] - 1] == char
        end[last] -= 1

    quote = raw == _QUOTE
    before = np.concatenate(([0], np.cumsum(quote)))  # quotes before each position
    comma = np.flatnonzero(raw == _COMMA)
    line = np.searchsorted(offsets[1:] - base, comma, side="right")
    inside = (before[comma] - before[start[line]]) & 1
    keep = (inside == 0) & (comma < end[line])
    comma, line = comma[keep], line[keep]

    # the fields of all lines in order: a line's first field starts with it, others after a comma
    count = np.bincount(line, minlength=n) + 1
    first = np.concatenate(([0], np.cumsum(count)))
    total = int(first[-1])
    f_line = np.repeat(np.arange(n), count)
    f_start, f_end = np.empty(total, np.int64), np.empty(total, np.int64)
    is_first, is_last = np.zeros(total, bool), np.zeros(total, bool)
    is_first[first[:-1]], is_last[first[1:] - 1] = True, True
    f_start[is_first], f_start[~is_first] = start, comma + 1
    f_end[is_last], f_end[~is_last] = end, comma

    solid = (raw != _SPACE) & (raw != _TAB)
    at = np.arange(len(raw))
    ahead = np.concatenate((np.minimum.accumulate(np.where(solid, at, len(raw))[::-1])[::-1], [len(raw)]))
    behind = np.concatenate(([-1], np.maximum.accumulate(np.where(solid, at, -1))))
    v_start = np.minimum(ahead[f_start], f_end)
    v_end = np.maximum(behind[f_end] + 1, v_start)

    n_quotes = before[f_end] - before[f_start]
    has = n_quotes > 0
    opened, closed = np.zeros(total, bool), np.zeros(total, bool)
    opened[has], closed[has] = raw[v_start[has]] == _QUOTE, raw[v_end[has] - 1] == _QUOTE
    bad = has & ~(opened & closed & (n_quotes % 2 == 0))
    # inside a field, every quote of odd rank but the last must be followed by its twin at once
    q = np.flatnonzero(quote)
    if len(q) and total:
        q_field = np.searchsorted(f_start, q, side="right") - 1
        rank = before[q] - before[f_start[q_field]]
        lonely = np.ones(len(q), bool)
        lonely[:-1] = q[1:] != q[:-1] + 1
        odd = (rank % 2 == 1) & (rank < n_quotes[q_field] - 1) & lonely
        bad[q_field[odd]] = True
    broken = np.zeros(n, bool)
    broken[f_line[bad]] = True

    quoted = has & opened
    s, e = v_start + quoted, np.maximum(v_end - quoted, v_start + quoted)
    s, e = np.minimum(ahead[s] if len(s) else s, e), np.maximum(behind[e] + 1 if len(e) else e, 0)
    e = np.maximum(e, s)
    null_line = np.asarray(pc.is_null(lines).to_numpy(zero_copy_only=False), bool) if n else np.zeros(0, bool)
    count = np.where(null_line, 0, count)
    good = (count == len(COLUMNS)) & ~broken
    columns = []
    for k in range(len(COLUMNS)):
        f = np.where(good, first[:-1] + k, 0)
        lo = np.where(good, s[f], 0)
        size = np.where(good, e[f] - s[f], 0)
        out = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
        where = np.repeat(lo - out[:-1], size) + np.arange(out[-1])
        text = pa.LargeStringArray.from_buffers(n, pa.py_buffer(out), pa.py_buffer(raw[where] if len(where) else np.zeros(0, np.uint8)))
        text = pc.replace_substring(text, '""', '"').cast(pa.string())
        columns.append(pc.if_else(pa.array(good), text, pa.scalar(None, pa.string())))
    return broken, count, columns


def is_bigint(text: pa.Array) -> pa.Array:
    """ASCII digits only and within bigint."""
    digits = pc.match_substring_regex(text, "^[0-9]+$")
    short = pc.utf8_ltrim(text, "0")
    size = pc.utf8_length(short)
    fits = pc.or_(pc.less(size, 19), pc.and_(pc.equal(size, 19), pc.less_equal(short, MAX_BIGINT)))
    return pc.and_(digits, fits)


#: Places of the hexadecimal digits in (GGGG,EEEE), and the digits' values by their code.
_DIGITS = np.array([1, 2, 3, 4, 6, 7, 8, 9])
_VALUES = np.array([int(chr(c), 16) if chr(c) in "0123456789abcdefABCDEF" else 0 for c in range(256)], np.int64)


def tag_numbers(text: pa.Array) -> pa.Array:
    """Tags of (GGGG,EEEE) texts, null for null."""
    there = np.asarray(pc.is_valid(text).to_numpy(zero_copy_only=False), bool) if len(text) else np.zeros(0, bool)
    out = np.zeros(len(text), np.int64)
    if there.any():
        packed = pc.take(text, pa.array(np.flatnonzero(there)))  # contiguous, 11 bytes each
        codes = np.frombuffer(packed.buffers()[2], np.uint8)[: 11 * len(packed)]
        out[there] = _VALUES[codes.reshape(-1, 11)[:, _DIGITS]] @ (16 ** np.arange(7, -1, -1, dtype=np.int64))
    return pa.array(out, mask=~there)


def parse_lines(lines: DataFrame, *, key: str = "line_id", text: str = "raw_line") -> DataFrame:
    """Each line as `key`, `reasons` and, where that array is empty, its typed columns.

    Columns: kind string, tag bigint, vr string (null if empty), offset bigint, path string (null if
    empty), need bigint, have bigint, note string (null if empty).
    Reasons: `quoting` alone; else `columns` alone; else any of kind, tag, vr, offset, need, have.
    A null, empty or blank line fails by `columns`. Null and repeated keys, very long lines and
    further columns of any name are harmless: only `key` and `text` are read. One narrow Arrow
    pass; nothing is shuffled.
    """
    key_type = lines.schema[key].dataType.simpleString()
    schema = f"`{key}` {key_type}, reasons array<string>, kind string, tag bigint, vr string, offset bigint, path string, need bigint, have bigint, note string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield check_batch(batch.column(0), batch.column(1), key)

    return lines.select(key, text).mapInArrow(run, schema)


def check_batch(keys: pa.Array, lines: pa.Array, key: str) -> pa.RecordBatch:
    """One batch of `parse_lines`."""
    broken, count, cols = split_lines(lines)
    n = len(lines)
    kind, tag, vr, offset, path, need, have, note = cols
    ok = {
        "kind": pc.is_in(kind, value_set=pa.array(KINDS)),
        "tag": pc.match_substring_regex(tag, r"^\([0-9A-Fa-f]{4},[0-9A-Fa-f]{4}\)$"),
        "vr": pc.match_substring_regex(vr, r"^([A-Z]{2})?$"),
        "offset": is_bigint(offset),
        "need": is_bigint(need),
        "have": is_bigint(have),
    }
    shaped = ~broken & (count == len(COLUMNS))
    names = ["quoting", "columns", *ok]
    fails = np.column_stack(
        [broken, ~broken & (count != len(COLUMNS)), *(shaped & ~pc.fill_null(v, False).to_numpy(zero_copy_only=False) for v in ok.values())]
    )
    row, which = np.nonzero(fails)
    offsets = np.concatenate(([0], np.cumsum(fails.sum(axis=1)))).astype(np.int32)
    reasons = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.array(names, object)[which], pa.string()))
    valid = pa.array(~fails.any(axis=1))
    none = lambda t: pa.scalar(None, t)
    pick = lambda a: pc.if_else(valid, a, none(pa.string()))
    filled = lambda a: pc.if_else(pc.equal(pick(a), ""), none(pa.string()), pick(a))
    tags = tag_numbers(pick(tag))
    number = lambda a: pick(a).cast(pa.int64())
    arrays = [keys, reasons, pick(kind), tags, filled(vr), number(offset), filled(path), number(need), number(have), filled(note)]
    return pa.RecordBatch.from_arrays(arrays, names=[key, "reasons", "kind", "tag", "vr", "offset", "path", "need", "have", "note"])


def rejected(parsed: DataFrame, *, key: str = "line_id") -> DataFrame:
    """One row per failing line and reason."""
    return parsed.select(key, F.explode("reasons").alias("reason"))


def accepted(parsed: DataFrame) -> DataFrame:
    """The lines that load, typed."""
    return parsed.where(F.size("reasons") == 0).drop("reasons")
