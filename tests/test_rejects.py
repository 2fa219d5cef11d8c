from __future__ import annotations

import random

import pyarrow as pa
from conftest import rows

from voxelake.operators.rejects import accepted, check_batch, parse_lines, rejected

GOOD = 'truncated_value,"(0010,0010)",PN,12,"(0040,A730) > (0040,A043)",8,5,"a ""b"", c"'


def table(spark, lines):
    return spark.createDataFrame([(i, t, 0) for i, t in enumerate(lines)], "line_id bigint, raw_line string, offset int")


def test_values(spark):
    got = accepted(parse_lines(table(spark, [GOOD, ' invalid_value , "(0009,0a0f)","", 0 ,, 007 ," 9223372036854775807 ",\r']))).orderBy("line_id").collect()
    assert tuple(got[0]) == (0, "truncated_value", 0x00100010, "PN", 12, "(0040,A730) > (0040,A043)", 8, 5, 'a "b", c')
    assert tuple(got[1]) == (1, "invalid_value", 0x00090A0F, None, 0, None, 7, 9223372036854775807, None)


def test_reasons(spark):
    lines = [
        GOOD, None, "", "  ", GOOD + ",", 'a,"b', 'a"b,c', '"a"b,"c"', "invalid_value,(0010,0010),PN,1,,1,1,",
        'x,"(0010,001)",pn,-1,,1.5,9223372036854775808,', '"""",,,,,,,', "\r", 'invalid_value,"(0010,0010)",PN,１２,,0,0,',
    ]
    want = [
        (1, "columns"), (2, "columns"), (3, "columns"), (4, "columns"), (5, "quoting"), (6, "quoting"), (7, "quoting"), (8, "columns"),
        *((9, r) for r in ("kind", "tag", "vr", "offset", "need", "have")), *((10, r) for r in ("kind", "tag", "offset", "need", "have")), (11, "columns"), (12, "offset"),
    ]
    assert rows(rejected(parse_lines(table(spark, lines)))) == sorted(want, key=repr)
    assert rejected(parse_lines(table(spark, []))).count() == 0


def scan(s: str) -> list[str] | None:
    """A plain state machine: the fields, or None for broken quoting."""
    s = s[:-1] if s.endswith("\n") else s
    s = s[:-1] if s.endswith("\r") else s
    out, i = [], 0
    while True:
        while i < len(s) and s[i] in " \t":
            i += 1
        v = ""
        if i < len(s) and s[i] == '"':
            i += 1
            while True:
                if i >= len(s):
                    return None
                if s[i : i + 2] == '""':
                    v, i = v + '"', i + 2
                elif s[i] == '"':
                    i += 1
                    break
                else:
                    v, i = v + s[i], i + 1
            while i < len(s) and s[i] in " \t":
                i += 1
            if i < len(s) and s[i] != ",":
                return None
        else:
            k = s.find(",", i)
            k = len(s) if k < 0 else k
            v, i = s[i:k], k
            if '"' in v:
                return None
        out.append(v.strip(" \t"))
        if i >= len(s):
            return out
        i += 1


def test_structure_against_state_machine():
    from voxelake.operators.rejects import split_lines

    rng = random.Random(4)
    lines = ["".join(rng.choice('",,,,a \t\r"') for _ in range(rng.randint(0, 24))) for _ in range(20_000)]
    lines += [",".join(rng.choice(['"x"', ' "y,""z" ', "w", "", ' "" ', '"', "a\tb"]) for _ in range(8)) + rng.choice(["", "\r"]) for _ in range(5000)] + ["é" * 50_000]
    broken, count, cols = split_lines(pa.array(lines))
    texts = list(zip(*(c.to_pylist() for c in cols), strict=True))
    for line, b, n, t in zip(lines, broken, count, texts, strict=True):
        want = scan(line)
        assert b == (want is None), line
        if want is not None:
            assert n == len(want), line
            if n == 8:
                assert list(t) == want, line


def test_sliced_batch():
    a = pa.array([None, GOOD, "x", GOOD, None])
    keys = pa.array(range(5))
    whole, part = check_batch(keys, a, "k"), check_batch(keys.slice(1, 3), a.slice(1, 3), "k")
    assert whole.slice(1, 3).to_pylist() == part.to_pylist()
