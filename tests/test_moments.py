from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from conftest import rows

from voxelake.operators.moments import normalise_moments, same_instant_pairs

SCHEMA = "moment_id bigint, exposure_uid string, station_id int, dt_original string, da_original string, tm_original string, tz_offset string, utc_micros string"


def table(spark, data):
    return spark.createDataFrame([(i, "x", *d, "clash") for i, d in enumerate(data)], SCHEMA)


def clocks(spark):
    return spark.createDataFrame(
        [(1, "Europe/Berlin"), (2, "UTC"), (3, "America/New_York"), (4, None), (None, "UTC"), (5, "No/Where"), (1, "Europe/Berlin"), (6, "Australia/Lord_Howe")],
        "station_id int, tz_name string",
    )


def at(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp() * 1_000_000)


def micros(spark, data, **how):
    n = normalise_moments(table(spark, data), clocks(spark), keep=["moment_id"], **how)
    return [(r.utc_micros, r.basis) for r in n.orderBy("moment_id").collect()]


def test_spellings_of_one_instant(spark):
    same = [
        "20240704093005.25", "2024-07-04T09:30:05.250", "2024-07-04 09:30:05,25", "2024/07/04 09:30:05.250000", "2024.07.04 09:30:05.2500009",
        "04-Jul-2024 09:30:05.25", "Thu, 4 Jul 2024 09:30:05.25", "Jul 4, 2024 9:30:05.25 AM", " 20240704093005.25\x00", "20240704T093005.25", "2024-07-04t09:30:05.25",
    ]
    got = micros(spark, [(2, s, None, None, None) for s in same])
    assert {g[0] for g in got} == {at(2024, 7, 4, 9, 30, 5) + 250_000}
    pair = micros(spark, [(2, None, "2024.07.04", "093005.25", None), (2, "", "04-JUL-2024 ", "9:30:05.25 am", " "), (2, "  ", "20240704", "09:30:05,25\x00", "Z")])
    assert {g[0] for g in pair} == {at(2024, 7, 4, 9, 30, 5) + 250_000}


def test_order_of_offsets_and_gaps(spark):
    got = micros(
        spark,
        [
            (1, "20240704093000+0530", None, None, "+0100"),
            (1, "20240704093000", None, None, "+01:00"),
            (1, "20240704093000", None, None, ""),
            (1, "20240331023000", None, None, None),  # never shown
            (1, "20241027023000", None, None, None),  # shown twice
            (9, "20240704093000", None, None, None),
            (4, "20240704093000", None, None, None),
            (5, "20240704093000", None, None, None),
            (None, "20240704093000", None, None, None),
            (6, "20240407014500", None, None, None),  # a change of half an hour
        ],
    )
    assert got == [
        (at(2024, 7, 4, 4, 0), "value"), (at(2024, 7, 4, 8, 30), "column"), (at(2024, 7, 4, 7, 30), "clock"), (None, "nonexistent"),
        (at(2024, 10, 27, 0, 30), "clock"), (None, "no_zone"), (None, "no_zone"), (None, "no_zone"), (None, "no_zone"), (at(2024, 4, 6, 14, 45), "clock"),
    ]
    twice = [(1, "20241027023000", None, None, None), (1, "20241027033000", None, None, None)]
    assert micros(spark, twice, ambiguous="second")[0][0] == at(2024, 10, 27, 1, 30)
    assert micros(spark, twice, ambiguous="none") == [(None, "ambiguous"), (at(2024, 10, 27, 2, 30), "clock")]
    assert micros(spark, [(1, "20240331023000", None, None, None)], nonexistent="shift")[0][0] == at(2024, 3, 31, 1, 30)


def test_strict_fields(spark):
    bad = ["20241304093000", "20240230093000", "20240704243000", "20240704096100", "20240704", "2024-07", "00000000000000", "n/a", "", None, "20240704093061", "Jul 4, 2024 13:30 PM"]
    assert {g[0] for g in micros(spark, [(2, b, None, None, None) for b in bad])} == {None}
    assert micros(spark, [(2, "20240704093060", None, None, None)])[0][0] == at(2024, 7, 4, 9, 30, 59)
    assert micros(spark, [(2, "2024070409", None, None, None)])[0][0] == at(2024, 7, 4, 9)
    assert micros(spark, [(2, "Jul 4, 2024 12:05 AM", None, None, None)])[0][0] == at(2024, 7, 4, 0, 5)
    assert micros(spark, [(2, "x" * 100_000, None, None, None)]) == [(None, "unparsed")]


def test_against_brute_force(spark):
    """The whole small table against a plain reading with datetime and zoneinfo."""
    d = "/root/testdata/sf0.001"
    m, st = spark.read.parquet(f"{d}/moments.parquet"), spark.read.parquet(f"{d}/stations.parquet")
    zones = {r.station_id: r.tz_name for r in st.collect()}
    months = {v: i for i, v in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}

    def plain(r):
        raw = (r.dt_original or "").strip(" \0") or " ".join(x.strip(" \0") for x in (r.da_original, r.tm_original) if x)
        t, off = raw, None
        if x := re.search(r"\s*(Z|UTC|[+-]\d\d:?\d\d)$", t):
            if len(t) - len(x[0]) > 10 or ":" in t:
                off, t = x[1], t[: x.start()]
        half = (re.search(r"\s*([AaPp])[Mm]$", t) or [None, None])[1]
        t = re.sub(r"\s*[AaPp][Mm]$", "", t)
        if x := re.match(r"(?:[A-Za-z]{3}, )?(\d+)[- ]([A-Za-z]{3})[- ](\d{4})(.*)", t):
            y, mo, dd, rest = int(x[3]), months[x[2].lower()], int(x[1]), x[4]
        elif x := re.match(r"([A-Za-z]{3}) (\d+), (\d{4})(.*)", t):
            y, mo, dd, rest = int(x[3]), months[x[1].lower()], int(x[2]), x[4]
        elif x := re.match(r"(\d{4})[-/.]?(\d\d)[-/.]?(\d\d)(.*)", t):
            y, mo, dd, rest = int(x[1]), int(x[2]), int(x[3]), x[4]
        else:
            return None
        rest = rest.strip(" tT")
        whole, _, frac = rest.replace(",", ".").partition(".")
        if ":" in whole:
            f = whole.split(":")
        else:
            f = re.findall("..", whole)
        if not f:
            return None
        h, mi, s = [int(v) for v in f] + [0] * (3 - len(f))
        if half:
            h = h % 12 + (12 if half in "pP" else 0)
        try:
            local = datetime(y, mo, dd, h, mi, min(s, 59), int((frac + "000000")[:6]))
        except ValueError:
            return None
        off = off or (r.tz_offset or "").strip() or None
        if off:
            off = off.replace(":", "")
            delta = timedelta() if off in ("Z", "UTC") else timedelta(hours=int(off[:3]), minutes=int(off[0] + off[3:]))
            u = local - delta
        else:
            z = ZoneInfo(zones[r.station_id])
            u = local.replace(tzinfo=z).astimezone(timezone.utc)
            if u.astimezone(z).replace(tzinfo=None) != local:
                return None
            u = u.replace(tzinfo=None)
        return (u - datetime(1970, 1, 1)) // timedelta(microseconds=1)

    want = {r.moment_id: plain(r) for r in m.collect()}
    got = {r.moment_id: r.utc_micros for r in normalise_moments(m, st, keep=["moment_id"]).collect()}
    assert got == want
    groups = {}
    for r in m.collect():
        if want[r.moment_id] is not None:
            groups.setdefault((r.exposure_uid, want[r.moment_id]), []).append(r.moment_id)
    pairs = sorted((a, b) for g in groups.values() for a in g for b in g if a < b)
    assert rows(same_instant_pairs(normalise_moments(m, st, keep=["moment_id", "exposure_uid"]))) == sorted(pairs, key=repr)


def test_empty(spark):
    n = normalise_moments(table(spark, []).drop("utc_micros"), clocks(spark).limit(0), keep=["moment_id", "exposure_uid"])
    assert n.count() == 0 and same_instant_pairs(n).count() == 0
