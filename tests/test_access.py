"""Typed access, setters and provenance: nulls, several values, empty tables."""

from __future__ import annotations

import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from voxelake.dictionary import dict_tags
from voxelake.functions import access as ac
from voxelake.functions import values as vl
from voxelake.operators import editing as ed

ELEMENT = "k bigint, path array<struct<tag:bigint,item:int>>, tag bigint, vr string, strings array<string>, raw binary"


def test_getters(spark):
    data = [
        (1, "US", ["7"]), (2, "US", ["7", "8"]), (3, "US", []), (4, "US", None), (5, "DS", ["1.5", " 2 "]), (6, "DS", ["1.5", "x"]), (7, "FD", ["nan"]), (8, "LO", ["12"]), (9, "LO", ["a"]),
        (10, "UV", ["18446744073709551615"]), (11, "AT", ["00100010", "7FE00010"]), (12, None, ["1"]), (13, "OB", None), (14, "IS", [" -5 "]), (15, "LO", [""]),
    ]
    df = spark.createDataFrame(data, "k int, vr string, strings array<string>").withColumn("raw", F.when(F.col("vr") == "OB", F.lit(b"ab")))
    vr, s, none = F.col("vr"), F.col("strings"), F.lit(None).cast("int")
    got = {r.k: r for r in df.select("k", ac.int_value(vr, s).alias("i"), ac.float_values(vr, s).alias("fs"), ac.float_value(vr, s).alias("f"), ac.big_int_value(vr, s).alias("b"), ac.tag_values(vr, s).alias("t"), ac.bytes_value(vr, F.col("raw")).alias("raw"), ac.multiplicity(vr, s, F.col("raw"), none).alias("vm"), ac.is_empty(vr, s, F.col("raw"), none).alias("e"), ac.decimal_value(vr, s).alias("d")).collect()}
    assert [got[k].i for k in range(1, 16)] == [7, None, None, None, None, None, None, 12, None, None, None, None, None, -5, None]
    assert got[5].fs == [1.5, 2.0] and got[6].fs is None and got[7].f != got[7].f and got[8].f == 12 and got[3].fs is None
    assert got[10].b == 18446744073709551615 and got[11].t == [0x00100010, 0x7FE00010] and bytes(got[13].raw) == b"ab" and got[1].raw is None
    assert [got[k].vm for k in (1, 2, 3, 4, 13, 15)] == [1, 2, 0, 0, 1, 0] and got[3].e and not got[13].e
    assert got[5].d is None and df.limit(0).select(ac.int_value(vr, s)).count() == 0


def test_moments_names_equality(spark):
    df = spark.createDataFrame(
        [(1, "DA", "20240229", "2024.02.29"), (2, "TM", "1155", "115500.0"), (3, "DT", "20240101+0100", "2023123123"), (4, "PN", "A^B^^=", "A^B"), (5, "IS", "+7", "7"), (6, "DS", None, None), (7, "DS", None, "1"), (8, "LO", "a", "a "), (9, "TM", "bad", "bad")],
        "k int, vr string, a string, b string",
    )
    vr, one = F.col("vr"), F.array("a")
    got = {r.k: r for r in df.select("k", ac.same_value(vr, F.col("a"), F.col("b")).alias("same"), ac.date_value(vr, one).alias("da"), ac.time_value(vr, one).alias("tm"), ac.datetime_value(vr, one)["tz_offset_min"].alias("tz"), ac.name_value(vr, one)["alphabetic"].alias("pn"), ac.is_zero(vr, one).alias("z")).collect()}
    assert [got[k].same for k in range(1, 10)] == [True, True, False, True, True, True, False, False, True]
    assert got[1].da == datetime.date(2024, 2, 29) and got[2].tm == 42900 * 10**6 and got[3].tz == 60 and got[4].pn == "A^B^^" and got[6].z and not got[1].z
    n = spark.createDataFrame([("Do^Jo^M^Dr^Jr=漢=か",), (None,)], "pn string").select(vl.formatted_name(vl.parse_pn(F.col("pn")), "{name_prefix} {given_name} {family_name}, {name_suffix} {ideographic}{phonetic}").alias("x")).collect()
    assert [r.x for r in n] == ["Dr Jo Do, Jr 漢か", None]
    with pytest.raises(ValueError):
        vl.formatted_name(vl.parse_pn(F.col("pn")), "{nobody}")
    assert spark.range(1).select(vl.name_groups(F.lit("A^B"), F.lit(None), F.lit("か")), vl.veterinary_name(F.lit("Smith"), F.lit("Rex"))).first()[:] == ("A^B==か", "Smith^Rex")


def test_scopes_and_membership(spark):
    seq, inner = 0x0040A730, 0x0040A043
    e = spark.createDataFrame(
        [(1, [], seq, "SQ", None, None), (1, [(seq, 0)], inner, "SQ", None, None), (1, [(seq, 1)], 0x0040A30A, "DS", ["1"], None), (1, [(seq, 0), (inner, 0)], 0x00080100, "SH", ["A"], None), (2, [], seq, "SQ", None, None), (2, [], 0x00100010, "PN", ["x"], None), (2, [], None, None, None, None)], ELEMENT
    )
    assert rows(ac.with_items(e, key="k").where("vr = 'SQ'").select("k", "tag", "items")) == sorted([(1, seq, 2), (1, inner, 1), (2, seq, 0)], key=repr)
    assert rows(ac.items_of(e, seq).select("item", F.size("path"), "tag")) == sorted([(0, 0, inner), (1, 0, 0x0040A30A), (0, 1, 0x00080100)], key=repr)
    assert ac.by_keyword(e, "PatientName").count() == 1 and ac.items_of(e.limit(0), seq).count() == 0
    with pytest.raises(ValueError):
        ac.by_keyword(e, "Nobody")
    t = spark.createDataFrame([(0x60023000,), (0x00100010,), (0x00090010,), (None,)], "tag bigint")
    got = rows(ac.in_dictionary(t, dict_tags(spark)).select("tag", "in_dictionary", ac.is_repeater(F.col("tag"))))
    assert got == sorted([(0x60023000, False, True), (0x00100010, True, False), (0x00090010, False, False), (None, False, None)], key=repr)


def test_setters(spark):
    base = ed.new_elements(spark, [("f", [], 0x00100010, "PN", ["old"], None), ("f", [], 0x00281050, "DS", ["40"], None)])
    one = lambda kind, v: spark.createDataFrame([("f", v), ("g", v)], f"file string, value {kind}")
    put = lambda df, tag, kind, v, of, **o: ed.set_values(df, one(of, v), key="file", tag=tag, kind=kind, **o)
    e = put(base, "PatientName", "name", "Doe^Jane", "string")
    e = put(e, "Rows", "int", [1, 2], "array<int>")
    e = put(e, 0x00281050, "float", [1 / 3, None], "array<double>")
    e = put(e, "StudyDate", "date", datetime.date(2024, 2, 29), "date")
    e = put(e, "StudyTime", "time", 42900 * 10**6 + 250_000, "bigint")
    e = put(e, "AcquisitionDateTime", "datetime", datetime.datetime(2024, 1, 2, 3, 4, 5, 600_000), "timestamp")
    e = put(e, "SeriesNumber", "integer", 5_000_000_000, "bigint")
    e = put(e, "PixelData", "bytes", bytearray(b"ab"), "binary")
    e = put(e, "ContentSequence", "sequence", 1, "int")
    got = {r.tag: r for r in e.where("file = 'g'").collect()}
    assert got[0x00280010].strings == ["1", "2"] and got[0x00281050].strings == ["0.33333333333333", ""] and got[0x00080020].strings == ["20240229"]
    assert got[0x00080030].strings == ["115500.25"] and got[0x0008002A].strings == ["20240102030405.6"] or got[0x0008002A].strings == ["20240102030405.600000"]
    assert 0x00200011 not in got and bytes(got[0x7FE00010].raw) == b"ab" and got[0x0040A730].vr == "SQ"
    assert {r.tag: r.strings for r in e.where("file = 'f'").collect()}[0x00100010] == ["Doe^Jane"] and len(set(rows(e.select("file", "tag")))) == e.count()
    bad = put(e, "WindowCenter", "float", [float("inf")], "array<double>").where("tag = 2625616").collect()
    assert [(r.strings, r.value_error is not None) for r in bad] == [(["0.33333333333333", ""], True)] * 2
    with pytest.raises(Exception, match="hold"):
        put(e, "WindowCenter", "float", [float("nan")], "array<double>", mode="FAILFAST").collect()
    for tag, kind in (("PatientName", "int"), ("Rows", "string"), (0x00990000 + 1, "string"), ("Nobody", "string")):
        with pytest.raises(ValueError):
            put(e, tag, kind, None, "string")
    assert put(base.limit(0), "Rows", "int", 1, "int").count() == 2 and ed.set_values(base, one("int", 1).limit(0), key="file", tag="Rows", kind="int").count() == 2


def test_provenance(spark):
    f = spark.createDataFrame([(1, ["ISO_IR 100"]), (2, None)], "k int, c array<string>")
    f = ed.with_encoding(f, implicit_vr=F.lit(True), little_endian=F.lit(True), charsets=F.col("c"))
    same = lambda i, l, c: [r[0] for r in f.orderBy("k").select(ed.is_original_encoding(F.lit(i).cast("boolean"), F.lit(l).cast("boolean"), c)).collect()]  # noqa: E731, E741
    assert same(None, None, F.col("c")) == [True, True] and same(False, True, F.col("c")) == [False, False] and same(True, True, F.lit(None).cast("array<string>")) == [False, True]
