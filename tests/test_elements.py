from __future__ import annotations

from conftest import rows
from pyspark.sql import functions as F

from voxelake.dictionary import dict_private, dict_repeaters, dict_tags
from voxelake.operators import elements as el
from voxelake.operators import images as im

SCHEMA = "k bigint, path array<struct<tag:bigint,item:int>>, tag bigint, vr string, strings array<string>, raw binary, undefined_length boolean"


def data(spark):
    seq = [(0x00283000, 0)]
    return spark.createDataFrame(
        [
            (1, [], 0x00280103, "US", ["1"], None, False),
            (1, seq, 0x00283002, "US or SS", None, None, False),
            (2, [], 0x00280103, "US", ["0"], None, False),
            (2, seq, 0x00280103, "US", ["1"], None, False),
            (2, seq, 0x00283002, "US or SS", None, None, False),
            (3, seq, 0x00283002, "US or SS", None, None, False),
            (4, [], 0x7FE00010, "OB or OW", None, None, True),
            (5, [], 0x7FE00010, "OB or OW", None, None, False),
            (None, [], 0x00100010, "PN", None, None, None),
        ],
        SCHEMA,
    )


def test_resolve(spark):
    got = rows(el.resolve_ambiguous(data(spark), key="k").where("vr like '% or %'").select("k", "resolved_vr", "vr_error"))
    assert got == [(1, "SS", None), (2, "SS", None), (3, "US", None), (4, "OB", None), (5, "OB or OW", "missing BitsAllocated")]
    got = rows(el.resolve_ambiguous(data(spark), key="k", implicit=True).where("k = 5").select("resolved_vr"))
    assert got == [("OW",)] and el.resolve_ambiguous(data(spark).limit(0), key="k").count() == 0


def test_resolve_by_what_stands_beside(spark):
    """LUT data by their descriptor, waveforms and pixels by their bits; both byte orders."""
    lut, pix, wave, rep = 0x00283006, 0x7FE00010, 0x54001010, 0x00280103
    e = spark.createDataFrame(
        [
            (1, [], 0x00283002, "US or SS", None, bytearray(b"\x01\x00\x00\x01\x10\x00"), False), (1, [], lut, "US or OW", None, bytearray(b"\x05\x00\xff\xff"), False),
            (2, [], 0x00283002, "US", ["4", "0", "16"], None, False), (2, [], lut, "US or OW", None, bytearray(b"\x05\x00"), False), (3, [], lut, "US or OW", None, None, False),
            (4, [], 0x00280100, "US", ["8"], None, False), (4, [], pix, "OB or OW", None, None, False), (5, [], 0x00280100, "US", ["16"], None, False), (5, [], pix, "OB or OW", None, None, False),
            (6, [], 0x54001004, "US", ["8"], None, False), (6, [], wave, "OB or OW", None, None, False), (7, [], 0x54001004, "US", ["16"], None, False), (7, [], wave, "OB or OW", None, None, False),
            (8, [], pix, "OW", None, None, False), (8, [], 0x00280106, "US or SS", None, bytearray(b"\x00\x01"), False), (9, [], rep, "US", ["1"], None, False),
            (9, [], 0x00280106, "US or SS", None, bytearray(b"\xfe\xff"), False), (10, [], 0x60023000, "OB or OW", None, None, False),
        ],
        SCHEMA,
    )
    got = {(r.k, r.tag): (r.resolved_vr, r.strings, r.vr_error) for r in el.resolve_ambiguous(e, key="k").where("vr like '% or %'").collect()}
    assert got[1, lut] == ("US", ["5", "65535"], None) and got[2, lut] == ("OW", None, None) and got[3, lut] == ("US or OW", None, "missing LUTDescriptor")
    assert got[1, 0x00283002] == ("US", ["1", "256", "16"], None)
    assert [got[k, pix][0] for k in (4, 5)] == [got[k, wave][0] for k in (6, 7)] == ["OB", "OW"] and got[10, 0x60023000][0] == "OW"
    assert got[8, 0x00280106][2] == "missing PixelRepresentation" and got[9, 0x00280106] == ("SS", ["-2"], None)
    big = el.resolve_ambiguous(e.where("k = 1"), key="k", little=False).where("tag = 2633734").first()
    assert big.resolved_vr == "OW"  # 01 00 is 256 there


def test_dictionary_and_private(spark):
    e = spark.createDataFrame([(1, 0x00100010), (2, 0x60023000), (3, 0x00090010), (4, 0x00091000), (5, None)], "k bigint, tag bigint")
    got = {r.k: (r.dictionary_vr, r.keyword) for r in el.with_dictionary(e, dict_tags(spark), dict_repeaters(spark)).collect()}
    assert got == {1: ("PN", "PatientName"), 2: ("OB or OW", "OverlayData"), 3: ("LO", "PrivateCreator"), 4: ("UN", ""), 5: ("UN", "")}
    p = spark.createDataFrame([(1, 0x00090010, ["ACUSON "]), (1, 0x00091000, ["5"]), (1, 0x00091100, ["6"])], "k bigint, tag bigint, strings array<string>")
    got = rows(el.private_vr(el.private_block(p, key="k"), dict_private(spark)).select("tag", "block_creator", "private_vr"))
    assert got == [(0x00091000, "ACUSON", "IS"), (0x00091100, None, "UN")]


def test_sets(spark):
    a = spark.createDataFrame([(1, 10, "x"), (1, 11, None), (2, 10, "y")], "k int, tag int, v string")
    b = spark.createDataFrame([(1, 10, "x"), (1, 11, None), (2, 10, "z"), (3, 1, "q")], "k int, tag int, v string")
    assert rows(el.equal_datasets(a, b, key="k", on=["tag"], values=["v"])) == [(1, True), (2, False), (3, False)]
    assert rows(el.update(a, b, on=["k", "tag"])) == [(1, 10, "x"), (1, 11, None), (2, 10, "z"), (3, 1, "q")]
    assert rows(el.delete(a, b.where("k = 1"), on=["k", "tag"])) == [(2, 10, "y")]
    assert el.update(a.limit(0), b.limit(0), on=["k", "tag"]).count() == 0


def test_frames_and_walk(spark):
    f = spark.createDataFrame([(1, bytearray(b"abcdef"), 3, 2), (2, bytearray(b"abcd\0"), 2, 2), (3, bytearray(b"abc"), 2, 2), (4, None, 2, 2)], "k int, px binary, size int, n int")
    got = rows(im.native_frames(f, key="k", data="px", frame_bytes=F.col("size"), n_frames=F.col("n")).select("k", "frame_idx", F.col("frame").cast("string")))
    assert got == [(1, 0, "abc"), (1, 1, "def"), (2, 0, "ab"), (2, 1, "cd"), (3, None, None), (4, None, None)]
    w = im.walk_order(spark.createDataFrame([(1, [(5, 1)], 2), (1, [], 7), (1, [(5, 0)], 9), (1, [], 5), (1, [], 1)], "k int, path array<struct<tag:bigint,item:int>>, tag bigint"), key="k")
    assert [(r.tag, len(r.path)) for r in w.orderBy("walk_idx").collect()] == [(1, 0), (5, 0), (9, 1), (2, 1), (7, 0)]
    r = spark.range(3).select(im.random_uid().alias("u")).collect()
    assert all(x.u.startswith("2.25.") for x in r)


def test_json_model(spark):
    """Three groups of a name, nesting, inline and bulk bytes, unknown bytes, what breaks the model."""
    import json

    text = json.dumps({
        "00100010": {"vr": "PN", "Value": [{"Alphabetic": "Yamada^Tarou", "Ideographic": "山田^太郎", "Phonetic": "やまだ^たろう"}, None]},
        "0040A730": {"vr": "SQ", "Value": [{"0040A30A": {"vr": "DS", "Value": [1.50, "+5"]}}, None, {}]},
        "00420011": {"vr": "OB", "InlineBinary": "AQID"}, "54001010": {"vr": "OW", "BulkDataURI": "https://example.com/w"},
        "00280010": {"vr": "UN", "InlineBinary": "AAI="}, "00100020": {"vr": "LO", "Value": ["a"], "InlineBinary": "AQID"}, "00100021": {"vr": "LO", "Value": "lone"},
        "00209161": {"vr": "OB", "InlineBinary": "*"}, "PatientID": {"vr": "LO"}, "00281101": {"vr": "AT", "Value": ["10010"]}, "00081030": {"vr": "LO"},
    })
    df = spark.createDataFrame([(1, text), (2, None), (3, "{"), (4, "{}"), (None, '[{"00100010":{"vr":"PN"}}]')], "k bigint, j string")
    out = el.from_json(df, key="k", json="j", bulk_reader=lambda tag, vr, uri: uri.encode())
    got = {(len(r.path), r.tag): r for r in out.where("k = 1").collect()}
    assert got[0, 0x00100010].strings == ["Yamada^Tarou=山田^太郎=やまだ^たろう", None] and got[1, 0x0040A30A].strings == ["1.5", "+5"] and got[0, 0x0040A730].vr == "SQ"
    assert got[0, 0x00420011].raw == b"\1\2\3" and got[0, 0x54001010].bulk_uri == "https://example.com/w" and bytes(got[0, 0x54001010].raw) == b"https://example.com/w"
    assert (got[0, 0x00280010].vr, got[0, 0x00280010].strings) == ("US", ["512"]) and got[0, 0x00281101].strings == ["00010010"] and got[0, 0x00081030].strings == []
    assert [got[0, t].value_error for t in (0x00100020, 0x00100021, 0x00209161, None)] == ["several value keys: Value, InlineBinary", "Value must be a list", "InlineBinary is no base64", "'PatientID' is no tag"]
    assert {r.k for r in out.where("tag is null").collect()} == {1, 3} and out.where("k is null").first().path == [(0, 0)] and out.where("k in (2, 4)").count() == 0

    e = spark.createDataFrame(
        [(1, [], 0x00280030, "DS", ["+5", "007", ".5", "nan", "1e3"], None), (1, [], 0x00100010, "PN", ["A^B=山田=や"], None), (1, [], 0x00420011, "OB", None, bytearray(b"x" * 13)), (1, [(0x0040A730, 1)], 0x00200013, "IS", ["+5"], None)],
        "k bigint, path array<struct<tag:bigint,item:int>>, tag bigint, vr string, strings array<string>, raw binary",
    )
    made = json.loads(el.to_json(e, key="k", bulk_threshold=4, bulk="https://example.com").first().json)
    assert made["00280030"]["Value"] == [5.0, 7.0, 0.5, "nan", 1000.0] and made["00100010"]["Value"] == [{"Alphabetic": "A^B", "Ideographic": "山田", "Phonetic": "や"}]
    assert made["00420011"] == {"vr": "OB", "BulkDataURI": "https://example.com/00420011"} and made["0040A730"]["Value"] == [{"00200013": {"vr": "IS", "Value": [5]}}]
    assert json.loads(el.to_json(e, key="k", bulk_threshold=20, bulk="x").first().json)["00420011"]["InlineBinary"]
