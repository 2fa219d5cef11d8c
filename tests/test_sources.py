from __future__ import annotations

import time

import pytest
from conftest import rows
from pyspark.sql import functions as F

from voxelake.codec.dataset import encode_file
from voxelake.dictionary import dict_private
from voxelake.functions import values as vl
from voxelake.operators import elements as el
from voxelake.sources.dicom import DicomSource, parse_diagnostics, parse_elements, parse_files, read_dicom
from voxelake.streaming.ingest import stream_elements


def some(i):
    e = [((), 0x00100010, "PN", b"Doe^Jane", False), ((), 0x00100020, "LO", f"ID{i:04d}".encode(), False), (((0x0040A730, 0),), 0x0040A040, "CS", b"NUM ", False)]
    return encode_file(e, "1.2.840.10008.1.2.1", "1.2", f"2.25.{i}")


def test_files_and_source(spark, tmp_path):
    spark.dataSource.register(DicomSource)
    files = spark.createDataFrame([(f"f{i}.dcm", bytearray(some(i))) for i in range(5)], "file string, content binary")
    files.write.format("dicom").mode("append").save(str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"f{i}.dcm" for i in range(5)]
    got = spark.read.format("dicom").load(str(tmp_path / "out"))
    ids = rows(got.where("tag = 1048608").select("strings"))
    assert ids == [([f"ID{i:04d}"],) for i in range(5)]
    assert rows(read_dicom(spark, str(tmp_path / "out"), tags=[0x00100020]).where("not is_meta").select("strings")) == ids
    assert got.where("depth = 1").count() == 5


def test_filters_change_no_other_scan(spark, tmp_path):
    """A filter on tag gives the rows that filtering all elements gives, nested ones too, and leaves
    other scans of the same DataFrame as they are."""
    spark.dataSource.register(DicomSource)
    for i in range(3):
        (tmp_path / f"{i}.dcm").write_bytes(some(i))
    e = spark.read.format("dicom").load(str(tmp_path))
    every = e.collect()
    name, patient, sequence, kind = 0x00100010, 0x00100020, 0x0040A730, 0x0040A040
    for text, tags in ((f"tag = {kind}", {kind}), (f"tag in ({patient}, {sequence})", {patient, sequence}), (f"tag in ({name}, {kind}) and tag = {kind}", {kind})):
        want = sorted((tuple(r) for r in every if r.tag in tags), key=repr)
        assert rows(e.where(text)) == want and len(want) == 3 * len(tags)
        assert e.where(text).union(e).count() == len(want) + len(every) and e.count() == len(every)
    only = spark.read.format("dicom").option("only", "0040A040;PatientID").load(str(tmp_path))
    assert rows(only) == sorted((tuple(r) for r in every if r.tag in (kind, patient)), key=repr)
    listed = spark.read.format("dicom").option("tags", "PatientID").load(str(tmp_path))
    assert {r.tag for r in listed.where("NOT is_meta").collect()} == {patient}


def test_modes_and_bad_data(spark):
    good, cut = some(1), some(2)[:-3]
    df = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(cut)), (3, bytearray(b"no file")), (4, None), (None, bytearray(good))], "k bigint, content binary")
    assert {r.k for r in parse_elements(df, key="k").select("k").distinct().collect()} == {1, 2, None}
    assert {r.k for r in parse_elements(df, key="k", mode="DROPMALFORMED").select("k").distinct().collect()} == {1, None}
    # the cut shows at every level that it goes through: the sequence, its item and the value inside
    assert rows(parse_diagnostics(df, key="k").select("k", "kind", F.size("path").alias("n"))) == [
        (2, "truncated_item", 0), (2, "truncated_value", 0), (2, "truncated_value", 1), (3, "not_dicom", 0)
    ]
    facts = {r.k: (r.transfer_syntax, r.read_error is None) for r in parse_files(df, key="k").collect()}
    assert facts[1] == ("1.2.840.10008.1.2.1", True) and facts[3] == (None, False) and facts[4] == (None, False)
    assert parse_elements(df.limit(0), key="k").count() == 0


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.dcm").write_bytes(some(i))
    q = stream_elements(spark, str(tmp_path / "in")).where("tag = 1048608").writeStream.format("memory").queryName("arrived").start()
    try:
        q.processAllAvailable()
        assert spark.table("arrived").count() == 3
    finally:
        q.stop()
    time.sleep(0)


def test_charset_lists(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, ["", "ISO2022 IR 87"]), (4, ["ISO-IR 100"]), (5, ["nonsense"]), (6, ["ISO_IR 192", "ISO_IR 100"]), (7, ["ISO_IR 100", "GB18030"]), (8, [None])], "k int, c array<string>")
    got = {r.k: r.s for r in df.select("k", vl.normalise_charsets(df.c).alias("s")).collect()}
    assert got == {1: ["ISO_IR 6"], 2: ["ISO_IR 6"], 3: ["ISO_IR 6", "ISO 2022 IR 87"], 4: ["ISO_IR 100"], 5: ["ISO_IR 6"], 6: ["ISO_IR 192"], 7: ["ISO_IR 100"], 8: ["ISO_IR 6"]}


def test_values(spark):
    df = spark.createDataFrame([("20240230", "115500", "20240101120000+0100", "1.5", " 7 ")], "da string, tm string, dt string, ds string, i string")
    r = df.select(vl.parse_da(df.da).cast("string"), vl.parse_tm(df.tm), vl.parse_dt(df.dt)["tz_offset_min"], vl.parse_ds(df.ds), vl.parse_is(df.i)).first()
    assert tuple(r) == ("2024-03-01", 42900 * 10**6, 60, 1.5, 7)
    bad = df.selectExpr("'' da", "'2561' tm", "'x' dt", "'--' ds", "'1.0' i")
    r = bad.select(vl.parse_da(bad.da), vl.parse_tm(bad.tm), vl.parse_dt(bad.dt), vl.parse_ds(bad.ds), vl.parse_is(bad.i)).first()
    assert tuple(r) == (None,) * 5


def test_private_dictionary_extras(spark):
    assert dict_private(spark, [("X", "0019xx01", "DS", "1", "n")]).count() == 2
    assert el.before_pixels(spark.createDataFrame([], "tag bigint")).count() == 0


def test_refused_files_leave_a_row(spark, tmp_path):
    spark.dataSource.register(DicomSource)
    (tmp_path / "good.dcm").write_bytes(some(1))
    (tmp_path / "bad.dcm").write_bytes(b"no file")
    (tmp_path / "cut.dcm").write_bytes(some(2)[:-3])
    read = lambda **o: spark.read.format("dicom").options(**o).load(str(tmp_path))
    q = stream_elements(spark, str(tmp_path)).writeStream.format("memory").queryName("refusals").start()
    try:
        q.processAllAvailable()
        for e in (read(), read_dicom(spark, str(tmp_path)), spark.table("refusals")):
            assert [(r.file.endswith("bad.dcm"), r.value_error) for r in e.where("tag is null").collect()] == [(True, "no DICM prefix")]
    finally:
        q.stop()
    assert {r.file.split("/")[-1] for r in read(mode="DROPMALFORMED").collect()} == {"good.dcm"}
    assert read_dicom(spark, str(tmp_path), refused=False).where("tag is null").count() == 0
    with pytest.raises(Exception, match="no DICM prefix|damaged dataset"):
        read(mode="FAILFAST").collect()


def test_damaged_deflated_data(spark):
    from voxelake.codec.dataset import encode_dataset

    deflated = "1.2.840.10008.1.2.1.99"
    whole = encode_dataset([((), 0x00100020, "LO", b"x" * 600, False), ((), 0x00104000, "LT", bytes(range(65, 91)) * 90, False)], deflated)
    df = spark.createDataFrame([(1, bytearray(whole)), (2, bytearray(whole[:40])), (3, bytearray(b"\xff" * 40)), (4, bytearray(b""))], "k bigint, content binary")
    got = {r.k: r.n for r in parse_elements(df, key="k", transfer_syntax=deflated).groupBy("k").agg(F.count("*").alias("n")).collect()}
    assert got[1] == 2 and 3 not in got
    said = {r.k: r.message for r in parse_diagnostics(df, key="k", transfer_syntax=deflated).where("message is not null").collect()}
    assert said[2] == "the deflated data end too early" and said[3].startswith("damaged deflated data") and 1 not in said
    file = encode_file([((), 0x00100020, "LO", b"x" * 600, False)], deflated, "1.2", "2.25.1")
    assert parse_elements(spark.createDataFrame([(1, bytearray(file[:-20] + b"\xff" * 20))], "k bigint, content binary"), key="k").where("is_meta").count() >= 6


def test_what_follows_pixels_in_an_item(spark):
    """Only the pixel data of the file itself end the reading."""
    import struct

    pixel = struct.pack("<HH2sHI", 0x7FE0, 0x0010, b"OW", 0, 4) + b"abcd"
    item = struct.pack("<HHI", 0xFFFE, 0xE000, 0xFFFFFFFF) + pixel + struct.pack("<HHI", 0xFFFE, 0xE00D, 0)
    icon = struct.pack("<HH2sHI", 0x0088, 0x0200, b"SQ", 0, 0xFFFFFFFF) + item + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
    shape = struct.pack("<HH2sH", 0x2050, 0x0020, b"CS", 8) + b"IDENTITY"
    df = spark.createDataFrame([(1, bytearray(icon + shape + pixel))], "k bigint, content binary")
    got = rows(parse_elements(df, key="k", transfer_syntax="1.2.840.10008.1.2.1", stop_before_pixels=True).select("tag", "depth"))
    assert set(got) == {(0x00880200, 0), (0x20500020, 0)}


def test_deferral_of_undefined_length(spark):
    from voxelake.codec.dataset import encode_dataset
    from voxelake.codec.frames import encapsulate
    from voxelake.sources.dicom import load_deferred

    body = encapsulate([b"abcdef", b"gh"])
    df = spark.createDataFrame([(1, bytearray(encode_dataset([((), 0x7FE00010, "OB", body, True)], "1.2.840.10008.1.2.1")))], "k bigint, content binary")
    late = parse_elements(df, key="k", transfer_syntax="1.2.840.10008.1.2.1", defer_size=8)
    assert [(r.deferred, r.raw) for r in late.collect()] == [(True, None)]
    assert bytes(load_deferred(late, df, key="k").first().raw) == body


def test_fields_rows_and_lazy_reading(spark, tmp_path):
    from voxelake.codec.file_bytes import FileBytes
    from voxelake.codec.dataset import parse_file
    from voxelake.sources.dicom import parse_rows

    big = encode_file([((), 0x00100020, "LO", b"ID01", False), ((), 0x00104000, "LT", b"y" * 400_000, False), ((), 0x20500020, "CS", b"INVERSE ", False), ((), 0x7FE00010, "OW", b"z" * 900_000, False)], "1.2.840.10008.1.2.1", "1.2", "2.25.9")
    df = spark.createDataFrame([(1, bytearray(big)), (2, bytearray(b"none")), (3, None), (None, bytearray(some(4)))], "k bigint, content binary")
    assert rows(parse_rows(df, key="k", columns={0x00100020: "id", 0x20500020: "shape"})) == sorted([(1, "ID01", "INVERSE"), (2, None, None), (None, "ID0004", None)], key=repr)
    e = parse_elements(df, key="k", fields=("tag", "depth"))
    assert e.columns == ["k", "depth", "tag"] and e.where("k = 1").count() == 6 + 1 + 4
    with pytest.raises(ValueError):
        parse_elements(df, key="k", fields=("nothing",))
    path = tmp_path / "big.dcm"
    path.write_bytes(big)
    for options, most in (({"stop_before_pixels": True}, 3 << 16), ({"values": frozenset({0x00100020})}, 5 << 16), ({"defer_size": 100}, 5 << 16)):
        with open(path, "rb") as f:
            lazy = FileBytes(f, len(big))
            _, r = parse_file(lazy, **options)
            _, whole = parse_file(big, **options)
            assert [(x.tag, x.raw, x.offset) for x in r.elements] == [(x.tag, x.raw, x.offset) for x in whole.elements]
            assert lazy.fetched <= most + (400_000 if "stop_before_pixels" in options else 0), (options, lazy.fetched)
    with open(path, "rb") as f:
        lazy = FileBytes(f, len(big))
        assert lazy.find(b"INVERSE") == big.find(b"INVERSE") and lazy.find(b"nowhere") == -1 and lazy[5:5] == b"" and lazy[128] == big[128]


def test_writer_keeps_folders(spark, tmp_path):
    spark.dataSource.register(DicomSource)
    names = [f"file:/data/{a}/1.dcm" for a in "ab"]
    files = spark.createDataFrame([(n, bytearray(some(i))) for i, n in enumerate(names)], "file string, content binary")
    files.write.format("dicom").mode("append").option("base", "file:/data").save(str(tmp_path / "one"))
    files.write.format("dicom").mode("append").save(str(tmp_path / "two"))
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*.dcm")) == ["one/a/1.dcm", "one/b/1.dcm", "two/data/a/1.dcm", "two/data/b/1.dcm"]
    got = spark.read.format("dicom").option("stopBeforePixels", "true").option("deferSize", "4").load(str(tmp_path / "one"))
    assert rows(got.where("tag = 1048608").select("deferred", F.element_at(F.split("file", "/"), -2))) == [(True, "a"), (True, "b")]
    bad = spark.createDataFrame([("../x.dcm", bytearray(b"x"))], "file string, content binary")
    with pytest.raises(Exception, match="no file name"):
        bad.write.format("dicom").mode("append").save(str(tmp_path / "three"))


def test_writing_faults_and_byte_order(spark):
    from voxelake.sources.dicom import encode_datasets, encode_files

    explicit, big = "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.2"
    e = spark.createDataFrame([(1, 0x00100010, "PN", ["Müller"]), (2, 0x00100010, "PN", ["Doe"])], "k bigint, tag bigint, vr string, strings array<string>")
    got = {r.k: r for r in encode_datasets(e, key="k").collect()}
    assert got[1].content is None and "ascii" in got[1].write_error and got[2].write_error is None
    with pytest.raises(Exception, match="ascii"):
        encode_datasets(e, key="k", mode="FAILFAST").collect()
    w = spark.createDataFrame([(1, 0x7FE00010, "OW", bytearray(b"\1\2\3\4")), (1, 0x00280010, "US", bytearray(b"\5\0")), (1, 0x00420011, "OB", bytearray(b"\1\2"))], "k bigint, tag bigint, vr string, raw binary")
    there = encode_datasets(w, key="k", transfer_syntax=big)
    assert b"\2\1\4\3" in bytes(there.first().content) and b"\0\5" in bytes(there.first().content)
    back = parse_elements(there, key="k", transfer_syntax=big)
    again = parse_elements(encode_datasets(back, key="k", transfer_syntax=explicit, big_endian_source=True), key="k", transfer_syntax=explicit)
    assert {r.tag: bytes(r.raw) for r in again.collect()} == {0x7FE00010: b"\1\2\3\4", 0x00280010: b"\5\0", 0x00420011: b"\1\2"}
    meta = spark.createDataFrame([(1, 0x00020016, "AE", ["SENDER"]), (1, 0x00100020, "LO", ["A"]), (2, 0x00100020, "LO", ["B"])], "k bigint, tag bigint, vr string, strings array<string>")
    f = encode_files(spark.createDataFrame([(1, "1.2", "2.25.1"), (2, None, "2.25.2")], "k bigint, sop_class string, sop_instance string"), meta, key="k")
    assert {r.k: r.write_error for r in f.collect()} == {1: None, 2: "the file meta information lacks (0002,0002)"}
    assert rows(parse_elements(f, key="k").where("tag = 131094").select("strings", "is_meta")) == [(["SENDER"], True)]
    with pytest.raises(ValueError):
        encode_datasets(e, key="k", transfer_syntax="1.2.3")


def test_kana_and_ideographs_escape():
    from voxelake.codec import charsets as cs

    sets = ["ISO 2022 IR 13", "ISO 2022 IR 87"]
    data = cs.encode("ﾔﾏﾀﾞ^ﾀﾛｳ=山田^太郎", sets, "^=\\")
    assert b"\x1b$B" in data and not any(b > 0x80 for b in data.split(b"=")[1]) and cs.decode(data, sets, b"^=\\") == "ﾔﾏﾀﾞ^ﾀﾛｳ=山田^太郎"
    for text, known in (("山", ["ISO_IR 13"]), ("Müller", None), ("漢", ["ISO_IR 100"])):
        with pytest.raises(ValueError):
            cs.encode(text, known)
        assert cs.encode(text, known, errors="replace").count(b"?") == 1


def test_dictionaries(spark):
    from voxelake.codec.dataset import encode_dataset
    from voxelake.dictionary import SEED, dict_uids, dictionary_of, learn_tags, load_private, load_tags, load_uids, parse_tag

    implicit = "1.2.840.10008.1.2"
    data = encode_dataset([((), 0x00081030, "LO", b"CT HEAD ", False), ((), 0x00190010, "LO", b"ACME", False), ((), 0x00191001, "DS", b"1.5 ", False), ((), 0x00720100, "FD", b"\0" * 8, False)], implicit)
    df = spark.createDataFrame([(1, bytearray(data))], "k bigint, content binary")
    assert rows(parse_elements(df, key="k", transfer_syntax=implicit).where("tag = 528432").select("vr", "strings")) == [("LO", ["CT HEAD"])]
    tags = load_tags(spark.createDataFrame([("00720100", "FD", "1", "SelectorFDValue")], "tag string, vr string, vm string, keyword string"))
    private = load_private(spark.createDataFrame([("ACME", "0019xx01", "DS", "1", "x")], "creator string, masked string, vr string, vm string, name string"))
    fuller = dictionary_of(tags, private)
    got = {r.tag: (r.vr, r.strings) for r in parse_elements(df, key="k", transfer_syntax=implicit, dictionary=fuller).collect()}
    assert got[0x00191001] == ("DS", ["1.5"]) and got[0x00720100] == ("FD", ["0.0"]) and SEED.vr(0x00720100) == "UN"
    learnt = learn_tags(spark.createDataFrame([(1, "LO"), (1, "LO"), (1, "SH"), (2, "UN")], "tag bigint, vr string"))
    assert rows(learnt.select("tag", "vr")) == [(1, "LO")]
    uids = {r.uid: r for r in dict_uids(spark).collect()}
    assert uids["1.2.840.10008.1.2.2"].retired and uids["1.2.840.10008.1.2.4.50"].encapsulated and uids["1.2.840.10008.5.1.4.1.1.2"].encapsulated is None
    assert dict_uids(spark, load_uids(spark.createDataFrame([("1.9", "n", "Transfer Syntax", "k", None)], "uid string, name string, type string, keyword string, retired boolean"))).first().encapsulated
    assert parse_tag("PatientName") == parse_tag("(0010,0010)") == parse_tag("0010,0010") == parse_tag("100010") and parse_tag("FFFEE000") == 0xFFFEE000
    for bad in ("Nobody", "(0010)x", "12345678901"):
        with pytest.raises(ValueError):
            parse_tag(bad)
    with pytest.raises(ValueError):
        load_tags(spark.createDataFrame([("1",)], "tag string"))
    with pytest.raises(ValueError):
        SEED.extended(private=[("X", "0018xx01", "DS", "1", "n")])
