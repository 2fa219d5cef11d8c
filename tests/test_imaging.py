"""Images from files to shown frames, against plain arithmetic on small arrays."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from voxelake.codec import frames as fr
from voxelake.codec import pixels as px
from voxelake.codec.dataset import encode_file, to_raw
from voxelake.operators import elements as el
from voxelake.operators import imaging as im
from voxelake.sources.dicom import parse_elements

EXPLICIT, RLE, JPEG = "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.5", "1.2.840.10008.1.2.4.50"


def image(data: bytes, syntax: str = EXPLICIT, undefined: bool = False, more: tuple = (), drop: tuple = (), **v) -> bytearray:
    values = {0x00280002: ("US", ["1"]), 0x00280004: ("CS", ["MONOCHROME2"]), 0x00280010: ("US", ["2"]), 0x00280011: ("US", ["2"]), 0x00280100: ("US", ["8"]), 0x00280101: ("US", ["8"]), 0x00280103: ("US", ["0"])}
    values |= {int(k[1:], 16): x for k, x in v.items()}
    e = [((), t, vr, to_raw(vr, s, True), False) for t, (vr, s) in values.items() if t not in drop]
    return bytearray(encode_file([*e, *more, ((), 0x7FE00010, "OB" if undefined else "OW", data, undefined)], syntax, "1.2", "2.25.1"))


def frame_of(spark, data, **o):
    r = im.display_frames(spark.createDataFrame([(1, data)], "k int, content binary"), key="k", **o).collect()
    return [list(x.frame) if x.frame is not None else x.frame_error for x in r]


def test_display(spark):
    raw = bytes([0, 10, 200, 255])
    assert frame_of(spark, image(raw)) == [[0, 10, 200, 255]]
    assert frame_of(spark, image(raw, t00280004=("CS", ["MONOCHROME1"]))) == [[255, 245, 55, 0]]
    assert frame_of(spark, image(raw, t20500020=("CS", ["INVERSE"]))) == [[255, 245, 55, 0]]
    assert frame_of(spark, image(raw, t20500020=("CS", ["ODD"])))[0].startswith("unknown presentation")
    assert frame_of(spark, image(bytes(4))) == [[0, 0, 0, 0]]
    window = {"t00281050": ("DS", ["100", "128"]), "t00281051": ("DS", ["50", "256"])}
    want = [int(np.floor(np.clip(((v - 99.5) / 49 + 0.5) * 255, 0, 255) + 0.5)) for v in raw]
    assert frame_of(spark, image(raw, **window)) == [want] and frame_of(spark, image(raw, **window), window=5) == ["there is no window 5"]
    assert frame_of(spark, image(raw, t00281056=("CS", ["NONE"]), **window))[0].startswith("unknown VOI")
    sig = frame_of(spark, image(raw, t00281056=("CS", ["SIGMOID"]), **window))[0]
    assert sig == [int(np.floor(255 / (1 + np.exp(-4 * (v - 100) / 50)) + 0.5)) for v in raw]
    item = ((0x00283010, 0),)
    lut = ((item, 0x00283002, "US", to_raw("US", ["3", "10", "8"], True), False), (item, 0x00283006, "US", to_raw("US", ["1", "2", "3"], True), False))
    assert frame_of(spark, image(raw, more=lut, **window)) == [[1, 1, 3, 3]] and frame_of(spark, image(raw, more=lut, **window), prefer_lut=False) == [want]
    mod = tuple((((0x00283000, 0),), *x[1:]) for x in lut)
    assert frame_of(spark, image(raw, more=mod, t00281052=("DS", ["1"]), t00281053=("DS", ["2"]))) == [[1, 1, 3, 3]]  # the table goes before slope and intercept
    assert frame_of(spark, image(raw, t00281053=("DS", ["2"]))) == [[0, 10, 200, 255]]  # slope alone changes nothing
    short = ((item, 0x00283002, "US", to_raw("US", ["9", "0", "8"], True), False), (item, 0x00283006, "US", b"\1\2", False))
    assert "entries" in frame_of(spark, image(raw, more=short))[0]


def test_descriptions_and_bad_data(spark):
    files = [(1, image(bytes(4))), (2, image(bytes(4), drop=(0x00280010, 0x00280100))), (3, bytearray(b"none")), (4, None), (5, image(bytes(7))), (None, image(bytes(3), t00280010=("US", ["1"]), t00280011=("US", ["3"])))]
    df = spark.createDataFrame(files, "k int, content binary")
    got = {r.k: r for r in im.describe_images(df, key="k").collect()}
    assert (got[1].rows, got[1].bits_stored, got[1].frame_bytes, got[1].missing, got[1].read_error) == (2, 8, 4, [], None)
    assert got[2].missing == ["Rows", "BitsAllocated"] and got[3].read_error == "no DICM prefix" and got[4].read_error == "no content"
    d = {r.k: r for r in im.decoded_frames(df, key="k").collect()}
    assert d[2].frame_error == "missing Rows, BitsAllocated" and d[3].frame_error == "no DICM prefix" and "7 bytes" in d[5].frame_error or "8 bytes" in d[5].frame_error
    assert 4 not in d and bytes(d[None].frame) == bytes(3)  # one byte of padding is lawful
    assert im.decoded_frames(df, key="k", index=3).where("k = 1").first().frame_error == "there is no frame 3 of 1"
    assert im.display_frames(df.limit(0), key="k").count() == 0 and im.describe_images(df.limit(0), key="k").count() == 0


def test_colour(spark):
    colour = {"t00280002": ("US", ["3"]), "t00280010": ("US", ["1"])}
    full = image(bytes([76, 85, 255, 255, 128, 128]), t00280004=("CS", ["YBR_FULL"]), **colour)
    assert frame_of(spark, full) == [[254, 0, 0, 255, 255, 255]]
    half = image(bytes([10, 20, 128, 128]), t00280004=("CS", ["YBR_FULL_422"]), **colour)
    assert frame_of(spark, half) == [[10, 10, 10, 20, 20, 20]]
    planes = image(bytes([1, 2, 3, 4, 5, 6]), t00280004=("CS", ["RGB"]), t00280006=("US", ["1"]), **colour)
    assert frame_of(spark, planes) == [[1, 3, 5, 2, 4, 6]]
    df = spark.createDataFrame([(1, planes)], "k int, content binary")
    assert list(im.decoded_frames(df, key="k", raw=True).first().frame) == [1, 2, 3, 4, 5, 6]
    s = im.sample_rows(im.sample_frames(df, key="k"), im.describe_images(df, key="k"), key="k")
    assert rows(s.select("row", "col", "sample", "value"))[:4] == [(0, 0, 0, 1.0), (0, 0, 1, 3.0), (0, 0, 2, 5.0), (0, 1, 0, 2.0)]


def test_compression_and_registered_codecs(spark):
    frames = [bytes(range(i, i + 4)) for i in range(5)]
    df = spark.createDataFrame([(1, image(b"".join(frames), t00280008=("IS", ["5"]))), (2, bytearray(b"x")), (3, None)], "k int, content binary")
    fr.register_codec(JPEG, lambda d, *_: d[::-1], lambda d, *_: d[::-1])
    try:
        for syntax in (RLE, JPEG, "1.2.840.10008.1.2.8.1"):
            for o in ({}, {"per_frame": 2}, {"extended": True}, {"table": False}):
                packed = im.compress_images(df, key="k", transfer_syntax=syntax, **o)
                got = {r.k: r for r in packed.collect()}
                assert got[1].write_error is None and got[2].write_error and got[3].write_error == "no content" and (got[1].extended_offsets is not None) == bool(o.get("extended"))
                e = im.replace_pixels(parse_elements(df, key="k").where("NOT is_meta"), packed, key="k")
                parts = [((), r.tag, r.vr, bytes(r.raw), bool(r.undefined_length)) for r in e.where("k = 1").collect()]
                again = spark.createDataFrame([(1, bytearray(encode_file(parts, syntax, "1.2", "2.25.1")))], "k int, content binary")
                assert [bytes(r.frame) for r in im.decoded_frames(again, key="k").orderBy("frame_idx").collect()] == frames, (syntax, o)
                assert bytes(im.decoded_frames(again, key="k", index=3).first().frame) == frames[3]
                assert im.fragment_counts(again, key="k").first().fragments == (10 if o.get("per_frame") else 5)
                assert bytes(im.joined_frames(im.decoded_frames(again, key="k"), key="k").first().data) == b"".join(frames)
                back = im.compress_images(again, key="k", transfer_syntax=EXPLICIT).first()
                assert bytes(back.pixel_data) == b"".join(frames) and not back.undefined_length
    finally:
        del fr.CODECS[JPEG]
    with pytest.raises(ValueError):
        im.compress_images(df, key="k", transfer_syntax=RLE, per_frame=2, extended=True)
    with pytest.raises(ValueError):
        im.compress_images(df, key="k", transfer_syntax="1.2.3")
    lost = im.compress_images(df, key="k", transfer_syntax=JPEG).where("k = 1").first()
    assert lost.write_error == f"unsupported transfer syntax {JPEG}"


def test_single_frames_and_marks(spark):
    parts = [b"ab\xff\xd9", b"cdef", b"gh\xff\xd9\0\0"]
    data = fr.itemise(b"") + b"".join(fr.itemise(p) for p in parts)
    assert fr.single_frame(data, 1, 2) == b"cdefgh\xff\xd9\0\0" and fr.count_fragments(data) == 3
    assert fr.extended_table(None, b"") is None and fr.extended_table(bytes(8), bytes(16)) is None
    for bad in (-1, 2):
        with pytest.raises(ValueError):
            fr.single_frame(data, bad, 2)
    f = spark.createDataFrame([(1, i, bytearray(p)) for i, p in enumerate(parts)] + [(2, 0, None), (2, 1, bytearray(b"x"))], "k int, i int, f binary").withColumn("eoi", el.ends_image(F.col("f")))
    assert [(r.k, r.i, r.eoi, r.frame_idx) for r in el.fragment_frames(f, key="k", order="i", marks_end="eoi").orderBy("k", "i").collect()] == [(1, 0, True, 0), (1, 1, False, 1), (1, 2, True, 1), (2, 0, False, 0), (2, 1, False, 0)]


def test_window_ranges():
    img = px.Image(EXPLICIT, stored=8, signed=True, slope=2.0, intercept=-10.0, photometric="MONOCHROME2")
    assert px.window_range(img) == (-266.0, 244.0) and px.modality_values(np.array([1.0]), img).tolist() == [-8.0]
    img.modality = px.Lut(0, np.array([1, 2]), 8)
    assert px.window_range(img) == (0.0, 255.0)
    w1 = px.Image(EXPLICIT, stored=8, photometric="MONOCHROME1")
    assert px.windowed(np.array([0.0, 1, 128, 254, 255]), 0, 1, w1).tolist() == [255.0] * 5
    assert np.allclose(px.windowed(np.array([0.0, 1, 128, 254, 255]), 254, 128, w1), [0, 0, 0, 128.5, 130.5], atol=0.1)
    for centre, width, function in ((0, 0, "LINEAR"), (0, 0, "LINEAR_EXACT"), (0, -1, "SIGMOID")):
        w1.function = function
        with pytest.raises(ValueError):
            px.windowed(np.zeros(1), centre, width, w1)
