from __future__ import annotations

import struct

import numpy as np
import pytest

from voxelake.codec import charsets, frames
from voxelake.codec.dataset import Reader, encode_dataset, encode_file, element_bytes, parse_dataset, parse_file, to_raw, values_of
from voxelake.dictionary import VR_OF, lookup_vr
from voxelake.functions.values import ds_text

EXPLICIT, IMPLICIT, BIG, DEFLATED = "1.2.840.10008.1.2.1", "1.2.840.10008.1.2", "1.2.840.10008.1.2.2", "1.2.840.10008.1.2.1.99"


def header(data: str, implicit: bool, little: bool):
    raw = bytes.fromhex(data)
    r = Reader(raw, implicit, little)
    return r.header(0, len(raw), r.tag(0), {})


def test_headers():
    assert header("1000100008000000", True, True) == ("PN", 8, 8)
    assert header("10001000504E0800", False, True) == ("PN", 8, 8)
    assert header("E07F10004F42000000100000", False, True) == ("OB", 4096, 12)
    assert header("1000100008000000", False, True) == ("PN", 8, 8)
    assert header("00100010504E0008", False, False) == ("PN", 8, 8)


def test_golden_bytes():
    e = [((), 0x00100010, "PN", b"Tube^HeNe", False), ((), 0x00100020, "LO", b"Test1101", False)]
    assert encode_dataset(e, IMPLICIT).hex().upper() == "100010000A000000547562655E48654E652010002000080000005465737431313031"
    for tag, vr, raw, want in ((0x00080054, "AE", b"CONQUESTSRV", "080054000C000000434F4E515545535453525620"), (0x00080062, "UI", b"1.2.3", "0800620006000000312E322E3300"), (0x7FE00010, "OB", b"\0\1\2", "E07F10000400000000010200")):
        assert element_bytes(tag, vr, raw, True, True).hex().upper() == want


@pytest.mark.parametrize("uid", [EXPLICIT, IMPLICIT, BIG, DEFLATED])
def test_round_trip(uid):
    little = uid != BIG
    e = [
        ((), 0x00080005, "CS", b"ISO_IR 192", False),
        ((), 0x00100010, "PN", to_raw("PN", ["Müller^José"], little, ["ISO_IR 192"]), False),
        ((), 0x00280010, "US", to_raw("US", [513], little), False),
        (((0x0040A730, 0),), 0x0040A040, "CS", b"NUM ", False),
        (((0x0040A730, 0), (0x0040A043, 0)), 0x00080100, "SH", b"A1", False),
        (((0x0040A730, 1),), 0x0040A30A, "DS", b"1.5\\2 ", False),
        ((), 0x00081140, "SQ", None, False),
    ]
    r = parse_dataset(encode_dataset(e, uid), uid)
    got = {(x.path, x.tag): x for x in r.elements}
    assert not r.diagnostics and values_of("PN", got[(), 0x00100010].raw, little, got[(), 0x00100010].charsets) == ["Müller^José"]
    assert values_of("US", got[(), 0x00280010].raw, little) == ["513"] and ((), 0x00081140) in got
    assert got[((0x0040A730, 0), (0x0040A043, 0)), 0x00080100].raw == b"A1"
    assert values_of("DS", got[((0x0040A730, 1),), 0x0040A30A].raw, little) == ["1.5", "2"]
    f = encode_file(e, uid, "1.2", "2.25.7")
    facts, r2 = parse_file(f)
    assert facts["transfer_syntax"] == uid and facts["charsets"] == ["ISO_IR 192"]
    assert [(x.path, x.tag, x.raw) for x in r2.elements if x.tag >> 16 != 2] == [(x.path, x.tag, x.raw) for x in r.elements]
    with pytest.raises(ValueError):
        parse_file(f[132:])


def test_undefined_lengths_and_unknown_sequences():
    item = element_bytes(0x00080100, "SH", b"A1", False, True)
    end_i, end_s = struct.pack("<HHI", 0xFFFE, 0xE00D, 0), struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
    seq = struct.pack("<HH2sHI", 0x0040, 0xA043, b"SQ", 0, 0xFFFFFFFF) + struct.pack("<HHI", 0xFFFE, 0xE000, 0xFFFFFFFF) + item + end_i + end_s
    r = parse_dataset(seq + element_bytes(0x0040A30A, "DS", b"1 ", False, True), EXPLICIT)
    assert [(x.path, x.tag) for x in r.elements] == [((), 0x0040A043), (((0x0040A043, 0),), 0x00080100), ((), 0x0040A30A)] and not r.diagnostics
    inner = element_bytes(0x00080100, "SH", b"A1", True, True)
    un = struct.pack("<HH2sHI", 0x4453, 0x100C, b"UN", 0, 0xFFFFFFFF) + struct.pack("<HHI", 0xFFFE, 0xE000, len(inner)) + inner + end_s
    assert [x.tag for x in parse_dataset(un, EXPLICIT).elements] == [0x4453100C, 0x00080100]


def test_truncation_says_where():
    whole = encode_dataset([((), 0x00100010, "PN", b"Doe^Jane", False), ((), 0x00100020, "LO", b"ABCD1234", False)], EXPLICIT)
    r = parse_dataset(whole[:-3], EXPLICIT)
    d = r.diagnostics[0]
    assert [x.tag for x in r.elements] == [0x00100010] and (d.kind, d.tag, d.vr, d.offset, d.need, d.have, d.path) == ("truncated_value", 0x00100020, "LO", len(whole) - 8, 8, 5, ())
    assert parse_dataset(whole[:20], EXPLICIT).diagnostics[0].kind == "truncated_header"
    for n in range(len(whole)):
        parse_dataset(whole[:n], EXPLICIT)  # never raises


def test_options():
    e = [((), 0x00100010, "PN", b"Doe^Jane", False), ((), 0x00100020, "LO", b"ABCD1234", False), ((), 0x7FE00010, "OW", b"\0" * 100, False)]
    data = encode_dataset(e, EXPLICIT)
    assert [x.tag for x in parse_dataset(data, EXPLICIT, tags=frozenset({0x00100020})).elements] == [0x00100020]
    assert [x.tag for x in parse_dataset(data, EXPLICIT, stop_before_pixels=True).elements] == [0x00100010, 0x00100020]
    late = parse_dataset(data, EXPLICIT, defer_size=50).elements[-1]
    assert late.deferred and late.raw is None and data[late.offset : late.offset + late.length] == b"\0" * 100


def test_charsets():
    assert charsets.decode(bytes.fromhex("C4D6DC"), ["ISO_IR 100"]) == "ÄÖÜ" and charsets.decode(bytes.fromhex("C4E9EFEDF5F3E9EFF2"), ["ISO_IR 126"]) == "Διονυσιος"
    for text, sets in (("Yamada^Tarou=山田^太郎=やまだ^たろう", ["", "ISO 2022 IR 87"]), ("Hong^Gildong=洪^吉洞=홍^길동", ["", "ISO 2022 IR 149"]), ("Wang^XiaoDong=王^小東", ["ISO_IR 192"]), ("Wang^XiaoDong=王^小东", ["GB18030"]), ("Люкceмбypг", ["ISO_IR 144"])):
        assert charsets.decode(charsets.encode(text, sets, "^=\\"), sets, b"^=\\") == text


def test_decimal_strings():
    assert [ds_text(v) for v in (1.0, 0.0, -0.0, 0.00001)] == ["1.0", "0.0", "-0.0", "1e-05"]
    assert ds_text(3.141592653589793) == "3.14159265358979" and ds_text(-3.141592653589793) == "-3.1415926535898"
    assert ds_text(5.3859401928763739403e-7) == "5.3859401929e-07" and ds_text(-5.3859401928763739403e-7) == "-5.385940193e-07"
    assert ds_text(1.2342534378125532912998323e10) == "12342534378.1255" and ds_text(1.7976931348623157e308) == "1.797693135e+308"
    assert ds_text(1 / 3) == "0.33333333333333" and ds_text(-1 / 3) == "-0.3333333333333" and ds_text(123456789012345678) == "1.2345678901e+17"
    assert ds_text(float("nan")) is None


def test_frames():
    assert frames.split_offsets(bytes.fromhex("FEFF00E000000000")) == ([], b"")
    one = bytes.fromhex("FEFF00E000000000FEFF00E00400000001000000")
    assert frames.frames_of(one, 5) == [b"\1\0\0\0"]
    parts = bytes.fromhex("FEFF00E000000000") + b"".join(frames.itemise(bytes([i, 0, 0, 0])) for i in (1, 2, 3))
    assert frames.frames_of(parts, 1) == [b"\1\0\0\0\2\0\0\0\3\0\0\0"] and len(frames.frames_of(parts, 3)) == 3
    with pytest.raises(ValueError):
        frames.frames_of(parts, 2)
    with pytest.raises(ValueError):
        frames.split_offsets(bytes.fromhex("FEFF00E003000000000000"))
    marks = frames.itemise(b"") + b"".join(frames.itemise(b) for b in (b"ab", b"c\xff\xd9\0", b"d\xff\xd9\0"))
    assert frames.frames_of(marks, 2) == [b"abc\xff\xd9\0", b"d\xff\xd9\0"]
    data, offsets, lengths = frames.encapsulate_extended([b"abc", b"defg"])
    assert frames.frames_of(data, 2, (offsets, lengths)) == [b"abc", b"defg"]
    assert frames.frames_of(frames.encapsulate([b"abcd", b"efghij"], 2), 2) == [b"abcd", b"efghij"]
    with pytest.raises(ValueError):
        frames.decode_frame("1.2.840.10008.1.2.4.50", b"", 1, 1, 1, 8)


def test_rle_and_samples():
    rng = np.random.default_rng(1)
    for rows, cols, samples, bits in ((2, 2, 1, 8), (5, 7, 3, 8), (4, 200, 1, 16), (1, 1, 1, 8)):
        for top in (3, 256):
            raw = rng.integers(0, top, rows * cols * samples * bits // 8, np.uint8).tobytes()
            assert frames.rle_decode(frames.rle_encode(raw, rows, cols, samples, bits), rows, cols, samples, bits) == raw
    assert frames.unpack_samples(b"\x88\x07", 16, True).tolist() == [1928] and frames.interleave(frames.planes(b"abcdef", 3, 1), 3, 1) == b"abcdef"
    assert lookup_vr(0x60023000) == "OB or OW" and lookup_vr(0x00091000, "ACUSON") == "IS" and lookup_vr(0x00091000) == "UN" and lookup_vr(0x00090010) == "LO" and len(VR_OF) > 80


def test_write_rules():
    from voxelake.codec.dataset import REQUIRED_META, missing_meta, write_encoding

    assert write_encoding(IMPLICIT) == (True, True) and write_encoding(BIG, False, False) == (False, False) and write_encoding("1.9", False, True) == (False, True)
    for bad in ((EXPLICIT, True, True), ("1.2.840.10008.1.1", False, True), ("1.9", None, True), (None, True, False)):
        with pytest.raises(ValueError):
            write_encoding(*bad)
    assert missing_meta(set(REQUIRED_META)) == [] and missing_meta({0x00020010}) == [t for t in REQUIRED_META if t != 0x00020010]
    with pytest.raises(ValueError):
        missing_meta({0x00080005})
    with pytest.raises(ValueError):
        encode_file([((), 0x00020010, "UI", b"1.2", False)], EXPLICIT, "1", "2")


def test_json_and_dump():
    import json

    from voxelake.__main__ import lines
    from voxelake.codec.json_model import dataset_json

    e = [
        {"path": [], "tag": 0x00100010, "vr": "PN", "strings": ["Yamada^Tarou=山田^太郎"], "raw": None},
        {"path": [{"tag": 0x0040A730, "item": 0}], "tag": 0x0040A30A, "vr": "DS", "strings": ["1.5", ""], "raw": None},
        {"path": [], "tag": 0x00420011, "vr": "OB", "strings": None, "raw": b"x" * 13},
    ]
    got = json.loads(dataset_json(e, 4, "https://example.com"))
    assert got["00100010"] == {"vr": "PN", "Value": [{"Alphabetic": "Yamada^Tarou", "Ideographic": "山田^太郎"}]}
    assert got["0040A730"]["Value"][0]["0040A30A"]["Value"] == [1.5, None] and got["00420011"] == {"vr": "OB", "BulkDataURI": "https://example.com/00420011"}
    assert "InlineBinary" in json.loads(dataset_json(e))["00420011"]
    f = encode_file([((), 0x00100010, "PN", b"Doe^Jane", False)], EXPLICIT, "1.2", "2.25.7")
    assert [x for x in lines(f, meta=False)] == [f"(0010,0010) {'PatientName':36} PN: Doe^Jane"]


def test_uids_and_colour():
    from voxelake.codec.pixels import expand_422
    from voxelake.operators.images import UID_ROOT, color_by_pixel

    import hashlib

    assert (UID_ROOT + str(int(hashlib.sha512(b"loremipsum").hexdigest(), 16)))[:64] == "1.2.826.0.1.3680043.8.498.87507166259346337659265156363895084463"
    assert list(expand_422(bytes([10, 20, 30, 40]))) == [10, 30, 40, 20, 30, 40] and color_by_pixel(b"adbecf", 3, 8) == b"abcdef"
