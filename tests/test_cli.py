from __future__ import annotations

import io
import pickle

import pytest
from conftest import rows

from voxelake import errors, log
from voxelake.__main__ import main
from voxelake.codec.dataset import encode_file, parse_file
from voxelake.sources.dicom import fetch_deferred, read_dicom


def file_of(path, n=1):
    e = [((), 0x00100010, "PN", b"Doe^Jane", False), (((0x0040A730, 0),), 0x0040A30A, "DS", b"1.5 ", False), ((), 0x00104000, "LT", b"y" * (300 * n), False)]
    path.write_bytes(encode_file(e, "1.2.840.10008.1.2.1", "1.2", f"2.25.{n}", bytes(128)))
    return path


def test_show_and_readcopy(tmp_path, capsys):
    a, b = file_of(tmp_path / "a.dcm"), tmp_path / "b.dcm"
    assert main(["show", str(a), "--no-meta", "-t", "PatientName", "-t", "0040,A30A"]) == 0
    assert capsys.readouterr().out.splitlines() == [f"(0010,0010) {'PatientName':36} PN: Doe^Jane", f"  (0040,A30A) {'NumericValue':36} DS: 1.5"]
    assert main(["read", str(a), "--top", "3", "--debug"]) == 0
    got = capsys.readouterr()
    assert len(got.out.splitlines()) == 3 and "component=voxelake.reader" in got.err
    assert main(["readcopy", str(a), str(b)]) == 0 and a.read_bytes() == b.read_bytes()
    assert main(["show", str(tmp_path / "none.dcm")]) == 1 and main(["show", str(a), "-t", "Nobody"]) == 1
    with pytest.raises(SystemExit):
        main(["readcopy", str(a)])


def test_errors_are_value_errors():
    with pytest.raises(errors.InvalidDicomError):
        parse_file(b"none")
    x = errors.SyntaxUnknownError("1.2.3")
    assert isinstance(x, ValueError) and str(pickle.loads(pickle.dumps(x))) == str(x) == "unknown transfer syntax 1.2.3"


def test_logging_is_silent_unless_asked():
    out = io.StringIO()
    h = log.enable(stream=out)
    log.logger("reader").debug("n=%d", 3)
    log.disable(h)
    log.logger("reader").debug("n=%d", 4)
    assert out.getvalue() == "DEBUG component=voxelake.reader n=3\n"


def test_deferred_values_from_files(spark, tmp_path):
    for i in (1, 2, 3):
        file_of(tmp_path / f"{i}.dcm", i)
    late = read_dicom(spark, str(tmp_path), defer_size=100)
    late = late.where("deferred").cache()
    assert late.count() == 3
    (tmp_path / "2.dcm").write_bytes((tmp_path / "2.dcm").read_bytes()[:400])
    (tmp_path / "3.dcm").unlink()
    got = {r.file[-5]: r for r in fetch_deferred(late).collect()}
    assert bytes(got["1"].raw) == b"y" * 300 and got["2"].raw is None and got["2"].value_error == "the file has become shorter" and got["3"].value_error
    assert rows(fetch_deferred(late.limit(0))) == []
