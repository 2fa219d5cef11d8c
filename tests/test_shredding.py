from __future__ import annotations

import json

from conftest import rows

from voxelake.operators.shredding import entity_table, item_elements, shred


def table(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "rec_id bigint, record_json string, node string")


def test_paths_and_keys(spark):
    code = {"80100": {"vr": "SH", "Value": ["A"]}, "00080104": {"Value": ["m1", "m2"]}}
    rec = {"0040a730": {"vr": "SQ", "Value": [None, {"40A043": {"Value": code}, "00100010": {"vr": "PN", "Value": [{"Alphabetic": "X"}]}}, {}]}, "00080060": {"Value": [1]}}
    df = shred(table(spark, [json.dumps(rec), None, "{}", "not json", json.dumps([{"00081140": {"Value": [{"00081150": None}]}}])]))
    assert rows(item_elements(df).select("rec_id", "sequence_path", "item_no", "tag")) == [
        (0, "0040A730", 1, "00100010"), (0, "0040A730", 1, "0040A043"), (0, "0040A730/1/0040A043", 0, "00080100"),
        (0, "0040A730/1/0040A043", 0, "00080104"), (4, "00081140", 0, "00081150"),
    ]
    assert rows(df.where("kind = 'error'").select("rec_id")) == [(3,)]
    flat = entity_table(df, "0040A043", {"00080100": "code", "00080104": "meaning", "00080102": "scheme"})
    assert rows(flat.select("rec_id", "sequence_path", "item_no", "code", "meaning", "scheme")) == [(0, "0040A730/1/0040A043", 0, "A", "m1\\m2", None)]


def test_parent_links_hold(spark):
    df = shred(spark.read.parquet("/root/testdata/sf0.001/dicom_json.parquet"))
    nodes = {(r.rec_id, r.node): r for r in df.collect()}
    for (rec, _), r in nodes.items():
        if r.parent is None:
            assert r.kind == "object"
        else:
            assert r.parent < r.node and (rec, r.parent) in nodes


def test_against_recursion(spark):
    src = spark.read.parquet("/root/testdata/sf0.001/dicom_json.parquet")
    want = []

    def walk(rec, ds, path, no):
        for k, v in ds.items():
            tag = k.upper().zfill(8)
            if path:
                want.append((rec, path, no, tag))
            val = v.get("Value") if isinstance(v, dict) else None
            for i, x in enumerate([val] if isinstance(val, dict) else val or []):
                if isinstance(x, dict) and not {"Alphabetic", "Ideographic", "Phonetic"} & x.keys():
                    walk(rec, x, f"{path}/{no}/{tag}" if path else tag, i)

    for r in src.collect():
        walk(r.rec_id, json.loads(r.record_json), "", 0)
    assert rows(item_elements(shred(src)).select("rec_id", "sequence_path", "item_no", "tag")) == sorted(want, key=repr)


def test_deep_long_and_empty(spark):
    deep = '{"00400000":{"Value":[' * 200 + '{"00080060":{"Value":["' + "x" * 200_000 + '"]}}' + "]}}" * 200
    df = shred(table(spark, [deep]))
    assert item_elements(df).count() == 200
    assert item_elements(shred(table(spark, []))).count() == 0
