from __future__ import annotations

from conftest import rows

from voxelake.llm.lookalikes import fold, look_alike_pairs, unify

SCHEMA = "name_id bigint, alphabetic string, ideographic string, canonical int"


def test_fold():
    assert fold("Ｊöｒｇ＾Ａ") == "Jörg^A" and fold("Jo\u0308rg") == "Jörg" and fold("O’Neil\u200b\xa0B\u2011c") == "O'Neil B-c"
    assert fold("\u212aim") == "Kim" and fold("⽔浦^ｱｶﾞ") == "水浦^アガ" and fold("谷\ufe00") == "谷"
    assert fold("x²") == "x²" and fold("Ä") != fold("A") and fold("é") == fold("e\u0301")


def test_repair_needs_the_vocabulary(spark):
    data = [(1, "Laszlo^Ann", None, 0), (2, "Lаszlо^Ann", None, 0), (3, "Βοris", None, 0), (4, "Иван", "ニコ", 0), (5, "Иван", "二コ", 0), (6, "Bοrіs^X", None, 0), (7, None, None, 0), (8, "", "", 0)]
    got = {r.name_id: (r.alphabetic, r.ideographic) for r in unify(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got[2] == ("Laszlo^Ann", None) and got[1] == ("Laszlo^Ann", None)
    assert got[3][0] == got[6][0].split("^")[0] == "Boris"  # two different spellings lead to it
    assert got[5] == ("Иван", "ニコ") and got[7] == (None, None) and got[8] == ("", "")
    one = {r.name_id: r.alphabetic for r in unify(spark.createDataFrame(data[2:3], SCHEMA)).collect()}
    assert one[3] == "Βοris"  # nothing in the corpus supports the Latin form


def test_pairs_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/person_names.parquet").union(spark.read.parquet("/root/testdata/sf0.01/person_names.parquet").where("name_id > 150 and name_id < 900"))
    canon = {r.name_id: r for r in unify(df).collect()}
    raw = {r.name_id: r for r in df.collect()}
    ids = sorted(raw)
    want = [
        (a, b)
        for i, a in enumerate(ids)
        for b in ids[i + 1 :]
        if any(raw[a][c] is not None and raw[b][c] is not None and raw[a][c] != raw[b][c] and canon[a][c] == canon[b][c] for c in ("alphabetic", "ideographic"))
    ]
    assert rows(look_alike_pairs(df)) == sorted(want, key=repr) and len(want) > 10


def test_odd_tables(spark):
    data = [(1, "A" * 100_000, None, 0), (2, "Ａ" * 100_000, None, 0), (2, "Ａ" * 100_000, None, 0), (3, "A" * 100_000, None, 0), (None, "Ａ" * 100_000, None, 0)]
    assert rows(look_alike_pairs(spark.createDataFrame(data, SCHEMA))) == [(1, 2), (2, 3)]
    assert look_alike_pairs(spark.createDataFrame([], SCHEMA)).count() == 0
