"""Queries of the dataset operators over the driver's tables: rows are mapped to DICOM elements,
run through an operator, and compared with what SQL says about the rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from voxelake.codec import charsets as cs
from voxelake.codec import frames as fr
from voxelake.dictionary import dict_private, dict_repeaters, dict_tags, dict_uids
from voxelake.functions import pixels as px
from voxelake.functions import tags as tg
from voxelake.functions import values as vl
from voxelake.operators import elements as el
from voxelake.session import table
from voxelake.sources.dicom import encode_datasets, encode_files, load_deferred, parse_diagnostics, parse_elements, parse_files, parse_rows

EXPLICIT, IMPLICIT, BIG, DEFLATED = "1.2.840.10008.1.2.1", "1.2.840.10008.1.2", "1.2.840.10008.1.2.2", "1.2.840.10008.1.2.1.99"
ID, NAME, DATE, DOSE, ROWS = 0x00100020, 0x00100010, 0x00080020, 0x00180050, 0x00280010


def query_table() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str], Callable]:
    """(queries, SQL, decorator that registers a query under its function's name with its SQL)."""
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    oracles: dict[str, str] = {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return add

    return queries, oracles, query


QUERIES, ORACLES, query = query_table()


def as_elements(df: DataFrame, key: str, values: dict[int, tuple[str, object]]) -> DataFrame:
    """One row per (key, tag) of a wide row; nulls give empty elements."""
    entry = [F.struct(F.lit(t).cast("bigint").alias("tag"), F.lit(vr).alias("vr"), F.array(c.cast("string")).alias("strings")) for t, (vr, c) in values.items()]
    return df.select(key, F.explode(F.array(*entry)).alias("e")).select(key, "e.*")


def order_elements(spark: SparkSession, d: str) -> DataFrame:
    """Every order as a dataset: patient id and name, date, dose, rows."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey)
    return as_elements(
        j, "o_orderkey",
        {ID: ("LO", F.col("o_custkey")), NAME: ("PN", F.col("c_name")), DATE: ("DA", F.date_format("o_orderdate", "yyyyMMdd")),
         DOSE: ("DS", F.round("o_totalprice", 2).cast("decimal(14,2)")), ROWS: ("US", F.col("o_orderkey") % 65536)},
    )


WIDE = {ID: "patient_id", NAME: "patient_name", DATE: "study_date", DOSE: "dose", ROWS: "n_rows"}


def wide(data: DataFrame, uid: str | None) -> DataFrame:
    return parse_rows(data, key="o_orderkey", columns=WIDE, transfer_syntax=uid)


@query("""SELECT n_name, count(*) AS studies, round(avg(CAST(round(o_totalprice, 2) AS DOUBLE)), 4) AS mean_dose
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def patient_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders encoded as datasets, parsed back, four tags selected and aggregated by nation."""
    data = encode_datasets(order_elements(spark, d), key="o_orderkey", transfer_syntax=EXPLICIT)
    w = parse_rows(data, key="o_orderkey", columns={ID: "patient_id", DOSE: "dose"}, transfer_syntax=EXPLICIT)
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    j = w.join(c, w.patient_id.cast("bigint") == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count("*").alias("studies"), F.round(F.avg(F.col("dose").cast("double")), 4).alias("mean_dose"))


_ROUND = """SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS patient_id, c_name AS patient_name, strftime(o_orderdate, '%Y%m%d') AS study_date,
CAST(CAST(round(o_totalprice, 2) AS DECIMAL(14,2)) AS VARCHAR) AS dose, CAST(o_orderkey % 65536 AS VARCHAR) AS n_rows FROM orders JOIN customer ON o_custkey = c_custkey"""


def _round_trip(uid: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        data = encode_datasets(order_elements(spark, d), key="o_orderkey", transfer_syntax=uid)
        return wide(data, uid)

    run.__doc__ = f"Every order encoded under {uid} and parsed back."
    return run


for _name, _uid in (("roundtrip_explicit", EXPLICIT), ("roundtrip_implicit", IMPLICIT), ("roundtrip_big_endian", BIG), ("roundtrip_deflated", DEFLATED)):
    QUERIES[_name], ORACLES[_name] = _round_trip(_uid), _ROUND


@query(_ROUND)
def roundtrip_part10(spark: SparkSession, d: str) -> DataFrame:
    """Every order as a whole deflated file and back."""
    o = table(spark, d, "orders").select("o_orderkey", F.lit("1.2.840.10008.5.1.4.1.1.2").alias("sop_class"), F.concat(F.lit("2.25."), "o_orderkey").alias("sop_instance"))
    return wide(encode_files(o, order_elements(spark, d), key="o_orderkey", transfer_syntax=DEFLATED), None)


@query(f"SELECT o_orderkey, '{EXPLICIT}' AS transfer_syntax, false AS implicit_vr, true AS little_endian, CAST(NULL AS VARCHAR) AS read_error FROM orders JOIN customer ON o_custkey = c_custkey")
def file_facts(spark: SparkSession, d: str) -> DataFrame:
    """Syntax and encoding of written files."""
    o = table(spark, d, "orders").select("o_orderkey", F.lit("1.2").alias("sop_class"), F.lit("2.25.1").alias("sop_instance"))
    return parse_files(encode_files(o, order_elements(spark, d), key="o_orderkey"), key="o_orderkey").select("o_orderkey", "transfer_syntax", "implicit_vr", "little_endian", "read_error")


def _le(n: str, size: int) -> str:
    return " || ".join(f"printf('%02X', ({n} // {256**i}) % 256)" for i in range(size))


@query(f"""WITH v AS (SELECT c_custkey, CASE WHEN length(c_name) % 2 = 1 THEN c_name || ' ' ELSE c_name END AS n,
CASE WHEN length(CAST(c_custkey AS VARCHAR)) % 2 = 1 THEN CAST(c_custkey AS VARCHAR) || ' ' ELSE CAST(c_custkey AS VARCHAR) END AS i FROM customer)
SELECT c_custkey, '10001000' || {_le('length(n)', 4)} || hex(encode(n)) || '10002000' || {_le('length(i)', 4)} || hex(encode(i)) AS implicit_hex,
'10001000504E' || {_le('length(n)', 2)} || hex(encode(n)) || '100020004C4F' || {_le('length(i)', 2)} || hex(encode(i)) AS explicit_hex FROM v""")
def encoded_hex(spark: SparkSession, d: str) -> DataFrame:
    """The very bytes of a dataset of name and id, in both little-endian syntaxes."""
    e = as_elements(table(spark, d, "customer"), "c_custkey", {NAME: ("PN", F.col("c_name")), ID: ("LO", F.col("c_custkey"))})
    hexed = lambda uid, n: encode_datasets(e, key="c_custkey", transfer_syntax=uid).select("c_custkey", F.hex("content").alias(n))
    return hexed(IMPLICIT, "implicit_hex").join(hexed(EXPLICIT, "explicit_hex"), "c_custkey")


def line_elements(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as items of a sequence, and in each a nested sequence of one item."""
    li = table(spark, d, "lineitem").withColumn("item", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")) - 1)
    path = lambda *p: F.array(*(F.struct(F.lit(t).cast("bigint").alias("tag"), i.cast("int").alias("item")) for t, i in p))
    outer, inner = path((0x300A0111, F.col("item"))), path((0x300A0111, F.col("item")), (0x0040A043, F.lit(0)))
    rows = F.array(
        F.struct(outer.alias("path"), F.lit(0x0040A30A).cast("bigint").alias("tag"), F.lit("DS").alias("vr"), F.array(F.col("l_quantity").cast("int").cast("string")).alias("strings")),
        F.struct(inner.alias("path"), F.lit(0x00080100).cast("bigint").alias("tag"), F.lit("SH").alias("vr"), F.array(F.col("l_partkey").cast("string")).alias("strings")),
    )
    return li.select("l_orderkey", F.explode(rows).alias("e")).select("l_orderkey", "e.*")


@query("""SELECT l_orderkey, CAST(count(*) AS BIGINT) AS items, CAST(sum(CAST(l_quantity AS INT)) AS BIGINT) AS quantity, CAST(sum(l_partkey) AS BIGINT) AS codes, 2 AS deepest FROM lineitem GROUP BY l_orderkey""")
def nested_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Lines as nested sequences, encoded and parsed back."""
    data = encode_datasets(line_elements(spark, d), key="l_orderkey", transfer_syntax=EXPLICIT)
    p = parse_elements(data, key="l_orderkey", transfer_syntax=EXPLICIT, fields=("depth", "vr", "strings")).where("vr <> 'SQ'")
    v = F.get("strings", F.lit(0)).cast("bigint")
    return p.groupBy("l_orderkey").agg(
        F.sum((F.col("depth") == 1).cast("bigint")).alias("items"), F.sum(F.when(F.col("depth") == 1, v)).alias("quantity"), F.sum(F.when(F.col("depth") == 2, v)).alias("codes"), F.max("depth").alias("deepest")
    )


@query("""SELECT c_custkey, 'truncated_value' AS kind, CAST(1048608 AS BIGINT) AS tag, 'LO' AS vr,
CAST(16 + length(c_name) + length(c_name) % 2 AS BIGINT) AS at, CAST(8 AS BIGINT) AS need, CAST(5 AS BIGINT) AS have FROM customer""")
def truncation(spark: SparkSession, d: str) -> DataFrame:
    """Three bytes missing at the end of each dataset: what is kept and what is said."""
    e = as_elements(table(spark, d, "customer"), "c_custkey", {NAME: ("PN", F.col("c_name")), ID: ("LO", F.lit("ABCD1234"))})
    data = encode_datasets(e, key="c_custkey").withColumn("content", F.expr("substring(content, 1, length(content) - 3)"))
    return parse_diagnostics(data, key="c_custkey", transfer_syntax=EXPLICIT).select("c_custkey", "kind", "tag", "vr", F.col("offset").alias("at"), "need", "have")


@query("SELECT c_custkey, c_name AS name FROM customer")
def deferred(spark: SparkSession, d: str) -> DataFrame:
    """Long values left out at first, then fetched by place and length."""
    e = as_elements(table(spark, d, "customer"), "c_custkey", {NAME: ("PN", F.col("c_name")), ID: ("LO", F.lit("1"))})
    data = encode_datasets(e, key="c_custkey")
    late = load_deferred(parse_elements(data, key="c_custkey", transfer_syntax=EXPLICIT, defer_size=4), data.drop("write_error"), key="c_custkey")
    return late.select("c_custkey", F.rtrim(F.col("raw").cast("string")).alias("name"))


_T = "(l_partkey % 65536) * 65536 + (l_suppkey * 37 + l_linenumber) % 65536"


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", f"{_T} AS tag")


@query(f"""SELECT tag, tag // 65536 AS grp, tag % 65536 AS elem, printf('(%04X,%04X)', tag // 65536, tag % 65536) AS txt, printf('%08X', tag) AS hexkey,
(tag // 65536) % 2 = 1 AS private, (tag // 65536) % 2 = 1 AND tag % 65536 BETWEEN 16 AND 255 AS creator,
CASE WHEN (tag // 65536) % 2 = 1 AND (tag % 65536) // 256 >= 16 THEN (tag // 65536) * 65536 + (tag % 65536) // 256 END AS creator_tag, tag AS parsed FROM (SELECT {_T} AS tag FROM lineitem)""")
def tag_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    """Parts, texts and predicates of tags."""
    t = F.col("tag")
    return _tagged(spark, d).select(
        "tag", tg.group_of(t).alias("grp"), tg.element_of(t).alias("elem"), tg.tag_text(t).alias("txt"), tg.tag_key(t).alias("hexkey"), tg.is_private(t).alias("private"),
        tg.is_private_creator(t).alias("creator"), tg.private_creator_of(t).alias("creator_tag"), tg.parse_tag(tg.tag_text(t)).alias("parsed"),
    )


@query("SELECT vr, count(*) AS n FROM (SELECT CASE WHEN v IN ('OB') THEN 'binary' WHEN v IN ('SQ') THEN 'sequence' WHEN v = 'US' THEN 'int' WHEN v = 'FD' THEN 'float' WHEN v = 'US or SS' THEN 'ambiguous' ELSE 'string' END AS vr FROM (SELECT ['PN','OB','SQ','US','FD','US or SS','DA'][l_linenumber] AS v FROM lineitem)) GROUP BY vr")
def vr_classes(spark: SparkSession, d: str) -> DataFrame:
    """Classes of value representations."""
    vr = F.get(F.array(*map(F.lit, ("PN", "OB", "SQ", "US", "FD", "US or SS", "DA"))), F.col("l_linenumber") - 1)
    return table(spark, d, "lineitem").groupBy(tg.vr_class(vr).alias("vr")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, strftime(make_date(CAST(o_orderkey % 200 + 1900 AS BIGINT), 1, 1) + to_months(CAST(o_orderkey % 15 AS INT)) + to_days(CAST(o_custkey % 40 AS INT) - 1), '%Y-%m-%d') AS d FROM orders WHERE o_orderkey % 15 < 99""")
def da_rollover(spark: SparkSession, d: str) -> DataFrame:
    """Dates whose month or day is out of range carry over."""
    t = F.format_string("%04d%02d%02d", F.col("o_orderkey") % 200 + 1900, F.col("o_orderkey") % 15 + 1, F.col("o_custkey") % 40)
    return table(spark, d, "orders").select("o_orderkey", F.date_format(vl.parse_da(t), "yyyy-MM-dd").alias("d"))


@query("""SELECT event_id, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT) * 1000000 AS whole, CAST(hour(ts) * 3600 + minute(ts) * 60 AS BIGINT) * 1000000 AS minutes,
CAST(hour(ts) * 3600 + minute(ts) * 60 + 59 AS BIGINT) * 1000000 + 250000 AS leap FROM events""")
def tm_parse(spark: SparkSession, d: str) -> DataFrame:
    """Times of several precisions; second 60 counts as 59."""
    tm = lambda c: vl.parse_tm(c)
    return table(spark, d, "events").select(
        "event_id", tm(F.date_format("ts", "HHmmss")).alias("whole"), tm(F.concat(F.date_format("ts", "HHmm"), F.lit(" "))).alias("minutes"), tm(F.concat(F.date_format("ts", "HHmm"), F.lit("60.25"))).alias("leap")
    )


@query("""SELECT event_id, epoch_us(date_trunc('second', ts)) - CAST(19800 AS BIGINT) * 1000000 AS utc, 330 AS shift, epoch_us(date_trunc('month', ts)) AS month_only FROM events""")
def dt_parse(spark: SparkSession, d: str) -> DataFrame:
    """Date-times with offset, and of month precision."""
    full, short = vl.parse_dt(F.concat(F.date_format("ts", "yyyyMMddHHmmss"), F.lit("+0530"))), vl.parse_dt(F.date_format("ts", "yyyyMM"))
    return table(spark, d, "events").select("event_id", full["utc_micros"].alias("utc"), full["tz_offset_min"].alias("shift"), short["utc_micros"].alias("month_only"))


@query("""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN ' ' || CAST(o_orderkey AS VARCHAR) || ' ' WHEN 1 THEN '-' || CAST(o_custkey AS VARCHAR) || '.5' WHEN 2 THEN CAST(o_orderkey AS VARCHAR) || 'e2' WHEN 3 THEN 'x' || CAST(o_orderkey AS VARCHAR) ELSE CAST(o_orderkey AS VARCHAR) || '0000000000.25' END AS s FROM orders)
SELECT o_orderkey, try_cast(trim(s) AS DOUBLE) AS ds, CASE WHEN regexp_full_match(trim(s), '[+-]?[0-9]+') THEN try_cast(trim(s) AS BIGINT) END AS "is",
length(s) <= 16 AND try_cast(trim(s) AS DOUBLE) IS NOT NULL AS ds_valid, length(s) <= 12 AND regexp_full_match(trim(s), '[+-]?[0-9]+') AS is_valid FROM t""")
def number_strings(spark: SparkSession, d: str) -> DataFrame:
    """Decimal and integer strings: values and validity."""
    k = F.col("o_orderkey").cast("string")
    m = F.col("o_orderkey") % 5
    s = F.when(m == 0, F.concat(F.lit(" "), k, F.lit(" "))).when(m == 1, F.concat(F.lit("-"), F.col("o_custkey").cast("string"), F.lit(".5"))).when(m == 2, F.concat(k, F.lit("e2"))).when(m == 3, F.concat(F.lit("x"), k)).otherwise(F.concat(k, F.lit("0000000000.25")))
    return table(spark, d, "orders").select("o_orderkey", vl.parse_ds(s).alias("ds"), vl.parse_is(s).alias("is"), vl.is_valid_ds(s).alias("ds_valid"), vl.is_valid_is(s).alias("is_valid"))


_DS = """WITH v AS (SELECT o_orderkey, o_totalprice / 3 * pow(10.0, CAST(o_orderkey % 40 - 20 AS DOUBLE)) AS v FROM orders),
s AS (SELECT o_orderkey, v, [format('{:.' || n || 'e}', v) FOR n IN range(0, 17)] AS e FROM v),
p AS (SELECT *, list_filter(e, lambda x: CAST(x AS DOUBLE) = v)[1] AS least, CAST(split_part(e[17], 'e', 2) AS INT) AS x FROM s),
t AS (SELECT *, rtrim(rtrim(split_part(least, 'e', 1), '0'), '.') AS m, greatest(length(rtrim(replace(split_part(least, 'e', 1), '.', ''), '0')), 1) AS nd FROM p),
u AS (SELECT *, CASE WHEN x BETWEEN -4 AND 5 THEN format('{:.' || greatest(nd - 1 - x, 1) || 'f}', v) ELSE m || 'e' || CASE WHEN x < 0 THEN '-' ELSE '+' END || lpad(CAST(abs(x) AS VARCHAR), CAST(greatest(2, length(CAST(abs(x) AS VARCHAR))) AS INT), '0') END AS short FROM t)
SELECT o_orderkey, CASE WHEN length(short) <= 16 THEN short ELSE list_filter([CASE WHEN x BETWEEN -4 AND 13 THEN
  CASE WHEN n - 1 - x > 0 THEN regexp_replace(rtrim(format('{:.' || greatest(n - 1 - x, 1) || 'f}', v), '0'), '[.]$', '.0') ELSE format('{:.1f}', v) END
  ELSE rtrim(rtrim(split_part(e[n], 'e', 1), '0'), '.') || 'e' || CASE WHEN x < 0 THEN '-' ELSE '+' END || lpad(CAST(abs(x) AS VARCHAR), CAST(greatest(2, length(CAST(abs(x) AS VARCHAR))) AS INT), '0') END
  FOR n IN range(16, 0, -1)], lambda y: length(y) <= 16)[1] END AS ds FROM u"""


@query(_DS)
def ds_format(spark: SparkSession, d: str) -> DataFrame:
    """Numbers as decimal strings of at most 16 characters."""
    v = F.col("o_totalprice") / 3 * F.pow(F.lit(10.0), (F.col("o_orderkey") % 40 - 20).cast("double"))
    return table(spark, d, "orders").select("o_orderkey", vl.format_ds(v).alias("ds"))


@query("""SELECT name_id, coalesce(split_part(split_part(whole, '=', 1), '^', 1), '') AS family, split_part(split_part(whole, '=', 1), '^', 2) AS given, split_part(whole, '=', 2) AS ideographic,
split_part(split_part(whole, '=', 1), '^', 1) || ', ' || split_part(split_part(whole, '=', 1), '^', 2) AS formatted FROM (SELECT name_id, regexp_replace(coalesce(alphabetic, '') || '=' || coalesce(ideographic, ''), '[ \\x00]+$', '') AS whole FROM person_names)""")
def pn_parts(spark: SparkSession, d: str) -> DataFrame:
    """Groups and parts of person names."""
    whole = F.concat(F.coalesce("alphabetic", F.lit("")), F.lit("="), F.coalesce("ideographic", F.lit("")))
    n = table(spark, d, "person_names").select("name_id", vl.parse_pn(whole).alias("pn"))
    a = F.col("pn.alphabetic")
    return n.select("name_id", vl.name_part(a, 0).alias("family"), vl.name_part(a, 1).alias("given"), "pn.ideographic", vl.family_comma_given(a).alias("formatted"))


@query("""SELECT patient_key, regexp_replace(coalesce(family_name, '') || '^' || coalesce(given_name, '') || '^^Dr.^', '\\^+$', '') AS pn FROM patients""")
def pn_build(spark: SparkSession, d: str) -> DataFrame:
    """Person names put together from parts."""
    return table(spark, d, "patients").select("patient_key", vl.name_from_parts(F.col("family_name"), F.col("given_name"), F.lit(None), F.lit("Dr."), F.lit("")).alias("pn"))


@query("""SELECT file_id, u, length(u) <= 64 AND regexp_full_match(u, '(0|[1-9][0-9]*)(\\.(0|[1-9][0-9]*))*') AS valid, NOT starts_with(u, '1.2.840.10008.') AS private
FROM (SELECT file_id, CASE file_id % 4 WHEN 0 THEN sop_instance_uid WHEN 1 THEN transfer_syntax WHEN 2 THEN sop_instance_uid || '.01' ELSE repeat(series_uid || '.', 5) || '1' END AS u FROM files) WHERE u IS NOT NULL""")
def uid_checks(spark: SparkSession, d: str) -> DataFrame:
    """Well-formed and private UIDs."""
    m = F.col("file_id") % 4
    u = F.when(m == 0, F.col("sop_instance_uid")).when(m == 1, F.col("transfer_syntax")).when(m == 2, F.concat("sop_instance_uid", F.lit(".01"))).otherwise(F.concat(F.repeat(F.concat("series_uid", F.lit(".")), F.lit(5)), F.lit("1")))
    return table(spark, d, "files").select("file_id", u.alias("u")).where("u IS NOT NULL").select("file_id", "u", tg.is_valid_uid(F.col("u")).alias("valid"), tg.is_private_uid(F.col("u")).alias("private"))


@query("""SELECT transfer_syntax, count(*) AS n, bool_or(transfer_syntax = '1.2.840.10008.1.2') AS implicit_vr, bool_and(coalesce(transfer_syntax <> '1.2.840.10008.1.2.2', true)) AS little_endian FROM files WHERE transfer_syntax LIKE '1.2.840.10008.1.2%' GROUP BY 1""")
def uid_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """Properties of transfer syntaxes by dictionary."""
    f, u = table(spark, d, "files").where("transfer_syntax LIKE '1.2.840.10008.1.2%'"), dict_uids(spark)
    return f.join(u, f.transfer_syntax == u.uid, "left").groupBy("transfer_syntax").agg(F.count("*").alias("n"), F.bool_or("implicit_vr").alias("implicit_vr"), F.bool_and("little_endian").alias("little_endian"))


_SETS = ", ".join(f"'{x}'" for x in vl.KNOWN_SETS)


@query(f"""WITH m AS (SELECT file_id, charsets AS cs, [upper(trim(coalesce(x, ''))) FOR x IN charsets] AS u FROM files),
n AS (SELECT file_id, cs, [regexp_replace(regexp_replace(x, '^ISO[ _-]?2022[ _-]?IR[ _-]?([0-9]+)$', 'ISO 2022 IR \\1'), '^ISO[ _-]?IR[ _-]?([0-9]+)$', 'ISO_IR \\1') FOR x IN u] AS v FROM m),
k AS (SELECT file_id, cs, [CASE WHEN x IN ({_SETS}) THEN x ELSE 'ISO_IR 6' END FOR x IN v] AS w FROM n)
SELECT file_id, CASE WHEN coalesce(len(cs), 0) < 1 THEN 'ISO_IR 6' WHEN w[1] IN ('ISO_IR 192', 'GBK', 'GB18030') THEN w[1]
ELSE array_to_string(list_concat([w[1]], list_filter(w[2:], lambda x: x NOT IN ('ISO_IR 192', 'GBK', 'GB18030'))), '\\') END AS sets FROM k""".replace("\\\\", "\\"))
def charset_lists(spark: SparkSession, d: str) -> DataFrame:
    """Character-set lists as read, and put right."""
    return table(spark, d, "files").select("file_id", F.concat_ws("\\", vl.normalise_charsets(F.col("charsets"))).alias("sets"))


@query("SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def charset_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts encoded and decoded under GB18030."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [cs.decode(cs.encode(t, ["GB18030"]), ["GB18030"]) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text").mapInArrow(run, "doc_id bigint, text string")


def _scoped(spark: SparkSession, d: str) -> DataFrame:
    """Lines as elements; every third one nested below the tag of its part."""
    t = _tagged(spark, d)
    top = F.shiftleft(F.col("l_suppkey") % 8, 16) + F.col("l_linenumber")
    path = F.when(F.col("l_linenumber") % 3 == 0, F.array(F.struct(top.cast("bigint").alias("tag"), F.lit(0).alias("item")))).otherwise(F.array().cast("array<struct<tag:bigint,item:int>>"))
    return t.withColumn("tag", F.shiftleft(F.col("l_partkey") % 8, 16) + F.col("l_linenumber")).withColumn("path", path).select("l_orderkey", "l_linenumber", "tag", "path")


_SCOPED = "SELECT l_orderkey, l_linenumber, (l_partkey % 8) * 65536 + l_linenumber AS tag, (l_suppkey % 8) * 65536 + l_linenumber AS top, l_linenumber % 3 = 0 AS nested FROM lineitem"


@query(f"SELECT l_orderkey, l_linenumber, tag FROM ({_SCOPED}) WHERE (tag IN (65537, 196611, 262147) OR tag = 524293 OR tag // 65536 = 2) AND (NOT nested OR top IN (65537, 196611, 262147))")
def specific_tags(spark: SparkSession, d: str) -> DataFrame:
    """Listed tags, group 2 and the character set, nested ones below listed sequences only."""
    return el.select_tags(_scoped(spark, d), [65537, 196611, 262147]).select("l_orderkey", "l_linenumber", "tag")


@query(f"SELECT l_orderkey, l_linenumber, tag FROM ({_SCOPED}) WHERE (CASE WHEN nested THEN top ELSE tag END) // 65536 = 4")
def group_dataset(spark: SparkSession, d: str) -> DataFrame:
    """One group with what is nested in it."""
    return el.group_dataset(_scoped(spark, d), 4).select("l_orderkey", "l_linenumber", "tag")


@query(f"SELECT l_orderkey, l_linenumber, tag FROM ({_SCOPED}) WHERE (tag // 65536) % 2 = 0 AND NOT (nested AND (top // 65536) % 2 = 1)")
def remove_private(spark: SparkSession, d: str) -> DataFrame:
    """Without private elements and what private sequences hold."""
    return el.remove_private(_scoped(spark, d)).select("l_orderkey", "l_linenumber", "tag")


@query(f"SELECT l_orderkey, l_linenumber, tag FROM (SELECT l_orderkey, l_linenumber, {_T} AS tag FROM lineitem) WHERE tag < 2145386512")
def stop_before_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Elements before pixel data."""
    return el.before_pixels(_tagged(spark, d)).select("l_orderkey", "l_linenumber", "tag")


@query("""WITH e AS (SELECT l_orderkey, l_linenumber, CASE l_partkey % 6 WHEN 0 THEN 1048592 WHEN 1 THEN 1048608 WHEN 2 THEN 1610625024 + (l_suppkey % 8) * 131072 + 0 WHEN 3 THEN 589840 WHEN 4 THEN 589824 ELSE 1118481 END AS tag FROM lineitem)
SELECT l_orderkey, l_linenumber, tag, CASE WHEN tag = 1048592 THEN 'PN' WHEN tag = 1048608 THEN 'LO' WHEN tag >= 1610625024 THEN 'OB or OW' WHEN tag = 589840 THEN 'LO' WHEN tag = 589824 THEN 'UL' ELSE 'UN' END AS dictionary_vr,
CASE WHEN tag = 1048592 THEN 'PatientName' WHEN tag = 1048608 THEN 'PatientID' WHEN tag >= 1610625024 THEN 'OverlayData' WHEN tag = 589840 THEN 'PrivateCreator' ELSE '' END AS keyword FROM e""")
def dictionary_join(spark: SparkSession, d: str) -> DataFrame:
    """Representation and keyword by dictionary and repeating groups."""
    m = F.col("l_partkey") % 6
    tag = F.when(m == 0, 0x00100010).when(m == 1, 0x00100020).when(m == 2, F.lit(0x60003000) + (F.col("l_suppkey") % 8) * 0x20000).when(m == 3, 0x00090010).when(m == 4, 0x00090000).otherwise(0x00111111)
    e = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", tag.cast("bigint").alias("tag"))
    return el.with_dictionary(e, dict_tags(spark), dict_repeaters(spark)).select("l_orderkey", "l_linenumber", "tag", "dictionary_vr", "keyword")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 2 = 0 THEN 'ACUSON' ELSE 'OTHER' END AS block_creator, CASE WHEN l_suppkey % 2 = 0 AND l_linenumber % 2 = 0 THEN 'IS' ELSE 'UN' END AS private_vr FROM lineitem""")
def private_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """Private elements by the creator of their block."""
    li = table(spark, d, "lineitem").withColumn("scope", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    texts = lambda c: F.array(c)
    e = F.array(
        F.struct(F.lit(0x00090010).cast("bigint").alias("tag"), texts(F.when(F.col("l_suppkey") % 2 == 0, "ACUSON").otherwise("OTHER")).alias("strings")),
        F.struct((F.lit(0x00091000) + F.col("l_linenumber") % 2).cast("bigint").alias("tag"), texts(F.lit("1")).alias("strings")),
    )
    rows = li.select("scope", "l_orderkey", "l_linenumber", F.explode(e).alias("e")).select("scope", "l_orderkey", "l_linenumber", "e.*")
    return el.private_vr(el.private_block(rows, key="scope"), dict_private(spark)).select("l_orderkey", "l_linenumber", "block_creator", "private_vr")


@query("""WITH i AS (SELECT l_orderkey, l_quantity, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) - 1 AS item FROM lineitem)
SELECT l_orderkey, CAST(item AS INT) AS item, CASE WHEN (CASE WHEN item % 2 = 0 THEN l_partkey % 2 ELSE l_orderkey % 2 END) = 1 THEN 'SS' ELSE 'US' END AS resolved_vr FROM i""")
def nearest_representation(spark: SparkSession, d: str) -> DataFrame:
    """US or SS by the nearest dataset around that says how pixels are represented."""
    li = table(spark, d, "lineitem").withColumn("item", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")) - 1)
    none = F.array().cast("array<struct<tag:bigint,item:int>>")
    inner = F.array(F.struct(F.lit(0x00283000).cast("bigint").alias("tag"), F.col("item").cast("int").alias("item")))
    make = lambda path, tag, vr, v: F.struct(path.alias("path"), F.lit(tag).cast("bigint").alias("tag"), F.lit(vr).alias("vr"), F.array(v.cast("string")).alias("strings"))
    own = F.when(F.col("item") % 2 == 0, make(inner, 0x00280103, "US", F.col("l_partkey") % 2))
    e = li.select("l_orderkey", F.explode(F.array(make(inner, 0x00283002, "US or SS", F.lit(0)), own)).alias("e")).where("e IS NOT NULL").select("l_orderkey", "e.*")
    roots = li.select("l_orderkey").distinct().select("l_orderkey", make(none, 0x00280103, "US", F.col("l_orderkey") % 2).alias("e")).select("l_orderkey", "e.*")
    r = el.resolve_ambiguous(e.unionByName(roots).withColumn("undefined_length", F.lit(False)), key="l_orderkey")
    return r.where(F.col("tag") == 0x00283002).select("l_orderkey", F.get("path", F.lit(0))["item"].alias("item"), "resolved_vr")


@query("""SELECT event_id, last_value(CASE WHEN event_id % 7 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS active_charset FROM events""")
def charset_carry(spark: SparkSession, d: str) -> DataFrame:
    """The character set in force at each element of a dataset."""
    e = table(spark, d, "events").withColumn("cs", F.when(F.col("event_id") % 7 == 0, F.col("event_type"))).withColumn("o", F.struct("ts", "event_id"))
    return el.carry_charset(e, key="user_id", order="o", charset="cs").select("event_id", "active_charset")


@query("""SELECT l_orderkey, l_linenumber, CAST(coalesce(sum(CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END) OVER w, 0) AS INT) AS frame_idx,
CAST(coalesce(sum(CAST(l_quantity AS BIGINT) + CAST(l_quantity AS BIGINT) % 2 + 8) OVER w, 0) AS BIGINT) AS start FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2))
WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def fragment_layout(spark: SparkSession, d: str) -> DataFrame:
    """Frames by end-of-image marks and offsets of fragments."""
    f = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("bigint").alias("q")).withColumn("eoi", F.col("q") > 40)
    g = el.fragment_frames(el.fragment_offsets(f, key="l_orderkey", order="l_linenumber", length="q"), key="l_orderkey", order="l_linenumber", marks_end="eoi")
    return g.select("l_orderkey", "l_linenumber", "frame_idx", F.col("offset").alias("start"))


@query("""SELECT l_orderkey, CAST(count(*) AS INT) AS frames, upper(string_agg(hex(encode(v)), ',' ORDER BY n)) AS bytes FROM (SELECT l_orderkey, l_partkey AS n, printf('%08d', l_partkey) AS v FROM lineitem) GROUP BY l_orderkey""")
def encapsulated_frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames encapsulated with an offset table, in two fragments each, and taken apart again."""
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_partkey")).alias("ks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, texts = [], []
            for ks in b.column(1).to_pylist():
                got = fr.frames_of(fr.encapsulate([b"%08d" % k for k in ks], 2), len(ks))
                n.append(len(got))
                texts.append(",".join(x.hex().upper() for x in got))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array(texts)], names=["l_orderkey", "frames", "bytes"])

    return g.mapInArrow(run, "l_orderkey bigint, frames int, bytes string")


@query("SELECT doc_id, hex(encode(text)) AS bytes FROM documents WHERE length(text) > 0")
def rle_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts as 8-bit frames through the run-length codec."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                x = t.encode()
                out.append(fr.decode_frame("1.2.840.10008.1.2.5", fr.rle_encode(x, 1, len(x), 1, 8), 1, len(x), 1, 8).hex().upper())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "bytes"])

    return table(spark, d, "documents").where("length(text) > 0").select("doc_id", "text").mapInArrow(run, "doc_id bigint, bytes string")


def _window_sql(kind: str) -> str:
    c, w = ("254.0 - 0.5", "128.0 - 1") if kind == "LINEAR" else ("254.0", "128.0")
    inner = "255.0 / (1 + exp(-4 * (v - 254.0) / 128.0))" if kind == "SIGMOID" else f"CASE WHEN v <= ({c}) - ({w}) / 2 THEN 0 WHEN v > ({c}) + ({w}) / 2 THEN 255.0 ELSE ((v - ({c})) / ({w}) + 0.5) * 255.0 END"
    return f"SELECT l_orderkey, l_linenumber, v AS rescaled, round({inner}, 6) AS shown FROM (SELECT l_orderkey, l_linenumber, l_quantity * 12.0 - 100.0 AS v FROM lineitem)"


def _windowed(kind: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        v = px.rescale(F.col("l_quantity"), F.lit(12.0), F.lit(-100.0))
        low, high = px.output_range(F.lit(8), F.lit(False))
        return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", v.alias("rescaled"), F.round(px.window_level(v, F.lit(254.0), F.lit(128.0), low, high, kind), 6).alias("shown"))

    run.__doc__ = f"Rescaled samples windowed by {kind}."
    return run


for _kind in ("LINEAR", "LINEAR_EXACT", "SIGMOID"):
    QUERIES[f"window_{_kind.lower()}"], ORACLES[f"window_{_kind.lower()}"] = _windowed(_kind), _window_sql(_kind)


@query("SELECT l_orderkey, l_linenumber, CAST([100, 200, 300, 450][least(greatest(CAST(l_quantity AS INT) - 10, 0), 3) + 1] AS INT) AS v FROM lineitem")
def lut_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Samples through a lookup table, held to its ends."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", px.lut_value(F.col("l_quantity"), F.array(*map(F.lit, (100, 200, 300, 450))), F.lit(10)).alias("v"))


@query("""SELECT l_orderkey, l_linenumber, l_quantity, max(l_quantity) OVER w - l_quantity AS inverted,
CAST(floor(least(greatest(CASE WHEN max(e) OVER w = min(e) OVER w THEN 0 WHEN min(e) OVER w >= 0 AND max(e) OVER w <= 255 THEN e ELSE (e - min(e) OVER w) / (max(e) OVER w - min(e) OVER w) * 255 END, 0), 255) + 0.5) AS INT) AS packed
FROM (SELECT *, l_quantity * 8 - 40 AS e FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey)""")
def display_frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames inverted and packed for display."""
    w = Window.partitionBy("l_orderkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", px.invert(F.col("l_quantity"), w).alias("inverted"), px.pack_u8(F.col("l_quantity") * 8 - 40, w).alias("packed"))


@query("""SELECT l_orderkey, l_linenumber, CAST(least(greatest(floor(a + 1.402 * (c - 128) + 0.5), 0), 255) AS INT) AS r,
CAST(least(greatest(floor(a - 0.114 * 1.772 / 0.587 * (b - 128) - 0.299 * 1.402 / 0.587 * (c - 128) + 0.5), 0), 255) AS INT) AS g, CAST(least(greatest(floor(a + 1.772 * (b - 128) + 0.5), 0), 255) AS INT) AS bl,
CAST(least(greatest(floor(0.299 * a + 0.587 * b + 0.114 * c + 0.5), 0), 255) AS INT) AS y
FROM (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 256 AS DOUBLE) AS a, CAST(l_suppkey * 7 % 256 AS DOUBLE) AS b, CAST(l_orderkey % 256 AS DOUBLE) AS c FROM lineitem)""")
def colour_spaces(spark: SparkSession, d: str) -> DataFrame:
    """YBR to RGB and luminance of RGB."""
    a, b, c = ((F.col(x) * k % 256).cast("double") for x, k in (("l_partkey", 1), ("l_suppkey", 7), ("l_orderkey", 1)))
    r, g, bl = px.ybr_to_rgb(a, b, c)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r.alias("r"), g.alias("g"), bl.alias("bl"), px.rgb_to_ybr(a, b, c)[0].alias("y"))


@query("""SELECT c_custkey, '{"00080060":{"vr":"CS"},"00100010":{"vr":"PN","Value":[{"Alphabetic":' || CAST(to_json(c_name) AS VARCHAR) || '}]},"00100020":{"vr":"LO","Value":["' || c_custkey || '"]},"00280010":{"vr":"US","Value":[' || c_nationkey || ']}}' AS json FROM customer""")
def json_export(spark: SparkSession, d: str) -> DataFrame:
    """Datasets in the DICOM JSON model."""
    c = table(spark, d, "customer")
    e = as_elements(c, "c_custkey", {ROWS: ("US", F.col("c_nationkey")), NAME: ("PN", F.col("c_name")), ID: ("LO", F.col("c_custkey")), 0x00080060: ("CS", F.lit(None))})
    e = e.withColumn("strings", F.filter("strings", lambda x: x.isNotNull())).withColumn("raw", F.lit(None).cast("binary"))
    return el.to_json(e, key="c_custkey")


_JSON_VALUES = r"""WITH e AS (SELECT rec_id, upper(lpad(k.key, 8, '0')) AS tag8, k.value AS e FROM dicom_json, json_each(CAST(record_json AS JSON)) k WHERE regexp_full_match(k.key, '[0-9A-Fa-f]{1,8}') AND json_type(k.value) = 'OBJECT'),
v AS (SELECT *, CASE json_type(e, '$.Value') WHEN 'ARRAY' THEN json_extract(e, '$.Value') WHEN 'NULL' THEN NULL ELSE CASE WHEN json_extract(e, '$.Value') IS NOT NULL THEN json_array(json_extract(e, '$.Value')) END END AS vs FROM e),
w AS (SELECT *, [json_extract(vs, '$[' || i || ']') FOR i IN range(0, CAST(coalesce(json_array_length(vs), 0) AS BIGINT))] AS entries FROM v),
x AS (SELECT *, e ->> '$.vr' AS vr0, len(list_filter(entries, lambda y: json_type(y) = 'OBJECT' AND len(list_filter(json_keys(y), lambda k: regexp_full_match(k, '[0-9A-Fa-f]{1,8}'))) > 0)) > 0 AS nested FROM w)
SELECT rec_id, CAST('0x' || tag8 AS BIGINT) AS tag, CASE WHEN vs IS NOT NULL AND (nested OR vr0 = 'SQ') THEN 'SQ' ELSE vr0 END AS vr,
CASE WHEN vs IS NULL OR nested OR vr0 = 'SQ' OR len(entries) = 0 THEN NULL ELSE array_to_string([coalesce(CASE
  WHEN json_type(y) = 'OBJECT' AND (json_exists(y, '$.Alphabetic') OR json_exists(y, '$.Ideographic') OR json_exists(y, '$.Phonetic'))
    THEN rtrim(coalesce(y ->> '$.Alphabetic', '') || '=' || coalesce(y ->> '$.Ideographic', '') || '=' || coalesce(y ->> '$.Phonetic', ''), '=')
  WHEN vr0 = 'AT' AND regexp_full_match(y ->> '$', '[0-9A-Fa-f]{1,8}') THEN upper(lpad(y ->> '$', 8, '0'))
  ELSE y ->> '$' END, '') FOR y IN entries], chr(92)) END AS value, CASE WHEN json_type(e, '$.BulkDataURI') = 'VARCHAR' AND vs IS NULL AND json_extract(e, '$.InlineBinary') IS NULL THEN e ->> '$.BulkDataURI' END AS bulk FROM x"""


@query(_JSON_VALUES)
def json_import(spark: SparkSession, d: str) -> DataFrame:
    """Top-level elements of DICOM JSON with their values."""
    e = el.from_json(table(spark, d, "dicom_json"), key="rec_id", json="record_json").where("size(path) = 0 AND tag IS NOT NULL")
    value = F.array_join(F.transform("strings", lambda x: F.coalesce(x, F.lit(""))), "\\")
    held = F.when(F.size("strings") > 0, value)
    return e.select("rec_id", "tag", "vr", held.alias("value"), F.col("bulk_uri").alias("bulk"))


@query("""SELECT o_custkey AS k, CAST(count(*) FILTER (o_orderkey % 4 <> 0) AS BIGINT) > 0 AND bool_and(o_orderkey % 3 <> 0 OR o_orderkey % 4 = 0) AND bool_and(o_orderkey % 4 <> 0) AS equal FROM orders GROUP BY o_custkey""")
def equal_datasets(spark: SparkSession, d: str) -> DataFrame:
    """Whether two sets of elements are the same for each key."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("tag"), "o_orderstatus")
    b = o.where("tag % 4 <> 0").withColumn("o_orderstatus", F.when(F.col("tag") % 3 == 0, F.lit("changed")).otherwise(F.col("o_orderstatus")))
    return el.equal_datasets(o, b, key="k", on=["tag"], values=["o_orderstatus"])


@query("""SELECT o_orderkey AS tag, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT -o_orderkey, 'added' FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey <> 0""")
def update_and_delete(spark: SparkSession, d: str) -> DataFrame:
    """Elements put in, replaced and deleted."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("tag"), F.col("o_orderstatus").alias("v"))
    new = o.where("tag % 3 = 0").withColumn("v", F.lit("new")).union(o.where("tag % 7 = 0").select(-F.col("tag"), F.lit("added")))
    return el.delete(el.update(o, new, on=["tag"]), o.where("tag % 5 = 0"), on=["tag"])
