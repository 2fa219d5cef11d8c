"""Queries of the general data problems: moments (1), nested records (3), failing lines (4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelake.operators.moments import normalise_moments, same_instant_pairs
from voxelake.operators.rejects import accepted, parse_lines, rejected
from voxelake.operators.shredding import entity_table, item_elements, shred
from voxelake.session import cut_lineage, table


def p1_instants(spark: SparkSession, d: str) -> DataFrame:
    """Every reading of moments as one instant in UTC, or as none with the reason."""
    n = normalise_moments(table(spark, d, "moments"), table(spark, d, "stations"), keep=["moment_id"])
    return n.select("moment_id", "utc_micros", "format", "basis")


def p1_utc(spark: SparkSession, d: str) -> DataFrame:
    """Every reading of moments as microseconds since 1970 in UTC, or null."""
    return p1_instants(spark, d).select("moment_id", "utc_micros")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of rows of one exposure that denote the same instant."""
    n = normalise_moments(table(spark, d, "moments"), table(spark, d, "stations"), keep=["moment_id", "exposure_uid"])
    return same_instant_pairs(n)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every element that stands in an item of a sequence, at any depth."""
    return item_elements(cut_lineage(shred(table(spark, d, "dicom_json")))).select("rec_id", "sequence_path", "item_no", "tag")


def p3_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The node table of all records."""
    return shred(table(spark, d, "dicom_json"))


def p3_concepts(spark: SparkSession, d: str) -> DataFrame:
    """Items of every concept name code sequence that have any of code, scheme and meaning."""
    nodes = cut_lineage(shred(table(spark, d, "dicom_json")))
    e = entity_table(nodes, "0040A043", {"00080100": "code_value", "00080102": "coding_scheme", "00080104": "code_meaning"})
    return e.select("rec_id", "sequence_path", "item_no", "code_value", "coding_scheme", "code_meaning").where("coalesce(code_value, coding_scheme, code_meaning) IS NOT NULL")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every failing line with each reason."""
    return rejected(parse_lines(table(spark, d, "diagnostic_lines")))


def p4_rows(spark: SparkSession, d: str) -> DataFrame:
    """The lines that load, typed."""
    return accepted(parse_lines(table(spark, d, "diagnostic_lines"))).select(
        "line_id", "kind", "tag", "vr", F.col("offset").alias("value_offset"), "path", "need", "have", "note"
    )


QUERIES = {
    "p1_instants": p1_instants,
    "p1_found": p1_found,
    "p1_utc": p1_utc,
    "p3_found": p3_found,
    "p3_nodes": p3_nodes,
    "p3_concepts": p3_concepts,
    "p4_found": p4_found,
    "p4_rows": p4_rows,
}

_LINES = r"""
WITH cut AS (
  SELECT line_id, regexp_replace(regexp_replace(raw_line, '\n$', ''), '\r$', '') AS s, raw_line IS NULL AS gone FROM diagnostic_lines
), formed AS (
  SELECT line_id, gone,
         coalesce(regexp_full_match(s, '[ \t]*("([^"]|"")*"[ \t]*|[^",]*)(,[ \t]*("([^"]|"")*"[ \t]*|[^",]*))*'), true) AS quoted_well,
         regexp_extract_all(',' || s, ',([ \t]*"(?:[^"]|"")*"[ \t]*|[^",]*)', 1) AS raw
  FROM cut
), fields AS (
  SELECT line_id, gone, quoted_well,
         [trim(CASE WHEN starts_with(trim(x, ' ' || chr(9)), '"')
                    THEN replace(regexp_replace(trim(x, ' ' || chr(9)), '^"|"$', '', 'g'), '""', '"') ELSE x END, ' ' || chr(9)) FOR x IN raw] AS f
  FROM formed
), checked AS (
  SELECT line_id, f, NOT quoted_well AS quoting, quoted_well AND (gone OR len(f) <> 8) AS columns, quoted_well AND NOT gone AND len(f) = 8 AS shaped,
         f[1] IN ('truncated_header', 'truncated_value', 'truncated_item', 'deferred_value_unreadable', 'invalid_value') AS kind_ok,
         regexp_full_match(f[2], '\([0-9A-Fa-f]{4},[0-9A-Fa-f]{4}\)') AS tag_ok, regexp_full_match(f[3], '([A-Z]{2})?') AS vr_ok,
         regexp_full_match(f[4], '[0-9]+') AND try_cast(f[4] AS BIGINT) IS NOT NULL AS offset_ok,
         regexp_full_match(f[6], '[0-9]+') AND try_cast(f[6] AS BIGINT) IS NOT NULL AS need_ok,
         regexp_full_match(f[7], '[0-9]+') AND try_cast(f[7] AS BIGINT) IS NOT NULL AS have_ok
  FROM fields
)
"""

_HELD = """
WITH RECURSIVE held AS (
  SELECT rec_id, CAST(NULL AS VARCHAR) AS sequence_path, CAST(NULL AS INTEGER) AS item_no, CAST(record_json AS JSON) AS obj FROM dicom_json
  UNION ALL
  SELECT h.rec_id,
         CASE WHEN h.sequence_path IS NULL THEN '' ELSE h.sequence_path || '/' || h.item_no || '/' END || upper(lpad(e.key, 8, '0')),
         CAST(i.n AS INTEGER), i.entry
  FROM held h, json_each(h.obj) e,
       LATERAL (SELECT CASE json_type(e.value, '$.Value') WHEN 'ARRAY' THEN json_extract(e.value, '$.Value')
                            WHEN 'OBJECT' THEN json_array(json_extract(e.value, '$.Value')) END AS entries) v,
       LATERAL (SELECT u.n, json_extract(v.entries, '$[' || u.n || ']') AS entry FROM unnest(range(0, CAST(json_array_length(v.entries) AS BIGINT))) AS u(n)) i
  WHERE regexp_full_match(e.key, '[0-9A-Fa-f]{1,8}') AND json_type(e.value) = 'OBJECT' AND v.entries IS NOT NULL
    AND json_type(i.entry) = 'OBJECT' AND len(list_filter(json_keys(i.entry), lambda k: regexp_full_match(k, '[0-9A-Fa-f]{1,8}'))) > 0
)
"""


def _values(tag: str) -> str:
    """SQL of an item's values of a tag, joined by backslashes; null where there is none."""
    return f"""(SELECT nullif(array_to_string(list_filter([CASE WHEN json_type(x) NOT IN ('OBJECT', 'NULL') THEN x ->> '$' END FOR x IN vs], lambda y: y IS NOT NULL), chr(92)), '')
  FROM (SELECT CASE json_type(e.value, '$.Value') WHEN 'ARRAY' THEN CAST(json_extract(e.value, '$.Value') AS JSON[]) WHEN 'NULL' THEN [] ELSE [json_extract(e.value, '$.Value')] END AS vs
        FROM json_each(held.obj) e WHERE upper(lpad(e.key, 8, '0')) = '{tag}' AND regexp_full_match(e.key, '[0-9A-Fa-f]{{1,8}}') AND json_type(e.value) = 'OBJECT' LIMIT 1))"""


_MOMENTS = r"""
WITH pad AS (SELECT ' ' || chr(9) || chr(10) || chr(13) || chr(0) AS ws), raw AS (
  SELECT moment_id, exposure_uid, station_id, nullif(trim(tz_offset, ws), '') AS off_column,
         trim(coalesce(nullif(trim(dt_original, ws), ''), nullif(trim(da_original, ws), '') || coalesce(' ' || nullif(trim(tm_original, ws), ''), '')), ws) AS t
  FROM moments, pad
), a AS (SELECT *, nullif(regexp_extract(t, '(Z|UTC|GMT|[+-][0-9]{2}:?[0-9]{2})$', 1), '') AS own FROM raw),
b AS (SELECT *, rtrim(CASE WHEN own IS NULL THEN t ELSE t[1:length(t) - length(own)] END) AS u FROM a),
c AS (SELECT *, lower(regexp_extract(u, '([AaPp])[Mm]$', 1)) AS half, rtrim(regexp_replace(u, '[AaPp][Mm]$', '')) AS v FROM b),
e AS (SELECT *, CASE WHEN regexp_matches(v, '^[0-9]{4}[-/.]?[0-9]{2}[-/.]?[0-9]{2}') THEN 1 WHEN regexp_matches(v, '^([A-Za-z]{3}, )?[0-9]{1,2}[- ][A-Za-z]{3}[- ][0-9]{4}') THEN 2
                WHEN regexp_matches(v, '^[A-Za-z]{3} [0-9]{1,2}, [0-9]{4}') THEN 3 END AS form FROM c),
f AS (SELECT *, CASE form WHEN 1 THEN regexp_extract(v, '^[0-9]{4}[-/.]?[0-9]{2}[-/.]?[0-9]{2}') WHEN 2 THEN regexp_extract(v, '^([A-Za-z]{3}, )?[0-9]{1,2}[- ][A-Za-z]{3}[- ][0-9]{4}') ELSE regexp_extract(v, '^[A-Za-z]{3} [0-9]{1,2}, [0-9]{4}') END AS d FROM e),
g AS (SELECT *, ltrim(v[length(d) + 1:], ' Tt') AS clock, CASE form WHEN 1 THEN regexp_replace(d, '[-/.]', '', 'g')
  WHEN 2 THEN regexp_extract(d, '([0-9]{4})$', 1) || printf('%02d', (instr('janfebmaraprmayjunjulaugsepoctnovdec', lower(regexp_extract(d, '[0-9][- ]([A-Za-z]{3})', 1))) + 2) // 3) || lpad(regexp_extract(d, '([0-9]{1,2})[- ]', 1), 2, '0')
  WHEN 3 THEN regexp_extract(d, '([0-9]{4})$', 1) || printf('%02d', (instr('janfebmaraprmayjunjulaugsepoctnovdec', lower(d[1:3])) + 2) // 3) || lpad(regexp_extract(d, ' ([0-9]{1,2}),', 1), 2, '0') END AS ymd FROM f),
h AS (SELECT *, try_cast(ymd[1:4] || '-' || ymd[5:6] || '-' || ymd[7:8] AS DATE) AS day, replace(regexp_extract(CASE WHEN regexp_matches(clock, '^[0-9]:') THEN '0' || clock ELSE clock END, '^[0-9:]+'), ':', '') AS hms,
        regexp_extract(clock, '[.,]([0-9]+)', 1) AS frac FROM g),
i AS (SELECT *, try_cast(hms[1:2] AS INT) AS h0, coalesce(try_cast(hms[3:4] AS INT), 0) AS mi, coalesce(try_cast(hms[5:6] AS INT), 0) AS se, CAST(rpad(frac[1:6], 6, '0') AS BIGINT) AS us FROM h),
j AS (SELECT *, CASE WHEN half = '' THEN h0 WHEN h0 BETWEEN 1 AND 12 THEN h0 % 12 + CASE half WHEN 'p' THEN 12 ELSE 0 END END AS ho FROM i),
k AS (SELECT *, CASE WHEN ho BETWEEN 0 AND 23 AND mi BETWEEN 0 AND 59 AND se BETWEEN 0 AND 60 THEN (CAST(day - DATE '1970-01-01' AS BIGINT) * 86400 + ho * 3600 + mi * 60 + least(se, 59)) * 1000000 + us END AS lo, replace(coalesce(own, off_column), ':', '') AS off FROM j),
l AS (SELECT k.*, tz_name, epoch_us(timezone(tz_name, make_timestamp(lo))) AS by_clock FROM k LEFT JOIN stations USING (station_id)),
m AS (SELECT *, CASE WHEN epoch_us(timezone(tz_name, make_timestamptz(by_clock - 3600000000))) = lo THEN by_clock - 3600000000 WHEN epoch_us(timezone(tz_name, make_timestamptz(by_clock - 1800000000))) = lo THEN by_clock - 1800000000
                 WHEN epoch_us(timezone(tz_name, make_timestamptz(by_clock))) = lo THEN by_clock END AS first_shown FROM l),
instants AS (SELECT moment_id, exposure_uid, CASE WHEN off IN ('Z', 'UTC', 'GMT') THEN lo WHEN off IS NOT NULL THEN lo - CASE WHEN off[1:1] = '-' THEN -1 ELSE 1 END * (CAST(off[2:3] AS BIGINT) * 60 + CAST(off[4:5] AS BIGINT)) * 60000000 ELSE first_shown END AS utc FROM m)
"""

ORACLES = {
    "p1_found": _MOMENTS
    + """
SELECT a.moment_id AS moment_id_a, b.moment_id AS moment_id_b FROM instants a JOIN instants b ON a.exposure_uid = b.exposure_uid AND a.utc = b.utc AND a.moment_id < b.moment_id""",
    "p1_utc": _MOMENTS + "SELECT moment_id, utc AS utc_micros FROM instants",
    "p3_found": _HELD
    + """
SELECT rec_id, sequence_path, item_no, upper(lpad(k.key, 8, '0')) AS tag
FROM held, json_each(obj) k
WHERE sequence_path IS NOT NULL AND regexp_full_match(k.key, '[0-9A-Fa-f]{1,8}')""",
    "p3_concepts": _HELD
    + f"""
SELECT * FROM (SELECT rec_id, sequence_path, item_no, {_values("00080100")} AS code_value, {_values("00080102")} AS coding_scheme, {_values("00080104")} AS code_meaning
FROM held WHERE sequence_path = '0040A043' OR ends_with(sequence_path, '/0040A043')) WHERE coalesce(code_value, coding_scheme, code_meaning) IS NOT NULL""",
    "p4_found": _LINES
    + """
SELECT line_id, unnest(list_filter([CASE WHEN quoting THEN 'quoting' END, CASE WHEN columns THEN 'columns' END,
       CASE WHEN shaped AND NOT kind_ok THEN 'kind' END, CASE WHEN shaped AND NOT tag_ok THEN 'tag' END, CASE WHEN shaped AND NOT vr_ok THEN 'vr' END,
       CASE WHEN shaped AND NOT offset_ok THEN 'offset' END, CASE WHEN shaped AND NOT need_ok THEN 'need' END,
       CASE WHEN shaped AND NOT have_ok THEN 'have' END], lambda x: x IS NOT NULL)) AS reason
FROM checked""",
    "p4_rows": _LINES
    + """
SELECT line_id, f[1] AS kind, CAST('0x' || f[2][2:5] || f[2][7:10] AS BIGINT) AS tag, nullif(f[3], '') AS vr, CAST(f[4] AS BIGINT) AS value_offset,
       nullif(f[5], '') AS path, CAST(f[6] AS BIGINT) AS need, CAST(f[7] AS BIGINT) AS have, nullif(f[8], '') AS note
FROM checked WHERE shaped AND kind_ok AND tag_ok AND vr_ok AND offset_ok AND need_ok AND have_ok""",
}
