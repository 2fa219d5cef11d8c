"""Queries of frames, samples, identifiers, walks and nested JSON."""

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelake.codec import frames as fr
from voxelake.operators import elements as el
from voxelake.operators import images as im
from voxelake.operators.shredding import shred
from voxelake.plans.elements import line_elements, query_table
from voxelake.session import cut_lineage, table

QUERIES, ORACLES, query = query_table()


@query("""WITH c AS (SELECT c_custkey, c_name || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || CASE WHEN length(c_name) % 2 = 1 THEN ' ' ELSE '' END AS s FROM customer)
SELECT c_custkey, CAST(i AS INT) AS frame_idx, hex(encode(substr(s, CAST(i * (length(s) // 2) + 1 AS BIGINT), length(s) // 2))) AS bytes FROM c, unnest([0, 1]) AS u(i)""")
def native_frames(spark: SparkSession, d: str) -> DataFrame:
    """Native pixel data of two frames, cut by byte slices."""
    s = F.concat("c_name", F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.when(F.length("c_name") % 2 == 1, " ").otherwise(""))
    c = table(spark, d, "customer").select("c_custkey", s.cast("binary").alias("px"))
    return im.native_frames(c, key="c_custkey", data="px", frame_bytes=F.expr("length(px) div 2"), n_frames=F.lit(2)).select("c_custkey", "frame_idx", F.hex("frame").alias("bytes"))


@query("""SELECT c_custkey, CAST((i - 1) // 3 AS INT) AS "row", CAST((i - 1) % 3 AS INT) AS col, CAST(ascii(substr(c_name, CAST(i AS BIGINT), 1)) AS DOUBLE) AS value FROM customer, unnest(range(1, length(c_name) + 1)) AS u(i)""")
def image_samples(spark: SparkSession, d: str) -> DataFrame:
    """Frames as one row a sample."""
    c = table(spark, d, "customer").select("c_custkey", im.sample_arrays(F.col("c_name").cast("binary"), 8, False).alias("s"))
    return im.explode_samples(c, keys=["c_custkey"], samples="s", columns=F.lit(3))


@query("""SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) - 1 AS INT) AS frame_idx, hex(encode(printf('%08d', l_partkey))) AS bytes FROM lineitem""")
def compressed_frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames compressed, encapsulated, taken apart and decoded again."""
    uid = "1.2.840.10008.1.2.5"

    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda b: fr.rle_encode(bytes(b), 2, 2, 1, 16))

    frame = F.pandas_udf(run, "binary")(F.format_string("%08d", "l_partkey").cast("binary"))
    order = F.struct("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    f = table(spark, d, "lineitem").select("l_orderkey", order.alias("o"), frame.alias("frame"))
    e = im.encode_frames(f, key="l_orderkey", order="o").withColumn("n", F.lit(None).cast("int"))
    got = im.encapsulated_frames(e, key="l_orderkey", data="pixel_data", n_frames="n")
    shaped = got.withColumns({"uid": F.lit(uid), "r": F.lit(2), "c": F.lit(2), "s": F.lit(1), "b": F.lit(16)})
    out = im.decode_frames(shaped, keys=["l_orderkey", "frame_idx"], rows="r", columns="c", samples="s", bits="b", syntax="uid")
    return out.select("l_orderkey", "frame_idx", F.hex("frame").alias("bytes"))


@query()
def uids_from_entropy(spark: SparkSession, d: str) -> DataFrame:
    """UIDs made from the text of a key."""
    return table(spark, d, "files").select("file_id", im.uid_from_entropy(F.concat_ws("|", "sop_instance_uid", F.col("file_id").cast("string"))).alias("uid"))


@query("""WITH i AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) - 1 AS item FROM lineitem)
SELECT l_orderkey, CAST(item AS INT) AS item, t.tag, CAST(item * 2 + CASE WHEN t.tag = 524544 THEN 1 ELSE 2 END AS INT) AS walk_idx FROM i, (VALUES (CAST(524544 AS BIGINT)), (CAST(4236042 AS BIGINT))) t(tag)""")
def walk_datasets(spark: SparkSession, d: str) -> DataFrame:
    """Elements in the order of a depth-first walk."""
    w = im.walk_order(line_elements(spark, d), key="l_orderkey")
    return w.select("l_orderkey", F.col("path")[0]["item"].alias("item"), "tag", "walk_idx")


_NESTED = """WITH i AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) - 1 AS item FROM lineitem)
SELECT l_orderkey, '300A0111/' || item || CASE WHEN t.tag = 524544 THEN '/0040A043/0' ELSE '' END AS path, t.tag, CASE WHEN t.tag = 524544 THEN 'SH' ELSE 'DS' END AS vr,
CASE WHEN t.tag = 524544 THEN CAST(l_partkey AS VARCHAR) ELSE CAST(CAST(l_quantity AS DOUBLE) AS VARCHAR) END AS value FROM i, (VALUES (CAST(524544 AS BIGINT)), (CAST(4236042 AS BIGINT))) t(tag)"""


@query(_NESTED)
def nested_json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Nested datasets written as JSON, shredded and read back as elements."""
    nodes = cut_lineage(shred(el.to_json(line_elements(spark, d), key="l_orderkey"), key="l_orderkey", text="json"))
    e = im.elements_of_nodes(nodes, key="l_orderkey").where("vr <> 'SQ'")
    path = F.array_join(F.transform("path", lambda p: F.concat(F.format_string("%08X", p["tag"]), F.lit("/"), p["item"].cast("string"))), "/")
    return e.select("l_orderkey", path.alias("path"), "tag", "vr", F.get("strings", F.lit(0)).alias("value"))


@query("""SELECT c_custkey, '(0010,0010) ' || rpad('PatientName', 36, ' ') || ' PN: ' || c_name AS line FROM customer""")
def dump_lines(spark: SparkSession, d: str) -> DataFrame:
    """Elements as lines of a dump."""
    c = table(spark, d, "customer")
    return c.select("c_custkey", im.display_line(F.lit(0x00100010).cast("bigint"), F.lit("PN"), F.lit("PatientName"), F.array("c_name"), F.lit(None).cast("binary"), F.lit(0)).alias("line"))
