"""Queries of the image pipeline: order lines become images of two frames, written as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelake.operators import imaging as im
from voxelake.plans.elements import EXPLICIT, query_table
from voxelake.session import table
from voxelake.sources.dicom import encode_files, encode_grouped

QUERIES, ORACLES, query = query_table()
RLE = "1.2.840.10008.1.2.5"
_NO_PATH = "array<struct<tag:bigint,item:int>>"


def _words(values: Column) -> Column:
    """Bytes of an array of unsigned 16-bit numbers, little endian."""
    return F.unhex(F.array_join(F.transform(values, lambda v: F.format_string("%02X%02X", v % 256, F.floor(v / 256))), ""))


def image_arrays(spark: SparkSession, d: str) -> DataFrame:
    """(l_orderkey, es): per order an image of one row, a column a line and two frames (quantity * 40, and 7 more), with a
    window and slope; every third inverted (MONOCHROME1), every fifth with a VOI table instead."""
    order = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_extendedprice", F.col("l_quantity").cast("bigint").alias("q"))))
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(order, lambda s: s["q"] * 40).alias("qs"))
    k, none = F.col("l_orderkey"), F.array().cast(_NO_PATH)
    both = F.concat(F.col("qs"), F.transform("qs", lambda v: v + 7))
    seq = F.array(F.struct(F.lit(0x00283010).cast("bigint").alias("tag"), F.lit(0).alias("item")))

    def entry(tag: int, vr: str, text: Column | None = None, raw: Column | None = None, path: Column = none, asked: Column | None = None) -> Column:
        e = F.struct(
            path.alias("path"), F.lit(tag).cast("bigint").alias("tag"), F.lit(vr).alias("vr"), (F.lit(None).cast("array<string>") if text is None else F.array(text.cast("string"))).alias("strings"),
            (F.lit(None).cast("binary") if raw is None else raw).alias("raw"),
        )
        return e if asked is None else F.when(asked, e)

    es = F.array(
        entry(0x00280002, "US", F.lit(1)), entry(0x00280004, "CS", F.when(k % 3 == 0, "MONOCHROME1").otherwise("MONOCHROME2")), entry(0x00280008, "IS", F.lit(2)), entry(0x00280010, "US", F.lit(1)),
        entry(0x00280011, "US", F.size("qs")), entry(0x00280100, "US", F.lit(16)), entry(0x00280101, "US", F.lit(16)), entry(0x00280102, "US", F.lit(15)), entry(0x00280103, "US", F.lit(0)),
        entry(0x00281050, "DS", F.lit(600)), entry(0x00281051, "DS", F.lit(800)), entry(0x00281052, "DS", F.lit(-100)), entry(0x00281053, "DS", F.lit(2)), entry(0x7FE00010, "OW", raw=_words(both)),
        entry(0x00283002, "US", raw=_words(F.array(F.lit(4), F.lit(500), F.lit(16))), path=seq, asked=k % 5 == 0), entry(0x00283006, "OW", raw=_words(F.array(*map(F.lit, (10, 20, 40, 90)))), path=seq, asked=k % 5 == 0),
    )
    return g.select("l_orderkey", F.filter(es, lambda e: e.isNotNull()).alias("es"))


def image_elements(spark: SparkSession, d: str) -> DataFrame:
    """The elements of `image_arrays`, one a row."""
    return image_arrays(spark, d).select("l_orderkey", F.explode("es").alias("e")).select("l_orderkey", "e.*")


def image_files(spark: SparkSession, d: str, elements: DataFrame | None = None, syntax: str = EXPLICIT) -> DataFrame:
    names = [F.lit("1.2.840.10008.5.1.4.1.1.2").alias("sop_class"), F.concat(F.lit("2.25."), F.col("l_orderkey").cast("string")).alias("sop_instance")]
    if elements is None:
        return encode_grouped(image_arrays(spark, d).select("l_orderkey", *names, "es"), key="l_orderkey", transfer_syntax=syntax)
    ids = table(spark, d, "lineitem").select("l_orderkey").distinct()
    return encode_files(ids.select("l_orderkey", *names), elements, key="l_orderkey", transfer_syntax=syntax)


def _bytes(frames: DataFrame) -> DataFrame:
    """(l_orderkey, frame_idx, pos, value) of 8-bit frames."""
    at = F.posexplode(F.transform(F.sequence(F.lit(1), F.length("frame")), lambda i: F.conv(F.hex(F.substring("frame", i, F.lit(1))), 16, 10).cast("int")))
    return frames.where("length(frame) > 0").select("l_orderkey", "frame_idx", at.alias("pos", "value"))


_SAMPLES = """q AS (SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice, l_quantity) - 1 AS INT) AS pos, CAST(l_quantity AS BIGINT) * 40 AS v FROM lineitem),
s AS (SELECT l_orderkey, CAST(f AS INT) AS frame_idx, pos, v + f * 7 AS v FROM q, unnest([0, 1]) u(f))"""

_DISPLAY = f"""WITH {_SAMPLES}, m AS (SELECT *, v * 2.0 - 100 AS hu FROM s), w AS (SELECT *, CASE WHEN l_orderkey % 5 = 0 THEN CAST([10, 20, 40, 90][CAST(least(greatest(hu - 500, 0), 3) AS INT) + 1] AS DOUBLE)
WHEN hu <= 599.5 - 799 / 2.0 THEN -100.0 WHEN hu > 599.5 + 799 / 2.0 THEN 130970.0 ELSE ((hu - 599.5) / 799.0 + 0.5) * 131070.0 - 100.0 END AS y FROM m),
i AS (SELECT *, CASE WHEN l_orderkey % 3 = 0 THEN max(y) OVER f - y ELSE y END AS z FROM w WINDOW f AS (PARTITION BY l_orderkey, frame_idx)),
r AS (SELECT *, min(z) OVER f AS lo, max(z) OVER f AS hi FROM i WINDOW f AS (PARTITION BY l_orderkey, frame_idx))
SELECT l_orderkey, frame_idx, pos, CAST(least(greatest(floor(CASE WHEN hi <= lo THEN 0 WHEN lo >= 0 AND hi <= 255 THEN z ELSE (z - lo) * (255.0 / (hi - lo)) END + 0.5), 0), 255) AS INT) AS value FROM r"""


@query(_DISPLAY)
def display_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Files to displayed 8-bit frames: rescale, VOI table or window, inversion, packing."""
    return _bytes(im.display_frames(image_files(spark, d), key="l_orderkey"))


@query(_DISPLAY)
def display_compressed(spark: SparkSession, d: str) -> DataFrame:
    """The same through pixel data compressed with an extended offset table, put back into the files."""
    files = image_files(spark, d)
    return _bytes(im.display_frames(im.recompress_files(files, key="l_orderkey", transfer_syntax=RLE, extended=True), key="l_orderkey"))


@query(f"""WITH {_SAMPLES} SELECT l_orderkey, CAST(1 AS INT) AS frame_idx, string_agg(printf('%02X%02X', v % 256, v // 256), '' ORDER BY pos) AS bytes FROM s WHERE frame_idx = 1 GROUP BY 1""")
def single_frame(spark: SparkSession, d: str) -> DataFrame:
    """The second frame alone, decoded from compressed files with a basic offset table."""
    files = image_files(spark, d)
    one = im.decoded_frames(im.recompress_files(files, key="l_orderkey", transfer_syntax=RLE, per_frame=2), key="l_orderkey", index=1, raw=True)
    return one.select("l_orderkey", "frame_idx", F.hex("frame").alias("bytes"))


@query(f"""WITH {_SAMPLES} SELECT l_orderkey, frame_idx, CAST(0 AS INT) AS "row", pos AS col, CAST(0 AS INT) AS sample, v * 2.0 - 100 AS value FROM s""")
def modality_samples(spark: SparkSession, d: str) -> DataFrame:
    """Every sample in the modality's units, with its place."""
    files = image_files(spark, d)
    return im.sample_rows(im.sample_frames(files, key="l_orderkey", modality=True), im.describe_images(files, key="l_orderkey"), key="l_orderkey")


@query("""SELECT l_orderkey, CAST(1 AS INT) AS "rows", CAST(count(*) AS INT) AS columns, CAST(2 AS INT) AS n_frames, CASE WHEN l_orderkey % 3 = 0 THEN 'MONOCHROME1' ELSE 'MONOCHROME2' END AS photometric, CAST(count(*) * 2 AS BIGINT) AS frame_bytes, CAST(0 AS BIGINT) AS missing
FROM lineitem GROUP BY l_orderkey""")
def image_descriptions(spark: SparkSession, d: str) -> DataFrame:
    """What the images of files are."""
    i = im.describe_images(image_files(spark, d), key="l_orderkey")
    return i.select("l_orderkey", "rows", "columns", "n_frames", "photometric", "frame_bytes", F.size("missing").cast("bigint").alias("missing"))


@query(f"""WITH {_SAMPLES} SELECT l_orderkey, CAST(4 AS INT) AS fragments, string_agg(printf('%02X%02X', v % 256, v // 256), '' ORDER BY frame_idx, pos) AS bytes FROM s GROUP BY 1""")
def all_frames(spark: SparkSession, d: str) -> DataFrame:
    """Fragments counted and all frames decoded into one byte string."""
    files = image_files(spark, d)
    # one chain of narrow passes: also packed without a table, which must succeed
    packed = im.compress_images(files, key="l_orderkey", transfer_syntax=RLE, per_frame=2, table=False, carry=("content",))
    sound = packed.where("write_error IS NULL AND undefined_length")
    whole = im.whole_images(im.recompress_files(sound, key="l_orderkey", transfer_syntax=RLE, per_frame=2), key="l_orderkey", raw=True)
    return whole.select("l_orderkey", "fragments", F.hex("data").alias("bytes"))
