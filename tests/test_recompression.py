"""Files recompressed in one narrow pass."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import rows
from voxelake.operators import imaging as im
from voxelake.plans import imaging as plans
from voxelake.sources.dicom import encode_files, parse_elements

SMALL, BIG = "/root/testdata/sf0.001", "1.2.840.10008.1.2.2"


@pytest.mark.parametrize("query", ["single_frame", "display_compressed", "all_frames"])
def test_files_are_made_once(spark, query):
    """Each query encodes its files from the table once, and shuffles no elements of files."""
    plan = plans.QUERIES[query](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") <= 4 and plan.count("Scan parquet") <= 2 and plan.count("Exchange") <= 2


@pytest.mark.parametrize("options", [{"per_frame": 2}, {"extended": True}, {"per_frame": 3, "table": False}])
def test_like_the_long_way(spark, options):
    """The same bytes as elements compressed, replaced and encoded again by joins."""
    files = plans.image_files(spark, SMALL).where("l_orderkey < 200").localCheckpoint()
    e = im.replace_pixels(parse_elements(files, key="l_orderkey").where("NOT is_meta"), im.compress_images(files, key="l_orderkey", transfer_syntax=plans.RLE, **options), key="l_orderkey")
    long = plans.image_files(spark, SMALL, e, plans.RLE).where("l_orderkey < 200")
    short = im.recompress_files(files, key="l_orderkey", transfer_syntax=plans.RLE, **options)
    assert rows(short) == rows(long) and files.count() > 100


def test_order_of_bytes_and_failures(spark):
    """Big-endian files keep their numbers; what is no image gives the reason; whole images and fragments."""
    e = plans.image_elements(spark, SMALL).where("l_orderkey < 50")
    pixels = F.expr("transform(sequence(1, length(raw), 2), i -> concat(substring(raw, i + 1, 1), substring(raw, i, 1)))")
    words = (F.col("vr").isin("OW", "US")) & F.col("raw").isNotNull()
    turned = e.withColumn("raw", F.when(words, F.aggregate(pixels, F.lit(b""), lambda a, x: F.concat(a, x))).otherwise(F.col("raw")))
    ids = e.select("l_orderkey").distinct().select("l_orderkey", F.lit("1.2.3").alias("sop_class"), F.lit("2.25.1").alias("sop_instance"))
    little, big = encode_files(ids, e, key="l_orderkey").localCheckpoint(), encode_files(ids, turned, key="l_orderkey", transfer_syntax=BIG, big_endian_source=True).localCheckpoint()
    one, other = (im.recompress_files(f, key="l_orderkey", transfer_syntax=plans.RLE, per_frame=2) for f in (little, big))
    assert rows(one) == rows(other) and one.where("content IS NULL").count() == 0
    back = im.recompress_files(one, key="l_orderkey", transfer_syntax=BIG)
    assert rows(back) == rows(big.select("l_orderkey", "content", "write_error"))
    whole = im.whole_images(one, key="l_orderkey", raw=True)
    long = im.joined_frames(im.decoded_frames(one, key="l_orderkey", raw=True), key="l_orderkey")
    assert rows(whole.select("l_orderkey", "data")) == rows(long) and {r.fragments for r in whole.collect()} == {4}
    odd = spark.createDataFrame([(1, bytearray(b"no file")), (2, None), (3, bytearray(little.first().content[:-3]))], "k bigint, content binary")
    lost = im.recompress_files(odd, key="k", transfer_syntax=plans.RLE).collect()
    assert [r.content for r in lost] == [None] * 3 and all(r.write_error for r in lost)
    assert all(r.data is None and r.frame_error for r in im.whole_images(odd, key="k").collect())
