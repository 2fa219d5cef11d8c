"""Files of a growing folder as a stream of elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelake.sources.dicom import parse_elements


def stream_elements(spark: SparkSession, path: str, *, files_per_trigger: int = 1000, **options) -> DataFrame:
    """The elements of every file as it arrives below `path`, each file once; stateless. A file
    that is none gives one row with the reason, unless `refused` is false."""
    files = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", files_per_trigger).schema("path string, modificationTime timestamp, length bigint, content binary").load(path)
    return parse_elements(files.select(F.col("path").alias("file"), "content"), key="file", **{"refused": True, **options})
