"""Frames and samples of images, identifiers, and text forms of elements."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelake.codec import frames as fr
from voxelake.dictionary import NATIVE
from voxelake.functions.tags import tag_text

#: Fixed value: the root under which entropy-based UIDs are made by default.
UID_ROOT = "1.2.826.0.1.3680043.8.498."


def native_frames(images: DataFrame, *, key: str, data: str, frame_bytes: Column, n_frames: Column) -> DataFrame:
    """(key, frame_idx, frame): native pixel data cut into frames by byte slices, all in the JVM.

    Data must be frames times their size, with at most one byte of padding; other lengths give one
    row with a null frame_idx and frame, so nothing vanishes unseen.
    """
    size, n = frame_bytes.cast("int"), n_frames.cast("int")
    fits = (F.length(data) - size * n).between(0, 1) & (size > 0) & (n > 0)
    rows = images.select(key, F.col(data).alias("__data"), size.alias("__size"), F.when(fits, n).alias("__n"))
    cut = rows.select("*", F.explode(F.when(F.col("__n").isNotNull(), F.sequence(F.lit(0), F.col("__n") - 1)).otherwise(F.array(F.lit(None).cast("int")))).alias("frame_idx"))
    return cut.select(key, "frame_idx", F.expr("substring(__data, frame_idx * __size + 1, __size)").alias("frame"))


def encapsulated_frames(images: DataFrame, *, key: str, data: str, n_frames: str) -> DataFrame:
    """(key, frame_idx, frame): encapsulated pixel data by its offset table, fragments or marks."""
    kind = images.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, idx, out = [], [], []
            for i, (blob, n) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                for j, f in enumerate(fr.frames_of(blob, n or 1) if blob else []):
                    at.append(i)
                    idx.append(j)
                    out.append(f)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(idx, pa.int32()), pa.array(out, pa.binary())], names=[key, "frame_idx", "frame"])

    return images.select(key, data, n_frames).mapInArrow(run, f"`{key}` {kind}, frame_idx int, frame binary")


def decode_frames(frames: DataFrame, *, keys: list[str], rows: str, columns: str, samples: str, bits: str, syntax: str) -> DataFrame:
    """`frame` decoded by the codec of each row's transfer syntax, registered ones included; native frames
    stay as they are."""
    kinds = ", ".join(f"`{k}` {frames.schema[k].dataType.simpleString()}" for k in keys)
    codecs = fr.registered()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = len(keys)
            out = [
                f if f is None or uid in NATIVE else fr.decode_frame(uid, f, *shape, codecs)
                for f, uid, *shape in zip(*(b.column(i).to_pylist() for i in range(n, n + 6)), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(out, pa.binary())], names=[*keys, "frame"])

    return frames.select(*keys, "frame", syntax, rows, columns, samples, bits).mapInArrow(run, f"{kinds}, frame binary")


def sample_arrays(frame: Column, bits: int, signed: bool, little: bool = True) -> Column:
    """ARRAY<DOUBLE> of a frame's 8- or 16-bit samples; null for null, an error for other sizes."""
    if bits not in (8, 16):
        raise ValueError("samples take 8 or 16 bits")

    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda b: None if b is None else fr.unpack_samples(bytes(b), bits, signed, little))

    return F.pandas_udf(run, "array<double>")(frame)


def explode_samples(frames: DataFrame, *, keys: list[str], samples: str, columns: Column) -> DataFrame:
    """`keys`, row, col, value: one row a sample of one-channel frames."""
    s = frames.select(*keys, columns.cast("int").alias("__w"), F.posexplode(samples).alias("__at", "value"))
    return s.select(*keys, F.expr("__at div __w").cast("int").alias("row"), (F.col("__at") % F.col("__w")).alias("col"), "value")


def encode_frames(frames: DataFrame, *, key: str, order: str, per_frame: int = 1, table: bool = True) -> DataFrame:
    """(key, pixel_data): a dataset's frames in order, encapsulated with or without offset table."""
    grouped = frames.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("frame").alias("f")))), lambda s: s["f"]).alias("fs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [fr.encapsulate(fs, per_frame, table) for fs in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=[key, "pixel_data"])

    return grouped.mapInArrow(run, f"`{key}` {frames.schema[key].dataType.simpleString()}, pixel_data binary")


def uid_from_entropy(parts: Column, prefix: str = UID_ROOT) -> Column:
    """A UID of at most 64 characters from text: prefix and SHA-512 as a decimal number."""
    if len(prefix) > 54 or not re.fullmatch(r"(0|[1-9]\d*)(\.(0|[1-9]\d*))*\.", prefix):
        raise ValueError(f"no usable UID prefix: {prefix}")

    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else (prefix + str(int(hashlib.sha512(t.encode()).hexdigest(), 16)))[:64])

    return F.pandas_udf(run, "string")(parts)


def random_uid() -> Column:
    """A fresh UID under 2.25 from a random UUID; differs each time it is computed."""

    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: f"2.25.{int(t.replace('-', ''), 16)}")

    return F.pandas_udf(run, "string")(F.expr("uuid()"))


def display_line(tag: Column, vr: Column, keyword: Column, strings: Column, raw: Column, depth: Column) -> Column:
    """One line of a dump: indent, tag, name and value; long values are cut to 61 characters and dots."""
    value = F.coalesce(F.array_join(strings, "\\"), F.when(F.length(raw) > 16, F.concat(F.lit("Array of "), F.length(raw), F.lit(" bytes"))).otherwise(F.lower(F.hex(raw))), F.lit(""))
    short = F.when(F.length(value) > 64, F.concat(F.substring(value, 1, 61), F.lit("..."))).otherwise(value)
    return F.concat(F.repeat(F.lit("  "), depth), tag_text(tag), F.lit(" "), F.rpad(keyword, 36, " "), F.lit(" "), vr, F.lit(": "), short)


def walk_order(elements: DataFrame, *, key: str) -> DataFrame:
    """`walk_idx`: the place of each element in the depth-first walk of its dataset."""
    from pyspark.sql import Window

    steps = F.concat(F.transform("path", lambda p: F.struct(p["tag"].alias("t"), p["item"].alias("i"))), F.array(F.struct(F.col("tag").alias("t"), F.lit(-1).alias("i"))))
    return elements.withColumn("walk_idx", F.row_number().over(Window.partitionBy(key).orderBy(steps)))


def elements_of_nodes(nodes: DataFrame, *, key: str) -> DataFrame:
    """Element rows (key, path, tag, vr, strings) of a node table, as the dataset operators take them."""
    items = nodes.where("kind = 'object'").select(key, F.col("node").alias("item_node"), F.col("sequence_path"), F.col("ordinal").alias("item_no"))
    e = nodes.where("kind = 'element'").select(key, F.col("node").alias("element_node"), F.col("parent").alias("item_node"), F.conv("label", 16, 10).cast("bigint").alias("tag"), "vr")
    scalars = nodes.where("kind = 'scalar' AND label = 'Value'").select(key, F.col("parent").alias("element_node"), F.struct("ordinal", "scalar").alias("s"))
    values = scalars.groupBy(key, "element_node").agg(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["scalar"]).alias("strings"))
    parts = F.split(F.concat_ws("/", "sequence_path", F.col("item_no").cast("string")), "/")
    path = F.when(F.col("sequence_path").isNull(), F.array().cast("array<struct<tag:bigint,item:int>>")).otherwise(
        F.transform(
            F.sequence(F.lit(0), (F.size(parts) / 2).cast("int") - 1),
            lambda i: F.struct(F.conv(F.get(parts, i * 2), 16, 10).cast("bigint").alias("tag"), F.get(parts, i * 2 + 1).cast("int").alias("item")),
        )
    )
    return e.join(items.hint("merge"), [key, "item_node"]).join(values.hint("merge"), [key, "element_node"], "left").select(key, path.alias("path"), "tag", "vr", "strings")


def color_by_pixel(frame: bytes, samples: int, bits: int) -> bytes:
    """Planes to interleaved pixels; the length must be a multiple of a pixel."""
    wide = bits // 8
    if len(frame) % (samples * wide):
        raise ValueError("the frame holds no whole number of pixels")
    return fr.interleave(frame, samples, wide)
