"""Operators over element rows: selection, scopes, dictionaries, private blocks, datasets as sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from voxelake.codec.json_model import dataset_json, json_elements
from voxelake.dictionary import SEED, Dictionary
from voxelake.sources.dicom import path_array
from voxelake.functions.tags import element_of, group_of, is_private, is_private_creator

CHARSET, PIXEL_REPRESENTATION, PIXEL_DATA = 0x00080005, 0x00280103, 0x7FE00010
BITS_ALLOCATED, WAVEFORM_BITS, LUT_DESCRIPTOR, LUT_DATA = 0x00280100, 0x54001004, 0x00283002, 0x00283006
#: Tags whose representation follows PixelRepresentation, and waveform data.
US_OR_SS = (0x00189810, 0x00221452, 0x00280104, 0x00280105, 0x00280106, 0x00280107, 0x00280108, 0x00280109, 0x00280110, 0x00280111, 0x00280120, 0x00280121, 0x00281101, 0x00281102, 0x00281103, 0x00283002, 0x00409211, 0x00409216, 0x00603004, 0x00603006)
WAVEFORM = (0x54000110, 0x54000112, 0x5400100A, 0x54001010)


def _path(df: DataFrame) -> Column:
    return F.col("path") if "path" in df.columns else F.array().cast("array<struct<tag:bigint,item:int>>")


def select_tags(elements: DataFrame, tags: list[int]) -> DataFrame:
    """The listed tags, group 2 and the character set; nested ones only below listed sequences."""
    above = F.forall(_path(elements), lambda p: p["tag"].isin(*tags))
    return elements.where((F.col("tag").isin(*tags, CHARSET) | (group_of(F.col("tag")) == 2)) & above)


def before_pixels(elements: DataFrame) -> DataFrame:
    """Without pixel data and what follows it."""
    return elements.where(F.col("tag") < PIXEL_DATA)


def group_dataset(elements: DataFrame, group: int) -> DataFrame:
    """Elements of one group with everything nested in them."""
    top = F.coalesce(F.get(_path(elements), F.lit(0))["tag"], F.col("tag"))
    return elements.where(group_of(top) == group)


def remove_private(elements: DataFrame) -> DataFrame:
    """Without elements that are private or stand in private sequences."""
    return elements.where(~is_private(F.col("tag")) & ~F.exists(_path(elements), lambda p: is_private(p["tag"])))


def with_dictionary(elements: DataFrame, tags: DataFrame, repeaters: DataFrame) -> DataFrame:
    """keyword and dictionary_vr of every element: exact tag first, then repeating groups.

    Both dictionaries are small by nature; joins leave the choice of a broadcast to their size.
    """
    exact = tags.select("tag", F.col("vr").alias("__v"), F.col("keyword").alias("__k"))
    masks = repeaters.select("mask").distinct()
    # one equi-join per mask instead of a join on a condition: the row carries its masked values
    masked = elements.join(exact, "tag", "left").withColumn("__m", F.lit(None).cast("string")).withColumn("__mv", F.lit(None).cast("string"))
    for (m,) in masks.collect():  # masks of the dictionary, a handful
        one = repeaters.where(F.col("mask") == m).select(F.col("value").alias("__value"), F.col("keyword").alias("__rk"), F.col("vr").alias("__rv"))
        masked = (
            masked.withColumn("__value", F.col("tag").bitwiseAND(F.lit(m).cast("bigint")))
            .join(one, "__value", "left")
            .withColumn("__m", F.coalesce("__m", "__rk"))
            .withColumn("__mv", F.coalesce("__mv", "__rv"))
            .drop("__value", "__rk", "__rv")
        )
    creator = is_private_creator(F.col("tag"))
    vr = F.coalesce("__v", F.when(element_of(F.col("tag")) == 0, "UL"), "__mv", F.when(creator, "LO"), F.lit("UN"))
    return masked.withColumn("dictionary_vr", vr).withColumn("keyword", F.coalesce("__k", "__m", F.when(creator, "PrivateCreator"), F.lit(""))).drop("__v", "__k", "__m", "__mv")


def carry_charset(elements: DataFrame, *, key: str, order: str, charset: str) -> DataFrame:
    """`active_charset`: the latest non-null `charset` of the same key up to and with each row."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return elements.withColumn("active_charset", F.last(charset, ignorenulls=True).over(w))


def private_block(elements: DataFrame, *, key: str) -> DataFrame:
    """Private elements with the creator text that reserved their block."""
    scope = _path(elements)
    e = elements.withColumn("__scope", scope)
    creators = e.where(is_private_creator(F.col("tag"))).select(
        key, "__scope", group_of(F.col("tag")).alias("__g"), element_of(F.col("tag")).alias("__b"), F.trim(F.get("strings", F.lit(0))).alias("block_creator")
    )
    inside = e.where(is_private(F.col("tag")) & (element_of(F.col("tag")) >= 0x1000))
    return (
        inside.withColumn("__g", group_of(F.col("tag")))
        .withColumn("__b", F.shiftright(element_of(F.col("tag")), 8))
        .join(creators.hint("merge"), [key, "__scope", "__g", "__b"], "left")
        .drop("__scope", "__g", "__b")
    )


def private_vr(private: DataFrame, dictionary: DataFrame) -> DataFrame:
    """`private_vr` of private elements with `block_creator`: exact form first, then GGGGxxEE, GGxxxxEE.

    One equi-join per form with the dictionary, whose size decides how; rows are never numbered.
    """
    tag = F.col("tag")
    g, e = F.format_string("%04X", group_of(tag)), F.format_string("%04X", element_of(tag))
    forms = (F.concat(g, e), F.concat(g, F.lit("xx"), F.substring(e, 3, 2)), F.concat(F.substring(g, 1, 2), F.lit("xxxx"), F.substring(e, 3, 2)))
    known = dictionary.groupBy(F.col("creator").alias("block_creator"), F.col("masked").alias("__m")).agg(F.min("vr").alias("__vr"))
    out = private
    for n, form in enumerate(forms):
        out = out.withColumn("__m", form).join(known.withColumnRenamed("__vr", f"__vr{n}"), ["block_creator", "__m"], "left").drop("__m")
    found = F.coalesce(*(F.col(f"__vr{n}") for n in range(len(forms))), F.lit("UN"))
    return out.select(*private.columns, found.alias("private_vr"))


def nearest_value(elements: DataFrame, *, key: str, tag: int, value: Column, at: DataFrame | None = None) -> DataFrame:
    """(key, path, nearest): for every dataset (those of `at`, else all) the value of `tag` in it or in
    the nearest one around it; datasets without any are left out.

    Only distinct (key, path) pairs are spread over their prefixes and joined to the datasets that
    hold the tag: equi-joins on (key, prefix), then the deepest wins. Values never travel.
    """
    holders = elements.where(F.col("tag") == tag).select(key, F.col("path").alias("__prefix"), value.alias("__value")).where("__value IS NOT NULL")
    datasets = (elements if at is None else at).select(key, "path").distinct()
    prefixes = datasets.select(key, "path", F.explode(F.transform(F.sequence(F.lit(0), F.size("path")), lambda n: F.slice("path", F.lit(1), n))).alias("__prefix"))
    return prefixes.join(holders.hint("merge"), [key, "__prefix"]).groupBy(key, "path").agg(F.max_by("__value", F.struct(F.size("__prefix"), "__value")).alias("nearest"))


def int16_strings(raw: Column, signed: Column, little: bool = True) -> Column:
    """The 16-bit numbers of a byte value as text; null for bytes that are no whole numbers."""
    byte = lambda i: F.hex(F.substring(raw, i, F.lit(1)))
    low, high = (1, 2) if little else (2, 1)
    one = lambda i: F.conv(F.concat(byte(i * 2 + high), byte(i * 2 + low)), 16, 10).cast("int")
    n = F.length(raw)
    made = F.transform(F.sequence(F.lit(0), (n / 2).cast("int") - 1), lambda i: F.when(signed & (one(i) > 32767), one(i) - 65536).otherwise(one(i)).cast("string"))
    return F.when((n % 2 == 0) & (n > 0), made).when(n == 0, F.array().cast("array<string>"))


def resolve_ambiguous(elements: DataFrame, *, key: str, implicit: Column | bool = False, little: bool = True) -> DataFrame:
    """`resolved_vr` and `vr_error`: what elements of ambiguous representation are.

    US or SS by the nearest pixel representation (unsigned where there is none, but an error beside
    pixel data); pixel data by its length, encoding and BitsAllocated; waveforms by encoding and
    WaveformBitsAllocated; LUTData by the first value of its LUTDescriptor; overlays are OW. An element
    that lacks what it depends on keeps its representation and says so. `strings` of elements resolved
    to US or SS are filled from `raw` where that column is there. Only ambiguous elements are joined.
    """
    unclear = F.col("vr").contains(" or ")
    implied = implicit if isinstance(implicit, Column) else F.lit(implicit)
    e = elements.where(unclear).withColumn("__implicit", implied)
    raw = "raw" in elements.columns
    number = F.get("strings", F.lit(0)).try_cast("int")
    first = F.coalesce(number, F.get(int16_strings(F.substring("raw", 1, 2), F.lit(False), little), F.lit(0)).try_cast("int")) if raw else number
    fact = lambda t, v: F.max(F.when(F.col("tag") == t, v))
    beside = (
        elements.where(F.col("tag").isin(BITS_ALLOCATED, WAVEFORM_BITS, LUT_DESCRIPTOR, PIXEL_DATA))
        .groupBy(key, "path")
        .agg(
            fact(BITS_ALLOCATED, number).alias("__bits"), fact(WAVEFORM_BITS, number).alias("__wave"), fact(LUT_DESCRIPTOR, first).alias("__lut"),
            F.coalesce(fact(PIXEL_DATA, F.lit(True)), F.lit(False)).alias("__pixels"),
        )
    )
    near = nearest_value(elements, key=key, tag=PIXEL_REPRESENTATION, value=number, at=e)
    e = e.join(beside.hint("merge"), [key, "path"], "left").join(near.hint("merge"), [key, "path"], "left")
    vr, tag = F.col("vr"), F.col("tag")
    overlay = group_of(tag).between(0x6000, 0x601E) & (element_of(tag) == 0x3000)
    by_bits = lambda b: F.when(F.col("__implicit"), "OW").when(F.col(b) > 8, "OW").when(F.col(b).isNotNull(), "OB")
    sign = F.when(F.col("nearest").isNull(), F.when(F.coalesce("__pixels", F.lit(False)), None).otherwise("US")).otherwise(F.when(F.col("nearest") == 0, "US").otherwise("SS"))
    made = (
        F.when((tag == PIXEL_DATA) & F.coalesce("undefined_length", F.lit(False)), "OB").when(tag == PIXEL_DATA, by_bits("__bits"))
        .when(tag.isin(*US_OR_SS) | (vr == "US or SS"), sign)
        .when(tag.isin(*WAVEFORM), by_bits("__wave"))
        .when(tag == LUT_DATA, F.when(F.col("__lut") == 1, "US").when(F.col("__lut").isNotNull(), "OW"))
        .when(overlay, "OW").otherwise(vr)
    )
    needs = F.when(tag == PIXEL_DATA, "BitsAllocated").when(tag.isin(*WAVEFORM), "WaveformBitsAllocated").when(tag == LUT_DATA, "LUTDescriptor").otherwise("PixelRepresentation")
    e = e.withColumn("resolved_vr", F.coalesce(made, vr)).withColumn("vr_error", F.when(made.isNull(), F.concat(F.lit("missing "), needs)))
    if raw:
        e = e.withColumn("strings", F.when(F.col("strings").isNull() & F.col("resolved_vr").isin("US", "SS"), int16_strings(F.col("raw"), F.col("resolved_vr") == "SS", little)).otherwise(F.col("strings")))
    rest = elements.where(~unclear | F.col("vr").isNull()).withColumns({"resolved_vr": vr, "vr_error": F.lit(None).cast("string")})
    return rest.unionByName(e.select(*rest.columns))


def update(base: DataFrame, other: DataFrame, *, on: list[str]) -> DataFrame:
    """`base` with the rows of `other` put in or in place of those of the same key."""
    both = base.withColumn("__src", F.lit(0)).unionByName(other.withColumn("__src", F.lit(1)))
    rest = [c for c in base.columns if c not in on]
    picked = both.groupBy(*on).agg(F.max_by(F.struct(*rest), "__src").alias("__r"))
    return picked.select(*on, *(F.col("__r")[c].alias(c) for c in rest)).select(*base.columns)


def delete(base: DataFrame, gone: DataFrame, *, on: list[str]) -> DataFrame:
    """`base` without the keys of `gone`."""
    return base.join(gone.select(*on).distinct().hint("merge"), on, "left_anti")


def equal_datasets(a: DataFrame, b: DataFrame, *, key: str, on: list[str], values: list[str]) -> DataFrame:
    """(key, equal): whether both sides hold the same elements with the same values."""
    x, y = a.select(key, *on, F.struct(*values).alias("__a")), b.select(key, *on, F.struct(*values).alias("__b"))
    same = F.coalesce(F.col("__a").eqNullSafe(F.col("__b")), F.lit(False))
    return x.join(y, [key, *on], "full").groupBy(key).agg(F.bool_and(same).alias("equal"))


def to_json(elements: DataFrame, *, key: str, bulk_threshold: int | None = None, bulk: str | Callable | None = None) -> DataFrame:
    """(key, json): whole datasets in the DICOM JSON model, nested where rows have a path; keys in order.

    Byte values whose base64 text would be longer than `bulk_threshold` characters become BulkDataURI:
    `bulk` and their place, or what the function `bulk` makes of (place, vr, bytes). One shuffle by
    key; a dataset must fit in a task.
    """
    e = elements
    for name, kind in (("path", "array<struct<tag:bigint,item:int>>"), ("raw", "binary")):
        if name not in e.columns:
            e = e.withColumn(name, F.lit(None).cast(kind))
    grouped = e.groupBy(key).agg(F.collect_list(F.struct("path", "tag", "vr", "strings", "raw")).alias("es"))
    most = None if bulk_threshold is None else bulk_threshold // 4 * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([dataset_json(x, most, bulk) for x in b.column(1).to_pylist()], pa.string())], names=[key, "json"])

    return grouped.mapInArrow(run, f"`{key}` {elements.schema[key].dataType.simpleString()}, json string")


def from_json(records: DataFrame, *, key: str, json: str, dictionary: Dictionary = SEED, bulk_reader: Callable | None = None) -> DataFrame:
    """(key, path, tag, vr, strings, raw, bulk_uri, value_error) of every element of DICOM JSON text.

    All groups of person names, nested items, inline and bulk bytes are read (`bulk_reader` makes bytes
    of (tag, vr, uri)), and unknown bytes by the dictionary. What doesn't follow the model, text that is
    no JSON included, says why in value_error. Null text gives no row. One narrow pass.
    """
    kinds = ("array<struct<tag:bigint,item:int>>", "bigint", "string", "array<string>", "binary", "string", "string")
    names = ("path", "tag", "vr", "strings", "raw", "bulk_uri", "value_error")
    types = (pa.int64(), pa.string(), pa.list_(pa.string()), pa.binary(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                if text is None:
                    continue
                try:
                    got = list(json_elements(text, dictionary, bulk_reader))
                except (ValueError, RecursionError) as x:
                    got = [((), None, None, None, None, None, f"no JSON: {x}"[:200])]
                rows += got
                at += [i] * len(got)
            cols = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), path_array(list(cols[0])), *(pa.array(c, t) for c, t in zip(cols[1:], types, strict=True))], names=[key, *names])

    return records.select(key, json).mapInArrow(run, ", ".join([f"`{key}` {records.schema[key].dataType.simpleString()}", *(f"{n} {k}" for n, k in zip(names, kinds, strict=True))]))


def ends_image(fragment: Column) -> Column:
    """Whether a fragment's last ten bytes hold the end of an image (FF D9), which padding may follow."""
    tail = F.substring(fragment, -10, 10) if isinstance(fragment, str) else F.substring(fragment, F.greatest(F.length(fragment) - 9, F.lit(1)), F.lit(10))
    return F.coalesce(F.exists(F.sequence(F.lit(1), F.lit(9)), lambda i: F.hex(F.substring(tail, i, F.lit(2))) == "FFD9"), F.lit(False))


def fragment_frames(fragments: DataFrame, *, key: str, order: str, marks_end: str) -> DataFrame:
    """`frame_idx` of fragments: a new frame begins after each one that ends an image."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return fragments.withColumn("frame_idx", F.coalesce(F.sum(F.col(marks_end).cast("int")).over(w), F.lit(0)).cast("int"))


def fragment_offsets(fragments: DataFrame, *, key: str, order: str, length: str) -> DataFrame:
    """`offset`: where each itemised fragment begins, as offset tables count it."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return fragments.withColumn("offset", F.coalesce(F.sum(F.col(length) + F.col(length) % 2 + 8).over(w), F.lit(0)))


def image_rows(elements: DataFrame, *, key: str, tags: dict[int, str]) -> DataFrame:
    """One row a dataset with the first value of each listed top-level tag."""
    picked = elements.where(F.col("tag").isin(*tags) & (F.size(_path(elements)) == 0))
    return picked.groupBy(key).agg(*(F.max(F.when(F.col("tag") == t, F.get("strings", F.lit(0)))).alias(n) for t, n in tags.items()))
