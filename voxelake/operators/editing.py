"""Elements put into datasets by kind of value, with the checks that a representation asks for, and
the encoding a dataset came in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelake.dictionary import SEED, Dictionary
from voxelake.functions import values as vl
from voxelake.functions.tags import BINARY_VRS, INT_VRS, STRING_VRS
from voxelake.operators.elements import update

ELEMENT = "path array<struct<tag:bigint,item:int>>, tag bigint, vr string, strings array<string>, raw binary, value_error string"
#: Representations that each kind of value may be put into.
KINDS = {
    "string": STRING_VRS,
    "int": (*INT_VRS, "US or SS", "US or OW", "US or SS or OW"),
    "float": ("FL", "FD", "DS"),
    "bytes": (*BINARY_VRS, "OB or OW", "US or OW", "US or SS or OW"),
    "sequence": ("SQ",),
    "date": ("DA",),
    "time": ("TM",),
    "datetime": ("DT",),
    "name": ("PN",),
    "decimal": ("DS",),
    "integer": ("IS",),
}


def new_elements(spark: SparkSession, rows: list[tuple], key: str = "file") -> DataFrame:
    """Elements from (key, path, tag, vr, strings, raw) tuples, in the columns of the operators here."""
    return spark.createDataFrame([(*r, None) for r in rows], f"`{key}` string, {ELEMENT}")


def representation(tag: int | str, kind: str | None = None, dictionary: Dictionary = SEED) -> tuple[int, str]:
    """(tag, vr) of a tag or keyword; an error where the dictionary has none or it doesn't hold the kind."""
    number = dictionary.tag(tag) if isinstance(tag, str) else tag
    vr = dictionary.vr(number)
    if vr == "UN":
        raise ValueError(f"({number >> 16:04X},{number & 0xFFFF:04X}) is in no dictionary: give its representation")
    if kind is not None and vr not in KINDS[kind]:
        raise ValueError(f"({number >> 16:04X},{number & 0xFFFF:04X}) has VR {vr}, which holds no {kind} values")
    return number, vr


def _utc(x: Column, pattern: str) -> Column:
    return F.date_format(x, pattern)


def value_texts(values: Column, kind: str, vr: str) -> tuple[Column, Column]:
    """(strings, reason) of an array of typed values; strings are null where a value has no spelling.

    date: DATE; time: microseconds of the day; datetime: TIMESTAMP, written in the session's zone with
    no offset; decimal and float under DS: at most 16 characters; integer: within 32 bits; name: the
    struct of `parse_pn` or text. A null value is an empty text.
    """
    if kind == "time":
        one = lambda x: F.concat(_utc(F.timestamp_micros(x), "HHmmss"), F.regexp_replace(F.format_string(".%06d", x % 1_000_000), r"\.?0+$", ""))
        sound = lambda x: x.between(0, 86_400_000_000 - 1)
    elif kind == "date":
        one, sound = lambda x: F.date_format(x, "yyyyMMdd"), lambda x: F.year(x).between(1, 9999)
    elif kind == "datetime":
        one = lambda x: F.regexp_replace(F.date_format(x, "yyyyMMddHHmmss.SSSSSS"), r"\.?0{6}$", "")
        sound = lambda x: F.year(x).between(1, 9999)
    elif kind == "integer":
        one, sound = lambda x: x.cast("string"), vl.is_in_range
    elif kind == "name":
        one, sound = lambda x: x, lambda x: F.lit(True)
    elif vr == "DS":
        # DS has no spelling for what is no finite number
        one = lambda x: x.cast("string")
        sound = lambda x: ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))
    else:
        one, sound = lambda x: x.cast("string"), lambda x: F.lit(True)
    good = F.forall(values, lambda x: x.isNull() | sound(x))
    texts = vl.format_ds_list(values.cast("array<double>")) if vr == "DS" and kind in ("float", "decimal") else F.transform(values, lambda x: F.coalesce(one(x), F.lit("")))
    return F.when(good, texts), F.when(~good, F.lit(f"VR {vr} can't hold a value of these"))


def set_values(base: DataFrame, values: DataFrame, *, key: str, tag: int | str, kind: str, column: str = "value", vr: str | None = None, dictionary: Dictionary = SEED, mode: str = "PERMISSIVE") -> DataFrame:
    """`base` (key, path, tag, vr, strings, raw, value_error) with the top-level element `tag` set, in
    place of one that is there, for every key of `values`, whose `column` holds a value or an array.

    The representation is the dictionary's, or `vr`; a kind that it doesn't hold is an error at once. A
    value without a spelling (not a number in DS) leaves the element as it was with the reason as
    value_error, or raises under FAILFAST. One shuffle of both sides by key, path and tag.
    """
    number, known = representation(tag, kind, dictionary) if vr is None else (dictionary.tag(tag) if isinstance(tag, str) else tag, vr)
    if known not in KINDS[kind]:
        raise ValueError(f"VR {known} holds no {kind} values")
    many = values.schema[column].dataType.typeName() == "array"
    v = F.col(column) if many else F.array(F.col(column))
    at = F.array().cast("array<struct<tag:bigint,item:int>>")
    rows = values.select(key, at.alias("path"), F.lit(number).cast("bigint").alias("tag"), F.lit(known).alias("vr"), v.alias("__v"))
    nothing = F.lit(None).cast("string")
    if kind == "bytes":
        new = rows.select(key, "path", "tag", "vr", F.lit(None).cast("array<string>").alias("strings"), F.get("__v", F.lit(0)).alias("raw"), nothing.alias("value_error"))
    elif kind == "sequence":
        new = rows.select(key, "path", "tag", "vr", F.lit(None).cast("array<string>").alias("strings"), F.lit(None).cast("binary").alias("raw"), nothing.alias("value_error"))
    else:
        texts, reason = value_texts(F.col("__v"), kind, known)
        if mode == "FAILFAST":
            texts, reason = F.when(reason.isNotNull(), F.raise_error(reason)).otherwise(texts), nothing
        new = rows.select(key, "path", "tag", "vr", texts.alias("strings"), F.lit(None).cast("binary").alias("raw"), reason.alias("value_error"))
    new = new.select(*base.columns)
    on = [key, "path", "tag"]
    bad = new.where("value_error IS NOT NULL")
    done = update(base, new.where("value_error IS NULL"), on=on)
    if kind in ("bytes", "sequence") or mode == "FAILFAST":
        return done
    told = bad.select(*on, F.col("value_error").alias("__e"))
    return done.join(told.hint("merge"), on, "left").withColumn("value_error", F.coalesce("__e", "value_error")).select(*base.columns)


def with_encoding(files: DataFrame, *, implicit_vr: Column, little_endian: Column, charsets: Column) -> DataFrame:
    """`original`: STRUCT<implicit_vr, little_endian, charsets> that datasets came in; a missing
    character set is the default one."""
    return files.withColumn("original", F.struct(implicit_vr.alias("implicit_vr"), little_endian.alias("little_endian"), vl.normalise_charsets(charsets).alias("charsets")))


def is_original_encoding(implicit_vr: Column, little_endian: Column, charsets: Column) -> Column:
    """Whether writing with these would use the encoding in `original`; a null flag means unchanged."""
    o = F.col("original")
    same = lambda a, b: a.isNull() | (a == b)
    return F.coalesce(same(implicit_vr, o["implicit_vr"]) & same(little_endian, o["little_endian"]) & (vl.normalise_charsets(charsets) == o["charsets"]), F.lit(False))
