"""Typed access to element rows: values by kind, multiplicity, emptiness, equality, membership.

All are built-in expressions over the columns vr, strings and raw; an absent or unusable value is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelake.dictionary import SEED, Dictionary
from voxelake.functions import values as vl
from voxelake.functions.tags import BINARY_VRS, INT_VRS, STRING_VRS, is_private

_TEXT = ("AE", "AS", "CS", "IS", "LO", "LT", "SH", "ST", "UC", "UI", "UR", "UT")


def _only(strings: Column) -> Column:
    """The one value of an element; null for none and for several."""
    return F.when(F.size(strings) == 1, F.get(strings, F.lit(0)))


def text_value(strings: Column) -> Column:
    """All values as one text, joined by backslashes; null for byte values."""
    return F.when(strings.isNotNull(), F.array_join(strings, "\\", ""))


def int_value(vr: Column, strings: Column) -> Column:
    """BIGINT of a single integer, integer string or text that is one; several values give null."""
    return F.when(vr.isin(*(v for v in INT_VRS if v != "AT"), *_TEXT), vl.parse_is(_only(strings)))


def big_int_value(vr: Column, strings: Column) -> Column:
    """DECIMAL(20,0), wide enough for every unsigned 64-bit value."""
    return F.when(vr.isin(*(v for v in INT_VRS if v != "AT"), *_TEXT), F.when(_only(strings).rlike(r"^ *[+-]?\d+ *$"), F.trim(_only(strings)).try_cast("decimal(20,0)")))


def float_values(vr: Column, strings: Column) -> Column:
    """ARRAY<DOUBLE> of FL, FD, DS and number texts; null if any of them is none."""
    number = lambda x: F.coalesce(vl.parse_ds(x), F.when(vr.isin("FL", "FD"), x.try_cast("double")))
    made = F.transform(strings, number)
    usable = vr.isin("FL", "FD", "DS", *_TEXT) & (F.size(strings) > 0)
    return F.when(usable & F.forall(made, lambda x: x.isNotNull()), made)


def float_value(vr: Column, strings: Column) -> Column:
    """The first of `float_values`."""
    return F.get(float_values(vr, strings), F.lit(0))


def date_value(vr: Column, strings: Column) -> Column:
    return F.when(vr == "DA", vl.parse_da(_only(strings)))


def time_value(vr: Column, strings: Column) -> Column:
    return F.when(vr == "TM", vl.parse_tm(_only(strings)))


def datetime_value(vr: Column, strings: Column) -> Column:
    return F.when(vr == "DT", vl.parse_dt(_only(strings)))


def name_value(vr: Column, strings: Column) -> Column:
    return F.when(vr == "PN", vl.parse_pn(_only(strings)))


def decimal_value(vr: Column, strings: Column) -> Column:
    """STRUCT<value, original> of a decimal string."""
    one = _only(strings)
    return F.when((vr == "DS") & vl.parse_ds(one).isNotNull(), F.struct(vl.parse_ds(one).alias("value"), one.alias("original")))


def integer_value(vr: Column, strings: Column) -> Column:
    """STRUCT<value, original> of an integer string."""
    one = _only(strings)
    return F.when((vr == "IS") & vl.parse_is(one).isNotNull(), F.struct(vl.parse_is(one).alias("value"), one.alias("original")))


def tag_values(vr: Column, strings: Column) -> Column:
    """ARRAY<BIGINT> of the tags of AT elements."""
    return F.when(vr == "AT", F.transform(strings, lambda x: F.conv(x, 16, 10).cast("bigint")))


def bytes_value(vr: Column, raw: Column) -> Column:
    """The bytes of byte representations."""
    return F.when(vr.isin(*BINARY_VRS) | vr.contains(" or "), raw)


def multiplicity(vr: Column, strings: Column, raw: Column, items: Column) -> Column:
    """Number of values: items of a sequence, one for bytes, texts by count; 0 for empty elements."""
    return (
        F.when(vr == "SQ", F.coalesce(items, F.lit(0)))
        .when(strings.isNotNull(), F.when((F.size(strings) == 1) & (F.get(strings, F.lit(0)) == ""), 0).otherwise(F.size(strings)))
        .otherwise((F.coalesce(F.length(raw), F.lit(0)) > 0).cast("int"))
    )


def is_empty(vr: Column, strings: Column, raw: Column, items: Column) -> Column:
    return multiplicity(vr, strings, raw, items) == 0


def with_items(elements: DataFrame, *, key: str) -> DataFrame:
    """`items`: the number of items of every sequence (0 for empty ones), null for other elements.

    Only the last step of each path is counted, so an item without elements is not seen.
    """
    last = F.element_at("path", -1)
    counted = (
        elements.where(F.size("path") > 0)
        .select(key, F.slice("path", F.lit(1), F.size("path") - 1).alias("path"), last["tag"].alias("tag"), (last["item"] + 1).alias("__n"))
        .groupBy(key, "path", "tag")
        .agg(F.max("__n").alias("__n"))
    )
    return elements.join(counted.hint("merge"), [key, "path", "tag"], "left").withColumn("items", F.when(F.col("vr") == "SQ", F.coalesce("__n", F.lit(0)))).drop("__n")


def items_of(elements: DataFrame, sequence: int) -> DataFrame:
    """The elements inside the items of a sequence at any depth, with `item` and their path from there on."""
    at = F.array_position(F.transform("path", lambda p: p["tag"]), F.lit(sequence).cast("bigint")).cast("int")
    inside = elements.withColumn("__at", at).where("__at > 0")
    return inside.withColumn("item", F.col("path")[F.col("__at") - 1]["item"]).withColumn("path", F.slice("path", F.col("__at") + 1, F.size("path"))).drop("__at")


def by_keyword(elements: DataFrame, keyword: str, dictionary: Dictionary = SEED) -> DataFrame:
    """The elements of one keyword; an error for a keyword that the dictionary lacks."""
    return elements.where(F.col("tag") == dictionary.tag(keyword))


def is_repeater(tag: Column, dictionary: Dictionary = SEED) -> Column:
    """Whether a tag belongs to a repeating group."""
    out = F.lit(False)
    for value, mask, _, _ in dictionary.repeaters:
        out = out | (tag.bitwiseAND(F.lit(mask).cast("bigint")) == value)
    return out


def in_dictionary(elements: DataFrame, tags: DataFrame) -> DataFrame:
    """`in_dictionary`: whether a dictionary table holds the tag."""
    known = tags.select("tag").distinct().withColumn("__known", F.lit(True))
    return elements.join(known, "tag", "left").withColumn("in_dictionary", F.coalesce("__known", F.lit(False))).drop("__known")


def is_zero(vr: Column, strings: Column) -> Column:
    """Whether a typed value is empty: no text, or blank text."""
    one = F.get(strings, F.lit(0))
    return F.when(vr.isin(*STRING_VRS), (F.coalesce(F.size(strings), F.lit(0)) == 0) | F.coalesce(F.trim(one) == "", F.lit(True)))


def same_value(vr: Column, a: Column, b: Column) -> Column:
    """Whether two texts denote the same value: dates, times and numbers by value, whatever their
    spelling; names without trailing empty groups and parts; other texts as they stand."""
    name = lambda x: F.regexp_replace(F.regexp_replace(vl.unpad(x), r"\^+(=|$)", "$1"), "=+$", "")
    by = lambda f: F.coalesce(f(a).eqNullSafe(f(b)) & (f(a).isNotNull() | a.eqNullSafe(b)), F.lit(False))
    moment = lambda x: F.to_json(vl.parse_dt(x))
    return (
        F.when(vr == "DA", by(vl.parse_da)).when(vr == "TM", by(vl.parse_tm)).when(vr == "DT", by(moment)).when(vr == "DS", by(vl.parse_ds))
        .when(vr == "IS", by(vl.parse_is)).when(vr == "PN", by(name)).otherwise(a.eqNullSafe(b))
    )


def is_private_element(tag: Column, path: Column) -> Column:
    """Whether an element, or a sequence around it, is private."""
    return is_private(tag) | F.exists(path, lambda p: is_private(p["tag"]))
