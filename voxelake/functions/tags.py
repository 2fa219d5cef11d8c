"""Tags as BIGINT: arithmetic, text forms, predicates; VR classes; UIDs. All built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Classes of value representations.
STRING_VRS = ("AE", "AS", "CS", "DA", "DS", "DT", "IS", "LO", "LT", "PN", "SH", "ST", "TM", "UC", "UI", "UR", "UT")
INT_VRS = ("AT", "SL", "SS", "SV", "UL", "US", "UV")
FLOAT_VRS = ("FD", "FL")
BINARY_VRS = ("OB", "OD", "OF", "OL", "OV", "OW", "UN")
AMBIGUOUS_VRS = ("US or SS", "OB or OW", "US or OW", "US or SS or OW")
UID_PATTERN = r"^(0|[1-9][0-9]*)(\.(0|[1-9][0-9]*))*$"


def make_tag(group: Column, element: Column) -> Column:
    return F.shiftleft(group.cast("bigint"), 16) + element.cast("bigint")


def group_of(tag: Column) -> Column:
    return F.shiftright(tag, 16)


def element_of(tag: Column) -> Column:
    return tag.bitwiseAND(F.lit(0xFFFF).cast("bigint"))


def is_private(tag: Column) -> Column:
    return group_of(tag) % 2 == 1


def is_private_creator(tag: Column) -> Column:
    return is_private(tag) & element_of(tag).between(0x10, 0xFF)


def private_creator_of(tag: Column) -> Column:
    """The tag of the creator that reserves a private element's block; null outside blocks."""
    block = F.shiftright(element_of(tag), 8)
    return F.when(is_private(tag) & (block >= 0x10), F.shiftleft(group_of(tag), 16) + block)


def tag_text(tag: Column) -> Column:
    """(GGGG,EEEE)"""
    return F.format_string("(%04X,%04X)", group_of(tag), element_of(tag))


def tag_key(tag: Column) -> Column:
    """GGGGEEEE"""
    return F.format_string("%08X", tag)


def parse_tag(text: Column) -> Column:
    """Tag of (GGGG,EEEE), GGGG,EEEE or up to eight hex digits, the whole unsigned 32-bit range; else null."""
    t = F.trim(text)
    pair = r"^\(?([0-9A-Fa-f]{4}),\s*([0-9A-Fa-f]{4})\)?$"
    hexed = F.when(t.rlike(pair), F.regexp_replace(t, pair, "$1$2")).when(t.rlike("^(0x)?[0-9A-Fa-f]{1,8}$"), F.regexp_replace(t, "^0x", ""))
    return F.conv(hexed, 16, 10).cast("bigint")


def vr_class(vr: Column) -> Column:
    """string, int, float, binary, sequence, ambiguous or other."""
    return (
        F.when(vr.isin(*STRING_VRS), "string").when(vr.isin(*INT_VRS), "int").when(vr.isin(*FLOAT_VRS), "float")
        .when(vr.isin(*BINARY_VRS), "binary").when(vr == "SQ", "sequence").when(vr.isin(*AMBIGUOUS_VRS), "ambiguous").otherwise("other")
    )


def is_valid_uid(uid: Column) -> Column:
    return F.coalesce(uid.rlike(UID_PATTERN) & (F.length(uid) <= 64), F.lit(False))


def is_private_uid(uid: Column) -> Column:
    return ~uid.startswith("1.2.840.10008.")
