"""Sample arithmetic as column expressions: modality and VOI transforms, colour, display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def rescale(v: Column, slope: Column, intercept: Column) -> Column:
    """v * slope + intercept where both are known, else v."""
    return F.when(slope.isNotNull() & intercept.isNotNull(), v * slope + intercept).otherwise(v)


def lut_value(v: Column, entries: Column, first: Column) -> Column:
    """The table's entry for int(v) - first, held to its ends; null for an empty table."""
    at = F.least(F.greatest(v.cast("int") - first, F.lit(0)), F.size(entries) - 1)
    return F.when(F.size(entries) > 0, F.get(entries, at))


def output_range(bits_stored: Column, signed: Column) -> tuple[Column, Column]:
    """Least and greatest value of samples of that depth."""
    low = F.when(signed, -F.pow(F.lit(2.0), bits_stored - 1)).otherwise(0.0)
    return low, low + F.pow(F.lit(2.0), bits_stored) - 1


def window_level(v: Column, centre: Column, width: Column, low: Column, high: Column, function: str = "LINEAR") -> Column:
    """Window centre and width onto [low, high]: LINEAR, LINEAR_EXACT or SIGMOID. Null where the
    width is too small (below 1 for LINEAR, not above 0 else)."""
    span = high - low
    if function == "SIGMOID":
        return F.when(width > 0, span / (1 + F.exp(-4 * (v - centre) / width)) + low)
    if function not in ("LINEAR", "LINEAR_EXACT"):
        raise ValueError(f"unknown VOI LUT function {function}")
    c, w = (centre - 0.5, width - 1) if function == "LINEAR" else (centre, width)
    usable = width >= 1 if function == "LINEAR" else width > 0
    inner = ((v - c) / F.nullif(w, F.lit(0.0)) + 0.5) * span + low
    return F.when(usable, F.when(v <= c - w / 2, low).when(v > c + w / 2, high).otherwise(inner))


def invert(v: Column, frame: WindowSpec) -> Column:
    """The frame's greatest value less v."""
    return F.max(v).over(frame) - v


def pack_u8(v: Column, frame: WindowSpec) -> Column:
    """0 to 255 for display: clipped if the frame lies within, 0 if it is constant, else stretched."""
    low, high = F.min(v).over(frame), F.max(v).over(frame)
    out = F.when(high == low, F.lit(0.0)).when((low >= 0) & (high <= 255), v).otherwise((v - low) / F.nullif(high - low, F.lit(0.0)) * 255)
    return F.floor(F.least(F.greatest(out, F.lit(0.0)), F.lit(255.0)) + 0.5).cast("int")


def _byte(c: Column) -> Column:
    return F.least(F.greatest(F.floor(c + 0.5), F.lit(0)), F.lit(255)).cast("int")


def ybr_to_rgb(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    """YBR_FULL to RGB, 8 bit, halves up."""
    return (_byte(y + 1.402 * (cr - 128)), _byte(y - 0.114 * 1.772 / 0.587 * (cb - 128) - 0.299 * 1.402 / 0.587 * (cr - 128)), _byte(y + 1.772 * (cb - 128)))


def rgb_to_ybr(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """RGB to YBR_FULL, 8 bit, halves up."""
    y = 0.299 * r + 0.587 * g + 0.114 * b
    return _byte(y), _byte((b - y) / 1.772 + 128), _byte((r - y) / 1.402 + 128)
