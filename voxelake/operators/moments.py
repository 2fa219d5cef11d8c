"""Mixed timestamp spellings and time zones, normalised to one instant in UTC.

An ordered cascade of anchored patterns turns a reading into
`year|month|day|hour|minute|second|fraction|am-pm|offset`; the first pattern that matches the
whole text decides. The fields are then checked strictly, and the local time is moved to UTC by
the offset inside the value, else by the offset column, else by the zone of the source's clock.
Everything is a built-in expression, so the whole operator is one scan with code generation.
"""

from __future__ import annotations

from dataclasses import dataclass
from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"

_OFFSET = r"(Z|z|UTC|GMT|[+-]\d{2}:?\d{2})"
_CLOCK = r"(\d{1,2})(?::(\d{2})(?::(\d{2})(?:[.,](\d+))?)?)?(?:\s*([AaPp])\.?[Mm]\.?)?"
_CLOCK_COMPACT = r"(\d{2})(?:(\d{2})(?:(\d{2})(?:[.,](\d+))?)?)?(?:\s*([AaPp])\.?[Mm]\.?)?"
_TAIL = rf"(?:\s*{_OFFSET})?$"


@dataclass(frozen=True)
class Pattern:
    """An anchored pattern and how its groups fill the nine fields."""

    name: str
    regex: str
    fields: str


def _dated(name: str, date: str, order: str, n: int, sep: str, clock: str) -> Pattern:
    """A date of n groups, optionally followed by a clock reading and an offset."""
    y, m, d = (f"${order.index(c) + 1}" for c in "ymd")
    rest = "|".join(f"${n + i}" for i in range(1, 7))
    return Pattern(name, rf"^{date}(?:{sep}{clock})?{_TAIL}", f"{y}|{m}|{d}|{rest}")


DATETIME_CASCADE: tuple[Pattern, ...] = (
    _dated("compact", r"(\d{4})(\d{2})(\d{2})", "ymd", 3, r"[Tt ]?", _CLOCK_COMPACT),
    _dated("iso", r"(\d{4})-(\d{1,2})-(\d{1,2})", "ymd", 3, r"(?:[Tt]|\s+)", _CLOCK),
    _dated("iso_compact_clock", r"(\d{4})-(\d{1,2})-(\d{1,2})", "ymd", 3, r"(?:[Tt]|\s+)", _CLOCK_COMPACT),
    _dated("slashed", r"(\d{4})/(\d{1,2})/(\d{1,2})", "ymd", 3, r"(?:[Tt]|\s+)", _CLOCK),
    _dated("dotted", r"(\d{4})\.(\d{1,2})\.(\d{1,2})", "ymd", 3, r"(?:[Tt]|\s+)", _CLOCK),
    _dated("compact_colon_clock", r"(\d{4})(\d{2})(\d{2})", "ymd", 3, r"(?:[Tt]|\s+)", _CLOCK),
    _dated("day_month_name", r"(\d{1,2})[- ]([A-Za-z]{3})[a-z]*[- ,]+(\d{4})", "dmy", 3, r"(?:[Tt]|\s+)", _CLOCK),
    _dated("rfc_mail", r"[A-Za-z]{3,9},?\s+(\d{1,2})\s+([A-Za-z]{3})[a-z]*\s+(\d{4})", "dmy", 3, r"\s+", _CLOCK),
    _dated("month_name_first", r"([A-Za-z]{3})[a-z]*\s+(\d{1,2}),?\s+(\d{4})", "mdy", 3, r",?\s+", _CLOCK),
)

#: After the date pattern of a separate date column comes its clock reading, joined by one blank.
_COMPACT_CLOCK_AT_ONCE = rf"^{_CLOCK_COMPACT}{_TAIL}"


def clean(c: Column) -> Column:
    """Text without padding (white space and NUL at both ends); empty text becomes null."""
    t = F.btrim(c, F.lit(" \t\n\x0b\f\r\x00"))
    return F.when(F.length(t) > 0, t)


def cascade(text: Column, patterns: tuple[Pattern, ...] = DATETIME_CASCADE) -> tuple[Column, Column]:
    """(fields joined by |, name of the pattern) of the first pattern that matches, else nulls."""
    fields, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for p in reversed(patterns):
        hit = text.rlike(p.regex)
        fields = F.when(hit, F.regexp_replace(text, p.regex, p.fields)).otherwise(fields)
        name = F.when(hit, F.lit(p.name)).otherwise(name)
    return fields, name


def offset_micros(c: Column) -> Column:
    """An offset text as microseconds east of UTC; null unless well formed and within +-14 h."""
    t = F.regexp_replace(F.upper(F.trim(c)), ":", "")
    hours, minutes = F.substring(t, 2, 2).try_cast("bigint"), F.substring(t, 4, 2).try_cast("bigint")
    sign = F.when(F.substring(t, 1, 1) == "-", -1).otherwise(1)
    total = hours * 60 + minutes
    numeric = F.when(t.rlike(r"^[+-]\d{4}$") & (minutes < 60) & (total <= 14 * 60), sign * total * F.lit(60_000_000))
    return F.when(t.isin("Z", "UTC", "GMT"), F.lit(0).cast("bigint")).otherwise(numeric)


def _once(c: Column) -> Column:
    """A value computed once a row. The one-row generator keeps the optimizer from copying its whole
    expression into every predicate on it, which would multiply the cascade."""
    return F.explode(F.array(c))


def normalise_moments(
    moments: DataFrame,
    clocks: DataFrame,
    *,
    keep: list[str],
    dt: str = "dt_original",
    da: str = "da_original",
    tm: str = "tm_original",
    offset: str = "tz_offset",
    source: str = "station_id",
    zone: str = "tz_name",
    ambiguous: str = "first",
    nonexistent: str = "none",
) -> DataFrame:
    """Each reading as one instant: `keep` columns, `utc_micros`, `format`, `basis`.

    `utc_micros` is null where the reading denotes no instant. `basis` says what fixed the
    offset (`value`, `column`, `clock`) or why there is none (`empty`, `unparsed`, `no_hour`,
    `out_of_range`, `no_zone`, `nonexistent`, `ambiguous`).

    ambiguous: `first`, `second` or `none` for a local time that the clock showed twice.
    nonexistent: `none`, or `shift` (forward by the gap) for one it never showed.

    Missing minutes, seconds and fractions are zero, second 60 counts as 59, digits after
    microseconds are dropped. A non-blank `dt` decides; otherwise `da` with `tm`. Null or unknown
    sources and null, unknown or repeated zones leave a reading without offset `no_zone` (of
    repeated sources with different zones the smallest zone name counts). Empty tables give an
    empty result; other columns, whatever their names, play no part unless listed in `keep`.
    """
    if ambiguous not in ("first", "second", "none") or nonexistent not in ("none", "shift"):
        raise ValueError("unknown policy for local times")
    zones = (
        clocks.where(F.col(zone).isin(*sorted(available_timezones())) & F.col(source).isNotNull())
        .groupBy(F.col(source).alias("__source"))
        .agg(F.min(zone).alias("__zone"))
    )
    day, clock = clean(F.col(da)), clean(F.col(tm))
    # a compact clock reading of a separate column is spelt out, so that one cascade serves both
    clock = F.when(
        ~clock.contains(":") & clock.rlike(_COMPACT_CLOCK_AT_ONCE),
        F.regexp_replace(
            F.regexp_replace(clock, r"^(\d{2})(\d{2})(\d{2})", "$1:$2:$3"), r"^(\d{2})(\d{2})(?!\d|:)", "$1:$2"
        ),
    ).otherwise(clock)
    whole = F.coalesce(clean(F.col(dt)), F.concat_ws(" ", day, F.when(day.isNotNull(), clock)))
    kept = [F.col(k) for k in keep]
    text = moments.select(*kept, F.col(source).alias("__s"), clean(F.col(offset)).alias("__off"), clean(whole).alias("__text"))
    fields, name = cascade(F.col("__text"))
    split = text.select(*keep, "__s", "__off", "__text", _once(F.split(fields, r"\|")).alias("__f"), name.alias("format"))

    f = lambda i: F.get(F.col("__f"), F.lit(i))
    number = lambda i: f(i).try_cast("int")
    month_at = F.instr(F.lit(MONTHS), F.lower(f(1)))
    month = F.when(f(1).rlike(r"^\d+$"), number(1)).when((F.length(f(1)) == 3) & (month_at % 3 == 1), (month_at + 2).cast("int") / 3)
    date = F.concat_ws("-", f(0), F.lpad(month.cast("int").cast("string"), 2, "0"), F.lpad(f(2), 2, "0")).try_cast("date")
    hour = F.when(f(7) == "", number(3)).when(
        number(3).between(1, 12), number(3) % 12 + F.when(F.lower(f(7)) == "p", 12).otherwise(0)
    )
    zero = lambda i: F.when(f(i) == "", 0).otherwise(number(i))
    minute, second = zero(4), zero(5)
    micros = F.when(f(6) == "", 0).otherwise(F.rpad(F.substring(f(6), 1, 6), 6, "0").try_cast("int"))
    good = hour.between(0, 23) & minute.between(0, 59) & second.between(0, 60)
    local = F.when(
        good,
        (F.unix_date(date).cast("bigint") * 86400 + hour * 3600 + minute * 60 + F.least(second, F.lit(59))) * F.lit(1_000_000).cast("bigint")
        + micros,
    )
    own = F.when(f(8) != "", f(8))
    parsed = split.select(
        *keep, "format", "__s", "__text",
        local.alias("__local"),
        (F.col("format").isNotNull() & (f(3) == "")).alias("__no_hour"),
        own.isNotNull().alias("__has_own"), offset_micros(own).alias("__own"), offset_micros(F.col("__off")).alias("__column"),
    )
    joined = parsed.join(zones, F.col("__s") == F.col("__source"), "left")
    shown = lambda micros: F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(micros), F.col("__zone")))
    needs = F.col("__local").isNotNull() & ~F.col("__has_own") & F.col("__column").isNull() & F.col("__zone").isNotNull()
    first = F.when(needs, F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(F.col("__local")), F.col("__zone"))))
    at = joined.withColumn("__first", first).withColumn("__shown", F.when(needs, shown(F.col("__first"))))
    later = F.col("__first") + F.lit(3 * 3_600_000_000)
    second_at = F.col("__local") - (shown(later) - later)
    twice = (second_at > F.col("__first")) & (shown(second_at) == F.col("__local"))
    never = F.col("__shown") != F.col("__local")
    by_clock = F.col("__first")
    if ambiguous == "second":
        by_clock = F.when(twice, second_at).otherwise(by_clock)
    elif ambiguous == "none":
        by_clock = F.when(~F.coalesce(twice, F.lit(False)), by_clock)
    if nonexistent == "none":
        by_clock = F.when(~never, by_clock)
    utc = (
        F.when(F.col("__has_own"), F.col("__local") - F.col("__own"))
        .when(F.col("__column").isNotNull(), F.col("__local") - F.col("__column"))
        .otherwise(by_clock)
    )
    basis = (
        F.when(F.col("__text").isNull(), "empty")
        .when(F.col("format").isNull(), "unparsed")
        .when(F.col("__no_hour"), "no_hour")
        .when(F.col("__local").isNull() | (F.col("__has_own") & F.col("__own").isNull()), "out_of_range")
        .when(F.col("__has_own"), "value")
        .when(F.col("__column").isNotNull(), "column")
        .when(F.col("__zone").isNull(), "no_zone")
        .when(utc.isNotNull(), "clock")
        .when(never, "nonexistent")
        .otherwise("ambiguous")
    )
    return at.select(*keep, _once(utc).alias("utc_micros"), "format", basis.alias("basis"))


def same_instant_pairs(instants: DataFrame, *, key: str = "moment_id", group: str = "exposure_uid") -> DataFrame:
    """Pairs (smaller key first) of rows of one group with the same `utc_micros`.

    An equi-join on (group, instant), so work follows the pairs that exist; both sides read one
    exchange, and a hot group is split by the adaptive skew join. Rows whose group or instant is
    null pair with nothing; rows with equal keys don't pair with each other.
    """
    base = instants.where(F.col(group).isNotNull() & F.col("utc_micros").isNotNull()).select(key, group, "utc_micros")
    # a merge join reads the one exchange twice; a broadcast of either side would parse all rows twice
    a, b = base.hint("merge").alias("a"), base.alias("b")
    return a.join(
        b,
        (F.col(f"a.{group}") == F.col(f"b.{group}"))
        & (F.col("a.utc_micros") == F.col("b.utc_micros"))
        & (F.col(f"a.{key}") < F.col(f"b.{key}")),
    ).select(F.col(f"a.{key}").alias(f"{key}_a"), F.col(f"b.{key}").alias(f"{key}_b"))
