"""Timestamps of mixed formats, precisions and zones brought to one UTC instant (microseconds since 1970).

An ordered cascade of anchored patterns; the first pattern that matches decides, and a value that matches none, or whose
fields are out of range, is unreadable (null). All of it is column expressions, so the work stays in code generation.

Policies: a wall time that occurs twice (clocks set back) is the first one; a wall time that is skipped (clocks set
forward) is read with the offset valid before the jump; digits finer than a microsecond are cut; missing ones are 0.
"""

from __future__ import annotations

import zoneinfo
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.guards import once

# Zone abbreviations in their US, European, Japanese or Australian meaning, as minutes east of Greenwich.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "UT": 0, "GMT": 0,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600,
    "WET": 0, "WEST": 60, "BST": 60, "IST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "JST": 540, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660,
}
# English month names, first three letters.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_ZONE = r"\s*(z|[+-]\d{2}(?::?\d{2})?|[a-z]{2,5})?(?:\s*\[([A-Za-z0-9_+/-]+)\])?"
_HALF = r"\s*(am|pm)?"
_DAY_NAME = r"(?:[a-z]{3,9},?\s+)?"
#: Patterns in order, each with the form that its groups are rewritten to: kind | year | month, week | day | hour | minute |
#: second | fraction | half of the day | zone or offset | region.
PATTERNS: list[tuple[str, str]] = [
    (rf"(?i)^(\d{{4}})-(\d{{2}})-(\d{{2}})[t ]\s*{_CLOCK}{_ZONE}$", "ymd|$1|$2|$3|$4|$5|$6|$7||$8|$9"),
    (rf"(?i)^(\d{{4}})(\d{{2}})(\d{{2}})t(\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d+))?)?{_ZONE}$", "ymd|$1|$2|$3|$4|$5|$6|$7||$8|$9"),
    (rf"(?i)^(\d{{4}})-?w(\d{{2}})-?(\d)t{_CLOCK}{_ZONE}$", "week|$1|$2|$3|$4|$5|$6|$7||$8|$9"),
    (rf"(?i)^(\d{{4}})-(\d{{3}})t{_CLOCK}{_ZONE}$", "ordinal|$1||$2|$3|$4|$5|$6||$7|$8"),
    (rf"(?i)^{_DAY_NAME}(\d{{1,2}})\s+([a-z]{{3}})[a-z]*\.?\s+(\d{{4}})\s+{_CLOCK}{_ZONE}$", "name|$3|$2|$1|$4|$5|$6|$7||$8|$9"),
    (rf"(?i)^{_DAY_NAME}([a-z]{{3}})[a-z]*\.?\s+(\d{{1,2}}),?\s+(\d{{4}}),?\s+{_CLOCK}{_HALF}{_ZONE}$", "name|$3|$1|$2|$4|$5|$6|$7|$8|$9|$10"),
    (rf"(?i)^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}),?\s+{_CLOCK}{_HALF}{_ZONE}$", "ymd|$3|$1|$2|$4|$5|$6|$7|$8|$9|$10"),
    (rf"(?i)^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),?\s+{_CLOCK}{_ZONE}$", "ymd|$3|$2|$1|$4|$5|$6|$7||$8|$9"),
]
_NUMBER = r"(?i)^[+-]?\d+(?:\.\d+)?(?:e\+?\d{1,2})?$"


@cache
def region_names() -> list[str]:
    """Region zones known to this machine; others count as no zone."""
    return sorted(z for z in zoneinfo.available_timezones() if z != "localtime")


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _epoch_micros(s: Column) -> Column:
    """Bare numbers: seconds, milli- or microseconds, told apart by size."""
    n = s.try_cast("decimal(38,9)")
    size = F.abs(n)
    scale = F.when(size < 100_000_000_000, 1_000_000).when(size < 100_000_000_000_000, 1_000).when(size < 100_000_000_000_000_000, 1)
    return F.when(s.rlike(_NUMBER), F.floor(n.cast("decimal(28,9)") * scale).cast("bigint"))


def _date(kind: Column, y: Column, m: Column, d: Column) -> Column:
    """Date of the fields, null if there is no such day. ``m`` is a month's number or name, or a week; ``d`` the day of it or of the year."""
    year, day, number = _int(y), _int(d), _int(m)
    year = F.when(year.between(1, 9999), year)
    monday = F.date_trunc("week", F.make_date(year, F.lit(1), F.lit(4))).cast("date")
    of_week = F.date_add(monday, (number - 1) * 7 + day - 1)
    of_week = F.when(number.between(1, 53) & day.between(1, 7) & (F.weekofyear(of_week) == number), of_week)
    of_year = F.date_add(F.make_date(year, F.lit(1), F.lit(1)), day - 1)
    of_year = F.when((day >= 1) & (F.year(of_year) == year), of_year)
    month = F.when(kind == "name", F.array_position(F.array(*map(F.lit, MONTHS)), m).cast("int")).otherwise(number)
    month = F.when(month.between(1, 12), month)
    last = F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1))))
    of_month = F.when(day.between(1, 31) & (day <= last), day)
    return F.when(kind == "week", of_week).when(kind == "ordinal", of_year).otherwise(F.make_date(year, month, of_month))


def with_utc_micros(df: DataFrame, raw: Column, default_zone: Column | None = None, out: str = "utc_us") -> DataFrame:
    """``df`` with the UTC instant of a raw value in microseconds since 1970, BIGINT; null if it states none.

    ``default_zone`` is the region zone of values that name none; null or unknown counts as UTC. Null, empty and
    blank values, words and impossible dates give null. Each step is a projection of its own, so that the planner
    evaluates a pattern once a row and not once a use.
    """
    text, parts, day, zone = (f"__instant_{x}" for x in ("text", "parts", "day", "zone"))
    cleaned = F.regexp_replace(F.regexp_replace(raw, "[\\s\u00a0\u1680\u2000-\u200b\u202f\u205f\u3000\ufeff]+", " "), "[\u2212\u2010\u2011\u2013]", "-")
    df = df.withColumns({text: F.trim(cleaned), zone: F.lit(None).cast("string") if default_zone is None else default_zone})
    s = F.col(text)
    form = F.lit(None).cast("string")
    for pattern, rewritten in reversed(PATTERNS):
        form = F.when(s.rlike(pattern), F.regexp_replace(s, pattern, rewritten)).otherwise(form)
    df = df.withColumn(parts, once(F.split(form, r"\|", -1)))
    kind, y, m, d, h, mi, sec, frac, half, z, region = (F.col(parts)[i] for i in range(11))
    m, half, z = F.lower(m), F.lower(half), F.lower(z)
    df = df.withColumn(day, F.datediff(_date(kind, y, m, d), F.lit("1970-01-01").cast("date")).cast("bigint"))
    number = lambda c: _int(F.when(c == "", "0").otherwise(c))
    hour, minute, second = number(h), number(mi), number(sec)
    micros = F.substring(F.rpad(frac, 6, "0"), 1, 6).cast("int")
    ok = F.when(half != "", hour.between(1, 12)).otherwise(hour <= 23) & (minute <= 59) & (second <= 59)
    hour = F.when(half != "", hour % 12 + F.when(half == "pm", 12).otherwise(0)).otherwise(hour)
    local = ((F.col(day) * 24 + hour) * 60 + minute) * 60 + second
    names = F.create_map(*(F.lit(x) for k, v in ABBREVIATIONS.items() for x in (k.lower(), v)))
    digits = F.rpad(F.regexp_replace(z, "[^0-9]", ""), 4, "0")
    minutes = F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")
    offset = F.when(z.rlike("^[+-]"), F.when(z.startswith("-"), -minutes).otherwise(minutes)).otherwise(F.try_element_at(names, z))
    stated_offset = F.when(F.abs(offset) <= 18 * 60, offset)
    own_zone = F.when(region != "", region)
    zone_id = F.coalesce(own_zone, F.trim(F.col(zone)))
    zone_id = F.when(zone_id.isin(region_names()), zone_id).otherwise("UTC")
    by_region = F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(local), zone_id))
    seconds = F.when(z != "", local - stated_offset * 60).otherwise(by_region)
    stated = F.when(ok, seconds * 1_000_000 + micros)
    return df.withColumn(out, once(F.coalesce(stated, _epoch_micros(s)))).drop(text, parts, day, zone)
