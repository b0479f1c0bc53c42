"""English texts for durations, lengths, speeds and items."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold.schemas import DISPLAY_NAMES

_UNITS = ((30 * 86400, "month"), (86400, "day"), (3600, "hour"), (60, "minute"), (1, "second"))


def plural(n: Column, unit: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"))


def duration(seconds: Column) -> Column:
    """The two largest units of a duration; seconds only below three minutes."""
    whole = F.floor(seconds).cast("long")
    parts, rest = [], whole
    for size, unit in _UNITS:
        n = F.floor(rest / size).cast("long")
        shown = (n > 0) & (whole < 180) if unit == "second" else n > 0
        parts.append(F.when(shown, plural(n, unit)))
        rest = rest % size
    first_two = F.slice(F.array_compact(F.array(*parts)), 1, 2)
    return F.when(F.isnan(seconds), "NaN").when(F.size(first_two) == 0, F.when(whole < 180, "0 seconds").otherwise("0 minutes")).otherwise(F.array_join(first_two, ", "))


def metres(m: Column) -> Column:
    """Metres below 1 km, else kilometres, with a decimal from 1 to 20 km."""
    return F.when(m < 1000, F.format_string("%.0f m", m)).when(m <= 20000, F.format_string("%.1f km", m / 1000)).otherwise(F.format_string("%.0f km", m / 1000))


def speed(mps: Column) -> Column:
    kmh = mps * 3.6
    return F.when(kmh < 10, F.format_string("%.1f km/h", kmh)).otherwise(F.format_string("%.0f km/h", kmh))


def display_name(kind: Column) -> Column:
    out = kind
    for name, shown in DISPLAY_NAMES.items():
        out = F.when(kind == name, shown).otherwise(out)
    return out


def title(is_visit: Column, is_gap: Column, keeper: Column, kind: Column) -> Column:
    """Visit or Brief Stop; Data Gap; or a path's type with a capital, Unknown without one."""
    shown = display_name(kind)
    path = F.concat(F.upper(F.substring(shown, 1, 1)), F.substring(shown, 2, 100))
    return F.when(is_visit, F.when(keeper, "Visit").otherwise("Brief Stop")).when(is_gap, "Data Gap").otherwise(F.coalesce(path, F.lit("Unknown")))
