"""Granularities, calendar rounding and stepping, all as Spark column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000
SECOND, MINUTE, HOUR, DAY, WEEK = MICROS, 60 * MICROS, 3600 * MICROS, 86400 * MICROS, 7 * 86400 * MICROS


@dataclass(frozen=True)
class Granularity:
    """Step of a time grid.

    kind ``fixed``: n microseconds; ``month``: n calendar months; ``month_end``: n month ends;
    ``business``: n weekdays (Monday to Friday).
    """

    kind: str
    n: int

    def __post_init__(self):
        if self.kind not in ("fixed", "month", "month_end", "business"):
            raise ValueError(f"unknown granularity kind {self.kind!r}")
        if self.n <= 0:
            raise ValueError("a granularity must be positive")

    def times(self, k: int) -> "Granularity":
        return Granularity(self.kind, self.n * k)

    def to_dict(self) -> dict:
        return {"kind": self.kind, "n": self.n}

    @classmethod
    def from_dict(cls, data: dict) -> "Granularity":
        return cls(data["kind"], int(data["n"]))


# Names of units and their calendar or clock length.
UNIT_LENGTH = {
    "year": Granularity("month", 12),
    "half_year": Granularity("month", 6),
    "quarter": Granularity("month", 3),
    "month": Granularity("month", 1),
    "week": Granularity("fixed", WEEK),
    "day": Granularity("fixed", DAY),
    "hour": Granularity("fixed", HOUR),
    "minute": Granularity("fixed", MINUTE),
    "second": Granularity("fixed", SECOND),
}
#: Words that may stand before any unit and do not change its length (fixed values).
PREFIXES = ("calendar", "year", "fiscal", "fy")
# Short frequency codes that are no unit names.
CODES = {
    "MS": Granularity("month", 1), "QS": Granularity("month", 3), "YS": Granularity("month", 12),
    "M": Granularity("month_end", 1), "Q": Granularity("month_end", 3), "Y": Granularity("month_end", 12),
    "A": Granularity("month_end", 12), "B": Granularity("business", 1), "W": Granularity("fixed", WEEK),
    "D": Granularity("fixed", DAY), "H": Granularity("fixed", HOUR), "min": Granularity("fixed", MINUTE),
    "s": Granularity("fixed", SECOND),
}
_NUMBERED = re.compile(r"^(\d+)\s*(.+?)$")


def _unit(name: str) -> Granularity | None:
    """A unit, or any prefix and a unit, with blanks or underscores between words."""
    name = name.replace(" ", "_")
    head, _, tail = name.partition("_")
    return UNIT_LENGTH.get(name) or (UNIT_LENGTH.get(tail) if head in PREFIXES else None)


def parse_granularity(text: str | Granularity) -> Granularity:
    """``'day'``, ``'calendar month'``, ``'3 months'``, ``'QS'``, ``'15min'`` … to a Granularity."""
    if isinstance(text, Granularity):
        return text
    if text in CODES:
        return CODES[text]
    name = text.strip().lower()
    found = _unit(name)
    if found:
        return found
    numbered = _NUMBERED.match(text.strip())
    if numbered:
        count, rest = int(numbered.group(1)), numbered.group(2)
        unit = CODES.get(rest) or _unit(rest.lower()) or (_unit(rest.lower()[:-1]) if rest.lower().endswith("s") else None)
        if unit:
            return unit.times(count)
    raise ValueError(f"unknown granularity {text!r}")


def frequency_granularity(name: str) -> Granularity:
    """Granularity of a named forecasting frequency (hourly, daily, … yearly)."""
    key = name.lower()
    # fixed values: the names of forecasting frequencies
    if key not in ("hourly", "daily", "weekly", "monthly", "quarterly", "yearly"):
        raise ValueError(f"unknown frequency {name!r}")
    return parse_granularity("day" if key == "daily" else key[:-2])


def ntz(col: Column | str) -> Column:
    return F.col(col).cast("timestamp_ntz") if isinstance(col, str) else col.cast("timestamp_ntz")


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch of a timestamp column (session zone UTC)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(value: Column) -> Column:
    return F.timestamp_micros(value.cast("long")).cast("timestamp_ntz")


def to_int_scale(ts: Column | str, t0: str = "1970-01-01", unit: str | Granularity = "second") -> Column:
    """Position on the integer time scale ``floor((ts - t0) / unit)``."""
    step = parse_granularity(unit)
    if step.kind != "fixed":
        raise ValueError("the integer scale needs a fixed unit")
    return F.floor((micros(ts) - micros(F.lit(t0).cast("timestamp_ntz"))) / F.lit(step.n)).cast("long")


def from_int_scale(value: Column, t0: str = "1970-01-01", unit: str | Granularity = "second") -> Column:
    step = parse_granularity(unit)
    return from_micros(micros(F.lit(t0).cast("timestamp_ntz")) + value.cast("long") * F.lit(step.n))


def trunc_grain(ts: Column | str, grain: str) -> Column:
    """Grain truncation (second … year), kept as timestamp without zone."""
    return F.date_trunc(grain.lower(), F.col(ts) if isinstance(ts, str) else ts).cast("timestamp_ntz")


_WEEKDAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")


def round_calendar(ts: Column | str, freq: str) -> Column:
    """Round to a frequency: period starts (MS QS YS), period ends (M Q Y A), week days, else floor."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    if freq == "MS":
        out = F.trunc(ts, "month")
    elif freq == "QS":
        out = F.trunc(ts, "quarter")
    elif freq == "YS":
        out = F.trunc(ts, "year")
    elif freq == "M":
        out = F.last_day(ts)
    elif freq == "Q":
        out = F.last_day(F.add_months(F.trunc(ts, "quarter"), 2))
    elif freq in ("Y", "A"):
        out = F.make_date(F.year(ts), F.lit(12), F.lit(31))
    elif freq == "W" or (freq.startswith("W-") and freq[2:] in _WEEKDAYS):
        day = 6 if freq == "W" else _WEEKDAYS.index(freq[2:])
        date = ts.cast("date")
        out = F.date_sub(date, F.pmod(F.weekday(date) - F.lit(day), F.lit(7)))
    else:
        step = parse_granularity(freq)
        if step.kind != "fixed":
            raise ValueError(f"cannot floor to {freq!r}")
        return from_micros(micros(ts) - F.pmod(micros(ts), F.lit(step.n)))
    return out.cast("timestamp_ntz")


def step_from(ts: Column | str, k: Column, gran: Granularity) -> Column:
    """The timestamp ``k`` grid steps after ``ts``. Month steps are anchored at ``ts``."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    if gran.kind == "fixed":
        return from_micros(micros(ts) + k.cast("long") * F.lit(gran.n))
    if gran.kind == "month":
        return (ts.cast("timestamp_ntz") + F.make_ym_interval(F.lit(0), (k * F.lit(gran.n)).cast("int")))
    if gran.kind == "month_end":
        shifted = F.add_months(F.trunc(ts, "month"), (k * F.lit(gran.n)).cast("int"))
        return F.last_day(shifted).cast("timestamp_ntz")
    # business: move to Monday-based week arithmetic; weekends count as the Friday before
    total = F.least(F.weekday(ts.cast("date")), F.lit(4)) + k * F.lit(gran.n)
    monday = F.date_sub(ts.cast("date"), F.weekday(ts.cast("date")))
    day = F.date_add(monday, (F.floor(total / 5) * 7 + F.pmod(total, F.lit(5))).cast("int"))
    return (day.cast("timestamp_ntz") + (ts.cast("timestamp_ntz") - F.date_trunc("day", ts).cast("timestamp_ntz")))


def steps_between(lo: Column, hi: Column, gran: Granularity) -> Column:
    """Number of whole grid steps from ``lo`` to ``hi`` (an upper bound for month-like grids)."""
    if gran.kind == "fixed":
        return F.floor((micros(hi) - micros(lo)) / F.lit(gran.n)).cast("long")
    if gran.kind == "business":
        days = F.datediff(hi.cast("date"), lo.cast("date"))
        return F.floor(days / F.lit(gran.n)).cast("long")
    months = (F.year(hi) - F.year(lo)) * 12 + F.month(hi) - F.month(lo)
    return F.floor(months / F.lit(gran.n)).cast("long")


def grid_points(lo: Column, hi: Column, gran: Granularity) -> Column:
    """Array of grid timestamps from ``lo`` to ``hi``, both ends included where on the grid."""
    steps = F.sequence(F.lit(0).cast("long"), steps_between(lo, hi, gran))
    points = F.transform(steps, lambda k: step_from(lo, k, gran))
    return F.filter(points, lambda t: t <= hi)


def on_grid(lo: Column, ts: Column, gran: Granularity) -> Column:
    """Whether ``ts`` lies on the grid that starts at ``lo``, by arithmetic alone."""
    if gran.kind == "fixed":
        return F.pmod(micros(ts) - micros(lo), F.lit(gran.n)) == 0
    if gran.kind == "business":
        count = lambda t: F.floor(F.datediff(t.cast("date"), F.lit("1970-01-05").cast("date")) / 7) * 5 + F.weekday(t.cast("date"))
        same_clock = (ts.cast("timestamp_ntz") - F.date_trunc("day", ts).cast("timestamp_ntz")) == (
            lo.cast("timestamp_ntz") - F.date_trunc("day", lo).cast("timestamp_ntz"))
        return (F.weekday(ts.cast("date")) < 5) & (F.pmod(count(ts) - count(lo), F.lit(gran.n)) == 0) & same_clock
    months = (F.year(ts) - F.year(lo)) * 12 + F.month(ts) - F.month(lo)
    return (F.pmod(months, F.lit(gran.n)) == 0) & (step_from(lo, F.floor(months / gran.n), gran) == ts.cast("timestamp_ntz"))
