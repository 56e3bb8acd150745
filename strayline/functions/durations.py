"""Durations between text such as ``1h 2min`` and seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds per unit.
SECONDS_PER_UNIT = {
    "d": 86400.0,
    "h": 3600.0,
    "min": 60.0,
    "s": 1.0,
    "ms": 1e-3,
    "us": 1e-6,
    "µs": 1e-6,
    "μs": 1e-6,
    "ns": 1e-9,
}

_QUANTITY = r"([0-9]+(?:\.[0-9]+)?(?:e[+-]?[0-9]+)?)\s*([a-z\x{00b5}\x{03bc}]+)"


def to_seconds(text: Column | str) -> Column:
    """Sum of all quantities in the text; NULL for an unknown unit or no quantity."""
    column = F.col(text) if isinstance(text, str) else text
    units = F.create_map(*[F.lit(v) for pair in SECONDS_PER_UNIT.items() for v in pair])
    numbers = F.regexp_extract_all(column, F.lit(_QUANTITY), F.lit(1))
    names = F.regexp_extract_all(column, F.lit(_QUANTITY), F.lit(2))
    parts = F.zip_with(numbers, names, lambda n, u: n.try_cast("double") * F.try_element_at(units, u))
    total = F.aggregate(parts, F.lit(0.0), lambda acc, part: acc + part)
    return F.when(column.rlike(_QUANTITY), total)


def _nearest(value: Column, digits: int) -> Column:
    """The value in units of the last digit, rounded by what the double holds, ties to even.

    ``F.round`` and ``%.2f`` go by the shortest decimal instead: 1.295 is below the tie. The high
    half of the value's bits and the rest are multiplied without rounding.
    """
    units = F.floor(value * 10.0**digits).cast("double")
    high = value * 134217729.0 - (value * 134217729.0 - value)
    beyond = (high * (2 * 10.0**digits) - (units * 2 + 1)) + (value - high) * (2 * 10.0**digits)
    return units + F.when((beyond > 0) | ((beyond == 0) & (units % 2 == 1)), 1.0).otherwise(0.0)


def _three_digits(value: Column) -> Column:
    """Three significant digits without closing zeros, for values from 0.0001 up."""
    def fixed(digits: int) -> Column:
        shown = F.format_string(f"%.{digits}f", _nearest(value, digits) / 10.0**digits)
        bare = F.regexp_replace(shown, r"0+$", "") if digits else shown
        return F.regexp_replace(bare, r"\.$", "")

    # A value that is rounded up to the next power of ten loses its zeros.
    return (
        F.when(value >= 999.5, F.lit("1e+03"))
        .when(value >= 100, fixed(0))
        .when(value >= 10, fixed(1))
        .when(value >= 1, fixed(2))
        .when(value >= 0.1, fixed(3))
        .when(value >= 0.01, fixed(4))
        .when(value >= 0.001, fixed(5))
        .when(value > 0, fixed(6))
        .otherwise(F.lit("0"))
    )


def to_text(seconds: Column | str) -> Column:
    """Readable text: ``d h min s`` from a minute up, else three digits and a unit.

    Spans below 0.0001 ns are shown with six decimals.
    """
    span = F.col(seconds) if isinstance(seconds, str) else seconds
    days = F.floor(span / 86400)
    hours = F.floor(F.pmod(span, F.lit(86400.0)) / 3600)
    minutes = F.floor(F.pmod(span, F.lit(3600.0)) / 60)
    rest = F.floor(F.pmod(span, F.lit(60.0)))
    long_parts = [
        F.when(part > 0, F.concat(part.cast("string"), F.lit(unit)))
        for part, unit in ((days, "d"), (hours, "h"), (minutes, "min"), (rest, "s"))
    ]
    short = (
        F.when(span >= 1, F.concat(_three_digits(span), F.lit(" s")))
        .when(span >= 1e-3, F.concat(_three_digits(span * 1e3), F.lit(" ms")))
        .when(span >= 1e-6, F.concat(_three_digits(span * 1e6), F.lit(" µs")))
        .otherwise(F.concat(_three_digits(span * 1e9), F.lit(" ns")))
    )
    return F.when(span >= 60, F.concat_ws(" ", *long_parts)).otherwise(short)
