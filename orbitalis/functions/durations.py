"""Durations such as 1h, 2.5d or 1y as days, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days in a unit: an exact set, and one with rounded hours and with months (fixed values).
EXACT = {"h": 1 / 24, "d": 1.0, "y": 365.25}
ROUNDED = {"h": 0.0416667, "d": 1.0, "m": 30.4167, "y": 365.25}


def parse_duration(text: Column, units: dict[str, float] = EXACT) -> Column:
    """Days; a bare number is days; null for anything else."""
    t = F.lower(F.trim(text))
    number = F.regexp_extract(t, r"^([+-]?[0-9]*\.?[0-9]+(?:e[+-]?[0-9]+)?)\s*([a-z]?)$", 1)
    unit = F.regexp_extract(t, r"^([+-]?[0-9]*\.?[0-9]+(?:e[+-]?[0-9]+)?)\s*([a-z]?)$", 2)
    factor = F.when(unit == "", 1.0)
    for name, days in units.items():
        factor = factor.when(unit == name, days)
    return F.when(number != "", F.expr("1.0") * number.try_cast("double") * factor)


def format_duration(days: Column) -> Column:
    """The largest unit in which the duration is at least 1."""
    return (
        F.when(F.abs(days) >= 365.25, F.concat(F.format_number(days / 365.25, 2), F.lit("y")))
        .when(F.abs(days) >= 1, F.concat(F.format_number(days, 2), F.lit("d")))
        .otherwise(F.concat(F.format_number(days * 24, 2), F.lit("h")))
    )
