"""Presentation values: recency, trend, status bands, short numbers, initials."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pkgatlas import fixed
from pkgatlas.functions.scoring import _upto


def _half_up(value: Column) -> Column:
    return F.floor(value + 0.5).cast("long").cast("string")


def one_decimal(value: Column) -> Column:
    """One decimal, exact ties away from zero (the formatter itself rounds ties to even)."""
    tie = F.abs(value) - F.floor(F.abs(value)) == 0.25
    lifted = F.when(tie, value + F.signum(value) * 0.05).otherwise(value)
    return F.call_function("format_number", lifted, F.lit("0.0"))


def recency_text(days: Column, style: str = "table") -> Column:
    """Age of the last release; styles ``table``, ``comparison`` and ``deep_dive``."""
    # FIXED VALUES: bands and labels of the three views
    if style == "table":
        return (
            F.when(days <= 7, "This week")
            .when(days <= 30, F.concat(_half_up(days / 7), F.lit(" weeks ago")))
            .when(days <= 365, F.concat(_half_up(days / 30), F.lit(" months ago")))
            .otherwise(F.concat(_half_up(days / 365), F.lit(" years ago")))
        )
    if style == "comparison":
        return (
            F.when(days <= 1, "Today")
            .when(days <= 7, F.concat(days.cast("string"), F.lit("d ago")))
            .when(days <= 30, F.concat(_half_up(days / 7), F.lit("w ago")))
            .when(days <= 365, F.concat(_half_up(days / 30), F.lit("mo ago")))
            .otherwise(F.concat(one_decimal(days / 365), F.lit("yr ago")))
        )
    if style == "deep_dive":
        return (
            F.when(days <= 30, "Recent")
            .when(days <= 180, F.concat(_half_up(days / 30), F.lit("mo ago")))
            .otherwise(F.concat(_half_up(days / 365), F.lit("yr ago")))
        )
    raise ValueError(f"unknown style {style!r}")


def recency_status(days: Column) -> Column:
    return _upto(days, fixed.RECENCY_STATUS, fixed.RECENCY_STATUS_FLOOR)


def trend_direction(growth: Column) -> Column:
    growth = F.coalesce(growth, F.lit(0.0))
    return (
        F.when(growth > fixed.TREND_BAND, "up")
        .when(growth < -fixed.TREND_BAND, "down")
        .otherwise("neutral")
    )


def band_status(value: Column, bands: tuple[int, int]) -> Column:
    value = F.coalesce(value, F.lit(0))
    return F.when(value > bands[0], "green").when(value > bands[1], "amber").otherwise("red")


def grouped_number(value: Column) -> Column:
    """Whole number with thousands separators."""
    return F.format_number(F.coalesce(value, F.lit(0)), 0)


def abbreviate(value: Column, thousand_digits: int = 1) -> Column:
    """1.2M / 3.4k / 567; charts pass ``thousand_digits=0``."""
    thousands = (
        one_decimal(value / 1_000) if thousand_digits else _half_up(value / 1_000)
    )
    return (
        F.when(value >= 1_000_000, F.concat(one_decimal(value / 1_000_000), F.lit("M")))
        .when(value >= 1_000, F.concat(thousands, F.lit("k")))
        .otherwise(value.cast("string"))
    )


def initials(name: Column) -> Column:
    """First letters of the first two words, or the first two letters of a single word."""
    words = F.split(F.translate(name, "-_", "  "), " ")
    two = F.concat(
        F.substring(F.get(words, F.lit(0)), 1, 1), F.substring(F.get(words, F.lit(1)), 1, 1)
    )
    return F.upper(F.when(F.size(words) >= 2, two).otherwise(F.substring(name, 1, 2)))
