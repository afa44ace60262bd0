"""Health score, risks, growth and age as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pkgatlas import fixed


def _upto(value: Column, bands: Sequence[tuple[int, object]], floor: object) -> Column:
    """First band whose upper edge the value does not pass."""
    result = None
    for edge, out in bands:
        result = (
            F.when(value <= edge, F.lit(out)) if result is None else result.when(value <= edge, F.lit(out))
        )
    return result.otherwise(F.lit(floor))


def _atleast(value: Column, bands: Sequence[tuple[int, object]], floor: object) -> Column:
    """First band whose lower edge the value reaches."""
    result = None
    for edge, out in bands:
        result = (
            F.when(value >= edge, F.lit(out)) if result is None else result.when(value >= edge, F.lit(out))
        )
    return result.otherwise(F.lit(floor))


def health_score(
    dependents: Column,
    stars: Column,
    days: Column,
    versions: Column,
    weights: Mapping[str, float] = fixed.SCORE_WEIGHTS,
) -> Column:
    """0-100. Missing inputs count as 0, a missing age as the oldest."""
    zero, one, hundred = F.lit(0), F.lit(1), F.lit(100.0)

    def log_part(value: Column, factor: int) -> Column:
        return F.least(hundred, F.log10(F.greatest(F.coalesce(value, zero), one) + 1) * factor)

    maintenance = _upto(
        F.coalesce(days, F.lit(fixed.UNKNOWN_DAYS)), fixed.MAINTENANCE_BANDS, fixed.MAINTENANCE_FLOOR
    )
    maturity = F.least(hundred, (F.coalesce(versions, zero) * fixed.MATURITY_PER_VERSION).cast("double"))
    score = (
        log_part(dependents, fixed.ADOPTION_FACTOR) * weights["adoption"]
        + maintenance * F.lit(weights["maintenance"])
        + maturity * weights["maturity"]
        + log_part(stars, fixed.COMMUNITY_FACTOR) * weights["community"]
    )
    return F.least(F.lit(100), F.greatest(F.lit(0), score.cast("int")))


def score_label(score: Column) -> Column:
    return _atleast(score, fixed.SCORE_LABELS, fixed.SCORE_LABEL_FLOOR)


def score_color(score: Column) -> Column:
    return _atleast(score, fixed.SCORE_COLORS, fixed.SCORE_COLOR_FLOOR)


def risk_level(score: Column) -> Column:
    """Below 40 high, below 70 moderate."""
    result = None
    for edge, out in fixed.RISK_LEVELS:
        hit = score < edge
        result = F.when(hit, out) if result is None else result.when(hit, out)
    return result.otherwise(fixed.RISK_LEVEL_CEILING)


def risk_flags(days: Column, dependents: Column, stars: Column, versions: Column) -> Column:
    """Array of risk texts; both age risks fire on a very old release."""
    days = F.coalesce(days, F.lit(fixed.UNKNOWN_DAYS))
    return F.array_compact(
        F.array(
            F.when(days > 365, fixed.RISK_STALE_1Y),
            F.when(days > 730, fixed.RISK_STALE_2Y),
            F.when(F.coalesce(dependents, F.lit(0)) < 10, fixed.RISK_ADOPTION),
            F.when(F.coalesce(stars, F.lit(0)) < 50, fixed.RISK_COMMUNITY),
            F.when(F.coalesce(versions, F.lit(0)) < 3, fixed.RISK_RELEASES),
        )
    )


def iso_timestamp(text: Column) -> Column:
    """Timestamp of an ISO text, null if it does not start with a full date."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(text))


def days_since(release: Column, as_of: str) -> Column:
    """Whole days (floor) from an ISO text to ``as_of``; 9999 when missing or unreadable."""
    micros = F.unix_micros(F.to_timestamp(F.lit(as_of))) - F.unix_micros(iso_timestamp(release))
    return F.coalesce(
        F.floor(micros / F.lit(86_400_000_000)).cast("int"), F.lit(fixed.UNKNOWN_DAYS)
    )


def growth_pct(current: Column, prior: Column) -> Column:
    """Year-over-year growth in percent; null when there is no prior value or it is 0."""
    return F.try_divide((current - prior) * F.lit(100.0), prior.cast("double"))


def growth_score(growth: Column, dependents: Column, at_least: int = 0) -> Column:
    """``growth * ln(dependents + 1)``; ``at_least=1`` lifts the count to one first."""
    count = F.coalesce(dependents, F.lit(0))
    if at_least:
        count = F.greatest(count, F.lit(at_least))
    return F.coalesce(growth, F.lit(0.0)) * F.ln(count + 1)


def blended_score(
    similarity: Column,
    dependents: Column,
    growth: Column,
    weights: Mapping[str, float] = fixed.BLEND_WEIGHTS,
) -> Column:
    """Similarity, popularity (log of dependents) and growth, each scaled to 0-1."""
    popularity = F.least(F.lit(1.0), F.log10(F.coalesce(dependents, F.lit(0)) + 1) / 5)
    rising = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(growth, F.lit(0.0)) / 100))
    return (
        similarity * weights["similarity"]
        + popularity * weights["popularity"]
        + rising * weights["growth"]
    )
