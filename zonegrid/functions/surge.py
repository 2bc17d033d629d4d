"""Prediction decorations (F9-F12, F16) as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed


def surge_level(der: Column) -> Column:
    """Level label; NULL stays NULL (instead of falling to the top level)."""
    expr = F.when(der.isNull(), F.lit(None).cast("string"))
    for upper, label in fixed.SURGE_LEVELS:
        expr = expr.when(der < upper, F.lit(label))
    return expr.otherwise(F.lit(fixed.SURGE_TOP_LEVEL))


def recommendation(der: Column, precip: Column) -> Column:
    """Advice text; the rain suffix is only added in the high-surge branch."""
    expr = F.when(der.isNull(), F.lit(None).cast("string"))
    last = len(fixed.RECOMMENDATIONS) - 1
    for i, (upper, text) in enumerate(fixed.RECOMMENDATIONS):
        value = F.lit(text)
        if i == last:
            value = F.when(precip > fixed.RAIN_PRECIP_ABOVE,
                           F.concat(F.lit(text), F.lit(fixed.RAIN_SUFFIX))).otherwise(F.lit(text))
        expr = expr.when(der < upper, value)
    return expr.otherwise(F.lit(fixed.RECOMMENDATION_TOP))


def percent_text(x: Column) -> Column:
    """``f"{x:.0%}"``: half-to-even rounding of x*100, then '%'."""
    return F.concat(F.bround(x * 100, 0).cast("int").cast("string"), F.lit("%"))


def factor_tags(precip: Column, hour: Column, velocity: Column, elasticity: Column) -> Column:
    """Key-factor tags shown next to a prediction (array<string>, in display order)."""
    return F.array_compact(F.array(
        F.when(precip > fixed.RAIN_PRECIP_ABOVE, F.lit(fixed.TAG_RAIN)),
        F.when(hour.between(7, 9), F.lit(fixed.TAG_MORNING_RUSH)),
        F.when(hour.between(17, 19), F.lit(fixed.TAG_EVENING_RUSH)),
        F.when(velocity > fixed.HIGH_VELOCITY_ABOVE, F.lit(fixed.TAG_HIGH_VELOCITY)),
        F.when(elasticity < fixed.LOW_SUPPLY_BELOW, F.lit(fixed.TAG_LOW_SUPPLY)),
    ))


def confidence_from_std(std: Column, n_trees: Column) -> Column:
    """1/(1+std) clamped to [0.15, 0.98]; one tree -> 0.85; no value -> 0.80."""
    conf = F.least(F.greatest(1.0 / (1.0 + std), F.lit(fixed.CONFIDENCE_MIN)),
                   F.lit(fixed.CONFIDENCE_MAX))
    return (F.when(n_trees <= 1, F.lit(fixed.CONFIDENCE_ONE_TREE))
            .when(std.isNull() | F.isnan(std), F.lit(fixed.CONFIDENCE_ON_FAILURE))
            .otherwise(conf))
