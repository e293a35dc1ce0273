"""Unit conversion and reading status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Internal feet to metric, with the unit label.
UNIT_FACTORS = {
    "length": (304.8, "мм"),
    "area": (0.09290304, "м²"),
    "volume": (0.028316846592, "м³"),
}


def to_unit(df: DataFrame, value: str, spec: str) -> DataFrame:
    """Add value, unit and status: length in mm, area in m², volume in m³."""
    factors = F.create_map(*[F.lit(x) for s, (f, _) in UNIT_FACTORS.items() for x in (s, f)])
    labels = F.create_map(*[F.lit(x) for s, (_, u) in UNIT_FACTORS.items() for x in (s, u)])
    factor = F.try_element_at(factors, F.col(spec))
    converted = F.col(value) * factor
    finite = converted.isNotNull() & ~F.isnan(converted) & (F.abs(converted) < float("inf"))
    status = F.when(factor.isNull(), "notApplicable").when(finite, "ok").otherwise("error")
    good = factor.isNotNull() & finite
    return df.withColumns(
        {
            "value": F.when(good, converted),
            "unit": F.when(good, F.try_element_at(labels, F.col(spec))),
            "status": status,
        }
    )


def status_of(errors: Column, has_value: Column, was_read: Column) -> Column:
    """Errors make a row partial (value read) or error; otherwise noValue or ok."""
    return (
        F.when(errors > 0, F.when(was_read, "partial").otherwise("error"))
        .when(~has_value, "noValue")
        .otherwise("ok")
    )
