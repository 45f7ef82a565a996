"""Day gaps, financial years and statutory cut-offs. The clock is always a parameter."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlane.config import ReconConfig

DAY_FIRST_FORMATS = ("d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "d MMM yyyy", "d-MMM-yyyy", "yyyy-M-d")


def days_between(left: Column, right: Column) -> Column:
    return F.abs(F.datediff(left, right))


def financial_year_start(day: Column) -> Column:
    """Calendar year in which the April-to-March year began."""
    return F.year(day) - F.when(F.month(day) < 4, 1).otherwise(0)


def claim_deadline(day: Column, config: ReconConfig) -> Column:
    return F.make_date(
        financial_year_start(day) + 1,
        F.lit(config.claim_cutoff_month),
        F.lit(config.claim_cutoff_day),
    )


def is_time_barred(day: Column, as_of: dt.date | Column, config: ReconConfig) -> Column:
    as_of = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return as_of > claim_deadline(day, config)


def days_to_cutoff(as_of: Column, config: ReconConfig) -> Column:
    cutoff = F.make_date(F.year(as_of), F.month(as_of), F.lit(config.action_cutoff_day))
    return F.datediff(cutoff, as_of)


def period_cutoff(period: Column, day: int) -> Column:
    """``MM-YYYY`` to the given day of that month."""
    parts = F.split(period, "-")
    return F.make_date(parts[1].cast("int"), parts[0].cast("int"), F.lit(day))


def return_period(day: Column) -> Column:
    return F.date_format(day, "MM-yyyy")


def parse_indian_date(text: Column) -> Column:
    """Day-first reading over a fixed list of formats; NULL where none fits."""
    trimmed = F.trim(text)
    return F.coalesce(*[F.try_to_date(trimmed, pattern) for pattern in DAY_FIRST_FORMATS])
