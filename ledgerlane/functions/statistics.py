"""Wilson intervals and what is derived from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z_95 = 1.959963984540054


def wilson(successes: Column, trials: Column, z: float = Z_95) -> Column:
    """struct(successes, trials, point, low, high); all zero when nothing was tried."""
    n, z2 = trials.cast("double"), z * z
    p = successes / n
    denominator = 1 + z2 / n
    centre = (p + z2 / (2 * n)) / denominator
    spread = F.lit(z) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / denominator

    def measured(value: Column) -> Column:
        return F.when(trials > 0, value).otherwise(F.lit(0.0))

    return F.struct(
        F.when(trials > 0, successes).otherwise(F.lit(0)).cast("long").alias("successes"),
        F.when(trials > 0, trials).otherwise(F.lit(0)).cast("long").alias("trials"),
        measured(p).alias("point"),
        measured(F.greatest(F.lit(0.0), centre - spread)).alias("low"),
        measured(F.least(F.lit(1.0), centre + spread)).alias("high"),
    )


def half_width(interval: Column) -> Column:
    return (interval["high"] - interval["low"]) / 2


def rounded(interval: Column) -> Column:
    return F.struct(
        interval["successes"].alias("successes"),
        interval["trials"].alias("trials"),
        F.round(interval["point"], 4).alias("point"),
        F.round(interval["low"], 4).alias("ci_low"),
        F.round(interval["high"], 4).alias("ci_high"),
    )


def difference_is_significant(left: Column, right: Column) -> Column:
    apart = (left["high"] < right["low"]) | (right["high"] < left["low"])
    return (left["trials"] > 0) & (right["trials"] > 0) & apart


def numbers_in(text: Column) -> Column:
    """Figures of two or more digits, without commas; integer parts of decimals as well."""
    raw = F.regexp_extract_all(text, F.lit(r"[0-9][0-9,]*\.?[0-9]*"), 0)
    cleaned = F.transform(
        raw, lambda x: F.regexp_replace(F.translate(x, ",", ""), r"\.+$", "")
    )
    long = F.filter(cleaned, lambda x: F.length(F.translate(x, ".", "")) >= 2)
    whole = F.transform(
        F.filter(long, lambda x: x.contains(".")), lambda x: F.substring_index(x, ".", 1)
    )
    return F.array_distinct(F.concat(long, whole))


def claim_is_grounded(claim: Column, result: Column) -> Column:
    """Every figure of the claim occurs in the cited result."""
    return F.size(F.array_except(numbers_in(claim), numbers_in(result))) == 0
