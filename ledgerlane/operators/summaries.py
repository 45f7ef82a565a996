"""Counts and totals over reconciliation results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlane.config import DEFAULTS, ReconConfig
from ledgerlane.functions.money import MONEY, literal


def rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def match_summary(matched: DataFrame, exceptions: DataFrame) -> DataFrame:
    kinds = matched.select(F.when(F.col("exact"), "exact").otherwise("fuzzy").alias("kind"))
    kinds = kinds.union(exceptions.select(F.lit("exception").alias("kind")))

    def count(kind: str) -> Column:
        return F.count_if(F.col("kind") == kind)

    documents = F.col("documents")
    return kinds.agg(
        F.count(F.lit(1)).alias("documents"),
        count("exact").alias("exact_count"),
        count("fuzzy").alias("fuzzy_count"),
        count("exception").alias("exceptions"),
    ).select(
        "*",
        rate(F.col("exact_count"), documents).alias("exact_rate"),
        rate(F.col("fuzzy_count"), documents).alias("fuzzy_rate"),
    )


def exceptions_by_class(exceptions: DataFrame) -> DataFrame:
    return (
        exceptions.groupBy("exception_class")
        .agg(F.count(F.lit(1)).alias("exceptions"))
        .orderBy(F.desc("exceptions"), "exception_class")
    )


def itc_totals(books: DataFrame, portal: DataFrame, *group: str) -> DataFrame:
    """Claimed and available credit over all lines of prepared sides, per group or overall."""
    zero = F.lit(0).cast(MONEY)
    both = books.select(*group, F.col("total_tax").alias("claimed"), zero.alias("available"))
    both = both.unionByName(
        portal.select(*group, zero.alias("claimed"), F.col("total_tax").alias("available"))
    )
    return both.groupBy(*group).agg(
        F.coalesce(F.sum("claimed"), zero).cast(MONEY).alias("claimed_itc"),
        F.coalesce(F.sum("available"), zero).cast(MONEY).alias("available_itc"),
    )


def drc01c_exposure(totals: DataFrame, config: ReconConfig = DEFAULTS) -> DataFrame:
    """Excess claim against the lower of a flat amount and a share of the available credit."""
    excess = (F.col("claimed_itc") - F.col("available_itc")).cast(MONEY)
    share = F.round(
        F.col("available_itc") * F.lit(config.exposure_fraction).cast("decimal(4,3)"), 2
    ).cast(MONEY)
    return (
        totals.withColumn("excess", excess)
        .withColumn("threshold", F.least(literal(config.exposure_absolute), share))
        .withColumn("fires", F.col("excess") > F.col("threshold"))
        .withColumn("headroom", (F.col("threshold") - F.col("excess")).cast(MONEY))
    )
