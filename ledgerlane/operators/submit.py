"""Idempotent submission against a ledger of applied keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlane.config import DEFAULTS, ReconConfig
from ledgerlane.fixed_values import TEXT_APPLIED, TEXT_REPLAYED
from ledgerlane.functions import digests
from ledgerlane.operators.scale import lookup

LEDGER_TYPES = (
    "taxpayer_gstin string, return_period string, document_id string, action string, "
    "ruleset_version string, idempotency_key string, portal_reference string, applied_seq bigint"
)


def to_submissions(
    decisions: DataFrame, taxpayer: str, period: str, config: ReconConfig = DEFAULTS
) -> DataFrame:
    """Submission rows for decisions, in their sequence order."""
    return decisions.select(
        F.lit(taxpayer).alias("taxpayer_gstin"),
        F.lit(period).alias("return_period"),
        F.col("exception_id").alias("document_id"),
        "action",
        F.lit(config.ruleset_version).alias("ruleset_version"),
        F.col("seq").alias("ord"),
    )


def with_key(submissions: DataFrame) -> DataFrame:
    return submissions.withColumn(
        "idempotency_key",
        digests.idempotency_key(
            *[
                F.col(name)
                for name in (
                    "taxpayer_gstin",
                    "return_period",
                    "document_id",
                    "action",
                    "ruleset_version",
                )
            ]
        ),
    )


def submit_once(
    submissions: DataFrame, ledger: DataFrame, config: ReconConfig = DEFAULTS
) -> DataFrame:
    """Outcome per submission: the first unseen presentation of a key applies, others replay."""
    keyed = with_key(submissions)
    firsts = keyed.groupBy("idempotency_key").agg(F.min("ord").alias("_first"))
    seen = ledger.select("idempotency_key", F.col("portal_reference").alias("_earlier"))
    known = firsts.join(seen, "idempotency_key", "left")
    joined = lookup(keyed, known, ["idempotency_key"], "inner", config.hot_key_rows)
    applied = F.col("_earlier").isNull() & (F.col("ord") == F.col("_first"))
    reference = F.concat(F.lit("REF-"), F.substring("idempotency_key", 1, 12))
    return (
        joined.withColumn("outcome", F.when(applied, "APPLIED").otherwise("ALREADY_APPLIED"))
        .withColumn("portal_reference", F.coalesce("_earlier", reference))
        .withColumn(
            "detail", F.when(applied, F.lit(TEXT_APPLIED)).otherwise(F.lit(TEXT_REPLAYED))
        )
        .drop("_first", "_earlier")
    )


def took_effect() -> Column:
    return F.col("outcome") == "APPLIED"


def ledger_rows(results: DataFrame) -> DataFrame:
    """What a batch adds to the ledger."""
    return results.where(took_effect()).select(
        "taxpayer_gstin",
        "return_period",
        "document_id",
        "action",
        "ruleset_version",
        "idempotency_key",
        "portal_reference",
        F.col("ord").alias("applied_seq"),
    )


def exactly_once_violations(results: DataFrame) -> DataFrame:
    return (
        results.where(took_effect())
        .groupBy("idempotency_key")
        .agg(F.count(F.lit(1)).alias("applications"))
        .where("applications > 1")
    )


def attempts_vs_applied(attempts: DataFrame, ledger: DataFrame) -> DataFrame:
    """Per key: how often it was presented and how often it is in the ledger."""
    presented = attempts.groupBy("idempotency_key").agg(
        F.count(F.lit(1)).alias("presentations"), F.count_if(took_effect()).alias("effects")
    )
    rows = ledger.groupBy("idempotency_key").agg(F.count(F.lit(1)).alias("applied_rows"))
    return presented.join(rows, "idempotency_key", "left").withColumn(
        "applied_rows", F.coalesce("applied_rows", F.lit(0))
    )


def ims_inbox(ledger: DataFrame, taxpayer: str, period: str) -> DataFrame:
    """Current action per document of one taxpayer and period; the last applied one counts."""
    return (
        ledger.where((F.col("taxpayer_gstin") == taxpayer) & (F.col("return_period") == period))
        .groupBy("taxpayer_gstin", "return_period", "document_id")
        .agg(F.max_by("action", "applied_seq").alias("current_action"))
        .orderBy("document_id")
    )
