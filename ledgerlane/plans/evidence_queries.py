"""Registered queries: evidence lookups, findings, traces, precedents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlane.config import DEFAULTS
from ledgerlane.fixed_values import REFERENCE_PROBES
from ledgerlane.functions import money
from ledgerlane.operators import evidence, findings, precedents
from ledgerlane.operators.scale import rank_in_group
from ledgerlane.operators.sides import prepare_side
from ledgerlane.plans.decision_queries import exceptions_with_key
from ledgerlane.plans.ledger_queries import ledger
from ledgerlane.sources import derived


STRANGER = 7_000_001
"""Added to an order key, it gives a supplier that no customer is."""


def probe_requests(spark, sf_dir) -> DataFrame:
    """One request of each kind per exception, with and without each filter.

    Some ask for what the tables do not hold; the tables themselves are whole.
    """
    k = F.col("k")
    number = F.coalesce("book.invoice_number", "portal.invoice_number")
    value = F.coalesce(
        F.col("portal.taxable") + F.col("portal.total_tax"),
        F.col("book.taxable") + F.col("book.total_tax"),
    )
    return exceptions_with_key(spark, sf_dir).select(
        "exception_id",
        F.lit("tc00").alias("call_id"),
        "k",
        F.when(k % 97 == 0, F.lit("")).otherwise(F.col("supplier_gstin")).alias("gstin"),
        F.coalesce("book.supplier_gstin", "portal.supplier_gstin").alias("book_gstin"),
        number.alias("number"),
        F.when(k % 2 == 0, F.col("amount_at_risk")).alias("tax"),
        value.cast(money.MONEY).alias("value"),
        F.coalesce("portal.irn", "book.irn").alias("irn"),
    )


def _ids(name: str) -> Column:
    return F.array_join(F.transform("rows", lambda r: r[name]), "|")


def probe_register(spark, sf_dir) -> DataFrame:
    k = F.col("k")
    asked = probe_requests(spark, sf_dir).withColumns(
        {
            "invoice_number": F.when((k % 3 == 0) | (k % 97 == 0), F.col("number")),
            "amount": F.col("tax"),
        }
    )
    books = prepare_side(derived.books(spark, sf_dir))
    return evidence.probe_purchase_register(asked, books).select(
        "exception_id", "match_count", F.coalesce(_ids("line_id"), F.lit("")).alias("line_ids")
    )


def probe_bank(spark, sf_dir) -> DataFrame:
    k = F.col("k")
    asked = probe_requests(spark, sf_dir).withColumns(
        {
            "amount": F.when(k % 4 != 0, F.col("value") + F.when(k % 10 == 9, 5_000_000).otherwise(0)).cast(money.MONEY),
            "tolerance": F.when(k % 5 == 0, F.lit(5)).cast(money.MONEY),
            "gstin": F.col("book_gstin"),
        }
    )
    return evidence.probe_bank_ledger(asked, derived.bank(spark, sf_dir)).select(
        "exception_id",
        "match_count",
        F.coalesce(_ids("payment_id"), F.lit("")).alias("payment_ids"),
    )


def probe_vendor(spark, sf_dir) -> DataFrame:
    k = F.col("k")
    strange = derived.with_supplier_gstin(probe_requests(spark, sf_dir).drop("gstin"), k + STRANGER)
    asked = strange.withColumn("gstin", F.when(k % 50 == 49, F.col("gstin")).otherwise(F.col("book_gstin")))
    found = evidence.probe_vendor_master(asked, derived.vendors(spark, sf_dir))
    return found.select(
        "exception_id",
        "known_vendor",
        F.coalesce("legal_name", F.lit("")).alias("legal_name"),
        F.coalesce("files_late", F.lit(False)).alias("files_late"),
        F.coalesce("risk_flag", F.lit("")).alias("risk_flag"),
        "gstin_well_formed",
        "gstin_checksum_valid",
    )


def probe_prior_2b(spark, sf_dir) -> DataFrame:
    k = F.col("k")
    known = F.regexp_replace("number", "^CN/", "")
    number = F.when(k % 14 == 0, F.concat(known, F.lit("/X"))).when(k % 2 == 0, known)
    asked = probe_requests(spark, sf_dir).withColumn("invoice_number", number)
    return evidence.probe_prior_2b(asked, derived.prior_portal(spark, sf_dir)).select(
        "exception_id",
        "period_count",
        "match_count",
        F.coalesce(_ids("line_id"), F.lit("")).alias("line_ids"),
    )


def probe_irn(spark, sf_dir) -> DataFrame:
    unknown = F.when(F.col("k") % 7 == 0, F.concat(F.lit("X"), "irn")).otherwise(F.col("irn"))
    asked = probe_requests(spark, sf_dir).withColumn("irn", unknown)
    found = evidence.probe_irn_status(asked, derived.irn_registry(spark, sf_dir))
    return found.select(
        "exception_id",
        "irn",
        "known",
        F.coalesce("status", F.lit("")).alias("status"),
        F.coalesce("cancelled", F.lit(False)).alias("cancelled"),
    )


def derived_replies(spark, sf_dir) -> DataFrame:
    """Model replies over all exceptions, sound and broken in eight ways."""
    kind = F.col("k") % 8

    def reply(cls: str, confidence: str, rationale: str, call: str | None) -> Column:
        items = (
            f'[{{"tool_call_id": "{call}", "tool_name": "t", "claim": "c"}}]' if call else "[]"
        )
        return F.concat(
            F.lit(f'Verdict: {{"proposed_class": "{cls}", "proposed_action": "ACCEPT", {confidence}'
                  f'"rationale": "{rationale}", "evidence": {items}}}'),
            F.lit("\nEnd "),
            F.col("k").cast("string"),
        )

    good, call = "DUPLICATE", "tc01-query_vendor_master"
    text = (
        F.when(kind == 0, reply(good, '"confidence": 0.84, ', "fits", call))
        .when(kind == 1, F.lit("nothing to report"))
        .when(kind == 2, F.lit('{"proposed_class": }'))
        .when(kind == 3, reply("NOT_A_CLASS", '"confidence": 0.5, ', "fits", call))
        .when(kind == 4, reply(good, '"confidence": 0.5, ', "fits", "tc09-invented"))
        .when(kind == 5, reply(good, '"confidence": "high", ', "fits", call))
        .when(kind == 6, reply(good, '"confidence": 1.7, ', "  wide  ", call))
        .otherwise(reply(good, "", "fits", None))
    )
    return exceptions_with_key(spark, sf_dir).select("exception_id", text.alias("text"))


def findings_validation(spark, sf_dir) -> DataFrame:
    calls = F.explode(
        F.array(F.lit("tc00-query_purchase_register"), F.lit("tc01-query_vendor_master"))
    )
    steps = ledger(spark, sf_dir)[1].exceptions.select("exception_id", calls.alias("call_id"))
    checked = findings.validate_findings(derived_replies(spark, sf_dir), steps)
    return checked.select(
        "exception_id",
        F.coalesce("proposed_class", F.lit("")).alias("proposed_class"),
        F.coalesce("confidence", F.lit(-1.0)).alias("confidence"),
        F.coalesce("rationale", F.lit("")).alias("rationale"),
        F.coalesce(F.size("evidence"), F.lit(-1)).cast("long").alias("citations"),
        "steps_used",
        "failure",
    )


def recorded_responses(spark, sf_dir) -> DataFrame:
    """Response logs from the event stream: one case per user, in time order."""
    events = derived.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("case_id"), "event_id", "ts", "event_type", "props", "value"
    )
    placed = rank_in_group(
        events, ["case_id"], ["ts", "event_id"], "place", DEFAULTS.hot_key_rows
    )
    idx = F.col("place") - 1
    return placed.select(
        "case_id",
        idx.alias("idx"),
        ((F.col("event_type") == "purchase") & (idx >= 3)).alias("is_final"),
        F.col("event_type").alias("tool_name"),
        F.when(F.col("case_id") % 2 == 0, F.lit("{}")).otherwise(F.col("props")).alias("arguments"),
        F.round(F.col("value") * 400).cast("long").alias("tokens"),
        (idx * F.when(F.col("case_id") % 5 == 0, 25.0).otherwise(4.0)).alias("elapsed"),
    )


def trace_termination(spark, sf_dir) -> DataFrame:
    return findings.trace_termination(recorded_responses(spark, sf_dir))


def prompt_dedupe(spark, sf_dir) -> DataFrame:
    """Distinct requests among all document texts, the first of each and how often it was asked."""
    asked = derived.table(spark, sf_dir, "documents").select(
        "doc_id", F.lit("p").alias("provider"), F.lit("m").alias("model"), "text"
    )
    return findings.first_requests(asked, ["provider", "model", "text"], "doc_id").select(
        "doc_id", "asked"
    )


def derived_precedents(spark, sf_dir) -> DataFrame:
    k = F.col("k")
    cls = (
        F.when(k % 4 == 1, "MISSING_IN_BOOKS")
        .when(k % 4 == 2, "AMOUNT_MISMATCH")
        .when(k % 4 == 3, "GSTIN_MISMATCH")
        .otherwise("CREDIT_NOTE_UNLINKED")
    )
    path = F.when(
        k % 4 == 1, F.array(*[F.lit(p) for p in REFERENCE_PROBES["MISSING_IN_BOOKS"]])
    ).otherwise(F.array(F.lit("query_purchase_register")))
    return (
        derived._documents(spark, sf_dir)
        .select(
            F.concat(F.lit("C1-"), "id").alias("precedent_id"),
            cls.alias("exception_class"),
            "gstin",
            F.concat(
                F.lit("invoice "), "number", F.lit(" dated "), F.col("day").cast("string")
            ).alias("summary"),
            path.alias("probe_sequence"),
            F.concat(F.lit("settled as order "), k.cast("string")).alias("resolution"),
            (k % 5 != 0).alias("human_confirmed"),
            F.lit(1).alias("cycle"),
        )
    )


def hash_embedding(spark, sf_dir) -> DataFrame:
    stored = precedents.add_precedents(derived_precedents(spark, sf_dir))
    shown = F.transform(
        "vector",
        lambda e: F.concat(e["idx"].cast("string"), F.lit(":"), e["weight"].cast("string")),
    )
    return stored.select(
        "precedent_id",
        F.array_join(shown, " ").alias("vector"),
        F.col("norm_squared").cast("long").alias("norm_squared"),
    )


def _hits(spark, sf_dir) -> DataFrame:
    stored = precedents.add_precedents(derived_precedents(spark, sf_dir))
    asked = ledger(spark, sf_dir)[1].exceptions.select(
        "exception_class", F.col("supplier_gstin").alias("gstin")
    )
    return precedents.search_precedents(asked, stored)


def precedent_top3(spark, sf_dir) -> DataFrame:
    return _hits(spark, sf_dir).select(
        "exception_class",
        "gstin",
        F.col("place").cast("long").alias("place"),
        "precedent_id",
        "similarity",
        "same_vendor",
    )


def precedent_hints(spark, sf_dir) -> DataFrame:
    return precedents.precedent_hint(_hits(spark, sf_dir))


def case_briefs(spark, sf_dir) -> DataFrame:
    """The brief of every exception, with the precedents that its class and supplier find."""
    return findings.case_briefs(ledger(spark, sf_dir)[1].exceptions, precedent_hints(spark, sf_dir))


def dense_cosine(spark, sf_dir) -> DataFrame:
    """Each embedding against the mean vector of its label."""
    vectors = derived.table(spark, sf_dir, "embeddings")
    means = (
        vectors.select("label", F.posexplode("embedding").alias("pos", "x"))
        .groupBy("label", "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy("label")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("parts"))
        .select("label", F.transform("parts", lambda p: p["x"]).alias("mean"))
    )
    return vectors.join(means, "label").select(
        "vec_id", F.round(precedents.dense_cosine(F.col("embedding"), F.col("mean")), 4).alias("cosine")
    )


QUERIES = {
    "probe_register": probe_register,
    "probe_bank": probe_bank,
    "probe_vendor": probe_vendor,
    "probe_prior_2b": probe_prior_2b,
    "probe_irn": probe_irn,
    "findings_validation": findings_validation,
    "trace_termination": trace_termination,
    "prompt_dedupe": prompt_dedupe,
    "hash_embedding": hash_embedding,
    "precedent_top3": precedent_top3,
    "precedent_hints": precedent_hints,
    "case_briefs": case_briefs,
    "dense_cosine": dense_cosine,
}
