"""Proposals about exceptions: case text, playbook proposals, validation of model replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlane.config import DEFAULTS, ReconConfig
from ledgerlane.fixed_values import (
    ACTIONS,
    CONFIDENCE_BASE,
    CONFIDENCE_SPAN,
    EXCEPTION_CLASSES,
    PLAYBOOK_ACTIONS,
    REFERENCE_PROBES,
    TEXT_PLAYBOOK_CLAIM,
    TEXT_SIMILAR_CASES,
)
from ledgerlane.functions import digests, money
from ledgerlane.operators.scale import lookup

EVIDENCE_TYPE = "array<struct<tool_call_id:string,tool_name:string,claim:string>>"
FINDING_TYPE = (
    "exception_id string, proposed_class string, proposed_action string, confidence double, "
    f"rationale string, evidence {EVIDENCE_TYPE}"
)


def describe_exception() -> Column:
    """Case brief over an exception row, one fact per line."""

    def side(name: str, label: str) -> Column:
        line = F.col(name)
        irn = F.when(
            F.coalesce(line["irn"], F.lit("")) != "", F.concat(F.lit(", IRN "), line["irn"])
        ).otherwise(F.lit(""))
        present = F.concat(
            F.lit(f"In the {label}: invoice "),
            line["invoice_number"],
            F.lit(" dated "),
            line["invoice_date"].cast("string"),
            F.lit(" from GSTIN "),
            line["supplier_gstin"],
            F.lit(", taxable "),
            money.plain(line["taxable"]),
            F.lit(", total tax "),
            money.plain(line["total_tax"]),
            irn,
            F.lit("."),
        )
        return F.when(line.isNull(), F.lit(f"No counterpart in the {label}.")).otherwise(present)

    head = F.concat(
        F.lit("Exception "),
        F.col("exception_id"),
        F.lit(" classified by rules as "),
        F.col("exception_class"),
        F.lit("."),
    )
    detail = F.when(F.col("detail") != "", F.col("detail"))
    return F.concat_ws(
        "\n", head, detail, side("book", "purchase register"), side("portal", "GSTR-2B")
    )


def case_briefs(exceptions: DataFrame, hints: DataFrame, config: ReconConfig = DEFAULTS) -> DataFrame:
    """``exception_id, brief``: what is asked about each exception, with similar cases where there are any.

    ``hints`` (``exception_class, gstin, hint``) has one row per class and supplier. A supplier with very many
    exceptions meets its few hints by broadcast. A supplier that is NULL or has no hint leaves the case text alone.
    """
    cases = exceptions.select(
        "exception_id", "exception_class", F.col("supplier_gstin").alias("gstin"), describe_exception().alias("text")
    )
    similar = F.concat(F.lit(TEXT_SIMILAR_CASES + "\n"), "hint")
    found = lookup(cases, hints, ["exception_class", "gstin"], "left", config.hot_key_rows)
    return found.select(
        "exception_id", F.concat_ws("\n\n", "text", F.when(F.col("hint") != "", similar)).alias("brief")
    )


def call_id(index: Column, tool: Column) -> Column:
    return F.concat(F.lit("tc"), F.format_string("%02d", index), F.lit("-"), tool)


def stable_confidence(exception_class: Column, text: Column) -> Column:
    first_byte = F.conv(F.substring(F.sha2(F.concat(exception_class, text), 256), 1, 2), 16, 10)
    return F.round(F.lit(CONFIDENCE_BASE) + first_byte.cast("double") / 255.0 * CONFIDENCE_SPAN, 4)


def playbook(spark) -> DataFrame:
    """Rule table: per class the probes to run, the action and the reason. One row per class."""
    rows = [
        (cls, list(probes), PLAYBOOK_ACTIONS[cls], f"rule for {cls}: {PLAYBOOK_ACTIONS[cls]}")
        for cls, probes in REFERENCE_PROBES.items()
    ]
    return spark.createDataFrame(
        rows, "exception_class string, probes array<string>, action string, rationale string"
    )


def playbook_findings(exceptions: DataFrame) -> DataFrame:
    """Proposals for exceptions whose class the playbook covers."""
    rules = F.broadcast(playbook(exceptions.sparkSession))
    evidence = F.transform(
        "probes",
        lambda tool, i: F.struct(
            call_id(i, tool).alias("tool_call_id"),
            tool.alias("tool_name"),
            F.concat(tool, F.lit(" " + TEXT_PLAYBOOK_CLAIM)).alias("claim"),
        ),
    )
    return exceptions.join(rules, "exception_class").select(
        "exception_id",
        F.col("exception_class").alias("proposed_class"),
        F.col("action").alias("proposed_action"),
        stable_confidence(F.col("exception_class"), describe_exception()).alias("confidence"),
        "rationale",
        evidence.alias("evidence"),
        F.size("probes").alias("steps_used"),
    )


REPLY_TYPE = (
    "proposed_class string, proposed_action string, confidence string, rationale string, "
    f"evidence {EVIDENCE_TYPE}"
)


def validate_findings(replies: DataFrame, steps: DataFrame) -> DataFrame:
    """Turn reply texts into findings, or say why not.

    ``replies``: exception_id, text. ``steps``: exception_id, call_id. Cited calls are checked by
    an equi-join on (case, call), so no case's calls are gathered in one place.
    """
    body = F.regexp_extract("text", r"(?s)\{.*\}", 0)
    parsed = (
        replies.withColumn("body", body)
        .withColumn("valid_json", F.try_parse_json("body").isNotNull())
        .withColumn("reply", F.when(F.col("valid_json"), F.from_json("body", REPLY_TYPE)))
        .withColumn(
            "states_confidence",
            F.coalesce(F.array_contains(F.json_object_keys("body"), "confidence"), F.lit(False)),
        )
    )
    cited = parsed.select("exception_id", F.posexplode("reply.evidence").alias("at", "item"))
    made = steps.select("exception_id", "call_id").distinct()
    cited_id = F.coalesce("item.tool_call_id", F.lit(""))
    invented = (
        cited.withColumn("call_id", cited_id)
        .join(made, ["exception_id", "call_id"], "left_anti")
        .groupBy("exception_id")
        .agg(F.min_by("call_id", "at").alias("invented"))
    )
    used = made.groupBy("exception_id").agg(F.count(F.lit(1)).alias("steps_used"))
    reply = F.col("reply")
    usable = F.coalesce(
        reply["proposed_class"].isin(*EXCEPTION_CLASSES)
        & reply["proposed_action"].isin(*ACTIONS),
        F.lit(False),
    )
    number = F.when(F.col("states_confidence"), reply["confidence"].try_cast("double")).otherwise(
        F.lit(0.0)
    )
    failure = (
        F.when(F.col("body") == "", F.lit("no JSON object in the reply"))
        .when(~F.col("valid_json"), F.lit("unparseable JSON"))
        .when(~usable, F.lit("unusable class or action"))
        .when(
            F.col("invented").isNotNull(),
            F.concat(
                F.lit("evidence cites '"),
                F.col("invented"),
                F.lit("', which is not a tool call this run made"),
            ),
        )
        .when(number.isNull(), F.lit("confidence is not a number"))
    )
    good = F.col("failure").isNull()
    empty = F.array().cast(EVIDENCE_TYPE)
    evidence = F.transform(
        F.coalesce(reply["evidence"], empty),
        lambda e: F.struct(
            F.coalesce(e["tool_call_id"], F.lit("")).alias("tool_call_id"),
            F.coalesce(e["tool_name"], F.lit("")).alias("tool_name"),
            F.coalesce(e["claim"], F.lit("")).alias("claim"),
        ),
    )
    return (
        parsed.join(invented, "exception_id", "left")
        .join(used, "exception_id", "left")
        .withColumn("failure", failure)
        .select(
            "exception_id",
            F.when(good, reply["proposed_class"]).alias("proposed_class"),
            F.when(good, reply["proposed_action"]).alias("proposed_action"),
            F.when(good, F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))).alias("confidence"),
            F.when(good, F.trim(F.coalesce(reply["rationale"], F.lit("")))).alias("rationale"),
            F.when(good, evidence).alias("evidence"),
            F.coalesce("steps_used", F.lit(0)).cast("long").alias("steps_used"),
            F.coalesce("failure", F.lit("")).alias("failure"),
        )
    )


def trace_termination(responses: DataFrame, config: ReconConfig = DEFAULTS) -> DataFrame:
    """Why each recorded run ended: one row per case with the label and the response it fell on.

    ``responses``: case_id, idx, is_final, tool_name, arguments, tokens, elapsed, and optionally ``invalid``:
    why a final response holds no valid finding (blank or NULL: it does). Responses count in the order of
    idx, which may have gaps. A run cannot pass its step budget, so responses beyond it cannot matter
    and each case keeps its first ``max_steps + 1`` rows; no task sends more of a case to the shuffle.
    """
    place = F.row_number().over(Window.partitionBy("case_id").orderBy("idx"))
    reachable = (
        responses.withColumn("place", place).where(F.col("place") <= config.max_steps + 1)
        .withColumn("idx", F.col("place").cast("long") - 1).drop("place")
    )
    if "invalid" not in reachable.columns:
        reachable = reachable.withColumn("invalid", F.lit(None).cast("string"))
    invalid = F.coalesce(F.trim("invalid"), F.lit("")) != ""
    case = Window.partitionBy("case_id").orderBy("idx")
    before = case.rowsBetween(Window.unboundedPreceding, -1)
    through = case.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same_call = Window.partitionBy("case_id", "is_final", "tool_name", "arguments").orderBy("idx")
    repeat = (F.row_number().over(same_call) > 1).cast("int")
    marked = (
        reachable.withColumn("spent", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
        .withColumn("repeat", repeat)
        .withColumn("repeats", F.sum("repeat").over(through))
    )
    label = (
        F.when(F.col("elapsed") > config.max_seconds, "wall_clock_timeout")
        .when(F.col("spent") > config.max_tokens, "spend_cap")
        .when(F.col("is_final") & invalid, F.concat(F.lit("invalid_finding: "), F.trim("invalid")))
        .when(F.col("is_final"), "completed")
        .when(F.col("idx") >= config.max_steps, "step_budget_exhausted")
        .when(
            (F.col("repeat") == 1) & (F.col("repeats") >= config.repeat_threshold),
            "loop_detected",
        )
    )
    ended = F.when(F.col("label").isNotNull(), F.col("idx"))
    return (
        marked.withColumn("label", label)
        .groupBy("case_id")
        .agg(
            F.coalesce(F.min_by("label", ended), F.lit("open")).alias("terminated_because"),
            F.coalesce(F.min(ended), F.max("idx") + 1).alias("steps"),
        )
    )


def request_fingerprint(fields: dict[str, Column]) -> Column:
    """Digest of everything that can change an answer, over UTF-8 so long texts stay cheap."""
    return digests.sha256_hex(digests.canonical_json(fields, escape=False))


def first_requests(requests: DataFrame, fields: list[str], order: str) -> DataFrame:
    """One row per distinct request, the first by ``order``, with how often it was asked."""
    marked = requests.withColumn(
        "fingerprint", request_fingerprint({name: F.col(name) for name in fields})
    )
    return marked.groupBy("fingerprint").agg(
        F.min(order).alias(order), F.count(F.lit(1)).alias("asked")
    )
