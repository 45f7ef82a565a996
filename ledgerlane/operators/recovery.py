"""Supplier conversations: what a reply means and what happens next, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlane.config import DEFAULTS, ReconConfig
from ledgerlane.fixed_values import (
    INJECTION_MARKERS,
    INSTRUCTION_MARKERS,
    REPLY_KINDS,
    TEXT_DOCUMENTS_BODY,
    TEXT_FIRST_CONTACT_BODY,
)
from ledgerlane.functions.digests import canonical_json

QUOTE_CHARS = 200
RULE_QUOTE_CHARS = 80
TRANSCRIPT_CHARS = 2000
FIRST_SUBJECT = "Subject: GSTR-1 filing for invoice under exception "
DOCUMENTS_SUBJECT = "Subject: Documents for exception "


def _contains_any(text: Column, markers: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for marker in markers:
        found = found | text.contains(marker)
    return found


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"(?U)\S")


def looks_like_injection(text: Column) -> Column:
    return _contains_any(F.lower(text), INJECTION_MARKERS)


def classify_reply_rules(text: Column) -> Column:
    """struct(kind, quote, flagged) by keyword precedence over the whole text."""
    low = F.lower(text)
    instructional = _contains_any(low, INSTRUCTION_MARKERS)
    kind = (
        F.when(is_blank(text), "NO_REPLY")
        .when(instructional, "UNCLEAR")
        .when(_contains_any(low, ("already filed", "have filed")), "CLAIMS_FILED")
        .when(_contains_any(low, ("will file", "next month")), "WILL_FILE")
        .when(_contains_any(low, ("wrong amount", "amount is")), "DISPUTES_AMOUNT")
        .when(_contains_any(low, ("no such invoice", "never supplied")), "DISPUTES_EXISTENCE")
        .when(
            low.contains("send") & _contains_any(low, ("copy", "document")), "REQUESTS_DOCUMENTS"
        )
        .otherwise("UNCLEAR")
    )
    shown = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.struct(
        kind.alias("kind"),
        F.substring(shown, 1, RULE_QUOTE_CHARS).alias("quote"),
        (~is_blank(text) & (instructional | looks_like_injection(text))).alias("flagged"),
    )


def parse_reply_label(output: Column, text: Column) -> Column:
    """struct(kind, quote, flagged) from a model's output about a reply."""
    body = F.regexp_extract(output, r"(?s)\{.*\}", 0)
    valid = F.try_parse_json(body).isNotNull()
    label = F.from_json(
        F.when(valid, body), "kind string, quote string, contains_apparent_instructions boolean"
    )
    blank = is_blank(text)
    stated = F.coalesce(label["kind"], F.lit("UNCLEAR"))
    usable = ~blank & F.coalesce(valid, F.lit(False)) & stated.isin(*REPLY_KINDS)
    quote = F.substring(F.coalesce(label["quote"], F.lit("")), 1, QUOTE_CHARS)
    says_so = usable & F.coalesce(label["contains_apparent_instructions"], F.lit(False))
    return F.struct(
        F.when(blank, "NO_REPLY").when(usable, stated).otherwise("UNCLEAR").alias("kind"),
        F.when(usable, quote).otherwise("").alias("quote"),
        (~blank & (looks_like_injection(text) | says_so)).alias("flagged"),
    )


def first_contact_draft(exception_id: Column) -> Column:
    return F.concat(
        F.lit(FIRST_SUBJECT),
        exception_id,
        F.lit("\n\n" + TEXT_FIRST_CONTACT_BODY),
    )


def documents_draft(exception_id: Column) -> Column:
    return F.concat(
        F.lit(DOCUMENTS_SUBJECT),
        exception_id,
        F.lit("\n\n" + TEXT_DOCUMENTS_BODY),
    )


# --- fixed values: reasons for the next step -------------------------------

REASONS = {
    "resolved": "already resolved",
    "blocked": "per-vendor message cap reached for this cycle",
    "first": "first contact with this vendor requires human approval",
    "CLAIMS_FILED": "supplier claims the return is filed; verify against the next 2B",
    "WILL_FILE": "supplier undertook to file; recheck next cycle",
    "REQUESTS_DOCUMENTS": "supplier asked for documents; assemble and send",
    "DISPUTES": "supplier disputes the claim; a human owns this conversation",
    "silent": "no reply after two cycles; escalate tone with approval",
    "NO_REPLY": "no reply yet; wait one more cycle",
    "other": "reply could not be classified; hand to a human",
}


def _step(kind: str, human: bool, reason: str, draft: Column | None = None) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        F.lit(human).alias("requires_human"),
        F.lit(REASONS[reason]).alias("reason"),
        (draft if draft is not None else F.lit("")).alias("draft"),
    )


def decide_next(
    stage: Column, sent: Column, contacted: Column, cycle: Column, reply: Column,
    exception_id: Column, config: ReconConfig = DEFAULTS,
) -> Column:
    """struct(kind, requires_human, reason, draft). Code decides; a reply only has a kind."""
    return (
        F.when(stage == "RESOLVED", _step("close_resolved", False, "resolved"))
        .when(sent >= config.max_messages_per_cycle, _step("blocked", False, "blocked"))
        .when(~contacted, _step("send", True, "first", first_contact_draft(exception_id)))
        .when(reply == "CLAIMS_FILED", _step("wait", False, "CLAIMS_FILED"))
        .when(reply == "WILL_FILE", _step("wait", False, "WILL_FILE"))
        .when(
            reply == "REQUESTS_DOCUMENTS",
            _step("send", False, "REQUESTS_DOCUMENTS", documents_draft(exception_id)),
        )
        .when(
            reply.isin("DISPUTES_AMOUNT", "DISPUTES_EXISTENCE"), _step("escalate", True, "DISPUTES")
        )
        .when((reply == "NO_REPLY") & (cycle >= 2), _step("escalate", True, "silent"))
        .when(reply == "NO_REPLY", _step("wait", False, "NO_REPLY"))
        .otherwise(_step("escalate", True, "other"))
    )


def next_stage(stage: Column, action: Column) -> Column:
    """Stage after a step of ``decide_next``."""
    kind = action["kind"]
    return (
        F.when((kind == "send") & action["requires_human"], "AWAITING_APPROVAL")
        .when(kind == "send", "AWAITING_REPLY")
        .when(kind == "escalate", "ESCALATED")
        .when(kind == "wait", "VERIFYING_NEXT_2B")
        .otherwise(stage)
    )


STATE_FIELDS = (
    "exception_id",
    "vendor_gstin",
    "stage",
    "cycle",
    "messages_sent_this_cycle",
    "contacted_before",
    "transcript",
    "last_reply_kind",
)
STATE_TYPES = (
    "exception_id string, vendor_gstin string, stage string, cycle int, "
    "messages_sent_this_cycle int, contacted_before boolean, "
    "transcript array<struct<direction:string,kind:string,text:string>>, last_reply_kind string"
)


def state_json() -> Column:
    """Sorted-key JSON of a conversation state row."""
    return canonical_json({name: F.col(name) for name in STATE_FIELDS})


def read_state(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.from_json(column, STATE_TYPES).alias("state")).select("state.*")
