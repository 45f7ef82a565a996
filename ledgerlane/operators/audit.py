"""Hash-chained decision log.

An entry's digest covers its content and the digest before it, so a chain is sequential by
nature. Logs are cut into segments of bounded length; segments are chained side by side and
their last digests form a log of their own, chained the same way. A log no longer than one
segment is a single plain chain; a longer one is where no segments are asked for, and one task
then walks it. Verification needs no order of execution at all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlane.config import DEFAULTS, ReconConfig
from ledgerlane.fixed_values import GENESIS_DIGEST
from ledgerlane.functions import digests, money
from ledgerlane.operators.policy import route
from ledgerlane.operators.scale import lookup, rank_in_group

CHAIN_TYPES = (
    "chain_id string, sequence bigint, exception_id string, action string, "
    "requires_human boolean, reasons array<string>, recorded_at timestamp, "
    "ruleset_version string, model string, prompt_digest string, confidence double, "
    "evidence_call_ids array<string>, approver string, amount_at_risk decimal(28,2), "
    "previous_digest string, digest string, superseded_by bigint"
)
SEGMENT_ROWS = 100_000
GROUP_ROWS = 10_000
"""Entries that short segments make up together when they are handed to Python."""


def recorded_text() -> Column:
    """``recorded_at`` as UTC text with offset; microseconds only where there are any."""
    micros = F.date_format("recorded_at", "SSSSSS")
    return F.concat(
        F.date_format("recorded_at", "yyyy-MM-dd HH:mm:ss"),
        F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(F.lit("")),
        F.lit("+00:00"),
    )


_MARK = '"previous_digest":""'


def _number_as_json(text: Column, name: str, value: Column) -> Column:
    """Put a number printed our way where the JSON writer printed its own."""
    quoted = F.concat(F.lit(f'"{name}":"'), value, F.lit('"'))
    return F.replace(text, quoted, F.concat(F.lit(f'"{name}":'), value))


def entry_json(previous: Column) -> Column:
    """Canonical JSON of an entry: sorted keys, no digest, no supersession pointer."""
    confidence = digests.python_float_text(F.col("confidence"))
    fields = {
        name: F.col(name)
        for name in (
            "sequence",
            "exception_id",
            "action",
            "requires_human",
            "reasons",
            "ruleset_version",
            "model",
            "prompt_digest",
            "evidence_call_ids",
            "approver",
        )
    }
    fields["confidence"] = confidence
    fields["recorded_at"] = recorded_text()
    fields["amount_at_risk"] = money.plain(F.col("amount_at_risk"))
    fields["previous_digest"] = previous
    text = digests.canonical_json(fields)
    return F.when(F.col("confidence").isNull(), text).otherwise(
        _number_as_json(text, "confidence", confidence)
    )


def entry_digest() -> Column:
    return digests.sha256_hex(entry_json(F.col("previous_digest")))


def _chain_segments(pdf: pd.DataFrame) -> pd.DataFrame:
    """Digest each entry after the one before it, in each of some whole segments of a chain."""
    pdf = pdf.sort_values(["segment", "sequence"])
    # Entries without a sequence are a segment too.
    segments = pdf["segment"].fillna(-1)
    starts = (segments != segments.shift()).to_numpy()
    previous, befores, afters = GENESIS_DIGEST, [], []
    for begins, head, tail in zip(starts, pdf["head"], pdf["tail"]):
        if begins:
            previous = GENESIS_DIGEST
        befores.append(previous)
        previous = hashlib.sha256((head + previous + tail).encode("ascii")).hexdigest()
        afters.append(previous)
    return pd.DataFrame(
        {
            "chain_id": pdf["chain_id"].to_numpy(),
            "sequence": pdf["sequence"].to_numpy(),
            "previous_digest": befores,
            "digest": afters,
        }
    )


def _chain_whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digest each entry after the one before it; batches hold whole chains one after the other, in order.

    Only the last digest is kept from batch to batch.
    """
    chain, previous = object(), GENESIS_DIGEST
    for pdf in batches:
        befores, afters = [], []
        for chain_id, head, tail in zip(pdf["chain_id"], pdf["head"], pdf["tail"]):
            if chain_id != chain:
                chain, previous = chain_id, GENESIS_DIGEST
            befores.append(previous)
            previous = hashlib.sha256((head + previous + tail).encode("ascii")).hexdigest()
            afters.append(previous)
        yield pdf[["chain_id", "sequence"]].assign(previous_digest=befores, digest=afters)


def append_chain(entries: DataFrame, segment_rows: int | None = SEGMENT_ROWS) -> DataFrame:
    """Add ``previous_digest`` and ``digest`` to entries numbered 0.. within each chain.

    Only the JSON before and after the previous digest goes to the chaining step, and only
    digests come back; they are joined to the entries by position. Short segments are handed over
    several at a time, as each hand-over costs as much as chaining hundreds of entries.

    With ``segment_rows=None`` a chain is never broken: one task walks it in order, batch by batch.
    """
    text = entry_json(F.lit(""))
    at = F.instr(text, _MARK) + len(_MARK) - 2
    halves = entries.select(
        "chain_id",
        "sequence",
        text.alias("text"),
        at.alias("at"),
    ).select(
        "chain_id",
        "sequence",
        F.expr("substring(text, 1, at)").alias("head"),
        F.expr("substring(text, at + 1)").alias("tail"),
    )
    digested = "chain_id string, sequence bigint, previous_digest string, digest string"
    if segment_rows is None:
        # Entries without a place in a chain do not come back, and must not stand before one that has.
        placed = halves.dropna(subset=["chain_id", "sequence"])
        in_order = placed.repartition("chain_id").sortWithinPartitions("chain_id", "sequence")
        chained = in_order.mapInPandas(_chain_whole, digested)
    else:
        together = max(1, GROUP_ROWS // segment_rows)
        halves = halves.withColumn("segment", F.floor(F.col("sequence") / segment_rows))
        chained = halves.groupBy("chain_id", F.floor(F.col("segment") / together).alias("group")).applyInPandas(
            _chain_segments, digested
        )
    if "superseded_by" not in entries.columns:
        entries = entries.withColumn("superseded_by", F.lit(None).cast("bigint"))
    return entries.join(chained, ["chain_id", "sequence"])


def extend_chain(
    log: DataFrame,
    entries: DataFrame,
    segment_rows: int = SEGMENT_ROWS,
    config: ReconConfig = DEFAULTS,
) -> DataFrame:
    """Append entries (numbered on from the log) to a chained log.

    Full segments stay as they are; only each chain's open segment is chained again.
    """
    lengths = log.groupBy("chain_id").agg(
        (F.floor(F.count(F.lit(1)) / segment_rows) * segment_rows).alias("open_from")
    )
    placed = lookup(log, lengths, ["chain_id"], "inner", config.hot_key_rows)
    is_open = F.col("sequence") >= F.col("open_from")
    plain = [name for name in log.columns if name not in ("previous_digest", "digest")]
    tail = placed.where(is_open).select(*plain).unionByName(
        entries.withColumn("superseded_by", F.lit(None).cast("bigint")).select(*plain)
    )
    kept = placed.where(~is_open).select(*log.columns)
    return kept.unionByName(append_chain(tail, segment_rows).select(*log.columns))


def segment_heads(chained: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Last digest of each segment, as entries of a log that links the segments of a chain."""
    segment = F.floor(F.col("sequence") / segment_rows)
    heads = chained.groupBy("chain_id", segment.alias("segment")).agg(
        F.max_by("digest", "sequence").alias("head"), F.max("recorded_at").alias("recorded_at")
    )
    text = F.lit("")
    return heads.select(
        F.concat("chain_id", F.lit("/segments")).alias("chain_id"),
        F.col("segment").alias("sequence"),
        F.col("head").alias("exception_id"),
        F.lit("SEGMENT").alias("action"),
        F.lit(False).alias("requires_human"),
        F.array().cast("array<string>").alias("reasons"),
        "recorded_at",
        text.alias("ruleset_version"),
        text.alias("model"),
        text.alias("prompt_digest"),
        F.lit(None).cast("double").alias("confidence"),
        F.array().cast("array<string>").alias("evidence_call_ids"),
        F.lit(None).cast("string").alias("approver"),
        F.lit(None).cast(money.MONEY).alias("amount_at_risk"),
    )


def link_log(chained: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """The log that links the segments of a chained log; it is written with it and checked with it."""
    return append_chain(segment_heads(chained, segment_rows), segment_rows)


def verify_log(
    log: DataFrame, links: DataFrame, config: ReconConfig = DEFAULTS, segment_rows: int = SEGMENT_ROWS
) -> DataFrame:
    """As ``verify_chain``, and every segment must be the one that was linked, and the links a chain.

    A segment that is replaced as a whole is a chain in itself; only its link tells.
    """
    suffix = "/segments"
    chain = F.regexp_replace("chain_id", suffix + "$", "")
    now = segment_heads(log, segment_rows).select(
        chain.alias("chain_id"), "sequence", F.col("exception_id").alias("head")
    )
    then = links.select(chain.alias("chain_id"), "sequence", F.col("exception_id").alias("linked"))
    told = F.concat(F.lit("segment "), F.col("sequence").cast("string"), F.lit(" is not the one that was linked"))
    segments = (
        now.join(then, ["chain_id", "sequence"], "full")
        .where(~F.col("head").eqNullSafe(F.col("linked")))
        .groupBy("chain_id").agg(F.min_by(told, "sequence").alias("segment_fault"))
    )
    linked = verify_chain(links, config, segment_rows).select(
        chain.alias("chain_id"), F.when(~F.col("intact"), F.concat(F.lit("links: "), "message")).alias("link_fault")
    )
    fault = F.coalesce(F.when(~F.col("intact"), F.col("message")), "segment_fault", "link_fault")
    return (
        verify_chain(log, config, segment_rows)
        .join(segments, "chain_id", "left").join(linked, "chain_id", "left")
        .select(
            "chain_id", "entries", fault.isNull().alias("intact"),
            F.coalesce(fault, F.lit("chain intact")).alias("message"),
        )
    )


def verify_chain(
    log: DataFrame, config: ReconConfig = DEFAULTS, segment_rows: int = SEGMENT_ROWS
) -> DataFrame:
    """Per chain: intact or not, and the first break. All rows are checked in parallel."""
    placed = rank_in_group(
        log, ["chain_id"], ["sequence", "digest"], "position", config.hot_key_rows
    ).select(
        "chain_id",
        "sequence",
        "previous_digest",
        (F.col("position") - 1).alias("position"),
        entry_digest().alias("actual"),
    )
    before = placed.select(
        "chain_id", (F.col("position") + 1).alias("position"), F.col("actual").alias("expected")
    )
    starts_segment = F.col("position") % segment_rows == 0
    expected = F.when(starts_segment, F.lit(GENESIS_DIGEST)).otherwise(F.col("expected"))
    position = F.col("position").cast("string")
    fault = F.when(
        F.col("sequence") != F.col("position"),
        F.concat(
            F.lit("entry at position "),
            position,
            F.lit(" claims sequence "),
            F.col("sequence").cast("string"),
        ),
    ).when(
        F.col("previous_digest") != expected,
        F.concat(
            F.lit("entry "),
            position,
            F.lit(" does not follow entry "),
            (F.col("position") - 1).cast("string"),
        ),
    )
    return (
        placed.join(before, ["chain_id", "position"], "left")
        .withColumn("fault", fault)
        .groupBy("chain_id")
        .agg(
            F.count(F.lit(1)).alias("entries"),
            F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("position"))).alias(
                "fault"
            ),
        )
        .select(
            "chain_id",
            "entries",
            F.col("fault").isNull().alias("intact"),
            F.coalesce("fault", F.lit("chain intact")).alias("message"),
        )
    )


def supersede(log: DataFrame, replacements: DataFrame) -> DataFrame:
    """Point earlier entries at later ones (``chain_id, sequence, replaced_by``).

    Only the forward pointer changes, so digests and the chain stand.
    """
    return (
        log.join(replacements, ["chain_id", "sequence"], "left")
        .withColumn("superseded_by", F.coalesce("replaced_by", "superseded_by"))
        .drop("replaced_by")
    )


def history_for(log: DataFrame, exception_id: str) -> DataFrame:
    return log.where(F.col("exception_id") == exception_id).orderBy("chain_id", "sequence")


def audit_entries(
    decisions: DataFrame, chain_id: Column, sequence: Column, recorded_at: Column,
    config: ReconConfig = DEFAULTS, approver: str | None = None, model: str = "",
) -> DataFrame:
    """Unchained entries for gate decisions."""
    investigated = route(F.col("exception_class")) == "TIER_2"
    finding = F.col("finding")
    no_ids = F.array().cast("array<string>")
    return decisions.select(
        chain_id.alias("chain_id"),
        sequence.cast("bigint").alias("sequence"),
        "exception_id",
        "action",
        "requires_human",
        "reasons",
        recorded_at.alias("recorded_at"),
        F.lit(config.ruleset_version).alias("ruleset_version"),
        F.when(investigated, F.lit(model)).otherwise(F.lit("")).alias("model"),
        F.when(investigated, digests.prompt_hash(F.col("detail")))
        .otherwise(F.lit(""))
        .alias("prompt_digest"),
        F.when(investigated, finding["confidence"]).alias("confidence"),
        F.coalesce(
            F.when(investigated, F.transform(finding["evidence"], lambda e: e["tool_call_id"])),
            no_ids,
        ).alias("evidence_call_ids"),
        F.when(~F.col("requires_human"), F.lit(approver).cast("string")).alias("approver"),
        "amount_at_risk",
    )
