"""Supplier conversations as a keyed stateful stream, right whatever the order of arrival.

Replies are classified as columns before the state step. A conversation's state is a small record of
fixed size and a map of the messages that came before their turn: a message is handled when all earlier
ones were, and a repeated one not at all. The map lies in the state store entry by entry, so neither a long
conversation nor a large trigger is gathered in memory. What was said is written out message by message
(``transcript``) and not carried in state.

Event time ends what would wait for ever: ``WAIT_DAYS`` after the last message, by the watermark, a missing
turn is given up and what waits behind it is handled in order; a conversation with nothing waiting is
forgotten. Messages behind the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerlane.config import DEFAULTS, ReconConfig
from ledgerlane.fixed_values import REPLY_KINDS, TEXT_DOCUMENTS_BODY, TEXT_FIRST_CONTACT_BODY
from ledgerlane.operators.recovery import (
    DOCUMENTS_SUBJECT,
    FIRST_SUBJECT,
    TRANSCRIPT_CHARS,
    classify_reply_rules,
    decide_next,
    next_stage,
)

MESSAGE_FIELDS = ("exception_id", "vendor_gstin", "cycle", "contacted", "ord", "text", "sent_at")
WAIT_DAYS = 30
"""Days after a conversation's last message when it stops waiting, or is forgotten."""

STATE_TYPES = (
    "stage string, cycle int, sent int, contacted boolean, following bigint, latest bigint, timer bigint"
)
EARLY_FIELDS = ("vendor_gstin", "cycle", "contacted", "text", "kind", "flagged")
EARLY_TYPES = (
    "vendor_gstin string, cycle int, contacted boolean, text string, kind string, flagged boolean"
)
OUTPUT_TYPES = (
    "exception_id string, vendor_gstin string, ord bigint, reply_kind string, flagged boolean, "
    "text string, action string, requires_human boolean, reason string, draft string, "
    "stage string, cycle int, sent int, contacted boolean"
)


KINDS = (*REPLY_KINDS, "UNCLEAR")


def transitions(spark: SparkSession, config: ReconConfig = DEFAULTS) -> dict[tuple, tuple]:
    """Every step that the rules can take, by resolved, capped, contacted, late and reply kind.

    The table is what ``decide_next`` and ``next_stage`` give for each case, so the rules are
    written once. A stage of "" leaves the conversation where it is.
    """
    flags = [(r, c, k, n) for r in (False, True) for c in (False, True) for k in (False, True) for n in (False, True)]
    cases = spark.createDataFrame(
        [(*f, kind) for f in flags for kind in KINDS],
        "resolved boolean, capped boolean, contacted boolean, late boolean, reply string",
    )
    stage = F.when(F.col("resolved"), "RESOLVED").otherwise("")
    step = decide_next(
        stage,
        F.when(F.col("capped"), config.max_messages_per_cycle).otherwise(config.max_messages_per_cycle - 1),
        F.col("contacted"),
        F.when(F.col("late"), 2).otherwise(0),
        F.col("reply"),
        F.lit(""),
        config,
    )
    rows = cases.withColumn("step", step).withColumn("after", next_stage(F.lit(""), F.col("step")))
    return {tuple(r)[:5]: (r.step.kind, r.step.requires_human, r.step.reason, r.after) for r in rows.collect()}


class Conversations(StatefulProcessor):
    """Steps of conversations by a table of the rules. Turns are numbered from 0."""

    def __init__(self, table: dict[tuple, tuple], cap: int, wait_days: int = WAIT_DAYS):
        self.table, self.cap, self.wait = table, cap, wait_days * 86_400_000
        self.columns = [part.split()[0] for part in OUTPUT_TYPES.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.record = handle.getValueState("record", STATE_TYPES)
        self.early = handle.getMapState("early", "ord bigint", EARLY_TYPES)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._load()
        for batch in rows:
            said = []
            for m in batch.sort_values("ord").to_dict("records"):
                self.latest = max(self.latest, int(m["at"]))
                if m["ord"] == self.following:
                    said.append(self._step(key[0], m))
                    said += self._in_turn(key[0])
                elif m["ord"] > self.following and not self.early.containsKey((int(m["ord"]),)):
                    self.early.updateValue((int(m["ord"]),), _plain(m))
            yield pd.DataFrame(said, columns=self.columns)
        self._store(self.latest + self.wait)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._load()
        waiting = sorted(k[0] for k in self.early.keys())
        if not waiting:
            self.record.clear()
            return
        said = []
        for place in waiting:  # gaps are given up
            if place >= self.following:
                self.following = place
                said += self._in_turn(key[0])
        yield pd.DataFrame(said, columns=self.columns)
        self.timer = None
        self._store(timerValues.getCurrentWatermarkInMs() + self.wait)

    def close(self) -> None:
        pass

    def _load(self) -> None:
        start = ("DRAFTED", 0, 0, False, 0, 0, None)
        found = self.record.get() if self.record.exists() else start
        self.stage, self.cycle, self.sent, self.contacted, self.following, self.latest, self.timer = found

    def _store(self, timer: int) -> None:
        if self.timer is not None and self.timer != timer:
            self.handle.deleteTimer(self.timer)
        if self.timer != timer:
            self.handle.registerTimer(timer)
        self.record.update(
            (self.stage, self.cycle, self.sent, self.contacted, self.following, self.latest, timer)
        )

    def _in_turn(self, exception_id: str) -> list[dict]:
        """Steps of the messages that waited for the ones just handled."""
        said = []
        while self.early.containsKey((self.following,)):
            place = (self.following,)
            m = dict(zip(EARLY_FIELDS, self.early.getValue(place)))
            self.early.removeKey(place)
            said.append(self._step(exception_id, {**m, "exception_id": exception_id, "ord": place[0]}))
        return said

    def _step(self, exception_id: str, m: dict) -> dict:
        if m["cycle"] > self.cycle:  # a new cycle starts its own count
            self.cycle, self.sent = int(m["cycle"]), 0
        self.contacted = bool(self.contacted or m["contacted"])
        kind, resolved, late = m["kind"], self.stage == "RESOLVED", self.cycle >= 2
        action, human, reason, after = self.table[resolved, self.sent >= self.cap, self.contacted, late, kind]
        self.sent += action == "send" and not human
        self.stage = after or self.stage
        self.following = int(m["ord"]) + 1
        heads = {(True, False): (DOCUMENTS_SUBJECT, TEXT_DOCUMENTS_BODY), (True, True): (FIRST_SUBJECT, TEXT_FIRST_CONTACT_BODY)}
        subject, body = heads.get((action == "send", human), (None, None))
        return {
            **{name: m[name] for name in ("exception_id", "vendor_gstin", "ord")},
            "reply_kind": kind, "flagged": bool(m["flagged"]), "action": action,
            "text": "" if kind == "NO_REPLY" else m["text"][:TRANSCRIPT_CHARS],
            "requires_human": human, "reason": reason, "stage": self.stage, "cycle": self.cycle,
            "draft": f"{subject}{exception_id}\n\n{body}" if subject else "",
            "sent": self.sent, "contacted": self.contacted,
        }


def _plain(m: dict) -> tuple:
    """A message's fields for the state store."""
    types = (str, int, bool, str, str, bool)
    return tuple(None if m[f] is None else t(m[f]) for f, t in zip(EARLY_FIELDS, types))


def transcript(steps: DataFrame) -> DataFrame:
    """One row per message of a conversation, in and out, from the written steps."""
    said = F.when(
        F.col("reply_kind") != "NO_REPLY",
        F.struct(
            F.lit(0).alias("part"),
            F.lit("in").alias("direction"),
            F.col("reply_kind").alias("kind"),
            F.col("text").alias("text"),
        ),
    )
    sent = F.when(
        (F.col("action") == "send") & ~F.col("requires_human"),
        F.struct(
            F.lit(1).alias("part"),
            F.lit("out").alias("direction"),
            F.lit("SENT").alias("kind"),
            F.col("draft").alias("text"),
        ),
    )
    return steps.select(
        "exception_id", "ord", F.inline(F.array_compact(F.array(said, sent)))
    )


def conversation_stream(
    messages: DataFrame, config: ReconConfig = DEFAULTS, late: str = "1 day", wait_days: int = WAIT_DAYS
) -> DataFrame:
    """Decisions for a stream of messages with ``MESSAGE_FIELDS``, in any order.

    The session's state store must be RocksDB (``prepare_session`` sets it).
    """
    step = Conversations(transitions(messages.sparkSession, config), config.max_messages_per_cycle, wait_days)
    reply = classify_reply_rules(F.col("text"))
    read = (
        messages.withWatermark("sent_at", late)
        .select(*MESSAGE_FIELDS, F.unix_millis("sent_at").alias("at"), reply.alias("r"))
        .select(*MESSAGE_FIELDS, "at", F.col("r.kind").alias("kind"), F.col("r.flagged").alias("flagged"))
    )
    return read.groupBy("exception_id").transformWithStateInPandas(
        step, OUTPUT_TYPES, outputMode="Append", timeMode="EventTime"
    )
