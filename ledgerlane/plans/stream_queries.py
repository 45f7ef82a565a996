"""Registered queries: the streams, run over everything available, and the generated cycle."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane.operators import review
from ledgerlane.operators.scale import shared_dir
from ledgerlane.plans import reconcile
from ledgerlane.plans.decision_queries import (
    decisions,
    derived_approvals,
    presented_submissions,
)
from ledgerlane.plans.ledger_queries import as_double
from ledgerlane.sources import derived, generated, tables
from ledgerlane.streaming import conversations, depth, submissions

STREAM_FILES = 4
"""Files that a stream reads at a time."""


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _as_stream(df: DataFrame, folder: str, per_trigger: int = STREAM_FILES) -> DataFrame:
    """Write a table as it is partitioned and read it as a stream of files."""
    df.write.parquet(folder)
    return (
        df.sparkSession.readStream.schema(df.schema)
        .option("maxFilesPerTrigger", per_trigger)
        .parquet(folder)
    )


def stream_submit(spark, sf_dir) -> DataFrame:
    """The ledger after two streams ran over the same input at the same time, and one again without its
    checkpoint."""
    folder = _folder(spark, "submissions")
    stream = _as_stream(presented_submissions(spark, sf_dir), f"{folder}/input")
    for attempt in (("one", "other"), ("again",)):
        running = [
            submissions.submission_stream(stream, f"{folder}/state", f"{folder}/{name}") for name in attempt
        ]
        for query in running:
            query.awaitTermination()
    ledger = tables.read_ledger(spark, f"{folder}/state")
    return ledger.groupBy("document_id", "action", "idempotency_key").agg(
        F.count(F.lit(1)).alias("applied_rows")
    )


def conversation_messages(turns: DataFrame) -> DataFrame:
    """Conversation turns as supplier messages."""
    c = F.col("conv_id")
    return turns.select(
        F.format_string("E%05d", c).alias("exception_id"),
        F.concat(F.lit("V"), c.cast("string")).alias("vendor_gstin"),
        F.floor(F.col("turn") / 3).cast("int").alias("cycle"),
        ((c % 4 != 0) | (F.col("turn") > 1)).alias("contacted"),
        F.col("turn").alias("ord"),
        F.when(c % 3 == 0, F.concat("text", F.lit(" Please send a copy.")))
        .otherwise(F.col("text"))
        .alias("text"),
        F.lit(dt.datetime(2026, 7, 14)).alias("sent_at"),  # the table has no times
    )


SHUFFLED_TRIGGERS = 6
"""Triggers over which the turns of a conversation are spread."""


def stream_recovery(spark, sf_dir) -> DataFrame:
    """All conversations through the stateful stream, their turns dealt over files and triggers by hash:
    later turns mostly arrive first, and wait in state for theirs.
    """
    folder = _folder(spark, "conversations")
    table = derived.table(spark, sf_dir, "conversations")
    files = max(2 * SHUFFLED_TRIGGERS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = table.repartition(files, F.xxhash64("conv_id", "turn"))
    stream = _as_stream(dealt, f"{folder}/input", -(-files // SHUFFLED_TRIGGERS))
    query = (
        conversations.conversation_stream(conversation_messages(stream))
        .writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(
        "exception_id", "ord", "reply_kind", "action", "requires_human", "reason", "stage",
        F.col("sent").cast("long").alias("sent"),
    )


def stream_depth(spark, sf_dir) -> DataFrame:
    """Depth over every queue event told twice, dealt over files by hash."""
    folder = _folder(spark, "depth")
    queue = review.build_review_queue(decisions(spark, sf_dir))
    resolved = review.resolve_approvals(queue, derived_approvals(queue)).where(
        "status = 'resolved'"
    )
    events = queue.select(
        "exception_id", F.lit("queued").alias("event"), "amount_at_risk"
    ).unionByName(resolved.select("exception_id", F.lit("resolved").alias("event"), "amount_at_risk"))
    timed = events.withColumn("at", F.lit(dt.datetime(2026, 7, 14)))  # the queue has no times
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    twice = timed.withColumn("n", F.explode(F.array(F.lit(0), F.lit(1))))
    dealt = twice.repartition(files, F.xxhash64("exception_id", "event", "n")).drop("n")
    stream = _as_stream(dealt, f"{folder}/input", -(-files // STREAM_FILES))
    depth.depth_stream(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return depth.latest_depth(spark, f"{folder}/out").select(
        "pending", "resolved", as_double("amount_awaiting_review")
    )


BASE_DATE = dt.date(2026, 7, 14)


def generate_cycle(spark, sf_dir) -> DataFrame:
    """A generated cycle with one document per order, reconciled and held against its truth."""
    orders = derived.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    made = generated.generate_cycle(
        derived.spread(orders, "id"),
        seed=20260726,
        period="07-2026",
        base_date=BASE_DATE,
        vendor_count=400,
    )
    result = reconcile.reconcile(made.books, made.portal, as_of=BASE_DATE)
    truth = made.truth.select("exception_key", F.col("exception_class").alias("planted"))
    anchor = F.regexp_extract("exception_id", "^E[0-9]+-(.*)$", 1)
    labelled = result.exceptions.withColumn("exception_key", anchor).join(
        truth, "exception_key", "left"
    )
    classes = labelled.groupBy("exception_class").agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(F.col("planted") == F.col("exception_class")).alias("as_planted"),
    )
    caught = result.matched.join(
        made.near_misses.withColumn("near", F.lit(True)),
        ["book_line_id", "portal_line_id"],
        "left",
    )
    kinds = caught.groupBy(
        F.when(F.col("exact"), "EXACT").otherwise("FUZZY").alias("exception_class")
    ).agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(F.coalesce("near", F.lit(False)) != F.col("exact")).alias("as_planted"),
    )
    return classes.unionByName(kinds)


QUERIES = {
    "generate_cycle": generate_cycle,
    "stream_submit": stream_submit,
    "stream_recovery": stream_recovery,
    "stream_depth": stream_depth,
}
