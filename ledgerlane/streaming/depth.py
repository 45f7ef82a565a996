"""Queue depth kept current over a stream of queue events, in a snapshot that is replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from ledgerlane.functions.money import MONEY

DEPTH_TYPES = f"pending bigint, resolved bigint, amount_awaiting_review {MONEY}, batch_id bigint"
SLOTS = 2
"""Snapshots kept: the last one, and the one that the next trigger goes on from."""


def queue_depth(events: DataFrame) -> DataFrame:
    """Pending and resolved cards and the amount waiting.

    ``events``: exception_id, event (``queued`` or ``resolved``), amount_at_risk. Each card is
    queued once and resolved at most once, so plain signed sums keep the figures without any
    per-card state.
    """
    queued, resolved = F.col("event") == "queued", F.col("event") == "resolved"
    signed = F.when(queued, F.col("amount_at_risk")).otherwise(-F.col("amount_at_risk"))
    return events.groupBy().agg(
        (F.count_if(queued) - F.count_if(resolved)).alias("pending"),
        F.count_if(resolved).alias("resolved"),
        F.coalesce(F.sum(signed), F.lit(0)).cast(MONEY).alias("amount_awaiting_review"),
    )


def depth_stream(events: DataFrame, table: str, checkpoint: str, late: str = "1 day") -> StreamingQuery:
    """Keep the depth of ``events`` (with their time ``at``) in ``table``.

    An event that comes again within ``late`` of its first time counts once; the state of older ones
    goes. Each trigger adds its own sums to the snapshot before it and replaces the one before that, so
    the table's size does not grow, a trigger that runs again after a crash gives the same, and a
    reader finds a whole snapshot while the other is written.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        earlier = (batch_id - 1) % SLOTS  # not the slot that is written
        before = _snapshots(batch.sparkSession, table, [earlier]).where(F.col("batch_id") == batch_id - 1)
        parts = queue_depth(batch).unionByName(before.drop("batch_id"))
        total = parts.agg(*[F.sum(c).cast(batch_types[c]).alias(c) for c in batch_types])
        total.withColumn("batch_id", F.lit(batch_id).cast("long")).coalesce(1).write.mode("overwrite").parquet(
            f"{table}/slot={batch_id % SLOTS}"
        )

    batch_types = {"pending": "long", "resolved": "long", "amount_awaiting_review": MONEY}
    return (
        events.withWatermark("at", late)
        .dropDuplicatesWithinWatermark(["exception_id", "event"])
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _snapshots(spark: SparkSession, table: str, slots: list[int]) -> DataFrame:
    found = spark.createDataFrame([], DEPTH_TYPES)
    for slot in slots:
        try:
            found = found.unionByName(spark.read.schema(DEPTH_TYPES).parquet(f"{table}/slot={slot}"))
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
    return found


def latest_depth(spark: SparkSession, table: str) -> DataFrame:
    return _snapshots(spark, table, list(range(SLOTS))).orderBy(F.desc("batch_id")).limit(1)
