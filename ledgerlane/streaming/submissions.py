"""Submission stream: every micro-batch against the durable ledger, each key applied once.

A batch that is run again after a crash finds its own keys in the ledger and replays them, so
the checkpoint and the ledger need not be committed together. Several streams may share a ledger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ledgerlane.config import DEFAULTS, ReconConfig
from ledgerlane.sources import tables


def submit_batch(folder: str, config: ReconConfig = DEFAULTS):
    def apply(batch: DataFrame, batch_id: int) -> None:
        tables.submit_to_ledger(batch, folder, config)

    return apply


def submission_stream(
    submissions: DataFrame, folder: str, checkpoint: str, config: ReconConfig = DEFAULTS
) -> StreamingQuery:
    """Start a query that applies all submissions available now to the ledger in ``folder``."""
    return (
        submissions.writeStream.foreachBatch(submit_batch(folder, config))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
