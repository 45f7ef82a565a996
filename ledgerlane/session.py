"""Session settings the jobs are written for. All are runtime SQL settings."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # HotSpot never compiles a method above 8,000 bytes, so a fused stage above that would run
    # interpreted. Below this limit Spark runs such a stage operator by operator instead, each
    # compiled. Wide text parsing stages are about four times faster for it.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Times are recorded and compared in UTC.
    "spark.sql.session.timeZone": "UTC",
    # States of streams lie on disk, entry by entry; maps and timers of a key need this store.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def prepare_session(spark: SparkSession) -> SparkSession:
    for name, value in SETTINGS.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark
