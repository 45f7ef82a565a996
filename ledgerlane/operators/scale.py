"""Building blocks that keep every operator balanced when one key holds much of the data.

``row_number`` over a key and a shuffled join on a key both send the whole key to one task. The
helpers here find the few keys for which that matters and give them another exact route.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOT_KEY_LIMIT = 10_000
"""Hot keys treated apart. The next largest key then has at most 1/10,001 of all rows."""
HASHES = 10_000
"""Key hashes that rows are counted by before keys are."""

_SLOT_BITS = 33  # monotonically_increasing_id keeps the partition above this bit
_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's part of the cluster's shared folder, for cut tables.

    Where no folder is set, local mode makes one that goes when the process ends.
    """
    app = spark.sparkContext.applicationId
    configured = spark.conf.get("spark.checkpoint.dir", None)
    configured = configured or spark.sparkContext.getCheckpointDir()
    if configured:
        return f"{configured}/{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if app not in _local_dirs:
        _local_dirs[app] = run_folder()
    return _local_dirs[app]


def run_folder() -> str:
    """A folder on this machine that goes when the process ends."""
    path = tempfile.mkdtemp(prefix="ledgerlane-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write a table once and read it back: short lineage that outlives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/ledgerlane-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hot_groups(df: DataFrame, keys: list[str], hot_rows: int | None) -> DataFrame | None:
    """Keys with more than ``hot_rows`` rows (at most the 10,000 largest), or None.

    Rows are counted by a hash of the key first, combined map-side: where no hash has more rows than
    the threshold no key has, and the keys themselves are never shuffled. That takes one pass; a caller
    that already knows passes ``hot_rows=None``.
    """
    if hot_rows is None:
        return None
    by_hash = df.groupBy(F.pmod(F.xxhash64(*keys), F.lit(HASHES)).alias("_hash")).agg(F.count(F.lit(1)).alias("_rows"))
    if (by_hash.agg(F.max("_rows")).first()[0] or 0) <= hot_rows:
        return None
    largest = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > hot_rows)
        .orderBy(F.desc("_rows"))
        .limit(HOT_KEY_LIMIT)
        .select(*keys)
    )
    rows = largest.collect()
    if not rows:
        return None
    return F.broadcast(df.sparkSession.createDataFrame(rows, largest.schema))


def split_hot(
    df: DataFrame, keys: list[str], hot_rows: int | None
) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary keys, rows of hot keys or None)."""
    hot = hot_groups(df, keys, hot_rows)
    if hot is None:
        return df, None
    return df.join(hot, keys, "left_anti"), df.join(hot, keys, "left_semi")


def global_index(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Consecutive 0-based position of each row in ``order``, which must be a total order.

    A range sort spreads the rows; only one count per output partition is summed centrally. The
    sorted rows are written once so that positions cannot change between reads.
    """
    placed = cut(df.orderBy(*order).withColumn("_slot", F.monotonically_increasing_id()))
    part = F.shiftright("_slot", _SLOT_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    in_part = F.col("_slot").bitwiseAND(F.lit((1 << _SLOT_BITS) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, in_part + F.col("_offset"))
        .drop("_slot", "_part", "_offset")
    )


def rank_cold(df: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def rank_hot(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """1-based rank inside each of a bounded number of very large groups."""
    indexed = global_index(df, [*keys, *order], "_index")
    starts = indexed.groupBy(*keys).agg(F.min("_index").alias("_start"))
    return (
        indexed.join(F.broadcast(starts), keys)
        .withColumn(name, F.col("_index") - F.col("_start") + 1)
        .drop("_index", "_start")
    )


def rank_in_group(
    df: DataFrame, keys: list[str], order: list[str], name: str, hot_rows: int | None
) -> DataFrame:
    """1-based rank of each row inside its key, whatever the size of the key."""
    cold, hot = split_hot(df, keys, hot_rows)
    ranked = rank_cold(cold, keys, order, name).withColumn(name, F.col(name).cast("long"))
    if hot is None:
        return ranked
    return ranked.unionByName(rank_hot(hot, keys, order, name))


def rank_zip(
    left: DataFrame, right: DataFrame, keys: list[str], order: str, hot_rows: int | None
) -> DataFrame:
    """Pair the k-th left row with the k-th right row of each key, in ``order``.

    Same answer as walking the left side in order and taking the first unused right row, because
    every row of a key accepts every other. Output: keys, ``left`` and ``right`` structs, one of
    them NULL where a side ran out. Both sides travel through one exchange on the keys; the
    ranking and the pairing reuse it.
    """
    def side(df: DataFrame, tag: int) -> DataFrame:
        mine, other = ("left", "right") if tag == 0 else ("right", "left")
        other_df = right if tag == 0 else left
        return df.select(
            *keys,
            F.lit(tag).alias("_side"),
            F.col(order).alias("_order"),
            F.struct(*df.columns).alias(mine),
            F.lit(None).cast(other_df.schema).alias(other),
        )

    both = side(left, 0).unionByName(side(right, 1))
    group = [*keys, "_side"]

    def pair(ranked: DataFrame) -> DataFrame:
        return ranked.groupBy(*keys, "_rank").agg(
            F.max("left").alias("left"), F.max("right").alias("right")
        )

    # Hot means hot over both sides together, so both sides of a key take the same route.
    cold, hot = split_hot(both, keys, hot_rows)
    ranked = rank_cold(cold.repartition(*keys), group, ["_order"], "_rank")
    paired = pair(ranked.withColumn("_rank", F.col("_rank").cast("long")))
    if hot is not None:
        paired = paired.unionByName(pair(rank_hot(hot, group, ["_order"], "_rank")))
    return paired.drop("_rank")


def lookup(
    left: DataFrame, right: DataFrame, keys: list[str], how: str, hot_rows: int | None
) -> DataFrame:
    """Join many rows to a table with one row per key.

    Hot keys of the left side meet their (at most 10,000) right rows by broadcast; the rest is
    an ordinary join. ``how`` is inner, left, left_semi or left_anti.
    """
    hot = hot_groups(left, keys, hot_rows)
    if hot is None:
        return left.join(right, keys, how)
    few = F.broadcast(right.join(hot, keys, "left_semi"))
    return (
        left.join(hot, keys, "left_anti")
        .join(right, keys, how)
        .unionByName(left.join(hot, keys, "left_semi").join(few, keys, how))
    )


def broadcast_if_small(df: DataFrame, limit: int) -> DataFrame:
    """Broadcast a side only after counting it."""
    return F.broadcast(df) if df.count() <= limit else df


def fan_out(df: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """Spread rows that cost much more to process than to move.

    Adaptive execution sizes partitions by bytes and would hand a short table to one task; a
    stated partition count is left alone.
    """
    partitions = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, key)


def side_by_side(*rows: DataFrame) -> DataFrame:
    """One-row tables with different columns as one row. No join is involved."""
    stacked = rows[0]
    for more in rows[1:]:
        stacked = stacked.unionByName(more, allowMissingColumns=True)
    return stacked.agg(*[F.max(name).alias(name) for name in stacked.columns])
