"""Minimum-cost-flow resharding.

Bytes of every old shard and capacities of the new ones make a transport problem, solved as a
minimum-cost flow: a byte that stays costs nothing, one that moves costs 1. The flow of each old
shard cuts its documents, in a fixed order, into blocks; a block goes to one new shard. Documents of
equal text are placed as one. The largest units stay where they are while their shard has room; the
others are cut in levels by size, and each finer level evens out what whole units left uneven.

Only shard sizes, old shards times levels, and the largest units, fewer than eight a new shard, reach
the driver. Positions are running sums over a range sort, with one offset per sorted partition.

Defined cases: a NULL text has no bytes and the crc32 of an empty text; a document weighs 8 bytes
more than its text; equal texts of one old shard share a new one, unless all together they are larger
than a shard; repeated rows are rows of their own; an empty table gives an empty placement; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlane.config import DEFAULTS
from ledgerlane.llm.common import table
from ledgerlane.operators.scale import cut, lookup, rank_in_group

OLD_SHARDS = 16
NEW_SHARDS = 24
ROW_BYTES = 8
"""Bytes that a document weighs besides its text."""

LEVELS = (8, 64, 512)
"""Units above target / 8, / 64 and / 512 bytes are placed before the rest, in this order."""

_SLOT_BITS = 33  # monotonically_increasing_id keeps the partition above this bit


def min_cost_flow(
    supply: Sequence[int], capacity: Sequence[int], cost: Sequence[Sequence[int]]
) -> list[list[int]]:
    """Units from each source to each sink at the least cost, by successive shortest paths.

    Capacities must cover the supplies. Costs are per unit and not negative.
    """
    sources, sinks = len(supply), len(capacity)
    flow = [[0] * sinks for _ in supply]
    left, room = list(supply), list(capacity)
    while any(left):
        # Shortest paths from sources with supply left; a used arc can be walked back.
        far = float("inf")
        out = [0 if s else far for s in left]
        into, came_out, came_in = [far] * sinks, [-1] * sources, [-1] * sinks
        changed = True
        while changed:
            changed = False
            for i in range(sources):
                if out[i] == far:
                    continue
                for j in range(sinks):
                    if out[i] + cost[i][j] < into[j]:
                        into[j], came_in[j], changed = out[i] + cost[i][j], i, True
            for j in range(sinks):
                if into[j] == far:
                    continue
                for i in range(sources):
                    if flow[i][j] and into[j] - cost[i][j] < out[i]:
                        out[i], came_out[i], changed = into[j] - cost[i][j], j, True
        end = min((j for j in range(sinks) if room[j]), key=lambda j: into[j])
        path, j = [], end
        while True:
            i = came_in[j]
            path.append((i, j, 1))
            if came_out[i] < 0:
                break
            path.append((i, came_out[i], -1))
            j = came_out[i]
        start = path[-1][0]
        units = min(left[start], room[end], *[flow[i][j] for i, j, way in path if way < 0])
        for i, j, way in path:
            flow[i][j] += way * units
        left[start] -= units
        room[end] -= units
    return flow


def even_parts(total: int, parts: int) -> list[int]:
    return [total * (k + 1) // parts - total * k // parts for k in range(parts)]


def running(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the same keys, in ``order``.

    The rows are range-sorted and written once, so a key of any size spreads over many partitions
    and positions cannot change; each partition adds one offset per key that it holds.
    """
    part = F.shiftright("_slot", _SLOT_BITS).alias("_part")
    placed = cut(
        df.orderBy(*keys, *order)
        .withColumn("_slot", F.monotonically_increasing_id())
        .withColumn("_value", value)
    ).select("*", part)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*keys, "_part")
        .agg(F.sum("_value").alias("_sum"))
        .select(*keys, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(*keys, "_part").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .join(offsets, [*keys, "_part"])
        .withColumn(name, F.col("_inside") + F.col("_offset"))
        .drop("_slot", "_part", "_value", "_inside", "_offset")
    )


def weighed(docs: DataFrame, old_shard: Column | None = None, old_shards: int = OLD_SHARDS) -> DataFrame:
    """doc_id, size, text_crc32 and old shard; without a given layout the text's crc32 decides."""
    octets = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id",
        (F.octet_length(octets) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(octets).alias("text_crc32"),
        *([] if old_shard is None else [old_shard.alias("old")]),
    )
    return rows if old_shard is not None else rows.withColumn("old", (F.col("text_crc32") % old_shards).cast("int"))


def blocks(
    sizes: dict[int, int], rooms: list[int], new_shards: int
) -> list[tuple[int, int, int, int]]:
    """(old, from byte, to byte, new shard): a level's blocks under the rooms left."""
    old = sorted(sizes)
    stays = [[0 if i == j else 1 for j in range(new_shards)] for i in old]
    flow = min_cost_flow([sizes[i] for i in old], rooms, stays)
    out = []
    for i, row in zip(old, flow):
        start = 0
        for new, units in sorted(enumerate(row), key=lambda x: (x[0] != i, x[0])):
            if units:
                out.append((i, start, start + units, new))
                start += units
    return out


UNIT = ["old", "text_crc32", "size"]
"""What documents of equal text share; few others do, and those go together as well."""


def _settle(units: list, goal: float, new_shards: int) -> tuple[list[tuple], list[int]]:
    """A shard for each of the few large units, largest first: its own while that has room, else the emptiest."""
    loads, found = [0] * new_shards, []
    for u in sorted(units, key=lambda u: (-u["total"], u["old"], u["text_crc32"], u["size"])):
        own = u["old"]
        stays = own < new_shards and loads[own] + u["total"] <= goal
        shard = own if stays else min(range(new_shards), key=lambda j: (loads[j], j))
        loads[shard] += u["total"]
        found.append((u["old"], u["text_crc32"], u["size"], shard))
    return found, loads


def place(rows: DataFrame, new_shards: int = NEW_SHARDS) -> DataFrame:
    """The weighed rows with shard and slot: sizes near equal, few bytes moved.

    Documents of equal text in one old shard are a unit, which goes to one new shard. Only a group larger than a
    shard is cut, between its documents.
    """
    spark = rows.sparkSession
    rows = cut(rows)
    units = cut(rows.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total")))
    total = units.agg(F.sum("total")).first()[0] or 0
    over = (F.col("n") > 1) & (F.col("total") * new_shards > total)
    large = F.col("total") * LEVELS[0] * new_shards > total
    # Large units are fewer than LEVELS[0] times the shards, whatever the input.
    settled, loads = _settle(units.where(~over & large).collect(), total / new_shards, new_shards)
    done = sum(loads)

    weight = F.when(over, F.col("size")).otherwise(F.col("total"))
    level = F.lit(len(LEVELS))
    for k, part in reversed(list(enumerate(LEVELS))):
        level = F.when(weight * part * new_shards > total, k).otherwise(level)
    left = units.where(over | ~large).withColumn("over", over).withColumn("level", level)
    ordered = cut(running(left, ["level", "old"], ["text_crc32", "size"], F.col("total"), "before"))
    # Documents of a group that is cut follow one another from where it begins; there are fewer groups than shards.
    groups = F.broadcast(ordered.where("over").select(*UNIT, "level", F.col("before").alias("first")))
    parts = cut(running(rows.join(groups, UNIT), UNIT, ["doc_id"], F.col("size"), "inside")
                .withColumn("before", F.col("first") + F.col("inside")).drop("first", "inside"))

    sizes: dict[int, dict[int, int]] = {}
    for r in ordered.groupBy("level", "old").agg(F.sum("total").alias("size")).collect():
        sizes.setdefault(r["level"], {})[r["old"]] = r["size"]
    schema = "level int, old int, start long, stop long, shard int"
    cuts = []
    units_middle = 2 * F.col("before") + F.col("total")  # twice the middle
    parts_middle = 2 * F.col("before") + F.col("size")
    for at in sorted(sizes):
        here = sum(sizes[at].values())
        done += here
        rooms = [max(0, goal - load) for goal, load in zip(even_parts(done, new_shards), loads)]
        excess = sum(rooms) - here  # where a shard is beyond its part already, the others get less
        while excess > 0:
            k = max(range(new_shards), key=lambda j: rooms[j] + loads[j] if rooms[j] else -1)
            less = min(rooms[k], max(1, excess // new_shards))
            rooms[k] -= less
            excess -= less
        found = spark.createDataFrame(part := [(at, *b) for b in blocks(sizes[at], rooms, new_shards)], schema)
        cuts += part
        mine = _blocked(ordered.where((F.col("level") == at) & ~F.col("over")), found, units_middle).select("shard", "total")
        cut_up = _blocked(parts.where(F.col("level") == at), found, parts_middle)
        for r in mine.unionByName(cut_up.select("shard", F.col("size").alias("total"))).groupBy("shard").agg(F.sum("total").alias("size")).collect():
            loads[r["shard"]] += r["size"]
    everywhere = spark.createDataFrame(cuts, schema)
    whole = _blocked(ordered.where(~F.col("over")), everywhere, units_middle).select(*UNIT, "shard")
    first = spark.createDataFrame(settled, "old int, text_crc32 long, size long, shard int")
    # A text may hold a third of the rows and few bytes: such units are looked up by broadcast.
    placed = lookup(rows, whole.unionByName(first), UNIT, "inner", DEFAULTS.hot_key_rows)
    placed = placed.unionByName(_blocked(parts, everywhere, parts_middle).select(*rows.columns, "shard"))
    return running(placed, ["shard"], ["old", "text_crc32", "size", "doc_id"], F.lit(1), "slot")


def _blocked(rows: DataFrame, cuts: DataFrame, middle: Column) -> DataFrame:
    """Each row joins the one block that holds its middle; there are at most levels x shards blocks."""
    within = (middle > 2 * F.col("start")) & (middle <= 2 * F.col("stop"))
    small = F.broadcast(cuts.withColumnsRenamed({"level": "_level", "old": "_old"}))
    same = (F.col("level") == F.col("_level")) & (F.col("old") == F.col("_old"))
    return rows.join(small, same & within).drop("_level", "_old", "start", "stop")


def least_moved(old_sizes: Sequence[int], new_shards: int = NEW_SHARDS) -> int:
    """Bytes that any move to even shards must take at least, documents aside: one flow over whole shards."""
    stays = [[0 if i == j else 1 for j in range(new_shards)] for i in range(len(old_sizes))]
    flow = min_cost_flow(old_sizes, even_parts(sum(old_sizes), new_shards), stays)
    return sum(units for i, row in enumerate(flow) for j, units in enumerate(row) if i != j)


def moves(placed: DataFrame) -> DataFrame:
    """Bytes and rows that go from each old shard to each new one."""
    return placed.groupBy("old", "shard").agg(
        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")
    )


def rewrite(docs: DataFrame, placed: DataFrame, path: str) -> list[int]:
    """Write the new files of the shards that gain or lose documents.

    Files lie below ``shard=N`` in slot order, in pieces of about equal row counts; the folder takes the place of
    a column ``shard`` of the documents. Returns the shards written. ``docs`` must be the rows that were placed; ids may be NULL or repeated, as a document is
    found by id, text and its number among equals.
    """
    touched = placed.where("old != shard")
    shards = sorted(
        r[0]
        for r in touched.select(F.explode(F.array("old", "shard")).alias("s")).distinct().collect()
    )
    octets = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    nested = docs.select(
        F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.crc32(octets).alias("crc"),
        (F.octet_length(octets) + ROW_BYTES).cast("long").alias("weight"),
    )
    named = rank_in_group(nested, ["id", "crc", "weight"], ["crc"], "nth", DEFAULTS.hot_key_rows)
    seats = placed.select(
        F.col("doc_id").alias("_id"), F.col("text_crc32").alias("_crc"), F.col("size").alias("_weight"), "shard", "slot"
    )
    seats = rank_in_group(seats, ["_id", "_crc", "_weight"], ["slot"], "_nth", DEFAULTS.hot_key_rows)
    same = F.col("id").eqNullSafe(F.col("_id"))
    for name in ("crc", "weight", "nth"):
        same = same & (F.col(name) == F.col(f"_{name}"))
    rows = named.join(seats.where(F.col("shard").isin(shards)), same).select("row", "shard", "slot")
    (
        rows.repartitionByRange("shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .select(*[F.col("row")[c].alias(c) for c in docs.columns if c.lower() != "shard"], "shard")
        .write.partitionBy("shard")
        .parquet(path)
    )
    return shards


def op9_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, laid out in 16 shards by their text, moved to 24 shards of near equal bytes."""
    placed = place(weighed(table(spark, sf_dir, "documents")))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("old").alias("old_shard"),
    )
