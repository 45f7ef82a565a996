"""Hash tree over chained logs: short proofs that an entry is in a log and that a log only grew.

The leaves are the digests of a chain's entries, taken from their content and placed by sequence. Two
neighbours make a node once both are complete, so a node never changes as the log grows. What has no
neighbour yet is a peak; a log of n entries has a peak for each bit of n. The seal of a chain is a digest
of its length and peaks. Entry i is proved by the nodes beside its way up to a peak; an older seal by
such a way for each of its peaks. One rule holds at every size and no walk along a chain is needed.

Work goes by blocks of ``2**height`` nodes: one exchange over the entries, then one over a ``2**height``-th
of the rows for each step up. A block is one row; nothing else is gathered by chain than a row a level.
Chain ids are not NULL. An entry without sequence stands at -1 and repeated sequences share a leaf of
their own kind; neither ever gives the seal of a sound log. An empty log has no seals.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlane.config import DEFAULTS, ReconConfig
from ledgerlane.functions import digests
from ledgerlane.operators.audit import entry_digest
from ledgerlane.operators.scale import broadcast_if_small, cut, lookup

HEIGHT = 10


@dataclass(frozen=True)
class HashTree:
    """Blocks of each step (``chain_id, block, levels``): ``levels[k]`` are the nodes k levels up."""

    steps: list[DataFrame]
    height: int


def _right(value: Column, bits: Column) -> Column:
    return F.call_function("shiftright", value, bits.cast("int"))


def _low_bits(value: Column, bits: Column) -> Column:
    return value - F.call_function("shiftleft", _right(value, bits), bits.cast("int"))


def _node(left: Column, right: Column) -> Column:
    return digests.sha256_hex(F.concat(F.lit("N"), left, right))


def leaf(digest: Column) -> Column:
    return digests.sha256_hex(F.concat(F.lit("L"), digest))


def _levels(nodes: Column, height: int) -> Column:
    """The given nodes and all complete nodes above them, level by level."""

    def above(level: Column) -> Column:
        pairs = F.floor(F.size(level) / 2).cast("int")
        made = F.transform(
            F.sequence(F.lit(1), pairs), lambda i: _node(F.get(level, i * 2 - 2), F.get(level, i * 2 - 1))
        )
        return F.when(pairs > 0, made).otherwise(F.array().cast("array<string>"))

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(height)),
        F.array(nodes),
        lambda done, _: F.concat(done, F.array(above(F.element_at(done, -1)))),
    )


def _is_complete(levels: Column, height: int) -> Column:
    return F.size(F.get(levels, F.lit(0))) == 1 << height


def _blocks(nodes: DataFrame, height: int) -> DataFrame:
    """Blocks of nodes (``chain_id, block, place, node``, no place twice)."""
    return nodes.groupBy("chain_id", "block").agg(
        F.sort_array(F.collect_list(F.struct("place", "node"))).alias("nodes")
    ).select("chain_id", "block", _levels(F.col("nodes.node"), height).alias("levels"))


def build(log: DataFrame, height: int = HEIGHT) -> HashTree:
    """The tree over the entries of a log as they read now, whatever digest they carry."""
    place = F.coalesce("sequence", F.lit(-1)).cast("long")
    bits = F.lit(height)
    # Exchanged by block, the entries are then grouped by place and by block where they lie.
    placed = (
        log.select("chain_id", place.alias("place"), entry_digest().alias("digest"))
        .withColumn("block", _right(F.col("place"), bits))
        .repartition("chain_id", "block")
        .groupBy("chain_id", "block", "place")
        .agg(F.count(F.lit(1)).alias("n"), F.min("digest").alias("low"), F.max("digest").alias("high"))
    )
    repeated = F.concat_ws(",", F.lit("repeated"), F.col("n").cast("string"), "low", "high")
    nodes = placed.select(
        "chain_id", "block", "place", leaf(F.when(F.col("n") == 1, F.col("low")).otherwise(repeated)).alias("node")
    )
    steps = []
    while not steps or not nodes.isEmpty():
        steps.append(cut(_blocks(nodes, height)))
        nodes = steps[-1].where(_is_complete(F.col("levels"), height) & (F.col("block") >= 0)).select(
            "chain_id",
            _right(F.col("block"), bits).alias("block"),
            F.col("block").alias("place"),
            F.get(F.get("levels", F.lit(height)), F.lit(0)).alias("node"),
        )
    return HashTree(steps, height)


def _root(entries: Column, peaks: Column) -> Column:
    text = F.transform(peaks, lambda p: F.concat(p["level"].cast("string"), F.lit("="), p["digest"]))
    return digests.sha256_hex(F.concat(F.lit("R"), entries.cast("string"), F.lit(":"), F.array_join(text, ",")))


def seals(tree: HashTree) -> DataFrame:
    """``chain_id, entries, peaks, root`` of each chain, highest peak first."""
    found = None
    for step, blocks in enumerate(tree.steps):
        base = step * tree.height
        odd = F.filter(
            F.sequence(F.lit(0), F.lit(tree.height - 1)), lambda k: F.size(F.get(F.col("levels"), k)) % 2 == 1
        )
        peaks = blocks.select("chain_id", F.explode(F.transform(odd, lambda k: F.struct(
            (k + base).alias("level"), F.element_at(F.get(F.col("levels"), k), -1).alias("digest")
        ))).alias("peak")).select("chain_id", "peak.*")
        found = peaks if found is None else found.unionByName(peaks)
    # A sound log has one peak a level; a damaged one may have any number, which are told apart by count.
    level = found.groupBy("chain_id", "level").agg(
        F.count(F.lit(1)).alias("n"), F.min("digest").alias("low"), F.max("digest").alias("high")
    ).select(
        "chain_id", "level", "n",
        F.when(F.col("n") == 1, F.col("low"))
        .otherwise(F.concat_ws(",", F.lit("repeated"), F.col("n").cast("string"), "low", "high")).alias("digest"),
    )
    return level.groupBy("chain_id").agg(
        F.sum(F.col("n") * F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level"))).alias("entries"),
        F.sort_array(F.collect_list(F.struct("level", "digest")), asc=False).alias("peaks"),
    ).withColumn("root", _root(F.col("entries"), F.col("peaks")))


def marks(tree: HashTree) -> DataFrame:
    """One digest a block of entries (``chain_id, block, entries, mark``): they tell where two logs differ."""
    nodes = F.get("levels", F.lit(0))
    return tree.steps[0].select(
        "chain_id", "block", F.size(nodes).cast("long").alias("entries"),
        digests.sha256_hex(F.array_join(nodes, "")).alias("mark"),
    )


def _beside(levels: Column, start: Column, local: Column, height: int) -> Column:
    """Nodes beside the way up from node ``local`` of level ``start`` of a block, as far as they exist."""
    steps = F.sequence(start.cast("int"), F.lit(height - 1))

    def at(k: Column) -> Column:
        return _right(local, k - start)

    def beside(k: Column) -> Column:
        return at(k).bitwiseXOR(F.lit(1).cast("long"))

    def exists(k: Column) -> Column:
        return F.greatest(at(k), beside(k)) < F.size(F.get(levels, k))

    return F.transform(F.filter(steps, exists), lambda k: F.get(F.get(levels, k), beside(k).cast("int")))


def _with_ways(tree: HashTree) -> list[DataFrame]:
    """Each step's blocks with ``above``: the nodes beside the way up from the block's own node.

    From the top down: a block meets the one block above it, which at most ``2**height`` blocks share.
    """
    none = F.array().cast("array<string>")
    ways = [tree.steps[-1].withColumn("above", none)]
    for blocks in reversed(tree.steps[:-1]):
        bits = F.lit(tree.height)
        upper = ways[0].select(
            "chain_id", F.col("block").alias("upper"), F.col("levels").alias("upper_levels"),
            F.col("above").alias("upper_above"),
        )
        beside = _beside(F.col("upper_levels"), F.lit(0), _low_bits(F.col("block"), bits), tree.height)
        further = F.when(_is_complete(F.col("upper_levels"), tree.height), F.col("upper_above")).otherwise(none)
        above = F.when(_is_complete(F.col("levels"), tree.height), F.concat(beside, further))
        ways.insert(0, blocks.withColumn("upper", _right(F.col("block"), bits)).join(
            upper, ["chain_id", "upper"], "left"
        ).select("chain_id", "block", "levels", F.coalesce(above, none).alias("above")))
    return ways


def _asked(tree: HashTree, nodes: DataFrame, step: int) -> DataFrame:
    """The asked nodes that lie in blocks of a step, with their block."""
    rest = F.lit((step + 1) * tree.height) - F.col("level")
    return nodes.where(F.floor(F.col("level") / tree.height) == step).withColumn("block", _right(F.col("index"), rest))


def prove(tree: HashTree, nodes: DataFrame, config: ReconConfig = DEFAULTS) -> DataFrame:
    """``digest`` and ``path`` of the asked nodes (``chain_id, level, index``); level 0 are the entries.

    Nodes that the tree does not have give no row. Blocks of entries that hold no asked node are left out before
    anything moves: an older seal asks for a few of them, whatever the size of the log.
    """
    wanted = broadcast_if_small(
        _asked(tree, nodes, 0).select("chain_id", "block").distinct(), config.broadcast_rows
    )
    held = tree.steps[0].join(wanted, ["chain_id", "block"], "left_semi")
    found = None
    for step, blocks in enumerate(_with_ways(HashTree([held, *tree.steps[1:]], tree.height))):
        start = F.col("level") - step * tree.height
        local = _low_bits(F.col("index"), F.lit(tree.height) - start)
        own = F.get(F.get(F.col("levels"), start.cast("int")), local.cast("int"))
        path = F.concat(_beside(F.col("levels"), start, local, tree.height), "above")
        proved = _asked(tree, nodes, step).join(blocks, ["chain_id", "block"]).select(
            "chain_id", "level", "index", own.alias("digest"), path.alias("path")
        ).where("digest IS NOT NULL")
        found = proved if found is None else found.unionByName(proved)
    return found


def prove_entries(tree: HashTree, entries: DataFrame) -> DataFrame:
    """Proofs for entries given by ``chain_id, sequence``."""
    level = F.lit(0).alias("level")
    return prove(tree, entries.select("chain_id", level, F.col("sequence").cast("long").alias("index")))


def prove_growth(tree: HashTree, older: DataFrame, config: ReconConfig = DEFAULTS) -> DataFrame:
    """Proofs for each peak of older seals of the same chains."""
    peaks = older.select("chain_id", "entries", F.explode("peaks").alias("peak"))
    level = F.col("peak.level")
    return prove(tree, peaks.select(
        "chain_id", level.alias("level"), (_right(F.col("entries"), level) - 1).alias("index")
    ), config)


def _folded() -> Column:
    turns = F.transform("path", lambda d, i: F.struct(
        d.alias("beside"), (_right(F.col("index"), i) % 2 == 1).alias("is_left")
    ))
    return F.aggregate(turns, F.col("digest"), lambda own, turn: F.when(
        turn["is_left"], _node(turn["beside"], own)
    ).otherwise(_node(own, turn["beside"])))


def verify(proofs: DataFrame, trusted: DataFrame, config: ReconConfig = DEFAULTS) -> DataFrame:
    """The proofs with ``holds``: folded, they give the peak of the trusted seal that covers the node.

    Only the proof and the seal are used, and the seal must have the root that its peaks give. For an entry that is at
    hand, ``digest`` should be ``leaf(entry_digest())`` of it.
    """
    top = F.col("level") + F.size("path")
    covered = _right(F.col("index"), F.size("path")) == _right(F.col("entries"), top) - 1
    reached = F.exists("peaks", lambda p: (p["level"] == F.col("top")) & (p["digest"] == F.col("folded")))
    sound = _root(F.col("entries"), F.col("peaks")) == F.col("root")
    sealed = trusted.where(sound).select("chain_id", "entries", "peaks")
    folded = proofs.withColumn("top", top).withColumn("folded", _folded())
    placed = lookup(folded, sealed, ["chain_id"], "left", config.hot_key_rows)
    return placed.withColumn("holds", F.coalesce(covered & reached, F.lit(False))).select(
        *proofs.columns, "holds"
    )


def verify_growth(
    proofs: DataFrame, older: DataFrame, newer: DataFrame, config: ReconConfig = DEFAULTS
) -> DataFrame:
    """Per chain of the older seals, ``grew``: each of their peaks is proved to lie in the newer seal."""
    sound = _root(F.col("entries"), F.col("peaks")) == F.col("root")
    peaks = older.select("chain_id", sound.alias("sound"), F.explode("peaks").alias("peak")).select(
        "chain_id", "sound", F.col("peak.level").alias("level"), F.col("peak.digest").alias("sealed")
    )
    held = verify(proofs, newer, config).where("holds").select("chain_id", "level", "digest")
    return peaks.join(held, ["chain_id", "level"], "left").groupBy("chain_id").agg(
        F.bool_and(F.coalesce(F.col("sound") & (F.col("digest") == F.col("sealed")), F.lit(False))).alias("grew")
    )


def verify_seals(tree: HashTree, trusted: DataFrame, sealed_marks: DataFrame) -> DataFrame:
    """Per chain: whether a log has its trusted seal, else the first block of entries that differs."""
    size = 1 << tree.height
    now = marks(tree).select("chain_id", "block", F.col("mark").alias("now"))
    changed = (
        now.join(sealed_marks.select("chain_id", "block", F.col("mark").alias("then")), ["chain_id", "block"], "full")
        .where(~F.col("now").eqNullSafe(F.col("then")))
        .groupBy("chain_id").agg(F.min("block").alias("block"))
    )
    first = F.col("block") * size
    told = F.concat(
        F.lit("entries "), first.cast("string"), F.lit(" to "), (first + size - 1).cast("string"),
        F.lit(" are not those that were sealed"),
    )
    found = seals(tree).select("chain_id", "entries", F.col("root").alias("found"))
    sealed = trusted.select("chain_id", "root")
    same = F.col("found").eqNullSafe(F.col("root"))
    return (
        found.join(sealed, "chain_id", "full").join(changed, "chain_id", "left")
        .select(
            "chain_id", F.coalesce("entries", F.lit(0)).alias("entries"), same.alias("intact"),
            F.when(same, F.lit("sealed"))
            .when(F.col("root").isNull(), F.lit("no seal"))
            .when(F.col("found").isNull(), F.lit("no entries"))
            .otherwise(F.coalesce(told, F.lit("seal differs"))).alias("message"),
        )
    )
