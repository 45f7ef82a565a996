"""The hash tree over audit logs, against a plain tree."""

import datetime as dt
import hashlib
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlane import ReconConfig
from ledgerlane.operators import audit, hashtree
from ledgerlane.sources import tables

NOW = dt.datetime(2026, 7, 10, 9, 0, tzinfo=dt.timezone.utc)
HEIGHT = 2
SIZES = {"a": 1, "b": 4, "c": 5, "d": 16, "e": 23, "f": 64, "g": 7}


def entries(spark, sizes=SIZES):
    rows = [
        (chain, i, f"{chain}{i}", "PENDING", False, ["r"], NOW, "2026.07", "", "", None, [], None, Decimal(i))
        for chain, size in sizes.items() for i in range(size)
    ]
    return spark.createDataFrame(rows, audit.CHAIN_TYPES.split(", previous_digest")[0])


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_seal(found):
    """Length, peaks and root of a list of entry digests."""
    level, number, peaks = [sha("L" + d) for d in found], 0, []
    while level:
        if len(level) % 2:
            peaks.insert(0, (number, level[-1]))
        level = [sha("N" + level[i] + level[i + 1]) for i in range(0, len(level) - 1, 2)]
        number += 1
    text = f"R{len(found)}:" + ",".join(f"{n}={d}" for n, d in peaks)
    return len(found), peaks, sha(text)


@pytest.fixture(scope="module")
def log(spark):
    return audit.append_chain(entries(spark)).cache()


@pytest.fixture(scope="module")
def tree(log):
    return hashtree.build(log, HEIGHT)


@pytest.fixture(scope="module")
def sealed(tree):
    return hashtree.seals(tree).cache()


def test_seals_equal_a_plain_tree_at_every_size(log, tree, sealed):
    found = {}
    for row in log.orderBy("chain_id", "sequence").collect():
        found.setdefault(row.chain_id, []).append(row.digest)
    got = {r.chain_id: (r.entries, [tuple(p) for p in r.peaks], r.root) for r in sealed.collect()}
    assert got == {chain: plain_seal(each) for chain, each in found.items()}
    assert len(tree.steps) == 4


def test_seals_do_not_depend_on_the_height(log, sealed):
    other = hashtree.seals(hashtree.build(log))
    assert {r.chain_id: r.root for r in other.collect()} == {r.chain_id: r.root for r in sealed.collect()}


def test_every_entry_is_proved(log, tree, sealed):
    proofs = hashtree.prove_entries(tree, log).cache()
    assert proofs.count() == log.count()
    assert hashtree.verify(proofs, sealed).where("NOT holds").isEmpty()
    # Few hot keys: the same by the other route.
    assert hashtree.verify(proofs, sealed, ReconConfig(hot_key_rows=10)).where("holds").count() == log.count()
    at_hand = log.select("chain_id", F.col("sequence").alias("index"), hashtree.leaf(audit.entry_digest()).alias("own"))
    assert proofs.join(at_hand, ["chain_id", "index"]).where("digest <> own").isEmpty()
    unknown = log.limit(1).select("chain_id", F.lit(1000).alias("sequence"))
    assert hashtree.prove_entries(tree, unknown).isEmpty()


@pytest.mark.parametrize("change", [
    ("digest", "sha2('other', 256)"),
    ("index", "index ^ 1L"),
    ("path", "concat(path, array(sha2('more', 256)))"),
])
def test_changed_proofs_do_not_hold(log, tree, sealed, change):
    proofs = hashtree.prove_entries(tree, log.where("chain_id = 'e'")).withColumn(change[0], F.expr(change[1]))
    assert hashtree.verify(proofs, sealed).where("holds").isEmpty()


def test_a_seal_whose_peaks_do_not_give_its_root_is_not_trusted(log, tree, sealed):
    proofs = hashtree.prove_entries(tree, log)
    assert hashtree.verify(proofs, sealed.withColumn("entries", F.col("entries") + 1)).where("holds").isEmpty()


@pytest.mark.parametrize("part", [0.5, 1.0])
def test_growth(spark, log, tree, sealed, part):
    shorter = {chain: max(1, int(size * part)) for chain, size in SIZES.items()}
    older = hashtree.seals(hashtree.build(audit.append_chain(entries(spark, shorter)), HEIGHT)).cache()
    proofs = hashtree.prove_growth(tree, older).cache()
    assert {r.grew for r in hashtree.verify_growth(proofs, older, sealed).collect()} == {True}
    # Another history of the same length is not what the newer seal grew from.
    forged = log.join(older.select("chain_id", "entries"), "chain_id").where("sequence < entries").drop("entries")
    forged = forged.withColumn("action", F.when(F.col("sequence") == 0, "ACCEPT").otherwise(F.col("action")))
    other = hashtree.seals(hashtree.build(forged, HEIGHT))
    got = hashtree.verify_growth(hashtree.prove_growth(tree, other), other, sealed)
    assert {r.grew for r in got.collect()} == {False}


def damaged(log, how):
    at = (F.col("chain_id") == "e") & (F.col("sequence") == 9)
    return {
        "altered": log.withColumn("action", F.when(at, "ACCEPT").otherwise(F.col("action"))),
        "missing": log.where(~at),
        "repeated": log.unionByName(log.where(at)),
        "unnumbered": log.withColumn("sequence", F.when(~at, F.col("sequence"))),
    }[how]


@pytest.mark.parametrize("how", ["altered", "missing", "repeated", "unnumbered"])
def test_damage_is_found_and_named(log, tree, sealed, how):
    found = hashtree.verify_seals(hashtree.build(damaged(log, how), HEIGHT), sealed, hashtree.marks(tree))
    rows = {r.chain_id: (r.intact, r.message) for r in found.collect()}
    first = -4 if how == "unnumbered" else 8
    assert rows.pop("e") == (False, f"entries {first} to {first + 3} are not those that were sealed")
    assert set(rows.values()) == {(True, "sealed")}


def test_a_segment_forged_as_a_whole_is_found(spark):
    """It is a chain in itself, so the chain's own check cannot tell."""
    whole = entries(spark, {"h": 12})
    tree = hashtree.build(audit.append_chain(whole, 4), HEIGHT)
    second = F.col("sequence").between(4, 7)
    forged = audit.append_chain(whole.withColumn("action", F.when(second, "ACCEPT").otherwise(F.col("action"))), 4)
    assert audit.verify_chain(forged, segment_rows=4).first().intact
    row = hashtree.verify_seals(hashtree.build(forged, HEIGHT), hashtree.seals(tree), hashtree.marks(tree)).first()
    assert (row.intact, row.message) == (False, "entries 4 to 7 are not those that were sealed")


def test_empty_and_lost_logs(log, tree, sealed):
    empty = hashtree.build(log.limit(0), HEIGHT)
    assert hashtree.seals(empty).isEmpty()
    rows = hashtree.verify_seals(empty, sealed, hashtree.marks(tree)).collect()
    assert {(r.entries, r.intact, r.message) for r in rows} == {(0, False, "no entries")}
    strange = hashtree.verify_seals(tree, sealed.limit(0), hashtree.marks(empty)).collect()
    assert {r.message for r in strange} == {"no seal"}


def test_stored_versions_only_grow(spark, log, tmp_path):
    folder = str(tmp_path)
    assert tables.verify_audit(spark, folder) is None
    short = audit.append_chain(entries(spark, {"a": 1, "e": 9}))
    first = tables.write_audit(short, folder, 0)
    long = audit.append_chain(entries(spark, {"a": 1, "e": 12, "g": 2}))
    tables.write_audit(long, folder, 1)
    found = {r.chain_id: (r.entries, r.intact, r.message) for r in tables.verify_audit(spark, folder).collect()}
    assert found == {chain: (n, True, "chain intact") for chain, n in {"a": 1, "e": 12, "g": 2}.items()}
    # Neither a shorter log nor another history becomes the next version, and an old number is not judged.
    for wrong, told in ((short, "'e', 'g'"), (long.where("chain_id <> 'a'"), "'a'")):
        with pytest.raises(ValueError, match=told):
            tables.write_audit(wrong, folder, 2)
    assert tables.write_audit(first, folder, 1) is None
    assert tables.read_audit(spark, folder)[0] == 2


def test_a_stored_log_changed_on_disk_is_found(spark, tmp_path):
    folder = str(tmp_path)
    whole = entries(spark, {"e": 9})
    tables.write_audit(audit.append_chain(whole), folder, 0)
    (path,) = (tmp_path / "audit").iterdir()
    other = whole.withColumn("action", F.when(F.col("sequence") == 3, "ACCEPT").otherwise(F.col("action")))
    audit.append_chain(other).write.mode("overwrite").parquet(str(path))
    row = tables.verify_audit(spark, folder).first()
    assert (row.intact, row.message) == (False, "entries 0 to 1023 are not those that were sealed")
    number, log = tables.read_audit(spark, folder)
    with pytest.raises(ValueError, match="changed or are gone"):
        tables.write_audit(audit.append_chain(log.drop("previous_digest", "digest")), folder, number)


def test_an_older_seal_moves_the_blocks_it_asks_for_only(log, tree, sealed):
    proofs = hashtree.prove_growth(tree, sealed)
    plan = proofs._jdf.queryExecution().executedPlan().toString()
    # Filtered where the blocks are read, so that none but the asked ones are exchanged.
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan
    spread = hashtree.prove_growth(tree, sealed, ReconConfig(broadcast_rows=0))
    assert sorted(map(str, spread.collect())) == sorted(map(str, proofs.collect()))
