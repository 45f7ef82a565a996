"""Steps that many queries share: read once, moved little."""

import random

import pandas as pd
from pyspark.sql import functions as F

from ledgerlane.fixed_values import GENESIS_DIGEST
from ledgerlane.operators import audit, precedents, scale
from ledgerlane.plans.reconcile import run_passes
from ledgerlane.sources import derived

from tests.test_reconcile import AS_OF, random_side, to_df


def counted(spark, df, column):
    """The table with a column whose every computation is counted."""
    seen = spark.sparkContext.accumulator(0)

    def same(value):
        seen.add(1)
        return value

    return df.withColumn(column, F.udf(same, "string")(column)), seen


def test_sides_are_prepared_once(spark):
    rng = random.Random(11)
    books, portal = (to_df(spark, random_side(rng, p, 40)) for p in "BP")
    books, seen = counted(spark, books, "invoice_number")
    run_passes(books, portal, as_of=AS_OF)
    assert seen.value == 40


def test_state_reads_no_rows(spark, tmp_path):
    for name in ("orders", "lineitem", "customer"):
        (tmp_path / f"{name}.parquet").write_bytes(b"no table " + name.encode())
    before = derived.state(spark, str(tmp_path))
    assert before == derived.state(spark, str(tmp_path))
    (tmp_path / "orders.parquet").write_bytes(b"another length")
    assert before != derived.state(spark, str(tmp_path))


def test_hot_groups_names_large_keys_and_nulls(spark):
    rows = [("a", 1)] * 30 + [(None, 2)] * 12 + [(f"k{i}", i) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, n int")
    assert sorted(map(str, (r.k for r in scale.hot_groups(df, ["k", "n"], 10).collect()))) == ["None", "a"]
    assert scale.hot_groups(df, ["k"], 30) is None
    assert scale.hot_groups(df.where("n < 0"), ["k"], 10) is None


def test_short_segments_are_handed_over_together():
    """Two segments in one frame are two chains, each as if it came alone."""
    frame = pd.DataFrame(
        {"chain_id": "c", "sequence": [3, 0, 2, 1], "segment": [1, 0, 1, 0], "head": list("dacb"), "tail": "t"}
    )
    done = audit._chain_segments(frame)
    alone = pd.concat(audit._chain_segments(frame[frame["segment"] == s]) for s in (0, 1))
    assert done.values.tolist() == alone.values.tolist()
    assert done["previous_digest"].tolist().count(GENESIS_DIGEST) == 2


def test_few_groups_for_many_short_segments(spark):
    entries = spark.range(600).select(
        F.lit("c").alias("chain_id"), F.col("id").alias("sequence"), F.lit("E").alias("exception_id"), F.lit("A").alias("action"),
        F.lit(False).alias("requires_human"), F.array().cast("array<string>").alias("reasons"),
        F.to_timestamp(F.lit("2026-07-10 09:00:00")).alias("recorded_at"),
        *[F.lit("").alias(c) for c in ("ruleset_version", "model", "prompt_digest")],
        F.lit(None).cast("double").alias("confidence"), F.array().cast("array<string>").alias("evidence_call_ids"),
        F.lit(None).cast("string").alias("approver"), F.lit(None).cast("decimal(28,2)").alias("amount_at_risk"),
    )
    log = audit.append_chain(entries, 2)
    assert "group" in log._jdf.queryExecution().executedPlan().toString().split("FlatMapGroupsInPandas")[1].split("\n")[0]
    assert log.where(F.col("previous_digest") == GENESIS_DIGEST).count() == 300
    assert audit.verify_chain(log, segment_rows=2).first().intact


def test_precedents_are_hashed_once_and_pairs_are_not_added_up(spark):
    cases = spark.range(200).select(
        F.format_string("C%05d", "id").alias("precedent_id"), F.lit("RCM").alias("exception_class"),
        F.concat(F.lit("G"), (F.col("id") % 20).cast("string")).alias("gstin"),
        F.concat(F.lit("invoice "), F.col("id").cast("string")).alias("summary"),
        F.array(F.lit("p")).alias("probe_sequence"), F.lit("r").alias("resolution"), F.lit(True).alias("human_confirmed"),
    )
    stored, seen = counted(spark, precedents.add_precedents(cases), "resolution")
    asked = spark.createDataFrame([("RCM", "G7"), ("RCM", "G8")], "exception_class string, gstin string")
    assert precedents.search_precedents(asked, stored).count() == 6
    assert seen.value == 200
    shape = "q_id string, q_norm int, exception_class string, common {0}, rare {0}".format("array<struct<idx:int,weight:int>>")
    vectors = spark.createDataFrame([("q", 14, "RCM", [(1, 1)], [(5, 2), (7, 3)])], shape)
    kept = spark.createDataFrame(
        [("q", 30, "RCM", [(1, 1)], [(5, 2), (7, 5)], "C1")], shape + ", precedent_id string"
    ).withColumnRenamed("q_norm", "norm_squared").drop("q_id")
    pairs = precedents.posted_pairs(vectors, kept)
    assert "Aggregate" not in pairs._jdf.queryExecution().executedPlan().toString()
    (pair,) = pairs.collect()
    assert abs(pair.score - 20 / (14 * 30) ** 0.5) < 1e-12


def test_stored_precedents_are_hashed_in_more_tasks_than_buckets(spark, tmp_path):
    from ledgerlane.sources import tables

    cases = spark.range(400).select(
        F.format_string("C%05d", "id").alias("precedent_id"), F.lit("RCM").alias("exception_class"),
        F.lit("G").alias("gstin"), F.lit("s").alias("summary"), F.lit(True).alias("human_confirmed"),
    )
    asked, tasks = precedents.with_embedding, []

    def noted(df, text, name):
        tasks.append(df.rdd.getNumPartitions())
        return asked(df, text, name)

    precedents.with_embedding = noted
    try:
        name = f"spread_{tmp_path.name.replace('-', '_')}"
        stored = tables.store_precedents(cases, name, str(tmp_path / "kept"), 2)
    finally:
        precedents.with_embedding = asked
    assert tasks == [4] and stored.count() == 400


def test_dense_weights(spark):
    vectors = [None, [], [(0, 2)], [(255, -1)], [(3, 1), (4, -2), (200, 5)], [(i, i - 100) for i in range(256)]]
    df = spark.createDataFrame(list(enumerate(vectors)), "n int, v array<struct<idx:int,weight:int>>")
    for row in df.select("v", precedents.dense_weights(F.col("v")).alias("w")).collect():
        held = {e.idx: e.weight for e in row.v or []}
        assert row.w == [held.get(i, 0) for i in range(256)]
    text = precedents.dense_weights(F.col("v"))
    plan = df.select(text.alias("w"))._jdf.queryExecution().analyzed().toString()
    assert "map_from_entries" not in plan  # built anew for each of 256 places
