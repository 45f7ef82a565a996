"""Evaluation aggregates on small cases, refusals, tables and registered queries."""

from pyspark.sql import functions as F

from ledgerlane.operators import evaluation
from ledgerlane.sources import tables

TYPES = (
    "exception_id string, exception_class string, cycle int, seq bigint, probes array<string>, "
    "resolved boolean, requires_human boolean, confidence double, live_requests bigint, "
    "cached_requests bigint, tokens bigint"
)


def trajectories(spark):
    rows = [
        ("E1", "MISSING_IN_BOOKS", 1, 1, ["query_purchase_register", "query_bank_ledger"], True, False, 0.9, 3, 0, 10),
        ("E2", "MISSING_IN_BOOKS", 1, 2, ["query_vendor_master"], True, True, 0.5, 2, 0, 10),
        ("E3", "RCM", 1, 3, [], False, False, 0.15, 1, 1, 10),
        ("E4", "RCM", 2, 4, ["x"] * 9, True, False, 0.35, 9, 0, 10),
    ]
    return spark.createDataFrame(rows, TYPES)


def test_budget_curve_truncates(spark):
    rows = evaluation.step_budget_curve(trajectories(spark)).orderBy("budget").collect()
    assert [r.successes for r in rows] == [1, 2, 2, 2, 2, 2, 2, 2]
    assert [r.probes_spent for r in rows][:3] == [3, 5, 6]
    assert rows[-1].probes_spent == 11


def test_memory_curve_counts_earlier_precedents(spark):
    rows = evaluation.memory_curve(trajectories(spark)).orderBy("cycle").collect()
    assert [(r.exceptions, r.precedents_available, r.precedent_hit_rate) for r in rows] == [
        (3, 1, 0.3333), (1, 2, 0.0)
    ]


def test_floor_steps_are_exact(spark):
    values = [i / 1000 for i in range(1001)] + [0.15 - 1e-17, 0.1499999999999999, 0.55, 0.7]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(evaluation.floor_step(F.col("x"), 20)).collect()]
    assert got == [max(k for k in range(21) if k / 20 <= v) for v in values]


def test_scripted_data_is_not_measured(spark):
    """Without the column, or with none that is true, no figure is given."""
    plain = trajectories(spark)
    for rows in (plain, plain.withColumn("measured", F.lit(False)), plain.withColumn("measured", F.lit(None).cast("boolean"))):
        scored = rows.withColumn("correct", F.lit(True))
        (row,) = evaluation.straight_through_curve(scored).collect()
        assert row.precision is None and row.n_auto == 0 and row.note.startswith("not measured: requires")
        (row,) = evaluation.trajectory_scores(rows).collect()
        assert row.cases_scored == 0 and row.first_probe_accuracy is None and row.note.startswith("not measured")
    scored = plain.withColumn("correct", F.lit(True)).withColumn("measured", F.lit(True))
    live = evaluation.straight_through_curve(scored).orderBy("confidence_floor").collect()
    assert [r.n_auto for r in live][::5] == [4, 3, 2, 1, 0] and live[-1].precision is None
    assert {r.note for r in live} == {""} and len(live) == 21
    some = scored.withColumn("measured", F.col("exception_id") != "E1")
    assert evaluation.straight_through_curve(some).agg(F.max("n_auto")).first()[0] == 3
    row = evaluation.trajectory_scores(some).first()
    assert (row.cases_scored, row.first_probe_accuracy, row.note) == (evaluation.trajectory_scores(scored).first().cases_scored - 1, 0.0, "")


def test_tiering_arms(spark):
    documents = spark.createDataFrame([(10,)], "documents bigint")
    rows = {r.arm: r for r in evaluation.tiering_ablation(trajectories(spark), documents).collect()}
    assert rows["all_deterministic"].resolved == 2
    assert rows["all_deterministic"].requests_per_resolution == 0.0
    assert (rows["all_agentic"].resolved, rows["all_agentic"].llm_requests) == (2, 16)
    assert (rows["tiered"].resolved, rows["tiered"].llm_requests, rows["tiered"].escalated) == (3, 5, 1)


def test_consistency_counts_moving_cases(spark):
    runs = spark.createDataFrame(
        [("a", True, "p", "ACCEPT"), ("a", False, "p", "NONE"), ("b", True, "p", "ACCEPT"), ("b", True, "q", "ACCEPT")],
        "exception_id string, resolved boolean, path string, action string",
    )
    row = evaluation.consistency(runs).first()
    assert (row.cases, row.unstable_outcome_rate) == (0, None) and row.note.startswith("not measured")
    row = evaluation.consistency(runs.withColumn("measured", F.lit(True))).first()
    assert row.note == ""
    assert (row.cases, row.unstable_outcome, row.unstable_probe_path, row.unstable_action) == (2, 1, 1, 1)


def test_statement_is_pruned_by_taxpayer_and_period(spark, tmp_path):
    path = str(tmp_path / "statement")
    lines = spark.createDataFrame(
        [("P1", "06-2026"), ("P2", "07-2026")], "line_id string, return_period string"
    )
    for taxpayer in ("T1", "T2"):
        tables.write_statement(lines, taxpayer, path)
    got = tables.read_statement(spark, path, "T1", "07-2026")
    assert [r.line_id for r in got.collect()] == ["P2"]
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull" in plan and "DataFilters: []" in plan


def test_result_and_precedent_tables(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1)], "name string, value int")
    tables.write_results(rows, str(tmp_path / "results"))
    assert spark.read.csv(str(tmp_path / "results/csv"), header=True).first()["value"] == "1"
    assert spark.read.json(str(tmp_path / "results/json")).first()["name"] == "a"
    cases = spark.createDataFrame([("p1", "RCM")], "precedent_id string, exception_class string")
    tables.write_precedents(cases, str(tmp_path / "precedents"))
    assert tables.read_precedents(spark, str(tmp_path / "precedents")).count() == 1
