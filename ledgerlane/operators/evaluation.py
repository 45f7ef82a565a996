"""Measurements over recorded investigations.

Input is one row per trajectory (``exception_id, exception_class, probes, resolved,
requires_human, confidence, proposed_class, live_requests, cached_requests, tokens, seconds``).
Everything is a plain aggregate; curves aggregate to a short histogram first and only then
spread it over their points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlane.fixed_values import REFERENCE_PROBES, TEXT_NOT_MEASURED, TEXT_REPEATS_NOT_MEASURED
from ledgerlane.functions.statistics import claim_is_grounded, rounded, wilson
from ledgerlane.operators.policy import route
from ledgerlane.operators.scale import side_by_side


def per_resolution(amount: Column, resolved: Column) -> Column:
    return F.when(resolved > 0, F.round(amount / resolved, 3))


def tiering_ablation(trajectories: DataFrame, documents: DataFrame) -> DataFrame:
    """Three arms over one exception set: rules only, all investigated, rules then residue.

    ``documents`` is a one-row table with the column ``documents``.
    """
    rule = route(F.col("exception_class")) == "TIER_1"
    won = F.col("resolved") & ~F.col("requires_human")
    requests = F.col("live_requests") + F.col("cached_requests")
    zero = F.lit(0).cast("long")

    def total(value: Column, where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, value)), zero)

    counted = trajectories.agg(
        F.count(F.lit(1)).alias("exceptions"),
        F.count_if(rule).alias("rule_closed"),
        F.count_if(won).alias("all_won"),
        F.count_if(won & ~rule).alias("rest_won"),
        total(requests, F.lit(True)).alias("all_requests"),
        total(F.col("tokens"), F.lit(True)).alias("all_tokens"),
        total(requests, ~rule).alias("rest_requests"),
        total(F.col("tokens"), ~rule).alias("rest_tokens"),
    )

    def arm(name: str, resolved: Column, requests: Column, tokens: Column) -> Column:
        return F.struct(
            F.lit(name).alias("arm"),
            resolved.alias("resolved"),
            requests.alias("llm_requests"),
            tokens.alias("total_tokens"),
        )

    tiered = F.col("rule_closed") + F.col("rest_won")
    arms = F.array(
        arm("all_deterministic", F.col("rule_closed"), zero, zero),
        arm("all_agentic", F.col("all_won"), F.col("all_requests"), F.col("all_tokens")),
        arm("tiered", tiered, F.col("rest_requests"), F.col("rest_tokens")),
    )
    interval = rounded(wilson(F.col("resolved"), F.col("exceptions")))
    return (
        side_by_side(counted, documents)
        .select("documents", "exceptions", F.inline(arms))
        .select(
            "arm",
            "documents",
            "exceptions",
            "resolved",
            interval["point"].alias("resolved_rate"),
            interval["ci_low"].alias("ci_low"),
            interval["ci_high"].alias("ci_high"),
            "llm_requests",
            "total_tokens",
            (F.col("exceptions") - F.col("resolved")).alias("escalated"),
            per_resolution(F.col("llm_requests"), F.col("resolved")).alias(
                "requests_per_resolution"
            ),
        )
    )


def step_budget_curve(trajectories: DataFrame, max_budget: int = 8) -> DataFrame:
    """Outcome at every budget from one run per case, by truncation."""
    steps = F.least(F.size("probes"), F.lit(max_budget + 1))
    shape = trajectories.groupBy(steps.alias("steps")).agg(
        F.count(F.lit(1)).alias("cases"), F.count_if("resolved").alias("resolved_cases")
    )
    budgets = F.explode(F.sequence(F.lit(1), F.lit(max_budget)))
    curve = (
        shape.select("*", budgets.alias("budget"))
        .groupBy("budget")
        .agg(
            F.sum(
                F.when(F.col("steps") <= F.col("budget"), F.col("resolved_cases")).otherwise(0)
            ).alias("resolved"),
            F.sum("cases").alias("cases"),
            F.sum(F.least("steps", "budget") * F.col("cases")).alias("probes_spent"),
        )
    )
    interval = rounded(wilson(F.col("resolved"), F.col("cases")))
    return curve.select(
        "budget",
        interval["successes"].alias("successes"),
        interval["trials"].alias("trials"),
        interval["point"].alias("point"),
        interval["ci_low"].alias("ci_low"),
        interval["ci_high"].alias("ci_high"),
        "probes_spent",
        per_resolution(F.col("probes_spent"), F.col("resolved")).alias("probes_per_resolution"),
    )


def memory_curve(trajectories: DataFrame) -> DataFrame:
    """Precedent hit rate per cycle (``cycle`` and within-cycle order ``seq``).

    A case hits when an earlier one of its class became a precedent. Only the first precedent of
    each class matters for that, and there are nine classes.
    """
    place = F.struct("cycle", "seq")
    stored = F.col("resolved") & ~F.col("requires_human")
    firsts = (
        trajectories.where(stored)
        .groupBy("exception_class")
        .agg(F.min(place).alias("first_stored"))
    )
    per_cycle = (
        trajectories.join(F.broadcast(firsts), "exception_class", "left")
        .groupBy("cycle")
        .agg(
            F.count(F.lit(1)).alias("exceptions"),
            F.count_if(stored).alias("added"),
            F.count_if(F.coalesce(F.col("first_stored") < place, F.lit(False))).alias("hits"),
            F.count_if("resolved").alias("resolved"),
            F.sum(F.col("live_requests") + F.col("cached_requests")).alias("llm_requests"),
            F.avg(F.size("probes")).alias("mean_probes"),
        )
    )
    cycles = Window.orderBy("cycle")  # one row per cycle by now
    return per_cycle.select(
        "cycle",
        "exceptions",
        F.sum("added").over(cycles).alias("precedents_available"),
        F.round(F.col("hits") / F.col("exceptions"), 4).alias("precedent_hit_rate"),
        "resolved",
        F.round("mean_probes", 3).alias("mean_probes"),
        "llm_requests",
        per_resolution(F.col("llm_requests"), F.col("resolved")).alias("requests_per_resolution"),
    )


def floor_step(confidence: Column, steps: int) -> Column:
    """Largest k with k/steps <= confidence, exact on doubles."""
    guess = F.floor(confidence * steps).cast("int")
    guess = F.when(guess / float(steps) > confidence, guess - 1).otherwise(guess)
    return F.when((guess + 1) / float(steps) <= confidence, guess + 1).otherwise(guess)


def measured_rows(rows: DataFrame) -> DataFrame:
    """Rows of a live provider: those whose column ``measured`` is true. Without the column there are none."""
    return rows.where(F.col("measured") if "measured" in rows.columns else F.lit(False))


def straight_through_curve(scored: DataFrame, steps: int = 20) -> DataFrame:
    """Rate and precision as the confidence floor moves, over the measured cases only.

    ``scored``: confidence, correct, measured. Where nothing was measured there is nothing to report: the
    curve is one row that says so.
    """
    scored = measured_rows(scored).select("confidence", "correct")
    columns = ("confidence_floor", "straight_through_rate", "precision", "precision_ci_low")
    refusal = scored.agg(F.count(F.lit(1)).alias("n_auto")).where("n_auto = 0").select(
        *[F.lit(None).cast("double").alias(name) for name in columns],
        "n_auto", F.lit(TEXT_NOT_MEASURED).alias("note"),
    )
    shape = scored.groupBy(floor_step(F.col("confidence"), steps).alias("top")).agg(
        F.count(F.lit(1)).alias("cases"), F.count_if("correct").alias("right")
    )
    floors = F.explode(F.sequence(F.lit(0), F.lit(steps)))
    passed = F.col("top") >= F.col("step")
    curve = (
        shape.select("*", floors.alias("step"))
        .groupBy("step")
        .agg(
            F.sum("cases").alias("scored"),
            F.sum(F.when(passed, F.col("cases")).otherwise(0)).alias("n_auto"),
            F.sum(F.when(passed, F.col("right")).otherwise(0)).alias("right"),
        )
    )
    precision = rounded(wilson(F.col("right"), F.col("n_auto")))
    some = F.col("n_auto") > 0
    return curve.select(
        F.round(F.col("step") / float(steps), 2).alias("confidence_floor"),
        F.round(F.col("n_auto") / F.col("scored"), 4).alias("straight_through_rate"),
        F.when(some, precision["point"]).alias("precision"),
        F.when(some, precision["ci_low"]).alias("precision_ci_low"),
        "n_auto",
        F.lit("").alias("note"),
    ).unionByName(refusal)


def reference_path(exception_class: Column) -> Column:
    table = F.create_map(
        *[
            x
            for cls, probes in REFERENCE_PROBES.items()
            for x in (F.lit(cls), F.array(*[F.lit(p) for p in probes]))
        ]
    )
    return table[exception_class]


def trajectory_scores(trajectories: DataFrame) -> DataFrame:
    """First-probe accuracy, overlap with the reference path, steps beyond it, over the measured cases.

    Where nothing was measured all figures are NULL and ``note`` says why.
    """
    trajectories = measured_rows(trajectories)
    reference = F.col("reference")
    usable = reference.isNotNull() & (F.size("probes") > 0)
    summary = trajectories.withColumn("reference", reference_path(F.col("exception_class"))).agg(
        F.count(F.lit(1)).alias("measured"),
        F.count_if(usable).alias("cases_scored"),
        F.count_if(usable & (F.get("probes", F.lit(0)) == reference[0])).alias("first_right"),
        F.avg(F.when(usable, F.size(F.array_intersect("probes", reference)) / F.size(reference))).alias("overlap"),
        F.avg(F.when(usable, (F.size("probes") - F.size(reference)).cast("double"))).alias("excess"),
    )
    some = F.col("cases_scored") > 0
    first = rounded(wilson(F.col("first_right"), F.col("cases_scored")))
    return summary.select(
        "cases_scored",
        F.when(some, first["point"]).alias("first_probe_accuracy"),
        F.when(some, first["ci_low"]).alias("ci_low"),
        F.when(some, first["ci_high"]).alias("ci_high"),
        F.round("overlap", 4).alias("mean_reference_overlap"),
        F.round("excess", 3).alias("mean_steps_over_reference"),
        F.when(F.col("measured") > 0, F.lit("")).otherwise(F.lit(TEXT_NOT_MEASURED)).alias("note"),
    )


def consistency(runs: DataFrame) -> DataFrame:
    """How often repeats of a case disagree (``exception_id, resolved, path, action, measured``).

    Only measured repeats count: a scripted or replayed answer is always the same. Two different values exist exactly when minimum and maximum differ, so repeats need not be
    collected.
    """

    def moved(name: str) -> Column:
        return (F.min(name) != F.max(name)).alias(f"{name}_moved")

    per_case = measured_rows(runs).groupBy("exception_id").agg(
        moved("resolved"), moved("path"), moved("action")
    )
    cases = F.col("cases")

    def share(name: str) -> Column:
        return F.when(cases > 0, F.round(F.col(name) / cases, 4)).alias(f"{name}_rate")

    return per_case.agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if("resolved_moved").alias("unstable_outcome"),
        F.count_if("path_moved").alias("unstable_probe_path"),
        F.count_if("action_moved").alias("unstable_action"),
    ).select(
        "*", share("unstable_outcome"), share("unstable_probe_path"), share("unstable_action"),
        F.when(cases > 0, F.lit("")).otherwise(F.lit(TEXT_REPEATS_NOT_MEASURED)).alias("note"),
    )


def grounded_fraction(claims: DataFrame, results: DataFrame) -> DataFrame:
    """Share of each case's claims supported by the result they cite.

    ``claims``: exception_id, call_id, claim. ``results``: exception_id, call_id, result, one per
    call. Cases without claims do not appear.
    """
    cited = claims.join(results, ["exception_id", "call_id"], "left")
    grounded = claim_is_grounded(F.col("claim"), F.coalesce("result", F.lit("")))
    return cited.groupBy("exception_id").agg(
        F.avg(grounded.cast("double")).alias("grounded_fraction"),
        F.count(F.lit(1)).alias("claims"),
    )


def tier_summary(trajectories: DataFrame) -> DataFrame:
    """Per model tier: outcome proportions, means and repairs.

    Adds to the common columns: ``tier, expected_class, grounded_fraction`` (NULL where nothing
    was cited or no label exists).
    """
    probes = F.size("probes")
    resolved = F.col("resolved")
    fresh = F.col("live_requests") > 0
    correct = resolved & (F.col("proposed_class") == F.col("expected_class"))
    grounded = resolved & (F.col("grounded_fraction") == 1.0)
    summary = trajectories.groupBy("tier").agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(resolved).alias("n_resolved"),
        F.count_if(F.coalesce(correct, F.lit(False))).alias("n_correct"),
        F.count_if(F.coalesce(grounded, F.lit(False))).alias("n_grounded"),
        F.round(F.avg(F.col("tokens").cast("double")), 1).alias("mean_tokens"),
        F.round(F.avg(F.when(fresh, F.col("seconds"))), 2).alias("mean_seconds"),
        F.count_if(fresh).alias("latency_from_n_fresh_runs"),
        F.round(F.avg(probes.cast("double")), 2).alias("mean_probes"),
        F.count_if(F.col("live_requests") > probes + 1).alias("repairs_needed"),
    )
    cases, n = F.col("cases"), F.col("n_resolved")
    outcome = rounded(wilson(n, cases))
    right = rounded(wilson(F.col("n_correct"), n))
    supported = rounded(wilson(F.col("n_grounded"), n))
    some = n > 0
    return summary.select(
        "tier",
        "cases",
        n.alias("resolved"),
        outcome["point"].alias("resolved_rate"),
        outcome["ci_low"].alias("resolved_ci_low"),
        outcome["ci_high"].alias("resolved_ci_high"),
        F.col("n_correct").alias("class_correct"),
        F.when(some, right["point"]).alias("class_accuracy"),
        F.when(some, right["ci_low"]).alias("class_ci_low"),
        F.col("n_grounded").alias("fully_grounded"),
        F.when(some, supported["point"]).alias("grounded_rate"),
        F.when(some, supported["ci_low"]).alias("grounded_ci_low"),
        "mean_tokens",
        "mean_seconds",
        "latency_from_n_fresh_runs",
        "mean_probes",
        "repairs_needed",
    )


def score_against_truth(findings: DataFrame, truth: DataFrame) -> DataFrame:
    """Proposed class against the planted one, joined on the anchor inside the exception id."""
    anchor = F.regexp_extract("exception_id", "^E[0-9]+-(.*)$", 1)
    labels = truth.select(
        F.col("exception_key").alias("anchor"), F.col("exception_class").alias("expected_class")
    )
    return findings.withColumn("anchor", anchor).join(labels, "anchor", "left").withColumn(
        "correct", F.coalesce(F.col("proposed_class") == F.col("expected_class"), F.lit(False))
    )


def trajectory_summary(trajectories: DataFrame) -> DataFrame:
    return trajectories.select(
        "exception_id",
        F.col("exception_class").alias("class"),
        F.array_join("probes", " -> ").alias("probes"),
        F.size("probes").alias("steps"),
        "resolved",
        "terminated_because",
        F.coalesce("proposed_action", F.lit("PENDING")).alias("action"),
        "confidence",
        "tokens",
    )


def spend_summary(requests: DataFrame) -> DataFrame:
    """One row over a request log: ``cached, input_tokens, output_tokens, wall_seconds, waited``."""
    return requests.agg(
        F.count_if(~F.col("cached")).alias("live_requests"),
        F.count_if("cached").alias("cached_requests"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.coalesce(F.sum(F.col("input_tokens") + F.col("output_tokens")), F.lit(0)).alias(
            "total_tokens"
        ),
        F.round(F.coalesce(F.sum("wall_seconds"), F.lit(0.0)), 3).alias("wall_seconds"),
        F.count_if("waited").alias("quota_waits"),
    )


def cache_hit_rate(lookups: DataFrame) -> DataFrame:
    """Hits, misses, writes and rate over a log of cache operations (column ``operation``)."""
    hits = F.count_if(F.col("operation") == "hit")
    misses = F.count_if(F.col("operation") == "miss")
    looked_up = hits + misses
    return lookups.agg(
        hits.alias("hits"),
        misses.alias("misses"),
        F.count_if(F.col("operation") == "write").alias("writes"),
        F.round(F.when(looked_up > 0, hits / looked_up).otherwise(0.0), 4).alias("hit_rate"),
    )
