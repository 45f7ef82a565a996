"""Evidence lookups for many requests at once.

The many-row probes never join request by row. Rows are first reduced to one summary per lookup
key (count and first rows by id), and requests fetch the summary, so a supplier with a third of
all rows costs one summary. Rows that no request can meet are dropped where they lie, before any of
that moves. Amount windows go through cells of equal amount, found by bands as wide as the window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlane.config import DEFAULTS, ReconConfig, for_row_count
from ledgerlane.fixed_values import TEXT_UNKNOWN_IRN, TEXT_UNKNOWN_VENDOR
from ledgerlane.functions import identifiers, money
from ledgerlane.operators.scale import cut, lookup

REQUEST = ["exception_id", "call_id"]

MARK_BITS = (16, 26)
"""Least and most bits, as powers of two, of the marks of asked keys: a broadcast of 2**20 rows at most."""


def asked_only(rows: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys are asked for, and few others, without moving any of them.

    Each asked key marks a bit by its hash; the words of bits are broadcast, and a row stays where its
    key's bit is marked. Equal keys have equal hashes, so no row that a request can meet is lost.
    """
    least, most = MARK_BITS
    power = min(most, max(least, (16 * asked.count()).bit_length()))

    def bit() -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(1 << power))

    marked = (
        asked.select(bit().alias("_bit"))
        .groupBy(F.shiftright("_bit", 6).alias("_word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(_bit & 63 AS int)))").alias("_bits"))
    )
    return (
        rows.withColumn("_bit", bit())
        .withColumn("_word", F.shiftright("_bit", 6))
        .join(F.broadcast(marked), "_word")
        .where("(shiftrightunsigned(_bits, cast(_bit & 63 AS int)) & 1) = 1")
        .drop("_bit", "_word", "_bits")
    )


def summarise(
    rows: DataFrame, keys: list[str], order: list[str], shown: list[str], config: ReconConfig
) -> DataFrame:
    """Per key: ``match_count`` and the first ``probe_rows`` rows in ``order``.

    Both are combined before the shuffle: counts as partial sums, and of each key no task sends more
    than its first rows (Spark limits a window group that is only asked for its first ranks where the rows
    lie). So a key with a third of all rows is neither moved nor ranked as a whole.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("match_count"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    kept = dict.fromkeys([*keys, *order, *shown])
    first = (
        rows.select(*kept).withColumn("_rank", place).where(F.col("_rank") <= config.probe_rows)
        .groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_rank", *shown))).alias("rows"))
    )
    return counts.join(first, keys)


def _fetch(
    requests: DataFrame, rows: DataFrame, keys: list[str], order: list[str], shown: list[str],
    amount: str | None, config: ReconConfig,
) -> DataFrame:
    """Requests that all filter on the same things, answered from summaries."""
    if amount is None and not keys:
        return _whole_table(requests, rows, order, shown, config)
    if amount is None:
        summary = summarise(asked_only(rows, requests, keys), keys, order, shown, config)
        return lookup(
            requests.select(*REQUEST, *keys), summary, keys, "left", config.hot_key_rows
        ).select(*REQUEST, "match_count", "rows")

    kept = list(dict.fromkeys([*order, *shown]))
    # Bands are as wide as the power of ten above the slack, so any window meets at most four.
    low, high = F.col("amount") - F.col("slack"), F.col("amount") + F.col("slack")
    window = [*keys, "amount", "slack"]
    asked = requests.select(*window).distinct().withColumn(
        "_digits", F.length(F.floor(F.abs(F.col("slack"))).cast("string"))
    )
    used = [r[0] for r in asked.select("_digits").distinct().collect() if r[0]]  # at most 26

    def band(value: Column) -> Column:
        return F.floor(value.cast("double") / F.pow(F.lit(10.0), F.col("_digits"))).cast("long")

    # Equal questions are asked once, so a band of one key holds a bounded number of them too.
    questions = asked.select(
        *window, "_digits", low.alias("_low"), high.alias("_high"),
        F.explode(F.sequence(band(low), band(high))).alias("_band"),
    ).withColumnsRenamed({"amount": "_asked", "slack": "_slack"})
    cell = [*keys, "_digits", "_band"]
    banded = (
        rows.withColumn("_digits", F.explode(F.array(*[F.lit(d) for d in used]).cast("array<int>")))
        .withColumn("_band", band(F.col(amount)))
    )
    cells = summarise(
        asked_only(banded, questions, cell), list(dict.fromkeys([*cell, amount])), order, kept, config
    )
    met = (
        questions.join(cells, cell)
        .where((F.col(amount) >= F.col("_low")) & (F.col(amount) <= F.col("_high")))
        .select(*keys, "_asked", "_slack", "match_count", "rows")
    )
    question = [*keys, "_asked", "_slack"]
    counts = met.groupBy(*question).agg(F.sum("match_count").alias("match_count"))
    # Each cell holds its first rows; the first of all cells are cut before anything is gathered.
    place = F.row_number().over(Window.partitionBy(*question).orderBy(*[f"_r.{c}" for c in order]))
    first = (
        met.select(*question, F.explode("rows").alias("_r"))
        .withColumn("_rank", place)
        .where(F.col("_rank") <= config.probe_rows)
        .groupBy(*question)
        .agg(F.array_sort(F.collect_list(F.struct("_rank", *[F.col(f"_r.{c}").alias(c) for c in shown]))).alias("rows"))
    )
    answers = counts.join(first, question).select(
        *keys,
        F.col("_asked").alias("amount"),
        F.col("_slack").alias("slack"),
        "match_count",
        "rows",
    )
    return lookup(
        requests.select(*REQUEST, *window), answers, window, "left", config.hot_key_rows
    ).select(*REQUEST, "match_count", "rows")


def _whole_table(
    requests: DataFrame, rows: DataFrame, order: list[str], shown: list[str], config: ReconConfig
) -> DataFrame:
    """A request without any filter: the row count and the first few rows, as constants."""
    first = rows.orderBy(*order).limit(config.probe_rows).select(*order, *_others(shown, order))
    entry = F.struct(*order, F.struct(F.lit(0).alias("_rank"), *shown).alias("row"))
    listed = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["row"])
    few = first.agg(listed.alias("rows"))
    text = few.select(F.to_json("rows", {"ignoreNullFields": "false"})).first()[0]
    return requests.select(
        *REQUEST,
        F.lit(rows.count()).cast("long").alias("match_count"),
        F.from_json(F.lit(text), few.schema["rows"].dataType).alias("rows"),
    )


def _others(shown: list[str], order: list[str]) -> list[str]:
    return [name for name in shown if name not in order]


def _probe(
    requests: DataFrame, rows: DataFrame, order: list[str], shown: list[str],
    amount: str | None, config: ReconConfig,
) -> DataFrame:
    """Answer requests with optional gstin, number and amount filters (blank or NULL: none)."""
    requests = requests.select(
        *REQUEST,
        identifiers.normalise_gstin(F.coalesce("gstin", F.lit(""))).alias("gstin_key"),
        identifiers.normalise_invoice_number(F.coalesce("invoice_number", F.lit(""))).alias(
            "num_key"
        ),
        (F.coalesce("invoice_number", F.lit("")) != "").alias("by_number"),
        F.col("amount").cast(money.MONEY).alias("amount"),
        F.col("slack").cast(money.MONEY).alias("slack"),
    ).withColumn("by_gstin", F.col("gstin_key") != "")
    by_amount = F.col("amount").isNotNull() if amount else F.lit(False)
    requests = requests.withColumn("by_amount", by_amount)
    # Several kinds of question read the same rows; they are computed once.
    needed = dict.fromkeys(["gstin_key", *(["num_key"] if "num_key" in rows.columns else []),
                            *([amount] if amount else []), *order, *shown])
    rows = cut(rows.select(*needed))
    config = for_row_count(config, max(rows.count(), requests.count()))
    flags = ["by_gstin", "by_number", "by_amount"]
    answers: DataFrame | None = None
    for shape in requests.select(*flags).distinct().collect():  # at most eight shapes
        keys = (["gstin_key"] if shape.by_gstin else []) + (["num_key"] if shape.by_number else [])
        alike = requests
        for flag in flags:
            alike = alike.where(F.col(flag) == F.lit(shape[flag]))
        part = _fetch(alike, rows, keys, order, shown, amount if shape.by_amount else None, config)
        answers = part if answers is None else answers.unionByName(part)
    if answers is None:
        answers = _fetch(requests, rows, [], order, shown, None, config)
    return answers.select(
        *REQUEST,
        F.coalesce("match_count", F.lit(0)).alias("match_count"),
        F.transform("rows", lambda r: F.struct(*[r[c].alias(c) for c in shown])).alias("rows"),
    )


def probe_purchase_register(
    requests: DataFrame, books: DataFrame, config: ReconConfig = DEFAULTS
) -> DataFrame:
    """Book lines by supplier, number and total tax (within the default slack)."""
    asked = requests.withColumn("slack", F.lit(config.probe_slack))
    shown = ["line_id", "invoice_number", "invoice_date", "total_tax", "supplier_gstin"]
    return _probe(asked, books, ["line_id"], shown, "total_tax", config)


def probe_bank_ledger(
    requests: DataFrame, bank: DataFrame, config: ReconConfig = DEFAULTS
) -> DataFrame:
    """Payments by counterparty and amount; the tolerance may be stated per request."""
    asked = requests.withColumn(
        "slack", F.coalesce("tolerance", F.lit(config.probe_slack))
    ).withColumn("invoice_number", F.lit(None).cast("string"))
    payments = bank.withColumn(
        "gstin_key", identifiers.normalise_gstin(F.col("counterparty_gstin"))
    )
    shown = ["payment_id", "amount", "value_date", "narration"]
    return _probe(asked, payments, ["payment_id"], shown, "amount", config)


def probe_prior_2b(
    requests: DataFrame, prior: DataFrame, config: ReconConfig = DEFAULTS
) -> DataFrame:
    """Earlier-period lines by supplier and number, in period then id order."""
    asked = requests.withColumn("amount", F.lit(None)).withColumn("slack", F.lit(None))
    lines = prior.select(
        "*",
        identifiers.normalise_gstin(F.col("supplier_gstin")).alias("gstin_key"),
        identifiers.normalise_invoice_number(F.col("invoice_number")).alias("num_key"),
    )
    shown = ["return_period", "line_id", "invoice_number", "total_tax"]
    periods = prior.select("return_period").distinct().count()
    found = _probe(asked, lines, ["return_period", "line_id"], shown, None, config)
    return found.withColumn("period_count", F.lit(periods).cast("long"))


def probe_vendor_master(
    requests: DataFrame, vendors: DataFrame, config: ReconConfig = DEFAULTS
) -> DataFrame:
    """Vendor facts where known, id check flags in any case."""
    asked = requests.withColumn(
        "gstin_key", identifiers.normalise_gstin(F.coalesce("gstin", F.lit("")))
    ).withColumn("check", identifiers.check_normalised_gstin(F.col("gstin_key")))
    master = vendors.select(
        F.col("gstin").alias("gstin_key"),
        "legal_name",
        "files_late",
        "risk_flag",
        F.lit(True).alias("known"),
    )
    known = F.coalesce("known", F.lit(False))
    return lookup(asked, master, ["gstin_key"], "left", config.hot_key_rows).select(
        *REQUEST,
        known.alias("known_vendor"),
        "legal_name",
        "files_late",
        "risk_flag",
        F.col("check.well_formed").alias("gstin_well_formed"),
        F.col("check.checksum_valid").alias("gstin_checksum_valid"),
        F.when(~known, F.col("check.reason")).alias("checksum_note"),
        F.when(~known, F.lit(TEXT_UNKNOWN_VENDOR)).alias("note"),
    )


def probe_irn_status(
    requests: DataFrame, registry: DataFrame, config: ReconConfig = DEFAULTS
) -> DataFrame:
    asked = requests.withColumn("irn", F.coalesce("irn", F.lit("")))
    known = F.col("status").isNotNull()
    return lookup(asked, registry, ["irn"], "left", config.hot_key_rows).select(
        *REQUEST,
        "irn",
        known.alias("known"),
        "status",
        F.when(known, F.col("status") == "CANCELLED").alias("cancelled"),
        F.when(~known, F.lit(TEXT_UNKNOWN_IRN)).alias("note"),
    )


def probe_tolerance(left: Column, right: Column, config: ReconConfig = DEFAULTS) -> Column:
    """struct(left, right, difference, allowed, within_tolerance); ``right`` sets the band."""
    a, b = money.money(left), money.money(right)
    test = money.tax_within_tolerance(a, b, config)
    return F.struct(
        a.alias("left"),
        b.alias("right"),
        test["delta"].alias("difference"),
        test["allowed"].alias("allowed"),
        test["within"].alias("within_tolerance"),
    )
