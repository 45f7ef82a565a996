"""Ledger tables derived from the order tables.

One order becomes one document on each side. The order key decides how the two sides differ, so
every kind of disagreement occurs at a known rate and in proportion to the data. One pass over
``orders``, no join: supplier ids are arithmetic on the customer key, and the extra lines some
orders need come from exploding a small per-row array.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.fixed_values import STATE_CODES
from ledgerlane.functions import dates, identifiers
from ledgerlane.functions.money import MONEY, invoice_value, total_tax

AS_OF = dt.date(2001, 7, 14)
PERIOD = "07-2001"
PATTERN_LENGTH = 40


def state(spark: SparkSession, sf_dir: str) -> tuple:
    """What the tables behind the ledger are now: application, folder, files and when they changed."""
    paths = [f"{sf_dir}/{name}.parquet" for name in ("orders", "lineitem", "customer")]
    # One row a file; what is in the files is not read.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    seen = files.agg(F.count(F.lit(1)), F.max("modificationTime"), F.sum("length"), F.approx_count_distinct("path")).first()
    return (spark.sparkContext.applicationId, sf_dir, *seen)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use every core where a small file gives fewer splits than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def with_supplier_gstin(df: DataFrame, key: Column) -> DataFrame:
    """Add a valid supplier id computed from an integer key."""
    states = F.array(*[F.lit(code) for code in STATE_CODES])
    letters = [F.char(F.lit(65) + F.floor(key / 26**i).cast("long") % 26) for i in range(5)]
    body = F.concat(
        F.element_at(states, (key % len(STATE_CODES) + 1).cast("int")),
        *letters,
        F.format_string("%04d", key % 10000),
        F.char(F.lit(65) + (key * 7) % 26),
        F.lit("1Z"),
    )
    # Two steps, so the body is computed once and not once per check term.
    return (
        df.withColumn("_body", body)
        .withColumn("gstin", F.concat("_body", identifiers.gstin_check_char(F.col("_body"))))
        .drop("_body")
    )


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with every value both sides share."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    day = F.to_date("o_orderdate")
    year = F.year(day).cast("string")
    rate = (
        F.when(k % 4 == 0, F.lit("0.05"))
        .when(k % 4 == 1, F.lit("0.12"))
        .when(k % 4 == 2, F.lit("0.18"))
        .otherwise(F.lit("0.28"))
        .cast("decimal(3,2)")
    )
    number = (
        F.when(c % 4 == 0, F.concat(F.lit("INV/"), year, F.lit("/"), F.format_string("%04d", k)))
        .when(c % 4 == 1, F.concat(F.lit("INV-"), year, F.lit("-"), k.cast("string")))
        .when(c % 4 == 2, F.concat(year, F.format_string("%05d", k)))
        .otherwise(F.concat(F.lit("INV"), F.format_string("%05d", k)))
    )
    m = F.col("m")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"
    )
    without_irn = m.isin(6, 7, 14, 15)
    return (
        with_supplier_gstin(spread(orders, "o_orderkey"), c)
        .select(
            k.alias("k"),
            c.alias("c"),
            (k % PATTERN_LENGTH).alias("m"),
            (k % (2 * PATTERN_LENGTH) >= PATTERN_LENGTH).alias("second"),
            F.format_string("%010d", k).alias("id"),
            "gstin",
            number.alias("number"),
            day.alias("day"),
            F.round(F.col("o_totalprice"), 2).cast(MONEY).alias("taxable"),
            rate.alias("rate"),
        )
        .withColumn("tax", F.round(F.col("taxable") * F.col("rate"), 2).cast(MONEY))
        .withColumn("half", F.round(F.col("tax") / 2, 2).cast(MONEY))
        .withColumn("interstate", F.substring("gstin", 1, 2) != "27")
        .withColumn("irn", F.when(~without_irn, F.concat(F.lit("IRN"), F.format_string("%012d", "k"))))
    )


def _line(suffix: str, number: Column, day: Column, drift: Column, gstin: Column | None = None,
          kind: str = "INVOICE", original: Column | None = None) -> Column:
    return F.struct(
        F.lit(suffix).alias("suffix"),
        (gstin if gstin is not None else F.col("gstin")).alias("supplier_gstin"),
        number.alias("invoice_number"),
        day.alias("invoice_date"),
        drift.cast(MONEY).alias("drift"),
        F.lit(kind).alias("kind"),
        (original if original is not None else F.lit(None).cast("string")).alias(
            "original_invoice_number"
        ),
    )


def _tax_columns() -> list[Column]:
    interstate, drift = F.col("interstate"), F.col("line.drift")
    zero = F.lit(0).cast(MONEY)
    return [
        F.when(interstate, zero)
        .otherwise((F.col("tax") - F.col("half") + drift).cast(MONEY))
        .alias("cgst"),
        F.when(interstate, zero).otherwise(F.col("half")).alias("sgst"),
        F.when(interstate, (F.col("tax") + drift).cast(MONEY)).otherwise(zero).alias("igst"),
        zero.alias("cess"),
    ]


def _swapped_gstin() -> Column:
    """Two adjacent distinct characters exchanged."""
    g = F.col("gstin")
    third, fourth = F.substring(g, 3, 1), F.substring(g, 4, 1)
    early = F.concat(F.substring(g, 1, 2), fourth, third, F.substring(g, 5, 11))
    late = F.concat(
        F.substring(g, 1, 6), F.substring(g, 8, 1), F.substring(g, 7, 1), F.substring(g, 9, 7)
    )
    return F.when(third != fourth, early).otherwise(late)


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The purchase register."""
    m, number, day = F.col("m"), F.col("number"), F.col("day")
    none = F.lit(0)
    plain = _line("", number, day, none)
    swapped = _line("", number, day, none, gstin=_swapped_gstin())
    with_a = _line("A", F.concat(number, F.lit("-A")), day, none)
    with_ab = _line("B", F.concat(number, F.lit("-A-B")), day, none)
    lines = (
        F.when(m == 3, F.array(swapped))
        .when((m == 11) & F.col("second"), F.array(plain, with_ab))
        .when(m == 11, F.array(plain, with_a, with_ab))
        .otherwise(F.array(plain))
    )
    return (
        _documents(spark, sf_dir)
        .where(~m.isin(1, 5, 6, 14))
        .withColumn("line", F.explode(lines))
        .select(
            F.concat(F.lit("B"), F.col("id"), F.col("line.suffix")).alias("line_id"),
            F.col("line.supplier_gstin").alias("supplier_gstin"),
            F.col("line.invoice_number").alias("invoice_number"),
            F.col("line.invoice_date").alias("invoice_date"),
            "taxable",
            *_tax_columns(),
            F.col("line.kind").alias("kind"),
            m.isin(7, 15).alias("reverse_charge"),
            "irn",
            F.lit(None).cast("string").alias("original_invoice_number"),
            F.lit(None).cast("int").alias("source_row"),
        )
    )


def portal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The government statement."""
    m, number, day, k = F.col("m"), F.col("number"), F.col("day"), F.col("k")
    second, none = F.col("second"), F.lit(0)

    def drift(text: str) -> Column:
        return F.lit(text).cast("decimal(10,2)")

    plain = _line("", number, day, none)
    suffixed = F.concat(number, F.lit("-A"))
    lines = (
        F.when(m == 2, F.array(_line("", number, day, F.lit(250) + k % 3750)))
        .when(m == 4, F.array(plain, _line("D", F.translate(number, "/", "-"), day, none)))
        .when(
            (m == 6) & second,
            F.array(_line("", F.concat(F.lit("CN/"), number), day, none, kind="CREDIT_NOTE")),
        )
        .when(
            m == 6,
            F.array(
                _line("", F.concat(F.lit("CN/"), number), day, none, kind="CREDIT_NOTE",
                      original=number)
            ),
        )
        .when(m == 8, F.array(_line("", number, day, drift("0.37"))))
        .when(m == 9, F.array(_line("", suffixed, F.date_add(day, 3), none)))
        .when(m == 10, F.array(_line("", number, F.date_add(day, 45), drift("0.50"))))
        .when(
            (m == 11) & second,
            F.array(
                _line("", number, day, drift("0.95")),
                _line("A", suffixed, day, drift("0.10")),
                _line("B", suffixed, F.date_add(day, 2), drift("0.10")),
            ),
        )
        .when(
            m == 11,
            F.array(
                _line("", number, day, drift("0.30")),
                _line("A", suffixed, day, drift("0.10")),
                _line("B", F.concat(number, F.lit("-A-B")), day, drift("0.20")),
            ),
        )
        .when(
            m == 13,
            F.array(
                plain,
                _line("C", F.concat(F.lit("CN/"), number), day, none, kind="CREDIT_NOTE",
                      original=number),
            ),
        )
        .otherwise(F.array(plain))
    )
    return (
        _documents(spark, sf_dir)
        .where(~m.isin(0, 15))
        .withColumn("line", F.explode(lines))
        .select(
            F.concat(F.lit("P"), F.col("id"), F.col("line.suffix")).alias("line_id"),
            F.col("line.supplier_gstin").alias("supplier_gstin"),
            F.col("line.invoice_number").alias("invoice_number"),
            F.col("line.invoice_date").alias("invoice_date"),
            "taxable",
            *_tax_columns(),
            F.col("line.kind").alias("kind"),
            m.isin(7, 14).alias("reverse_charge"),
            "irn",
            F.when(m == 5, F.lit("CANCELLED"))
            .when(F.col("irn").isNull(), F.lit("NOT_APPLICABLE"))
            .otherwise(F.lit("ACTIVE"))
            .alias("irn_status"),
            F.col("line.original_invoice_number").alias("original_invoice_number"),
            dates.return_period(F.col("line.invoice_date")).alias("return_period"),
            (F.col("c") % 10 < 3).alias("filed_late"),
        )
    )


def vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    styles = F.array(*[F.lit(s) for s in ("slash", "dash", "plain", "compact")])
    return (
        with_supplier_gstin(table(spark, sf_dir, "customer"), c)
        .select(
            "gstin",
            F.col("c_name").alias("legal_name"),
            (c % 10 < 3).alias("files_late"),
            F.when(c % 25 < 2, F.lit("REPEATED_LATE_FILING")).alias("risk_flag"),
            F.element_at(styles, (c % 4 + 1).cast("int")).alias("invoice_style"),
        )
    )


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments; every third is off by more than the default slack."""
    k = F.col("k")
    paid = F.col("taxable") + F.col("tax") + (k % 3) * F.lit("0.60").cast("decimal(4,2)")
    return (
        _documents(spark, sf_dir)
        .select(
            F.concat(F.lit("BP"), "id").alias("payment_id"),
            F.col("gstin").alias("counterparty_gstin"),
            paid.cast(MONEY).alias("amount"),
            F.date_add("day", (k % 40 + 5).cast("int")).alias("value_date"),
            F.concat(F.lit("NEFT Customer "), F.col("c").cast("string")).alias("narration"),
        )
    )


def irn_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _documents(spark, sf_dir)
        .where(F.col("irn").isNotNull())
        .select(
            "irn",
            F.when(F.col("m") == 5, F.lit("CANCELLED")).otherwise(F.lit("ACTIVE")).alias("status"),
        )
    )


def prior_portal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier-period lines, one per document."""
    earlier = F.add_months("day", -1)
    return (
        _documents(spark, sf_dir)
        .select(
            F.concat(F.lit("Q"), "id").alias("line_id"),
            F.col("gstin").alias("supplier_gstin"),
            F.col("number").alias("invoice_number"),
            earlier.alias("invoice_date"),
            F.col("tax").alias("total_tax"),
            dates.return_period(earlier).alias("return_period"),
        )
    )


def payment_value() -> Column:
    return invoice_value(F.col("taxable"), total_tax())
