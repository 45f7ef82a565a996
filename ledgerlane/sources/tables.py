"""Durable tables: audit log, submission ledger, statement, precedents, results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ledgerlane.config import DEFAULTS, ReconConfig
from ledgerlane.functions import digests, money
from ledgerlane.operators import hashtree
from ledgerlane.operators.audit import CHAIN_TYPES, recorded_text, verify_chain
from ledgerlane.operators.precedents import new_cases, with_vectors
from ledgerlane.operators.scale import broadcast_if_small, cut, fan_out
from ledgerlane.operators.submit import LEDGER_TYPES, ledger_rows, submit_once
from ledgerlane.sources import commits

AUDIT_JSON_TYPES = CHAIN_TYPES.replace("chain_id string, ", "").replace(
    "amount_at_risk decimal(28,2)", "amount_at_risk string"
).replace("recorded_at timestamp", "recorded_at string")


def _read_or_empty(spark: SparkSession, path: str, types: str) -> DataFrame:
    try:
        return spark.read.schema(types).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], types)


def read_audit(spark: SparkSession, folder: str) -> tuple[int, DataFrame | None]:
    """The last committed version of the log and its number; 0 and None where there is none."""
    number, names, _ = commits.live(spark, f"{folder}/audit_versions")
    return number, spark.read.parquet(f"{folder}/audit/version={names[-1]}") if names else None


def _sealed(spark: SparkSession, folder: str, version: str) -> tuple[DataFrame, DataFrame]:
    """The seals and the marks that were written with a version of the log."""
    return tuple(spark.read.parquet(f"{folder}/audit_{name}/version={version}") for name in ("seals", "marks"))


def write_audit(log: DataFrame, folder: str, after: int, anew: bool = False) -> DataFrame | None:
    """Write a new version of the log, its seals and marks beside the old ones; return the log read back.

    None where another writer committed a version since number ``after``: the log was not made from it. A log
    that did not grow from the seals of the version before, entry for entry, is refused: somebody changed it.
    A cycle that is run again starts its log ``anew``; the versions before it stay with their seals.
    """
    spark, version = log.sparkSession, uuid.uuid4().hex
    number, names, _ = commits.live(spark, f"{folder}/audit_versions")
    if number != after:
        return None
    path = f"{folder}/audit/version={version}"
    log.write.parquet(path)
    written = spark.read.schema(log.schema).parquet(path)
    tree = hashtree.build(written)
    hashtree.seals(tree).write.parquet(f"{folder}/audit_seals/version={version}")
    hashtree.marks(tree).write.parquet(f"{folder}/audit_marks/version={version}")
    if names and not anew:
        older, newer = _sealed(spark, folder, names[-1])[0], _sealed(spark, folder, version)[0]
        grown = hashtree.verify_growth(hashtree.prove_growth(tree, older), older, newer)
        lost = [row.chain_id for row in grown.where("NOT grew").limit(20).collect()]
        if lost:
            raise ValueError(f"entries sealed in version {after} were changed or are gone, chains {sorted(lost)}")
    done = commits.commit(spark, f"{folder}/audit_versions", after + 1, [version], base=True)
    return written if done else None


def grown_from(log: DataFrame, folder: str) -> DataFrame | None:
    """The last version of the stored log if it begins with the entries of ``log``, else None."""
    spark = log.sparkSession
    _, stored = read_audit(spark, folder)
    if stored is None:
        return None
    tree, wanted = hashtree.build(stored), hashtree.seals(hashtree.build(log))
    grown = hashtree.verify_growth(hashtree.prove_growth(tree, wanted), wanted, hashtree.seals(tree))
    return stored if grown.where("NOT grew").isEmpty() else None


def intend(spark: SparkSession, folder: str, attempt: str, step: str) -> None:
    """Note, before it is done, what an attempt at a cycle is about to write."""
    while True:
        number, _, _ = commits.live(spark, f"{folder}/intents")
        if commits.commit(spark, f"{folder}/intents", number + 1, [f"{attempt}/{step}"]):
            return


def read_intents(spark: SparkSession, folder: str) -> DataFrame:
    """``place, attempt, step`` of everything that was intended, in order."""
    _, names, _ = commits.live(spark, f"{folder}/intents")
    rows = [(place, *name.split("/")) for place, name in enumerate(names)]
    return spark.createDataFrame(rows, "place bigint, attempt string, step string")


def verify_audit(spark: SparkSession, folder: str, config: ReconConfig = DEFAULTS) -> DataFrame | None:
    """Per chain of the last version, ``chain_id, entries, intact, message``: its chain, then its seal.

    The seals lie beside the log. Against somebody who may write there, keep their roots elsewhere.
    """
    _, names, _ = commits.live(spark, f"{folder}/audit_versions")
    if not names:
        return None
    log = spark.read.parquet(f"{folder}/audit/version={names[-1]}")
    sealed = hashtree.verify_seals(hashtree.build(log), *_sealed(spark, folder, names[-1]))
    broken = verify_chain(log, config).where("NOT intact").select("chain_id", F.col("message").alias("fault"))
    return sealed.join(broken, "chain_id", "left").select(
        "chain_id", "entries", (F.col("intact") & F.col("fault").isNull()).alias("intact"),
        F.coalesce("fault", F.when(~F.col("intact"), F.col("message")), F.lit("chain intact")).alias("message"),
    )


def read_ledger(spark: SparkSession, folder: str, periods: list[str] | None = None) -> DataFrame:
    """Applied keys; of the given return periods only, so that other partitions are not read."""
    _, names, _ = commits.live(spark, f"{folder}/ledger")
    return _ledger_of(spark, folder, names, periods)


def _ledger_of(spark: SparkSession, folder: str, names: list[str], periods: list[str] | None) -> DataFrame:
    ledger = commits.read(spark, f"{folder}/ledger", LEDGER_TYPES, names)
    return ledger if periods is None else ledger.where(F.col("return_period").isin(periods))


def submit_to_ledger(submissions: DataFrame, folder: str, config: ReconConfig = DEFAULTS) -> DataFrame:
    """Outcome per submission, with what takes effect committed to the ledger in ``folder``.

    Other jobs may submit at the same time: a key is applied by whoever commits it first. Whoever comes
    second decides again over the ledger as it is then, and replays.
    """
    spark, table = submissions.sparkSession, f"{folder}/ledger"
    submissions = cut(submissions)
    # A key holds its period, so only the partitions of these periods are met.
    periods = [r[0] for r in submissions.select("return_period").distinct().collect()]
    while True:
        number, names, _ = commits.live(spark, table)
        sent = cut(submit_once(submissions, _ledger_of(spark, folder, names, periods), config))
        fresh = ledger_rows(sent)
        if fresh.isEmpty():
            return sent
        if commits.commit(spark, table, number + 1, [commits.write(fresh, table, "return_period")]):
            if (number + 1) % commits.MERGE_EVERY == 0:
                commits.merge(spark, table, LEDGER_TYPES, "return_period")
            return sent


def write_audit_jsonl(log: DataFrame, path: str) -> None:
    """One canonical JSON entry per line, in sequence order, with digest and pointer."""
    confidence = digests.python_float_text(F.col("confidence"))
    fields = {
        name: F.col(name) for name in log.columns if name not in ("chain_id", "confidence")
    }
    fields["confidence"] = confidence
    fields["recorded_at"] = recorded_text()
    fields["amount_at_risk"] = money.plain(F.col("amount_at_risk"))
    text = digests.canonical_json(fields)
    quoted = F.concat(F.lit('"confidence":"'), confidence, F.lit('"'))
    bare = F.concat(F.lit('"confidence":'), confidence)
    text = F.when(F.col("confidence").isNull(), text).otherwise(F.replace(text, quoted, bare))
    log.orderBy("chain_id", "sequence").select(text.alias("value")).write.text(path)


def read_audit_jsonl(spark: SparkSession, path: str, chain_id: str) -> DataFrame:
    raw = spark.read.schema(AUDIT_JSON_TYPES).json(path)
    return raw.select(
        F.lit(chain_id).alias("chain_id"),
        *[
            F.to_timestamp("recorded_at").alias(name)
            if name == "recorded_at"
            else F.col(name).cast(money.MONEY).alias(name)
            if name == "amount_at_risk"
            else F.col(name)
            for name in raw.columns
        ],
    )


def write_statement(portal: DataFrame, taxpayer: str, path: str) -> None:
    """Statement lines of one taxpayer, laid out by taxpayer and period."""
    portal.withColumn("taxpayer_gstin", F.lit(taxpayer)).write.mode("append").partitionBy(
        "taxpayer_gstin", "return_period"
    ).parquet(path)


def read_statement(spark: SparkSession, path: str, taxpayer: str, period: str) -> DataFrame:
    """Lines of one taxpayer and period; other partitions are not read."""
    return spark.read.parquet(path).where(
        (F.col("taxpayer_gstin") == taxpayer) & (F.col("return_period") == period)
    )


ROWS_A_BUCKET = 4_000_000
"""Rows of the larger table that one bucket should hold."""
STATEMENT_KEY = ("supplier_gstin", "invoice_number")


def buckets_for(rows: int) -> int:
    """Buckets for a table of so many rows: a power of two, so that tables of different ages still divide evenly."""
    buckets = 2
    while buckets * ROWS_A_BUCKET < rows:
        buckets *= 2
    return buckets


def save_bucketed(df: DataFrame, name: str, path: str, key: tuple[str, ...], buckets: int, partition: str | None = None) -> DataFrame:
    """Keep a table under a name of the session's catalog, bucketed by ``key``, in folders by ``partition`` if given.

    Tables with equal keys and buckets meet without an exchange. Rows are dealt as buckets are, so every folder has one
    file a bucket. A key should be fine enough that none holds much of the table: documents, not suppliers.
    """
    writer = df.repartition(buckets, *key).write.format("parquet").option("path", path).bucketBy(buckets, *key).sortBy(*key)
    if partition is not None:
        writer = writer.partitionBy(partition)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def open_bucketed(spark: SparkSession, name: str, path: str, types: str, key: tuple[str, ...], buckets: int, partition: str | None = None) -> DataFrame:
    """A table that ``save_bucketed`` wrote, made known to another session."""
    columns = ", ".join(key)
    folders = f"PARTITIONED BY ({partition})" if partition else ""
    spark.sql(
        f"CREATE TABLE {name} ({types}) USING parquet {folders} CLUSTERED BY ({columns}) SORTED BY ({columns})"
        f" INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    if partition:
        spark.sql(f"MSCK REPAIR TABLE {name}")
    return spark.table(name)


def open_periods(statement: DataFrame, returns: DataFrame) -> DataFrame:
    """Statement lines of the periods whose return is open. Only their folders are read, found while the query runs.

    ``returns``: return_period, status; a written table with one row a month.
    """
    due = broadcast_if_small(returns.where("status = 'open'").select("return_period"), DEFAULTS.broadcast_rows)
    return statement.join(due, "return_period", "left_semi")


def booked_against(lines: DataFrame, books: DataFrame) -> DataFrame:
    """Statement lines with the register's lines of the same document: how many, the first, and their tax.

    Both bucketed by ``STATEMENT_KEY``: neither grouping nor join moves a row. Suppliers and numbers are compared as written.
    """
    booked = books.groupBy(*STATEMENT_KEY).agg(
        F.count(F.lit(1)).alias("booked"), F.min("line_id").alias("first_book"), F.sum(money.total_tax()).alias("booked_tax")
    )
    return lines.join(booked.hint("merge"), list(STATEMENT_KEY), "left").withColumn("booked", F.coalesce("booked", F.lit(0)))


def write_precedents(precedents: DataFrame, path: str) -> None:
    precedents.write.mode("append").partitionBy("exception_class").parquet(path)


def store_precedents(incoming: DataFrame, name: str, path: str, buckets: int) -> DataFrame:
    """Add confirmed cases to a stored table bucketed by id, laid out by class; ids in it already are passed over.

    Only the incoming cases are moved to meet it. One writer at a time.
    """
    spark = incoming.sparkSession
    existing = spark.table(name) if spark.catalog.tableExists(name) else None
    # Buckets are few and large: what is new is spread again to be hashed.
    fresh = cut(with_vectors(fan_out(new_cases(incoming, existing, buckets), "precedent_id")))
    if existing is None:
        return save_bucketed(fresh, name, path, ("precedent_id",), buckets, "exception_class")
    writer = fresh.select(existing.columns).repartition(buckets, "precedent_id").write.format("parquet").mode("append")
    writer.partitionBy("exception_class").bucketBy(buckets, "precedent_id").sortBy("precedent_id").saveAsTable(name)
    return spark.table(name)


def read_precedents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_results(rows: DataFrame, path: str) -> None:
    """Result rows as CSV and JSON."""
    rows.write.csv(f"{path}/csv", header=True)
    rows.write.json(f"{path}/json")
