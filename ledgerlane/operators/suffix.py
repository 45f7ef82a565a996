"""Tolerant pass: compatible numbers, close dates, close tax, assigned best first.

Compatible numbers are equal or differ by one trailing letter token, so a pair never leaves
(supplier, root number). The root is the number without its trailing letter tokens. Lines are
grouped once on it; small groups are scored and assigned inside their row by array functions.
Large groups go to ``rounds.assign_rounds``, which gives the same answer without listing pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlane.config import DEFAULTS, ReconConfig
from ledgerlane.functions import dates, identifiers, money
from ledgerlane.operators import rounds
from ledgerlane.operators.scale import broadcast_if_small, cut, split_hot

GROUP = ["gstin_key", "root_key"]
EDGE_FIELDS = (
    "neg_affinity",
    "delta",
    "gap",
    "book_id",
    "portal_id",
    "suffix",
    "gstin_key",
    "portal_num_key",
)


def _narrow(df: DataFrame, side: int) -> DataFrame:
    number = F.col("num_key")
    return df.select(
        F.lit(side).alias("side"),
        "gstin_key",
        identifiers.root_number(number).alias("root_key"),
        number,
        identifiers.parent_number(number).alias("parent_key"),
        "total_tax",
        "invoice_date",
        "line_id",
    )


def candidate_edges(
    books: DataFrame, portal: DataFrame, config: ReconConfig = DEFAULTS
) -> DataFrame:
    """All acceptable pairings as a table.

    An interval join in two dimensions: each side offers its number and its number without one
    trailing letter token, and a cell of one tax band by one date band. A book line lies in its home cell
    alone, a portal line is offered to that cell and its neighbours, so an acceptable pair meets exactly
    once, and lines of a busy number that are far apart in tax or date never meet. Reported for
    inspection; assignment does not need it.
    """
    width = money.literal(max(config.tax_cap, config.tax_slack))
    band = F.floor(F.col("total_tax") / width).cast("long")
    date_band = F.floor(F.unix_date("invoice_date") / max(config.date_window_days, 1)).cast("long")

    def around(name: str):
        return F.explode(F.array(F.col(name) - 1, F.col(name), F.col(name) + 1))

    def offer(df: DataFrame, side: int, prefix: str) -> DataFrame:
        narrow = _narrow(df, side).withColumn("band", band).withColumn("date_band", date_band)
        if side == 1:
            narrow = narrow.withColumn("band", around("band")).withColumn("date_band", around("date_band"))
        keys = F.array(
            F.struct(F.lit(False).alias("shortened"), F.col("num_key").alias("join_key")),
            F.struct(F.lit(True).alias("shortened"), F.col("parent_key").alias("join_key")),
        )
        return narrow.select("*", F.inline(keys)).where("join_key is not null").select(
            "gstin_key",
            "join_key",
            "band",
            "date_band",
            *[
                F.col(c).alias(f"{prefix}_{c}")
                for c in ("shortened", "num_key", "total_tax", "invoice_date", "line_id")
            ],
        )

    tolerance = money.tax_within_tolerance(F.col("b_total_tax"), F.col("p_total_tax"), config)
    gap = dates.days_between(F.col("b_invoice_date"), F.col("p_invoice_date"))
    longer = F.when(F.col("b_shortened"), F.col("b_num_key")).otherwise(F.col("p_num_key"))
    suffixed = F.col("b_shortened") | F.col("p_shortened")
    return (
        offer(books, 0, "b")
        .join(offer(portal, 1, "p"), ["gstin_key", "join_key", "band", "date_band"])
        .where(~(F.col("b_shortened") & F.col("p_shortened")))
        .where((gap <= config.date_window_days) & tolerance["within"])
        .select(
            F.col("b_line_id").alias("book_line_id"),
            F.col("p_line_id").alias("portal_line_id"),
            F.when(suffixed, F.lit(0.9)).otherwise(F.lit(1.0)).alias("affinity"),
            tolerance["delta"].alias("tax_delta"),
            gap.alias("days_apart"),
            match_detail(F.when(suffixed, F.regexp_extract(longer, "[A-Z]+$", 0)), gap,
                         tolerance["delta"]).alias("detail"),
        )
    )


def match_detail(suffix: Column, gap: Column, delta: Column) -> Column:
    why = F.when(suffix.isNull(), F.lit("identical after normalisation")).otherwise(
        identifiers.suffix_reason(suffix)
    )
    return F.concat(
        why, F.lit("; dates "), gap.cast("string"), F.lit("d apart; tax differs by "),
        money.plain(delta),
    )


def _edges_in_row(config: ReconConfig) -> Column:
    """Sorted acceptable pairings of one group's two line arrays."""

    def edge(b: Column, p: Column) -> Column:
        same = b["num_key"] == p["num_key"]
        book_longer = F.coalesce(b["parent_key"] == p["num_key"], F.lit(False))
        portal_longer = F.coalesce(p["parent_key"] == b["num_key"], F.lit(False))
        tolerance = money.tax_within_tolerance(b["total_tax"], p["total_tax"], config)
        gap = dates.days_between(b["invoice_date"], p["invoice_date"])
        keep = (
            (same | book_longer | portal_longer)
            & (gap <= config.date_window_days)
            & tolerance["within"]
        )
        longer = F.when(book_longer, b["num_key"]).otherwise(p["num_key"])
        return F.when(
            keep,
            F.struct(
                F.when(same, F.lit(-1.0)).otherwise(F.lit(-0.9)).alias("neg_affinity"),
                tolerance["delta"].alias("delta"),
                gap.alias("gap"),
                b["line_id"].alias("book_id"),
                p["line_id"].alias("portal_id"),
                F.when(~same, F.regexp_extract(longer, "[A-Z]+$", 0)).alias("suffix"),
                F.col("gstin_key").alias("gstin_key"),
                p["num_key"].alias("portal_num_key"),
            ),
        )

    pairs = F.flatten(
        F.transform("book_lines", lambda b: F.transform("portal_lines", lambda p: edge(b, p)))
    )
    return F.array_sort(F.filter(pairs, lambda e: e.isNotNull()))


_TAKE_IN_ORDER = """
aggregate(
  edges,
  named_struct('books', cast(array() as array<string>),
               'portal', cast(array() as array<string>),
               'taken', filter(edges, e -> false)),
  (acc, e) -> if(
    array_contains(acc.books, e.book_id) or array_contains(acc.portal, e.portal_id),
    acc,
    named_struct('books', array_append(acc.books, e.book_id),
                 'portal', array_append(acc.portal, e.portal_id),
                 'taken', array_append(acc.taken, e))),
  acc -> acc.taken)
"""


def _assign_in_rows(lines: DataFrame, config: ReconConfig) -> DataFrame:
    line = F.struct("num_key", "parent_key", "total_tax", "invoice_date", "line_id")
    return (
        lines.groupBy(*GROUP)
        .agg(
            F.collect_list(F.when(F.col("side") == 0, line)).alias("book_lines"),
            F.collect_list(F.when(F.col("side") == 1, line)).alias("portal_lines"),
        )
        .where((F.size("book_lines") > 0) & (F.size("portal_lines") > 0))
        .select(_edges_in_row(config).alias("edges"))
        .where(F.size("edges") > 0)
        .select(F.inline(F.expr(_TAKE_IN_ORDER)))
        .select(*EDGE_FIELDS)
    )


def assign_best_first(
    books: DataFrame, portal: DataFrame, config: ReconConfig = DEFAULTS
) -> DataFrame:
    """One-to-one matches, taken by (affinity, tax gap, day gap, book id, portal id).

    The inputs should be cut tables: a narrow count sizes the groups before any is gathered, and
    only where some group is too large are the lines split by the size of their group.
    """
    lines = _narrow(books, 0).unionByName(_narrow(portal, 1))
    sizes = lines.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("group_lines"))
    largest = sizes.agg(F.max("group_lines")).first()[0] or 0
    if largest <= config.pair_group_lines:
        return _assign_in_rows(lines, config)

    ordinary, hot = split_hot(lines, GROUP, config.hot_key_rows)
    sized = cut(ordinary.join(sizes, GROUP))
    is_small = F.col("group_lines") <= config.pair_group_lines
    large = sized.where(~is_small).drop("group_lines")
    if hot is not None:
        large = large.unionByName(hot.select(large.columns))
    taken = _assign_in_rows(sized.where(is_small).drop("group_lines"), config)
    return taken.unionByName(rounds.assign_rounds(cut(large), config).select(*EDGE_FIELDS))


def tolerant_matches(taken: DataFrame) -> DataFrame:
    return taken.select(
        F.col("book_id").alias("book_line_id"),
        F.col("portal_id").alias("portal_line_id"),
        F.lit("fuzzy").alias("rule"),
        match_detail(F.col("suffix"), F.col("gap"), F.col("delta")).alias("detail"),
        F.col("delta").alias("tax_delta"),
        F.col("gap").alias("days_apart"),
        (-F.col("neg_affinity")).alias("number_similarity"),
        F.lit(False).alias("exact"),
    )


def remove_lines(df: DataFrame, used: DataFrame, config: ReconConfig = DEFAULTS) -> DataFrame:
    """Lines whose id is not in ``used`` (a cut table of ``line_id``, so counting it is cheap)."""
    return df.join(broadcast_if_small(used, config.broadcast_rows), "line_id", "left_anti")
