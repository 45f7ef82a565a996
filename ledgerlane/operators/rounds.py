"""Best-first assignment for groups too large to score inside one row.

Lines of equal side, supplier, number, tax and date form a cell. Each round finds, for every
cell, all acceptable partner cells at its smallest distance. What no other pairing can come before
is taken at once, as the one-by-one walk would take it:

* Cells that are each other's partners and nobody else's in the round, all books with all portal cells
  (often two of one side that tie for one of the other): the walk takes their books in id order, each with
  the first free portal line, so the k-th line of one side goes with the k-th of the other, over all their
  lines in one step, however the ids interleave.
* Otherwise two cells that are each other's first partner share a run: line by line, up to the first line
  of the next cell that competes for either of them.

Nearest partners are searched in blocks of one tax band by one date band. Amounts are whole
hundredths, so a block has a bounded number of cells however many lines share the key, and no
list of pairs is ever made.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane.config import ReconConfig
from ledgerlane.functions import money
from ledgerlane.operators.scale import cut, lookup, rank_in_group, rank_zip

CELL = ["side", "gstin_key", "num_key", "total_tax", "invoice_date"]
BLOCK = ["gstin_key", "join_key", "relation", "tax_band", "date_band"]
SAME, BOOK_LONGER, PORTAL_LONGER = 0, 1, 2
NEAREST_TYPES = (
    "cell_id string, neg_affinity double, delta long, gap int, partner string, partner_rep string"
)
OUT = ["neg_affinity", "delta", "gap", "book_id", "portal_id", "suffix", "gstin_key", "portal_num_key"]
_FAR = np.iinfo(np.int64).max


def nearest_partners(
    seekers: pd.DataFrame, targets: pd.DataFrame, allowed_from: str, window: int
) -> pd.DataFrame:
    """For each seeker cell: smallest (tax gap, day gap), and a row for each partner there.

    Per day of the window only the next target above and below in tax can be nearest: the
    allowance grows more slowly than the tax it is derived from.
    """
    targets = targets.sort_values(["day", "paise"], kind="stable").reset_index(drop=True)
    start = targets.reset_index().groupby(["day", "paise"], sort=True).agg(
        start=("index", "min"), cells=("index", "size"), allowed=("allowed", "first")
    )
    grouped = start.reset_index()
    day, paise = seekers["day"].to_numpy(), seekers["paise"].to_numpy()
    own_allowed = seekers["allowed"].to_numpy()
    level = np.full(len(seekers), _FAR)
    met: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # seeker, place in grouped, distance

    for target_day, slice_ in grouped.groupby("day", sort=True):
        near = np.flatnonzero(np.abs(day - target_day) <= window)
        if not len(near):
            continue
        taxes, places = slice_["paise"].to_numpy(), slice_.index.to_numpy()
        above = np.searchsorted(taxes, paise[near], "left")
        for position in (above, above - 1):
            inside = (position >= 0) & (position < len(taxes))
            rows, at = near[inside], position[inside]
            delta = np.abs(paise[rows] - taxes[at])
            limit = slice_["allowed"].to_numpy()[at] if allowed_from == "target" else (
                own_allowed[rows]
            )
            fits = delta <= limit
            rows, at, delta = rows[fits], at[fits], delta[fits]
            here = delta * (window + 1) + np.abs(day[rows] - target_day)
            close = here <= level[rows]
            rows, at, here = rows[close], at[close], here[close]
            level[rows] = here
            met.append((rows, places[at], here))

    empty = np.empty(0, dtype=np.int64)
    rows, places, here = (np.concatenate([empty, *parts]) for parts in (zip(*met) if met else ([], [], [])))
    nearest = here == level[rows]
    rows, places = rows[nearest], places[nearest]
    cells = grouped["cells"].to_numpy()[places]
    rows = np.repeat(rows, cells)
    offset = np.arange(len(rows)) - np.repeat(np.cumsum(cells) - cells, cells)
    partner = np.repeat(grouped["start"].to_numpy()[places], cells) + offset
    return pd.DataFrame(
        {
            "cell_id": seekers["cell_id"].to_numpy(dtype=object)[rows],
            "delta": level[rows] // (window + 1),
            "gap": (level[rows] % (window + 1)).astype("int32"),
            "partner": targets["cell_id"].to_numpy(dtype=object)[partner],
            "partner_rep": targets["rep"].to_numpy(dtype=object)[partner],
        }
    )


def _search_block(window: int):
    def search(block: pd.DataFrame) -> pd.DataFrame:
        sides = [block[block["side"] == side] for side in (0, 1)]
        out = []
        for side, allowed_from in ((0, "target"), (1, "seeker")):
            seekers, targets = sides[side][sides[side]["home"]], sides[1 - side]
            if len(seekers) and len(targets):
                out.append(nearest_partners(seekers, targets, allowed_from, window))
        if not out:
            return pd.DataFrame(columns=["cell_id", "neg_affinity", "delta", "gap", "partner", "partner_rep"])
        found = pd.concat(out)
        same = int(block["relation"].iloc[0]) == SAME
        found.insert(1, "neg_affinity", -1.0 if same else -0.9)
        return found

    return search


def _offers(cells: DataFrame, config: ReconConfig) -> DataFrame:
    """Every live cell under each key it can meet a partner on, in its own and neighbour bands."""

    def offer(relation: int, key):
        return F.struct(F.lit(relation).alias("relation"), key.alias("join_key"))

    is_book = F.col("side") == 0
    number, parent = F.col("num_key"), F.col("parent_key")
    offers = F.array(
        offer(SAME, number),
        offer(BOOK_LONGER, F.when(is_book, parent).otherwise(number)),
        offer(PORTAL_LONGER, F.when(is_book, number).otherwise(parent)),
    )
    width = int(max(config.tax_cap, config.tax_slack) * 100)
    days = max(config.date_window_days, 1)
    paise = (F.col("total_tax") * 100).cast("long")
    day = F.unix_date("invoice_date")
    steps = F.array(*[F.lit(step) for step in (-1, 0, 1)])
    return (
        cells.select("*", F.inline(offers))
        .where("join_key is not null")
        .select(
            "gstin_key",
            "join_key",
            "relation",
            "side",
            "cell_id",
            "rep",
            paise.alias("paise"),
            day.alias("day"),
            (money.allowed_difference(F.col("total_tax"), config) * 100)
            .cast("long")
            .alias("allowed"),
        )
        .withColumn("tax_step", F.explode(steps))
        .withColumn("date_step", F.explode(steps))
        .withColumn("home", (F.col("tax_step") == 0) & (F.col("date_step") == 0))
        .withColumn("tax_band", F.floor(F.col("paise") / width) + F.col("tax_step"))
        .withColumn("date_band", F.floor(F.col("day") / days) + F.col("date_step"))
        .drop("tax_step", "date_step")
    )


def _best(cells: DataFrame, config: ReconConfig) -> DataFrame:
    """Per cell: best level, its partners there (struct of rep and id, first line first), and a name
    of that set of partners."""
    found = (
        _offers(cells, config)
        .groupBy(*BLOCK)
        .applyInPandas(_search_block(config.date_window_days), NEAREST_TYPES)
    )
    level = F.struct("neg_affinity", "delta", "gap")
    merged = found.groupBy("cell_id").agg(
        F.min(level).alias("best"),
        # Per relation one distance: cells of two taxes and two days at most for each number met.
        F.collect_list(F.struct(level.alias("level"), "partner_rep", "partner")).alias("entries"),
    )
    at_best = F.filter("entries", lambda e: e["level"] == F.col("best"))
    partners = F.array_sort(
        F.transform(at_best, lambda e: F.struct(e["partner_rep"].alias("rep"), e["partner"].alias("id")))
    )
    return merged.select("cell_id", "best.*", partners.alias("partners")).withColumn(
        "partner_set",
        F.sha2(F.array_join(F.array_sort(F.transform("partners", lambda p: p["id"])), "\n"), 256),
    )


def assign_rounds(lines: DataFrame, config: ReconConfig) -> DataFrame:
    """Assignment of all ``lines`` (a cut table) in rounds of mutually best cells."""
    ranked = rank_in_group(lines, CELL, ["line_id"], "place", config.hot_key_rows)
    first = lines.groupBy(*CELL, "parent_key").agg(
        F.min("line_id").alias("cell_id"), F.count(F.lit(1)).alias("size")
    )
    cells = cut(first.withColumn("used", F.lit(0).cast("long")).withColumn("rep", F.col("cell_id")))
    places = cut(
        lookup(
            ranked.select(*CELL, "line_id", "place"),
            cells.select(*CELL, "cell_id"),
            CELL,
            "inner",
            config.hot_key_rows,
        ).select("cell_id", "side", "place", "line_id")
    )
    spans: DataFrame | None = None
    pairs: DataFrame | None = None
    while True:
        best = _live_best(cells, config)
        closed = cut(_closed_sets(best))
        zipped = cut(_zip_sets(closed, best, places, config))
        taken = cut(_take_runs(best.join(closed, "cell_id", "left_anti"), places, config))
        if taken.isEmpty() and zipped.isEmpty():
            break
        spans = taken if spans is None else spans.unionByName(taken)
        pairs = zipped if pairs is None else pairs.unionByName(zipped)
        spent = [
            taken.select(F.col("b_cell_id").alias("cell_id"), "lines"),
            taken.select(F.col("p_cell_id").alias("cell_id"), "lines"),
            zipped.groupBy(F.col("b_cell_id").alias("cell_id")).agg(F.count(F.lit(1)).alias("lines")),
            zipped.groupBy(F.col("p_cell_id").alias("cell_id")).agg(F.count(F.lit(1)).alias("lines")),
        ]
        cells = _use(cells, spent[0].union(spent[1]).union(spent[2]).union(spent[3]), places)
    spans, pairs = (taken, zipped) if spans is None else (spans, pairs)
    expanded = _expand(spans, places, config)
    return expanded.select(*OUT).unionByName(pairs.select(*OUT))


def _live_best(cells: DataFrame, config: ReconConfig) -> DataFrame:
    live = cells.where("used < size")
    return cut(live.join(_best(live, config), "cell_id"))


def _closed_sets(best: DataFrame) -> DataFrame:
    """cell_id, closed: cells of sets in which all books have just all portal cells as partners, and
    these just all those books; at least three cells. ``closed`` names the set.
    """
    edges = best.select(
        "side", "cell_id", "partner_set", F.size("partners").alias("degree"),
        F.explode("partners.id").alias("other"),
    )
    sets = best.select(F.col("cell_id").alias("other"), F.col("partner_set").alias("other_set"))
    back = edges.select(F.col("cell_id").alias("other"), F.col("other").alias("cell_id"))
    # A partner that has a nearer one itself does not point back.
    edges = edges.join(back, ["cell_id", "other"]).join(sets, "other")
    alike = edges.groupBy("cell_id").agg(
        (
            (F.count(F.lit(1)) == F.max("degree")) & (F.min("other_set") == F.max("other_set"))
        ).alias("alike"),
    )
    others = alike.select(F.col("cell_id").alias("other"), F.col("alike").alias("other_alike"))
    whole = (
        edges.join(alike.where("alike"), "cell_id").join(others, "other")
        .groupBy("side", "cell_id", "partner_set", "other_set")
        .agg(F.bool_and("other_alike").alias("whole"), F.max("degree").alias("degree"))
        .where("whole")
    )
    mine, theirs = F.col("partner_set"), F.col("other_set")
    name = F.when(F.col("side") == 0, F.concat(mine, theirs)).otherwise(F.concat(theirs, mine))
    named = whole.select("cell_id", "degree", name.alias("closed"))
    # One cell with one cell is a run of all their lines, and needs no list of them.
    more = named.groupBy("closed").agg(F.max("degree").alias("most")).where("most > 1").select("closed")
    return named.join(more, "closed").select("cell_id", "closed")


def _suffix(book: str, portal: str):
    longer = F.when(F.length(book) > F.length(portal), F.col(book)).otherwise(F.col(portal))
    return F.when(F.col("neg_affinity") > -1.0, F.regexp_extract(longer, "[A-Z]+$", 0))


def _zip_sets(closed: DataFrame, best: DataFrame, places: DataFrame, config: ReconConfig) -> DataFrame:
    """Line pairs of closed sets: the k-th free line of the books with the k-th of the portal's."""
    members = best.join(closed, "cell_id").select(
        "cell_id", "closed", "used", "num_key", "gstin_key", "neg_affinity", "delta", "gap"
    )
    free = lookup(places, members, ["cell_id"], "inner", config.hot_key_rows).where("place > used")

    def side(number: int) -> DataFrame:
        return free.where(F.col("side") == number).drop("side", "place", "used")

    met = rank_zip(side(0), side(1), ["closed"], "line_id", config.hot_key_rows)
    return met.where("left IS NOT NULL AND right IS NOT NULL").select(
        F.col("left.neg_affinity").alias("neg_affinity"),
        (F.col("left.delta") / 100).cast(money.MONEY).alias("delta"),
        F.col("left.gap").alias("gap"),
        F.col("left.line_id").alias("book_id"),
        F.col("right.line_id").alias("portal_id"),
        F.col("left.gstin_key").alias("gstin_key"),
        F.col("left.num_key").alias("book_num_key"),
        F.col("right.num_key").alias("portal_num_key"),
        F.col("left.cell_id").alias("b_cell_id"),
        F.col("right.cell_id").alias("p_cell_id"),
    ).withColumn("suffix", _suffix("book_num_key", "portal_num_key"))


def _take_runs(best: DataFrame, places: DataFrame, config: ReconConfig) -> DataFrame:
    """Spans of cells that are each other's first partner, up to the next competitor's first line."""

    def side(number: int, prefix: str) -> DataFrame:
        first, second = F.col("partners")[0], F.get("partners", F.lit(1))
        return best.where(F.col("side") == number).select(
            *[F.col(name).alias(f"{prefix}_{name}") for name in ("cell_id", "used", "size", "num_key")],
            first["id"].alias(f"{prefix}_partner"),
            # Another partner of this cell bounds the lines of its first one.
            second["rep"].alias(f"{prefix}_bound"),
            *([] if number else ["neg_affinity", "delta", "gap", "gstin_key"]),
        )

    meet = (F.col("b_partner") == F.col("p_cell_id")) & (F.col("p_partner") == F.col("b_cell_id"))
    met = cut(side(0, "b").join(side(1, "p"), meet))

    def before(prefix: str, other: str) -> DataFrame:
        """Free lines of a cell before the bound that its partner's other partners set."""
        bound = F.col(f"{other}_bound")
        contested = met.where(bound.isNotNull()).select(
            F.col(f"{prefix}_cell_id").alias("cell_id"), F.col(f"{prefix}_used").alias("used"), bound.alias("bound")
        )
        held = lookup(places, contested, ["cell_id"], "inner", config.hot_key_rows)
        return held.where("place > used AND line_id < bound").groupBy(
            F.col("cell_id").alias(f"{prefix}_cell_id")
        ).agg(F.count(F.lit(1)).alias(f"{prefix}_free"))

    def lines(prefix: str):
        return F.coalesce(f"{prefix}_free", F.col(f"{prefix}_size") - F.col(f"{prefix}_used"))

    return (
        met.join(before("b", "p"), "b_cell_id", "left").join(before("p", "b"), "p_cell_id", "left")
        .withColumn("suffix", _suffix("b_num_key", "p_num_key"))
        .select(
            "neg_affinity",
            (F.col("delta") / 100).cast(money.MONEY).alias("delta"),
            "gap",
            "suffix",
            "gstin_key",
            F.col("p_num_key").alias("portal_num_key"),
            "b_cell_id",
            "b_used",
            "p_cell_id",
            "p_used",
            F.least(lines("b"), lines("p")).alias("lines"),
        )
    )


def _use(cells: DataFrame, spent: DataFrame, places: DataFrame) -> DataFrame:
    """Advance used counts and point each touched cell at its next free line."""
    moved = cells.join(spent, "cell_id").withColumn("used", F.col("used") + F.col("lines"))
    following = places.select("cell_id", "place", F.col("line_id").alias("next"))
    moved = (
        moved.where("used < size")
        .withColumn("place", F.col("used") + 1)
        .join(following, ["cell_id", "place"])
        .withColumn("rep", F.col("next"))
    )
    still = cells.join(spent, "cell_id", "left_anti")
    return cut(still.unionByName(moved.select(*still.columns)))


def _expand(taken: DataFrame, places: DataFrame, config: ReconConfig) -> DataFrame:
    """Cell pairs back to line pairs: the k-th free line of one with the k-th of the other."""
    pair = ["b_cell_id", "b_used", "p_cell_id", "p_used"]

    def side(prefix: str, name: str) -> DataFrame:
        spans = taken.select(
            *pair, "lines", F.col(f"{prefix}_cell_id").alias("cell_id")
        )
        met = lookup(places, spans, ["cell_id"], "inner", config.hot_key_rows)
        offset = F.col("place") - F.col(f"{prefix}_used")
        return met.where((offset >= 1) & (offset <= F.col("lines"))).select(
            *pair, offset.alias("offset"), F.col("line_id").alias(name)
        )

    levels = taken.select(
        *pair, "neg_affinity", "delta", "gap", "suffix", "gstin_key", "portal_num_key"
    )
    books = lookup(side("b", "book_id"), levels, pair, "inner", config.hot_key_rows)
    return books.join(side("p", "portal_id"), [*pair, "offset"])
