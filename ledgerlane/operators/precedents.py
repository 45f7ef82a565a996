"""Resolved cases as retrievable precedents: hashed token vectors, cosine, top matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlane.config import DEFAULTS, ReconConfig
from ledgerlane.operators.scale import broadcast_if_small, cut, fan_out

DIMENSIONS = 256
USUAL_SHARE = 8
"""An index is usual in a class when more than one in so many of its precedents has it."""

LIST_ROWS = 64
"""Precedents of a class ranked for queries that share no rare index with them, at first."""


def with_embedding(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Add the sparse bag-of-tokens vector of ``text``: array of struct(idx, weight), by index.

    Each token's SHA-256 picks an index (first four bytes) and a sign (fifth byte). The unit
    vector is the weights over ``norm_squared``'s root; keeping integers keeps ties exact. Steps
    are separate columns so that each token is hashed once.
    """
    cleaned = F.trim(F.regexp_replace(F.upper(F.translate(text, "/", " ")), r"(?U)\s+", " "))
    tokens = F.filter(F.split(cleaned, " "), lambda t: t != "")

    def vote(digest: Column) -> Column:
        index = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % DIMENSIONS
        even = F.conv(F.substring(digest, 9, 2), 16, 10).cast("int") % 2 == 0
        return F.struct(
            index.cast("int").alias("idx"), F.when(even, 1).otherwise(-1).alias("weight")
        )

    def total(index: Column) -> Column:
        mine = F.filter("_votes", lambda v: v["idx"] == index)
        return F.struct(
            index.alias("idx"),
            F.aggregate(mine, F.lit(0), lambda n, v: n + v["weight"]).alias("weight"),
        )

    indexes = F.array_sort(F.array_distinct(F.transform("_votes", lambda v: v["idx"])))
    return (
        df.withColumn("_digests", F.transform(tokens, lambda t: F.sha2(t, 256)))
        .withColumn("_votes", F.transform("_digests", vote))
        .withColumn(name, F.filter(F.transform(indexes, total), lambda e: e["weight"] != 0))
        .drop("_digests", "_votes")
    )


def norm_squared(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0), lambda n, e: n + e["weight"] * e["weight"])


def dense_weights(vector: Column) -> Column:
    """The sparse vector as an array of all 256 integer weights; without a vector, of zeros.

    Each entry brings the zeros between it and the one before, so a vector is walked once.
    """

    def zeros(count: Column) -> Column:
        return F.array_repeat(F.lit(0), count.cast("int"))

    def stretch(entry: Column, place: Column) -> Column:
        before = F.coalesce(F.get(vector, place - 1)["idx"], F.lit(-1))
        return F.concat(zeros(entry["idx"] - before - 1), F.array(entry["weight"]))

    last = F.coalesce(F.get(vector, F.size(vector) - 1)["idx"], F.lit(-1))
    whole = F.concat(F.flatten(F.transform(vector, stretch)), zeros(F.lit(DIMENSIONS - 1) - last))
    return F.coalesce(whole, zeros(F.lit(DIMENSIONS)))


def sparse_dot(left: Column, right: Column) -> Column:
    """Integer dot product of two short sparse vectors."""

    def weight(vector: Column, index: Column) -> Column:
        same = F.filter(vector, lambda e: e["idx"] == index)
        return F.aggregate(same, F.lit(0), lambda n, e: n + e["weight"])

    return F.aggregate(left, F.lit(0), lambda n, e: n + e["weight"] * weight(right, e["idx"]))


def sparse_cosine(dot: Column, left_norm: Column, right_norm: Column) -> Column:
    scale = left_norm * right_norm
    return F.when(scale == 0, F.lit(0.0)).otherwise(dot / F.sqrt(scale))


def dense_cosine(left: Column, right: Column) -> Column:
    """Cosine of two arrays of equal length."""

    def dot(a: Column, b: Column) -> Column:
        products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda n, x: n + x)

    return dot(left, right) / F.sqrt(dot(left, left) * dot(right, right))


def precedent_text(exception_class: Column, gstin: Column, summary: Column | None = None) -> Column:
    return F.concat(
        exception_class, F.lit(" "), gstin, F.lit(" "), summary if summary is not None else F.lit("")
    )


def new_cases(incoming: DataFrame, existing: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    """Confirmed cases not stored yet, one per id.

    ``partitions``: where the stored ones are bucketed by id, their buckets, so that they need not move.
    """
    # Hashing texts is much work for few bytes, so the rows are spread by a stated count; the
    # same exchange serves the uniqueness of ids and the check against stored ones.
    fresh = fan_out(incoming.where("human_confirmed"), "precedent_id", partitions)
    fresh = fresh.dropDuplicates(["precedent_id"])
    if existing is not None:
        fresh = fresh.join(existing.select("precedent_id"), "precedent_id", "left_anti")
    return fresh


def with_vectors(cases: DataFrame) -> DataFrame:
    text = precedent_text(F.col("exception_class"), F.col("gstin"), F.col("summary"))
    return (
        with_embedding(cases, text, "vector")
        .withColumn("norm_squared", norm_squared(F.col("vector")))
        .withColumn("weights", dense_weights(F.col("vector")))
    )


def add_precedents(incoming: DataFrame, existing: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    """``new_cases`` with their vectors."""
    return with_vectors(new_cases(incoming, existing, partitions))


def _asked(queries: DataFrame) -> DataFrame:
    asked = with_embedding(
        queries.select("exception_class", "gstin").distinct(),
        precedent_text(F.col("exception_class"), F.col("gstin")),
        "q_vector",
    )
    name = F.concat("exception_class", F.lit(" "), F.to_json("q_vector"))
    return asked.withColumn("q_id", F.sha2(name, 256))


def usual_indexes(precedents: DataFrame) -> DataFrame:
    """exception_class, usual: the indexes that more than 1/8 of a class's precedents have.

    At most 256 a class. Counts are combined before the shuffle.
    """
    sizes = precedents.groupBy("exception_class").agg(F.count(F.lit(1)).alias("stored"))
    held = (
        precedents.select("exception_class", F.explode("vector.idx").alias("idx"))
        .groupBy("exception_class", "idx").agg(F.count(F.lit(1)).alias("held"))
    )
    often = held.join(sizes, "exception_class").where(USUAL_SHARE * F.col("held") > F.col("stored"))
    found = often.groupBy("exception_class").agg(F.collect_set("idx").alias("usual"))
    return sizes.join(found, "exception_class", "left").select(
        "exception_class", "stored", F.coalesce("usual", F.array().cast("array<int>")).alias("usual")
    )


def _split(vector: str) -> dict[str, Column]:
    """A vector's entries at usual indexes of the class, and the others."""
    among = lambda e: F.array_contains("usual", e["idx"])
    return {"common": F.filter(vector, among), "rare": F.filter(vector, lambda e: ~among(e))}


def posted_pairs(vectors: DataFrame, stored: DataFrame) -> DataFrame:
    """q_id, precedent_id and score of all pairs that share a rare index: a join of postings.

    ``vectors``: exception_class, q_id, q_norm, common, rare. ``stored`` adds precedent_id and norm_squared. A pair
    is scored once, where the first index that it shares is met, so pairs are not moved to be added up.
    """
    asked = vectors.select(
        "exception_class", "q_id", "q_norm", F.col("common").alias("q_common"), F.col("rare").alias("q_rare"),
        F.explode("rare.idx").alias("idx"),
    )
    postings = stored.select(
        "exception_class", "precedent_id", "norm_squared", "common", "rare", F.explode("rare.idx").alias("idx")
    )
    shared = F.array_intersect("rare.idx", "q_rare.idx")
    met = postings.join(asked, ["exception_class", "idx"]).where(F.col("idx") == F.array_min(shared))
    dot = sparse_dot(F.col("q_rare"), F.col("rare")) + sparse_dot(F.col("q_common"), F.col("common"))
    return met.select("q_id", "precedent_id", sparse_cosine(dot, F.col("q_norm"), F.col("norm_squared")).alias("score"))


def _ranked(pairs: DataFrame, keys: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "precedent_id")
    return pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def common_pairs(vectors: DataFrame, stored: DataFrame, top: int) -> DataFrame:
    """q_id, precedent_id and score of the ``top`` precedents of each query that share no rare index with it.

    Without one the score depends on the usual entries alone, so queries that agree on these share one
    short list of the class, and pass over what their postings found. A list that turns out too
    short for some queries is taken sixteen times as long for these.
    """
    pattern = ["exception_class", "q_common", "q_norm"]
    vectors = vectors.withColumnRenamed("common", "q_common").select(
        *pattern, "q_id", F.col("rare.idx").alias("q_rare")
    )
    alike = ["exception_class", "common", "norm_squared"]
    found, depth = None, LIST_ROWS
    while True:
        asked = vectors.select(*pattern).distinct()
        # Precedents that agree on these have one score in every pattern: only the first of each kind can be listed.
        first = F.row_number().over(Window.partitionBy(*alike).orderBy("precedent_id"))
        lists = stored.select(*alike, "stored", "precedent_id", F.col("rare.idx").alias("rare"))
        lists = lists.withColumn("first", first).where(F.col("first") <= depth).drop("first")
        lists = lists.join(asked, "exception_class")
        score = sparse_cosine(sparse_dot(F.col("q_common"), F.col("common")), F.col("q_norm"), F.col("norm_squared"))
        lists = _ranked(lists.withColumn("score", score), pattern, depth).drop("common", "norm_squared", "place")
        met = vectors.join(lists, pattern)
        apart = F.count_if(~F.arrays_overlap("q_rare", "rare"))
        short = cut(
            met.groupBy("q_id").agg(apart.alias("apart"), F.max("stored").alias("stored"))
            .where((F.col("apart") < top) & (F.col("stored") > depth)).select("q_id")
        )
        enough = met.where(~F.arrays_overlap("q_rare", "rare")).join(short, "q_id", "left_anti")
        enough = _ranked(enough, ["q_id"], top).select("q_id", "precedent_id", "score")
        found = enough if found is None else found.unionByName(enough)
        if short.isEmpty():
            return found
        vectors, depth = vectors.join(short, "q_id", "left_semi"), 16 * depth


def search_precedents(
    queries: DataFrame, precedents: DataFrame, config: ReconConfig = DEFAULTS
) -> DataFrame:
    """Top precedents for each (exception_class, gstin) asked about.

    Queries are reduced to distinct vectors first. Only precedents in a posting list (class, index) of a
    rare index of the query are scored for it; the rest of a class differs by usual entries alone and
    is ranked once for all queries that agree on them. Texts are fetched for the hits alone.
    """
    top = config.precedents_per_query
    asked = cut(_asked(queries))
    # Read by four steps; their vectors are hashed once.
    precedents = cut(precedents.select(
        "exception_class", "precedent_id", "gstin", "summary", "probe_sequence", "resolution", "vector", "norm_squared"
    ))
    classes = cut(usual_indexes(precedents))
    classes = broadcast_if_small(classes, config.broadcast_rows)
    vectors = asked.select("exception_class", "q_id", "q_vector").distinct().join(classes, "exception_class")
    vectors = vectors.withColumns(_split("q_vector")).withColumn("q_norm", norm_squared(F.col("q_vector")))
    vectors = broadcast_if_small(
        cut(vectors.select("exception_class", "q_id", "q_norm", "common", "rare")), config.broadcast_rows
    )
    stored = precedents.select("exception_class", "precedent_id", "norm_squared", "vector").join(classes, "exception_class")
    stored = stored.withColumns(_split("vector")).drop("vector", "usual")
    pairs = posted_pairs(vectors, stored).unionByName(common_pairs(vectors, stored, top))
    best = cut(_ranked(pairs, ["q_id"], top))
    # At most k rows per distinct vector.
    best = broadcast_if_small(best, top * config.broadcast_rows)
    told = precedents.select(
        "precedent_id",
        F.col("gstin").alias("p_gstin"),
        "summary",
        "probe_sequence",
        "resolution",
    )
    return (
        asked.join(told.join(best, "precedent_id"), "q_id")
        .select(
            "exception_class",
            "gstin",
            "place",
            "precedent_id",
            F.round("score", 4).alias("similarity"),
            "summary",
            "probe_sequence",
            "resolution",
            (F.col("p_gstin") == F.col("gstin")).alias("same_vendor"),
        )
    )


def precedent_hint(hits: DataFrame) -> DataFrame:
    """Prompt lines per query, best hit first (at most the top-k lines each)."""
    probes = F.when(F.size("probe_sequence") == 0, F.lit("(none)")).otherwise(
        F.array_join("probe_sequence", " -> ")
    )
    line = F.concat(
        F.lit("- "),
        F.col("summary"),
        F.lit(" (probes: "),
        probes,
        F.lit("; outcome: "),
        F.col("resolution"),
        F.lit(")"),
    )
    lines = F.array_sort(F.collect_list(F.struct("place", line.alias("line"))))
    return hits.groupBy("exception_class", "gstin").agg(
        F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("hint")
    )
