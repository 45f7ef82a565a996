"""MinHash near-duplicates by a multi-index Hamming join.

A document's set is its distinct four-word shingles; its signature has 128 MinHash symbols of 32 bits.
Two signatures are near when at most ``APART`` symbols differ. The signature is split into chunks; by the
pigeonhole principle, two near signatures differ in at most ``errors`` symbols in some chunk (with the
numbers here: in at least ``AGREEING`` chunks). Instead of listing all values that a chunk may have after
an error, each chunk is indexed once for every choice of ``errors`` symbols to leave out: chunks that differ
in these symbols only meet in that key. So every pair within the distance shares a key; none is missed.

What shares a key is compared by distance, and what is near enough is confirmed on the whole sets. Distance
estimates similarity: a pair at exactly 0.80 differs in 25.6 symbols on average, and lies beyond 47 with a
probability of 4 in 1,000,000 (binomial tail); closer pairs, far less.

A document with fewer than 128 - 47 symbols that any other set has at the same place has no near one: only the
others are indexed, which leaves out most documents that share no more than a passage.

As in ``links``, equal sets are one class, and the answer is the classes' connected components. Every key first
compares its classes with one centre, in three turns, so that a group of thousands of copies falls into one
component in a linear number of pairs. Then symbols, and shingles, count only where another component has them:
classes with enough of both that still share a key are compared in full, but for pairs inside the key's largest
component. A sketch of a class's shingles bounds what a pair has in common: a bit that one marks and the other does
not stands for a shingle that is in one only. So a group of texts just below the similarity hands on few of its
pairs; they are still compared inside the join. Pairs that agree in fewer than ``AGREEING`` chunks are no near pairs.

Defined cases: a NULL text counts as empty; a document without words has no shingles, is linked with nothing and
is kept; one with fewer than four words is one shingle of the whole sequence; repeated rows give one result row
each, all with the same ``kept``; a row with a NULL id takes the least id of its component and is kept only where the
component has none; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.llm.common import WordHashes, mix, shingle_set, small_batches, table
from ledgerlane.llm.fingerprints import PERMUTATIONS, signatures
from ledgerlane.llm.links import apart_by_sketch, merge, set_class, shingle_sets, verify
from ledgerlane.operators.scale import cut

SHINGLE = 4
LIKENESS = (80, 100)
"""Links need this similarity or more, as a fraction."""

APART = 47
"""Symbols in which near signatures differ at most."""

CHUNKS = 26
STAR_ROUNDS = 3
PEELS = 2
"""Times that classes go which cannot link to what is left."""

SKETCH_WORDS = 16
"""Words of 64 bits of a sketch. It bounds less where a set has far more shingles than bits."""

TOGETHER = 200
"""Documents whose signatures are computed together."""


ERRORS = 1
"""Symbols left out of a chunk."""

AGREEING = CHUNKS - APART // (ERRORS + 1)
"""Chunks in which near signatures differ in ``ERRORS`` symbols at most: each other one needs more."""


def chunk_keys(marks: np.ndarray, chunks: int = CHUNKS, errors: int = ERRORS) -> tuple[np.ndarray, np.ndarray]:
    """For each row of symbols its 64-bit keys: each chunk without each choice of its errors. And for
    each key the name of what it leaves out, 0 for a chunk's first choice.

    Equal chunks have all keys in common, but only the first choice leaves out what is named alike: a chunk
    counts once where keys meet whose names differ or are 0.
    """
    places = np.arange(1, marks.shape[1] + 1, dtype=np.uint64)
    terms = (marks.astype(np.uint64) + np.uint64(1)) * (mix(places) | np.uint64(1))
    edges = np.linspace(0, marks.shape[1], chunks + 1).astype(int)
    keys, names, tag = [], [], 0
    for low, high in zip(edges, edges[1:]):
        whole = terms[:, low:high].sum(axis=1)
        for choice, left_out in enumerate(combinations(range(low, high), errors)):
            tag += 1
            gone = terms[:, list(left_out)].sum(axis=1)
            keys.append(mix(whole - gone + mix(np.uint64([tag]))))
            names.append(gone if choice else np.zeros(len(marks), dtype=np.uint64))
    return np.stack(keys, axis=1), np.stack(names, axis=1)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class and signature of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for batch in batches:
            for low in range(0, len(batch), TOGETHER):
                part = batch.iloc[low : low + TOGETHER]
                sets = [shingle_set(t, words, SHINGLE) for t in part["text"]]
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].to_numpy(),
                        "n_shingles": [len(s) for s in sets],
                        "class": [set_class(s) for s in sets],
                        "signature": [m.astype("<u4").tobytes() for m in signatures(sets, kind=np.uint32)],
                    }
                )

    # Ids travel as text: pandas would turn whole numbers with gaps into floats.
    return (
        docs.select(F.col("doc_id").cast("string"), "text")
        .mapInPandas(run, "doc_id string, n_shingles long, class long, signature binary")
        .withColumn("doc_id", F.col("doc_id").cast("long"))
    )


def _marks(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<u4").reshape(len(column), PERMUTATIONS)


def indexed(classes: DataFrame) -> DataFrame:
    """key, without, class, n: the chunk keys of each class and the names of what they leave out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                keys, names = chunk_keys(_marks(batch["signature"]))
                yield pd.DataFrame(
                    {
                        "key": keys.view(np.int64).ravel(),
                        "without": names.view(np.int64).ravel(),
                        "class": np.repeat(batch["class"].to_numpy(), keys.shape[1]),
                        "n": np.repeat(batch["n"].to_numpy(), keys.shape[1]),
                    }
                )

    return classes.select("class", "n", "signature").mapInPandas(run, "key long, without long, class long, n long")


def symbols(classes: DataFrame) -> DataFrame:
    """symbol, class, comp: a name of each symbol at its place, for each class with a component."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                marks = _marks(batch["signature"]).astype(np.int64)
                named = marks | (np.arange(PERMUTATIONS, dtype=np.int64) << 32)
                yield pd.DataFrame(
                    {
                        "symbol": named.ravel(),
                        "class": np.repeat(batch["class"].to_numpy(), PERMUTATIONS),
                        "comp": np.repeat(batch["comp"].to_numpy(), PERMUTATIONS),
                    }
                )

    return classes.select("class", "comp", "signature").mapInPandas(run, "symbol long, class long, comp long")


def not_alone(classes: DataFrame) -> DataFrame:
    """class, held: those with enough symbols that a class of another component has at the same place too."""
    found = symbols(classes).groupBy("symbol").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    shared = found.where("lo != hi").select("symbol")
    held = symbols(classes).join(shared, "symbol").groupBy("class").agg(F.count(F.lit(1)).alias("held"))
    return held.where(F.col("held") >= PERMUTATIONS - APART)


def in_others(sets: DataFrame, sketch: bool = False) -> DataFrame:
    """class, comp, n, shared: how many shingles a class of another component has too; with a sketch
    of these as ``bits``, if asked for.

    ``sets`` has class, comp and shingles. Classes that cannot have the similarity by this are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                yield pd.DataFrame(
                    {
                        "shingle": np.frombuffer(row["shingles"], dtype="<u8").view(np.int64),
                        "class": row["class"],
                        "comp": row["comp"],
                    }
                )

    share, whole = LIKENESS
    each = sets.mapInPandas(run, "shingle long, class long, comp long")
    found = each.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    held = each.join(found.where("lo != hi").select("shingle"), "shingle")
    place = F.shiftrightunsigned("shingle", 64 - (64 * SKETCH_WORDS - 1).bit_length())
    bit = F.expr("shiftleft(1L, cast(place % 64 AS int))")
    bits = F.array(*[F.bit_or(F.when(F.shiftright("place", 6) == i, bit).otherwise(0)) for i in range(SKETCH_WORDS)])
    held = held.withColumn("place", place).groupBy("class").agg(
        F.count(F.lit(1)).alias("shared"), *([bits.alias("bits")] if sketch else [])
    )
    size = (F.octet_length("shingles") / 8).cast("long")
    return (
        sets.select("class", "comp", size.alias("n")).join(held, "class")
        .where(whole * F.col("shared") >= share * F.col("n"))
    )


def near(pairs: DataFrame, classes: DataFrame, apart: int = APART) -> DataFrame:
    """The pairs (a, b) of classes whose signatures differ in at most ``apart`` symbols."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                keep = (_marks(batch["left"]) != _marks(batch["right"])).sum(axis=1) <= apart
                yield batch.loc[keep, ["a", "b"]]

    one = classes.select(F.col("class").alias("a"), F.col("signature").alias("left"))
    two = classes.select(F.col("class").alias("b"), F.col("signature").alias("right"))
    return (
        pairs.join(one, "a").join(two, "b").select("a", "b", "left", "right").mapInPandas(run, "a long, b long")
    )


def _alike(n: str, other: str):
    """Whether sets of these sizes can have the similarity."""
    share, whole = LIKENESS
    return whole * F.least(n, other) >= share * F.greatest(n, other)


def _pair(one: str, two: str) -> list:
    return [F.least(one, two).alias("a"), F.greatest(one, two).alias("b")]


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach), kept."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    index = cut(signed(docs))
    filled = index.where("n_shingles > 0")
    # Copies carry the same signature: each class enters once.
    classes = cut(
        filled.groupBy("class").agg(
            F.min("doc_id").alias("doc_id"),
            F.max("n_shingles").alias("n"),
            F.max("signature").alias("signature"),
        )
    )
    first = cut(not_alone(classes.withColumn("comp", F.col("class"))))
    active = cut(classes.join(first, "class"))
    sets = cut(shingle_sets(docs, active.select("doc_id"), SHINGLE))
    repeated = indexed(active).groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("key")
    entries = cut(indexed(active).join(repeated, "key").join(first, "class"))
    labels = cut(entries.select("class").distinct().withColumn("comp", F.col("class")))
    tested = None
    for turn in range(STAR_ROUNDS):
        live = entries.join(labels, "class")
        # First the class with the fewest symbols of its own, as the text that others are copies of has. Keys
        # draw alike, so that a class meets few centres whatever the number of its keys.
        own = -F.col("held") if turn == 0 else F.lit(0)
        draw = F.xxhash64("class", F.lit(turn))
        centre = F.struct(own.alias("own"), draw.alias("draw"), "class", "comp", "n")
        centres = (
            live.groupBy("key")
            .agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(centre).alias("at"))
            .where("lo != hi")
            .select("key", F.col("at.class").alias("other"), F.col("at.comp").alias("other_comp"), F.col("at.n").alias("other_n"))
        )
        met = live.join(centres, "key").where((F.col("comp") != F.col("other_comp")) & _alike("n", "other_n"))
        pairs = met.select(*_pair("class", "other")).distinct()
        pairs = cut(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        tested = pairs if tested is None else tested.unionByName(pairs)
        labels = merge(labels, cut(verify(near(pairs, active), sets, *LIKENESS)))

    # What is left must be able to link to another component, by symbols and by shingles.
    left = not_alone(active.join(labels, "class")).select("class")
    left = cut(labels.join(left, "class"))
    for turn in range(PEELS):
        left = cut(in_others(left.select("class", "comp").join(sets, "class"), sketch=turn == PEELS - 1))
    live = entries.select("key", "without", "class").join(left, "class")
    largest = (
        live.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("size"))
        .groupBy("key").agg(F.max(F.struct("size", "comp")).alias("top"), F.count(F.lit(1)).alias("comps"))
        .where("comps > 1").select("key", F.col("top.comp").alias("top"))
    )
    apart = cut(live.join(largest, "key"))
    others = apart.select("key", *[F.col(c).alias(f"other_{c}") for c in ("class", "comp", "n", "shared", "bits", "without", "top")])
    once = [
        # A pair without a class of the largest component would meet from both sides.
        (F.col("other_comp") == F.col("other_top")) | (F.col("class") < F.col("other_class")),
        (F.col("without") == 0) | (F.col("without") != F.col("other_without")),
    ]
    possible = apart_by_sketch(SKETCH_WORDS, *LIKENESS)
    met = (
        apart.where("comp != top").drop("top").join(others, "key")
        .where((F.col("comp") != F.col("other_comp")) & once[0] & once[1] & _alike("n", "other_n") & possible)
    )
    pairs = met.groupBy(*_pair("class", "other_class")).agg(F.count(F.lit(1)).alias("chunks"))
    pairs = cut(pairs.where(F.col("chunks") >= AGREEING).select("a", "b").join(tested, ["a", "b"], "left_anti"))
    labels = merge(labels, cut(verify(near(pairs, active), sets, *LIKENESS)))

    heads = classes.select("class", "doc_id").join(labels, "class", "left")
    heads = heads.select("class", "doc_id", F.coalesce("comp", "class").alias("comp"))
    least = heads.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    of_class = cut(heads.join(least, "comp").select("class", "component_id"))
    named = filled.join(of_class, "class").select("doc_id", "n_shingles", "component_id")
    alone = index.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return named.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op11_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = {
    "op11_hamming": r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda w: w != '') AS w
    FROM documents
), sets AS (
    SELECT doc_id, CASE
        WHEN len(w) = 0 THEN []::VARCHAR[]
        WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2),
            lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
    FROM words
), tokens AS (
    SELECT doc_id, len(s) AS n, unnest(s) AS token FROM sets
), links AS (
    SELECT a.doc_id AS x, b.doc_id AS y
    FROM tokens a JOIN tokens b ON a.token = b.token AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n
    HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), edges AS (
    SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
    SELECT doc_id AS x, doc_id AS y FROM documents
    UNION
    SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x
)
SELECT s.doc_id, len(s.s) AS n_shingles, r.component_id, s.doc_id = r.component_id AS kept
FROM sets s JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) r ON s.doc_id = r.x
""",
}
