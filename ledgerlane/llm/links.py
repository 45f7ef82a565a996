"""Classes of linked documents from an index of candidate keys, without listing all pairs.

Documents of equal shingle sets are one set class. Classes that share an index key are candidates;
a link needs the similarity, counted on the whole sets. The answer is the connected components:

1. In two rounds every key compares its classes with one centre each (a linear number of pairs),
   and linked classes merge. A group of thousands of near copies falls into one component here.
2. What then still shares a key across components is compared in full: each class outside the
   largest component of its key with every class of other components. No pair that could join two
   components is left out, and pairs inside a component cannot change the answer.

Work goes by key and class in ordinary joins on written tables, which adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane.llm.common import SHINGLE_WORDS, WordHashes, shared, shingle_set
from ledgerlane.operators.scale import cut

STAR_ROUNDS = 2
SKETCH_WORDS = 8
FILTER_BITS = (16, 27)
"""Least and most bits, as powers of two, of the filter that picks documents to hash again."""


def set_class(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a shingle set."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def id_filter(ids: DataFrame):
    """A column expression that holds for every doc_id in ``ids`` and for few others."""
    words, power = _filter_words(ids)
    get = shared(ids.sparkSession, words)

    @F.pandas_udf("boolean")
    def among(marks: pd.Series) -> pd.Series:
        return pd.Series(_hits(marks.to_numpy(dtype=np.int64), get(), power))

    return among(F.xxhash64(F.col("doc_id").cast("long")))


def _hits(marks: np.ndarray, words: np.ndarray, power: int) -> np.ndarray:
    hit, mask = np.ones(len(marks), dtype=bool), np.int64((1 << power) - 1)
    for place in (marks & mask, (marks >> np.int64(32)) & mask):
        hit &= ((words[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
    return hit


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose doc_id is not among ``ids``, without shuffling the texts that stay.

    A filter of bounded size passes what is surely kept. Of the rest, the ids that it caught by
    chance are found in a join of ids alone, and only their documents take part in a join.
    """
    ids = cut(ids.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct())
    caught = id_filter(ids)
    by_chance = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(caught).join(ids, "doc_id", "left_anti"))
    kept = docs.where(~caught)
    if by_chance.isEmpty():
        return kept
    again = docs.where(caught).where(id_filter(by_chance))
    key = by_chance.select(F.col("doc_id").alias("_kept")).distinct()
    back = again.join(key, again["doc_id"].eqNullSafe(key["_kept"]), "left_semi")
    return kept.unionByName(back)


def _filter_words(ids: DataFrame) -> tuple[np.ndarray, int]:
    """A Bloom filter of two bits per id, as 64-bit words; at most 16 MB whatever the input."""
    least, most = FILTER_BITS
    power = min(most, max(least, (16 * ids.count()).bit_length()))
    found = np.zeros(1 << (power - 6), dtype=np.uint64)
    mark = F.xxhash64("doc_id")
    places = [F.pmod(mark, F.lit(1 << power)), F.pmod(F.shiftright(mark, 32), F.lit(1 << power))]
    words = (
        ids.select(F.explode(F.array(*places)).alias("place"))
        .groupBy(F.shiftright("place", 6).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 AS int)))").alias("bits"))
    )
    for row in words.toLocalIterator():
        found[row["word"]] = np.uint64(row["bits"] & ((1 << 64) - 1))
    return found, power


def shingle_sets(docs: DataFrame, ids: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """class, shingles (sorted little-endian 64-bit numbers) of the documents in ``ids``, and few more.

    Texts of other documents are passed over by a filter inside the scan, not shuffled.
    """
    words, power = _filter_words(ids)
    get = shared(docs.sparkSession, words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, known = get(), WordHashes()
        for batch in batches:
            hit = _hits(batch["mark"].to_numpy(dtype=np.int64), held, power)
            sets = [shingle_set(t, known, size) for t in batch["text"][hit]]
            yield pd.DataFrame(
                {
                    "class": pd.Series([set_class(s) for s in sets], dtype="int64"),
                    "shingles": [s.astype("<u8").tobytes() for s in sets],
                }
            )

    marked = docs.select("text", F.xxhash64(F.col("doc_id").cast("long")).alias("mark"))
    return marked.mapInPandas(run, "class long, shingles binary").dropDuplicates(["class"])


def verify(pairs: DataFrame, sets: DataFrame, share: int, whole: int) -> DataFrame:
    """a, b of the pairs whose sets have ``whole * intersection >= share * union``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for left, right in zip(batch["left"], batch["right"]):
                x, y = np.frombuffer(left, dtype="<u8"), np.frombuffer(right, dtype="<u8")
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(whole * common >= share * (len(x) + len(y) - common))
            yield batch.loc[keep, ["a", "b"]]

    one = sets.select(F.col("class").alias("a"), F.col("shingles").alias("left"))
    two = sets.select(F.col("class").alias("b"), F.col("shingles").alias("right"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "left", "right").mapInPandas(
        run, "a long, b long"
    )


def merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (class, comp) after joining the components that links (a, b) connect.

    Each round every component hooks to its least neighbour, hooks are followed to their ends, and
    the links are renamed; rounds grow with the logarithm of the components.
    """
    one = labels.select(F.col("class").alias("a"), F.col("comp").alias("u"))
    two = labels.select(F.col("class").alias("b"), F.col("comp").alias("v"))
    edges = cut(
        links.join(one, "a").join(two, "b").where("u != v")
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    )
    while not edges.isEmpty():
        hooks = cut(edges.groupBy(F.col("v").alias("comp")).agg(F.min("u").alias("root")))
        while True:
            above = hooks.select(F.col("comp").alias("root"), F.col("root").alias("up"))
            followed = cut(
                hooks.join(above, "root", "left").select(
                    "comp", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")
                )
            )
            hooks = followed.select("comp", "root")
            if followed.where("moved").isEmpty():
                break
        labels = cut(
            labels.join(hooks, "comp", "left").select("class", F.coalesce("root", "comp").alias("comp"))
        )
        one = hooks.select(F.col("comp").alias("u"), F.col("root").alias("u_root"))
        two = hooks.select(F.col("comp").alias("v"), F.col("root").alias("v_root"))
        u, v = F.coalesce("u_root", "u"), F.coalesce("v_root", "v")
        edges = cut(
            edges.join(one, "u", "left").join(two, "v", "left")
            .select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).where("u != v").distinct()
        )
    return labels


def _possible(share: int, whole: int):
    """Whether the similarity is possible: by this key, no pair has more than ``held`` in common."""
    common = F.least("held", "other_held")
    return whole * common >= share * (F.col("n") + F.col("other_n") - common)


def apart_by_sketch(words: int, share: int, whole: int):
    """Whether sketches allow the similarity: a bit that one set marks and the other does not stands
    for at least one element that is not in common."""
    def alone(mine: str, theirs: str):
        bits = [F.bit_count(F.col(mine)[i].bitwiseAND(F.bitwise_not(F.col(theirs)[i]))) for i in range(words)]
        return sum(bits[1:], bits[0])

    common = F.least(
        F.col("shared") - alone("bits", "other_bits"), F.col("other_shared") - alone("other_bits", "bits")
    )
    return whole * common >= share * (F.col("n") + F.col("other_n") - common)


def _others(prefix: str = "") -> list:
    return [F.col(prefix + c).alias("other" if c == "class" else f"other_{c}") for c in ("class", "comp", "n", "held")]


def _pairs(df: DataFrame) -> DataFrame:
    return df.select(
        F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b")
    ).distinct()


def linked_classes(docs: DataFrame, index: DataFrame, share: int, whole: int) -> DataFrame:
    """doc_id, n_shingles, component_id: the least doc_id that links reach.

    ``index`` has doc_id, n_shingles, class and the candidate ``keys`` of each document, each with the
    number ``held`` of shingles at most that a partner found by it can have in common. Any two sets
    with a similarity of ``share / whole`` must have a key in common that allows it. It may also have
    a sketch ``bits`` of the ``shared`` shingles that can occur in another set at all. Documents without shingles
    are linked with nothing; NULL ids take the least id of their component, if it has one.
    """
    index = cut(index)
    classes = index.where("n_shingles > 0")
    # Copies carry the same keys: each class enters once.
    entries = classes.select("class", F.col("n_shingles").alias("n"), F.inline("keys"))
    shared = entries.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi"))
    entries = cut(
        entries.join(shared.where("lo != hi").select("key"), "key").dropDuplicates(["key", "class"])
    )
    active = entries.select("class").distinct()
    heads = classes.groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    active = cut(active.join(heads, "class"))
    labels = active.select("class", F.col("class").alias("comp"))
    if not active.isEmpty():
        sets = cut(shingle_sets(docs, active.select("doc_id")))
        tested = None
        for turn in range(STAR_ROUNDS):
            live = entries.join(labels, "class")
            # First the class with the least of its own, as the text that others are copies of has.
            own = (F.col("n") - F.col("held")) / F.col("n") if turn == 0 else F.lit(0.0)
            centre = F.struct(own.alias("own"), F.xxhash64("class", F.lit(turn)).alias("draw"), "class", "comp", "n", "held")
            centres = (
                live.groupBy("key")
                .agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(centre).alias("at"))
                .where("lo != hi")
                .select("key", *_others("at."))
            )
            near = live.join(centres, "key").where("comp != other_comp").where(_possible(share, whole))
            pairs = _pairs(near)
            pairs = cut(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
            tested = pairs if tested is None else tested.unionByName(pairs)
            labels = merge(labels, cut(verify(pairs, sets, share, whole)))
        live = cut(entries.join(labels, "class"))
        largest = (
            live.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("size"))
            .groupBy("key").agg(F.max(F.struct("size", "comp")).alias("top"), F.count(F.lit(1)).alias("comps"))
            .where("comps > 1").select("key", F.col("top.comp").alias("top"))
        )
        apart = live.join(largest, "key")
        allowed = _possible(share, whole)
        more = [c for c in ("shared", "bits") if c in index.columns]
        if more:
            apart = apart.join(classes.where("bits IS NOT NULL").select("class", *more).dropDuplicates(["class"]), "class")
            allowed &= apart_by_sketch(SKETCH_WORDS, share, whole)
        apart = cut(apart)
        outside = apart.where("comp != top")
        others = apart.select("key", *_others(), *[F.col(c).alias(f"other_{c}") for c in more])
        near = outside.join(others, "key").where("comp != other_comp").where(allowed)
        pairs = cut(_pairs(near).join(tested, ["a", "b"], "left_anti"))
        labels = merge(labels, cut(verify(pairs, sets, share, whole)))
    least = cut(
        heads.join(labels, "class", "left")
        .groupBy(F.coalesce("comp", "class").alias("comp")).agg(F.min("doc_id").alias("component_id"))
    )
    of_class = cut(
        heads.join(labels, "class", "left").select("class", F.coalesce("comp", "class").alias("comp"))
        .join(least, "comp").select("class", "component_id")
    )
    named = classes.join(of_class, "class").select("doc_id", "n_shingles", "component_id")
    return named.unionByName(
        index.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    )
