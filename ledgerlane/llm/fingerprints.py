"""Document fingerprints: MinHash signatures from universal hash permutations.

A text is its set of five-word shingles, each a 64-bit number. ``x -> a*x + b`` modulo 2**64 with
odd ``a`` is a permutation of those numbers; a signature keeps the least image under each of 128
permutations, folded to 16 bits, so two signatures agree in about the share of their Jaccard
similarity. ``near_duplicates`` joins signature bands in Spark and verifies the similarity on the
whole shingle sets.

Defined cases: a NULL text counts as empty; an empty text has the signature of all ones, and equals
only other empty texts; equal texts have equal fingerprints; ids may be NULL (ordered first) or
repeated (the text breaks the tie); extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlane.llm.common import (
    WordHashes,
    mix,
    shingle_hashes,
    shingle_set,
    small_batches,
    table,
    word_hashes,
)
from ledgerlane.llm.links import linked_classes, set_class

PERMUTATIONS = 128
BANDS = 32
LIKENESS = (3, 4)
"""Similarity of near duplicates, as a fraction."""

BLOCK = 1 << 17
"""Shingles hashed at a time; a block of them stays in the processor's cache."""

BLOCKS_PER_PARTITION = 4
PAIRS = 200
"""Documents whose signatures are computed together."""


def permutations(count: int = PERMUTATIONS) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * count + 1, dtype=np.uint64))
    return seeds[:count] | np.uint64(1), seeds[count:]


def signatures(
    sets: list[np.ndarray], count: int = PERMUTATIONS, kind: type = np.uint16
) -> np.ndarray:
    """One row of ``count`` numbers of 16 (or of a kind's) bits per shingle array; repeats do no harm."""
    factor, shift = permutations(count)
    least = np.full((len(sets), count), np.iinfo(np.uint64).max, dtype=np.uint64)

    def settle(rows: list[int], parts: list[np.ndarray]) -> None:
        values = np.concatenate(parts)
        starts = np.cumsum([0] + [len(p) for p in parts[:-1]])
        for k in range(count):
            images = values * factor[k]
            images += shift[k]
            least[rows, k] = np.minimum(least[rows, k], np.minimum.reduceat(images, starts))

    rows, parts, held = [], [], 0
    for row, values in enumerate(sets):
        for start in range(0, len(values), BLOCK):
            part = values[start : start + BLOCK]
            if held and (held + len(part) > BLOCK or rows[-1] == row):
                settle(rows, parts)
                rows, parts, held = [], [], 0
            rows.append(row)
            parts.append(part)
            held += len(part)
    if held:
        settle(rows, parts)
    out = (mix(least) >> np.uint64(64 - np.iinfo(kind).bits)).astype(kind)
    out[[len(s) == 0 for s in sets]] = np.iinfo(kind).max
    return out


def as_text(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last quarter of the text replaced by as many first code points of the next one."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def fingerprint_pairs(batch: pd.DataFrame, words: WordHashes) -> pd.DataFrame:
    """Rows of doc_id, text, following: the fingerprints and their likeness."""
    texts = [t or "" for t in batch["text"]]
    nexts = [t or "" for t in batch["following"]]
    changed = [edited(t, n) for t, n in zip(texts, nexts)]
    # A next text mostly is the following row's own text: hash each different text once.
    known = {t: i for i, t in enumerate(dict.fromkeys([*texts, *nexts, *changed]))}
    marks = signatures([shingle_hashes(word_hashes(t, words)) for t in known])
    own, other, new = (marks[[known[t] for t in group]] for group in (texts, nexts, changed))
    return pd.DataFrame(
        {
            "doc_id": batch["doc_id"].to_numpy(),
            "n_chars": [len(t) for t in texts],
            "edited_sha256": [
                hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed
            ],
            "fingerprint": [as_text(s) for s in own],
            "edited_fingerprint": [as_text(s) for s in new],
            "near_edited": (own == new).mean(axis=1),
            "near_next": (own == other).mean(axis=1),
        }
    )


def _block_udf(bounds: list[int]):
    limits = np.array(bounds, dtype=np.int64)

    @F.pandas_udf("int")
    def block(ids: pd.Series) -> pd.Series:
        place = np.searchsorted(limits, ids.fillna(0).to_numpy(dtype=np.int64), side="right")
        return pd.Series(np.where(ids.isna(), 0, place)).astype("int32")

    return block


def in_order(docs: DataFrame) -> DataFrame:
    """Rows of doc_id (as text), text, block and tail in ascending doc_id, for ``_follow``.

    Ids are cut into ranges of about equal counts. Each range is sorted in one task and gets the
    first row of the next range too (of the first one at the end), so a text is shuffled once and no
    task sees more than its ranges.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = BLOCKS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    steps = [i / blocks for i in range(1, blocks)]
    (cuts,) = docs.agg(F.percentile_approx("doc_id", steps, 10 * blocks)).first()
    block = _block_udf(sorted(set(cuts or [])))
    heads = (
        docs.select("doc_id")
        .withColumn("block", block("doc_id"))
        .groupBy("block")
        .agg(F.min("doc_id").alias("least"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("none"))
        .orderBy("block")
        .collect()  # one row per range
    )
    if not heads:
        return docs.select(F.col("doc_id").cast("string"), "text", F.lit(0).alias("block"), F.lit(True).alias("tail"))
    first = [None if r["none"] else r["least"] for r in heads]
    tails = spark.createDataFrame(
        [(first[(i + 1) % len(heads)], r["block"]) for i, r in enumerate(heads)],
        T.StructType([T.StructField("head", T.LongType()), T.StructField("block", T.IntegerType())]),
    )
    extra = docs.join(
        F.broadcast(tails), docs["doc_id"].eqNullSafe(tails["head"])
    ).select("doc_id", "text", "block", F.lit(True).alias("tail"))
    rows = docs.withColumn("block", block("doc_id")).withColumn("tail", F.lit(False))
    placed = (
        rows.select("doc_id", "text", "block", "tail")
        .unionByName(extra)
        .repartition(blocks // BLOCKS_PER_PARTITION, "block")
        .sortWithinPartitions("block", "tail", F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    )
    # Ids travel as text: pandas would turn whole numbers with gaps into floats.
    return placed.withColumn("doc_id", F.col("doc_id").cast("string"))


def _follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Give each row of a sorted range the text after it; a tail row only serves the row before."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pd.concat([held, batch], ignore_index=True)
        batch["following"] = batch["text"].shift(-1)
        same = batch["block"].shift(-1) == batch["block"]
        held = batch.iloc[[-1]][["doc_id", "text", "block", "tail"]]
        done = batch[same & ~batch["tail"].astype(bool)]
        yield done[["doc_id", "text", "following"]]


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of each text and of its edited text, and their likeness."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for batch in _follow(batches):
            for low in range(0, len(batch), PAIRS):
                yield fingerprint_pairs(batch.iloc[low : low + PAIRS], words)

    return in_order(docs).mapInPandas(
        run,
        "doc_id string, n_chars long, edited_sha256 string, fingerprint string,"
        " edited_fingerprint string, near_edited double, near_next double",
    ).withColumn("doc_id", F.col("doc_id").cast("long"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Documents with a class id: the least id that verified links reach.

    Documents that share a signature band are candidates; a link needs a Jaccard similarity of
    0.75 over the whole shingle sets. Documents without words are linked with nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for batch in batches:
            sets = [shingle_set(t, words) for t in batch["text"]]
            marks = signatures(sets).reshape(len(sets), BANDS, -1).astype(np.uint64)
            weights = mix(np.arange(1, marks.shape[2] + 1, dtype=np.uint64)) | np.uint64(1)
            keys = mix((marks * weights).sum(axis=2) + np.arange(BANDS, dtype=np.uint64))
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "n_shingles": [len(s) for s in sets],
                    "class": [set_class(s) for s in sets],
                    "keys": [
                        [{"key": int(x), "held": len(s)} for x in k.view(np.int64)] if len(s) else []
                        for k, s in zip(keys, sets)
                    ],
                }
            )

    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bands = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(
        run, "doc_id string, n_shingles long, class long, keys array<struct<key: long, held: long>>"
    ).withColumn("doc_id", F.col("doc_id").cast("long"))
    return linked_classes(docs, bands, *LIKENESS)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents."""
    return fingerprints(table(spark, sf_dir, "documents"))
