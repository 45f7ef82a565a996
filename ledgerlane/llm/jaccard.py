"""N-gram Jaccard join on token-combination prefixes.

The tokens of a document are its five-word shingles, ordered from rare to frequent. Two sets with
the similarity share more than m tokens in their prefixes when these are m tokens longer than the
usual prefix. Rare tokens of that extended prefix are index keys by themselves. Frequent ones are
dealt into m classes by their hash: if two documents share frequent tokens only, two of them fall
into one class, so pairs of frequent tokens of a class are the keys. A key also says how much two
documents can have in common by it: for a rare token as the first in common, what follows it; for
pairs, the frequent tokens. Candidates are verified on the whole sets (``links``).

How often a token occurs is counted over all documents. Tokens travel as packed arrays by hash
range, are counted there, and only tokens of two or more documents travel back.

Defined cases: a NULL text counts as empty; a document without words is linked with nothing; one
with fewer than five words is a single token of the whole sequence; repeated rows give one result
row each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.llm.common import WordHashes, mix, shingle_set, small_batches, table
from ledgerlane.llm.links import linked_classes, set_class, without_ids
from ledgerlane.operators.scale import cut

LIKENESS = (3, 4)
"""Links need this similarity or more, as a fraction."""

FREQUENT = 32
"""Tokens of more documents than this are indexed in pairs."""

CLASS_SHARE = 8
"""A set of 2**L to 2**(L+1) tokens deals frequent tokens into 2**L / CLASS_SHARE classes."""

BLOCK_TOKENS = 500_000
"""Tokens of one block of documents, which are sent and answered together."""

RANGE_BYTES = 8 << 20
"""Text bytes per hash range; bounds what one task counts."""

SKETCH_BITS = 9
"""A set's tokens mark the places of a sketch of 2**9 bits: a bound on what two sets share."""

_INDEX_BITS = 16
_TOKEN_BITS = 48


def _block(number: int, ids: list, sets: list[np.ndarray], ranges: int) -> pd.DataFrame:
    """Rows for the ranges, and one that names the documents of the block."""
    keys = np.concatenate(
        [((s >> np.uint64(_INDEX_BITS)) << np.uint64(_INDEX_BITS)) | np.uint64(i) for i, s in enumerate(sets)]
        or [np.empty(0, dtype=np.uint64)]
    )
    keys.sort()
    edges = [-(-r * (1 << _TOKEN_BITS) // ranges) << _INDEX_BITS for r in range(1, ranges)]
    cuts = [0, *np.searchsorted(keys, np.array(edges, dtype=np.uint64)), len(keys)]
    rows = [
        (r, number, False, keys[a:b].astype("<u8").tobytes(), b"")
        for r, (a, b) in enumerate(zip(cuts, cuts[1:]))
        if a < b
    ]
    names = [(int(x or 0), x is None, len(s), set_class(s)) for x, s in zip(ids, sets)]
    rows.append((number % ranges, number, True, np.array(names, dtype="<i8").tobytes(), b""))
    return pd.DataFrame(rows, columns=["range", "block", "names", "keys", "counts"])


def _scatter(ranges: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, number = WordHashes(), TaskContext.get().partitionId() << 32
        ids, sets, held = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                sets.append(shingle_set(text, known))
                ids.append(doc_id)
                held += len(sets[-1])
                if held >= BLOCK_TOKENS or len(sets) == 1 << _INDEX_BITS:
                    yield _block(number, ids, sets, ranges)
                    ids, sets, held, number = [], [], 0, number + 1
        if sets:
            yield _block(number, ids, sets, ranges)

    return run


def _count(rows: pd.DataFrame) -> pd.DataFrame:
    """Keep the tokens that occur more than once in a range, each with its count."""
    names = rows[rows["names"]]
    parts = rows[~rows["names"]]
    arrays = [np.frombuffer(p, dtype="<u8") for p in parts["keys"]]
    if not arrays:
        return names
    tokens = np.concatenate(arrays) >> np.uint64(_INDEX_BITS)
    _, place, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    counts = counts[place].astype("<u4")
    ends = np.cumsum([len(a) for a in arrays])
    kept_keys, kept_counts = [], []
    for array, own in zip(arrays, np.split(counts, ends[:-1])):
        more = own > 1
        kept_keys.append(array[more].tobytes())
        kept_counts.append(own[more].tobytes())
    answers = parts.assign(keys=kept_keys, counts=kept_counts)
    return pd.concat([names, answers[[len(k) > 0 for k in kept_keys]]], ignore_index=True)


def classes_of(level: int) -> int:
    return max(1, (1 << level) // CLASS_SHARE)


def index_keys(size: int, tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set of ``size`` tokens, given those of two or more documents, rare ones first; and
    for each the tokens that a partner found by it can have in common at most.

    Two documents agree on the classes of the larger one's level: each deals its tokens for its own
    level, and for the next one if a partner of that level can have the similarity.
    """
    share, whole = LIKENESS
    prefix = size - -(-share * size // whole) + 1
    single = size - len(tokens)  # these come first in the order, and no other document has them
    if single >= prefix:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    level = size.bit_length() - 1
    tokens = mix(tokens)
    often = counts > FREQUENT
    levels = [level] if size * whole < share * (2 << level) else [level, level + 1]
    reach = max(0, min(size, prefix + classes_of(levels[-1])) - single)
    keys = [tokens[:reach][~often[:reach]]]
    held = [size - single - np.arange(len(keys[0]))]
    frequent = int(often.sum())
    for at in levels if whole * frequent >= share * size else ():
        groups = classes_of(at)
        reach = max(0, min(size, prefix + groups) - single)
        chosen = np.sort(tokens[:reach][often[:reach]])
        dealt = chosen % np.uint64(groups)
        order = np.argsort(dealt, kind="stable")
        chosen, dealt = chosen[order], dealt[order]
        # Pairs at distance 1, 2, ... within runs of one class.
        step = 1
        while step < len(chosen):
            same = dealt[step:] == dealt[:-step]
            if not same.any():
                break
            first, second = chosen[:-step][same], chosen[step:][same]
            keys.append(mix(first * np.uint64(3) + mix(second + np.uint64(at))))
            held.append(np.full(len(first), frequent))
            step += 1
    return np.concatenate(keys).view(np.int64), np.concatenate(held)


def sketch(tokens: np.ndarray) -> list[int]:
    """The bits that tokens mark, as signed 64-bit words."""
    bits = np.zeros(1 << SKETCH_BITS, dtype=np.uint8)
    bits[mix(tokens) >> np.uint64(64 - SKETCH_BITS)] = 1
    return np.packbits(bits).view("<i8").tolist()


def _index(rows: pd.DataFrame) -> pd.DataFrame:
    named = rows["names"].to_numpy(dtype=bool)
    docs = np.frombuffer(rows["keys"][named].iloc[0], dtype="<i8").reshape(-1, 4)
    keys = np.frombuffer(b"".join(rows["keys"][~named]), dtype="<u8")
    counts = np.frombuffer(b"".join(rows["counts"][~named]), dtype="<u4")
    owner = (keys & np.uint64((1 << _INDEX_BITS) - 1)).astype(np.int64)
    tokens = keys >> np.uint64(_INDEX_BITS)
    order = np.lexsort((tokens, counts, owner))
    owner, tokens, counts = owner[order], tokens[order], counts[order]
    edges = np.searchsorted(owner, np.arange(len(docs) + 1))
    found = [
        [{"key": int(k), "held": int(h)} for k, h in zip(*index_keys(int(size), tokens[a:b], counts[a:b]))]
        if a < b
        else []
        for size, a, b in zip(docs[:, 2], edges, edges[1:])
    ]
    return pd.DataFrame(
        {
            "doc_id": [None if missing else str(x) for x, missing in docs[:, :2]],
            "n_shingles": docs[:, 2],
            "class": docs[:, 3],
            "shared": np.diff(edges),
            "bits": [sketch(tokens[a:b]) if found_ else None for found_, a, b in zip(found, edges, edges[1:])],
            "keys": found,
        }
    )


def prefix_index(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class and index keys of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    (size,) = docs.agg(F.sum(F.octet_length("text"))).first()
    ranges = max(
        2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // RANGE_BYTES)
    )
    packed = "range long, block long, names boolean, keys binary, counts binary"
    # Ids travel as text: pandas would turn whole numbers with gaps into floats.
    sent = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(_scatter(ranges), packed)
    counted = sent.groupBy("range").applyInPandas(_count, packed)
    return counted.groupBy("block").applyInPandas(
        _index,
        "doc_id string, n_shingles long, class long, shared long, bits array<long>,"
        " keys array<struct<key: long, held: long>>",
    ).withColumn("doc_id", F.col("doc_id").cast("long"))


def jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return linked_classes(docs, prefix_index(docs), *LIKENESS)


def first_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component: the one with the least id (a NULL id comes last).

    Rows are named by their place in a written table, so equal rows, repeated ids and NULL ids are
    told apart: of equal rows one stays, and a different text that shares the id of a copy stays too.
    """
    rows = cut(docs.select(F.monotonically_increasing_id().alias("doc_id"), F.struct(*docs.columns).alias("doc")))
    joined = jaccard_join(rows.select("doc_id", F.col("doc.text").alias("text")))
    ids = rows.select("doc_id", F.col("doc.doc_id").cast("long").alias("id"))
    first = F.min(F.struct(F.col("id").isNull(), "id", "doc_id"))["doc_id"]
    linked = cut(joined.join(ids, "doc_id"))
    firsts = linked.groupBy("component_id").agg(first.alias("first"))
    copies = linked.join(firsts, "component_id").where("doc_id <> first").select("doc_id")
    return without_ids(rows, copies).select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents."""
    return jaccard_join(table(spark, sf_dir, "documents"))


SQL = {
    "op6_jaccard": r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda w: w != '') AS w
    FROM documents
), sets AS (
    SELECT doc_id, CASE
        WHEN len(w) = 0 THEN []::VARCHAR[]
        WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3),
            lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
    FROM words
), tokens AS (
    SELECT doc_id, len(s) AS n, unnest(s) AS token FROM sets
), links AS (
    SELECT a.doc_id AS x, b.doc_id AS y
    FROM tokens a JOIN tokens b ON a.token = b.token AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n
    HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), edges AS (
    SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
    SELECT doc_id AS x, doc_id AS y FROM documents
    UNION
    SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x
)
SELECT s.doc_id, len(s.s) AS n_shingles, r.component_id
FROM sets s JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) r ON s.doc_id = r.x
""",
}
