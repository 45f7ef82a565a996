"""Language-model scoring with a weighted backoff automaton of smoothed word bigrams.

Every word with a successor in the training texts is a state. An arc from state u by word v weighs
the absolutely discounted, interpolated probability of v after u; a failure arc of weight
``gamma(u) = D * types(u) / count(u)`` leads to the root, whose arcs are the words' own
probabilities. A text is read once from left to right: the state carried along is the last word,
and each step adds the log10 weight of its arc, or of the failure arc and the root's arc. A block
of documents does so in numpy, as every step's arc is an index into the block's own arcs.

The model is never gathered in one place. Documents form blocks of about a million tokens; a block
sends its different bigrams with their training counts to ranges of the states, which add up the
counts over all blocks and send them back. So each block ends with exactly the part of the
automaton that its texts visit, and no other n-gram is moved. States that hold more than a small
share of all tokens (a bounded number) are dealt over several ranges by the next word.

Defined cases: a NULL text counts as empty; an empty text is its end alone; a document with a NULL
id is a training document; repeated rows count and are scored as often as they occur; very long
texts are scored in parts that know the word before; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.llm.common import WordHashes, fold, mix, small_batches, table
from ledgerlane.operators.scale import cut

FOLDS, HELD_OUT = 7, 2
DISCOUNT = 0.75
BLOCK_TOKENS = 800_000
RANGE_BYTES = 4 << 20
"""Text bytes per range of states."""

HOT_SHARE = 1 / 1000
"""States with a larger share of a block's tokens are hot candidates."""

END = np.uint64(0x454E444F46544558)
"""Stands for the end of a text, and before its first word."""

_EDGE = np.array([END], dtype=np.uint64)
_SALT = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Pieces:
    """Documents or parts of them: their words in one array."""

    words: np.ndarray  # hash of each word, and END after the last part of a text
    before: np.ndarray  # the word before, END at the start of a text
    owner: np.ndarray  # number of the part
    train: np.ndarray  # whether the word counts as training


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of documents as normal words: blanks between words, line feeds between parts."""
    number = TaskContext.get().partitionId() << 32
    press = zstandard.ZstdCompressor(level=1)
    rows, lines, held = [], [], 0

    def block() -> pd.DataFrame:
        columns = ["row", "doc_id", "held_out", "first", "last"]
        found = {c: [[r[k] for r in rows]] for k, c in enumerate(columns)}
        return pd.DataFrame({"block": [number], **found, "words": [press.compress(b"\n".join(lines))]})

    for batch in batches:
        for row, doc_id, out, text in zip(batch["row"], batch["doc_id"], batch["held_out"], batch["text"]):
            words = (text or "").encode("utf-8", "surrogatepass").lower().split()
            start = 0
            while True:
                end = min(len(words), start + BLOCK_TOKENS)
                # A later part begins with the word before it, which is not counted again.
                lines.append(b" ".join(words[max(0, start - 1) : end]))
                rows.append((row, doc_id, bool(out), start == 0, end == len(words)))
                held += end - start + 1
                if held >= BLOCK_TOKENS:
                    yield block()
                    rows, lines, held, number = [], [], 0, number + 1
                if end == len(words):
                    break
                start = end
    if rows:
        yield block()


BLOCK = (
    "block long, row array<long>, doc_id array<string>, held_out array<boolean>,"
    " first array<boolean>, last array<boolean>, words binary"
)


def unpack(packed: bytes, held_out, first, last, known: WordHashes) -> Pieces:
    lines = zstandard.ZstdDecompressor().decompress(packed).split(b"\n")
    words, before, owner, train = [], [], [], []
    for k, (line, out, begins, ends) in enumerate(zip(lines, held_out, first, last)):
        split = line.split(b" ") if line else []
        marks = np.fromiter(map(known.__getitem__, split), dtype=np.uint64, count=len(split))
        full = np.concatenate((_EDGE[: int(begins)], marks, _EDGE[: int(ends)]))
        words.append(full[1:])
        before.append(full[:-1])
        owner.append(np.full(len(full) - 1, k))
        train.append(np.full(len(full) - 1, not out))
    return Pieces(*(np.concatenate(x) for x in (words, before, owner, train)))


class Arcs:
    """The different bigrams of a block, by state key and next word, in the order of the exchange."""

    def __init__(self, pieces: Pieces, hot: dict[int, int]):
        self.vocabulary, place = np.unique(np.concatenate([pieces.words, pieces.before]), return_inverse=True)
        count = len(self.vocabulary)
        self.word, state = place[: len(pieces.words)], place[len(pieces.words) :]
        pairs, arc = np.unique(state * count + self.word, return_inverse=True)
        times = np.bincount(arc, pieces.train, len(pairs)).astype("<u4")
        self.state = state
        of, to = pairs // count, pairs % count
        mark = (mix(self.vocabulary) >> np.uint64(32)).astype("<u4")
        keys = self.vocabulary[of]
        # A hot state has several keys, told apart by the next word; the block asks for all of them.
        salts = np.array([hot.get(int(w), 1) for w in self.vocabulary], dtype=np.uint64)
        salted = salts[of] > 1
        salt = mark[to[salted]].astype(np.uint64) % salts[of[salted]]
        keys[salted] = mix(keys[salted] + _SALT * (salt + np.uint64(1)))
        asked, self.asked_word = [self.vocabulary[salts == 1]], [np.flatnonzero(salts == 1)]
        for k in np.flatnonzero(salts > 1):
            asked.append(mix(self.vocabulary[k] + _SALT * (np.arange(salts[k], dtype=np.uint64) + np.uint64(1))))
            self.asked_word.append(np.full(int(salts[k]), k))
        asked, words = np.concatenate(asked), np.concatenate(self.asked_word)
        order = np.argsort(asked, kind="stable")
        self.asked, self.asked_word = asked[order], words[order]
        order = np.lexsort((mark[to], keys))
        self.place = np.empty(len(order), dtype=np.int64)
        self.place[order] = np.arange(len(order))
        self.arc = self.place[arc]
        self.next, self.times = mark[to][order], times[order]
        self.begins = np.searchsorted(keys[order], self.asked)
        self.sizes = np.diff(np.append(self.begins, len(order))).astype("<u4")


def _edges(ranges: int) -> np.ndarray:
    return np.array([-(-(r << 64) // ranges) for r in range(1, ranges)], dtype=np.uint64)


def _send(hot: dict[int, int], ranges: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, limits = WordHashes(), _edges(ranges)
        for batch in batches:
            for b in batch.itertuples():
                arcs = Arcs(unpack(b.words, b.held_out, b.first, b.last, known), hot)
                cuts = [0, *np.searchsorted(arcs.asked, limits), len(arcs.asked)]
                ends = np.append(arcs.begins, len(arcs.next))
                rows = [
                    (r, b.block, arcs.asked[x:y].astype("<u8").tobytes(), arcs.sizes[x:y].tobytes(),
                     arcs.next[ends[x] : ends[y]].tobytes(), arcs.times[ends[x] : ends[y]].tobytes())
                    for r, (x, y) in enumerate(zip(cuts, cuts[1:])) if x < y
                ]
                yield pd.DataFrame(rows, columns=["range", "block", "states", "sizes", "next", "times"])

    return run


SENT = "range long, block long, states binary, sizes binary, next binary, times binary"
ANSWER = "block long, range long, counts binary, types binary, times binary"


def _add_up(rows: pd.DataFrame) -> pd.DataFrame:
    """Counts and types of the states of a range over all blocks, and counts of their arcs."""
    states, sizes, following, times = (
        [np.frombuffer(x, dtype=kind) for x in rows[c]]
        for c, kind in (("states", "<u8"), ("sizes", "<u4"), ("next", "<u4"), ("times", "<u4"))
    )
    known, place = np.unique(np.concatenate(states), return_inverse=True)
    arcs = np.concatenate(following).astype(np.int64)
    arcs |= np.repeat(place.astype(np.int64), np.concatenate(sizes)) << 32
    arcs, arc = np.unique(arcs, return_inverse=True)
    total = np.bincount(arc, np.concatenate(times), len(arcs)).astype("<i8")
    count = np.bincount(arcs >> 32, total, len(known)).astype("<i8")
    types = np.bincount(arcs >> 32, total > 0, len(known)).astype("<i8")
    out, a, b = [], 0, 0
    for block, at, s, f in zip(rows["block"], rows["range"], states, following):
        mine = place[a : a + len(s)]
        out.append((block, at, count[mine].tobytes(), types[mine].tobytes(), total[arc[b : b + len(f)]].tobytes()))
        a, b = a + len(s), b + len(f)
    return pd.DataFrame(out, columns=["block", "range", "counts", "types", "times"])


def log_weights(count: np.ndarray, types: np.ndarray, times: np.ndarray, own: np.ndarray) -> np.ndarray:
    """log10 weight of each step: by its arc where there is one, else by the failure arc and the root.

    ``count`` and ``types`` are the state's, ``times`` the arc's, ``own`` is the word's probability.
    """
    seen = count > 0
    safe = np.where(seen, count, 1)
    arc = np.maximum(times - DISCOUNT, 0) / safe
    fail = np.where(seen, DISCOUNT * types / safe, 1.0)
    return np.log10(arc + fail * own)


def _score(hot: dict[int, int], tokens: int, words: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        answers = rows[rows["words"].isna()].sort_values("range")
        (b,) = rows[~rows["words"].isna()].itertuples()
        pieces = unpack(b.words, b.held_out, b.first, b.last, WordHashes())
        arcs = Arcs(pieces, hot)
        counts, types, times = (
            np.frombuffer(b"".join(answers[c]), dtype="<i8") for c in ("counts", "types", "times")
        )
        size = len(arcs.vocabulary)
        count = np.bincount(arcs.asked_word, counts, size)
        kinds = np.bincount(arcs.asked_word, types, size)
        own = (count[arcs.word] + 1) / (tokens + words + 1)
        steps = log_weights(count[arcs.state], kinds[arcs.state], times[arcs.arc], own)
        parts = len(b.row)
        return pd.DataFrame(
            {
                "row": b.row, "doc_id": b.doc_id, "held_out": b.held_out,
                "n_tokens": np.bincount(pieces.owner, minlength=parts),
                "n_known": np.bincount(pieces.owner, count[arcs.word] > 0, parts).astype(np.int64),
                "base_score": np.bincount(pieces.owner, np.log10(own), parts),
                "score": np.bincount(pieces.owner, steps, parts),
            }
        )

    return run


def _often(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words above HOT_SHARE of a block with their counts, and the tokens of the block (word NULL)."""
    known = WordHashes()
    for batch in batches:
        for b in batch.itertuples():
            pieces = unpack(b.words, b.held_out, b.first, b.last, known)
            found, times = np.unique(pieces.before, return_counts=True)
            many = times > HOT_SHARE * len(pieces.words)
            names = [str(w) for w in found[many]]
            yield pd.DataFrame(
                [(None, len(pieces.words), int(pieces.train.sum())), *((w, int(t), 0) for w, t in zip(names, times[many]))],
                columns=["word", "times", "train"],
            )


def _train_words(ranges: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, limits = WordHashes(), _edges(ranges)
        for batch in batches:
            for b in batch.itertuples():
                pieces = unpack(b.words, b.held_out, b.first, b.last, known)
                words = np.unique(pieces.words[pieces.train])
                cuts = [0, *np.searchsorted(words, limits), len(words)]
                rows = [(r, words[x:y].astype("<u8").tobytes()) for r, (x, y) in enumerate(zip(cuts, cuts[1:])) if x < y]
                yield pd.DataFrame(rows, columns=["range", "words"])

    return run


def _different(rows: pd.DataFrame) -> pd.DataFrame:
    words = np.unique(np.frombuffer(b"".join(rows["words"]), dtype="<u8"))
    return pd.DataFrame({"words": [len(words)]})


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every text."""
    spark = docs.sparkSession
    small_batches(spark)
    held_out = F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    # Ids travel as text: pandas would turn whole numbers with gaps into floats.
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("string").alias("doc_id"),
        held_out.alias("held_out"), "text",
    )
    blocks = cut(rows.mapInPandas(_pack, BLOCK))
    (size,) = docs.agg(F.sum(F.octet_length("text"))).first()
    ranges = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // RANGE_BYTES))
    often = (
        blocks.mapInPandas(_often, "word string, times long, train long")
        .groupBy("word").agg(F.sum("times").alias("times"), F.sum("train").alias("train"))
    )
    often = often.persist()
    total = often.where("word IS NULL").first()
    tokens = total["train"] if total else 0
    # At most 2 / HOT_SHARE words can have half of HOT_SHARE of all tokens.
    least = HOT_SHARE / 2 * (total["times"] if total else 0)
    hot = {
        int(r["word"]): 1 + int(r["times"] / total["times"] * ranges)
        for r in often.where(F.col("word").isNotNull() & (F.col("times") > least)).collect()
    }
    often.unpersist()
    (words,) = (
        blocks.mapInPandas(_train_words(ranges), "range long, words binary")
        .groupBy("range").applyInPandas(_different, "words long").agg(F.sum("words")).first()
    )
    answers = (
        blocks.mapInPandas(_send(hot, ranges), SENT).groupBy("range").applyInPandas(_add_up, ANSWER)
    )
    both = answers.unionByName(blocks, allowMissingColumns=True)
    parts = both.groupBy("block").applyInPandas(
        _score(hot, tokens, words or 0),
        "row long, doc_id string, held_out boolean, n_tokens long, n_known long, base_score double, score double",
    )
    return (
        parts.groupBy("row")
        .agg(
            F.first("doc_id").cast("long").alias("doc_id"), F.first("held_out").alias("held_out"),
            *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")],
        )
        .drop("row").withColumn("train_tokens", F.lit(tokens).cast("long"))
    )


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    return score_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
