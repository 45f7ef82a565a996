"""Quality: histogram gradient-boosted trees over document statistics.

Statistics of a text are binned by quantiles; each tree splits on sums of gradients per bin. Fitted
trees are complete, flattened into arrays, and a batch of documents walks them level by level in
numpy. The trees are fitted on at most about MAX_LABELLED labelled documents, drawn by a hash of
their id; scores cover all documents and whole texts.

Defined cases: a NULL text counts as empty; an empty text has zero statistics and gets a score like
any other; without usable labels every score is 0.5, with one kind of label it is near that label;
repeated rows give repeated results; labels with NULLs are not used; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.llm.common import WordHashes, fold, shared, small_batches, table, word_hashes

MAX_LABELLED = 60_000
"""Labelled documents that the trees are fitted on, about; beyond it they are drawn by hash."""

TREES, DEPTH, RATE, BINS = 60, 4, 0.2, 64
PENALTY, LEAST_LEAF = 1.0, 5.0
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2

_GROUPS = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "space": (9, 10, 11, 12, 13, 32),
    "stop": b".",
    "comma": b",",
    "shout": b"!?",
    "symbol": b"#$%&*+=@^_~\\",
    "bar": b"|/",
    "bracket": b"<>()[]{}",
    "control": [c for c in range(32) if c not in (9, 10, 11, 12, 13)],
    "high": range(128, 256),
}
_OF_GROUP = np.zeros((256, len(_GROUPS)))
for _k, _octets in enumerate(_GROUPS.values()):
    _OF_GROUP[list(_octets), _k] = 1.0

STATISTICS = (
    *_GROUPS, "log_bytes", "log_words", "word_bytes", "distinct_words", "distinct_pairs",
    "top_word", "log_lines", "distinct_lines", "line_words",
)


def statistics(text: str, known: WordHashes) -> np.ndarray:
    """Shares of character groups, sizes, and how much words, word pairs and lines repeat."""
    raw = text.encode("utf-8", "surrogatepass")
    size = max(1, len(raw))
    shares = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256) @ _OF_GROUP / size
    words = word_hashes(text, known)
    count = max(1, len(words))
    _, times = np.unique(words, return_counts=True)
    pairs = np.unique(words[:-1] * np.uint64(3) + words[1:])
    lines = [x for x in text.split("\n") if x]
    own = (
        np.log1p(len(raw)), np.log1p(len(words)), len(raw) / count, len(times) / count,
        len(pairs) / max(1, len(words) - 1), (times.max() if len(times) else 0) / count,
        np.log1p(len(lines)), len(set(lines)) / max(1, len(lines)), count / max(1, len(lines)),
    )
    return np.concatenate([shares, own]).astype(np.float32)


@dataclass
class Trees:
    """Flattened complete trees: node k has the children 2k + 1 and 2k + 2."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.base)
        every = np.arange(len(rows))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(rows), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (rows[every, feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-total))


def fit_trees(rows: np.ndarray, labels: np.ndarray) -> Trees:
    """Boosting with the logistic loss; splits from histograms of gradients over quantile bins."""
    inner, leaves = (1 << DEPTH) - 1, 1 << DEPTH
    if not len(rows):
        return Trees(0.0, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)))
    features = rows.shape[1]
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in rows.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, rows.T)], axis=1)
    share = np.clip(labels.mean(), 1e-4, 1 - 1e-4)
    base = float(np.log(share / (1 - share)))
    total = np.full(len(rows), base)
    found = Trees(base, np.zeros((TREES, inner), int), np.zeros((TREES, inner)), np.zeros((TREES, leaves)))
    for t in range(TREES):
        chance = 1 / (1 + np.exp(-total))
        slope, bend = chance - labels, chance * (1 - chance)
        node = np.zeros(len(rows), dtype=np.int64)
        for level in range(DEPTH):
            first, width = (1 << level) - 1, 1 << level
            best_gain, best = np.full(width, 1e-9), [(0, np.inf, BINS)] * width
            for f in range(features):
                cell = (node - first) * BINS + binned[:, f]
                g, h = (np.bincount(cell, w, width * BINS).reshape(width, BINS) for w in (slope, bend))
                n = np.bincount(cell, minlength=width * BINS).reshape(width, BINS)
                gl, hl, nl = (x.cumsum(axis=1)[:, :-1] for x in (g, h, n))
                gt, ht, nt = (x.sum(axis=1, keepdims=True) for x in (g, h, n))
                gain = gl**2 / (hl + PENALTY) + (gt - gl) ** 2 / (ht - hl + PENALTY) - gt**2 / (ht + PENALTY)
                gain[(nl < LEAST_LEAF) | (nt - nl < LEAST_LEAF)] = -1
                gain[:, len(edges[f]):] = -1
                at = gain.argmax(axis=1)
                for k in np.flatnonzero(gain.max(axis=1) > best_gain):
                    best_gain[k], best[k] = gain[k, at[k]], (f, edges[f][at[k]], at[k])
            for k, (f, limit, at) in enumerate(best):
                found.feature[t, first + k], found.threshold[t, first + k] = f, limit
            which, cut = np.array([b[0] for b in best]), np.array([b[2] for b in best])
            place = node - first
            node = 2 * node + 1 + (binned[np.arange(len(rows)), which[place]] > cut[place])
        leaf = node - inner
        g, h = np.bincount(leaf, slope, leaves), np.bincount(leaf, bend, leaves)
        found.leaf[t] = -RATE * g / (h + PENALTY)
        total += found.leaf[t][leaf]
    return found


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality") -> Trees:
    used = labels.where(F.col(column).isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT)).select(
        F.col("doc_id").cast("long").alias("label_id"), F.col(column).cast("int").alias("label")
    )
    share = min(1.0, MAX_LABELLED / max(1, used.count()))
    if share < 1:
        used = used.where(F.pmod(F.xxhash64("label_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        F.broadcast(used), F.col("doc_id") == F.col("label_id")  # bounded by MAX_LABELLED
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for batch in batches:
            rows = [statistics(t or "", known) for t in batch["text"]]
            if rows:
                packed = np.column_stack([np.stack(rows), batch["label"].to_numpy(np.float32)])
                yield pd.DataFrame({"rows": [packed.astype("<f4").tobytes()]})

    packed = joined.select("text", "label").mapInPandas(run, "rows binary").collect()
    matrix = np.frombuffer(b"".join(r["rows"] for r in packed), dtype="<f4")
    matrix = matrix.reshape(-1, len(STATISTICS) + 1)
    matrix = matrix[np.lexsort(matrix.T)]  # the same trees whatever order the rows came in
    return fit_trees(matrix[:, :-1], matrix[:, -1].astype(np.float64))


def score_documents(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, score and the statistics of every text."""
    small_batches(docs.sparkSession)
    get = shared(docs.sparkSession, trees)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for batch in batches:
            rows = np.array([statistics(t or "", known) for t in batch["text"]])
            rows = rows.reshape(len(batch), len(STATISTICS))
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"], "score": get().score(rows), "statistics": list(rows)}
            )

    # Ids travel as text: pandas would turn whole numbers with gaps into floats.
    return docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(
        run, "doc_id string, score double, statistics array<float>"
    ).withColumn("doc_id", F.col("doc_id").cast("long"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
