"""Toxicity: maximum-scoring segments of token log-odds, calibrated by extreme-value statistics.

Each word, and each beginning of a word, has a lower confidence bound of its log-odds between toxic
and clean labelled documents, in which it is counted once, under an informative Dirichlet prior. A token scores the highest bound
of its word and beginnings, less a drift. One linear scan over a text finds all maximal scoring
segments. A segment of score S in a text of n tokens has the expectation
``K * n * exp(-lambda * S)`` in clean text; lambda solves the usual moment equation, K is fitted to
clean documents. Significant segments of a document add up to its evidence. The evidence of labelled
documents, each judged by a lexicon that it did not shape, gives a probability that never falls with it.

The lexicon has 2**20 hashed token slots, so the model is bounded whatever the input. It is fitted
on labelled documents: at most about MAX_LABELLED of them, drawn by a hash of their id. Everything
else covers all documents and whole texts.

Defined cases: a NULL text counts as empty; an empty text has no evidence and gets the probability
of that; without usable labels nothing is toxic; repeated rows give repeated results; labels with
NULLs are not used; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.llm.common import fold, shared, small_batches, table
from ledgerlane.operators.scale import cut

SLOTS = 1 << 20
PRIOR_SHARE = 0.1
"""Weight of the prior, as a share of the labelled tokens and spread as they are."""

CONFIDENCE = 2.0
"""Standard errors by which a log-odds must differ from zero."""

PREFIXES = (4, 5, 6, 7)
"""Lengths of word beginnings that are counted besides whole words."""

DRIFT = 0.25
"""Subtracted from every token's score, so that clean text scores below zero on average."""

MAX_LABELLED = 200_000
"""Labelled documents that the lexicon is fitted on, about; beyond it they are drawn by hash."""

EXPECTED = 0.5
"""Segments with an expectation below this in clean text are significant."""

THRESHOLD = 0.3
BIN = 0.5
BINS = 160
FOLDS, HELD_OUT = 4, 2
SLICE = 1 << 20

_TOKEN = re.compile(r"\w+")
_GAP = re.compile(r"\W")


@dataclass
class Model:
    scores: dict[int, float]
    """Token slot to score, for tokens whose log-odds differ from zero; others score -DRIFT."""
    lam: float
    k: float
    levels: list[tuple[float, float]]
    """(evidence, probability), ascending in both."""


def slot(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) & (SLOTS - 1)


def features(token: str) -> list[int]:
    """Slots of a word and of its beginnings."""
    return [slot(token), *[slot("^" + token[:n]) for n in PREFIXES if len(token) > n]]


def slices(text: str) -> Iterator[tuple[int, str]]:
    """(start, part): a long text in parts that end between tokens."""
    start = 0
    while start < len(text):
        gap = _GAP.search(text, start + SLICE) if len(text) > start + SLICE else None
        end = gap.start() if gap else len(text)
        yield start, text[start:end]
        start = end


class Slots(dict):
    """Token to score, filled as tokens are met."""

    def __init__(self, scores: dict[int, float]):
        super().__init__()
        self.scores = scores

    def __missing__(self, token: str) -> float:
        if len(self) >= 300_000:
            self.clear()
        found = max(self.scores.get(f, -DRIFT) for f in features(token))
        if len(token) <= 64:
            self[token] = found
        return found


def segments(values: list[tuple[int, float]]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score) in linear time.

    ``values`` are the tokens that do not score -DRIFT, as (token number, score) in order.
    """
    open_: list[tuple[float, float, int, int, int]] = []  # sum before, at the end, first, last, lower
    total, last = 0.0, -1
    for number, value in values:
        total -= DRIFT * (number - last - 1)
        last = number
        left, first = total, number
        total += value
        if value <= 0:
            continue
        while True:
            # The last segment that starts at a lower sum; each one remembers its own.
            lower = len(open_) - 1
            while lower >= 0 and open_[lower][0] >= left:
                lower = open_[lower][4]
            if lower < 0 or open_[lower][1] >= total:
                open_.append((left, total, first, number, lower))
                break
            left, _, first, _, _ = open_[lower]
            del open_[lower:]
    return [(first, end, right - left) for left, right, first, end, _ in open_]


def token_scores(text: str, known: Slots) -> tuple[int, list[tuple[int, float]]]:
    """Number of tokens, and those that do not score -DRIFT; empty if none is positive."""
    count, values, positive = 0, [], False
    for _, part in slices(text):
        found = list(map(known.__getitem__, _TOKEN.findall(part.lower())))
        scores = np.array(found)
        for k in np.flatnonzero(scores != -DRIFT):
            values.append((count + int(k), found[k]))
            positive = positive or found[k] > 0
        count += len(found)
    return count, values if positive else []


def passages(text: str, model: Model, known: Slots) -> tuple[int, float, list[tuple[int, int, float]]]:
    """Tokens, evidence, and the significant segments as (start, end, score) in characters."""
    count, values = token_scores(text, known)
    found, evidence = [], 0.0
    best = 0.0
    for first, last, score in segments(values):
        log_expected = math.log(model.k * max(count, 1)) - model.lam * score
        best = max(best, model.lam * score)
        if log_expected < math.log(EXPECTED):
            evidence += math.log(EXPECTED) - log_expected
            found.append((first, last, score))
    return count, evidence if found else min(0.0, best - 40.0) if best else -40.0, _spans(text, found)


def _spans(text: str, found: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    if not found:
        return []
    wanted = {t for first, last, _ in found for t in (first, last)}
    at, number = {}, 0
    for start, part in slices(text):
        for m in _TOKEN.finditer(part.lower()):
            if number in wanted:
                at[number] = (start + m.start(), start + m.end())
            number += 1
    return [(at[first][0], at[last][1], score) for first, last, score in found]


def usable(labels: DataFrame, column: str) -> DataFrame:
    """doc_id and label of labelled rows outside the held-out fold, about MAX_LABELLED at most."""
    rows = labels.where(F.col(column).isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT))
    rows = rows.select(
        F.col("doc_id").cast("long").alias("label_id"), F.col(column).cast("int").alias("label"),
        fold("doc_id", FOLDS).cast("int").alias("fold"),
    )
    share = min(1.0, MAX_LABELLED / max(1, rows.count()))
    if share < 1:
        rows = rows.where(F.pmod(F.xxhash64("label_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    return rows


def _count_tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    totals = np.zeros((2, SLOTS), dtype=np.int64)
    for batch in batches:
        for label in (0, 1):
            tokens: Counter[str] = Counter()
            for text in batch["text"][batch["label"] == label]:
                # Once per document: a text that repeats a word is no more evidence about it.
                tokens.update({t for _, part in slices(text or "") for t in _TOKEN.findall(part.lower())})
            if tokens:
                slots = [features(t) for t in tokens]
                times = np.repeat(list(tokens.values()), [len(f) for f in slots])
                np.add.at(totals[label], [k for f in slots for k in f], times)
    used = np.flatnonzero(totals.any(axis=0))
    yield pd.DataFrame({"slot": used, "clean": totals[0][used], "toxic": totals[1][used]})


def lexicon(rows: DataFrame) -> dict[int, float]:
    """Scores of the slots whose log-odds differ from zero."""
    counts = (
        rows.mapInPandas(_count_tokens, "slot long, clean long, toxic long")
        .groupBy("slot").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    )
    counts = counts.persist()
    clean, toxic = counts.agg(F.sum("clean"), F.sum("toxic")).first()
    if not clean or not toxic:
        counts.unpersist()
        return {}
    prior = PRIOR_SHARE * (F.col("clean") + F.col("toxic"))
    whole = PRIOR_SHARE * (clean + toxic)

    def odds(name: str, total: int):
        mine = F.col(name) + prior
        return F.log(mine / (total + whole - mine))

    delta = odds("toxic", toxic) - odds("clean", clean)
    error = F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior))
    bound = F.signum(delta) * F.greatest(F.lit(0.0), F.abs(delta) - CONFIDENCE * error)
    kept = (
        counts.select("slot", (bound - DRIFT).alias("score"))
        .where(F.abs(F.col("score") + DRIFT) > DRIFT)
        .collect()  # at most one row per slot
    )
    counts.unpersist()
    return {r["slot"]: r["score"] for r in kept}


def decay(weights: list[tuple[float, float]]) -> float:
    """lambda with a mean of exp(lambda * score) of 1, from (score, tokens) of clean documents."""
    total = sum(n for _, n in weights)
    if not total or max(x for x, _ in weights) <= 0:
        return 1.0
    scores = np.array([x for x, _ in weights])
    share = np.array([n for _, n in weights]) / total
    low, high = 1e-3, 100.0 / max(scores.max(), 1.0)
    for _ in range(80):
        middle = (low + high) / 2
        below = float((share * np.exp(middle * scores)).sum()) < 1
        low, high = (middle, high) if below else (low, middle)
    return low


def _best(model: Model):
    """Tokens and highest segment of each document, and how often it has each score, to a twentieth."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Slots(model.scores)
        for batch in batches:
            out = []
            for text, label in zip(batch["text"], batch["label"]):
                count, values = token_scores(text or "", known)
                best = max((s for _, _, s in segments(values)), default=0.0)
                times = Counter(round(20 * s) for _, s in values)
                times[round(-20 * DRIFT)] += count - len(values)
                out.append((label, count, best, [{"score": k / 20, "times": n} for k, n in times.items()]))
            yield pd.DataFrame(out, columns=["label", "tokens", "best", "scores"])

    return run


def _evidence(model: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Slots(model.scores)
        for batch in batches:
            found = [passages(t or "", model, known)[1] for t in batch["text"]]
            yield pd.DataFrame({"label": batch["label"], "evidence": found})

    return run


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic") -> Model:
    """Learn the lexicon from all labelled documents; segment statistics and calibration by thirds.

    Each third is judged by a lexicon that the other two made, so what a document shaped does not
    judge it.
    """
    used = usable(labels, column)
    # Written once: what follows reads the labelled documents alone, not all documents each time.
    joined = cut(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .join(F.broadcast(used), F.col("doc_id") == F.col("label_id"))  # bounded by MAX_LABELLED
        .select("text", "label", "fold")
    )
    model = Model(lexicon(joined), 1.0, 1.0, [])
    thirds = [k for k in range(FOLDS) if k != HELD_OUT]
    others = {k: Model(lexicon(joined.where(F.col("fold") != k)), 1.0, 1.0, []) for k in thirds}

    def judged(function, columns: str) -> DataFrame:
        parts = [
            joined.where(F.col("fold") == k).mapInPandas(function(other), columns) for k, other in others.items()
        ]
        return reduce(DataFrame.unionByName, parts)

    found = "label int, tokens long, best double, scores array<struct<score: double, times: long>>"
    clean = cut(judged(_best, found).where("label = 0"))
    scores = clean.select(F.explode("scores").alias("s")).groupBy("s.score").agg(F.sum("s.times").alias("times"))
    model.lam = decay([(r["score"], r["times"]) for r in scores.collect()])  # a row per score
    chance = F.col("tokens") * F.exp(-model.lam * F.col("best"))
    hits, total = clean.agg(F.count(F.when(F.col("best") > 0, 1)), F.sum(chance)).first()
    model.k = max(0.5, hits or 0) / max(total or 1.0, 1.0)
    for other in others.values():
        other.lam, other.k = model.lam, model.k
    found = (
        judged(_evidence, "label int, evidence double")
        .groupBy(F.least(F.lit(BINS), F.floor(F.col("evidence") / BIN)).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("toxic"))
        .orderBy("bin").collect()  # a row per bin
    )
    model.levels = calibrate([((r["bin"] + 0.5) * BIN, r["n"], r["toxic"]) for r in found])
    return model


def calibrate(bins: list[tuple[float, int, int]]) -> list[tuple[float, float]]:
    """Probability by evidence: pooled so that it never falls, smoothed by half a document each way."""
    pooled: list[list[float]] = []  # evidence weight, documents, toxic
    for at, count, toxic in bins:
        pooled.append([at * count, count, toxic])
        while len(pooled) > 1 and pooled[-2][2] * pooled[-1][1] >= pooled[-1][2] * pooled[-2][1]:
            upper = pooled.pop()
            pooled[-1] = [a + b for a, b in zip(pooled[-1], upper)]
    return [(w / n, (t + 0.25) / (n + 0.5) if t else 0.25 / (n + 0.5)) for w, n, t in pooled]


def probability(evidence: np.ndarray, levels: list[tuple[float, float]]) -> np.ndarray:
    if not levels:
        return np.zeros(len(evidence))
    x, y = zip(*levels)
    low = np.interp(evidence, x, np.maximum.accumulate(y))
    return np.clip(low, 0.0, 1.0)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, tokens and the toxic passages (start, end, score) of every text."""
    small_batches(docs.sparkSession)
    get = shared(docs.sparkSession, model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = get()
        known = Slots(held.scores)
        for batch in batches:
            found = [passages(t or "", held, known) for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "score": probability(np.array([f[1] for f in found]), held.levels),
                    "tokens": [f[0] for f in found],
                    "passages": [
                        [{"start": a, "end": b, "score": s} for a, b, s in f[2]] for f in found
                    ],
                }
            )

    # Ids travel as text: pandas would turn whole numbers with gaps into floats.
    return docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(
        run,
        "doc_id string, score double, tokens long,"
        " passages array<struct<start: long, end: long, score: double>>",
    ).withColumn("doc_id", F.col("doc_id").cast("long"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score, passages and ``predicted`` (1 from THRESHOLD on) of every document."""
    model = fit(docs, labels)
    return score_documents(docs, model).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted to be toxic, with all their columns."""
    model = fit(docs, labels)
    small_batches(docs.sparkSession)
    columns, get = docs.columns, shared(docs.sparkSession, model)

    @F.pandas_udf("double")
    def toxic(texts: pd.Series) -> pd.Series:
        held = get()
        known = Slots(held.scores)
        evidence = np.array([passages(t or "", held, known)[1] for t in texts])
        return pd.Series(probability(evidence, held.levels))

    return docs.where(toxic("text") < THRESHOLD).select(*columns)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id",
        F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        "predicted",
        F.size("passages").cast("long").alias("n_passages"),
    )
