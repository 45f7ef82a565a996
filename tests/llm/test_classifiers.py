"""Toxicity and quality: their parts against plain versions, and accuracy on held-out documents."""

import random

import numpy as np
import pytest

from ledgerlane.llm import quality, toxicity
from ledgerlane.llm.common import WordHashes
from tests.llm.conftest import edge_rows, prose


def plain_segments(scores):
    """Maximal segments by their definition: the best segment, then those of what is left and right."""
    if not len(scores):
        return []
    best, at = 0.0, None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best + 1e-9 or (at and abs(total - best) < 1e-9 and j - i < at[1] - at[0]):
                best, at = total, (i, j)
    if at is None:
        return []
    left, right = plain_segments(scores[: at[0]]), plain_segments(scores[at[1] + 1 :])
    return left + [(at[0], at[1], best)] + [(a + at[1] + 1, b + at[1] + 1, s) for a, b, s in right]


def test_segments_equal_their_definition():
    rng = random.Random(4)
    for _ in range(200):
        # Sums without ties, as the definition leaves those open.
        scores = [rng.choice([-toxicity.DRIFT, -toxicity.DRIFT, rng.uniform(0.1, 2), rng.uniform(-2, -0.3)]) for _ in range(rng.randrange(1, 25))]
        sparse = [(i, s) for i, s in enumerate(scores) if s != -toxicity.DRIFT]
        got, want = toxicity.segments(sparse), plain_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert [s for _, _, s in got] == pytest.approx([s for _, _, s in want])


def test_scan_is_linear():
    values = [(i, 1.0 if i % 2 else -1.1) for i in range(400_000)]
    assert len(toxicity.segments(values)) == 200_000


def corpus(spark, documents):
    """Every fourth document has insults; every seventh is shouted."""
    rng, rows, labels = random.Random(6), [], []
    for i in range(400):
        words = prose(i, 60).split()
        if i % 4 == 0:
            for _ in range(5):
                words[rng.randrange(60)] = rng.choice(["idiotic", "vermin", "filthy"])
        text = " ".join(words)
        if i % 7 == 0:
            text = " ".join(w.upper() + "!!" for w in words)
        rows.append((i, text))
        labels.append((i, int(i % 7 != 0), int(i % 4 == 0), "x"))
    labels += [(None, 1, 1, "x"), (5, None, None, "x"), (900, None, 1, "x")]
    return rows, documents(rows + edge_rows_after(1000)), spark.createDataFrame(
        labels, "doc_id long, quality int, toxic int, text string"
    )


def edge_rows_after(first):
    return [(None if i is None else first + i, t) for i, t in edge_rows()]


def test_toxic_documents_and_passages_are_found(spark, documents):
    rows, docs, labels = corpus(spark, documents)
    got = toxicity.judge(docs, labels).collect()
    assert len(got) == len(rows) + len(edge_rows())
    texts, wrong = dict(rows), 0
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        if r.doc_id is None or r.doc_id >= 1000:
            assert r.predicted == 0
            continue
        wrong += r.predicted != (r.doc_id % 4 == 0)
        for p in r.passages if r.predicted else ():
            assert any(w in texts[r.doc_id][p.start : p.end].lower() for w in ("idiotic", "vermin", "filthy"))
    assert wrong <= 8
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}


@pytest.mark.parametrize("module", [toxicity, quality])
def test_no_labels_and_no_documents(spark, documents, module):
    docs, none = documents(edge_rows()), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = module.fit(docs, none)
    scores = [r.score for r in module.score_documents(docs, model).collect()]
    assert len(scores) == len(edge_rows()) and all(0 <= s <= 1 for s in scores)
    one = spark.createDataFrame([(6, 1, 1), (8, 1, 1)], "doc_id long, quality int, toxic int")
    assert module.score_documents(docs, module.fit(docs, one)).count() == len(edge_rows())
    assert module.score_documents(documents([]), model).collect() == []


def test_quality_is_learned(spark, documents):
    rows, docs, labels = corpus(spark, documents)
    got = quality.score_documents(docs, quality.fit(docs, labels)).collect()
    assert len(got) == len(rows) + len(edge_rows())
    wrong = sum((r.score >= 0.7) != (r.doc_id % 7 != 0) for r in got if r.doc_id is not None and r.doc_id < 1000)
    assert wrong <= 4


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(500, 5)).astype(np.float32)
    labels = (rows[:, 0] + rows[:, 1] * rows[:, 2] > 0).astype(float)
    trees = quality.fit_trees(rows, labels)
    assert ((trees.score(rows) > 0.5) == labels.astype(bool)).mean() > 0.9
    for row, score in zip(rows[:50], trees.score(rows[:50])):
        total = trees.base
        for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += leaf[node - len(feature)]
        assert score == pytest.approx(1 / (1 + np.exp(-total)))


def test_statistics_of_odd_texts():
    for _, text in edge_rows():
        found = quality.statistics(text or "", WordHashes())
        assert found.shape == (len(quality.STATISTICS),) and np.isfinite(found).all()


def test_calibration_never_falls():
    levels = toxicity.calibrate([(0, 100, 1), (1, 10, 5), (2, 10, 2), (3, 10, 9)])
    assert [p for _, p in levels] == sorted(p for _, p in levels)
    assert (np.diff(toxicity.probability(np.linspace(-1, 5, 30), levels)) >= 0).all()
