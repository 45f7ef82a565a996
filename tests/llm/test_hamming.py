import random

import numpy as np
import pytest

from ledgerlane.llm import hamming
from ledgerlane.llm.common import shingle_set
from tests.llm.conftest import edge_rows, prose


def plain(rows):
    """component_id and n_shingles of each row, by comparing all pairs of texts."""
    sets = [set(shingle_set(t, None, 4).tolist()) for _, t in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                comp[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return sorted(
        (str(d), len(s), str(least.get(root(i), d) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets))
    )


def found(docs):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in docs.collect())


def edited(text, share, seed):
    rng = random.Random(seed)
    return " ".join(f"w{rng.random()}" if rng.random() < share else w for w in text.split())


def test_groups_equal_a_comparison_of_all_pairs(spark, documents):
    rows = edge_rows()
    passage = prose(50, 70)
    # Copies about the limit, whose links form chains, and texts that share a long passage only.
    rows += [(100 + i, edited(prose(5, 120), 0.002 * (i % 15), i)) for i in range(60)]
    rows += [(300 + i, passage + " " + prose(400 + i, 12 + i)) for i in range(40)]
    rows += [(500 + i, prose(9, 80 + i)) for i in range(30)]
    result = hamming.near_duplicates(documents(rows))
    assert found(result) == plain(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in result.collect() if r.doc_id is not None)


def test_empty_table(spark, documents):
    assert hamming.near_duplicates(documents([])).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_signatures_within_the_distance_share_enough_chunks(seed):
    rng = np.random.default_rng(seed)
    one = rng.integers(0, 1 << 32, size=(1, 128), dtype=np.uint32)
    two = one.copy()
    changed = rng.choice(128, size=hamming.APART, replace=False)
    # The worst cases put errors where they spoil most chunks.
    if seed % 2:
        edges = np.linspace(0, 128, hamming.CHUNKS + 1).astype(int)
        changed = np.concatenate([[e, e + 1] for e in edges[:-1]])[: hamming.APART]
    two[0, changed] += 1
    (a, without_a), (b, without_b) = hamming.chunk_keys(one), hamming.chunk_keys(two)
    met = (a == b) & ((without_a == 0) | (without_a != without_b))
    assert met.sum() >= hamming.AGREEING


def test_each_agreeing_chunk_counts_once():
    marks = np.arange(256, dtype=np.uint32).reshape(2, 128)
    marks[1] = marks[0]
    keys, without = hamming.chunk_keys(marks)
    assert ((keys[0] == keys[1]) & ((without[0] == 0) | (without[0] != without[1]))).sum() == hamming.CHUNKS


def test_texts_just_below_the_similarity_hand_on_few_pairs(spark, documents, monkeypatch):
    # Each text differs from the common one in four words of its own, so any two lie a little below the limit.
    rng, base, rows = random.Random(3), prose(5, 160).split(), []
    for i in range(150):
        words = list(base)
        for place in rng.sample(range(4, 156), 4):
            words[place] = f"w{i}x{place}"
        rows.append((i, " ".join(words)))
    handed, near = [], hamming.near

    def counted(pairs, classes):
        handed.append(pairs.count())
        return near(pairs, classes)

    monkeypatch.setattr(hamming, "near", counted)
    assert found(hamming.near_duplicates(documents(rows))) == plain(rows)
    assert handed[-1] <= 4 * len(rows)
