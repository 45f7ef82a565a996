"""Components against all pairs of a small table."""

import re

import pytest

from ledgerlane.llm import jaccard, links
from ledgerlane.llm.common import shingle_hashes, word_hashes
from tests.llm.conftest import edge_rows, prose

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
    if not words:
        return frozenset()
    size = min(5, len(words))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 75 * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for (doc_id, _), g in zip(rows, group):
        if doc_id is not None:
            least[g] = min(least.get(g, doc_id), doc_id)
    return sorted(
        ((i, len(s), least.get(g) if s else i) for (i, _), s, g in zip(rows, sets, group)), key=repr
    )


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def near_copies(count, words, edits):
    """Copies of one text, each with some words changed: chains, links at the limit and misses."""
    import random

    rng, base, rows = random.Random(5), prose(11, words).split(), []
    for i in range(count):
        text = list(base)
        for _ in range(rng.randrange(edits)):
            text[rng.randrange(words)] = f"w{rng.randrange(50)}"
        rows.append((1000 + i, " ".join(text)))
    return rows


def test_edge_cases_equal_all_pairs(documents):
    rows = edge_rows()
    assert result(jaccard.jaccard_join(documents(rows))) == brute(rows)


@pytest.mark.parametrize("frequent", [2, 32])
def test_near_copies_equal_all_pairs(documents, monkeypatch, frequent):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    rows = near_copies(60, 60, 8) + near_copies(0, 1, 1) + [(i, prose(i, 40)) for i in range(20)]
    rows += [(2000 + i, prose(99, 30) + " " + prose(i, 6 + i)) for i in range(20)]
    assert result(jaccard.jaccard_join(documents(rows))) == brute(rows)


def test_keys_alone_lose_no_pair():
    """Any two sets with the similarity share a key that allows it, whatever is frequent."""
    import random

    import numpy as np

    rng = random.Random(3)
    for frequent in (0, 3, 1000):
        for _ in range(150):
            size = rng.randrange(2, 200)
            base = rng.sample(range(1, 2000), size)
            other = [x for x in base if rng.random() > 0.12] + rng.sample(range(3000, 4000), rng.randrange(1 + size // 12))
            count = {x: (x * 7919) % 60 + 2 for x in [*base, *other]}
            common = len(set(base) & set(other))
            if 4 * common < 3 * len(set(base) | set(other)):
                continue
            keys = []
            for tokens in (base, other):
                ordered = sorted(set(tokens), key=lambda x: (count[x], x))
                jaccard.FREQUENT, kept = frequent, jaccard.FREQUENT
                found = jaccard.index_keys(len(ordered), np.array(ordered, np.uint64), np.array([count[x] for x in ordered]))
                keys.append(dict(zip(*[x.tolist() for x in found])))
                jaccard.FREQUENT = kept
            shared = keys[0].keys() & keys[1].keys()
            assert max(min(keys[0][k], keys[1][k]) for k in shared) >= common


def test_empty_table(documents):
    assert result(jaccard.jaccard_join(documents([]))) == []


def test_first_of_each_keeps_columns_and_clean_documents(documents):
    rows = [(1, prose(1, 50)), (2, prose(1, 50)), (3, prose(2, 50)), (4, None), (5, ""), (None, "x y")]
    kept = jaccard.first_of_each(documents(rows))
    assert kept.columns == documents([]).columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == ["1", "3", "4", "5", "None"]


def test_documents_caught_by_chance_come_back(documents, monkeypatch):
    monkeypatch.setattr(links, "FILTER_BITS", (6, 6))  # catches nearly everything
    rows = [(i, "x") for i in range(80)]
    kept = links.without_ids(documents(rows), documents(rows[::3]).select("doc_id"))
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(80) if i % 3]


def test_words_are_split_and_lowered_in_ascii_only():
    assert len(word_hashes("a\x85b c d\x0be\x1cf")) == 3
    assert list(word_hashes("ÀB c")) == list(word_hashes("Àb C"))
    assert list(word_hashes("ÀB")) != list(word_hashes("àb"))
    assert len(shingle_hashes(word_hashes("a b c d e f"))) == 2


def test_merge_follows_chains(spark):
    labels = spark.createDataFrame([(i, i) for i in range(12)], "class long, comp long")
    chain = spark.createDataFrame([(i, i + 1) for i in range(8)] + [(9, 10)], "a long, b long")
    found = dict(links.merge(labels, chain).collect())
    assert found == {**{i: 0 for i in range(9)}, 9: 9, 10: 9, 11: 11}
