import math
import random
import re
from collections import Counter

import numpy as np

from ledgerlane.llm import search
from tests.llm.conftest import edge_rows, prose

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(rows, items, top):
    docs = [(d, Counter(terms(t))) for d, t in rows]
    docs = [(d, c) for d, c in docs if c]
    total, words = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in docs:
            m = 75 + (25 * sum(c.values()) * total) // words
            score = sum(
                math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
                for t in terms(text)
                if t in c
            )
            if score > 0:
                scores.append((-score, d is None, d or 0))
        for rank, (score, none, d) in enumerate(sorted(scores)[:top], 1):
            out.append((item, rank, None if none else d, -score))
    return sorted(out, key=str)


def ranked(spark, docs, items, top=20):
    table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id string, text string, doc_id string")
    return sorted([tuple(r) for r in search.search(docs, table, top).collect()], key=str)


def test_ranks_equal_scoring_every_document(spark, documents, monkeypatch):
    rng = random.Random(3)
    rows = edge_rows() + [(20 + i, prose(i, rng.randint(1, 80)) + " A-b, É9" * (i % 3)) for i in range(300)]
    items = [("a", prose(5, 30)), ("b", prose(77, 25) + " É9 é9 a"), ("c", "absent"), ("d", ""), ("e", "one One ONE")]
    items += [("f", prose(6, 60)), ("f2", rows[30][1])]
    assert ranked(spark, documents(rows), items) == plain(rows, items, 20)
    assert ranked(spark, documents(rows), items, 3) == plain(rows, items, 3)


def test_many_blocks_and_groups_of_queries_change_nothing(spark, documents, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_DOCS", 16)
    monkeypatch.setattr(search, "GROUP_BYTES", 300)
    rows = [(i, prose(i % 50, 10 + i % 37)) for i in range(200)]
    items = [(str(i), prose(1000 + i, 20)) for i in range(8)]
    assert ranked(spark, documents(rows), items) == plain(rows, items, 20)


def test_empty_tables(spark, documents):
    assert ranked(spark, documents([]), [("a", "one")]) == []
    assert ranked(spark, documents([(1, "one")]), []) == []


def test_null_and_repeated_items(spark, documents):
    rows = [(1, "one two"), (2, "two three"), (2, "two three"), (3, None)]
    assert ranked(spark, documents(rows), [("a", None), ("b", "three"), ("b", "three")]) == plain(rows, [("b", "three")], 20)


def test_bounds_skip_documents_but_never_one_of_the_best():
    """A block's answer is the same with any threshold below the true one, and pairs that never meet
    bound a document by the larger of both terms."""
    rng = np.random.default_rng(5)
    queries = search.Queries.of(["a b c d e f"])
    size = 2000
    held = {t: np.sort(rng.choice(size, size=rng.integers(20, 900), replace=False)) for t in range(6)}
    held[1] = np.setdiff1d(held[1], held[0])
    queries.weigh({t: len(d) for t, d in held.items()}, size)
    edges = np.cumsum([0] + [len(held[t]) for t in range(6)])
    owners = np.concatenate([held[t] for t in range(6)])
    impacts = rng.integers(1, 1_000_000, size=len(owners))
    block = search.Block([str(i) for i in range(size)], edges, owners, impacts)
    lists, best = zip(*[block.meet(*p, queries.weights) for p in queries.pairs])
    block.pair_edges = np.cumsum([0] + [len(x) for x in lists])
    block.pair_owners, block.pair_best = np.concatenate(lists), np.array(best)
    every = np.zeros(size, dtype=np.int64)
    for t in range(6):
        docs, gain = block.postings(t)
        every[docs] += queries.weights[t] * gain
    want = np.sort(every)[-20:]
    for least in (0, int(want[0] // 2), int(want[0])):
        docs, scores = search.best_of(block, queries.plans[0], queries, least, 20)
        assert (every[docs] == scores).all() and np.array_equal(np.sort(scores)[-20:], want)
        assert len(docs) < (every > 0).sum()
