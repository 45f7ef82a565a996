"""Order and edits against a plain walk; likeness against Jaccard."""

import hashlib

import numpy as np

from ledgerlane.llm import fingerprints
from ledgerlane.llm.common import shingle_hashes, shingle_set, word_hashes
from tests.llm.conftest import edge_rows, prose
from tests.llm.test_jaccard import brute, result


def test_rows_equal_a_plain_walk(documents):
    rows = [r for r in edge_rows()]
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want = []
    for (doc_id, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        text, after = text or "", after or ""
        changed = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        want.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest()))
    got = fingerprints.fingerprints(documents(rows)).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == sorted(want, key=repr)
    marks = {}
    for r in got:
        marks.setdefault(r.doc_id, set()).add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert marks[6] == marks[7] and marks[1] == marks[2] == marks[3] and marks[6] != marks[12]


def test_one_row_follows_itself_and_no_row_gives_none(documents):
    (row,) = fingerprints.fingerprints(documents([(3, prose(1, 30))])).collect()
    assert row.near_next == 1.0
    assert fingerprints.fingerprints(documents([])).collect() == []


def test_likeness_follows_jaccard():
    texts = [prose(1, 400), prose(1, 300) + " " + prose(2, 100), prose(3, 400)]
    marks = fingerprints.signatures([shingle_hashes(word_hashes(t)) for t in texts])
    sets = [set(shingle_set(t)) for t in texts]
    for i in range(3):
        for j in range(3):
            true = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            assert abs((marks[i] == marks[j]).mean() - true) < 0.15


def test_signatures_do_not_depend_on_the_batch():
    sets = [shingle_set(prose(i, 50 + 13 * i)) for i in range(12)] + [np.empty(0, np.uint64)]
    alone = np.concatenate([fingerprints.signatures([s]) for s in sets])
    assert (fingerprints.signatures(sets) == alone).all()
    block, fingerprints.BLOCK = fingerprints.BLOCK, 64
    assert (fingerprints.signatures(sets) == alone).all()
    fingerprints.BLOCK = block


def test_near_duplicates_are_verified(documents):
    rows = [(1, prose(1, 80)), (2, prose(1, 80)), (3, prose(1, 79) + " z"), (4, prose(4, 80)), (5, None), (6, prose(1, 40))]
    assert result(fingerprints.near_duplicates(documents(rows))) == brute(rows)
