"""Scores against a plain bigram model over the whole small table."""

import math
import re
import zlib
from collections import Counter

import pytest

from ledgerlane.llm import language
from tests.llm.conftest import edge_rows, prose

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER)), None]


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def brute(rows):
    words, pairs, after = Counter(), Counter(), Counter()
    for doc_id, text in rows:
        if not held_out(doc_id):
            found = tokens(text)
            words.update(found)
            pairs.update(zip([None, *found], found))
    for first, _ in pairs:
        after[first] += 1
    total, known = sum(words.values()), len(words)
    out = []
    for doc_id, text in rows:
        found = tokens(text)
        own = [(words[w] + 1) / (total + known + 1) for w in found]
        score, state = 0.0, None
        for word, p in zip(found, own):
            if words[state]:
                arc = max(pairs[state, word] - language.DISCOUNT, 0) / words[state]
                p = arc + language.DISCOUNT * after[state] / words[state] * p
            score += math.log10(p)
            state = word
        out.append((doc_id, held_out(doc_id), len(found), sum(words[w] > 0 for w in found), total, sum(map(math.log10, own)), score))
    return out


def compare(got, want):
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=repr)
    want = sorted(want, key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize(("block", "hot"), [(800_000, 1 / 1000), (300, 1 / 50)])
def test_scores_equal_a_plain_model(documents, monkeypatch, block, hot):
    """With small blocks texts are cut into parts; with a low limit many states are dealt over ranges."""
    monkeypatch.setattr(language, "BLOCK_TOKENS", block)
    monkeypatch.setattr(language, "HOT_SHARE", hot)
    rows = [r if r[0] != 10 else (10, r[1][:20_000]) for r in edge_rows()] + [(40 + i, prose(i, 80)) for i in range(40)]
    compare(language.score_documents(documents(rows)).collect(), brute(rows))


def test_no_training_and_no_rows(documents):
    only = [(i, prose(i, 20)) for i in range(60) if held_out(i)]
    compare(language.score_documents(documents(only)).collect(), brute(only))
    assert language.score_documents(documents([])).collect() == []


def test_smallest_tables(documents, small):
    compare(language.score_documents(documents(small)).collect(), brute(small))
