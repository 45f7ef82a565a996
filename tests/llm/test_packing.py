"""Pieces put together again give the ids that the tokenizer gives to whole texts."""

import zlib

import numpy as np
import pytest

from ledgerlane.llm import packing
from tests.llm.conftest import edge_rows, prose

tokenizers = pytest.importorskip("tokenizers")
PATH = packing.default_tokenizer()


def plain_ids(texts):
    tokenizer = tokenizers.Tokenizer.from_file(PATH)
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END] for t in texts]


ODD = [
    "It's DON'T we'll x'y ''s '' 'tis a.b,c!! 12 3ab4", "Straße ÀÉ ñandú çã × ÷ ß ÿ İstanbul ΑΣ ﬁ", "tab\there\r\nline\x0bfeed",
    "<|endoftext|> <|startoftext|>x a<|endoftext|>b", "漢字 かな 한국어 ​ zero é ́start", "   \n\n  ", "a" * 3000,
    "\x1c\x85\xa0 blanks wide", "\U0001f600 emoji\U0001f600\U0001f600 \x00 nul", "e-mail a@b.c +49 (0)30 1.2.3.4 | $$$ &&&",
]


def test_ids_equal_the_tokenizer(small):
    texts = ODD + [t for _, t in small[:150]]
    encoder = packing.Encoder(PATH)
    for got, want in zip(encoder.texts([t or "" for t in texts]), plain_ids(texts)):
        assert np.frombuffer(got, "<u2").tolist() == want[:-1]


def check(rows, pieces, window):
    want = {}
    for (doc_id, _), ids in zip(rows, plain_ids([t for _, t in rows])):
        want.setdefault(doc_id, []).append(ids)
    got, sequences = {}, {}
    for p in pieces:
        ids = np.frombuffer(bytes(p.ids), "<u4").tolist()
        assert len(ids) == p.length > 0
        got.setdefault(p.doc_id, []).append((p.start, p.doc_tokens, ids))
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert set(got) == set(want)
    for doc_id, texts in want.items():
        if len(texts) == 1:
            ids = []
            for start, tokens, part in sorted(got[doc_id]):
                assert start == len(ids) and tokens == len(texts[0])
                ids += part
            assert ids == texts[0]
        else:
            assert sum(len(i) for _, _, i in got[doc_id]) == sum(map(len, texts))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= window and (end == window or end & (end - 1) == 0)


@pytest.mark.parametrize("window", [64, 4096])
def test_each_id_lies_in_one_piece(documents, window):
    rows = [r for r in edge_rows() if r[0] != 10] + [(20, prose(4, 9000))] + [(30 + i, t) for i, t in enumerate(ODD)]
    check(rows, packing.packed(documents(rows), PATH, window).collect(), window)


def test_digest_and_empty_table(documents):
    rows = [(1, "some words here"), (2, None)]
    found = {r.doc_id: r.doc_tokens for r in packing.digest(packing.packed(documents(rows), PATH)).collect()}
    assert found == {1: len(plain_ids(["some words here"])[0]), 2: 1}
    whole = [r for r in packing.digest(packing.packed(documents([(2, None)]), PATH)).collect()]
    assert [(r.start, r.length, r.ids_crc32) for r in whole] == [(0, 1, zlib.crc32(b"\x02\0\0\0"))]
    assert packing.packed(documents([]), PATH).collect() == []


def test_neighbours_share_words_with_the_seed():
    rng = np.random.default_rng(1)
    topics = [rng.integers(1000 * k + 10, 1000 * k + 60, (20, 30)).astype("<u2") for k in range(4)]
    pieces = [p for group in zip(*topics) for p in group]  # topics take turns
    pure = 0
    for parts in packing.pack(pieces, 300):
        pure += len({pieces[p][0] // 1000 for p, _, _ in parts}) == 1
    assert pure >= 6  # of eight windows


def test_bm25_equals_the_formula():
    rng = np.random.default_rng(2)
    pieces = [rng.integers(0, 40, size).astype("<u2") for size in (5, 17, 30, 30, 64)]
    index, mean = packing.Index(pieces), np.mean([len(p) for p in pieces])
    terms, counts = np.unique(pieces[2], return_counts=True)
    weight = {t: np.log1p((5 - sum(t in p for p in pieces) + 0.5) / (sum(t in p for p in pieces) + 0.5)) for t in range(40)}
    heavy = sorted(zip(terms, counts), key=lambda x: -weight[x[0]] * x[1])[: packing.QUERY_TERMS]
    for k, p in enumerate(pieces):
        want = sum(
            weight[t] * (p == t).sum() * (packing.K1 + 1)
            / ((p == t).sum() + packing.K1 * (1 - packing.B + packing.B * len(p) / mean))
            for t, _ in heavy
        )
        assert abs(index.scores(2)[k] - want) < 1e-9


def test_like_pieces_meet_in_bounded_shards(spark):
    """Sixteen topics that take turns, and equal rows without an id: dealt blindly, few would meet."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(6000):
        low = 1000 * (i % 16) + 10
        ids = np.concatenate([rng.integers(low, low + 60, 40), rng.integers(30_000, 30_500, 10)])
        rows.append((str(i), 50, 0, ids.astype("<u2").tobytes(), int(rng.integers(-(1 << 62), 1 << 62))))
    same = np.arange(31_000, 31_050).astype("<u2").tobytes()
    rows += [(None, 50, 0, same, int(rng.integers(-(1 << 62), 1 << 62))) for _ in range(5000)]
    pieces = spark.createDataFrame(rows, packing.PIECE + ", name long")
    stats = packing.statistics(pieces)
    assert stats.count == 11_000 and stats.mean == 50 and stats.held[31_000] == 5000
    got = packing.deal(pieces, stats, lambda: stats).select("doc_id", "shard").collect()
    sizes, topics = {}, {}
    for r in got:
        sizes[r.shard] = sizes.get(r.shard, 0) + 1
        if r.doc_id is not None:
            shard = topics.setdefault(int(r.doc_id) % 16, {})
            shard[r.shard] = shard.get(r.shard, 0) + 1
    assert len(got) == 11_000 and max(sizes.values()) <= 2 * packing.SHARD_PIECES
    together = sum(n * n for shard in topics.values() for n in shard.values())
    every = sum(sum(shard.values()) ** 2 for shard in topics.values())
    assert together / every > 0.3  # by hash: 1 of 11


def test_every_term_of_a_seed_counts():
    pieces = [np.arange(100, 300).astype("<u2"), np.arange(290, 300).astype("<u2"), np.arange(400, 410).astype("<u2")]
    index = packing.Index(pieces, packing.Statistics(1000, 70.0, np.where(np.arange(1 << 16) < 290, 2, 900)))
    assert index.scores(0)[1] > index.scores(0)[2] == 0
