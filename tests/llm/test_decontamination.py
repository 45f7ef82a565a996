"""Places of items against a plain edit-distance table."""

import random

import pytest

from ledgerlane.llm import decontamination as d
from tests.llm.conftest import edge_rows, prose


def plain_distance(pattern, text):
    """Least distance of the pattern to any part of the text, and the first end of it."""
    row = list(range(len(pattern) + 1))
    best, end = row[-1], 0
    for place, letter in enumerate(text, start=1):
        new = [0]
        for k, p in enumerate(pattern):
            new.append(min(row[k] + (p != letter), row[k + 1] + 1, new[k] + 1))
        row = new
        if row[-1] < best:
            best, end = row[-1], place
    return best, end


def test_bit_parallel_distance_equals_the_table():
    rng = random.Random(1)
    for _ in range(300):
        pattern = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 80)))
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 90)))
        assert d.nearest(pattern, text) == plain_distance(pattern, text)


def edit(text, count, rng):
    letters = list(text)
    for _ in range(count):
        at = rng.randrange(len(letters))
        letters[at : at + 1] = rng.choice([[], ["q"], [letters[at], "q"]])
    return "".join(letters)


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(i, prose(500 + i, 12 + i), "x") for i in range(12)]
    rows += [(12, rows[0][1], "x"), (13, None, "x"), (14, ""), (15, "two words"), (None, prose(900, 20), "x")]
    return [(r[0], r[1]) for r in rows], spark.createDataFrame(
        [(r[0], r[1], "x") for r in rows], "item_id long, text string, doc_id string"
    )


def planted(items):
    rng, rows = random.Random(2), []
    for k, (_, text) in enumerate(items[:12]):
        budget = int(d.ERROR_SHARE * len(d.normal(text)))
        for j, count in enumerate((0, budget, 2 * budget + 4)):
            passage = edit(text, count, rng).upper().replace(" ", " \n ", 1)
            rows.append((100 + 10 * k + j, f"{prose(k, 20)}  {passage}\t{prose(700 + k, 20)}"))
    return rows + [(300, "Two  words"), (301, "the two words here"), (302, items[16][1])]


def test_matches_equal_a_plain_search(documents, benchmark):
    items, table = benchmark
    rows = planted(items) + [r for r in edge_rows() if r[0] != 10]
    want = set()
    for doc_id, text in rows:
        plain = d.normal(text or "")
        for item_id, item in items:
            item = d.normal(item or "")
            if 0 < len(item) < d.LEAST_CHARS:
                if item == plain:
                    want.add((doc_id, item_id, 0))
            elif item:
                distance, _ = plain_distance(item, plain)
                if distance <= int(d.ERROR_SHARE * len(item)):
                    want.add((doc_id, item_id, distance))
    got = d.matches(documents(rows), table).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in got} == want
    assert {r.doc_id for r in got} >= {100 + 10 * k + j for k in range(12) for j in (0, 1)} | {300, 302}
    texts = dict(rows)
    for r in got:
        item = dict(items)[r.item_id]
        assert plain_distance(d.normal(item), d.normal(texts[r.doc_id][r.start : r.end]))[0] == r.distance


def test_blocks_of_items_give_the_same(documents, benchmark, monkeypatch):
    items, table = benchmark
    rows = planted(items)
    whole = sorted(map(str, d.matches(documents(rows), table).collect()))
    monkeypatch.setattr(d, "BLOCK_CHARS", 400)
    assert sorted(map(str, d.matches(documents(rows), table).collect())) == whole


def test_leaks_go_and_clean_documents_stay(documents, benchmark, spark):
    items, table = benchmark
    rows = planted(items) + edge_rows()
    leaks = {r.doc_id for r in d.matches(documents(rows), table).collect()}
    kept = d.without_leaks(documents(rows), table)
    assert kept.columns == documents([]).columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(i) for i, _ in rows if i not in leaks)
    assert d.matches(documents([]), table).collect() == []
    assert d.without_leaks(documents(rows), table.limit(0)).count() == len(rows)


def test_a_text_full_of_hits_is_searched_once():
    items = d.Items([(1, "abcd efgh " * 10 + "tail")])
    assert items.matches(d.normal("abcd efgh " * 20_000)) is not None
