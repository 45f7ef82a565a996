"""Flows against all possible flows; placements against the law."""

import itertools
import zlib

import pyarrow.parquet as pq
import pytest

from ledgerlane.llm import resharding as r
from tests.llm.conftest import edge_rows, prose


def least_cost(supply, capacity, cost):
    """By trying every flow of a small problem."""
    best = None
    rows = [
        [f for f in itertools.product(range(s + 1), repeat=len(capacity)) if sum(f) == s] for s in supply
    ]
    for flow in itertools.product(*rows):
        if all(sum(f[j] for f in flow) <= c for j, c in enumerate(capacity)):
            total = sum(cost[i][j] * f for i, row in enumerate(flow) for j, f in enumerate(row))
            best = total if best is None else min(best, total)
    return best


@pytest.mark.parametrize(
    ("supply", "capacity", "cost"),
    [
        ([4, 1], [2, 2, 1], [[0, 1, 1], [1, 0, 1]]),
        ([3, 3], [2, 2, 2], [[0, 5, 1], [0, 2, 3]]),
        ([2, 2, 2], [3, 3], [[0, 4], [0, 1], [0, 2]]),
        ([0, 3], [1, 3], [[1, 1], [2, 2]]),
    ],
)
def test_flow_is_cheapest(supply, capacity, cost):
    flow = r.min_cost_flow(supply, capacity, cost)
    assert [sum(f) for f in flow] == supply
    assert all(sum(f[j] for f in flow) <= c for j, c in enumerate(capacity))
    assert sum(cost[i][j] * x for i, f in enumerate(flow) for j, x in enumerate(f)) == least_cost(supply, capacity, cost)


def test_staying_is_free():
    flow = r.min_cost_flow([100, 10, 10], [40, 40, 40], [[0 if i == j else 1 for j in range(3)] for i in range(3)])
    assert [flow[i][i] for i in range(3)] == [40, 10, 10]


def placed_rows(documents, rows, shards):
    return r.place(r.weighed(documents(rows)), shards).collect()


def test_placement(documents):
    rows = edge_rows()[:11] + [(100 + i, prose(i, 10 + i % 60)) for i in range(300)] + [(900 + i, "copy of a text") for i in range(150)]
    got = placed_rows(documents, rows, 6)
    want = sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(x.doc_id), x.size, x.text_crc32) for x in got) == want
    loads = [sum(x.size for x in got if x.shard == k) for k in range(6)]
    assert max(loads) - min(loads) <= 600
    for k in range(6):
        assert sorted(x.slot for x in got if x.shard == k) == list(range(sum(x.shard == k for x in got)))
    moved = sum(x.size for x in got if x.shard != x.old)
    old = [sum(x.size for x in got if x.old == k) for k in range(16)]
    needed = sum(max(0, s - sum(old) // 6) for s in old[:6]) + sum(old[6:])
    assert needed == r.least_moved(old, 6)
    assert moved <= needed + 16 * 600


def test_equal_texts_go_together(documents):
    """Groups of copies of all sizes, and one that is larger than a shard."""
    rows = [(i, prose(i, 10 + i % 60)) for i in range(300)]
    for g in range(40):
        rows += [(1000 + 100 * g + c, prose(5000 + g, 20)) for c in range(2 + g)]
    rows += [(None, ""), (None, None), (7, ""), (7, "")]
    rows += [(9000 + c, prose(7777, 300)) for c in range(60)]
    got = placed_rows(documents, rows, 6)
    assert len(got) == len(rows)
    homes, weight = {}, {}
    for x in got:
        key = (x.text_crc32, x.size)
        homes.setdefault(key, set()).add(x.shard)
        weight[key] = weight.get(key, 0) + x.size
    goal = sum(weight.values()) / 6
    assert max(weight.values()) > goal
    assert all(len(homes[k]) == 1 for k in homes if weight[k] <= goal)
    loads = [sum(x.size for x in got if x.shard == k) for k in range(6)]
    assert max(loads) <= 1.1 * goal and min(loads) >= 0.9 * goal
    for k in range(6):
        assert sorted(x.slot for x in got if x.shard == k) == list(range(sum(x.shard == k for x in got)))


def test_large_units_stay_while_there_is_room():
    units = [{"old": o, "text_crc32": i, "size": s, "total": s} for i, (o, s) in enumerate([(0, 50), (0, 60), (9, 40), (1, 30)])]
    found, loads = r._settle(units, 100, 3)
    assert {u[1]: u[3] for u in found} == {1: 0, 0: 1, 2: 2, 3: 1} and loads == [60, 80, 40]


def test_one_row_and_no_row(documents):
    (row,) = placed_rows(documents, [(1, None)], 24)
    assert (row.size, row.slot, row.text_crc32) == (8, 0, 0)
    assert placed_rows(documents, [], 24) == []


def test_rewritten_files_hold_their_documents(documents, tmp_path):
    rows = [(i, prose(i, 20)) for i in range(80)]
    docs = documents(rows)
    placed = r.place(r.weighed(docs), 4)
    shards = r.rewrite(docs, placed, str(tmp_path / "new"))
    where = {x.doc_id: x.shard for x in placed.collect()}
    got = pq.read_table(tmp_path / "new").to_pylist()
    assert {x["doc_id"]: int(x["shard"]) for x in got} == {i: s for i, s in where.items() if s in shards}
    assert {x["doc_id"]: x["text"] for x in got}.items() <= dict(rows).items()


def test_rewritten_rows_with_null_and_repeated_ids(documents, tmp_path):
    rows = [(None, prose(i, 20)) for i in range(30)] + [(5, prose(i // 2, 20)) for i in range(60)] + [(None, None), (5, ""), (5, "")]
    docs = documents(rows)
    placed = r.place(r.weighed(docs), 4)
    shards = r.rewrite(docs, placed, str(tmp_path / "new"))
    got = pq.read_table(tmp_path / "new").to_pylist()
    want = [(x.doc_id, x.text_crc32, x.shard) for x in placed.collect() if x.shard in shards]
    name = lambda x: tuple(str(v) for v in x)
    found = [(x["doc_id"], zlib.crc32((x["text"] or "").encode()), int(x["shard"])) for x in got]
    assert sorted(map(name, found)) == sorted(map(name, want))
    assert shards == sorted({s for x in placed.collect() if x.old != x.shard for s in (x.old, x.shard)})
