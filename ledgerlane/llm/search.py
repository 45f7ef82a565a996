"""Ranked lexical search: MaxScore with bounds of term pairs.

``build`` makes an inverted index in blocks of documents: for each term of the queries the documents that
hold it with their impacts and the largest impact, and for chosen pairs of terms the intersection of both
lists with the largest joint score. ``search`` answers each query block by block. Its terms are taken in
pairs (each with its neighbour by weight); the bound of a pair is the largest of the first term alone, the
second alone, and both together, so pairs that never meet, or never at their best, bound a document more
tightly than two separate maxima. From the highest pair bound down, the documents of a pair become
candidates only while their own bound and all lower pairs together can still reach the twentieth-best
score: both lists, or only one, or only the intersection. Once the lower pairs cannot reach it alone, no
new document can; the rest is added up for candidates only, which leave as soon as they cannot reach it.

Scores are exact 64-bit integers. The threshold is the twentieth-best score that the task has seen, so it
carries from block to block; a skipped document is below it, and equal scores stay in. Every document is
indexed. Postings are those of the stated queries' terms; counts N, L and df are taken over all documents.
Queries travel to tasks in groups of bounded size; each group runs over the whole index of its terms.

Defined cases: a NULL text has no terms; documents and queries without terms match nothing; a NULL doc_id
ranks after all others of its score; repeated rows are ranked one by one; equal (item_id, text) rows of
queries are one query, and different texts of one item_id are ranked apart; extra columns are ignored; an
empty table gives an empty result; terms of very long texts are split off in slices.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlane.llm.common import small_batches, table
from ledgerlane.operators.scale import cut

TOP = 20
BLOCK_DOCS = 8192
"""Documents of a block at most; their numbers in it need 16 bits."""

BLOCK_POSTINGS = 1 << 20
"""A block is closed at so many postings."""

GROUP_BYTES = 4 << 20
"""Bytes of query texts that travel to the tasks at a time, on average."""

SLICE = 1 << 20
_TERMS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """Terms ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` in slices, A-Z lower-cased."""
    raw = (text or "").encode("utf-8").lower().translate(_TERMS)
    start = 0
    while start < len(raw):
        gap = raw.find(b" ", start + SLICE)
        end = len(raw) if gap < 0 else gap
        yield raw[start:end].split()
        start = end


@dataclass
class Queries:
    """Queries over numbered terms, as sent to tasks: of bounded size."""

    numbers: dict[bytes, int]
    terms: list[Counter]
    weights: np.ndarray | None = None
    pairs: list[tuple[int, int, int, int]] | None = None
    plans: list[list[int]] | None = None

    @classmethod
    def of(cls, texts: list[str | None]) -> Queries:
        numbers: dict[bytes, int] = {}
        terms = [
            Counter(numbers.setdefault(t, len(numbers)) for part in terms_of(text) for t in part)
            for text in texts
        ]
        return cls(numbers, terms)

    def weigh(self, found: dict[int, int], total: int) -> None:
        """Weights from document frequencies; then each query's terms in pairs, by weight."""
        self.weights = np.array(
            [math.floor(1000 * math.log((2 * total + 2) / (2 * found.get(t, 0) + 1))) for t in range(len(self.numbers))],
            dtype=np.int64,
        )
        places: dict[tuple[int, int, int, int], int] = {}
        self.plans = []
        for terms in self.terms:
            order = sorted(terms, key=lambda t: (-self.weights[t], t))
            order = [(t, terms[t]) for t in order if found.get(t)]
            twos = [(*a, *b) for a, b in zip(order[::2], order[1::2])]
            if len(order) % 2:
                twos.append((*order[-1], -1, 0))
            self.plans.append([places.setdefault(p, len(places)) for p in twos])
        self.pairs = list(places)


def _forward(queries):
    """doc_id, n and the query terms of each document that has any term, with their occurrences."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = queries.value.numbers
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                n, found = 0, []
                for words in terms_of(text):
                    n += len(words)
                    at = np.fromiter((numbers.get(w, -1) for w in words), dtype=np.int64, count=len(words))
                    found.append(at[at >= 0])
                if n:
                    terms, times = np.unique(np.concatenate(found), return_counts=True)
                    rows.append((doc_id, n, terms.astype("<u4").tobytes(), times.astype("<u4").tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "terms", "times"])

    return run


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        terms = np.frombuffer(b"".join(batch["terms"]), dtype="<u4")
        found, df = np.unique(terms, return_counts=True)
        yield pd.DataFrame({"term": found.astype(np.int64), "df": df})


def impact(times: np.ndarray, size: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * times) // (1000 * times + 12 * size)


def _posted(rows: pd.DataFrame, queries: Queries, docs: int, words: int) -> dict:
    """A block: postings by term with their largest impacts, and pairs with intersections."""
    terms = np.frombuffer(b"".join(rows["terms"]), dtype="<u4").astype(np.int64)
    times = np.frombuffer(b"".join(rows["times"]), dtype="<u4").astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(t) // 4 for t in rows["terms"]])
    # 25 * n * N may pass 64 bits: whole multiples of L are taken out first.
    n = rows["n"].to_numpy(dtype=object)
    size = np.array([75 + (25 * int(x) * docs) // words for x in n], dtype=np.int64)
    order = np.argsort(terms, kind="stable")
    terms, owner = terms[order], owner[order]
    impacts = impact(times[order], size[owner])
    edges = np.searchsorted(terms, np.arange(len(queries.weights) + 1))
    block = Block(rows["doc_id"].tolist(), edges, owner, impacts)
    lists, ends, joint = [], [0], []
    for a, q_a, b, q_b in queries.pairs:
        both, best = block.meet(a, q_a, b, q_b, queries.weights)
        lists.append(both)
        ends.append(ends[-1] + len(both))
        joint.append(best)
    both = np.concatenate(lists) if lists else np.empty(0, dtype=np.int64)
    return {
        "ids": ",".join("" if i is None else i for i in block.ids),
        "edges": edges.astype("<u4").tobytes(),
        "owners": owner.astype("<u2").tobytes(),
        "impacts": impacts.astype("<u4").tobytes(),
        "pair_edges": np.array(ends, dtype="<u4").tobytes(),
        "pair_owners": both.astype("<u2").tobytes(),
        "pair_best": np.array(joint, dtype="<i8").tobytes(),
    }


class Block:
    """Postings of some documents, numbered 0, 1, ...; the lists of a term are in that order."""

    def __init__(self, ids, edges, owners, impacts, pair_edges=None, pair_owners=None, pair_best=None):
        self.ids, self.edges, self.owners, self.impacts = ids, edges, owners, impacts
        self.pair_edges, self.pair_owners, self.pair_best = pair_edges, pair_owners, pair_best

    @classmethod
    def read(cls, row) -> Block:
        def numbers(name: str, kind: str) -> np.ndarray:
            return np.frombuffer(getattr(row, name), dtype=kind).astype(np.int64)

        return cls(
            [i or None for i in row.ids.split(",")],
            numbers("edges", "<u4"),
            numbers("owners", "<u2"),
            numbers("impacts", "<u4"),
            numbers("pair_edges", "<u4"),
            numbers("pair_owners", "<u2"),
            numbers("pair_best", "<i8"),
        )

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        if term < 0:
            return self.owners[:0], self.impacts[:0]
        part = slice(self.edges[term], self.edges[term + 1])
        return self.owners[part], self.impacts[part]

    def meet(self, a: int, q_a: int, b: int, q_b: int, weights) -> tuple[np.ndarray, int]:
        """Documents of both terms, and the largest joint score among them."""
        (one, x), (two, y) = self.postings(a), self.postings(b)
        both, at, there = np.intersect1d(one, two, assume_unique=True, return_indices=True)
        if not len(both):
            return both, 0
        return both, int((q_a * weights[a] * x[at] + q_b * weights[b] * y[there]).max())


def build(forward: DataFrame, queries, docs: int, words: int) -> DataFrame:
    """The index: a row for each block of documents, with its postings and pair lists."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, count, postings = [], 0, 0

        def closed() -> pd.DataFrame:
            return pd.DataFrame([_posted(pd.concat(held, ignore_index=True), queries.value, docs, words)])

        for batch in batches:
            ends = np.cumsum([len(t) // 4 for t in batch["terms"]])
            low = 0
            while low < len(batch):
                done = int(ends[low - 1]) if low else 0
                room = int(np.searchsorted(ends, done + BLOCK_POSTINGS - postings, side="right")) - low
                high = min(len(batch), low + max(1, min(room, BLOCK_DOCS - count)))
                held.append(batch.iloc[low:high])
                count, postings = count + high - low, postings + int(ends[high - 1]) - done
                low = high
                if count >= BLOCK_DOCS or postings >= BLOCK_POSTINGS or low < len(batch):
                    yield closed()
                    held, count, postings = [], 0, 0
        if held:
            yield closed()

    return forward.where(F.octet_length("terms") > 0).mapInPandas(
        run,
        "ids string, edges binary, owners binary, impacts binary,"
        " pair_edges binary, pair_owners binary, pair_best binary",
    )


def best_of(block: Block, plan: list[int], queries: Queries, least: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a block that can be among the best, with their scores: all with ``least`` or more
    that are not behind ``top`` others. Also right, and only slower, with ``least`` at 0."""
    weights, pairs = queries.weights, []
    for number in plan:
        a, q_a, b, q_b = queries.pairs[number]
        (one, x), (two, y) = block.postings(a), block.postings(b)
        if len(one) or len(two):
            x, y = q_a * weights[a] * x, (q_b * weights[b] if q_b else 0) * y
            alone = int(x.max(initial=0)), int(y.max(initial=0))
            pairs.append((max(*alone, int(block.pair_best[number])), number, alone, (one, x), (two, y)))
    pairs.sort(key=lambda p: p[:2])
    below = np.cumsum([0] + [p[0] for p in pairs])  # what all pairs below the i-th can add
    scores = np.zeros(len(block.ids), dtype=np.int64)
    candidate = np.zeros(len(block.ids), dtype=bool)
    at = len(pairs)
    # Only candidates can enter; a document skipped at its highest pair is below the threshold.
    while at and below[at] >= max(least, 1):
        at -= 1
        _, number, alone, one, two = pairs[at]
        for (docs, gain), most in zip((one, two), alone):
            scores[docs] += gain
            if most + below[at] >= least:
                candidate[docs] = True
        if block.pair_best[number] + below[at] >= least:
            candidate[block.pair_owners[block.pair_edges[number] : block.pair_edges[number + 1]]] = True
        if len(scores) > top:
            least = max(least, int(np.partition(scores, -top)[-top]))
    left = np.flatnonzero(candidate)
    left = left[scores[left] + below[at] >= least]
    while at and len(left):
        at -= 1
        for docs, gain in pairs[at][3:]:
            place = np.minimum(np.searchsorted(docs, left), max(0, len(docs) - 1))
            hit = docs[place] == left if len(docs) else np.zeros(len(left), dtype=bool)
            scores[left[hit]] += gain[place[hit]]
        if len(left) > top:
            least = max(least, int(np.partition(scores[left], -top)[-top]))
        left = left[scores[left] + below[at] >= least]
    left = left[scores[left] > 0]
    return left, scores[left]


def _ranked(found: list[tuple], top: int) -> list[tuple]:
    """(score, doc_id as number or None): highest first, then least id, NULL last."""
    return sorted(found, key=lambda f: (-f[0], f[1] is None, f[1] or 0))[:top]


def _search(queries, top: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = queries.value
        best: list[list[tuple]] = [[] for _ in known.plans]
        for batch in batches:
            for row in batch.itertuples():
                block = Block.read(row)
                for number, plan in enumerate(known.plans):
                    mine = best[number]
                    least = mine[-1][0] if len(mine) == top else 0
                    docs, scores = best_of(block, plan, known, least, top)
                    if len(docs):
                        ids = [block.ids[d] for d in docs]
                        more = [(s, None if i is None else int(i)) for s, i in zip(scores.tolist(), ids)]
                        best[number] = _ranked(mine + more, top)
        rows = [(q, s, None if i is None else str(i)) for q, found in enumerate(best) for s, i in found]
        yield pd.DataFrame(rows, columns=["query", "score", "doc_id"])

    return run


def _group(docs: DataFrame, items: list, kind: str, top: int) -> DataFrame:
    """item_id (of a given type), text, score, doc_id: the tasks' best, for queries of bounded size."""
    spark = docs.sparkSession
    queries = Queries.of([i["text"] for i in items])
    sent = spark.sparkContext.broadcast(queries)
    forward = cut(docs.mapInPandas(_forward(sent), "doc_id string, n long, terms binary, times binary"))
    total, words = forward.agg(F.count(F.lit(1)), F.sum("n")).first()
    found = (
        forward.select("terms").mapInPandas(_frequencies, "term long, df long")
        .groupBy("term").agg(F.sum("df").alias("df")).collect()  # terms of the queries
    )
    queries.weigh({r["term"]: r["df"] for r in found}, total)
    weighed = spark.sparkContext.broadcast(queries)
    index = cut(build(forward, weighed, total, words or 1))
    best = cut(index.mapInPandas(_search(weighed, top), "query long, score long, doc_id string"))
    for used in (sent, weighed):
        used.destroy()
    names = spark.createDataFrame(
        [(n, i["item_id"], i["text"]) for n, i in enumerate(items)], f"query long, item_id {kind}, text string"
    )
    return best.join(F.broadcast(names), "query").drop("query")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of each item with a score above 0."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("string"), "text")
    items = cut(items.select("item_id", "text").where("text IS NOT NULL").distinct())
    (size,) = items.agg(F.sum(F.octet_length("text") + 64)).first()
    groups = -(-(size or 0) // GROUP_BYTES)
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, groups)))
    found = None
    for group in range(groups):
        rows = items.where(place == group).orderBy("item_id", "text").collect()  # of bounded size
        if rows:
            one = _group(texts, rows, dict(items.dtypes)["item_id"], top)
            found = one if found is None else found.unionByName(one)
    if found is None:
        return items.select(
            "item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")
        ).limit(0)
    found = found.withColumn("doc_id", F.col("doc_id").cast("long"))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # First within shares, whose number grows with the cluster, then among their first ones.
    shares = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = Window.partitionBy("item_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(shares))).orderBy(*order)
    some = found.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    whole = Window.partitionBy("item_id", "text").orderBy(*order)
    ranked = some.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents for each benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = {
    "op12_search": r"""
WITH lists AS (
    SELECT doc_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
    FROM documents WHERE text IS NOT NULL
), sizes AS (
    SELECT doc_id, len(t) AS n FROM lists WHERE len(t) > 0
), whole AS (
    SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM sizes
), postings AS (
    SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM lists) GROUP BY ALL
), weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM postings, whole GROUP BY term, docs
), queries AS (
    SELECT item_id, term, count(*) AS q FROM (
        SELECT item_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL
), scores AS (
    SELECT item_id, p.doc_id, CAST(sum(q * w * ((1000000000 * tf)
        // (1000 * tf + 12 * (75 + (25 * n * docs) // words)))) AS BIGINT) AS score
    FROM queries JOIN postings p USING (term) JOIN weights USING (term)
    JOIN sizes ON sizes.doc_id = p.doc_id, whole
    GROUP BY item_id, p.doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank,
    doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 20
""",
}
