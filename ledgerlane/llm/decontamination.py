"""Benchmark decontamination: pigeonhole edit matching.

A test item of m characters may differ by k edits, a fixed share of m. Cut into k + 1 pieces, at
least one piece of any such copy is untouched, so every copy is found by the exact hits of pieces
(one pass of an automaton over the text). Around the hits Myers' bit-parallel recurrence gives the
least edit distance of the item to any part of the text. Overlapping surroundings are searched
once, so a text full of hits costs no more than its length for each item.

Texts and items are compared in lower case with white space runs as one blank. Items are searched
in blocks of a bounded number of characters, each against all documents.

Defined cases: NULL or empty texts and items match nothing; an item of fewer than LEAST_CHARS
characters says too little inside a text and matches only a document that consists of it; equal
items match each by itself; repeated documents give repeated rows; extra columns are ignored; with
no items or no documents the result is empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.llm.common import shared, small_batches, table

ERROR_SHARE = 0.08
"""Edits allowed per character of an item."""

LEAST_CHARS = 24
BLOCK_CHARS = 8 << 20
"""Characters of the items searched in one pass."""

_WORD = re.compile(r"\S+")


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str) -> list[tuple[int, str]]:
    """(offset, piece): the item cut into one piece more than the edits allowed."""
    count = int(ERROR_SHARE * len(item)) + 1
    edges = [len(item) * i // count for i in range(count + 1)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:])]


def nearest(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any part of the text, and the first end of such a part."""
    size = len(pattern)
    masks: dict[str, int] = {}
    for k, letter in enumerate(pattern):
        masks[letter] = masks.get(letter, 0) | 1 << k
    every, top = (1 << size) - 1, 1 << (size - 1)
    up, down, score = every, 0, size
    best, end = size, 0
    for place, letter in enumerate(text, start=1):
        same = masks.get(letter, 0)
        cross = same | down
        along = (((same & up) + up) ^ up) | same
        grows = down | (~(along | up) & every)
        falls = up & along
        if grows & top:
            score += 1
        elif falls & top:
            score -= 1
        grows, falls = (grows << 1) & every, (falls << 1) & every
        up = falls | (~(cross | grows) & every)
        down = grows & cross
        if score < best:
            best, end = score, place
    return best, end


class Items:
    """Items of one block with their automaton, which each worker builds once."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, normal(t or "")) for i, t in items]
        self.automaton = None

    def build(self) -> None:
        where: dict[str, list[tuple[int, int]]] = {}
        self.whole: dict[str, list[int]] = {}
        for k, (_, item) in enumerate(self.items):
            if len(item) < LEAST_CHARS:
                if item:
                    self.whole.setdefault(item, []).append(k)
                continue
            for offset, piece in pieces(item):
                where.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()
        self.searched = bool(where)

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item number, start, end, distance) in the normal text, the nearest place of each item."""
        if self.automaton is None:
            self.build()
        found = [(k, 0, len(text), 0) for k in self.whole.get(text, ())]
        around: dict[int, list[list[int]]] = {}
        for last, (size, places) in self.automaton.iter(text) if self.searched and text else ():
            for k, offset in places:
                item = self.items[k][1]
                room = int(ERROR_SHARE * len(item))
                start = last + 1 - size - offset
                low, high = max(0, start - room), min(len(text), start + len(item) + room)
                spans = around.setdefault(k, [])
                if spans and low <= spans[-1][1] and low >= spans[-1][0]:
                    spans[-1][1] = max(spans[-1][1], high)
                else:
                    spans.append([low, high])
        for k, spans in sorted(around.items()):
            item = self.items[k][1]
            room = int(ERROR_SHARE * len(item))
            best = None
            for low, high in spans:
                exact = text.find(item, low, high)
                if exact >= 0:
                    best = (0, exact, exact + len(item))
                    break
                distance, end = nearest(item, text[low:high])
                if distance <= room and (best is None or distance < best[0]):
                    # Backwards from the end the same search gives the start.
                    head = text[max(low, low + end - len(item) - room) : low + end][::-1]
                    _, back = nearest(item[::-1], head)
                    best = (distance, low + end - back, low + end)
            if best:
                found.append((k, best[1], best[2], best[0]))
        return found

    def places(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, start, end, distance) in characters of the text as it is."""
        plain = normal(text)
        found = self.matches(plain)
        if not found:
            return []
        # Words keep their order, so a place in the normal text is a word and a place in it.
        words = list(_WORD.finditer(text))
        starts, at = [], 0
        for w in words:
            starts.append(at)
            at += len(w.group().lower()) + 1
        out, index = [], pd.Index(starts)
        for k, a, b, distance in found:
            one = index.searchsorted(a, side="right") - 1
            two = index.searchsorted(max(a, b - 1), side="right") - 1
            start = min(words[one].end(), words[one].start() + a - starts[one])
            end = min(words[two].end(), words[two].start() + b - starts[two])
            out.append((self.items[k][0], start, end, distance))
        return out


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of about BLOCK_CHARS characters: a pass over the documents for each."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    count = -(-size // BLOCK_CHARS)
    for k in range(count):
        mine = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k)
        yield [(r["item_id"], r["text"]) for r in mine.orderBy("item_id", "text").collect()]


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, end, distance: the nearest place of each item in each document."""
    schema = "doc_id string, item_id long, start long, end long, distance long"
    small_batches(docs.sparkSession)
    spark, found = docs.sparkSession, []
    # Ids travel as text: pandas would turn whole numbers with gaps into floats.
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    for items in _blocks(benchmark):
        get = shared(spark, Items(items))

        def run(batches: Iterator[pd.DataFrame], get=get) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = [
                    (doc_id, *place)
                    for doc_id, text in zip(batch["doc_id"], batch["text"])
                    for place in get().places(text or "")
                ]
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "start", "end", "distance"])

        found.append(rows.mapInPandas(run, schema))
    empty = spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, found, empty).withColumn("doc_id", F.col("doc_id").cast("long"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no item is found, with all their columns."""
    small_batches(docs.sparkSession)
    columns = docs.columns
    for items in _blocks(benchmark):
        get = shared(docs.sparkSession, Items(items))

        @F.pandas_udf("boolean")
        def clean(texts: pd.Series) -> pd.Series:
            return pd.Series([not get().matches(normal(t or "")) for t in texts], dtype=bool)

        docs = docs.where(clean("text"))
    return docs.select(*columns)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All places of benchmark items in all documents."""
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
