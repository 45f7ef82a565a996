"""Lexical retrieval packing of tokenised documents into windows.

A document longer than a window is cut: full windows stand alone, the rest is a remainder.
Remainders are sorted by their heaviest terms, coarse to fine, and cut into shards of a bounded
number of documents, so that neighbours meet; the number of shards grows with the input. A group of
like texts may fill several shards. Each shard builds a BM25 inverted index over its remainders, with
document frequencies and mean length counted over all pieces. The longest
unused one seeds a window and is the query; its best unused neighbours fill the window, the last of
them is cut where the window ends, and its rest stays unused. So every window but a shard's last is
full. The last one is split into sequences of powers of two, which need no padding.

Defined cases: a NULL text counts as empty; an empty document is its end token alone; repeated rows
are documents of their own; ties go to the smaller id and then to the order of the ids in a text;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.llm.common import shared, small_batches, table
from ledgerlane.operators.scale import cut

WINDOW = 4096
END = 2
"""Id after the last token of a document."""

SHARD_PIECES = 1024
"""Pieces in a shard, about: bounds an index to 1024 windows of ids."""

QUERY_TERMS = None
"""Terms of a seed that are looked up, those of the greatest weight first; None for all."""

LEVELS = (1024, 64, 2)
"""Pieces that must hold a term for it to count as the first, second or third term of a sort key."""

SAMPLED = 1_000_000
"""Sort keys, about, from which the edges of the shards are taken."""

K1, B = 1.2, 0.75
KNOWN_CHUNKS, KNOWN_WORDS = 250_000, 400_000
"""Chunks between blanks, and words, whose ids a worker remembers; it starts anew beyond that."""

JOINED_WORDS = 400
SLICE = 1 << 20
"""Characters encoded at a time; a longer text is cut at blanks."""

# Words that split alike here and in the tokenizer: Latin letters, digits, ASCII punctuation.
_SIMPLE = re.compile(r"[!-~À-ÖØ-öø-ÿ]+\Z")
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


class Encoder:
    """Ids of whole texts by a tokenizers file, word by word with what was met before remembered.

    The tokenizer splits at blanks before it merges, so a text has the ids of its chunks between
    blanks in order. New words of simple chunks are encoded many at a time, other chunks alone.
    """

    def __init__(self, path: str):
        self.path, self.tokenizer = path, None
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list:
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
        return [self.tokenizer.encode(t, add_special_tokens=False) for t in texts]

    def _learn(self, words: list[str]) -> None:
        for k in range(0, len(words), JOINED_WORDS):
            part = words[k : k + JOINED_WORDS]
            (found,) = self._encode([" ".join(part)])
            packed = np.array(found.ids, dtype="<u2").tobytes()
            # Each word is one piece of the split, and pieces are numbered.
            edges = (2 * np.searchsorted(np.array(found.word_ids), np.arange(len(part) + 1))).tolist()
            self.words.update(zip(part, [packed[a:b] for a, b in zip(edges, edges[1:])]))

    def texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed as little-endian 16-bit numbers, SLICE characters at a time."""
        parts: list[list[bytes]] = [[] for _ in texts]
        owners, slices, held = [], [], 0
        for k, text in enumerate(texts):
            start = 0
            while start < len(text):
                end = text.find(" ", start + SLICE)
                end = len(text) if end < 0 else end
                owners.append(k)
                slices.append(text[start:end])
                held += end - start
                start = end
                if held >= SLICE:
                    for owner, ids in zip(owners, self._slices(slices)):
                        parts[owner].append(ids)
                    owners, slices, held = [], [], 0
        for owner, ids in zip(owners, self._slices(slices)):
            parts[owner].append(ids)
        return [b"".join(p) for p in parts]

    def _slices(self, texts: list[str]) -> list[bytes]:
        if len(self.chunks) > KNOWN_CHUNKS:
            self.chunks = {}
        if len(self.words) > KNOWN_WORDS:
            self.words = {}
        split = [t.replace("\n", " ").split(" ") for t in texts]
        new = list(set().union(*split).difference(self.chunks))
        other = [] if _SIMPLE.match("".join(new)) else [c for c in new if not _SIMPLE.match(c)]
        other += [c for c in new if "<|" in c or not c]
        simple = list(set(new).difference(other))
        lower = " ".join(simple).lower().split(" ") if simple else []
        parts = [[low] if low.isalpha() else _WORD.findall(low) for low in lower]
        self._learn(list({w for words in parts for w in words}.difference(self.words)))
        known = self.words
        for chunk, words in zip(simple, parts):
            self.chunks[chunk] = known[words[0]] if len(words) == 1 else b"".join([known[w] for w in words])
        for chunk, found in zip(other, self._encode(other)):
            self.chunks[chunk] = np.array(found.ids, dtype="<u2").tobytes()
        get = self.chunks.__getitem__
        return [b"".join(map(get, chunks)) for chunks in split]


PIECE = "doc_id string, doc_tokens long, start long, ids binary"


def tokenised(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """doc_id (as text), doc_tokens, start, ids: each document in pieces of at most a window.

    ``ids`` are packed 16-bit numbers; all but a document's last piece are whole windows.
    """
    small_batches(docs.sparkSession)
    get = shared(docs.sparkSession, Encoder(path))
    end = np.array([END], dtype="<u2").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = get()
        for batch in batches:
            rows = []
            for low in range(0, len(batch), 500):
                part = batch.iloc[low : low + 500]
                packed = encoder.texts([t or "" for t in part["text"]])
                for doc_id, ids in zip(part["doc_id"], packed):
                    ids += end
                    count = len(ids) // 2
                    for start in range(0, count, window):
                        rows.append((doc_id, count, start, ids[2 * start : 2 * (start + window)]))
            yield pd.DataFrame(rows, columns=["doc_id", "doc_tokens", "start", "ids"])

    # Ids travel as text: pandas would turn whole numbers with gaps into floats.
    return docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(run, PIECE)


class Statistics:
    """Number of pieces, their mean length, and how many hold each id."""

    def __init__(self, count: int, mean: float, held: np.ndarray):
        self.count, self.mean, self.held = count, max(1.0, mean), held
        self.weight = np.log1p((count - held + 0.5) / (held + 0.5))

    def norm(self, sizes):
        return K1 * (1 - B + B * sizes / self.mean)

    def key(self, ids: np.ndarray) -> int:
        """The heaviest common, less common and rare term, 16 bits each: like pieces have near keys."""
        terms, times = np.unique(ids, return_counts=True)
        heavy = self.weight[terms] * times / (times + self.norm(len(ids)))
        held, key = self.held[terms], 0
        for level in LEVELS:
            fit = np.where(held >= min(level, self.count // 2), heavy, 0.0)
            key = key << 16 | int(terms[fit.argmax()])
        return key


def statistics(pieces: DataFrame) -> Statistics:
    """Over all pieces; at most an entry per id comes to the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            for ids in batch["ids"]:
                held[np.unique(np.frombuffer(ids, dtype="<u2"))] += 1
        found = np.flatnonzero(held)
        yield pd.DataFrame({"term": found, "held": held[found]})

    count, octets = pieces.agg(F.count(F.lit(1)), F.sum(F.octet_length("ids"))).first()
    held = np.zeros(1 << 16, dtype=np.int64)
    counted = pieces.select("ids").mapInPandas(run, "term long, held long")
    for row in counted.groupBy("term").agg(F.sum("held").alias("held")).collect():
        held[row["term"]] = row["held"]
    return Statistics(count, (octets or 0) / 2 / max(1, count), held)


class Index:
    """BM25 inverted index over the pieces of one shard; ``stats`` are those of all pieces."""

    def __init__(self, pieces: list[np.ndarray], stats: Statistics | None = None):
        self.terms, self.counts = [], []
        for ids in pieces:
            ordered = np.sort(ids)
            edges = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
            self.terms.append(ordered[edges])
            self.counts.append(np.diff(np.concatenate((edges, [len(ordered)]))))
        sizes = np.array([len(p) for p in pieces], dtype=np.float64)
        owner = np.repeat(np.arange(len(pieces)), [len(t) for t in self.terms])
        terms, counts = np.concatenate(self.terms), np.concatenate(self.counts)
        order = np.argsort(terms, kind="stable")
        self.owner = owner[order]
        ordered = terms[order]
        self.starts = np.searchsorted(ordered, np.arange(1 << 16))
        self.starts = np.append(self.starts, len(ordered))
        stats = stats or Statistics(len(pieces), sizes.mean(), np.diff(self.starts))
        self.weight = stats.weight
        norm = stats.norm(sizes)
        times = counts[order].astype(np.float64)
        self.part = self.weight[ordered] * times * (K1 + 1) / (times + norm[self.owner])
        self.size = len(pieces)

    def scores(self, piece: int) -> np.ndarray:
        """BM25 of every piece for the terms of one."""
        terms = self.terms[piece]
        heavy = np.argsort(-self.weight[terms] * self.counts[piece], kind="stable")[:QUERY_TERMS]
        places = [slice(a, b) for a, b in zip(self.starts[terms[heavy]], self.starts[terms[heavy].astype(np.int64) + 1])]
        owners = np.concatenate([self.owner[p] for p in places])
        return np.bincount(owners, np.concatenate([self.part[p] for p in places]), self.size)


def pack(pieces: list[np.ndarray], window: int = WINDOW, stats: Statistics | None = None) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (piece, from, to): all but the last are full.

    Pieces are at most a window long. Parts of a piece left unused keep its place in the index.
    """
    if not pieces:
        return []
    left = np.array([len(p) for p in pieces], dtype=np.int64)
    used = np.zeros(len(pieces), dtype=np.int64)
    index = Index(pieces, stats) if (left < window).any() else None
    longest = iter(np.argsort(-left, kind="stable"))
    windows = []
    for seed in longest:
        if not left[seed]:
            continue
        found, room = [], window
        ranked: Iterator[int] = iter(())
        if left[seed] < window:
            scores = index.scores(seed)
            scores[seed] = np.inf
            free = np.flatnonzero(left)
            ranked = iter(free[np.argsort(-scores[free], kind="stable")])
        else:
            ranked = iter([seed])
        for piece in ranked:
            take = min(room, left[piece])
            found.append((int(piece), int(used[piece]), int(used[piece] + take)))
            used[piece] += take
            left[piece] -= take
            room -= take
            if not room:
                break
        windows.append(found)
    return windows


def split_last(parts: list[tuple[int, int, int]], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """A window that is not full as sequences of falling powers of two."""
    length = sum(b - a for _, a, b in parts)
    if length == window:
        return [parts]
    out, queue = [], list(reversed(parts))
    while length:
        room = 1 << (length.bit_length() - 1)
        length -= room
        sequence = []
        while room:
            piece, a, b = queue.pop()
            take = min(room, b - a)
            sequence.append((piece, a, a + take))
            if a + take < b:
                queue.append((piece, a + take, b))
            room -= take
        out.append(sequence)
    return out


PACKED = PIECE + ", length long, sequence_id long, offset long"


def _pack_shard(window: int, get):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(rows["shard"].iloc[0])
        rows = rows.assign(key=pd.to_numeric(rows["doc_id"]))
        rows = rows.sort_values(["key", "doc_id", "start", "ids"], kind="stable", ignore_index=True)
        pieces = [np.frombuffer(i, dtype="<u2") for i in rows["ids"]]
        sequences = [s for w in pack(pieces, window, get()) for s in split_last(w, window)]
        out = []
        doc_ids, tokens, starts = (rows[c].tolist() for c in ("doc_id", "doc_tokens", "start"))
        for number, sequence in enumerate(sequences):
            offset = 0
            for piece, a, b in sequence:
                ids = pieces[piece][a:b].astype("<u4").tobytes()
                out.append((doc_ids[piece], tokens[piece], starts[piece] + a, ids, b - a, (shard << 32) + number, offset))
                offset += b - a
        return pd.DataFrame(out, columns=["doc_id", "doc_tokens", "start", "ids", "length", "sequence_id", "offset"])

    return run


def packed(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """Pieces with their place: doc_id, doc_tokens, start, ids (little-endian 32 bits), length,
    sequence_id and offset. Each token lies in exactly one piece."""
    # Written with a name for each piece, which differs for equal rows too.
    name = F.xxhash64("doc_id", "start", F.monotonically_increasing_id())
    pieces = cut(tokenised(docs, path, window).withColumn("name", name))
    stats = statistics(pieces)
    get = shared(docs.sparkSession, stats)
    dealt = deal(pieces, stats, get, window).select("shard", *[f.split()[0] for f in PIECE.split(", ")])
    return dealt.groupBy("shard").applyInPandas(_pack_shard(window, get), PACKED).withColumn(
        "doc_id", F.col("doc_id").cast("long")
    )


def deal(pieces: DataFrame, stats: Statistics, get, window: int = WINDOW) -> DataFrame:
    """The pieces with their shard. Full windows need no neighbours and have shards of their own."""

    @F.pandas_udf("long")
    def keyed(ids: pd.Series, names: pd.Series) -> pd.Series:
        find = get().key
        keys = [find(np.frombuffer(i, dtype="<u2")) << 15 for i in ids]
        return pd.Series(np.array(keys, dtype=np.int64) | (names.to_numpy() & 0x7FFF), dtype="int64")

    whole = F.octet_length("ids") == 2 * window
    full = pieces.where(whole).count()
    rest = stats.count - full
    shards, full_shards = -(-rest // SHARD_PIECES), -(-full // SHARD_PIECES)
    edges = np.empty(0, dtype=np.int64)
    if shards > 1:
        drawn = F.pmod(F.shiftright("name", 20), F.lit(1 << 20)) < int((1 << 20) * min(1.0, SAMPLED / rest))
        sample = pieces.where(~whole & drawn).select(keyed("ids", "name").alias("key")).toPandas()["key"]
        found = np.sort(sample.to_numpy())
        edges = found[np.arange(1, shards) * len(found) // shards]
    cuts = shared(pieces.sparkSession, edges)

    @F.pandas_udf("long")
    def placed(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts(), keys.to_numpy(), side="right"), dtype="int64")

    remainders = pieces.where(~whole).withColumn("shard", placed(keyed("ids", "name")))
    own = F.lit(shards) + F.pmod("name", F.lit(max(1, full_shards)))
    return remainders.unionByName(pieces.where(whole).withColumn("shard", own.cast("long")))


def default_tokenizer() -> str:
    """Where the vocabulary file lies."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents."""
    return digest(packed(table(spark, sf_dir, "documents"), default_tokenizer()))
