"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
"""Words in a shingle."""

SLICE_BYTES = 1 << 20
"""Texts are hashed in slices of about this size, so that a very long text needs little memory."""

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
KNOWN_WORDS = 300_000
"""Words whose hashes a task remembers; it starts anew beyond that."""


class WordHashes(dict):
    """Word bytes to their 64-bit hash, remembered while there is room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        found = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = found
        return found


BATCH_ROWS = 1000
"""Documents that a Python worker gets at a time."""


def small_batches(spark: SparkSession) -> None:
    """Whole texts are large rows: hand them to Python workers in small batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) != BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession, value) -> Callable[[], object]:
    """Broadcast an object of bounded size to tasks; a worker unpacks it once and keeps it.

    It is pickled by value, as executors have no copy of this package.
    """
    sent = spark.sparkContext.broadcast([cloudpickle.dumps(value)])

    def get():
        box = sent.value
        if len(box) == 1:
            box.append(cloudpickle.loads(box[0]))
        return box[1]

    return get


def fold(key: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``. NULL for a NULL id."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; one to one."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def word_hashes(text: str | None, known: WordHashes | None = None) -> np.ndarray:
    """A 64-bit hash of each word ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, in order.

    Both lower() and split() of bytes know ASCII letters and white space only.
    """
    known = WordHashes() if known is None else known
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    parts, start = [], 0
    while start < len(raw):
        gap = _SPACE.search(raw, start + SLICE_BYTES) if len(raw) > start + SLICE_BYTES else None
        end = gap.start() if gap else len(raw)
        words = raw[start:end].split()
        parts.append(np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words)))
        start = end
    return np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)


_PLACES = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
"""An odd factor for each place of a shingle."""


def shingle_hashes(words: np.ndarray, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of all runs of ``size`` words, in order and with repeats.

    Fewer words make one shingle of the whole sequence; no words make none.
    """
    count = len(words)
    if count == 0:
        return words
    width = min(size, count)
    total = np.zeros(count - width + 1, dtype=np.uint64)
    for i in range(width):
        total += words[i : count - width + 1 + i] * _PLACES[i]
    return mix(total + np.uint64(width))


def shingle_set(
    text: str | None, known: WordHashes | None = None, size: int = SHINGLE_WORDS
) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(shingle_hashes(word_hashes(text, known), size))
