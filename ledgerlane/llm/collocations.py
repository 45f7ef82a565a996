"""Phrase collocation mining by Toivonen's method.

A sample of the documents proposes phrases at a lowered threshold, level by level. One pass over all
documents then counts, exactly, the proposals and their negative border: every phrase whose two parts,
without its last and without its first word, are proposals. A phrase of the border that turns out
frequent is a failure of the sample: it joins the proposals, and an expansion pass counts what can be
reached through it. That pass takes all it counts for proposals at once, so it closes the expansion: a phrase
that is counted in neither pass has a part that is in neither, or that is not frequent. So no frequent phrase
is missed, whatever the sample.

Passes count names of phrases: 64 bits and 20 more, made from 64-bit hashes of the words. Counts are exact but
for two words of one hash, or two phrases of one name, which are counted as one. With its count each name keeps the mark of one document that
holds it, and a last pass spells a frequent phrase out only where it meets that mark: a phrase that every task
meets is not sent by every task. Which phrases are proposals, and which marks theirs, is asked of filters of at
most 16 MB: they let some others through, which are then counted or spelled too, and beyond some 10 million
proposals they save less work, but no phrase is lost by them.

Defined cases: a NULL text counts as empty, a NULL lang as ``und``; texts without words add nothing; equal
rows count as often as they stand there; ids and extra columns are ignored (NULL or repeated ids too);
ties in rank fall to the phrase, which is unique in its lang; an empty table gives an empty result; a
very long text is hashed in slices and counted in blocks that overlap by the longest phrase.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlane.llm.common import _PLACES, WordHashes, mix, small_batches, table
from ledgerlane.operators.scale import broadcast_if_small, cut

LEAST = 100
"""Occurrences that make a phrase frequent."""

LONGEST = 5
"""Words of the longest phrase."""

TOP = 2000
"""Phrases reported for each lang."""

SAMPLE = 8
"""One of so many documents proposes phrases. It only decides how many passes are needed."""

LOWERED = 0.5
"""The sample's threshold, as a share of what a phrase of ``LEAST`` occurrences has there on average."""

BLOCK_WORDS = 1 << 19
"""Words counted together in a task before anything is sent."""

SPELLED_WORDS = 1 << 17
"""Words held as text at a time where phrases are spelled out: fewer, as each word is an object there."""

HELD_PHRASES = 300_000
"""Phrases that a task remembers as sent before it starts anew."""

MORE_BITS = 20
"""Bits of a phrase's name beyond the first 64."""

MARKS = 1 << 15
"""Marks of documents; documents may share one."""

SLICE = 1 << 20
FILTER_BITS = (16, 27)
"""Least and most bits, as powers of two, of the filter of proposals."""

FEW_LANGS = 10_000
"""Langs whose sizes are broadcast; more are joined."""

_END = b"\xff"
"""Stands for the end of a piece. No UTF-8 text has this byte, so it is no word."""

_SPLIT = bytes(255 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))


def words_of(text: str | None) -> Iterator[list[bytes]]:
    """Lower-cased words of a text in slices; each piece ends with ``_END``."""
    raw = (text or "").encode("utf-8").lower().translate(_SPLIT)
    start = 0
    while start < len(raw):
        gap = raw.find(b" ", start + SLICE)
        end = len(raw) if gap < 0 else gap
        yield raw[start:end].replace(_END, b" \xff ").split()
        start = end
    yield [_END]


def hits(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which keys the filter lets through: it holds two bits of each of its own."""
    mask, hit = np.uint64(len(bits) * 64 - 1), np.ones(len(keys), dtype=bool)
    for place in (keys & mask, (keys >> np.uint64(32)) & mask):
        hit &= ((bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1)).astype(bool)
    return hit


class Windows:
    """Words of documents in a row, handed out in blocks with the runs that start in them."""

    def __init__(self, longest: int, keep_words: bool):
        self.ahead, self.keep_words, self.known = longest - 1, keep_words, WordHashes()
        self.most = min(BLOCK_WORDS, SPELLED_WORDS) if keep_words else BLOCK_WORDS
        self.words: list[bytes] = []
        self.hashes, self.langs, self.marks, self.held = [], [], [], 0
        self.names: list[str] = []

    def blocks(self, batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        """Hashes, langs, marks, words of each block and how many of them start runs of it.

        The last words of a block start runs of the next one, so texts may lie in many blocks.
        """
        for batch in batches:
            for lang, text, mark in zip(batch["lang"], batch["text"], batch["mark"]):
                if lang not in self.names:
                    self.names.append(lang)
                for words in words_of(text):
                    self._add(self.names.index(lang), mark, words)
                    if self.held >= self.most:
                        yield self._block(self.ahead)
        if self.held:
            yield self._block(0)

    def _add(self, lang: int, mark: int, words: list[bytes]) -> None:
        self.hashes.append(np.fromiter(map(self.known.__getitem__, words), dtype=np.uint64, count=len(words)))
        self.langs.append(np.full(len(words), lang, dtype=np.int32))
        self.marks.append(np.full(len(words), mark, dtype=np.int32))
        if self.keep_words:
            self.words += words
        self.held += len(words)

    def _block(self, ahead: int) -> tuple:
        hashes, langs, marks, words = *map(np.concatenate, (self.hashes, self.langs, self.marks)), self.words
        starts = len(hashes) - ahead
        self.hashes, self.langs, self.marks, self.words = [hashes[starts:]], [langs[starts:]], [marks[starts:]], words[starts:]
        self.held = ahead
        return hashes, langs, marks, words, starts


_BREAK = np.uint64(xxhash.xxh64_intdigest(_END))
_MORE_PLACES = mix(np.arange(101, 165, dtype=np.uint64)) | np.uint64(1)
"""Other odd factors for the places, for the bits beyond the first 64."""


def runs(
    hashes: np.ndarray, langs: np.ndarray, seeds: np.ndarray, longest: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For k = 1, 2, ...: k, the names of the runs of k words, their tags, and which runs lie within one piece.

    A tag is k and the bits of the name beyond the first 64. One lang's run and another's have different
    names. A text ends with a break, so no run leaves it.
    """
    total = more = seeds[langs]
    inside = np.ones(len(hashes), dtype=bool)
    for k in range(1, longest + 1):
        size = len(hashes) - k + 1
        if size <= 0:
            return
        total = total[:size] + hashes[k - 1 :] * _PLACES[k - 1]
        more = more[:size] + hashes[k - 1 :] * _MORE_PLACES[k - 1]
        inside = inside[:size] & (hashes[k - 1 :] != _BREAK)
        tags = (more >> np.uint64(64 - MORE_BITS)).astype(np.int32) * 8 + k
        yield k, mix(total + np.uint64(k)), tags, inside


def distinct(names: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct (name, tag) first stands, and how often it does; a name whose tags differ may
    be listed in several parts, whose counts add up."""
    order = np.argsort(names, kind="stable")
    sorted_names, sorted_tags = names[order], tags[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (sorted_names[1:] != sorted_names[:-1]) | (sorted_tags[1:] != sorted_tags[:-1])
    at = np.flatnonzero(new)
    return order[at], np.diff(np.append(at, len(order)))


def reached(level, k: int, names: np.ndarray, inside: np.ndarray, bits: np.ndarray | None):
    """Which runs are countable (both their parts are let through), and which of these are let through."""
    countable = inside if k == 1 else inside & level[: len(inside)] & level[1 : len(inside) + 1]
    through = np.zeros(len(names), dtype=bool)
    if bits is not None:
        at = np.flatnonzero(countable)
        through[at] = hits(names[at], bits)
    return countable, through


def _seeds(names: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(n.encode(), seed=1) for n in names], dtype=np.uint64)


def _counting(before, now, levels: range, longest: int):
    """Counts of the runs that are countable with the filter ``now``, and whether it lets them through.

    With ``before``: of those only that were not countable with it, and what they reach in their turn.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        old, new = before and before.value, now and now.value
        windows = Windows(longest, False)
        for hashes, langs, marks, _, starts in windows.blocks(batches):
            was = through = None
            for k, names, tags, inside in runs(hashes, langs, _seeds(windows.names), longest):
                fresh, through = reached(through, k, names, inside, new)
                if before is not None:
                    done, was = reached(was, k, names, inside, old)
                    fresh = fresh & ~done
                    through = through | fresh
                if k in levels:
                    at = np.flatnonzero(fresh[:starts])
                    first, n = distinct(names[at], tags[at])
                    spots = at[first]
                    yield pd.DataFrame(
                        {
                            "key": names[spots].view(np.int64),
                            "tag": tags[spots],
                            "known": through[spots],
                            "mark": marks[spots],
                            "n": n,
                        }
                    )

    return run


def _counts(docs: DataFrame, before, now, levels: range, least: float, longest: int) -> DataFrame:
    """key, tag, known, a mark and n of the runs with ``least`` occurrences; sums are combined before the shuffle."""
    sent = docs.mapInPandas(
        _counting(before, now, levels, longest), "key long, tag int, known boolean, mark int, n long"
    )
    return cut(
        sent.groupBy("key", "tag", "known").agg(F.sum("n").alias("n"), F.min("mark").alias("mark"))
        .where(F.col("n") >= least)
    )


def _filter(keys: DataFrame, power: int) -> np.ndarray:
    """Two bits of each key, in words of 64 bits: at most 16 MB whatever the number of keys."""
    bits = np.zeros(1 << (power - 6), dtype=np.uint64)
    mask = F.lit((1 << power) - 1).cast("long")
    places = [F.col("key").bitwiseAND(mask), F.shiftrightunsigned("key", 32).bitwiseAND(mask)]
    parts = (
        keys.select(F.explode(F.array(*places)).alias("place"))
        .groupBy(F.shiftright("place", 6).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 AS int)))").alias("bits"))
    )
    for row in parts.toLocalIterator():
        bits[row["word"]] = np.uint64(row["bits"] & ((1 << 64) - 1))
    return bits


def _power(count: int) -> int:
    return min(FILTER_BITS[1], max(FILTER_BITS[0], (32 * count).bit_length()))


def marked(key, mark):
    """The key of a name at a document's mark, for a filter; for columns and for arrays."""
    if isinstance(key, np.ndarray):
        place = mark.astype(np.uint64)
        return key ^ (place << np.uint64(1)) ^ (place << np.uint64(33))
    place = mark.cast("long")
    return key.bitwiseXOR(F.shiftleft(place, 1)).bitwiseXOR(F.shiftleft(place, 33))


def _naming(kept, at_marks, longest: int):
    """Words of the runs that the filter lets through, at the marks that the other one lets through; and for
    each lang, without a key, the number of its words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, mark_bits, windows, told, total = kept.value, at_marks.value, Windows(longest, True), set(), Counter()
        for hashes, langs, marks, words, starts in windows.blocks(batches):
            through = None
            for k, names, tags, inside in runs(hashes, langs, _seeds(windows.names), longest):
                _, through = reached(through, k, names, inside, bits)
                if k == 1:
                    every = np.bincount(langs[:starts][inside[:starts]], minlength=len(windows.names))
                    total.update({name: int(n) for name, n in zip(windows.names, every)})
                at = np.flatnonzero(through[:starts])
                at = at[hits(marked(names[at], marks[at]), mark_bits)]
                first, _ = distinct(names[at], tags[at])
                spots = [i for i in at[first].tolist() if (names[i], tags[i]) not in told]
                told.update((names[i], tags[i]) for i in spots)
                yield pd.DataFrame(
                    {
                        "lang": np.array([windows.names[x] for x in langs[spots].tolist()], dtype=object),
                        "phrase": np.array([b" ".join(words[i : i + k]).decode("utf-8") for i in spots], dtype=object),
                        "key": pd.array(names[spots].view(np.int64), dtype="Int64"),
                        "tag": tags[spots],
                        "n": np.zeros(len(spots), dtype=np.int64),
                    }
                )
            if len(told) > HELD_PHRASES:
                told.clear()
        yield pd.DataFrame(
            {
                "lang": np.array(list(total), dtype=object),
                "phrase": "",
                "key": pd.array([None] * len(total), dtype="Int64"),
                "tag": np.zeros(len(total), dtype=np.int32),
                "n": np.array(list(total.values()), dtype=np.int64),
            }
        )

    return run


def frequent_phrases(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, sample: int = SAMPLE
) -> tuple[DataFrame, int]:
    """lang, phrase, words, n of all phrases of 1 to ``longest`` words with n >= ``least``, and one row
    per lang with 0 words: the number of its words. Also the number of passes over all documents.
    """
    spark = docs.sparkSession
    small_batches(spark)
    named = F.xxhash64(*[c for c in ("doc_id", "text") if c in docs.columns])
    mark = F.pmod(F.shiftright(named, 32), F.lit(MARKS)).cast("int").alias("mark")
    texts = docs.select(
        F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"), mark
    )
    draw = F.pmod(named, F.lit(sample)) == 0
    drawn = cut(docs.where(draw).select(F.coalesce("lang", F.lit("und")).alias("lang"), "text", mark))
    send = spark.sparkContext.broadcast

    lowered = max(1.0, LOWERED * least / sample)
    proposed = held = bits = None
    for k in range(1, longest):
        level = _counts(drawn, None, held, range(k, k + 1), lowered, longest)
        proposed = level if proposed is None else proposed.unionByName(level)
        bits = _filter(proposed, _power(proposed.count()))
        if held is not None:
            held.destroy()
        held = send(bits)
    power = (64 * len(bits)).bit_length() - 1

    found = _counts(texts, None, held, range(1, longest + 1), least, longest)
    failed = found.where(~F.col("known") & (F.col("tag") % 8 < longest))
    passes = 1
    if not failed.isEmpty():
        passes = 2
        more = send(bits | _filter(failed, power))
        found = found.unionByName(_counts(texts, held, more, range(2, longest + 1), least, longest))
        more.destroy()
    held.destroy()

    count = found.count()
    kept = send(_filter(found, max(power, _power(count))))
    at_marks = send(_filter(found.select(marked(F.col("key"), F.col("mark")).alias("key")), _power(4 * count)))
    spelled = cut(
        texts.mapInPandas(_naming(kept, at_marks, longest), "lang string, phrase string, key long, tag int, n long")
    )
    kept.destroy()
    at_marks.destroy()
    phrases = (
        found.select("key", "tag", "n")
        .join(spelled.where("tag > 0").select("key", "tag", "lang", "phrase").dropDuplicates(["key", "tag"]), ["key", "tag"])
        .select("lang", "phrase", (F.col("tag") % 8).alias("words"), "n")
    )
    sizes = spelled.where("tag = 0").groupBy("lang").agg(F.sum("n").alias("n")).where("n > 0")
    exact = cut(phrases.unionByName(sizes.select("lang", F.lit("").alias("phrase"), F.lit(0).alias("words"), "n")))
    return exact, passes


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each lang's ``top`` phrases by their weakest cut."""
    phrases, _ = frequent_phrases(docs, least, longest)
    wide = "decimal(20,0)"
    candidates = phrases.where("words >= 2").select("lang", "phrase", "words", F.col("n").alias("a"))
    # A longer candidate as frequent as one of its two parts drops that part; parts of parts follow,
    # as whatever lies between has the same count.
    parts = candidates.where("words >= 3").select(
        "lang",
        F.col("a").alias("longer"),
        F.explode(
            F.array(
                F.expr("substring_index(phrase, ' ', words - 1)"),
                F.expr("substring_index(phrase, ' ', 1 - words)"),
            )
        ).alias("phrase"),
    ).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = candidates.join(parts, ["lang", "phrase"], "left").where("longer IS NULL OR longer < a").drop("longer")
    cuts = kept.select(
        "lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    ).withColumns(
        {
            "first": F.expr("substring_index(phrase, ' ', k)"),
            "rest": F.expr("substring_index(phrase, ' ', k - words)"),
        }
    )
    named = phrases.where("words >= 1")
    first = named.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    rest = named.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    size = broadcast_if_small(phrases.where("words = 0").select("lang", "n"), FEW_LANGS)
    scored = (
        cuts.join(first, ["lang", "first"]).join(rest, ["lang", "rest"]).join(size, "lang")
        .withColumn(
            "score",
            F.expr(
                f"cast(1000 * a as {wide}) * cast(n as decimal(18,0))"
                f" div (cast(l as {wide}) * cast(r as decimal(18,0)))"
            ),
        )
    )
    weakest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    rows = weakest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    # First within shares of a lang, whose number grows with the cluster, then among their first ones.
    shares = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(shares))).orderBy(*order)
    some = rows.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    whole = Window.partitionBy("lang").orderBy(*order)
    ranked = some.withColumn("rank", F.row_number().over(whole).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of all documents."""
    return collocations(table(spark, sf_dir, "documents"))


SQL = {
    "op13_collocations": r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), lists AS (
    SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w != '') AS w FROM pieces
), grams AS (
    SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2),
        lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
    FROM lists, range(1, 6) AS t(k) WHERE len(w) >= k
), counts AS (
    SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL
), frequent AS (
    SELECT * FROM counts WHERE f >= 100
), size AS (
    SELECT lang, sum(f) AS n FROM counts WHERE k = 1 GROUP BY lang
), candidates AS (
    SELECT lang, phrase, k AS words, f AS a, string_split(phrase, ' ') AS w FROM frequent WHERE k >= 2
), inside AS (
    SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS longer
    FROM candidates, range(2, 5) AS u(s), range(1, 5) AS v(i)
    WHERE s < words AND i + s - 1 <= words GROUP BY ALL
), kept AS (
    SELECT c.* FROM candidates c LEFT JOIN inside i USING (lang, phrase)
    WHERE i.longer IS NULL OR 100 * i.longer < 100 * c.a
), scored AS (
    SELECT c.lang, c.phrase, c.a, t.k AS k, l.f AS l, r.f AS r, n,
        CAST(1000 AS HUGEINT) * c.a * n // (CAST(l.f AS HUGEINT) * r.f) AS score
    FROM kept c, range(1, 5) AS t(k), frequent l, frequent r, size
    WHERE t.k < words AND l.lang = c.lang AND r.lang = c.lang AND size.lang = c.lang
        AND l.phrase = array_to_string(w[1:t.k], ' ') AND r.phrase = array_to_string(w[t.k + 1:words], ' ')
), weakest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
    phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM weakest QUALIFY rank <= 2000
""",
}
