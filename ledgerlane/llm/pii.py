"""Personal data: fixed patterns, and information-theoretic sanitisation of the terms around them.

Patterns find e-mail addresses, IP addresses, card and phone numbers. Their values are the
protected entities. Over the whole corpus, co-occurrence in documents then tells how strongly a term
reveals an entity: with N documents, n(k) with a key, n(t) with the term and n(k, t) with both,
``PMI(k; t) / IC(e)`` is the share of the entity's information that the term gives away (1: the term
occurs with this entity only). The keys of an entity are its own value and the groups it belongs to
(domain and words of an address, network, issuer, number range), so a rare entity is judged by what
its groups show; what a group tells is measured against the information of the entity itself.
Evidence is weighed by the number of different surroundings, so copies of one text prove nothing. A
term that is a part of the entity, as a name in an address, needs no such evidence.

A term above a threshold is disclosing in every document that holds the entity: each occurrence is
generalised to its shape, or removed where it gives away nearly everything.

Only documents with an entity give pairs, and only keys that can reach the threshold. Document counts
of their terms come from a pass over all documents, with a filter of bounded size that passes all of
them and few others.

Defined cases: a NULL text counts as empty and holds nothing; matches that fail their test (octets,
Luhn, digits) are dropped without a retry; repeated rows are one document in the counts near
entities and give repeated results; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.llm.common import shared, small_batches, table
from ledgerlane.operators.scale import cut

KINDS = ("email", "ip", "card", "phone")
NEAR_WORDS = 4
"""Words on each side of an entity that make its surroundings."""

SUPPORT = 3
"""Different surroundings from which on evidence counts in full; fewer count in proportion."""

GENERALISE, REMOVE = 0.6, 0.9
"""Shares of an entity's information from which a term beside it is generalised, or removed."""

FILTER_BITS = (16, 27)

# The patterns are fixed values; the guards before them only keep long runs linear.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_TERM = re.compile(r"\w+")
_LETTERS = re.compile(r"[a-z]+")
_REACH = 64
HELD = ("entities", "keys", "contexts", "own_entities", "own_terms", "terms", "starts", "ends")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free = 0
    for m in _DOMAIN.finditer(text):
        at, reach = m.start(), _REACH
        while True:
            low = max(free, at - reach)
            local = _LOCAL.search(text[low:at])
            if local is None or local.start() or low == free:
                break
            reach *= 8
        if local is not None:
            yield low + local.start(), m.end()
            free = m.end()


def _luhn(digits: str) -> bool:
    total = 0
    for k, digit in enumerate(map(int, reversed(digits))):
        total += digit if k % 2 == 0 else digit * 2 - 9 * (digit > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all base matches, by kind as listed and then by start."""
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = "".join(_DIGITS.findall(m.group()))
            if 16 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGITS.findall(m.group())) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def term_hash(term: str) -> int:
    """Signed 64 bits."""
    return xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass")) - (1 << 63)


def _value(kind: str, text: str) -> int:
    return term_hash(kind + ":" + (text.lower() if kind in ("email", "ip") else "".join(_DIGITS.findall(text))))


def _surroundings(text: str, start: int, end: int, taken: list[tuple[int, int]]) -> int:
    """Names the words on both sides of a span; words inside any span do not count."""
    low, high = max(0, start - 32 * NEAR_WORDS), min(len(text), end + 32 * NEAR_WORDS)
    before = [(m.start() + low, m.end() + low) for m in _TERM.finditer(text[low:start])]
    after = [(m.start() + end, m.end() + end) for m in _TERM.finditer(text[end:high])]
    if low and before and before[0][0] == low:
        before = before[1:]  # may be cut
    if high < len(text) and after and after[-1][1] == high:
        after = after[:-1]
    near = before[-NEAR_WORDS:] + after[:NEAR_WORDS]
    return term_hash(" ".join(text[a:b].lower() for a, b in near if not any(x < b and a < y for x, y in taken)))


def groups(kind: str, text: str) -> tuple[list[str], list[str]]:
    """The groups that an entity belongs to, and the terms that are parts of it."""
    if kind == "email":
        local, _, domain = text.lower().partition("@")
        words = sorted({w for w in _LETTERS.findall(local) if len(w) >= 3})
        return ["domain:" + domain, *["word:" + w for w in words]], words
    if kind == "ip":
        octets = [str(int(o)) for o in text.split(".")]
        return ["net:" + ".".join(octets[:2]), "net:" + ".".join(octets[:3])], []
    digits = "".join(_DIGITS.findall(text))
    return [f"{kind}:" + (digits[:6] if kind == "card" else digits[:-4]) + "*"], [digits[-4:]]


def held(text: str, spans: list[tuple[str, int, int]]) -> dict[str, list[int]]:
    """What a document with spans holds, as arrays.

    ``entities``, ``keys`` and ``contexts`` have an entry for each key of each distinct entity, the
    context being the least of its surroundings; ``own_entities`` and ``own_terms`` one for each part of
    an entity; ``terms``, ``starts`` and ``ends`` one for each term outside the spans.
    """
    out = {name: [] for name in HELD}
    if not spans:
        return out
    taken, edges = [], []
    for a, b in sorted((a, b) for _, a, b in spans):
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    edges = [b for _, b in taken]
    contexts, parts = {}, {}
    for kind, start, end in spans:
        entity = _value(kind, text[start:end])
        low, high = bisect_left(edges, start - 32 * NEAR_WORDS), bisect_left(edges, end + 32 * NEAR_WORDS) + 1
        context = _surroundings(text, start, end, taken[low:high])
        contexts[entity] = min(context, contexts.get(entity, context))
        parts[entity] = groups(kind, text[start:end])
    for entity, (names, terms) in parts.items():
        keys = [entity, *map(term_hash, names)]
        out["entities"] += [entity] * len(keys)
        out["keys"] += keys
        out["contexts"] += [contexts[entity]] * len(keys)
        out["own_entities"] += [entity] * len(terms)
        out["own_terms"] += map(term_hash, terms)
    known, place = {}, 0
    for m in _TERM.finditer(text):
        a, b = m.span()
        while place < len(taken) and taken[place][1] <= a:
            place += 1
        if place < len(taken) and taken[place][0] < b:
            continue
        term = m.group().lower()
        mark = known.get(term)
        if mark is None:
            mark = known[term] = term_hash(term)
        out["terms"].append(mark)
        out["starts"].append(a)
        out["ends"].append(b)
    return out


def _find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        spans = [base_spans(t or "") for t in batch["text"]]
        counts = [Counter(kind for kind, _, _ in s) for s in spans]
        found = [held(t or "", s) for t, s in zip(batch["text"], spans)]
        yield pd.DataFrame(
            {
                "row": batch["row"],
                "doc_id": batch["doc_id"],
                **{f"n_{kind}": [c[kind] for c in counts] for kind in KINDS},
                "base": [listed(s) for s in spans],
                **{name: [d[name] for d in found] for name in HELD},
            }
        )


def row_key() -> Column:
    """Names a document by its content, so that it is the same whenever a table is read again."""
    return F.xxhash64(F.col("doc_id").cast("string"), F.lit("|"), F.col("text"))


def find_base(docs: DataFrame) -> DataFrame:
    """Base spans of each document, and what it holds (``HELD``). Equal documents share a ``row``."""
    # Ids travel as text: pandas would turn whole numbers with gaps into floats.
    rows = docs.select(
        row_key().alias("row"), F.col("doc_id").cast("string").alias("doc_id"), "text"
    )
    return rows.mapInPandas(
        _find,
        "row long, doc_id string, n_email long, n_ip long, n_card long, n_phone long, base string, "
        + ", ".join(f"{name} array<long>" for name in HELD),
    ).withColumn("doc_id", F.col("doc_id").cast("long"))


class Wanted(dict):
    """Term to its hash, or None for terms that the filter rules out."""

    def __init__(self, words: np.ndarray, power: int):
        super().__init__()
        self.words, self.mask = words, (1 << power) - 1

    def __missing__(self, term: str) -> int | None:
        if len(self) >= 300_000:
            self.clear()
        mark = term_hash(term)
        found = mark
        for place in (mark & self.mask, (mark >> 32) & self.mask):
            if not int(self.words[place >> 6]) >> (place & 63) & 1:
                found = None
                break
        if len(term) <= 64:
            self[term] = found
        return found


def _filter_words(terms: DataFrame, count: int) -> tuple[np.ndarray, int]:
    """A Bloom filter of two bits per term, at most 16 MB whatever the input."""
    least, most = FILTER_BITS
    power = min(most, max(least, (16 * count).bit_length()))
    found = np.zeros(1 << (power - 6), dtype=np.uint64)
    size = F.lit(1 << power)
    places = F.array(F.pmod("term", size), F.pmod(F.shiftright("term", 32), size))
    words = (
        terms.select(F.explode(places).alias("place"))
        .groupBy(F.shiftright("place", 6).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 AS int)))").alias("bits"))
    )
    for row in words.toLocalIterator():
        found[row["word"]] = np.uint64(row["bits"] & ((1 << 64) - 1))
    return found, power


def document_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n_t: documents that hold each of the terms (distinct hashes), over all documents."""
    words, power = _filter_words(terms, terms.count())
    get = shared(docs.sparkSession, words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, totals = Wanted(get(), power), Counter()
        for batch in batches:
            for text in batch["text"]:
                distinct = set(_TERM.findall((text or "").lower()))
                totals.update({h for h in map(known.__getitem__, distinct) if h is not None})
            if len(totals) > 500_000:
                yield pd.DataFrame(totals.items(), columns=["term", "n_t"])
                totals.clear()
        yield pd.DataFrame(totals.items(), columns=["term", "n_t"])

    counted = docs.select("text").mapInPandas(run, "term long, n_t long")
    return counted.groupBy("term").agg(F.sum("n_t").alias("n_t")).join(terms, "term", "left_semi")


def _in_filter(marks: np.ndarray, words: np.ndarray, power: int) -> np.ndarray:
    """Which 64-bit numbers a filter of ``_filter_words`` passes."""
    passed, mask = np.ones(len(marks), dtype=bool), (1 << power) - 1
    for place in (marks & mask, (marks >> 32) & mask):
        passed &= (words[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) != 0
    return passed


def _pairs(documents: DataFrame, chosen: DataFrame, paired: bool) -> DataFrame:
    """row, entity, key, context, term: each key with each distinct term of its document.

    ``chosen`` has, in a column ``term``, the keys that are wanted, or if ``paired`` the numbers
    ``_pair`` of key and term; few others pass.
    """
    words, power = _filter_words(chosen, chosen.count())
    get = shared(documents.sparkSession, words)
    test = _in_filter

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = get()
        for batch in batches:
            out, count = [], 0
            for d in batch.itertuples(index=False):
                places, keys = np.arange(len(d.keys)), np.asarray(d.keys, dtype=np.int64)
                if not paired:
                    places = places[test(keys, words, power)]
                if not len(places):
                    continue
                terms = np.unique(np.asarray(d.terms, dtype=np.int64))
                for k in places.tolist():
                    kept = terms[test(keys[k] ^ (terms << 1), words, power)] if paired else terms
                    if len(kept):
                        out.append((kept, d.row, d.entities[k], keys[k], d.contexts[k]))
                        count += len(kept)
                    if count >= 200_000:
                        yield frame(out)
                        out, count = [], 0
            if out:
                yield frame(out)

    def frame(out: list[tuple]) -> pd.DataFrame:
        sizes = [len(o[0]) for o in out]
        columns = {name: np.repeat([o[i] for o in out], sizes) for i, name in enumerate(("row", "entity", "key", "context"), 1)}
        return pd.DataFrame({**columns, "term": np.concatenate([o[0] for o in out])})

    wide = documents.select("row", "entities", "keys", "contexts", "terms")
    return wide.mapInPandas(run, "row long, entity long, key long, context long, term long")


def _pair() -> Column:
    return F.col("key").bitwiseXOR(F.shiftleft("term", 1))


def disclosing(docs: DataFrame, documents: DataFrame) -> DataFrame:
    """row, term, share: how much of an entity's information a term of the same document gives away.

    ``documents`` are the distinct rows of ``find_base`` that hold an entity.
    """
    total = float(docs.count())
    entries = documents.select(
        "row", F.explode(F.arrays_zip("entities", "keys", "contexts")).alias("e")
    ).select("row", F.col("e.entities").alias("entity"), F.col("e.keys").alias("key"), F.col("e.contexts").alias("context"))
    # Two steps of counting, so that no task gets all rows of a key.
    once = entries.groupBy("key", "row").agg(F.min("context").alias("context"))
    sizes = cut(
        once.groupBy("key", "context").agg(F.count(F.lit(1)).alias("rows"))
        .groupBy("key").agg(F.sum("rows").alias("n_k"), F.count(F.lit(1)).alias("contexts"))
    )
    ic = F.log(total / F.col("n_k"))
    entities = sizes.select(F.col("key").alias("entity"), ic.alias("own"))
    # A key tells at most its own information: links that cannot reach the threshold are left out.
    links = (
        entries.select("entity", "key").distinct().join(entities, "entity")
        .groupBy("key").agg(F.min("own").alias("least_own"))
    )
    can = F.least(F.lit(1.0), F.col("contexts") / SUPPORT) * ic >= GENERALISE * F.col("least_own")
    keys = cut(sizes.join(links, "key").where(can & (F.col("least_own") > 0)))
    joint = cut(
        _pairs(documents, keys.select(F.col("key").alias("term")), False)
        .groupBy("key", "term", "row").agg(F.min("context").alias("context"))
        .groupBy("key", "term", "context").agg(F.count(F.lit(1)).alias("rows"))
        .groupBy("key", "term").agg(F.sum("rows").alias("n_kt"), F.count(F.lit(1)).alias("contexts"))
        .where(F.col("contexts") >= GENERALISE * SUPPORT)
    )
    own = documents.select(
        "row", "terms", F.explode(F.arrays_zip("own_entities", "own_terms")).alias("o")
    ).where(F.array_contains("terms", F.col("o.own_terms")))
    own = cut(own.select("row", F.col("o.own_entities").alias("entity"), F.col("o.own_terms").alias("term")))
    terms = cut(joint.select("term").union(own.select("term")).distinct())
    if terms.isEmpty():
        return own.select("row", "term", F.lit(0.0).alias("share")).limit(0)
    n_t = cut(document_counts(docs, terms))
    mutual = F.log(F.least("n_kt", "n_k", "n_t") * total / (F.col("n_k") * F.col("n_t")))
    told = F.least(F.lit(1.0), F.col("contexts") / SUPPORT) * mutual
    strong = cut(
        joint.join(keys.select("key", "n_k", "least_own"), "key").join(n_t, "term")
        .select("key", "term", told.alias("told"), "least_own")
        .where(F.col("told") >= GENERALISE * F.col("least_own"))
    )
    by_keys = (
        _pairs(documents, strong.select(_pair().alias("term")), True)
        .join(strong, ["key", "term"]).select("row", "entity", "term", "told")
    )
    by_parts = own.join(n_t, "term").select("row", "entity", "term", F.log(total / F.col("n_t")).alias("told"))
    share = F.when(F.col("own") > 0, F.least(F.lit(1.0), F.col("told") / F.col("own"))).otherwise(0.0)
    return (
        by_keys.unionByName(by_parts).join(entities, "entity")
        .groupBy("row", "term").agg(F.max(share).alias("share")).where(F.col("share") >= GENERALISE)
    )


def _placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for d in batch.itertuples(index=False):
            shares = {m["term"]: m["share"] for m in d.marks}
            out.append([(a, b, shares[t]) for t, a, b in zip(d.terms, d.starts, d.ends) if t in shares])
        found = [[{"start": a, "end": b, "share": s} for a, b, s in terms] for terms in out]
        yield pd.DataFrame({"row": batch["row"], "terms": found})


def find(docs: DataFrame) -> DataFrame:
    """row, doc_id, counts, ``base`` spans and ``terms``: all occurrences of disclosing terms.

    A term is (start, end, share).
    """
    small_batches(docs.sparkSession)
    base = cut(find_base(docs))
    documents = cut(base.where("base != ''").select("row", *HELD).dropDuplicates(["row"]))
    marks = (
        disclosing(docs, documents)
        .groupBy("row").agg(F.collect_list(F.struct("term", "share")).alias("marks"))
    )
    terms = documents.select("row", "terms", "starts", "ends").join(marks, "row").mapInPandas(
        _placed, "row long, terms array<struct<start: long, end: long, share: double>>"
    )
    return base.drop(*HELD).join(cut(terms), "row", "left")


def shape(term: str) -> str:
    """A term with its letters and digits made general."""
    return re.sub(r"[^\W\d_]", "x", re.sub(r"[0-9]", "0", term))


def sanitised(text: str, base: list[tuple[str, int, int]], terms) -> str:
    """The text with base spans replaced by their kind and disclosing terms generalised or removed."""
    edits = [(a, b, f"<{kind.upper()}>") for kind, a, b in base]
    edits += [(t["start"], t["end"], "" if t["share"] >= REMOVE else shape(text[t["start"] : t["end"]])) for t in terms]
    out, free = [], 0
    for a, b, put in sorted(edits):
        if a >= free:
            out += [text[free:a], put]
            free = b
        elif b > free:  # spans of two kinds may overlap
            free = b
    return "".join([*out, text[free:]])


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents with clean texts and their new n_chars; other columns stay. NULL texts stay."""
    found = find(docs)
    terms = found.where("terms IS NOT NULL").select("row", "terms")
    # The input's columns travel in one, so that their names cannot meet those used here.
    rows = docs.select(row_key().alias("row"), F.struct(*docs.columns).alias("doc")).join(terms, "row", "left")
    empty = F.array().cast("array<struct<start: long, end: long, share: double>>")

    @F.pandas_udf("string")
    def clean(texts: pd.Series, terms: pd.Series) -> pd.Series:
        return pd.Series(
            [None if t is None else sanitised(t, base_spans(t), list(x)) for t, x in zip(texts, terms)],
            dtype=object,
        )

    rows = rows.withColumn("clean", clean("doc.text", F.coalesce("terms", empty)))
    new = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("clean").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of all documents."""
    found = find(table(spark, sf_dir, "documents"))
    extra = F.array_join(
        F.transform("terms", lambda t: F.concat(F.lit("term:"), t["start"].cast("string"), F.lit(":"), t["end"].cast("string"))), ","
    )
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.size("terms") > 0, extra))
    return found.select(
        "doc_id", *[f"n_{kind}" for kind in KINDS],
        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), spans.alias("spans"),
    )
