import random
import re
from collections import Counter

from pyspark.sql import types as T

from ledgerlane.llm import collocations
from tests.llm.conftest import edge_rows, prose

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
COLUMNS = T.StructType([T.StructField(n, T.StringType()) for n in ("text", "lang", "phrase", "n", "key", "words")])


def counts(rows, longest=5):
    found, size = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            size[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    found[lang or "und", tuple(words[i : i + k])] += 1
    return found, size


def plain(rows, least, top):
    found, size = counts(rows)
    often = {p: a for p, a in found.items() if a >= least and len(p[1]) > 1}
    out = {}
    for (lang, words), a in often.items():
        inside = any(
            o[0] == lang and len(o[1]) > len(words) and b >= a
            and any(o[1][i : i + len(words)] == words for i in range(len(o[1])))
            for o, b in often.items()
        )
        if inside:
            continue
        cut = min(
            (1000 * a * size[lang] // (found[lang, words[:k]] * found[lang, words[k:]]), k) for k in range(1, len(words))
        )
        l, r = found[lang, words[: cut[1]]], found[lang, words[cut[1] :]]
        out.setdefault(lang, []).append((-cut[0], -a, " ".join(words).encode(), l, r))
    return sorted(
        (lang, rank, phrase.decode(), -a, l, r, size[lang], -score)
        for lang, rows_ in out.items()
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows_)[:top], 1)
    )


def mined(spark, rows, least, top):
    docs = spark.createDataFrame([(t, g, "p", "n", "k", "w") for t, g in rows], COLUMNS)
    return sorted(tuple(r) for r in collocations.collocations(docs, least, top=top).collect())


def corpus():
    rng = random.Random(11)
    rows = [(prose(i, rng.randint(0, 90)), rng.choice(["en", "de", None])) for i in range(150)]
    rows += [(f"Alpha beta gamma delta epsilon zeta; {prose(900 + i, 6)}! alpha\tbeta gamma", "en") for i in range(40)]
    rows += [("ab ab ab ab ab ab", None), ("x " * 30, "de"), ("a\x00b été a\x00b été", "fr")] * 9
    return rows + [(t, "en") for _, t in edge_rows()[:-3]]


def test_phrases_equal_counting_everything(spark, monkeypatch):
    rows = corpus()
    assert mined(spark, rows, 8, 2000) == plain(rows, 8, 2000)
    # Small blocks, few held phrases, and few reported ones.
    monkeypatch.setattr(collocations, "BLOCK_WORDS", 64)
    monkeypatch.setattr(collocations, "HELD_PHRASES", 5)
    monkeypatch.setattr(collocations, "SLICE", 16)
    assert mined(spark, rows, 8, 7) == plain(rows, 8, 7)


def test_a_sample_that_proposes_nothing_loses_nothing(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame([(t, g, "p", "n", "k", "w") for t, g in rows], COLUMNS)
    monkeypatch.setattr(collocations, "LOWERED", 1e9)
    phrases, passes = collocations.frequent_phrases(docs, 8)
    assert passes == 2
    found, _ = counts(rows)
    want = {(lang, " ".join(w)): n for (lang, w), n in found.items() if n >= 8}
    assert {(r.lang, r.phrase): r.n for r in phrases.where("words > 0").collect()} == want


def test_empty_table(spark):
    assert mined(spark, [], 1, 10) == []


def test_text_of_one_long_document(spark):
    rows = [(prose(7, 60_000), "en")]
    assert mined(spark, rows, 60, 50) == plain(rows, 60, 50)


def test_a_phrase_that_every_task_meets_is_spelled_once(spark, monkeypatch):
    rows = [(f"alpha beta gamma. own{i} beta", "en") for i in range(160)]
    docs = spark.createDataFrame([(t, g, "p", "n", "k", "w") for t, g in rows], COLUMNS).repartition(8)
    sent, cut = [], collocations.cut

    def counted(df):
        done = cut(df)
        if "phrase" in done.columns:
            sent.append(done.where("phrase != ''").count())
        return done

    monkeypatch.setattr(collocations, "cut", counted)
    phrases, _ = collocations.frequent_phrases(docs, 100)
    assert {(r.phrase, r.words, r.n) for r in phrases.where("words > 0").collect()} == {
        ("alpha", 1, 160), ("beta", 1, 320), ("gamma", 1, 160),
        ("alpha beta", 2, 160), ("beta gamma", 2, 160), ("alpha beta gamma", 3, 160),
    }
    # What a task spells out is written once (first), then the frequent phrases.
    assert sent == [6, 6]


def test_words_are_held_as_text_in_small_blocks():
    import pandas as pd

    texts = [" ".join(f"w{i % 97}" for i in range(1000))] * 400
    batch = pd.DataFrame({"lang": "en", "text": texts, "mark": 1})
    blocks = list(collocations.Windows(collocations.LONGEST, True).blocks(iter([batch])))
    # Counting held half a million words and more at a time; as objects that many take a task's memory.
    assert max(len(words) for _, _, _, words, _ in blocks) <= 150_000
    assert sum(starts for *_, starts in blocks) == 400 * 1001
