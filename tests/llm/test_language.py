"""Scores against a plain version, held-out accuracy, and texts without letters."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyward.llm import language

SF_DIR = "/root/testdata/sf0.01"

TRAINING = [
    ("en", "the cat sat on the mat and the dog sat on the log"), ("en", "that is what the thing is"), ("de", "der Hund und die Katze sind in dem Haus"),
    ("de", "das ist nicht der Weg zu dem Wald"), (None, "le chat"), ("fr", None), ("fr", "le chat est sur la table et le chien est là"),
]


def plain(training, text):
    """Counts and scores without limits or remembered words."""
    words = {}
    for lang, t in training:
        if lang and t:
            words.setdefault(lang, Counter()).update(re.findall(r"[^\W\d_]+", t.lower()))
    langs = sorted(words)
    grams = {lang: {n: Counter() for n in range(1, 5)} for lang in langs}
    for lang in langs:
        for w, c in words[lang].items():
            for n in range(1, 5):
                for i in range(len(w) + 3 - n):
                    piece = f" {w} "[i : i + n]
                    if piece.strip():
                        grams[lang][n][piece] += c
    log = lambda table, x: [math.log((table[k].get(x, 0) + 0.5) / (sum(table[k].values()) + 0.5 * (len(set().union(*table.values())) + 1))) for k in langs]
    total = [0.0] * len(langs)
    found = re.findall(r"[^\W\d_]+", (text or "").lower())
    for w in found:
        if any(w in words[k] for k in langs):
            own = log(words, w)
        else:
            own = [0.0] * len(langs)
            for n in range(4, 0, -1):
                table = {k: grams[k][n] for k in langs}
                pieces = [p for p in (f" {w} "[i : i + n] for i in range(len(w) + 3 - n)) if any(p in table[k] for k in langs)]
                if pieces:
                    own = [sum(x) / len(pieces) for x in zip(*(log(table, p) for p in pieces))]
                    break
        total = [a + b for a, b in zip(total, own)]
    if not found:
        return "und", 0.0
    best = max(range(len(langs)), key=lambda i: (total[i], -i))
    return langs[best], 1 / sum(math.exp(max(t - total[best], -700)) for t in total)


def test_against_plain(spark):
    model = language.fit(spark.createDataFrame([(*r, 1) for r in TRAINING], "lang string, text string, score int"))
    texts = [None, "", "123 !?", "the dog", "Hundekatze", "xyz qqq", "thatch", "là", "Ω", "the der le " * 30000, "the dog"]
    frame = spark.createDataFrame([(i // 2, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang_pred string").coalesce(1)
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language.predict(frame, model).collect()]
    for (i, lang, score), at in zip(got, range(len(texts))):
        expected = plain(TRAINING, texts[at])
        assert (i, lang) == (at // 2, expected[0]) and score == pytest.approx(expected[1], abs=1e-9)
    few = language.Scorer(model, limit=4)
    for t in texts:
        expected = plain(TRAINING, t)
        lang, score = few.predict(t or "")
        assert lang == expected[0] and score == pytest.approx(expected[1], abs=1e-9)


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language.report(empty).count() == 0
    model = language.fit(empty)
    (row,) = language.predict(spark.createDataFrame([(1, "words")], "doc_id long, text string"), model).collect()
    assert (row["lang_pred"], row["score"]) == ("und", 0.0)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = language.report(docs).join(docs, "doc_id").where("held_out AND lang_pred != 'und'")
    right, n = found.select(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 150 and right / n >= 0.97


def test_all_words_and_pieces_are_kept(spark):
    """More words and n-grams than any list of frequent ones, some frequent in one language and rare in the other."""
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    rare = " ".join(name(i) for i in range(30_000))
    common = " ".join(f"{name(i)} {name(i)}" for i in range(21_000, 51_000))
    training = [("aa", rare), ("bb", common)]
    model = language.fit(spark.createDataFrame(training, "lang string, text string"))
    assert len(model.words) == 51_000
    scorer = language.Scorer(model)
    for text in (name(29_999), name(20_999), name(25_000), name(50_999), f"{name(100)} {name(22_000)}", name(29_998) + "q", "zzzq"):
        expected = plain(training, text)
        lang, score = scorer.predict(text)
        assert lang == expected[0] and score == pytest.approx(expected[1], abs=1e-9)
