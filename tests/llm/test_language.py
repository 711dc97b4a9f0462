"""Language identification: n-grams by hand, sampling, held-out accuracy, and edge cases."""

import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, language
from tidemark.llm.queries import op13_language

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain_grams(text):
    """n-grams as strings: a word's letters, with a space after each word and before all but a letterless start."""
    out, marks = [], ""
    for c in (text or "").lower() + "\n":
        if c.isalpha():
            marks += c
        elif marks and marks[-1] != " ":
            marks += " "
    padded = "  " + marks
    for i, c in enumerate(marks):
        before = padded[i + 1]
        out += [c] * (c != " ")
        out += [before + c] if c != " " or before != " " else []
        out += [padded[i] + before + c] if before != " " else []
    return out


@pytest.mark.parametrize("text", ["", "  ", "a", "Ab c", "Été, l'été!\n2 x", "...a..b", "日本語 テスト", "x" * 50])
def test_grams(text):
    owner, bins, times = language.occurrences([text, "between", text])
    want = sorted(Counter(plain_grams(text)).values())
    for i in (0, 2):
        assert len(bins[owner == i]) == len(plain_grams(text))
        assert sorted(Counter(bins[owner == i].tolist()).values()) == want
    assert np.array_equal(np.sort(bins[owner == 0]), np.sort(bins[owner == 2]))


def test_pieces(monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choice("abç é.\nΩ1") for _ in range(5000))
    whole = language.counts(text)
    monkeypatch.setattr(language, "PIECE", 7)
    assert np.array_equal(language.counts(text), whole)
    owner, bins, times = language.occurrences(["short", text])
    assert np.array_equal(np.bincount(bins[owner == 1], times[owner == 1], minlength=language.BINS), whole)


def made(rng, letters, n=60):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


ALPHABETS = {"en": "thewo", "de": "schui", "nl": "vijkg", "fr": "éleau", "es": "ñosar", "zz": "qxzwk"}


def test_hierarchy(spark):
    rng = random.Random(5)
    docs = [(i, made(rng, ALPHABETS[lang]), lang, "s") for i, lang in enumerate(list(ALPHABETS) * 40)]
    extra = [(900, None, "en", "s"), (901, "123 ...", "de", None), (902, "thewo " * 200000, None, "s"), (None, made(rng, ALPHABETS["fr"]), "fr", "s"), docs[0]]
    df = spark.createDataFrame(docs + extra, "doc_id long, text string, lang string, h string")
    model = language.train(df.where("doc_id < 200"))
    assert model.families == {"germanic": ["de", "en", "nl"], "romance": ["es", "fr"], "other": ["zz"]}
    assert set(model.of_pair) == {("de", "en"), ("de", "nl"), ("en", "nl"), ("es", "fr")}
    got = language.predict(df, model).collect()
    assert len(got) == len(docs) + len(extra)
    by_id = {r.id: r for r in got}
    assert all(by_id[d[0]].lang_pred == d[2] and 0.5 < by_id[d[0]].score <= 1 for d in docs)
    assert [by_id[i].lang_pred for i in (900, 901, 902, None)] == ["und", "und", "en", "fr"] and by_id[900].score == by_id[901].score == 0


def test_little_or_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "abc", "en"), (2, "xyz", None), (3, "", "fr")], "doc_id long, text string, lang string")
    one = {r.id: r.lang_pred for r in language.predict(df, language.train(df)).collect()}
    assert one == {1: "en", 2: "en", 3: "und"}
    nothing = language.train(df.limit(0))
    assert not nothing.families and {r.lang_pred for r in language.predict(df, nothing).collect()} == {"und"}
    assert language.predict(df.limit(0), nothing).count() == 0


def test_sample_is_bounded_and_counts_copies_once(spark):
    rng = random.Random(6)
    rows = [(i, made(rng, ALPHABETS["en"], 3), "en") for i in range(400)] + [(1000 + i, "copy of one text", "en") for i in range(3000)] + [(5000, "éle eau", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    seen = []
    real = language.fit
    try:
        language.fit = lambda sample: seen.append(sample) or real(sample)
        language.train(df, sample=50)
        language.train(df.repartition(3), sample=50)
    finally:
        language.fit = real
    assert [Counter(s[0] for s in x) for x in seen] == [{"en": 50, "fr": 1}] * 2
    assert all(a[0] == b[0] and np.array_equal(a[1], b[1]) for a, b in zip(*seen))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_held_out(spark):
    """Of the held-out texts with 20 letters or more, at least 98 of 100 are right."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = op13_language(spark, DATA)
    rest = docs.where((common.remainder(F.col("doc_id"), 4) == 2) & (F.length(F.regexp_replace("text", r"\P{L}", "")) >= 20))
    both = rest.join(found.where("held_out"), "doc_id").agg(F.count("*").alias("n"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right")).first()
    assert both.n >= 40 and both.right >= 0.98 * both.n
