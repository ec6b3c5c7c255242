"""Language ID against plain counting with dictionaries, from the table to the prediction."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import langid

SF = "/root/testdata/sf0.01"


def plain_words(text):
    return [w for w in re.split(r"[^a-zß-öø-ÿœ]+", (text or "").lower()) if w]


def plain_grams(word):
    marked = f"^{word}$"
    return [marked[i : i + n] for n in range(1, 5) for i in range(len(marked) - n + 1) if marked[i : i + n] not in "^$"]


class Plain:
    """The method with dictionaries of strings, one word at a time."""

    def __init__(self, rows):
        self.words, self.grams = defaultdict(Counter), defaultdict(Counter)
        for lang, text in rows:
            for w in plain_words(text):
                self.words[lang][w] += 1
                for g in plain_grams(w):
                    self.grams[lang, len(g)][g] += 1
        self.langs = sorted(self.words)
        self.n_words = len(set().union(*self.words.values()))
        self.n_grams = {k: len(set().union(*(self.grams[x, k] for x in self.langs))) for k in range(1, 5)}

    def log(self, lang, item, size):
        own, n = (self.words[lang], self.n_words) if not size else (self.grams[lang, size], self.n_grams[size])
        return math.log((own[item] + 0.1) / (sum(own.values()) + 0.1 * n))

    def word(self, w):
        if any(w in self.words[x] for x in self.langs):
            return [self.log(x, w, 0) for x in self.langs]
        marked, total = f"^{w}$", [0.0] * len(self.langs)
        for i in range(len(marked) - 1):
            known = next((g for n in range(min(4, len(marked) - i), 0, -1) if any((g := marked[i : i + n]) in self.grams[x, n] for x in self.langs)), None)
            total = [t + (self.log(x, known, len(known)) if known else -12.0) for t, x in zip(total, self.langs)]
        return [2 * t / (len(marked) - 1) for t in total]

    def predict(self, text):
        found = [self.word(w) for w in plain_words(text)]
        if not found:
            return "und", 0.0
        total = [sum(c) for c in zip(*found)]
        best = max(range(len(total)), key=lambda k: (total[k], -k))
        return self.langs[best], 1 / sum(math.exp((t - total[best]) / math.sqrt(len(found))) for t in total)


def test_fit_and_prediction_are_those_of_plain_counting(spark):
    latin = F.col("text").isNull() | ~F.col("text").rlike(r"[^\x00-ÿœŒ]|[ªµº]")  # where the plain words above are the letters
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter(latin & (F.coalesce(F.length("text"), F.lit(0)) < 1500) & (F.col("doc_id") < 400))
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 7 > 0, F.col("lang")))
    model = langid.fit(docs, "text", "lang", "doc_id")
    rows = docs.collect()
    plain = Plain([(r.lang, r.text) for r in rows if r.lang and r.text is not None])
    assert model.languages == plain.langs and len(model.words.keys) == plain.n_words and {k + 1: len(g.keys) for k, g in enumerate(model.grams)} == plain.n_grams
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, model, ["doc_id"]).collect()}
    unknown = 0
    for r in rows:
        lang, score = plain.predict(r.text)
        assert got[r.doc_id] == (lang, pytest.approx(score, abs=1e-5)), r.doc_id
        unknown += any(w not in plain.words[x] for w in plain_words(r.text) for x in plain.langs)
    assert unknown > 20


def test_a_prediction_depends_on_its_text_alone():
    rng = np.random.default_rng(5)
    names = ["x", "y", "z"]
    words = [f"w{chr(97 + a)}{chr(97 + b)}" for a in range(26) for b in range(26)]
    keys = langid.Marked.of(words).word_keys()
    pick = np.sort(rng.choice(len(words), 300, replace=False))
    lang = rng.integers(0, 3, 300)
    counts = langid.Counts.of(keys[pick], lang, rng.integers(1, 90, 300), np.bincount(lang, minlength=3) * 40.0)
    none = langid.Counts.of(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0), np.ones(3))
    predict = langid.predictor(langid.Model(names, counts, [none] * 4))
    import pyarrow as pa

    texts = [" ".join(rng.choice(words, rng.integers(0, 40))) for _ in range(50)]
    together = predict(pa.array(texts))
    for i, text in enumerate(texts):
        assert predict(pa.array([text])) == [[together[0][i]], [together[1][i]]]  # to the last bit


def test_no_two_words_or_grams_of_a_table_share_a_hash(spark):
    words = sorted({w for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect() for w in plain_words(r.text)})
    own = langid.Marked.of(words)
    assert len(np.unique(own.word_keys())) == len(words)
    found = defaultdict(set)
    owners = own.owners()
    for size, at, keys in own.gram_keys():
        for place, key in zip(at.tolist(), keys.tolist()):
            i = place - own.starts[owners[place]]
            found[key].add(f"^{words[owners[place]]}$"[i : i + size])
    assert all(len(g) == 1 for g in found.values()) and {g for s in found.values() for g in s} == {g for w in words for g in plain_grams(w)}


def test_rows_without_letters_languages_or_ids(spark):
    docs = spark.createDataFrame([(1, "the cat", "en"), (None, "le chat", "fr"), (None, "12 !!", "de"), (4, None, "en"), (5, "", None), (6, "cat " * 5000, None)], "doc_id long, text string, lang string")
    model = langid.fit(docs, "text", "lang", "doc_id")
    assert model.languages == ["en", "fr"]  # a language without words can't be told
    got = {(r.doc_id, r.text and r.text[:6]): (r.lang_pred, r.score) for r in langid.identify(docs, model, ["doc_id", "text"]).collect()}
    assert got[4, None] == got[5, ""] == got[None, "12 !!"] == ("und", 0.0)
    assert got[6, "cat ca"][0] == got[1, "the ca"][0] == "en" and got[None, "le cha"][0] == "fr"
