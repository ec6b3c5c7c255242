"""Small cases of every operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names; brute force where SQL has no form."""

import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidemill.llm import hostrules, langid, licenses, mixing, packing, simhash, topk, wavelet

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, id long"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ROWS = [
    (1, "Released under the MIT License. call +1 (717) 555-0202 or 717-555-0202 a@b.example.com", "en", "a", 5, 0.1, 7),
    (2, None, None, None, None, None, None), (3, "", "fr", "a", 0, 0.1, 7), (None, "no id here at all", "en", "b", 3, 0.1, 7),
    (5, LONG, "en", "a", len(LONG), 0.1, 7), (6, "the cat sat on the mat", "en", "b", 3, 0.1, 7), (6, "the cat sat on the mat", "en", "b", 3, 0.1, 7),
    (7, "le chat est sur la table", "fr", "a", 3, 0.1, 7), (8, "12 !! 34", None, "a", 3, 0.1, 7), (9, " \n ", "en", "c", 3, 0.1, 7),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_licenses(docs, none):
    got = {r.doc_id: r for r in licenses.scan_licenses(docs, ["doc_id"]).collect()}
    assert (got[1].labels, got[1].base_labels, got[1].n_base, got[1].first_word) == ("mit", "mit", 1, 1)
    assert (got[2].n_words, got[2].labels, got[2].first_word, got[2].score) == (0, "", None, 0.0)
    assert got[5].n_words == 30_000
    assert licenses.scan_licenses(none, ["doc_id"]).count() == 0


@pytest.mark.parametrize(("text", "ok"), [
    ("a b c d", True), ("a c d", True), ("a b x y d", True), ("a x d", True), ("a b x y z d", False), ("b c d", False), ("q a b c d q", True), ("a b b d", True),
])
def test_template_regions(text, ok):
    template = "a <<beginOptional>>b <<endOptional>><<var;max=2>> d"
    words = text.encode().split()
    assert licenses.Automaton.compile("x", template).found(words) is ok
    assert bool(re.search(" " + licenses.as_regex(template), " " + text + " ")) is ok


def brute_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    places = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(places)


def test_host_rules(spark, docs, none):
    texts = ["a b c a b c a", "x\ny\nx\n\n \nx", " lead  a b c\td a b c ", "é# *é é# *é é#", None, "", "a a a a a", "one two", " ".join(f"{i % 90} {i % 7}" for i in range(800))]
    own = spark.createDataFrame([(i, t, "en", "h", 0, 0.0, 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r.id: r for r in hostrules.judge(own).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == brute_counts(t), t
    assert hostrules.judge(docs).count() == len(ROWS) and hostrules.judge(none).count() == 0
    bad = spark.createDataFrame([(i, LONG if i < 3 else "short", "en", "bad", 0, 0.0, 0) for i in range(300)] + [(1000 + i, " ".join(f"w{j}" for j in range(60)), "en", f"h{i % 3}", 0, 0.0, 0) for i in range(60)], SCHEMA)
    kept = {r.id: r.kept for r in hostrules.judge(bad).collect()}
    assert not kept[0] and kept[1000]  # a good document of a host that is turned down goes


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=40), st.lists(st.integers(0, 63), max_size=3), st.integers(0, 4))
def test_trie_join(values, flips, budget):
    near = [v ^ sum(1 << b for b in set(flips)) for v in values]
    own = np.unique(np.array(values + near, np.uint64))
    want = {(i, j) for i in range(len(own)) for j in range(i + 1, len(own)) if int(own[i] ^ own[j]).bit_count() <= budget}
    got = [(int(a), int(b)) for i, j in simhash.trie_join(own, None, budget, leaf=2, most=5) for a, b in zip(i, j)]
    assert len(got) == len(set(got)) and set(got) == want
    left, right = own[::2], own[1::2]
    cross = {(int(a), int(b)) for i, j in simhash.trie_join(left, right, budget, leaf=3) for a, b in zip(i, j)}
    assert cross == {(i, j) for i in range(len(left)) for j in range(len(right)) if int(left[i] ^ right[j]).bit_count() <= budget}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=60))
def test_forest(pairs):
    values = np.arange(31, dtype=np.uint64)
    groups = {i: {i} for i in range(31)}
    for a, b in pairs:
        if groups[a] is not groups[b]:
            groups[a] |= groups[b]
            for x in groups[b]:
                groups[x] = groups[a]
    a, b = simhash._forest(values, [(np.array([p[0]]), np.array([p[1]])) for p in pairs] + ([tuple(np.array(x) for x in zip(*pairs))] if pairs else []))
    root = dict(zip(a.tolist(), b.tolist()))
    assert all(root.get(i, i) == min(groups[i]) for i in range(31))


def test_near_duplicates(spark, docs, none):
    got = [(r.id, r.component_id) for r in simhash.near_duplicates(docs, 3, 2).collect()]
    assert len(got) == len(ROWS) and (6, 6) in got and {(2, 2), (3, 2), (9, 2)} <= set(got)
    assert simhash.near_duplicates(none).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.integers(-2, 3, 6) / 8]) for i in range(120)]
    rows += [(200, None), (250, [1.0, None]), (251, [float("nan")] * 6), (None, [1.0] * 6), (100, rows[100][1]), (300, [0.5, 0.5]), (301, [0.5, 0.5])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in topk.top_k(table, F.col("vec_id") % 50 == 0, 5, block=16, query_block=2).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    clean = {i: [math.floor(256 * x) for x in v] for i, v in rows if i is not None and v and None not in v and not any(map(math.isnan, v))}
    for q in (0, 50, 100, 300):
        all_of = sorted(((-sum(a * b for a, b in zip(clean[q], v)), i) for i, v in clean.items() if i != q and len(v) == len(clean[q])))[:5]
        assert got[q] == [(i, -s) for s, i in all_of]
    assert set(got) == {0, 50, 100, 300}
    assert topk.top_k(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_language_id(spark, docs, none):
    model = langid.fit(docs.filter("doc_id <> 5"), "text", "lang", "doc_id")
    rows = langid.identify(docs, model, ["doc_id"], prefix="_").collect()
    got = {r.doc_id: (r._lang_pred, r._score) for r in rows}
    assert got[6][0] == "en" and got[7][0] == "fr" and got[2] == got[3] == got[8] == got[9] == ("und", 0.0)
    with pytest.raises(ValueError, match="share names"):
        langid.identify(docs, model, ["score"])
    assert langid.identify(none, model, ["doc_id"]).count() == 0
    empty = langid.fit(none, "text", "lang", "doc_id")
    assert {r.lang_pred for r in langid.identify(docs, empty, ["doc_id"]).collect()} == {"und"}


def test_backoff_by_hand():
    own = langid.Marked.of(["cd"])
    of = {(size, int(p)): int(k) for size, at, keys in own.gram_keys() for p, k in zip(at, keys)}
    base = np.array([-9.0, -9.0])
    gram = lambda *items: langid.Counts(np.sort(np.array([k for k, _ in items], np.uint64)), np.arange(0, 2 * len(items) + 1, 2, dtype=np.int32), np.array([0, 1] * len(items), np.int16), np.array([x for _, v in sorted(items) for x in v], np.float32), base)
    two = gram((of[2, 0], (8.0, 6.0)), (of[2, 2], (7.0, 8.0)))  # "^c" and "d$"
    one = gram((of[1, 1], (4.0, 4.0)))  # "c"
    words = gram((int(langid.Marked.of(["ab"]).word_keys()[0]), (8.0, 7.0)))
    m = langid.Model(["x", "y"], words, [one, two, gram(), gram()])
    assert m.scores(["ab"]).tolist() == [[-1, -2]]
    # "^cd$": "^c", then "c", then "d$"
    assert m.scores(["cd"])[0].tolist() == pytest.approx([2 * (-1 - 5 - 2) / 3, 2 * (-3 - 5 - 1) / 3])


def test_wavelet_matrix():
    rng = np.random.default_rng(2)
    for tokens in (rng.integers(0, 49408, 3000), rng.integers(0, 5, 700), np.zeros(0, int), np.array([7]), np.full(50, 3)):
        tokens = tokens.astype(np.uint32)
        own = wavelet.WaveletMatrix(wavelet.build(np.array([1]), np.array([len(tokens)]), tokens))
        own.check()
        assert own.tokens().tolist() == tokens.tolist()
        for i in range(0, len(tokens), 97):
            t = int(tokens[i])
            places = np.flatnonzero(tokens == t)
            assert own.access(i) == t and own.count(t) == len(places) and own.rank(t, 0, i) == (places < i).sum()
            assert own.select(t, len(places) - 1) == places[-1] and next(own.locate(t)) == places[0]
        assert own.count(60000) == 0
    data = bytearray(wavelet.build(np.array([1]), np.array([3]), np.array([1, 2, 3])))
    data[-1] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        wavelet.WaveletMatrix(bytes(data)).check()


def encoded(name, end):
    library = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda t: library.encode(t or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_index(spark, docs, none, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = wavelet.index_documents(docs, f"file://{tmp_path}/a", path, 2, shard_docs=3, shard_tokens=500).orderBy("start").collect()
    ids, at = encoded("word_bpe_49k.json", 2), 0
    for row, r in zip(sorted(ROWS, key=lambda x: (x[0] is not None, x[0], x[1])), got, strict=True):
        own = ids(row[1])
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (row[0], at, len(own), crc(own))
        at += len(own)
    assert wavelet.index_documents(none, f"file://{tmp_path}/b", path, 2).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=40))
def test_best_fit_decreasing(lengths):
    rest, want = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [w for w, free in enumerate(rest) if free >= lengths[i]]
        w = min(fits, key=lambda w: rest[w], default=len(rest))
        if w == len(rest):
            rest.append(16)
        want[i] = rest[w]
        rest[w] -= lengths[i]
    got = packing.best_fit_decreasing(lengths, 16)
    assert [16 - o for _, o in got] == [want[i] for i in range(len(lengths))]  # the same capacities are met
    assert len({w for w, _ in got}) == len(rest)


def test_packing(docs, none):
    path, ids = public_tokenizers.path("byte_bpe_50k.json"), encoded("byte_bpe_50k.json", 0)
    got = packing.pack(docs, path, 0, shard_docs=4).collect()
    for row in ROWS:
        own, mine = ids(row[1]), sorted((r.start, r.length, r.ids_crc32, r.ids) for r in got if r.doc_id == row[0])
        if row[0] != 6:
            assert b"".join(bytes(m[3]) for m in mine) == np.array(own, "<u4").tobytes() and sum(m[1] for m in mine) == len(own)
            assert all(c == crc(own[a : a + n]) for a, n, c, _ in mine)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 1024
    assert packing.pack(none, path, 0).count() == 0


def test_mixing(spark, docs, none):
    assert set(mixing.mix(docs).columns) == {*SCHEMA.replace(" long", "").replace(" string", "").replace(" double", "").split(", "), "repeats", "copy", "shuffle_key"}
    assert mixing.mix(none).count() == 0
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x" * 10).alias("text"), F.when(F.col("id") < 3000, "a").otherwise("b").alias("source"))
    got = mixing.mix(many, weights={"a": 1.0, "b": 1.0}).groupBy("source").count().collect()
    assert {r.source: r["count"] for r in got} == {"a": pytest.approx(2000, rel=0.1), "b": pytest.approx(2000, rel=0.1)}
    heavy = mixing.mix(many.filter("doc_id < 20"), weights={"a": 1.0}, total=20 * 10 * 100.0)  # a mean of 100, in parts
    assert heavy.count() == pytest.approx(2000, rel=0.15)
    with pytest.raises(ValueError, match="prefix"):
        mixing.mix(docs.withColumn("copy", F.lit(1)))


def test_pipeline(spark, docs, none):
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, "")
        assert kept.columns == corpus_pipeline.COLUMNS, name
        if name == "language_id":
            assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 5, 6, 6, 7]
        if name == "near_duplicates":
            assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 5, 6, 7]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0, name
