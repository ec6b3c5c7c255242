"""The pipeline's near-duplicates against brute force over all pairs."""

import numpy as np

import corpus_pipeline
from tidemill.llm import resemblance, simhash


def similarity(a, b):
    a, b = (set(simhash.hashes(t.encode(), 5)) for t in (a, b))
    return len(a & b) / len(a | b)


def edited(rng, words, places):
    out = list(words)
    for i in rng.choice(len(out), places, replace=False):
        out[i] = f"new{rng.integers(1 << 40)}"
    return out


def test_every_pair_of_a_similarity_of_0_8_is_found(spark, monkeypatch):
    rng = np.random.default_rng(11)
    texts = []
    for _ in range(60):
        words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        texts += [" ".join(w) for w in (words, edited(rng, words, 4), edited(rng, words, 9))]
    hot = [f"h{x}" for x in rng.integers(0, 5000, 150)]
    texts += [" ".join(edited(rng, hot, 2)) for _ in range(60)]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if similarity(texts[i], texts[j]) >= 0.8]
    fps = simhash.fingerprinter(5)([t.encode() for t in texts])[0].view(np.uint64)
    assert sum(int(fps[i] ^ fps[j]).bit_count() > 6 for i, j in near) > 50  # beyond the former budget
    root = list(range(len(texts)))
    for i, j in near:
        a, b = sorted((root[i], root[j]))
        root = [a if r == b else r for r in root]
    own = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    for tile in (1_000_000, 2_000):  # whole groups, and groups in parts
        monkeypatch.setattr(resemblance, "TILE", tile)
        assert {r.id: r.component_id for r in resemblance.near_duplicates(own).collect()} == dict(enumerate(root))
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, own, "").collect()} == set(root)


def test_rows_of_repeated_and_null_ids_go_by_their_text(spark):
    one, two, three, four = (" ".join(f"{k}{i}" for i in range(20)) for k in "abcd")
    rows = [(1, one), (2, one), (2, two), (3, three), (3, four), (None, three), (None, "none"), (None, "none"), (4, None), (None, "")]
    own = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, own, "").collect()]
    assert sorted(got, key=str) == sorted([(1, one), (2, two), (3, three), (3, four), (None, "none"), (4, None)], key=str)
