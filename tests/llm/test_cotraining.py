"""Co-training against a plain version with dense rows, and on documents of two kinds."""

import zlib
from collections import Counter

import numpy as np
import pytest

from tidemill.llm import cotraining as co

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, id long"


def plain_text_row(text):
    tokens = (text or "").replace("\n", " ").split(" ")
    x = np.zeros(co.TEXT_DIMS)
    for k, n in Counter(zlib.crc32(t.lower().encode()) % 1024 for t in tokens).items():
        x[k] = n / len(tokens)
    for k, n in Counter(1024 + zlib.crc32(co.shape(t).encode()) % 256 for t in tokens).items():
        x[k] = n / len(tokens)
    lines = [s for s in (text or "").split("\n") if s]
    x[1280 + min(7, int(8 * (1 - len(set(lines)) / len(lines) if lines else 0)))] = 1
    x[1288 + min(7, int(np.log2(1 + len(tokens) / max(1, len(lines)))))] = 1
    return x.astype(np.float16).astype(np.float32)


def plain_meta_row(source, lang, n_chars):
    host, lang, n = source or "", lang or "", 0 if not n_chars or n_chars < 1 else min(31, int(n_chars).bit_length())
    h = lambda key, dims: zlib.crc32(key.encode()) % dims
    x = np.zeros(1024, np.float32)
    for place in (h(host, 64), 64 + h(lang, 32), 96 + n, 128 + h(f"{host}|{lang}", 256), 384 + h(f"{host}|{n}", 512), 896 + h(f"{lang}|{n}", 128)):
        x[place] = 1
    return x


def plain(rows, marks, rounds, grow):
    """Scores by id, and the numbers of labels given, from all rows in memory."""
    views = [{str(r[0]): plain_text_row(r[1]) for r in rows}, {str(r[0]): plain_meta_row(r[3], r[2], r[4]) for r in rows}]
    have = {str(i): y for i, y in marks.items() if str(i) in views[0]}
    order = lambda i: (zlib.crc32(i.encode()), i)
    held, learn = {}, {}
    for y in (0, 1):
        for k, i in enumerate(sorted((i for i in have if have[i] == y), key=order)):
            (learn if k % 4 else held)[i] = float(y)
    labels = [{i: (y, 1.0) for i, y in learn.items()} for _ in views]
    seen, log = set(have), []

    def models(even):
        out, ids = [], sorted(held)
        for v in (0, 1):
            own = sorted(labels[v])
            m = co.logistic(np.stack([views[v][i] for i in own]), np.array([labels[v][i][0] for i in own]), np.array([labels[v][i][1] for i in own]))
            z = np.array([views[v][i].astype(float) @ m.weights + m.bias for i in ids])
            out.append((m, co.platt(z[:, None], np.array([held[i] for i in ids]), even), z))
        return out

    def logit(m, v, i):
        return m[1][0] * (views[v][i].astype(float) @ m[0].weights + m[0].bias) + m[1][1]

    for _ in range(rounds):
        now, given, new = models(True), [0, 0], []
        for v in (0, 1):
            for y in (0, 1):
                p = {i: 1 / (1 + np.exp(-(2 * y - 1) * logit(now[v], v, i))) for i in views[0] if i not in seen}
                for i in sorted((i for i in p if p[i] >= co.LEAST_SURE), key=lambda i: (-p[i], i))[:grow]:
                    new.append((v, y, i, p[i]))
                    given[1 - v] += 1
        for v, y, i, p in new:
            labels[1 - v].setdefault(i, (float(y), 2 * p - 1))
            seen.add(i)
        log.append(tuple(given))
    final = models(False)
    ids = sorted(held)
    mixture = co.platt(np.column_stack([m[1][0] * m[2] + m[1][1] for m in final]), np.array([held[i] for i in ids]))
    scores = {i: 1 / (1 + np.exp(-(mixture[0] * logit(final[0], 0, i) + mixture[1] * logit(final[1], 1, i) + mixture[2]))) for i in views[0]}
    return scores, log


def documents(n, seed=0):
    rng = np.random.default_rng(seed)
    good, bad = ["good", "fine", "prose", "Text,", "well"], ["###", "$$$", "junk|", "fine", "x9"]
    return [(i, " ".join(rng.choice(good if i % 2 else bad, rng.integers(1, 40))) + ("\nagain\nagain" if i % 7 == 0 else ""), "en" if i % 3 else "fr", f"s{i % 2 if i % 5 else 3}", int(rng.integers(1, 5000)), 0.0, 0) for i in range(n)]


def test_training_is_the_plain_one(spark):
    rows = documents(90)
    marks = {i: i % 2 if i % 11 else 1 - i % 2 for i in range(40)}
    want, log = plain(rows, marks, 2, 4)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    model = co.fit(docs, spark.createDataFrame(list(marks.items()), "doc_id long, quality int"), rounds=2, grow=4)
    assert model.rounds == log and all(a and b for a, b in log)
    got = {str(r.doc_id): r.score for r in co.score(co.features(docs), model).collect()}
    assert got == {i: pytest.approx(p, abs=1e-3) for i, p in want.items()}


def test_two_kinds_of_documents(spark):
    many = spark.createDataFrame(documents(400), SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 200)] + [(None, 1), (1, None)], "doc_id long, quality int")
    model = co.fit(many, labels)
    assert model.rounds and all(a and b for a, b in model.rounds[:1])
    got = co.score(co.features(many), model).collect()
    assert np.mean([(r.score > 0.5) == bool(r.doc_id % 2) for r in got if r.doc_id >= 200]) > 0.97


def test_odd_rows(spark):
    rows = [(1, None, None, None, None, None, None), (None, "", "fr", "a", 0, 0.1, 7), (2, "w " * 60_000, "en", "a", 3, 0.1, 7), (3, "same", "en", "a", 3, 0.1, 7), (3, "same", "en", "a", 3, 0.1, 7), (3, "other", "en", "b", -3, 0.1, 7)]
    docs = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (3, 0), (9, 0)], "doc_id long, quality int")
    model = co.fit(docs, marks)
    got = co.score(co.features(docs), model).collect()
    assert len(got) == len(rows) and all(0 < r.score < 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 3}) == 2
    none = docs.limit(0)
    assert co.fit(none, marks) is None and co.fit(docs, marks.limit(0)) is None and co.score(co.features(none), model).count() == 0
    assert {r.score for r in co.score(co.features(docs), None).collect()} == {0.5}


def test_a_score_depends_on_its_row_alone():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["a", "B", "c9", "d,"], rng.integers(0, 30))) for _ in range(40)]
    weights = rng.normal(size=co.TEXT_DIMS)
    together = co.TextView().features(pa.array(texts)).dot(weights)
    for i, t in enumerate(texts):
        one = co.Sparse.unpacked(co.TextView().features(pa.array([t])).packed())
        assert one.dot(weights)[0] == together[i]
        assert (one.dense(co.TEXT_DIMS)[0] == plain_text_row(t)).all()
