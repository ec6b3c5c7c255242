"""The pipeline over whole small tables, each stage against plain code on what the one before it kept."""

import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
from test_langid import Plain
from test_resemblance import similarity
from tokenizers import Tokenizer

import corpus_pipeline
from tidemill.llm import langid, mixing, pii
from tidemill.runtime import cut

SF = "/root/testdata/sf0.001"
PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"(?<![0-9.])[0-9]{1,2}(\.[0-9]{1,2}){3}(?![0-9.])", r"\+[0-9][\x20().0-9-]{10,13}[0-9]"]


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's rows, from ``documents`` on."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SF))
        out.append((name, docs))
    return {name: df.collect() for name, df in out}


def test_language(spark, stages):
    rows = stages["documents"]
    held = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").filter(langid.held_out()).collect()}
    plain = Plain([(r.lang, r.text) for r in rows if r.lang and r.text is not None and r.doc_id not in held])
    want = {r.doc_id for r in rows if (p := plain.predict(r.text))[0] != "und" and p[1] >= corpus_pipeline.LEAST_LANGUAGE_SCORE}
    assert {r.doc_id for r in stages["language_id"]} == want and len(stages["language_id"]) == len(want)


def test_near_duplicates(stages):
    rows = sorted(stages["language_id"], key=lambda r: r.doc_id)
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = len(rows[i].text.split()), len(rows[j].text.split())
            if root[i] != root[j] and min(a, b) >= 0.6 * max(a, b) and similarity(rows[i].text, rows[j].text) >= 0.8:
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    want = [rows[i] for i in range(len(rows)) if root[i] == i]
    assert sorted(stages["near_duplicates"]) == sorted(want) and len(want) < len(rows)


def test_personal_data(stages):
    before = {r.doc_id: r for r in stages["near_duplicates"]}
    assert len(before) == len(stages["personal_data"])
    masked = 0
    for r in stages["personal_data"]:
        own = before[r.doc_id]
        assert r.n_chars == len(r.text) and (r.lang, r.source) == (own.lang, own.source)
        assert not any(re.search(p, r.text) for p in PATTERNS)
        spans = pii.base_spans(own.text)
        if spans:
            masked += 1
            assert all(own.text[a:b] not in r.text or len(own.text[a:b]) < 8 for _, a, b in spans)
        elif not re.search("[0-9@]", own.text):
            assert r.text == own.text
    assert masked


def test_mixing(spark, stages, tmp_path):
    spark.createDataFrame(stages["personal_data"], spark.read.parquet(f"{SF}/documents.parquet").schema).write.parquet(f"file://{tmp_path}/d")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    want = con.sql(f"select doc_id, text, lang, source, n_chars from ({mixing.sql()})").fetchall()
    assert sorted(map(tuple, stages["mixing"])) == sorted(want)


def test_packing(stages):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for r in stages["mixing"]:
        ids = library.encode(r.text, add_special_tokens=False).ids + [0]
        want.setdefault(r.doc_id, []).append(np.array(ids, "<u4").tobytes())
    got, sequences = {}, {}
    for r in stages["packing"]:
        got.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, texts in want.items():  # equal copies: each start as often as there are copies
        pieces = sorted(got[doc])
        assert b"".join(p for _, p in pieces[:: len(texts)]) == texts[0] and len(set(texts)) == 1 and len(pieces) % len(texts) == 0
    assert set(got) == set(want)
    for own in sequences.values():
        assert sum(n for _, n in own) <= 1024 and [o for o, _ in sorted(own)] == np.cumsum([0, *[n for _, n in sorted(own)]])[:-1].tolist()


def test_the_run_is_its_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(r.ids for r in got.select("ids").collect()) == sorted(r.ids for r in stages["packing"])
