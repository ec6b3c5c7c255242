"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut, shared_path
from .arrow import bound_batches
from . import cotraining, hostrules, langid, licenses, mixing, packing, pii, simhash, topk, wavelet


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table; the session gets bounded Arrow batches where it has Spark's defaults."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), ["doc_id"])


def op2_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    made = cut(cotraining.features(docs))
    model = cotraining.fit(docs, table(spark, sf_dir, "labels"), made=made)
    return cotraining.score(made, model).withColumn("kept", F.col("score") >= 0.5)


def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hostrules.judge(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, budget=2)
    return rows.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(~langid.held_out()), "text", "lang", "doc_id")
    return langid.identify(docs, model, ["doc_id"]).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op7_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = wavelet.index_documents(docs, shared_path(spark, "wavelet"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs), ["doc_id"])


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, keep_ids=False)


def op10_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_cotraining": op2_cotraining,
    "op3_host_rules": op3_host_rules,
    "op4_simhash": op4_simhash,
    "op5_exact_topk": op5_exact_topk,
    "op6_language_id": op6_language_id,
    "op7_token_index": op7_token_index,
    "op8_personal_data": op8_personal_data,
    "op9_packing": op9_packing,
    "op10_poisson_mixing": op10_poisson_mixing,
}


def _pattern(template: str) -> tuple[str, int]:
    """A template as a regular expression over words that each end with a space, and its number of mandatory words; made without the operator's parser."""
    plain = re.sub(r"<<var;max=([0-9]+)>>", r" #\1 ", template.lower().replace("<<beginoptional>>", " { ").replace("<<endoptional>>", " } "))
    out, depth, must = "", 0, 0
    for word in re.findall("#[0-9]+|[{}]|[0-9a-z]+", plain):
        if word[0] == "#":
            out += "(?:[^ ]+ ){0," + word[1:] + "}"
        elif word in "{}":
            out += "(?:" if word == "{" else ")?"
            depth += 1 if word == "{" else -1
        else:
            out += word + " "
            must += not depth
    return out, must


def _license_sql() -> str:
    joined = "' ' || array_to_string(w, ' ') || ' '"
    phrases = [(p.split(), label) for p, label in licenses.PHRASES.items()]
    at = " or ".join(f"w[i + 1 : i + {len(p)}] = {p!r}" for p, _ in phrases)
    base = ", ".join(f"case when contains(s, ' {' '.join(p)} ') then '{label}' end" for p, label in phrases)
    rules = [(label, *_pattern(t)) for label, ts in licenses.TEMPLATES.items() for t in ts]
    own = ", ".join(f"case when regexp_matches(s, ' {r}') then '{label}' end" for label, r, _ in rules)
    best = [f"case when contains(s, ' {' '.join(p)} ') then {len(p)} else 0 end" for p, _ in phrases] + [f"case when regexp_matches(s, ' {r}') then {m} else 0 end" for _, r, m in rules]
    clean = "array_to_string(list_sort(list_distinct([x for x in [{}] if x is not null])), ',')"
    return f"""
with tokens as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
lines as (select doc_id, w, {joined} as s from tokens),
found as (select doc_id, w, s, [i for i in range(len(w)) if {at}] as p from lines),
scored as (select *, greatest({", ".join(best)}) as m from found)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(p) as bigint) as n_base, list_min(p) as first_word, list_max(p) as last_word,
  {clean.format(base)} as base_labels, {clean.format(base + ", " + own)} as labels, case when m = 0 then 0.0::double else m::double / (m + 4) end as score
from scored
"""


ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": _license_sql(),
    "op3_host_rules": hostrules.SQL,
    "op5_exact_topk": """
with v as (select vec_id, [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as w from embeddings
  where vec_id is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_sum([q.w[i] * c.w[i] for i in range(1, len(q.w) + 1)]) as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(q.w) = len(c.w)),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from s)
select query_id, cast(rank as integer) as rank, vec_id, cast(score as bigint) as score from r where rank <= 5
""",
    "op10_poisson_mixing": mixing.sql(),
}
