"""The corpus pipeline: language ID, near-duplicates, personal data, mixing, packing."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import langid, mixing, packing, pii, resemblance
from tidemill.llm.arrow import bound_batches
from tidemill.runtime import delete, shared_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_LANGUAGE_SCORE = 0.3
NEAR_SIMILARITY = 0.8  # of the sets of five-word shingles


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (null and empty texts too), and those whose language stays open (a score under 0.3).

    Repeated rows are judged alike, null ids and labels change nothing, an empty table gives none.
    """
    bound_batches(spark)
    docs = docs.select(*COLUMNS)
    model = langid.fit(docs.filter(~langid.held_out()), "text", "lang", "doc_id")
    if not model.languages:  # nothing to learn from: only documents without letters go
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    rows = docs.withColumn("_found", langid.predicted(spark, model, F.col("text")))
    return rows.filter((F.col("_found.lang_pred") != langid.UNKNOWN) & (F.col("_found.score") >= LEAST_LANGUAGE_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of texts that links of a similarity of 0.8 or more connect: that of the smallest id.

    A null id comes last; of several texts of that id the one of the smallest node stays, of repeated
    rows one. Texts without words are one group. An empty table gives none.
    """
    bound_batches(spark)
    return resemblance.without_repeats(docs.select(*COLUMNS), width=5, least=NEAR_SIMILARITY)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each span by its kind in angle brackets, and counts characters anew; all rows stay, null texts too."""
    bound_batches(spark)
    docs = docs.select(*COLUMNS)
    text = pii.masked(spark, pii.fit(docs), F.col("text"))
    return docs.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources near their target shares, in a global shuffle.

    A null source is one of its own, a null text has no characters, rows of equal id have equal
    numbers of copies, and an empty table gives none.
    """
    return mixing.mix(docs.select(*COLUMNS), prefix="_").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sequences of at most 1024; a null text has the end id alone, copies are packed like others, an empty table gives none."""
    bound_batches(spark)
    return packing.pack(docs.select(*COLUMNS), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, keep_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixed),
    ("packing", packed),
]

#: Learned models, loopy message passing and tokenizers have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written to the shared folder and read again, and deleted once the next one stands."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        to = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(to)
        docs = spark.read.parquet(to)
        if before is not None:
            delete(spark, before)
        before = to
    return docs
