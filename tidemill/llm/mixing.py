"""Mixing of sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, lookup

STEP = 32.0  # a mean rate beyond this is drawn as a sum of equal parts
TERMS = 128  # of each part's distribution; what lies beyond is below 1e-30
BROADCAST_SOURCES = 20_000


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts, joined by colons; 52 bits."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def rates(docs: DataFrame, source_col: str, text_col: str, weights: dict[str, float] | None, temperature: float, total: float | None) -> DataFrame:
    """source, n_docs, rate: the mean number of copies of each document of a source.

    ``weights`` are target shares of the characters, of the sources named; others get 0. Without
    them a source's share is its characters to the power ``temperature``. ``total`` is the target
    number of characters, by default as many as there are. A source without characters has rate 1.
    """
    chars = F.sum(F.coalesce(F.length(text_col), F.lit(0)))
    held = docs.groupBy(F.col(source_col).alias("source")).agg(chars.cast("double").alias("chars"), F.count("*").alias("n_docs"))
    if weights is None:
        power = F.sqrt("chars") if temperature == 0.5 else F.pow("chars", F.lit(temperature))
        shares = held.withColumn("weight", power)
    else:
        keys = list(weights)
        known = F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*(F.lit(float(weights[k])) for k in keys)))
        shares = held.withColumn("weight", F.coalesce(F.try_element_at(known, F.coalesce("source", F.lit(""))), F.lit(0.0)))
    shares = cut(shares)
    sums = shares.agg(F.sum("weight").alias("w"), F.sum("chars").alias("c")).first()
    goal = float(total if total is not None else sums["c"] or 0.0)
    rate = F.when(F.col("chars") == 0, 1.0).otherwise(F.lit(goal) * F.col("weight") / F.lit(float(sums["w"] or 1.0)) / F.col("chars"))
    return shares.select("source", "n_docs", rate.alias("rate"))


def mix(docs: DataFrame, seed: int = 7, weights: dict[str, float] | None = None, temperature: float = 0.5, total: float | None = None, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", prefix: str = "") -> DataFrame:
    """All columns of ``docs`` for each copy, with ``<prefix>repeats``, ``<prefix>copy`` (from 1) and ``<prefix>shuffle_key``, in a globally shuffled order.

    A document's number of copies is the inverse of the Poisson distribution of its source's mean
    rate at a number in [0, 1) that the MD5 of seed and id gives: it depends on nothing else, and
    repeats when a task runs again. Rates beyond 32 are drawn as a sum of equal parts. A null
    source is a source of its own, a null id counts as an empty string, a null text has no
    characters. Rows of equal id get equal numbers of copies. An empty table gives no rows. Added
    columns that would clash with those of ``docs`` are an error: choose a ``prefix``.
    """
    added = [f"{prefix}{x}" for x in ("repeats", "copy", "shuffle_key")]
    if clash := (set(added) | {"_source", "_parts", "_sums", "n_docs"}) & set(docs.columns):
        raise ValueError(f"docs has columns {sorted(clash)}; choose a prefix, or rename those with an underscore")
    rate = rates(docs, source_col, text_col, weights, temperature, total)
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / STEP).cast("int"))
    mean = F.col("_rate_of_part")
    term = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)),
        F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("sums")),
        lambda a, k: F.struct((a["p"] * mean / k).alias("p"), F.array_append(a["sums"], F.element_at(a["sums"], -1) + a["p"] * mean / k).alias("sums")),
    )["sums"]
    table = rate.withColumn("_parts", parts).withColumn("_rate_of_part", F.col("rate") / F.col("_parts")).withColumn("_sums", term)
    table = cut(table.select(F.col("source").alias("_source"), "_parts", "_sums", "n_docs"))
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    drawn = lookup(docs, F.col(source_col), table, "_source", "n_docs", BROADCAST_SOURCES)
    # the draws are an array of their own, so that none is made again for each sum it is compared with
    draws = F.transform(F.sequence(F.lit(1), F.col("_parts")), lambda j: uniform(F.lit(str(seed)), name, j.cast("string")))
    repeats = F.aggregate(draws, F.lit(0), lambda a, u: a + F.size(F.filter("_sums", lambda s: s <= u)))
    copies = drawn.withColumn(added[0], repeats).filter(F.col(added[0]) > 0)
    copies = copies.withColumn(added[1], F.explode(F.sequence(F.lit(1), F.col(added[0])))).drop("_source", "_parts", "_sums")
    key = F.md5(F.concat_ws(":", F.lit(f"{seed}s"), name, F.col(added[1]).cast("string")))
    return copies.withColumn(added[2], key).repartition(F.col(added[2])).sortWithinPartitions(added[2])


def sql(table: str = "documents", seed: int = 7) -> str:
    """The same rows in DuckDB's dialect, for weights by the square root and as many characters as there are."""
    u = f"(('0x' || md5('{seed}:' || coalesce(cast(d.doc_id as varchar), '') || ':' || cast(j as varchar))[1:13])::bigint / {float(2**52)!r})"
    return f"""
with held as (select source, cast(sum(coalesce(length(text), 0)) as double) as chars from {table} group by source),
shares as (select source, chars, sqrt(chars) as weight, sum(sqrt(chars)) over () as w, sum(chars) over () as c from held),
rated as (select source, case when chars = 0 then 1.0::double else c * weight / w / chars end as rate from shares),
parts as (select source, greatest(1, cast(ceil(rate / {STEP}) as integer)) as parts, rate / greatest(1, cast(ceil(rate / {STEP}) as integer)) as mean from rated),
terms as (select source, parts, k, exp(sum(case when k = 0 then -mean else ln(mean) - ln(k) end) over (partition by source order by k)) as p
  from parts, range(0, {TERMS + 1}) t(k)),
sums as (select source, parts, list(s order by k) as sums from (select source, parts, k, sum(p) over (partition by source order by k) as s from terms) group by source, parts),
drawn as (select d.*, list_sum([len([s for s in sums.sums if s <= {u}]) for j in range(1, sums.parts + 1)]) as repeats
  from {table} d join sums on d.source is not distinct from sums.source),
copies as (select *, unnest(range(1, cast(repeats as bigint) + 1)) as copy from drawn where repeats > 0)
select doc_id, text, lang, source, n_chars, cast(repeats as integer) as repeats, cast(copy as integer) as copy,
  md5('{seed}s:' || coalesce(cast(doc_id as varchar), '') || ':' || cast(copy as varchar)) as shuffle_key from copies
"""
