"""Quality rules with host verdicts, in DataFrame functions only.

Each document gets counts and rule failures from its whole text. Failures are summed by host,
rates are shrunk by a beta prior that is fitted to all hosts by moments, and hosts whose shrunk
rate is too high are turned down with all their documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, lookup

FEW = 64  # repeated windows up to which a list is searched; beyond, windows are sorted with their places
BROADCAST_HOSTS = 50_000
MAX_RATE = 0.6
SPACE = r"[\x20\x09-\x0D]"


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns, with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines`` and ``n_repeat_words`` of the whole text.

    Windows are compared by their 64-bit XXH64. Each step is a projection of its own, so that
    nothing is computed twice and nothing within a function over an array is computed again for
    each element. Columns of ``docs`` with these names, or with those of the steps between, are an error.
    """
    own = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "_flat", "_lines", "_windows", "_sorted", "_twice", "_placed", "_starts"}
    if clash := own & set(docs.columns):
        raise ValueError(f"docs has columns {sorted(clash)}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumn("_flat", F.trim(F.regexp_replace(text, SPACE + "+", " ")))
    n = F.when(F.col("_flat") == "", 0).otherwise(F.length("_flat") - F.length(F.replace("_flat", F.lit(" "), F.lit(""))) + 1)
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    windows = F.regexp_extract_all("_flat", F.lit(r"(?<![^ ])(?=([^ ]+ [^ ]+ [^ ]+))"), 1)
    rows = rows.withColumns({
        "n_words": n.cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "_lines": lines,
        "_windows": F.transform(windows, lambda x: F.xxhash64(x)),
    })
    rows = rows.withColumns({
        "word_chars": F.greatest(F.lit(0), F.length("_flat") - F.greatest(F.lit(0), F.col("n_words") - 1)).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_sorted": F.sort_array("_windows"),
    })
    again = F.filter("_sorted", lambda x, i: (i > 0) & (x == F.get(F.col("_sorted"), i - 1)))
    rows = rows.withColumn("_twice", F.array_distinct(again))
    few = F.filter(F.transform("_windows", lambda x, i: F.when(F.array_contains(F.col("_twice"), x), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("_placed", F.when(F.size("_twice") > FEW, F.array_sort(F.transform("_windows", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    equal = lambda a, b: F.get(F.col("_placed"), a)["x"] == F.get(F.col("_placed"), b)["x"]
    many = F.filter(F.transform("_placed", lambda v, k: F.when(((k > 0) & equal(k, k - 1)) | equal(k, k + 1), v["i"])), lambda i: i.isNotNull())
    none = F.array().cast("array<int>")
    rows = rows.withColumn("_starts", F.when(F.size("_twice") == 0, none).when(F.size("_twice") <= FEW, few).otherwise(F.sort_array(many)))
    covered = F.aggregate("_starts", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")))
    rows = rows.withColumn("n_repeat_words", covered["n"].cast("long"))
    return rows.drop("_flat", "_lines", "_windows", "_sorted", "_twice", "_placed", "_starts")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """A document fails a host's count if it fails one of these."""
    return {
        "base": base_failed(),
        "symbols": 5 * F.col("n_symbols") > F.col("word_chars"),
        "lines": 2 * F.col("n_dup_lines") > F.col("n_words"),
    }


def verdicts(marked: DataFrame) -> DataFrame:
    """host, n_docs, n_failed, rate, shrunk, host_ok, from columns host and failed.

    The prior has mean m, the rate over all documents, and strength s = m(1-m)/v - 1 within 1 and
    1000, with v the variance of the hosts' rates, each weighted by its documents; s is 1000 where
    v is 0. The shrunk rate is (n_failed + s m) / (n_docs + s).
    """
    hosts = marked.groupBy("host").agg(F.count("*").alias("n_docs"), F.count_if("failed").alias("n_failed"))
    hosts = cut(hosts.withColumn("rate", F.col("n_failed") / F.col("n_docs")))
    sums = hosts.agg(F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f")).first()
    m = (sums["f"] or 0) / max(1, sums["n"] or 0)
    v = hosts.agg(F.sum(F.col("n_docs") * (F.col("rate") - m) * (F.col("rate") - m))).first()[0]
    v = (v or 0.0) / max(1, sums["n"] or 0)
    s = min(1000.0, max(1.0, m * (1 - m) / v - 1)) if v > 0 else 1000.0
    shrunk = (F.col("n_failed") + F.lit(s * m)) / (F.col("n_docs") + F.lit(s))
    return hosts.withColumn("shrunk", shrunk).withColumn("host_ok", F.col("shrunk") <= MAX_RATE)


def judge(docs: DataFrame, host_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, host, the five counts, base_failed, host_rate and kept of every row.

    A row is kept if it passes the base rules and its host is not turned down. A null host is a
    host of its own; a null or empty text has no words, and so fails. Repeated rows count again.
    An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    rows = measured(rows).drop("text").withColumn("base_failed", base_failed())
    failed = F.lit(False)
    for rule in rules().values():
        failed = failed | rule
    rows = cut(rows.withColumn("failed", failed))
    hosts = cut(verdicts(rows).select(F.col("host").alias("_host"), F.col("shrunk").alias("host_rate"), "host_ok", "n_docs"))
    joined = lookup(rows, F.col("host"), hosts, "_host", "n_docs", BROADCAST_HOSTS)
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("host_ok")).drop("_host", "host_ok", "failed")


SQL = r"""
with d as (select doc_id, source, coalesce(text, '') as t from documents),
w as (select doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w,
  [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] as lines from d),
grams as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from grams) where n > 1),
places as (select distinct doc_id, i + k as p from twice, range(0, 3) t(k)),
repeats as (select doc_id, count(*) as n from places group by doc_id),
m as (select w.doc_id, source, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
  length(t) - length(translate(t, '#*$%&|<>', '')) as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines,
  coalesce(r.n, 0) as n_repeat_words from w left join repeats r on r.doc_id = w.doc_id),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words or 5 * n_symbols > word_chars or 2 * n_dup_lines > n_words as failed from m),
h as (select source, count(*) as n, count(*) filter (where failed) as k from f group by source),
g as (select sum(k)::double / sum(n)::double as m, sum(n)::double as n from h),
s as (select g.m, case when sum(h.n * pow(h.k::double / h.n - g.m, 2)) > 0
  then least(1000.0, greatest(1.0, g.m * (1 - g.m) / (sum(h.n * pow(h.k::double / h.n - g.m, 2)) / g.n) - 1)) else 1000.0 end as s from h, g group by g.m, g.n),
v as (select source, (k + s * m) / (n + s) <= 0.6 as ok from h, s)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
  cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, base_failed, (not base_failed) and ok as kept
from f join v on f.source is not distinct from v.source
"""
