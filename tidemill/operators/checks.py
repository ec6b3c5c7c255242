"""Comparison of results, metric summaries, and schedules of block pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def compare(actual: DataFrame, expected: DataFrame, tol: float = 0.0) -> DataFrame:
    """id, actual, expected of ids that one side lacks or whose values differ by more than tol."""
    a, b = actual.select("id", F.col("value").alias("actual")), expected.select("id", F.col("value").alias("expected"))
    both = a.join(b, "id", "full_outer")
    differ = F.abs(F.col("actual") - F.col("expected")) > tol
    return both.filter(F.col("actual").isNull() | F.col("expected").isNull() | differ).select("id", "actual", "expected")


def unequal_cells(a: DataFrame, b: DataFrame) -> DataFrame:
    return unequal(a.select("i", "j", F.col("v").alias("left_v")).join(b.select("i", "j", F.col("v").alias("right_v")), ["i", "j"], "full_outer"))


def unequal(both: DataFrame) -> DataFrame:
    """Cells (i, j, left_v, right_v) that differ, as ``matrix.side_by_side`` has them of two products."""
    return both.filter(~F.col("left_v").eqNullSafe(F.col("right_v")))


def metric_summary(samples: DataFrame, event: str = "event", value: str = "value") -> DataFrame:
    """Count, sum, extremes, mean, exact median and population deviation of each event, in milliseconds of samples in nanoseconds."""
    v = F.col(value).cast("double") / 1e6
    return samples.groupBy(F.col(event).alias("event")).agg(
        F.count(v).alias("n"), F.sum(v).alias("sum_ms"), F.min(v).alias("min_ms"), F.max(v).alias("max_ms"),
        F.avg(v).alias("mean_ms"), F.percentile(v, 0.5).alias("median_ms"), F.stddev_pop(v).alias("stddev_ms"),
    )


def block_schedule(spark: SparkSession, k: int) -> DataFrame:
    """(round, slot, lo, hi): 2k-1 rounds that each pair all 2k blocks, every pair once; the circle method."""
    m = 2 * k - 1
    rows = spark.range(m * k).select(F.expr(f"id div {k}").alias("round"), (F.col("id") % k).alias("slot"))
    a = F.when(F.col("slot") == 0, F.lit(m)).otherwise((F.col("round") + F.col("slot")) % m)
    b = F.when(F.col("slot") == 0, F.col("round")).otherwise(F.pmod(F.col("round") - F.col("slot"), F.lit(m)))
    return rows.select("round", "slot", F.least(a, b).cast("long").alias("lo"), F.greatest(a, b).cast("long").alias("hi"))


def schedule_checks(schedule: DataFrame) -> DataFrame:
    """n_rounds, min and max of blocks a round covers, n_pairs and n_distinct_pairs."""
    ends = schedule.select("round", F.explode(F.array("lo", "hi")).alias("b"))
    covered = ends.groupBy("round").agg(F.count_distinct("b").alias("c"))
    per_round = covered.agg(F.count("*").alias("n_rounds"), F.min("c").alias("min_covered"), F.max("c").alias("max_covered"))
    return per_round.crossJoin(schedule.agg(F.count("*").alias("n_pairs"), F.count_distinct("lo", "hi").alias("n_distinct_pairs")))  # one row each


def exchange_plan(k: int) -> list[list[tuple[int, int]]]:
    """For each round, each worker's (kept, fetched) block: one of its two stays from the round before.

    The pairs of two rounds in a row form even cycles; walking a cycle gives each next pair to a
    worker that holds one of its blocks. A walk over 2k numbers, not over data.
    """
    m = 2 * k - 1
    rounds = [[(m, r)] + [((r + i) % m, (r - i) % m) for i in range(1, k)] for r in range(m)]
    held = [set(p) for p in rounds[0]]
    plan = []
    for nxt in rounds[1:]:
        holder = {b: w for w, own in enumerate(held) for b in own}
        partner = {b: p for p in nxt for b in p}
        given: dict[int, tuple[int, int]] = {}
        for start in range(k):
            if start in given:
                continue
            worker, keep = start, min(held[start])
            while worker not in given:
                pair = partner[keep]
                other = pair[0] if pair[1] == keep else pair[1]
                given[worker] = (keep, other)
                worker = holder[other]
                left = held[worker] - {other}
                keep = left.pop() if left else other
        plan.append([given[w] for w in range(k)])
        held = [set(given[w]) for w in range(k)]
    return plan


def plan_table(spark: SparkSession, k: int) -> DataFrame:
    """(round, worker, kept, fetched) of ``exchange_plan``; 2k-2 rounds of k rows."""
    rows = [(r, w, *pair) for r, turn in enumerate(exchange_plan(k)) for w, pair in enumerate(turn)]
    return spark.createDataFrame(rows, "round long, worker long, kept long, fetched long")


def plan_checks(plan: DataFrame, k: int) -> DataFrame:
    """For each round the blocks that are held, the workers that kept one of their two blocks and fetched one they hadn't, and the pairs that are new."""
    first = plan.sparkSession.createDataFrame([(-1, w, 2 * k - 1 if not w else w % (2 * k - 1), 0 if not w else -w % (2 * k - 1)) for w in range(k)], "round long, worker long, kept long, fetched long")
    all_of = first.union(plan)
    before = Window.partitionBy("worker").orderBy("round")
    was = F.array(F.lag("kept").over(before), F.lag("fetched").over(before))
    marked = all_of.withColumn("was", was).withColumn("pair", F.array(F.least("kept", "fetched"), F.greatest("kept", "fetched")))
    marked = marked.withColumn("nth", F.row_number().over(Window.partitionBy("pair").orderBy("round")))
    good = F.array_contains("was", F.col("kept")) & ~F.array_contains("was", F.col("fetched"))
    return marked.groupBy("round").agg(F.size(F.array_distinct(F.flatten(F.collect_list("pair")))).cast("long").alias("n_blocks"), F.count_if(good).alias("n_good"), F.count_if(F.col("nth") == 1).alias("n_new")).filter("round >= 0")
