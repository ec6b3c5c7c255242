"""Measured runs: samples of durations in nanoseconds, from the driver's clock and from the stages that Spark ran."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .operators.checks import metric_summary
from .sources.texts import write_metrics


@dataclass
class Samples:
    found: list[tuple[str, float]] = field(default_factory=list)

    @contextmanager
    def timed(self, event: str) -> Iterator[None]:
        began = time.perf_counter_ns()
        yield
        self.found.append((event, float(time.perf_counter_ns() - began)))

    def seconds(self, event: str) -> float:
        return sum(v for e, v in self.found if e == event) / 1e9

    def table(self, spark: SparkSession, events: tuple[str, ...] | None = None) -> DataFrame:
        """(event, value); events without a sample are left out."""
        return spark.createDataFrame([x for x in self.found if events is None or x[0] in events], "event string, value double")

    def write(self, spark: SparkSession, path: str, events: tuple[str, ...]) -> None:
        write_metrics(metric_summary(self.table(spark, events)).orderBy("event"), path)

    @staticmethod
    def _stages(spark: SparkSession) -> list:
        context = spark.sparkContext
        found = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
        return [found.apply(i) for i in range(found.size())]

    def next_stage(self, spark: SparkSession) -> int:
        """The number above all stages so far."""
        return 1 + max((s.stageId() for s in self._stages(spark)), default=-1)

    def take_stages(self, spark: SparkSession, since: int) -> None:
        """Adds what each stage from number ``since`` on took until its first task, and on waiting for shuffled blocks."""
        for s in self._stages(spark):
            if s.stageId() >= since and not s.firstTaskLaunchedTime().isEmpty():
                self.found.append(("Get Partitions (RPC)", s.shuffleFetchWaitTime() * 1e6))
                self.found.append(("Get Work Unit", (s.firstTaskLaunchedTime().get().getTime() - s.submissionTime().get().getTime()) * 1e6))
