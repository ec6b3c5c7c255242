"""Configuration files, address lists, trace logs, and the sinks of metrics and traces."""

from __future__ import annotations

import logging
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRACE_SCHEMA = "name string, cat string, pid string, tid string, ph string, ts string, dur string, args struct<worker: string>"
# Spellings of application names.
APPS = {"pagerank": "pagerank", "page-rank": "pagerank", "connectedcomps": "components", "connected-comp": "components", "shortestpath": "shortest_path", "shortest-path": "shortest_path", "degree": "degree", "bfs": "bfs", "matmul": "gram", "pagerank-normalized": "pagerank_normalized"}
LEVELS = {"trace": "TRACE", "debug": "DEBUG", "info": "INFO", "warn": "WARN", "error": "ERROR"}


def parse_pairs(lines: list[str]) -> dict[str, str]:
    """Key and value at the first equals sign; comments and blank lines are skipped, nothing is trimmed; a line without one is its own value."""
    out = {}
    for line in lines:
        if not line or line.startswith("#"):
            continue
        key, sign, value = line.partition("=")
        out[key] = value if sign else line
    return out


def pairs(lines: DataFrame) -> DataFrame:
    """The same of a column ``value``, as (key, value)."""
    kept = lines.filter("value <> '' and not startswith(value, '#')")
    at = F.instr("value", "=")
    return kept.select(F.when(at > 0, F.expr("substring(value, 1, instr(value, '=') - 1)")).otherwise(F.col("value")).alias("key"), F.when(at > 0, F.expr("substring(value, instr(value, '=') + 1)")).otherwise(F.col("value")).alias("value"))


def addresses(text: str) -> list[str]:
    """The items of a comma list; a trailing comma gives none."""
    items = text.split(",")
    return items[:-1] if items[-1] == "" else items


def address_column(text: Column) -> Column:
    items = F.split(text, ",", -1)
    return F.when(F.element_at(items, -1) == "", F.slice(items, F.lit(1), F.size(items) - 1)).otherwise(items)


@dataclass
class Config:
    app: str
    iterations: int | None = 10
    input_dir: str = ""
    output_dir: str = ""
    graph_file: str = ""
    log_level: str = "info"
    partitions: int | None = None
    weighted: bool = False
    source: int = 0
    rest: dict[str, str] = field(default_factory=dict)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Config:
        """``app.iterations`` is a number, or ``fixpoint``; ``app.weighted`` is true or false, ``app.source`` a vertex."""
        own = parse_pairs([r["value"] for r in spark.read.text(path).collect()])  # a file of a few lines
        name = own.get("app.name", "")
        if name not in APPS:
            raise ValueError(f"unknown application {name!r}")
        shuffle, turns = own.get("buffer.num_partitions"), own.get("app.iterations", "10")
        return cls(
            APPS[name], None if turns == "fixpoint" else int(turns), own.get("app.input_dir", ""), own.get("app.output_dir", ""), own.get("app.graph_file", ""), own.get("app.log_level", "info"),
            int(shuffle) if shuffle else None, own.get("app.weighted", "false").lower() == "true", int(own.get("app.source", 0)), own,
        )

    def start_logging(self, spark: SparkSession, folder: str | None = None) -> logging.Logger:
        """The engine's logger, to the console at the configured level and, with a folder on the driver, to a file for each level."""
        level = LEVELS.get(self.log_level.lower(), "INFO")
        spark.sparkContext.setLogLevel("WARN" if level == "INFO" else level)  # Spark tells far more at its level INFO than a run does
        log = logging.getLogger("tidemill")
        log.handlers.clear()
        log.setLevel(1)
        console = logging.StreamHandler()
        console.setLevel("DEBUG" if level == "TRACE" else level)
        log.addHandler(console)
        for name, lowest in ((k, 1 if v == "TRACE" else v) for k, v in LEVELS.items()) if folder else ():
            os.makedirs(folder, exist_ok=True)
            handler = logging.FileHandler(f"{folder}/{self.app}_{name}.log", mode="w")
            handler.setLevel(lowest)
            handler.setFormatter(logging.Formatter("[%(levelname)s] [%(asctime)s] [PID:%(process)d TID:%(thread)d] %(message)s"))
            log.addHandler(handler)
        return log


def trace_events(lines: DataFrame) -> DataFrame:
    """Events of the lines of column ``value`` that hold ``[Tracing]``; text that is no JSON raises."""
    own = lines.filter(F.col("value").contains("[Tracing]")).select(F.replace(F.substring_index("value", "[Tracing]", -1), F.lit("'"), F.lit('"')).alias("j"))
    return own.select(F.from_json(F.trim("j"), TRACE_SCHEMA, {"mode": "FAILFAST"}).alias("e")).select("e.*")


def read_traces(spark: SparkSession, folder: str, app: str, file: str) -> DataFrame:
    lines = spark.read.option("pathGlobFilter", f"*{app}_{file}*.log").text(folder)
    return trace_events(lines)


def trace_lines(events: DataFrame) -> DataFrame:
    """The lines (column ``value``) of the JSON file that trace viewers read, in order of time and in one partition, as the format has it.

    The events pass through one task after a distributed sort; none of it holds them all.
    """
    none = events.sparkSession.createDataFrame([(None, None)], "t double, value string")  # so that there is a task without events too
    own = events.select(F.col("ts").cast("double").alias("t"), F.to_json(F.struct(*events.columns)).alias("value"))
    ordered = none.union(own).orderBy("t").select("value").coalesce(1)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = '{"traceEvents":['
        for batch in batches:
            for value in batch.column(0).drop_null().to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([before])], ["value"])
                before = value + ","
        last = [before] if before.endswith("[") else [before[:-1]]
        yield pa.RecordBatch.from_arrays([pa.array([*last, '],"displayTimeUnit":"ms"}'])], ["value"])

    return ordered.mapInArrow(lines, "value string")


def write_trace(events: DataFrame, path: str) -> None:
    trace_lines(events).write.text(path)


def write_metrics(summary: DataFrame, path: str) -> None:
    """A CSV of the summary with the columns' usual headings and six decimals."""
    # Headings of the file.
    names = {"event": "Event", "n": "Count", "sum_ms": "Sum(ms)", "min_ms": "Min(ms)", "max_ms": "Max(ms)", "mean_ms": "Mean(ms)", "median_ms": "Median(ms)", "stddev_ms": "Stddev(ms)"}
    six = lambda c: F.format_string("%.6f", F.col(c)) if c.endswith("_ms") else F.col(c)
    summary.select(*(six(c).alias(n) for c, n in names.items())).coalesce(1).write.option("header", True).csv(path)


def result_files(names: list[str], prefix: str) -> list[str]:
    """Names of result files of a prefix, without those that were sorted already."""
    return [n for n in names if f"{prefix}_" in n and "_sorted" not in n]
