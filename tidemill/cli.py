"""``spark-submit tidemill/cli.py CONFIG``: runs the application that a configuration names and writes ``id value`` lines and metrics.

It runs from any folder: the package beside it is found, and sent to the executors of a cluster.
"""

from __future__ import annotations

import atexit
import logging
import shutil
import sys
import tempfile
from pathlib import Path

if __package__ in (None, ""):
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import SparkSession

from tidemill.metrics import Samples
from tidemill.operators.matrix import gather_rows, gram
from tidemill.plans.algorithms import APPLICATIONS
from tidemill.sources.graphs import read_edge_list, write_vertices
from tidemill.sources.matrices import read_matrix, write_matrix
from tidemill.sources.texts import Config

GRAPH_EVENTS = ("Vertices Wrapping", "Gather")
BUFFER_EVENTS = ("Load data", "Get Partitions (RPC)", "Get Work Unit")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, through the driver's file server."""
    here, folder = Path(__file__).resolve().parent, tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # executors fetch it as long as the driver runs
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/tidemill", "zip", here.parent, here.name))


def run(spark: SparkSession, path: str, log_folder: str | None = None) -> dict[str, float]:
    """Seconds of loading, of running, and of writing the result; the metrics go to CSV files beside it."""
    config = Config.read(spark, path)
    log = config.start_logging(spark, log_folder)
    if config.partitions:
        spark.conf.set("spark.sql.shuffle.partitions", config.partitions)
    source, target = f"{config.input_dir}/{config.graph_file}", f"{config.output_dir}/{config.app}"
    samples = Samples()
    since = samples.next_stage(spark)
    if config.app == "gram":
        with samples.timed("Load data"):
            rows = read_matrix(spark, source).persist()
            n = rows.count()
        with samples.timed("Gather"):
            product = gather_rows(gram(rows)).persist()
            product.count()
        with samples.timed("Collect"):
            write_matrix(product, target, n)
        product.unpersist()
        rows.unpersist()
    else:
        with samples.timed("Load data"):
            graph = read_edge_list(spark, source, config.weighted)
            graph.edges = graph.edges.persist()
            graph.edges.count()
        with samples.timed("Vertices Wrapping"):
            graph.vertices = graph.vertices.persist()
            graph.vertices.count()
        with samples.timed("Gather"):
            values = APPLICATIONS[config.app](graph, config.iterations, config.source).persist()
            values.count()
        with samples.timed("Collect"):
            write_vertices(values, target, "value")
        for held in (values, graph.edges, graph.vertices):
            held.unpersist()
    samples.take_stages(spark, since)
    samples.write(spark, f"{target}_graph_metrics.csv", GRAPH_EVENTS)
    samples.write(spark, f"{target}_buffer_metrics_0.csv", BUFFER_EVENTS)
    took = {"load_s": samples.seconds("Load data"), "run_s": samples.seconds("Vertices Wrapping") + samples.seconds("Gather"), "collect_s": samples.seconds("Collect")}
    for name, key in (("Load Data", "load_s"), ("Execution", "run_s"), ("Collect result", "collect_s")):
        log.info("%s time: %d ms", name, round(1000 * took[key]))
    for handler in log.handlers:
        handler.flush()
    return took


def main(arguments: list[str]) -> None:
    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    print(run(spark, arguments[0], arguments[1] if len(arguments) > 1 else None))
    logging.shutdown()


if __name__ == "__main__":
    main(sys.argv[1:])
