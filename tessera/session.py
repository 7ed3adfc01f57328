"""Session helpers shared by the entry point, the benchmark and the tests."""

from __future__ import annotations

import contextlib
import ctypes
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cores: int | str = 8, app: str = "tessera", **conf: str) -> SparkSession:
    """A local session with the settings the queries are written for."""
    put = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in put.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package when it is not installed on them.

    Workers get the repository root on PYTHONPATH. On a cluster whose nodes do
    not see that folder, pass the package with ``--py-files`` instead.
    """
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables, by any path Spark can read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Lets at most `most` bytes of rows travel to a Python worker at once (a longer row alone), which bounds its memory and the JVM's.

    This is a setting of the session; a smaller one that is already there stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    jvm = spark.sparkContext._jvm
    told = jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if told <= 0 or told > most:
        spark.conf.set(name, str(most))


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over Arrow batches that gives its memory back to the system at the end of a task.

    A Python worker waits for further tasks, and what it holds meanwhile counts as the executor's.
    """

    def leaving_nothing(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
            ctypes.CDLL(None).malloc_trim(0)

    return leaving_nothing
