"""Session for tests and benchmarks. A cluster brings its own."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = 8, app: str = "tagloom") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt by hash of ``keys`` to as many tasks as the session shuffles to.

    Spark joins shuffled partitions by their bytes as written; rows that compress well swell to many times that in a task's memory. A number that is asked for is kept.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the one the cluster names, or,
    where none is named, a temporary one for a local run, removed at its end."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="tagloom-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return made
