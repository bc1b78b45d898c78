"""Versions put together from parts that arrive in any order, by state.

A part is a parquet file with some files of a version; the manifest of a version says how many parts it has. Both come as rows of
one stream, ``ARRIVALS``: a part has a ``place`` and no ``n_parts``, a manifest has ``n_parts`` and no ``place``. What has arrived of
a version is its state: the places of its parts. When the number is met the version goes out as a row per part, status
``complete``, and the state goes. A version that is not complete when its patience is over goes out as one row, status ``missing``,
with the numbers found and wanted, and its state goes too: all parts have to come again. Parts that come again meanwhile
count once. A manifest that comes again with another number replaces the last; of several in one batch the largest counts.
Parts that come again after the version went out wait as any others, end as ``missing``, and harm nothing:
:func:`ingest_assembled` passes over versions that the index has.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tagloom.operators.versions import new_versions
from tagloom.plans.index import IndexOptions
from tagloom.schema import FILES
from tagloom.streaming.ingest import indexed_versions, ingest_batch

ARRIVALS = T.StructType([
    T.StructField("project", T.StringType(), True), T.StructField("version", T.StringType(), True),
    T.StructField("place", T.StringType(), True), T.StructField("n_parts", T.LongType(), True),
])
ASSEMBLED = T.StructType([
    *ARRIVALS.fields[:3], T.StructField("status", T.StringType(), True),
    T.StructField("found", T.LongType(), True), T.StructField("wanted", T.LongType(), True),
])
#: Places that have arrived, how many there shall be, and when the patience is over (ms).
_WAITING = "places array<string>, wanted long, due long"


def _assembly(patience_ms: int):
    """The step of one (project, version) with its new rows, or with none when its time is over."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, wanted, due = state.get if state.exists else ([], None, None)
        places = dict.fromkeys(held)
        if state.hasTimedOut:
            state.remove()
            yield _rows(key, [None], "missing", len(places), wanted)
            return
        numbers = []
        for rows in parts:
            places.update(dict.fromkeys(rows["place"].dropna()))
            numbers += rows["n_parts"].dropna().tolist()
        wanted = int(max(numbers)) if numbers else wanted
        now = state.getCurrentProcessingTimeMs()
        due = now + patience_ms if due is None else due
        # More parts than announced are no complete version either: the manifest, or a part, is wrong.
        if len(places) == wanted:
            if state.exists:
                state.remove()
            yield _rows(key, list(places), "complete", len(places), wanted)
        else:
            state.update((list(places), wanted, due))
            state.setTimeoutDuration(max(1, due - now))

    return step


def _rows(key: tuple, places: list, status: str, found: int, wanted: int | None) -> pd.DataFrame:
    made = pd.DataFrame({"place": pd.Series(places, dtype="object")})
    made["project"], made["version"], made["status"] = *key, status
    made["found"] = pd.Series([found] * len(places), dtype="Int64")
    made["wanted"] = pd.Series([wanted] * len(places), dtype="Int64")
    return made[ASSEMBLED.fieldNames()]


def assemble(arrivals: DataFrame, patience_ms: int) -> DataFrame:
    """Complete versions of a stream of ``ARRIVALS`` as ``ASSEMBLED`` rows; those not complete ``patience_ms`` after their first row are ``missing``.

    Rows without project or version belong to none and are left out. A version of no parts is complete at once and has no rows.
    """
    known = arrivals.where("project IS NOT NULL AND version IS NOT NULL").select(*ARRIVALS.fieldNames())
    return known.groupBy("project", "version").applyInPandasWithState(
        _assembly(patience_ms), ASSEMBLED, _WAITING, "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def ingest_assembled(assembled: DataFrame, batch_id: int, root: str, options: IndexOptions = IndexOptions()) -> None:
    """Add the complete versions of one micro-batch to the index below ``root``; versions that it has are passed over.

    Only places, as many as the batch has parts, come to the driver.
    """
    spark, key = assembled.sparkSession, ["project", "version"]
    parts = new_versions(assembled.where("status = 'complete'").select(*key, "place"), indexed_versions(spark, root, batch_id)).collect()
    if not parts:
        return
    wanted = spark.createDataFrame(list({(r["project"], r["version"]) for r in parts}), T.StructType(ARRIVALS.fields[:2]))
    files = spark.read.schema(FILES).parquet(*sorted({r["place"] for r in parts}))
    # Rows of a part that belong to another version are not what was announced.
    ingest_batch(files.join(F.broadcast(wanted), key, "left_semi"), batch_id, root, options)


def stream_arrivals(spark: SparkSession, landing: str, files_per_batch: int | None = None) -> DataFrame:
    """Landed parquet files of arrivals as a stream."""
    reader = spark.readStream.schema(ARRIVALS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(landing)


def start_once(writer: DataStreamWriter, spark: SparkSession) -> None:
    """Run a stream with timers over what there is, then stop: timers that are due go off in the batches that bring rows.

    Spark else runs empty batches for timers to come, and a run to the end of the input would have no end.
    """
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")  # a query keeps the settings that it is started with
    try:
        query = writer.trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before)
    query.awaitTermination()


def ingest_parts(spark: SparkSession, landing: str, root: str, checkpoint: str, patience_ms: int,
                 options: IndexOptions = IndexOptions(), files_per_batch: int | None = None) -> None:
    """Take in all arrivals landed since the last run, index the versions that they complete, then stop. State and timers stay
    in ``checkpoint`` for the next run."""
    start_once(
        assemble(stream_arrivals(spark, landing, files_per_batch), patience_ms)
        .writeStream.foreachBatch(lambda df, n: ingest_assembled(df, n, root, options))
        .outputMode("append")
        .option("checkpointLocation", checkpoint),
        spark,
    )
