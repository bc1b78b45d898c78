"""Exported source trees and ready-made file tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.text import blob_hash, decode_text
from tagloom.schema import FILES
from tagloom.sources.tree_format import FORMAT, PLAIN, TreeSource

FILE_COLUMNS = FILES.fieldNames()


def scan_paths(spark: SparkSession, root: str) -> DataFrame:
    """Files below ``root/<project>/<version>/<path>``, read in parallel.

    On a mounted file system (no scheme, or ``file:``), which every executor has to see at the same place, links and executables are
    told from plain files: a link's content is its target. Stores that know neither are read as plain files throughout.
    """
    local = re.fullmatch(r"(?:file:(?://)?)?(/.*)", root)
    return _mounted(spark, local[1]) if local else _stored(spark, root)


def tree_versions(spark: SparkSession, root: str) -> DataFrame:
    """``(project, version)`` of the trees below a mounted ``root``; no content is read."""
    spark.dataSource.register(TreeSource)
    return spark.read.format(FORMAT).option("content", "false").load(root).select("project", "version").distinct()


def _mounted(spark: SparkSession, root: str) -> DataFrame:
    spark.dataSource.register(TreeSource)
    return spark.read.format(FORMAT).load(root).select(
        "project", "version", "path", "kind", "perm", blob_hash(F.col("raw")).alias("blob_id"), "size",
        decode_text(F.col("raw")).alias("content"),
    )


def _stored(spark: SparkSession, root: str) -> DataFrame:
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    # Paths come back with a scheme, at times a host, and percent codes; what follows the root counts.
    here = "/" + re.sub(r"^[a-z0-9]+:/+", "", root).strip("/") + "/"
    tail = F.regexp_replace(
        F.expr("url_decode(replace(_metadata.file_path, '+', '%2B'))"), r"^[a-z0-9]+:/+", "/"
    )
    relative = F.regexp_extract(tail, f"{re.escape(here)}(.*)$", 1)
    parts = F.split(relative, "/", 3)
    return raw.select(
        parts[0].alias("project"), parts[1].alias("version"), parts[2].alias("path"),
        F.lit("blob").alias("kind"), F.lit(PLAIN).alias("perm"),
        blob_hash(F.col("content")).alias("blob_id"), F.col("length").alias("size"),
        decode_text(F.col("content")).alias("content"),
    )


def files_from_text(rows: DataFrame) -> DataFrame:
    """Complete ``(project, version, path, content)`` rows to the files schema."""
    have = set(rows.columns)
    return rows.select(
        "project", "version", "path",
        F.lit("blob").alias("kind"),
        (F.col("perm") if "perm" in have else F.lit("100644")).alias("perm"),
        blob_hash(F.col("content")).alias("blob_id"),
        F.octet_length("content").cast("bigint").alias("size"),
        "content",
    )


#: Versions whose owners are sent to the readers of the sources, some 100 bytes each.
OWNERS = 500_000


def version_owners(*versions: DataFrame) -> DataFrame:
    """``(project, version, _source)``: the first of the sources, given by the versions they have, that has it."""
    tagged = [v.select("project", "version", F.lit(i).alias("_source")) for i, v in enumerate(versions)]
    return reduce(DataFrame.unionByName, tagged).groupBy("project", "version").agg(F.min("_source").alias("_source"))


def union_sources(*sources: DataFrame, versions: list[DataFrame] | None = None) -> DataFrame:
    """Several sources as one; of a version delivered twice the first source counts.

    Who owns a version is found from ``versions(project, version)`` of each source, or from these two columns of
    the sources themselves. Each source is then read once, its rows filtered where they are read: content is not exchanged. Beyond
    ``OWNERS`` versions, counted first, owners and rows are joined as Spark sees fit.
    """
    owner = version_owners(*(versions or sources))
    if owner.limit(OWNERS + 1).count() <= OWNERS:
        owner = F.broadcast(owner)
    tagged = [s.select(*FILE_COLUMNS).withColumn("_source", F.lit(i)) for i, s in enumerate(sources)]
    files = reduce(DataFrame.unionByName, tagged)
    key = [files[c].eqNullSafe(owner[c]) for c in ("project", "version", "_source")]
    return files.join(owner, reduce(lambda a, b: a & b, key), "left_semi").select(*FILE_COLUMNS)
