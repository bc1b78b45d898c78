"""Content-addressed blobs: every distinct content is kept and parsed once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.order import release_key
from tagloom.functions.paths import base_name, file_family
from tagloom.functions.text import pack_id, unpack_id


def listing(files: DataFrame) -> DataFrame:
    """Files of each version without their content."""
    return files.select("project", "version", "path", "blob_id", "kind", "perm", "size")


def first_names(files: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """``(project, blob_id, path, first_version, first_key)``: where each content was first seen, oldest
    version, then smallest path.

    ``versions(project, version, natkey, seq, is_reversed)``, as :func:`sequence_versions` numbers them,
    gives the project's own order (versions that it lacks come last, in plain order); without it versions
    are in natural order. Content is not read.
    """
    rows = files.select("project", "blob_id", "version", "path").withColumn("first_key", release_key(F.col("version")))
    place = F.lit(0)
    if versions is not None:
        own = versions.select(
            "project", "version", F.col("natkey").alias("_own"),
            F.when(F.col("is_reversed"), -F.col("seq")).otherwise(F.col("seq")).alias("_place"),
        )
        rows = rows.join(own, ["project", "version"], "left").withColumn("first_key", F.coalesce("_own", "first_key"))
        place = F.coalesce("_place", F.lit(2**62))
    first = Window.partitionBy("project", "blob_id").orderBy(place, "first_key", "path")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(
        "project", "blob_id", "path", F.col("version").alias("first_version"), "first_key"
    )


def build_blobs(files: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """One row per distinct content.

    The name of a blob is the one it was first seen under, and its family follows that name.
    ``row_number() = 1`` is cut to one row per blob before the shuffle, so copies, however many, never
    meet in one task. With ``versions`` the names are found from the listing alone and meet one copy of each
    content afterwards.
    """
    return _unpacked(_packed_blobs(files, versions))


def _packed_blobs(files: DataFrame, versions: DataFrame | None) -> DataFrame:
    """As :func:`build_blobs`, with ``blob_id`` in the bytes that cross the network."""
    files = _packed(files)
    if versions is None:
        first = Window.partitionBy("blob_id", "project").orderBy("first_key", "path")
        named = (
            files.withColumn("first_key", release_key(F.col("version")))
            .withColumn("_n", F.row_number().over(first))
            .where("_n = 1")
            .withColumn("first_version", F.col("version"))
        )
    else:
        any_copy = Window.partitionBy("project", "blob_id").orderBy("size")
        copies = files.select("project", "blob_id", "size", "content").withColumn("_n", F.row_number().over(any_copy)).where("_n = 1")
        named = copies.join(first_names(files, versions), ["project", "blob_id"])
    return named.select(
        "project",
        "blob_id",
        base_name(F.col("path")).alias("filename"),
        file_family(F.col("path")).alias("family"),
        "first_version",
        "first_key",
        "size",
        "content",
    )


def new_blobs(files: DataFrame, blobs: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """Blobs of ``files`` that ``blobs`` does not hold yet.

    Copies go first, inside the map tasks; known ids are then taken off where that dedup has put each
    content, so a content crosses the network once.
    """
    known = _packed(blobs.select("project", "blob_id"))
    return _unpacked(_packed_blobs(files, versions).join(known, ["project", "blob_id"], "left_anti"))


def _packed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("blob_id", pack_id(F.col("blob_id")))


def _unpacked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("blob_id", unpack_id(F.col("blob_id")))


#: Keys that are sent to the blobs, some 100 bytes each.
FEW_KEYS = 250_000


def read_blob(blobs: DataFrame, keys: DataFrame) -> DataFrame:
    """Content of the blobs named in ``keys(project, blob_id)``.

    Up to ``FEW_KEYS`` keys, counted first, go to where the blobs lie; with more, keys and contents are joined as Spark sees fit.
    """
    if keys.limit(FEW_KEYS + 1).count() <= FEW_KEYS:
        keys = F.broadcast(keys)
    return keys.join(blobs.select("project", "blob_id", "size", "content"), ["project", "blob_id"])


def read_file(paths: DataFrame, blobs: DataFrame, keys: DataFrame) -> DataFrame:
    """Raw content of the files named in ``keys(project, version, path)``."""
    found = keys.join(paths, ["project", "version", "path"]).select(
        "project", "version", "path", "blob_id"
    )
    return found.join(blobs.select("project", "blob_id", "size", "content"), ["project", "blob_id"])


def first_paths(paths: DataFrame) -> DataFrame:
    """Smallest path of every blob in every version."""
    return paths.groupBy("blob_id", "version", "project").agg(F.min("path").alias("path")).select("project", "version", "blob_id", "path")


def new_blobs_per_version(blobs: DataFrame) -> DataFrame:
    return blobs.groupBy("project", F.col("first_version").alias("version")).agg(
        F.count("*").alias("new_blobs")
    )
