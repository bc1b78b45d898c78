"""Directories, path types and existence, from the flat list of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions.paths import ancestors, base_name, dir_name, join_path, strip_slashes
from tagloom.session import spread


def of_versions(paths: DataFrame, keys: DataFrame) -> DataFrame:
    """The listings of the versions that ``keys`` speak of; stored listings of others are not read.

    The test of the version's name, true of every name, tells the planner that the keys are worth
    asking before the scan.
    """
    asked = keys.where("length(version) >= 0").select("project", "version").distinct()
    return paths.join(asked, ["project", "version"], "left_semi")


def directories(paths: DataFrame) -> DataFrame:
    """Every directory a file implies, the root (empty path) included.

    Distinct parents come first: they are few beside the files, so the
    ancestors are exploded from them only, in one pass. They are dealt to a number
    of tasks that stays, as paths compress too well to be sized by their bytes.
    """
    parents = spread(paths.select("project", "version", dir_name(F.col("path")).alias("path")), "version", "path").distinct()
    path = F.col("path")
    every = F.concat(F.array(path, F.lit("")), F.coalesce(ancestors(path), F.array().cast("array<string>")))
    return parents.select("project", "version", F.explode(every).alias("path")).distinct()


def entries(paths: DataFrame) -> DataFrame:
    """Files and directories alike, each with its directory and name."""
    trees = directories(paths).where("path <> ''").select(
        "project", "version", "path", F.lit("tree").alias("kind"),
        F.lit("040000").alias("perm"), F.lit(None).cast("bigint").alias("size"),
        F.lit(None).cast("string").alias("blob_id"),
    )
    files = paths.select("project", "version", "path", "kind", "perm", "size", "blob_id")
    return files.unionByName(trees).select(
        "*", dir_name(F.col("path")).alias("dir"), base_name(F.col("path")).alias("name")
    )


def list_dir(paths: DataFrame, dirs: DataFrame | None = None, blobs: DataFrame | None = None) -> DataFrame:
    """Visible entries of the directories in ``dirs(project, version, dir)``, or of all.

    Directories come before files, then by name. Names with a leading dot are
    hidden. With ``blobs`` at hand a symbolic link shows what it points to.
    """
    if dirs is not None:
        paths = of_versions(paths, dirs)
    out = entries(paths)
    if dirs is not None:
        wanted = dirs.select("project", "version", strip_slashes(F.col("dir")).alias("dir")).distinct()
        out = out.join(wanted, ["project", "version", "dir"], "left_semi")
    return show(out, blobs)


def show(out: DataFrame, blobs: DataFrame | None = None) -> DataFrame:
    """Entries as a listing shows them."""
    out = out.where(~F.col("name").startswith("."))
    out = out.withColumn("target", F.col("path"))
    if blobs is not None:
        links = (
            out.where("perm <=> '120000'")
            .join(blobs.select("project", "blob_id", "content"), ["project", "blob_id"])
            .withColumn("kind", F.lit("symlink"))
            .withColumn("target", join_path(F.col("dir"), F.col("content")))
            .select(*out.columns)
        )
        out = out.where("NOT perm <=> '120000'").unionByName(links)
    return out.select("project", "version", "dir", "kind", "name", "target", "size", "perm").orderBy(
        "project", "version", "dir", F.when(F.col("kind") == "tree", 0).otherwise(1), "name"
    )


def path_type(paths: DataFrame, keys: DataFrame) -> DataFrame:
    """``blob``, ``tree`` or null for ``keys(project, version, path)``."""
    paths = of_versions(paths, keys)
    known = paths.select("project", "version", F.col("path").alias("_p"), F.lit("blob").alias("type")).unionByName(
        directories(paths).select("project", "version", F.col("path").alias("_p"), F.lit("tree").alias("type"))
    )
    return (
        keys.withColumn("_p", strip_slashes(F.col("path")))
        .join(known, ["project", "version", "_p"], "left")
        .drop("_p")
    )


def existing_paths(paths: DataFrame) -> DataFrame:
    """Files and the directories that directly hold a file."""
    files = paths.select("project", "version", "path")
    parents = files.select("project", "version", dir_name(F.col("path")).alias("path"))
    return files.unionByName(parents.distinct())


def path_exists(keys: DataFrame, paths: DataFrame) -> DataFrame:
    """Keep the keys whose path, slashes around it stripped, exists."""
    return (
        keys.withColumn("_p", strip_slashes(F.col("path")))
        .join(
            existing_paths(of_versions(paths, keys)).withColumnRenamed("path", "_p"),
            ["project", "version", "_p"],
            "left_semi",
        )
        .drop("_p")
    )
