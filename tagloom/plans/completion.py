"""Completion of names from a stored table of prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.plans.index import delete

#: ``names``: in byte order. A prefix with ``more`` names than ``K`` has its first ``K``; a prefix with fewer is in the table if it is the
#: shortest such one of its names, with all of them. So each name stands below one short list at most, besides the first names of long ones.
COMPLETIONS = T.StructType([
    T.StructField("project", T.StringType(), True), T.StructField("prefix", T.StringType(), True),
    T.StructField("more", T.BooleanType(), True), T.StructField("names", T.ArrayType(T.StringType()), True),
])
K = 10


def completion_table(names: DataFrame, k: int = K) -> DataFrame:
    """The table for ``names(project, ident)``.

    Of each prefix ``k + 1`` names leave a map task, however many share it; nothing else is shuffled. Prefixes whose own parent
    has few names are covered by the parent and left out.
    """
    return _kept(_lists(names, k), k)


def _lists(names: DataFrame, k: int) -> DataFrame:
    """Every prefix with its first ``k + 1`` names."""
    first = Window.partitionBy("project", "prefix").orderBy("ident")
    return (
        names.select("project", "ident").distinct()
        .withColumn("_len", F.explode(F.sequence(F.lit(0), F.length("ident"))))
        .select("project", F.substring(F.col("ident"), F.lit(1), F.col("_len")).alias("prefix"), "ident")
        .withColumn("_rank", F.row_number().over(first))
        .where(F.col("_rank") <= k + 1)
        .groupBy("project", "prefix").agg(F.array_sort(F.collect_list("ident")).alias("names"))
        .select("project", "prefix", "names", (F.size("names") > k).alias("more"))
    )


def _kept(lists: DataFrame, k: int) -> DataFrame:
    """The lists that stand in the table."""
    # A prefix is in the table if it is the empty one or its parent has more: the parent's first k + 1 names can't tell all children,
    # so children ask for their parent by an equi join of keys.
    parents = lists.where("more").select("project", F.col("prefix").alias("_parent"))
    cut = F.substring(F.col("prefix"), F.lit(1), F.length("prefix") - 1)
    below = lists.where("prefix <> ''").withColumn("_parent", cut).join(parents, ["project", "_parent"], "left_semi")
    kept = lists.where("prefix = ''").select(*lists.columns).unionByName(below.select(*lists.columns))
    return kept.select("project", "prefix", "more", F.slice("names", 1, k).alias("names"))


def write_completions(names: DataFrame, path: str, k: int = K) -> DataFrame:
    """The table below ``path``, sorted by prefix in ranges, with a bloom filter on prefixes.

    The lists of all prefixes, which are asked twice for parents and children and again by the sampling for ranges, are put down first.
    """
    spark = names.sparkSession
    parent, _, leaf = path.rpartition("/")
    staging = f"{parent}/_staging-{leaf}"
    lists = _lists(names, k)
    lists.write.mode("overwrite").option("compression", "zstd").parquet(staging)
    rows = _kept(spark.read.schema(lists.schema).parquet(staging), k).repartitionByRange("project", "prefix").sortWithinPartitions("project", "prefix")
    rows.write.mode("overwrite").partitionBy("project").option("parquet.bloom.filter.enabled#prefix", "true").parquet(path)
    delete(spark, staging)
    return read_completions(spark, path)


def read_completions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COMPLETIONS).parquet(path).select(*COMPLETIONS.fieldNames())


def _fitting(prefix: Column, names: Column, k: int) -> Column:
    return F.slice(F.filter(names, lambda n: n.startswith(prefix)), 1, k)


def complete(table: DataFrame, prefixes: DataFrame, k: int = K) -> DataFrame:
    """First ``k`` names, in byte order, for each of ``prefixes(project, prefix, ...)``: a row for each with ``rank`` and ``ident``.

    A question meets its own prefix, or else the one short list that holds all its names, which stands at one of its
    own prefixes: both by key. ``k`` is at most that of the table.

    Both joins sort and merge: the planner sizes the questions by the files they come from, before each is cut into all its prefixes,
    and would send the whole lot through the driver.
    """
    asked = prefixes.distinct()
    keys = asked.select("project", "prefix").distinct()
    tried = keys.withColumn("_at", F.explode(F.transform(F.sequence(F.lit(0), F.length("prefix")), lambda i: F.substring(F.col("prefix"), F.lit(1), i))))
    held = table.select("project", F.col("prefix").alias("_at"), "more", "names")
    found = (
        tried.join(held.hint("merge"), ["project", "_at"]).where(~F.col("more") | (F.col("_at") == F.col("prefix")))
        .select("project", "prefix", F.posexplode(_fitting(F.col("prefix"), F.col("names"), k)).alias("_pos", "ident"))
    )
    return asked.join(found.hint("merge"), ["project", "prefix"]).select(*asked.columns, (F.col("_pos") + 1).alias("rank"), "ident")


def complete_one(table: DataFrame, project: str, prefix: str, k: int = K) -> DataFrame:
    """As :func:`complete` for one prefix; its few possible keys reach the scan."""
    keys = [prefix[:i] for i in range(len(prefix) + 1)]
    rows = table.where((F.col("project") == project) & F.col("prefix").isin(keys)).where(~F.col("more") | (F.col("prefix") == prefix))
    return rows.select(F.explode(_fitting(F.lit(prefix), F.col("names"), k)).alias("ident")).orderBy("ident").limit(k)
