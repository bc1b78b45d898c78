"""Building, writing and reading the index."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.text import pack_id, unpack_id
from tagloom.operators import blobs as blob_ops
from tagloom.operators.compat import binding_words, extract_comps, resolve_comp_docs
from tagloom.operators.defs import DEFAULT_RULES, DEFINE_RULE, clean_defs, defs_from_tags, extract_tags
from tagloom.operators.docs import extract_docs
from tagloom.operators.refs import extract_refs, known_idents, resolve, resolve_as_of, token_postings
from tagloom.schema import INDEX_TABLES, SORT_COLUMNS


@dataclass(frozen=True)
class IndexOptions:
    """Choices where more than one reading is sensible; defaults are faithful.

    ``versions`` (project, version and their order, as ``sequence_versions`` gives them) says which version of a project comes first, and so
    which name a content is first seen under; without it, release numbers do.
    """

    rules: tuple = DEFAULT_RULES
    statements: bool = True
    edge_tokens: str = "drop"
    resolve: str = "all"
    lenient_closer: bool = False
    stop: DataFrame | None = field(default=None, compare=False)
    dts_projects: DataFrame | None = field(default=None, compare=False)
    tags: DataFrame | None = field(default=None, compare=False)
    versions: DataFrame | None = field(default=None, compare=False)


def table_plan(name: str, files: DataFrame, tables: Mapping[str, DataFrame],
               options: IndexOptions) -> DataFrame:
    """The plan of one index table, from ``files`` and the tables before it."""
    blobs = lambda: tables["blobs"]
    if name == "blobs":
        return blob_ops.build_blobs(files, options.versions)
    if name == "paths":
        return blob_ops.listing(files)
    if name == "first_paths":
        # Spread by range first: the groups then stay where they are, and their rows cross the network once.
        packed = tables["paths"].select("project", "version", "path", pack_id(F.col("blob_id")).alias("blob_id"))
        first = blob_ops.first_paths(packed.repartitionByRange("project", "version", "blob_id"))
        return first.withColumn("blob_id", unpack_id(F.col("blob_id")))
    if name == "tags":
        return extract_tags(blobs(), options.rules, options.statements)
    if name == "defs":
        if options.tags is not None:
            return defs_from_tags(options.tags, blobs(), options.stop)
        return clean_defs(tables["tags"], options.stop)
    if name == "tokens":
        return token_postings(blobs(), tables["defs"], options.edge_tokens)
    if name == "refs":
        # Candidates that are not stored yet go straight into the join: most name nothing and need not be put down.
        if "tokens" not in tables:
            return extract_refs(blobs(), tables["defs"], options.resolve, options.edge_tokens)
        if options.resolve == "as_of":
            return resolve_as_of(tables["tokens"], tables["defs"], blobs())
        return resolve(tables["tokens"], known_idents(tables["defs"]))
    if name == "docs":
        ours = options.statements and DEFINE_RULE in options.rules and options.tags is None
        return extract_docs(blobs(), tables["tags"] if ours else None, options.lenient_closer)
    if name == "comps":
        return extract_comps(blobs(), options.dts_projects)
    if name == "comp_words":
        return binding_words(blobs(), tables["paths"])
    if name == "comp_docs":
        return resolve_comp_docs(tables["comp_words"], tables["comps"])
    raise KeyError(name)


class LazyIndex(dict):
    """Index tables as plans; a table asked for first brings those before it."""

    def __init__(self, files: DataFrame, options: IndexOptions = IndexOptions()):
        super().__init__()
        self.files, self.options = files, options

    def __missing__(self, name: str) -> DataFrame:
        self[name] = table_plan(name, self.files, self, self.options)
        return self[name]


class StoredIndex(LazyIndex):
    """As :class:`LazyIndex`, but every table is written below ``root`` when it is
    first asked for, and read from there: each extractor reads the stored blobs
    and the stored listing, not the source."""

    def __init__(self, files: DataFrame, root: str, options: IndexOptions = IndexOptions()):
        super().__init__(files, options)
        self.root = root

    def __missing__(self, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        write_table(table_plan(name, self.files, self, self.options), name, path)
        self[name] = read_table(self.files.sparkSession, name, path)
        return self[name]


def build_index(files: DataFrame, options: IndexOptions = IndexOptions()) -> LazyIndex:
    """All index tables of ``files`` as DataFrames that nothing has run yet."""
    return LazyIndex(files, options)


#: Tables whose plan reads and matches whole texts right up to its end. Spreading
#: rows by range samples its input first, which would run such a plan twice, so
#: their rows are put down once as they come and spread from there.
STAGED = ("tokens", "refs", "docs", "comps", "comp_words")

#: Tables that are always read whole or met by hash, or spread by their plan: they stay where it has put them.
UNSPREAD = ("blobs", "tags", "first_paths")


def bucket_of(buckets: int) -> Column:
    """The bucket a row's identifier falls into; the same for every batch of an index."""
    return F.pmod(F.xxhash64("ident"), F.lit(buckets)).cast("int")


def write_table(df: DataFrame, name: str, path: str, buckets: int | None = None) -> None:
    """Write one index table in full, partitioned by project and sorted for
    row-group skipping; identifier tables carry a bloom filter on the identifier.
    With ``buckets`` the rows of a project also lie apart by bucket of their identifier.

    Rows are spread by range of their sort columns: files cover narrow key
    ranges, and a key that holds many rows is spread by the columns behind it.
    Blobs stay where their dedup by hash put them, tags where their statements were ordered.
    """
    spark, columns = df.sparkSession, INDEX_TABLES[name].fieldNames()
    parent, _, leaf = path.rpartition("/")
    # A leading underscore, and no '=', hide the folder from readers of the parent.
    rows, staging = df.select(*columns), f"{parent}/_staging-{leaf.replace('=', '-')}"
    if name in STAGED:
        rows.write.mode("overwrite").option("compression", "zstd").parquet(staging)
        rows = spark.read.schema(INDEX_TABLES[name]).parquet(staging)
    folders = ["project", "version"] if name in ("paths", "first_paths") else ["project"]
    if buckets:
        rows, folders = rows.withColumn("bucket", bucket_of(buckets)), ["project", "bucket"]
    order = list(dict.fromkeys(["project", *folders, *SORT_COLUMNS[name]])) if buckets else ["project", *SORT_COLUMNS[name]]
    if name not in UNSPREAD:
        # Names of blobs, which no codec makes smaller as text, cross as bytes.
        rows = rows.withColumn("blob_id", pack_id(F.col("blob_id"))).repartitionByRange(*order).withColumn("blob_id", unpack_id(F.col("blob_id")))
    writer = rows.sortWithinPartitions(*order).write.mode("overwrite").option("compression", "zstd").partitionBy(*folders)
    if "ident" in SORT_COLUMNS[name]:
        writer = writer.option("parquet.bloom.filter.enabled#ident", "true")
    writer.parquet(path)
    if name in STAGED:
        delete(spark, staging)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder this module wrote, on whatever file system it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    columns = INDEX_TABLES[name].fieldNames()
    return spark.read.schema(INDEX_TABLES[name]).parquet(path).select(*columns)


# Postings before listings: a version counts as indexed once its listing is there.
WRITE_ORDER = ("blobs", "tags", "defs", "tokens", "refs", "docs", "comps", "comp_words", "comp_docs",
               "first_paths", "paths")


def write_index(files: DataFrame, root: str, options: IndexOptions = IndexOptions()) -> StoredIndex:
    """Build and store the whole index of ``files``."""
    index = StoredIndex(files, root, options)
    # The source is read twice: once for the listing, put down under a hidden name for all tables that
    # need it, and once for the blobs. The listing is published last.
    hidden = f"{root}/_listing"
    blob_ops.listing(files).write.mode("overwrite").parquet(hidden)
    index["paths"] = files.sparkSession.read.schema(INDEX_TABLES["paths"]).parquet(hidden)
    for name in WRITE_ORDER[:-1]:
        index[name]
    path = f"{root}/paths"
    write_table(index["paths"], "paths", path)
    index["paths"] = read_table(files.sparkSession, "paths", path)
    delete(files.sparkSession, hidden)
    return index


def read_index(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {name: read_table(spark, name, f"{root}/{name}") for name in INDEX_TABLES}


def index_stats(index: dict[str, DataFrame], versions: DataFrame) -> DataFrame:
    """Counts per project: versions, blobs, defined and referenced identifiers."""
    parts = [
        versions.groupBy("project").agg(F.countDistinct("version").alias("n")).withColumn("what", F.lit("versions")),
        index["blobs"].groupBy("project").agg(F.count("*").alias("n")).withColumn("what", F.lit("blobs")),
        index["defs"].groupBy("project").agg(F.countDistinct("ident").alias("n")).withColumn("what", F.lit("definitions")),
        index["refs"].groupBy("project").agg(F.countDistinct("ident").alias("n")).withColumn("what", F.lit("references")),
        # A listed blob without content would be a damaged index.
        index["paths"].select("project", "blob_id").distinct()
        .join(index["blobs"].select("project", "blob_id"), ["blob_id", "project"], "left_anti")
        .groupBy("project").agg(F.count("*").alias("n")).withColumn("what", F.lit("missing blobs")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("project", "what", "n")
