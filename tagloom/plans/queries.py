"""Every operator as a query over the test tables: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.functions import paths as P
from tagloom.functions import text as X
from tagloom.operators import blobs as B
from tagloom.operators import compat as C
from tagloom.operators import defs as D
from tagloom.operators import docs as DOC
from tagloom.operators import links as L
from tagloom.operators import listing as LS
from tagloom.operators import refs as R
from tagloom.operators import tokens as TK
from tagloom.operators import versions as V
from tagloom.plans import completion as CM
from tagloom.plans import directories as DR
from tagloom.plans import search as S
from tagloom.plans.index import IndexOptions, StoredIndex, index_stats
from tagloom.schema import REF_COMPAT, pairs
from tagloom.sources import lenses
from tagloom.session import spread, work_dir
from tagloom.sources.lenses import table
from tagloom.streaming.ingest import ingest_manifests, read_batches

QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# --- inputs --------------------------------------------------------------------


_STORED: dict[tuple, StoredIndex] = {}


def _stored(spark: SparkSession, d: str, name: str, files, options: IndexOptions = IndexOptions()) -> StoredIndex:
    """The index of a tree, stored once per session and test-data folder."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _STORED:
        root = f"{work_dir(spark)}/index-{spark.sparkContext.applicationId}-{len(_STORED)}-{name}"
        _STORED[key] = StoredIndex(files(spark, d), root, options)
    return _STORED[key]


def code_index(spark: SparkSession, d: str) -> StoredIndex:
    return _stored(spark, d, "code", lenses.code_files)


def code_directories(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The stored directories of the code tree, written when they are first asked for."""
    index = code_index(spark, d)
    if "directories" not in index:
        index["directories"] = DR.write_directories(index["paths"], f"{index.root}/directories")
    return index["directories"]


def config_index(spark: SparkSession, d: str) -> StoredIndex:
    return _stored(spark, d, "config", lenses.config_files)


def prose_index(spark: SparkSession, d: str) -> StoredIndex:
    options = IndexOptions(rules=lenses.prose_rules(), statements=False)
    return _stored(spark, d, "prose", lenses.prose_files, options)


def web_index(spark: SparkSession, d: str) -> StoredIndex:
    return _stored(spark, d, "web", lenses.web_files)


def code_versions(paths: DataFrame) -> DataFrame:
    """The versions of an index, taken as its tags."""
    return V.list_versions(paths.select("project", F.col("version").alias("rev")))


def ident_queries(spark: SparkSession, d: str) -> DataFrame:
    """A lookup per part, order, supplier and customer; customers ask for names
    that are defined nowhere."""
    code = F.lit("code").alias("project")

    def name(prefix: str, key: str) -> Column:
        return F.concat(F.lit(prefix), F.col(key).cast("string")).alias("ident")

    pk = F.col("p_partkey")
    families = F.array(*[F.lit(f) for f in ("C", "A", "K", "D", "M", "Z")])
    parts = table(spark, d, "part").select(
        code,
        F.concat(
            F.lit("v"), (pk % 7 + 1995).cast("string"), F.lit("."), (pk % 12 + 1).cast("string")
        ).alias("version"),
        name("part_", "p_partkey"),
        F.element_at(families, (pk % 6 + 1).cast("int")).alias("family"),
    )
    orders = table(spark, d, "orders").select(
        code,
        F.concat(
            F.lit("v"), F.year("o_orderdate").cast("string"), F.lit("."), F.month("o_orderdate").cast("string")
        ).alias("version"),
        name("order_", "o_orderkey"),
        F.when(F.col("o_orderkey") % 2 == 0, "A").otherwise("C").alias("family"),
    )
    suppliers = table(spark, d, "supplier").select(
        code, F.lit("latest").alias("version"), name("supp_", "s_suppkey"), F.lit("C").alias("family")
    )
    customers = table(spark, d, "customer").select(
        code, F.lit("latest-rc").alias("version"), name("none_", "c_custkey"), F.lit("C").alias("family")
    )
    return parts.unionByName(orders).unionByName(suppliers).unionByName(customers)


def config_queries(spark: SparkSession, d: str) -> DataFrame:
    """Every symbol of an office, vendor macro and compatible string, for each family."""
    nation = lenses.offices(spark, d).select(
        "n_nationkey", F.concat(F.lit("v1."), F.col("n_regionkey").cast("string")).alias("version")
    )
    n = F.col("n_nationkey").cast("string")
    supp = table(spark, d, "supplier").select(
        F.col("s_nationkey").alias("n_nationkey"), F.col("s_suppkey").cast("string").alias("sk"),
        F.floor(F.col("s_suppkey") / lenses.SUPPLIERS_PER_HEADER).cast("string").alias("c"),
    ).join(nation, "n_nationkey")
    names = nation.select("version", F.concat(F.lit("CONFIG_NATION_"), n).alias("ident")).unionByName(
        supp.select(
            "version",
            F.explode(
                F.array(
                    F.concat(F.lit("VENDOR"), n, F.lit("_"), "c"),
                    F.concat(F.lit("node_"), n, F.lit("_"), "c"),
                    F.concat(F.lit("vendor"), n, F.lit(",supp"), "sk"),
                    F.concat(F.lit("vendor"), n, F.lit(",any")),
                )
            ).alias("ident"),
        )
    )
    return names.distinct().select(
        F.lit("config").alias("project"), "version", "ident",
        F.explode(F.array(*[F.lit(f) for f in ("A", "B", "C", "D", "K", "M")])).alias("family"),
    )


def path_queries(spark: SparkSession, d: str) -> DataFrame:
    """Per order: its file with slashes around, its directory, the one above,
    the root, and a path that does not exist."""
    k = F.col("o_orderkey")
    ks = k.cast("string")
    q = F.concat(F.lit("drivers/q"), (k % 7).cast("string"))
    return (
        table(spark, d, "orders")
        .select(
            F.lit("code").alias("project"),
            F.concat(
                F.lit("v"), F.year("o_orderdate").cast("string"), F.lit("."),
                F.month("o_orderdate").cast("string"),
            ).alias("version"),
            F.explode(
                F.array(
                    F.concat(F.lit("/"), q, F.lit("/order_"), ks, F.lit(".c/")),
                    q, F.lit("drivers/"), F.lit(""),
                    F.concat(F.lit("gone/"), ks),
                )
            ).alias("path"),
        )
        .distinct()
    )


# Naming habits of the tag lens: nine invented projects.
TAG_RULES = (
    V.VersionRules("plain"),
    V.VersionRules("dashed", swap=("-.", ".-"), groups=(V.Group(lead="s"),)),
    V.VersionRules("shipped", rev_keep=r"\+ship$", to_version=((r"\+ship$", ""), ("^", "v")), to_rev=(("^v", ""), ("$", "+ship"))),
    V.VersionRules("codename", groups=(V.Group("fox-", strip="fox-", major="fox"), V.Group("owl-", strip="owl-", major="owl"))),
    V.VersionRules("calendar", latest_keep="w", latest_drop="", groups=(V.Group(without="v", sep="w"), V.Group("v"))),
    V.VersionRules("labelled", list_drop="draft", groups=(V.Group("v"), V.Group("L_", major="labels", minor="by date"))),
    V.VersionRules("backwards", list_reversed=True),
    V.VersionRules("archive", groups=(V.Group("v"), V.Group("attic:", strip="attic:", sep=":", major="attic")),
                   constant=(("attic", "start", "start"),)),
    # What is marked as early comes before the release it leads up to.
    V.VersionRules("early", order_as=(("^early:(.*)$", "$1~early"),), groups=(V.Group(strip="early:", lead="v"),)),
)


def tag_versions(spark: SparkSession, d: str) -> DataFrame:
    return V.list_versions(lenses.raw_tags(spark, d), TAG_RULES)


def indexed_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags whose orders have line items count as indexed."""
    used = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return V.list_versions(lenses.raw_tags(spark, d, used), TAG_RULES).select("project", "version")


# --- versions ------------------------------------------------------------------


@query
def versions_natural(spark, d):
    return V.sequence_versions(tag_versions(spark, d)).select("project", "version", "seq")


@query
def projects(spark, d):
    return V.list_projects(tag_versions(spark, d))


@query
def versions_new(spark, d):
    return V.new_versions(tag_versions(spark, d), indexed_tags(spark, d)).select("project", "version", "rev")


@query
def versions_rules(spark, d):
    return tag_versions(spark, d).select("project", "version", "is_rc", "is_listed", "is_stable")


@query
def versions_filter(spark, d):
    return V.filter_versions(tag_versions(spark, d), "V.*RC|l_|ATTIC").select("project", "version")


@query
def versions_grouped(spark, d):
    return V.group_versions(tag_versions(spark, d), TAG_RULES).select("project", "grp", "major", "minor", "version")


@query
def version_tree(spark, d):
    return V.version_tree(tag_versions(spark, d), indexed_tags(spark, d), TAG_RULES).select(
        "project", "grp", "major", "minor", "version"
    )


@query
def version_tree_nodes(spark, d):
    tree = V.version_tree(tag_versions(spark, d), indexed_tags(spark, d), TAG_RULES)
    return V.tree_nodes(tree).select("project", "major", "minor", "n_versions", "newest")


@query
def latest_version(spark, d):
    return V.latest_version(tag_versions(spark, d), indexed_tags(spark, d))


@query
def version_rewrite(spark, d):
    return V.add_rev(tag_versions(spark, d).select("project", "rev", "version"), TAG_RULES)


@query
def queries_resolved(spark, d):
    paths = code_index(spark, d)["paths"]
    versions = code_versions(paths)
    asked = V.resolve_version(ident_queries(spark, d), V.latest_version(versions, versions))
    return spread(asked, "project", "version", "ident", "family").distinct()


# --- files, blobs, directories ---------------------------------------------------


@query
def paths_scan(spark, d):
    return B.listing(lenses.code_files(spark, d)).select("project", "version", "path", "blob_id", "size")


@query
def blob_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", X.blob_hash(F.col("text")).alias("blob_id"))


@query
def blob_dedup(spark, d):
    return B.build_blobs(lenses.prose_files(spark, d)).select(
        "project", "blob_id", "filename", "family", "first_version", "size"
    )


@query
def blob_lookup(spark, d):
    index = code_index(spark, d)
    keys = index["paths"].where(F.col("path").startswith("include/")).select("project", "blob_id").distinct()
    return B.read_blob(index["blobs"], keys).select("project", "blob_id", "size", "content")


@query
def blobs_new(spark, d):
    """Blobs the versions from 2000 on add to an index of the earlier ones."""
    files = lenses.code_files(spark, d)
    late = F.regexp_extract("version", r"^v([0-9]+)", 1).cast("int") >= 2000
    known = files.where(~late).select("project", "blob_id")
    return B.new_blobs(files.where(late), known).select("project", "blob_id", "filename", "first_version")


@query
def new_blobs_per_version(spark, d):
    return B.new_blobs_per_version(code_index(spark, d)["blobs"])


@query
def file_raw(spark, d):
    index = code_index(spark, d)
    keys = path_queries(spark, d).withColumn("path", P.strip_slashes(F.col("path")))
    return B.read_file(index["paths"], index["blobs"], keys).select("version", "path", "content")


@query
def dir_listing(spark, d):
    paths = code_index(spark, d)["paths"]
    return LS.list_dir(paths).select("version", "dir", "kind", "name", "size", "perm")


@query
def dir_listing_asked(spark, d):
    """The directories that are asked for, of the versions asked for."""
    asked = path_queries(spark, d).select("project", "version", F.col("path").alias("dir"))
    return DR.list_directories(code_directories(spark, d), asked).select("version", "dir", "kind", "name", "size", "perm")


@query
def path_type(spark, d):
    return DR.path_types(code_directories(spark, d), path_queries(spark, d)).select("version", "path", "type")


@query
def path_exists(spark, d):
    return DR.paths_exist(path_queries(spark, d), code_directories(spark, d)).select("version", "path")


@query
def directory_nodes(spark, d):
    """How often each distinct directory is shared, by its entries."""
    tree = code_directories(spark, d)
    shared = tree["dirs"].groupBy("node").agg(F.count("*").alias("n_places"), F.min("dir").alias("first_dir"))
    held = tree["nodes"].groupBy("node").agg(F.count("*").alias("n_entries"), F.min("name").alias("first_name"))
    return shared.join(held, "node").drop("node")


@query
def path_parts(spark, d):
    path = F.col("path")
    return lenses.prose_files(spark, d).select(
        "path", P.dir_name(path).alias("dir"), P.base_name(path).alias("base"),
        P.stem(path).alias("stem"), P.extension(path).alias("ext"),
    )


@query
def path_ancestors(spark, d):
    return LS.directories(code_index(spark, d)["paths"]).select("version", F.col("path").alias("dir"))


@query
def path_normalize(spark, d):
    """Link targets of pages, as written and as seen from the page."""
    files = lenses.web_files(spark, d)
    return (
        files.select(
            "path", F.explode(F.regexp_extract_all("content", F.lit('href="([^"]*)"'), F.lit(1))).alias("href")
        )
        .select(
            "path", "href",
            P.join_path(P.dir_name(F.col("path")), F.col("href")).alias("target"),
            P.normalize(F.concat_ws("/", "path", F.lit(".."), F.lit("."), F.lit(".."), "href")).alias("above"),
        )
        .distinct()
    )


@query
def family_counts(spark, d):
    return (
        lenses.prose_files(spark, d).withColumn("family", P.file_family(F.col("path")))
        .groupBy("family").agg(F.count("*").alias("n_files"))
    )


@query
def ingest_blobs(spark, d):
    """The config tree, its versions arriving in the order in which sign-ups first name their regions, in two
    batches of manifests; every listed file with its blob."""
    files = lenses.config_files(spark, d)
    root = f"{work_dir(spark)}/ingest-{uuid.uuid4().hex}"
    signups = table(spark, d, "events").where("event_type = 'signup'").select(
        F.concat(F.lit("v1."), (F.col("user_id") % 5).cast("string")).alias("version"), F.struct("ts", "event_id").alias("at")
    )
    order = signups.groupBy("version").agg(F.min("at").alias("at")).withColumn("nth", F.row_number().over(Window.orderBy("at")))  # five rows
    counted = files.groupBy("project", "version").agg(F.count("*").alias("n_files")).join(order, "version", "left")
    late = F.coalesce(F.col("nth") > 2, F.lit(True))
    for batch, part in enumerate((counted.where(~late), counted.where(late))):
        place = f"{root}/landing-{batch}"
        files.join(part.select("project", "version"), ["project", "version"], "left_semi").write.parquet(place)
        ingest_manifests(part.select("project", "version", F.lit(place).alias("place"), "n_files"), batch, f"{root}/index")
    index = read_batches(spark, f"{root}/index")
    return index["paths"].drop("size").join(index["blobs"].select("project", "blob_id", "size"), ["project", "blob_id"]).select(
        "version", "path", "blob_id", "size"
    )


# --- tokens ----------------------------------------------------------------------


@query
def tokens(spark, d):
    """Token counts of the documents."""
    blobs = prose_index(spark, d)["blobs"]
    return TK.tokenize(blobs).groupBy("family", "token").agg(F.count("*").alias("n"))


@query
def tokens_by_line(spark, d):
    blobs = prose_index(spark, d)["blobs"]
    return TK.tokenize(blobs).groupBy("blob_id", "line").agg(F.count("*").alias("n_tokens"))


@query
def tokens_dts(spark, d):
    """Devicetree words keep their hyphens; documents and device trees alike."""
    blobs = prose_index(spark, d)["blobs"].unionByName(config_index(spark, d)["blobs"]).where("family = 'D'")
    return TK.tokenize(blobs).groupBy("project", "token").agg(F.count("*").alias("n"))


@query
def token_lines(spark, d):
    return TK.count_by_line(code_index(spark, d)["blobs"])


@query
def masked_tokens(spark, d):
    """Names inside comments and strings are gone after masking."""
    blobs = code_index(spark, d)["blobs"]
    return TK.tokenize(blobs).groupBy("token").agg(F.count("*").alias("n"))


@query
def marked_tokens(spark, d):
    """Every token of the code and configuration trees, known to its family or not."""
    marked = [
        L.mark_idents(TK.token_spans(X.with_packed_id(index["blobs"])), D.known_in_family(index["defs"]))
        for index in (code_index(spark, d), config_index(spark, d))
    ]
    return marked[0].unionByName(marked[1]).select(
        "project", X.unpack_id(F.col("blob_id")).alias("blob_id"), "family", "line", "start", "end", "ident", "known"
    )


@query
def marked_file(spark, d):
    """Files of both trees by all their paths, unknown tokens too, and files of no family as text; sums of their spans."""
    files = [
        S.marked_file(index, index["paths"].select("project", "version", "path"))
        for index in (code_index(spark, d), config_index(spark, d))
    ]
    spot = F.expr("CAST(line AS BIGINT) * 1000000 + start * 1000 + `end`")
    # Rows are sorted for their texts; by a hash of the path first, most comparisons end at its eight bytes.
    near = F.xxhash64("version", "path").alias("_near")
    return files[0].unionByName(files[1]).groupBy(near, "project", "version", "path").agg(
        F.count("*").alias("n_tokens"), F.count_if("known").alias("n_known"), F.sum(spot).alias("spots"),
        F.sum(F.length("text")).alias("chars"), F.min("text").alias("first_text"), F.max("text").alias("last_text"),
    ).drop("_near")


# --- definitions -------------------------------------------------------------------


@query
def defs_extract(spark, d):
    return D.extract_defs(code_index(spark, d)["blobs"])


@query
def defs_old_style(spark, d):
    """Old-style functions, one or two a file, written from every part."""
    return D.extract_defs(B.build_blobs(lenses.old_style_files(spark, d)))


@query
def defs_extract_config(spark, d):
    return D.extract_defs(config_index(spark, d)["blobs"])


@query
def defs_extract_prose(spark, d):
    return D.extract_defs(prose_index(spark, d)["blobs"], lenses.prose_rules(), statements=False)


@query
def defs_stop_filtered(spark, d):
    """Definitions of documents minus the words of the benchmark passages."""
    stop = table(spark, d, "benchmark").select(
        F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), F.lit(0))).alias("ident")
    )
    blobs = prose_index(spark, d)["blobs"]
    return D.extract_defs(blobs, lenses.prose_rules(), stop, statements=False)


@query
def def_postings(spark, d):
    got = D.def_postings(prose_index(spark, d)["defs"])
    return got.select(
        "ident", "blob_id", "family",
        F.array_join(
            F.transform("postings", lambda p: F.concat_ws(":", p["line"].cast("string"), p["type"])), ","
        ).alias("postings"),
    )


@query
def ident_families(spark, d):
    return D.ident_families(config_index(spark, d)["defs"])


@query
def ident_macro_families(spark, d):
    return D.family_sets(prose_index(spark, d)["defs"])


@query
def defs_cache(spark, d):
    return D.known_in_family(prose_index(spark, d)["defs"])


@query
def defs_first_path(spark, d):
    index = code_index(spark, d)
    return index["defs"].join(index["first_paths"], ["blob_id", "project"]).select(
        "version", "path", "ident", "type", "line"
    )


# --- references ----------------------------------------------------------------------


@query
def refs(spark, d):
    index = code_index(spark, d)
    return R.explode_lines(R.extract_refs(index["blobs"], index["defs"]))


@query
def refs_prose(spark, d):
    index = prose_index(spark, d)
    return R.extract_refs(index["blobs"], index["defs"]).select(
        "project", "ident", "blob_id", X.line_list_text(F.col("lines")).alias("lines"), "family"
    )


@query
def refs_config(spark, d):
    index = config_index(spark, d)
    return R.explode_lines(R.extract_refs(index["blobs"], index["defs"]))


@query
def refs_excluding_defs(spark, d):
    """Candidate references of defined names: all occurrences but the definitions'."""
    index = prose_index(spark, d)
    same = index["refs"].join(index["defs"].select("project", "ident", "blob_id").distinct(),
                              ["project", "ident", "blob_id"], "left_semi")
    return R.explode_lines(same, distinct_lines=True).select("ident", "blob_id", "line")


@query
def refs_as_of(spark, d):
    index = prose_index(spark, d)
    return R.extract_refs(index["blobs"], index["defs"], "as_of").select(
        "ident", "blob_id", F.size("lines").cast("bigint").alias("n")
    )


@query
def ref_line_lists(spark, d):
    got = code_index(spark, d)["refs"]
    text = X.line_list_text(F.col("lines"))
    return got.select(
        "ident", "blob_id", text.alias("lines"),
        F.aggregate(X.parse_line_list(text), F.lit(0), lambda a, x: a + x).cast("bigint").alias("line_sum"),
    )


@query
def index_stats_code(spark, d):
    index = code_index(spark, d)
    return index_stats(index, code_versions(index["paths"]))


# --- documentation -----------------------------------------------------------------


@query
def docs(spark, d):
    return DOC.extract_docs(code_index(spark, d)["blobs"])


@query
def docs_first(spark, d):
    return DOC.docs_first(code_index(spark, d)["docs"]).select("ident", "blob_id", "family", "line")


# --- compatible strings --------------------------------------------------------------


@query
def comps(spark, d):
    return R.explode_lines(C.extract_comps(config_index(spark, d)["blobs"]))


@query
def comp_docs(spark, d):
    index = config_index(spark, d)
    return R.explode_lines(C.extract_comp_docs(index["blobs"], index["paths"], index["comps"]))


@query
def quote(spark, d):
    """Compatible strings, and lines of conversations, there and back."""
    strings = config_index(spark, d)["comps"].select("project", "ident").unionByName(
        table(spark, d, "conversations").select(F.lit("talk").alias("project"), F.col("text").alias("ident"))
    )
    return S.quoted_names(strings).select("project", "quoted", F.col("unquoted"))


@query
def search_compatible(spark, d):
    return _shown(S.search_compatible(config_index(spark, d), config_queries(spark, d)))


# --- lookups -----------------------------------------------------------------------


def _shown(result: DataFrame) -> DataFrame:
    return result.withColumn("lines", X.line_list_text(F.col("lines")))


def _code_search(spark, d) -> DataFrame:
    index = code_index(spark, d)
    versions = code_versions(index["paths"])
    return S.search_ident(index, ident_queries(spark, d), V.latest_version(versions, versions))


@query
def search_ident(spark, d):
    return _shown(_code_search(spark, d))


@query
def search_ident_config(spark, d):
    return _shown(S.search_ident(config_index(spark, d), config_queries(spark, d)))


@query
def search_ident_ranked(spark, d):
    return _shown(S.ranked(_code_result(spark, d)))


@query
def search_compatible_ranked(spark, d):
    return _shown(S.ranked(S.search_compatible(config_index(spark, d), config_queries(spark, d))))


@query
def search_ident_json(spark, d):
    """Answers of all families, in pieces small enough that many have several."""
    index, asked = config_index(spark, d), config_queries(spark, d)
    return S.search_json(S.search_ident(index, asked).unionByName(S.search_compatible(index, asked)), asked, piece=200)


@query
def ident_exists(spark, d):
    index = code_index(spark, d)
    versions = code_versions(index["paths"])
    return S.ident_exists(index, ident_queries(spark, d), V.latest_version(versions, versions))


@query
def ident_defs_by_family(spark, d):
    return S.search_ident(config_index(spark, d), config_queries(spark, d)).where(
        "section = 'definitions'"
    ).groupBy("family", "type").agg(F.count("*").alias("n"))


@query
def ident_refs_by_family(spark, d):
    """Reference predicate as a join with the table of compatible families."""
    index = config_index(spark, d)
    compat = pairs(spark, REF_COMPAT, "requested", "family")
    return (
        index["refs"].join(F.broadcast(compat), "family")
        .groupBy("requested", "ident").agg(F.sum(F.size("lines")).alias("n"))
    )


def _code_result(spark, d) -> DataFrame:
    """The answers of the code tree as a written table, for what reads them twice."""
    index = code_index(spark, d)
    path = f"{index.root}/found"
    if "found" not in index:
        _code_search(spark, d).write.mode("overwrite").parquet(path)
        index["found"] = spark.read.parquet(path)
    return index["found"]


@query
def defs_by_type(spark, d):
    return S.defs_by_type(_code_search(spark, d))


@query
def result_summary(spark, d):
    return S.result_summary(_code_result(spark, d), most=3)


@query
def queries_validated(spark, d):
    """Words of conversations as identifiers: most are valid, many are not."""
    asked = table(spark, d, "conversations").select(
        F.lit("code").alias("project"), F.col("role").alias("version"),
        F.explode(F.split("text", r"[ \n]+")).alias("ident"),
        F.substring("role", 1, 1).alias("family"),
    ).distinct()
    return S.validate_queries(asked).select("project", "version", "ident", "family", "accepted", "rejected_for")


def _completions(index: StoredIndex, compatible: bool) -> DataFrame:
    """The stored table of prefixes of an index, written when it is first asked for."""
    name = "completions-b" if compatible else "completions"
    if name not in index:
        index[name] = CM.write_completions(S.completion_names(index, compatible), f"{index.root}/{name}")
    return index[name]


@query
def autocomplete(spark, d):
    index = code_index(spark, d)
    k = F.col("o_orderkey").cast("string")
    asked = (
        table(spark, d, "orders")
        .select(
            F.explode(
                F.array(
                    F.concat(F.lit("order_"), k), F.concat(F.lit("part_"), F.substring(k, 1, 2)),
                    F.lit("supp_"), F.lit("item_1"), F.concat(F.lit("zz"), k),
                )
            ).alias("prefix")
        )
        .distinct()
        .select(F.lit("code").alias("project"), "prefix", F.lit("C").alias("family"))
    )
    return CM.complete(_completions(index, False), asked).select("project", "prefix", "family", "rank", "ident")


@query
def autocomplete_compatible(spark, d):
    index = config_index(spark, d)
    asked = lenses.offices(spark, d).select(
        F.lit("config").alias("project"),
        F.concat(F.lit("vendor"), F.col("n_nationkey").cast("string"), F.lit(",")).alias("prefix"),
        F.lit("B").alias("family"),
    )
    return CM.complete(_completions(index, True), asked).select("project", "prefix", "family", "rank", "ident")


# --- links ---------------------------------------------------------------------------

LINK_COLUMNS = ["version", "path", "line", "rule", "text", "target_kind", "target"]


def _links(index, rules, comps: DataFrame | None = None) -> DataFrame:
    return L.extract_links(index["paths"], index["blobs"], rules, comps).select(*LINK_COLUMNS)


def _config_links(spark, d, *rules) -> DataFrame:
    return _links(config_index(spark, d), rules)


def _code_links(spark, d, *rules) -> DataFrame:
    return _links(code_index(spark, d), rules)


@query
def links_comp_code(spark, d):
    return _config_links(spark, d, L.COMP_CODE)


@query
def links_comp_dts(spark, d):
    return _config_links(spark, d, L.COMP_DTS)


@query
def links_comp_docs(spark, d):
    index = config_index(spark, d)
    return _links(index, [L.COMP_DOCS], index["comps"])


@query
def links_include(spark, d):
    return _code_links(spark, d, L.INCLUDE)


@query
def links_resolved(spark, d):
    """A rule by functions: includes of files in even folders, beside the file if there, else below ``include``."""
    rule = L.LinkRule(
        "nearest", L.named("#include", '"', '"'), extensions=L.C_EXTENSIONS, hint="#include", check=True,
        when=lambda path: path.rlike("^drivers/q[0246]/"),
        resolve=lambda path, text: F.array(
            F.concat(P.dir_name(path), F.lit("/"), P.base_name(text)), F.concat(F.lit("include/"), P.base_name(text))
        ),
    )
    return _code_links(spark, d, rule)


@query
def links_sysinclude(spark, d):
    return _code_links(spark, d, L.sys_include(("drivers", "include", "net")))


@query
def links_defconfig(spark, d):
    return _config_links(spark, d, L.DEFCONFIG)


@query
def links_config_in(spark, d):
    return _config_links(spark, d, L.CONFIG_IN)


@query
def links_kconfig(spark, d):
    return _config_links(spark, d, L.KCONFIG)


@query
def links_kconfig_idents(spark, d):
    index = config_index(spark, d)
    marked = L.mark_idents(TK.token_spans(index["blobs"]), D.known_in_family(index["defs"]))
    return L.ident_links(marked, index["paths"], config=True).select(
        "version", "path", "line", "text", "target_kind", "target"
    )


@query
def links_idents(spark, d):
    index = config_index(spark, d)
    marked = L.mark_idents(TK.token_spans(index["blobs"]), D.known_in_family(index["defs"]))
    return L.ident_links(marked, index["paths"], config=False).select(
        "version", "path", "line", "text", "target_kind", "target"
    )


@query
def links_dtsi(spark, d):
    return _config_links(spark, d, L.DTSI)


@query
def links_make_dir(spark, d):
    return _config_links(spark, d, L.MAKE_DIR)


@query
def links_make_dtb(spark, d):
    return _config_links(spark, d, L.MAKE_DTB)


@query
def links_make_file(spark, d):
    return _config_links(spark, d, L.MAKE_FILE)


@query
def links_make_o(spark, d):
    return _config_links(spark, d, L.MAKE_O)


@query
def links_make_srctree(spark, d):
    return _config_links(spark, d, L.MAKE_SRCTREE)


@query
def links_make_subdir(spark, d):
    return _config_links(spark, d, L.MAKE_SUBDIR)


@query
def link_rules(spark, d):
    """Two projects with the same files, only one of which has devicetree support; each with rules of its own."""
    files = lenses.config_files(spark, d)
    both = files.unionByName(files.withColumn("project", F.lit("bare")))
    rules = {"config": (L.COMP_CODE, L.COMP_DTS, L.DEFCONFIG), "bare": (L.COMP_DTS, L.DTSI)}
    with_dts = V.dts_projects(spark, (V.VersionRules("config", dts_support=True), V.VersionRules("bare")))
    every = tuple(dict.fromkeys(r for some in rules.values() for r in some))
    found = L.extract_links(B.listing(both), B.build_blobs(both), every, allowed=L.rules_of(spark, rules), dts_projects=with_dts)
    return found.select("project", *LINK_COLUMNS)


@query
def links_html(spark, d):
    """A rule of the user's own: rooted page links, with a flag whether a page is there."""
    index = web_index(spark, d)
    href = L.LinkRule("href", L.matches(r'href="(/[^"]*)"'), absolute=True, hint="href")
    paths = index["paths"]
    there = LS.existing_paths(paths).select(
        "version", F.col("path").alias("target"), F.lit(True).alias("_there")
    ).distinct()
    return (
        L.extract_links(paths, index["blobs"], [href]).join(there, ["version", "target"], "left")
        .select("version", "path", "line", "text", "target", F.col("_there").isNotNull().alias("target_exists"))
    )
