"""Lookups for whole tables of queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.text import (
    line_list_text, quote, unquote, valid_family, valid_ident, valid_path, valid_project, valid_version, with_packed_id,
)
from tagloom.operators.defs import known_in_family
from tagloom.operators.docs import docs_first
from tagloom.operators.links import mark_idents
from tagloom.operators.listing import of_versions
from tagloom.operators.ranks import numbered
from tagloom.operators.tokens import token_spans
from tagloom.operators.versions import resolve_version
from tagloom.schema import FAMILIES, REF_COMPAT

RESULT = ["project", "version", "ident", "family", "section", "type", "path", "lines"]


def validate_queries(queries: DataFrame) -> DataFrame:
    """Add ``accepted`` and the reason of a refusal; an unknown family becomes C."""
    has = set(queries.columns)
    reason = F.when(~valid_project(F.col("project")), "project").when(
        ~valid_version(F.col("version")), "version"
    )
    if "ident" in has:
        reason = reason.when(~valid_ident(F.col("ident")), "ident")
    if "path" in has:
        reason = reason.when(~valid_path(F.col("path")), "path")
    out = queries.withColumn("rejected_for", reason).withColumn("accepted", reason.isNull())
    if "family" in has:
        out = out.withColumn(
            "family", F.when(valid_family(F.col("family")), F.col("family")).otherwise("C")
        )
    return out


def _prepared(queries: DataFrame, latest: DataFrame | None) -> DataFrame:
    out = queries.select("project", "version", "ident", "family").withColumn(
        "family", F.when(F.col("family").isin(*FAMILIES), F.col("family")).otherwise("C")
    )
    if latest is not None:
        out = resolve_version(out, latest)
    return out.distinct()


def _reference_families(requested: Column) -> Column:
    """Families of referring files that count for a requested family."""
    out = F.array().cast("array<string>")
    for family in FAMILIES:
        allowed = [f for r, f in REF_COMPAT if r == family]
        if allowed:
            out = F.when(requested == family, F.array(*[F.lit(f) for f in allowed])).otherwise(out)
    return out


def search_ident(index: dict[str, DataFrame], queries: DataFrame, latest: DataFrame | None = None,
                 dup_defs: str = "first_path", docs_per_blob: str = "first") -> DataFrame:
    """Definitions, references and documentation for a table of queries
    ``(project, version, ident, family)``.

    Postings are cut down by identifier first, then placed on the paths of the
    version asked for. Definitions show at the first path of a blob only,
    references and documentation at every path.
    """
    wanted = _prepared(queries, latest).where("family <> 'B'")
    idents = wanted.select("project", "ident").distinct()
    key = ["project", "ident"]
    by = key[::-1]  # sorts of a join tell rows by the first key, which few projects share out
    defs = index["defs"].join(idents, by, "left_semi")
    known = defs.select(*key).distinct()
    # A macro of a C file opens all definitions of its name to devicetree queries.
    c_macros = defs.where("type = 'macro' AND family = 'C'").select(*key).distinct().withColumn(
        "_c_macro", F.lit(True)
    )
    asked = wanted.join(known, by, "left_semi").join(c_macros, by, "left")
    requested = F.col("family")

    in_def = defs.select(
        *key, "blob_id", F.col("family").alias("_f"), F.lit("definitions").alias("section"), "type",
        F.array("line").alias("lines"),
    )
    refs = index["refs"].join(known, by, "left_semi").select(
        *key, "blob_id", F.col("family").alias("_f"), F.lit("references").alias("section"),
        F.lit(None).cast("string").alias("type"), "lines",
    )
    docs = index["docs"].join(known, by, "left_semi")
    if docs_per_blob == "first":
        docs = docs_first(docs)
    docs = docs.select(
        *key, "blob_id", F.col("family").alias("_f"), F.lit("documentations").alias("section"),
        F.lit(None).cast("string").alias("type"), F.array("line").alias("lines"),
    )

    def place(postings: DataFrame, paths: DataFrame, test: Column) -> DataFrame:
        return (
            postings.join(asked, by).where(test)
            .join(paths.select("project", "version", "blob_id", "path"), ["blob_id", "version", "project"])
            .select(*RESULT)
        )

    def_ok = (requested == "A") | (F.col("_f") == requested) | (
        (requested == "D") & F.coalesce(F.col("_c_macro"), F.lit(False))
    )
    ref_ok = (F.col("section") == "documentations") | F.array_contains(
        _reference_families(requested), F.col("_f")
    )
    def_paths = index["first_paths"] if dup_defs == "first_path" else index["paths"]
    return place(in_def, def_paths, def_ok).unionByName(
        place(refs.unionByName(docs), index["paths"], ref_ok)
    )


#: Sections of an answer in the order they are shown; bindings of compatible strings stand in for definitions, device trees for references.
SECTIONS = {"definitions": "definitions", "references": "references", "documentations": "documentations", "code": "definitions", "dts": "references"}


def _result_order() -> list[Column]:
    return [F.desc("type"), F.col("path"), F.col("lines")]


def ranked(result: DataFrame) -> DataFrame:
    """``result`` with ``rank``, from 1 within each section of a query: definitions by type from the back, path, line; the rest by path.

    A query with most of the rows is numbered by many tasks."""
    return numbered(result, ["project", "version", "ident", "family", "section"], _result_order())


def ident_exists(index: dict[str, DataFrame], queries: DataFrame, latest: DataFrame | None = None) -> DataFrame:
    """Whether each identifier is defined in any version, and whether the
    version asked for is indexed."""
    wanted = _prepared(queries, latest)
    # Only names that are asked for get as far as the dedup.
    asked = wanted.select("project", "ident").distinct()
    among = lambda table: index[table].select("project", "ident").join(asked, ["project", "ident"], "left_semi").distinct()
    defined = among("defs").withColumn("_d", F.lit(True))
    strings = among("comps").withColumn("_b", F.lit(True))
    there = index["paths"].select("project", "version").distinct().withColumn("_v", F.lit(True))
    return (
        wanted.join(defined, ["project", "ident"], "left")
        .join(strings, ["project", "ident"], "left")
        .join(there, ["project", "version"], "left")
        .select(
            "project", "version", "ident", "family",
            F.when(F.col("family") == "B", F.col("_b").isNotNull()).otherwise(F.col("_d").isNotNull()).alias("symbol_exists"),
            F.col("_v").isNotNull().alias("version_indexed"),
        )
    )


def search_compatible(index: dict[str, DataFrame], queries: DataFrame, latest: DataFrame | None = None) -> DataFrame:
    """Where compatible strings are bound in code, used in device trees, and
    documented, for queries of family B."""
    wanted = _prepared(queries, latest).where("family = 'B'")
    key = ["project", "ident"]
    comps = index["comps"].join(wanted.select(*key).distinct(), key, "left_semi")
    known = comps.select(*key).distinct()
    docs = index["comp_docs"].join(known, key, "left_semi")
    postings = comps.select(
        *key, "blob_id", "lines",
        F.when(F.col("family") == "C", "code").otherwise("dts").alias("section"),
        F.when(F.col("family") == "C", "compatible").alias("type"),
    ).unionByName(
        docs.select(*key, "blob_id", "lines", F.lit("documentations").alias("section"),
                    F.lit(None).cast("string").alias("type"))
    )
    return (
        postings.join(wanted, key)
        .join(index["paths"].select("project", "version", "blob_id", "path"), ["project", "version", "blob_id"])
        .select(*RESULT)
    )


def search_json(result: DataFrame, queries: DataFrame, piece: int = 1 << 20) -> DataFrame:
    """Answers as JSON in pieces: ``(project, version, ident, family, piece, json)``, pieces numbered from 0 (a row longer than a
    piece leaves numbers out).

    Each piece is an object with the lists ``definitions``, ``references`` and ``documentations``; an answer is their lists
    joined in order of the pieces. A piece holds the rows whose text starts within its ``piece`` characters
    of the answer, so that no answer is ever whole in a task. Queries that found nothing have one piece of empty lists.
    """
    keys = ["project", "version", "ident", "family"]
    first, none = F.element_at("lines", 1), F.lit(None).cast("string")
    defined = F.to_json(F.struct("path", first.alias("line"), "type"), {"ignoreNullFields": "false"})
    placed = F.to_json(F.struct("path", line_list_text(F.col("lines")).alias("line"), F.coalesce("type", none).alias("type")), {"ignoreNullFields": "false"})
    names = F.create_map(*[F.lit(x) for pair in SECTIONS.items() for x in pair])
    rows = result.select(
        *keys, names[F.col("section")].alias("section"), "type", "path", "lines",
        F.when(F.col("section") == "definitions", defined).otherwise(placed).alias("item"),
    )
    lists = list(dict.fromkeys(SECTIONS.values()))
    place = F.array_position(F.array(*[F.lit(n) for n in lists]), F.col("section"))
    told = numbered(rows, keys, [place, *_result_order()], size=F.length("item") + 1)
    found = told.groupBy(*keys, F.expr(f"before DIV {piece}").alias("piece")).agg(
        F.array_sort(F.collect_list(F.struct("rank", "section", "item"))).alias("items")
    )
    part = lambda name: F.array_join(F.transform(F.filter("items", lambda x: x["section"] == name), lambda x: x["item"]), ",")
    text = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{n}":['), part(n), F.lit("]")) for n in lists]), F.lit("}"))
    nothing = "{" + ",".join(f'"{n}":[]' for n in lists) + "}"
    return (
        queries.select(*keys).distinct()
        .join(found.select(*keys, "piece", text.alias("json")), keys, "left")
        .select(*keys, F.coalesce("piece", F.lit(0)).cast("long").alias("piece"), F.coalesce("json", F.lit(nothing)).alias("json"))
    )


def marked_file(index: dict[str, DataFrame], keys: DataFrame) -> DataFrame:
    """``(project, version, path, line, start, end, text, known)``: the identifiers of the files that
    ``keys(project, version, path)`` name, with a flag for those their family knows.

    A file of no family is one row, its whole content as ``text``, without line and span.
    """
    key = ["blob_id", "project"]
    asked = with_packed_id(of_versions(index["paths"], keys)).join(
        keys.select("project", "version", "path").distinct(), ["version", "path", "project"]
    ).select("project", "version", "path", "blob_id")
    blobs = with_packed_id(index["blobs"]).join(asked.select(*key).distinct(), key, "left_semi")
    spans = mark_idents(token_spans(blobs), known_in_family(index["defs"])).select(*key, "line", "start", "end", F.col("token").alias("text"), "known")
    plain = blobs.where("family IS NULL").select(
        *key, *[F.lit(None).cast("int").alias(c) for c in ("line", "start", "end")], F.col("content").alias("text"), F.lit(False).alias("known")
    )
    return spans.unionByName(plain).join(asked, key).select("project", "version", "path", "line", "start", "end", "text", "known")


def defs_by_type(result: DataFrame) -> DataFrame:
    """Definition sections of each query: rows and files per type."""
    return result.where("section = 'definitions'").groupBy(
        "project", "version", "ident", "family", "type"
    ).agg(F.count("*").alias("n_rows"), F.countDistinct("path").alias("n_files"))


def result_summary(result: DataFrame, most: int = 100) -> DataFrame:
    """Rows with their lines, and as they are shown: in a section of more than ``most`` rows the
    line numbers shown give way to their count."""
    keys = ["project", "version", "ident", "family", "section"]
    sizes = result.groupBy(*keys).agg(F.count("*").alias("n_rows"))
    return result.join(sizes, keys).select(
        *keys, "type", "path", "n_rows", F.size("lines").cast("bigint").alias("n_lines"),
        line_list_text(F.col("lines")).alias("lines"),
        F.when(F.col("n_rows") <= most, line_list_text(F.col("lines"))).alias("shown_lines"),
    )


# --- completion ----------------------------------------------------------------


def completion_names(index: dict[str, DataFrame], compatible: bool) -> DataFrame:
    table = index["comps"] if compatible else index["defs"]
    return table.select("project", "ident").distinct()


def complete_prefix(index: dict[str, DataFrame], project: str, prefix: str, family: str = "C",
                    k: int = 10) -> DataFrame:
    """First ``k`` names from ``prefix`` on; the prefix test reaches the scan."""
    names = (index["comps"] if family == "B" else index["defs"]).where(
        (F.col("project") == project) & F.col("ident").startswith(prefix)
    )
    return names.select("ident").distinct().orderBy("ident").limit(k)


def autocomplete(index: dict[str, DataFrame], prefixes: DataFrame, k: int = 10,
                 scope: str = "all") -> DataFrame:
    """First ``k`` names per query ``(project, prefix, family)``, in byte order.

    Names are cut to the prefix lengths that are asked for, and only prefixes that
    are asked for are ranked; of each the first ``k`` names go on: the ranking limit
    works inside each map task, so a prefix shared by a third of all names costs no
    more than others. Prefixes then meet queries in an equi join.
    """
    asked = prefixes.select(
        "project", "prefix",
        F.when(F.col("family").isin(*FAMILIES), F.col("family")).otherwise("C").alias("family"),
    ).distinct()
    lengths = asked.select("project", F.length("prefix").alias("_len")).distinct()

    def answer(wanted: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
        ranked = Window.partitionBy(*keys, "prefix").orderBy("ident")
        firsts = (
            names.withColumn("_len", F.explode(F.sequence(F.lit(0), F.length("ident"))))
            .join(lengths, ["project", "_len"], "left_semi")
            .withColumn("prefix", F.substring(F.col("ident"), F.lit(1), F.col("_len")))
            .join(wanted.select(*keys, "prefix").distinct(), [*keys, "prefix"], "left_semi")
            .withColumn("rank", F.row_number().over(ranked))
            .where(F.col("rank") <= k)
        )
        return wanted.join(firsts, [*keys, "prefix"]).select("project", "prefix", "family", "rank", "ident")

    if scope == "family":
        symbols, keys = index["defs"].select("project", "ident", "family").distinct(), ["project", "family"]
    else:
        symbols, keys = completion_names(index, False), ["project"]
    return answer(asked.where("family <> 'B'"), symbols, keys).unionByName(
        answer(asked.where("family = 'B'"), completion_names(index, True), ["project"])
    )


def quoted_names(postings: DataFrame) -> DataFrame:
    """Compatible strings in percent-encoded form and back."""
    return postings.select("project", "ident").distinct().select(
        "project", "ident", quote(F.col("ident")).alias("quoted"),
        unquote(quote(F.col("ident"))).alias("unquoted"),
    )
