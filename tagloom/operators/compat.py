"""Devicetree compatible strings in code, in device trees and in bindings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.paths import is_binding
from tagloom.functions.text import closed_lines, trim_blanks
from tagloom.schema import COMP_FAMILIES

# Fixed value: a word of a bindings document, Unicode letters included, at most one comma inside.
_WORD = r"(?U)[\w-]+,?[\w-]+"


def binding_strings(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(_WORD), F.lit(0))


def quoted_texts(line: Column) -> Column:
    """Texts between quotes, in order: every second piece that a quote follows."""
    pieces = F.split(line, '"')
    return F.filter(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda t, i: (i % 2 == 1) & (t != ""))


def strings_behind(line: Column, word: str) -> Column:
    """Quoted texts behind the first ``word`` of a line; none without it."""
    at = F.locate(word, line)
    return F.when(at > 0, quoted_texts(F.substring(line, at + len(word), F.length(line)))).otherwise(F.array().cast("array<string>"))


def strings_in_code(line: Column) -> Column:
    """What members called ``.compatible`` are set to: the quoted text right behind an equals sign."""
    behind = F.split(line, "[.]compatible")
    values = F.transform(F.slice(behind, F.lit(2), F.size(behind)), trim_blanks)
    set_to = F.transform(F.filter(values, lambda v: v.startswith("=")), lambda v: trim_blanks(F.substring(v, F.lit(2), F.length(v))))
    return F.flatten(F.transform(F.filter(set_to, lambda v: v.startswith('"')), lambda v: F.slice(quoted_texts(v), F.lit(1), F.lit(1))))


def _lines(blobs: DataFrame, pretest: Column | None = None) -> DataFrame:
    some = blobs if pretest is None else blobs.where(pretest)
    return some.select(
        "project", "blob_id", "family", F.posexplode(closed_lines(F.col("content"))).alias("_pos", "_line")
    )


def _postings(found: DataFrame) -> DataFrame:
    return (
        found.select("project", "blob_id", "family", (F.col("_pos") + 1).alias("line"), F.explode("_found").alias("ident"))
        .groupBy("project", "ident", "blob_id", "family")
        .agg(F.array_sort(F.collect_list("line")).alias("lines"))
        .select("project", "ident", "blob_id", "lines", "family")
    )


def extract_comps(blobs: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """Compatible strings of C and devicetree files, per (string, blob).

    ``projects(project)``, where given, names the projects with devicetree
    support; all others are left out.
    """
    if projects is not None:
        blobs = blobs.join(projects.select("project").distinct(), "project", "left_semi")
    lines = _lines(
        blobs, F.col("family").isin(*COMP_FAMILIES) & F.col("content").contains("compatible")
    ).where(F.col("_line").contains("compatible"))
    in_code = F.col("family") == "C"
    found = F.when(in_code, strings_in_code(F.col("_line"))).when(
        trim_blanks(F.col("_line")).startswith("compatible"), quoted_texts(F.col("_line"))
    )
    return _postings(lines.withColumn("_found", found))


def binding_blobs(blobs: DataFrame, paths: DataFrame) -> DataFrame:
    """Blobs that lie below the bindings directory at some path of some version."""
    ids = paths.where(is_binding(F.col("path"))).select("project", "blob_id").distinct()
    return blobs.join(ids, ["project", "blob_id"], "left_semi")


def binding_words(blobs: DataFrame, paths: DataFrame) -> DataFrame:
    """Every word of the bindings documents that could be a compatible string."""
    return words_of(binding_blobs(blobs, paths))


def new_binding_files(files: DataFrame, seen: DataFrame) -> DataFrame:
    """``(project, blob_id, content)``, one row per content below the bindings directory in ``files`` that
    ``seen(project, blob_id)`` lacks."""
    key = ["project", "blob_id"]
    below = files.where(is_binding(F.col("path"))).select(*key, "path", "content").join(seen, key, "left_anti")
    first = Window.partitionBy(*key).orderBy("path")
    return below.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*key, "content")


def words_of(bindings: DataFrame) -> DataFrame:
    lines = _lines(bindings.withColumn("family", F.lit("B")))
    return _postings(lines.withColumn("_found", binding_strings(F.col("_line"))))


def extract_comp_docs(blobs: DataFrame, paths: DataFrame, comps: DataFrame) -> DataFrame:
    """Words of the bindings that are compatible strings somewhere."""
    return resolve_comp_docs(binding_words(blobs, paths), comps)


def resolve_comp_docs(words: DataFrame, comps: DataFrame) -> DataFrame:
    return words.join(comps.select("project", "ident").distinct(), ["project", "ident"], "left_semi")
