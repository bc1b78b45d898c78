"""Documentation comments: from a definition back to the comment above it.

A documentation block is an opener line (``/**``), a header line naming
something, and then only blank or comment lines up to the code line ``stop``.
All of this is decided inside the row that holds the blob. A definition is
documented by a block of its own name when the line before its head lies inside
that block, so blocks and definitions meet in one equi join on
(blob, identifier) with a range left over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.text import split_lines
from tagloom.operators.defs import DEFINE_RULE, extract_tags
from tagloom.schema import DOC_FAMILIES
from tagloom.session import spread

_KINDS = ("struct", "enum", "union", "typedef")


def _begins(text: Column, mark: str) -> Column:
    """``mark`` alone, or with blank space behind it."""
    return (text == mark) | text.startswith(mark + " ") | text.startswith(mark + "\t")


def _body(line: Column) -> Column:
    return F.ltrim(line, F.lit(" \t"))


def _opens(line: Column) -> Column:
    return _begins(_body(line), "/**")


def _passed_over(line: Column, lenient_closer: bool) -> Column:
    """Empty lines, and indented lines of a comment or with its end."""
    body = _body(line)
    star = body.startswith("*/") | _begins(body, "*")
    if lenient_closer:
        star = star | body.startswith("**/")
    return (body == "") | ((body != line) & star)


def _is_name(text: Column) -> Column:
    return F.coalesce(text.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), F.lit(False))


def header_name(line: Column) -> Column:
    """The name that the first line of a documentation comment speaks of, null if none: its first word,
    or the second behind a kind of type, up to a bracket or colon."""
    body = _body(line)
    words = F.transform(F.split(_body(F.substring(body, F.lit(2), F.length(body))), "[ \t]+"), lambda w: F.get(F.split(w, "[(:]"), F.lit(0)))
    first, second = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    typed = F.get(F.split(body, "[ \t]+"), F.lit(1)).isin(*_KINDS)
    name = F.when(typed & _is_name(second), second).when(_is_name(first), first)
    return F.when((body != line) & _begins(body, "*"), name)


def line_flags(text: Column, lenient_closer: bool = False) -> Column:
    """One character per line: ``o`` opener, ``s`` skippable, ``a`` begins with
    a letter or underscore, ``n`` other."""
    return F.array_join(
        F.transform(
            split_lines(text),
            lambda x: F.when(_opens(x), "o")
            .when(_passed_over(x, lenient_closer), "s")
            .when(x.rlike("^[A-Za-z_]"), "a")
            .otherwise("n"),
        ),
        "",
    )


def doc_blocks(blobs: DataFrame, lenient_closer: bool = False) -> DataFrame:
    """``(project, blob_id, family, ident, line, stop)``: line of the opener, and the
    first line behind the block that is neither blank nor comment."""
    flags = F.col("_flags")
    with_flags = (
        blobs.where(F.col("family").isin(*DOC_FAMILIES) & F.col("content").contains("/**"))
        .select(
            "project", "blob_id", "family", split_lines(F.col("content")).alias("_lines"),
            line_flags(F.col("content"), lenient_closer).alias("_flags"),
        )
    )
    # Flag text falls apart into runs, one per opener, in the order of the openers.
    runs = with_flags.select(
        "project", "blob_id", "family", "_lines",
        F.filter(
            F.transform("_lines", lambda x, i: F.when(_opens(x), i + 1)), lambda v: v.isNotNull()
        ).alias("_at"),
        F.regexp_extract_all(flags, F.lit("o[^o]*"), F.lit(0)).alias("_runs"),
    )
    candidates = runs.select(
        "project", "blob_id", "family",
        F.explode(
            F.filter(
                F.transform(
                    F.arrays_zip("_at", "_runs"),
                    lambda o: F.struct(
                        o["_at"].alias("line"),
                        (o["_at"] + F.length(F.regexp_extract(o["_runs"], "^os*", 0))).alias("stop"),
                        F.get(F.col("_lines"), o["_at"]).alias("header"),
                    ),
                ),
                lambda b: b["stop"] > b["line"] + 1,
            )
        ).alias("_b"),
    )
    return candidates.withColumn("_name", header_name(F.col("_b.header"))).where("_name IS NOT NULL").select(
        "project", F.col("_name").alias("ident"), "blob_id", "family",
        F.col("_b.line").cast("int").alias("line"), F.col("_b.stop").cast("int").alias("stop"),
    )


def forced_c_tags(blobs: DataFrame) -> DataFrame:
    """Documented files read as C, whatever their family."""
    some = blobs.where(F.col("family").isin(*DOC_FAMILIES) & F.col("content").contains("/**")).withColumn(
        "family", F.lit("C")
    )
    return extract_tags(some, (DEFINE_RULE,))


def doc_tags(tags: DataFrame) -> DataFrame:
    """Tags that can carry documentation: macros, functions, prototypes, types
    and variables; no members, no external variables, no assembler names."""
    return tags.where(
        (F.col("at_start").isNotNull() & ~F.col("type").isin("member", "externvar")) | (F.col("type") == "macro")
    ).withColumn("at_start", F.coalesce("at_start", F.lit(False)))


def doc_starts(blobs: DataFrame, tags: DataFrame) -> DataFrame:
    """``(project, blob_id, ident, start)``: the line before each definition's head, in blobs with documentation comments.

    One name counts per line, the last in byte order. The head of a function
    whose line begins with its name lies above the lines that begin with a
    letter or underscore (split return types), and one line more is passed over.
    """
    # Dealt by blob once: heads are found, and meet the flags of their blob, where that has put them. Only blobs that
    # hold a comment have any.
    heads = spread(doc_tags(tags), "blob_id", "project").groupBy("blob_id", "project", "line").agg(
        F.max(F.struct("ident", "type", "at_start")).alias("_d")
    ).select("project", "blob_id", "line", "_d.*")
    flags = spread(
        blobs.where(F.col("content").contains("/**")).select("project", "blob_id", line_flags(F.col("content")).alias("_flags")),
        "blob_id", "project",
    )
    above = F.length(F.regexp_extract(F.substring(F.col("_flags"), F.lit(1), F.col("line")), r"a*$", 0))
    return heads.join(flags.hint("merge"), ["blob_id", "project"]).select(
        "project", "blob_id", "ident", (F.col("line") - 1 - F.when(F.col("at_start"), above).otherwise(0)).alias("start")
    )


def extract_docs(blobs: DataFrame, tags: DataFrame | None = None, lenient_closer: bool = False) -> DataFrame:
    """Documentation postings: ``line`` is the line of the comment opener.

    ``tags`` of the C files, where they are at hand, spare reading those again;
    files of other families are read as C in any case.
    """
    if tags is None:
        tags = forced_c_tags(blobs)
    else:
        tags = tags.where("family = 'C'").unionByName(forced_c_tags(blobs.where("family <> 'C'")))
    blocks = doc_blocks(blobs, lenient_closer)
    found = blocks.join(doc_starts(blobs, tags), ["blob_id", "ident", "project"]).where(
        (F.col("start") >= F.col("line")) & (F.col("start") < F.col("stop"))
    )
    return found.select("project", "ident", "blob_id", "line", "family").distinct()


def docs_first(docs: DataFrame) -> DataFrame:
    """The one documentation line shown per (identifier, blob): the last."""
    return docs.groupBy("project", "ident", "blob_id", "family").agg(F.max("line").alias("line"))
