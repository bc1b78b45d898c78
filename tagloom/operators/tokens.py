"""Tokenising blobs into identifiers with line numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.text import DTS_WORD, WORD, mask_noncode, running_sums, split_lines, unpack_id, with_packed_id
from tagloom.schema import REF_FAMILIES
from tagloom.session import spread

#: Words of a line above which the places of all are summed up beforehand.
LONG_LINE = 64


def masked_text(text: Column, family: Column) -> Column:
    """Devicetree text keeps ``-`` inside words, all other text splits at it."""
    return F.when(family == "D", mask_noncode(text, DTS_WORD)).otherwise(mask_noncode(text, WORD))


def _words(line: Column, family: Column) -> Column:
    return F.when(
        family == "D", F.regexp_extract_all(line, F.lit(f"[{DTS_WORD}]+"), F.lit(0))
    ).otherwise(F.regexp_extract_all(line, F.lit(f"[{WORD}]+"), F.lit(0)))


def _drop_edge_words(text: Column, family: Column) -> Column:
    """Blank a word with no delimiter before it (start) or behind it (end)."""

    def cut(word: str) -> Column:
        out = F.when(
            F.substring(text, 1, 1).rlike(f"[{word}]"), F.regexp_replace(text, rf"\A[{word}]+", " ")
        ).otherwise(text)
        return F.when(
            F.substring(text, -1, 1).rlike(f"[{word}]"), F.regexp_replace(out, rf"[{word}]+\z", " ")
        ).otherwise(out)

    return F.when(family == "D", cut(DTS_WORD)).otherwise(cut(WORD))


def tokenize(blobs: DataFrame, edge_tokens: str = "drop") -> DataFrame:
    """One row per token occurrence: ``(project, blob_id, family, line, token)``.

    A word with no delimiter before it (start of the file) or behind it (end of
    the file) is not a token, unless ``edge_tokens='keep'``. Each text is masked
    once, each line matched once; nothing is shuffled.
    """
    family = F.col("family")
    masked = blobs.where(family.isin(*REF_FAMILIES)).select(
        "project", "blob_id", "family", masked_text(F.col("content"), family).alias("_m")
    )
    text = _drop_edge_words(F.col("_m"), family) if edge_tokens == "drop" else F.col("_m")
    return (
        masked.select("project", "blob_id", "family", text.alias("_m"))
        .select("project", "blob_id", "family", F.posexplode(split_lines(F.col("_m"))).alias("_pos", "_line"))
        .select(
            "project", "blob_id", "family", (F.col("_pos") + 1).alias("line"),
            F.explode(_words(F.col("_line"), family)).alias("token"),
        )
    )


def count_by_line(blobs: DataFrame) -> DataFrame:
    """``(blob_id, token, line, n)``: how often each token stands on a line, of all blobs of that name together.

    Tokens are dealt by blob, whose rows follow one another and compress, and not by all three keys.
    """
    words = tokenize(with_packed_id(blobs)).select("blob_id", "token", "line")
    counted = spread(words, "blob_id").groupBy("blob_id", "token", "line").agg(F.count("*").alias("n"))
    return counted.withColumn("blob_id", unpack_id(F.col("blob_id")))


def ident_of_token(token: Column, family: Column) -> Column:
    """Kconfig symbols are known as ``CONFIG_<symbol>``."""
    return F.when(family == "K", F.concat(F.lit("CONFIG_"), token)).otherwise(token)


def token_spans(blobs: DataFrame) -> DataFrame:
    """Tokens with their column span ``[start, end)`` on the line, from 0.

    Masking keeps lengths, so the span holds in the raw text too. A token starts behind the words and gaps before it:
    their text is joined again, or, on a line of more than ``LONG_LINE`` words, their lengths are summed once for all.
    All of this stays inside the line's row: nothing is shuffled.
    """
    family = F.col("family")
    lines = (
        blobs.where(family.isin(*REF_FAMILIES))
        .select("project", "blob_id", "family", split_lines(masked_text(F.col("content"), family)).alias("_lines"))
        .select("project", "blob_id", "family", F.size("_lines").alias("_n"), F.posexplode("_lines").alias("_pos", "_line"))
    )
    gaps = F.when(family == "D", F.split("_line", f"[{DTS_WORD}]+", -1)).otherwise(F.split("_line", f"[{WORD}]+", -1))
    parts = lines.select(
        "project", "blob_id", "family", (F.col("_pos") + 1).alias("line"),
        F.when(F.col("_pos") == F.col("_n") - 1, F.length("_line")).alias("_eof"),
        _words(F.col("_line"), family).alias("_words"), gaps.alias("_gaps"),
    )
    # The gap before each word and the word, as one length.
    steps = F.zip_with(F.slice("_gaps", F.lit(1), F.size("_words")), "_words", lambda g, w: F.length(g) + F.length(w))
    words = parts.withColumn("_ends", F.when(F.size("_words") > LONG_LINE, running_sums(steps))).select(
        "project", "blob_id", "family", "line", "_eof", "_words", "_gaps", "_ends", F.posexplode("_words").alias("_k", "token")
    )
    before = lambda column, n: F.length(F.array_join(F.slice(column, F.lit(1), n), ""))
    start = F.when(F.col("_ends").isNull(), before("_gaps", F.col("_k") + 1) + before("_words", F.col("_k"))).otherwise(
        F.get("_ends", F.col("_k")) - F.length("token")
    )
    spans = words.select("project", "blob_id", "family", "line", "_eof", start.alias("start"), "token").withColumn("end", F.col("start") + F.length("token"))
    return spans.where(
        ((F.col("line") > 1) | (F.col("start") > 0)) & (F.col("_eof").isNull() | (F.col("end") < F.col("_eof")))
    ).select("project", "blob_id", "family", "line", "start", "end", "token")
