"""Sort keys for version names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def natural_key(text: Column) -> Column:
    """A string whose byte order is the order of ``sort -V``.

    Numbers compare by value (length, then digits; the length itself is written
    with its own length before it, so that no number is too long), a number before any
    other character, letters before other signs, a tilde before everything.
    """
    digits = lambda p: F.ltrim(p, F.lit("0"))
    size = lambda p: F.length(digits(p)).cast("string")
    return F.array_join(
        F.transform(
            F.regexp_extract_all(text, F.lit(r"[0-9]+|[^0-9]"), F.lit(0)),
            lambda p: F.when(
                p.rlike("^[0-9]"),
                F.concat(F.lit("0"), F.length(size(p)).cast("string"), size(p), digits(p)),
            )
            .when(p.rlike("^[A-Za-z]$"), p)
            .when(p == "~", F.lit(" "))
            .otherwise(F.concat(F.lit("{"), p)),
        ),
        "",
    )


def release_key(version: Column) -> Column:
    """Natural order in which a release follows its own candidates."""
    return natural_key(F.concat(version, F.lit(".0")))
