"""Text expressions: decoding, hashing, quoting, masking, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decode_text(raw: Column) -> Column:
    """UTF-8 where the whole file is valid UTF-8, Latin-1 otherwise."""
    return F.when(F.is_valid_utf8(raw.cast("string")), F.decode(raw, "UTF-8")).otherwise(
        F.decode(raw, "ISO-8859-1")
    )


def blob_hash(content: Column) -> Column:
    """The git object name of a blob with this content (string or binary)."""
    raw = content.cast("binary")
    head = F.concat(F.lit("blob "), F.octet_length(raw).cast("string"), F.lit("\0"))
    return F.sha1(F.concat(head.cast("binary"), raw))


def pack_id(blob_id: Column) -> Column:
    """A blob's name as bytes to cross the network with: hexadecimal digits halve, any other name goes as it is, behind 21 zero bytes that no packed one has."""
    plain = F.concat(F.unhex(F.lit("00" * 21)), blob_id.cast("binary"))
    return F.when(blob_id.rlike("^[0-9a-f]{40}\\z"), F.unhex(blob_id)).otherwise(plain)


def unpack_id(packed: Column) -> Column:
    """Undo :func:`pack_id`."""
    plain = F.substring(packed, F.lit(22), F.octet_length(packed)).cast("string")
    return F.when(F.octet_length(packed) == 20, F.lower(F.hex(packed))).otherwise(plain)


def with_packed_id(rows: DataFrame) -> DataFrame:
    """``rows`` with the bytes of :func:`pack_id` as ``blob_id``."""
    return rows.withColumn("blob_id", pack_id(F.col("blob_id")))


def quote(text: Column) -> Column:
    """Percent-encoding that leaves letters, digits and ``_.-~/`` alone."""
    out = F.url_encode(text)
    for old, new in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def unquote(text: Column) -> Column:
    """Undo :func:`quote`; text that is no valid encoding comes back as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def closed_lines(text: Column) -> Column:
    """Lines ended by a newline; an unterminated last line is left out."""
    return F.slice(split_lines(text), F.lit(1), F.size(split_lines(text)) - 1)


def running_sums(sizes: Column, chunk: int = 64) -> Column:
    """Sums of an array up to each of its places: of whole chunks first, then within each, so that a long
    array costs little more than its length."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda acc, x: acc + x)
    chunks = F.transform(
        F.when(F.size(sizes) > 0, F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / chunk).cast("int"))).otherwise(F.array().cast("array<int>")),
        lambda k: F.slice(sizes, k * chunk + 1, F.lit(chunk)),
    )
    sums = F.transform(chunks, total)
    bases = F.transform(sums, lambda _, k: total(F.slice(sums, F.lit(1), k)))
    return F.flatten(F.zip_with(chunks, bases, lambda part, base: F.transform(part, lambda _, i: base + total(F.slice(part, F.lit(1), i + 1)))))


def trim_blanks(text: Column) -> Column:
    """The text without blank space before it."""
    return F.ltrim(text, F.lit(" \t\r\n\f\x0b"))


def count_newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def line_list_text(lines: Column) -> Column:
    """``64,64,71``"""
    return F.array_join(F.transform(lines, lambda x: x.cast("string")), ",")


def parse_line_list(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda x: x.cast("int"))


# --- masking -----------------------------------------------------------------
#
# Text is cut into whole pieces by one flat alternation. No group around it is
# repeated by backtracking: repeated groups are possessive, which java.util.regex
# runs as a loop, so the length of a comment, a string or a blank stretch never
# shows on the stack. Pieces that hold no code are blanked, newlines kept.


#: A comment up to its end, without a step back for each character.
COMMENT = r"/\*[^*]*+(?:\*(?!/)[^*]*+)*+\*/"


def _pieces(word: str) -> str:
    """Delimiter text as the tokeniser sees it.

    A string is one character other than an apostrophe, a quote, and text up to
    the closing quote. A quote right behind a longer word opens no string, so
    words are eaten whole; a one-letter word before a quote belongs to the
    string (``L"x"``).
    """
    return (
        rf"{COMMENT}"
        r"|//[^\n]*\n"
        r"""|[^']"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+\""""
        r"|# *include *<[^>]*>"
        rf"""|(?:[{word}][{word}]++|[{word}](?!")|'|[^{word}"/#']+(?!"))++"""
        r"|[\s\S]"
    )


#: ASCII word characters; ``é`` splits words. The named class is a table in java.util.regex, ranges are tried one by one.
WORD = r"\w"
DTS_WORD = WORD + r"\-"


def blank(piece: Column) -> Column:
    """Blanks for all characters but newlines."""
    spaces = lambda line: F.repeat(F.lit(" "), F.length(line))
    return F.when(piece.contains("\n"), F.array_join(F.transform(split_lines(piece), spaces), "\n")).otherwise(spaces(piece))


def mask_noncode(text: Column, word: str = WORD) -> Column:
    """Blank comments, strings and ``#include <...>``; length and lines stay."""
    masked = F.array_join(
        F.transform(
            F.regexp_extract_all(text, F.lit(_pieces(word)), F.lit(0)),
            lambda p: F.when(
                (F.length(p) > 1)
                & (F.substring(p, 1, 1).isin("/", "#") | (F.substring(p, 2, 1) == '"')),
                blank(p),
            ).otherwise(p),
        ),
        "",
    )
    # Most prose, and plenty of code, holds none of the openers.
    needs = text.contains('"') | text.contains("/*") | text.contains("//") | text.contains("include")
    return F.when(needs, masked).otherwise(text)


_C_PIECES = (
    rf"{COMMENT}"
    r"|//(?:\\\n|[^\n])*+"
    r"""|"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+\""""
    r"""|'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'"""
    r"|(?m:^)[ \t]*+#(?:/\*[\s\S]*?\*/|\\[\s\S]|[^\n\\/]|/(?!\*))*+"
    r"""|(?:[^"'/#\n]++|\n(?![ \t]*+#))++"""
    r"|[\s\S]"
)


def mask_for_statements(text: Column) -> Column:
    """Blank comments, literals and preprocessor directives of C text."""
    return F.array_join(
        F.transform(
            F.regexp_extract_all(text, F.lit(_C_PIECES), F.lit(0)),
            lambda p: F.when(
                (F.length(p) > 1) & p.rlike(r"""^(?:/[*/]|["']|[ \t]*#)"""),
                blank(p),
            ).otherwise(p),
        ),
        "",
    )


# --- validation --------------------------------------------------------------
#
# The characters that names and paths of a question may consist of.


def valid_project(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^[a-zA-Z0-9_.,:/-]+$"), F.lit(False))


valid_version = valid_project


def valid_ident(ident: Column) -> Column:
    return F.coalesce(ident.rlike(r"^[A-Za-z0-9_,.+?#-]+$"), F.lit(False))


def valid_path(path: Column) -> Column:
    # The range from + to = is meant: it takes in digits, ':', ';' and '<'.
    return F.coalesce(path.rlike(r"^[A-Za-z0-9_/.,+-=]*$"), F.lit(False))


def valid_family(family: Column) -> Column:
    from tagloom.schema import FAMILIES

    return F.coalesce(family.isin(*FAMILIES), F.lit(False))


def acceptable_ident(ident: Column) -> Column:
    """Two bytes at least and no leading tilde; the stop list is joined apart."""
    return (F.octet_length(ident) >= 2) & ~ident.startswith("~")
