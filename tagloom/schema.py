"""Tables of the index and the small fixed vocabularies they use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


_S, _I, _L = T.StringType(), T.IntegerType(), T.LongType()
_LINES = T.ArrayType(_I)

#: One row per file of a version, content included. Every source yields this.
FILES = _struct(
    ("project", _S), ("version", _S), ("path", _S), ("kind", _S), ("perm", _S),
    ("blob_id", _S), ("size", _L), ("content", _S),
)

BLOBS = _struct(
    ("project", _S), ("blob_id", _S), ("filename", _S), ("family", _S),
    ("first_version", _S), ("first_key", _S), ("size", _L), ("content", _S),
)
PATHS = _struct(
    ("project", _S), ("version", _S), ("path", _S), ("blob_id", _S),
    ("kind", _S), ("perm", _S), ("size", _L),
)
FIRST_PATHS = _struct(("project", _S), ("version", _S), ("blob_id", _S), ("path", _S))
DEFS = _struct(
    ("project", _S), ("ident", _S), ("blob_id", _S), ("type", _S), ("line", _I), ("family", _S),
)
#: Definitions as found, before cleaning; the source of ``defs`` and ``docs``.
TAGS = _struct(*[(f.name, f.dataType) for f in DEFS], ("at_start", T.BooleanType()))
#: Line lists are kept per (identifier, blob), duplicates included.
POSTINGS = _struct(
    ("project", _S), ("ident", _S), ("blob_id", _S), ("lines", _LINES), ("family", _S),
)
DOCS = _struct(
    ("project", _S), ("ident", _S), ("blob_id", _S), ("line", _I), ("family", _S),
)

INDEX_TABLES: dict[str, T.StructType] = {
    "blobs": BLOBS,
    "tags": TAGS,
    "defs": DEFS,
    "tokens": POSTINGS,
    "refs": POSTINGS,
    "docs": DOCS,
    "comps": POSTINGS,
    "comp_words": POSTINGS,
    "comp_docs": POSTINGS,
    "first_paths": FIRST_PATHS,
    "paths": PATHS,
}

#: Columns by which each table is sorted inside its files, so that parquet
#: row-group statistics can skip rows on a point or prefix filter.
SORT_COLUMNS: dict[str, list[str]] = {
    "blobs": ["blob_id"],
    "tags": ["blob_id", "line"],
    "defs": ["ident", "blob_id", "line"],
    "tokens": ["ident", "blob_id"],
    "refs": ["ident", "blob_id"],
    "docs": ["ident", "blob_id", "line"],
    "comps": ["ident", "blob_id"],
    "comp_words": ["ident", "blob_id"],
    "comp_docs": ["ident", "blob_id"],
    "first_paths": ["version", "blob_id"],
    "paths": ["version", "path"],
}

# Definition types that are stored; a posting of any other type
# is dropped.
DEF_TYPES = (
    "config", "define", "enum", "enumerator", "externvar", "function", "label",
    "macro", "member", "prototype", "struct", "typedef", "union", "variable",
)

# File families. A = any (only in queries), B = compatible
# strings, C = C family, D = devicetree, K = Kconfig, M = makefile.
FAMILIES = ("A", "B", "C", "D", "K", "M")

# Which stages look at which families.
DEF_FAMILIES = ("C", "D", "K")
REF_FAMILIES = ("C", "D", "K", "M")
DOC_FAMILIES = ("C", "D", "K")
COMP_FAMILIES = ("C", "D")

# Family asked for -> families of the files whose references count.
REF_COMPAT = (
    ("A", "C"), ("A", "D"), ("A", "K"), ("A", "M"),
    ("C", "C"),
    ("D", "D"),
    ("K", "C"), ("K", "K"), ("K", "M"),
)

# Family of a file -> families of definitions that mark an
# identifier in it as known. Files of family D also know macros defined in C.
KNOWN_COMPAT = (("C", "C"), ("C", "K"), ("K", "K"), ("D", "D"), ("M", "K"))
MACRO_COMPAT = (("D", "C"),)

BINDINGS_PREFIX = "Documentation/devicetree/bindings"


def pairs(spark: SparkSession, rows, left: str, right: str) -> DataFrame:
    """A fixed pair list as a (tiny) dimension table."""
    return spark.createDataFrame(list(rows), _struct((left, _S), (right, _S)))
