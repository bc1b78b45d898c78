"""Path and file-name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    """Everything before the last slash; empty for a top-level name."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """Last dot and what follows; the dots a name starts with do not count."""
    return F.regexp_extract(base_name(path), r"^\.*[^.].*(\.[^.]*)$", 1)


def stem(path: Column) -> Column:
    base = base_name(path)
    return F.substring(base, F.lit(1), F.length(base) - F.length(extension(path)))


# Extensions of each family, lower case.
C_EXTENSIONS = (".c", ".cc", ".cpp", ".c++", ".cxx", ".h", ".s")
DTS_EXTENSIONS = (".dts", ".dtsi")


def file_family(path: Column) -> Column:
    """Family of a file by its name, null when it belongs to none."""
    ext = F.lower(extension(path))
    name = F.lower(stem(path))
    not_rst = ext != ".rst"
    return (
        F.when(ext.isin(*C_EXTENSIONS), "C")
        .when(ext.isin(*DTS_EXTENSIONS), "D")
        .when(name.startswith("kconfig") & not_rst, "K")
        .when((name.startswith("makefile") & not_rst) | (ext == ".mk"), "M")
    )


def strip_slashes(path: Column) -> Column:
    return F.regexp_replace(path, r"^/+|/+$", "")


def normalize(path: Column) -> Column:
    """Resolve ``.``, ``..`` and doubled slashes; the result has no leading slash."""
    return F.array_join(
        F.aggregate(
            F.split(path, "/"),
            F.array().cast("array<string>"),
            lambda acc, part: F.when(part.isin("", "."), acc)
            .when(part == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .otherwise(F.concat(acc, F.array(part))),
        ),
        "/",
    )


def join_path(directory: Column, name: Column) -> Column:
    """``name`` seen from ``directory``; an absolute name stands for itself."""
    return normalize(F.when(name.startswith("/"), name).otherwise(F.concat_ws("/", directory, name)))


def ancestors(path: Column) -> Column:
    """All directories above a path, nearest last, the root (empty name) excluded."""
    parts = F.split(path, "/")
    return F.when(
        F.size(parts) > 1,
        F.transform(
            F.sequence(F.lit(1), F.size(parts) - 1),
            lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"),
        ),
    ).otherwise(F.array().cast("array<string>"))


def is_binding(path: Column) -> Column:
    """A plain prefix test, without a slash after the directory name."""
    from tagloom.schema import BINDINGS_PREFIX

    return path.startswith(BINDINGS_PREFIX)
