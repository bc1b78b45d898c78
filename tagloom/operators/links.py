"""Links from a file to other files and to identifiers, by rule."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.paths import (
    C_EXTENSIONS, DTS_EXTENSIONS, dir_name, extension, is_binding, join_path, stem,
)
from tagloom.functions.text import pack_id, split_lines, trim_blanks
from tagloom.operators.compat import binding_strings, strings_behind, strings_in_code
from tagloom.operators.listing import existing_paths


Reader = Callable[[Column], Column]


@dataclass(frozen=True)
class LinkRule:
    """One kind of link.

    Applies to files by ``extensions``, ``stems`` or ``suffix`` (of the path), and not to paths matching
    ``except_paths``. ``read`` makes an array of link texts of a line that holds ``hint``; a line other
    than the first comes with a newline before it. The target is an identifier of family
    ``ident_family``, or a path: ``target`` with ``{}`` for the text, taken from the directory of the file
    or, when ``absolute``, from the root. ``check`` keeps links to existing paths only; several ``target``
    forms are then tried in order. ``gated`` rules hold in projects with devicetree support only.

    What options can't say is said by functions of columns: ``when`` tests the path beside them, ``resolve`` makes
    the target paths, an array in order of preference, of the path and the link text instead of ``target``. Both
    become part of the plan; ``resolve`` may give null or an empty array for no link.
    """

    name: str
    read: Reader
    extensions: tuple[str, ...] = ()
    stems: tuple[str, ...] = ()
    suffix: str = ""
    bindings: bool = False
    except_paths: str = ""
    skip_prefix: str = ""
    ident_family: str = ""
    target: tuple[str, ...] = ("{}",)
    absolute: bool = False
    check: bool = False
    hint: str = ""
    gated: bool = False
    when: Callable[[Column], Column] | None = None
    resolve: Callable[[Column, Column], Column] | None = None


# --- readers -----------------------------------------------------------------

_NONE = "array<string>"


def _only(condition: Column, text: Column) -> Column:
    return F.when(condition, F.array(text)).otherwise(F.array().cast(_NONE))


def named(keyword: str, opening: str, closing: str, last: bool = False) -> Reader:
    """The text between ``opening`` and the next (or last) ``closing`` of a line that begins with ``keyword``."""

    def read(line: Column) -> Column:
        body = trim_blanks(line)
        rest = trim_blanks(F.substring(body, F.lit(len(keyword) + 1), F.length(body)))
        inner = F.substring(rest, F.lit(2), F.length(rest))
        text = F.substring_index(inner, closing, 1)
        if last:
            text = F.substring(inner, F.lit(1), F.length(inner) - F.length(F.substring_index(inner, closing, -1)) - 1)
        return _only(body.startswith(keyword) & rest.startswith(opening) & inner.contains(closing), text)

    return read


def words(line: Column) -> Column:
    """Words with blank space before them."""
    parts = F.split(line, "[ \t\r\n]+")
    return F.slice(parts, F.lit(2), F.size(parts))


def _is_path(text: Column, signs: str = "-") -> Column:
    return text.rlike(f"^[A-Za-z0-9_/{signs}]+$")


def _file_path(text: Column) -> Column:
    """A directory and a file name: ``a/b.c``, not from the root."""
    name = F.substring_index(text, "/", -1)
    folder = F.substring(text, F.lit(1), F.length(text) - F.length(name))
    return text.contains("/") & ~text.startswith("/") & (name != "") & _is_path(text, ".-") & ~folder.contains(".")


def _values(line: Column) -> Column:
    """What stands behind blank space or an equals sign, without a ``-I`` before it, up to a bracket."""
    parts = F.flatten(F.transform(words(line), lambda w: F.split(w, "=")))
    return F.transform(parts, lambda p: F.substring_index(F.when(p.startswith("-I"), F.substring(p, F.lit(3), F.length(p))).otherwise(p), ")", 1))


def make_dirs(line: Column) -> Column:
    found = F.filter(words(line), lambda w: w.endswith("/") & (F.length(w) > 1) & _is_path(w))
    return F.transform(found, lambda w: F.substring(w, F.lit(1), F.length(w) - 1))


def make_dtbs(line: Column) -> Column:
    before = lambda w: F.substring(w, F.lit(1), F.length(w) - F.length(F.substring_index(w, ".dtb", -1)) - 4)
    return F.filter(F.transform(F.filter(words(line), lambda w: w.contains(".dtb")), before), lambda t: _is_path(t, "+.-"))


def make_files(line: Column) -> Column:
    return F.filter(_values(line), _file_path)


def make_objects(line: Column) -> Column:
    """``x.o``, unless it is assigned to."""
    w = words(line)
    ended = lambda t: ~F.substring(t, F.length(F.substring_index(t, ".o", 1)) + 3, F.lit(1)).rlike("[A-Za-z0-9_]")
    assigned = lambda i: F.coalesce(F.get(w, i + 1).isin("=", ":="), F.lit(False))
    found = F.filter(w, lambda t, i: t.contains(".o") & ended(t) & ~(t.endswith(".o") & assigned(i)))
    return F.filter(F.transform(found, lambda t: F.substring_index(t, ".o", 1)), lambda t: _is_path(t))


def make_from_root(line: Column) -> Column:
    root = "$(srctree)/"
    # The bracket of the variable would end a value: it is taken off first.
    plain = F.replace(line, F.lit(root), F.lit("\x01"))
    found = F.filter(_values(plain), lambda t: t.startswith("\x01"))
    return F.filter(F.transform(found, lambda t: F.substring(t, F.lit(2), F.length(t))), lambda t: ~t.contains("/") & _is_path(t, ".-") | _file_path(t))


def make_subdirs(line: Column) -> Column:
    w = words(line)
    at = F.filter(F.transform(w, lambda t, i: F.when(t.endswith("subdir-y") & F.get(w, i + 1).isin("+=", ":="), F.get(w, i + 2))), lambda t: t.isNotNull())
    return F.filter(F.transform(at, lambda t: F.regexp_extract(t, "^[A-Za-z0-9_-]+", 0)), lambda t: t != "")


def config_names(line: Column) -> Column:
    behind = F.split(line, "CONFIG_")
    tails = F.transform(F.slice(behind, F.lit(2), F.size(behind)), lambda t: F.regexp_extract(t, "^[A-Za-z0-9_]+", 0))
    return F.transform(F.filter(tails, lambda t: t != ""), lambda t: F.concat(F.lit("CONFIG_"), t))


def matches(pattern: str) -> Reader:
    """Group 1 of every match of a pattern of the user's own."""
    return lambda line: F.regexp_extract_all(line, F.lit(pattern), F.lit(1))


def plain_source(line: Column) -> Column:
    return F.filter(named("source", '"', '"')(line), lambda t: _is_path(t, ".-"))


_CODE = C_EXTENSIONS + DTS_EXTENSIONS
_MAKE = ("Makefile",)

COMP_CODE = LinkRule("comp_code", strings_in_code, extensions=C_EXTENSIONS, ident_family="B", hint="compatible", gated=True)
COMP_DTS = LinkRule("comp_dts", lambda line: strings_behind(line, "compatible"), extensions=DTS_EXTENSIONS,
                    ident_family="B", hint="compatible", gated=True)
COMP_DOCS = LinkRule("comp_docs", binding_strings, bindings=True, ident_family="B", gated=True)
INCLUDE = LinkRule("include", named("#include", '"', '"'), extensions=_CODE, hint="#include")
SYS_INCLUDE = LinkRule("sysinclude", named("#include", "<", ">"), extensions=_CODE, skip_prefix="asm/",
                       target=("include/{}",), absolute=True, check=True, hint="#include")
DEFCONFIG = LinkRule("defconfig", config_names, suffix="defconfig", ident_family="K", hint="CONFIG_")
CONFIG_IN = LinkRule("config_in", named("source", '"', '"', last=True), stems=("Config",), absolute=True, hint="source")
KCONFIG = LinkRule("kconfig", plain_source, stems=("Kconfig",), absolute=True, hint="source")
DTSI = LinkRule("dtsi", named("/include/", '"', '"'), extensions=DTS_EXTENSIONS, hint="/include/")
MAKE_DIR = LinkRule("make_dir", make_dirs, stems=_MAKE, target=("{}/Makefile",), check=True, hint="/")
MAKE_DTB = LinkRule("make_dtb", make_dtbs, stems=_MAKE, target=("{}.dts",), hint=".dtb")
MAKE_FILE = LinkRule("make_file", make_files, stems=_MAKE, check=True, hint="/")
MAKE_O = LinkRule("make_o", make_objects, stems=_MAKE, target=("{}.c",), hint=".o")
MAKE_SRCTREE = LinkRule("make_srctree", make_from_root, stems=_MAKE, absolute=True, check=True, hint="$(srctree)/")
MAKE_SUBDIR = LinkRule("make_subdir", make_subdirs, stems=_MAKE, target=("{}/Makefile",), hint="subdir-y")

DEFAULT_LINKS = (COMP_CODE, COMP_DTS, COMP_DOCS, INCLUDE)
KCONFIG_LINKS = (KCONFIG, DEFCONFIG)
MAKE_LINKS = (MAKE_O, MAKE_DTB, MAKE_DIR, MAKE_FILE, MAKE_SUBDIR, MAKE_SRCTREE)


def sys_include(prefixes=("include",), except_paths: str = "") -> LinkRule:
    """System includes searched below several directories, first hit wins."""
    return replace(SYS_INCLUDE, target=tuple(p + "/{}" for p in prefixes), except_paths=except_paths)


def applies(rule: LinkRule) -> Column:
    path = F.col("path")
    tests = []
    if rule.extensions:
        tests.append(F.lower(extension(path)).isin(*rule.extensions))
    if rule.stems:
        tests.append(stem(path).isin(*rule.stems))
    if rule.suffix:
        tests.append(path.endswith(rule.suffix))
    if rule.bindings:
        tests.append(is_binding(path))
    if rule.when:
        tests.append(F.coalesce(rule.when(path), F.lit(False)))
    test = reduce(lambda a, b: a & b, tests) if tests else F.lit(True)
    return test & ~path.rlike(rule.except_paths) if rule.except_paths else test


def _found(rule: LinkRule) -> Column:
    """Links of one rule on one line, as an array of structs."""
    line = F.col("_line")
    structs = F.transform(rule.read(line), lambda t: F.struct(F.lit(rule.name).alias("rule"), t.alias("text")))
    if rule.skip_prefix:
        structs = F.filter(structs, lambda s: ~s["text"].startswith(rule.skip_prefix))
    if not rule.hint:
        return structs
    return F.when(line.contains(rule.hint), structs).otherwise(F.array().cast("array<struct<rule:string,text:string>>"))


def _texts(blobs: DataFrame, rules) -> DataFrame:
    return (
        blobs.select("project", "blob_id", F.posexplode(split_lines(F.col("content"))).alias("_pos", "_line"))
        # The newline before a line counts as blank space in front of a word.
        .withColumn("_line", F.when(F.col("_pos") > 0, F.concat(F.lit("\n"), "_line")).otherwise(F.col("_line")))
        .select(
            "project", "blob_id", (F.col("_pos") + 1).alias("line"),
            F.posexplode(F.concat(*[_found(r) for r in rules])).alias("nth", "_l"),
        )
        .select("project", "blob_id", "line", "nth", "_l.rule", "_l.text")
    )


def raw_links(paths: DataFrame, blobs: DataFrame, rules) -> DataFrame:
    """Link texts per blob, before targets are worked out.

    Texts are read where the blobs lie, from blobs that hold a rule's hint; content never moves, only what was
    read meets the paths. Rules without a hint read blobs that one of their paths asks for.
    """
    hinted, free = [r for r in rules if r.hint], [r for r in rules if not r.hint]
    out = None
    if hinted:
        some = reduce(lambda a, b: a | b, [F.col("content").contains(h) for h in sorted({r.hint for r in hinted})])
        out = _texts(blobs.where(some), hinted)
    if free:
        ids = paths.where(reduce(lambda a, b: a | b, [applies(r) for r in free])).select("project", "blob_id").distinct()
        more = _texts(blobs.join(ids, ["project", "blob_id"], "left_semi"), free)
        out = more if out is None else out.unionByName(more)
    return out


def rules_of(spark, by_project: dict[str, tuple[LinkRule, ...]]) -> DataFrame:
    """``(project, rule)``: which rules hold in which project, for :func:`extract_links`."""
    rows = [(project, r.name) for project, rules in by_project.items() for r in rules]
    return spark.createDataFrame(rows, "project string, rule string")


def extract_links(
    paths: DataFrame, blobs: DataFrame, rules, comps: DataFrame | None = None,
    allowed: DataFrame | None = None, dts_projects: DataFrame | None = None,
) -> DataFrame:
    """``(project, version, path, line, rule, text, target_kind, target)``.

    Rules with a check keep only links whose target exists in the same version;
    words of bindings documents count when ``comps`` holds them. ``allowed`` (project, rule) names the rules
    of each project, ``dts_projects`` (project) those where gated rules hold; without them all rules hold
    everywhere. Rules of the same kind with other options per project take names of their own.
    """
    rules = tuple(rules)
    rule_is = lambda r: F.col("rule") == r.name
    here = paths.select(
        "project", "version", "path", "blob_id",
        F.array_compact(F.array(*[F.when(applies(r), F.lit(r.name)) for r in rules])).alias("_rules"),
    ).where(F.size("_rules") > 0)
    if len(rules) == 1:
        here = here.drop("_rules")  # whatever is found on a path that is here is its one rule's
    found = raw_links(paths, blobs, rules)
    # Both tables are as small as the code that names projects and rules.
    if allowed is not None:
        found = found.join(F.broadcast(allowed.select("project", "rule").distinct()), ["project", "rule"], "left_semi")
    if dts_projects is not None:
        gated = F.col("rule").isin(*[r.name for r in rules if r.gated])
        with_dts = F.broadcast(dts_projects.select("project").distinct().withColumn("_dts", F.lit(True)))
        found = found.join(with_dts, "project", "left").where(~gated | F.col("_dts").isNotNull()).drop("_dts")
    if comps is not None:
        docs = [r.name for r in rules if r.bindings]
        is_doc = F.col("rule").isin(*docs) if docs else F.lit(False)
        strings = comps.select("project", F.col("ident").alias("text")).distinct()
        found = found.where(~is_doc).unionByName(found.where(is_doc).join(strings, ["project", "text"], "left_semi"))
    packed = lambda rows: rows.withColumn("blob_id", pack_id(F.col("blob_id")))
    links = packed(found).join(packed(here), ["project", "blob_id"])
    if len(rules) > 1:
        links = links.where(F.array_contains(F.col("_rules"), F.col("rule")))

    base = dir_name(F.col("path"))
    kind, target = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    for r in rules:
        if r.ident_family:
            value, what = F.array(F.col("text")), f"ident {r.ident_family}"
        elif r.resolve:
            value, what = F.transform(r.resolve(F.col("path"), F.col("text")), lambda t: join_path(F.lit(""), t)), "path"
        else:
            forms = [
                F.concat(*[F.lit(part) if i % 2 == 0 else F.col("text")
                           for i, part in enumerate(_interleave(form))])
                for form in r.target
            ]
            value = F.array(*[join_path(F.lit("") if r.absolute else base, f) for f in forms])
            what = "path"
        kind = F.when(rule_is(r), what).otherwise(kind)
        target = F.when(rule_is(r), value).otherwise(target)
    links = links.withColumn("target_kind", kind).withColumn("_targets", target)
    if any(r.resolve for r in rules):
        links = links.where(F.size("_targets") > 0)

    checked = [r.name for r in rules if r.check]
    columns = ["project", "version", "path", "line", "rule", "text", "target_kind"]
    if not checked:
        return links.select(*columns, F.col("_targets")[0].alias("target"))
    is_checked = F.col("rule").isin(*checked)
    tested = links.where(is_checked)
    exists = existing_paths(paths).withColumnRenamed("path", "target")
    if all(len(r.target) == 1 and not r.resolve for r in rules if r.check):
        hits = tested.withColumn("target", F.col("_targets")[0]).join(
            exists, ["project", "version", "target"], "left_semi"
        )
    else:
        # Several forms: of the existing ones, the first of each link.
        tries = tested.select(*columns, "nth", F.posexplode("_targets").alias("_i", "target"))
        hits = (
            tries.join(exists, ["project", "version", "target"], "left_semi")
            .groupBy(*columns, "nth").agg(F.min_by("target", "_i").alias("target"))
        )
    hits = hits.select(*columns, "target")
    if len(checked) == len(rules):
        return hits  # a branch for free links would read and join everything again, to find none
    return links.where(~is_checked).select(*columns, F.col("_targets")[0].alias("target")).unionByName(hits)


def _interleave(form: str) -> list[str]:
    """``a{}b`` as literal, hole, literal; even positions are literals."""
    parts = form.split("{}")
    out = [parts[0]]
    for part in parts[1:]:
        out += ["{}", part]
    return out


def mark_idents(spans: DataFrame, known: DataFrame) -> DataFrame:
    """Flag the tokens of :func:`token_spans` that files of their family know.

    ``known(project, ident, family)``. Kconfig symbols carry their prefix.
    """
    from tagloom.operators.tokens import ident_of_token

    marked = known.select("project", "ident", "family").distinct().withColumn("known", F.lit(True))
    key = ["project", "ident", "family"]
    return (
        spans.withColumn("ident", ident_of_token(F.col("token"), F.col("family")))
        .join(marked, ["ident", "project", "family"], "left")
        .select(*key, *[c for c in spans.columns if c not in key], F.coalesce("known", F.lit(False)).alias("known"))
    )


def ident_links(marked: DataFrame, paths: DataFrame, config: bool | None = None) -> DataFrame:
    """Known identifiers as links: ``CONFIG_`` names to family K, all others to
    the family of the file. ``config`` keeps one of the two kinds."""
    is_config = F.col("ident").startswith("CONFIG_")
    links = marked.where("known").withColumn(
        "target_kind",
        F.when(is_config, "ident K").otherwise(F.concat(F.lit("ident "), F.col("family"))),
    )
    if config is not None:
        links = links.where(is_config if config else ~is_config)
    return links.join(
        paths.select("project", "version", "path", "blob_id"), ["project", "blob_id"]
    ).select(
        "project", "version", "path", "line", "start", "end",
        F.col("token").alias("text"), "target_kind", F.col("ident").alias("target"),
    )
