"""Version names: rewriting, natural order, grouping, latest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.functions.order import natural_key, release_key

Rewrites = tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Group:
    """A section of the version menu: tags that begin with ``starts`` and hold no ``without``.

    A tag, less the prefix ``strip``, falls into fields at ``sep``. The first field, with ``lead`` before
    it, is its major; the first two, the second up to where its digits end, are its minor. Either can be a
    fixed title instead. Tags of one field, or whose first field is not a number (a ``v`` may stand before
    it), have ``FIXME`` for what is not fixed.
    """

    starts: str = ""
    without: str = ""
    sep: str = "."
    strip: str = ""
    lead: str = ""
    major: str = ""
    minor: str = ""


@dataclass(frozen=True)
class VersionRules:
    """How one project names its versions. Empty patterns do not filter."""

    project: str
    rev_keep: str = ""
    to_version: Rewrites = ()
    to_rev: Rewrites = ()
    swap: tuple[str, str] | None = None
    list_keep: str = ""
    list_drop: str = ""
    list_reversed: bool = False
    groups: tuple[Group, ...] = (Group(),)
    constant: tuple[tuple[str, str, str], ...] = ()
    latest_keep: str = ""
    latest_drop: str = "-rc"
    order_as: Rewrites = ()
    dts_support: bool = False


_REWRITES = "array<struct<pattern:string,replacement:string>>"
_GROUPS = "array<struct<grp:int,starts:string,without:string,sep:string,strip:string,lead:string,major:string,minor:string>>"
_RULE_SCHEMA = (
    f"project string, rev_keep string, to_version {_REWRITES}, to_rev {_REWRITES}, swap_from string, "
    f"swap_to string, list_keep string, list_drop string, list_reversed boolean, groups {_GROUPS}, "
    f"latest_keep string, latest_drop string, order_as {_REWRITES}"
)


def _rule_row(rule: VersionRules) -> tuple:
    swap = rule.swap or ("", "")
    groups = [(i, g.starts, g.without, g.sep, g.strip, g.lead, g.major, g.minor) for i, g in enumerate(rule.groups)]
    return (rule.project, rule.rev_keep, list(rule.to_version), list(rule.to_rev), *swap, rule.list_keep,
            rule.list_drop, rule.list_reversed, groups, rule.latest_keep, rule.latest_drop, list(rule.order_as))


def _with_rules(df: DataFrame, rules) -> DataFrame:
    """Put the rule of its project beside each row, as the struct ``_r``.

    Rules are rows, one per project: the plan does not grow with their number.
    """
    table = df.sparkSession.createDataFrame([_rule_row(r) for r in rules], _RULE_SCHEMA)
    fields = [c for c in table.columns if c != "project"]
    # The rule list is code: one row per project, so broadcasting it is safe.
    beside = F.broadcast(table.select("project", F.struct(*fields).alias("_r")))
    return df.join(beside, "project", "left").withColumn("_r", F.coalesce("_r", _default_rule(table.schema)))


def _default_rule(schema) -> Column:
    """The rule of projects that have none, as a literal of the same type."""
    row = _rule_row(VersionRules(""))
    values = []
    for field, value in zip(schema.fields[1:], row[1:]):
        if isinstance(value, list):
            value = F.array(*[F.struct(*[F.lit(v) for v in item]) for item in value])
        else:
            value = F.lit(value)
        values.append(value.cast(field.dataType).alias(field.name))
    return F.struct(*values)


def _rule(name: str) -> Column:
    return F.col(f"_r.{name}")


def _matches(text: Column, keep: Column, drop: Column) -> Column:
    return ((keep == "") | F.rlike(text, keep)) & ((drop == "") | ~F.rlike(text, drop))


def _rewrite(text: Column, rewrites: Column) -> Column:
    return F.aggregate(
        rewrites, text, lambda acc, r: F.regexp_replace(acc, r["pattern"], r["replacement"])
    )


def _swap(text: Column, old: Column, new: Column) -> Column:
    return F.when(old != "", F.call_function("translate", text, old, new)).otherwise(text)


def add_rev(versions: DataFrame, rules=()) -> DataFrame:
    """Revision of each version name, worked out from the name alone."""
    back = _rewrite(_swap(F.col("version"), _rule("swap_to"), _rule("swap_from")), _rule("to_rev"))
    return _with_rules(versions, rules).withColumn("rev_again", back).drop("_r")


def list_versions(raw_tags: DataFrame, rules=()) -> DataFrame:
    """Versions of ``raw_tags(project, rev)`` with their sort keys and flags.

    ``natkey`` orders versions naturally, a release behind its candidates;
    ``latest_key`` is the plain natural order that the search for the latest
    uses. Both are strings, so any sort, range or ``max_by`` can use them.
    """
    rev, version = F.col("rev"), F.col("version")
    name = _rewrite(_swap(rev, _rule("swap_from"), _rule("swap_to")), _rule("to_version"))
    kept = _with_rules(raw_tags.select("project", "rev").distinct(), rules).where(
        (_rule("rev_keep") == "") | F.rlike(rev, _rule("rev_keep"))
    )
    return kept.withColumn("version", name).select(
        "project", "version", "rev",
        release_key(_rewrite(version, _rule("order_as"))).alias("natkey"),
        natural_key(version).alias("latest_key"),
        version.contains("-rc").alias("is_rc"),
        _matches(version, _rule("list_keep"), _rule("list_drop")).alias("is_listed"),
        _matches(version, _rule("latest_keep"), _rule("latest_drop")).alias("is_stable"),
        _rule("list_reversed").alias("is_reversed"),
    )


def dts_projects(spark: SparkSession, rules) -> DataFrame:
    """Projects with devicetree support, for the extraction of compatible strings."""
    return spark.createDataFrame([(r.project,) for r in rules if r.dts_support], "project string")


def in_natural_order(versions: DataFrame) -> DataFrame:
    return versions.orderBy("project", "natkey", "version")


def sequence_versions(versions: DataFrame, key_chars: int = 18) -> DataFrame:
    """Number the versions of each project in natural order, from 1.

    A prefix of the key is monotone in the key, so versions are counted per
    prefix, the counts are summed up, and rows are numbered inside their prefix:
    no task holds all versions of a project.
    """
    bucketed = versions.withColumn("_bucket", F.substring("natkey", 1, key_chars))
    sums = Window.partitionBy("project").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bucketed.groupBy("project", "_bucket").agg(F.count("*").alias("_n")).select(
        "project", "_bucket", F.coalesce(F.sum("_n").over(sums), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy("project", "_bucket").orderBy("natkey", "version")
    return (
        bucketed.withColumn("_row", F.row_number().over(inside))
        .join(offsets, ["project", "_bucket"])
        .withColumn("seq", F.col("_offset") + F.col("_row"))
        .drop("_bucket", "_row", "_offset")
    )


def list_projects(versions: DataFrame) -> DataFrame:
    return versions.select("project").distinct().orderBy("project")


def new_versions(listed: DataFrame, indexed: DataFrame) -> DataFrame:
    """Listed versions that are not indexed."""
    return listed.join(indexed.select("project", "version"), ["project", "version"], "left_anti")


def filter_versions(versions: DataFrame, pattern: str) -> DataFrame:
    """Versions whose name holds the pattern, upper and lower case alike."""
    return versions.where(F.col("version").rlike(f"(?i){pattern}"))


def group_versions(versions: DataFrame, rules=()) -> DataFrame:
    """Versions with section number, major and minor, one row per section they
    fall into; constant entries of the rules are appended."""
    version, g = F.col("version"), lambda name: F.col(f"_g.{name}")
    own = F.when(version.startswith(g("strip")), F.substring(version, F.length(g("strip")) + 1, F.length(version))).otherwise(version)
    first, second = F.get("_fields", F.lit(0)), F.get("_fields", F.lit(1))
    # What is left of a field without its leading digits is what follows them.
    digits = F.substring(second, F.lit(1), F.length(second) - F.length(F.ltrim(second, F.lit("0123456789"))))
    numbered = second.isNotNull() & (F.call_function("translate", first, F.lit("v0123456789"), F.lit("")) == "")
    head = F.concat(g("lead"), first)
    title = lambda fixed, made: F.when(fixed != "", fixed).when(numbered, made).otherwise("FIXME")
    grouped = (
        _with_rules(versions, rules)
        .select("project", "version", "natkey", F.explode("_r.groups").alias("_g"))
        .where(version.startswith(g("starts")) & ((g("without") == "") | ~version.contains(g("without"))))
        .withColumn("_fields", F.call_function("split", own, F.concat(F.lit(r"\Q"), g("sep"), F.lit(r"\E"))))
        .select(
            "project", "_g.grp", title(g("major"), head).alias("major"),
            title(g("minor"), F.concat(head, g("sep"), digits)).alias("minor"), "version", "natkey",
        )
    )
    extra = [
        (rule.project, len(rule.groups) + i, *entry)
        for rule in rules for i, entry in enumerate(rule.constant)
    ]
    if extra:
        constants = versions.sparkSession.createDataFrame(
            extra, "project string, grp int, major string, minor string, version string"
        ).withColumn("natkey", release_key(F.col("version")))
        present = constants.join(versions.select("project").distinct(), "project", "left_semi")
        grouped = grouped.unionByName(present)
    return grouped


def version_tree(versions: DataFrame, indexed: DataFrame, rules=()) -> DataFrame:
    """The indexed versions as a tree in flat form: section, major, minor,
    version, newest first inside a section."""
    return (
        group_versions(versions, rules)
        .join(indexed.select("project", "version").distinct(), ["project", "version"], "left_semi")
        .orderBy("project", "grp", F.desc("natkey"), F.desc("version"))
    )


def tree_nodes(tree: DataFrame) -> DataFrame:
    """Inner nodes of the tree with their newest version and number of versions."""
    return tree.groupBy("project", "major", "minor").agg(
        F.count("*").alias("n_versions"),
        F.min("grp").alias("grp"),
        F.max_by("version", F.struct("natkey", "version")).alias("newest"),
    )


def latest_version(versions: DataFrame, indexed: DataFrame) -> DataFrame:
    """Newest indexed version per project, with and without candidates.

    Where no version is indexed the oldest one is given, indexed or not.
    """
    marks = indexed.select("project", "version").distinct().withColumn("_ok", F.lit(True))
    all_ = versions.join(marks, ["project", "version"], "left")
    ok = F.coalesce(F.col("_ok"), F.lit(False))
    # Without candidates: plain natural order. With: the listed order.
    plain = F.struct("latest_key", "version")
    rel = F.struct("natkey", "version")
    name = F.col("version")

    def pick(test: Column, key: Column) -> Column:
        newest = F.max_by(F.when(test & ok, name), F.when(test & ok, key))
        return F.coalesce(newest, F.min_by(F.when(test, name), F.when(test, key)))

    def pick_reversed(test: Column, key: Column) -> Column:
        oldest = F.min_by(F.when(test & ok, name), F.when(test & ok, key))
        return F.coalesce(oldest, F.max_by(F.when(test, name), F.when(test, key)))

    return all_.groupBy("project").agg(
        pick(F.col("is_stable"), plain).alias("latest"),
        F.when(F.max("is_reversed"), pick_reversed(F.col("is_listed"), rel))
        .otherwise(pick(F.col("is_listed"), rel)).alias("latest_rc"),
    )


#: Projects whose latest versions are sent to the queries, some 100 bytes each.
FEW_PROJECTS = 100_000


def resolve_version(queries: DataFrame, latest: DataFrame) -> DataFrame:
    """Replace ``latest`` and ``latest-rc`` in a query table.

    ``latest`` has one row per project. Up to ``FEW_PROJECTS``, counted first, go to the queries, so that those of one project need not meet
    in a task; with more, it is an ordinary join.
    """
    if latest.limit(FEW_PROJECTS + 1).count() <= FEW_PROJECTS:
        latest = F.broadcast(latest)
    return (
        queries.join(latest, "project", "left")
        .withColumn(
            "version",
            F.when(F.col("version") == "latest", F.col("latest"))
            .when(F.col("version") == "latest-rc", F.col("latest_rc"))
            .otherwise(F.col("version")),
        )
        .drop("latest", "latest_rc")
    )
