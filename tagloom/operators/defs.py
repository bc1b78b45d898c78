"""Definitions by rules, without a parser.

Two kinds of rules are applied. *Line rules* are a table of (family, pattern,
type, prefix) tried on single lines. *Statement rules* read C text cut at ``;``,
``{`` and ``}``, with brace depth and the kind of the enclosing block from one
window pass per blob. Exact tags of an outside tagger can be brought in with
:func:`defs_from_tags` instead.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.text import COMMENT, acceptable_ident, blank, count_newlines, mask_for_statements, pack_id, split_lines, trim_blanks, unpack_id
from tagloom.schema import DEF_FAMILIES, DEF_TYPES
from tagloom.session import spread

DEF_COLUMNS = ["project", "ident", "blob_id", "type", "line", "family"]


@dataclass(frozen=True)
class DefRule:
    """``pattern`` has one group, the name. ``masked`` rules skip comments and strings. ``hint`` is text that
    every match holds: files without it are not cut into lines."""

    family: str
    pattern: str
    type: str
    prefix: str = ""
    masked: bool = False
    hint: str = field(default="", compare=False)


DEFINE_RULE = DefRule("C", r"^[ \t]*#[ \t]*define[ \t]+([A-Za-z_]\w*)", "macro", masked=True, hint="define")

def called(macro: str, end: str, prefix: str = "", hint: str = "") -> DefRule:
    """A macro whose first argument names a function; ``end``: what may follow the argument."""
    return DefRule("C", rf"^\s*{macro}\(\s*([A-Za-z0-9_]+)\s*[{end}]", "function", prefix, hint=hint)


#: Macros, assembler entry points, system calls, Kconfig symbols, DTS labels.
DEFAULT_RULES = (
    DEFINE_RULE,
    called("ENTRY", ")", hint="ENTRY"),
    called("SYSCALL_DEFINE[0-9]", ",)", prefix="sys_", hint="SYSCALL_DEFINE"),
    DefRule("K", r"^[ \t]*(?:menu)?config[ \t]+(\w+)[ \t]*$", "config", prefix="CONFIG_", hint="config"),
    DefRule("D", r"^[ \t]*#[ \t]*define[ \t]+([A-Za-z_]\w*)", "macro", masked=True, hint="define"),
    DefRule("D", r"^[ \t]*([A-Za-z_]\w*)[ \t]*:(?:[^:]|$)", "label", masked=True, hint=":"),
)


def _mask_comments(text: Column) -> Column:
    """Blank comments only; enough for line rules on directives and labels."""
    pieces = (
        rf"{COMMENT}|//[^\n]*+"
        r"""|"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+\""""
        r"""|[^/"]++|[\s\S]"""
    )
    masked = F.array_join(
        F.transform(
            F.regexp_extract_all(text, F.lit(pieces), F.lit(0)),
            lambda p: F.when(
                p.startswith("/*") | p.startswith("//"), blank(p)
            ).otherwise(p),
        ),
        "",
    )
    return F.when(text.contains("/*") | text.contains("//"), masked).otherwise(text)


def line_defs(blobs: DataFrame, rules=DEFAULT_RULES) -> DataFrame:
    """Apply line rules. The rule list is code, so it becomes one array of
    candidate structs per line: no join, no shuffle."""
    out = []
    for masked in (False, True):
        some = [r for r in rules if r.masked == masked]
        if not some:
            continue
        text = _mask_comments(F.col("content")) if masked else F.col("content")
        candidates = F.array(
            *[
                F.struct(
                    F.when(
                        F.col("family") == r.family, F.regexp_extract("_line", r.pattern, 1)
                    ).alias("name"),
                    F.lit(r.prefix).alias("prefix"),
                    F.lit(r.type).alias("type"),
                )
                for r in some
            ]
        )
        out.append(
            blobs.where(_may_match(some))
            .select("project", "blob_id", "family", F.posexplode(split_lines(text)).alias("_pos", "_line"))
            .where(_any_rule(some))
            .select(
                "project", "blob_id", "family", (F.col("_pos") + 1).alias("line"),
                F.inline(F.filter(candidates, lambda c: F.coalesce(c["name"], F.lit("")) != "")),
            )
        )
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found.select(
        "project", F.concat("prefix", "name").alias("ident"), "blob_id", "type",
        F.col("line").cast("int").alias("line"), "family",
    )


def _may_match(rules) -> Column:
    """Files of a rule's family that hold its hint."""
    tests = [(F.col("family") == r.family) & (F.col("content").contains(r.hint) if r.hint else F.lit(True)) for r in rules]
    return reduce(lambda a, b: a | b, tests)


def _any_rule(rules) -> Column:
    """One pre-test per family, so most lines leave before candidates are built."""
    test = F.lit(False)
    for family in sorted({r.family for r in rules}):
        either = "|".join(f"(?:{r.pattern})" for r in rules if r.family == family)
        test = test | ((F.col("family") == family) & F.col("_line").rlike(either))
    return test


# --- C statements ------------------------------------------------------------

# Words that stand before a parenthesis without being a function.
_NOT_FUNCTIONS = ("if", "while", "for", "switch", "return", "sizeof", "do", "else", "defined", "case")

_ATTRIBUTE = r"__attribute__[ \t\n]*\(\([^()]*(?:\([^()]*\)[^()]*)*\)\)"
_CALL = r"^([\w\s*]*?)\b([A-Za-z_]\w*)\s*\((?!\s*\*)"
_OLD_HEAD = r"^[^(]*+\(([\w\s,]*+)\)([\s\S]*+)$"
_BLOCK = r"\b(struct|union|enum|class)\b(?:\s+([A-Za-z_]\w*))?[\w\s:,]*$"


#: A statement; or the rest of a block without blocks of its own, taken whole where its head ends in a bracket: nothing in it is a
#: definition, as long as it lies below the top.
_STATEMENT = r"[^;{}]*+[;{}]"
_BODY = r"(?<=\)[ \t\r\n]{0,16}\{)[^{}]*+\}"
#: Pairs of braces within each other that :func:`_sinks_below` sees through.
_NESTED = 8


def _sinks_below(masked: Column) -> Column:
    """Whether the running depth of braces could fall below the top, so that a block's inside counts as the top: a closing brace too
    many since the last one that resets the depth, or a block that does not count when it opens but does when it closes."""
    braces = F.regexp_replace(F.regexp_replace(masked, r"(?<![^\n;{}])\}", "\x01"), r"[^{}\x01]++", "")
    for _ in range(_NESTED):
        braces = F.replace(braces, F.lit("{}"), F.lit(""))
    return masked.rlike(r"\b(?:extern|namespace)\b[^;{}]*+\{") | F.when(masked.rlike(r"[^\n;{}]\}"), braces.contains("}")).otherwise(False)


def _pieces(masked: Column) -> Column:
    """Masked C text as statements, bodies of functions and of conditions in one piece where that is safe."""
    return F.when(_sinks_below(masked), F.regexp_extract_all(masked, F.lit(_STATEMENT), F.lit(0))).otherwise(
        F.regexp_extract_all(masked, F.lit(f"{_BODY}|{_STATEMENT}"), F.lit(0))
    )


def _declarators(head: Column) -> Column:
    """Names a statement declares, each with the newlines before it."""
    flat = F.regexp_replace(head, r"=[^,]*", " ")
    # Function pointers: keep the name, drop the arguments.
    flat = F.regexp_replace(flat, r"\(\s*\*+\s*(?:const\s+)?(\w+)[^()]*\)\s*\([^()]*\)", " $1 ")
    flat = F.regexp_replace(flat, r"\[[^\]]*\]|:\s*\w+\s*(?=,|$)", " ")
    parts = F.split(flat, ",")
    return F.filter(
        F.transform(
            parts,
            lambda p, i: F.struct(
                F.regexp_extract(p, r"([A-Za-z_]\w*)\s*$", 1).alias("name"),
                count_newlines(
                    F.concat(
                        F.array_join(F.slice(parts, F.lit(1), i), ","),
                        F.regexp_extract(p, r"^([\s\S]*?)\w*\s*$", 1),
                    )
                ).alias("nl"),
            ),
        ),
        lambda d: d["name"] != "",
    )


def _enumerators(head: Column) -> Column:
    return F.flatten(
        F.transform(
            F.split(head, "\n"),
            lambda line, i: F.transform(
                F.regexp_extract_all(line, F.lit(r"(?:^|,)\s*([A-Za-z_]\w*)\s*(?=[,=]|$)"), F.lit(1)),
                lambda name: F.struct(name.alias("name"), i.alias("nl")),
            ),
        )
    )


def _declares_its_parameters(head: Column) -> Column:
    """Whether a list of bare names is followed by a declaration of one of them: ``int f(a, b) char *a``."""
    listed = F.transform(F.split(F.regexp_extract(head, _OLD_HEAD, 1), ","), lambda name: trim_blanks(name))
    declared = F.transform(_declarators(F.regexp_extract(head, _OLD_HEAD, 2)), lambda d: d["name"])
    return head.rlike(r"\)\s*[A-Za-z_]\w*[\s*]") & F.arrays_overlap(listed, declared)


def _settle(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later expressions read as values. A generator stands
    between, so the optimizer does not put their text into each use again."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _statements(blobs: DataFrame) -> DataFrame:
    """C text as statements, condensed to candidate names before the shuffle."""
    text, head, block = F.col("_text"), F.col("_head"), F.col("_block")
    bare = F.expr("substring(_text, 1, length(_text) - 1)")
    term = F.substring(text, -1, 1)
    opens, closes = F.col("_term") == "{", F.col("_term") == "}"
    call = F.col("_call") != ""
    masked = _settle(blobs.select("project", "blob_id", "family", "content"), _masked=mask_for_statements(F.col("content")))
    pieces = masked.select("project", "blob_id", "family", F.posexplode(_pieces(F.col("_masked"))).alias("_i", "_text"))
    pieces = _settle(
        pieces,
        _term=term,
        _nl=count_newlines(text),
        _reset=(term == "}") & text.rlike(r"(?:^|[\n;])\}$"),
        _head=F.when((term == "}") & text.contains(";"), "").when(text.contains("__attribute__"), F.regexp_replace(bare, _ATTRIBUTE, " ")).otherwise(bare),
    ).drop("_text")
    pieces = _settle(
        pieces,
        _call=F.when(head.contains("("), F.regexp_extract(head, _CALL, 2)).otherwise(""),
        _block=F.when(opens, F.regexp_extract(head, _BLOCK, 1)).otherwise(""),
        _typedef=head.rlike(r"^\s*(?:__extension__\s+)?typedef\b"),
    )
    pieces = _settle(
        pieces.withColumn("_call", F.when(F.col("_call").isin(*_NOT_FUNCTIONS), "").otherwise(F.col("_call"))),
        _prefix=F.when(call, F.regexp_extract(head, _CALL, 1)),
    )
    declares = F.when(opens, head.contains("=")).otherwise(~closes & (~call | F.col("_typedef")))
    return pieces.select(
        "project", "blob_id", "family", "_i", "_term", "_call", "_nl", "_reset", "_typedef",
        head.rlike(r"^\s*extern\b").alias("_extern"),
        F.when(~opens, None)
        .when(head.contains("="), "init")
        .when(call, "function")
        .when(block != "", block)
        .when(head.rlike(r"^\s*(?:extern|namespace\b.*)\s*$"), "outer")
        .otherwise("block").alias("_kind"),
        F.coalesce(count_newlines(F.col("_prefix")), F.lit(0)).alias("_call_nl"),
        F.coalesce(F.col("_prefix").rlike(r"\S"), F.lit(False)).alias("_typed"),
        F.coalesce(
            F.col("_prefix").rlike(r"\n[ \t]*$") | ((F.col("_i") == 0) & F.col("_prefix").rlike(r"^[ \t]*$")),
            F.lit(False),
        ).alias("_at_start"),
        F.when(
            opens & ~call & (block != ""),
            F.struct(
                F.regexp_extract(head, _BLOCK, 2).alias("name"),
                count_newlines(F.regexp_extract(head, r"^([\s\S]*?)\b(?:struct|union|enum)\b", 1)).alias("nl"),
            ),
        ).alias("_tag"),
        (~opens & head.rlike(r"^\s*(?:struct|union|enum)\s+\w+\s*$")).alias("_forward"),
        head.rlike(r"[\w*]\s+[\w*(]|\*\w").alias("_two_words"),
        F.when((F.col("_term") == ";") & call & ~F.col("_typedef"), _declares_its_parameters(head)).otherwise(False).alias("_old"),
        (opens & ~head.rlike(r"\S")).alias("_bare"),
        F.when(declares, _declarators(head)).when(closes, _enumerators(head)).alias("_names"),
    )


def c_statement_defs(blobs: DataFrame) -> DataFrame:
    """Functions, prototypes, variables, types, members and enumerators of C text.

    Depth and enclosing block come from running sums per blob; all windows
    share the one shuffle by blob. A closing brace in column 0 ends a top-level
    block and resets the depth, so ``#if`` branches with unequal braces do no
    lasting harm. An old-style parameter list is told by the declarations behind
    it: a function once its body follows, its parameters no variables. Also yields
    ``at_start``: a function whose line begins with its name.
    """
    blob = Window.partitionBy("blob_id", "project").orderBy("_i")
    earlier = blob.rowsBetween(Window.unboundedPreceding, -1)
    outer = F.coalesce(F.col("_kind") == "outer", F.lit(False))
    delta = F.when(outer, 0).when(F.col("_term") == "{", 1).when(F.col("_term") == "}", -1).otherwise(0)
    # Dealt once, to a number of tasks that stays: condensed statements compress tenfold, and each task sorts its own four times.
    # Not by project, which may be a constant that the planner then takes for another key than the windows'.
    packed = blobs.withColumn("blob_id", pack_id(F.col("blob_id")))
    rows = spread(_statements(packed), "blob_id").select(
        "*",
        (F.coalesce(F.sum("_nl").over(earlier), F.lit(0)) + 1).alias("_first"),
        F.coalesce(F.sum(F.col("_reset").cast("int")).over(earlier), F.lit(0)).alias("_part"),
        F.coalesce(F.sum(delta).over(earlier), F.lit(0)).alias("_sum"), delta.alias("_delta"),
    )
    # The depth of a part is what was added since the last reset; the rows are in that order already.
    since = F.coalesce(F.last(F.when(F.col("_reset"), F.col("_sum") + F.col("_delta")), ignorenulls=True).over(earlier), F.lit(0))
    rows = rows.withColumn("_depth", F.greatest(F.col("_sum") - since, F.lit(0))).drop("_sum", "_delta").withColumn(
        # An opener counts to the level it opens, everything else to its own.
        "_level", F.col("_depth") + F.when((F.col("_term") == "{") & ~outer, 1).otherwise(0)
    )
    level = Window.partitionBy("blob_id", "project", "_part", "_level").orderBy("_i")
    opener = F.when(F.col("_kind").isNotNull() & ~outer, F.struct("_kind", "_typedef"))
    top = F.col("_depth") == 0
    # The last old-style head, forgotten at the next brace.
    head = F.when(
        F.col("_old") & top,
        F.struct(F.col("_call").alias("name"), (F.col("_first") + F.col("_call_nl")).alias("line"), "_typed", "_at_start"),
    )
    brace = F.col("_term").isin("{", "}")
    rows = rows.withColumn(
        "_in", F.last(opener, ignorenulls=True).over(level.rowsBetween(Window.unboundedPreceding, -1))
    ).select(
        "*", F.lag("_term").over(blob).alias("_prev"), F.lag("_in").over(blob).alias("_closed"),
        F.last(F.when(head.isNotNull() | brace, F.struct(head.alias("head"))), ignorenulls=True).over(earlier)["head"].alias("_wait"),
    )

    ends, opens = F.col("_term") == ";", F.col("_term") == "{"
    body = F.col("_wait").isNotNull() & F.col("_bare") & top
    parameter = F.coalesce(F.col("_wait._typed"), F.lit(False)) & ends & top & ~F.col("_extern")
    call = F.col("_call") != ""
    after_block = F.coalesce(
        (F.col("_prev") == "}") & F.col("_closed._kind").isin("struct", "union", "enum"), F.lit(False)
    )
    inside = F.col("_in._kind").isin("struct", "union", "class") & (F.col("_depth") > 0)
    name_type = (
        F.when(opens & top & (F.col("_kind") == "init"), F.when(F.col("_typed") | F.col("_two_words"), "variable"))
        .when((F.col("_term") == "}") & (F.col("_in._kind") == "enum") & (F.col("_depth") > 0), "enumerator")
        .when(ends & after_block & top & F.col("_closed._typedef"), "typedef")
        .when(ends & after_block & top, "variable")
        .when(ends & inside & (after_block | F.col("_two_words")) & ~call, "member")
        .when(ends & top & F.col("_typedef"), "typedef")
        .when(parameter, None)
        .when(ends & top & ~call & F.col("_two_words") & ~F.col("_forward") & F.col("_extern"), "externvar")
        .when(ends & top & ~call & F.col("_two_words") & ~F.col("_forward"), "variable")
    )
    call_type = F.when(opens & top & (F.col("_kind") == "function"), "function").when(
        ends & top & call & F.col("_typed") & ~F.col("_typedef") & ~F.col("_old"), "prototype"
    )
    none = F.lit(None).cast("string")
    found = F.concat(
        F.array(
            F.struct(
                F.when(call_type.isNotNull(), F.col("_call")).otherwise(none).alias("ident"),
                call_type.alias("type"), F.col("_call_nl").alias("nl"),
            ),
            F.struct(
                F.col("_tag.name").alias("ident"), F.col("_kind").alias("type"), F.col("_tag.nl").alias("nl")
            ),
            F.struct(
                F.when(body, F.col("_wait.name")).alias("ident"), F.lit("function").alias("type"),
                (F.col("_wait.line") - F.col("_first")).cast("int").alias("nl"),
            ),
        ),
        F.transform(
            F.when(name_type.isNotNull(), F.col("_names")).otherwise(F.array().cast("array<struct<name:string,nl:int>>")),
            lambda n: F.struct(n["name"].alias("ident"), name_type.alias("type"), n["nl"].alias("nl")),
        ),
    )
    return (
        rows.select(
            "project", "blob_id", "family", "_first", F.when(body, F.col("_wait._at_start")).otherwise(F.col("_at_start")).alias("_at_start"),
            F.explode(F.filter(found, lambda d: F.coalesce(d["ident"], F.lit("")) != "")).alias("_d"),
        )
        .select(
            "project", F.col("_d.ident").alias("ident"), unpack_id(F.col("blob_id")).alias("blob_id"), F.col("_d.type").alias("type"),
            (F.col("_first") + F.col("_d.nl")).cast("int").alias("line"), "family",
            ((F.col("_d.type") == "function") & F.col("_at_start")).alias("at_start"),
        )
    )


# --- the operator ------------------------------------------------------------


def clean_defs(defs: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """Drop unknown types, operator and ``CONFIG_`` names of C files, names too
    short to look up, and the names of the stop table ``stop(ident)``."""
    kept = defs.where(
        F.col("type").isin(*DEF_TYPES)
        & acceptable_ident(F.col("ident"))
        & ~((F.col("family") == "C") & F.col("ident").rlike("^(?:operator |CONFIG_)"))
    )
    if stop is not None:
        kept = kept.join(stop.select("ident").distinct(), "ident", "left_anti")
    return kept.select(*DEF_COLUMNS)


def extract_tags(blobs: DataFrame, rules=DEFAULT_RULES, statements: bool = True) -> DataFrame:
    """Everything the rules find, uncleaned. ``at_start`` is null for line rules,
    else it tells a function whose line begins with its name."""
    found = line_defs(blobs, rules).withColumn("at_start", F.lit(None).cast("boolean"))
    if statements:
        found = found.unionByName(c_statement_defs(blobs.where("family = 'C'")))
    return found


def extract_defs(blobs: DataFrame, rules=DEFAULT_RULES, stop: DataFrame | None = None,
                 statements: bool = True) -> DataFrame:
    """Definitions of all blobs, by line rules and (unless off) C statements."""
    return clean_defs(extract_tags(blobs, rules, statements), stop)


def defs_from_tags(tags: DataFrame, blobs: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """Definitions from an outside tagger: ``tags(project, blob_id, row)`` with
    rows ``ident type line``; malformed rows have no line and are left out."""
    parts = F.split("row", " ")
    rows = tags.select(
        "project", "blob_id", parts[0].alias("ident"), parts[1].alias("type"),
        F.expr("try_cast(split(row, ' ')[2] AS int)").alias("line"), F.size(parts).alias("_n"),
    ).where("_n = 3 AND line IS NOT NULL")
    family = blobs.where(F.col("family").isin(*DEF_FAMILIES)).select("project", "blob_id", "family")
    named = rows.join(family, ["project", "blob_id"])
    return clean_defs(
        named.withColumn(
            "ident", F.when(F.col("family") == "K", F.concat(F.lit("CONFIG_"), "ident")).otherwise(F.col("ident"))
        ),
        stop,
    )


# --- aggregates over definitions ----------------------------------------------


def def_postings(defs: DataFrame) -> DataFrame:
    """Definitions of an identifier in one blob, as an ordered list.

    The list is kept per blob, not per identifier: a name that half the corpus
    defines stays many small rows.
    """
    return defs.groupBy("project", "ident", "blob_id", "family").agg(
        F.array_sort(F.collect_list(F.struct("line", "type"))).alias("postings")
    )


def ident_families(defs: DataFrame) -> DataFrame:
    """Distinct (identifier, family) with the flag whether it is a macro there."""
    return defs.groupBy("project", "ident", "family").agg(
        F.max((F.col("type") == "macro").cast("int")).cast("boolean").alias("is_macro")
    )


def family_sets(defs: DataFrame) -> DataFrame:
    """Families of each identifier, and those in which it is a macro, as text."""
    return ident_families(defs).groupBy("project", "ident").agg(
        F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("is_macro"), F.col("family")))), ",").alias(
            "macro_families"
        ),
    )


def known_in_family(defs: DataFrame) -> DataFrame:
    """``(project, ident, family)``: identifiers known to files of a family."""
    from tagloom.schema import KNOWN_COMPAT, MACRO_COMPAT

    own = ident_families(defs)
    targets = F.array_compact(
        F.array(
            *[F.when(F.col("family") == d, f) for f, d in KNOWN_COMPAT],
            *[F.when((F.col("family") == d) & F.col("is_macro"), f) for f, d in MACRO_COMPAT],
        )
    )
    return own.select("project", "ident", F.explode(targets).alias("family")).distinct()
