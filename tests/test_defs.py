"""Definitions and documentation comments on hand-written files."""

from tagloom.operators import defs as D
from tagloom.operators import docs as DOC

SOURCE = """\
#include <x.h>
#define LIMIT 3
#define TWO(a) \\
\tdo { a; } while (0)
struct forward;
struct point {
\tint x, y;
\tstruct inner { int z; } in;
\tint (*cb)(int);
};
enum color { RED, GREEN = 2,
\tBLUE };
typedef struct { int q; } quad_t;
typedef int (*handler_t)(int a, int b);
typedef unsigned long word_t;
extern int shared;
extern int outside(void);
static int counter = 4, *cursor;
static const char *names[] = { "a", "b" };
int proto(int a);
static inline int
split_type(int a)
{
\tint local;
\tif (a) { call(a); }
\treturn local;
}
int plain(int a, int b) {
\treturn a;
}
union both { int i; char c; };
void __attribute__((noreturn)) stop(void)
{
}
/* int hidden(void) { } */
char *text = "int fake(void) {";
"""


def names(defs):
    return {(r.ident, r.type, r.line) for r in defs.collect()}


def test_c_definitions(blobs):
    assert names(D.extract_defs(blobs("a.c", SOURCE))) == {
        ("LIMIT", "macro", 2), ("TWO", "macro", 3), ("point", "struct", 6), ("inner", "struct", 8),
        ("cb", "member", 9), ("in", "member", 8), ("color", "enum", 11), ("RED", "enumerator", 11),
        ("GREEN", "enumerator", 11), ("BLUE", "enumerator", 12), ("quad_t", "typedef", 13),
        ("handler_t", "typedef", 14), ("word_t", "typedef", 15), ("shared", "externvar", 16),
        ("outside", "prototype", 17), ("counter", "variable", 18), ("cursor", "variable", 18),
        ("names", "variable", 19), ("proto", "prototype", 20), ("split_type", "function", 22),
        ("plain", "function", 28), ("both", "union", 31), ("stop", "function", 32), ("text", "variable", 36),
    }


def test_uneven_branches_do_no_lasting_harm(blobs):
    text = "#ifdef A\nint f(int a) {\n#else\nint f(long a) {\n#endif\n\treturn 1;\n}\nint gg(void)\n{\n}\n"
    assert ("gg", "function", 8) in names(D.extract_defs(blobs("a.c", text)))


def test_entry_and_system_calls(blobs):
    text = "ENTRY(start_it)\n#define X(a) ENTRY(a##_b)\n\tENTRY(0x10, a, b)\nSYSCALL_DEFINE3(readit, int, a)\n{\n}\n"
    got = {(i, l) for i, t, l in names(D.extract_defs(blobs("a.S", text))) if t == "function"}
    assert ("start_it", 1) in got and ("sys_readit", 4) in got
    assert not any("##" in i or i.startswith("0x") for i, _ in got)


def test_keyword_of_another_language(blobs):
    assert ("class", "struct", 1) in names(D.extract_defs(blobs("a.c", "struct class {\n\tint aa;\n};\n")))


def test_kconfig_and_devicetree(blobs):
    kconfig = "menuconfig NET\n\tbool\n  config SUB\n# config NOT_THIS one\n"
    assert names(D.extract_defs(blobs("Kconfig", kconfig))) == {("CONFIG_NET", "config", 1), ("CONFIG_SUB", "config", 3)}
    dts = "#define BASE 1\nuart0: serial@1 {\n\treg = <BASE>;\n/* no: */\n};\n"
    assert names(D.extract_defs(blobs("a.dts", dts))) == {("BASE", "macro", 1), ("uart0", "label", 2)}


def test_short_and_stopped_names_go(blobs, spark):
    stop = spark.createDataFrame([("stopped",)], "ident string")
    got = names(D.extract_defs(blobs("a.c", "int i;\nint stopped;\nint kept;\n#define CONFIG_A 1\n"), stop=stop))
    assert got == {("kept", "variable", 3)}


def test_imported_tags(spark, blobs):
    b = blobs("a.c", "x\n")
    ident = b.first().blob_id
    rows = ["foo function 3", "operator function 4", "bar unknown 5", "broken", "baz macro x", "qux macro 7"]
    tags = spark.createDataFrame([("p", ident, r) for r in rows], "project string, blob_id string, row string")
    assert names(D.defs_from_tags(tags, b)) == {("foo", "function", 3), ("operator", "function", 4), ("qux", "macro", 7)}


def docs(blobs, text, **kw):
    return {(r.ident, r.line) for r in DOC.extract_docs(blobs("a.c", text), **kw).collect()}


DOCUMENTED = """\
/**
 * plain - text
 * @a: more
 */
int plain(int a)
{
}

/**
 * wrong_name - text
 */
int other(void)
{
}
/**
 * struct thing - text
 */

struct thing {
\tint a;
};
/**
 * split() - text
 */
static int
split(int a)
{
}
/*
 * simple - no doc opener
 */
int simple(void)
{
}
/**
 * MAC: a macro
 */
#define MAC(a) \\
\t(a)
/**
 * proto - text
 */
int proto(int a);
int undocumented(void)
{
}
"""


def test_documentation(blobs):
    assert docs(blobs, DOCUMENTED) == {("plain", 1), ("thing", 15), ("split", 22), ("MAC", 35), ("proto", 40)}


def test_star_star_closer(blobs):
    one_line = "/**\n * foo - text\n **/\nint foo(void)\n{\n}\n"
    own_line = "/**\n * foo - text\n **/\nint\nfoo(void)\n{\n}\n"
    assert docs(blobs, one_line) == set()
    assert docs(blobs, own_line) == {("foo", 1)}
    assert docs(blobs, one_line, lenient_closer=True) == {("foo", 1)}


def test_upper_case_return_type_on_its_own_line(blobs):
    assert docs(blobs, "/**\n * foo - text\n */\nSTATIC int\nfoo(void)\n{\n}\n") == {("foo", 1)}


def test_same_name_under_two_branches(blobs):
    text = ("#ifdef A\n/**\n * twin - text\n */\nint twin(void)\n{\n}\n#else\n#define twin() 0\n#endif\n"
            "void user(void)\n{\n\t#define LOCAL 1\n}\n")
    assert docs(blobs, text) == {("twin", 2)}


def test_first_documentation_per_blob(blobs):
    text = "/**\n * foo - a\n */\nint foo(int);\n/**\n * foo - b\n */\nint foo(int a)\n{\n}\n"
    found = DOC.extract_docs(blobs("a.c", text))
    assert {r.line for r in found.collect()} == {1, 5}
    assert [r.line for r in DOC.docs_first(found).collect()] == [5]


def test_tags_at_hand_give_the_same(blobs):
    b = blobs("a.c", DOCUMENTED)
    assert DOC.extract_docs(b, D.extract_tags(b)).exceptAll(DOC.extract_docs(b)).count() == 0


OLD_STYLE = """\
int add(a, b)
int a;
long b;
{
\treturn a + b;
}
static char *
pick(names, n, fn)
\tregister char **names;
\tint n, (*fn)();
{
\tint inner;
\treturn names[n];
}
int after;
main(argc, argv)
char *argv[];
{
}
int marked(int a) __init __cold;
int unknown(a) int b;
int real(int a);
"""


def test_old_style_parameter_lists(blobs):
    assert names(D.extract_defs(blobs("a.c", OLD_STYLE))) == {
        ("add", "function", 1), ("pick", "function", 8), ("after", "variable", 15), ("main", "function", 16),
        ("marked", "prototype", 20), ("unknown", "prototype", 21), ("real", "prototype", 22),
    }
    starts = {r.ident: r.at_start for r in D.extract_tags(blobs("a.c", OLD_STYLE)).where("type = 'function'").collect()}
    assert starts == {"add": False, "pick": True, "main": True}


def test_old_style_head_without_a_body(blobs):
    text = "int ff(a) int a;\nstruct ss { int mm; };\nint gg(void)\n{\n}\nint vv;\n{\n}\n"
    got = names(D.extract_defs(blobs("a.c", text)))
    assert got == {("ss", "struct", 2), ("mm", "member", 2), ("gg", "function", 3), ("vv", "variable", 6)}


def test_old_style_head_is_linear(blobs):
    many = "int ff(" + ", ".join(f"a{i}" for i in range(4000)) + ")\n" + "".join(f"int a{i};\n" for i in range(4000)) + "{\n}\n"
    assert names(D.extract_defs(blobs("a.c", many))) == {("ff", "function", 1)}


def test_files_without_a_rules_hint_are_not_cut_into_lines(blobs):
    assert all(rule.hint for rule in D.DEFAULT_RULES)
    plan = D.line_defs(blobs("a.c", "int a;\n"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Contains(content") >= len(D.DEFAULT_RULES)
    own = D.DefRule("C", r"^(\w+)!", "macro")
    assert [r.ident for r in D.line_defs(blobs("a.c", "yes!\nno\n"), (own, *D.DEFAULT_RULES)).collect()] == ["yes"]


def test_statements_are_dealt_to_a_number_of_tasks_that_stays(blobs):
    found = D.c_statement_defs(blobs("a.c", "int aa;\nint ff(void)\n{\n}\n"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert {(r.ident, r.type) for r in found.collect()} == {("aa", "variable"), ("ff", "function")}
    # One exchange for the dedup of contents, one for the windows.
    assert "REPARTITION_BY_NUM" in plan and plan.count("Exchange hashpartitioning") == 2
