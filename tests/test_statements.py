"""Bodies are cut in one piece only where that changes no definition."""

import random

from pyspark.sql import functions as F

from tagloom.operators import defs as D
from tagloom.operators import docs as DOC

PIECES = (
    "int f(int a)\n{", "if (x) {", "}", "\n}", "\n\t}", ";", " a = 1;", "struct s {", "int m;", 'extern "C" {', "namespace n(x) {", "};", "int old(a) int a;", "{", " \x01 ",
    "enum e { A,\n B }", " __attribute__((x))", "typedef struct {", "int g = (1) {", "int v, *w;", "\n", "static int p(void);", ")", "extern __attribute__((y)) {", "f() {}", "/* ; } */",
)


def _blobs(spark, texts):
    rows = [("p", f"{i:040x}", "C", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "project string, blob_id string, family string, content string")


def test_bodies_are_one_statement(spark):
    body = "".join(f"\tuse(part_{i});\n" for i in range(50))
    text = f"int one(void)\n{{\n{body}}}\nint two(void) {{ if (x) {{ {body} }} }}\nint three;\n"
    assert D._statements(_blobs(spark, [text])).count() <= 8
    got = {(r.ident, r.type, r.line) for r in D.extract_defs(_blobs(spark, [text])).collect()}
    assert got == {("one", "function", 1), ("two", "function", 54), ("three", "variable", 105)}


def test_bodies_in_one_piece_hide_no_definition(spark, monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    texts += ["} int f(int a) { int top; }", "f() {\nif (x) {\n}\nint a;\n }\nint g(void) { int b; }", "extern \"C\" {\n }\nint h(void) { int c; }"]
    # Deeper than the test for missing braces sees.
    texts.append("int deep(void) " + "if (x) { y; " * 12 + "} " * 12 + "int after;")
    blobs = _blobs(spark, texts).cache()

    def found():
        return sorted(map(tuple, D.extract_tags(blobs).select("blob_id", "ident", "type", "line", "at_start").collect()), key=repr)

    whole = found()
    monkeypatch.setattr(D, "_sinks_below", lambda masked: F.lit(True))
    assert len(whole) > 2000 and whole == found()
    blobs.unpersist()


def test_heads_of_blobs_without_comments_do_not_travel(spark):
    blobs = _blobs(spark, ["int plain(void)\n{\n}\n", "/**\n * told - x\n */\nint told(void)\n{\n}\n", "/**\n * late - x\n */\nstatic long\nlate(void)\n{\n}\n"])
    assert {r.ident for r in DOC.doc_starts(blobs, DOC.forced_c_tags(blobs)).collect()} == {"told", "late"}
    assert {(r.ident, r.line) for r in DOC.extract_docs(blobs).collect()} == {("told", 1), ("late", 1)}
