"""Counts of tokens by line, dealt by blob."""

from collections import Counter

from tagloom.operators import tokens as TK

A, B = "a" * 40, "0123456789abcdef" * 2 + "01234567"
ROWS = [
    ("p", A, "C", " use(x, x);\n x y \n"), ("q", A, "C", " use(x, x);\n x y \n"), ("p", B, "D", " a-b a-b\n"),
    ("p", "NOT-A-HASH", "K", "\nword word \n"), ("p", None, "C", " z z \n"), ("p", "b" * 40, None, " none \n"), ("p", "c" * 40, "C", None),
]


def test_against_plain_counts(spark):
    blobs = spark.createDataFrame(ROWS, "project string, blob_id string, family string, content string")
    got = TK.count_by_line(blobs)
    plan = got._jdf.queryExecution().executedPlan().toString()
    want = Counter((r.blob_id, r.token, r.line) for r in TK.tokenize(blobs).collect())
    assert {(r.blob_id, r.token, r.line): r.n for r in got.collect()} == want and want[A, "x", 1] == 4 and want[None, "z", 1] == 2
    assert plan.count("Exchange ") == 1 and "line" not in plan[plan.index("hashpartitioning(blob_id"):].split(")")[0]
