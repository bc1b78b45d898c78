"""Numbers and sizes within groups that many tasks share; answers in pieces."""

import json
import random

from pyspark.sql import functions as F

from tagloom.operators.ranks import numbered
from tagloom.plans import search as S

KEYS = ["project", "version", "ident", "family"]


def test_numbers_of_a_group_in_many_ranges(spark):
    rnd = random.Random(1)
    rows = [("hot", rnd.randrange(10**6), rnd.randrange(50)) for _ in range(5000)] + [(f"k{i % 300}", rnd.randrange(99), 3) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, v long, w long").repartition(6)
    got = numbered(df, ["k"], ["v", "w"], size=F.col("w"))
    assert got.columns == ["k", "v", "w", "rank", "before"]
    # The large group is counted in several ranges: one exchange at most is by the key alone, that of the counts.
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert sum("hashpartitioning(k#" in line and "_part" not in line for line in plan.splitlines()) <= 1, plan
    want = []
    for key in {k for k, _, _ in rows}:
        before = 0
        for i, (k, v, w) in enumerate(sorted(r for r in rows if r[0] == key), 1):
            want.append((k, v, w, i, before))
            before += w
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_numbers_of_nothing_and_of_ties(spark):
    df = spark.createDataFrame([], "k string, v long")
    assert numbered(df, ["k"], ["v"]).collect() == []
    same = spark.createDataFrame([("a", 1)] * 40 + [("b", None)], "k string, v long").repartition(5)
    assert sorted((r.k, r.rank) for r in numbered(same, ["k"], [F.desc("v")]).collect()) == [("a", i) for i in range(1, 41)] + [("b", 1)]


def _result(spark):
    rows = [("p", "v1", "f", "A", "definitions", t, f"d{i % 3}.c", [i]) for i, t in enumerate(("macro", "function", "macro", "prototype", "function"))]
    rows += [("p", "v1", "f", "A", "references", None, f"r{i:02}.c", [i, i + 1]) for i in range(30)]
    rows += [("p", "v1", "f", "A", "documentations", None, "x.c", [3])]
    rows += [("p", "v1", "v,s", "B", s, t, "b.c", [2, 4]) for s, t in (("code", "compatible"), ("dts", None), ("documentations", None))]
    return spark.createDataFrame(rows, "project string, version string, ident string, family string, section string, type string, path string, lines array<int>")


def test_order_of_sections(spark):
    got = {}
    for r in sorted(S.ranked(_result(spark)).where("family = 'A'").collect(), key=lambda r: r["rank"]):
        got.setdefault(r.section, []).append((r.type, r.path, r.lines[0]))
    assert got["definitions"] == [("prototype", "d0.c", 3), ("macro", "d0.c", 0), ("macro", "d2.c", 2), ("function", "d1.c", 1), ("function", "d1.c", 4)]
    assert [p for _, p, _ in got["references"]] == [f"r{i:02}.c" for i in range(30)]


def test_pieces_join_to_the_whole_answer(spark):
    result = _result(spark)
    asked = result.select(*KEYS).distinct().union(spark.createDataFrame([("p", "v1", "none", "C")], "a string, b string, c string, d string"))
    lists = ("definitions", "references", "documentations")

    def answers(piece):
        out, sizes = {}, []
        for r in sorted(S.search_json(result, asked, piece).collect(), key=lambda r: r.piece):
            whole = out.setdefault(r.ident, {x: [] for x in lists})
            found = json.loads(r.json)
            assert tuple(found) == lists
            for x in lists:
                whole[x] += found[x]
            sizes.append(sum(map(len, found.values())))
        return out, sizes

    whole, sizes = answers(1 << 20)
    assert len(sizes) == 3 and whole["none"] == {x: [] for x in lists}
    assert whole["v,s"] == {
        "definitions": [{"path": "b.c", "line": "2,4", "type": "compatible"}],
        "references": [{"path": "b.c", "line": "2,4", "type": None}], "documentations": [{"path": "b.c", "line": "2,4", "type": None}]}
    assert whole["f"]["definitions"][0] == {"path": "d0.c", "line": 3, "type": "prototype"}
    parts, small = answers(120)
    assert parts == whole and max(small) <= 4 and len(small) > 8
    assert answers(1)[0] == whole
