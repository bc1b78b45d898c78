"""Completion from the stored table against a look at all names."""

import random

from pyspark.sql import functions as F

from tagloom.plans import completion as C


def _names():
    rnd = random.Random(7)
    names = {"".join(rnd.choice("ab_é漢") for _ in range(rnd.randrange(1, 7))) for _ in range(400)}
    return names | {f"very_common_{i}" for i in range(300)} | {"very_common_1" * 3, "z", "zz"} | {f"only{'x' * i}" for i in range(4)}


def test_against_all_names(spark, tmp_path):
    names = _names()
    df = spark.createDataFrame([(p, n) for n in names for p in ("p", "q") if p == "p" or len(n) > 4], "project string, ident string").repartition(7)
    table = C.write_completions(df.union(df), str(tmp_path / "t"), k=5)
    asked = {n[:i] for n in names for i in range(len(n) + 1)} | {"nothing", "zzz", "very_common_1x", "a" * 40}
    q = spark.createDataFrame([(p, a, "C") for a in asked for p in ("p", "q", "r")], "project string, prefix string, family string")
    got = {}
    for r in C.complete(table, q, k=5).collect():
        got.setdefault((r.project, r.prefix), {})[r["rank"]] = r.ident
    for a in asked:
        for p in ("p", "q", "r"):
            mine = [] if p == "r" else sorted((n for n in names if n.startswith(a) and (p == "p" or len(n) > 4)), key=str.encode)
            assert list(map(got.get((p, a), {}).get, range(1, len(mine[:5]) + 1))) == mine[:5] and len(got.get((p, a), {})) == len(mine[:5])
    for a in ("", "very_common_1", "zz", "nothing", "only", "onlyx"):
        assert [r.ident for r in C.complete_one(table, "p", a, k=5).collect()] == sorted((n for n in names if n.startswith(a)), key=str.encode)[:5]


def test_table_is_small_and_read_by_key(spark, tmp_path):
    names = spark.range(5000).select(F.lit("p").alias("project"), F.concat(F.lit("name_"), F.col("id").cast("string")).alias("ident"))
    table = C.write_completions(names, str(tmp_path / "t"))
    lists = table.collect()
    short = [n for r in lists if not r.more for n in r.names]
    assert len(short) == len(set(short)) <= 5000 and max(len(r.names) for r in lists) == C.K
    plan = C.complete_one(table, "p", "name_12")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(prefix" in plan and "PartitionFilters: [isnotnull(project" in plan
    assert C.write_completions(names.where("false"), str(tmp_path / "none")).count() == 0


def test_questions_do_not_go_through_the_driver(spark, tmp_path):
    """Files of few bytes hold many questions, each with many prefixes: neither they nor their answers are sized by their files."""
    names = spark.range(50).select(F.lit("p").alias("project"), F.concat(F.lit("name_"), F.col("id").cast("string")).alias("ident"))
    names.select("project", F.col("ident").alias("prefix"), F.lit("C").alias("family")).write.parquet(str(tmp_path / "q"))
    got = C.complete(C.write_completions(names, str(tmp_path / "t")), spark.read.parquet(str(tmp_path / "q")))
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.where("rank = 1 AND ident = prefix").count() == 50
