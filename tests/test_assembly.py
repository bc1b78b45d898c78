"""Versions put together from parts by state."""

import time

import pytest

from tagloom.plans.index import INDEX_TABLES, build_index
from tagloom.streaming import assembly as A
from tagloom.streaming.ingest import read_batches

@pytest.fixture
def stream(spark, tmp_path):
    """Lands rows, runs one batch over them, and gives what has gone out so far."""
    landing, out = str(tmp_path / "landing"), str(tmp_path / "out")

    def step(*rows, patience=3_600_000):
        spark.createDataFrame(rows, A.ARRIVALS).coalesce(1).write.mode("append").parquet(landing)
        A.start_once(A.assemble(A.stream_arrivals(spark, landing), patience).writeStream.format("parquet").outputMode("append")
                     .option("path", out).option("checkpointLocation", str(tmp_path / "check")), spark)
        got = spark.read.schema(A.ASSEMBLED).parquet(out)
        return sorted((tuple(r) for r in got.collect()), key=str)

    return step


def test_late_repeated_and_missing_parts(stream):
    part = lambda v, place: ("p", v, place, None)
    done = [("p", "v1", x, "complete", 2, 2) for x in "ab"]
    assert stream(part("v1", "a"), part("v1", "a"), part("v2", "x"), (None, "v1", "b", None), ("p", "v3", None, 0)) == []
    assert stream(("p", "v1", None, 2), part("v1", "a")) == []  # repeated, and not yet whole
    assert stream(part("v1", "b")) == done
    assert stream(("p", "v2", None, 3), part("v2", "y"), part("v1", "b")) == done  # b again: a state of its own now
    # A short patience counts for new states only: those of v2 and v1 keep the hour they were given.
    assert stream(part("v4", "q"), patience=1) == done
    time.sleep(0.2)
    missing = ("p", "v4", None, "missing", 1, None)
    assert stream(part("v2", "y")) == sorted([*done, missing], key=str)
    assert stream(part("v2", "z")) == sorted([*done, missing, *[("p", "v2", x, "complete", 3, 3) for x in "xyz"]], key=str)
    # The state of v4 went with its timer: its part has to come again.
    assert ("p", "v4", "r", "complete", 1, 1) in stream(("p", "v4", None, 1), part("v4", "r"))


def test_assembled_versions_are_indexed_once(spark, files, tmp_path):
    landing, root = str(tmp_path / "landing"), str(tmp_path / "ix")
    text = [("a.c", "int one(void)\n{\n\treturn 1;\n}\n"), ("b.c", "int two(void)\n{\n\treturn one();\n}\n")]
    places = []
    for i, row in enumerate(text):
        places.append(str(tmp_path / f"part{i}"))
        files([("v1", *row)]).write.parquet(places[-1])

    def run(*rows):
        spark.createDataFrame(rows, A.ARRIVALS).coalesce(1).write.mode("append").parquet(landing)
        A.ingest_parts(spark, landing, root, str(tmp_path / "check"), 3_600_000)
        return read_batches(spark, root)

    assert run(("p", "v1", places[1], None), ("p", "v1", None, 2))["paths"].count() == 0
    again = [("p", "v1", x, None) for x in places] + [("p", "v1", None, 2)]
    for rows in (again[:1], again):  # the second completes a version that is indexed already
        got = run(*rows)
        assert got["paths"].count() == 2 and got["blobs"].count() == 2
    whole = build_index(files([("v1", *r) for r in text]))
    for name in ("blobs", "defs", "refs", "paths"):
        columns = INDEX_TABLES[name].fieldNames()
        assert sorted(map(str, got[name].collect())) == sorted(map(str, whole[name].select(*columns).collect())), name
