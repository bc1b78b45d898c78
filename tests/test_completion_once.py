"""Names are ranked once, however often the lists of their prefixes are asked."""

from tagloom.plans import completion as C


def test_names_are_read_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([("p", f"name_{i}") for i in range(200)] + [("q", "name"), (None, "x"), ("q", None)], "project string, ident string")
    table = C.write_completions(rows.mapInArrow(counted, rows.schema), str(tmp_path / "t"))
    assert read.value == 203
    lists = {(r.project, r.prefix): r.names for r in table.collect()}
    assert lists["p", "name_1"] == sorted(f"name_{i}" for i in range(200) if str(i)[0] == "1")[: C.K] and lists["q", ""] == ["name"]
    assert not list(tmp_path.glob("_staging*"))
