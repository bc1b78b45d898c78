"""Index build, storage, lookups, and incremental runs."""

import json

import pytest
from pyspark.sql import functions as F

from tagloom.operators.blobs import build_blobs
from tagloom.operators.refs import explode_lines, extract_refs
from tagloom.operators.defs import extract_defs
from tagloom.plans import search as S
from tagloom.plans.index import IndexOptions, StoredIndex, build_index, read_index, write_index
from tagloom.schema import FILES, INDEX_TABLES
from tagloom.streaming.ingest import MANIFEST, compact, fresh_blob_stream, ingest_available, ingest_batch, read_batches

V1 = [
    ("v1", "lib/a.c", "/**\n * foo - does\n */\nint foo(int a)\n{\n\treturn later(a);\n}\n"),
    ("v1", "lib/copy.c", "/**\n * foo - does\n */\nint foo(int a)\n{\n\treturn later(a);\n}\n"),
    ("v1", "use.c", "\nint user(void)\n{\n\tfoo(1); foo(2);\n\treturn MAC;\n}\n"),
    ("v1", "x.dts", "/ {\n\tcompatible = \"ven,dev\";\n\treg = <MAC>;\n};\n"),
    ("v1", "Makefile", "obj-$(CONFIG_NET) += a.o\n"),
]
V2 = [
    *[("v2", *r[1:]) for r in V1],
    ("v2", "later.c", "int later(int a)\n{\n\treturn 0;\n}\n#define MAC 1\n"),
    ("v2", "Kconfig", "config NET\n\tbool\n"),
    ("v2", "drv.c", "struct id ids[] = {\n\t{ .compatible = \"ven,dev\" },\n};\n"),
    ("v2", "Documentation/devicetree/bindings/a.txt", "for ven,dev and ven,none\n"),
]
V3 = [("v3", *r[1:]) for r in V2] + [("v3", "Documentation/devicetree/bindings/use.c", V1[2][2])]


@pytest.fixture(scope="module")
def index(files, tmp_path_factory):
    """The first two versions as a stored index."""
    return write_index(files(V1 + V2), str(tmp_path_factory.mktemp("index") / "ix"))


def rows(df):
    return sorted(map(str, df.collect()))


def same(a, b):
    for name, schema in INDEX_TABLES.items():
        columns = schema.fieldNames()
        assert rows(a[name].select(*columns)) == rows(b[name].select(*columns)), name


def test_stored_equals_lazy(spark, files, index):
    same(read_index(spark, index.root), build_index(files(V1 + V2)))


def test_references_alone_need_no_stored_candidates(files, index, tmp_path):
    alone = StoredIndex(files(V1 + V2), str(tmp_path / "alone"))
    assert rows(alone["refs"]) == rows(index["refs"]) and "tokens" not in alone
    assert not (tmp_path / "alone" / "tokens").exists()


def test_projects_of_one_index_do_not_mix(spark, files, tmp_path):
    """The same contents, versions and names in two projects, one of them with more: as each for itself."""
    one, two = files(V1 + V2, "p"), files(V1, "q/r")
    both = write_index(one.unionByName(two).repartition(5), str(tmp_path / "both"))
    alone = [write_index(f, str(tmp_path / f"alone{i}")) for i, f in enumerate((one, two))]
    stored = read_index(spark, both.root)
    for name in INDEX_TABLES:
        assert rows(stored[name]) == rows(alone[0][name].unionByName(alone[1][name])), name
    assert both["refs"].where("project = 'q/r' AND ident = 'MAC'").count() == 0 < both["refs"].where("project = 'p' AND ident = 'MAC'").count()


def test_partitioning_changes_nothing(files, index):
    same(build_index(files(V1 + V2).orderBy(F.desc("path")).repartition(7)), index)


def test_prefix_filter_reaches_the_scan(index):
    plan = S.complete_prefix(index, "p", "fo")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(ident,fo)" in plan and "PartitionFilters: [isnotnull(project" in plan
    assert [r.ident for r in S.complete_prefix(index, "p", "fo").collect()] == ["foo"]


def test_references_name_definitions_and_are_none(index):
    refs, defs = explode_lines(index["refs"]), index["defs"]
    assert refs.join(defs.select("project", "ident"), ["project", "ident"], "left_anti").count() == 0
    assert refs.join(defs, ["project", "ident", "blob_id", "line"], "left_semi").count() == 0


def test_as_of(files):
    blobs = build_blobs(files(V1 + V2))
    defs = extract_defs(blobs)
    names = lambda mode: {r.ident for r in extract_refs(blobs, defs, mode).collect()}
    assert {"later", "MAC", "CONFIG_NET"} <= names("all")
    assert names("as_of") & {"later", "MAC", "CONFIG_NET"} == set()
    assert "foo" in names("as_of")


def ask(spark, index, *queries, **kw):
    q = spark.createDataFrame([("p", *x) for x in queries], "project string, version string, ident string, family string")
    got = S.search_ident(index, q, **kw).collect()
    return {(r.version, r.ident, r.family, r.section, r.type, r.path, tuple(r.lines)) for r in got}


def test_lookup(spark, index):
    foo = ask(spark, index, ("v1", "foo", "C"))
    # Definitions at the first path of a blob, documentation and references at all.
    assert {r[3:] for r in foo} == {
        ("definitions", "function", "lib/a.c", (4,)),
        ("references", None, "use.c", (4, 4)),
        ("documentations", None, "lib/a.c", (1,)), ("documentations", None, "lib/copy.c", (1,))}
    every = ask(spark, index, ("v1", "foo", "C"), dup_defs="all")
    assert {r[5] for r in every if r[3] == "definitions"} == {"lib/a.c", "lib/copy.c"}


def test_families_of_a_lookup(spark, index):
    sections = lambda family, ident="MAC": {
        (r[3], r[5]) for r in ask(spark, index, ("v2", ident, family))}
    assert sections("C") == {("definitions", "later.c"), ("references", "use.c")}
    assert sections("D") == {("definitions", "later.c"), ("references", "x.dts")}
    assert sections("K") == {("references", "use.c")}
    assert sections("M") == set()
    assert sections("A") == {("definitions", "later.c"), ("references", "use.c"), ("references", "x.dts")}
    assert sections("nonsense") == sections("nonsense") and {r[2] for r in ask(spark, index, ("v2", "MAC", "??"))} == {"C"}
    assert sections("K", "CONFIG_NET") == {("definitions", "Kconfig"), ("references", "Makefile")}


def test_unknown_names_and_versions(spark, index):
    assert ask(spark, index, ("v1", "nobody", "C"), ("v9", "foo", "C")) == set()
    q = spark.createDataFrame([("p", "v1", "MAC", "C"), ("p", "v1", "nobody", "C"), ("p", "v9", "foo", "C")],
                              "project string, version string, ident string, family string")
    got = {r.ident: (r.symbol_exists, r.version_indexed) for r in S.ident_exists(index, q).collect()}
    assert got == {"MAC": (True, True), "nobody": (False, True), "foo": (True, False)}


def test_compatible_lookup(spark, index):
    q = spark.createDataFrame([("p", "v2", "ven,dev", "B"), ("p", "v1", "ven,dev", "B")],
                              "project string, version string, ident string, family string")
    got = {(r.version, r.section, r.type, r.path, tuple(r.lines)) for r in S.search_compatible(index, q).collect()}
    assert got == {
        ("v2", "code", "compatible", "drv.c", (2,)), ("v2", "dts", None, "x.dts", (2,)), ("v1", "dts", None, "x.dts", (2,)),
        ("v2", "documentations", None, "Documentation/devicetree/bindings/a.txt", (1,))}


def test_json_answer(spark, files):
    proto = ("v1", "proto.h", "\nint foo(int a);\n")
    index = build_index(files([*V1, proto]))
    q = spark.createDataFrame([("p", "v1", "foo", "C"), ("p", "v1", "nobody", "C")],
                              "project string, version string, ident string, family string")
    got = {r.ident: json.loads(r.json) for r in S.search_json(S.search_ident(index, q), q).collect()}
    assert got["nobody"] == {"definitions": [], "references": [], "documentations": []}
    assert got["foo"]["definitions"] == [{"path": "proto.h", "line": 2, "type": "prototype"},
                                         {"path": "lib/a.c", "line": 4, "type": "function"}]
    assert got["foo"]["references"] == [{"path": "use.c", "line": "4,4", "type": None}]


def test_completion_scope(spark, index):
    q = spark.createDataFrame([("p", "", "C"), ("p", "", "K"), ("p", "CON", "K"), ("p", "ven", "B")],
                              "project string, prefix string, family string")
    got = lambda **kw: {(r.prefix, r.family, r.rank, r.ident) for r in S.autocomplete(index, q, **kw).collect()}
    everything = sorted(r.ident for r in index["defs"].select("ident").distinct().collect())
    assert {(i + 1, n) for i, n in enumerate(everything[:10])} == {r[2:] for r in got() if r[:2] == ("", "C")}
    assert {r[3] for r in got(scope="family") if r[1] == "K"} == {"CONFIG_NET"}
    assert ("ven", "B", 1, "ven,dev") in got()


def manifest(spark, tmp_path, landing, n, version, files_df, count=None):
    """Writes a version over several files, then its manifest."""
    place = tmp_path / f"place{n}"
    files_df.repartition(3).write.parquet(str(place))
    part = tmp_path / f"manifest{n}"
    rows = [("p", version, str(place), files_df.count() if count is None else count)]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(str(part))
    (data,) = part.glob("*.parquet")
    (landing / f"{n}.parquet").write_bytes(data.read_bytes())


@pytest.mark.parametrize("options", [IndexOptions(), IndexOptions(resolve="as_of")])
def test_stream_equals_batch(spark, files, tmp_path, options):
    landing, root = tmp_path / "landing", str(tmp_path / "ix")
    landing.mkdir()
    for n, version in enumerate((V1, V2, V3)):
        manifest(spark, tmp_path, landing, n, version[0][0], files(version))
        if n != 1:  # the second run brings two versions, in batches of their own
            ingest_available(spark, str(landing), root, str(tmp_path / "cp"), options, files_per_batch=1)
    same(read_batches(spark, root), build_index(files(V1 + V2 + V3), options))
    compact(spark, root, str(tmp_path / "plain"))
    same(read_index(spark, str(tmp_path / "plain")), read_batches(spark, root))


def test_incomplete_version_fails_and_may_come_again(spark, files, tmp_path):
    landing, root = tmp_path / "landing", str(tmp_path / "ix")
    landing.mkdir()
    manifest(spark, tmp_path, landing, 0, "v1", files(V1), count=files(V1).count() + 1)
    with pytest.raises(Exception, match="other numbers of files"):
        ingest_available(spark, str(landing), root, str(tmp_path / "cp"))
    assert read_batches(spark, root)["paths"].isEmpty()
    again = tmp_path / "again"
    again.mkdir()
    manifest(spark, tmp_path, again, 1, "v1", files(V1))
    manifest(spark, tmp_path, again, 2, "v1", files(V1))
    with pytest.raises(Exception, match="several manifests"):
        ingest_available(spark, str(again), root, str(tmp_path / "cp2"))
    (again / "2.parquet").unlink()
    ingest_available(spark, str(again), root, str(tmp_path / "cp3"))
    same(read_batches(spark, root), build_index(files(V1)))
    with pytest.raises(ValueError, match="indexed already"):
        ingest_batch(files(V1), 9, root)


def test_stored_content_is_not_read_again(spark, files, tmp_path, monkeypatch):
    """No plan of a second batch scans the content of stored blobs."""
    from tagloom.streaming import ingest

    root, plans = str(tmp_path / "ix"), []
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # whole paths in plans
    ingest_batch(files(V1), 0, root)
    real = ingest.write_table

    def spying(df, name, path, *more):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        real(df, name, path, *more)

    monkeypatch.setattr(ingest, "write_table", spying)
    ingest_batch(files(V2), 1, root)
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    scans = [x for plan in plans for x in plan.split("\n") if "FileScan" in x and f"{root}/blobs" in x and "batch=1" not in x]
    assert scans, [x for plan in plans for x in plan.split("\n") if "FileScan" in x][:3]
    assert not [x for x in scans if "content:string" in x]


def test_batch_reads_the_buckets_of_its_new_names(spark, files, tmp_path, monkeypatch):
    """Ten new names, used by files of an earlier batch, open a few of the old token files, however many batches there are."""
    from tagloom.streaming import ingest

    root, opened = str(tmp_path / "ix"), []
    uses = "".join(f"\tuse(late_{i});\n" for i in range(10))
    many = "".join(f"\tuse(name_{i});\n" for i in range(3000))
    first = [("v1", "b.c", f"int first(void)\n{{\n{uses}{many}}}\n")]
    third = [("v3", "late.h", "/* */\n" + "".join(f"int late_{i};\n" for i in range(10)))]
    ingest_batch(files(first), 0, root)
    old = {f for n in ("tokens", "defs") for f in spark.read.parquet(f"{root}/{n}").inputFiles()}
    real = ingest.read_buckets

    def spying(spark, root, name, idents, but=None):
        out = real(spark, root, name, idents, but)
        opened.append((name, out.inputFiles()))
        return out

    monkeypatch.setattr(ingest, "read_buckets", spying)
    ingest_batch(files(third), 2, root)
    (tokens,) = [f for name, f in opened if name == "tokens"]
    assert 0 < len(tokens) < 0.05 * sum("/tokens/" in f for f in old)
    whole = build_index(files(first + third))
    same(read_batches(spark, root), whole)
    refs = read_batches(spark, root)["refs"]
    assert refs.where("ident LIKE 'late%'").count() == 10
    versions = {(r.project, r.version) for r in ingest.indexed_versions(spark, root).collect()}
    assert versions == {("p", "v1"), ("p", "v3")}
    assert ingest.indexed_versions(spark, root, but=2).count() == 1


def test_first_names_in_the_projects_own_order(spark, files):
    from tagloom.operators.blobs import build_blobs
    from tagloom.operators.versions import VersionRules, list_versions, sequence_versions

    rows = [(v, f"{v}.c", "int x;\n") for v in ("early:1.2", "1.2", "1.1")]
    made = files(rows)
    tags = made.select("project", F.col("version").alias("rev"))
    for rule, want in ((VersionRules("p"), "1.1"), (VersionRules("p", list_reversed=True), "early:1.2"),
                       (VersionRules("p", list_reversed=True, order_as=(("^early:(.*)$", "$1~early"),)), "1.2")):
        versions = sequence_versions(list_versions(tags, (rule,)))
        (blob,) = build_blobs(made, versions).collect()
        assert blob.first_version == want and blob.filename == want + ".c"
        (same_blob,) = build_index(made, IndexOptions(versions=versions))["blobs"].collect()
        assert same_blob == blob


class Lost(Exception):
    pass


@pytest.mark.parametrize("last", ["refs", "paths"])
def test_batch_lost_half_way(spark, files, index, tmp_path, last):
    root = str(tmp_path / "ix")

    def die(name):
        if name == last:
            raise Lost

    ingest_batch(files(V1), 0, root)
    names = ("defs", "refs", "paths")
    before = {n: rows(read_batches(spark, root)[n]) for n in names}
    with pytest.raises(Lost):
        ingest_batch(files(V2), 1, root, step=die)
    assert {n: rows(read_batches(spark, root)[n]) for n in names} == before
    ingest_batch(files(V2), 1, root)
    same(read_batches(spark, root), index)


def test_blob_stream_by_state(spark, files, tmp_path):
    files(V1 + V2).write.parquet(str(tmp_path / "in"))
    stream = fresh_blob_stream(spark.readStream.schema(FILES).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("fresh").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("fresh").count() == build_blobs(files(V1 + V2)).count()


def test_common_words_without_definition_are_left_out_early(spark, files):
    from tagloom.operators.refs import common_strangers, known_idents, resolve, token_postings

    many = build_blobs(files([("v1", f"f{i}.c", f"\nint fun{i}(void)\n{{\n\tshared(fun{i % 7});\n}}\n") for i in range(30)]))
    defs = extract_defs(many)
    strangers = common_strangers(many, known_idents(defs), one_in=1)
    assert {"int", "void", "shared"} == {r.ident for r in strangers.collect()}
    every = token_postings(many, defs)
    fewer = token_postings(many, defs, strangers=strangers)
    assert rows(fewer) == rows(every.where("ident NOT IN ('int', 'void', 'shared')"))
    assert rows(extract_refs(many, defs)) == rows(resolve(every, known_idents(defs)))


def test_first_paths_cross_the_network_once(spark, index):
    from tagloom.operators.blobs import first_paths
    from tagloom.plans.index import UNSPREAD, table_plan

    plan = table_plan("first_paths", None, index, IndexOptions())
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1 and "first_paths" in UNSPREAD
    assert rows(index["first_paths"]) == rows(first_paths(index["paths"]).select(*index["first_paths"].columns))


def test_tables_are_stored_small(spark, index):
    assert all(".zstd." in name for t in ("blobs", "paths", "first_paths", "refs") for name in index[t].inputFiles())


def test_documentation_asks_blobs_no_second_time(spark, files):
    from tagloom.operators.docs import extract_docs

    some = build_blobs(files(V1))
    blocks = extract_docs(some)
    assert [(r.ident, r.line, r.family) for r in blocks.collect()] == [("foo", 1, "C")]
    # Blocks, and the heads of functions that begin their line.
    assert blocks._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 2
