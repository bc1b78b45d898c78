"""Sources, blobs, listings, links."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators import blobs as B
from tagloom.operators import links as L
from tagloom.operators import listing as LS
from tagloom.operators import versions as V
from tagloom.functions import paths as P
from tagloom.plans.directories import write_directories
from tagloom.sources import trees as T
from tagloom.sources.trees import files_from_text, scan_paths, tree_versions, union_sources


def test_scan_exported_trees(spark, tmp_path):
    base = tmp_path / "proj" / "v1"
    (base / "sub dir").mkdir(parents=True)
    (base / "sub dir" / "a+b.c").write_bytes(b"int caf\xe9;\n")
    (base / "b.c").write_bytes("é\n".encode())
    got = {r.path: r for r in scan_paths(spark, str(tmp_path)).collect()}
    assert set(got) == {"sub dir/a+b.c", "b.c"}
    row = got["sub dir/a+b.c"]
    assert (row.project, row.version, row.size, row.content) == ("proj", "v1", 10, "int café;\n")
    assert got["b.c"].content == "é\n" and got["b.c"].size == 3


def test_modes_and_links_of_trees(spark, tmp_path):
    import hashlib
    import os

    base = tmp_path / "t" / "proj" / "v1"
    (base / "d" / "deep").mkdir(parents=True)
    (base / "d" / "run.sh").write_text("#!/bin/sh\n")
    (base / "d" / "run.sh").chmod(0o755)
    (base / "d" / "deep" / "plain.c").write_text("int;\n")
    (base / "link").symlink_to("d/deep/plain.c")
    (base / "d" / "up").symlink_to("../d")  # a link to a directory above it is not walked
    (base / "gone").symlink_to("nowhere/é")
    (base / "empty.c").write_text("")
    os.mkfifo(base / "pipe")
    (tmp_path / "t" / "proj" / "v2").mkdir()
    (tmp_path / "t" / "stray.c").write_text("in no version")
    for root in (str(tmp_path / "t"), f"file://{tmp_path}/t/"):
        found = scan_paths(spark, root)
        got = {r.path: (r.kind, r.perm, r.size, r.content) for r in found.collect()}
        assert got == {
            "d/run.sh": ("blob", "100755", 10, "#!/bin/sh\n"), "d/deep/plain.c": ("blob", "100644", 5, "int;\n"),
            "link": ("blob", "120000", 14, "d/deep/plain.c"), "d/up": ("blob", "120000", 4, "../d"),
            "gone": ("blob", "120000", 10, "nowhere/é"), "empty.c": ("blob", "100644", 0, "")}
        git = hashlib.sha1(b"blob 14\0d/deep/plain.c").hexdigest()
        assert [r.blob_id for r in found.where("path = 'link'").collect()] == [git]
    assert found.rdd.getNumPartitions() == 3  # v1: its own files and d; v2: its own files
    assert [tuple(r) for r in tree_versions(spark, str(tmp_path / "t")).collect()] == [("proj", "v1")]
    shown = LS.list_dir(B.listing(found), None, B.build_blobs(found)).where("dir = ''").collect()
    assert {(r.kind, r.name, r.target) for r in shown} == {
        ("tree", "d", "d"), ("symlink", "link", "d/deep/plain.c"), ("symlink", "gone", "nowhere/é"), ("blob", "empty.c", "empty.c")}
    (tmp_path / "none").mkdir()
    assert scan_paths(spark, str(tmp_path / "none")).count() == 0


def test_first_source_of_a_version_counts(files):
    got = union_sources(files([("v1", "a", "1")]), files([("v1", "a", "2"), ("v2", "a", "3")])).collect()
    assert {(r.version, r.content) for r in got} == {("v1", "1"), ("v2", "3")}


def test_sources_are_united_without_moving_content(spark, files, tmp_path, monkeypatch):
    one = [("v1", "a", "1"), ("v1", "b", "1"), (None, "n", "5")]
    two = [("v1", "a", "2"), ("v2", "a", "3"), (None, "n", "6")]
    made = []
    for i, part in enumerate((one, two)):
        files(part).write.parquet(f"{tmp_path}/{i}")
        made.append(spark.read.parquet(f"{tmp_path}/{i}"))
    wanted = {("v1", "a", "1"), ("v1", "b", "1"), (None, "n", "5"), ("v2", "a", "3")}
    rows = lambda df: {(r.version, r.path, r.content) for r in df.collect()}
    known = [s.select("project", "version") for s in made]
    for got in (union_sources(*made), union_sources(*made, versions=known)):
        assert rows(got) == wanted
        plan = got._jdf.queryExecution().explainString(got._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        sections = [s for s in plan.split("\n\n") if ") Exchange" in s.split("\n")[0]]
        assert sections and not [s for s in sections if "content#" in s]
        assert plan.count("content:string") == 2  # each source is scanned with its content once
    monkeypatch.setattr(T, "OWNERS", 1)
    assert rows(union_sources(*made)) == wanted


def test_name_of_a_blob_is_the_first_seen(files):
    got = B.build_blobs(files([("v1.10", "a.c", "x"), ("v1.9", "z/b.dts", "x"), ("v1.9", "z/c.c", "x")])).collect()
    assert [(r.filename, r.family, r.first_version) for r in got] == [("b.dts", "D", "v1.9")]


def test_new_blobs(files):
    old = B.build_blobs(files([("v1", "a.c", "x")]))
    got = B.new_blobs(files([("v2", "a.c", "x"), ("v2", "b.c", "y"), ("v2", "c.c", "y")]), old).collect()
    assert [(r.filename, r.content) for r in got] == [("b.c", "y")]


def test_hot_blob_is_cut_before_the_shuffle(files):
    plan = B.build_blobs(files([("v1", "a.c", "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Partial") > plan.index("Final")


def test_families(spark):
    names = ["a.c", "a.H", "x.S", "a.c++", "b.dtsi", "Kconfig", "kconfig-x.y", "Kconfig.rst", "Makefile", "GNUmakefile",
             "x.mk", "makefile.rst", "d/.c", "README", "Makefile.am"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", P.file_family(F.col("n")).alias("f"))
    assert {r.n: r.f for r in got.collect()} == {
        "a.c": "C", "a.H": "C", "x.S": "C", "a.c++": "C", "b.dtsi": "D", "Kconfig": "K", "kconfig-x.y": "K",
        "Kconfig.rst": None, "Makefile": "M", "GNUmakefile": None, "x.mk": "M", "makefile.rst": None, "d/.c": None,
        "README": None, "Makefile.am": "M"}


def test_links_and_hidden_names_in_a_directory(spark):
    rows = [("p", "v1", "d/x.c", "int;", "100644"), ("p", "v1", "d/.hid", "a", "100644"),
            ("p", "v1", "d/sub/y.c", "b", "100644"), ("p", "v1", "d/lnk", "../e/./z.c", "120000")]
    files = files_from_text(spark.createDataFrame(
        rows, "project string, version string, path string, content string, perm string"))
    dirs = spark.createDataFrame([("p", "v1", "/d/")], "project string, version string, dir string")
    got = LS.list_dir(B.listing(files), dirs, B.build_blobs(files)).collect()
    assert [(r.kind, r.name, r.target, r.size) for r in got] == [
        ("tree", "sub", "d/sub", None), ("symlink", "lnk", "e/z.c", 10), ("blob", "x.c", "d/x.c", 4)]


def test_existence_takes_direct_parents_only(files, spark):
    paths = B.listing(files([("v1", "a/b/c.c", "x")]))
    keys = spark.createDataFrame([("p", "v1", k) for k in ("a/b/c.c", "/a/b/", "a", "")],
                                 "project string, version string, path string")
    assert {r.path for r in LS.path_exists(keys, paths).collect()} == {"a/b/c.c", "/a/b/"}
    assert {r.path: r.type for r in LS.path_type(paths, keys).collect()} == {
        "a/b/c.c": "blob", "/a/b/": "tree", "a": "tree", "": "tree"}


def links(files, rows, rules, **kw):
    f = files([("v1", *r) for r in rows])
    got = L.extract_links(B.listing(f), B.build_blobs(f), rules, **kw).collect()
    return {(r.path, r.line, r.rule, r.text, r.target) for r in got}


def test_makefile_links(files):
    make = "obj-y += a.o dir/ gone/\nb.o := x\nobj-y += c.o := d.o.cmd\ndir/\nF=dir/x.h $(srctree)/top.c)\nsubdir-y := dir\n"
    got = links(files, [("m/Makefile", make), ("m/dir/Makefile", ""), ("m/dir/x.h", "h"), ("top.c", "t")], L.MAKE_LINKS)
    assert got == {
        ("m/Makefile", 1, "make_o", "a", "m/a.c"), ("m/Makefile", 1, "make_dir", "dir", "m/dir/Makefile"),
        ("m/Makefile", 4, "make_dir", "dir", "m/dir/Makefile"), ("m/Makefile", 5, "make_file", "dir/x.h", "m/dir/x.h"),
        ("m/Makefile", 5, "make_srctree", "top.c", "top.c"), ("m/Makefile", 6, "make_subdir", "dir", "m/dir/Makefile"),
        ("m/Makefile", 3, "make_o", "d", "m/d.c"),
    }


def test_system_includes(files):
    text = "#include <linux/a.h>\n#include <asm/b.h>\n #include <none.h>\n#include \"a.h\"\n"
    rows = [("src/x.c", text), ("include/linux/a.h", ""), ("arch/linux/a.h", "1"), ("include/uapi/y.h", "#include <linux/a.h>\n//\n")]
    rule = L.sys_include(("arch", "include"), "^include/uapi/")
    assert links(files, rows, [rule, L.INCLUDE]) == {
        ("src/x.c", 1, "sysinclude", "linux/a.h", "arch/linux/a.h"), ("src/x.c", 4, "include", "a.h", "src/a.h")}
    assert links(files, rows, [L.SYS_INCLUDE]) >= {
        ("include/uapi/y.h", 1, "sysinclude", "linux/a.h", "include/linux/a.h")}


def test_rule_by_functions(files):
    rule = L.LinkRule(
        "near", L.named("use", "<", ">"), when=lambda path: path.endswith(".x"),
        resolve=lambda path, text: F.when(text != "skip", F.array(F.concat(P.dir_name(path), F.lit("/../"), text), F.concat(F.lit("lib/"), text))),
    )
    rows = [("a/b/m.x", "use <f>\nuse <skip>\nuse <g>\nuse <none>\n"), ("a/m.y", "use <f>\nuse <q>\n"), ("a/f", "1"), ("lib/f", "2"), ("lib/g", "3")]
    assert links(files, rows, [rule]) == {
        ("a/b/m.x", 1, "near", "f", "a/f"), ("a/b/m.x", 3, "near", "g", "a/g"), ("a/b/m.x", 4, "near", "none", "a/none")}
    assert links(files, rows, [L.replace(rule, check=True), L.INCLUDE]) == {
        ("a/b/m.x", 1, "near", "f", "a/f"), ("a/b/m.x", 3, "near", "g", "lib/g")}


def test_two_equal_links_on_a_line_stay_two(files):
    f = files([("v1", "a_defconfig", "CONFIG_A CONFIG_A\n")])
    assert L.extract_links(B.listing(f), B.build_blobs(f), [L.DEFCONFIG]).count() == 2


def test_compatible_strings_in_devicetree(files):
    got = links(files, [("a.dts", '\t"before" compatible = "x,y", "z";\n')], [L.COMP_DTS])
    assert {g[3] for g in got} == {"x,y", "z"}


def test_directories_by_content(spark, files, tmp_path):
    from tagloom.operators import listing as LS
    from tagloom.operators.blobs import listing
    from tagloom.plans import directories as DR

    same = [("lib/a/x.c", "1"), ("lib/a/y.c", "2"), ("copy/x.c", "1"), ("copy/y.c", "2")]
    rows = [(v, p, c) for v in ("v1", "v2") for p, c in [*same, (".hidden", "h"), ("deep/er/and/deeper/z", "z")]]
    rows += [("v2", "lib/b.c", "new"), ("v3", "only.c", "1"), ("v3", "lib/a/x.c", "changed"), ("v3", "lib/a/y.c", "2")]
    paths = listing(files(rows))
    tree = DR.write_directories(paths, str(tmp_path / "t"))
    dirs = {(r.version, r.dir): r.node for r in tree["dirs"].collect()}
    assert dirs["v1", "lib/a"] == dirs["v2", "lib/a"] == dirs["v1", "copy"] != dirs["v3", "lib/a"]
    assert dirs["v1", "deep"] == dirs["v2", "deep"] and dirs["v1", "lib"] != dirs["v2", "lib"] and dirs["v1", ""] != dirs["v2", ""]
    assert tree["nodes"].where(F.col("node") == dirs["v1", "copy"]).count() == 2
    asked = ["", "/", "lib", "lib/a/", "copy", "deep/er", "gone", "only.c", "lib/a/x.c", ".hidden", "deep/er/and/deeper/z", "deep"]
    keys = spark.createDataFrame([("p", v, p) for v in ("v1", "v2", "v3", "v4") for p in asked], "project string, version string, path string")
    rows = lambda df: sorted(map(str, df.collect()))
    wanted = keys.withColumnRenamed("path", "dir")
    assert rows(DR.list_directories(tree, wanted)) == rows(LS.list_dir(paths, wanted))
    assert rows(DR.path_types(tree, keys)) == rows(LS.path_type(paths, keys))
    assert rows(DR.paths_exist(keys, tree)) == rows(LS.path_exists(keys, paths))
    empty = DR.write_directories(paths.where("false"), str(tmp_path / "none"))
    assert empty["dirs"].count() == 0 and DR.paths_exist(keys, empty).count() == 0


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_contents_stay_when_few_are_asked_for(spark, files, tmp_path):
    B.build_blobs(files([("v1", "a.c", "int aa;\n"), ("v1", "b.c", "int bb;\n")])).write.parquet(f"{tmp_path}/blobs")
    blobs = spark.read.parquet(f"{tmp_path}/blobs")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = B.read_blob(blobs, blobs.where("filename = 'a.c'").select("project", "blob_id"))
        assert "SortMergeJoin" not in _plan(got) and [r.content for r in got.collect()] == ["int aa;\n"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_questions_of_one_project_do_not_meet_in_a_task(spark):
    asked = spark.createDataFrame([("p", v) for v in ("latest", "latest-rc", "v1")] + [("q", "latest")], "project string, version string")
    latest = spark.createDataFrame([("p", "v2", "v3-rc")], "project string, latest string, latest_rc string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = V.resolve_version(asked, latest)
        assert "Exchange hashpartitioning" not in _plan(got)
        assert sorted((r.project, r.version or "") for r in got.collect()) == [("p", "v1"), ("p", "v2"), ("p", "v3-rc"), ("q", "")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_checked_links_are_read_once(files):
    tree = files([("v1", "a/x.c", '#include "y.h"\n#include "gone.h"\n'), ("v1", "a/y.h", "int yy;\n")])
    rule = L.LinkRule("near", L.named("#include", '"', '"'), extensions=L.C_EXTENSIONS, hint="#include", check=True)
    got = L.extract_links(B.listing(tree), B.build_blobs(tree), [rule])
    assert _plan(got).count("Generate posexplode") == 2  # lines, and what a line holds
    assert [(r.path, r.line, r.target) for r in got.collect()] == [("a/x.c", 1, "a/y.h")]


def test_nodes_of_directories_are_not_spread_again(spark, files, tmp_path, monkeypatch):
    spreads = []
    told = DataFrame.repartitionByRange
    monkeypatch.setattr(DataFrame, "repartitionByRange", lambda self, *a: spreads.append(a) or told(self, *a))
    tree = write_directories(B.listing(files([("v1", "a/b.c", "x"), ("v2", "a/b.c", "x"), ("v2", "a/c.c", "y")])), f"{tmp_path}/tree")
    assert not spreads and tree["nodes"].where("kind <> 'tree'").count() == 3
    assert tree["dirs"].groupBy("node").count().count() == 4 and set(tree["nodes"].where("kind <> 'tree'").select("child").distinct().toPandas()["child"]) == {
        r.blob_id for r in files([("v1", "x", "x"), ("v1", "y", "y")]).collect()
    }


def test_directories_are_dealt_to_a_number_of_tasks_that_stays(files):
    got = LS.directories(files([("v1", "a/b/c.c", "x"), ("v1", "a/d.c", "y"), ("v1", "e", "z"), ("v2", "a/b/f.c", "x")]))
    assert sorted((r.version, r.path) for r in got.collect()) == [("v1", ""), ("v1", "a"), ("v1", "a/b"), ("v2", ""), ("v2", "a"), ("v2", "a/b")]
    assert "REPARTITION_BY_NUM" in _plan(got) and "Union" not in _plan(got)
