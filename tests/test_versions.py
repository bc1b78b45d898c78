"""Version names: order, rules, latest."""

import random
import subprocess

from tagloom.operators import versions as V
from tagloom.plans.queries import TAG_RULES


def tags(spark, project, revs):
    return spark.createDataFrame([(project, r) for r in revs], "project string, rev string")


def test_order_is_that_of_sort(spark):
    revs = ["v1.10", "v1.9", "v1.9-rc1", "v1.9-rc10", "v1.9-rc2", "v2.0", "v2.0~beta", "a_1", "a.1", "a-1", "v1.9a",
            "v007.1", "v7.1", "1.0", "release/1.2.0", "v1.9.1", "V1.9", "v1..9", "v10000000000000000000000.1",
            "v" + "9" * 1200 + ".1", "v1" + "0" * 999 + ".1"]
    random.Random(1).shuffle(revs)
    want = subprocess.run(["sort", "-V"], input="\n".join(r + ".0" for r in revs), text=True, capture_output=True,
                          env={"LC_ALL": "C"}, check=True).stdout.split()
    got = V.in_natural_order(V.list_versions(tags(spark, "p", revs))).collect()
    assert [r.version + ".0" for r in got] == want
    seq = V.sequence_versions(V.list_versions(tags(spark, "p", revs)), key_chars=4).orderBy("seq").collect()
    assert [r.version + ".0" for r in seq] == want and [r.seq for r in seq] == list(range(1, len(revs) + 1))


def test_release_follows_its_candidates(spark):
    got = V.in_natural_order(V.list_versions(tags(spark, "p", ["v2.0", "v2.0-rc1", "v1.9"]))).collect()
    assert [r.version for r in got] == ["v1.9", "v2.0-rc1", "v2.0"]


def test_pre_releases_by_rule(spark):
    got = V.in_natural_order(V.list_versions(tags(spark, "early", ["1.2", "early:1.2", "1.1"]), TAG_RULES)).collect()
    assert [r.version for r in got] == ["1.1", "early:1.2", "1.2"]


def test_latest(spark):
    versions = V.list_versions(tags(spark, "p", ["v1.0", "v2.0", "v2.1-rc1", "v3.0", "v0.1"]))
    indexed = versions.where("version <> 'v3.0'")
    assert V.latest_version(versions, indexed).first()[1:] == ("v2.0", "v2.1-rc1")
    none = versions.where("false")
    assert V.latest_version(versions, none).first()[1:] == ("v0.1", "v0.1")


def test_latest_where_the_list_runs_backwards(spark):
    versions = V.list_versions(tags(spark, "b", ["v1.0", "v2.0"]), (V.VersionRules("b", list_reversed=True),))
    assert V.latest_version(versions, versions).first()[1:] == ("v2.0", "v1.0")


def test_rewriting_both_ways(spark):
    revs = ["1-2-3", "1-3"]
    got = V.add_rev(V.list_versions(tags(spark, "dashed", revs), TAG_RULES).select("project", "version"), TAG_RULES)
    assert {(r.version, r.rev_again) for r in got.collect()} == {("1.2.3", "1-2-3"), ("1.3", "1-3")}


def test_tree(spark):
    versions = V.list_versions(tags(spark, "archive", ["v1.2-rc3", "v1.3", "attic:1:0", "other"]), TAG_RULES)
    got = {(r.major, r.minor, r.version) for r in V.group_versions(versions, TAG_RULES).collect()}
    assert got == {("v1", "v1.2", "v1.2-rc3"), ("v1", "v1.3", "v1.3"), ("attic", "1:0", "attic:1:0"),
                   ("attic", "start", "start")}
    odd = V.group_versions(V.list_versions(tags(spark, "p", ["nightly"]))).first()
    assert (odd.major, odd.minor) == ("FIXME", "FIXME")


def test_resolve_version(spark):
    queries = spark.createDataFrame([("p", "latest"), ("p", "v9"), ("q", "latest")], "project string, version string")
    latest = spark.createDataFrame([("p", "v2", "v3-rc1")], "project string, latest string, latest_rc string")
    got = {tuple(r) for r in V.resolve_version(queries, latest).collect()}
    assert got == {("p", "v2"), ("p", "v9"), ("q", None)}


def test_compatible_strings_of_supporting_projects_only(spark, files):
    from tagloom.operators.blobs import build_blobs
    from tagloom.operators.compat import extract_comps

    row = ("v1", "a.dts", 'compatible = "x,y";\n')
    blobs = build_blobs(files([row], "on").unionByName(files([row], "off")))
    on = V.dts_projects(spark, [V.VersionRules("on", dts_support=True), V.VersionRules("off")])
    assert [r.project for r in extract_comps(blobs, on).collect()] == ["on"]
