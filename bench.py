"""Benchmark: prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Figures are wall times in one warm session; results go to the ``noop`` sink, so all rows and
columns are produced. Index tables are built for real and written, once; their times stand apart
from the lookups that read them. A lookup of under five seconds runs three times: ``queries`` has
its fastest run, ``spread`` the slowest and the mean.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tagloom.plans import queries as q  # noqa: E402
from tagloom.session import local_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

#: Index tables in the order of their build, per tree.
BUILDS = {
    "code": ("blobs", "paths", "first_paths", "defs", "tokens", "refs", "docs"),
    "prose": ("blobs", "paths", "defs", "tokens", "refs"),
    "config": ("blobs", "paths", "first_paths", "defs", "tokens", "refs", "comps", "comp_words", "comp_docs"),
}
LOOKUPS = (
    "search_ident", "search_ident_config", "search_compatible", "autocomplete", "ident_exists", "result_summary",
    "defs_first_path", "index_stats_code", "dir_listing", "dir_listing_asked", "path_type", "path_exists", "file_raw",
    "blobs_new", "marked_tokens", "marked_file", "links_include", "links_sysinclude", "links_comp_docs", "links_html",
    "versions_natural", "version_tree", "latest_version", "tokens", "docs_first", "quote",
)


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    spark = local_session(CPUS, "tagloom-bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    out: dict[str, float] = {}
    for tree, tables in BUILDS.items():
        index = getattr(q, f"{tree}_index")(spark, SF_DIR)
        for table in tables:
            out[f"build_{tree}_{table}"] = timed(lambda: index[table])
        out[f"build_{tree}"] = round(sum(out[f"build_{tree}_{t}"] for t in tables), 3)
    q.web_index(spark, SF_DIR)["blobs"], q.web_index(spark, SF_DIR)["paths"]
    spread = {}
    for name in LOOKUPS:
        run = lambda: q.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()  # noqa: B023, E731
        runs = [timed(run)]
        if runs[0] < 5:
            runs += [timed(run), timed(run)]
        out[name] = min(runs)
        spread[name] = {"runs": len(runs), "max": max(runs), "mean": round(sum(runs) / len(runs), 3)}
    total = sum(v for k, v in out.items() if k in LOOKUPS or k in {f"build_{t}" for t in BUILDS})
    print(json.dumps({
        "metric": "index build and batch lookups, wall time", "value": round(total, 3), "unit": "sec",
        "queries": out, "spread": spread, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"), "cpus": int(CPUS),
    }))


if __name__ == "__main__":
    main()
