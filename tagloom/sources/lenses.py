"""Versioned file trees derived from the star-schema test tables.

Every lens yields the files schema. Files are written row by row, or from groups
whose size is bounded by a key range (64 parts, 100 suppliers), so no lens
gathers an unbounded group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.sources.trees import files_from_text

PARTS_PER_HEADER = 64
SUPPLIERS_PER_HEADER = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _s(col) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("string")


def _cat(*parts) -> Column:
    """Concatenate; columns as they are, Python strings as literals."""
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _month(day: str) -> Column:
    return _cat("v", _s(F.year(day)), ".", _s(F.month(day)))


def _chunk(key: str, size: int) -> Column:
    return F.floor(F.col(key) / size).cast("bigint")


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project ``code``: a C file per order and per line item, shared headers.

    A line item's file depends on part and line number only, so many paths,
    within a version and across versions, hold the same blob. Headers belong to
    a version when something in it uses one of their names.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    key = F.col("o_orderkey")
    order_files = orders.select(
        _month("o_orderdate").alias("version"),
        _cat("drivers/q", _s(key % 7), "/order_", _s(key), ".c").alias("path"),
        _cat(
            F.when(key % 3 == 0, "/*\n").otherwise("/**\n"),
            " * order_", _s(key), " - priority ", F.col("o_orderpriority"), "\n",
            " */\n",
            "int order_", _s(key), "(void)\n",
            "{\n",
            "\treturn ", _s(key % 100), ";\n",
            "}\n",
        ).alias("content"),
    )

    used = table(spark, sf_dir, "lineitem").select(
        _month("l_shipdate").alias("version"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"
    )
    part, number = F.col("l_partkey"), F.col("l_linenumber")
    header = _s(_chunk("l_partkey", PARTS_PER_HEADER))
    item_files = used.select("version", "l_orderkey", "l_partkey", "l_linenumber").distinct().select(
        "version",
        _cat(
            "drivers/q", _s(F.col("l_orderkey") % 7), "/o", _s("l_orderkey"),
            "/item_", _s(part), "_", _s(number), ".c",
        ).alias("path"),
        _cat(
            '#include "../../../include/part_', header, '.h"\n',
            F.when(number % 2 == 0, _cat("#include <part_", header, ".h>\n")).otherwise("#include <none.h>\n"),
            "/* order_", _s(part), " */\n",
            "int item_", _s(part), "_", _s(number), "(void)\n",
            "{\n",
            F.repeat(
                _cat(
                    "\tuse(part_", _s(part), ', "supp_', _s(part % 10), '", part_', _s(part),
                    "); // part_", _s(part), "\n",
                ),
                number,
            ),
            "}\n",
        ).alias("content"),
    )

    part_headers = (
        table(spark, sf_dir, "part")
        .groupBy(_chunk("p_partkey", PARTS_PER_HEADER).alias("chunk"))
        .agg(F.array_sort(F.collect_set(F.struct("p_partkey", "p_size"))).alias("_rows"))
        .select(
            "chunk",
            _cat("include/part_", _s("chunk"), ".h").alias("path"),
            F.array_join(
                F.transform(
                    "_rows", lambda r: _cat("#define part_", _s(r["p_partkey"]), " ", _s(r["p_size"]), "\n")
                ),
                "",
            ).alias("content"),
        )
    )
    supp_headers = (
        table(spark, sf_dir, "supplier")
        .groupBy(_chunk("s_suppkey", SUPPLIERS_PER_HEADER).alias("chunk"))
        .agg(F.array_sort(F.collect_set("s_suppkey")).alias("_rows"))
        .select(
            "chunk",
            _cat("include/supp_", _s("chunk"), ".h").alias("path"),
            F.array_join(F.transform("_rows", lambda k: _cat("extern int supp_", _s(k), ";\n")), "").alias("content"),
        )
    )
    part_use = used.select("version", _chunk("l_partkey", PARTS_PER_HEADER).alias("chunk")).distinct()
    supp_use = used.select("version", _chunk("l_suppkey", SUPPLIERS_PER_HEADER).alias("chunk")).distinct()
    columns = ["version", "path", "content"]
    rows = (
        order_files.unionByName(item_files)
        .unionByName(part_use.join(part_headers, "chunk").select(*columns))
        .unionByName(supp_use.join(supp_headers, "chunk").select(*columns))
    )
    return files_from_text(rows.withColumn("project", F.lit("code")))


def offices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(n_nationkey, n_name, n_regionkey)`` of the nations, and after them of all customers whose keys are no nation's: each has a directory."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), "n_name", "n_regionkey")
    customers = table(spark, sf_dir, "customer").where("c_custkey > 24").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return nation.unionByName(customers.select(F.col("c_custkey").cast("bigint").alias("n_nationkey"), F.col("c_name").alias("n_name"), "n_regionkey"))


def old_style_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project ``old``: a C file per part with functions whose parameters are declared behind their list."""
    key = _s("p_partkey")
    second = _cat("put_", key, "(n)\nlong n;\n{\n}\n")
    return files_from_text(table(spark, sf_dir, "part").select(
        F.lit("old").alias("project"), F.lit("v1").alias("version"), _cat("lib/part_", key, ".c").alias("path"),
        _cat(
            "int take_", key, "(size, name)\nint size;\nchar *name;\n{\n\treturn size;\n}\n",
            F.when(F.col("p_size") % 2 == 0, second).otherwise(""),
            "int told_", key, "(int size);\nint kept_", key, ";\n",
        ).alias("content"),
    ))


def config_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project ``config``: Kconfig, makefiles, C, devicetree, bindings and
    defconfig files; one version per region."""
    nation = offices(spark, sf_dir).select(
        "n_nationkey", "n_name", _cat("v1.", _s("n_regionkey")).alias("version"),
        _cat("net/r", _s("n_regionkey"), "/n", _s("n_nationkey")).alias("dir"),
    )
    n = _s("n_nationkey")
    d = F.col("dir")

    def out(rows: DataFrame, path: Column, content: Column) -> DataFrame:
        return rows.select("version", path.alias("path"), content.alias("content"))

    kconfig = out(
        nation, _cat(d, "/Kconfig"),
        _cat(
            "config NATION_", n, "\n", '\tbool "', F.col("n_name"), '"\n',
            "\tdepends on NATION_", n, "\n", 'source "', d, '/sub/Makefile"\n',
        ),
    )
    makefile = out(
        nation, _cat(d, "/Makefile"),
        _cat(
            "obj-$(CONFIG_NATION_", n, ") += nation_", n, ".o\n",
            "obj-y += sub/\n",
            "obj-y += gone/\n",
            "subdir-y += doc\n",
            "dtb-y += board_", n, ".dtb\n",
            "include $(srctree)/", d, "/Kconfig\n",
            "include $(srctree)/", d, "/absent\n",
            "extra-y += sub/Makefile\n",
            " nation_", n, ".o := none\n",
        ),
    )
    sub = out(nation, _cat(d, "/sub/Makefile"), F.lit("obj-y += leaf.o\n"))
    config_in = out(
        nation, _cat(d, "/Config.in"), _cat('source "', d, '/Kconfig"\n', '  source "', d, '/none.in"\n')
    )
    defconfig = out(
        table(spark, sf_dir, "customer")
        .select(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment").distinct()
        .join(nation, "n_nationkey"),
        _cat("net/configs/", F.lower("c_mktsegment"), "_", n, "_defconfig"),
        _cat("CONFIG_NATION_", n, "=y\n", "CONFIG_ABSENT=y\n"),
    )
    supplier = table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("n_nationkey"), "s_suppkey",
        _chunk("s_suppkey", SUPPLIERS_PER_HEADER).alias("chunk"),
    )
    groups = supplier.groupBy("n_nationkey", "chunk").agg(
        F.array_sort(F.collect_set("s_suppkey")).alias("_supps")
    ).join(nation, "n_nationkey")
    c = _s("chunk")
    code = out(
        groups, _cat(d, "/drv_", n, "_", c, ".c"),
        _cat(
            "#include <linux/of.h>\n",
            "#define VENDOR", n, "_", c, " 1\n",
            "#ifdef CONFIG_NATION_", n, "\n",
            F.array_join(
                F.transform(
                    "_supps", lambda k: _cat('\t{ .compatible = "vendor', n, ",supp", _s(k), '" },\n')
                ),
                "",
            ),
            "#endif\n",
        ),
    )
    dts = out(
        groups, _cat(d, "/board_", n, "_", c, ".dts"),
        _cat(
            '/include/ "common_', n, '.dtsi"\n',
            "node_", n, "_", c, ": node {\n",
            F.array_join(
                F.transform(
                    "_supps",
                    lambda k: _cat('\tcompatible = "vendor', n, ",supp", _s(k), '", "vendor', n, ',any";\n'),
                ),
                "",
            ),
            "\treg = <VENDOR", n, "_", c, ">;\n",
            "};\n",
        ),
    )
    bindings = out(
        supplier.join(nation, "n_nationkey"),
        _cat("Documentation/devicetree/bindings/n", n, "/supp", _s("s_suppkey"), ".txt"),
        _cat(
            "Compatible: vendor", n, ",supp", _s("s_suppkey"), " or vendor", n, ",none\n",
            "\n", "see vendor", n, ",supp", _s("s_suppkey"), "\n",
        ),
    )
    rows = kconfig
    for more in (makefile, sub, config_in, defconfig, code, dts, bindings):
        rows = rows.unionByName(more)
    return files_from_text(rows.withColumn("project", F.lit("config")))


def prose_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project ``prose``: documents under names of several families; a version
    per source."""
    doc = _s("doc_id")
    kind = F.col("doc_id") % 7
    name = (
        F.when(kind == 0, _cat("f", doc, ".c"))
        .when(kind == 1, _cat("f", doc, ".H"))
        .when(kind == 2, _cat("Kconfig-", doc))
        .when(kind == 3, _cat("f", doc, ".dts"))
        .when(kind == 4, _cat("Makefile.", doc))
        .when(kind == 5, _cat("Kconfig", doc, ".rst"))
        .otherwise(_cat("README", doc))
    )
    rows = table(spark, sf_dir, "documents").select(
        F.lit("prose").alias("project"), F.col("source").alias("version"),
        _cat(F.col("lang"), "/", name).alias("path"), F.col("text").alias("content"),
    )
    return files_from_text(rows)


#: Definition rules for prose: what follows a capitalised first word decides.
def prose_rules():
    from tagloom.operators.defs import DefRule

    return tuple(
        DefRule(family, rf"^([A-Z][A-Za-z0-9_]*){sign}", type_, prefix)
        for family, prefix in (("C", ""), ("D", ""), ("K", "CONFIG_"))
        for sign, type_ in ((",", "variable"), (r"\.", "macro"), (" ", "function"))
    )


def web_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project ``web``: pages under the path of their address, one version per
    host."""
    address = F.regexp_replace("url", r"[?#].*$", "")
    rows = table(spark, sf_dir, "pages").select(
        F.lit("web").alias("project"),
        F.regexp_extract(address, r"^[a-z]+://([^/]*)", 1).alias("version"),
        F.regexp_replace(
            F.regexp_replace(address, r"^[a-z]+://[^/]*/*", ""), r"/*$", ""
        ).alias("path"),
        F.col("html").alias("content"),
    )
    return files_from_text(rows)


def raw_tags(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """``(project, rev)``: a tag per order (of those in ``only(o_orderkey)``), in
    the naming habit of one of nine projects."""
    k = F.col("o_orderkey")
    year, month = F.year("o_orderdate"), F.month("o_orderdate")
    # Per project the shapes of tags for order status P, F and any other.
    shapes = {
        "plain": ("v<yy>.<m>.<n><rc>", "v<yy>.<m>.<n>", "v<yy>.<m>.<n>"),
        "dashed": ("<d>-<m>-<n>",) * 3,
        "shipped": ("<yy>.<m>+try", "<yy>.<m>.<k3>+ship", "<yy>.<m>.<k3>+ship"),
        "codename": ("fox-<yy>.<m>", "owl-<yy>.<m>.<n>", "fox-<yy>.<m>.<n>"),
        "calendar": ("v<m>.<n><rc>", "v<m>.<n>", "v<m>.<n>"),
        "labelled": ("draft/<yy>.<m>", "L_<y>_<m>", "v<yy>.<m>.<n>"),
        "backwards": ("v<y>.<mm>.<n>",) * 3,
        "archive": ("attic:<m>:<n>", "v<m>.<n>", "v<m>.<n>"),
        "early": ("early:<yy>.<m>", "<yy>.<m>.<n>", "<yy>.<m>"),
    }
    which = (k % len(shapes)).cast("int")
    status = F.when(F.col("o_orderstatus") == "P", 1).when(F.col("o_orderstatus") == "F", 2).otherwise(3)
    shape = F.when((which == 4) & (k % 2 == 0), "<y>w<mm>.<n>").otherwise(
        F.element_at(F.array(*[F.lit(s) for three in shapes.values() for s in three]), which * 3 + status)
    )
    holes = {
        "<yy>": _s(year % 100), "<y>": _s(year), "<d>": _s(year % 10),
        "<mm>": F.lpad(_s(month), 2, "0"), "<m>": _s(month),
        "<n>": _s(F.floor(k / len(shapes)) % 50), "<k3>": _s(k % 3),
        "<rc>": _cat("-rc", _s(k % 5 + 1)),
    }
    rev = shape
    for hole, value in holes.items():
        rev = F.replace(rev, F.lit(hole), value)
    project = F.element_at(F.array(*[F.lit(p) for p in shapes]), which + 1)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    if only is not None:
        orders = orders.join(only, "o_orderkey", "left_semi")
    return orders.select(project.alias("project"), rev.alias("rev")).distinct()
