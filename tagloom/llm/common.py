"""Helpers shared by the operators: inputs, stored intermediate tables, fixed-size
maps and connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tagloom.session import work_dir

#: Edges that one task holds before it writes out the forest it has found.
FOREST_EDGES = 1_000_000


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, for Python code that runs in tasks (once per application)."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        _SHIPPED.add(app)
        package = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp(prefix="package-")  # on the driver; Spark serves the file to executors
        archive = Path(folder, f"{package.name}.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for file in sorted(package.rglob("*.py")):
                z.write(file, file.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(archive))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names."""
    return f"{work_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """The rows of ``df``, written to the shared folder once: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_key(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that shuffles and merges.

    Stored tables of ids are a few MB as files, many times that as a table to look up in, and grow with the input: the planner,
    who judges by the files, would send each of them through the driver.
    """
    return df.hint("merge")


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of each text of an Arrow column; null is empty."""
    binary = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(binary).to_pylist()]


def give_back() -> None:
    """Returns memory that Arrow and the C library keep after large batches: workers live on for other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _parts(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` bytes, so that what a task makes of one stays small."""
    for batch in batches:
        step = max(1, batch.num_rows * most // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def add_columns(
    df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, pa.Array]], inputs: list[str], added: str, keep: list[str] | None = None
) -> DataFrame:
    """``df`` with the Arrow columns ``added`` (a DDL string) that ``fn`` makes of a batch of ``inputs``.

    ``keep`` names the columns to carry along (all by default). Inputs come to ``fn`` by position,
    so that columns of any name may stand beside them; one with the name of an added column (upper and lower case alike) gives way to it.
    """
    kept = df.columns if keep is None else keep
    packed = df.select(
        F.struct(*[F.col(f"`{c}`") for c in kept] or [F.lit(True)]).alias("kept"),
        *[F.col(f"`{c}`").alias(f"in{i}") for i, c in enumerate(inputs)],
    )
    extra = StructType.fromDDL(added)
    names = extra.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            made = fn(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[made[n] for n in names]], names=["kept", *names])
        give_back()

    out = packed.mapInArrow(run, StructType([packed.schema["kept"], *extra.fields]))
    added_names = {n.lower() for n in names}
    return out.select(*[F.col(f"kept.`{c}`").alias(c) for c in kept if c.lower() not in added_names], *[F.col(f"`{n}`") for n in names])


def byte_map(rows: DataFrame, cells: int, chunk: int = 4096) -> np.ndarray:
    """``uint8[cells]`` with the largest ``level`` of each ``cell``; the size is fixed by ``cells``
    alone. ``rows``: (cell long, level int). What reaches the driver is ``cells`` bytes at most."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, places, levels = (batch.column(i).to_pylist() for i in range(3))
            made = []
            for p, v in zip(places, levels):
                block = np.zeros(chunk, np.uint8)
                block[np.asarray(p, np.int64)] = np.minimum(np.asarray(v, np.int64), 255)
                made.append(block.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(made, pa.binary())], names=["at", "block"])

    packed = (
        rows.groupBy("cell").agg(F.max("level").alias("level"))
        .groupBy(F.expr(f"cell DIV {chunk}").alias("at"))
        .agg(F.collect_list(F.struct(F.expr(f"cell % {chunk}").alias("p"), "level")).alias("c"))
        .select("at", "c.p", "c.level")
        .mapInArrow(pack, "at long, block binary")
    )
    out = np.zeros(cells, np.uint8)
    for r in packed.collect():  # ``cells`` bytes together
        out[r["at"] * chunk : (r["at"] + 1) * chunk] = np.frombuffer(bytes(r["block"]), np.uint8)
    return out


class Forest:
    """Union-find over whole numbers; the smallest member is the root."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.parent[b] = a
        self.parent.setdefault(a, a)
        return True


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()

    def stars() -> pa.RecordBatch:
        rows = [(x, forest.find(x)) for x in list(forest.parent)]
        u, v = zip(*rows) if rows else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if a != b:
                forest.union(a, b)
        if len(forest.parent) > FOREST_EDGES:
            yield stars()
            forest = Forest()
    if forest.parent:
        yield stars()


def components(edges: DataFrame, tag: str) -> DataFrame:
    """(node, component) of every node of ``edges`` (two long columns), component its smallest reachable node.

    By contraction: each task reduces its edges to a forest, whose trees have their smallest node as root, and
    gives each of its nodes with its root. A node that several tasks have seen ties their roots together; these ties are the edges of the next, smaller
    graph. When none are left, labels are handed back level by level. Every level is one stored table. A
    node's group holds a row per task at most, and a hub with very many links is only ever joined.
    """
    a, b = edges.columns
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    levels: list[DataFrame] = []
    while True:
        roots = e.mapInArrow(_forests, "u long, v long").groupBy("u").agg(F.min("v").alias("m"), F.collect_set("v").alias("vs"))
        level = stored(roots.select("u", "m", F.filter("vs", lambda v: v != F.col("m")).alias("others")), tag)
        levels.append(level)
        ties = level.where("size(others) > 0")
        if ties.isEmpty():
            break
        e = ties.select(F.explode("others").alias("u"), F.col("m").alias("v"))
    known = levels[-1].select(F.col("u").alias("node"), F.col("m").alias("component"))
    for level in reversed(levels[:-1]):
        up = known.withColumnRenamed("node", "m")
        known = level.select("u", "m").join(by_key(up), "m", "left").select(F.col("u").alias("node"), F.coalesce("component", "m").alias("component"))
    return known
