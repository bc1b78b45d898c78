"""Exported trees on a mounted file system as a Spark data source, with the modes and links that ``binaryFile`` can't see.

A partition is a top-level directory of a version, or the files beside them: the driver lists three levels by name, tasks walk
the rest and read content there, in batches of bounded size. ``path`` is needed, ``content`` (default true) may be false for
a listing alone.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql import types as T

FORMAT = "source_tree"
BATCH_BYTES, BATCH_ROWS = 8 << 20, 4_096
# Modes as version control writes them.
PLAIN, EXECUTABLE, LINK = "100644", "100755", "120000"

SCHEMA = "project string, version string, path string, kind string, perm string, size long, raw binary"
_ARROW = pa.schema([("project", pa.string()), ("version", pa.string()), ("path", pa.string()), ("kind", pa.string()),
                    ("perm", pa.string()), ("size", pa.int64()), ("raw", pa.binary())])


class Subtree(InputPartition):
    """Directory ``top`` of a version, or (None) its files that lie in none."""

    def __init__(self, project: str, version: str, top: str | None):
        super().__init__((project, version, top))
        self.project, self.version, self.top = project, version, top


def _text(name: str) -> str:
    return os.fsencode(name).decode("utf-8", "replace")


def _directories(path: str) -> list[str]:
    with os.scandir(path) as found:
        return sorted(e.name for e in found if e.is_dir())


class TreeReader(DataSourceReader):
    def __init__(self, root: str, content: bool):
        self.root, self.content = root, content

    def partitions(self) -> list[Subtree]:
        out = []
        for project in _directories(self.root):
            for version in _directories(f"{self.root}/{project}"):
                with os.scandir(f"{self.root}/{project}/{version}") as found:
                    tops = sorted(e.name for e in found if e.is_dir(follow_symlinks=False))
                out += [Subtree(project, version, top) for top in (None, *tops)]
        # Spark asks for one partition at least.
        return out or [Subtree("", "", None)]

    def _entries(self, base: str, top: str | None) -> Iterator[tuple[str, os.stat_result]]:
        """(path below ``base``, status) of files and links; links are not followed, pipes, sockets and devices left out."""
        todo = [top or ""]
        while todo:
            at = todo.pop()
            with os.scandir(f"{base}/{at}" if at else base) as found:
                for entry in found:
                    path = f"{at}/{entry.name}" if at else entry.name
                    if entry.is_dir(follow_symlinks=False):
                        if top is not None:
                            todo.append(path)
                        continue
                    status = entry.stat(follow_symlinks=False)
                    if stat.S_ISREG(status.st_mode) or stat.S_ISLNK(status.st_mode):
                        yield path, status

    def read(self, partition: Subtree) -> Iterator[pa.RecordBatch]:
        if not partition.project:
            return
        base = f"{self.root}/{partition.project}/{partition.version}"
        project, version = _text(partition.project), _text(partition.version)
        rows, held = [], 0
        for path, status in self._entries(base, partition.top):
            link = stat.S_ISLNK(status.st_mode)
            perm = LINK if link else EXECUTABLE if status.st_mode & stat.S_IXUSR else PLAIN
            raw = os.fsencode(os.readlink(f"{base}/{path}")) if link else None
            if not link and self.content:
                with open(f"{base}/{path}", "rb") as file:
                    raw = file.read()
            size = status.st_size if raw is None else len(raw)
            rows.append((project, version, _text(path), "blob", perm, size, raw if self.content else None))
            held += size if self.content else 0
            if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> TreeReader:
        return TreeReader(self.options["path"].rstrip("/") or "/", self.options.get("content", "true").lower() == "true")
