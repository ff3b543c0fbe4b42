"""A batch data source that walks file systems: spark.read.format("file_walk").option("roots", "/a;/b")."""

from __future__ import annotations

import os
import stat
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path binary, kind string, size long, modified long, created long, error string"
PSEUDO = (b"/proc", b"/sys", b"/dev", b"/run")


def _kind(mode: int) -> str:
    return "folder" if stat.S_ISDIR(mode) else "link" if stat.S_ISLNK(mode) else "file" if stat.S_ISREG(mode) else "other"


def entry(path: bytes) -> tuple:
    """A path's row from lstat; a path that can't be read has only its error."""
    try:
        s = os.lstat(path)
    except OSError as e:
        return path, None, None, None, None, e.strerror
    born = getattr(s, "st_birthtime", None)
    return path, _kind(s.st_mode), s.st_size, int(s.st_mtime), None if born is None else int(born), None


@dataclass
class Subtree(InputPartition):
    """A path with all below it, with its direct entries, or alone."""

    path: bytes
    depth: int | None


def walk(path: bytes, depth: int | None):
    """Rows of a path and of what lies below it, in sorted order, links not followed."""
    row = entry(path)
    yield row
    if row[1] != "folder" or depth == 0:
        return
    try:
        names = sorted(os.listdir(path))
    except OSError as e:
        yield path, None, None, None, None, e.strerror
        return
    for name in names:
        below = os.path.join(path, name)
        if below not in PSEUDO:
            yield from walk(below, None if depth is None else depth - 1)


class _Walk(DataSourceReader):
    def __init__(self, options):
        self.paths = [os.fsencode(p.rstrip("/") or "/") for p in options.get("roots", "").split(";") if p]
        self.flat = options.get("recursive", "true") == "false"

    def partitions(self):
        """Each root alone, and each of its entries with all below it."""
        out: list[InputPartition] = []
        for root in self.paths:
            if self.flat:
                out.append(Subtree(root, 1))
                continue
            out.append(Subtree(root, 0))
            if os.path.isdir(root) and not os.path.islink(root):
                try:
                    out += [Subtree(os.path.join(root, n), None) for n in sorted(os.listdir(root)) if os.path.join(root, n) not in PSEUDO]
                except OSError:
                    out.append(Subtree(root, 1))
        return out

    def read(self, partition):
        if partition is not None:  # there is no root
            yield from walk(partition.path, partition.depth)


class FileWalk(DataSource):
    @classmethod
    def name(cls):
        return "file_walk"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Walk(self.options)


def scan(spark: SparkSession, roots: list[str], recursive: bool = True):
    """Rows of the entries under roots (targets work the same), and a table of what couldn't be read."""
    spark.dataSource.register(FileWalk)
    rows = spark.read.format("file_walk").option("roots", ";".join(roots)).option("recursive", str(recursive).lower()).load()
    return rows.where("error IS NULL").drop("error"), rows.where("error IS NOT NULL").select("path", "error")


def _read(batches):
    import pyarrow as pa

    for batch in batches:
        for path in batch["path"].to_pylist():
            try:
                with open(path, "rb") as f:
                    data = f.read()
            except OSError:
                continue
            yield pa.RecordBatch.from_pydict({"path": pa.array([path], pa.binary()), "content": pa.array([data], pa.binary())})


def contents(files, most: int = 16 << 20):
    """(path, content) of the files of a catalog that can be read and are no larger than `most`, as content: needs them."""
    return files.where((files.kind == "file") & (files["size"] <= most)).select("path").mapInArrow(_read, "path binary, content binary")


def _digests(size: int | None):
    def run(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            found = []
            for path in batch["path"].to_pylist():
                try:
                    with open(path, "rb") as f:
                        if size is not None:
                            found.append((path, hashlib.sha256(f.read(size)).hexdigest()))
                        else:
                            found.append((path, hashlib.file_digest(f, "sha256").hexdigest()))
                except OSError:
                    continue
            if found:
                yield pa.RecordBatch.from_pydict({"path": pa.array([p for p, _ in found], pa.binary()), "digest": pa.array([d for _, d in found])})

    return run


def digests(files, size: int | None = None):
    """(path, digest) of the first `size` bytes of files, or of whole files of any size, read as streams."""
    return files.where(files.kind == "file").select("path").mapInArrow(_digests(size), "path binary, digest string")


class Contents:
    """What content: and dupe:content read of files that executors can open: only of the rows that are left."""

    def contents(self, rows, most: int):
        return contents(rows, most)

    def digests(self, rows, size: int | None):
        return digests(rows, size)
