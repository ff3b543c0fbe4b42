"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and \x09-\x0D, which is what bytes.split() takes as separators.
SPACES = "\\x20\\x09-\\x0D"
_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _own_dir:
        _own_dir["dir"] = tempfile.mkdtemp(prefix="shelfmark-")
    return "file://" + _own_dir["dir"]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as Parquet into the shared folder and read it again.

    The files outlive lost executors; the folder belongs to the session's owner, who removes it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/shelfmark-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def column(name: str) -> Column:
    """A column by its name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame, made: tuple[str, ...] = (), name: str = "_row") -> Column:
    """All columns but those that an operator makes itself, as one struct, so that no name can clash with its own."""
    return F.struct(*[column(c) for c in docs.columns if c not in made] or [F.lit(None).alias("_none")]).alias(name)


def unpacked(docs: DataFrame, made: tuple[str, ...] = (), name: str = "_row") -> list[Column]:
    """The columns of packed() again, in order."""
    return [F.col(name)[c].alias(c) for c in docs.columns if c not in made]


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = "_k") -> DataFrame:
    """docs with a unique long column `key`, ascending in (id, text); ids stay as they are.

    Where ids are whole numbers, unique and never null, the key is the id itself. Otherwise rows are sorted by
    (id with nulls last, text) and numbered, and the numbered table is materialised so that a
    recomputed partition cannot renumber it. Only the id column is read to decide.
    """
    if dict(docs.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint"):
        odd = docs.groupBy(column(id_col).alias("i")).count().where("count > 1 OR i IS NULL")
        if odd.isEmpty():
            return docs.withColumn(key, column(id_col).cast("long"))
    ordered = docs.orderBy(column(id_col).asc_nulls_last(), column(text_col).asc_nulls_first())
    return materialize(ordered.withColumn(key, F.monotonically_increasing_id()), "keyed")


_held: dict = {}


def held(key, make: Callable):
    """What a Python worker keeps from task to task; it holds one thing at a time."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def _trim() -> None:
    """Give memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, key=None) -> DataFrame:
    """df.mapInArrow(run, schema) whose workers, which Spark uses again, don't keep the memory of a task; key: what run holds."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _held and key not in _held:  # another operator's
            _held.clear()
            _trim()
        try:
            yield from run(batches)
        finally:
            _trim()

    return df.mapInArrow(whole, schema)


def words_of(text) -> F.Column:
    """Native array of the words [^\\x20\\x09-\\x0D]+ of a text column; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACES}]+"), lambda w: w != "")


def n_words_of(text) -> F.Column:
    return F.size(words_of(text)).cast("long")


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals as maximal runs; touching intervals join."""
    if not len(start):
        return start, end
    o = np.argsort(start, kind="stable")
    start, reach = start[o], np.maximum.accumulate(end[o])
    first = np.concatenate(([True], start[1:] > reach[:-1]))
    return start[first], reach[np.concatenate((np.flatnonzero(first)[1:] - 1, [len(start) - 1]))]
