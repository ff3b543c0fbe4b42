"""Exports of searches, the change history, and catalog generations."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import text as T

from .staging import Folder


def csv_lines(rows: DataFrame) -> Column:
    """Name,Path,Size,Modified,Created,Type with fields quoted only where needed."""

    def field(x: Column) -> Column:
        x = F.coalesce(x, F.lit(""))
        return F.when(x.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)

    size = F.when(F.col("kind").isin("file", "folder"), F.col("size").cast("string")).otherwise("")
    return F.concat_ws(",", field(F.col("name_text")), field(F.col("path_text")), size, T.local_time(F.col("modified")), F.coalesce(T.local_time(F.col("created")), F.lit("")), field(T.type_label(F.col("kind"), F.col("ext"))))


def json_lines(rows: DataFrame) -> Column:
    return F.to_json(F.struct(F.col("path_text").alias("path"), "kind", "size", "modified", "created", "items"))


def write_lines(lines: DataFrame, path: str, header: str | None = None) -> None:
    """Lines (one string column, in order) as text; the header is a file of its own, the first in name order."""
    lines.write.mode("overwrite").text(path)
    if header:
        lines.sparkSession.createDataFrame([(header,)], "value string").coalesce(1).write.mode("overwrite").text(path.rstrip("/") + ".header")


def write_paths(rows: DataFrame, path: str, separator: str = "\n") -> None:
    """Raw path bytes, a separator after each, as files of a folder; a retried task leaves nothing twice."""
    rows.select(F.col("path").cast("string")).write.mode("overwrite").option("lineSep", separator).text(path)


RAW = "path binary, kind string, size long, modified long, created long"
HISTORY = "t long, a string, k string, p string, to string, s long"
#: The folders below which a catalog is kept in buckets, by their depth; the buckets; the history's parts before they are made one.
DEPTH, BUCKETS, PARTS = 3, 64, 50
FORMAT = 2


class DamagedError(Exception):
    """A generation that the pointer names lacks files, or has cut ones."""


def bucket_of(raw: Column, depth: int = DEPTH, buckets: int = BUCKETS) -> Column:
    """The bucket of a path in byte form: entries of one folder at `depth` share it, shorter paths have their own."""
    head = F.substring_index(raw, "/", depth + 1)
    return F.pmod(F.xxhash64(head), F.lit(buckets)).cast("int")


def buckets_of(targets: DataFrame, depth: int = DEPTH, buckets: int = BUCKETS) -> list[int] | None:
    """Buckets that the targets (column raw) and all below them can be in; None for all (a target is above `depth`)."""
    parts = F.size(F.split(F.col("raw"), "/")) - 1
    found = targets.select(F.when(parts >= depth, bucket_of(F.col("raw"), depth, buckets)).alias("b")).distinct().collect()
    return None if any(r.b is None for r in found) else sorted(r.b for r in found)


class Generations:
    """Catalog generations in a folder, in buckets of which an update rewrites those it touches.

    An update writes its buckets and its part of the history first, and then one pointer file, put in place by a
    single rename; the pointer with the highest number counts. Whatever a crash leaves behind is named by no
    pointer, and is overwritten by the next update. Pointers say the files of each part and their lengths.
    """

    def __init__(self, spark: SparkSession, root: str, depth: int = DEPTH, buckets: int = BUCKETS):
        self.spark, self.root, self.depth, self.buckets = spark, root.rstrip("/"), depth, buckets
        self.folder = Folder(spark, root)

    def _pointers(self) -> list[int]:
        return sorted(int(m[1]) for n in self.folder.files() if (m := re.fullmatch(r"pointer-([0-9]+)[.]json", n)))

    def meta(self) -> dict:
        """What the newest pointer says; generation 0 before the first, and for one in another format."""
        numbers = self._pointers()
        if not numbers:
            return {"generation": 0, "parts": {}, "history": []}
        try:
            found = json.loads(self.folder.read(f"pointer-{numbers[-1]}.json"))
        except ValueError as e:
            raise DamagedError(f"pointer {numbers[-1]} can't be read") from e
        return found if found.get("format") == FORMAT else {"generation": 0, "parts": {}, "history": []}

    def _written(self, name: str) -> dict[str, int]:
        return {k: v for k, v in self.folder.files(name).items() if k[0] not in "._"}

    def check(self) -> None:
        """Raise DamagedError unless all files that the pointer names are there in full; only lists folders."""
        for part, files in [*(self.meta()["parts"].values()), *self.meta()["history"]]:
            if self._written(part) != files:
                raise DamagedError(f"{part} has lost files")

    def load(self, schema: str = RAW, only: list[int] | None = None) -> DataFrame:
        """The current generation, or some buckets of it; empty before the first."""
        parts = self.meta()["parts"]
        paths = sorted({f"{self.root}/{part}" for b, (part, _) in parts.items() if only is None or int(b) in only})
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def publish(self, rows: DataFrame, only: list[int] | None = None, changes: DataFrame | None = None, time: int = 0, **meta) -> int:
        """Make rows the next generation (or, of some buckets, their new content) with their history."""
        old = self.meta()
        n = old["generation"] + 1
        data, past = f"data/generation={n}", f"history/generation={n}"
        keyed = rows.withColumn("bucket", bucket_of(T.bytes_of(F.col("path")), self.depth, self.buckets))
        keyed.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{data}")
        new = {k: v for k, v in old["parts"].items() if only is not None and int(k) not in only}
        for name in self.folder.files(data):
            if name.startswith("bucket="):
                new[name[7:]] = [f"{data}/{name}", self._written(f"{data}/{name}")]
        history = old["history"]
        if changes is not None:
            history_rows(changes, time).write.mode("overwrite").json(f"{self.root}/{past}")
            history = [*history, [past, self._written(past)]]
        self._point(meta | {"generation": n, "parts": new, "history": history})
        if len(history) > PARTS:
            self.compact_history(time)
        return self.meta()["generation"]

    def _point(self, meta: dict) -> None:
        if not self.folder.create(f"pointer-{meta['generation']}.json", json.dumps(meta | {"format": FORMAT}).encode()):
            raise RuntimeError(f"Generation {meta['generation']} was published by someone else")

    def history(self) -> DataFrame:
        """All changes of the generations up to the current one."""
        paths = [f"{self.root}/{part}" for part, files in self.meta()["history"] if files]
        return read_history(self.spark, *paths) if paths else self.spark.createDataFrame([], HISTORY)

    def compact_history(self, now: int, days: int = 30, most: int = 100_000) -> None:
        """Make the history one part without what is too old or too much; the catalog stays."""
        meta = self.meta()
        n = meta["generation"] + 1
        part = f"history/generation={n}"
        kept = self.history().where(F.col("t") >= now - days * 86_400).orderBy(F.desc("t"), "p").limit(most)
        kept.write.mode("overwrite").json(f"{self.root}/{part}")
        self._point(meta | {"generation": n, "history": [[part, self._written(part)]]})

    def quarantine(self) -> None:
        """Set a damaged store's pointers aside, so that the next update starts anew; its data stay for a look."""
        for n in self._pointers():
            self.folder.move(f"pointer-{n}.json", f"damaged-{n}.json")

    def vacuum(self, keep: int = 2) -> None:
        """Remove pointers but the newest, and parts that none of those kept names."""
        numbers = self._pointers()
        named: set[str] = set()
        for n in numbers[-keep:]:
            found = json.loads(self.folder.read(f"pointer-{n}.json"))
            named |= {p for p, _ in [*found["parts"].values(), *found["history"]]}
        for n in numbers[:-keep]:
            self.folder.remove(f"pointer-{n}.json")
        for top in ("data", "history"):
            for name in self.folder.files(top):
                if not any(p == f"{top}/{name}" or p.startswith(f"{top}/{name}/") for p in named):
                    self.folder.remove(f"{top}/{name}")


def history_rows(changes: DataFrame, time: int) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    return changes.select(F.lit(time).cast("long").alias("t"), F.col("action").alias("a"), F.col("kind").alias("k"), text("path").alias("p"), text("to").alias("to"), F.col("size").alias("s"))


def read_history(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.schema(HISTORY).json([*paths], mode="DROPMALFORMED").where("t IS NOT NULL")
