"""Live maintenance: a stream of changed paths reconciles the catalog, a micro-batch a generation.

A batch reads and rewrites only the buckets of the catalog that its paths can be in.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import text as T
from shelfmark.operators import rules as X
from shelfmark.operators.catalog import one_per_path, rolled_up
from shelfmark.operators.changes import MOST, covered, diff, outermost
from shelfmark.sources.sinks import RAW, DamagedError, Generations, buckets_of
from shelfmark.sources.staging import staged

MOST_TARGETS = 50_000


def targets_of(events: DataFrame) -> DataFrame:
    """Outermost changed paths (byte form, column raw) of events (path binary)."""
    return outermost(events.select(T.bytes_of(F.col("path")).alias("raw")))


def accepted(events: DataFrame, roots: list[str], flat_roots: tuple[str, ...] = (), rules: X.Rules | None = None) -> DataFrame:
    """Events below a watched root whose folders the rules enter; below a root that isn't recursive, only its direct entries."""
    raw = T.bytes_of(F.col("path"))
    test = F.lit(False)
    for r in roots:
        near = F.coalesce(T.parent_of(raw) == r, F.lit(False)) | (raw == r) if r in flat_roots else T.within(raw, r)
        test = test | near
    if rules is not None:
        test = test & X.entered(raw, rules)
    return events.where(test)


def ruled(rows: DataFrame, rules: X.Rules | None) -> DataFrame:
    """Raw catalog rows (path binary) that the rules list."""
    if rules is None:
        return rows
    return X.kept(rows.withColumn("_bytes", F.col("path")).withColumn("path", F.col("path").cast("string")), rules).withColumn("path", F.col("_bytes")).drop("_bytes")


def offline(roots: list[str]) -> list[str]:
    """Roots that can't be read or are empty, as unmounted drives are (seen from the driver)."""

    def gone(root: str) -> bool:
        try:
            with os.scandir(root) as entries:
                return next(entries, None) is None
        except OSError:
            return True

    return [r for r in roots if gone(r)]


def reconciled(previous: DataFrame, targets: DataFrame, scan: Callable[[DataFrame], DataFrame], away: list[str] | tuple[str, ...] = (), rules: X.Rules | None = None) -> DataFrame:
    """Raw rows with all in the targets replaced by a fresh scan of them; what has vanished is gone, but not from roots that are away."""
    inside = F.lit(False)
    for r in away:
        inside = inside | T.within(T.bytes_of(F.col("path")), r)
    kept = covered(previous, targets, "left_anti")
    if away:
        kept = kept.unionByName(covered(previous, targets).where(inside))
    return one_per_path(kept.unionByName(ruled(scan(targets), rules).where(~inside)))


def changed_folders(previous: DataFrame, stats: DataFrame, saved_at: int) -> DataFrame:
    """Folders (raw) to read again at start-up: new ones, and those modified since or within two seconds before the save."""
    old = previous.where("kind = 'folder'").select("path", F.col("modified").alias("_was"))
    now = stats.where("kind = 'folder'").join(old, "path", "left")
    again = F.col("_was").isNull() | (F.col("_was") != F.col("modified")) | (F.col("modified") >= saved_at - 2)
    return now.where(again).select(T.bytes_of(F.col("path")).alias("raw"))


def caught_up(previous: DataFrame, stats: DataFrame, saved_at: int, listing: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The quick start-up scan: raw rows after reading only the changed folders' direct entries again.

    stats: rows of all folders there are now. listing: rows of the direct entries of folders (raw). Folders that are
    gone take all below them along; files edited in place in unchanged folders are missed until a full scan.
    """
    again = changed_folders(previous, stats, saved_at)
    entries = listing(again)
    at = F.coalesce(T.parent_of(T.bytes_of(F.col("path"))), F.lit(""))
    files = previous.where("kind <> 'folder'").withColumn("raw", at)
    same = files.join(again, "raw", "left_anti").join(stats.where("kind = 'folder'").select(T.bytes_of(F.col("path")).alias("raw")), "raw", "left_semi").select(*previous.columns)
    return one_per_path(same.unionByName(entries.where("kind <> 'folder'")).unionByName(stats.where("kind = 'folder'")))


@dataclass
class Live:
    """A catalog that is kept up to date: its store, what to watch, and how to scan targets (column raw)."""

    store: Generations
    scan: Callable[[DataFrame], DataFrame]
    roots: list[str]
    flat_roots: tuple[str, ...] = ()
    rules: X.Rules | None = None
    keep_offline: tuple[str, ...] = ()
    clock: Callable[[], float] = time.time
    query: object | None = field(default=None, repr=False)

    @property
    def spark(self) -> SparkSession:
        return self.store.spark

    def update(self, targets: DataFrame | None = None, **meta) -> int:
        """Read the targets anew (None: the roots, whole) and publish a generation; changes are history once there is one before.

        A damaged store is set aside and scanned anew; a full scan under other rules or roots leaves no history.
        """
        watched = repr((sorted(self.roots), sorted(self.flat_roots), self.rules))
        try:
            self.store.check()
        except DamagedError:
            self.store.quarantine()
            targets = None
        before = self.store.meta()
        whole = targets is None or not before["generation"]
        if whole:
            targets = self.spark.createDataFrame([(r,) for r in self.roots], "raw string")
        only = None if whole else buckets_of(targets, self.store.depth, self.store.buckets)
        previous = self.store.load(RAW, only)
        rows = reconciled(previous, targets, self.scan, offline([*self.keep_offline]), self.rules)
        changes = None
        if before["generation"] and before.get("watched") == watched and not previous.isEmpty():
            rows = staged(rows, "reconciled")
            changes = diff(rolled_up(previous).drop("items"), rolled_up(rows).drop("items"), targets, MOST)
        now = int(self.clock())
        return self.store.publish(rows, only, changes, now, watched=watched, scanned_at=now if whole else before.get("scanned_at", now), saved_at=now, **({"batch": before["batch"]} if "batch" in before else {}) | meta)

    def apply(self, batch: DataFrame, number: int) -> None:
        """One micro-batch of events (path binary, overflow boolean); one that runs again after a restart is skipped by its number."""
        if self.store.meta().get("batch", -1) >= number:
            return
        wanted = accepted(batch, self.roots, self.flat_roots, self.rules).persist()
        try:
            lost = batch.agg(F.coalesce(F.bool_or("overflow"), F.lit(False))).first()[0]
            count = wanted.agg(F.count_distinct("path")).first()[0]
            if lost or count > MOST_TARGETS:
                self.update(None, batch=number)
            elif count:
                self.update(targets_of(wanted), batch=number)
        finally:
            wanted.unpersist()

    def start(self, events: DataFrame, checkpoint: str, trigger: dict | None = None):
        """Start the maintenance query; events wait at least the trigger's interval, and as long as an update takes."""
        self.query = events.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "200 milliseconds"})).start()
        return self.query

    def pause(self) -> None:
        """Apply what has arrived, then stop; searches go on with the last generation."""
        if self.query is not None:
            self.query.processAllAvailable()
            self.query.stop()
            self.query = None

    def resume(self, events: DataFrame, checkpoint: str, trigger: dict | None = None):
        """Scan the roots in full, for events may have been missed, and go on from the checkpoint."""
        self.update(None)
        return self.start(events, checkpoint, trigger)

    def rescan(self, root: str | None = None) -> int:
        """Read a root, or all, again."""
        if root is not None and root not in self.roots:
            raise ValueError(f"{root} is not a root")
        return self.update(None if root is None else self.spark.createDataFrame([(root,)], "raw string"))

    def wait(self, after: int, timeout: float = 55.0, step: float = 0.2) -> int:
        """The current generation, as soon as it is later than `after`, or when the time is over."""
        until = time.monotonic() + timeout
        while (n := self.store.meta()["generation"]) <= after and time.monotonic() < until:
            time.sleep(step)
        return n

    def status(self, errors: DataFrame | None = None) -> dict:
        return status(self.store, errors) | {"roots": self.roots, "offline": offline([*self.keep_offline]), "paused": self.query is None}


def reconcile_stream(events: DataFrame, store: Generations, scan: Callable[[DataFrame], DataFrame], checkpoint: str, *, roots: list[str], flat_roots: tuple[str, ...] = (), rules: X.Rules | None = None, keep_offline: tuple[str, ...] = (), trigger: dict | None = None):
    """Start the maintenance query of a new Live."""
    return Live(store, scan, roots, flat_roots, rules, keep_offline).start(events, checkpoint, trigger)


def status(store: Generations, errors: DataFrame | None = None) -> dict:
    """Entries, generation, scan time, and of what couldn't be read (path, error) the number and the first 50 messages."""
    meta = store.meta()
    out = {k: meta.get(k) for k in ("generation", "scanned_at", "saved_at")} | {"entries": store.load(RAW).count(), "error_count": 0, "errors": []}
    if errors is not None:
        out["error_count"] = errors.count()
        out["errors"] = [f"{r.path.decode(errors='replace')}: {r.error}" for r in errors.orderBy("path").limit(50).collect()]
    return out
