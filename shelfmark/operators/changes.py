"""Differences of two catalog generations, moves among them, and the change history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import text as T
from shelfmark.sources.staging import staged

MOST = 20_000


def outermost(targets: DataFrame) -> DataFrame:
    """Paths (byte form, column raw) that no other one covers.

    A path is covered if an ancestor of it is listed: paths are exploded into their ancestors, which are joined by equality.
    """
    from .catalog import _ancestors

    targets = targets.select("raw").distinct()
    up = targets.withColumn("_dir", T.parent_of(F.col("raw"))).where("_dir IS NOT NULL").select("raw", F.explode(_ancestors(F.col("_dir"))).alias("_up"))
    return targets.join(up.join(targets.select(F.col("raw").alias("_up")), "_up", "left_semi").select("raw"), "raw", "left_anti")


def covered(rows: DataFrame, targets: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows (column path) that lie in (left_semi) or outside (left_anti) the targets (column raw)."""
    from .catalog import _ancestors

    raw = T.bytes_of(F.col("path"))
    chain = F.concat(F.coalesce(_ancestors(T.parent_of(raw)), F.array().cast("array<string>")), F.array(raw))
    hit = rows.select("path", F.explode(chain).alias("raw")).join(targets.select("raw"), "raw", "left_semi").select("path").distinct()
    return rows.join(hit, "path", how).select(*rows.columns)


def differences(old: DataFrame, new: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(action, kind, path, size, modified, created): created, deleted, and modified files; a changed kind is both of the first."""
    if targets is not None:
        targets = outermost(targets)
        old, new = covered(old, targets), covered(new, targets)
    side = lambda df, p: df.select("path", F.struct("kind", "size", "modified", "created").alias(p))
    both = side(old, "o").join(side(new, "n"), "path", "full")
    row = lambda action, s: F.struct(F.lit(action).alias("action"), *[F.col(f"{s}.{c}").alias(c) for c in ("kind", "size", "modified", "created")])
    gone, made = F.col("n").isNull(), F.col("o").isNull()
    other = F.col("o.kind") != F.col("n.kind")
    edited = (F.col("n.kind") == "file") & ((F.col("o.size") != F.col("n.size")) | (F.col("o.modified") != F.col("n.modified")))
    events = F.when(gone, F.array(row("deleted", "o"))).when(made, F.array(row("created", "n"))).when(other, F.array(row("deleted", "o"), row("created", "n"))).when(edited, F.array(row("modified", "n")))
    return both.select("path", F.explode(events).alias("e")).select("e.action", "e.kind", "path", "e.size", "e.modified", "e.created")


_KEYS = ["kind", "size", "modified", "_c"]


def _paired(gone: DataFrame, made: DataFrame, by: str) -> DataFrame:
    """One-to-one pairs of equal entries: each deletion in path order takes the first creation left that isn't inside it.

    Where no creation of a key lies inside a deletion of it, that is the k-th with the k-th. Keys of folders
    that were moved into one another are matched one deletion after the other.
    """
    from .catalog import _ancestors

    keys = [*_KEYS, by]
    w = Window.partitionBy(*keys).orderBy("path_key")
    b = made.select(*keys, "path_key", F.col("path").alias("to"), F.col("raw").alias("to_raw"))
    up = b.where("kind = 'folder'").select(*keys, F.explode(F.concat(_ancestors(T.parent_of(F.col("to_raw"))), F.array("to_raw"))).alias("raw"))
    odd = staged(up.join(gone.select(*keys, "raw"), [*keys, "raw"], "left_semi").select(*keys).distinct(), "odd-keys")
    shape = gone.select("*", F.col("path").alias("to"), F.col("raw").alias("to_raw"))
    columns = shape.columns
    ranked = lambda x: x.join(odd, keys, "left_anti").withColumn("_n", F.row_number().over(w))
    usual = ranked(gone).join(ranked(b).drop("path_key"), [*keys, "_n"]).select(*columns)

    if odd.isEmpty():
        return usual

    def match(group):
        import pandas as pd

        group = group.sort_values("path_key")
        free, rows = group[group["_made"]].to_dict("records"), []
        for row in group[~group["_made"]].to_dict("records"):
            at = next((i for i, x in enumerate(free) if not (x["raw"] + "/").startswith(row["raw"].rstrip("/") + "/")), None)
            if at is not None:
                new = free.pop(at)
                rows.append(row | {"to": new["path"], "to_raw": new["raw"]})
        return pd.DataFrame(rows, columns=columns)

    both = gone.withColumn("_made", F.lit(False)).unionByName(made.withColumn("_made", F.lit(True)))
    return usual.unionByName(both.join(odd, keys, "left_semi").groupBy(*keys).applyInPandas(match, shape.schema))


def paired(changes: DataFrame) -> DataFrame:
    """Changes with deletions and creations of one entry as moves (column `to`), and without those inside moved folders.

    Pairs have equal kind, size and times, and the same name (first) or the same folder; no target lies inside its source.
    """
    raw = T.bytes_of(F.col("path"))
    c = changes.withColumn("raw", raw).withColumn("_name", T.name_of(raw)).withColumn("_dir", F.coalesce(T.parent_of(raw), F.lit(""))).withColumn("path_key", T.path_key(F.col("path"))).withColumn("_c", F.coalesce("created", F.lit(-(2**63))))
    c = staged(c, "changes")
    gone, made = c.where("action = 'deleted'"), c.where("action = 'created'")
    first = staged(_paired(gone, made, "_name"), "moves")
    gone = gone.join(first.select("path"), "path", "left_anti").select(*c.columns)
    made_left = made.join(first.select(F.col("to").alias("path")), "path", "left_anti").select(*c.columns)
    moves = staged(first.unionByName(_paired(gone, made_left, "_dir")), "moves")
    rest = c.where("action = 'modified'").unionByName(gone.join(moves.select("path"), "path", "left_anti").select(*c.columns)).unionByName(made_left.join(moves.select(F.col("to").alias("path")), "path", "left_anti").select(*c.columns))
    everything = moves.withColumn("action", F.lit("moved")).unionByName(rest.withColumn("to", F.lit(None).cast("binary")).withColumn("to_raw", F.lit(None).cast("string")))
    folders = moves.where("kind = 'folder'").select(F.col("raw").alias("_from"), F.col("to_raw").alias("_to"))
    from .catalog import _ancestors

    inside = everything.select("path", "action", F.explode(_ancestors(F.col("_dir"))).alias("_up")).where("_up <> ''")
    old = inside.where("action IN ('deleted', 'moved')").join(folders.select(F.col("_from").alias("_up")), "_up", "left_semi")
    new = inside.where("action = 'created'").join(folders.select(F.col("_to").alias("_up")), "_up", "left_semi")
    hidden = old.select("path", "action").unionByName(new.select("path", "action")).distinct()
    return everything.join(hidden, ["path", "action"], "left_anti").select("action", "kind", "path", "to", "size", "path_key")


def diff(old: DataFrame, new: DataFrame, targets: DataFrame | None = None, most: int = MOST) -> DataFrame:
    """The changes of one update in path order, at most `most` (the history's own limit)."""
    return paired(differences(old, new, targets)).orderBy("path_key").limit(most).drop("path_key")


def label(action: Column, path: Column, to: Column) -> Column:
    """What the history shows: Renamed for a move within a folder."""
    same = T.parent_of(T.bytes_of(path)).eqNullSafe(T.parent_of(T.bytes_of(to)))
    return F.when((action == "moved") & same, "Renamed").otherwise(F.initcap(action))


def recent(history: DataFrame, since: int, limit: int = 100, text: str = "") -> DataFrame:
    """History rows (t epoch seconds, a, k, p, to, s) newer than `since`, newest first, with a text in either path."""
    rows = history.where(F.col("t") >= since)
    if text:
        rows = rows.where(F.lower("p").contains(text.lower()) | F.coalesce(F.lower("to").contains(text.lower()), F.lit(False)))
    return rows.orderBy(F.desc("t"), "p").limit(limit)


def since_seconds(text: str) -> int:
    """30, 30m, 12h, 1d or 2w as seconds; a bare number is minutes."""
    units = {"m": 60, "h": 3600, "d": 86_400, "w": 604_800}
    n, unit = (text[:-1], text[-1]) if text and text[-1] in units else (text, "m")
    return int(n) * units[unit]


def trimmed(history: DataFrame, now: int, days: int = 30, most: int = 100_000) -> DataFrame:
    """History without what is too old or too much."""
    return history.where(F.col("t") >= now - days * 86_400).orderBy(F.desc("t"), "p").limit(most)
