"""Mounted file systems, as a small table: which mount holds a path, and which are networks or removable drives."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import text as T

#: Types of file systems that are served over a network, and of such user-space ones.
NETWORK = ("nfs", "nfs4", "cifs", "smb3", "smbfs", "afs", "ceph", "glusterfs", "9p", "davfs", "ncpfs", "coda", "lustre", "ocfs2", "gfs2")
NETWORK_FUSE = ("fuse.sshfs", "fuse.rclone", "fuse.gvfsd-fuse", "fuse.davfs2", "fuse.s3fs", "fuse.curlftpfs", "fuse.smbnetfs", "fuse.cifs")
MEDIA = ("/media", "/run/media")


def unescaped(field: str) -> bytes:
    """A mount table's field with its octal escapes undone."""
    return re.sub(rb"\\([0-3][0-7]{2})", lambda m: bytes([int(m[1], 8)]), field.encode("utf-8", "surrogateescape"))


def parsed(spark: SparkSession, table: str) -> DataFrame:
    """(point binary, type) of each line of a mountinfo table; other lines are left out."""
    rows = []
    for line in table.splitlines():
        left, dash, right = line.partition(" - ")
        fields = left.split(" ")
        if dash and len(fields) > 4:
            rows.append((unescaped(fields[4]), right.split(" ")[0]))
    return spark.createDataFrame(rows, "point binary, type string")


def current(spark: SparkSession) -> DataFrame:
    with open("/proc/self/mountinfo", encoding="utf-8", errors="surrogateescape") as f:
        return parsed(spark, f.read())


def is_network(kind: Column) -> Column:
    return F.substring_index(kind, ".", 1).isin(*NETWORK) | kind.isin(*NETWORK_FUSE)


def mounted(paths: DataFrame, mounts: DataFrame) -> DataFrame:
    """paths (column path binary) with the point and type of the mount that holds each: the longest that is an ancestor.

    Paths are exploded into their ancestors and joined by equality; null where no mount holds a path.
    """
    from shelfmark.operators.catalog import _ancestors

    raw = T.bytes_of(F.col("path"))
    chain = F.concat(F.coalesce(_ancestors(T.parent_of(raw)), F.array().cast("array<string>")), F.array(raw))
    table = mounts.select(T.bytes_of(F.col("point")).alias("_at"), "point", "type")
    held = paths.select("path", F.explode(chain).alias("_at")).distinct().join(table, "_at")
    best = held.groupBy("path").agg(F.max_by(F.struct("point", "type"), F.length("_at")).alias("_m"))
    return paths.join(best, "path", "left").select(*paths.columns, "_m.point", "_m.type")


def removable(mounts: DataFrame, user: str | None = None) -> DataFrame:
    """Points of removable drives: mounts directly below a media folder, or the user's one in it, that are no network's."""
    user = os.environ.get("USER", "") if user is None else user
    folders = [*MEDIA, *(f"{m}/{user}" for m in MEDIA if user)]
    return mounts.where(T.parent_of(T.bytes_of(F.col("point"))).isin(*folders) & ~is_network(F.col("type"))).select("point")
