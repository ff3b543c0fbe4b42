"""Catalogs: derived columns, duplicates by path, and folder roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import text as T

RAW = "path binary, kind string, size long, modified long, created long"


def one_per_path(raw: DataFrame) -> DataFrame:
    """The first row of each path: of equal paths the smallest of (kind, size, modified, created)."""
    w = Window.partitionBy("path").orderBy("kind", "size", "modified", "created")
    return raw.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def _ancestors(raw_dir):
    """Every folder on the way to a path's parent, the parent too (byte form)."""
    parts = F.split(raw_dir, "/")
    below = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws("/", F.slice(parts, 1, i)))
    below = F.filter(below, lambda x: x != "")
    return F.when(raw_dir == "/", F.array(F.lit("/"))).when(raw_dir.startswith("/"), F.concat(F.array(F.lit("/")), below)).otherwise(below)


def rolled_up(raw: DataFrame) -> DataFrame:
    """raw with folders' sizes (all files below) and items (all entries below; 0 for others).

    Rows are summed by parent before ancestors are exploded, so the explosion is over folders.
    """
    at = raw.withColumn("_raw", T.bytes_of(F.col("path"))).withColumn("_dir", T.parent_of(F.col("_raw")))
    direct = at.where("_dir IS NOT NULL").groupBy("_dir").agg(F.sum(F.when(F.col("kind") == "file", F.col("size")).otherwise(0)).alias("_s"), F.count("*").alias("_c"))
    below = direct.select(F.explode(_ancestors(F.col("_dir"))).alias("_raw"), "_s", "_c").groupBy("_raw").agg(F.sum("_s").alias("_s"), F.sum("_c").alias("_c"))
    folder = F.col("kind") == "folder"
    return at.join(below, "_raw", "left").select("path", "kind", F.when(folder, F.coalesce("_s", F.lit(0))).otherwise(F.col("size")).cast("long").alias("size"), "modified", "created", F.when(folder, F.coalesce("_c", F.lit(0))).otherwise(0).cast("long").alias("items"))


def enriched(rolled: DataFrame, exact_fold: bool = False) -> DataFrame:
    """The columns searches use, beside those of `rolled_up`; exact_fold folds Hangul too, with an Arrow function."""
    fold = T.fold_udf if exact_fold else T.folded
    path_text = F.make_valid_utf8(F.col("path").cast("string")) if hasattr(F, "make_valid_utf8") else F.col("path").cast("string")
    base = rolled.withColumn("raw", T.bytes_of(F.col("path"))).withColumn("path_text", path_text)
    base = base.withColumn("raw_name", T.name_of(F.col("raw"))).withColumn("raw_dir", T.parent_of(F.col("raw"))).withColumn("name_text", T.name_of(F.col("path_text")))
    return (
        base.withColumn("name", F.encode("raw_name", "ISO-8859-1"))
        .withColumn("dir", F.encode("raw_dir", "ISO-8859-1"))
        .withColumn("ext", T.sort_extension(F.col("name_text")))
        .withColumn("fext", T.filter_extension(F.col("name_text")))
        .withColumn("path_key", F.replace("raw", F.lit("/"), F.lit("\0")))
        .withColumn("name_fold", fold(F.col("name_text")))
        .withColumn("path_fold", fold(F.col("path_text")))
        .withColumn("name_key", T.natural_key(F.col("name_fold")))
    )


def build(raw: DataFrame, exact_fold: bool = False) -> DataFrame:
    return enriched(rolled_up(raw), exact_fold)


def totals(catalog: DataFrame) -> DataFrame:
    """Entries, files, folders, and bytes of files."""
    count = lambda kind: F.sum(F.when(F.col("kind") == kind, 1).otherwise(0)).cast("long")
    return catalog.agg(F.count("*").alias("entries"), count("file").alias("files"), count("folder").alias("folders"), F.coalesce(F.sum(F.when(F.col("kind") == "file", F.col("size"))), F.lit(0)).cast("long").alias("bytes"))


def selection(rows: DataFrame) -> DataFrame:
    """Count and bytes of the selected files and folders."""
    return rows.agg(F.count("*").alias("selected"), F.coalesce(F.sum(F.when(F.col("kind").isin("file", "folder"), F.col("size"))), F.lit(0)).cast("long").alias("bytes"))
