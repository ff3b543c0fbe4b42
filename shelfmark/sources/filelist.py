"""File lists (CSV with a header) as catalogs, and their export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import text as T

HEADER = "Filename,Size,Date Modified,Date Created,Attributes"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, folder, size, modified, created) of a list; columns in any order, all but Filename may be missing."""
    df = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, encoding="UTF-8")
    for name in df.columns:
        df = df.withColumnRenamed(name, name.lstrip("﻿").strip().lower())
    return parsed(df)


def parsed(df: DataFrame) -> DataFrame:
    """Records from string columns named as in the header, lower-cased."""
    column = lambda n: F.col(f"`{n}`") if n in df.columns else F.lit(None).cast("string")
    name = column("filename")
    folder = name.rlike(r"[/\\]$") | (F.floor(T.attributes(F.coalesce(column("attributes"), F.lit(""))) / 16) % 2 == 1)
    rows = df.where(F.coalesce(name, F.lit("")) != "")
    return rows.select(
        F.when(F.length(name) > 1, F.regexp_replace(name, r"(?<=.)[/\\]+$", "")).otherwise(name).alias("path"),
        folder.alias("folder"),
        F.coalesce(F.trim(column("size")).try_cast("bigint"), F.lit(0)).alias("size"),
        T.list_date(column("date modified")).alias("modified"),
        T.list_date(column("date created")).alias("created"),
    )


def as_root(records: DataFrame, old: str, new: str) -> DataFrame:
    """Raw catalog rows of the records under `old`, moved below the folder `new`, which gets a row too."""
    path = T.mapped_path(F.col("path"), old, new)
    rows = records.withColumn("_to", path).where("_to IS NOT NULL").select(F.col("_to").cast("binary").alias("path"), F.when(F.col("folder"), "folder").otherwise("file").alias("kind"), F.when(F.col("folder"), 0).otherwise(F.col("size")).cast("long").alias("size"), F.coalesce("modified", F.lit(0)).alias("modified"), "created")
    root = records.sparkSession.createDataFrame([(new.encode(), "folder", 0, 0, None)], rows.schema)
    return rows.unionByName(root)


def common_folder(paths: list[str]) -> str:
    """The longest folder that all paths share, whatever their case; parts as the first path writes them."""
    split = [p.replace("\\", "/").split("/")[:-1] for p in paths]
    out = []
    for parts in zip(*split, strict=False):
        if len({p.lower() for p in parts}) > 1:
            break
        out.append(parts[0])
    return "/".join(out) or ("/" if paths and all(p.startswith("/") for p in paths) else "")


def lines(rows: DataFrame) -> Column:
    """A list line: only the path is quoted, links and others have no size."""
    quoted = F.concat(F.lit('"'), F.replace(F.col("path_text"), F.lit('"'), F.lit('""')), F.lit('"'))
    size = F.when(F.col("kind").isin("file", "folder"), F.col("size").cast("string")).otherwise("")
    created = F.coalesce(T.filetime(F.col("created")).cast("string"), F.lit(""))
    return F.concat_ws(",", quoted, size, T.filetime(F.col("modified")).cast("string"), created, F.when(F.col("kind") == "folder", "16").otherwise("32"))
