"""Rename plans: new names by text, pattern or case, and why some can't be given. Nothing is renamed."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import text as T


def _parts(items: DataFrame, whole: bool) -> DataFrame:
    """items (path string, folder boolean, modified long, ord long) with name, _stem, _kept, _ext."""
    named = items.withColumn("name", T.name_of(F.col("path"))).withColumn("_dir", T.parent_of(F.col("path")))
    dotted = ~F.col("folder") & F.col("name").rlike(r"(?s)^.+[.][^.]*$")
    stem = F.when(dotted, F.regexp_extract("name", r"(?s)^(.+)[.][^.]*$", 1)).otherwise(F.col("name"))
    ext = F.when(dotted, F.regexp_extract("name", r"(?s)^.+[.]([^.]*)$", 1)).otherwise("")
    named = named.withColumn("_old_stem", stem).withColumn("_ext", ext)
    if whole:
        return named.withColumn("_stem", F.col("name")).withColumn("_kept", F.lit(""))
    return named.withColumn("_stem", F.col("_old_stem")).withColumn("_kept", F.when(dotted, F.concat(F.lit("."), "_ext")).otherwise(""))


def _planned(parts: DataFrame, new_stem: Column, catalog: DataFrame) -> DataFrame:
    """(from, to, problem): invalid names, names given twice, and names that others have and keep."""
    named = parts.withColumn("_new", F.concat(new_stem, "_kept"))
    slash = F.when(F.col("_dir") == "/", "/").otherwise(F.concat("_dir", F.lit("/")))
    plan = named.select(F.col("path").alias("from"), F.concat(F.coalesce(slash, F.lit("")), "_new").alias("to"), T.invalid_name(F.col("_new")).alias("_bad"))
    plan = plan.withColumn("_twice", F.count("*").over(Window.partitionBy("to")) > 1)
    leaving = plan.where("`from` <> `to`").select(F.col("from").alias("_there"))
    taken = catalog.select(F.col("path").cast("string").alias("_there")).distinct().join(leaving, "_there", "left_anti")
    plan = plan.join(taken, plan["to"] == taken["_there"], "left")
    clash = F.when(F.col("_twice"), "Another item would get the same name").when((F.col("from") != F.col("to")) & F.col("_there").isNotNull(), "A file with this name already exists")
    return plan.select("from", "to", F.coalesce("_bad", clash).alias("problem"))


def replaced(items: DataFrame, catalog: DataFrame, find: str, new: str, *, regex: bool = False, case: bool = False, extension: bool = False) -> DataFrame:
    parts = _parts(items, extension)
    flags = "" if case else "(?iu)"
    pattern = flags + (find if regex else re.escape(find))
    return _planned(parts, F.regexp_replace("_stem", pattern, new if regex else new.replace("\\", r"\\").replace("$", r"\$")), catalog)


def patterned(items: DataFrame, catalog: DataFrame, template: str, *, start: int = 1, step: int = 1, digits: int = 1, extension: bool = False) -> DataFrame:
    """[N] stem, [E] extension, [F] whole name, [P] parent's name, [D] date, [C] counter in the order of ord."""
    parts = _parts(items, extension)
    counter = (start + step * F.col("ord")).cast("string")
    counter = F.when(F.length(counter) < digits, F.lpad(counter, digits, "0")).otherwise(counter)
    day = F.date_format(F.timestamp_seconds("modified"), "yyyy-MM-dd")
    out = F.lit(template)
    for mark, value in (("[N]", F.col("_old_stem")), ("[E]", F.col("_ext")), ("[F]", F.col("name")), ("[P]", F.coalesce(F.when(F.col("_dir") == "/", "").otherwise(T.name_of(F.col("_dir"))), F.lit(""))), ("[D]", day), ("[C]", counter)):
        out = F.replace(out, F.lit(mark), value)
    return _planned(parts, out, catalog)


def cased(items: DataFrame, catalog: DataFrame, how: str, *, extension: bool = False) -> DataFrame:
    """how: lower, upper, title or sentence."""
    if how in ("lower", "upper"):
        new = getattr(F, how)(F.col("_stem"))
    else:
        new = F.pandas_udf(lambda s: s.map(lambda x: None if x is None else T.changed_case(x, how)), "string")("_stem")
    return _planned(_parts(items, extension), new, catalog)
