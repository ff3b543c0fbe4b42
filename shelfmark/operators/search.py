"""Searches: order, page, total, launcher ranking, and queries built from parts."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.text import fold
from shelfmark.plans.compiler import compile_query
from shelfmark.plans.language import MACROS, QueryError, parse

MOST_ROWS = 10_000
CANDIDATES, RESULTS = 300, 20
SORTS = {
    "name": ["name_key", "name", "path_key"],
    "path": ["path_key"],
    "size": ["size", "path_key"],
    "modified": ["modified", "path_key"],
    "created": ["created", "path_key"],
    "items": ["items", "path_key"],
    "type": ["_file", "_ext", "name_key", "name", "path_key"],
}


@dataclass(frozen=True)
class SearchRequest:
    query: str = ""
    sort: str = "name"
    descending: bool = False
    limit: int = 1000
    offset: int = 0


def order(sort: str, descending: bool = False) -> list[Column]:
    """Sort keys with their tie-breakers, all reversed when descending; unknown times come first going up."""
    if sort not in SORTS:
        raise QueryError(f"Unknown sort: {sort}")
    special = {"_file": F.col("kind") != "folder", "_ext": F.when(F.col("kind") == "folder", "").otherwise(F.col("ext"))}
    keys = [special.get(k, F.col(k)) for k in SORTS[sort]]
    return [k.desc_nulls_last() if descending else k.asc_nulls_first() for k in keys]


def page(rows: DataFrame, sort: str = "name", descending: bool = False, limit: int = 1000, offset: int = 0) -> DataFrame:
    """One page in order (top-k, no full sort), with its place as `rank` from 1; at most MOST_ROWS rows."""
    keys = order(sort, descending)
    found = rows.orderBy(*keys).offset(offset).limit(min(limit, MOST_ROWS))
    return found.withColumn("rank", (F.row_number().over(Window.orderBy(*keys)) + offset).cast("long"))


def search(catalog: DataFrame, request: SearchRequest, content: DataFrame | None = None, **clock) -> tuple[DataFrame, DataFrame]:
    """(page, one-row total of all matches)."""
    rows = compile_query(request.query, catalog, content, **clock)
    return page(rows, request.sort, request.descending, request.limit, request.offset), rows.agg(F.count("*").alias("total"))


def launcher(catalog: DataFrame, text: str, **clock) -> DataFrame:
    """The launcher's results: of the newest matches those that start with the first word, then visible ones; with relevance."""
    text = text.strip()
    found = compile_query(text if len(text) >= 2 else '"\0"', catalog, **clock)
    newest = page(found, "modified", True, CANDIDATES)
    first = fold(text.split()[0]) if text else ""
    best = [~F.col("name_fold").startswith(first), F.col("raw").rlike(r"(^|/)[.]"), F.col("rank")]
    top = newest.orderBy(*best).limit(RESULTS)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.row_number().over(Window.orderBy(*best))
    top = top.select("*", place.alias("place"), F.greatest(F.count("*").over(everything), F.lit(1)).alias("_of"))
    return top.withColumn("relevance", 0.9 - 0.4 * ((F.col("place") - 1) / F.col("_of"))).withColumn("match", F.when(F.col("name_fold") == first, 100).otherwise(30)).drop("_of")


def with_filter(query: str, extra: str) -> str:
    """A query with a type macro, a saved filter or a bookmark as one more AND term."""
    return f"<{query}> <{extra}>" if query.strip() and extra.strip() else query or extra


def in_folder(query: str, folder: str) -> str:
    return f'"{folder.rstrip("/")}/" {query}'.strip()


def browse(folder: str) -> str:
    return f'parent:"{folder}"'


def valid_saved(queries: dict[str, str], most: int = 1000) -> None:
    """Raise QueryError unless all saved queries parse and there are no more than `most`."""
    if len(queries) > most:
        raise QueryError("Too many saved searches")
    for q in queries.values():
        parse(q)


OPERATORS = ("case:", "path:", "ww:", "wholeword:", "regex:", "file:", "folder:", "ext:", "size:", "dm:", "dc:", "parent:", "infolder:", "child:", "empty:", "dupe:", "content:")


def completions(typed: str, history: list[str], saved: dict[str, str] | None = None) -> list[str]:
    """Past searches that start as typed, then operators, macros and saved names for the last word."""
    whole = [h for h in history if typed and h.lower().startswith(typed.lower()) and h != typed]
    last = typed.rsplit(" ", 1)[-1].lower()
    words = [w for w in (*OPERATORS, *MACROS, *(saved or {})) if last and w.lower().startswith(last) and w.lower() != last]
    return [*dict.fromkeys([*whole, *words])]


def history_after(history: DataFrame, query: str, now: datetime, most: int = 100, days: int = 90) -> DataFrame:
    """Past searches (query, at) with one moved to the front, pruned by age and then by number."""
    new = history.sparkSession.createDataFrame([(query, now)], history.schema)
    latest = history.unionByName(new).groupBy("query").agg(F.max("at").alias("at")).where(F.col("at") >= F.lit(now) - F.expr(f"interval {days} days"))
    return latest.orderBy(F.desc("at"), "query").limit(most)
