"""Trees of the search language to DataFrames over an enriched catalog.

Predicates on a row become one Column. Terms about sets of rows (child:, empty:, and dupe: or
content: anywhere but as a direct term of an AND) become flag tables joined by path. Direct dupe: and
content: terms of an AND run last, in their written order, each on the rows that are left.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import text as T
from shelfmark.functions.text import fold

from . import language as L

MOST_CONTENT, HEAD = 16 << 20, 64 << 10
_WORD = r"0-9A-Za-z\x80-\xFF"


def _whole(raw: Column, needle: str, case: bool) -> Column:
    body = re.escape(needle.encode().decode("latin-1"))
    return raw.rlike(f"(?{'s' if case else 'si'})(?<![{_WORD}]){body}(?![{_WORD}])")


def _contains(t: L.Contains) -> Column:
    at = "path" if t.path else "name"
    raw, flat = F.col("raw" if t.path else "raw_name"), F.col(f"{at}_fold")
    if t.whole:
        if t.case:
            return _whole(raw, t.needle, True)
        return _whole(raw, t.needle, False) | _whole(T.bytes_of(F.encode(flat, "UTF-8")), fold(t.needle), False)
    return F.contains(F.col(at), F.lit(t.needle.encode())) if t.case else flat.contains(fold(t.needle))


def _affix(t: L.Affix) -> Column:
    test = F.startswith if t.prefix else F.endswith
    return test(F.col("name"), F.lit(t.needle.encode())) if t.case else test(F.col("name_fold"), F.lit(fold(t.needle)))


def _within(t: L.Within) -> Column:
    out = F.col(t.column).isNotNull()
    if t.low is not None:
        out &= F.col(t.column) >= t.low
    if t.high is not None:
        out &= F.col(t.column) <= min(t.high, 2**63 - 1)
    if t.column == "size":
        out &= F.col("kind").isin("file", "folder")
    return out


def _leaf(t) -> Column | None:
    """The bare predicate of a term about one row, which the scan can take over; null counts as no."""
    match t:
        case L.All():
            return F.lit(True)
        case L.Contains():
            return _contains(t)
        case L.Affix():
            return _affix(t)
        case L.Pattern():
            return F.col("raw" if t.path else "raw_name").rlike(t.regex)
        case L.Kind():
            return F.col("kind") == t.kind
        case L.Ext():
            return (F.col("kind") == "file") & F.col("fext").isin(*t.extensions)
        case L.Within():
            return _within(t)
        case L.Parent():
            return F.col("dir") == F.lit(t.path.encode())
    return None


class Compiler:
    """content: for content: and dupe:content, a table (path binary, content binary or string), or an object that reads
    contents(rows, most) and digests(rows, size), as sources.files.Contents does."""

    def __init__(self, catalog: DataFrame, content=None):
        self.catalog, self.content = catalog, content

    def rows(self, tree, scope: DataFrame | None = None) -> DataFrame:
        """The rows that match, of `scope` or else of the catalog."""
        inside = self.catalog if scope is None else scope
        if isinstance(tree, L.Dupe | L.Content):
            return self._slow(tree, inside)
        if not isinstance(tree, L.And):
            return self._filtered(inside, [tree])
        slow = [t for t in tree.terms if isinstance(t, L.Dupe | L.Content)]
        out = self._filtered(inside, [t for t in tree.terms if t not in slow])
        for t in slow:
            out = self._slow(t, out)
        return out

    def _filtered(self, df: DataFrame, terms: list) -> DataFrame:
        flags: list[DataFrame] = []
        wanted = [self._column(t, flags) for t in terms]
        names = df.columns
        for i, table in enumerate(flags):
            df = df.join(table.withColumn(f"_flag{i}", F.lit(True)), "path", "left")
        for column in wanted:
            df = df.where(column)
        return df.select(*names)

    def _flag(self, paths: DataFrame, flags: list[DataFrame]) -> Column:
        flags.append(paths.distinct())
        return F.coalesce(F.col(f"_flag{len(flags) - 1}"), F.lit(False))

    def _column(self, t, flags: list[DataFrame]) -> Column:
        if (leaf := _leaf(t)) is not None:
            return leaf
        match t:
            case L.Not():
                return ~F.coalesce(self._column(t.term, flags), F.lit(False))
            case L.Or():
                out = self._column(t.terms[0], flags)
                for x in t.terms[1:]:
                    out = out | self._column(x, flags)
                return out
            case L.And() if not any(isinstance(x, L.Dupe | L.Content) for x in t.terms):
                out = self._column(t.terms[0], flags)
                for x in t.terms[1:]:
                    out = out & self._column(x, flags)
                return out
            case L.Child():
                hit = self.catalog.where(F.col("name_fold") == fold(t.name)).select(F.col("dir").alias("path"))
                return (F.col("kind") == "folder") & self._flag(hit.where("path IS NOT NULL"), flags)
            case L.Empty():
                return (F.col("kind") == "folder") & ~self._flag(self.catalog.where("dir IS NOT NULL").select(F.col("dir").alias("path")), flags)
        return self._flag(self.rows(t).select("path"), flags)

    def _contents(self, df: DataFrame) -> DataFrame:
        """df's files with their contents, of those that content: reads."""
        if self.content is None:
            raise L.QueryError("No file contents are at hand")
        df = df.where("kind = 'file'")
        read = self.content if isinstance(self.content, DataFrame) else self.content.contents(df, MOST_CONTENT)
        return df.join(read.select("path", F.col("content").cast("binary").alias("_content")), "path").where(F.octet_length("_content") <= MOST_CONTENT)

    def _digested(self, df: DataFrame, name: str, size: int | None) -> DataFrame:
        """df with the digest of the first `size` bytes of each file, or of the whole file."""
        if self.content is None:
            raise L.QueryError("No file contents are at hand")
        if isinstance(self.content, DataFrame):
            data = F.col("content").cast("binary")
            read = self.content.join(df.select("path"), "path", "left_semi").select("path", F.sha2(data if size is None else F.substring(data, 1, size), 256).alias(name))
        else:
            read = self.content.digests(df, size).withColumnRenamed("digest", name)
        return df.join(read, "path")

    def _slow(self, t, df: DataFrame) -> DataFrame:
        names = df.columns
        if isinstance(t, L.Content):
            found = self._contents(df)
            if t.case:
                hit = F.contains(F.col("_content"), F.lit(t.needle.encode()))
            else:
                hit = T.ascii_lower(T.bytes_of(F.col("_content"))).contains(fold(t.needle).encode().decode("latin-1"))
            return found.where(hit).select(*names)
        keys = [k for k in t.by if k != "content"]
        if "size" in t.by or "content" in t.by:
            df, keys = df.where("kind = 'file' AND size > 0"), list(dict.fromkeys([*keys, "size"]))
        df = self._shared(df, keys)
        if "content" not in t.by:
            return df
        df = self._shared(self._digested(df, "_head", HEAD), [*keys, "_head"])
        short = df.where(F.col("size") <= HEAD).select(*names)
        return short.unionByName(self._shared(self._digested(df.where(F.col("size") > HEAD), "_whole", None), [*keys, "_head", "_whole"]).select(*names))

    @staticmethod
    def _shared(df: DataFrame, keys: list[str]) -> DataFrame:
        """Rows whose keys another row shares: counted with partial sums, then joined."""
        again = df.groupBy(*keys).count().where("count > 1").select(*keys)
        return df.join(again, keys, "left_semi").select(*df.columns)


def compile_query(text: str, catalog: DataFrame, content=None, **clock) -> DataFrame:
    return Compiler(catalog, content).rows(L.parse(text, **clock))
