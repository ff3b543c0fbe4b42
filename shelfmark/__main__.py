"""python -m shelfmark STORE VERB ...: index, search, status, changes, rescan, config."""

from __future__ import annotations

import argparse
import sys
import time
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import catalog as C
from shelfmark.operators import changes as D
from shelfmark.operators import search as S
from shelfmark.operators.rules import normalized_roots
from shelfmark.operators.settings import Root, SettingsStore, from_json
from shelfmark.plans.compiler import compile_query
from shelfmark.plans.language import QueryError
from shelfmark.sources import filelist, files, sinks
from shelfmark.streaming.live import Live, status


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="shelfmark", description="Index folders and search their entries.")
    p.add_argument("store", help="folder of the catalog's generations")
    verbs = p.add_subparsers(dest="verb", required=True)
    v = verbs.add_parser("index", help="scan folders and publish a generation")
    v.add_argument("roots", nargs="*")
    v = verbs.add_parser("search", help="print what a query finds")
    v.add_argument("query", nargs="*")
    v.add_argument("--limit", type=int, default=1000)
    v.add_argument("--offset", type=int, default=0)
    v.add_argument("--sort", choices=sorted(S.SORTS), default="name")
    v.add_argument("--descending", action="store_true")
    form = v.add_mutually_exclusive_group()
    form.add_argument("--json", action="store_true")
    form.add_argument("--null", action="store_true")
    form.add_argument("--efu", action="store_true")
    form.add_argument("--csv", action="store_true")
    verbs.add_parser("status", help="entries, generation and times")
    v = verbs.add_parser("changes", help="print recent changes")
    v.add_argument("text", nargs="?", default="")
    v.add_argument("--since", default="1d")
    v.add_argument("--limit", type=int, default=100)
    v = verbs.add_parser("rescan", help="read a root, or all, again")
    v.add_argument("root", nargs="?")
    v = verbs.add_parser("config", help="show the settings, or import a file")
    v.add_argument("file", nargs="?")
    return p


def walker(spark: SparkSession, flat: list[str]):
    """Scans targets (raw) of the file system; the listed roots, which aren't recursive, with their direct entries alone."""

    def scan(targets: DataFrame) -> DataFrame:
        wanted = [r.raw.encode("latin-1").decode("utf-8", "surrogateescape") for r in targets.select("raw").collect()]  # at most MOST_TARGETS
        deep = files.scan(spark, [w for w in wanted if w not in flat])[0]
        return deep.unionByName(files.scan(spark, [w for w in wanted if w in flat], recursive=False)[0])

    return scan


def live_of(spark: SparkSession, store: str) -> Live:
    settings = SettingsStore(spark, store).load()
    flat = [r.path for r in settings.roots if not r.recursive]
    kept = tuple(r.path for r in settings.roots if r.enabled and r.keep_offline)
    return Live(sinks.Generations(spark, store), walker(spark, flat), settings.enabled(), tuple(flat), settings.index_rules(), kept)


def found(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The page that `search` prints: (rank, line)."""
    catalog = C.build(sinks.Generations(spark, a.store).load())
    rows = compile_query(" ".join(a.query), catalog, files.Contents())
    page = S.page(rows, a.sort, a.descending, a.limit, a.offset)
    line = sinks.json_lines(page) if a.json else filelist.lines(page) if a.efu else sinks.csv_lines(page) if a.csv else F.col("path").cast("string")
    return page.select("rank", line.cast("binary").alias("line")).orderBy("rank")


def main(words: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    a = parser().parse_args(words)
    out = out or sys.stdout.buffer
    say = lambda x: out.write(x + (b"\0" if getattr(a, "null", False) else b"\n"))
    spark = spark or SparkSession.builder.appName("shelfmark").getOrCreate()
    try:
        if a.verb == "index":
            if a.roots:
                own = SettingsStore(spark, a.store)
                now = own.load()
                own.save(now.revision, replace(now, roots=tuple(Root(r) for r in normalized_roots(a.roots))))
            live = live_of(spark, a.store)
            if not live.roots:
                raise ValueError("There is no root to index")
            live.update(None)
            say(f"{live.store.load().count()} entries".encode())
        elif a.verb == "search":
            if a.efu:
                say(filelist.HEADER.encode())
            if a.csv:
                say(b"Name,Path,Size,Modified,Created,Type")
            for row in found(spark, a).toLocalIterator():  # at most MOST_ROWS lines
                say(bytes(row.line))
        elif a.verb == "status":
            for k, v in status(sinks.Generations(spark, a.store)).items():
                say(f"{k}: {v}".encode())
        elif a.verb == "changes":
            rows = D.recent(sinks.Generations(spark, a.store).history(), int(time.time()) - D.since_seconds(a.since), a.limit, a.text)
            for r in rows.collect():
                say(f"{time.strftime('%Y-%m-%d %H:%M', time.gmtime(r.t))} {r.a} {r.p}{' -> ' + r.to if r.to else ''}".encode(errors="surrogateescape"))
        elif a.verb == "rescan":
            say(f"generation {live_of(spark, a.store).rescan(a.root)}".encode())
        else:
            own = SettingsStore(spark, a.store)
            if a.file:
                with open(a.file, encoding="utf-8") as f:
                    new = from_json(f.read())
                own.save(own.load().revision, new)
            say(own.load().to_json().encode())
    except (QueryError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
