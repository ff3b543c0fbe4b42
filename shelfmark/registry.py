"""The catalog engine's queries over the derived catalog, and their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import text as T
from shelfmark.operators import catalog as C
from shelfmark.operators import changes as D
from shelfmark.operators import rename as N
from shelfmark.operators import rules as X
from shelfmark.operators import search as S
from shelfmark.plans.compiler import compile_query
from shelfmark.plans.language import MACROS
from shelfmark.sources import filelist, sinks
from shelfmark.sources.staging import shared_folder
from shelfmark.streaming import live

NOW = datetime(2024, 1, 15, 12, tzinfo=UTC)
TABLES = ("region", "nation", "customer", "orders", "documents", "pages", "events")
#: The derived catalog; EPOCH, BYTES and MD differ between the engines.
RAW_SQL = """select '/w' path, 'folder' kind, cast(0 as bigint) size, cast(0 as bigint) modified, cast(null as bigint) created
union all select concat('/w/',r_name),'folder',cast(0 as bigint),cast(r_regionkey as bigint),cast(null as bigint) from region
union all select concat('/w/',r_name,'/',n_name),'folder',cast(0 as bigint),cast(n_nationkey as bigint),cast(null as bigint) from nation join region on n_regionkey=r_regionkey
union all select concat('/w/',r_name,'/',n_name,'/',c_name),'folder',cast(0 as bigint),c_custkey,cast(null as bigint) from customer join nation on c_nationkey=n_nationkey join region on n_regionkey=r_regionkey
union all select concat('/w/',r_name,'/',n_name,'/',c_name,'/order-',cast(o_orderkey%500 as varchar(20)),'-',cast(o_orderkey as varchar(20)),case o_orderstatus when 'F' then '.pdf' when 'O' then '.TXT' else '.md' end),'file',cast(round(o_totalprice*100) as bigint),EPOCH(o_orderdate),EPOCH(o_orderdate)-86400 from orders join customer on o_custkey=c_custkey join nation on c_nationkey=n_nationkey join region on n_regionkey=r_regionkey
union all select '/w/docs','folder',cast(0 as bigint),cast(0 as bigint),cast(null as bigint)
union all select distinct concat('/w/docs/',lang),'folder',cast(0 as bigint),cast(0 as bigint),cast(null as bigint) from documents
union all select distinct concat('/w/docs/',lang,'/',source),'folder',cast(0 as bigint),cast(0 as bigint),cast(null as bigint) from documents
union all select concat('/w/docs/',lang,'/',source,'/',cast(doc_id as varchar(20))),'folder',cast(0 as bigint),doc_id,cast(null as bigint) from documents
union all select concat('/w/docs/',lang,'/',source,'/',cast(doc_id as varchar(20)),'/',replace(replace(substr(text,1,12),'/','_'),chr(10),' '),'.txt'),'file',cast(BYTES(text) as bigint),1700000000+doc_id*3600,1690000000+doc_id from documents
union all select '/w/web','folder',cast(0 as bigint),cast(0 as bigint),cast(null as bigint)
union all select concat('/w/web/page ',cast(page_id as varchar(20)),'.html'),case when page_id%10=0 then 'link' else 'file' end,cast(BYTES(html) as bigint),1710000000+page_id,cast(null as bigint) from pages
union all select '/w/void','folder',cast(0 as bigint),cast(0 as bigint),cast(null as bigint)
union all select concat('/w/void/',r_name),'folder',cast(0 as bigint),cast(0 as bigint),cast(null as bigint) from region"""
#: The second generation: some orders gone, some grown, one source's folders moved.
LATER_SQL = """select case when path like '/w/docs/%/src7' or path like '/w/docs/%/src7/%' then replace(path, '/src7', '/moved7') else path end path, kind, case when ordered % 89 = 0 then size + 1 else size end size, modified, created
from (select *, cast(case when kind = 'file' and path like '%/order-%' then NUMBER(path) end as bigint) ordered from (RAW) r) r where ordered is null or ordered % 97 <> 0"""


def _engine(sql: str, duck: bool) -> str:
    sql = sql.replace("(RAW)", f"({RAW_SQL})")
    sql = re.sub(r"EPOCH\((\w+)\)", r"cast(epoch(\1) as bigint)" if duck else r"unix_seconds(cast(\1 as timestamp))", sql)
    sql = sql.replace("BYTES(", "strlen(" if duck else "octet_length(")
    return sql.replace("NUMBER(path)", "regexp_extract(path, '-([0-9]+)[.][A-Za-z]+$', 1)")


def raw(spark: SparkSession, sf_dir: str, sql: str = RAW_SQL) -> DataFrame:
    """Raw rows of a folder's tables; scanned once a session, as a file system would be."""
    key = (spark.sparkContext.applicationId, sf_dir, sql)
    if key not in _scanned:
        _scanned[key] = shared_folder(spark, "scan")
        _derived(spark, sf_dir, sql).write.parquet(_scanned[key])
    return spark.read.parquet(_scanned[key])


_scanned: dict[tuple[str, str, str], str] = {}


def _derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    text = _engine(sql, False)
    for t in TABLES:  # named frames, so that no view of the session is touched
        text = _named(text, t)
    return spark.sql(text, **tables).withColumn("path", F.col("path").cast("binary"))


def _named(sql: str, table: str) -> str:
    return re.sub(rf"\b(from|join) {table}\b", rf"\1 {{{table}}} {table}", sql)


_built: dict[tuple[str, str], str] = {}


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog of a folder's tables; indexed once a session and then read, as searches do."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        path = shared_folder(spark, "catalog")
        C.build(raw(spark, sf_dir)).write.parquet(path)
        _built[key] = path
    return spark.read.parquet(_built[key])


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat(F.lit("/w/docs/"), "lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("/"), F.replace(F.replace(F.substring("text", 1, 12), F.lit("/"), F.lit("_")), F.lit("\n"), F.lit(" ")), F.lit(".txt"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    page = F.concat(F.lit("/w/web/page "), F.col("page_id").cast("string"), F.lit(".html"))
    return docs.select(path.cast("binary").alias("path"), F.col("text").alias("content")).unionByName(pages.select(page.cast("binary").alias("path"), F.col("html").alias("content")))


SHOWN = ("path", "kind", "size", "modified", "created", "items")


def _shown(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(F.col("path_text").alias("path"), *SHOWN[1:], *more)


#: name: (query, sort or None, descending, limit, offset, SQL condition over c)
SEARCHES: dict[str, tuple] = {
    "search_flagship": ("ext:pdf size:>1kb", "size", True, 100, 0, "kind = 'file' and fext = 'pdf' and size > 1024"),
    "search_contains": ("CIÓN", None, 0, 0, 0, "contains(name_fold, 'cion')"),
    "search_case": ("case:The", None, 0, 0, 0, "contains(name, 'The')"),
    "search_wholeword": ("ww:the", None, 0, 0, 0, "regexp_matches(name_fold, '(^|[^0-9a-z\\x{80}-\\x{10FFFF}])the([^0-9a-z\\x{80}-\\x{10FFFF}]|$)')"),
    "search_path": ("path:asia/nation_2 order-1", None, 0, 0, 0, "contains(path_fold, 'asia/nation_2') and contains(name_fold, 'order-1')"),
    "search_prefix": ("order-12*", None, 0, 0, 0, "starts_with(name_fold, 'order-12')"),
    "search_suffix": ("*7.TXT", None, 0, 0, 0, "ends_with(name_fold, '7.txt')"),
    "search_inner": ("*ente*", None, 0, 0, 0, "contains(name_fold, 'ente')"),
    "search_wildcard": ("order-?1-*.md", None, 0, 0, 0, "regexp_matches(name, '(?is)^order-.1-.*\\.md$')"),
    "search_path_wildcard": ("/w/*/nation_1/*/*-99*.pdf", None, 0, 0, 0, "regexp_matches(path, '(?is)^/w/[^/]*/nation_1/[^/]*/[^/]*-99[^/]*\\.pdf$')"),
    "search_regex": ('regex:"^order-[0-9]{2}-.*7\\.(pdf|md)$"', None, 0, 0, 0, "regexp_matches(name, '(?i)^order-[0-9]{2}-.*7\\.(pdf|md)$')"),
    "search_regex_path": ('regex:"docs/(fr|de)/src1/"', None, 0, 0, 0, "regexp_matches(path, '(?i)docs/(fr|de)/src1/')"),
    "search_and_or_not": ("order-1 pdf | md !-10", None, 0, 0, 0, "contains(name_fold, 'order-1') and (contains(name_fold, 'pdf') or contains(name_fold, 'md')) and not contains(name_fold, '-10')"),
    "search_grouping": ("<pdf order-3> | <html 7>", None, 0, 0, 0, "(contains(name_fold, 'pdf') and contains(name_fold, 'order-3')) or (contains(name_fold, 'html') and contains(name_fold, '7'))"),
    "search_quoted": ('"page 1"', None, 0, 0, 0, "contains(name_fold, 'page 1')"),
    "filter_kind_file": ("file: 99", None, 0, 0, 0, "kind = 'file' and contains(name_fold, '99')"),
    "filter_kind_folder": ("folder:", None, 0, 0, 0, "kind = 'folder'"),
    "filter_ext": ("ext:md;.TXT", None, 0, 0, 0, "kind = 'file' and fext in ('md', 'txt')"),
    "filter_type_macro": ("doc: -7", None, 0, 0, 0, f"kind = 'file' and fext in ({', '.join(repr(x) for x in MACROS['doc:'].split(';'))}) and contains(name_fold, '-7')"),
    "filter_size_range": ("size:100kb..1mb", None, 0, 0, 0, "kind in ('file', 'folder') and size between 102400 and 1048576"),
    "filter_modified_day": ("dm:1995-03-15", None, 0, 0, 0, "modified between 795225600 and 795311999"),
    "filter_modified_month": ("dm:1996-02", None, 0, 0, 0, "modified between 823132800 and 825638399"),
    "filter_modified_range": ("dm:1996..1997-06-30", None, 0, 0, 0, "modified between 820454400 and 867715199"),
    "filter_modified_after": ("dm:>2023-11-20 dm:<2023-12-10", None, 0, 0, 0, "modified >= 1700524800 and modified < 1702166400"),
    "filter_modified_rolling": ("dm:last3months", None, 0, 0, 0, "modified between 1697371200 and 1705320000"),
    "filter_created": ("dc:<1996", None, 0, 0, 0, "created < 820454400"),
    "filter_parent": ("parent:/w/web/", None, 0, 0, 0, "dir = '/w/web'"),
    "filter_child": ("child:nation_1", None, 0, 0, 0, "kind = 'folder' and path in (select dir from c where name_fold = 'nation_1')"),
    "filter_empty": ("empty:", None, 0, 0, 0, "kind = 'folder' and path not in (select dir from c where dir is not null)"),
    "dupe_name": ("dupe:", None, 0, 0, 0, "name in (select name from c group by name having count(*) > 1)"),
    "dupe_size": ("dupe:size", None, 0, 0, 0, "kind = 'file' and size > 0 and size in (select size from c where kind = 'file' and size > 0 group by size having count(*) > 1)"),
    "dupe_name_size": ("dupe:name;size", None, 0, 0, 0, "kind = 'file' and size > 0 and (name, size) in (select (name, size) from c where kind = 'file' and size > 0 group by name, size having count(*) > 1)"),
    "dupe_content": ("dupe:content", None, 0, 0, 0, "kind = 'file' and size > 0 and md5(content) in (select md5(content) from c where kind = 'file' and size > 0 and content is not null group by 1 having count(*) > 1)"),
    "dupe_scoped": ("ext:txt dupe:name", None, 0, 0, 0, "kind = 'file' and fext = 'txt' and name in (select name from c where kind = 'file' and fext = 'txt' group by name having count(*) > 1)"),
    "dupe_negated": ("ext:txt !dupe:", None, 0, 0, 0, "kind = 'file' and fext = 'txt' and name not in (select name from c group by name having count(*) > 1)"),
    "content_search": ("content:license", None, 0, 0, 0, "kind = 'file' and contains(lower(content), 'license')"),
    "content_case": ("case:content:The ext:txt", None, 0, 0, 0, "kind = 'file' and fext = 'txt' and contains(content, 'The')"),
    "content_then_dupe": ("content:the dupe:size", None, 0, 0, 0, "kind = 'file' and size > 0 and contains(lower(content), 'the') and size in (select size from c where kind = 'file' and size > 0 and contains(lower(content), 'the') group by size having count(*) > 1)"),
    "content_or_name": ("<content:license ext:txt> | page", None, 0, 0, 0, "(kind = 'file' and fext = 'txt' and contains(lower(content), 'license')) or contains(name_fold, 'page')"),
    "type_filtered": (S.with_filter("order-2", "ext:pdf | size:<100b"), None, 0, 0, 0, "contains(name_fold, 'order-2') and ((kind = 'file' and fext = 'pdf') or (kind in ('file', 'folder') and size < 100))"),
    "folder_scoped": (S.in_folder("order-4", "/w/ASIA"), None, 0, 0, 0, "contains(path_fold, '/w/asia/') and contains(name_fold, 'order-4')"),
    "browse_folder": (S.browse("/w/docs"), None, 0, 0, 0, "dir = '/w/docs'"),
    "sort_name": ("order-1 | the", "name", False, 200, 0, "contains(name_fold, 'order-1') or contains(name_fold, 'the')"),
    "sort_name_descending": ("order-1 | the", "name", True, 200, 0, "contains(name_fold, 'order-1') or contains(name_fold, 'the')"),
    "sort_path": ("docs/es", "path", False, 300, 0, "contains(path_fold, 'docs/es')"),
    "sort_size": ("", "size", True, 250, 0, "true"),
    "sort_modified": ("", "modified", False, 250, 0, "true"),
    "sort_type": ("page | nation_1 | order-49", "type", False, 400, 0, "contains(name_fold, 'page') or contains(name_fold, 'nation_1') or contains(name_fold, 'order-49')"),
    "sort_created": ("page | order-49", "created", False, 400, 0, "contains(name_fold, 'page') or contains(name_fold, 'order-49')"),
    "sort_items": ("folder:", "items", True, 250, 0, "kind = 'folder'"),
    "page_offset": ("pdf", "size", False, 50, 120, "contains(name_fold, 'pdf')"),
}
ORDER_SQL = {"name": "name_key {d}, name {d}, path_key {d}", "path": "path_key {d}", "type": "kind <> 'folder' {d}, case when kind = 'folder' then '' else ext end {d}, name_key {d}, name {d}, path_key {d}"} | {k: f"{k} {{d}}, path_key {{d}}" for k in ("size", "modified", "created", "items")}

_FOLD = "lower(strip_accents(" + "replace(" * len(T.BASES) + "X" + "".join(f", '{a}', '{b}')" for a, b in T.BASES.items()) + "))"
_NATURAL = "array_to_string(list_transform(regexp_extract_all(name_fold, '[0-9]+|[^0-9]+'), lambda x: case when regexp_matches(x, '^[0-9]') then (case when length(NZ) <= 8 then length(NZ)::varchar else '9' || chr(least(length(NZ), 255)::int) end) || NZ else x end), '')".replace("NZ", "(case when ltrim(x, '0') = '' then '0' else ltrim(x, '0') end)")


#: A twin's derived columns: the SQL of each over p (a raw row with its folder and name).
_DERIVED = {
    "name_fold": _FOLD.replace("X", "name"),
    "path_fold": _FOLD.replace("X", "path"),
    "ext": "lower(case when regexp_matches(name, '(?s)^.+[.]') then regexp_extract(name, '[.]([^.]*)$', 1) else '' end)",
    "fext": "lower(case when contains(name, '.') then regexp_extract(name, '[.]([^.]*)$', 1) end)",
    "path_key": "replace(path, '/', chr(0))",
}
_UP = "unnest(list_prepend('/', list_transform(range(2, len(string_split(dir, '/')) + 1), lambda i: array_to_string(string_split(dir, '/')[1:i], '/')))) folder"


def _sql(sql: str) -> str:
    """sql with a WITH clause that gives r (raw) and c, which has only the derived columns that sql names."""
    parts = [f"r as ({_engine(RAW_SQL, True)})"]
    if re.search(r"\bc\b", sql):
        used = set(re.findall(r"\w+", sql))
        if "name_key" in used:
            used |= {"name_fold"}
        made = "".join(f", {x} {name}" for name, x in _DERIVED.items() if name in used)
        parts.append("p as (select *, case when instr(substr(path, 2), '/') = 0 then '/' else regexp_extract(path, '^(.*)/[^/]*$', 1) end dir, regexp_extract(path, '([^/]*)$', 1) name from r)")
        size, items, joined = "size", "0::bigint", ""
        if used & {"size", "items"}:
            parts.append("direct as (select dir, sum(case when kind = 'file' then size else 0 end) s, count(*) n from p group by dir)")
            parts.append(f"roll as (select folder, sum(s)::bigint s, sum(n)::bigint n from (select {_UP}, s, n from direct) group by folder)")
            size, items, joined = "case when kind = 'folder' then coalesce(s, 0) else size end", "case when kind = 'folder' then coalesce(n, 0) else 0 end", " left join roll on roll.folder = p.path"
        parts.append(f"e as (select p.path, kind, {size} size, modified, created, {items} items, dir, name{made} from p{joined})")
        more = f", {_NATURAL} name_key" if "name_key" in used else ""
        if "content" in used:
            parts.append("ct as (select concat('/w/docs/',lang,'/',source,'/',doc_id::varchar,'/',replace(replace(substr(text,1,12),'/','_'),chr(10),' '),'.txt') path, text content from documents union all select concat('/w/web/page ', page_id::varchar, '.html'), html from pages)")
            parts.append(f"c as (select e.*{more}, content from e left join ct on ct.path = e.path)")
        else:
            parts.append(f"c as (select e.*{more} from e)")
    return "with " + ",\n".join(parts) + "\n" + sql


def _search_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    text, sort, descending, limit, offset, _ = SEARCHES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        content = contents(spark, sf_dir) if "content" in text else None
        rows = compile_query(text, catalog(spark, sf_dir), content, now=NOW)
        return _shown(S.page(rows, sort, descending, limit, offset), "rank") if sort else _shown(rows)

    return run


def _search_sql(name: str) -> str:
    _, sort, descending, limit, offset, where = SEARCHES[name]
    shown = ", ".join(SHOWN)
    if not sort:
        return _sql(f"select {shown} from c where {where}")
    keys = ORDER_SQL[sort].replace("{d}", "desc nulls last" if descending else "asc nulls first")
    return _sql(f"select {shown}, row_number() over (order by {keys}) rank from c where {where} qualify rank > {offset} and rank <= {offset + limit}")


def launcher_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.launcher(catalog(spark, sf_dir), "order-3 pdf", now=NOW)
    return found.select(F.col("path_text").alias("path"), F.col("place").cast("long").alias("place"), F.round("relevance", 6).alias("relevance"), F.col("match").cast("long").alias("match"))


def folder_size_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.rolled_up(raw(spark, sf_dir)).where("kind = 'folder'").select(F.col("path").cast("string").alias("path"), "size")


def folder_item_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.rolled_up(raw(spark, sf_dir)).where("kind = 'folder'").select(F.col("path").cast("string").alias("path"), "items")


def catalog_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.totals(raw(spark, sf_dir))


def search_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search(catalog(spark, sf_dir), S.SearchRequest("pdf | md", "size", limit=10))[1]


def selection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.selection(compile_query("parent:/w/web | parent:/w/docs", catalog(spark, sf_dir)))


def dedup_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw(spark, sf_dir)
    twice = rows.unionByName(rows.where("kind = 'file'").withColumn("size", F.col("size") + 1))
    return C.one_per_path(twice).select(F.col("path").cast("string").alias("path"), "kind", "size")


def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return c.select(F.col("path_text").alias("path"), "name_fold", "name_key", "ext", "fext", F.col("raw_dir").isNull().alias("top"), T.filetime(F.col("modified")).alias("ticks"), T.local_time(F.col("modified")).alias("shown"), T.thousands(F.col("size")).alias("grouped"), T.type_label(F.col("kind"), F.col("ext")).alias("label"))


def _later(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    keep = ("path", "kind", "size", "modified", "created")
    return C.rolled_up(raw(spark, sf_dir)).select(*keep), C.rolled_up(raw(spark, sf_dir, LATER_SQL)).select(*keep)


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.differences(*_later(spark, sf_dir)).select("action", "kind", F.col("path").cast("string").alias("path"), "size")


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.paired(D.differences(*_later(spark, sf_dir)))
    return p.select("action", "kind", F.col("path").cast("string").alias("path"), F.col("to").cast("string").alias("to"), "size", D.label(F.col("action"), F.col("path"), F.col("to")).alias("label"))


def move_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moves(spark, sf_dir).where("action = 'moved'")


def moved_children_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moves(spark, sf_dir)


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/nation.parquet").join(spark.read.parquet(f"{sf_dir}/region.parquet"), F.col("n_regionkey") == F.col("r_regionkey"))
    nation = c.where("n_nationkey % 3 = 0").select(F.concat(F.lit("/w/"), "r_name", F.lit("/"), "n_name").alias("raw"))
    return nation.unionByName(c.where("r_name = 'ASIA'").select(F.concat(F.lit("/w/"), "r_name").alias("raw")).distinct())


def reconcile_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.outermost(_targets(spark, sf_dir)).select(F.col("raw").alias("path"))


def reconcile_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, fresh = raw(spark, sf_dir), raw(spark, sf_dir, LATER_SQL)
    out = live.reconciled(old, D.outermost(_targets(spark, sf_dir)), lambda t: D.covered(fresh, t))
    return out.select(F.col("path").cast("string").alias("path"), "kind", "size", "modified", "created")


def stream_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `events` table as a stream of changed paths; the scan finds a file an event."""
    root = shared_folder(spark, "live")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    path = F.concat(F.lit("/w/stream/"), F.col("user_id").cast("string"), F.lit("/"), "event_type", F.lit("-"), F.col("event_id").cast("string")).cast("binary")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    files = table.select(path.alias("path"), F.lit("file").alias("kind"), F.col("event_id").cast("long").alias("size"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("modified"), F.lit(None).cast("long").alias("created"))
    live_ = live.Live(sinks.Generations(spark, root), lambda t: D.covered(files, t), ["/w"])
    live_.start(stream.select(path.alias("path"), F.lit(False).alias("overflow")), f"{root}/checkpoint", {"availableNow": True}).awaitTermination()
    return live_.store.load().select(F.col("path").cast("string").alias("path"), "kind", "size", "modified")


RULES = X.Rules(roots=("/w",), excluded_folders=("/w/EUROPE", "/w/docs/fr"), included_folders=("/w/EUROPE/FRANCE",), exclude_hidden=True, excluded_types=("md",), excluded_files=("order-1*",))


def index_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw(spark, sf_dir).withColumn("path", F.col("path").cast("string"))
    return X.kept(rows, RULES).select("path", "kind")


def efu_export_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compile_query("page | docs/es", catalog(spark, sf_dir))
    return rows.select(filelist.lines(rows).alias("line"))


def csv_export_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compile_query("page | docs/es", catalog(spark, sf_dir))
    return rows.select(sinks.csv_lines(rows).alias("line"))


def efu_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw(spark, sf_dir).select(F.replace(F.col("path").cast("string"), F.lit("/"), F.lit("\\")).alias("path"))
    return rows.select(T.mapped_path(F.col("path"), "\\W\\asia\\", "/mnt/list").alias("mapped")).where("mapped IS NOT NULL")


def filelist_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/orders.parquet")
    made = c.select(F.concat(F.lit("C:\\d\\"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 7 == 0, "\\").otherwise("")).alias("filename"), F.when(F.col("o_orderkey") % 5 == 0, "x").otherwise(F.col("o_custkey").cast("string")).alias("size"), F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(T.filetime(F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).cast("string")).alias("date modified"), F.when(F.col("o_orderkey") % 11 == 0, "0x10").otherwise("32").alias("attributes"))
    return filelist.parsed(made).select("path", "folder", "size", "modified")


def _items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every entry as an item to rename, and the catalog they are in."""
    rows = raw(spark, sf_dir).withColumn("path", F.col("path").cast("string"))
    return rows.select("path", (F.col("kind") == "folder").alias("folder"), "modified", F.col("modified").alias("ord")), rows


def rename_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.replaced(*_items(spark, sf_dir), "PAGE ", "p$")


def rename_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.patterned(*_items(spark, sf_dir), "[P]-[C]_[N] [D].[E]", start=5, step=2, digits=4)


def rename_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.replaced(*_items(spark, sf_dir), "^(page|order-) ?1", "$1 ", regex=True)


OWN = (launcher_rank, folder_size_rollup, folder_item_count, catalog_totals, search_total, selection_summary, dedup_by_path, scalar_functions, snapshot_diff, move_pairs, moved_children_suppressed, reconcile_targets, reconcile_apply, stream_reconcile, index_rules, efu_export_lines, csv_export_lines, efu_map, filelist_records, rename_replace, rename_pattern, rename_conflicts)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _search_query(name) for name in SEARCHES} | {f.__name__: f for f in OWN}


_TWO = ", r2 as (" + _engine(LATER_SQL, True) + "), u2 as (select unnest(list_prepend('/', list_transform(range(2, len(string_split(d, '/')) + 1), lambda i: array_to_string(string_split(d, '/')[1:i], '/')))) folder, kind, size from (select *, regexp_extract(path, '^(.*)/[^/]*$', 1) d from r2)), roll2 as (select folder, sum(case when kind = 'file' then size else 0 end)::bigint s from u2 group by folder), n2 as (select path, kind, case when kind = 'folder' then coalesce(s, 0) else size end size, modified, created from r2 left join roll2 on folder = path), d as (select case when o.path is null then 'created' when n.path is null then 'deleted' else 'modified' end action, coalesce(n.kind, o.kind) kind, coalesce(n.path, o.path) path, coalesce(n.size, o.size) size, coalesce(n.modified, o.modified) modified, coalesce(n.created, o.created) created from c o full join n2 n on o.path = n.path where o.path is null or n.path is null or (n.kind = 'file' and (o.size <> n.size or o.modified <> n.modified)))"
_MOVED = _TWO + """, x as (select *, regexp_extract(path, '([^/]*)$', 1) nm, regexp_extract(path, '^(.*)/[^/]*$', 1) dr, coalesce(created, -1) cr, replace(path, '/', chr(0)) pk from d),
g1 as (select *, row_number() over (partition by kind, size, modified, cr, nm order by pk) k from x where action = 'deleted'), m1 as (select *, row_number() over (partition by kind, size, modified, cr, nm order by pk) k from x where action = 'created'),
p1 as (select g1.kind, g1.path, m1.path t, g1.size from g1 join m1 using (kind, size, modified, cr, nm, k) where not (m1.path = g1.path or starts_with(m1.path, g1.path || '/'))),
g2 as (select *, row_number() over (partition by kind, size, modified, cr, dr order by pk) k from x where action = 'deleted' and path not in (select path from p1)), m2 as (select *, row_number() over (partition by kind, size, modified, cr, dr order by pk) k from x where action = 'created' and path not in (select t from p1)),
mv as (select * from p1 union all select g2.kind, g2.path, m2.path, g2.size from g2 join m2 using (kind, size, modified, cr, dr, k) where not starts_with(m2.path, g2.path || '/')),
al as (select 'moved' action, kind, path, t "to", size from mv union all select action, kind, path, null, size from x where action = 'modified' or (action = 'deleted' and path not in (select path from mv)) or (action = 'created' and path not in (select t from mv))),
f as (select path, t from mv where kind = 'folder')
select action, kind, path, "to", size, case when action = 'moved' and regexp_extract(path, '^(.*)/', 1) = regexp_extract("to", '^(.*)/', 1) then 'Renamed' else upper(action[1]) || action[2:] end as label from al
where not exists (select 1 from f where (al.action in ('deleted', 'moved') and starts_with(al.path, f.path || '/')) or (al.action = 'created' and starts_with(al.path, f.t || '/')))"""
_TARGETS = "t0 as (select '/w/' || r_name || '/' || n_name path from nation join region on n_regionkey = r_regionkey where n_nationkey % 3 = 0 union all select '/w/ASIA'), t as (select path from t0 where not exists (select 1 from t0 o where starts_with(t0.path, o.path || '/')))"
_ITEMS = "i as (select *, regexp_extract(path, '([^/]*)$', 1) nm, regexp_extract(path, '^(.*)/[^/]*$', 1) dr from r), s as (select *, case when kind <> 'folder' and regexp_matches(nm, '^.+[.]') then regexp_extract(nm, '^(.+)[.][^.]*$', 1) else nm end st, case when kind <> 'folder' and regexp_matches(nm, '^.+[.]') then regexp_extract(nm, '^.+([.][^.]*)$', 1) else '' end kept from i), n as (select path f, dr || '/' || {stem} || kept t, {stem} || kept nn from s), k as (select f, t, case when nn in ('', '.', '..') then 'The new name is empty' when count(*) over (partition by t) > 1 then 'Another item would get the same name' when f <> t and t in (select path from r) and t not in (select f from n where f <> t) then 'A file with this name already exists' end problem from n) select f as \"from\", t as \"to\", problem from k"


def oracle_sql() -> dict[str, str]:
    plain = lambda stem: _engine(f"with r as ({RAW_SQL}), ", True) + _ITEMS.replace("{stem}", stem)
    out = {name: _search_sql(name) for name in SEARCHES}
    out["launcher_rank"] = _sql("select path, place, round(0.9 - 0.4 * ((place - 1) / (count(*) over ())), 6) relevance, case when name_fold = 'order-3' then 100 else 30 end::bigint as match from (select path, name_fold, row_number() over (order by not starts_with(name_fold, 'order-3'), regexp_matches(path, '(^|/)[.]'), rank) place from (select *, row_number() over (order by modified desc, path_key desc) rank from c where contains(name_fold, 'order-3') and contains(name_fold, 'pdf') qualify rank <= 300) qualify place <= 20)")
    out["folder_size_rollup"] = _sql("select path, size from c where kind = 'folder'")
    out["folder_item_count"] = _sql("select path, items from c where kind = 'folder'")
    out["catalog_totals"] = _sql("select count(*) entries, count(*) filter (kind = 'file') files, count(*) filter (kind = 'folder') folders, sum(size) filter (kind = 'file')::bigint bytes from r")
    out["search_total"] = _sql("select count(*) total from c where contains(name_fold, 'pdf') or contains(name_fold, 'md')")
    out["selection_summary"] = _sql("select count(*) selected, sum(size) filter (kind in ('file', 'folder'))::bigint bytes from c where dir in ('/w/web', '/w/docs')")
    out["dedup_by_path"] = _sql("select path, kind, min(size) size from (select path, kind, size from r union all select path, kind, size + 1 from r where kind = 'file') group by path, kind")
    out["scalar_functions"] = _sql("select path, name_fold, name_key, ext, fext, false top, (modified + 11644473600) * 10000000 ticks, strftime(make_timestamp(modified * 1000000), '%Y-%m-%d %H:%M') shown, format('{:,}', size) grouped, case kind when 'folder' then 'Folder' when 'link' then 'Link' else case when ext = '' then 'File' else upper(ext) || ' file' end end as label from c")
    out["snapshot_diff"] = _sql(_TWO + " select action, kind, path, size from d")
    out["moved_children_suppressed"] = _sql(_MOVED)
    out["move_pairs"] = f"select * from ({_sql(_MOVED)}) where action = 'moved'"
    out["reconcile_targets"] = f"with {_TARGETS} select path from t"
    out["reconcile_apply"] = _engine(f"with r as ({RAW_SQL}), r2 as ({LATER_SQL}), {_TARGETS} select path, kind, size, modified, created from r where not exists (select 1 from t where r.path = t.path or starts_with(r.path, t.path || '/')) union all select path, kind, size, modified, created from r2 where exists (select 1 from t where r2.path = t.path or starts_with(r2.path, t.path || '/'))", True)
    out["stream_reconcile"] = "select '/w/stream/' || user_id || '/' || event_type || '-' || event_id path, 'file' kind, event_id::bigint size, cast(floor(epoch(ts)) as bigint) modified from events"
    out["index_rules"] = _sql("select path, kind from r where (starts_with(path || '/', '/w/EUROPE/FRANCE/') or not (starts_with(path || '/', '/w/EUROPE/') or starts_with(path || '/', '/w/docs/fr/') or regexp_matches(path, '^/w/(.*/)?[.]'))) and not (kind <> 'folder' and (regexp_matches(path, '/order-1[^/]*$') or (lower(path) like '%.md' and lower(path) not like '%/.md')))")
    out["efu_export_lines"] = _sql("""select '"' || replace(path, '"', '""') || '",' || case when kind in ('file', 'folder') then size::varchar else '' end || ',' || ((modified + 11644473600) * 10000000)::varchar || ',' || coalesce(((created + 11644473600) * 10000000)::varchar, '') || ',' || case when kind = 'folder' then '16' else '32' end line from c where contains(name_fold, 'page') or contains(path_fold, 'docs/es')""")
    quote = lambda x: f"""case when regexp_matches({x}, '[",\\r\\n]') then '"' || replace({x}, '"', '""') || '"' else {x} end"""
    stamp = lambda x: f"strftime(make_timestamp({x} * 1000000), '%Y-%m-%d %H:%M')"
    out["csv_export_lines"] = _sql(f"select {quote('name')} || ',' || {quote('path')} || ',' || case when kind in ('file', 'folder') then size::varchar else '' end || ',' || {stamp('modified')} || ',' || coalesce({stamp('created')}, '') || ',' || case kind when 'folder' then 'Folder' when 'link' then 'Link' else upper(ext) || ' file' end line from c where contains(name_fold, 'page') or contains(path_fold, 'docs/es')")
    out["efu_map"] = _sql("select '/mnt/list' || path[8:] mapped from r where lower(path) = '/w/asia' or starts_with(lower(path), '/w/asia/')")
    out["filelist_records"] = "select 'C:\\d\\' || o_orderkey path, o_orderkey % 7 = 0 or o_orderkey % 11 = 0 folder, case when o_orderkey % 5 = 0 then 0 else o_custkey end::bigint size, cast(epoch(o_orderdate) as bigint) modified from orders"
    out["rename_replace"] = plain("regexp_replace(st, '(?i)page ', 'p$', 'g')")
    out["rename_pattern"] = plain("regexp_extract(dr, '([^/]*)$', 1) || '-' || case when 5 + 2 * modified < 1000 then lpad((5 + 2 * modified)::varchar, 4, '0') else (5 + 2 * modified)::varchar end || '_' || st || ' ' || strftime(make_timestamp(modified * 1000000), '%Y-%m-%d') || '.' || kept[2:]")
    out["rename_conflicts"] = plain("regexp_replace(st, '(?i)^(page|order-) ?1', '\\1 ')")
    return out
