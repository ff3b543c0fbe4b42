"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are aggregated by the set of sources they belong to. On that graph (a node a pattern,
a node a source) words flow from patterns to source quotas; a pattern's first, second and third
copies cost 1, 2 and 3 a word, so repeats are used last. A pattern's flow is then met by whole copies
of all its documents plus one more copy of seeded ones: in the order of md5(seed:id) each document that still fits
is taken. This goes in rounds: a round takes documents no longer than what is missing until one doesn't fit, and the
next round goes on behind them with what is then missing, at most ROUNDS times (each about halves it). At the
end the shortest document left is taken too if that brings the words nearer to the flow. A round's end is found
from sums over 4096 hash buckets and one bucket's documents, so no source, however large, is one task's.

The driver holds a row for each pattern and each source, never a document.

Edge cases. Null and empty texts weigh 0 and are never taken; a null source is a source, last in order;
repeated rows tie and are taken together; an empty table gives no rows; columns named as the four that are
added (_size, _source_size, _target, _taken) are replaced, any others pass through.
"""

from __future__ import annotations

import json
from collections import defaultdict, deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, materialize, n_words_of, packed, unpacked

COPIES = 3
SEED = "mix"
#: Most rounds that fill what is missing of a flow.
ROUNDS = 8
MADE = ("_size", "_source_size", "_target", "_taken")


def targets(sizes: dict, weights: dict, copies: int = COPIES) -> dict:
    """Quotas that share all words by weight, none above `copies` times its source, the excess shared anew."""
    total, out, todo = sum(sizes.values()), {}, sorted(sizes, key=lambda s: (copies * sizes[s] / weights[s], s is None, s or ""))
    rest, weight = total, sum(weights[s] for s in todo)
    for s in todo:
        if copies * sizes[s] * weight <= rest * weights[s]:
            out[s] = float(copies * sizes[s])
            rest -= copies * sizes[s]
            weight -= weights[s]
        else:
            out[s] = rest * weights[s] / weight
    return out


def cheapest_flow(patterns: dict, quotas: dict, copies: int = COPIES) -> dict:
    """Words from each pattern (a tuple of sources -> its words) that meet the quotas at least cost."""
    nodes = ["in", "out", *(("p", p) for p in patterns), *(("s", s) for s in quotas)]
    number = {n: i for i, n in enumerate(nodes)}
    arcs: list[list] = []
    at = defaultdict(list)

    def arc(a, b, room, cost):
        at[number[a]].append(len(arcs))
        arcs.append([number[b], room, cost])
        at[number[b]].append(len(arcs))
        arcs.append([number[a], 0, -cost])

    first = {}
    for p, words in patterns.items():
        first[p] = len(arcs)
        for k in range(copies):
            arc("in", ("p", p), words, k + 1)
        for s in p:
            arc(("p", p), ("s", s), copies * words, 0)
    for s, quota in quotas.items():
        arc(("s", s), "out", round(quota), 0)
    while True:
        cost, via, queue, queued = {0: 0}, {}, deque([0]), {0}
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for k in at[a]:
                b, room, c = arcs[k]
                if room > 0 and cost[a] + c < cost.get(b, float("inf")):
                    cost[b], via[b] = cost[a] + c, k
                    if b not in queued:
                        queued.add(b)
                        queue.append(b)
        if 1 not in cost:
            break
        path, n = [], 1
        while n:
            path.append(via[n])
            n = arcs[via[n] ^ 1][0]
        amount = min(arcs[k][1] for k in path)
        for k in path:
            arcs[k][1] -= amount
            arcs[k ^ 1][1] += amount
    return {p: sum(arcs[first[p] + 2 * k + 1][1] for k in range(copies)) for p in patterns}


def _round(rows: DataFrame, state: DataFrame) -> list:
    """(pattern, last document taken, words taken) of the longest run of documents behind `_last`, none over the gap, that fits it."""
    spark = rows.sparkSession
    bucket = F.conv(F.substring("_order", 1, 3), 16, 10).cast("int")
    me = F.struct("_order", "_size")
    left = rows.join(F.broadcast(state), "_pattern").where((F.col("_size") <= F.col("_gap")) & (me > F.col("_last"))).withColumn("_bucket", bucket)
    sums = left.groupBy("_pattern", "_gap", "_bucket").agg(F.sum("_size").alias("_sum"), F.max(me).alias("_at"))
    ahead = Window.partitionBy("_pattern").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({"_before": F.coalesce(F.sum("_sum").over(ahead), F.lit(0)), "_prior": F.max("_at").over(ahead)}).where("_before < _gap")
    edges = sums.groupBy("_pattern").agg(F.max(F.struct("_bucket", "_before", "_prior")).alias("e")).select("_pattern", "e.*").collect()  # a row a pattern
    # the gap is filled in the last of these buckets; its documents are counted one by one
    table = F.broadcast(spark.createDataFrame(edges, "_pattern string, _bucket int, _before long, _prior struct<_order: string, _size: long>"))
    so_far = Window.partitionBy("_pattern").orderBy("_order", "_size").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inner = left.join(table, ["_pattern", "_bucket"]).select("_pattern", "_order", "_size", "_gap", (F.col("_before") + F.sum("_size").over(so_far)).alias("_got")).where("_got <= _gap")
    ends = {r[0]: (r[1], r[2]) for r in inner.groupBy("_pattern").agg(F.max(me), F.max("_got")).collect()}
    return [(p, *ends.get(p, (prior, before))) for p, _, before, prior in edges if p in ends or prior is not None]


_STATE = "_pattern string, _gap long, _last struct<_order: string, _size: long>"
_ROUNDS = "array<struct<low: struct<_order: string, _size: long>, high: struct<_order: string, _size: long>, gap: long>>"


def _chosen(rounds: Column, extra: Column) -> Column:
    """A document (_order, _size) is taken once more."""
    me = F.struct("_order", "_size")
    fits = F.exists(rounds, lambda r: (me > r["low"]) & (me <= r["high"]) & (F.col("_size") <= r["gap"]))
    return (F.col("_size") > 0) & (fits | F.coalesce(me == extra, F.lit(False)))


def fillings(rows: DataFrame, gaps: dict[str, int]) -> dict[str, tuple[list, tuple | None]]:
    """For each pattern the rounds (documents behind `low` up to `high` that are no longer than `gap`) and the last document."""
    spark = rows.sparkSession
    rows = rows.where("_size > 0")
    rounds: dict[str, list] = {p: [] for p in gaps}
    gap, last = dict(gaps), {p: ("", -1) for p in gaps}
    todo = [p for p in gaps if gap[p] > 0]
    for _ in range(ROUNDS):
        if not todo:
            break
        found = _round(rows, spark.createDataFrame([(p, gap[p], last[p]) for p in todo], _STATE))
        for p, at, got in found:
            rounds[p].append((last[p], tuple(at), gap[p]))
            last[p], gap[p] = tuple(at), gap[p] - got
        todo = [r[0] for r in found if gap[r[0]] > 0]
    extra: dict[str, tuple] = {}
    if missing := [(p, gap[p], rounds[p]) for p in gaps if gap[p] > 0]:
        state = spark.createDataFrame(missing, f"_pattern string, _gap long, _rounds {_ROUNDS}")
        near = rows.join(F.broadcast(state), "_pattern").where("_size > _gap AND _size < 2 * _gap").where(~_chosen(F.col("_rounds"), F.lit(None).cast("struct<_order: string, _size: long>")))
        extra = {r[0]: (r[1][1], r[1][0]) for r in near.groupBy("_pattern").agg(F.min(F.struct("_size", "_order"))).collect()}
    return {p: (rounds[p], extra.get(p)) for p in gaps}


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, size: str | None = None, weights: dict | None = None, copies: int = COPIES, seed: str = SEED) -> DataFrame:
    """docs with _size, _source_size, _target and _taken; the first two sums are of the pattern's first source.

    source_col: a string or an array of strings. size: a column with the words, else they are counted.
    weights: by source; else 1, 2, 3, repeating, over the sources by code point, null last.
    """
    spark, sources = docs.sparkSession, column(source_col)
    pattern = F.array_sort(F.array_distinct(sources)) if dict(docs.dtypes)[source_col].startswith("array") else F.array(sources)
    order_ = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(column(id_col).cast("string"), F.lit(""))).cast("binary"))
    words_ = F.coalesce(column(size).cast("long"), F.lit(0)) if size else n_words_of(column(text_col))
    rows = docs.select(packed(docs, MADE), words_.alias("_size"), F.to_json(pattern).alias("_pattern"), order_.alias("_order"))
    slim = materialize(rows.select("_pattern", "_order", "_size"), "sizes")
    words = {r[0]: r[1] for r in slim.groupBy("_pattern").agg(F.sum("_size")).collect()}
    members = {p: tuple(json.loads(p)) if p else (None,) for p in words}
    sizes: dict = defaultdict(int)
    for p, of in members.items():
        for s in of:
            sizes[s] += words[p]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = weights or {s: i % 3 + 1 for i, s in enumerate(order)}
    quotas = targets(sizes, weights, copies)
    flow = cheapest_flow({members[p]: words[p] for p in words}, quotas, copies)
    parts = {p: divmod(flow[of], words[p]) if words[p] else (0, 0) for p, of in members.items()}
    filled = fillings(slim, {p: int(rest) for p, (_, rest) in parts.items()})
    first = {p: of[0] if of else None for p, of in members.items()}
    table = [(p, int(parts[p][0]), sizes.get(first[p], 0), quotas.get(first[p], 0.0), *filled[p]) for p in words]
    table = spark.createDataFrame(table, f"_pattern string, _base long, _source_size long, _target double, _rounds {_ROUNDS}, _extra struct<_order: string, _size: long>")
    taken = F.col("_size") * (F.col("_base") + _chosen(F.col("_rounds"), F.col("_extra")).cast("long"))
    return rows.join(table, "_pattern").select(*unpacked(docs, MADE), "_size", "_source_size", "_target", taken.alias("_taken"))
