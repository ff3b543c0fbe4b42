"""Exact removal of repeated byte strings with suffix arrays built over bounded blocks.

A byte goes if a string of `length` bytes that covers it also starts earlier: in a document with a
smaller key, or in the same document further left. Strings are judged on the input.

Plan. Every window of `length` bytes holds 69 k-grams of 32 bytes; the one with the smallest hash is
its anchor, and equal windows have equal anchors at equal places. Anchors with their contexts (68
bytes to the left, 100 from the start, so all windows that own them) are shuffled by hash. Of equal
contexts only the first counts further, the others are covered as a whole; this is combined on the
map side first, so a passage with a million copies sends one row a batch. Contexts that share an
anchor but differ go into suffix arrays, block by block: each context is a string of symbols (cells of
17 bytes left and right of the anchor), and windows with equal cells are neighbours there. The two cut
cells at a window's ends are compared byte by byte. Anchors with more than `hot` different contexts
are grouped by window hash instead, so that no task gathers an unbounded group.

Cells, anchors and contexts are compared by 64-bit fingerprints, always two or more of them together.

Edge cases. A null text is empty; a text under `length` bytes is left whole; repeated or null ids, and ids that
aren't whole numbers, are ordered as `common.keyed` says and count as documents of their own; other columns pass
through whatever their names, but for those that are made (_n_bytes, _n_removed, _n_spans, _kept_sha256), which are
replaced; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, keyed, mapped, materialize, merged, packed, unpacked
from .suffix_array import suffix_array

LENGTH, GRAM = 100, 32
REACH = LENGTH - GRAM
CELL = REACH // 4
HOT = 50_000
BLOCK = 20_000
_U = np.uint64
_MUL, _MIX = _U(0xD6E8FEB86659FD93), _U(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _MUL
    h = (h ^ (h >> _U(29))) * _MIX
    return h ^ (h >> _U(32))


def _extreme(f, h: np.ndarray, width: int) -> np.ndarray:
    """f (minimum or maximum) over every run of `width` values."""
    w = 1
    while w * 2 <= width:
        h, w = f(h[:-w], h[w:]), w * 2
    return f(h[: len(h) - (width - w)], h[width - w :]) if w < width else h


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the k-grams that are smallest in some window of the byte array."""
    n = len(data)
    if n < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = _mixed(data.astype(np.uint64) + _U(1))
    mul, w = _MUL, 1
    with np.errstate(over="ignore"):
        while w < GRAM:
            h, mul, w = h[:-w] * mul + h[w:], mul * mul, w * 2
    h = _mixed(h)
    low = _extreme(np.minimum, h, REACH + 1)
    padded = np.zeros(len(h) + REACH, np.uint64)
    padded[REACH : REACH + len(low)] = low
    at = np.flatnonzero(_extreme(np.maximum, padded, REACH + 1) == h)
    return at, h[at]


class _Spans:
    """64-bit hashes of byte ranges of one array, from prefix sums."""

    def __init__(self, data: np.ndarray):
        powers = np.full(len(data) + 1, _MUL, np.uint64)
        powers[0] = 1
        inverse = np.full(len(data) + 1, _U(pow(int(_MUL), -1, 1 << 64)), np.uint64)
        inverse[0] = 1
        self.back = np.cumprod(inverse)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + _U(1)) * np.cumprod(powers)[:-1], dtype=np.uint64)))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64) * _MIX)


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _bytes(value) -> np.ndarray:
    return np.frombuffer(value or b"", np.uint8)


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchor rows (h, ctx, k, pos, fresh); rows with fresh = false carry a covered span (pos, ctx = end) instead."""
    for batch in batches:
        hs, cs, ks, ps = [], [], [], []
        for k, text in zip(batch["_k"].to_pylist(), batch["_b"].to_pylist(), strict=True):
            data = _bytes(text)
            at, h = anchors(data)
            if not len(at):
                continue
            left, right = np.minimum(at, REACH), np.minimum(at + LENGTH, len(data))
            spans = _Spans(data)
            hs.append(h)
            cs.append(spans(at - left, right) ^ _mixed(left.astype(np.uint64)))
            ps.append(at)
            ks.append(np.full(len(at), k, np.int64))
        if not hs:
            continue
        h, c, k, p = map(np.concatenate, (hs, cs, ks, ps))
        o = np.lexsort((p, k, c, h))
        h, c, k, p = h[o], c[o], k[o], p[o]
        again = np.concatenate(([False], (h[1:] == h[:-1]) & (c[1:] == c[:-1])))
        yield _batch(h=_signed(h[~again]), ctx=_signed(c[~again]), k=k[~again], pos=p[~again], fresh=np.ones((~again).sum(), bool))
        if again.any():
            k, p = k[again], p[again]
            o = np.lexsort((p, k))
            k, p = k[o], p[o]
            cut = np.concatenate(([True], (k[1:] != k[:-1]) | (p[1:] - REACH > p[:-1] + LENGTH)))
            end = p[np.concatenate((np.flatnonzero(cut)[1:] - 1, [len(p) - 1]))] + LENGTH
            k, p = k[cut], np.maximum(p[cut] - REACH, 0)
            yield _batch(h=_signed(_mixed(k.view(np.uint64) + p.view(np.uint64) * _MIX)), ctx=end, k=k, pos=p, fresh=np.zeros(len(k), bool))


def _first_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (h, fresh, ctx, k, pos): covered spans, and the first row of each context whose anchor has others."""
    held = None  # the last context's first row: (h, ctx, k, pos, shares its anchor)

    def out(h, k, start, end, open_):
        return _batch(h=h, k=k, start=start, end=end, open=open_)

    for batch in batches:
        h, c, k, p, fresh = (batch[x].to_numpy(zero_copy_only=False) for x in ("h", "ctx", "k", "pos", "fresh"))
        if (~fresh).any():
            yield out(h[~fresh], k[~fresh], p[~fresh], c[~fresh], np.zeros((~fresh).sum(), bool))
        h, c, k, p = h[fresh], c[fresh], k[fresh], p[fresh]
        if not len(h):
            continue
        shares = False
        if held:
            h, c, k, p = (np.concatenate(([v], x)) for v, x in zip(held, (h, c, k, p), strict=False))
            shares = held[4]
        new_h = np.concatenate(([True], h[1:] != h[:-1]))
        new_c = new_h | np.concatenate(([True], c[1:] != c[:-1]))
        if (~new_c).any():
            yield out(h[~new_c], k[~new_c], np.maximum(p[~new_c] - REACH, 0), p[~new_c] + LENGTH, np.zeros((~new_c).sum(), bool))
        i = np.flatnonzero(new_c)
        alone = new_h[i].copy()
        if shares:
            alone[0] = False
        many = ~alone
        many[:-1] |= ~new_h[i[1:]]
        held = (h[i[-1]], c[i[-1]], k[i[-1]], p[i[-1]], bool(many[-1]))
        i = i[:-1][many[:-1]]
        if len(i):
            yield out(h[i], k[i], p[i], p[i], np.ones(len(i), bool))
    if held and held[4]:
        yield out([held[0]], [held[2]], [held[3]], [held[3]], [True])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around each open anchor: (h, k, pos, left, body)."""
    for batch in batches:
        hs, ks, ps, ls, bs, size = [], [], [], [], [], 0
        for k, text, open_ in zip(batch["_k"].to_pylist(), batch["_b"].to_pylist(), batch["_open"], strict=True):
            for row in open_.as_py():
                p = row["pos"]
                left = min(p, REACH)
                body = text[p - left : p + LENGTH]
                hs.append(row["h"]), ks.append(k), ps.append(p), ls.append(left), bs.append(body)
                size += len(body)
            if size > 16 << 20:
                yield _batch(h=hs, k=ks, pos=ps, left=ls, body=bs)
                hs, ks, ps, ls, bs, size = [], [], [], [], [], 0
        if hs:
            yield _batch(h=hs, k=ks, pos=ps, left=ls, body=bs)


def covered_windows(h: np.ndarray, left: np.ndarray, bodies: list[bytes]) -> np.ndarray:
    """For contexts in ascending (key, position) order within each anchor h, a matrix [context, l]: does the
    window that starts l bytes before the anchor also occur with an earlier context of the same anchor?"""
    m = len(h)
    width = REACH + LENGTH
    raw = np.zeros((m, width), np.uint8)
    right = np.empty(m, np.int64)
    for i, (skip, body) in enumerate(zip((REACH - left).tolist(), bodies, strict=True)):
        raw[i, skip : skip + len(body)] = np.frombuffer(body, np.uint8)
        right[i] = skip + len(body) - REACH
    powers = np.cumprod(np.concatenate(([_U(1)], np.full(CELL - 1, _MUL, np.uint64))))
    cells = np.zeros((m, 9), np.uint64)
    for j in range(9):
        if j != 4:
            at = j * CELL if j < 4 else REACH + GRAM + (j - 5) * CELL
            cells[:, j] = _mixed(((raw[:, at : at + CELL].astype(np.uint64) + _U(1)) * powers).sum(axis=1, dtype=np.uint64))
    cells[:, 4] = h.view(np.uint64)
    there = np.ones((m, 9), bool)
    for j in range(4):
        there[:, j] = left >= (4 - j) * CELL
        there[:, 5 + j] = right >= GRAM + (j + 1) * CELL
    # one string: the cells of each context, then a separator of its own, the separators descending
    ranks = np.zeros((m, 10), np.int64)
    _, inverse = np.unique(cells, return_inverse=True)
    ranks[:, :9] = inverse.reshape(m, 9) + m
    ranks[:, 9] = np.arange(m)[::-1]
    keep = np.concatenate((there, np.ones((m, 1), bool)), axis=1)
    text = ranks[keep]
    owner = np.repeat(np.arange(m), 10)[keep.ravel()]
    column = np.tile(np.arange(10), m)[keep.ravel()]
    order = suffix_array(text)
    padded = np.concatenate((text, np.full(10, -1)))
    same = [padded[order[1:] + j] == padded[order[:-1] + j] for j in range(8)]
    result = np.zeros((m, REACH + 1), bool)
    for l in range(REACH + 1):
        full, cut = divmod(l, CELL)
        back = 4 - full - (cut > 0)
        shared = np.ones(len(order) - 1, bool)
        for j in range(full + 1 + back):
            shared &= same[j]
        run = np.cumsum(np.concatenate(([True], ~shared)))
        pick = (column[order] == 4 - full) & (left[owner[order]] >= l) & (right[owner[order]] >= LENGTH - l)
        pick &= np.concatenate((shared, [False])) | np.concatenate(([False], shared))
        if not pick.any():
            continue
        run, who = run[pick], owner[order[pick]]
        parts = [run]
        if cut:
            ends = np.zeros((len(who), 24), np.uint8)
            ends[:, :cut] = raw[who, REACH - l : REACH - l + cut]
            tail = REACH + GRAM + back * CELL
            ends[:, cut:CELL] = raw[who, tail : tail + CELL - cut]
            parts += list(ends.view(np.uint64).T)
        o = np.lexsort((who, *parts))
        twin = np.ones(len(o) - 1, bool)
        for x in parts:
            twin &= x[o[1:]] == x[o[:-1]]
        result[who[o[1:][twin]], l] = True
    return result


def _runs(rows: list) -> pa.RecordBatch | None:
    """Spans of covered windows of contexts (h, k, pos, left, body)."""
    h, k, pos, left = (np.array(x, np.int64) for x in list(zip(*rows, strict=True))[:4])
    hit = covered_windows(h, left, [r[4] for r in rows])
    edge = np.diff(np.concatenate((np.zeros((len(h), 1), np.int8), hit.astype(np.int8), np.zeros((len(h), 1), np.int8)), axis=1), axis=1)
    (i, a), (_, b) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    return _batch(k=k[i], start=pos[i] - (b - 1), end=pos[i] - a + LENGTH) if len(i) else None


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffix arrays over blocks of whole anchor groups, from contexts sorted by (h, k, pos)."""
    block: list = []
    for batch in batches:
        for row in zip(*(batch[x].to_pylist() for x in ("h", "k", "pos", "left", "body")), strict=True):
            if len(block) >= BLOCK and row[0] != block[-1][0]:
                if out := _runs(block):
                    yield out
                block = []
            block.append(row)
    if block and (out := _runs(block)):
        yield out


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of a context: two hashes of it, its document and start."""
    for batch in batches:
        for h, k, p, left, body in zip(*(batch[x].to_pylist() for x in ("h", "k", "pos", "left", "body")), strict=True):
            data = _bytes(body)
            start = np.arange(len(data) - LENGTH + 1)
            if len(start):
                a = _Spans(data)(start, start + LENGTH)
                b = _Spans(data ^ np.uint8(0x5A))(start, start + LENGTH) ^ _U(h & (1 << 64) - 1)
                yield _batch(a=_signed(a), b=_signed(b), k=np.full(len(start), k), start=p - left + start)


_CONTEXT = "h long, k long, pos long, left long, body binary"


def covered_spans(keyed_docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(k, start, end): spans of repeated bytes, overlapping ones among them, of documents (_k, _b binary)."""
    rows = mapped(keyed_docs.select("_k", "_b"), _scan, "h long, ctx long, k long, pos long, fresh boolean")
    found = mapped(rows.repartition("h").sortWithinPartitions("h", "fresh", "ctx", "k", "pos"), _first_contexts, "h long, k long, start long, end long, open boolean")
    found = materialize(found, "anchors")
    covered = found.where("NOT open").select("k", "start", "end")
    opened = found.where("open")
    hot_keys = opened.groupBy("h").count().where(F.col("count") > hot).select("h")
    by_doc = opened.groupBy(F.col("k").alias("_k")).agg(F.collect_list(F.struct(F.col("start").alias("pos"), "h")).alias("_open"))
    contexts = mapped(keyed_docs.select("_k", "_b").join(by_doc, "_k").select("_k", "_b", "_open"), _contexts, _CONTEXT)
    if hot_keys.isEmpty():
        usual = contexts
    else:
        contexts, hot_keys = materialize(contexts, "contexts"), materialize(hot_keys, "hot")
        usual = contexts.join(hot_keys, "h", "left_anti").select("h", "k", "pos", "left", "body")
        windows = mapped(contexts.join(hot_keys, "h", "left_semi").select("h", "k", "pos", "left", "body"), _windows, "a long, b long, k long, start long")
        windows = materialize(windows, "windows")
        first = windows.groupBy("a", "b").agg(F.min(F.struct("k", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
        late = windows.join(first, ["a", "b"]).where(F.struct("k", "start") > F.col("first"))
        covered = covered.unionByName(late.select("k", "start", (F.col("start") + LENGTH).alias("end")))
    compared = mapped(usual.repartition("h").sortWithinPartitions("h", "k", "pos"), _compare, "k long, start long, end long")
    return covered.unionByName(compared)


def _on_characters(text: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans narrowed to whole UTF-8 characters."""
    inner = (np.frombuffer(text + b"\0", np.uint8) & 0xC0) == 0x80
    pairs = []
    for s, e in zip(start.tolist(), end.tolist(), strict=True):
        while s < e and inner[s]:
            s += 1
        while e > s and inner[e]:
            e -= 1
        if s < e:
            pairs.append((s, e))
    return np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)


def _cut(text: bytes, start: np.ndarray, end: np.ndarray) -> bytes:
    at = [0, *np.ravel(np.column_stack((start, end))).tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(at[::2], at[1::2], strict=True))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, rewrite: bool = False, hot: int = HOT) -> DataFrame:
    """docs with _n_bytes, _n_removed, _n_spans, _kept_sha256 in place of the text; with `rewrite`, docs with the
    repeated strings cut out of the text instead (spans narrowed to whole characters, null texts stay null)."""
    made_names = (text_col,) if rewrite else (text_col, "_n_bytes", "_n_removed", "_n_spans", "_kept_sha256")
    source = docs.select(packed(docs, made_names), column(id_col).alias("_id"), column(text_col).alias("_t"))
    source = keyed(source, "_id", "_t").withColumn("_b", F.coalesce(F.col("_t"), F.lit("")).cast("binary"))
    spans = covered_spans(source, hot)
    by_doc = spans.groupBy(F.col("k").alias("_k")).agg(F.collect_list("start").alias("_s"), F.collect_list("end").alias("_e"))
    joined = source.select("_row", "_k", "_b", F.col("_t").isNull().alias("_null")).join(by_doc, "_k", "left")
    fields = "text string" if rewrite else "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema = joined.select("_row").schema
    for field in fields.split(", "):
        schema = schema.add(*field.split(" "))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, counts, digests, texts = [], [], [], [], []
            for i, text in enumerate(batch["_b"].to_pylist()):
                s, e = batch["_s"][i].values, batch["_e"][i].values
                start, end = merged(*(np.empty(0, np.int64) if x is None else x.to_numpy() for x in (s, e)))
                end = np.minimum(end, len(text))
                if rewrite:
                    start, end = _on_characters(text, start, end)
                    texts.append(_cut(text, start, end).decode("utf-8", "replace"))
                    continue
                sizes.append(len(text)), removed.append(int((end - start).sum())), counts.append(len(start))
                digests.append(hashlib.sha256(_cut(text, start, end)).hexdigest())
            if rewrite:
                made = [pa.array([None if gone else x for gone, x in zip(batch["_null"].to_pylist(), texts, strict=True)], pa.string())]
            else:
                made = [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays([batch["_row"], *made], names=schema.names)

    done = mapped(joined, finish, schema)
    if rewrite:
        return done.select(*[F.col("text").alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns])
    return done.select(*unpacked(docs, made_names), *[F.col(c).alias(f"_{c}") for c in schema.names[1:]])
