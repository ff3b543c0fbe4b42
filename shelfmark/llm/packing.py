"""Best-fit packing of documents into sequences, large items matched first.

Only the histogram of lengths reaches the driver (one count a length, so at most `capacity` numbers).
Items over a third of the capacity are matched greedily, each with the longest that still fits, at most
two to a bin; the others, longest first, go where they leave the least room. This is done for counts of
items, not for items: a step fills whole ranges of bins, so the plan has a bounded number of steps
whatever the input. Items find their place in it by their rank among those of their length, which
is counted in hash buckets, so that a common length is not one task's.

Edge cases. A null or empty text is its end token alone; repeated rows are packed each; ids may be
null; an empty table gives no rows. Longer documents are cut into full pieces, the first one shorter.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held, mapped, materialize
from .token_counts import byte_symbols

#: Most strings that a worker keeps the ids of, and the longest such string in characters.
KEPT, KEPT_LENGTH = 400_000, 64
PER_BUCKET = 100_000


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit numbers, as the tokenizers library gives them.

    The vocabulary's pattern never joins a character to white space after it, so a text is encoded
    by parts (white space and what follows it) and known parts are looked up. New parts are encoded
    from the same file's merges by the tiktoken library, which gives the same ids and costs less for
    short strings; texts with special strings go to the tokenizers library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        special = {t["content"] for t in file["added_tokens"]}
        ids = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        # the merges stand in the order of their results' ids, which the byte-pair merger takes as ranks
        results = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        assert results == sorted(results), "the merges' order differs from the ids'"
        self.merger = tiktoken.Encoding("merges", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ids, special_tokens={})
        self.tokenizer = Tokenizer.from_file(path)
        self.sizes = np.zeros(max(ids.values()) + 1, np.int64)
        self.sizes[list(ids.values())] = [len(b) for b in ids]
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # texts with special strings, or with what only Python takes as white space, are encoded whole
        self.whole = re.compile("|".join(["[\x1c-\x1f]", *map(re.escape, special)]))
        self.parts = re.compile(r"\s*\S+|\s+")
        self.known: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _merged(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of parts. Those of one space and what follows it are merged as one string and told apart by their bytes."""
        encode = self.merger.encode_ordinary
        row = [p for p in parts if p[0] == " " and len(p) > 1 and not p[1].isspace()]
        found: dict[str, bytes] = {}
        if row:
            ids = np.array(encode("".join(row)), "<u4")
            ends = np.cumsum(self.sizes[ids])
            wanted = np.cumsum(np.fromiter((len(p.encode()) for p in row), np.int64, len(row)))
            last = np.searchsorted(ends, wanted)
            if (ends[np.minimum(last, len(ends) - 1)] == wanted).all():
                cuts, data = (4 * np.concatenate(([0], last + 1))).tolist(), ids.tobytes()
                found = {p: data[a:b] for p, a, b in zip(row, cuts, cuts[1:], strict=False)}
        return found | {p: array("I", encode(p)).tobytes() for p in parts if p not in found}

    def texts(self, texts: list[str]) -> list[bytes]:
        whole = [i for i, t in enumerate(texts) if self.whole.search(t)]
        done = dict(zip(whole, self._library([texts[i] for i in whole]), strict=True)) if whole else {}
        split = [[] if i in done else self.parts.findall(t) for i, t in enumerate(texts)]
        known = self.known
        fresh = [p for p in dict.fromkeys(chain.from_iterable(split)) if p not in known]
        if len(known) + len(fresh) > KEPT:
            known.clear()
            fresh = list(dict.fromkeys(chain.from_iterable(split)))
        found = self._merged(fresh)
        known.update((p, x) for p, x in found.items() if len(p) <= KEPT_LENGTH)
        odd = any(len(p) > KEPT_LENGTH for p in fresh)
        of = (lambda p: found.get(p) or known[p]) if odd else known.__getitem__
        return [done[i] if i in done else b"".join(map(of, parts)) for i, parts in enumerate(split)]


def pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, text_col: str = "text") -> DataFrame:
    """docs without the text, a row for each piece: piece, start, length, ids_crc32."""
    kept = [c for c in docs.columns if c != text_col]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held(("encoder", path), lambda: Encoder(path))
        for batch in batches:
            texts = [x or "" for x in batch[text_col].to_pylist()]
            rows, i = [], 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and size < 1 << 20:
                    size += len(texts[j])
                    j += 1
                for k, ids in zip(range(i, j), encoder.texts(texts[i:j]), strict=True):
                    ids += end
                    n = len(ids) // 4
                    cuts = [0, *range(n % capacity or capacity, n, capacity), n]
                    rows += [(k, p, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
                i = j
            if rows:
                of, piece, start, length, crc = map(list, zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([*(batch[c].take(pa.array(of)) for c in kept), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=[*kept, "piece", "start", "length", "ids_crc32"])

    schema = docs.select(*kept).withColumns({"piece": F.lit(0)} | {c: F.lit(0).cast("long") for c in ("start", "length", "ids_crc32")}).schema
    return mapped(docs, run, schema, ("encoder", path))


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Steps (length, first rank, number, first bin, number in a bin, place in the bin) that place all items."""
    left, rank, steps = dict(counts), defaultdict(int), []
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)
    bins = 0

    def put(size: int, n: int, first: int, each: int, offset: int) -> None:
        steps.append((size, rank[size], n, first, each, offset))
        rank[size] += n
        left[size] -= n

    large = sorted((s for s in counts if 3 * s > capacity), reverse=True)
    for s in large:
        while left[s]:
            mate = next((t for t in large if t <= min(s, capacity - s) and left[t] > (t == s)), None)
            if mate is None:
                n = left[s]
                put(s, n, bins, 1, 0)
                room[capacity - s].append((bins, n))
            elif mate == s:
                n = left[s] // 2
                put(s, 2 * n, bins, 2, 0)
                room[capacity - 2 * s].append((bins, n))
            else:
                n = min(left[s], left[mate])
                put(s, n, bins, 1, 0)
                put(mate, n, bins, 1, s)
                room[capacity - s - mate].append((bins, n))
            bins += n
    for s in sorted((s for s in counts if 3 * s <= capacity), reverse=True):
        while left[s]:
            gap = next((g for g in range(s, capacity + 1) if room.get(g)), None)
            if gap is None:
                gap, n = capacity, -(-left[s] // (capacity // s))
                room[capacity].append((bins, n))
                bins += n
            first, n = room[gap].pop()
            each = gap // s
            full = min(n, left[s] // each)
            if full:
                put(s, full * each, first, each, capacity - gap)
                room[gap - each * s].append((first, full))
            if full < n:
                rest = min(left[s], each)
                if rest:
                    put(s, rest, first + full, rest, capacity - gap)
                    room[gap - rest * s].append((first + full, 1))
                    full += 1
                if full < n:
                    room[gap].append((first + full, n - full))
    return steps


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) for each piece."""
    items = materialize(pieces(docs.select(id_col, text_col), path, capacity, end_id, text_col), "pieces")
    buckets = -(-items.count() // PER_BUCKET) or 1
    items = items.withColumn("_bucket", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(buckets)))
    sizes = items.groupBy("_bucket", "length").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = materialize(sizes.withColumn("_before", F.coalesce(F.sum("_n").over(ahead), F.lit(0))), "lengths")
    steps = plan({r[0]: r[1] for r in sizes.groupBy("length").agg(F.sum("_n")).collect()}, capacity)
    table = np.array(sorted(steps), np.int64).reshape(-1, 6)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    within = Window.partitionBy("_bucket", "length").orderBy(id_col, "piece", "ids_crc32")
    ranked = items.withColumn("_rank", F.row_number().over(within) - 1).join(sizes.drop("_n"), ["_bucket", "length"])
    ranked = ranked.select(id_col, "piece", "start", "length", "ids_crc32", (F.col("_rank") + F.col("_before")).alias("_rank"))
    names = [id_col, "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        wide = int(table[:, 1].max()) + 1 if len(table) else 1
        keys = table[:, 0] * wide + table[:, 1]
        for batch in batches:
            size, rank = batch["length"].to_numpy(), batch["_rank"].to_numpy()
            row = table[np.searchsorted(keys, size * wide + np.minimum(rank, wide - 1), "right") - 1]
            at = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(row[:, 3] + at // row[:, 4]), pa.array(row[:, 5] + at % row[:, 4] * size)], names=[*names, "sequence_id", "offset"])

    return mapped(ranked, place, ranked.drop("_rank").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema)
