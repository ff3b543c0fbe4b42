"""SimHash near-duplicates: fingerprints of word shingles, pigeonhole blocks, Hamming verification.

A fingerprint is cut into six blocks. Two fingerprints that differ in at most three bits agree on at
least three whole blocks, so they meet under one of 20 keys, each of about 32 bits. Equal fingerprints
are one before that. A key with two fingerprints is verified in place; one with up to `most` goes to
a numpy check that sends back a spanning forest, never all pairs. A key with more is cut again: its
other bits are cut into six blocks, of which three agree; what is left under such a key are
at most 16 free bits, so at most 65,536 fingerprints, whatever the input.

Edge cases. Fewer words than a shingle: the whole sequence is the shingle. No word, empty or null
text: fingerprint zero, linked like any other. Repeated rows share a component. A null id never
becomes a component id unless its component has no other; ids may be of any type with an order. Other columns are
ignored; an empty table gives no rows.

similar_components() serves the rule "five-word shingles, similarity of 0.8 or more". The similarity that SimHash
estimates is the cosine of the shingle sets (the share of equal bits is 1 less their angle over pi), so that is what
is asked for: 0.8 or more, a Jaccard similarity of two thirds for sets of one size. SimHash groups, of sets within three
bits, are found first and as above. Texts at 0.8 differ in 13 of 64 bits, though, and pigeonhole blocks for these
would be of four bits. So texts at three bits or fewer are joined by SimHash, and for the others the same three steps (blocks,
join, verification) are taken with smallest hashes: 24 blocks of three minima over all shingles (a pair at 0.8
shares none with probability 0.0002) and 512 lanes, each a byte of the smallest hash that falls into it, from which
the similarity is estimated (standard error at most 0.016). The estimate only prunes: pairs within MARGIN of the rule are
decided by their whole shingle sets. Blocks that many fingerprints share are worked off in chunks that all meet; see _shrink.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, mapped, materialize
from .components import connected_components

MOST = 4096
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, shingle: int = 5) -> np.ndarray:
    """XXH64 (seed 42) of each shingle, repeats included; of the whole sequence if it is shorter; none if there is no word."""
    words = text.lower().split()
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, 42)] if words else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1].tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)], np.uint64)


def fingerprint(text: bytes, shingle: int = 5) -> int:
    """64 bits, each 1 if it is set in over half the shingles' XXH64 (seed 42)."""
    return majority(shingle_hashes(text, shingle))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    if len(h) < 2:
        return int(h[0]) if len(h) else 0
    groups = np.arange(0, len(h), 255)
    bits = np.empty((8, 8), np.int64)
    for k in range(8):  # lane i of the sums counts bit 8 * i + k
        bits[:, k] = np.add.reduceat((h >> np.uint64(k)) & _LANES, groups).view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits.ravel() * 2 > len(h), bitorder="little").tobytes(), "little")


def with_fingerprint(docs: DataFrame, text_col: str = "text", shingle: int = 5, name: str = "_fp") -> DataFrame:
    """docs without its text, with the fingerprint as a signed long."""
    kept = [c for c in docs.columns if c != text_col]
    source = docs.select(*kept, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(b, shingle) for b in batch["_b"].to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(found)], names=[*kept, name])

    return mapped(source, run, docs.select(*kept).withColumn(name, F.lit(0).cast("long")).schema)


def _masks(free: list[int]) -> list[int]:
    """Masks over every three of six blocks of the free bits."""
    blocks = [sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(free), 6)]
    return [a | b | c for a, b, c in combinations(blocks, 3)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


FIRST = _masks(list(range(64)))
SECOND = {m: _masks([b for b in range(64) if not m >> b & 1]) for m in FIRST}


def _keys(fps: DataFrame) -> DataFrame:
    keys = F.array(*[F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for m in FIRST])
    return fps.select("fp", F.explode(keys).alias("x")).select("fp", "x.mask", "x.key")


def _finer(keys: DataFrame) -> DataFrame:
    table = F.create_map(*[x for m in FIRST for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(m | s)) for s in SECOND[m]]))])
    return keys.select("fp", F.explode(table[F.col("mask")]).alias("mask")).select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))


def near_links(values: np.ndarray, distance: int = 3) -> list[tuple[int, int]]:
    """A spanning forest of the links between distinct fingerprints at most `distance` bits apart."""
    n, root, links = len(values), list(range(len(values))), []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    bits = values.view(np.uint64)
    for i in range(n - 1):
        for j in np.flatnonzero(np.bitwise_count(bits[i + 1 :] ^ bits[i]) <= distance) + i + 1:
            a, b = top(i), top(int(j))
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((int(values[i]), int(values[j])))
    return links


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [x for row in batch["fps"] for x in near_links(np.unique(row.values.to_numpy()))]
        if found:
            yield pa.RecordBatch.from_pydict({"u": pa.array([x[0] for x in found], pa.int64()), "v": pa.array([x[1] for x in found], pa.int64())})


def _level(keys: DataFrame, most: int | None) -> tuple[DataFrame, DataFrame]:
    """(links under keys with 2 to `most` fingerprints, the keyed rows of larger keys)."""
    sizes = keys.groupBy("mask", "key").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1")
    sizes = materialize(sizes, "blocks")
    twos = sizes.where("n = 2 AND bit_count(u ^ v) <= 3").select("u", "v")
    usual = sizes.where("n > 2" + (f" AND n <= {most}" if most else "")).select("mask", "key")
    groups = keys.join(usual, ["mask", "key"]).groupBy("mask", "key").agg(F.collect_list("fp").alias("fps")).select("fps")
    links = twos.unionByName(mapped(groups, _verify, "u long, v long"))
    return links, keys.join(sizes.where(f"n > {most}").select("mask", "key"), ["mask", "key"], "left_semi") if most else None


def links(fps: DataFrame, most: int = MOST) -> DataFrame:
    """Pairs (u, v) of distinct fingerprints `fp` that together span every group linked at three bits or fewer."""
    found, large = _level(_keys(fps), most)
    if large.isEmpty():
        return found
    return found.unionByName(_level(_finer(materialize(large, "large-blocks")), None)[0])


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, most: int = MOST) -> DataFrame:
    """(id, fingerprint as 16 hexadecimal digits, component_id: the smallest id reachable)."""
    docs = docs.select(column(id_col).alias("_id"), column(text_col).alias("_t"))
    prints = materialize(with_fingerprint(docs, "_t", shingle), "fingerprints")
    distinct = prints.groupBy(F.col("_fp").alias("fp")).agg(F.min("_id").alias("low"))
    roots = connected_components(links(distinct.select("fp"), most))
    labelled = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = labelled.groupBy("root").agg(F.min("low").alias("component_id"))
    named = labelled.join(lows, "root").select(F.col("fp").alias("_fp"), "component_id")
    return prints.join(named, "_fp").select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Blocks of the similarity fingerprint, minima in a block, and lanes.
BLOCKS, ROWS, LANES = 24, 3, 512
#: Estimates this far from the rule decide a pair, if so many lanes are in use; with fewer none links and SMALL_MARGIN dismisses.
MARGIN, LEAST_LANES, SMALL_MARGIN = 0.08, 64, 0.3
#: Most bytes of shingle sets in a part of a group that is decided by them; two parts meet at a time.
PART = 16 << 20
_FACTORS = np.array([xxhash.xxh64_intdigest(b"factor %d" % i) | 1 for i in range(BLOCKS * ROWS)], np.uint64)


def sketch(h: np.ndarray) -> np.ndarray:
    """The lanes of ascending distinct hashes: a byte of the smallest in each, 0 where none fell."""
    lanes = np.zeros(LANES, np.uint8)
    places, first = np.unique((h >> np.uint64(55)).astype(np.int64), return_index=True)
    lanes[places] = (h[first] % np.uint64(255) + np.uint64(1)).astype(np.uint8)
    return lanes


def minima(text: bytes, shingle: int = 5) -> tuple[int, list[int], bytes, int, int]:
    """(fingerprint of the shingle set, its blocks' keys, its lanes, its size, its SimHash)."""
    h = np.unique(shingle_hashes(text, shingle))
    if not len(h):
        return 0, [0] * BLOCKS, bytes(LANES), 0, 0
    low = np.array([(h * f).min() for f in _FACTORS], np.uint64).astype("<u8").tobytes()
    keys = [xxhash.xxh64_intdigest(low[8 * ROWS * b : 8 * ROWS * (b + 1)], b) for b in range(BLOCKS)]
    return xxhash.xxh64_intdigest(h.tobytes(), 0), keys, sketch(h).tobytes(), len(h), majority(h)


def _with_minima(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [minima(b, shingle) for b in batch["_b"].to_pylist()]
            prints, simhashes = (np.array([x[i] for x in found], np.uint64).view(np.int64) for i in (0, 4))
            keys = np.array([x[1] for x in found], np.uint64).reshape(-1).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * BLOCKS), pa.array(keys))
            yield pa.RecordBatch.from_arrays([batch[id_col], pa.array(prints), lists, pa.array([x[2] for x in found], pa.binary()), pa.array([x[3] for x in found], pa.int32()), pa.array(simhashes)], names=[id_col, "fp", "keys", "lanes", "size", "simhash"])

    source = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_b"))
    return mapped(source, run, docs.select(id_col).withColumns({"fp": F.lit(0).cast("long"), "keys": F.array(F.lit(0).cast("long")), "lanes": F.lit(b""), "size": F.lit(0), "simhash": F.lit(0).cast("long")}).schema)


def _cosine(both: np.ndarray, sizes: np.ndarray, size: int) -> np.ndarray:
    """Cosine of sets of given sizes with `both` members in common."""
    return both / np.maximum(np.sqrt(sizes.astype(np.float64) * size), 1e-9)


def _estimates(others: np.ndarray, sizes: np.ndarray, lanes: np.ndarray, size: int, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Estimated similarity of each of the others to one, and whether it surely is or may be similar enough."""
    union = np.count_nonzero(others | lanes, axis=1)
    jaccard = np.count_nonzero((others == lanes) & (others != 0), axis=1) / np.maximum(union, 1)
    guess = _cosine(jaccard / (1 + jaccard) * (sizes.astype(np.float64) + size), sizes, size)
    enough = union >= LEAST_LANES
    return guess, enough & (guess >= similarity + MARGIN), (union > 0) & (guess >= similarity - np.where(enough, MARGIN, SMALL_MARGIN))


def similar_links(lanes: np.ndarray, sizes: np.ndarray, similarity: float, trees: np.ndarray, sure: bool) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(pairs that surely are, or may be, similar enough and join `trees` to larger ones, the larger tree of each member)."""
    left, found, joined = np.arange(len(lanes)), [], np.empty(len(lanes), np.int64)
    while len(left):
        first = left[0]
        joined[first], todo, left = first, [first], left[1:]
        while todo and len(left):
            a = todo.pop()
            known = trees[left] == trees[a]
            hit = _estimates(lanes[left], sizes[left], lanes[a], sizes[a], similarity)[1 if sure else 2] & ~known
            found += [(int(a), int(b)) for b in left[hit]]
            joined[left[hit | known]] = first
            todo += left[hit | known].tolist()
            left = left[~(hit | known)]
    return found, joined


def _unsure(prints: np.ndarray, sizes: np.ndarray, trees: np.ndarray, loose: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number, fingerprints, their trees) of each group of trees that may be one; the same members have the same number."""
    for head in np.unique(loose):
        at = np.flatnonzero(loose == head)
        if len(np.unique(trees[at])) < 2:
            continue
        at = at[np.argsort(prints[at])]
        _, tree = np.unique(trees[at], return_inverse=True)
        low = np.full(tree.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, tree, prints[at])
        part = np.cumsum(sizes[at].astype(np.int64) * 8) // PART
        parts = np.unique(part).tolist()
        for some in combinations(parts, 2) if len(parts) > 1 else [parts]:
            those = np.isin(part, some)
            fps, low_of = prints[at][those], low[tree][those]
            yield xxhash.xxh64_intdigest(np.concatenate((fps, low_of)).tobytes(), 0), fps, low_of


def _forests(groups: DataFrame, similarity: float) -> DataFrame:
    """(u, v, null) for each sure link of the groups' forests; (fp, tree, number) for each member of trees that may be one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members in batch["members"]:
                prints, trees, sizes = (members.values.field(c).to_numpy() for c in ("fp", "tree", "size"))
                lanes = np.frombuffer(b"".join(members.values.field("lanes").to_pylist()), np.uint8).reshape(-1, LANES)
                found, joined = similar_links(lanes, sizes, similarity, trees, True)
                u, v, n = prints[[a for a, _ in found]].tolist(), prints[[b for _, b in found]].tolist(), [None] * len(found)
                if joined.any():
                    for number, fps, tree in _unsure(prints, sizes, joined, similar_links(lanes, sizes, similarity, joined, False)[1]):
                        u += fps.tolist()
                        v += tree.tolist()
                        n += [_signed(number)] * len(fps)
                yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "unsure": pa.array(n, pa.int64())})

    return mapped(groups.select("members"), run, "u long, v long, unsure long")


def exact_links(prints: np.ndarray, trees: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs whose shingle sets are similar enough and that join the trees; the likeliest are compared first."""
    lanes, sizes = np.array([sketch(h) for h in sets]).reshape(-1, LANES), np.array([len(h) for h in sets], np.int64)
    guesses, ones, others = [], [], []
    for i in range(len(sets) - 1):
        guess, _, may = _estimates(lanes[i + 1 :], sizes[i + 1 :], lanes[i], sizes[i], similarity)
        hit = np.flatnonzero(may & (trees[i + 1 :] != trees[i]))
        guesses.append(guess[hit].astype(np.float32))
        ones.append(np.full(len(hit), i, np.int32))
        others.append((hit + i + 1).astype(np.int32))
    root, found = {t: t for t in trees.tolist()}, []

    def top(t: int) -> int:
        while root[t] != t:
            root[t] = root[root[t]]
            t = root[t]
        return t

    if guesses:
        order = np.argsort(-np.concatenate(guesses), kind="stable")
        for i, j in zip(np.concatenate(ones)[order].tolist(), np.concatenate(others)[order].tolist(), strict=True):
            a, b = top(int(trees[i])), top(int(trees[j]))
            if a != b:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both * both >= similarity * similarity * sizes[i] * sizes[j] * (1 - 1e-12):
                    root[max(a, b)] = min(a, b)
                    found.append((int(prints[i]), int(prints[j])))
    return found


def _exact(unsure: DataFrame, docs: DataFrame, lows: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """Links (u, v) by whole shingle sets in the groups (fp, tree, unsure); only their texts (by lows: fp, low) are read again."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingle_hashes(b, shingle)).astype("<u8").tobytes() for b in batch["_b"].to_pylist()]
            prints = np.array([xxhash.xxh64_intdigest(b, 0) for b in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(prints), pa.array(found, pa.binary())], names=["fp", "set"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members in batch["members"]:
                prints, first = np.unique(members.values.field("fp").to_numpy(), return_index=True)
                trees, whole = members.values.field("tree").to_numpy()[first], members.values.field("set")
                found = exact_links(prints, trees, [np.frombuffer(whole[i].as_py(), "<u8") for i in first.tolist()], similarity)
                yield pa.RecordBatch.from_pydict({"u": pa.array([a for a, _ in found], pa.int64()), "v": pa.array([b for _, b in found], pa.int64())})

    ids = materialize(lows.join(unsure.select("fp").distinct(), "fp", "left_semi").select("low").distinct(), "unsure-ids")
    texts = docs.join(ids, docs[id_col].eqNullSafe(ids.low), "left_semi").select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_b"))
    members = unsure.join(mapped(texts, sets, "fp long, set binary"), "fp").groupBy("unsure").agg(F.collect_list(F.struct("fp", "tree", "set")).alias("members"))
    return mapped(members.select("members"), decide, "u long, v long")


def _gather(rows: DataFrame, lanes: DataFrame, *chunk: str) -> DataFrame:
    return rows.join(lanes, "fp").groupBy("block", "key", *chunk).agg(F.collect_list(F.struct("fp", "tree", "lanes", "size")).alias("members"))


def _chunk(n: Column, most: int) -> Column:
    """A chunk for each fingerprint of a key, of about most / 2 of the key's n fingerprints."""
    return F.pmod(F.xxhash64("fp", "block"), F.ceil(n * 2 / most))


def _shrink(rows: DataFrame, lanes: DataFrame, similarity: float, most: int) -> DataFrame:
    """Sure links, and groups of trees that may be one, as _forests gives them, under keys (block, key) of the rows (block, key, fp).

    Keys of up to `most` fingerprints are verified at once. Larger ones are dealt into chunks by a hash of
    fingerprint and block, and each chunk's trees are linked. Of what these links connect, each key's largest
    tree is known to be one; every other member of the key, not a head alone, then meets all members, so no pair is
    left out. Chunks of the largest tree need not meet each other, so the cost is the key's size times what is
    outside that tree: in proportion for large groups of near copies, the square where most are unlike.
    """
    rows = materialize(rows, "rows")
    sizes = rows.groupBy("block", "key").agg(F.count("*").alias("n")).where("n > 1")
    sized = rows.join(sizes, ["block", "key"]).withColumn("tree", F.col("fp"))
    out = _forests(_gather(sized.where(F.col("n") <= most), lanes), similarity)
    large = materialize(sized.where(F.col("n") > most), "large-keys")
    if large.isEmpty():
        return out
    in_chunks = _forests(_gather(large.withColumn("chunk", _chunk(F.col("n"), most)), lanes, "chunk"), similarity)
    out = materialize(out.unionByName(in_chunks.where("unsure IS NULL")), "links")
    roots = connected_components(out.where("unsure IS NULL").select("u", "v"))
    known = large.drop("tree").join(roots, large.fp == roots.node, "left").select("block", "key", "fp", "n", F.coalesce("root", "fp").alias("tree"))
    known = materialize(known, "known")
    trees = known.groupBy("block", "key", "tree").agg(F.count("*").alias("c"), F.first("n").alias("n"))
    largest = trees.groupBy("block", "key").agg(F.max(F.struct("c", "tree")).alias("top"), F.first("n").alias("n")).where("top.c < n")
    parts = largest.select("block", "key", F.col("top.tree").alias("top"), F.ceil((F.col("n") - F.col("top.c")) * 2 / most).alias("rest_chunks"), F.ceil(F.col("top.c") * 2 / most).alias("top_chunks"))
    placed = known.drop("n").join(parts, ["block", "key"])
    hashed, is_top = F.xxhash64("fp", "block"), F.col("tree") == F.col("top")
    placed = placed.withColumn("chunk", F.when(is_top, F.col("rest_chunks") + F.pmod(hashed, F.col("top_chunks"))).otherwise(F.pmod(hashed, F.col("rest_chunks"))))
    last = F.when(is_top, F.col("rest_chunks")).otherwise(F.col("rest_chunks") + F.col("top_chunks")) - 1
    meet = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last))).where("chunk <> other")
    pairs = meet.select("block", "key", "fp", "tree", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"))
    return out.unionByName(_forests(_gather(pairs, lanes, "a", "b"), similarity))


def _simhash_links(distinct: DataFrame, most: int) -> DataFrame:
    """Links (u, v) of the sets `fp` whose SimHashes (over each shingle once) differ in at most three bits."""
    shared = materialize(distinct.where("size > 0").groupBy("simhash").agg(F.min("fp").alias("u"), F.count("*").alias("n")), "simhashes")
    same = distinct.where("size > 0").join(shared.where("n > 1").select("simhash", "u"), "simhash").select("u", F.col("fp").alias("v")).where("u <> v")
    near = links(shared.select(F.col("simhash").alias("fp")), most)
    near = near.join(shared.select(F.col("simhash").alias("u"), F.col("u").alias("a")), "u").join(shared.select(F.col("simhash").alias("v"), F.col("u").alias("b")), "v")
    return same.unionByName(near.select(F.col("a").alias("u"), F.col("b").alias("v")))


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, most: int = MOST) -> DataFrame:
    """(id, component_id: the smallest id reachable by links of texts whose shingle sets are similar, by cosine).

    Texts without a word are alike, and like no other; null ids and repeated rows as in components().
    """
    docs = docs.select(column(id_col).alias("_id"), column(text_col).alias("_t"))
    prints = materialize(_with_minima(docs, "_id", "_t", shingle), "minima")
    distinct = materialize(prints.groupBy("fp").agg(F.min("_id").alias("low"), *[F.first(c).alias(c) for c in ("keys", "lanes", "size", "simhash")]), "distinct")
    keys = distinct.select("fp", F.posexplode("keys").alias("block", "key"))
    made = materialize(_shrink(keys.select("block", "key", "fp"), distinct.select("fp", "lanes", "size"), similarity, most), "made")
    linked = made.where("unsure IS NULL").select("u", "v").unionByName(_simhash_links(distinct.select("fp", "simhash", "size"), most))
    unsure = materialize(made.where("unsure IS NOT NULL").select(F.col("u").alias("fp"), F.col("v").alias("tree"), "unsure").distinct(), "unsure")
    if not unsure.isEmpty():
        linked = linked.unionByName(_exact(unsure, docs, distinct.select("fp", "low"), "_id", "_t", shingle, similarity))
    roots = connected_components(linked)
    labelled = distinct.select("fp", "low").join(roots, distinct.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = labelled.groupBy("root").agg(F.min("low").alias("component_id"))
    return prints.select("_id", "fp").join(labelled.join(lows, "root").select("fp", "component_id"), "fp").select(F.col("_id").alias(id_col), "component_id")
