"""Language-model scores from a hashed maximum-entropy model with class-factored softmax.

A token's probability is P(class | history) * P(subclass | class, history) * P(token | subclass, history): three
softmaxes over a bias and hashed features of the history. The features are the token before, the two tokens before, and
the token before the last one (a skip); the class sees all three, the finer softmaxes the n-grams. The classes of the
most frequent tokens (the head, a bounded number) are runs of the tokens in the order of their endings. Any other
token's class is given by its CRC-32, unknown tokens' too, and within that class it has its smoothed frequency, so a
text's probability is a proper one.

Counts cover all training texts. Weights are trained by distributed gradient updates. A round's gradient of the
log-likelihood is, for each weight, how often its feature was seen with its outcome less how often the model expects
that; each task sums it over its own texts, parts of the tables are added up on the executors in two steps (so that
no reducer hears from every task), and each weight goes along its gradient, scaled by the expectation and damped by a
logarithm. The first round starts from the frequencies, where the expectation needs no softmax: all its sums are
integers, so the model doesn't depend on how the texts are dealt to tasks. Only the weights, tables of fixed size,
reach the driver. Scoring is numpy over batches of sparse features. Counts of tokens outside the head reach the
texts by a join on the token, so nothing broadcast grows with the corpus.

Edge cases. A null or empty text is its end token alone; an empty training set leaves a
uniform model over one unknown token a class; repeated and null ids, and ids of any type, get a row each; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, column, keyed, mapped, materialize

#: Classes of the head and of all other tokens; subclasses of a class and tokens of a subclass at most; most tokens in the head.
HEAD_CLASSES, TAIL_CLASSES, WIDE = 24, 8, 64
CLASSES, HEAD = HEAD_CLASSES + TAIL_CLASSES, HEAD_CLASSES * WIDE * WIDE
#: Of each softmax the kinds of features, the nodes it is for, the hashed features of a kind for a node (a power of two), and the outcomes.
LEVELS = ((3, 1, 1 << 13, CLASSES), (2, HEAD_CLASSES, 1 << 10, WIDE), (2, HEAD_CLASSES * WIDE, 1 << 6, WIDE))
#: How far a weight goes along its gradient, and what is added to its expectation.
RATE, PRIOR = 0.6, 0.5
STEP = 4096
#: Parts of each table, and of the tasks, in which gradients are added up.
SLICES, PARTS = 16, 64
#: The end token, which no text can hold.
END = b"\n"
_U = np.uint64


class Vocabulary:
    """Head tokens with their classes and counts, and what is known of the whole vocabulary.

    A head token's place in the tree is its number: tokens are numbered by their endings, and each class and
    subclass is a run of numbers.
    """

    def __init__(self, head: list[tuple[bytes, int]], total: int, distinct: int, tails: dict[int, tuple[int, int]], levels: tuple = LEVELS):
        head.sort(key=lambda x: x[0][::-1])
        self.total, self.distinct, self.levels = total, distinct, levels
        self.ids = {w: i for i, (w, _) in enumerate(head)}
        self.counts = np.array([n for _, n in head], np.float64)
        self.per_class = max(1, -(-len(head) // HEAD_CLASSES))
        self.per_subclass = max(1, -(-self.per_class // WIDE))
        sums, members = np.zeros(CLASSES), np.zeros(CLASSES)
        for c, (n, v) in tails.items():
            sums[HEAD_CLASSES + c], members[HEAD_CLASSES + c] = n, v
        members[HEAD_CLASSES:] += 1  # for unknown tokens
        self.room = sums + 0.5 * members
        mass = [self.room.copy(), np.zeros((HEAD_CLASSES, WIDE)), np.zeros((HEAD_CLASSES * WIDE, WIDE))]
        c, s, t = self.path(np.arange(len(head)))
        for table, at in ((mass[0], c), (mass[1], (c, s)), (mass[2], (c * WIDE + s, t))):
            np.add.at(table, at, self.counts + 0.5)
        self.shares = [m.reshape(-1, m.shape[-1]) / np.maximum(m.sum(axis=-1, keepdims=True), 1e-300).reshape(-1, 1) for m in mass]
        with np.errstate(divide="ignore"):
            self.bias = [np.log(p).astype(np.float32) for p in self.shares]
        self.base_room = math.log10(total + 0.5 * (distinct + 1))
        self.base = np.log10(self.counts + 0.5)

    def path(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class, subclass in it and place in that of head tokens."""
        c, rest = np.divmod(ids, self.per_class)
        return c, *np.divmod(rest, self.per_subclass)

    def arrays(self, lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all texts' tokens in a row: ids (over the head: from the CRC-32), the CRC class of others, and where texts start."""
        get, size = self.ids.get, len(self.ids)
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = list(chain.from_iterable(lists))
        ids = np.fromiter(map(get, flat, repeat(-1)), np.int64, len(flat))
        rest = np.flatnonzero(ids < 0)
        crc = np.fromiter(map(zlib.crc32, itemgetter(*rest.tolist())(flat) if len(rest) > 1 else [flat[i] for i in rest]), np.int64, len(rest))
        ids[rest] = size + (crc & 0xFFFF)
        tail = np.zeros(len(ids), np.int64)
        tail[rest] = HEAD_CLASSES + crc % TAIL_CLASSES
        return ids, tail, np.cumsum(sizes) - sizes

    def outcomes(self, ids: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """(the class of each token, which are of the head, and for these the node and outcome of the finer softmaxes)."""
        head = np.flatnonzero(ids < len(self.ids))
        c, s, t = self.path(ids[head])
        classes = tail.copy()
        classes[head] = c
        return classes, head, [(c, s), (c * WIDE + s, t)]


def hashes(ids: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Hashes of each token's history by kind of feature; texts begin with two empty tokens."""
    before = np.concatenate(([-1], ids[:-1]))
    before[starts] = -1
    skipped = np.concatenate(([-2], before[:-1]))
    skipped[starts] = -2
    out = []
    for k, x in enumerate((before, before * 1_000_003 + skipped, skipped)):
        h = (x.view(_U) + _U(k + 1)) * _U(0x9E3779B97F4A7C15)
        out.append(((h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93) >> _U(40)).view(np.int64))
    return out


def rows_of(level: tuple, kind: int, node: np.ndarray | int, h: np.ndarray) -> np.ndarray:
    """Rows of a level's table: of each kind and node a block of hashed features."""
    _, nodes, features, _ = level
    return (kind * nodes + node) * features + (h & (features - 1))


def _each(v: Vocabulary, ids: np.ndarray, tail: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray | slice, list[np.ndarray], np.ndarray]]:
    """(level, tokens, rows by kind, outcomes) of the tokens in a row."""
    h = hashes(ids, starts)
    classes, head, finer = v.outcomes(ids, tail)
    yield 0, slice(None), [rows_of(v.levels[0], k, 0, h[k]) for k in range(v.levels[0][0])], classes
    for level, (node, outcome) in enumerate(finer, 1):
        yield level, head, [rows_of(v.levels[level], k, node, h[k][head]) for k in range(v.levels[level][0])], outcome


def tables(levels: tuple, kind) -> list[np.ndarray]:
    return [np.zeros((kinds * nodes * features, wide), kind) for kinds, nodes, features, wide in levels]


class Scorer:
    """Logarithms of probabilities under trained weights; the biases stand in the rows of the first kind."""

    def __init__(self, v: Vocabulary, weights: list[np.ndarray]):
        self.v, self.weights = v, [w.astype(np.float32) for w in weights]
        for (_, nodes, features, _), w, bias in zip(v.levels, self.weights, v.bias, strict=True):
            w[: nodes * features] += np.repeat(bias, features, axis=0)

    def chosen(self, level: int, rows: list[np.ndarray], outcome: np.ndarray) -> np.ndarray:
        """Natural logarithms of the outcomes' probabilities. Sums of weights stay under 80, so exponentials need no shift."""
        w, out = self.weights[level], np.empty(len(outcome))
        wide = w.shape[1]
        x, more = np.empty((STEP, wide), np.float32), np.empty((STEP, wide), np.float32)
        for i in range(0, len(outcome), STEP):
            o = outcome[i : i + STEP]
            n = len(o)
            np.take(w, rows[0][i : i + STEP], axis=0, out=x[:n], mode="clip")
            for r in rows[1:]:
                np.take(w, r[i : i + STEP], axis=0, out=more[:n], mode="clip")
                np.add(x[:n], more[:n], out=x[:n])
            own = x[np.arange(n), o].astype(np.float64)
            np.exp(x[:n], out=x[:n])
            out[i : i + STEP] = own - np.log(x[:n].sum(axis=1))
        return out

    def tokens(self, ids: np.ndarray, tail: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Base-10 logarithms of each token's probability; of tail tokens that of their class, with its room taken off."""
        v, logs = self.v, np.zeros(len(ids))
        for level, tokens, rows, outcome in _each(v, ids, tail, starts):
            logs[tokens] += self.chosen(level, rows, outcome)
        logs /= math.log(10)
        rest = np.flatnonzero(ids >= len(v.ids))
        logs[rest] -= np.log10(v.room[tail[rest]])
        return logs


def moved(weights: np.ndarray, seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Weights after an update: along the gradient (seen - expected), scaled and damped."""
    return weights + RATE * np.log1p((seen - expected) / (expected + PRIOR))


def _slabs(texts: list[bytes | None]) -> Iterator[list[list[bytes]]]:
    """Tokens of texts, in parts of about 2^17 tokens, of which one is held at a time."""
    part, size = [], 0
    for t in texts:
        part.append([*(t or b"").lower().split(), END])
        size += len(part[-1])
        if size >= 1 << 17:
            yield part
            part, size = [], 0
    if part:
        yield part


def _packed(values: np.ndarray) -> bytes:
    """Small counts as compressed bytes."""
    wide = np.uint8 if not values.size or values.max() < 256 else np.uint64
    return bytes([wide().itemsize]) + zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(values, wide).tobytes())


def _unpacked(data: bytes, dtype=None) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data[1:])
    return np.frombuffer(raw, dtype or (np.uint8 if data[0] == 1 else np.uint64))


def _slice(level: tuple, k: int) -> slice:
    """The k-th part of a level's rows."""
    n = level[0] * level[1] * level[2]
    return slice(n * k // SLICES, n * (k + 1) // SLICES)


def _summed(batches: Iterator[pa.RecordBatch], *by: str) -> Iterator[tuple[tuple, np.ndarray]]:
    """Sums of blobs with equal keys, from rows sorted by key; one sum is held at a time."""
    key, total = None, None
    for batch in batches:
        for *now, blob in zip(*(batch[c].to_pylist() for c in (*by, "blob")), strict=True):
            values = _unpacked(blob)
            if tuple(now) != key:
                if key is not None:
                    yield key, total
                key, total = tuple(now), values.astype(np.uint64)
            else:
                total += values
    if key is not None:
        yield key, total


def train(texts: DataFrame, vocabulary) -> list[np.ndarray]:
    """Weights after an update from the frequencies, by the gradient over all texts (one binary column _b); vocabulary: a broadcast Vocabulary."""
    schema, levels = "level int, slice int, part int, blob binary", vocabulary.value.levels

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, seen = vocabulary.value, tables(levels, np.int32)
        for batch in batches:
            for part in _slabs(batch["_b"].to_pylist()):
                for level, _, rows, outcome in _each(v, *v.arrays(part)):
                    flat, ones = seen[level].reshape(-1), np.ones(len(outcome), np.int32)  # of one type, which add.at is fast for
                    for r in rows:
                        np.add.at(flat, r * levels[level][3] + outcome, ones)
        part = TaskContext.get().partitionId() % PARTS
        for level in range(len(levels)):
            blobs = [(k, _packed(x)) for k in range(SLICES) if (x := seen[level][_slice(levels[level], k)]).any()]
            if blobs:
                n = len(blobs)
                yield pa.RecordBatch.from_pydict({"level": pa.array([level] * n, pa.int32()), "slice": pa.array([k for k, _ in blobs], pa.int32()), "part": pa.array([part] * n, pa.int32()), "blob": pa.array([b for _, b in blobs], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (level, k, part), total in _summed(batches, "level", "slice", "part"):
            yield pa.RecordBatch.from_pydict({"level": pa.array([level], pa.int32()), "slice": pa.array([k], pa.int32()), "part": pa.array([part], pa.int32()), "blob": pa.array([_packed(total)], pa.binary())})

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        for (level, k), total in _summed(batches, "level", "slice"):
            kinds, nodes, features, wide = levels[level]
            seen = total.reshape(-1, wide).astype(np.float64)
            rows = np.arange(kinds * nodes * features)[_slice(levels[level], k)]
            expected = seen.sum(axis=1, keepdims=True) * v.shares[level][rows // features % nodes]
            new = moved(np.zeros_like(seen), seen, expected).astype(np.float16)
            yield pa.RecordBatch.from_pydict({"level": pa.array([level], pa.int32()), "slice": pa.array([k], pa.int32()), "blob": pa.array([new.tobytes()], pa.binary())})

    parts = mapped(texts, count, schema).repartition("level", "slice", "part").sortWithinPartitions("level", "slice", "part")
    parts = mapped(parts, add, schema).repartition("level", "slice").sortWithinPartitions("level", "slice")
    weights = tables(levels, np.float16)
    for level, k, blob in mapped(parts, update, "level int, slice int, blob binary").toLocalIterator():
        weights[level][_slice(levels[level], k)] = np.frombuffer(blob, np.float16).reshape(-1, levels[level][3])
    return weights


def _tokens(text: Column) -> Column:
    """Native tokens as binary; the end token is a line feed."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.concat(F.filter(F.split(lower, f"[{SPACES}]+"), lambda w: w != ""), F.array(F.lit("\n")))


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score), learned from the rows that aren't held out."""
    spark = docs.sparkSession
    source = keyed(docs.select(column(id_col).alias("_id"), column(text_col).alias("_text"), F.coalesce(held_out, F.lit(False)).alias("_held")), "_id", "_text")
    training = source.where("NOT _held")
    counts = materialize(training.select(F.explode(_tokens(F.col("_text"))).alias("token")).groupBy("token").count(), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    # the head's least count, from a histogram over a logarithmic scale (at most 1024 rows); no ordering of tokens
    scale = F.floor(F.log2("count") * 16)
    floor, size = None, 0
    for bucket, n in sorted(counts.groupBy(scale.alias("b")).count().collect(), reverse=True):
        if size + n > HEAD:
            break
        floor, size = bucket, size + n
    head = [] if floor is None else [(bytes(r[0]), r[1]) for r in counts.where(scale >= floor).select(F.col("token").cast("binary"), "count").collect()]
    other = counts if floor is None else counts.where(scale < floor)
    by_class = other.groupBy((F.crc32(F.col("token").cast("binary")) % TAIL_CLASSES).cast("int").alias("c")).agg(F.sum("count"), F.count("*")).collect()
    vocabulary = Vocabulary(head, total, distinct, {r[0]: (r[1], r[2]) for r in by_class})
    del head
    shared = spark.sparkContext.broadcast(vocabulary)
    weights = train(training.select(F.coalesce("_text", F.lit("")).cast("binary").alias("_b")), shared)
    trained = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, trained.value)
        v = scorer.v
        for batch in batches:
            keys, done = batch["_k"].to_numpy(), 0
            out = {n: [] for n in ("_k", "token", "n", "base", "score")}
            for part in _slabs(batch["_b"].to_pylist()):
                ids, tail, starts = v.arrays(part)
                head = ids < len(v.ids)
                logs = scorer.tokens(ids, tail, starts)
                base = np.zeros(len(ids))
                base[head] = v.base[ids[head]]
                n = np.diff(np.append(starts, len(ids)))
                known = np.add.reduceat(head.astype(np.int64), starts)
                k = keys[done : done + len(part)]
                out["_k"] += k.tolist()
                out["token"] += [None] * len(part)
                out["n"] += known.tolist()
                out["base"] += (np.add.reduceat(base, starts) - n * v.base_room).tolist()
                out["score"] += np.add.reduceat(logs, starts).tolist()
                for i in np.flatnonzero(known < n).tolist():
                    rare = Counter(t for t, h in zip(part[i], head[starts[i] : starts[i] + n[i]].tolist(), strict=True) if not h)
                    out["_k"] += [k[i]] * len(rare)
                    out["token"] += list(rare)
                    out["n"] += rare.values()
                    out["base"] += [0.0] * len(rare)
                    out["score"] += [0.0] * len(rare)
                done += len(part)
            yield pa.RecordBatch.from_pydict({"_k": pa.array(out["_k"], pa.int64()), "token": pa.array(out["token"], pa.binary()), "n": pa.array(out["n"], pa.int64()), "base": pa.array(out["base"], pa.float64()), "score": pa.array(out["score"], pa.float64())})

    scanned = materialize(mapped(source.select("_k", F.coalesce("_text", F.lit("")).cast("binary").alias("_b")), run, "_k long, token binary, n long, base double, score double"), "scored")
    rare = scanned.where("token IS NOT NULL").join(other.select(F.col("token").cast("binary").alias("token"), F.col("count").alias("c")), "token", "left")
    part = F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)
    rare = rare.select("_k", F.col("n").alias("all"), F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0).alias("known"), part.alias("base"), part.alias("score"))
    whole = scanned.where("token IS NULL").select("_k", F.col("n").alias("all"), F.col("n").alias("known"), "base", "score")
    sums = whole.unionByName(rare).groupBy("_k").agg(F.sum("all").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    rows = source.select("_id", "_k", "_held").join(sums, "_k")
    return rows.select(F.col("_id").alias(id_col), F.col("_held").alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
