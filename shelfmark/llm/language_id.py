"""Language identification by unigram models that are marginalised over all segmentations.

The pieces are those of a fixed public vocabulary; each language has a probability for every piece,
fitted by expectation-maximisation on a bounded sample of labelled texts. A word's score under
a language is the sum over all its segmentations (forward algorithm); no piece crosses white space, so
a text's score is the sum of its words' log scores. Workers keep the scores of words in a bounded table.
Pieces of one text are no independent evidence, so the posterior counts a text's mean log odds as if it had
EVIDENCE characters at most; the predicted language is the same with and without that.

Edge cases. `und` with score 0 if a text is null or empty, has no letter, or nothing could be learned;
ties go to the first language by code point; rows with a null label are never learned from; each row, repeated
ones too, gives a row; an empty table gives none; columns named as the two that are added are replaced, any others
pass through.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, held, mapped, packed

#: About so many texts of each language, none over so many bytes, are learned from.
SAMPLE, SAMPLE_BYTES = 300, 100_000
ROUNDS, SMOOTH = 3, 0.1
#: A text's evidence counts for so many characters at most.
EVIDENCE = 100
#: Most words that a worker keeps, and the longest (in characters) that the batched passes take; longer ones go one by one.
KEPT, SHORT = 250_000, 24
_SCALE = 30.0
#: Closes a word in the lattice; no code point.
_END = (1 << 21) - 1
_LETTER = regex.compile(r"\p{L}")


def read_pieces(path: str) -> list[str]:
    """The vocabulary's ordinary pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


class Model:
    """Piece probabilities [piece, language]; the last but one row is for characters outside the vocabulary, the last is 0."""

    def __init__(self, pieces: list[str], languages: list[str], counts: np.ndarray | None = None):
        self.ids = {p: i for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces), default=1)
        self._grow_trie()
        self.languages = languages
        self.set(np.ones((len(pieces) + 1, len(languages))) if counts is None else counts)

    def _grow_trie(self) -> None:
        """steps: sorted node << 21 | code point, closed by a key that is none; targets: the nodes reached; piece_of: a node's piece or -1."""
        steps, piece_of = {}, [-1]
        for piece, i in self.ids.items():
            node = 0
            for c in map(ord, piece):
                node = steps.setdefault(node << 21 | c, len(piece_of))
                if node == len(piece_of):
                    piece_of.append(-1)
            piece_of[node] = i
        keys = np.array([*steps, np.iinfo(np.int64).max], np.int64)
        order = np.argsort(keys)
        self.steps, self.targets, self.piece_of = keys[order], np.array([*steps.values(), 0], np.int64)[order], np.array(piece_of, np.int32)

    def set(self, counts: np.ndarray) -> None:
        counts = counts + SMOOTH
        self.p = np.concatenate((counts / counts.sum(axis=0), np.zeros((1, counts.shape[1]))))

    def edges(self, word: str) -> list[tuple[int, int, int]]:
        """(end, length, piece) of every piece in a word."""
        get, n, unknown = self.ids.get, len(word), len(self.ids)
        out = []
        for s in range(n):
            p = get(word[s], unknown)
            out.append((s + 1, 1, p))
            for e in range(s + 2, min(n, s + self.longest) + 1):
                p = get(word[s:e])
                if p is not None:
                    out.append((e, e - s, p))
        return out

    def _lattice(self, words: list[str]) -> np.ndarray:
        """Piece at [word, end, length] for words of one length, the none-piece where there is none.

        All starts of all words walk the trie together; a start leaves when no piece goes on.
        """
        size, none = len(words[0]), len(self.p) - 1
        letters = np.full((len(words), size + 1), _END)
        letters[:, :size] = np.array(words, f"U{size}").view(np.uint32).reshape(-1, size)
        letters = letters.ravel()
        grid = np.full((len(letters), min(self.longest, size) + 1), none, np.int32)
        at = np.flatnonzero(letters != _END)
        grid[at + 1, 1] = none - 1
        node = np.zeros(len(at), np.int64)
        for n in range(1, grid.shape[1]):
            key = node << 21 | letters[at + n - 1]
            step = np.searchsorted(self.steps, key)
            goes = self.steps[step] == key
            at, node = at[goes], self.targets[step[goes]]
            piece = self.piece_of[node]
            ends = piece >= 0
            grid[at[ends] + n, n] = piece[ends]
        return grid.reshape(len(words), size + 1, -1)

    def _batches(self, words: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
        """Places of up to 4096 words of one length, and their lattice; words over SHORT aren't among them."""
        by_size = defaultdict(list)
        for i, w in enumerate(words):
            if len(w) <= SHORT:
                by_size[len(w)].append(i)
        for part in by_size.values():
            for k in range(0, len(part), 4096):
                yield part[k : k + 4096], self._lattice([words[i] for i in part[k : k + 4096]])

    def _forward(self, grid: np.ndarray) -> np.ndarray:
        a = np.zeros((*grid.shape[:2], self.p.shape[1]))
        a[:, 0] = 1
        for e in range(1, grid.shape[1]):
            for n in range(1, min(e, grid.shape[2] - 1) + 1):
                a[:, e] += a[:, e - n] * self.p[grid[:, e, n]] * _SCALE**n
        return a

    def long_score(self, word: str) -> np.ndarray:
        """Log score of one word of any length."""
        by_end = defaultdict(list)
        for e, n, p in self.edges(word):
            by_end[e].append((n, p))
        a, logs = {0: np.ones(self.p.shape[1])}, np.zeros(self.p.shape[1])
        for e in range(1, len(word) + 1):
            a[e] = sum(a[e - n] * self.p[p] for n, p in by_end.pop(e))
            a.pop(e - self.longest, None)
            top = np.maximum(a[e], 1e-300)
            if (top < 1e-100).any():
                logs += np.log(top)
                a = {k: v / top for k, v in a.items()}
        return logs + np.log(np.maximum(a[len(word)], 1e-300))

    def long_expected(self, word: str, weights: np.ndarray, total: np.ndarray) -> None:
        """Add one word's expected piece counts, weighted by language, to `total`: forward and backward sums of logarithms."""
        n, edges = len(word), self.edges(word)
        with np.errstate(divide="ignore"):
            logs = np.log(self.p)
        into, out = defaultdict(list), defaultdict(list)
        for e, size, p in edges:
            into[e].append((e - size, p))
            out[e - size].append((e, p))
        a, b = np.full((n + 1, self.p.shape[1]), -np.inf), np.full((n + 1, self.p.shape[1]), -np.inf)
        a[0] = b[n] = 0
        for e in range(1, n + 1):
            at, p = map(list, zip(*into[e], strict=True))
            a[e] = np.logaddexp.reduce(a[at] + logs[p], axis=0)
        for s in range(n - 1, -1, -1):
            at, p = map(list, zip(*out[s], strict=True))
            b[s] = np.logaddexp.reduce(b[at] + logs[p], axis=0)
        ends, sizes, pieces = (np.array(x, np.int64) for x in zip(*edges, strict=True))
        with np.errstate(invalid="ignore"):
            mass = np.exp(a[ends - sizes] + logs[pieces] + b[ends] - a[n])
        np.add.at(total, pieces, np.nan_to_num(mass) * weights)

    def scores(self, words: list[str]) -> np.ndarray:
        """Log score of each word (marked at its start) under each language."""
        out = np.full((len(words), self.p.shape[1]), -np.inf)
        for part, grid in self._batches(words):
            with np.errstate(divide="ignore"):
                out[part] = np.log(self._forward(grid)[:, -1]) - (grid.shape[1] - 1) * np.log(_SCALE)
        for i in np.flatnonzero(~np.isfinite(out).all(axis=1)):  # long words, and sums that came out as 0
            out[i] = self.long_score(words[i])
        return out

    def expected(self, words: list[str], weights: np.ndarray) -> np.ndarray:
        """Expected piece counts of the words, weighted [word, language], by forward and backward sums."""
        total = np.zeros_like(self.p)
        for part, grid in self._batches(words):
            a, b = self._forward(grid), np.zeros((*grid.shape[:2], self.p.shape[1]))
            b[:, -1] = 1
            for s in range(grid.shape[1] - 2, -1, -1):
                for n in range(1, min(grid.shape[1] - 1 - s, grid.shape[2] - 1) + 1):
                    b[:, s] += b[:, s + n] * self.p[grid[:, s + n, n]] * _SCALE**n
            share = weights[part] / np.maximum(a[:, -1], 1e-300)
            for e in range(1, grid.shape[1]):
                for n in range(1, min(e, grid.shape[2] - 1) + 1):
                    p = grid[:, e, n]
                    mass = a[:, e - n] * self.p[p] * _SCALE**n * b[:, e] * share
                    for x in range(mass.shape[1]):
                        total[:, x] += np.bincount(p, mass[:, x], len(total))
        for i, w in enumerate(words):
            if len(w) > SHORT:
                self.long_expected(w, weights[i], total)
        return total[:-1]


def learn(labelled: DataFrame, text_col: str, lang_col: str, id_col: str, pieces_path: str, sample: int = SAMPLE) -> Model | None:
    """A model from about `sample` texts of each language, picked by a hash of the id; None if there is no label."""
    labelled = labelled.select(column(id_col).alias("i"), column(text_col).alias("t"), column(lang_col).alias("l")).where("l IS NOT NULL AND t IS NOT NULL").where(F.octet_length("t") <= SAMPLE_BYTES)
    sizes = {r[0]: r[1] for r in labelled.groupBy("l").count().collect()}
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, sample / n)])
    picked = labelled.where(F.pmod(F.xxhash64(F.col("i").cast("string"), F.lit("language sample")), F.lit(1_000_000)) < share[F.col("l")] * 1_000_000)
    counted = picked.select("l", F.explode(F.split("t", r"\s+")).alias("w")).where("w <> ''").groupBy("l", "w").count().toPandas()
    languages = sorted(sizes)
    model = Model(read_pieces(pieces_path), languages)
    words = sorted(counted["w"].unique())
    weights = np.zeros((len(words), len(languages)))
    row = {w: i for i, w in enumerate(words)}
    place = {x: i for i, x in enumerate(languages)}
    for x, w, n in counted.itertuples(index=False):
        weights[row[w], place[x]] = n
    marked = ["▁" + w for w in words]
    for _ in range(ROUNDS if words else 0):
        model.set(model.expected(marked, weights))
    return model


class _Scorer:
    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.kept = min(KEPT, 40_000_000 // len(model.languages))
        self.table = np.empty((self.kept, len(model.languages)))

    def texts(self, texts: list[str]) -> np.ndarray:
        """Summed log scores [text, language]."""
        split = [t.split() for t in texts]
        known = self.known
        fresh = [w for w in dict.fromkeys(chain.from_iterable(split)) if w not in known]
        if len(known) + len(fresh) > self.kept:
            known.clear()
            fresh = list(dict.fromkeys(chain.from_iterable(split)))
        table = self.table
        if len(fresh) > self.kept:  # one text of very many words
            known, table = {}, np.empty((len(fresh), table.shape[1]))
        if fresh:
            at = len(known)
            table[at : at + len(fresh)] = self.model.scores(["▁" + w for w in fresh])
            known.update(zip(fresh, range(at, at + len(fresh)), strict=True))
        return np.array([table[[known[w] for w in ws]].sum(axis=0) if ws else np.zeros(table.shape[1]) for ws in split])


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", *, language: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language and its posterior probability under equal priors."""
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in (language, score)]
    kept = docs.select(*map(column, names))
    if model is None:
        return kept.withColumns({language: F.lit("und"), score: F.lit(0.0)})
    shared, key = spark.sparkContext.broadcast(model), hash((model.p.tobytes(), tuple(model.languages)))
    rows = docs.select(packed(docs, (text_col, language, score), "row"), column(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held(("language", key), lambda: _Scorer(shared.value))
        for batch in batches:
            texts = batch["text"].to_pylist()
            languages, scores = ["und"] * len(texts), np.zeros(len(texts))
            todo = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
            while todo:
                part, size = [], 0
                while todo and size < 1 << 21:
                    part.append(todo.pop())
                    size += len(texts[part[-1]])
                found = scorer.texts([texts[i] for i in part])
                best = found.argmax(axis=1)
                found /= np.maximum(1, np.array([len(texts[i]) for i in part]) / EVIDENCE)[:, None]
                odds = np.exp(found - found.max(axis=1, keepdims=True))
                for i, b in zip(part, best, strict=True):
                    languages[i] = scorer.model.languages[b]
                scores[part] = 1 / odds.sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch["row"], batch["text"], pa.array(languages, pa.string()), pa.array(scores)], names=["row", "text", "language", "score"])

    made = mapped(rows, run, rows.withColumns({"language": F.lit(""), "score": F.lit(0.0)}).schema, ("language", key))
    return made.select(*[F.col("text" if c == text_col else f"row.`{c}`").alias(c) for c in names], F.col("language").alias(language), F.col("score").alias(score))
