"""Token counts of a byte-pair vocabulary with word ends, by heap and linked list.

A word's symbols are a linked list; a heap holds its mergeable neighbours by rank. The lowest rank is
popped and merged again and again, and the count is the number of symbols at first less the merges: no
ids are made. Words beyond ASCII are normalised and split by the library's own normaliser and pre-tokeniser, whose
Unicode version decides what a letter is. Texts fall apart at white space, so counts of white-space-free strings are kept in
a bounded table of each worker.

Edge cases. Null and empty texts, and texts of white space only, have no tokens. Special strings inside
a text count one each. Columns besides the id (of any type) and the text are ignored; each row gives a row, and
an empty table gives none.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, held, mapped

#: White space of the vocabulary's normaliser and its split pattern.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+"
#: Most entries of a worker's tables, and the longest string (in characters) that they hold.
KEPT, KEPT_LENGTH = 1_000_000, 64


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names, extra = {b: chr(b) for b in shown}, 0
    for b in range(256):
        if b not in names:
            names[b], extra = chr(256 + extra), extra + 1
    return [names[b] for b in range(256)]


def merged_count(symbols: list[int], ranks: dict[int, int], results: list[int]) -> int:
    """Symbols left after merging the lowest-ranked neighbours while there are any.

    ranks: left << 17 | right -> rank; results: rank -> merged symbol. Heap entries are rank * n + place.
    """
    n = left = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank_of = ranks.get
    heap = [r * n + i for i in range(n - 1) if (r := rank_of(symbols[i] << 17 | symbols[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i = divmod(heapq.heappop(heap), n)
        j = after[i]
        if j >= n or symbols[i] < 0 or rank_of(symbols[i] << 17 | symbols[j]) != r:
            continue
        symbols[i] = s = results[r]
        symbols[j] = -1
        k = after[i] = after[j]
        left -= 1
        if k < n:
            before[k] = i
            if (r := rank_of(s << 17 | symbols[k])) is not None:
                heapq.heappush(heap, r * n + i)
        h = before[i]
        if h >= 0 and (r := rank_of(symbols[h] << 17 | s)) is not None:
            heapq.heappush(heap, r * n + h)
    return left


def keep(table: dict, text: str | bytes, value) -> None:
    if len(text) <= KEPT_LENGTH:
        if len(table) >= KEPT:
            table.clear()
        table[text] = value


class Counter:
    """Counts tokens of texts; one a worker and vocabulary file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)
        model = vocabulary["model"]
        self.end = model["end_of_word_suffix"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        ids = model["vocab"]
        self.ranks = {ids[a] << 17 | ids[b]: i for i, (a, b) in reversed([*enumerate(pairs)])}
        self.results = [ids[a + b] for a, b in pairs]
        self.inner = [ids[c] for c in byte_symbols()]
        self.last = [ids[c + self.end] for c in byte_symbols()]
        self.special = [t["content"] for t in vocabulary["added_tokens"]]
        self.at_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))))
        self.at_white = re.compile(f"[{WHITE}]+")
        self.odd = re.compile("[\x1c-\x1f]")  # white space for str.split() alone
        self.pieces = re.compile(PIECES, re.ASCII)
        self.library = Tokenizer.from_file(path)
        self.byte_of = {c: b for b, c in enumerate(byte_symbols())}
        self.known: dict[str, int] = {}
        self.known_pieces: dict[bytes, int] = {}

    def word(self, word: str) -> int:
        """Tokens of a string without white space or special strings."""
        if word.isascii():
            pieces = [p.encode() for p in self.pieces.findall(word.lower())]
        else:
            shown = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(word))
            pieces = [bytes(map(self.byte_of.__getitem__, p)) for p, _ in shown]
        total = 0
        for piece in pieces:
            n = self.known_pieces.get(piece)
            if n is None:
                data = piece
                symbols = [*map(self.inner.__getitem__, data[:-1]), self.last[data[-1]]]
                n = merged_count(symbols, self.ranks, self.results)
                keep(self.known_pieces, piece, n)
            total += n
        return total

    def plain(self, text: str) -> int:
        known, total = self.known, 0
        if text.isascii() and not self.odd.search(text):
            words = text.split()
        else:
            words = self.at_white.split(text)
        for w in words:
            n = known.get(w)
            if n is None:
                n = self.word(w)
                keep(known, w, n)
            total += n
        return total

    def text(self, text: str) -> int:
        if not any(s in text for s in self.special):
            return self.plain(text)
        parts = self.at_special.split(text)
        return sum(map(self.plain, parts)) + len(parts) - 1


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = held(("counts", path), lambda: Counter(path))
        for batch in batches:
            counts = [counter.text(x) for x in batch["_t"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["_id"], batch["n_bytes"], pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce(column(text_col), F.lit(""))
    source = docs.select(column(id_col).alias("_id"), text.alias("_t"), F.octet_length(text).cast("long").alias("n_bytes"))
    return mapped(source, run, docs.select(column(id_col)).withColumns({"n_bytes": F.lit(0).cast("long"), "n_tokens": F.lit(0).cast("long"), "over_limit": F.lit(True)}).schema, ("counts", path))
