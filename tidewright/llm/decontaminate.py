"""Benchmark decontamination by a prefix-filtered set join.

An item is cut into windows of ``window`` consecutive words. A document contains a
window only if it contains every word of it, so one word of each window is a
necessary prefix token, and the rarest one in the corpus is the cheapest: words are
ordered by their counts over all documents, and each window is filed under its
rarest word with that word's offset and the window's length. A document word that is a prefix token names
start positions; length and position bounds drop starts that cannot hold the window. Starts that are left
are looked up by a hash of the window, and a hit is verified by comparing the words.

The benchmark is the stated query set. It is cut into pieces, and pieces are packed into blocks of at most
``block_bytes`` of text; a long item is spread over blocks, with ``window - 1`` words in common. A block's index
is a few sorted arrays, ``Index.bytes`` tells how large: about 30 bytes a window. A task holds the index of one block at
a time, whatever the size of the benchmark, and reads the documents once for counts and once for windows.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import col, map_arrow, materialize, raw, release

#: A-Z to a-z; bytes up to 0x2F, 0x3A-0x60 and 0x7B-0x7F end a word.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else 32 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))
#: An odd multiplier: a window's hash is a polynomial in it over the hashes of its words.
_BASE = np.uint64(0x9E3779B97F4A7C15)


def item_words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` words."""
    n = len(hashes) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, size):
        out *= _BASE
        out += hashes[j : j + n]
    return out


def pieces_of(words: list[bytes], window: int, limit: int) -> list[bytes]:
    """The words, joined, in pieces of about ``limit`` bytes at most; every window of the whole is in a piece."""
    out, at = [], 0
    while at < len(words):
        end, size = at, 0
        while end < len(words) and (size + len(words[end]) < limit or end < at + 2 * window):
            size += len(words[end]) + 1
            end += 1
        out.append(b" ".join(words[at:end]))
        if end == len(words):
            break
        at = end - window + 1
    return out


class Index:
    """Windows of the pieces of a block.

    ``hashes``: of the windows, sorted; ``owner``, ``at`` and ``length``: the item of each, its first word and how many; ``text``:
    the words of all pieces, and ``starts`` of each in it. ``tokens``: hashes of prefix tokens, sorted; ``shapes``: a bit for each (offset, length) of a window filed
    under the token, so however many windows share a token, a document word names ``window`` squared starts at most."""

    def __init__(self, pieces: list[tuple[str, bytes]], window: int, counts: dict[bytes, int]):
        self.window = window
        self.items = sorted({i for i, _ in pieces})
        number = {x: k for k, x in enumerate(self.items)}
        texts = [t.split() for _, t in pieces]
        self.text = b" ".join(t for _, t in pieces if t)
        sizes = np.fromiter((len(w) + 1 for t in texts for w in t), np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        hashes = word_hashes(list(chain.from_iterable(texts)))
        rarity = np.fromiter((counts.get(w, 0) for t in texts for w in t), np.int64, len(hashes))
        found, owners, ats, lengths, tokens, shapes = [], [], [], [], [], []
        at = 0
        for (item, _), t in zip(pieces, texts, strict=True):
            n = min(window, len(t))
            if n:
                h, r = hashes[at : at + len(t)], rarity[at : at + len(t)]
                starts = np.arange(len(t) - n + 1)
                # ties go to the smaller hash, so that equal windows have equal tokens
                order = np.lexsort((h, r))
                rank = np.empty(len(t), np.int64)
                rank[order] = np.arange(len(t))
                offset = np.lib.stride_tricks.sliding_window_view(rank, n).argmin(axis=1)
                found.append(window_hashes(h, n))
                owners.append(np.full(len(starts), number[item], np.int32))
                ats.append(starts + at)
                lengths.append(np.full(len(starts), n, np.int8))
                tokens.append(h[starts + offset])
                shapes.append((n - 1) * window + offset)
            at += len(t)
        none = np.zeros(0, np.int64)
        self.hashes, self.owner, self.at, self.length = (np.concatenate([none.astype(k), *x]) for x, k in ((found, np.uint64), (owners, np.int32), (ats, np.int64), (lengths, np.int8)))
        self._take(np.lexsort((self.at, self.owner, self.hashes)))
        # a window that its item repeats is kept once; equal hashes of different windows stay
        again = np.nonzero((self.hashes[1:] == self.hashes[:-1]) & (self.owner[1:] == self.owner[:-1]))[0] + 1
        stay = np.ones(len(self.hashes), dtype=bool)
        stay[[e for e in again.tolist() if self._window(e) == self._window(e - 1)]] = False
        self._take(np.nonzero(stay)[0])
        filed = sorted(set(zip(np.concatenate([none.astype(np.uint64), *tokens]).tolist(), np.concatenate([none, *shapes]).tolist(), strict=True)))
        self.tokens = np.array(sorted({t for t, _ in filed}), dtype=np.uint64)
        self.begin = np.searchsorted(np.array([t for t, _ in filed], dtype=np.uint64), self.tokens)
        self.shapes = np.array([s for _, s in filed], dtype=np.int16)
        self.begin = np.append(self.begin, len(self.shapes))

    def _take(self, entries: np.ndarray) -> None:
        self.hashes, self.owner, self.at, self.length = self.hashes[entries], self.owner[entries], self.at[entries], self.length[entries]

    def _window(self, entry: int) -> bytes:
        p = int(self.at[entry])
        return self.text[self.starts[p] : self.starts[p + int(self.length[entry])] - 1]

    @property
    def bytes(self) -> int:
        return len(self.text) + sum(x.nbytes for x in (self.starts, self.hashes, self.owner, self.at, self.length, self.tokens, self.begin, self.shapes))

    def find(self, words: list[bytes], hashes: np.ndarray) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word spans that lie in windows, and the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        seen: dict[bytes, set[int]] = {}
        if not len(words) or not len(self.tokens):
            return spans, set()
        near = np.minimum(np.searchsorted(self.tokens, hashes), len(self.tokens) - 1)
        hit = np.nonzero(self.tokens[near] == hashes)[0]
        if not len(hit):
            return spans, set()
        lo, n = self.begin[near[hit]], self.begin[near[hit] + 1] - self.begin[near[hit]]
        heads = np.cumsum(n) - n
        shape = self.shapes[np.repeat(lo - heads, n) + np.arange(int(n.sum()))].astype(np.int64)
        start, size = np.repeat(hit, n) - shape % self.window, shape // self.window + 1
        for k in np.unique(size).tolist():
            own = start[(size == k) & (start >= 0) & (start + k <= len(words))]
            if not len(own):
                continue
            own = np.unique(own)
            asked = window_hashes(hashes, k)[own]
            a, b = np.searchsorted(self.hashes, asked, side="left"), np.searchsorted(self.hashes, asked, side="right")
            for s, i, j in zip(own[b > a].tolist(), a[b > a].tolist(), b[b > a].tolist(), strict=True):
                mine = b" ".join(words[s : s + k])
                if mine not in seen:
                    seen[mine] = {int(self.owner[e]) for e in range(i, j) if self.length[e] == k and self._window(e) == mine}
                if seen[mine]:
                    items |= seen[mine]
                    spans.append((s, s + k))
        return merge(spans), {self.items[i] for i in items}


def merge(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _pieces(benchmark: DataFrame, id_col: str, text_col: str, window: int, limit: int) -> DataFrame:
    """row, item, words: items in pieces, in an order that stays. An item without an id can't be reported and is left out."""
    items = benchmark.select(col(id_col).cast("string").alias("i"), col(text_col).cast("string").alias("t")).where("i IS NOT NULL AND t IS NOT NULL")

    def cut(batches):
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), raw(b.column(1)), strict=True):
                found = pieces_of(item_words(text), window, limit)
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.string()), pa.array(found, pa.binary())], names=["i", "w"])

    return materialize(items.mapInArrow(cut, "i string, w binary").withColumn("row", F.monotonically_increasing_id()))


def _blocks(pieces: DataFrame, block_bytes: int) -> list[tuple[int, int]]:
    """Ranges of rows whose pieces have at most ``block_bytes`` together, or are one piece. The driver sees the size of each piece."""
    out: list[tuple[int, int]] = []
    held = 0
    for r in pieces.select("row", F.octet_length("w").alias("n")).orderBy("row").collect():
        if out and held + r["n"] <= block_bytes:
            out[-1], held = (out[-1][0], r["row"]), held + r["n"]
        else:
            out.append((r["row"], r["row"]))
            held = r["n"]
    return out


def _block(pieces: DataFrame, rows: tuple[int, int]) -> list[tuple[str, bytes]]:
    return [(r["i"], bytes(r["w"])) for r in pieces.where(F.col("row").between(*rows)).orderBy("row").collect()]


def _one_at_a_time(shared: list):
    """The values of broadcasts, each forgotten before the next is loaded; a single one is kept."""
    if len(shared) == 1:
        yield shared[0].value
        return
    for b in shared:
        yield b.load_from_path(b._path) if getattr(b, "_path", None) else b.value


def token_counts(docs: DataFrame, text_col: str, pieces: DataFrame, blocks: list[tuple[int, int]]) -> DataFrame:
    """b, w, n: the count of each word of each block over all documents; at most one row a word and task is shuffled."""
    shared = [docs.sparkSession.sparkContext.broadcast(frozenset(w for _, t in _block(pieces, rows) for w in t.split())) for rows in blocks]

    def run(batches):
        found: list[Counter] = [Counter() for _ in shared]
        for b in batches:
            texts = [item_words(t) for t in raw(b.column(0))]
            for k, known in enumerate(_one_at_a_time(shared)):
                for words in texts:
                    found[k].update(filter(known.__contains__, words))
        for k, c in enumerate(found):
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(c), pa.int32()), pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["b", "w", "n"])

    counted = docs.select(col(text_col).cast("string").alias("t")).mapInArrow(run, "b int, w binary, n bigint")
    return counted.groupBy("b", "w").agg(F.sum("n").alias("n"))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    keep: list[str] | None = None,
    window: int = 8,
    min_items: int = 2,
    block_bytes: int = 4 << 20,
) -> DataFrame:
    """One row for each document row: the kept columns (the id by default), n_words,
    n_hit (words in any occurrence of a window), n_items, item_ids (sorted as
    strings), hit_starts and hit_ends (word spans), contaminated.

    Null and empty texts have no words and are clean. Repeated rows are scored
    alike, each on its own. An item of fewer words than a window is one window; items
    without words, text or id never match. Items with the same id are one item. An empty
    benchmark or corpus gives clean rows or none.
    """
    if window > 64:
        raise ValueError("a window has at most 64 words")
    spark = docs.sparkSession
    pieces = _pieces(benchmark, item_col, item_text_col, window, max(1, block_bytes // 4))
    blocks = _blocks(pieces, block_bytes)
    counted = materialize(token_counts(docs, text_col, pieces, blocks)) if blocks else None
    shared = []
    for k, rows in enumerate(blocks):
        counts = {bytes(r["w"]): r["n"] for r in counted.where(F.col("b") == k).select("w", "n").collect()}
        shared.append(spark.sparkContext.broadcast(Index(_block(pieces, rows), window, counts)))
    release(pieces, *([counted] if blocks else []))
    names = ["n_words", "n_hit", "n_items", "item_ids", "hit_starts", "hit_ends", "contaminated"]
    kinds = [T.LongType(), T.LongType(), T.LongType(), T.ArrayType(T.StringType()), T.ArrayType(T.IntegerType()), T.ArrayType(T.IntegerType()), T.BooleanType()]

    def make():
        def step(texts):
            every = [item_words(t) for t in raw(texts)]
            hashes = [word_hashes(w) for w in every]
            found: list[tuple[list, set]] = [([], set()) for _ in every]
            for index in _one_at_a_time(shared):
                for (spans, items), words, h in zip(found, every, hashes, strict=True):
                    s, i = index.find(words, h)
                    spans += s
                    items |= i
            rows = []
            for words, (spans, items) in zip(every, found, strict=True):
                whole = merge(spans)
                rows.append((len(words), sum(b - a for a, b in whole), len(items), sorted(items), [a for a, _ in whole], [b for _, b in whole], len(items) >= min_items))
            return [pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.bool_()])]

        return step

    return map_arrow(docs, [col(text_col).cast("string")], list(keep or [id_col]), list(zip(names, kinds, strict=True)), make)
