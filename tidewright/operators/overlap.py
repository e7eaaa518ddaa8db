"""The closest text of the filing before: sets of shingles in arrays, compared without a row a shingle.

Each text is shingled once. Its hashes go to parts of a ticker's item by their value, so the texts of a part that share a
hash meet there, whichever filing they are of. Lists of a hash are short (their pairs are at most ``LIGHT`` times
their members, and are counted) or long (boilerplate; their members keep the hash). Long lists make no pairs: texts
with the same long-list hashes are one set there. For a pair without a short list the common long-list hashes are all
it has in common, and for others they bound its score from below, so the best of both is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import SHINGLE_WORDS, normalise

#: Characters of text whose hashes are one part.
PART_CHARS = 16_000_000
#: A list is short if its pairs are at most so many times its members.
LIGHT = 8
#: Pairs or scores that a task holds at once.
HELD = 1 << 21
_FACTOR, _START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x2545F4914F6CDD1D)
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * _FACTOR
    return h ^ (h >> np.uint64(32))


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)


def _firsts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new key begins."""
    new = np.zeros(len(sorted_keys[0]), bool)
    new[:1] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _hashes_of(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """How many hashes each row has, and all of them."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], column.type)
    a = a.fill_null(b"").cast(pa.large_binary())
    ends = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8)[ends[0] : ends[-1]] if len(a) and a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return np.diff(ends) // 8, data.view(np.uint64) if not data.ctypes.data % 8 else data.copy().view(np.uint64)


def _binary(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(lengths * 8)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def shingle_sets(texts: pa.Array, size: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The distinct shingles of each normalised text as sorted 64-bit hashes: all words as one if they are fewer than ``size``."""
    a = texts.fill_null("").cast(pa.large_binary())
    ends = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    lo, hi = int(ends[0]), int(ends[-1])
    raw = np.zeros(hi - lo + 16, np.uint8)
    if hi > lo:
        raw[: hi - lo] = np.frombuffer(a.buffers()[2], np.uint8)[lo:hi]
    else:
        return [np.zeros(0, np.uint64)] * len(a)
    ends = ends - lo
    word = np.zeros(hi - lo + 2, bool)
    word[1:-1] = raw[: hi - lo] != 32
    cut = np.zeros(hi - lo + 1, bool)
    cut[ends] = True
    starts = np.flatnonzero(word[1:] & (~word[:-1] | cut))
    stops = np.flatnonzero(word[:-1] & (~word[1:] | cut))
    eights = np.ndarray((hi - lo + 8,), np.uint64, raw, strides=(1,))
    hashed, left, at, live = np.full(len(starts), _START), stops - starts, starts, np.arange(len(starts))
    while len(live):
        hashed[live] = _mix(hashed[live] ^ (eights[at] & _MASKS[np.minimum(left, 8)]))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    first = np.searchsorted(starts, ends)
    words = np.diff(first)
    runs = np.where(words > 0, np.maximum(words - size + 1, 1), 0)
    begin, many = _spread(first[:-1], runs), np.repeat(words, runs)
    out = np.full(len(begin), _START)
    for j in range(size):
        step = _mix(out * _FACTOR ^ hashed[np.minimum(begin + j, len(hashed) - 1)])
        out = step if not len(many) or many.min() > j else np.where(many > j, step, out)
    parts = np.concatenate([[0], np.cumsum(runs)])
    return [np.unique(out[parts[i] : parts[i + 1]]) for i in range(len(a))]


_PLACE = "ticker string, item string, part int, rank int, doc long, ordinal long, n int, hs binary"
_MET = "ticker string, item string, kind int, rank int, doc long, n int, p_doc long, p_n int, ordinal long, c int, hs binary"
_BEST = "ticker string, rank int, item string, doc long, first_ordinal long, first_sim double, top double"


def _dealt(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Rows of texts to rows of their hashes, by part."""
    for whole in batches:
        for b in (whole.slice(at, 256) for at in range(0, whole.num_rows, 256)):
            parts, rows, which, sizes, held, lengths = b.column("parts").to_numpy(), [], [], [], [], []
            for i, h in enumerate(shingle_sets(b.column("norm"))):
                k = int(parts[i])
                if not len(h):
                    continue
                p = (h >> np.uint64(32)) % np.uint64(k)
                order = np.argsort(p, kind="stable")
                n = np.bincount(p.astype(np.int64), minlength=k)
                some = np.flatnonzero(n)
                rows += [i] * len(some)
                sizes += [len(h)] * len(some)
                which.append(some)
                lengths.append(n[some])
                held.append(h[order])
            if rows:
                t = b.select(["ticker", "item", "rank", "doc", "ordinal"]).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [t.column(0), t.column(1), pa.array(np.concatenate(which), pa.int32()), *t.columns[2:], pa.array(sizes, pa.int32()), _binary(np.concatenate(held), np.concatenate(lengths))],
                    names=["ticker", "item", "part", "rank", "doc", "ordinal", "n", "hs"],
                )


def _met(key: tuple, table: pa.Table) -> pa.Table:
    """Of the hashes of a part: pairs in short lists with the number of those (kind 0), and the texts in
    long ones with these hashes, as later (1) and as earlier text (2)."""
    rank, doc, n, ordinal = (table.column(c).to_numpy() for c in ("rank", "doc", "n", "ordinal"))
    lengths, h = _hashes_of(table.column("hs"))
    row = np.repeat(np.arange(len(doc)), lengths)
    once = np.zeros(len(doc), bool)  # equal rows count once
    once[np.unique(np.stack([rank.astype(np.int64), doc]), axis=1, return_index=True)[1]] = True
    h, row = h[once[row]], row[once[row]]
    order = np.argsort(h)
    h, row = h[order], row[order]
    at = _firsts(h)
    size = np.diff(np.append(at, len(h)))
    keep = _spread(at[size > 1], size[size > 1])
    h, row = h[keep], row[keep]
    order = np.lexsort((rank[row], h))
    h, row = h[order], row[order]
    at = _firsts(h, rank[row])
    size = np.diff(np.append(at, len(h)))
    after = np.flatnonzero((h[at[1:]] == h[at[:-1]]) & (rank[row[at[1:]]] == rank[row[at[:-1]]] + 1)) if len(at) else np.zeros(0, np.int64)
    a, b = size[after + 1], size[after]
    light = a * b <= LIGHT * (a + b)
    out: list[list] = [[] for _ in range(9)]

    def add(kind, mine, prior, c, hs):
        k = len(mine) if mine is not None else len(prior)
        zero = np.zeros(k, np.int64)
        x, y = (mine if mine is not None else prior), (prior if prior is not None else mine)
        r = rank[x] + (mine is None)
        for o, v in zip(out, (np.full(k, kind), r, doc[x], n[x], doc[y], n[y], ordinal[y], zero if c is None else c), strict=False):
            o.append(v)
        out[8].append(hs if hs is not None else _binary(np.zeros(0, np.uint64), zero))

    few = after[light]
    cost = np.cumsum(size[few + 1] * size[few])
    for lo, hi in _slices(cost, HELD):
        f = few[lo:hi]
        pairs = size[f + 1] * size[f]
        place = _spread(np.zeros(len(f), np.int64), pairs)
        width = np.repeat(size[f], pairs)
        mine, prior = row[np.repeat(at[f + 1], pairs) + place // width], row[np.repeat(at[f], pairs) + place % width]
        both, c = np.unique(mine * len(doc) + prior, return_counts=True)
        add(0, both // len(doc), both % len(doc), c, None)
    long = after[~light]
    for kind, which in ((1, long + 1), (2, long)):
        take = _spread(at[which], size[which])
        r, g = row[take], h[take]
        order = np.lexsort((g, r))
        r, g = r[order], g[order]
        first = _firsts(r)
        if len(first):
            held = _binary(g, np.diff(np.append(first, len(r))))
            add(kind, *((r[first], None) if kind == 1 else (None, r[first])), None, held)
    names = ["kind", "rank", "doc", "n", "p_doc", "p_n", "ordinal", "c", "hs"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
    columns = [pa.array(np.concatenate(o) if o else [], t) for o, t in zip(out, types, strict=False)]
    columns.append(pa.concat_arrays(out[8]) if out[8] else pa.array([], pa.binary()))
    k = len(columns[0])
    return pa.table([pa.array([key[0].as_py()] * k, pa.string()), pa.array([key[1].as_py()] * k, pa.string()), *columns], names=["ticker", "item", *names])


def _slices(cost: np.ndarray, most: int) -> Iterable[tuple[int, int]]:
    """Ranges whose cost (given as sums) is about ``most`` each."""
    lo = 0
    while lo < len(cost):
        hi = max(lo + 1, int(np.searchsorted(cost, (cost[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


class _Sets:
    """Texts by their long-list hashes: rows (doc, n, ordinal), the set of each, and the members of the sets."""

    def __init__(self, doc: np.ndarray, n: np.ndarray, ordinal: np.ndarray, hs: tuple[np.ndarray, np.ndarray]):
        self.doc, at, of = np.unique(doc, return_index=True, return_inverse=True)
        self.n, self.ordinal = n[at], ordinal[at]
        row, h = np.repeat(of, hs[0]), hs[1]
        name = np.zeros(len(self.doc), np.uint64)
        np.add.at(name, row, _mix(h * _FACTOR + _START))
        _, lead, self.set = np.unique(name, return_index=True, return_inverse=True)
        led = np.zeros(len(self.doc), bool)
        led[lead] = True
        self.count, self.member, self.h = len(lead), self.set[row[led[row]]], h[led[row]]

    def place(self, doc: np.ndarray) -> np.ndarray:
        """The row of each text, -1 for texts in no long list."""
        if not len(self.doc):
            return np.full(len(doc), -1)
        i = np.minimum(np.searchsorted(self.doc, doc), len(self.doc) - 1)
        return np.where(self.doc[i] == doc, i, -1)


def _closest(threshold: float) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        of = lambda k, *names: [table.column(c).to_numpy()[kind == k] for c in names]
        hs = lambda k: _hashes_of(table.column("hs").filter(pa.array(kind == k)))
        later, earlier = _Sets(*of(1, "doc", "n", "ordinal"), hs(1)), _Sets(*of(2, "p_doc", "p_n", "ordinal"), hs(2))
        doc, n, p_doc, p_n, ordinal, c = of(0, "doc", "n", "p_doc", "p_n", "ordinal", "c")
        # parts of a pair to one row
        order = np.lexsort((p_doc, doc))
        first = _firsts(doc[order], p_doc[order])
        c = np.add.reduceat(c[order].astype(np.int64), first) if len(first) else c.astype(np.int64)
        doc, n, p_doc, p_n, ordinal = (x[order][first] for x in (doc, n, p_doc, p_n, ordinal))
        mine, prior = later.place(doc), earlier.place(p_doc)
        both = np.flatnonzero((mine >= 0) & (prior >= 0))
        both = both[np.argsort(later.set[mine[both]], kind="stable")] if len(both) else both
        pair_set = later.set[mine[both]] if len(both) else both
        # lists of the earlier sets by hash, and where those of a later set are
        order = np.argsort(earlier.h, kind="stable")
        lists, members = earlier.h[order], earlier.member[order]
        order = np.argsort(later.member, kind="stable")
        wanted = later.h[order]
        low, high = np.searchsorted(lists, wanted, "left"), np.searchsorted(lists, wanted, "right")
        of_set = np.searchsorted(later.member[order], np.arange(later.count + 1))
        rows = np.argsort(later.set, kind="stable")
        of_rows = np.searchsorted(later.set[rows], np.arange(later.count + 1))
        # earlier sets: their smallest size; their rows in order
        by = np.lexsort((earlier.ordinal, earlier.n, earlier.set))
        lead = by[_firsts(earlier.set[by])] if len(by) else by
        p_rows = by[_firsts(earlier.set[by], earlier.n[by])] if len(by) else by
        found = []
        for s in range(later.count):
            span = slice(of_set[s], of_set[s + 1])
            common = np.bincount(members[_spread(low[span], high[span] - low[span])], minlength=earlier.count)
            pairs = both[np.searchsorted(pair_set, s) : np.searchsorted(pair_set, s, "right")]
            c[pairs] += common[earlier.set[prior[pairs]]]
            some = np.flatnonzero(common)
            texts = rows[of_rows[s] : of_rows[s + 1]]
            if not len(some):
                continue
            close = np.zeros(earlier.count, bool)
            close[some[common[some] >= threshold * later.n[texts].min() - 0.5]] = True
            near = p_rows[close[earlier.set[p_rows]]] if close.any() else p_rows[:0]
            near = near[np.argsort(earlier.ordinal[near], kind="stable")]
            step = max(1, HELD // (len(some) + len(near)))
            for t in (texts[i : i + step] for i in range(0, len(texts), step)):
                for group, top in ((lead[some], True), (near, False)):
                    if not len(group):
                        continue
                    k = common[earlier.set[group]]
                    sim = k / (later.n[t][:, None].astype(np.int64) + earlier.n[group] - k)
                    pick = sim.argmax(1) if top else (sim >= threshold).argmax(1)
                    found.append((later.doc[t], earlier.ordinal[group[pick]], sim[np.arange(len(t)), pick]))
        found.append((doc, ordinal, c / (n.astype(np.int64) + p_n - c)))
        d, o, s = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((-s, d))
        at = order[_firsts(d[order])] if len(d) else order
        over = np.flatnonzero(s >= threshold)
        order = over[np.lexsort((-s[over], o[over], d[over]))]
        one = order[_firsts(d[order])] if len(order) else order
        best, top = d[at], s[at]
        place = np.searchsorted(best, d[one])
        none, ordinals, sims = np.ones(len(best), bool), np.zeros(len(best), np.int64), np.zeros(len(best))
        none[place], ordinals[place], sims[place] = False, o[one], s[one]
        k = len(best)
        same = lambda x, t: pa.array([x.as_py()] * k, t)
        columns = [same(key[0], pa.string()), same(key[2], pa.int32()), same(key[1], pa.string()), pa.array(best, pa.int64()), pa.array(ordinals, pa.int64(), mask=none), pa.array(sims, pa.float64(), mask=none), pa.array(top, pa.float64())]
        return pa.table(columns, names=["ticker", "rank", "item", "doc", "first_ordinal", "first_sim", "top"])

    return run


def closest(texts: DataFrame, *, threshold: float, part_chars: int = PART_CHARS) -> DataFrame:
    """ticker, rank, item, doc, sim of rows (ticker, rank, item, doc, ordinal, text): the first score at or over the
    threshold among the texts of the rank before, in the order of their ordinals, else the highest. Rows without a common shingle are left out.
    ``doc`` stands for the row: rows that have it in common are one. Tables of a row an item of a filing are broadcast, so that texts stay where they are."""
    at = ["ticker", "item"]
    sizes = texts.groupBy(*at, "rank").agg(F.sum(F.length("text")).alias("chars"))
    blocks = lambda c: F.ceil(c / F.lit(part_chars)).cast("int")
    parts = texts.join(F.broadcast(sizes.groupBy(*at).agg(F.greatest(F.lit(1), blocks(F.sum("chars"))).alias("parts"))), at)
    ready = parts.select(*at, "rank", "doc", F.coalesce(F.col("ordinal").cast("long"), F.lit(-(1 << 63))).alias("ordinal"), "parts", normalise(F.col("text")).alias("norm"))
    met = ready.mapInArrow(_dealt, _PLACE).groupBy(*at, "part").applyInArrow(_met, _MET)
    # both filings of a pair in blocks, each block of the one with each of the other
    count = F.greatest(F.lit(1), blocks(F.col("chars")))
    mine = sizes.select(*at, "rank", count.alias("m"))
    blocked = met.join(F.broadcast(mine), [*at, "rank"]).join(F.broadcast(sizes.select(*at, (F.col("rank") + 1).alias("rank"), count.alias("p"))), [*at, "rank"])
    one = lambda c, k: F.array(F.pmod(F.xxhash64(c), k).cast("int"))
    every = lambda k: F.sequence(F.lit(0), k - 1)
    spread = blocked.withColumn("mb", F.explode(F.when(F.col("kind") == 2, every(F.col("m"))).otherwise(one("doc", F.col("m")))))
    spread = spread.withColumn("pb", F.explode(F.when(F.col("kind") == 1, every(F.col("p"))).otherwise(one("p_doc", F.col("p")))))
    best = spread.groupBy(*at, "rank", "mb", "pb").applyInArrow(_closest(threshold), _BEST)
    first = F.min(F.when(F.col("first_ordinal").isNotNull(), F.struct("first_ordinal", (-F.col("first_sim")).alias("less"))))
    return best.groupBy("ticker", "rank", "item", "doc").agg(F.coalesce(-first["less"], F.max("top")).alias("sim"))
