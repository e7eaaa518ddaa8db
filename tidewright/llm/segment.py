"""Sampled SentencePiece segmentations without replacement, and exact decoding.

The lattice of a text has an edge for each vocabulary piece that matches at a
position; a path's weight is the exponential of ``alpha`` times its pieces' scores.
Perturbing the log-probability of every path with independent Gumbel noise and taking
the k largest draws k distinct paths without replacement. The paths are far too many
to perturb one by one; the search is an A-star search over sets of paths: the largest
perturbed value of a set is a Gumbel variable located at the set's log mass, which is
an exact bound, and a set is only split when it is the best one left. The best path
of a set goes through an edge chosen in proportion to mass (backward sums give
it), and what is left at each node of the path (all other edges there) is a new set,
whose value is drawn from the Gumbel distribution cut off at the value of the set
it was split from.

No piece reaches from a letter into a following space, so the lattice is a chain of
short lattices, one for each word with the spaces before it. Backward sums are computed
once for each distinct word of a batch, for all of them at a time, and draws for
all words of a batch take one array operation a step. Random numbers are a hash of
row key, sample, and position: results depend on the row alone.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from dataclasses import dataclass
from functools import lru_cache
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import col, map_arrow

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_SPACE = "▁"
#: Code points of a batch of texts whose lattices are built together.
BATCH_CHARS = 200_000
#: Nodes of lattices that a task keeps from batch to batch, about 150 bytes each.
HELD_NODES = 1 << 18
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def stream_of(keys: np.ndarray, stream: int) -> np.ndarray:
    """Keys of one stream of random numbers for each row key."""
    return mix(keys + np.uint64(stream * int(_GOLD) % 2**64))


def randoms(streams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1) at positions of streams."""
    h = mix(streams + at.astype(np.uint64) * _GOLD)
    return ((h >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def cut_off(location: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variables at the locations, given that they are below the bound."""
    # the largest of a set below a bound T: -log(exp(-T) + exp(-location) * E), E exponential
    with np.errstate(over="ignore"):
        e = np.log(-np.log(u)) - location
        x = e + bound
        return np.where(x > 40, -e, bound - np.log1p(np.exp(np.minimum(x, 40.0))))


class Vocabulary:
    """Pieces as a dense trie over the alphabet of longer pieces, and their bytes."""

    def __init__(self, path: str, alpha: float):
        from sentencepiece import sentencepiece_model_pb2 as model

        proto = model.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces or not proto.normalizer_spec.add_dummy_prefix or not proto.trainer_spec.byte_fallback:
            raise ValueError("the model must have identity normalisation, a dummy prefix and byte fallback")
        pieces = [(i, p.piece, p.score) for i, p in enumerate(proto.pieces) if p.type == 1]
        if any(re.search(f"[^{_SPACE}]{_SPACE}", p) for _, p, _ in pieces):
            raise ValueError("a piece reaches over a space")
        self.bytes: list[bytes] = [b""] * len(proto.pieces)
        self.byte_ids = [0] * 256
        for i, p in enumerate(proto.pieces):
            if p.type == 1:
                self.bytes[i] = p.piece.replace(_SPACE, " ").encode()
            elif p.type == 6:
                self.bytes[i] = bytes([int(p.piece[3:5], 16)])
                self.byte_ids[self.bytes[i][0]] = i
        self.spelling = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)
        self.spelling_sizes = np.array([len(x) for x in self.bytes], dtype=np.int64)
        self.spelling_starts = np.cumsum(self.spelling_sizes) - self.spelling_sizes
        self.longest = max(len(p) for _, p, _ in pieces)
        letters = sorted({c for _, p, _ in pieces if len(p) > 1 for c in p})
        self.letter = np.zeros(0x110001, dtype=np.int32)  # 0: no longer piece has it
        for k, c in enumerate(letters, 1):
            self.letter[ord(c)] = k
        nodes: dict[str, int] = {"": 0}
        for _, p, _ in pieces:
            if len(p) > 1:
                for n in range(1, len(p) + 1):
                    nodes.setdefault(p[:n], len(nodes))
        self.next = np.zeros((len(nodes), len(letters) + 1), dtype=np.uint16 if len(nodes) < 65536 else np.int32)
        self.piece = np.full(len(nodes), -1, dtype=np.int32)
        self.weight = np.zeros(len(nodes))  # logs, as all weights
        for prefix, n in nodes.items():
            if prefix:
                self.next[nodes[prefix[:-1]], self.letter[ord(prefix[-1])]] = n
        self.single = np.full(0x110001, -1, dtype=np.int32)
        self.single_weight = np.zeros(0x110001)
        for b in range(128):  # one byte spells these, so the edge has that id
            self.single[b] = self.byte_ids[b]
        for i, p, s in pieces:
            w = alpha * s
            if len(p) == 1:
                self.single[ord(p)], self.single_weight[ord(p)] = i, w
            else:
                self.piece[nodes[p]], self.weight[nodes[p]] = i, w

    def decode(self, ids: np.ndarray, cuts: np.ndarray) -> list[bytes]:
        """The exact bytes of each segmentation; ``cuts``: where each begins among the ids, and the end of the last."""
        sizes = self.spelling_sizes[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        kind = np.int32 if ends[-1] < 1 << 31 else np.int64
        at = np.repeat((self.spelling_starts[ids] - ends[:-1]).astype(kind), sizes)
        at += np.arange(ends[-1], dtype=kind)
        held = self.spelling[at].tobytes()
        whole = ends[cuts].tolist()
        # every segmentation but an empty one begins with the space before its text
        return [held[a + 1 : b] for a, b in zip(whole[:-1], whole[1:], strict=True)]


@lru_cache(maxsize=2)
def vocabulary(path: str, alpha: float) -> Vocabulary:
    return Vocabulary(path, alpha)


#: Stands for U+2581 as a character of the text itself, which only bytes can spell.
_LITERAL = "\U0010ffff"


def chunks_of(text: str) -> list[str]:
    """Words, each with the spaces before it but one: a chunk's lattice begins with a space that isn't written here.
    At the end of a text a chunk may be spaces alone."""
    if _SPACE in text:
        text = text.replace(_SPACE, _LITERAL)
    if not text:
        return []
    words = text.split(" ")
    if "" not in words:
        return words
    out, held = [], 0
    for w in words:
        if w:
            out.append(_SPACE * held + w)
            held = 0
        else:
            held += 1
    return [*out, _SPACE * (held - 1)] if held else out


class Lattices:
    """Lattices of distinct chunks, kept over the batches of a task until they hold ``HELD_NODES`` nodes.

    Nodes of a chunk are its code points, the space before it, and its end. Edges stand node by node, by length:
    ``start`` and ``degree`` of a node tell where. Every sum is a sum of logs about its largest term, so neither
    long chunks nor large ``alpha`` leave the range of doubles. For each edge there are the running share of its
    node's mass (``upto``), the log of its own share and the log of what the node's other edges have (``rest``)."""

    NODE = (("start", np.int64), ("degree", np.int32))
    EDGE = (("size", np.int32), ("ids", np.int32), ("upto", np.float64), ("log", np.float64), ("rest", np.float64))
    CHUNK = (("first", np.int64), ("last", np.int64))

    def __init__(self, v: Vocabulary):
        self.v = v
        self.clear()

    def clear(self) -> None:
        self.table: dict[str, int] = defaultdict(count().__next__)
        self.nodes = self.edges = self.chunks = 0
        self.halves: tuple[int, ...] = ()
        for name, kind in (*self.NODE, *self.EDGE, *self.CHUNK):
            held = getattr(self, name, None)
            if held is None or len(held) > 8 * HELD_NODES:  # as one very long text leaves it
                setattr(self, name, np.zeros(64, dtype=kind))

    def numbers(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The number of each chunk; new chunks are added."""
        if self.nodes > HELD_NODES:
            self.clear()
        known = len(self.table)
        out = [np.fromiter(map(self.table.__getitem__, c), np.int64, len(c)) for c in texts]
        if len(self.table) > known:
            self._add(list(islice(self.table, known, None)))
        return out

    def _put(self, kinds, used: int, values) -> None:
        for (name, _), x in zip(kinds, values, strict=True):
            held = getattr(self, name)
            if used + len(x) + 64 > len(held):  # a search may look a few edges beyond the last
                held = np.concatenate([held[:used], np.zeros(used + 2 * len(x) + 64, dtype=held.dtype)])
                setattr(self, name, held)
            held[used : used + len(x)] = x

    def _add(self, chunks: list[str]) -> None:
        v = self.v
        size = np.fromiter(map(len, chunks), np.int64, len(chunks)) + 1  # the space before counts
        first = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
        last = first + size
        n = int(last[-1]) + 1
        points = np.frombuffer((_SPACE + f"\0{_SPACE}".join(chunks) + "\0").encode("utf-32-le"), dtype=np.uint32).astype(np.int32)
        left = (np.repeat(last, size + 1) - np.arange(n)).astype(np.int32)  # code points to the chunk's end
        letters = v.letter[points]
        at = np.nonzero(left > 0)[0]
        state = v.next[0, letters[at]]
        hits = [(1, at, v.single[points[at]], v.single_weight[points[at]])]
        degree = (left > 0).astype(np.int32)
        for length in range(2, v.longest + 1):
            go = np.nonzero((state > 0) & (left[at] >= length))[0]
            if not len(go):
                break
            at = at[go]
            state = v.next[state[go], letters[at + length - 1]]
            hit = np.nonzero(v.piece[state] >= 0)[0]
            if len(hit):
                node, state_there = at[hit], state[hit]
                degree[node] += 1
                hits.append((length, node, v.piece[state_there], v.weight[state_there]))
        # edges stand by their node's distance from the end, then node, then length: sums go from the end of all chunks at once
        node = np.argsort(left.astype(np.uint16) if left.max() < 65536 else left, kind="stable")[len(chunks) :]
        degrees = degree[node]
        begin = np.cumsum(degrees) - degrees
        start = np.zeros(n, dtype=np.int64)
        start[node] = begin
        total, free = int(degrees.sum()), start.copy()
        head, step, ids, x = np.empty(total, np.int64), np.empty(total, np.int32), np.empty(total, np.int32), np.empty(total)
        for length, own, piece, weight in hits:
            place = free[own]
            head[place], step[place], ids[place], x[place] = own, length, piece, weight
            free[own] += 1
        after = np.zeros(n)
        bounds = np.searchsorted(left[node], np.arange(1, int(left.max()) + 2))
        ends = np.append(begin, total)
        ahead = head + step
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            a, b = ends[lo], ends[hi]
            x[a:b] += after[ahead[a:b]]
            after[node[lo:hi]] = log_sums(x[a:b], begin[lo:hi] - a, degrees[lo:hi])
        x -= after[head]
        share = np.exp(x)
        with np.errstate(divide="ignore"):
            rest = np.log1p(-np.minimum(share, 1.0))
        # an edge with nearly all of its node's mass: what the others have is summed, not found as a difference of nearly equal numbers
        heavy = np.nonzero(share > 1 - 1e-6)[0]
        rest[heavy[degree[head[heavy]] == 1]] = -np.inf
        heavy = heavy[degree[head[heavy]] > 1]
        if len(heavy):
            own = degree[head[heavy]]
            base = np.cumsum(own) - own
            every = np.repeat(start[head[heavy]] - base, own) + np.arange(int(own.sum()))
            others = np.where(every == np.repeat(heavy, own), -np.inf, x[every])
            rest[heavy] = log_sums(others, base, own)
        place = np.arange(total) - np.repeat(begin, degrees)
        width, jump = int(degrees.max()), 1
        while jump < width:
            share[jump:] += np.where(place[jump:] >= jump, share[:-jump], 0.0)
            jump *= 2
        share[begin + degrees - 1] = np.inf  # whatever rounding left of 1
        self._put(self.NODE, self.nodes, (start + self.edges, degree))
        self._put(self.EDGE, self.edges, (step, ids, share, x, rest))
        self._put(self.CHUNK, self.chunks, (first + self.nodes, last + self.nodes))
        self.nodes, self.edges, self.chunks = self.nodes + n, self.edges + total, self.chunks + len(chunks)
        while (1 << len(self.halves)) < width:
            self.halves = (1 << len(self.halves), *self.halves)

    def draw(self, nodes: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge from each node, chosen in proportion to mass: the first whose running share reaches u."""
        edge, stop = self.start[nodes], self.degree[nodes]
        stop += edge
        for step in self.halves:
            ahead = edge + step
            go = ahead < stop
            go &= self.upto[ahead - 1] < u
            edge += step * go
        return edge

    def among(self, node: int, barred: list[int], u: float) -> tuple[int, float]:
        """An edge from the node that isn't barred, and the log of the share of all such edges."""
        a = int(self.start[node])
        x = self.log[a : a + int(self.degree[node])].copy()
        x[np.array(barred) - a] = -np.inf
        top = x.max()
        up = np.cumsum(np.exp(x - top))
        return a + int(np.searchsorted(up, u * up[-1], side="left")), float(top + np.log(up[-1]))

    def open_share(self, node: int, barred: list[int]) -> float:
        """Log of the share of the edges that aren't barred."""
        a, n = int(self.start[node]), int(self.degree[node])
        return self.among(node, barred, 0.5)[1] if len(barred) < n else -np.inf


def log_sums(x: np.ndarray, begin: np.ndarray, degree: np.ndarray) -> np.ndarray:
    """Log of the sum of exponentials of each run of x; a run of nothing but -inf has -inf."""
    top = np.maximum.reduceat(x, begin)
    top[top == -np.inf] = 0.0
    with np.errstate(divide="ignore"):
        return top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, degree)), begin))


@dataclass
class Path:
    """Edges of a path, the chunk of each, and where each begins in its text."""

    edges: np.ndarray
    chunk: np.ndarray
    where: np.ndarray


def sample_batch(texts: list[str], keys: np.ndarray, lat: Lattices, k: int):
    """For each text its samples, best first: (ids, log probability, log of the
    probability of inclusion among k)."""
    occ = lat.numbers([chunks_of(t) for t in texts])
    begin = [np.concatenate([[0], np.cumsum(lat.last[x] - lat.first[x])]) for x in occ]  # where each chunk begins in its text
    docs = [d for d in range(len(texts)) if len(occ[d])]
    results: list[list] = [[] if len(x) else [(np.zeros(0, np.int32), 0.0, 0.0)] for x in occ]
    if not docs:
        return results

    def paths(jobs, stream) -> list[Path]:
        """jobs: (doc, first chunk, node in it or None for its first). The steps drawn for each job."""
        sizes = [len(occ[d]) - c for d, c, _ in jobs]
        heads = np.cumsum([0, *sizes])
        number = np.concatenate([np.arange(c, len(occ[d])) for d, c, _ in jobs])
        chunk = np.concatenate([occ[d][c:] for d, c, _ in jobs])
        first, end = lat.first[chunk], lat.last[chunk]
        shift = np.concatenate([begin[d][c:-1] for d, c, _ in jobs]) - first
        key = np.repeat(stream_of(keys[[d for d, _, _ in jobs]], stream), sizes)
        node = first.copy()
        for j, (_, _, at) in enumerate(jobs):
            if at is not None:
                node[heads[j]] = at
        live = np.nonzero(node < end)[0]
        got_at, got_edge, got_where = [], [], []
        now, key, shift, end = node[live], key[live], shift[live], end[live]
        while len(live):
            where = now + shift
            edge = lat.draw(now, randoms(key, where))
            got_at.append(live)
            got_edge.append(edge)
            got_where.append(where)
            now = now + lat.size[edge]
            go = np.nonzero(now < end)[0]
            live, now, key, shift, end = live[go], now[go], key[go], shift[go], end[go]
        at, edges, where = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (got_at, got_edge, got_where))
        order = np.argsort(at, kind="stable")
        at, edges, where = at[order], edges[order], where[order]
        cuts = np.searchsorted(at, heads)
        number = number[at]
        return [Path(edges[a:b], number[a:b], where[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    heaps: dict[int, list] = {d: [] for d in docs}
    found: dict[int, list] = {d: [] for d in docs}

    def note(entries, stream):
        """Adds paths, each (doc, path, value, fresh, barred), and the sets that are left beside each from its step
        ``fresh`` on; barred: edges that were taken before at that step."""
        befores, locations, wheres = [], [], []
        for d, path, _, fresh, barred in entries:
            before = np.concatenate([[0.0], np.cumsum(lat.log[path.edges])])
            rest = lat.rest[path.edges[fresh:]]
            if barred and len(rest):
                edge = int(path.edges[fresh])
                rest[0] = lat.open_share(node_of(d, path, fresh), [*barred, edge])
            befores.append(before)
            locations.append(before[fresh:-1] + rest)
            wheres.append(path.where[fresh:])
        sizes = [len(x) for x in locations]
        bounds = np.repeat([e[2] for e in entries], sizes)
        streams = np.repeat(stream_of(keys[[e[0] for e in entries]], stream), sizes)
        values = cut_off(np.concatenate(locations), bounds, randoms(streams, np.concatenate(wheres)))
        cuts = np.cumsum([0, *sizes]).tolist()
        for i, (d, path, bound, fresh, barred) in enumerate(entries):
            found[d].append((path, float(befores[i][-1])))
            left, g = k + 1 - len(found[d]), values[cuts[i] : cuts[i + 1]]
            if left > 0 and len(g):
                best = np.argpartition(-g, left - 1)[:left] if len(g) > left else np.arange(len(g))
                for t in best.tolist():
                    if g[t] > -np.inf:
                        taken = [*barred, int(path.edges[fresh])] if t == 0 else [int(path.edges[fresh + t])]
                        heapq.heappush(heaps[d], (-float(g[t]), fresh + t, taken, path))

    def node_of(d: int, path: Path, t: int) -> int:
        c = int(path.chunk[t])
        return int(path.where[t] - begin[d][c] + lat.first[occ[d][c]])

    values = -np.log(-np.log(randoms(stream_of(keys[docs], 0), np.zeros(len(docs), np.int64))))
    note([(d, p, g, 0, []) for d, p, g in zip(docs, paths([(d, 0, None) for d in docs], 1), values.tolist(), strict=True)], 2)
    for s in range(1, k):
        jobs, heads = [], []
        for d in docs:
            if not heaps[d]:
                continue
            g, t, taken, path = heapq.heappop(heaps[d])
            node = node_of(d, path, t)
            u = float(randoms(stream_of(keys[d : d + 1], 3 * s + 2), path.where[t : t + 1])[0])
            edge, _ = lat.among(node, taken, u)
            jobs.append((d, int(path.chunk[t]), node + int(lat.size[edge])))
            heads.append((d, -g, t, taken, path, edge))
        if not jobs:
            break
        entries = []
        for (d, g, t, taken, path, edge), tail in zip(heads, paths(jobs, 3 * s), strict=True):
            joined = Path(np.concatenate([path.edges[:t], [edge], tail.edges]), np.concatenate([path.chunk[: t + 1], tail.chunk]), np.concatenate([path.where[: t + 1], tail.where]))
            entries.append((d, joined, g, t, taken))
        note(entries, 3 * s + 1)
    for d in docs:
        kappa = -heaps[d][0][0] if heaps[d] and len(found[d]) == k else -np.inf
        for path, phi in found[d]:
            ids = lat.ids[path.edges]
            if (ids < 0).any():
                ids = spelt(ids, texts[d], path.where, lat.v)
            # P(value > kappa) = 1 - exp(-exp(phi - kappa)); near exp(phi - kappa) where that is small
            x = phi - kappa
            inclusion = 0.0 if x > 30 else x if x < -30 else float(np.log(-np.expm1(-np.exp(x))))
            results[d].append((ids, phi, inclusion))
    return results


def spelt(ids: np.ndarray, text: str, where: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Ids in which each -1, a code point that no piece has, is spelt in bytes. Places count the space before the text."""
    out: list[int] = []
    for i, at in zip(ids.tolist(), where.tolist(), strict=True):
        out += [i] if i >= 0 else [v.byte_ids[b] for b in text[at - 1].encode()]
    return np.array(out, dtype=np.int32)


def batches_of(texts: list[str]):
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BATCH_CHARS:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def _nested(flat: pa.Array, outer: np.ndarray, inner: np.ndarray | None = None) -> pa.Array:
    if inner is not None:
        flat = pa.ListArray.from_arrays(pa.array(inner, pa.int32()), flat)
    return pa.ListArray.from_arrays(pa.array(outer, pa.int32()), flat)


def sample_segmentations(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, samples: int = 2, alpha: float = 2e-4, seed: int = 42, model_path: str = DEFAULT_MODEL
) -> DataFrame:
    """The kept columns (the id by default) and, in parallel arrays by falling perturbed
    value, segmentations (piece ids), log_probs and log_inclusions (log probability that the
    segmentation is among ``samples``; 0 if the text has no more); and decodes, whether every segmentation was
    decoded to the exact text.

    Segmentations of a row are distinct; a text with fewer than ``samples`` has them all. Null and empty texts have
    one empty segmentation. The draw depends on the id as text, the seed and the text: repeated rows get equal
    results. An empty table gives no rows. Memory follows the longest text. Every worker reads the model at
    ``model_path``.
    """
    if samples < 1:
        raise ValueError("samples must be positive")

    def make():
        lat = Lattices(vocabulary(model_path, alpha))

        def step(keys, texts):
            whole = [t or "" for t in texts.to_pylist()]
            key = keys.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            got = [x for a, b in batches_of(whole) for x in sample_batch(whole[a:b], key[a:b], lat, samples)]
            flat = [s for x in got for s in x]
            outer, inner = np.cumsum([0] + [len(x) for x in got]), np.cumsum([0] + [len(s[0]) for s in flat])
            ids = np.concatenate([np.zeros(0, np.int32), *[s[0] for s in flat]])
            back = lat.v.decode(ids, inner)
            exact = [all(b == t.encode() for b in back[i:j]) for t, i, j in zip(whole, outer[:-1].tolist(), outer[1:].tolist(), strict=True)]
            logs = [_nested(pa.array([s[i] for s in flat], pa.float64()), outer) for i in (1, 2)]
            return [_nested(pa.array(ids, pa.int32()), outer, inner), *logs, pa.array(exact, pa.bool_())]

        return step

    key = F.xxhash64(F.lit(seed), F.coalesce(col(id_col).cast("string"), F.lit("")))
    fields = [("segmentations", T.ArrayType(T.ArrayType(T.IntegerType()))), ("log_probs", T.ArrayType(T.DoubleType())), ("log_inclusions", T.ArrayType(T.DoubleType())), ("decodes", T.BooleanType())]
    return map_arrow(docs, [key, col(text_col).cast("string")], keep or [id_col], fields, make)


def decode_segmentations(rows: DataFrame, *, ids_col: str = "segmentations", keep: list[str], alpha: float = 2e-4, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """The kept columns and decoded_texts: the exact text of each segmentation; null where the segmentations are."""

    def make():
        v = vocabulary(model_path, alpha)

        def step(x):
            out = []
            for row in x.to_pylist():
                cuts = np.cumsum([0] + [len(s) for s in row or []])
                ids = np.fromiter((i for s in row or [] for i in s), np.int64, int(cuts[-1]))
                out.append(None if row is None else [b.decode() for b in v.decode(ids, cuts)])
            return [pa.array(out, pa.list_(pa.string()))]

        return step

    return map_arrow(rows, [col(ids_col)], keep, [("decoded_texts", T.ArrayType(T.StringType()))], make)
