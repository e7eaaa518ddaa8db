"""SimHash near-duplicate detection over pigeonhole blocks.

Fingerprints of equal texts are collapsed first, so a group of copies is one node.
A 64-bit fingerprint is cut into ``blocks`` blocks; two fingerprints that differ in at
most ``max_distance`` bits agree on at least ``blocks - max_distance`` of them, so
each choice of that many blocks is a join key, and pairs in a bucket are verified by
the Hamming distance.

Buckets of more than ``bucket_pairs`` fingerprints would need pairs by the square.
Their members take an exact way that stays linear: two fingerprints are within 2r
bits (r = ceil(max_distance / 2)) of each other only if some word is within r bits of
both, so each member names all words within r bits of it, and members that name
the same word are candidates. For a distance of 2 a word is named by at most 65
fingerprints, which are within 2 bits of each other: a star of verified links is enough.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from fractions import Fraction
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import HOT_KEYS, col, join_keyed, map_arrow, materialize, raw, release
from .components import components


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles, repeats included, as rows of eight bytes,
    highest first."""
    words = text.lower().split()  # bytes: A-Z only; splits at \x20 and \x09-\x0D
    if not words:
        return np.zeros((0, 8), dtype=np.uint8)
    n = len(words) - shingle + 1
    parts = [b" ".join(words)] if n < 1 else map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, parts, repeat(42))), dtype=np.uint8).reshape(-1, 8)


def fingerprint_of(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half of the hashes; none: 0."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 16384):
        ones += np.unpackbits(hashes[at : at + 16384], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes, shingle: int) -> int:
    return fingerprint_of(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, *, text_col: str = "text", keep: list[str], shingle: int = 3, name: str = "fp") -> DataFrame:
    """The kept columns and the fingerprint of the whole text as a signed long."""

    def make():
        def step(texts):
            found = np.array([fingerprint(t, shingle) for t in raw(texts)], dtype=np.uint64)
            return [pa.array(found.view(np.int64))]

        return step

    return map_arrow(docs, [col(text_col).cast("string")], keep, [(name, T.LongType())], make)


def _block_masks(blocks: int) -> list[int]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_pairs(fps: DataFrame, *, max_distance: int = 2, blocks: int = 4, bucket_pairs: int = 64) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp): enough of them for the
    same components as all pairs within the distance, each verified."""
    masks = [_signed(sum(c)) for c in combinations(_block_masks(blocks), blocks - max_distance)]
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("k", "v"))
    sizes = keyed.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"), F.count(F.lit(1)).alias("many")).where("n > 1")
    member = materialize(join_keyed(keyed, sizes, ["k", "v"], "many", fps.count() * len(masks)))
    small = member.where(F.col("n") <= bucket_pairs)
    pairs = (
        small.select("k", "v", F.col("fp").alias("a"))
        .join(small.select("k", "v", F.col("fp").alias("b")), ["k", "v"])
        .where((F.col("a") > F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance))
        .select("a", "b")
    )
    large = member.where(F.col("n") > bucket_pairs).select("fp").distinct()
    radius = (max_distance + 1) // 2
    flips = [0] + [_signed(sum(1 << i for i in c)) for r in range(1, radius + 1) for c in combinations(range(64), r)]
    named = large.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(x)) for x in flips])).alias("w"))
    lists = named.groupBy("w").agg(F.sort_array(F.collect_list("fp")).alias("s")).where(F.size("s") > 1)
    if 2 * radius <= max_distance:  # all that name a word are within the distance
        hot = lists.select(F.col("s")[0].alias("b"), F.explode(F.slice("s", 2, 1 << 30)).alias("a"))
    else:  # some may be one bit too far: a link to each later one, verified
        one = lists.select("s", F.explode("s").alias("b"))
        hot = one.select("b", F.explode("s").alias("a")).where((F.col("a") > F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance))
    return pairs.unionByName(hot.select("a", "b")).distinct()


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    max_distance: int = 2,
    blocks: int = 4,
    bucket_pairs: int = 64,
) -> DataFrame:
    """One row for each document row: the id, fingerprint (16 lowercase hex digits) and
    component_id, the smallest id among all documents that links reach.

    Null and empty texts have fingerprint zero and link like any other; texts of fewer
    words than a shingle are one shingle. Repeated rows each get their row. A null id
    never names a component: it gets the smallest other id, or null if there is none.
    An empty table gives no rows.
    """
    marked = materialize(fingerprints(docs, text_col=text_col, keep=[id_col], shingle=shingle, name="tidewright fp").select(col(id_col).alias("id"), F.col("`tidewright fp`").alias("fp")))
    nodes = materialize(marked.groupBy("fp").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("many")))
    roots = components(near_pairs(nodes.select("fp"), max_distance=max_distance, blocks=blocks, bucket_pairs=bucket_pairs))
    return _grouped(marked, nodes, roots, id_col)


def _grouped(marked: DataFrame, nodes: DataFrame, roots: DataFrame, id_col: str) -> DataFrame:
    """Rows (id, fp) with the smallest id (low, by fingerprint) of their component; many: rows of a fingerprint."""
    placed = materialize(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "low", "many", F.coalesce("root", "fp").alias("root")))
    lows = placed.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("nodes"))
    owner = materialize(join_keyed(placed, lows, ["root"], "nodes", placed.count()).select("fp", "component_id", "many"))
    out = join_keyed(marked, owner, ["fp"], "many", marked.count())
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: The fingerprints that documents are linked by first: words of a shingle, bits that may differ, blocks.
PRINT_SHINGLE, PRINT_DISTANCE, PRINT_BLOCKS = 3, 2, 4
#: Members of a list that a task compares with others at once.
LIST_PART = 256
#: Members of a large list that all others are compared with in a turn, and pairs that a turn verifies for a node.
PIVOTS = 4
#: Turns with pivots at most, and comparisons a member that are few enough for all pairs.
TURNS, FEW_PAIRS = 6, 16
#: Texts that the order of shingles is learnt from (an expectation), and shingles in that order, most frequent last.
ORDER_TEXTS, ORDER_SHINGLES = 65536, 1 << 18
#: Classes of hashes that are marked in a broadcast: many more than rows in groups, so that few rows beside those are shuffled.
CLASS_BITS = 24
_ODD = 0x9E3779B97F4A7C15


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The distinct shingles as sorted 64-bit hashes: sums of the XXH64 of their words, each times an odd number of its place."""
    words = text.lower().split()
    size = min(shingle, len(words))
    each = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), dtype=np.uint64)
    out = np.zeros(len(words) - size + 1 if words else 0, dtype=np.uint64)
    for i in range(size):
        out += each[i : i + len(out)] * np.uint64(pow(_ODD, i + 1, 1 << 64))
    return np.unique(out)


def size_edges(least: Fraction) -> list[int]:
    """The smallest sizes of bins of set sizes. Two sets of the least similarity are in one bin or in neighbouring ones."""
    wide, edges = min(least, Fraction(4, 5)), [1]
    while edges[-1] < 1 << 31:
        edges.append(edges[-1] * wide.denominator // wide.numerator + 1)
    return edges


def list_keys(ordered: np.ndarray, least: Fraction, edges: list[int]) -> tuple[np.ndarray, int]:
    """The lists that a set is in, and how many of them are of its own bin of sizes: a list is of a shingle and a bin. ordered:
    the set in the common order. Of its own bin are the first shingles, all but ceil(least * n) - 1. Then follow, from the first
    on, those of the next bin: a set of that bin is larger, so the first shingle that both have stands earlier in this set."""
    n, up, down = len(ordered), least.numerator, least.denominator
    if not n:
        return ordered, 0
    at = bisect_right(edges, n) - 1
    own = n + 1 + -n * up // down
    next_bin = max(0, n + 1 + -up * (n + edges[at + 1]) // (up + down))  # overlap of up / (up + down) of both sizes at least
    marks = [np.uint64(b * _ODD % (1 << 64)) for b in (at, at + 1)]
    return np.concatenate([ordered[:own] + marks[0], ordered[:next_bin] + marks[1]]), own


def _set_key(found: np.ndarray) -> int:
    return _signed(xxhash.xxh64_intdigest(found.tobytes(), 11))


def _long_lists(rows: list[np.ndarray]) -> pa.Array:
    cuts = pa.array(np.cumsum([0] + [len(x) for x in rows]), pa.int32())
    return pa.ListArray.from_arrays(cuts, pa.array(np.concatenate([np.zeros(0, dtype=np.uint64), *rows]).view(np.int64)))


def _frequent(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles found in three or more texts of a sample, sorted, and their counts. They only order the
    shingles: whatever the sample, the same pairs are found."""
    share = -(-texts.count() // ORDER_TEXTS)
    part = texts.where(F.pmod(F.xxhash64("t"), F.lit(max(1, share))) == 0).distinct()

    def make():
        return lambda ts: [_long_lists([shingle_set(t, shingle) for t in raw(ts)])]

    seen = map_arrow(part, [F.col("t")], [], [("s", T.ArrayType(T.LongType()))], make).select(F.explode("s").alias("k"))
    top = seen.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 2").orderBy(F.desc("n"), "k").limit(ORDER_SHINGLES).toArrow()
    keys = top["k"].to_numpy().view(np.uint64)
    at = np.argsort(keys)
    return keys[at], top["n"].to_numpy()[at]


def parity_map(found: np.ndarray) -> np.ndarray:
    """For each of m classes of shingles whether the set has an odd number of them, as longs; m is the power of two
    from the size of the set up, 64 at least. Two sets differ in at least as many shingles as their maps differ in bits. A map
    of m classes is made one of m / 2 by the difference of its halves."""
    m = max(64, 1 << (len(found) - 1).bit_length()) if len(found) else 64
    c = (((found * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) & np.uint64(m - 1)).astype(np.int64)
    return np.packbits((np.bincount(c, minlength=m) & 1).astype(np.uint8)).view(np.int64)


def _map_distance(x: Column, y: Column) -> Column:
    """Bits in which two parity maps differ, the larger one halved; their sizes are equal or a factor of two apart."""
    size = F.least(F.size(x), F.size(y))
    other = lambda z: F.when(F.size(z) > size, F.zip_with(F.slice(z, F.lit(1), size), F.slice(z, size + 1, size), lambda p, q: p.bitwiseXOR(q))).otherwise(z)
    return F.aggregate(F.zip_with(other(x), other(y), lambda p, q: F.bit_count(p.bitwiseXOR(q)).cast("int")), F.lit(0), lambda p, q: p + q)


def _attach(pairs: DataFrame, values: DataFrame, side: str, hot: DataFrame) -> DataFrame:
    """The pairs with the value (v, by fp) of one side as v_a or v_b. hot: nodes with over one in HOT_KEYS of all
    pairs, so fewer than that, and parts; their value is given once to each part of their pairs."""
    other = "b" if side == "a" else "a"
    dealt = pairs.join(F.broadcast(hot), side, "left").withColumn("part", F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    spread = values.select(F.col("fp").alias(side), F.col("v").alias(f"v_{side}")).join(F.broadcast(hot), side, "left")
    copies = spread.select(side, f"v_{side}", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    return dealt.join(copies, [side, "part"]).drop("part")


def _class_marks(hashes: DataFrame) -> DataFrame:
    """Which of 2^CLASS_BITS classes hold a hash (column h), as words of 64 bits: at most 2^(CLASS_BITS - 6) rows, few enough to
    broadcast. Rows of other classes need no shuffle; where all classes hold something, nothing is saved and nothing lost."""
    c = F.shiftrightunsigned("h", 64 - CLASS_BITS)
    bits = hashes.select(F.shiftright(c, 6).alias("tidewright word"), c.bitwiseAND(F.lit(63)).cast("int").alias("at"))
    return bits.groupBy("tidewright word").agg(F.expr("bit_or(shiftleft(1L, at))").alias("tidewright mask"))


def _of_classes(rows: DataFrame, h: Column, marks: DataFrame, held: bool) -> DataFrame:
    """The rows whose hash is in a marked class, or those whose hash is in none; they stay where they are."""
    names = rows.columns
    c = F.shiftrightunsigned(h, 64 - CLASS_BITS)
    met = rows.withColumn("tidewright class", c).withColumn("tidewright word", F.shiftright("tidewright class", 6)).join(F.broadcast(marks), "tidewright word", "left")
    bit = F.getbit(F.coalesce(col("tidewright mask"), F.lit(0).cast("long")), col("tidewright class").bitwiseAND(F.lit(63)).cast("int"))
    return met.where(bit == int(held)).select(*[col(n) for n in names])


def _hot_sides(pairs: DataFrame) -> dict[str, DataFrame]:
    total = max(1, pairs.count())
    out = {}
    for side in ("a", "b"):
        counted = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("of")).where(F.col("of") * HOT_KEYS > total)
        out[side] = counted.select(side, F.ceil(F.col("of") * HOT_KEYS / F.lit(total)).cast("int").alias("parts"))
    return out


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int, least: Fraction) -> DataFrame:
    """The pairs (a, b) whose sets of shingles have the least similarity, counted exactly. A pair whose parity maps
    differ in more bits than so similar sets differ in shingles is out; of the others' nodes the sets are made again from their texts."""
    up, down = least.numerator, least.denominator
    hot = _hot_sides(pairs)
    maps = nodes.select("fp", F.struct("n", "m").alias("v"))
    both = _attach(_attach(pairs, maps, "a", hot["a"]), maps, "b", hot["b"])
    apart = _map_distance(F.col("v_a.m"), F.col("v_b.m"))
    close = materialize(both.where((up + down) * apart <= (down - up) * (F.col("v_a.n") + F.col("v_b.n"))).select("a", "b"))
    asked = close.select(F.col("a").alias("fp")).unionByName(close.select(F.col("b").alias("fp"))).distinct()
    wanted = materialize(nodes.join(asked, "fp", "left_semi").select("h"))

    def make():
        def step(ts):
            found = [shingle_set(t, shingle) for t in raw(ts)]
            return [pa.array([_set_key(x) for x in found], pa.int64()), _long_lists(found)]

        return step

    # most texts are in no pair
    there = _of_classes(texts.withColumn("h", F.xxhash64("t")), F.col("h"), _class_marks(wanted), True).join(wanted.hint("shuffle_merge"), "h", "left_semi")
    made = map_arrow(there.select("t"), [F.col("t")], [], [("fp", T.LongType()), ("v", T.ArrayType(T.LongType()))], make)
    sets = materialize(made.groupBy("fp").agg(F.first("v").alias("v")))
    hot = _hot_sides(close)
    whole = _attach(_attach(close, sets, "a", hot["a"]), sets, "b", hot["b"])
    good = materialize(whole.where((up + down) * F.size(F.array_intersect("v_a", "v_b")).cast("long") >= up * (F.size("v_a") + F.size("v_b")).cast("long")).select("a", "b"))
    release(close, wanted, sets)
    return good


def _few(pairs: DataFrame, turn: int) -> DataFrame:
    """At most PIVOTS of the pairs of each a, the same b for many."""
    picked = pairs.groupBy("a").agg(F.array_distinct(F.array(*[F.min_by("b", F.xxhash64("b", F.lit(PIVOTS * turn + i))) for i in range(PIVOTS)])).alias("b"))
    return picked.select("a", F.explode("b").alias("b"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _print_pairs(nodes: DataFrame, max_distance: int, blocks: int) -> DataFrame:
    """Pairs of nodes by their fingerprints (column print), at most PIVOTS for each: nodes of one fingerprint with the smallest
    of them, and those of fingerprints within the distance."""
    first = materialize(nodes.groupBy("print").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("of")))
    near = materialize(_few(near_pairs(first.select(F.col("print").alias("fp")), max_distance=max_distance, blocks=blocks), 0))
    hot, values = _hot_sides(near), first.select(F.col("print").alias("fp"), "v")
    apart = _attach(_attach(near, values, "a", hot["a"]), values, "b", hot["b"]).select(F.col("v_a").alias("a"), F.col("v_b").alias("b"))
    same = join_keyed(nodes.select("print", F.col("fp").alias("a")), first.where("of > 1").select("print", F.col("v").alias("b"), "of"), ["print"], "of", nodes.count())
    out = materialize(_ordered(apart.unionByName(same.where("a <> b").select("a", "b"))))
    release(first, near)
    return out


def _similar(docs: DataFrame, key: Column, text_col: str, shingle: int, similarity: float, bucket_pairs: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (id: the key, fp), nodes (fp, low: smallest key) and the root of each node that has a link."""
    least = Fraction(str(similarity))
    up, down = least.numerator, least.denominator
    rows = docs.select(key.alias("id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("t"))
    texts = rows.select("t")
    keys, counts = _frequent(texts, shingle)
    edges = size_edges(least)

    def make():
        def step(ts):
            whole = raw(ts)
            found = [shingle_set(t, shingle) for t in whole]
            prints = np.array([fingerprint(t, PRINT_SHINGLE) for t in whole], dtype=np.uint64)
            lists = []
            for x in found:
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
                    x = x[np.lexsort((x, np.where(keys[at] == x, counts[at], 0)))]
                lists.append(list_keys(x, least, edges))
            maps = _long_lists([parity_map(x).view(np.uint64) for x in found])
            return [pa.array([_set_key(x) for x in found], pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array(prints.view(np.int64)), _long_lists([x for x, _ in lists]), pa.array([own for _, own in lists], pa.int64()), maps]

        return step

    longs = T.ArrayType(T.LongType())
    mapped = map_arrow(rows.withColumn("h", F.xxhash64("t")), [F.col("t")], ["id", "h"], [("fp", T.LongType()), ("n", T.LongType()), ("print", T.LongType()), ("p", longs), ("own", T.LongType()), ("m", longs)], make)
    marked = materialize(mapped.withColumn("row", F.monotonically_increasing_id()))
    # texts with the same set are one node; its prefix is that of one of its rows
    nodes = materialize(marked.groupBy("fp").agg(F.min("id").alias("low"), F.min(F.struct("row", "h", "n", "print", "m")).alias("one"), F.count(F.lit(1)).alias("many")).select("fp", "low", "one.*", "many"))
    near = _print_pairs(nodes, PRINT_DISTANCE, PRINT_BLOCKS)
    links = _verified(near, nodes, texts, shingle, least)
    roots = components(links)
    release(near, links)

    # rows, copies too: what a list has at most; a list with no set of its own bin has pairs that meet elsewhere
    shared = marked.select("own", F.posexplode("p").alias("i", "k")).groupBy("k").agg(F.count(F.lit(1)).alias("rows"), F.max(F.col("i") < F.col("own")).alias("has_own"))
    shared = materialize(shared.where("rows > 1 AND has_own").select("k", "rows"))
    placed = nodes.select("row", "fp").join(roots, F.col("fp") == F.col("node"), "left").select("row", F.coalesce("root", "fp").alias("root"))
    place = F.col("i") - F.when(F.col("i") < F.col("own"), 0).otherwise(F.col("own"))
    posted = marked.join(placed, "row").select("fp", "n", "own", "root", F.posexplode("p").alias("i", "k")).select("fp", "k", "n", (F.col("n") - place).alias("rest"), "root")
    total = marked.agg(F.coalesce(F.sum(F.size("p")), F.lit(0))).first()[0]
    listed = materialize(join_keyed(posted, shared, ["k"], "rows", total))
    many = F.count(F.lit(1))
    # a list that the fingerprints have joined has no link to find
    sizes = materialize(listed.groupBy("k").agg(many.alias("many"), many.alias("of"), F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").drop("r", "s"))
    member = materialize(join_keyed(listed, sizes, ["k"], "of", listed.count()))
    release(shared, listed, sizes)

    def paired(x: DataFrame, y: DataFrame, keys: tuple[str, ...] = ("k",)) -> DataFrame:
        """Pairs of a list in two components that may be similar by their sizes, and by what follows if this shingle is the first that they share."""
        one, two = (z.select(*keys, *[F.col(c).alias(f"{c}_{side}") for c in z.columns if c not in keys]) for z, side in ((x, "a"), (y, "b")))
        return fits(one.join(two, list(keys)))

    def fits(both: DataFrame) -> DataFrame:
        return both.where((F.col("root_a") != F.col("root_b")) & ((up + down) * F.least("rest_a", "rest_b") >= up * (F.col("n_a") + F.col("n_b"))))

    def linked(pairs: DataFrame) -> DataFrame:
        """The roots, with the links among the pairs."""
        pairs = materialize(pairs)
        if pairs.isEmpty():
            release(pairs)
            return roots
        more = _verified(pairs, nodes, texts, shingle, least)
        whole = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
        release(pairs, more, roots)
        return whole

    base = ["k", "fp", "n", "rest", "root"]
    small, large = member.where(F.col("many") <= bucket_pairs).select(*base), member.where(F.col("many") > bucket_pairs)
    asked = paired(small, small).where("fp_a > fp_b").select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))
    # the large lists by node: a node's root is looked up once, not in each of its lists
    packs = materialize(large.groupBy("fp", "n").agg(F.collect_list(F.struct("k", "rest")).alias("lists")))
    before = None
    for turn in range(TURNS + 1):
        placed = packs.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "n", F.coalesce("root", "fp").alias("root"), F.explode("lists").alias("e"))
        placed = materialize(placed.select("e.k", "fp", "n", "e.rest", "root"))
        picks = [F.min_by("fp", F.xxhash64("fp", F.lit(PIVOTS * turn + i))) for i in range(PIVOTS)]
        shares = placed.groupBy("k", "root").agg(F.count(F.lit(1)).alias("of"))
        most = shares.groupBy("k").agg(F.max_by("root", F.struct("of", "root")).alias("most"), F.max("of").alias("in_most"), F.count(F.lit(1)).alias("parts"), F.sum("of").alias("members")).where("parts > 1")
        open_lists = materialize(most.select("k", "most", "members", F.col("members").alias("of"), ((F.col("members") - F.col("in_most")) * F.col("members")).alias("pairs")))
        left, members = open_lists.agg(F.coalesce(F.sum("pairs"), F.lit(0)), F.coalesce(F.sum("members"), F.lit(0))).first()
        split = materialize(join_keyed(placed, open_lists.drop("pairs"), ["k"], "of", placed.count()))
        release(placed, open_lists)
        if turn and (turn == TURNS or left <= FEW_PAIRS * members or (turn > 1 and 4 * left > 3 * before)):
            break
        before = left
        # in a turn members meet pivots, mostly the same ones in all lists of a group, in however many tasks they are
        pivots = materialize(split.groupBy("k").agg(F.array_distinct(F.array(*picks)).alias("pivots"), F.count(F.lit(1)).alias("of")))
        chosen = join_keyed(split, pivots, ["k"], "of", members).where(F.array_contains("pivots", F.col("fp")))
        ends = lambda z, side, *more: z.select("k", *[F.col(c).alias(f"{c}_{side}") for c in base[1:]], *more)
        star = fits(join_keyed(ends(split, "a"), ends(chosen, "b", "members"), ["k"], "members", members))
        star = _few(star.select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b")), turn)
        roots = linked(_ordered(star if turn else asked.unionByName(star)))  # the first turn takes the small lists too
        release(split, pivots)
    if left:
        # what the pivots left apart: every pair of a list that lies in two components has a member outside the list's largest one;
        # the members of a list are dealt in parts, and those outside its largest component meet each part
        whole = materialize(split.withColumn("dealt", F.ceil(F.col("members") / LIST_PART).cast("int")).join(nodes.select("fp", "m"), "fp"))
        odd = whole.where("root <> most").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("dealt") - 1)))
        every = whole.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("dealt")).cast("int"))
        close = (up + down) * _map_distance(F.col("m_a"), F.col("m_b")) <= (down - up) * (F.col("n_a") + F.col("n_b"))
        apart = paired(*(z.select("part", *base, "m") for z in (odd, every)), keys=("k", "part")).where(close)
        roots = linked(_ordered(apart.select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))))
        release(whole)
    release(member, split, packs)
    return marked, nodes, roots


def similar_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, bucket_pairs: int = 16) -> DataFrame:
    """One row for each document row, id and component_id as in ``near_duplicates``, for documents
    that are similar though not nearly equal: two link if their sets of word shingles have at least the
    similarity (common among all), counted exactly. All such pairs are candidates: if each set is sorted in one
    order, rare shingles first, two sets that are so similar share one of their first n - ceil(similarity * n) + 1. Lists of
    sets with such a shingle are kept by bins of set sizes: texts too different in size to be similar meet in none, however large the table.

    Texts with the same set are one node. Lists of up to ``bucket_pairs`` nodes that share a shingle are compared in
    full, unless fingerprints have joined them. Members of larger ones are compared with ``PIVOTS`` members in turns; then all pairs of the list that are still in two components are compared, so no link that would join groups is lost. A group of near copies is mostly joined by
    its pivots, which keeps its lists nearly linear; a large list of documents that are not similar takes pairs by the square.
    """
    marked, nodes, roots = _similar(docs, col(id_col), text_col, shingle, similarity, bucket_pairs)
    return _grouped(marked.select("id", "fp"), nodes, roots, id_col).drop("fingerprint")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, bucket_pairs: int = 16) -> DataFrame:
    """All columns of the documents that stay: of each group of ``similar_groups`` the row with the smallest
    id, ties (repeated or null ids) by content, null ids last. Rows whose text has
    no words have nothing to compare and stay, all of them."""
    names = docs.columns
    has_words = F.coalesce(col(text_col).cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    # a row's key: the id, and a hash of all its columns and of which of them are null
    content = F.xxhash64(*[x for c in names for x in (col(c), col(c).isNull())])
    key = F.struct(col(id_col).isNull().alias("none"), col(id_col).alias("id"), content.alias("row"))
    marked, nodes, roots = _similar(docs.where(has_words), key, text_col, shingle, similarity, bucket_pairs)
    chosen = nodes.join(roots, F.col("fp") == F.col("node"), "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("low").alias("low"))
    chosen = materialize(chosen.select(F.col("low.id").alias("tidewright id"), F.col("low.row").alias("tidewright row")))
    match = col(id_col).eqNullSafe(col("tidewright id")) & (content == col("tidewright row"))
    # rows that go are of few classes of keys: those of other classes stay without a join
    keyed = lambda i, r: F.xxhash64(i, r)
    gone = marked.select(keyed(F.col("id.id"), F.col("id.row")).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).join(chosen.select(keyed(col("tidewright id"), col("tidewright row")).alias("h"), F.lit(1).alias("stays")), "h", "left").where("stays IS NULL OR n > 1")
    marks = materialize(_class_marks(gone))
    untouched, kept = (_of_classes(docs.where(has_words), keyed(col(id_col), content), marks, held) for held in (False, True))
    # equal rows: one of them stays
    again = marked.select(F.col("id.id").alias("tidewright id"), F.col("id.row").alias("tidewright row")).groupBy("tidewright id", "tidewright row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("tidewright id", "tidewright row")
    if again.isEmpty():
        out = kept.join(chosen, match, "left_semi")
    else:
        again = materialize(again)
        twice = lambda how: chosen.join(again.select(col("tidewright id").alias("a_id"), col("tidewright row").alias("a_row")), col("tidewright id").eqNullSafe(F.col("a_id")) & (col("tidewright row") == F.col("a_row")), how)
        equal = kept.join(twice("left_semi"), match, "left_semi").groupBy(col(id_col).alias("tidewright id"), content.alias("tidewright row")).agg(F.min(F.struct(*[col(c).alias(f"c{i}") for i, c in enumerate(names)])).alias("s"))
        out = kept.join(twice("left_anti"), match, "left_semi").unionByName(equal.select(*[F.col(f"s.c{i}").alias(c) for i, c in enumerate(names)]))
    return out.unionByName(untouched).unionByName(docs.where(~has_words)).select(*[col(c) for c in names])
