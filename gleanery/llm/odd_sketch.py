"""MinHash near-dedup with odd sketches: sets of word shingles are linked at a Jaccard similarity of `similarity` or more.

Each set gives SAMPLES MinHash samples. Bands of ROWS samples propose partners; the samples are also folded into a bitmap of BITS
parities (a bit is 1 if an odd number of samples fall on it), so samples that two sets share cancel, and the population count of
the XOR of two bitmaps tells how many samples differ. A candidate goes on if that count is within `odd_limit`, which is worked
out from the distribution of the count at the similarity asked for. What goes on is confirmed on the full sets.

1. Equal sets are one.
2. Twice: in the buckets of the bands each set names the nearest by its bitmap and the middle of its bucket, among sets of
   other components; these few pairs are confirmed on the full sets, and components grow.
3. Sets that still share a bucket with another component are grouped by their bitmaps, and each group is compared as a whole,
   full sets in blocks, each pair of blocks a task. Only a spanning forest of the links found leaves a task.

So no pair is capped and none within a group is put out but for spanning forests. A pair of similarity 0.85 is missed if no
band holds it (7e-9) or its bitmaps differ too much (1e-9); no pair under the similarity is linked.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, join_hot, row_keys, stash
from .simhash import alike, few, in_groups, shingle_hashes, signed

#: MinHash samples, samples in a band, bits of the bitmap, and the odds at which a pair at the limit is dropped.
SAMPLES, ROWS, BITS, MISS = 160, 5, 512, 1e-9
#: Sets of a bucket held against one another at once, sets of one component that a bucket's second round looks at, shingles in
#: a block of a group that is compared as a whole, and rounds of step 2.
GROUP, PICKS, BLOCK, ROUNDS = 1024, 8, 500_000, 2
_SEEDS = np.random.default_rng(5).integers(1, 1 << 63, (2, SAMPLES), dtype=np.uint64) | np.uint64(1)
#: Odd constants that spread hashes.
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def minhash(own: np.ndarray) -> np.ndarray:
    """SAMPLES least hashes of a set that is not empty, a few thousand shingles at a time."""
    out = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(own), 2048):
        x = (own[i : i + 2048, None] ^ _SEEDS[0]) * _SEEDS[1]
        x ^= x >> np.uint64(32)
        x *= _A
        np.minimum(out, x.min(0), out=out)
    return out


def bands(samples: np.ndarray) -> np.ndarray:
    out = np.zeros(SAMPLES // ROWS, np.uint64)
    for k in range(ROWS):
        out = spread(out ^ samples[k::ROWS])
    return out


def odd_sketch(samples: np.ndarray) -> bytes:
    """Parity of the number of samples on each bit; the same value of two different samples falls on bits of its own."""
    at = spread(samples ^ spread(np.arange(1, SAMPLES + 1, dtype=np.uint64))) % np.uint64(BITS)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=BITS) & 1).tobytes()


@cache
def odd_limit(similarity: Fraction) -> int:
    """The count that the XOR of two bitmaps exceeds with odds of at most MISS if the sets have this similarity. A sample differs
    with the odds 1 - similarity and then turns two bits; k turns leave an odd number of turns on so many bits."""
    odd, turned = np.zeros(BITS + 1), np.zeros(BITS + 1)
    odd[0] = 1
    k = np.arange(BITS + 1)
    up, down = (BITS - k) / BITS, k / BITS
    other = 1 - float(similarity)
    for d in range(SAMPLES + 1):
        turned += math.comb(SAMPLES, d) * other**d * (1 - other) ** (SAMPLES - d) * odd
        for _ in range(2):
            odd = np.r_[0, (odd * up)[:-1]] + np.r_[(odd * down)[1:], 0]
    beyond = np.cumsum(turned[::-1])[::-1]  # odds of this count or more
    return int(np.nonzero(beyond > MISS)[0].max())


def estimate(differing: np.ndarray) -> np.ndarray:
    """The similarity that a population count of the XOR stands for."""
    return 1 + BITS / (4 * SAMPLES) * np.log(np.maximum(1 - 2 * np.asarray(differing) / BITS, 1e-9))


def shape(text: str | None, width: int) -> tuple[int, int, int, np.ndarray, bytes]:
    """Of the set of distinct shingles: its digest (two longs), size, band keys and bitmap."""
    own = np.unique(shingle_hashes(text, width))
    a, b = np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), np.int64).tolist()
    if not len(own):
        return a, b, 0, np.empty(0, np.int64), b""
    samples = minhash(own)
    return a, b, len(own), signed(bands(samples)), odd_sketch(samples)


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Population counts of the XOR of each of x and each of y (rows of 64-bit words)."""
    out = np.zeros((len(x), len(y)), np.uint16)
    for k in range(x.shape[1]):
        out += np.bitwise_count(x[:, k, None] ^ y[None, :, k])
    return out


def _groups(rows: pd.DataFrame, keys: list[str]) -> Iterator[tuple[int, int]]:
    """(from, to) of each run of equal keys."""
    if len(rows):
        key = rows[keys].to_numpy()
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)])
        yield from zip(starts.tolist(), [*starts[1:].tolist(), len(key)], strict=True)


def _words(sketches: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint64).reshape(-1, BITS // 64)


def _may_link(x: np.ndarray, y: np.ndarray, roots: tuple[np.ndarray, np.ndarray], sizes: tuple[np.ndarray, np.ndarray], least: Fraction) -> tuple[np.ndarray, np.ndarray]:
    count = differing(x, y)
    small, large = np.minimum(sizes[0][:, None], sizes[1]), np.maximum(sizes[0][:, None], sizes[1])
    return count, (count <= odd_limit(least)) & (roots[0][:, None] != roots[1]) & (small * least.denominator >= large * least.numerator)


def nearest(rows: pd.DataFrame, least: Fraction) -> pd.DataFrame:
    """(id, other, count, middle): for each set of whole groups (bucket, salt) the nearest of another component, and the middle
    of its group, if their bitmaps may belong to linked sets."""
    out = [np.empty((0, 4), np.int64)]
    ids, roots, sizes, words = rows.id.to_numpy(), rows.root.to_numpy(), rows["size"].to_numpy(), _words(rows.sketch)
    for a, b in _groups(rows, ["bucket", "salt"]):
        own, r, z = ids[a:b], roots[a:b], sizes[a:b]
        if b - a < 2 or (r == r[0]).all():
            continue
        count, ok = _may_link(words[a:b], words[a:b], (r, r), (z, z), least)
        far = np.where(ok, count, BITS + 1).astype(np.int64)
        best, middle = far.argmin(1), int(far.sum(1).argmin())
        some = np.flatnonzero(far[np.arange(b - a), best] <= BITS)
        out.append(np.stack([own[some], own[best[some]], far[some, best[some]], 0 * some], axis=1))
        some = np.flatnonzero(ok[:, middle])
        out.append(np.stack([own[some], np.full(len(some), own[middle]), far[some, middle], 0 * some + 1], axis=1))
    return pd.DataFrame(np.concatenate(out), columns=["id", "other", "count", "middle"])


def forest(ok: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the graph between the rows and the columns of ok."""
    out, todo = [], np.ones(ok.shape[1], bool)
    for start in np.flatnonzero(ok.any(1)).tolist():
        ahead = [start] if (ok[start] & todo).any() else []
        seen = {start}
        while ahead:
            i = ahead.pop()
            for j in np.flatnonzero(ok[i] & todo).tolist():
                todo[j] = False
                out.append((i, j))
                for k in np.flatnonzero(ok[:, j]).tolist():
                    if k not in seen:
                        seen.add(k)
                        ahead.append(k)
                        out.append((k, j))
    return out


def _linked(rows: pd.DataFrame, judge) -> pd.DataFrame:
    """(u, v): a spanning forest of what judge(rows of one block, rows of the other) says of each whole group (group, a, b)."""
    out = []
    block, ids = rows.block.to_numpy(), rows.id.to_numpy()
    for low, high in _groups(rows, ["group", "a", "b"]):
        a, b = rows.a.iat[low], rows.b.iat[low]
        x, y = low + np.flatnonzero(block[low:high] == a), low + np.flatnonzero(block[low:high] == b)
        if len(x) and len(y):
            out += [(ids[x[i]], ids[y[j]]) for i, j in forest(judge(rows.iloc[x], rows.iloc[y]))]
    links = np.array(out, np.int64).reshape(-1, 2)
    return pd.DataFrame({"u": links.min(1), "v": links.max(1)})


def sketch_links(rows: pd.DataFrame, least: Fraction) -> pd.DataFrame:
    """Spanning forests of pairs whose bitmaps may belong to linked sets."""
    def judge(x: pd.DataFrame, y: pd.DataFrame) -> np.ndarray:
        return _may_link(_words(x.sketch), _words(y.sketch), (x.root.to_numpy(), y.root.to_numpy()), (x["size"].to_numpy(), y["size"].to_numpy()), least)[1]

    return _linked(rows, judge)


def shared(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of x shares with each of y."""
    sizes = np.array([len(s) for s in y])
    of = np.repeat(np.arange(len(y)), sizes)
    values = np.concatenate([*y, np.empty(0, np.int64)])
    order = np.argsort(values, kind="stable")
    values, of = values[order], of[order]
    out = np.zeros((len(x), len(y)), np.int64)
    for i, own in enumerate(x):
        low, high = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
        n = high - low
        if n.any():
            at = np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            out[i] = np.bincount(of[at], minlength=len(y))
    return out


def full_links(rows: pd.DataFrame, least: Fraction) -> pd.DataFrame:
    """Spanning forests of the links between full sets (column own)."""
    def judge(x: pd.DataFrame, y: pd.DataFrame) -> np.ndarray:
        both = x["size"].to_numpy()[:, None] + y["size"].to_numpy()
        ok = shared(list(x.own), list(y.own)) * (least.numerator + least.denominator) >= both * least.numerator
        return ok & (x.root.to_numpy()[:, None] != y.root.to_numpy())

    return _linked(rows, judge)


def in_blocks(rows: DataFrame, weight: str, most: int) -> DataFrame:
    """rows (group, id, root, ...) with block, a and b: any two rows of a group with different roots are together in one (group,
    a, b). A block holds about `most` of `weight`; a component of more has blocks of its own, which are not held against each other."""
    each = rows.groupBy("group", "root").agg(F.sum(weight).alias("w"), F.count("*").alias("n"))
    small = each.groupBy("group").agg(F.coalesce(F.sum(F.when(F.col("w") <= most, F.col("w"))), F.lit(0)).alias("small"))
    each = stash(each.join(small, "group"), "components")
    own = F.when(F.col("w") > most, F.xxhash64("root", F.pmod(F.xxhash64("id"), F.ceil(F.col("w") / most))))
    placed = join_hot(rows, each, ["group", "root"], "n").withColumn("block", own.otherwise(F.pmod(F.xxhash64("root", F.lit(7)), F.greatest(F.lit(1), F.ceil(F.col("small") / most)))))
    placed = stash(placed.drop("w", "n", "small"), "placed")
    blocks = stash(placed.groupBy("group", "block").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")), "blocks")
    x, y = (blocks.select("group", F.col("block").alias(n), F.col("lo").alias(f"{n}_lo"), F.col("hi").alias(f"{n}_hi")) for n in "ab")
    pairs = x.join(y, "group").where("a <= b and not (a_lo = a_hi and b_lo = b_hi and a_lo = b_lo)")
    ends = pairs.select("group", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    return placed.join(ends, ["group", "block"])


def grown(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, root: the smallest node of its component) with more links. Only what the links join anew is worked on: components so
    far are one node each, their root."""
    if roots is None:
        return few(stash(components(links), "roots"))
    at = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
    ends = links.join(few(at("u")), "u", "left").join(few(at("v")), "v", "left")
    joined = stash(components(ends.select(F.coalesce("u_root", "u").alias("u"), F.coalesce("v_root", "v").alias("v"))), "joined")
    moved = roots.join(few(joined.select(F.col("node").alias("root"), F.col("root").alias("top"))), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return few(stash(moved.union(joined.join(few(roots.select("node")), "node", "left_anti").select("node", "root")), "roots"))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.85) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles (long), component_id (the smallest doc_id that links reach).

    Null and empty texts and those without a word have no shingle and link with nothing, not even each other: each is its own
    component. Fewer words than `width` are one shingle. Repeated rows stay repeated and are in one component. A null doc_id
    counts as no id: a component of nothing else has a null component_id. Very long texts are held one at a time. An empty
    table gives no rows; other columns of docs, whatever their names, take no part.
    """
    least = Fraction(str(similarity))

    @F.pandas_udf("a long, b long, size long, bands array<long>, sketch binary")
    def shaped(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shape(t, width) for t in texts], columns=["a", "b", "size", "bands", "sketch"])

    # rows are known by what they hold (k1, k2), so that texts are read again where they lie and never written
    k1, k2 = row_keys(docs)
    rows = docs.select(F.monotonically_increasing_id().alias("id"), k1.alias("k1"), k2.alias("k2"), F.col(id_col).alias("doc_id"), shaped(F.col(text_col)).alias("s"))
    rows = stash(rows.select("id", "k1", "k2", "doc_id", "s.*"), "shaped")
    filled = rows.where("size > 0")
    equal = stash(filled.groupBy("a", "b").agg(F.min("id").alias("one"), F.count("*").alias("n")).where("n > 1"), "equal-sets")
    twins = stash(join_hot(filled.select("id", "a", "b"), equal, ["a", "b"], "n").where("id <> one").select("id", "one"), "twins")
    sets = filled.join(few(twins.select("id")), "id", "left_anti").select("id", "size", "bands", "sketch")

    def texts(wanted: DataFrame) -> DataFrame:
        found = few(stash(rows.select("id", "k1", "k2").join(few(wanted), "id", "left_semi"), "named"))
        own = docs.select(k1.alias("k1"), k2.alias("k2"), F.col(text_col).alias("text")).join(found, ["k1", "k2"]).select("id", "text")
        return own if equal.isEmpty() else own.dropDuplicates(["id"])  # equal rows have one id that is wanted

    def placed(roots: DataFrame | None) -> DataFrame:
        if roots is None:
            return sets.withColumn("root", F.col("id"))
        return sets.join(roots, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id")).drop("node")

    def buckets(now: DataFrame) -> DataFrame:
        """(bucket, n, id, root): the rows of every bucket with several components; of buckets of the same sets, one."""
        each = now.select("id", "root", F.posexplode("bands").alias("band", "key"))
        found = each.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
        one = found.where("lo <> hi").groupBy("n", "x", "y").agg(F.min(F.struct("band", "key")).alias("b"))
        one = stash(one.select("b.band", "b.key", "n", F.xxhash64("b.band", "b.key").alias("bucket")), "buckets")
        return stash(join_hot(each, one, ["band", "key"], "n").select("bucket", "n", "id", "root"), "bucket-rows")

    def with_sketches(some: DataFrame) -> DataFrame:
        return some.join(sets.select("id", "size", "sketch"), "id")

    roots: DataFrame | None = None
    for turn in range(ROUNDS):
        held = buckets(placed(roots))
        if held.isEmpty():
            break
        if turn:  # of a component a bucket looks at PICKS sets
            some = Window.partitionBy("bucket", "root").orderBy(F.xxhash64("id", F.lit(turn)), "id")
            held = held.withColumn("at", F.row_number().over(some)).where(F.col("at") <= PICKS).drop("at")
        dealt = with_sketches(held).withColumn("salt", F.pmod(F.xxhash64("id", F.lit(turn)), F.ceil(F.col("n") / GROUP)))
        near = in_groups(dealt.select("bucket", "salt", "id", "root", "size", "sketch"), ["bucket", "salt"], lambda g: nearest(g, least), "id long, other long, count long, middle long")
        best = near.groupBy("id", "middle").agg(F.min(F.struct("count", "other")).alias("e"))
        pairs = best.select(F.least("id", "e.other").alias("u"), F.greatest("id", "e.other").alias("v")).distinct()
        roots = grown(roots, alike(pairs, texts, width, least))
    now = placed(roots)
    held = buckets(now)
    if not held.isEmpty():
        dealt = in_blocks(with_sketches(held).withColumnRenamed("bucket", "group").withColumn("one", F.lit(1)).drop("n"), "one", GROUP)
        near = in_groups(dealt.select("group", "a", "b", "block", "id", "root", "size", "sketch"), ["group", "a", "b"], lambda g: sketch_links(g, least), "u long, v long")
        grouped = stash(components(near.distinct()), "groups")
        whole = in_blocks(grouped.select(F.col("root").alias("group"), F.col("node").alias("id")).join(now.select("id", "root", "size"), "id"), "size", BLOCK)

        @F.pandas_udf("array<long>")
        def shingles(some: pd.Series) -> pd.Series:
            return pd.Series([signed(np.unique(shingle_hashes(t, width))) for t in some], dtype=object)

        own = stash(texts(grouped.select(F.col("node").alias("id"))).select("id", shingles("text").alias("own")), "shingles")
        full = whole.join(own, "id").select("group", "a", "b", "block", "id", "root", "size", "own")
        roots = grown(roots, in_groups(full, ["group", "a", "b"], lambda g: full_links(g, least), "u long, v long"))
    every = rows.select("id", "doc_id", "size").join(few(twins), "id", "left").withColumn("set", F.coalesce("one", "id")).drop("one")
    if roots is not None:
        every = every.join(roots, F.col("set") == F.col("node"), "left").withColumn("set", F.coalesce("root", "set")).drop("node", "root")
    every = stash(every, "rooted")
    names = stash(every.groupBy("set").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")), "names")
    named = join_hot(every, names, ["set"], "n")
    return named.select("doc_id", F.col("size").alias("n_shingles"), "component_id")
