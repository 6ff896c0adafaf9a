"""SimHash near-dedup: 64-bit fingerprints, linked at a Hamming distance of at most `radius` with a vantage-point tree.

A tree of vantage points is fitted on a bounded sample of the distinct fingerprints; its leaves are the shards. At each node
what lies within the limit goes inside and the rest outside; of the rest, what lies within `radius` of the limit goes inside,
too. By the triangle inequality two linked fingerprints then meet in a shard: both within the limit or both beyond it meet by
themselves, and else the one beyond is near enough to the limit to go inside. (One side alone is doubled, so a level adds
about a fifth to the rows and not two fifths.) In its task a shard grows the tree on, in the same way, until few fingerprints
are left to compare with one another, so work stays far from quadratic however large shards are. A node is split until the rows
that it is expected to get, doubled ones included, are few, and only where the split costs less than comparing all with all.
What goes out is a spanning forest of the links found in each shard (not all pairs); its components are those of all links.
Where no vantage point parts a dense group, it is compared in blocks, each a task.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import MADE, components, row_keys, stash, tidy

#: Fingerprints a shard should hold (with doubled ones; up to four times as many where there are many shards), leaves of the tree
#: that is broadcast (24 bytes a node; below them shards grow their own), sampled fingerprints for each SHARD and at most,
#: fingerprints that are compared with one another at once, those in a block of a group that no vantage point parts, rows that are
#: routed at once, and rows that a task compares, about.
SHARD, MOST_SHARDS, SAMPLE_EACH, MOST_SAMPLE, FEW, BLOCK, ROUTED, TASK = 4096, 1 << 16, 128, 1 << 20, 2000, 1 << 15, 1 << 16, 1 << 15
#: A split into shares a and b of the rows (a + b over 1, as some are doubled) makes work grow as the power p of the rows for which
#: a^p + b^p is 1; comparing all with all is 2. Splits of a larger power than this one are not worth it.
WORTH = 1.6
#: Of drop_near_copies: buckets in which shingles are counted and the pieces they travel in; least hashes of a set, those that
#: sets are grouped by, sets of such a group that are held against one another, partners that each proposes; sets in a block of a shingle's
#: list; ids that are sent to every executor at most. None of them changes what is linked.
COUNTS, PARTS, KEYS, GROUPED, GROUP, TRIES, KEY_BLOCK, SHIPPED = 1 << 20, 16, 16, 4, 1024, 6, 4096, 1 << 22
#: Odd constants that make further hashes of a hash.
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `width` words, repeats included; fewer words: of the whole sequence; none: no hash."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, cut at \x20 and \x09-\x0D
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= width:
        return np.array([xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts, stops = [0, *ends[:-width].tolist()], (ends[width - 1 :] - 1).tolist()
    return np.fromiter((xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, stops, strict=True)), np.uint64, len(stops))


def simhash(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; signed, as Spark's long. No hash: zero."""
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: Column, width: int) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(shingle_hashes(t, width)) for t in texts], dtype="int64")

    return of(text)


def vantage(some: np.ndarray, radius: int, rng: np.random.Generator) -> tuple[int, int] | None:
    """(vantage point, limit) that part the fingerprints best: the fewest doubled rows for what the split tells. None if no
    split of those tried is worth its rows (WORTH), as in a dense group. Judged on 1,024 fingerprints at most."""
    best, seen = None, some if len(some) <= 1024 else rng.choice(some, 1024)
    for point in rng.choice(some, min(6, len(some)), replace=False):
        upto = np.cumsum(np.bincount(np.bitwise_count(seen ^ point), minlength=65 + radius)) / len(seen)
        inside, edge = upto[:65], upto[radius:] - upto[: len(upto) - radius]
        good = np.nonzero((inside >= 0.1) & (inside <= 0.9) & ((inside + edge) ** WORTH + (1 - inside) ** WORTH <= 1))[0]
        if len(good):
            x = inside[good]
            cost = np.log2(1 + edge[good]) / -(x * np.log2(x) + (1 - x) * np.log2(1 - x))
            k = int(cost.argmin())
            if best is None or cost[k] < best[0]:
                best = (cost[k], int(point), int(good[k]))
    return best and best[1:]


def fit_tree(sample: np.ndarray, rows: int, shard: int, radius: int, seed: int = 1) -> tuple[list[tuple[int, int, int, int]], list[int]]:
    """Nodes (vantage, limit, inside, outside) for `rows` fingerprints; a child below zero is the shard -child - 1. Also the shards
    that are larger than `shard` as no vantage point parts them. The sample is routed as the fingerprints will be, doubled where
    they are, and the largest node is split first, so shards are about alike however unequal the splits."""
    rng, nodes, dense, leaves, made = np.random.default_rng(seed), [], [], 0, 0
    scale, todo = rows / max(1, len(sample)), [(-len(sample), 0, -1, 0, sample)]
    while todo:
        _, _, parent, side, some = heapq.heappop(todo)
        large = len(some) > 1 and len(some) * scale > shard
        best = vantage(some, radius, rng) if large and len(todo) + leaves + 1 < MOST_SHARDS else None
        if best is None:
            if large and len(todo) + leaves + 1 < MOST_SHARDS:
                dense.append(leaves)
            leaves += 1
            at = -leaves
        else:
            at = len(nodes)
            nodes.append([*best, 0, 0])
            far = np.bitwise_count(some ^ np.uint64(best[0])).astype(int)
            for k, part in ((2, some[far <= best[1] + radius]), (3, some[far > best[1]])):
                made += 1
                heapq.heappush(todo, (-len(part), made, at, k, part))
        if parent >= 0:
            nodes[parent][side] = at
    return [tuple(x) for x in nodes], dense


def route(nodes: list[tuple[int, int, int, int]], prints: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """(position in prints, shard): the shard that each lives in, and those that it goes to for being within `slack` of a limit."""
    if not nodes:
        return np.arange(len(prints)), np.zeros(len(prints), np.int64)
    found, todo = [], [(0, np.arange(len(prints)))]
    while todo:
        at, own = todo.pop()
        if not len(own):
            continue
        if at < 0:
            found.append((own, np.full(len(own), -at - 1)))
            continue
        point, limit, inside, outside = nodes[at]
        far = np.bitwise_count(prints[own] ^ np.uint64(point)).astype(int)
        todo += [(inside, own[far <= limit + slack]), (outside, own[far > limit])]
    return np.concatenate([x[0] for x in found] or [np.empty(0, int)]), np.concatenate([x[1] for x in found] or [np.empty(0, int)])


def forest(visitors: np.ndarray, residents: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between visitors and residents (or among them, if they are the same array)."""
    nodes, inverse = np.unique(np.concatenate([visitors, residents]), return_inverse=True)
    v, r = inverse[: len(visitors)], inverse[len(visitors) :]
    label, out, step = np.arange(len(nodes)), [], max(1, 500_000 // max(1, len(r)))
    for i in range(0, len(v), step):
        skip = i if visitors is residents else 0  # each pair once
        near = np.flatnonzero(np.bitwise_count(visitors[i : i + step, None] ^ residents[skip:]) <= radius)
        a, b = v[i + near // (len(r) - skip)], r[skip + near % (len(r) - skip)]
        new = label[a] != label[b]
        if not new.any():
            continue
        a, b = a[new], b[new]
        _, one = np.unique(np.stack([label[a], label[b]]), axis=1, return_index=True)
        parent: dict[int, int] = {}

        def top(x: int, parent: dict[int, int] = parent) -> int:
            while x in parent:
                x = parent[x]
            return x

        for k in one:
            x, y = top(int(label[a[k]])), top(int(label[b[k]]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((a[k], b[k]))
        at = np.arange(len(nodes))
        for x in sorted(parent):  # parents are smaller, so they are final
            at[x] = at[parent[x]]
        label = at[label]
    return [(int(nodes[x]), int(nodes[y])) for x, y in out]


def links_among(prints: np.ndarray, radius: int, seed: int = 2) -> list[tuple[int, int]]:
    """The links among some fingerprints as spanning forests of the leaves of a tree of their own."""
    rng, out, todo = np.random.default_rng(seed), [], [prints]
    while todo:
        own = todo.pop()
        best = vantage(own, radius, rng) if len(own) > FEW else None
        if best is None:
            out += forest(own, own, radius) if len(own) > 1 else []
            continue
        far = np.bitwise_count(own ^ np.uint64(best[0])).astype(int)
        todo += [own[far <= best[1] + radius], own[far > best[1]]]
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def as_links(pairs: list[tuple[int, int]]) -> pd.DataFrame:
    links = np.array(pairs, np.uint64).reshape(-1, 2)
    return pd.DataFrame({"u": signed(links[:, 0].copy()), "v": signed(links[:, 1].copy())})


def hamming_links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """(u, v): links between distinct fingerprints (column fp: long) at most `radius` bits apart, as spanning forests of the
    shards; their components are those of all links. No fingerprint: no row."""
    n = prints.count()
    shard = min(4 * SHARD, max(SHARD, n // 64))
    share = min(1.0, SAMPLE_EACH / SHARD, MOST_SAMPLE / max(1, n))
    sample = prints.where(F.expr(f"pmod(xxhash64(fp, 11), 1000000) < {share * 1e6}")).select("fp").toArrow()["fp"].to_numpy()
    nodes, dense = fit_tree(np.sort(sample).view(np.uint64), n, shard, radius)

    def routed(some: list[np.ndarray]) -> pd.DataFrame:
        x = np.concatenate(some).view(np.uint64)
        at, shard = route(nodes, x, radius)
        return pd.DataFrame({"shard": shard, "fp": signed(x[at])})

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        some: list[np.ndarray] = []
        for b in batches:
            some.append(b.fp.to_numpy())
            if sum(map(len, some)) >= ROUTED:
                yield routed(some)
                some = []
        if some:
            yield routed(some)

    dealt = stash(prints.select("fp").mapInPandas(members, "shard long, fp long"), "members")
    sizes = stash(dealt.groupBy("shard").count(), "shards")
    tasks = 1 + (sizes.agg(F.sum("count")).first()[0] or 0) // TASK
    large = stash(sizes.where(F.col("count") > BLOCK).where(F.col("shard").isin(dense)).select(F.col("shard").alias("of"), F.ceil(F.col("count") / BLOCK).alias("blocks")), "large-shards")
    # in a large shard that nothing parts each fingerprint is compared with those of one block for each task
    wide = dealt.join(large, F.col("shard") == F.col("of"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    each = wide.withColumn("own", F.expr("pmod(xxhash64(fp, 5), blocks)")).withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)")))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        x, own = group.fp.to_numpy().view(np.uint64), (group.own == group.block).to_numpy()
        return as_links(links_among(x, radius) if own.all() else forest(x, x[own], radius))

    dealt_out = each.select("shard", "block", "own", "fp").repartition(tasks, "shard", "block")  # few bytes, much work
    return dealt_out.groupBy("shard", "block").applyInPandas(compare, "u long, v long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, fp (long), component_id, the smallest doc_id that links reach.

    Null and empty texts and those without a word have the fingerprint zero, which links like any other. Null ids count as
    no id: a component of nothing else has a null component_id. Repeated rows stay repeated. An empty table gives no rows.
    """
    marked = stash(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), width).alias("fp")), "prints")
    prints = stash(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-prints")
    roots = components(hamming_links(prints, radius))
    placed = prints.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stash(placed.join(names, "root").select(F.col("fp").alias("same"), "component_id"), "classes")
    return marked.join(named, F.col("fp") == F.col("same")).select("doc_id", "fp", "component_id")


def mixed(hashes: np.ndarray, which: int) -> np.ndarray:
    """Another hash of each hash."""
    x = (hashes ^ np.uint64(_MIX[which % 4])) * np.uint64(_MIX[(which + 1) % 4] + 2 * which)
    x ^= x >> np.uint64(29)
    x *= np.uint64(_MIX[(which + 2) % 4])
    return x ^ (x >> np.uint64(32))


def shingle_counts(texts: DataFrame, width: int) -> np.ndarray:
    """How many texts (column text) have a shingle of each of COUNTS buckets (several of one bucket count as often). Tasks send
    their counts as PARTS packed pieces, so nothing grows with the number of shingles."""
    each = COUNTS // PARTS

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(COUNTS, np.int32)
        for b in batches:
            some = [np.unique(shingle_hashes(t, width)) for t in b.text]
            n += np.bincount((np.concatenate([*some, np.empty(0, np.uint64)]) % np.uint64(COUNTS)).astype(np.int64), minlength=COUNTS).astype(np.int32)
        yield pd.DataFrame({"part": range(PARTS), "n": [n[i * each : (i + 1) * each].tobytes() for i in range(PARTS)]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, n in zip(b.part, b.n, strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(n, np.int32).astype(np.int64)
        yield pd.DataFrame({"part": list(sums), "n": [n.tobytes() for n in sums.values()]})

    out = np.zeros(COUNTS, np.int64)
    for x in texts.mapInPandas(count, "part int, n binary").repartition(PARTS, "part").mapInPandas(add, "part int, n binary").collect():
        out[x.part * each : (x.part + 1) * each] = np.frombuffer(x.n, np.int64)
    return out


def shape(text: str | None, width: int, often: np.ndarray, usual: int, least: Fraction) -> tuple[int, int, int, int, np.ndarray, np.ndarray, np.ndarray]:
    """Of the set of distinct shingles: its digest (two longs), its size, its fingerprint, its least hashes under KEYS orders, and
    its rarest shingles, one of which any set of similarity `least` must share, with the blocks that each one's list is cut into."""
    own = np.unique(shingle_hashes(text, width))
    fp = simhash(own)
    a, b = np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), np.int64).tolist()
    if not len(own):
        return a, b, 0, fp, signed(own), signed(own), signed(own)
    n = often[(own % np.uint64(COUNTS)).astype(np.int64)]
    first = np.lexsort((own, n))[: len(own) - math.ceil(least * len(own)) + 1]  # one order of all shingles for all sets
    keys = signed(np.array([mixed(own, 8 + i).min() for i in range(KEYS)], np.uint64))
    return a, b, len(own), fp, keys, signed(own[first]), 1 + np.maximum(0, n[first] - usual) // KEY_BLOCK


def candidates(rows: pd.DataFrame, least: Fraction) -> pd.DataFrame:
    """(u, v): of whole groups (token, a, b), in order, the pairs of sets that may reach the similarity and are not yet linked:
    by their sizes, and by what can still be shared after the token (for the first token that two sets share, all of it)."""
    key = rows[["token", "a", "b"]].to_numpy()
    starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)]) if len(key) else np.empty(0, np.int64)
    ids, sizes, ats, roots, blocks = (rows[c].to_numpy() for c in ("id", "size", "at", "root", "block"))
    cross = key[:, 1] != key[:, 2]
    many = np.diff(np.r_[starts, len(key)])
    mixed_roots = (np.minimum.reduceat(roots, starts) != np.maximum.reduceat(roots, starts)) if len(starts) else np.empty(0, bool)
    starts, many = starts[mixed_roots], many[mixed_roots]
    num, den = least.numerator, least.denominator
    out: list[np.ndarray] = []

    def judge(i: np.ndarray, j: np.ndarray) -> None:
        ok = (roots[i] != roots[j]) & (np.minimum(sizes[i], sizes[j]) * den >= np.maximum(sizes[i], sizes[j]) * num) & (~cross[i] | (blocks[i] != blocks[j]))
        i, j = i[ok], j[ok]
        ok = np.minimum(sizes[i] - ats[i], sizes[j] - ats[j]) * (num + den) >= num * (sizes[i] + sizes[j])
        u, v = ids[i[ok]], ids[j[ok]]
        out.append(np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0))

    for m in np.unique(many):
        own = starts[many == m]
        if m <= 64:  # many short groups at once
            x, y = np.triu_indices(m, 1)
            step = max(1, 2_000_000 // len(x))
            for k in range(0, len(own), step):
                judge((own[k : k + step, None] + x).ravel(), (own[k : k + step, None] + y).ravel())
            continue
        step = max(1, 2_000_000 // m)
        for start in own:
            for k in range(0, m, step):
                x, y = np.nonzero(np.arange(k, min(m, k + step))[:, None] < np.arange(m)[None])
                judge(start + k + x, start + y)
    pairs = np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), np.int64)
    return pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1]})


def in_groups(rows: DataFrame, keys: list[str], compare: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """compare() of whole groups, many small ones at once: a group of one key lies together, and batches are cut between groups."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        for b in batches:
            if not len(b):
                continue
            last = (b[keys].to_numpy() == b[keys].to_numpy()[-1]).all(1)  # may go on in the next batch
            same = rest and (rest[0][keys].iloc[0].to_numpy() == b[keys].iloc[0].to_numpy()).all()
            if last.all() and (same or not rest):
                rest.append(b)
                continue
            yield compare(pd.concat([*rest, b[~last]], ignore_index=True))
            rest = [b[last]]
        if rest:
            yield compare(pd.concat(rest, ignore_index=True))

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(each, schema)


def likeliest(rows: pd.DataFrame, least: Fraction) -> pd.DataFrame:
    """(u, v, shared): for each set of whole groups (which, key, salt) the TRIES sets of other roots that share most of their
    least hashes with it."""
    key = rows[["which", "key", "salt"]].to_numpy()
    starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)]) if len(key) else np.empty(0, np.int64)
    ids, sizes, roots = (rows[c].to_numpy() for c in ("id", "size", "root"))
    hashes = np.stack(rows["keys"].to_numpy()) if len(rows) else np.empty((0, KEYS), np.int64)
    out = [np.empty((0, 3), np.int64)]
    for low, high in zip(starts, [*starts[1:], len(key)], strict=True):
        r, z, h = roots[low:high], sizes[low:high], hashes[low:high]
        if high - low < 2 or (r == r[0]).all():
            continue
        shared = np.zeros((high - low, high - low), np.int8)
        for k in range(h.shape[1]):
            shared += h[:, None, k] == h[None, :, k]
        fits = (r[:, None] != r[None, :]) & (np.minimum(z[:, None], z[None, :]) * least.denominator >= np.maximum(z[:, None], z[None, :]) * least.numerator)
        shared[~fits] = 0
        most = min(TRIES, high - low)
        best = np.argpartition(-shared, most - 1, axis=1)[:, :most]
        n = np.take_along_axis(shared, best, 1)
        some, place = np.nonzero(n >= KEYS // 2)
        u, v = ids[low + some], ids[low + best[some, place]]
        out.append(np.unique(np.stack([np.minimum(u, v), np.maximum(u, v), n[some, place]], axis=1), axis=0))
    pairs = np.concatenate(out)
    return pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1], "shared": pairs[:, 2]})


def likely_pairs(sets: DataFrame, least: Fraction) -> DataFrame:
    """(u, v): for each set (id, size, root, keys) its likeliest partners in other components, in the groups of its least hashes;
    for each two components the TRIES likeliest pairs. Groups are dealt out in parts of about GROUP, so pairs grow with the sets."""
    each = sets.select("id", "size", "root", "keys", F.posexplode(F.slice("keys", 1, GROUPED)).alias("which", "key"))
    groups = each.groupBy("which", "key").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("n > 1 and lo <> hi").select("which", "key", "n")
    dealt = each.join(groups, ["which", "key"]).withColumn("salt", F.expr(f"pmod(xxhash64(id, which), cast(ceil(n / {GROUP}) as bigint))")).drop("n")
    found = in_groups(dealt, ["which", "key", "salt"], lambda rows: likeliest(rows, least), "u long, v long, shared long").distinct()
    p, q = F.least("u_root", "v_root"), F.greatest("u_root", "v_root")
    best = Window.partitionBy(p, q).orderBy(F.desc("shared"), "u", "v")
    return with_roots(found, sets).withColumn("at", F.row_number().over(best)).where(F.col("at") <= TRIES).select("u", "v")


def sharing_pairs(sets: DataFrame, least: Fraction) -> DataFrame:
    """(u, v): every pair of sets (id, size, root, prefix, parts) with different roots that may reach the similarity, and others.
    A token of many sets is cut into blocks, and each pair of blocks is a group of its own."""
    each = sets.select("id", "size", "root", F.posexplode(F.arrays_zip("prefix", "parts")).alias("at", "t"))
    each = each.select("id", "size", "root", "at", F.col("t.prefix").alias("token"), F.expr("pmod(xxhash64(id), t.parts)").alias("block"), F.explode(F.expr("sequence(0L, t.parts - 1)")).alias("other"))
    dealt = each.select("token", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "id", "size", "root", "at", "block")

    return in_groups(dealt, ["token", "a", "b"], lambda rows: candidates(rows, least), "u long, v long").distinct()


def few(ids: DataFrame) -> DataFrame:
    """ids, sent to every executor if there are SHIPPED at most; beyond that they are joined."""
    return F.broadcast(ids) if ids.count() <= SHIPPED else ids


def alike(pairs: DataFrame, texts: Callable[[DataFrame], DataFrame], width: int, least: Fraction) -> DataFrame:
    """Those of the pairs (u, v: ids) whose texts have a similarity of `least` or more, from the shingles themselves. texts gives
    (id, text) of ids."""

    @F.pandas_udf("array<long>")
    def shingles(some: pd.Series) -> pd.Series:
        return pd.Series([signed(np.unique(shingle_hashes(t, width))) for t in some], dtype=object)

    made = len(MADE)
    pairs = stash(pairs, "candidates")
    wanted = stash(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "wanted")
    sets = stash(texts(wanted).select("id", shingles("text").alias("own")), "shingles")
    both = pairs.join(sets.select(F.col("id").alias("u"), F.col("own").alias("x")), "u").join(sets.select(F.col("id").alias("v"), F.col("own").alias("y")), "v")
    shared = F.size(F.array_intersect("x", "y")) * F.lit(least.numerator + least.denominator)
    return tidy(stash(both.where(shared >= (F.size("x") + F.size("y")) * F.lit(least.numerator)).select("u", "v"), "links"), made)


def with_roots(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (u, v, ...) of sets in different components, with u_root and v_root."""
    root = lambda name: sets.select(F.col("id").alias(name), F.col("root").alias(f"{name}_root"))
    return pairs.join(root("u"), "u").join(root("v"), "v").where("u_root <> v_root")


def between(links: DataFrame, sets: DataFrame) -> DataFrame:
    """One of the links (u, v) for each two components that they join; none within a component."""
    one = with_roots(links, sets).groupBy(F.least("u_root", "v_root").alias("p"), F.greatest("u_root", "v_root").alias("q")).agg(F.min(F.struct("u", "v")).alias("e"))
    return one.select("e.u", "e.v")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, radius: int = 2) -> DataFrame:
    """One row of each group of near-copies, that with the smallest doc_id (of repeated rows, one); columns as they were.

    Near-copies: texts whose sets of distinct shingles have a Jaccard similarity of `similarity` or more. All such pairs count
    and no others: each candidate is decided by the shingles themselves. Equal sets are one first. Then come pairs whose
    SimHash fingerprints the vantage-point tree links at `radius` bits, then for each set its likeliest partners by least
    hashes in components that are still apart; so dense groups are joined by few pairs. At last come all pairs of
    sets not joined yet that share one of their rarest shingles, which two sets of that similarity must, so none is lost.
    Groups are the components of all links. Null and empty texts and those without a word are one group. An empty table gives
    no rows; of very long texts the shingle set is held, one text at a time.
    """
    least = Fraction(str(similarity))
    counts = shingle_counts(docs.select(F.col(text_col).alias("text")), width)
    shipped = docs.sparkSession.sparkContext.broadcast((counts, int(counts.mean())))  # COUNTS numbers

    @F.pandas_udf("a long, b long, size long, fp long, keys array<long>, prefix array<long>, parts array<long>")
    def shaped(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shape(t, width, *shipped.value, least) for t in texts], columns=["a", "b", "size", "fp", "keys", "prefix", "parts"])

    # rows are known by what they hold (k1, k2), so that texts are read again where they lie and never written
    k1, k2 = row_keys(docs)
    rows = stash(docs.select(F.monotonically_increasing_id().alias("id"), k1.alias("k1"), k2.alias("k2"), F.col(id_col).alias("doc_id"), shaped(F.col(text_col)).alias("s")).select("id", "k1", "k2", "doc_id", "s.*"), "shaped")
    shipped.destroy()
    equal = stash(rows.groupBy("a", "b").agg(F.min("id").alias("one"), F.count("*").alias("n")).where("n > 1").select("a", "b", "one"), "equal-sets")
    stood_for = stash(rows.select("id", "a", "b").join(equal, ["a", "b"]).where("id <> one").select("id", "one"), "stood-for")
    sets = rows.join(few(stood_for.select("id")), "id", "left_anti").select("id", "size", "fp", "keys", "prefix", "parts")

    def texts(wanted: DataFrame) -> DataFrame:
        named = rows.select("id", "k1", "k2").join(few(wanted), "id", "left_semi")
        found = few(stash(named.select("id", "k1", "k2"), "named"))
        own = docs.select(k1.alias("k1"), k2.alias("k2"), F.col(text_col).alias("text")).join(found, ["k1", "k2"]).select("id", "text")
        return own if equal.isEmpty() else own.dropDuplicates(["id"])  # equal rows have one id that is wanted

    def placed(links: DataFrame) -> DataFrame:
        roots = few(stash(components(links), "roots"))
        return sets.join(roots, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id")).drop("node")

    heads = stash(sets.groupBy("fp").agg(F.min("id").alias("head")), "prints")
    same = sets.select("id", "fp").join(heads, "fp").where("id <> head").select(F.col("head").alias("u"), F.col("id").alias("v"))
    near = hamming_links(heads.select("fp"), radius).join(heads.select(F.col("fp").alias("u"), F.col("head").alias("x")), "u").join(heads.select(F.col("fp").alias("v"), F.col("head").alias("y")), "v")
    links = alike(same.union(near.select(F.least("x", "y"), F.greatest("x", "y"))).distinct(), texts, width, least)
    now = placed(links)
    links = links.union(alike(likely_pairs(now, least), texts, width, least))
    now = placed(links)
    links = stash(links.union(between(alike(sharing_pairs(now, least), texts, width, least), now)), "links")
    roots = few(stash(components(links), "roots"))
    every = rows.select("id", "doc_id", "k1", "k2").join(few(stood_for), "id", "left").withColumn("set", F.coalesce("one", "id"))
    every = every.join(roots, F.col("set") == F.col("node"), "left").withColumn("root", F.coalesce("root", "set"))
    kept = every.groupBy("root").agg(F.min(F.struct("doc_id", "id")).alias("least")).select(F.col("least.id").alias("id"))
    gone = stash(every.join(kept, "id", "left_anti").select("k1", "k2"), "gone")
    # equal rows: all go, or one stays
    twice = stash(rows.groupBy("k1", "k2").count().where("count > 1").select("k1", "k2").join(gone, ["k1", "k2"], "left_semi"), "twice")
    named = lambda some: (k1 == some["k1"]) & (k2 == some["k2"])
    out = docs.join(few(gone), named(gone), "left_anti")
    if twice.isEmpty():
        return out
    stay = stash(twice.join(every.join(kept, "id", "left_semi"), ["k1", "k2"], "left_semi"), "stay")
    return out.unionAll(docs.join(few(stay), named(stay), "left_semi").dropDuplicates([id_col, text_col]))
