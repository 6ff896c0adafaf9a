"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Each source's target is its share by weight of all words, at most `most` times its own words; what is over is shared again.
2. Each source is dealt by hash into blocks. A source is taken whole as often as its target allows; for the rest its blocks
   are drawn in a permuted order until the target is met, the last block document by document.
3. The block draws of all sources are the colours of an urn. A binary tree over the output shards splits them: each node
   draws its left half's quotas from its own by the multivariate hypergeometric law, so every shard gets an exact quota of
   every source and the quotas add up. Each shard takes its quota as the next blocks of the source's permuted order, so blocks
   of a pass are disjoint, and orders its documents by hash.
Everything random is a hash or a generator seeded by the seed and the node, so reruns agree. The driver holds one row a source
and the top nodes of the tree; blocks (at most MOST_BLOCKS a source), draws and documents stay in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_keys, stash

MOST_BLOCKS, BLOCK_WORDS, SHARD_WORDS, SUBTREES = 1 << 16, 20_000, 1_000_000, 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fill(sizes: Sequence[int], weights: Sequence[float], most: float = 3.0) -> list[float]:
    """Shares of sum(sizes) by weight; a share stops at most * its size and the excess is shared again by weight."""
    out, free, left = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while free:
        whole = sum(weights[i] for i in free)
        full = [i for i in free if left * weights[i] / whole > most * sizes[i]]
        if not full:
            for i in free:
                out[i] = left * weights[i] / whole
            break
        for i in full:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in full)
        free = [i for i in free if i not in set(full)]
    return out


def split(quota: np.ndarray, low: int, high: int, seed: int, stop: int = 1) -> Iterator[tuple[int, int, np.ndarray]]:
    """The splitting tree below the node of shards low to high - 1: nodes of at most `stop` shards, with their quotas."""
    if high - low <= stop:
        yield low, high, quota
        return
    middle, whole = (low + high) // 2, int(quota.sum())
    rng = np.random.default_rng([seed, low, high])
    left = rng.multivariate_hypergeometric(quota, whole * (middle - low) // (high - low), method="marginals")
    yield from split(left, low, middle, seed, stop)
    yield from split(quota - left, middle, high, seed, stop)


def numbered(sized: DataFrame, equal: DataFrame) -> DataFrame:
    """sized with n: a number from 0 among rows of one key (k1, k2), first by partition, so that no group lies in one task.
    Equal rows are alike in all, so it does not matter which gets which number."""
    if equal.isEmpty():
        return sized.withColumn("n", F.lit(0).cast("long"))
    some = sized.join(equal, ["k1", "k2"], "left_semi").withColumn("part", F.shiftright("at", 33))
    own = some.withColumn("n", F.row_number().over(Window.partitionBy("k1", "k2", "part").orderBy("at")) - 1)
    sums = some.groupBy("k1", "k2", "part").agg(F.count("*").alias("m"))
    upto = Window.partitionBy("k1", "k2").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("k1", "k2", "part", F.coalesce(F.sum("m").over(upto), F.lit(0)).alias("before"))
    own = own.join(before, ["k1", "k2", "part"]).withColumn("n", F.col("n") + F.col("before"))
    return sized.join(equal, ["k1", "k2"], "left_anti").withColumn("n", F.lit(0).cast("long")).unionByName(own.select(*sized.columns, "n"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, and draws: array<struct<pass, shard, place>>, the
    times it is taken, with its shard and its place in the shard's order; k1 and k2, the row's key (see row_keys). Options: those
    of _mixed after docs.

    weights gives each source's weight (0 where it has none); without it the weights in cycle repeat over the sources by code
    point, null last. A null source is a source of its own. Null and empty texts have size 0 and change no total; they are
    taken as often as their block is. Repeated rows are taken each for itself. An empty table gives no rows. Rows are known by
    what they hold, so reruns agree however the table is split or ordered. Of texts only sizes and hashes are written.
    """
    return _mixed(docs, **options)[0]


def _mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: dict[str | None, float] | None = None, cycle: Sequence[float] = (1, 2, 3), most: int = 3, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """What mix() returns, and the keys of equal rows."""
    spark = docs.sparkSession
    k1, k2 = row_keys(docs)
    sized = docs.select(F.monotonically_increasing_id().alias("at"), k1.alias("k1"), k2.alias("k2"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    sized = stash(sized, "sizes")
    equal = stash(sized.groupBy("k1", "k2").count().where("count > 1").select("k1", "k2"), "equal")
    sized = numbered(sized, equal).withColumn("row_id", F.xxhash64("k1", "k2", "n"))
    totals = sorted(((x.source, x.size) for x in sized.groupBy("source").agg(F.sum("size").alias("size")).collect()), key=lambda x: (x[0] is None, (x[0] or "").encode()))
    sizes = [x[1] for x in totals]
    weight = [(weights.get(s, 0.0) if weights else cycle[i % len(cycle)]) for i, (s, _) in enumerate(totals)]
    targets = fill(sizes, weight, most) if sum(weight) else [0.0] * len(sizes)
    blocks = [max(1, min(MOST_BLOCKS, z // BLOCK_WORDS)) for z in sizes]
    table = spark.createDataFrame([(i, s, z, t, b, min(most, int(t // z)) if z else 0) for i, ((s, z), t, b) in enumerate(zip(totals, targets, blocks, strict=True))], "src int, name string, source_size long, target double, blocks int, whole int")
    rows = sized.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("name")))  # one row a source
    rows = rows.withColumn("block", F.expr(f"cast(pmod(xxhash64({seed}, row_id), blocks) as int)"))

    # the draws of the last, partial pass: blocks by a permuted order until the rest of the target is met
    per_block = rows.groupBy("src", "block").agg(F.sum("size").alias("words"), F.first("whole").alias("whole"), F.first("target").alias("target"), F.first("source_size").alias("source_size"))
    order = Window.partitionBy("src").orderBy("mixed", "block")
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    ordered = per_block.withColumn("mixed", F.expr(f"xxhash64({seed} + 1, src, block)")).withColumn("before", F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ordered = stash(ordered.withColumn("left", F.when(F.col("whole") < most, F.greatest(rest - F.col("before"), F.lit(0.0))).otherwise(0.0)), "blocks")
    passes = F.expr("sequence(0, whole - 1 + if(left > 0, 1, 0))")
    draws = ordered.where("whole > 0 or left > 0").select("src", "block", F.explode(passes).alias("pass"))
    place = Window.partitionBy("src").orderBy("pass", F.expr(f"xxhash64({seed} + 2, src, block, pass)"), "block")
    draws = draws.withColumn("at", F.row_number().over(place) - 1)

    # the splitting tree: its top on the driver, the subtrees in tasks
    urn = dict(draws.groupBy("src").count().collect())
    quota = np.array([urn.get(i, 0) for i in range(len(sizes))], np.int64)
    shards = max(1, -(-int(sum(targets)) // SHARD_WORDS))
    top = list(split(quota, 0, shards, seed, max(1, -(-shards // SUBTREES)))) if len(sizes) else []

    def below(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for low, high, own in b.itertuples(index=False):
                for at, _, got in split(np.asarray(own, np.int64), int(low), int(high), seed):
                    yield pd.DataFrame({"shard": at, "src": np.arange(len(got), dtype=np.int32), "quota": got})

    trees = spark.createDataFrame([(a, b, q.tolist()) for a, b, q in top], "low long, high long, quota array<long>").repartition(max(1, min(len(top), SUBTREES)))
    quotas = trees.mapInPandas(below, "shard long, src int, quota long")
    upto = F.sum("quota").over(Window.partitionBy("src").orderBy("shard"))
    taken = quotas.withColumn("upto", upto).where("quota > 0").select("src", "shard", F.explode(F.expr("sequence(cast(upto - quota as int), cast(upto - 1 as int))")).alias("at"))
    by_block = draws.join(taken, ["src", "at"]).groupBy("src", "block").agg(F.collect_list(F.struct("pass", "shard")).alias("drawn"))  # at most `most` each
    by_block = ordered.join(by_block, ["src", "block"], "left").select("src", "block", F.coalesce("drawn", F.array().cast("array<struct<pass:int,shard:long>>")).alias("drawn"), "left", F.col("words").alias("block_words"))

    # documents: all draws of their block; in a block that the target cuts, those before the cut by a permuted order, and
    # the one of the others that brings the source nearest to its target, if it does
    rows = rows.join(stash(by_block, "draws"), ["src", "block"])
    own = Window.partitionBy("src", "block")
    part = rows.where("left > 0 and left < block_words").select("k1", "k2", "n", "src", "block", "size", "left", F.expr(f"xxhash64({seed} + 3, row_id)").alias("mixed"))
    order = ["mixed", "k1", "k2", "n"]
    part = part.withColumn("upto", F.sum("size").over(own.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    part = part.withColumn("gap", F.col("left") - F.coalesce(F.max(F.expr("if(upto <= left, upto, null)")).over(own), F.lit(0)))
    part = part.where("upto > left").withColumn("off", F.abs(F.col("gap") - F.col("size")))
    part = part.withColumn("nearest", F.row_number().over(own.orderBy("off", *order))).where("nearest > 1 or off >= gap").select("k1", "k2", "n", F.lit(True).alias("beyond"))
    rows = rows.join(part, ["k1", "k2", "n"], "left")
    mine = F.filter("drawn", lambda d: (d["pass"] < F.col("whole")) | F.col("beyond").isNull())
    placed = F.transform(mine, lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"), F.xxhash64(F.lit(seed), d["shard"], d["pass"], F.col("row_id")).alias("place")))
    return rows.select("doc_id", "source", "size", "source_size", "target", F.array_sort(placed).alias("draws"), "k1", "k2"), equal


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document once for each time it is taken, columns as they were, then its shard and place (its order in
    the shard); these names take underscores where docs has them already. Options as for mix(). The texts are read once more
    and joined to their draws by the rows' keys; equal rows are one text with all their draws."""
    names = []
    for name in ("shard", "place"):
        while name in docs.columns:
            name += "_"
        names.append(name)
    own = "_"
    while any(c.startswith(own) for c in docs.columns):
        own += "_"
    a, b, c, d = (own + x for x in ("k1", "k2", "d1", "d2"))
    mixed, equal = _mixed(docs, **options)
    draws = mixed.select(F.col("k1").alias(c), F.col("k2").alias(d), F.explode("draws").alias("draw"))
    draws = stash(draws.select(c, d, F.col("draw.shard").alias(own + names[0]), F.col("draw.place").alias(own + names[1])), "taken")
    k1, k2 = row_keys(docs)
    keyed = docs.withColumns({a: k1, b: k2})
    if not equal.isEmpty():  # of equal rows one stands for all
        same = (F.col(a) == F.col("k1")) & (F.col(b) == F.col("k2"))
        equal = equal.select("k1", "k2")
        one = keyed.join(equal, same, "left_semi").dropDuplicates([a, b])
        keyed = keyed.join(equal, same, "left_anti").unionByName(one)
    out = keyed.join(draws, (F.col(a) == F.col(c)) & (F.col(b) == F.col(d)))
    return out.select(*[F.col(f"`{x}`") for x in docs.columns], *[F.col(own + x).alias(x) for x in names])
