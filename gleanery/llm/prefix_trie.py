"""Prefix trie of conversations by fixed-length block hashing, with DataFrame functions but for two streams of identifiers.

A conversation's turns are cut into blocks of BLOCK turns. What is grouped first are whole blocks, by the digest of all turns
before them and of their own, so conversations that go the same way are one row a block. Where all that follow a block's start go
the same way, the block's turns are nodes as they are. Only where siblings diverge in a block are the blocks (not the
conversations) taken apart and grouped turn by turn.

Sums over a subtree need no walk over levels: each node belongs to its smallest member, the nodes that a conversation owns are
the last of its path, and a subtree's nodes are owned by members of its top. So every sum is one over members, and is grouped by
blocks like all else. A conversation may be as long as the table: turns are numbered by a sort over all rows, and digests of what
lies before a block are worked out in a tree of FAN blocks each. Lists of members are put together in pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_hot, stash

#: Turns in a block, blocks whose digests are chained at once, and characters in a piece of a list of members.
BLOCK, FAN, PIECE = 4, 64, 1 << 16

def none() -> Column:
    """The digest of no turn."""
    return F.unhex(F.lit(""))


def digest(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def numbered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(conv, at, key, bytes) with turns numbered from 0 in each conversation, and (conv, n).

    Turns are in the order of turn (null first), then role, then the text's SHA-256. key stands for role and text; null is empty.
    """
    own = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        digest(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("sha"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row"),
    )
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("sha"), F.col("row")]
    own = own.repartitionByRange(*order).sortWithinPartitions(*order)
    own = stash(own.select("conv", digest(F.col("sha"), F.col("role").cast("binary")).alias("key"), "bytes", F.monotonically_increasing_id().alias("place")), "turns")
    part = F.shiftright("place", 33).alias("part")
    held = own.groupBy("conv", part).agg(F.min("place").alias("first"), F.count("*").alias("n"))
    so_far = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition that a conversation is in
    held = stash(held.withColumn("before", F.coalesce(F.sum("n").over(so_far), F.lit(0))), "held")
    at = join_hot(own.withColumn("part", part), held, ["conv", "part"], "n").select("conv", (F.col("place") - F.col("first") + F.col("before")).alias("at"), "key", "bytes")
    return stash(at, "numbered"), stash(held.groupBy("conv").agg(F.sum("n").alias("n")), "lengths")


def rebuilt(turns: DataFrame, lengths: DataFrame, family: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """(conv, at, key, bytes) and (conv, n) after each conversation's first h turns are those of the first of its family of five,
    as far as it has any; h is the CRC-32 of its number modulo nine."""
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % heads
    convs = lengths.select("conv", "n", h.alias("h"), (F.col("conv") - F.col("conv") % family).alias("base"))
    first = turns.where((F.col("at") < heads - 1) & (F.col("conv") % family == 0)).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("at", "key", "bytes"))).alias("head"))
    taken = F.slice(F.coalesce("head", F.array().cast("array<struct<at:bigint,key:binary,bytes:bigint>>")), F.lit(1), F.col("h").cast("int"))
    # the first of a family keeps its own turns
    convs = convs.withColumn("h", F.when(F.col("conv") == F.col("base"), F.lit(0)).otherwise(F.col("h")))
    plan = stash(convs.join(first.withColumnRenamed("conv", "base"), "base", "left").select("conv", "n", "h", taken.alias("head")), "plan")
    given = plan.select("conv", F.explode("head").alias("t")).select("conv", "t.at", "t.key", "t.bytes")
    kept = join_hot(turns, plan.select("conv", "n", "h", F.size("head").alias("more")), ["conv"], "n").where("at >= h")
    kept = kept.select("conv", (F.col("at") - F.col("h") + F.col("more")).alias("at"), "key", "bytes")
    return given.unionAll(kept), plan.select("conv", (F.size("head") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("n"))


def chained(keys: Column) -> Column:
    """For each of a list of digests that of all up to it."""
    step = lambda so_far, k: F.concat(so_far, F.array(digest(F.when(F.size(so_far) > 0, F.element_at(so_far, -1)).otherwise(none()), k)))
    return F.aggregate(keys, F.array().cast("array<binary>"), step)


def before(items: DataFrame) -> DataFrame:
    """(conv, k, start, upto, behind): for the k-th item of a conversation the digest of those before it (empty for the first), of
    those up to it, which is the start of the next, and the bytes before it. items: (conv, k, end: digest, bytes).

    FAN items at once; their digests the same way in turn. So what precedes an item has one digest in all conversations.
    """
    own = items.groupBy("conv", F.floor(F.col("k") / FAN).alias("g")).agg(F.array_sort(F.collect_list(F.struct("k", "end", "bytes"))).alias("items"))
    own = stash(own.withColumn("chain", chained(F.col("items.end"))), "chains")
    upper = own.select("conv", F.col("g").alias("k"), F.element_at("chain", -1).alias("end"), F.aggregate("items", F.lit(0).cast("long"), lambda s, x: s + x["bytes"]).alias("bytes"))
    if own.where("g > 0").isEmpty():
        own = own.withColumn("start", none()).withColumn("upto", F.get("chain", F.lit(FAN - 1))).withColumn("behind", F.lit(0).cast("long"))
    else:
        own = own.join(before(upper).withColumnRenamed("k", "g"), ["conv", "g"])
    each = own.select("conv", "g", "start", "upto", "behind", "chain", "items", F.posexplode("items").alias("i", "x"))
    within = lambda i: F.when(F.col("g") == 0, F.get("chain", i)).otherwise(digest(F.col("start"), F.get("chain", i)))
    start = F.when(F.col("i") == 0, F.col("start")).otherwise(within(F.col("i") - 1))
    upto = F.when(F.col("i") == FAN - 1, F.col("upto")).otherwise(within(F.col("i")))
    so_far = F.aggregate(F.slice("items", F.lit(1), F.col("i")), F.lit(0).cast("long"), lambda s, x: s + x["bytes"])
    return each.select("conv", F.col("x.k").alias("k"), start.alias("start"), upto.alias("upto"), (F.col("behind") + so_far).alias("behind"))


def blocks(turns: DataFrame) -> DataFrame:
    """One row per block of a conversation: conv, k, start (digest of all before), nodes (of each turn the digest of all up to it),
    sizes (bytes of its turns) and after (bytes of the conversation from each of its turns on)."""
    own = turns.groupBy("conv", F.floor(F.col("at") / BLOCK).alias("k")).agg(F.array_sort(F.collect_list(F.struct("at", "key", "bytes"))).alias("t"))
    own = stash(own.select("conv", "k", chained(F.col("t.key")).alias("chain"), F.col("t.bytes").alias("sizes")), "blocks")
    total = F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x)
    starts = before(own.select("conv", "k", F.element_at("chain", -1).alias("end"), total.alias("bytes")))
    whole = own.groupBy("conv").agg(F.sum(total).alias("whole"), F.count("*").alias("n"))
    own = join_hot(own.join(starts, ["conv", "k"]), whole, ["conv"], "n")
    nodes = F.transform("chain", lambda c, j: F.when(j == BLOCK - 1, F.col("upto")).otherwise(digest(F.col("start"), c)))
    after = F.transform("sizes", lambda _, i: F.col("whole") - F.col("behind") - F.aggregate(F.slice("sizes", F.lit(1), i), F.lit(0).cast("long"), lambda s, x: s + x))
    return stash(own.select("conv", "k", "start", nodes.alias("nodes"), "sizes", after.alias("after")), "placed")


def grouped(rows: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """The nodes (depth, node, parent, size, n, least) and for each of `sums` (lists over a block's turns) the sum over members.

    Members of a block are one row first; only blocks with siblings are taken apart and grouped by turns.
    """
    added = [F.sum(F.coalesce(F.get(lists, F.lit(j)), F.lit(0).cast("long"))).alias(f"{name}{j}") for name, lists in sums.items() for j in range(BLOCK)]
    alike = stash(rows.groupBy("k", "start", "nodes", "sizes").agg(F.count("*").alias("n"), F.min("conv").alias("least"), *added), "alike")
    forks = stash(alike.groupBy("k", "start").agg(F.count("*").alias("siblings")).where("siblings > 1"), "forks")

    def turns(some: DataFrame) -> DataFrame:
        each = some.select("*", F.posexplode(F.arrays_zip("nodes", "sizes")).alias("j", "t"))
        parent = F.when(F.col("j") > 0, F.get("nodes", F.col("j") - 1)).otherwise(F.col("start"))
        values = [F.get(F.array(*[f"{name}{j}" for j in range(BLOCK)]), F.col("j")).alias(name) for name in sums]
        return each.select((F.col("k") * BLOCK + F.col("j") + 1).alias("depth"), F.col("t.nodes").alias("node"), parent.alias("parent"), F.col("t.sizes").alias("size"), "n", "least", *values)

    straight = turns(alike.join(forks.select("k", "start"), ["k", "start"], "left_anti"))
    apart = turns(join_hot(alike, forks, ["k", "start"], "siblings"))
    apart = apart.groupBy("depth", "node", "parent", "size").agg(F.sum("n").alias("n"), F.min("least").alias("least"), *[F.sum(name).alias(name) for name in sums])
    return stash(straight.unionByName(apart), "nodes")


def member_lists(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): of each node the SHA-256 of its members (node, conv), ascending and joined by commas. The members of a
    node are dealt out by ranges and joined in pieces of PIECE characters, so the task that hashes them reads few rows."""
    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, first, ids, size = None, 0, [], 0
        for b in batches:
            out = []
            for own, conv in zip(b.node, b.conv, strict=True):
                if own != node or size >= PIECE:
                    if ids:
                        out.append((node, first, ",".join(ids)))
                    node, first, ids, size = own, conv, [], 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            yield pd.DataFrame(out, columns=["node", "first", "ids"])
        if ids:
            yield pd.DataFrame([(node, first, ",".join(ids))], columns=["node", "first", "ids"])

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, sha = None, None
        for b in batches:
            out = []
            for own, ids in zip(b.node, b.ids, strict=True):
                if own != node:
                    if sha:
                        out.append((node, sha.hexdigest()))
                    node, sha = own, hashlib.sha256(ids.encode())
                else:
                    sha.update(f",{ids}".encode())
            yield pd.DataFrame(out, columns=["node", "ends_sha256"])
        if sha:
            yield pd.DataFrame([(node, sha.hexdigest())], columns=["node", "ends_sha256"])

    joined = ends.repartitionByRange("node", "conv").sortWithinPartitions("node", "conv").mapInPandas(pieces, "node binary, first long, ids string")
    return joined.repartition("node").sortWithinPartitions("node", "first").mapInPandas(hashed, "node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256.

    Null roles and texts are empty; rows without a conv_id belong to no conversation; turns of equal number are ordered by role and
    the text's SHA-256, and equal ones stay repeated. Long texts are known by their digest. A table without conversations has no
    node, not even the root. Other columns, whatever their names, take no part.
    """
    turns, lengths = numbered(conversations)
    turns, lengths = rebuilt(turns, lengths)
    rows, lengths = blocks(turns), stash(lengths, "new-lengths")
    nodes = grouped(rows, {"held": F.col("after")})
    parents = stash(nodes.groupBy("parent").agg(F.count("*").alias("n_children")), "parents").withColumnRenamed("parent", "node")
    childless = nodes.join(parents.select("node"), "node", "left_anti").select("least", F.lit(1).cast("long").alias("leaf"))
    # of each conversation that owns nodes: the depth at which they begin, their bytes, and whether the last is a leaf
    owners = nodes.select("least", "depth", "size", F.lit(0).cast("long").alias("leaf")).unionAll(childless.select("least", F.lit(None).cast("long"), F.lit(0).cast("long"), "leaf"))
    owners = owners.groupBy(F.col("least").alias("conv")).agg(F.min("depth").alias("from"), F.sum("size").alias("owned"), F.max("leaf").alias("leaf"))
    owners = stash(owners.join(rows.groupBy("conv").agg(F.count("*").alias("n")), "conv"), "owners")
    known = join_hot(rows, owners, ["conv"], "n")
    own = F.transform("after", lambda s, j: F.when(F.col("k") * BLOCK + j + 1 >= F.col("from"), s).otherwise(F.col("owned")))
    # conversations that own nothing add nothing
    summed = grouped(known, {"owned": own, "leaves": F.transform("after", lambda _: F.col("leaf"))}).select("node", "owned", "leaves")
    nodes = nodes.join(summed, "node")
    n, least = lengths.agg(F.count("*"), F.min("conv")).first()
    last = rows.groupBy("conv").agg(F.max(F.struct("k", F.element_at("nodes", -1).alias("node"))).alias("e")).select("e.node", "conv")
    ends = last.unionAll(lengths.where("n = 0").select(none().alias("node"), "conv"))
    lists = stash(member_lists(ends), "members")
    children, leaves, saved = nodes.agg(F.count_if(F.col("depth") == 1), F.sum(F.when(F.col("depth") == 1, F.col("leaves"))), F.sum((F.col("n") - 1) * F.col("size"))).first()
    top = conversations.sparkSession.createDataFrame([(least, 0, None, n, children, leaves or 1, saved or 0)] if n else [], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    top = top.withColumn("node", none())
    above = parents.join(nodes.select("node", "least"), "node").select(F.col("node").alias("parent"), F.col("least").alias("parent_conv_id"), "n_children")
    below = join_hot(nodes.where("depth > 1"), stash(above, "above"), ["parent"], "n_children").drop("n_children")
    below = below.unionByName(nodes.where("depth = 1").withColumn("parent_conv_id", F.lit(least).cast("long")))
    below = below.join(parents, "node", "left").select(F.col("least").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("held") - F.col("owned")).alias("saved_tokens"), "node")
    whole = below.unionByName(top).join(lists, "node", "left")
    return whole.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest()))).drop("node")
