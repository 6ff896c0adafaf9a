"""What the operators share: reading tables, written tables that cut lineage, ASCII lower-casing, components."""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import shared_folder

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
#: Categories in which lower() changes a character outside A-Z (unassigned ones too: ICU may know them).
CASED_BEYOND_ASCII = r"[^\x00-\x7F&&[\p{Lu}\p{Lt}\p{Nl}\p{So}\p{Cn}]]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Where this driver's stashes lie, in the order in which they were made.
MADE: list[str] = []


def stash(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    MADE.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Remove stashes that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def tidy(out: DataFrame, made: int) -> DataFrame:
    """out; the stashes made since MADE had `made` entries are removed unless out still reads them."""
    read = out.inputFiles() if len(MADE) > made else []
    over = [p for p in MADE[made:] if not any(p.rsplit("/", 1)[1] in f for f in read)]
    discard(out.sparkSession, over)
    MADE[made:] = [p for p in MADE[made:] if p not in over]
    return out


def row_keys(docs: DataFrame) -> tuple[Column, Column]:
    """Two longs that tell rows apart by what they hold, wherever they lie."""
    own = [F.col(f"`{c}`") for c, kind in docs.dtypes if not kind.startswith(("map", "variant"))]
    return F.xxhash64(F.lit(0), *own), F.xxhash64(F.lit(1), *own)


#: Of a group with over 1/HOT of the rows there are HOT at most.
HOT = 1000


def join_hot(rows: DataFrame, groups: DataFrame, keys: list[str], n: str) -> DataFrame:
    """rows joined with groups (one row for each value of keys, n: its rows). Large groups, HOT of them at most, are sent to every
    executor, so that the rows of one group are not gathered in a task; the others are joined as Spark sees fit."""
    most = (groups.agg(F.sum(n)).first()[0] or 0) // HOT
    hot, cool = groups.where(F.col(n) > most), groups.where(F.col(n) <= most)
    if most < HOT:  # no group can be large
        return rows.join(groups, keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cool, keys))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. lower() does that wherever no other cased character occurs, and is far quicker than translate()."""
    return F.when(text.rlike(CASED_BEYOND_ASCII), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


#: Edges that a task makes stars of at once.
AT_ONCE = 250_000


def stars(batches):
    """Edges (u, v) as stars: of each AT_ONCE edges, each node with the smallest that they reach from it. The same components."""
    import pandas as pd

    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (higher := up.get(top, top)) != top:
            top = higher
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def made() -> pd.DataFrame:
        own = [(x, root(x)) for x in list(up)]
        up.clear()
        return pd.DataFrame(own, columns=["u", "v"], dtype="int64")

    n = 0
    for b in batches:
        for u, v in zip(b.u.tolist(), b.v.tolist(), strict=True):
            a, z = root(u), root(v)
            if a != z:
                up[max(a, z)] = min(a, z)
        n += len(b)
        if n >= AT_ONCE:
            yield made()
            n = 0
    yield made()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (u, v: long): rows (node, root), root the smallest node of its component.

    Each task first makes stars of its edges, so a dense group has a row for each node and task. Then
    large-star and small-star steps in turn (Kiveris et al. 2014) until the edges stay as they are; each round is written
    to the shared folder. A node without an edge has no row. A graph with no edges gives no rows. Nothing reaches the
    driver but a count and a checksum for each round.
    """
    pairs = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").distinct()
    pairs = pairs.mapInPandas(stars, "u long, v long")
    pairs = stash(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        pairs = stash(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct(), "edges")
        now = pairs.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if tuple(now) == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = tuple(now)
    raise RuntimeError("components did not settle")
