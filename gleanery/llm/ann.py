"""Approximate nearest neighbours over learned partitions.

On a bounded sample of the distinct vectors a neighbour graph is built and cut into balanced partitions (halving by the main
direction, then moves that keep more neighbours together while sizes stay balanced). A small network learns to tell a vector's
partitions from the vector. Within each partition the same is done once more, in a task, on a bounded sample of it, as far as
it has vectors for several cells; so there are up to 16,384 cells of PARTITION vectors and more. Every distinct vector is
indexed in its likeliest cell; a query goes to its likeliest partitions and there to their likeliest cells, at each level the
fewest that reach `recall` on held-out sampled vectors, and on until they hold k + 1 entries, and is ranked there by exact
cosine in double precision. Equal vectors are one entry with their smallest ids, so a very common vector is no hot group.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

#: Sampled vectors at most (and bytes of them) of the table and of each partition, sampled ones that a partition needs, distinct
#: vectors a cell should hold; entries in a bucket, queries that meet it in a task, and those ranked at once; queries by which recall is measured.
SAMPLE, SAMPLE_BYTES, EACH, PARTITION, BUCKET, ASKED, QUERIES_AT_ONCE, MEASURED = 6144, 64 << 20, 48, 1500, 8192, 1 << 16, 512, 200


class Router(NamedTuple):
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: np.ndarray
    probes: int


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def likely(router: Router, x: np.ndarray) -> np.ndarray:
    """Scores of the partitions for unit vectors."""
    return np.maximum(x @ router.first + router.first_bias, 0) @ router.second + router.second_bias


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    out = np.empty((len(x), k), np.int64)
    for i in range(0, len(x), 512):
        s = x[i : i + 512] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -2
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        out[i : i + 512] = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 6, slack: float = 1.1) -> np.ndarray:
    """A partition number for each row, sizes within slack of the mean, keeping neighbours of the graph together."""
    part = np.zeros(len(x), np.int64)
    todo, used = [(np.arange(len(x)), 0, parts)], 1
    while todo:
        own, name, want = todo.pop()
        if want < 2:
            continue
        centred = x[own] - x[own].mean(0)
        along = centred @ np.linalg.svd(centred, full_matrices=False)[2][0]
        half = want // 2
        far = own[np.argsort(along, kind="stable")[len(own) * half // want :]]
        part[far] = used
        todo += [(np.setdiff1d(own, far, assume_unique=True), name, half), (far, used, want - half)]
        used += 1
    most = int(np.ceil(slack * len(x) / parts))
    edges_from = np.repeat(np.arange(len(x)), graph.shape[1])
    for _ in range(rounds):
        near = np.zeros((len(x), parts), np.int32)
        np.add.at(near, (edges_from, part[graph.ravel()]), 1)
        np.add.at(near, (graph.ravel(), part[edges_from]), 1)
        best = near.argmax(1)
        gain = near[np.arange(len(x)), best] - near[np.arange(len(x)), part]
        sizes = np.bincount(part, minlength=parts)
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if sizes[best[i]] < most:
                sizes[part[i]] -= 1
                sizes[best[i]] += 1
                part[i] = best[i]
    return part


def fit_router(sample: np.ndarray, parts: int, k: int, recall: float, hidden: int = 64, epochs: int = 30, seed: int = 3) -> Router:
    """The network, trained on the partitions of a vector and its neighbours, and the probes that held-out vectors need."""
    rng = np.random.default_rng(seed)
    x = unit(sample)
    d = x.shape[1]
    if parts < 2 or len(x) < 4 * k:
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    graph = neighbour_graph(x, min(len(x) - 1, 2 * k))
    part = balanced_parts(x, graph, parts)
    want = np.zeros((len(x), parts))
    np.add.at(want, (np.arange(len(x)), part), 1.0)
    np.add.at(want, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph.ravel()]), 1.0 / graph.shape[1])
    want /= want.sum(1, keepdims=True)
    w = [rng.normal(0, (2 / d) ** 0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, (hidden, parts)), np.zeros(parts)]
    mean, square, t = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w], 0
    mix = rng.permutation(len(x))
    held, train = mix[: max(1, len(x) // 5)], mix[max(1, len(x) // 5) :]
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(train), max(1, len(train) // 256)):
            own = x[batch]
            h = np.maximum(own @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            p = np.exp(z - z.max(1, keepdims=True))
            g = (p / p.sum(1, keepdims=True) - want[batch]) / len(batch)
            gh = (g @ w[2].T) * (h > 0)
            t += 1
            for i, slope in enumerate((own.T @ gh, gh.sum(0), h.T @ g, g.sum(0))):
                mean[i] = 0.9 * mean[i] + 0.1 * slope
                square[i] = 0.999 * square[i] + 0.001 * slope**2
                w[i] = w[i] - 0.01 * (mean[i] / (1 - 0.9**t)) / (np.sqrt(square[i] / (1 - 0.999**t)) + 1e-8)
    router = Router(*w, 1)
    home = likely(router, x).argmax(1)
    order = np.argsort(-likely(router, x[held]), axis=1)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(parts)[None, :].repeat(len(held), 0), 1)
    needed = np.sort(np.take_along_axis(rank, home[graph[held][:, :k]], 1).ravel())
    return router._replace(probes=int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1)


def nearest(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, recall: float = 0.97) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, largest cosine first, ties to the smaller vec_id.

    is_query: a Column. Vectors null, empty, zero or holding null or non-finite components take no part, nor do null ids.
    Vectors of different lengths have no cosine: each length is searched by itself. A query's own row is no candidate,
    repeated rows are. With k or fewer candidates all are returned. An empty table gives no rows.
    """
    v = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    good = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), is_query.alias("asks"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    good = good.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda c: c != 0))
    lengths = [r.d for r in good.groupBy(F.size("v").alias("d")).count().orderBy("d").collect()]  # one row a length
    found = [nearest_of_length(good.where(F.size("v") == d), d, k, recall) for d in lengths]
    none = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, found) if found else none


def nearest_of_length(good: DataFrame, d: int, k: int, recall: float) -> DataFrame:
    """nearest() of vectors (vec_id, v, asks) that all have d components."""
    # entries: distinct vectors with their k + 1 smallest ids; the limit on row_number holds before the shuffle, too
    first = Window.partitionBy("v").orderBy("vec_id")
    entries = good.select("vec_id", "v").withColumn("at", F.row_number().over(first)).where(F.col("at") <= k + 1)
    entries = stash(entries.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "entries")
    asked = stash(good.where("asks").select("vec_id", "v"), "asked")
    questions = asked.groupBy("v").agg(F.min("vec_id").alias("question"))

    n = entries.count()
    most = max(64, min(SAMPLE, SAMPLE_BYTES // (8 * d)))
    some = entries.where(F.expr(f"pmod(xxhash64(v), 1000000) < {min(1.0, most / max(1, n)) * 1e6}")).select("v").orderBy(F.xxhash64("v"), "v").limit(most).collect()
    parts = max(1, len(some) // EACH)
    router = fit_router(np.array([x.v for x in some]).reshape(len(some), -1), parts, k, recall) if some else None
    if router is None:
        return asked.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).where("false")
    spark = good.sparkSession
    shipped = spark.sparkContext.broadcast(router)

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.stack(b.v.to_numpy()) if len(b) else np.empty((0, 1))
            yield b.assign(part=likely(shipped.value, unit(x)).argmax(1) if len(b) else np.empty(0, np.int64))

    parted = stash(entries.mapInPandas(home, "v array<double>, ids array<long>, part long"), "parted")
    sizes = {x.part: x["count"] for x in parted.groupBy("part").count().collect()}  # one row a partition
    cells = {p: min(SAMPLE // EACH, c // PARTITION) for p, c in sizes.items() if c >= 2 * PARTITION}

    def fit(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        found = fit_router(np.stack(own.v.to_numpy()), min(cells[key[0]], max(1, len(own) // EACH)), k, recall)
        return pd.DataFrame({"part": [key[0]], "router": [pickle.dumps(found._replace(**{n: x.astype(np.float32) for n, x in found._asdict().items() if n != "probes"}))]})

    by_hash = Window.partitionBy("part").orderBy(F.xxhash64("v"), "v")
    sampled = parted.where(F.col("part").isin(list(cells))).select("part", "v").withColumn("at", F.row_number().over(by_hash)).where(F.col("at") <= most)
    inner = {x.part: pickle.loads(x.router) for x in sampled.groupBy("part").applyInPandas(fit, "part long, router binary").collect()} if cells else {}  # one of a partition each
    within = spark.sparkContext.broadcast(inner)

    def cell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sub = np.zeros(len(b), np.int64)
            for p in set(b.part) & set(within.value):
                own = np.nonzero((b.part == p).to_numpy())[0]
                sub[own] = likely(within.value[p], unit(np.stack(b.v.to_numpy()[own]))).argmax(1)
            yield b.assign(cell=sub)

    placed = stash(parted.mapInPandas(cell, "v array<double>, ids array<long>, part long, cell long"), "placed")
    held = {(x.part, x.cell): x["count"] for x in placed.groupBy("part", "cell").count().collect()}  # one row a cell, 16,384 at most
    names = spark.createDataFrame([(p, c, -(-m // BUCKET)) for (p, c), m in held.items()], "part long, cell long, salts long")
    bucketed = placed.join(F.broadcast(names), ["part", "cell"]).withColumn("salt", F.expr("pmod(xxhash64(v), salts)")).drop("salts")

    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            x = unit(np.stack(b.v.to_numpy())) if len(b) else np.empty((0, 1))
            order = np.argsort(-likely(shipped.value, x), axis=1, kind="stable") if len(b) else []
            for i, parts_of in enumerate(order):
                got = 0
                for tried, p in enumerate(parts_of.tolist()):
                    if tried >= shipped.value.probes and got > k:
                        break
                    own = within.value.get(p)
                    subs = np.argsort(-likely(own, x[i : i + 1])[0], kind="stable")[: own.probes].tolist() if own else [0]
                    for c in subs:
                        m = held.get((p, c), 0)
                        got += m
                        rows += [(i, p, c, s) for s in range(-(-m // BUCKET))]
            at = [r[0] for r in rows]
            yield pd.DataFrame({"question": b.question.to_numpy()[at], "v": b.v.to_numpy()[at], "part": [r[1] for r in rows], "cell": [r[2] for r in rows], "salt": [r[3] for r in rows]})

    # a task holds the questions of one turn, ASKED or so, and what lies in one bucket
    turns = max(1, -(-questions.count() // ASKED))
    turn = F.expr(f"pmod(xxhash64(question, 9), {turns}L)")
    sent = questions.mapInPandas(routed, "question long, v array<double>, part long, cell long, salt long").withColumn("turn", turn)
    bucketed = bucketed.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(turns - 1).cast("long"))))

    def rank(asks: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"question": [], "score": [], "ids": []}
        if len(asks) and len(own):
            x = np.stack(own.v.to_numpy())
            norms, ids = np.sqrt((x * x).sum(1)), own.ids.to_numpy()
            least = np.array([i[0] for i in ids])
            for i in range(0, len(asks), QUERIES_AT_ONCE):
                q = np.stack(asks.v.to_numpy()[i : i + QUERIES_AT_ONCE])
                s = (q @ x.T) / (np.sqrt((q * q).sum(1))[:, None] * norms[None, :])
                for j, name in enumerate(asks.question.to_numpy()[i : i + QUERIES_AT_ONCE]):
                    some = np.argpartition(-s[j], k)[: k + 1] if len(x) > k + 1 else np.arange(len(x))
                    some = np.nonzero(s[j] >= s[j][some].min() - 1e-12)[0]
                    exact = (x[some] * q[j]).sum(1) / (np.sqrt((q[j] * q[j]).sum()) * norms[some])
                    for m in np.lexsort((least[some], -exact))[: k + 1]:
                        out["question"].append(name), out["score"].append(float(exact[m])), out["ids"].append(ids[some[m]])
        return pd.DataFrame(out, dtype=object)

    found = sent.groupBy("part", "cell", "salt", "turn").cogroup(bucketed.groupBy("part", "cell", "salt", "turn")).applyInPandas(rank, "question long, score double, ids array<long>")
    best = Window.partitionBy("question").orderBy(F.desc("score"), F.col("ids")[0])
    best_of = found.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1).select("question", "score", "ids")
    by_row = asked.join(questions, "v").select(F.col("vec_id").alias("query_id"), "question").join(best_of, "question")
    # the own row goes once, so a repeated row with the same id stays a candidate
    each = by_row.select("query_id", "score", F.posexplode("ids").alias("at", "vec_id"))
    ordered = each.withColumn("own", F.when(F.col("vec_id") == F.col("query_id"), F.row_number().over(Window.partitionBy("query_id", "vec_id").orderBy(F.desc("score"), "at"))))
    ordered = ordered.where("own is null or own > 1").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "at")))
    return ordered.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def recall(vectors: DataFrame, found: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5) -> DataFrame:
    """(queries, recall): the share of the k nearest of MEASURED queries of found (query_id, rank, vec_id, score), chosen by a hash,
    that it has, by brute force over all vectors where they lie. A neighbour counts if it is as near as the k-th."""
    v = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    good = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    some = found.select("query_id").distinct().orderBy(F.xxhash64("query_id"), "query_id").limit(MEASURED)
    asked = {x.vec_id: np.array(x.v) for x in good.join(F.broadcast(some), F.col("vec_id") == F.col("query_id")).collect()}  # MEASURED rows, if ids are unique
    shipped = vectors.sparkSession.sparkContext.broadcast(asked)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = list(shipped.value)
        q = np.stack(list(shipped.value.values())) if ids else np.empty((0, 1))
        for b in batches:
            own = [i for i, x in enumerate(b.v) if ids and len(x) == q.shape[1] and all(c is not None for c in x)]
            x = np.stack([np.asarray(b.v[i], float) for i in own]) if own else np.empty((0, q.shape[1]))
            fine = np.isfinite(x).all(1) & x.any(1)
            x, named = x[fine], b.vec_id.to_numpy()[own][fine]
            s = (q @ x.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None])
            s[np.array(ids).reshape(-1, 1) == named[None]] = -2
            for i, name in enumerate(ids):
                top = np.sort(s[i])[::-1][:k]
                yield pd.DataFrame({"query_id": name, "score": top[top > -2]})

    order = Window.partitionBy("query_id").orderBy(F.desc("score"))
    least = good.mapInPandas(near, "query_id long, score double").withColumn("at", F.row_number().over(order)).where(F.col("at") <= k).groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    hits = found.select("query_id", "score").join(F.broadcast(least), "query_id").groupBy("query_id").agg(F.count_if(F.col("score") >= F.col("least") - 1e-9).alias("hits"), F.first("n").alias("n"))
    return hits.agg(F.count("*").alias("queries"), F.round(F.sum(F.least("hits", "n")) / F.sum("n"), 4).alias("recall"))
