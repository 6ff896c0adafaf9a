"""Ranked lexical search over bags: documents that look alike to the items are scored once.

A document is restricted to the vocabulary of the items: what counts is how often it holds each of their terms, and m, its length
in steps of a quarter of the mean length over a hundred. Documents with the same counts and the same m are a class; classes are
found by a hash of both and verified by the counts themselves. Each class is scored once against all items, in blocks of both,
and keeps its TOP members of smallest doc_id: an item's best documents are in its best TOP classes, ordered by score and smallest
member, for each class before another has a document before it.

Items are the stated queries: they are worked on in blocks of ITEM_BYTES, each a pass over the documents, so that what is sent to
every executor is bounded however many items there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

#: Bytes of items in a block, items that a task scores at once, and numbers in a block of counts.
ITEM_BYTES, ITEMS, CELLS = 16 << 20, 64, 4_000_000
#: A term is a run of letters and digits of ASCII and of all characters beyond it; A-Z count as a-z.
_TERMS = bytes(c if c > 127 or chr(c).isalnum() and not chr(c).isupper() else c + 32 if chr(c).isupper() else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERMS).split()


class Items:
    """A block of items: its sorted vocabulary, and for each item its terms' places and repeats."""

    def __init__(self, texts: list[str | None]):
        bags = [terms(t) for t in texts]
        self.vocabulary = sorted({w for bag in bags for w in bag})
        at = {w: i for i, w in enumerate(self.vocabulary)}
        self.bags = [np.unique(np.array([at[w] for w in bag], np.int64), return_counts=True) for bag in bags]


def count_terms(docs: DataFrame, id_col: str, text_col: str, vocabulary: list[bytes]) -> DataFrame:
    """(row, doc_id, n, code): n counts a document's terms; code holds the places of its terms of the vocabulary and their counts."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by ITEM_BYTES

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = {w: i for i, w in enumerate(sent.value)}
        for b in batches:
            n, codes = [], []
            for text in b.text:
                words = terms(text)
                n.append(len(words))
                found = np.fromiter(map(at.get, words, repeat(-1)), np.int32, len(words))
                places, counts = np.unique(found[found >= 0], return_counts=True)
                codes.append(np.concatenate([places, counts]).astype("<i4").tobytes())
            yield pd.DataFrame({"row": b.row, "doc_id": b.doc_id, "n": n, "code": codes})

    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = stash(own.mapInPandas(count, f"row long, doc_id {own.schema['doc_id'].dataType.simpleString()}, n long, code binary"), "bags")
    sent.destroy()
    return out


def weights(bags: DataFrame, words: int, n_docs: int) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2 df + 1))) of each term; df is counted over all documents."""
    each = F.explode(F.expr("transform(sequence(0, cast(octet_length(code) / 8 as int) - 1), i -> substring(code, 4 * i + 1, 4))"))
    df = np.zeros(words, np.int64)
    for r in bags.where("octet_length(code) > 0").select(each.alias("t")).groupBy("t").count().collect():  # one row a term of the block
        df[int.from_bytes(r.t, "little")] = r["count"]
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


def classes(bags: DataFrame, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(m, code, members): the classes of documents that hold terms of the vocabulary, with their `top` members of smallest doc_id."""
    m = F.expr(f"75 + cast((25 * cast(n as decimal(38, 0)) * {n_docs}) div {max(1, n_terms)} as bigint)")
    own = bags.where("octet_length(code) > 0").select("row", "doc_id", m.alias("m"), "code").withColumn("h", F.xxhash64("code", "m"))
    # by the hash first, then by what it stands for; large classes are cut before they are shuffled
    first = Window.partitionBy("h", "m", "code").orderBy(F.col("doc_id").asc_nulls_last(), "row")
    few = own.withColumn("at", F.row_number().over(first)).where(F.col("at") <= top)
    return stash(few.groupBy("h", "m", "code").agg(F.array_sort(F.collect_list(F.struct("at", "doc_id", "row"))).alias("members")).drop("h"), "classes")


def best_of(score: np.ndarray, least: np.ndarray, row: np.ndarray, top: int) -> np.ndarray:
    """Places of the `top` best above 0: by score, then the smallest document."""
    some = np.flatnonzero(score > 0)
    if len(some) > top:
        some = some[score[some] >= np.partition(score[some], -top)[-top]]
    return some[np.lexsort((row[some], least[some], -score[some]))][:top]


def score_classes(found: DataFrame, items: Items, w: np.ndarray, top: int) -> DataFrame:
    """(item, score, row): for each partition the best classes of each item; row is that of the class's first member."""
    sent = (items.bags, w)  # bounded by ITEM_BYTES, goes with the tasks

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bags, w = sent
        blocks = []
        for k in range(0, len(bags), ITEMS):
            own = np.unique(np.concatenate([b[0] for b in bags[k : k + ITEMS]]))
            times = np.zeros((len(own), len(bags[k : k + ITEMS])), np.int64)
            for j, (places, counts) in enumerate(bags[k : k + ITEMS]):
                times[np.searchsorted(own, places), j] = counts
            # a product of doubles is exact while no sum passes 2 ** 53; a count weighs less than a million
            exact = (times * w[own, None]).sum(0).max(initial=0) * 1_000_000 < 1 << 53
            where = np.full(len(w), -1, np.int64)
            where[own] = np.arange(len(own))
            blocks.append((k, where, times.astype(np.float64) if exact else times))
        tops = [(np.empty(0, np.int64),) * 3] * len(bags)
        for b in batches:
            pairs = [np.frombuffer(c, "<i4").reshape(2, -1) for c in b.code]
            of = np.repeat(np.arange(len(b)), [p.shape[1] for p in pairs])
            place, tf = np.concatenate([*pairs, np.empty((2, 0), np.int32)], axis=1).astype(np.int64)
            value = w[place] * ((1_000_000_000 * tf) // (1000 * tf + 12 * b.m.to_numpy()[of]))
            least, row = b.least.to_numpy(), b.row.to_numpy()
            for k, where, times in blocks:
                if not len(times):
                    continue
                step = max(1, CELLS // len(times))
                for i in range(0, len(b), step):
                    some = (of >= i) & (of < i + step) & (where[place] >= 0)
                    counts = np.zeros((min(step, len(b) - i), len(times)), times.dtype)
                    counts[of[some] - i, where[place[some]]] = value[some]
                    scores = (counts @ times).astype(np.int64)
                    for j in range(scores.shape[1]):
                        x, y, z = (np.concatenate(v) for v in zip(tops[k + j], (scores[:, j], least[i : i + step], row[i : i + step]), strict=True))
                        best = best_of(x, y, z, top)
                        tops[k + j] = (x[best], y[best], z[best])
        yield pd.DataFrame({"item": np.repeat(np.arange(len(bags)), [len(t[0]) for t in tops]), "score": np.concatenate([t[0] for t in tops]), "row": np.concatenate([t[2] for t in tops])})

    given = found.select("m", "code", F.coalesce(F.col("members")[0]["doc_id"].cast("long"), F.lit((1 << 63) - 1)).alias("least"), F.col("members")[0]["row"].alias("row"))
    return given.mapInPandas(score, "item long, score long, row long")


def search(docs: DataFrame, items: DataFrame, top: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` documents of highest score above 0 of each row of items, ties by ascending doc_id.

    Repeated documents are documents of their own and so are repeated items; a null doc_id comes last among equal scores. Items
    and documents without a term (null, empty, only marks) have no rows, and such documents do not count. Of very long texts the
    counts are held, one text at a time. Empty tables give no rows; other columns, whatever their names, take no part. doc_id is
    a whole number.
    """
    spark = docs.sparkSession
    own = items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text"))
    blocks = max(1, -(-int(own.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // ITEM_BYTES))
    results = []
    for k in range(blocks):
        # about ITEM_BYTES, by hash
        block = own.where((F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) & F.col("text").isNotNull()).collect()
        if not block:
            continue
        given = Items([r.text for r in block])
        bags = count_terms(docs, id_col, text_col, given.vocabulary)
        n_docs, n_terms = bags.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        found = classes(bags, n_docs, n_terms, top)
        scored = score_classes(found, given, weights(bags, len(given.vocabulary), n_docs), top)
        firsts = found.select(F.col("members")[0]["row"].alias("row"), "members")
        first = Window.partitionBy("item").orderBy(F.desc("score"), F.col("members")[0]["doc_id"].asc_nulls_last(), "row")
        best = scored.join(firsts, "row").withColumn("at", F.row_number().over(first)).where(F.col("at") <= top)
        each = best.select("item", "score", F.explode("members").alias("d")).select("item", "score", "d.doc_id", "d.row")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "row")
        ranked = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(block)], f"item long, item_id {own.schema['item_id'].dataType.simpleString()}")
        results.append(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    if not results:
        kinds = {"item_id": own.schema["item_id"].dataType.simpleString(), "rank": "int", "doc_id": docs.schema[id_col].dataType.simpleString(), "score": "long"}
        return spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in kinds.items()))
    out = results[0]
    for more in results[1:]:
        out = out.unionAll(more)
    return out
