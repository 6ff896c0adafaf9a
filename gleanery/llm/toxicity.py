"""Toxicity: a linear-chain conditional random field tags toxic tokens; its marginals give scores and spans.

Two tags, clean and toxic. A token's features are its lower-cased form, its first three to six letters and its last three,
hashed. Documents are labelled, tokens are not: the words and beginnings of words that are pure signs of toxic documents and
that together explain them (a greedy cover, so that what merely stands beside them in copies adds nothing) label their tokens
toxic; all other tokens are labelled clean. The chain is fitted on a bounded sample of labelled rows (SAMPLE documents of each
label, of each label CHARACTERS at most, dealt so that no document uses another's share, and SEGMENTS segments of SEGMENT
tokens), small enough for the driver. Scoring is a Spark job over whole texts: forward and backward over all tokens, then a
logistic function of the largest marginal and of the marginals' sum, which is fitted on the whole texts of the sample.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

#: The sample that the chain is fitted on: labelled documents of each label, characters of each label, segments and their
#: tokens, characters of a token in a text that is not taken whole; hashed weights; words a task remembers; tokens that are
#: worked on at once, and those beyond which a text is worked on by itself.
SAMPLE, CHARACTERS, SEGMENTS, SEGMENT, LONGEST, BUCKETS, REMEMBERED, AT_ONCE, LONG = 2000, 4_000_000, 16_000, 48, 64, 1 << 18, 200_000, 300_000, 1000
TOKEN = re.compile(r"\w+")


class Chain(NamedTuple):
    """weights: of hashed features, for the tag toxic; step: exp of the transition weights [from, to]; doc: of the logistic."""

    weights: np.ndarray
    step: np.ndarray
    doc: np.ndarray


def features(token: str) -> list[str]:
    w = token.lower()
    return ["w" + w, *("p" + w[:n] for n in (3, 4, 5, 6) if len(w) > n), "s" + w[-3:]]


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % BUCKETS


class Emissions(dict):
    """Token to its weight for the tag toxic."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, token: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[token] = float(sum(self.weights[bucket(f)] for f in features(token))) + float(self.weights[BUCKETS])
        return found


def marginals(flat: np.ndarray, lengths: np.ndarray, step: np.ndarray) -> np.ndarray:
    """P(tag of each token is toxic), by forward and backward over all sequences at once. flat: the emission weights of the
    sequences one after another. With two tags the recursions need only the ratio of toxic to clean."""
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    starts, sizes = starts[order], lengths[order]
    x = np.exp(np.clip(flat, -30, 30))
    (cc, ct), (tc, tt) = step
    ahead, back = np.empty(len(flat)), np.ones(len(flat))
    most = int(sizes[0]) if len(sizes) else 0
    live = np.searchsorted(-sizes, -np.arange(most), side="left")  # sequences longer than t
    ratio = None
    for t in range(most):
        at = starts[: live[t]] + t
        ratio = x[at] if t == 0 else x[at] * (ct + tt * ratio[: live[t]]) / (cc + tc * ratio[: live[t]])
        ratio = np.clip(ratio, 1e-30, 1e30)
        ahead[at] = ratio
    for t in range(most - 2, -1, -1):
        at = starts[: live[t + 1]] + t
        y = x[at + 1] * back[at + 1]
        back[at] = (tc + tt * y) / (cc + ct * y)
    odds = ahead * back
    return odds / (1 + odds)


def marginals_of_one(flat: np.ndarray, step: np.ndarray) -> np.ndarray:
    """marginals() of one long sequence, number by number: array steps of a single sequence would cost far more.
    In double precision, as there."""
    x = np.exp(np.clip(flat.astype(np.float64), -30, 30)).tolist()
    (cc, ct), (tc, tt) = step.tolist()
    ahead, ratio = [], 0.0
    for i, v in enumerate(x):
        ratio = v * (ct + tt * ratio) / (cc + tc * ratio) if i else v
        ratio = 1e-30 if ratio < 1e-30 else 1e30 if ratio > 1e30 else ratio
        ahead.append(ratio)
    back = 1.0
    for i in range(len(x) - 1, -1, -1):
        ahead[i] *= back
        y = x[i] * back
        back = (tc + tt * y) / (cc + ct * y)
    odds = np.array(ahead)
    return odds / (1 + odds)


def signs(parts: np.ndarray, lengths: np.ndarray, documents: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """Whether each feature tells toxic documents from clean ones: pure ones that cover the toxic documents, each taken for those
    not yet covered (the longest of equals), and all pure ones that a good part of the toxic documents have.

    parts: [word, feature], -1 where a word has fewer; lengths: of the features; documents: the distinct words, the label."""
    count = np.zeros((2, len(lengths)), np.int64)
    own = []
    for ids, label in documents:
        some = np.unique(parts[ids])
        own.append(some[some >= 0])
        count[label, own[-1]] += 1
    n = [sum(1 for _, x in documents if x == k) for k in (0, 1)]
    pure = (count[1] >= 2) & (count[0] / max(1, n[0]) <= 0.02 * count[1] / max(1, n[1]))
    where: dict[int, set[int]] = {}
    for i, (_, label) in enumerate(documents):
        for f in own[i][pure[own[i]]].tolist() if label else ():
            where.setdefault(f, set()).add(i)
    found = pure & (count[1] >= max(5, 0.03 * n[1]))
    covered: set[int] = set()
    queue = [(-len(d), int(count[0, f]), -int(lengths[f]), f) for f, d in where.items()]
    heapq.heapify(queue)
    while queue:
        gain, *rank, f = heapq.heappop(queue)
        now = len(where[f] - covered)
        if now < 2:
            continue
        if now < -gain:  # counted before the last ones were taken
            heapq.heappush(queue, (-now, *rank, f))
            continue
        found[f] = True
        covered |= where[f]
    return found


def fit_chain(documents: Iterable[tuple[list[str], int]], epochs: int = 4, rate: float = 0.3, seed: int = 5) -> Chain:
    """The chain from (pieces of a text, label 0 or 1) pairs, by AdaGrad on the likelihood of the tags; without the logistic."""
    rng = np.random.default_rng(seed)
    words: dict[str, int] = {}
    as_ids, labels = [], []
    for pieces, label in documents:
        ids = [np.array([words.setdefault(t, len(words)) for t in TOKEN.findall(piece)], np.int32) for piece in pieces]
        if any(map(len, ids)):
            as_ids.append(ids)
            labels.append(label)
    none = BUCKETS + 1  # pads the features of a token
    table, parts = np.full((len(words), 7), none, np.int32), np.full((len(words), 5), -1, np.int32)
    names: dict[str, int] = {}
    for t, i in words.items():
        own = features(t)
        table[i, : len(own)] = [bucket(f) for f in own]
        table[i, 6] = BUCKETS
        parts[i, : len(own) - 1] = [names.setdefault(f, len(names)) for f in own[:-1]]
    telling = signs(parts, np.array([len(f) for f in names], np.int64), [(np.unique(np.concatenate(ids)), y) for ids, y in zip(as_ids, labels, strict=True)])
    toxic = (np.append(telling, False)[parts]).any(1).astype(float)
    del words, names, parts
    segments = [(ids[i : i + SEGMENT], toxic[ids[i : i + SEGMENT]] * label) for own, label in zip(as_ids, labels, strict=True) for ids in own for i in range(0, len(ids), SEGMENT)]
    if len(segments) > SEGMENTS:  # as many with a toxic token as there are, up to half, and others by chance
        hot = rng.permutation([i for i, s in enumerate(segments) if s[1].any()])[: SEGMENTS // 2]
        cold = rng.permutation([i for i, s in enumerate(segments) if not s[1].any()])[: SEGMENTS - len(hot)]
        segments = [segments[i] for i in sorted([*hot.astype(int), *cold.astype(int)])]
    w, seen, step, seen_step = np.zeros(BUCKETS + 2), np.full(BUCKETS + 2, 1e-6), np.zeros((2, 2)), np.full((2, 2), 1e-6)
    w[BUCKETS] = -2.0
    for _ in range(epochs if segments else 0):
        for batch in np.array_split(rng.permutation(len(segments)), max(1, len(segments) // 512)):
            some = [segments[i] for i in batch]
            f, y = table[np.concatenate([s[0] for s in some])], np.concatenate([s[1] for s in some])
            lengths = np.array([len(s[0]) for s in some])
            p = marginals(w[f].sum(1), lengths, np.exp(step))
            slope = np.bincount(f.ravel(), np.repeat(p - y, f.shape[1]), BUCKETS + 2) / len(some) + 1e-6 * w
            slope[none] = 0
            seen += slope * slope
            w -= rate * slope / np.sqrt(seen)
            inner = np.ones(len(y), bool)
            inner[np.cumsum(lengths) - 1] = False  # the last token of a segment leads nowhere
            here = np.nonzero(inner)[0]
            a, b, ya, yb = p[here], p[here + 1], y[here], y[here + 1]
            pull = np.array([[((1 - a) * (1 - b)).sum() - ((1 - ya) * (1 - yb)).sum(), ((1 - a) * b).sum() - ((1 - ya) * yb).sum()], [(a * (1 - b)).sum() - (ya * (1 - yb)).sum(), (a * b).sum() - (ya * yb).sum()]]) / len(some)
            seen_step += pull * pull
            step = np.clip(step - 0.1 * pull / np.sqrt(seen_step), -4, 4)
    return Chain(w[: BUCKETS + 1].astype(np.float32), np.exp(step), np.zeros(3))


def summary(p: np.ndarray) -> np.ndarray:
    """What the logistic of a document sees of its marginals."""
    most = float(np.clip(p.max(), 1e-4, 1 - 1e-4)) if len(p) else 1e-4
    return np.array([1.0, math.log(most / (1 - most)), math.log1p(float(p.sum()))])


def logistic(rows: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    w = np.zeros(3)
    for _ in range(30):
        if not len(rows):
            break
        p = 1 / (1 + np.exp(-rows @ w))
        w -= np.linalg.solve((rows * (p * (1 - p))[:, None]).T @ rows + ridge * np.eye(3), rows.T @ (p - y) + ridge * w)
    return w


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", each: int = SAMPLE) -> DataFrame:
    """(key, y, text): at most `each` documents of either label, by the order of a hash, with their whole texts; never a held-out
    one. A document with several labels counts as toxic if one says so, of several texts it has the least; null labels and ids
    and null texts give nothing."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    picked = [known.where(F.col("y") == k).orderBy(F.xxhash64("id"), "id").limit(each) for k in (0, 1)]
    chosen = F.broadcast(picked[0].union(picked[1]))  # at most 2 * each ids
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").join(chosen, "id")
    return rows.groupBy("id").agg(F.max("y").cast("int").alias("y"), F.min("text").alias("text")).select(F.xxhash64("id").alias("key"), "y", "text")


def share(sizes: list[int], budget: int) -> int:
    """The most that each may have so that all together have at most the budget."""
    left = budget
    for i, n in enumerate(sorted(sizes)):
        if n * (len(sizes) - i) > left:
            return left // (len(sizes) - i)
        left -= n
    return max(sizes, default=0)


def pieces_of(text: str, key: int, most: int) -> list[str]:
    """The text if it has at most `most` characters; else as many of its segments, by a hash over its whole length; one at least."""
    if len(text) <= most:
        return [text]
    tokens = TOKEN.findall(text)
    starts = range(0, len(tokens), SEGMENT)
    out, left = [], most
    for i in sorted(starts, key=lambda i: (zlib.crc32(f"{key}:{i}".encode()), i)):
        piece = " ".join(t[:LONGEST] for t in tokens[i : i + SEGMENT])
        left -= len(piece)
        if left < 0 and out:
            break
        out.append((i, piece))
    return [piece for _, piece in sorted(out)]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Chain:
    """The chain and its logistic from the labelled sample. Without documents of both labels it knows no sign, and all score low."""
    rows = stash(labelled_sample(docs, labels, id_col, text_col, label_col), "labelled")
    sizes: dict[int, list[int]] = {0: [], 1: []}
    for x in rows.select("y", F.length("text").alias("n")).collect():  # at most 2 * SAMPLE rows
        sizes[x.y].append(x.n)
    if not (sizes[0] and sizes[1]):
        weights = np.zeros(BUCKETS + 1, np.float32)
        weights[BUCKETS] = -4.0
        return Chain(weights, np.ones((2, 2)), np.array([-4.0, 0.0, 0.0]))
    most = {y: share(n, CHARACTERS) for y, n in sizes.items()}

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": b.key, "y": b.y, "pieces": pd.Series([pieces_of(t, k, most[y]) for k, y, t in zip(b.key, b.y, b.text, strict=True)], dtype=object)})

    pieces = rows.mapInPandas(cut, "key long, y int, pieces array<string>").orderBy("key", "pieces")
    chain = fit_chain((x.pieces, x.y) for x in pieces.toLocalIterator())
    shipped = docs.sparkSession.sparkContext.broadcast(chain)

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Emissions(shipped.value.weights)
        for b in batches:
            own = [(k, y, *summary(p)) for k, y, p in zip(b.key, b.y, scored(b.text, known, shipped.value)[0], strict=True) if len(p)]
            yield pd.DataFrame(own, columns=["key", "y", "one", "most", "total"])

    seen = sorted(tuple(x) for x in rows.mapInPandas(summed, "key long, y int, one double, most double, total double").collect())
    shipped.destroy()
    return chain._replace(doc=logistic(np.array([x[2:] for x in seen]).reshape(-1, 3), np.array([x[1] for x in seen], float)))


def scored(texts: pd.Series, known: Emissions, chain: Chain) -> tuple[list[np.ndarray], np.ndarray]:
    """The marginals of each text's tokens, and the texts' scores. Texts of like length are worked on together, AT_ONCE tokens at
    most (or one text)."""
    tokens = [np.fromiter(map(known.__getitem__, TOKEN.findall(t or "")), np.float32) for t in texts]
    order = sorted((i for i in range(len(tokens)) if len(tokens[i]) <= LONG), key=lambda i: -len(tokens[i]))
    rows: list[np.ndarray] = [marginals_of_one(t, chain.step).astype(np.float32) if len(t) > LONG else np.empty(0) for t in tokens]
    at = 0
    while at < len(order):
        some, n = [], 0
        while at < len(order) and (not some or n + len(tokens[order[at]]) <= AT_ONCE):
            some.append(order[at])
            n += len(tokens[order[at]])
            at += 1
        lengths = np.array([len(tokens[i]) for i in some], np.int64)
        p = marginals(np.concatenate([tokens[i] for i in some]).astype(float), lengths, chain.step)
        for i, k, end in zip(some, lengths, np.cumsum(lengths), strict=True):
            rows[i] = p[end - k : end].astype(np.float32)
    return rows, 1 / (1 + np.exp(-(np.array([summary(r) for r in rows]).reshape(-1, 3) @ chain.doc)))


def tag(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, score, spans array<struct<start, end, p>> (code points; neighbouring toxic tokens are one
    span, p its largest marginal). Null and empty texts and those without a word have the score of no toxic token."""
    shipped = docs.sparkSession.sparkContext.broadcast(chain)  # BUCKETS weights

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Emissions(shipped.value.weights)
        for b in batches:
            rows, scores = scored(b.text, known, shipped.value)
            yield pd.DataFrame({"doc_id": b.doc_id, "score": scores, "spans": pd.Series([spans(t or "", r) for t, r in zip(b.text, rows, strict=True)], dtype=object)})

    chosen = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    found = chosen.mapInPandas(score, "doc_id string, score double, spans array<struct<start:long,end:long,p:double>>")
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))


def spans(text: str, p: np.ndarray, least: float = 0.5) -> list[dict]:
    if not len(p) or p.max() < least:
        return []
    out: list[dict] = []
    last = -2
    for i, m in enumerate(TOKEN.finditer(text)):
        if p[i] < least:
            continue
        if last == i - 1:
            out[-1] |= {"end": m.end(), "p": max(out[-1]["p"], float(p[i]))}
        else:
            out.append({"start": m.start(), "end": m.end(), "p": float(p[i])})
        last = i
    return out


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """tag() with a chain fitted on the labelled rows that are not held out. Without labels of both kinds nothing tells toxic
    from clean: every score is 0.018, no document is predicted toxic and no span is found. An empty table gives no rows."""
    return tag(docs, fit(docs, labels, id_col, text_col, label_col), id_col, text_col)


def drop_toxic(docs: DataFrame, labels: DataFrame, most: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs that score under `most`, columns as they were; each row is judged where it lies."""
    shipped = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, text_col=text_col))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Emissions(shipped.value.weights)
        for texts in batches:
            yield pd.Series(scored(texts, known, shipped.value)[1])

    return docs.where(score(F.col(text_col)) < most)
