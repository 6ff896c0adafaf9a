"""A hidden Markov language model: Baum-Welch over all training documents, exact likelihood by the scaled forward recursion.

Symbols of the chain: the most frequent words (LEXICON at most), the end of a text, and CLASSES classes of all other words by
length and last letters. A word outside the lexicon has the probability of its class times its add-one share in the class, in
which unseen words count as one more word; so the model is a distribution over texts, with the same vocabulary as the add-one
unigram that it is given beside.

Jobs over the documents: counts of all words (combined in each task, then by hash); counts of neighbouring symbols; Baum-Welch
rounds, whose expected counts are summed over the partitions; and scoring, where counts of the words outside the lexicon come by
a join on the word's hash. Counts are never broadcast: they grow with the corpus. Nothing is learnt from a sample. The start is
the chain whose pairs of neighbours are likeliest, by expectation-maximization on the counts of all neighbours in all training
documents; for these the symbols are in NEAR groups, so they are a table of fixed size. Every round of Baum-Welch after that is
over all training documents, whole: long texts are worked on in pieces of SEGMENT symbols, and the forward states and backward
messages that cross the cuts are worked out first, so the counts are those of uncut texts. Words are told apart by a 64-bit hash.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

LEXICON, CLASSES, STATES, ROUNDS, SEGMENT, PASSED, START_ROUNDS = 16384, 256, 8, 3, 2048, 512, 200
#: Groups of symbols whose neighbours are counted for the start: frequent words and the end by themselves, NEAR_CLASSES of all others.
NEAR, NEAR_CLASSES = 512, 64
#: PASSED: pieces that messages are worked out of at once. Tokens that are worked on at once, in training and in scoring; words
#: counted before they are sent on; the least count in the lexicon; rows in a batch that goes to Python, as a row is a whole text;
#: characters of texts whose words are hashed at once.
AT_ONCE, FORWARD_AT_ONCE, COUNTED, LEAST, ROWS, PART = 400_000, 2_000_000, 400_000, 5, 1000, 1_000_000


class Model(NamedTuple):
    start: np.ndarray  # [state]
    step: np.ndarray  # [from, to]
    emit: np.ndarray  # [symbol, state]


#: A word's hash: the sum of its bytes' values, each times an odd value of its place, modulo 2 ** 64. White space counts nothing.
_BYTES = np.random.default_rng(9).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) ^ np.random.default_rng(10).integers(0, 1 << 63, 256, dtype=np.uint64)
_BYTES[[32, *range(9, 14)]] = 0


def _places(n: int) -> np.ndarray:
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) | np.uint64(1)


@cache
def _ends() -> tuple[np.ndarray, np.ndarray]:
    """What the last letters add to the class: of words of one byte, and of others by their last two."""
    one = [zlib.crc32(bytes([i])) for i in range(256)]
    return np.array(one) % (CLASSES // 4), np.array([zlib.crc32(bytes([i >> 8, i & 255])) for i in range(1 << 16)]) % (CLASSES // 4)


def tokens(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, classes) of the words of all texts, one after the other, and the number of words of each text. A-Z are lowered,
    words are cut at \\x20 and \\x09-\\x0D."""
    own = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    x = np.frombuffer(b" " + b" ".join(own).lower() + b" ", np.uint8)  # of bytes, lower() changes A-Z only
    gap = (x == 32) | (x - np.uint8(9) <= 4)
    edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    sizes = ends - starts
    begins = np.cumsum([1] + [len(t) + 1 for t in own])
    lengths = np.diff(np.searchsorted(starts, begins))
    hashes = np.empty(len(starts), np.uint64)
    cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(x), PART)), len(starts)))
    for low, high in itertools.pairwise(cuts.tolist()):
        first = starts[low]
        at = starts[low:high] - first
        piece = x[first : ends[high - 1]]
        longest = int(sizes[low:high].max())
        place = np.arange(len(piece)) - np.repeat(at, np.diff(at, append=len(piece)))
        hashes[low:high] = np.add.reduceat(_BYTES[piece] * _places(longest)[np.minimum(place, longest - 1)], at)
    one, two = _ends()
    classes = np.where(sizes == 1, one[x[ends - 1]], two[x[ends - 2].astype(np.int64) * 256 + x[ends - 1]]) + CLASSES // 4 * np.where(sizes < 15, sizes // 5, 3)
    return hashes.view(np.int64), classes.astype(np.int32), lengths


def summed(hashes: np.ndarray, classes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same with one entry for each hash."""
    order = np.argsort(hashes)
    hashes = hashes[order]
    first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]][: len(hashes)])
    return hashes[first], classes[order[first]], np.add.reduceat(counts[order], first) if len(first) else counts


def parts(texts: pd.Series) -> Iterator[tuple[int, int]]:
    """(from, to) of texts that are worked on at once: PART characters, or one text."""
    low = held = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > low and held + n > PART:
            yield low, i
            low, held = i, 0
        held += n
    if len(texts):
        yield low, len(texts)


def grid(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, live, symbols[t, sequence]): longest first, so that at time t the first live[t] are there."""
    lengths = np.array([len(s) for s in sequences])
    order = np.argsort(-lengths, kind="stable")
    most = int(lengths.max())
    live = np.searchsorted(-lengths[order], -np.arange(most), side="left")
    out = np.zeros((most, len(sequences)), np.int32)
    for j, i in enumerate(order):
        out[: lengths[i], j] = sequences[i]
    return order, live, out


def forward(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each sequence."""
    order, live, symbols = grid(sequences)
    total, one = np.zeros(len(sequences)), np.ones(len(model.start))
    state = None
    for t in range(len(live)):
        k = live[t]
        state = (model.start if t == 0 else state[:k] @ model.step) * model.emit[symbols[t, :k]]
        scale = state @ one
        state /= scale[:, None]
        total[:k] += np.log(scale)
    out = np.empty(len(sequences))
    out[order] = total
    return out


class Pieces(NamedTuple):
    """Texts in pieces of SEGMENT symbols at most, whose messages make them whole again. before: the scaled forward state that
    reaches each piece (of the first piece of a text: none, marked by first); after: the backward message to its last symbol."""

    symbols: list[np.ndarray]
    before: np.ndarray
    after: np.ndarray
    first: np.ndarray


def passage(model: Model, pieces: list[np.ndarray]) -> np.ndarray:
    """[piece, from, to]: what each piece makes of a state that is predicted for its first symbol, up to a factor."""
    order, live, symbols = grid(pieces)
    k = len(model.start)
    x, one = np.broadcast_to(np.eye(k), (len(pieces), k, k)).copy(), np.ones(k * k)
    for t in range(len(live)):
        m = live[t]
        x[:m] = (x[:m] if t == 0 else (x[:m].reshape(-1, k) @ model.step).reshape(m, k, k)) * model.emit[symbols[t, :m]][:, None, :]
        x[:m] /= (x[:m].reshape(m, k * k) @ one)[:, None, None]
    out = np.empty_like(x)
    out[order] = x
    return out


def in_pieces(model: Model, sequences: list[np.ndarray]) -> Pieces:
    """The sequences in pieces: forward and backward messages cross from piece to piece, so nothing is lost at the cuts."""
    k = len(model.start)
    symbols = [p for s in sequences for p in segments(s)]
    counts = np.array([-(-len(s) // SEGMENT) for s in sequences], np.int64)
    before, after, first = np.tile(model.start, (len(symbols), 1)), np.ones((len(symbols), k)), np.zeros(len(symbols), bool)
    at = np.cumsum(counts) - counts
    first[at] = True
    long = np.nonzero(np.repeat(counts > 1, counts))[0]
    through = np.empty((len(symbols), k, k))
    for i in range(0, len(long), PASSED):
        through[long[i : i + PASSED]] = passage(model, [symbols[j] for j in long[i : i + PASSED]])
    for i in np.nonzero(counts > 1)[0].tolist():
        low, high = int(at[i]), int(at[i] + counts[i])
        state = model.start
        for j in range(low, high - 1):
            state = state @ through[j]
            state /= state.sum()
            before[j + 1] = state
            state = state @ model.step
        message = np.ones(k)
        for j in range(high - 1, low, -1):
            message = model.step @ (through[j] @ message)
            message /= message.max()
            after[j - 1] = message
    return Pieces(symbols, before, after, first)


def expected(model: Model, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of starts, steps and emissions [symbol, state] of whole texts, and their log probability."""
    order, live, symbols = grid(pieces.symbols)
    before, after, first = pieces.before[order], pieces.after[order], pieces.first[order]
    most, n, k = len(live), len(order), len(model.start)
    ahead, scale, one = np.zeros((most, n, k)), np.ones((most, n)), np.ones(k)
    entry = np.where(first[:, None], model.start, before @ model.step)
    for t in range(most):
        m = live[t]
        x = (entry if t == 0 else ahead[t - 1, :m] @ model.step) * model.emit[symbols[t, :m]]
        scale[t, :m] = x @ one
        np.divide(x, scale[t, :m, None], out=ahead[t, :m])
    last = ahead[np.array([len(pieces.symbols[i]) for i in order]) - 1, np.arange(n)]
    back = after / (last * after).sum(1)[:, None]  # posteriors then add up to 1
    steps, posterior = np.zeros((k, k)), ahead
    for t in range(most - 1, -1, -1):
        m = live[t]
        y = model.emit[symbols[t, :m]] * back[:m] / scale[t, :m, None]
        posterior[t, :m] *= back[:m]
        if t:
            # the state before is still unweighted there
            steps += ahead[t - 1, :m].T @ y
            back[:m] = y @ model.step.T
        else:
            steps += before[:m][~first[:m]].T @ y[~first[:m]]
    there = np.arange(n)[None, :] < live[:, None]
    emitted = np.zeros((k, len(model.emit)))
    for t in range(0, most, some := max(1, AT_ONCE // 8 // n)):
        own = there[t : t + some]
        seen, weight = symbols[t : t + some][own], posterior[t : t + some][own].T.copy()
        for s in range(k):
            emitted[s] += np.bincount(seen, weight[s], len(model.emit))
    return posterior[0][first].sum(0), steps * model.step, emitted.T, float(np.log(scale[there]).sum())


def counts_of(model: Model, sequences: list[np.ndarray]) -> list[np.ndarray]:
    """[starts, steps, emissions] of the sequences, in grids of AT_ONCE tokens at most; zeros of none."""
    k = len(model.start)
    out = [np.zeros(k), np.zeros((k, k)), np.zeros_like(model.emit)]
    if not sequences:
        return out
    whole = in_pieces(model, sequences)
    order = np.argsort([-len(p) for p in whole.symbols], kind="stable")
    done = 0
    for some in batches_of([whole.symbols[i] for i in order]):
        own = order[done : done + len(some)]
        done += len(some)
        for a, b in zip(out, expected(model, Pieces(some, whole.before[own], whole.after[own], whole.first[own])), strict=False):
            a += b
    return out


def refit(counts: tuple[np.ndarray, np.ndarray, np.ndarray], common: np.ndarray, prior: float = 30.0) -> Model:
    """The model of largest posterior: emissions lean to the symbols' shares in the corpus, so none is zero."""
    start, step, emitted = counts
    emit = emitted + prior * common[:, None]
    return Model((start + 1) / (start + 1).sum(), (step + 1) / (step + 1).sum(1, keepdims=True), emit / emit.sum(0))


def batches_of(sequences: list[np.ndarray], cells: int = AT_ONCE) -> Iterator[list[np.ndarray]]:
    """Sequences of like length together, longest first, in grids of at most `cells` (or one sequence)."""
    some: list[np.ndarray] = []
    for s in sorted(sequences, key=len, reverse=True):
        if some and len(some[0]) * (len(some) + 1) > cells:
            yield some
            some = []
        some.append(s)
    if some:
        yield some


def segments(sequence: np.ndarray) -> list[np.ndarray]:
    return [sequence[i : i + SEGMENT] for i in range(0, len(sequence), SEGMENT)]


def near_groups(classes: list[int], common: np.ndarray) -> np.ndarray:
    """The group of each symbol, under NEAR: the most frequent words and the end have one each, the others share NEAR_CLASSES by
    their class. classes: those of the words of the lexicon, the most frequent first."""
    alone, size = NEAR - NEAR_CLASSES - 1, len(classes)
    kinds = np.concatenate([np.array(classes, np.int64), [0], np.arange(len(common) - size - 1)])
    out = alone + 1 + kinds % NEAR_CLASSES
    out[: min(alone, size)] = np.arange(min(alone, size))
    out[size] = alone
    return out


def neighbours(encoded: DataFrame, group: np.ndarray, end: int) -> np.ndarray:
    """[group, group]: how often a symbol of the one is followed by one of the other, within the rows of encoded (symbols)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(NEAR * NEAR, np.int64)
        for b in batches:
            if len(b):
                own = np.concatenate(list(b.symbols))
                at, inside = group[own], own[:-1] != end
                total += np.bincount((at[:-1] * NEAR + at[1:])[inside], minlength=NEAR * NEAR)
        cells = np.flatnonzero(total)
        yield pd.DataFrame({"cell": cells, "n": total[cells]})

    found = encoded.select("symbols").mapInPandas(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # NEAR * NEAR rows at most
    out = np.zeros(NEAR * NEAR)
    out[found["cell"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(NEAR, NEAR)


def begin(pairs: np.ndarray, group: np.ndarray, common: np.ndarray, states: int, seed: int = 4, prior: float = 30.0) -> Model:
    """The chain under which the pairs of neighbours are likeliest, by expectation-maximization from a random start with lasting
    states. Symbols of one group share its probability as they do in the corpus."""
    rng = np.random.default_rng(seed)
    share = np.bincount(group, common, len(pairs))
    emit = rng.dirichlet(np.full(states, 0.5), len(share)) * share[:, None] + 1e-3 * share[:, None]
    emit /= emit.sum(0)
    joint = (np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)) / states
    for _ in range(START_ROUNDS if pairs.any() else 0):
        ratio = pairs / np.maximum(emit @ joint @ emit.T, 1e-300)
        after, before = ratio @ emit, ratio.T @ emit
        emitted = emit * (after @ joint.T + before @ joint) + prior * share[:, None]
        joint = joint * (emit.T @ after) + 1
        joint, emit = joint / joint.sum(), emitted / emitted.sum(0)
    every = emit[group] * (common / share[group])[:, None]
    return Model(joint.sum(1), joint / joint.sum(1, keepdims=True), every / every.sum(0))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(False))


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(h, class, c): how often each word occurs; summed in each task first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return summed(*(np.concatenate(x) for x in zip(*seen, strict=True)))

        for b in batches:
            for low, high in parts(b.text):
                h, kinds, _ = tokens(b.text[low:high])
                seen.append(summed(h, kinds, np.ones(len(h), np.int64)))
                if sum(len(x[0]) for x in seen) >= 2 * COUNTED:
                    seen = [merged()]
                    if len(seen[0][0]) >= COUNTED:
                        yield pd.DataFrame(dict(zip(("h", "class", "c"), seen.pop(), strict=True)))
        if seen:
            yield pd.DataFrame(dict(zip(("h", "class", "c"), merged(), strict=True)))

    each = docs.select(F.col(text_col).alias("text")).mapInPandas(count, "h long, class int, c long")
    return each.groupBy("h").agg(F.first("class").alias("class"), F.sum("c").alias("c"))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of probabilities).

    Null and empty texts are the end alone. Repeated rows are counted and scored each for itself; a null id is not held out.
    An empty table gives no rows. Without training documents every token is unseen.
    """
    spark, rows = docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    spark.conf.set(rows, ROWS)
    try:  # all that goes to Python is worked out in there
        return _score(docs, id_col, text_col, states, rounds)
    finally:
        spark.conf.set(rows, before)


def _score(docs: DataFrame, id_col: str, text_col: str, states: int, rounds: int) -> DataFrame:
    spark = docs.sparkSession
    train = docs.where(~held_out(id_col)).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counts = stash(word_counts(train), "counts")
    n_train = train.count()
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = sums.n + n_train, sums.v + (1 if n_train else 0)  # the end is a token and a word
    frequent = stash(counts.where(F.col("c") >= LEAST).orderBy(F.desc("c"), "h").limit(LEXICON), "lexicon")
    top = sorted(frequent.collect(), key=lambda x: (-x.c, x.h))  # LEXICON at most
    lexicon_counts = np.array([x.c for x in top], float)
    rest = counts.join(F.broadcast(frequent.select("h")), "h", "left_anti")
    by_class = {x["class"]: (x.n, x.v) for x in rest.groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}  # CLASSES at most
    class_n, class_v = (np.array([by_class.get(i, (0, 0))[j] for i in range(CLASSES)], float) for j in (0, 1))
    common = np.concatenate([lexicon_counts, [n_train], class_n]) + 0.5
    common /= common.sum()

    shipped_lexicon = spark.sparkContext.broadcast(np.array([x.h for x in top], np.int64))
    known_logs = np.log10(np.concatenate([lexicon_counts, [n_train]]) + 1)
    class_logs = np.log10(class_n + class_v + 1)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each text as symbols, and what needs no model: the logs of its frequent words and classes, and its other words as
        distinct hashes with their counts."""
        words, size = shipped_lexicon.value, len(known_logs) - 1
        place = np.argsort(words).astype(np.int32)
        words = np.append(words[place], np.int64(0))
        for b in batches:
            for low, high in parts(b.text):
                n = high - low
                hashes, kinds, lengths = tokens(b.text[low:high])
                at = np.searchsorted(words[:size], hashes)
                other = (at == size) | (words[at] != hashes)
                symbols = size + 1 + kinds
                symbols[~other] = place[at[~other]]
                row = np.repeat(np.arange(n), lengths)
                # (row, word) of the words outside the lexicon, as one number
                names, which = np.unique(hashes[other], return_inverse=True)
                pair, times = np.unique(row[other] * max(1, len(names)) + which, return_counts=True)
                of, which = np.divmod(pair, max(1, len(names)))
                cuts, ends = np.searchsorted(of, np.arange(1, n)), np.cumsum(lengths)
                out = b.iloc[low:high][["row_id", "doc_id", "held_out"]].reset_index(drop=True)
                yield out.assign(
                    symbols=pd.Series(np.split(np.insert(symbols, ends, size), (ends + np.arange(1, n + 1))[:-1]), dtype=object), n_tokens=lengths + 1,
                    n_known=np.bincount(row[~other], minlength=n) + int(n_train > 0), logs=np.bincount(row[~other], known_logs[symbols[~other]], n) + known_logs[size],
                    class_logs=np.bincount(row[other], class_logs[symbols[other] - size - 1], n), h=pd.Series(np.split(names[which], cuts), dtype=object), times=pd.Series(np.split(times.astype(np.int32), cuts), dtype=object),
                )

    chosen = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("string").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    encoded = stash(chosen.mapInPandas(encode, "row_id long, doc_id string, held_out boolean, symbols array<int>, n_tokens long, n_known long, logs double, class_logs double, h array<long>, times array<int>"), "encoded")

    group = near_groups([x["class"] for x in top], common)
    model = begin(neighbours(encoded.where("not held_out"), group, len(top)), group, common, states)
    for _ in range(rounds if n_train else 0):
        shipped = spark.sparkContext.broadcast(model)  # symbols by states, both bounded

        def collect(batches: Iterator[pd.DataFrame], shipped=shipped) -> Iterator[pd.DataFrame]:
            own = shipped.value
            total: list[np.ndarray] | None = None
            waiting: list[np.ndarray] = []
            held = 0
            for s in itertools.chain((s for b in batches for s in b.symbols), [None]):
                if s is not None:
                    waiting.append(s)
                    held += len(s)
                if held >= 4 * AT_ONCE or s is None:
                    found = counts_of(own, waiting)
                    total = found if total is None else [a + b for a, b in zip(total, found, strict=True)]
                    waiting, held = [], 0
            rows = np.concatenate([total[0][None], *total[1:]])
            some = np.nonzero(rows.any(1))[0]
            yield pd.DataFrame({"row": some, "x": pd.Series(list(rows[some]), dtype=object)})

        sums = encoded.where("not held_out").select("symbols").mapInPandas(collect, "row long, x array<double>").groupBy("row").agg(F.array(*[F.sum(F.col("x")[i]) for i in range(states)]).alias("x"))
        total = np.zeros((1 + states + len(common), states))
        for x in sums.collect():  # one row a symbol, state and start
            total[x.row] = x.x
        shipped.destroy()
        model = refit((total[0], total[1 : 1 + states], total[1 + states :]), common)

    shipped = spark.sparkContext.broadcast(model)

    def likelihood(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = b.symbols.to_numpy()
            order = np.argsort([-len(s) for s in own], kind="stable")
            logs, done = np.empty(len(own)), 0
            for some in batches_of([own[i] for i in order], FORWARD_AT_ONCE):
                logs[order[done : done + len(some)]] = forward(shipped.value, some)
                done += len(some)
            yield b.drop(columns="symbols").assign(score=logs / np.log(10) - b.class_logs)

    fixed = "row_id long, doc_id string, held_out boolean, n_tokens long, n_known long, logs double, class_logs double"
    scored = stash(encoded.drop("h", "times").select("symbols", *[c.split()[0] for c in fixed.split(", ")]).mapInPandas(likelihood, fixed + ", score double"), "scored")
    # words outside the lexicon are rare, so no key of this join is hot
    pairs = encoded.select("row_id", F.explode(F.arrays_zip("h", "times")).alias("w")).select("row_id", F.col("w.h").alias("h"), F.col("w.times").alias("times"))
    seen = pairs.join(rest.select("h", "c"), "h").groupBy("row_id").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("c") + F.lit(1.0))).alias("more"))
    out = scored.join(seen, "row_id", "left")
    more = F.coalesce("more", F.lit(0.0))
    unseen = float(np.log10(n + v + 1.0))
    return out.select(
        F.col("doc_id").cast(docs.schema[id_col].dataType).alias("doc_id"), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * F.lit(unseen)).alias("base_score"), (F.col("score") + more).alias("score"),
    )
