"""Best-fit packing of tokenized documents into sequences, with several capacities at once.

A document's ids are cut into pieces of at most `tokens`; each piece is a vector of demands: tokens, one document, and
attention cost (length squared). Pieces are dealt by hash into groups of about GROUP, and each group is packed by vector best-fit, longest
first: among the open sequences that every capacity allows, the one with the smallest weighted residual norm (or the largest weighted dot product) takes the piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

#: Pieces a group; words a worker remembers (about 200 bytes each).
GROUP, REMEMBERED = 8192, 400_000


#: Words by which a tokenizer shows whether it may be given words one by one.
_PROBES = (["Some", "Words,", "don't", "x1", "1,000", "Zürich", "naïve"], ["(a)", "B-c", "é", "…", "中文", "__init__", "A"], ["\u00a0x", "I'm", "42%", "http://a.b/C?d=E", "?!"])
#: Plain words by which it shows whether letters and the marks after them may be given one by one.
_MARKED = ("Some,", "ones,###", "Zürich.***", 'na"|()', "x&&&", "B%$@", "y_/+<=>~", "z[]{}^`;:!?-\\")


class WordTokens(dict):
    """Word (a run without white space) to its ids as little-endian uint32 bytes. `split` says whether the tokenizer's own
    settings make that exact: it drops white space before any token is made, lower-cases, and shows bytes as byte-level BPE
    does. Without that, whole texts go to the tokenizer."""

    def __init__(self, path: str):
        import re

        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.parts = self.tokenizer.model, {}
        self.split = all(self.encoded(" ".join(ws)) == b"".join(map(self.encoded, ws)) for ws in _PROBES) and all(self.encoded(w) == self.encoded(w.lower()) for ws in _PROBES for w in ws)
        # plain words: letters whose lower case is one character of the same kind, then common marks
        self.plain = re.compile(r"([a-zA-Z\xdf-\xf6\xf8-\xff\xc0-\xd6\xd8-\xde]+)([!-&(-/:-@\[-`{-~]*)").fullmatch
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed values: byte-level BPE shows these bytes as themselves
        rest = [b for b in range(256) if b not in own]
        self.shown = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
        if not all(self[w] == self.encoded(w) for w in _MARKED):
            self.plain = lambda word: None
            self.clear()

    def encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            if len(self.parts) >= REMEMBERED:
                self.parts.clear()
            shown = part if part.isascii() else "".join(map(self.shown.__getitem__, part.encode()))
            found = self.parts[part] = np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()
        return found

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        m = self.plain(word)
        if m:
            found = self.part(m[1].lower()) + (self.part(m[2]) if m[2] else b"")
        else:
            found = self.encoded(word)
        self[word] = found
        return found

    def ids(self, text: str | None) -> np.ndarray:
        text = text or ""
        if not self.split or any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space for str.split(), not for the tokenizer
            return np.frombuffer(self.encoded(text), "<u4")
        return np.frombuffer(b"".join(map(self.__getitem__, text.split())), "<u4")


@cache
def known_words(path: str) -> WordTokens:
    """The words that this worker knows; its tasks share them, one after another."""
    return WordTokens(path)


def tokenizer_path() -> str:
    from public_tokenizers import path

    return path("word_bpe_49k.json")


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: int = 4096, end_id: int = 1, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32 and, if asked for, ids): each document's ids and end_id, cut at `tokens`."""
    tokenizer = tokenizer or tokenizer_path()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = known_words(tokenizer)
        for b in batches:
            rows = []
            for doc, text in b.itertuples(index=False):
                ids = np.append(known.ids(text), np.uint32(end_id)).astype("<u4")
                for k, start in enumerate(range(0, len(ids), tokens)):
                    own = ids[start : start + tokens]
                    rows.append((doc, k, start, len(own), zlib.crc32(own.tobytes()), *([own.astype(np.int64)] if with_ids else [])))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    chosen = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    cut_up = chosen.mapInPandas(cut, "doc_id string, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))
    return cut_up.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))


def best_fit(lengths: np.ndarray, tokens: int, most_docs: int, most_attention: int, weights: Sequence[float] = (1.0, 0.05, 0.05), rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, longest first. rule "norm": the open bin with the smallest weighted norm of what is left
    after placing; "dot": that with the largest weighted dot product of the demand and what is left before."""
    full = np.array([tokens, most_docs, most_attention], float)
    w = np.asarray(weights, float)
    left = np.empty((len(lengths), 3))  # the open bins are the first `n`
    name = np.empty(len(lengths), np.int64)
    bins, offsets, n, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0, 0
    order = np.argsort(-lengths, kind="stable")
    least = int(lengths.min()) if len(lengths) else 1
    for i in order:
        need = np.array([lengths[i], 1.0, float(lengths[i]) ** 2])
        fits = np.nonzero((left[:n, 0] >= need[0]) & (left[:n, 1] >= 1) & (left[:n, 2] >= need[2]))[0]
        if len(fits):
            rest = left[fits]
            score = ((((rest - need) / full) ** 2) @ w) if rule == "norm" else -((rest / full * (need / full)) @ w)
            k = fits[int(np.argmin(score))]
        else:
            k, left[n], name[n], n, made = n, full, made, n + 1, made + 1
        bins[i], offsets[i] = name[k], tokens - int(left[k, 0])
        left[k] -= need
        if left[k, 0] < least or left[k, 1] < 1:  # closed: the last open bin takes its place
            left[k], name[k], n = left[n - 1], name[n - 1], n - 1
    return bins, offsets


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: int = 4096, most_docs: int | None = None, most_attention: int | None = None, weights: Sequence[float] = (1.0, 0.05, 0.05), rule: str = "norm", end_id: int = 1, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for).

    Capacities of a sequence: tokens; most_docs pieces (without it: tokens, which never binds); most_attention, the sum of
    squared lengths (without it: tokens squared, which never binds; at least that is needed for a full piece). Null and
    empty texts are the end id alone. Repeated rows and null ids are packed each for itself. An empty table gives no rows.
    """
    most_docs, most_attention = most_docs or tokens, most_attention or tokens * tokens
    if most_attention < tokens * tokens:
        raise ValueError("a full piece needs tokens squared")
    cut = stash(pieces(docs, id_col, text_col, tokens, end_id, tokenizer, with_ids), "pieces")
    groups = max(1, -(-cut.count() // GROUP))
    dealt = cut.withColumn("row", F.monotonically_increasing_id()).withColumn("group", F.expr(f"pmod(xxhash64(row, doc_id, piece), {groups})"))

    def one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row", ignore_index=True)
        bins, offsets = best_fit(group.length.to_numpy(), tokens, most_docs, most_attention, weights, rule)
        return group.drop(columns=["row", "group"]).assign(sequence_id=(np.int64(key[0]) << 32) + bins, offset=offsets)

    return dealt.groupBy("group").applyInPandas(one, ", ".join(f"{n} {t}" for n, t in cut.dtypes) + ", sequence_id long, offset long")
