"""Odd sketches, ranked search and the prefix trie against plain versions, and on nulls, empty and long texts, ties, repeats and clashing names."""

import collections
import hashlib
import math
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import ODD, SF, fold, odd  # noqa: F401

from gleanery.llm import odd_sketch, prefix_trie, ranked

WORDS = [f"w{i}" for i in range(400)]


def shingles(text):
    w = fold(text).encode().split()
    return frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def classes_by_hand(rows, percent=85):
    """(doc_id, size, component) of each row, by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (_, a) in enumerate(sets):
        for y in range(x):
            b = sets[y][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[max(top(x), top(y))] = min(top(x), top(y))
    least = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            least[top(x)] = min(least.get(top(x), i), i)
    return collections.Counter((i, len(s), least.get(top(x))) for x, (i, s) in enumerate(sets))


def edited(rng, words, share):
    return " ".join(f"e{rng.integers(1 << 30)}" if rng.random() < share else w for w in words)


def test_near_classes(spark, odd):  # noqa: F811
    got = odd_sketch.near_classes(odd).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == classes_by_hand([(r.doc_id, r.text) for r in odd.collect()])
    assert odd_sketch.near_classes(odd.limit(0)).count() == 0


def test_near_classes_about_the_limit(spark, monkeypatch):
    """Groups whose members are just under and just over the limit, with small groups, picks and blocks: every link, no other."""
    for name, value in (("GROUP", 8), ("PICKS", 2), ("BLOCK", 900)):
        monkeypatch.setattr(odd_sketch, name, value)
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(4):
        words = rng.choice(WORDS, 150)
        rows += [edited(rng, words, share) for share in rng.uniform(0, 0.035, 25)]
    rows += rows[:7] + [" ".join(rng.choice(WORDS, 60)) for _ in range(30)] + ["one two three four five six", "one two three four five six seven", "a b", "A  b"]
    rows = [(1000 - i, t) for i, t in enumerate(rows)]
    got = odd_sketch.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    want = classes_by_hand(rows)
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert 20 < len({c for _, _, c in want}) < 110


@pytest.mark.parametrize("size", [40, 2000])
def test_odd_sketches_tell_the_similarity(size):
    rng = np.random.default_rng(size)
    for similarity in (0.8, 0.9, 0.97):
        told = []
        for _ in range(30):
            x = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            own = round(size * (1 - similarity) / (1 + similarity))
            y = np.r_[x[own:], rng.integers(0, 1 << 63, own, dtype=np.uint64)]
            pair = [np.frombuffer(odd_sketch.odd_sketch(odd_sketch.minhash(s)), np.uint64)[None] for s in (x, y)]
            told.append(int(odd_sketch.differing(*pair)[0, 0]))
        assert max(told) <= odd_sketch.odd_limit(Fraction("0.8")) and abs(odd_sketch.estimate(np.array(told)).mean() - similarity) < 0.03
    assert odd_sketch.odd_limit(Fraction("0.95")) < odd_sketch.odd_limit(Fraction("0.85")) < odd_sketch.BITS / 2


def ranking_by_hand(docs, items, top=20):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", fold(t))
    bags = [(i, collections.Counter(terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n, length, df = len(bags), sum(x for _, _, x in bags), collections.Counter(w for _, b, _ in bags for w in b)
    out = collections.Counter()
    for item, text in items:
        scores = []
        for i, bag, size in bags:
            m = 100 - 25 + (25 * size * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * bag[w]) // (1000 * bag[w] + 12 * m)) for w in terms(text) if w in bag)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out.update((item, k, None if null else i, -s) for k, (s, null, i) in enumerate(sorted(scores)[:top], 1))
    return out


@pytest.mark.parametrize("cells, items_at_once, block", [(4_000_000, 64, 16 << 20), (500, 3, 900)])
def test_search(spark, odd, monkeypatch, cells, items_at_once, block):  # noqa: F811
    for name, value in (("CELLS", cells), ("ITEMS", items_at_once), ("ITEM_BYTES", block)):
        monkeypatch.setattr(ranked, name, value)
    items = [(7, "X de me x word", "k"), (8, None, "k"), (9, "...", "k"), (None, "ünï 1 2 3 4", "k"), (7, "X de me x word", "k"), (10, "unheard", "k")]
    asked = spark.createDataFrame(items, "item_id long, text string, score string")
    got = ranked.search(odd, asked, top=4).collect()
    assert collections.Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == ranking_by_hand([(r.doc_id, r.text) for r in odd.collect()], [i[:2] for i in items], 4)
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = docs.union(docs.limit(40))  # repeated rows
    got = ranked.search(docs, bench).collect()
    assert collections.Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == ranking_by_hand([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert ranked.search(odd.limit(0), asked).count() == ranked.search(odd, asked.limit(0)).count() == 0


def trie_by_hand(rows):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", sha(text or ""), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in own.items()}
    again = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        again[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:]
    members, ends, kids = collections.defaultdict(list), collections.defaultdict(list), collections.defaultdict(set)
    for c, turns in again.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    leaves, saved = collections.Counter(), collections.Counter()
    for node, own_members in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in kids
            saved[node[:d]] += (len(own_members) - 1) * len(node[-1][1].encode()) if node else 0
    return collections.Counter((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids.get(k, ())), leaves[k], saved[k], sha(",".join(map(str, sorted(ends.get(k, ())))))) for k, m in members.items())


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@pytest.mark.parametrize("block, fan", [(4, 64), (3, 2)])
def test_prefix_trie(spark, monkeypatch, block, fan):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "FAN", fan)
    monkeypatch.setattr(prefix_trie, "PIECE", 5)
    rng = np.random.default_rng(block)
    rows = []
    for c in [*range(-12, 60), 10**17]:
        words = [("user", "assistant", None)[rng.integers(3)] for _ in range(rng.integers(0, 14))]
        rows += [(c, k, w, ("hey", "Ünï", "", None)[rng.integers(4)] if k else "hey") for k, w in enumerate(words)]
    rows += [(70, k, "user", "hey") for k in range(60)] + [(71, k, "user", "hey") for k in range(57)]  # long, and a chain within it
    rows += [(72, None, "user", "hey"), (72, 1, "user", "b"), (72, 1, "user", "b"), (72, 1, None, "c"), (None, 1, "user", "lost"), (81, 1, "x", "y")]
    got = prefix_trie.prefix_trie(spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn int, role string, text string, depth int, node string").repartition(4)).collect()
    assert collections.Counter(tuple(r[c] for c in COLUMNS) for r in got) == trie_by_hand(rows)


def test_prefix_trie_without_turns(spark):
    schema = "conv_id long, turn int, role string, text string"
    assert prefix_trie.prefix_trie(spark.createDataFrame([], schema)).count() == 0
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in range(1, 5)}
    rows = [(c, 0, "user", "x") for c in h if h[c] > 0]  # no conversation 0: what they take is nothing
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, schema)).collect()
    assert collections.Counter(tuple(r[c] for c in COLUMNS) for r in got) == trie_by_hand(rows) and len(got) == 1


def test_ann_of_several_lengths(spark, monkeypatch):
    """Each length is searched by itself, and queries are dealt out in turns."""
    from gleanery.llm import ann

    monkeypatch.setattr(ann, "ASKED", 5)
    rng = np.random.default_rng(8)
    vectors = {i: rng.normal(size=(3, 4, 7)[i % 3 if i < 60 else 1]) for i in range(120)} | {500: np.array([1.0])}
    rows = [(i, [float(c) for c in v]) for i, v in vectors.items()] + [(600, [0.0, 0.0, 0.0]), (601, [1.0, float("inf"), 0.0]), (602, None), (603, [])]
    got = collections.defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 2 == 0).collect():
        got[r.query_id].append((r["rank"], r.vec_id))
    cosine = lambda a, b: float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b))
    for i in (i for i in vectors if i % 2 == 0):
        same = sorted((-cosine(vectors[i], v), j) for j, v in vectors.items() if j != i and len(v) == len(vectors[i]))
        assert sorted(got[i]) == [(k + 1, j) for k, (_, j) in enumerate(same[:5])], i


@pytest.mark.parametrize("run, literal", [("a", "me@x.de"), ("1", "1.2.3.4"), ("aB9+", "me@x.de 1.2.3.4"), ("1.2", "9.9.9.9"), ("a@", "b@c.de")])
def test_personal_data_in_long_runs(spark, run, literal):
    """A megabyte without a break beside a match: in time, and found as the plain patterns find it."""
    import time

    from gleanery.llm import pii
    from test_operators import private

    short = (run * 200)[:200] + " " + literal + " " + (run * 100)[:150] + literal + "_d@e.fr"
    text = (run * 1_000_000)[:1_000_000] + " " + literal
    docs = spark.createDataFrame([(1, text), (2, short)], "doc_id long, text string").select("doc_id", pii.base_spans(F.col("text")).alias("base"))
    docs.where("doc_id = 2").collect()
    began = time.time()
    got = {r.doc_id: [(pii.KINDS[s.kind], s.start, s.end) for s in r.base] for r in docs.collect()}
    assert time.time() - began < 20 and got[2] == [tuple(x) for x in private(short)]
    assert (len(text) - len(literal.split()[-1]), len(text)) in [x[1:] for x in got[1]] or run in ("1.2", "a@")
