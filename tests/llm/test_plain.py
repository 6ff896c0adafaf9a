"""Toxicity scores and disclosing terms against plain versions that work text by text."""

import collections
import math

import numpy as np
import pytest
import regex
from test_operators import private

from gleanery.llm import pii, toxicity

SF = "/root/testdata/sf0.001"


def plain_score(text, chain):
    """The score by the definition: a chain of two tags, its marginals from forward and backward sums scaled token by token."""
    x = []
    for token in regex.findall(r"\w+", text or ""):
        w = token.lower()
        own = {"w" + w, "s" + w[-3:]} | {"p" + w[:n] for n in (3, 4, 5, 6) if len(w) > n}
        weight = sum(float(chain.weights[toxicity.bucket(f)]) for f in own) + float(chain.weights[-1])
        x.append(math.exp(max(-30.0, min(30.0, weight))))
    ahead, back = [], [(1.0, 1.0)]
    for i, v in enumerate(x):
        a = (1.0, v) if i == 0 else tuple(sum(ahead[-1][s] * chain.step[s][t] for s in (0, 1)) * (1, v)[t] for t in (0, 1))
        ahead.append((a[0] / sum(a), a[1] / sum(a)))
    for v in reversed(x[1:]):
        b = tuple(sum(chain.step[s][t] * (1, v)[t] * back[-1][t] for t in (0, 1)) for s in (0, 1))
        back.append((b[0] / sum(b), b[1] / sum(b)))
    p = [a[1] * b[1] / (a[0] * b[0] + a[1] * b[1]) for a, b in zip(ahead, reversed(back[: len(x)]), strict=True)]
    most = min(max(max(p, default=0), 1e-4), 1 - 1e-4)
    return 1 / (1 + math.exp(-(chain.doc[0] + chain.doc[1] * math.log(most / (1 - most)) + chain.doc[2] * math.log1p(sum(p)))))


def test_scores_of_whole_texts(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    chain = toxicity.fit(docs, labels)
    assert chain.doc.any() and len(chain.weights) == toxicity.BUCKETS + 1
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.score for r in toxicity.tag(docs, chain).collect()}
    assert got == {i: pytest.approx(plain_score(t, chain), rel=1e-3, abs=1e-5) for i, t in texts.items()}
    assert any(len(t or "") > 6 * toxicity.LONG for t in texts.values()) and max(got.values()) - min(got.values()) > 0.5


def plain_terms(texts, threshold, support):
    """For each text the words that disclose one of its entities, by counts over all texts."""
    words = lambda t: set(regex.findall(r"\p{L}{2,}", t.lower()))
    n_term = collections.Counter(w for t in texts for w in words(t))
    contexts, together, holders = collections.defaultdict(set), collections.defaultdict(set), collections.defaultdict(set)
    for i, t in enumerate(texts):
        for _, a, b in private(t):
            value = t[a:b].lower()
            before, after = t[max(0, a - 81) : a], t[b : b + 81]
            if len(before) > 80:
                before = regex.sub(r"^(?:\p{L}+|[^\p{L}])", "", before)
            if len(after) > 80:
                after = regex.sub(r"(?:\p{L}+|[^\p{L}])$", "", after)
            holders[value].add(i)
            for w in words(before) | words(after):
                contexts[value, w].add((before, after))
                together[value, w].add(i)
    strong = collections.defaultdict(set)
    for (value, w), own in contexts.items():
        bits = math.log2(len(texts) / len(holders[value]))
        pmi = math.log2(len(together[value, w]) * len(texts) / (n_term[w] * len(holders[value])))
        if len(own) >= support and bits > 0 and pmi / bits >= threshold:
            strong[value].add(w)
    out = []
    for t in texts:
        asked = set().union(*(strong[t[a:b].lower()] for _, a, b in private(t)))
        out.append([(m.start(), m.end()) for m in regex.finditer(r"\p{L}{2,}", t) if m.group().lower() in asked])
    return out


@pytest.mark.parametrize(("threshold", "support"), [(0.8, 3), (0.3, 2)])
def test_terms_by_counts(spark, threshold, support):
    rng = np.random.default_rng(11)
    common, names = [f"w{chr(97 + i)}{chr(97 + i)}" for i in range(20)], ["Quill", "Ombre", "Zést", "Tarn"]
    texts = []
    for i in range(160):
        words = list(rng.choice(common, int(rng.integers(5, 60))))
        for k in rng.choice(4, int(rng.integers(0, 3)), replace=False):
            at = int(rng.integers(len(words)))
            near = [names[k]] if rng.random() < 0.8 else []
            words[at:at] = [*near, str(rng.choice(["mailed", "from"])), f"P{k}@Mail.org"]
        texts.append(" ".join(words))
    texts += ["Quill alone", "", "10.0.0.7 by Tarn and 10.0.0.7 by Tarn", texts[0], texts[1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: [(s.start, s.end) for s in r.terms] for r in pii.find(docs, threshold=threshold, support=support).collect()}
    want = plain_terms(texts, threshold, support)
    assert any(want) and got == dict(enumerate(want))
