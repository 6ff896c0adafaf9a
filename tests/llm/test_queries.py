"""The registered queries in the shape of their contracts, against plain versions."""

import collections
import hashlib
import math
import re
import struct
import zlib

import pytest
from test_operators import by_hand, fold, links_of, plain_secrets, private, simple_fingerprint
from tokenizers import Tokenizer

from gleanery.llm import mixing, packing
from gleanery.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SIZE = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name, key="doc_id"):
    out = {}
    for r in QUERIES[name](spark, SF).collect():
        out.setdefault(r[key], []).append(r)
    return out


def test_op1(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = rows(spark, "op1_url_filter", "page_id")
    assert set(got) == set(urls)
    for i, (r,) in got.items():
        host, path, rule, verdict = by_hand(urls[i])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict)


def test_op2(spark, texts):
    got = rows(spark, "op2_toxicity")
    assert set(got) == set(texts)
    for i, (r,) in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_op5(spark, texts):
    for i, (r,) in rows(spark, "op5_pii").items():
        base = private(texts[i].text)
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in base) for x in ("email", "ip", "card", "phone")]
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest() and r.spans.startswith(told)


def test_op6(spark, texts):
    got = rows(spark, "op6_mixing")
    own = collections.defaultdict(list)
    for r in texts.values():
        own[r.source].append(SIZE(r.text))
    names = sorted(own, key=lambda s: (s is None, (s or "").encode()))
    target = dict(zip(names, mixing.fill([sum(own[s]) for s in names], [(1, 2, 3)[i % 3] for i in range(len(names))]), strict=True))
    taken = collections.Counter()
    for i, (r,) in got.items():
        s = texts[i].source
        assert (r.size, r.source_size) == (SIZE(texts[i].text), sum(own[s])) and r.target == pytest.approx(target[s]) and r.taken <= 3 * r.size
        taken[s] += r.taken
    assert set(got) == set(texts) and all(abs(taken[s] - target[s]) <= max(own[s]) for s in names)


def test_op7(spark, texts):
    ids = sorted(texts)
    prints = [simple_fingerprint(texts[i].text) for i in ids]
    label = links_of(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    got = rows(spark, "op7_simhash")
    assert {i: (got[i][0].fingerprint, got[i][0].component_id) for i in got} == {i: (f"{p:016x}", ids[k]) for i, p, k in zip(ids, prints, label, strict=True)}


def test_op8(spark, texts):
    for i, (r,) in rows(spark, "op8_secrets").items():
        base, told, spans = plain_secrets(texts[i].text or "")
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for _, k, _ in base) for x in range(3)]
        assert (r.base_sha256, r.spans) == (hashlib.sha256(told.encode()).hexdigest(), spans)


def test_op9(spark, texts):
    got = rows(spark, "op9_hmm")
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    tokens = {i: [*fold(r.text).encode().split(), None] for i, r in texts.items()}
    count = collections.Counter(w for i in texts if not held[i] for w in tokens[i])
    for i, (r,) in got.items():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(tokens[i]), sum(w in count for w in tokens[i]), sum(count.values())) and r.score < 0
        below = sum(count.values()) + len(count) + 1
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / below) for w in tokens[i]))


def test_op10(spark, texts):
    known = Tokenizer.from_file(packing.tokenizer_path())
    places = collections.defaultdict(list)
    for i, own in rows(spark, "op10_packing").items():
        own.sort(key=lambda r: r.piece)
        assert [r.start for r in own] == [4096 * k for k in range(len(own))] and all(r.length == 4096 for r in own[:-1])
        ids = [*known.encode(texts[i].text or "", add_special_tokens=False).ids, 1]
        assert own[-1].start + own[-1].length == len(ids)
        for r in own:
            cut = ids[r.start : r.start + r.length]
            assert len(cut) == r.length and r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(cut)}I", *cut))
            places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(n for _, n in own) <= 4096


def test_ann_recall(spark):
    assert QUERIES["ann_recall"](spark, SF).first().recall >= 0.9
