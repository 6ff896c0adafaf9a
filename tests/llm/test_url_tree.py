"""The template tree against a plain version of it."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from gleanery.llm import url_filter


def plain_tree(rows, most_kids=16, z=1.96, strength=4.0, sure=1.64):
    """rows (host, path, label) -> {(host, path): (template, purity, rejected)}"""
    shapes = collections.defaultdict(lambda: [0, 0, 0])
    cut = {}
    for host, path, label in rows:
        short = re.sub(r"(?<![0-9A-Za-z])[0-9a-f]{8,}(?![0-9A-Za-z])", "<h>", path)
        segments = () if path == "" else tuple(re.sub("[0-9]+", "<n>", re.sub("^/", "", short)).split("/"))
        cut[host, path] = segments
        s = shapes[host, segments]
        s[0] += 1
        s[1] += label is not None
        s[2] += label or 0
    prior = (sum(c[2] for c in shapes.values()) + 1) / (sum(c[1] for c in shapes.values()) + 2)
    template = {}

    def grow(host, own, done):
        """own: {shape: rest} of one node"""
        template.update({(host, s): done for s, rest in own.items() if not rest})
        kids = collections.defaultdict(dict)
        for s, rest in own.items():
            if rest:
                kids[rest[0]][s] = rest[1:]
        counts = {k: [sum(shapes[host, s][i] for s in v) for i in range(3)] for k, v in kids.items()}
        whole = [sum(c[i] for c in counts.values()) for i in range(3)]
        merged = collections.defaultdict(dict)
        for k, (n, labelled, bad) in counts.items():
            others = whole[1] - labelled + strength
            rate = (whole[2] - bad + strength * prior) / others
            variable = len(kids) > most_kids and n * len(kids) < whole[0]
            similar = abs(bad - labelled * rate) <= z * (labelled * rate * (1 - rate) * (1 + labelled / others)) ** 0.5
            # a node's only branch keeps its name, if no shape ends at the node, too
            name = "*" if len(kids) > 1 and (variable or similar) else k
            merged[name].update(kids[k])
        for name, some in merged.items():
            grow(host, some, (*done, name))

    for host in {h for h, _ in shapes}:
        grow(host, {s: s for h, s in shapes if h == host}, ())
    pure = collections.defaultdict(lambda: [0, 0])
    for k, t in template.items():
        pure[k[0], t][0] += shapes[k][1]
        pure[k[0], t][1] += shapes[k][2]
    out = {}
    for k, s in cut.items():
        labelled, bad = pure[k[0], template[k[0], s]]
        p = (bad + strength * prior) / (labelled + strength)
        out[k] = ("/" + "/".join(template[k[0], s]), p, labelled > 0 and p - sure * (p * (1 - p) / (labelled + strength + 1)) ** 0.5 >= 0.5)
    return out


def test_tree(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(1500):
        host = rng.choice(["a.test", "b.test", "b.test", "b.test"])
        branch = rng.choice(["news", "shop", "spam", "x" + str(rng.randrange(40)) + chr(97 + rng.randrange(26)), ""])
        tail = rng.choice(["", "/deep" * 40 + rng.choice(["", "/x", "/y"]), f"/{rng.randrange(99)}", f"/deadbeef{rng.randrange(10)}", "/p/q.html", "//"])
        bad = rng.random() < (0.9 if branch == "spam" else 0.1)
        rows.append((host, f"/{branch}{tail}" if branch else rng.choice(["", "/"]), rng.choice([None, int(bad)])))
    want = plain_tree(rows)
    pages = spark.createDataFrame([(i, f"http://{h}{p}", y) for i, (h, p, y) in enumerate(rows)], "page_id long, url string, y int")
    got = url_filter.judge(pages, label=F.col("y"), rules=()).collect()
    assert len(got) == len(rows)
    for r in got:
        template, purity, rejected = want[r.host, r.path]
        assert r.template == template and r.purity == pytest.approx(purity) and r.verdict == ("block" if rejected else "allow")
    assert len({r.verdict for r in got}) == 2
