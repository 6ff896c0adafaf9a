"""Rules, domains and headers are worked out once a row, and rows that texts are made of are dealt out over tasks."""

import re

from pyspark.sql import functions as F

from gleanery.functions import patterns as P
from gleanery.functions import spans
from gleanery.operators import detect as D
from gleanery.operators import mail
from gleanery.plans import evidence, mixed, planted, registry

HEADERS = "headers array<struct<name: string, value: string>>"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _tables(spark, at):
    keys = "cast(id + 65570 as bigint)"
    spark.range(30).selectExpr(f"{keys} AS c_custkey", "'m' AS c_mktsegment").coalesce(1).write.parquet(f"{at}/customer.parquet")
    spark.range(30).selectExpr(f"{keys} AS o_orderkey", "'1' AS o_orderpriority").coalesce(1).write.parquet(f"{at}/orders.parquet")
    spark.range(200).selectExpr("id AS s_suppkey").coalesce(1).write.parquet(f"{at}/supplier.parquet")
    return str(at)


def test_rows_of_one_row_group_are_dealt_out(spark, tmp_path):
    at = _tables(spark, tmp_path)
    for df in (mixed.mixed(spark, at), planted.planted(spark, at, "password"), evidence.QUERIES["j17_planted_lookalikes"](spark, at)):
        assert df.rdd.getNumPartitions() > 4


def test_field_rules_are_in_the_plan_once(spark):
    units = spark.createDataFrame([("s", "1", 'password = "Zq9!0123456789"')], "source string, doc_id string, text string")
    found = D.detect(units, kinds=["password"])
    assert [(x.value, x.confidence) for x in found.collect()] == [("Zq9!0123456789", "high")]
    assert _plan(found).count("fixtures?") == 1


def test_ipv6_lookup_of_keys_over_a_group(spark, tmp_path):
    """Keys over 65,535 do not fit a group of the address; of equal prefixes the least number is told."""
    rows = registry.QUERIES["j14_ipv6_lookup"](spark, _tables(spark, tmp_path)).collect()
    known = [(s, s % 50, s % 9 if s % 2 == 0 else None) for s in range(200)]
    for x in rows:
        k = x.c_custkey
        hits = sorted((b is None, s) for s, a, b in known if a == k % 50 and b in (None, k % 9))
        assert x.ip == f"2001:db8:{k % 50:x}:{k % 9:x}::{k:x}"
        assert (x.asn, x.prefix_len) == ((hits[0][1], 48 if hits[0][0] else 64) if hits else (-1, -1))
    assert len(rows) == 30 and any(x.asn >= 0 for x in rows)


def test_lookalikes_read_a_domain_once(spark):
    df = spark.createDataFrame([("paypa1.com",), ("a.b.co.uk",), ("www.amazon.com",), ("10.0.0.1",), ("localhost",), (None,)], "d string")
    found = df.select("d", mail.lookalike(df.d).alias("b"))
    assert {x.d: x.b for x in found.collect()} == {"paypa1.com": "paypal.com", "a.b.co.uk": None, "www.amazon.com": None, "10.0.0.1": None, "localhost": None, None: None}
    assert _plan(found).count(r"^[\d.]+$") == 1


def test_hops_come_of_one_pass(spark):
    rows = [(1, [("Received", "from b by c with SMTP; x"), ("received", "from a by b id 7"), ("Subject", "s")]), (2, [("Received", "from a id 7")]), (3, [])]
    found = mail.received_hops(spark.createDataFrame(rows, f"msg_sha256 int, {HEADERS}"))
    assert sorted((x.msg_sha256, x.hop, x.from_host, x.by_host, x.public) for x in found.collect()) == sorted([(1, 1, "a", "b", False), (1, 2, "b", "c", False), (1, 3, "c", None, None), (2, 1, "a", None, False)], key=str)
    assert "Window" not in _plan(found) and "Union" not in _plan(found)


def test_headers_are_parsed_once(spark):
    rows = [(1, [("From", '"PayPal" <a@x.example>'), ("Reply-To", "b@y.test"), ("Date", "Thu, 1 Feb 2024 11:00:00 +0100")])]
    found = mail.mail_headers(spark.createDataFrame(rows, f"msg_sha256 int, {HEADERS}"))
    assert found.first().anomalies == ["Reply-To domain differs", "display name imitates another sender"]
    assert _plan(found).count("= date)") == 1


def test_looking_ahead_loses_no_match(spark):
    """Names and hosts are tried only where one can end; what is found is what the patterns find without that."""
    ahead = re.compile(r"\(\?=\[.*?(?:\[:=\]|\\\.)\)")
    names = ["password", "DbPassword", "x" * 24 + "Password", "my user_name", "api-key", "API.KEY", "login name", "pw"]
    ends = [" = 'a1'", "\"  : b2", "']\t\t=> c3", " " * 70 + ":= d4", "\t \t= e5", "== f6", " g7", ".example.com", "." + "a" * 63 + ".org h", "." + "b" * 64 + ".org", "-.corp", "@x.lan", " at s-1.corp"]
    texts = [f"{before}{n}{e} and more words" for before in ("", "the ", "x.", "<", "-", "\n") for n in names for e in ends]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    gated = [s for s in P.SPECS if ahead.search(s.before + s.value)]
    assert [s.kind for s in gated] == ["internal-host", "domain", "password", "username", "secret"]
    parts = [F.transform(spans.matches(F.col("text"), v, b), lambda m: m["part"]) for s in gated for b, v in ((s.before, s.value), (ahead.sub("", s.before), ahead.sub("", s.value)))]
    found = rows.select(*[x.alias(f"p{i}") for i, x in enumerate(parts)]).collect()
    for i in range(0, len(parts), 2):
        assert [x[i] for x in found] == [x[i + 1] for x in found] and any(x[i] for x in found)
