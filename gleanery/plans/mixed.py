"""Queries over texts that hold several kinds at once: values that are none, overlaps, pairs, and values round the ends of blocks.

As in planted.py the texts are made of keys, and the SQL knows where everything was put.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import detect as D
from ..operators.lineage import dealt
from .planted import _sql

#: A line and what is found in it: (what stands before, value, kind, confidence, value as reported where that differs).
LINES: list[tuple[str, list[tuple[str, ...]]]] = [
    ("concat('mail jo', {d}, '@corp.example.com today')", [("'mail '", "concat('jo', {d}, '@corp.example.com')", "email", "high")]),
    # a url keeps the host in it out, but not a secret
    ("concat('go https://h', {d}, '.example.com/a?token=', {a}, ' now')", [("'go '", "concat('https://h', {d}, '.example.com/a?token=', {a})", "url", "medium"), ("concat('go https://h', {d}, '.example.com/a')", "concat('?token=', {a})", "secret-in-url", "critical")]),
    ("concat('from 10.42.', o_orderkey % 250, '.4 to 300.1.1.1 and 1:2:3')", [("'from '", "concat('10.42.', o_orderkey % 250, '.4')", "ipv4", "medium")]),
    ("'card 4111 1111 1111 1111 or 4111 1111 1111 1112'", [("'card '", "'4111 1111 1111 1111'", "credit-card", "high")]),
    ("'iban GB00WEST00000000000000 no'", []),
    ("'password = \"changeme\"'", []),
    ("'api_key = os.environ[\"KEY\"]'", []),
    ("concat('a', chr(10), 'b', chr(10), 'c', chr(10), 'd', chr(10), 'e')", []),
    # within five lines of one another a name and a password raise each other
    ("concat('<password>Zq9!', substr({a}, 1, 10), '</password>')", [("'<password>'", "concat('Zq9!', substr({a}, 1, 10))", "password", "critical")]),
    ("concat('username = \"bob', {d}, '\"')", [("'username = '", "concat('\"bob', {d}, '\"')", "username", "high", "concat('bob', {d})")]),
    ("concat('f', chr(10), 'g', chr(10), 'h', chr(10), 'i', chr(10), 'j', chr(10), 'k')", []),
    ("concat('<add key=\"client_secret\" value=\"', {a}, 'GHIJKLMNOPQRSTUVWXYZ\"/>')", [("'<add key=\"client_secret\" value=\"'", "concat({a}, 'GHIJKLMNOPQRSTUVWXYZ')", "secret", "medium")]),
    ("concat('tel +44', {d}, ' and ', {d})", [("'tel '", "concat('+44', {d})", "intl-phone", "medium")]),
    ("'sample password = \"Hq7#kk29zz\"'", []),
    ("concat('see h', {d}, '.example.com and srv', {d}, '.corp')", [("'see '", "concat('h', {d}, '.example.com')", "domain", "low"), ("concat('see h', {d}, '.example.com and ')", "concat('srv', {d}, '.corp')", "internal-host", "low")]),
]

_KEYS = "(SELECT c_custkey AS o_orderkey, c_mktsegment AS source FROM customer)"


def _joined(parts: list[str]) -> str:
    return f"concat({', chr(10), '.join(_sql(x) for x in parts)})"


def mixed_sql() -> str:
    """All findings of the mixed texts, in SQL that knows where they were put."""
    rows = []
    for i, (_, found) in enumerate(LINES):
        ahead = [line for line, _ in LINES[:i]]
        for before, value, kind, confidence, *shown in found:
            start = f"length({_joined([*ahead, before])})"
            number = 1 + sum(1 + line.count("chr(10)") for line in ahead)
            rows.append(f"""SELECT source, concat('', o_orderkey) AS unit_id, {number}::BIGINT AS line, {start}::INT AS start, ({start} + length({_sql(value)}))::INT AS "end", '{kind}' AS kind, {_sql(shown[0] if shown else value)} AS value, '{confidence}' AS confidence FROM {_KEYS}""")
    return " UNION ALL ".join(rows)


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = dealt(spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS o_orderkey", "c_mktsegment AS source"), "o_orderkey")
    return keys.selectExpr("o_orderkey AS doc_id", "source", f"{_joined([line for line, _ in LINES])} AS text")


def k_mixed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.detect(mixed(spark, sf_dir)).select("source", "unit_id", "line", "start", "end", "kind", "value", "confidence")


def k_mixed_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.inventory(D.detect(mixed(spark, sf_dir)))


def k_mixed_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.rotation(D.detect(mixed(spark, sf_dir))).select("fingerprint", "kind", "severity", "projects", "files", "occurrences", "rank")


def k_mixed_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.redact(mixed(spark, sf_dir)).select("unit_id", "redacted", "n")


def _redacted() -> str:
    """The mixed text with its outermost findings replaced."""
    lines = []
    for line, found in LINES:
        out = _sql(line)
        for _, value, kind, *_ in found[:1] if "https" in line else found:
            out = f"replace({out}, {_sql(value)}, '[REDACTED:{kind}]')"
        lines.append(out)
    return f"concat({', chr(10), '.join(lines)})"


_RANKS = " ".join(f"WHEN kind IN ({', '.join(repr(k) for k in kinds)}) THEN {r}" for r, kinds in P.ROTATION.items())
_CATEGORIES = " ".join(f"WHEN '{k}' THEN '{c}'" for k, c in P.CATEGORY.items())
_LEVEL = "list_position(['low', 'medium', 'high', 'critical'], confidence)"

#: Where a value begins, less what stands before it, and its length.
_GAP, _LONG = "(16384 - 700 + s_suppkey * 37 % 1400)", "(10 + s_suppkey * 199 % 20000)"


def r01_block_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bearer values of 10 to 20,000 characters that begin round the end of a block, in one line or after short ones."""
    filler = f"CASE WHEN s_suppkey % 2 = 0 THEN repeat('q ', cast({_GAP} div 2 as int)) ELSE repeat(concat('row', chr(10)), cast({_GAP} div 4 as int)) END"
    text = f"concat({filler}, 'Authorization: Bearer ', repeat('Zx9k', cast({_LONG} div 4 + 2 as int)), ' end')"
    units = dealt(spark.read.parquet(f"{sf_dir}/supplier.parquet"), "s_suppkey").selectExpr("s_suppkey AS doc_id", "'s' AS source", f"{text} AS text")
    return D.detect(units, kinds=["bearer"]).select("unit_id", "start", "end", "line", F.sha2("value", 256).alias("value_sha256"))


def x_message_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bearer value in the head and a key in the body of requests, an address in the body of responses."""
    line = "concat('GET /', {d}, ' HTTP/1.1', chr(13), chr(10), 'Authorization: Bearer ', {h}, chr(13), chr(10), chr(13), chr(10), 'k AKIA', substr({u}, 1, 16), ' end')"
    answer = "concat('HTTP/1.1 200 OK', chr(10), chr(10), 'row', chr(10), 'mail u', {d}, '@x.example.org')"
    rows = dealt(spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS o_orderkey"), "o_orderkey")
    rows = rows.selectExpr("o_orderkey AS id", f"{_sql(line)} AS request", f"CASE WHEN o_orderkey % 3 > 0 THEN {_sql(answer)} END AS response")
    return D.message_findings(rows, "id", kinds=["bearer", "aws-access-key", "email"]).select("unit_id", "part", "place", "line", "kind", "value", "confidence")


QUERIES = {"x_message_findings": x_message_findings, "k_mixed_findings": k_mixed_findings, "k_mixed_inventory": k_mixed_inventory, "k_mixed_rotation": k_mixed_rotation, "k_mixed_redact": k_mixed_redact, "r01_block_edges": r01_block_edges}
_ONE = f"SELECT concat('', o_orderkey) AS unit_id, '{{}}' AS part, '{{}}' AS place, {{}}::BIGINT AS line, '{{}}' AS kind, {{}} AS value, '{{}}' AS confidence FROM {_KEYS}"

ORACLE_SQL = {
    "x_message_findings": " UNION ALL ".join(
        (_ONE.format("request", "head", 2, "bearer", _sql("{h}"), "critical"), _ONE.format("request", "body", 4, "aws-access-key", _sql("concat('AKIA', substr({u}, 1, 16))"), "critical"), _ONE.format("response", "body", 4, "email", _sql("concat('u', {d}, '@x.example.org')"), "high") + " WHERE o_orderkey % 3 > 0")
    ),
    "k_mixed_findings": mixed_sql(),
    "k_mixed_inventory": f"""WITH f AS ({mixed_sql()}) SELECT kind, CASE kind {_CATEGORIES} END AS category, count(*) AS n, count(DISTINCT value) AS n_values, count(DISTINCT unit_id) AS n_units,
        ['low', 'medium', 'high', 'critical'][max({_LEVEL})] AS top FROM f GROUP BY kind""",
    "k_mixed_rotation": f"""WITH f AS ({mixed_sql()}) SELECT sha256(concat(lower(kind), chr(10), trim(value))) AS fingerprint, kind, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][max({_LEVEL})] AS severity,
        count(DISTINCT source) AS projects, count(DISTINCT source || '/' || unit_id) AS files, count(*) AS occurrences, CASE {_RANKS} ELSE 2 END AS rank FROM f GROUP BY fingerprint, kind""",
    "k_mixed_redact": f"SELECT concat('', o_orderkey) AS unit_id, {_redacted()} AS redacted, {sum(len(found) for _, found in LINES)} AS n FROM {_KEYS}",
    "r01_block_edges": f"""WITH g AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 2 * ({_GAP} // 2) ELSE 4 * ({_GAP} // 4) END + 22 AS start, repeat('Zx9k', ({_LONG} // 4 + 2)::INT) AS value FROM supplier)
        SELECT concat('', s_suppkey) AS unit_id, start::INT AS start, (start + length(value))::INT AS "end", CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 1 + (start - 22) // 4 END::BIGINT AS line, sha256(value) AS value_sha256 FROM g""",
}
