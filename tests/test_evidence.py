"""Tables, queries, files, mail, fleet and streaming operators on small fixtures."""

import base64
import gzip
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from gleanery.functions import scalars as S
from gleanery.operators import fleet, mail, query, tables
from gleanery.sources import files
from gleanery.streaming import events as stream


def test_safe_names():
    assert tables.safe_names(["First Name", "first name", "2024 total", "weird!!col", ""]) == ["First_Name", "first_name_2", "col_2024_total", "weird_col", "col_5"]


def test_types_and_conversion(spark):
    df = spark.createDataFrame([("1", "1.5", "x", ""), (" 2", "", "true", None), ("3", "2", "y", " ")], "a string, b string, c string, d string")
    kinds = tables.infer_types(df)
    assert kinds == {"a": "INTEGER", "b": "REAL", "c": "TEXT", "d": "TEXT"}
    out = tables.convert(spark.createDataFrame([("1", "oops"), ("true", "2.5")], "a string, b string"), {"a": "INTEGER", "b": "REAL"}).collect()
    assert [(r.a, r.b, r._rescued) for r in out] == [(1, None, {"b": "oops"}), (1, 2.5, {})]


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;name;score\n1;jo;2.5\n2;al\n3;bo;1;9\n")
    df = files.load_delimited(spark, str(tmp_path / "a.csv"))
    assert df.columns[:3] == ["id", "name", "score"] and df.count() == 3
    assert files.ragged_rows(df.cache()).first().ragged == 2
    assert files.sniff(["a\tb", "c\td"]) == ("\t", False)


def test_json_sources(spark, tmp_path):
    (tmp_path / "a.ndjson").write_text('[\n{"a":1},\n{"a":2},\nbroken\n]\n')
    assert files.read_ndjson(spark, str(tmp_path / "a.ndjson")).count() == 2
    with pytest.raises(Exception, match="no JSON"):
        files.read_ndjson(spark, str(tmp_path / "a.ndjson"), strict=True).collect()
    (tmp_path / "b.json").write_text('{"note": "x", "rows": [{"a": 1, "b": {"c": 2}}, {"a": 3}]}')
    df = files.read_json(spark, str(tmp_path / "b.json"))
    assert tables.flatten(df).columns == ["a", "b.c"] and df.count() == 2


def test_lines_corpus_and_formats(spark, tmp_path):
    with gzip.open(tmp_path / "a.log.gz", "wt") as f:
        f.write("one\ntwo\n")
    assert [r.text for r in files.read_lines(spark, str(tmp_path / "a.log.gz")).collect()] == ["one", "two"]
    (tmp_path / "src/node_modules").mkdir(parents=True)
    (tmp_path / "src/app.py").write_text("def main(): pass\nmain()\n")
    (tmp_path / "src/node_modules/x.js").write_text("x")
    (tmp_path / "src/pic.png").write_bytes(b"\x89PNG\x00\x01")
    corpus = files.read_corpus(spark, str(tmp_path / "src"))
    assert [r.path.rsplit("/", 1)[1] for r in corpus.collect()] == ["app.py"]
    assert [r.role for r in query.find_symbol(corpus, "main", "path").collect()] == ["definition", "reference"]
    (tmp_path / "f").mkdir()
    for name, data in {"a.cap": b"\xd4\xc3\xb2\xa1\x02", "b.db": b"SQLite format 3\x00", "c.json": b'{"a": [1]}', "d.csv": b"a,b\n1,2\n", "e.txt": b"hello\nworld\n", "g.nd": b'{"a":1}\n{"a":2}\n'}.items():
        (tmp_path / "f" / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r.format for r in files.classify_files(spark, str(tmp_path / "f")).collect()}
    assert got == {"a.cap": "pcap", "b.db": "sqlite", "c.json": "json", "d.csv": "delimited", "e.txt": "text", "g.nd": "ndjson"}


def test_http_export(spark, tmp_path):
    raw = base64.b64encode(b"GET /a HTTP/1.1\r\nHost: h\r\nX-A: 1\r\nx-a: 2\r\n\r\nbody").decode()
    (tmp_path / "h.xml").write_text(f'<items><item><time>t</time><url>http://h/a</url><host ip="1.2.3.4">h</host><port>80</port><method>GET</method><request base64="true">{raw}</request><response base64="false">HTTP/1.1 200 OK</response></item></items>')
    row = files.read_http_xml(spark, str(tmp_path / "h.xml")).withColumn("m", files.split_http(F.col("request"))).withColumn("a", files.http_header(F.col("m.headers"), "X-A")).first()
    assert (row.host, row.host_ip, row.m.start, row.m.body, row.a) == ("h", "1.2.3.4", "GET /a HTTP/1.1", "body", "1, 2")
    (tmp_path / "n.xml").write_text('<nmaprun><host><address addr="1.1.1.1" addrtype="ipv4"/><hostnames><hostname name="a.b"/></hostnames><ports><port protocol="tcp" portid="22"><state state="open"/><service name="ssh"/></port></ports></host></nmaprun>')
    row = files.read_portscan_xml(spark, str(tmp_path / "n.xml")).first()
    assert (row.address, row.hostname, row.port, row.state, row.service) == ("1.1.1.1", "a.b", 22, "open", "ssh")


def test_html(spark):
    row = spark.createDataFrame([("<title> A  b </title><script>x</script><p>one</p><ul><li>two<li>two</ul><input name=q>",)], "h string").select(files.html_to_text(F.col("h")).alias("t"), files.html_title(F.col("h")).alias("n"), files.html_inputs(F.col("h")).alias("i")).first()
    assert row.n == "A b" and row.i == ["q"] and row.t.split("\n")[-2:] == ["one", "- two"]


def message(bad):
    m = EmailMessage()
    m["From"] = '"PayPal Support" <a@paypa1.com>' if bad else "jo@x.org"
    m["Reply-To"] = "b@evil.net" if bad else "jo@x.org"
    m["Date"] = "Mon, 05 Feb 2024 10:00:00 +0000"
    m["Subject"] = "hi"
    m["Received"] = "from mail.evil.net (mail.evil.net [8.8.4.4]) by mx.google.com with ESMTP id q1; Mon, 05 Feb 2024 10:00:01 +0000"
    m["Authentication-Results"] = "mx; spf=fail smtp.mailfrom=a@paypa1.com; dkim=fail header.d=paypa1.com; dmarc=fail header.from=paypa1.com" if bad else "mx; spf=pass smtp.mailfrom=jo@x.org; dkim=pass header.d=x.org; dmarc=pass"
    m.set_content("see text")
    if bad:
        m.add_alternative('<a href="http://evil.net/x">www.paypal.com</a>', subtype="html")
        m.add_attachment(b"MZ\x90\x00", maintype="application", subtype="pdf", filename="bill.pdf")
    return m.as_bytes()


def test_mail(spark):
    parsed = files.parse_mail(spark.createDataFrame([(bytearray(message(True)),), (bytearray(message(False)),)], "content binary")).cache()
    scores = {r.score: r for r in mail.mail_score(mail.mail_facts(parsed)).collect()}
    assert set(scores) == {0, 100} and scores[100].level == "HIGH"
    factors = {x.factor for x in scores[100].reasons}
    assert {"dmarc_fail", "dkim_invalid", "spf_fail", "reply_to_mismatch", "display_name_impersonation", "lookalike_or_new_domain", "executable_attachment", "extension_mime_mismatch", "link_text_lies"} <= factors
    hops = mail.received_hops(parsed).where("hop = 1").first()
    assert (hops.from_host, hops.by_host, hops.ip, hops.public, hops.relay) == ("mail.evil.net", "mx.google.com", "8.8.4.4", True, "Google")


def test_lookalike(spark):
    names = ["paypa1.com", "microsoft.login.ru", "microsoft-login.com", "microsfot.com", "example.org", "paypal.com"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "d string").select(mail.lookalike(F.col("d"))).collect()]
    assert [bool(x) for x in got] == [True, True, True, True, False, False]


def test_host_tables(spark):
    ps = "  PID  PPID USER  %CPU %MEM   RSS COMMAND\n    1     0 root   0.0  0.1  1000 /sbin/init\n   20     1 jo    12.5  2.0  2048 /tmp/x --run\n   30    20 jo     1.0  1.0   512 sh\n"
    procs = fleet.parse_process_table(spark.createDataFrame([("h", ps)], "host_id string, text string")).cache()
    assert [(r.pid, r.ppid, r.rss_bytes, r.executable) for r in procs.orderBy("pid").collect()] == [(1, 0, 1024000, "/sbin/init"), (20, 1, 2097152, "/tmp/x"), (30, 20, 524288, "sh")]
    lsof = "COMMAND PID USER FD TYPE DEVICE SIZE/OFF NODE NAME\nx 20 jo 3u IPv4 0x1 0t0 TCP 10.0.0.1:5000->8.8.8.8:443 (ESTABLISHED)\nx 20 jo 4u IPv4 0x1 0t0 TCP *:8080 (LISTEN)\n"
    socks = fleet.parse_socket_table(spark.createDataFrame([("h", lsof)], "host_id string, text string")).cache()
    assert [(r.pid, r.local_port, r.remote_host, r.remote_port, r.state) for r in socks.collect()] == [(20, 5000, "8.8.8.8", 443, "ESTABLISHED"), (20, 8080, None, None, "LISTEN")]
    assert {r.pid: r.chain for r in fleet.ancestry(procs).collect()}[30] == ["/tmp/x --run", "/sbin/init"]
    signed = spark.createDataFrame([("h", "/tmp/x", False)], "host_id string, executable string, signed boolean")
    starts = spark.createDataFrame([("h", "/tmp/x")], "host_id string, path string")
    rows = fleet.endpoint_findings(fleet.annotate_sockets(socks.drop("user", "command"), procs.select("host_id", "pid", "executable"), signed), starts).collect()
    assert {r.severity for r in rows} == {"high", "investigate"}
    assert [r.pid for r in fleet.port_owner(socks, 8080).collect()] == [20]


def test_guard(spark):
    df = spark.range(3).toDF("a")
    assert query.query(df, "SELECT sum(a) AS s FROM data").first().s == 3
    for bad in ("DELETE FROM data", "SELECT 1; SELECT 2", "WITH x AS (SELECT 1) INSERT INTO data SELECT 1", "/* x */ DROP TABLE data"):
        with pytest.raises(ValueError):
            query.query(df, bad)


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source = str(tmp_path / "in")
    events.repartition(3).write.parquet(source)
    live = stream.windowed_counts(stream.read_stream(spark, source, events.schema), late="60 days")
    q = live.writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r.start, r.event_type, r.n)
    assert sorted(map(key, spark.table("w").collect())) == sorted(map(key, stream.windowed_counts(events).collect()))
    named = stream.read_stream(spark, source, events.schema).withColumn("project", F.col("event_type"))
    stream.append_by_project(named, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    stream.append_by_project(named, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()


def test_long_chains_take_few_rounds(spark):
    """A thousand aliases in a row, a cycle, and branches; ancestors a thousand deep."""
    cnames = [("c", f"n{i}", f"n{i - 1}") for i in range(1, 1001)] + [("c", "x", "y"), ("c", "y", "x"), ("c", "y", "n3"), ("c", "self", "self")]
    binds = spark.createDataFrame([("c", "1.1.1.1", "n0"), ("c", "2.2.2.2", "n500"), ("d", "3.3.3.3", "n0")], "capture string, ip string, name string")
    got = {(r.capture, r.ip, r.name) for r in fleet.alias_closure(binds, spark.createDataFrame(cnames, "capture string, owner string, target string")).collect()}
    assert got == {("c", "1.1.1.1", f"n{i}") for i in range(1001)} | {("c", "2.2.2.2", f"n{i}") for i in range(500, 1001)} | {("c", "1.1.1.1", "x"), ("c", "1.1.1.1", "y"), ("d", "3.3.3.3", "n0")}
    procs = [("h", i, i - 1, f"p{i}") for i in range(1, 301)] + [("h", 900, 901, "a"), ("h", 901, 900, "b"), ("h", 950, 900, "c"), ("g", 5, 5, "own")]
    procs = spark.createDataFrame(procs, "host_id string, pid int, ppid int, command string")
    chains = {(r.host_id, r.pid): r.chain for r in fleet.ancestry(procs).collect()}
    assert chains["h", 300] == [f"p{i}" for i in range(299, 0, -1)] and chains["h", 900] == ["b"] and chains["h", 950] == ["a", "b"] and chains["g", 5] == [] == chains["h", 1]
    tree = {r.pid: (r.depth, r.path) for r in fleet.process_tree(procs, 290).collect()}
    assert tree == {i: (i - 290, list(range(290, i + 1))) for i in range(290, 301)}


def test_addresses_of_both_families(spark):
    import ipaddress

    texts = ["1.2.3.4", "255.0.0.255", "::", "::1", "fe80::1%eth0", "2001:db8::8:800:200c:417a", "::ffff:192.0.2.128", "64:ff9b::10.0.0.1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::2::3", "12345::", "1:2:3", "::1.2.3.400", "g::", "", "1.2.3"]
    for r in spark.createDataFrame([(t,) for t in texts], "a string").select("a", S.ip_bits(F.col("a")).alias("b")).collect():
        try:
            ip = ipaddress.ip_address(r.a.split("%")[0])
            assert r.b == f"{int(ip):0{ip.max_prefixlen}b}", r
        except ValueError:
            assert r.b is None, r
    nets = ["10.0.0.0/8", "10.1.0.0/16", "10.1.2.0/24", "0.0.0.0/0", "2001:db8::/32", "2001:db8:1::/48", "::ffff:0:0/96", "fe80::/10", "2001:db8::7/128"]
    ips = ["10.9.9.9", "10.1.9.9", "10.1.2.3", "8.8.8.8", "2001:db8:1::5", "2001:db8:2::5", "2001:db8::7", "::ffff:1.2.3.4", "fe80::1%lo", "3000::", None, "junk"]
    rows = fleet.asn_lookup(spark.createDataFrame([(i,) for i in ips], "ip string"), spark.createDataFrame(list(enumerate(nets)), "asn int, prefix string")).collect()
    assert len(rows) == len(ips)
    for r in rows:
        try:
            ip = ipaddress.ip_address((r.ip or "").split("%")[0])
            held = [n for n in map(ipaddress.ip_network, nets) if n.version == ip.version and ip in n]
            want = max(held, key=lambda n: n.prefixlen) if held else None
        except ValueError:
            want = None
        assert (r.prefix and ipaddress.ip_network(r.prefix)) == want, r
