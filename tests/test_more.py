from pyspark.sql import functions as F

from gleanery.operators import detect, extend, fleet, query, tables
from gleanery.sources import files


def test_describe(spark):
    rows = ["/usr/bin/python3 -m http.server 80", "node /srv/app/server.js --x", "bash -c /opt/run.sh", "npm run dev", "/opt/tool"]
    got = fleet.describe_process(spark.createDataFrame([(c,) for c in rows], "command string")).collect()
    assert [r.label for r in got] == ["python3 http.server", "node server.js", "bash run.sh", "npm run", "tool"]
    held = spark.createDataFrame([("bash", [1], 0, 0), ("bash", [], 0, 0), ("x", [], 2, 0), ("x", [], 0, 1), ("x", [], 0, 0)], "runtime string, listening array<int>, established int, children int")
    assert [r.role for r in fleet.describe_role(held).collect()] == ["server", "shell", "client", "supervisor", "process"]


def test_http_extras(spark):
    req = "POST /a?q=1 HTTP/1.1\r\nCookie: s=1; t=2\r\nAuthorization: Bearer abc\r\nContent-Type: application/x-www-form-urlencoded\r\n\r\nu=jo&p=a%20b"
    row = files.http_extras(spark.createDataFrame([(req, "HTTP/1.1 302 Found\r\nLocation: /b\r\n\r\n")], "request string, response string")).first()
    assert (row.method, row.status, row.query, row.cookies, row.authorization, row.location) == ("POST", "302", "q=1", ["s", "t"], "Bearer", "/b")
    assert [tuple(f) for f in row.form] == [("u", "jo"), ("p", "a b")]


def test_bounded_json(spark):
    row = spark.createDataFrame([('{"a": [1, 2, 3], "b": {"c": {"d": 1}}}',), ("no",), (None,)], "j string").select(query.bounded_json(F.col("j"), depth=2, items=2).alias("j")).collect()
    assert "1 items left out" in row[0].j and "keys left out" in row[0].j and row[1].j == "no" and row[2].j is None


def test_ids_and_extensions(spark):
    lines = spark.createDataFrame([("f", 1, "<item>"), ("f", 2, "x"), ("f", 3, "<item><item>")], "file string, line long, text string")
    assert [r.item for r in detect.item_numbers(lines, "file").orderBy("line").collect()] == [1, 1, 3]

    @extend.enricher("up")
    def up(df):
        return df.withColumn("text", F.upper("text"))

    assert [r.text for r in extend.enrich(lines, "up").orderBy("line").collect()][1] == "X"
    found = spark.createDataFrame([("1", "email", 9), ("2", "domain", 9)], "unit_id string, kind string, item long")
    assert detect.analyst_kinds(found).count() == 1
    ids = detect.with_native_ids(found, spark.createDataFrame([("1", 7)], "unit_id string, item long"), "item").collect()
    assert {r.unit_id: r.item for r in ids} == {"1": 7, "2": None}


def test_answering_processes(spark):
    rows = [("h", 1, "python3 app.py", "server", "/usr/bin/python3 app.py", "root", [80]), ("h", 2, "python3 job.py", None, "python3 job.py", "bob", None), ("h", 3, None, None, "sh -c python3 server", "bob", []), (None, 4, None, None, None, None, [1])]
    procs = spark.createDataFrame(rows, "host_id string, pid long, label string, role string, command string, user string, listening array<int>")

    def ask(question):
        return {r.pid: (r.score, r.tier, r.answered, r.missing) for r in fleet.answering_processes(procs, question).collect()}

    # nobody on the second host is named so, so what listens there is told
    none = (0, "listening", [], ["python3", "servers"])
    assert ask("Python3 servers") == {1: (85, "all", ["python3", "servers"], []), 4: none}
    assert ask("python3") == {1: (125, "all", ["python3"], []), 2: (100, "all", ["python3"], []), 4: (0, "listening", [], ["python3"])}
    assert ask("bob's jobs") == {2: (20, "part", ["jobs"], ["bob"]), 4: (0, "listening", [], ["bob", "jobs"])}
    assert ask("bob") == {1: (0, "listening", [], ["bob"]), 4: (0, "listening", [], ["bob"])}
    assert set(ask(" ")) == set(ask(None)) == {1, 4} and ask("sh")[1][1] == "listening"
    assert fleet.answering_processes(procs.where("false"), "a b").count() == 0
    assert fleet.answering_processes(procs.where("pid = 3"), "bob").first().tier == "any"


def test_host_extras(spark):
    text = '"Image Name","PID","Session Name","Session#","Mem Usage"\n"a.exe","42","Console","1","1,024 K"\n'
    row = fleet.parse_tasklist(spark.createDataFrame([("h", text)], "host_id string, text string")).first()
    assert (row.pid, row.executable, row.rss_bytes) == (42, "a.exe", 1048576)
    ips = '[{"ifname":"lo","operstate":"UNKNOWN","address":"0","addr_info":[{"family":"inet","local":"127.0.0.1","prefixlen":8}]},{"ifname":"eth0","operstate":"UP","address":"1","addr_info":[{"family":"inet","local":"10.0.0.2","prefixlen":24}]}]'
    nets = fleet.interfaces_from_json(spark.createDataFrame([("h", ips)], "host_id string, text string"))
    assert nets.count() == 2 and fleet.primary_interface(nets).first().interface == "eth0"
    procs = spark.createDataFrame([("h", "nginx", "nginx -g", [("a", "all")], 1), ("h", "python3 app.py", "python3 app.py", [], 0)], "host_id string, label string, command string, listening array<struct<local_host:string,scope:string>>, established int")
    assert tuple(fleet.exposure_counts(procs).first())[1:] == (1, 1, 1)
    assert [r.score for r in fleet.match_processes(procs, ["nginx"]).collect()] == [125]
    two = spark.createDataFrame([("h", "cron", "a", "/x"), ("h", "cron", "a", "/y")], "host_id string, kind string, name string, path string")
    assert fleet.distinct_persistence(two).count() == 1
    assert {r.language: r.files for r in query.languages(spark.createDataFrame([("a/main.py",), ("b.py",), ("c.go",), ("d",)], "path string")).collect()} == {"Python": 2, "Go": 1}


def test_registry_and_report_pack(spark, tmp_path):
    now = F.lit("2024-01-01 10:00:00").cast("timestamp")
    none = spark.createDataFrame([], "id string, name string, source string, created_at timestamp, expires_at timestamp")
    two = tables.register(tables.register(none, None, "a.csv", now), None, "b.csv", now + F.expr("interval 1 hour"))
    assert [r.name for r in tables.list_datasets(two, now).collect()] == ["dt2", "dt1"]
    assert [r.name for r in tables.list_datasets(two, now + F.expr("interval 270 minutes")).collect()] == ["dt2"]
    docs = spark.createDataFrame([(i, f"k AKIA{i:016d} x", f"p{i % 2}") for i in range(4)], "doc_id long, text string, source string")
    found = detect.detect(docs, kinds=["aws-access-key"])
    at = files.write_report_pack(detect.report_records(found), found, str(tmp_path / "pack"))
    assert at.endswith("_IST") and {r.project: (r.files, r.critical) for r in spark.read.json(f"{at}/summary").collect()} == {"p0": (2, 2), "p1": (2, 2)}
    assert spark.read.json(f"{at}/rotation").count() == 4 and spark.read.option("header", True).csv(f"{at}/csv").count() == 4
    files.write_findings(found.select("kind", "value"), str(tmp_path / "text"), "text")
    assert all(r.value.startswith("aws-access-key\tAKIA") for r in spark.read.text(str(tmp_path / "text")).collect())
    assert detect.kinds_in_question(["a", "b"], ["b"]) == ["b"] and detect.kinds_in_question([], ["c"]) == ["c"]
    assert [r.exposure[:4] for r in detect.analyst_report(found).collect()] == ["Acts"]


def test_targets_and_places(spark):
    from gleanery.functions import scalars as S

    given = ["https://u:p@A.example.com:8080/x", "8.8.8.8:53", "[2001:db8::1]:443", "2001:db8::1", "b.example.", "no", ""]
    got = [r[0] and tuple(r[0]) for r in spark.createDataFrame([(g,) for g in given], "v string").select(S.normalise_target(F.col("v"))).collect()]
    assert got == [("domain", "a.example.com"), ("ip", "8.8.8.8"), ("ip", "2001:db8::1"), ("ip", "2001:db8::1"), ("domain", "b.example"), None, None]
    rows = spark.createDataFrame([("a", 3, "u"), ("b", 0, None)], "name string, packet int, url string")
    assert [r[0] for r in rows.select(tables.row_where(rows)).collect()] == ["packet 3 · u", "b"]


def test_symbols_carry_what_they_are_nested_in(spark):
    import ast

    code = "import os\n\n\nclass A:\n    x = 1\n\n    def go(self):\n        def inner():\n            pass\n        return inner\n    # note\n    async def go2(self):\n        pass\n\n\ndef go():\n    class B:\n        def go(self): ...\n    return B\nif os:\n    def late(): ...\n"
    want = set()

    def walk(node, names):
        for n in ast.iter_child_nodes(node):
            own = isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))
            if own:
                want.add((n.lineno, n.name, ".".join([*names, n.name])))
            walk(n, [*names, n.name] if own else names)

    walk(ast.parse(code), [])
    df = spark.createDataFrame([("a.py", code), ("b.py", ""), ("c.py", None)], "path string, text string")
    assert {(r.line, r.name, r.symbol) for r in query.symbols(df, "path").collect()} == want
    got = {(r.line, r.role, r.symbol) for r in query.find_symbol(df, "go", "path").collect()}
    assert got == {(7, "definition", "A.go"), (16, "definition", "go"), (18, "definition", "go.B.go")}

