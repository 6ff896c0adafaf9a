"""Files as DataFrames: delimited, JSON, lines, corpora, HTTP exports, port scans, mail."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import is_json
from ..functions.spans import let

COMMON = {"id", "name", "email", "date", "time", "type", "status", "user", "username", "value", "count", "host", "url", "path", "ip", "port", "city", "country", "address", "phone", "score", "title", "description"}


def sniff(sample: list[str]) -> tuple[str, bool]:
    """Delimiter and whether the first line is a header, from the first lines."""
    rows = [r for r in sample if r.strip()][:12]
    sep = max(",\t;|", key=lambda d: (min((r.count(d) for r in rows), default=0), -",\t;|".index(d)))
    cells = [[c.strip().strip('"') for c in r.split(sep)] for r in rows]
    first = cells[0] if cells else []
    number = lambda c: bool(re.fullmatch(r"[+-]?\d+(?:\.\d+)?", c))
    if not first or any(number(c) for c in first) or len({c.lower() for c in first}) < len(first):
        return sep, False
    typed = any(number(r[i]) for r in cells[1:] for i in range(min(len(r), len(first))))
    known = sum(c.lower() in COMMON for c in first)
    return sep, known >= 2 or (known >= 1 and typed) or typed


def width(sample: list[str], sep: str) -> int:
    """The commonest number of cells in the lines, the larger of equals; 1 if there are none."""
    sizes = [len(row) for row in csv.reader([r for r in sample if r.strip()], delimiter=sep)]
    return max(sizes, key=lambda n: (sizes.count(n), n), default=1)


def load_delimited(spark: SparkSession, path: str, delimiter: str | None = None, has_header: bool | None = None) -> DataFrame:
    """All columns as text; short rows padded, long ones trimmed, both with the line in _corrupt. Without a header there are as many
    columns (_c0, _c1, ...) as the commonest of the first lines has."""
    sample = [r.value for r in spark.read.text(path).limit(12).collect()]
    sep, header = sniff(sample)
    sep, header = delimiter or sep, header if has_header is None else has_header
    names = spark.read.option("sep", sep).option("header", True).csv(path).columns if header else [f"_c{i}" for i in range(width(sample, sep))]
    schema = ", ".join(f"`{c}` string" for c in names) + ", _corrupt string"
    return spark.read.schema(schema).option("sep", sep).option("header", header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").csv(path)


def ragged_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.count("_corrupt").alias("ragged"))


def read_ndjson(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(json): one valid value a line; a trailing comma goes, lines with a bracket alone or nothing are left out."""
    rows = spark.read.text(path).select(F.regexp_replace(F.trim("value"), r",\s*$", "").alias("json")).where("json not in ('', '[', ']')")
    good = is_json(F.col("json"))
    return rows.where(good if not strict else F.coalesce(good, F.lit(False)) | F.assert_true(good, F.lit("a line is no JSON")).isNotNull())


def read_json(spark: SparkSession, path: str, array_path: str = "") -> DataFrame:
    df = spark.read.option("multiLine", True).json(path)
    if not array_path:
        arrays = [f.name for f in df.schema.fields if f.dataType.typeName() == "array"]
        if len(df.columns) > 1 and "_corrupt_record" not in df.columns and not (len(arrays) == 1 and len(df.columns) <= 3):
            return df
        array_path = arrays[0] if arrays else ""
    if not array_path:
        return df
    rows = df.select(F.explode(array_path).alias("value"))
    return rows.select("value.*") if rows.schema["value"].dataType.typeName() == "struct" else rows


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, text); gzip is read as it is."""
    from ..operators.query import lines

    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    return lines(whole, "value", "path")


def classify_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, format, reason) by the first bytes and the shape of the text."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    first, text = F.hex(F.substring("content", 1, 16)), F.substring("content", 1, 4096).cast("string")
    magic = [("A1B2C3D4|D4C3B2A1|A1B23C4D|4D3CB2A1|0A0D0D0A", "pcap"), ("53514C69746520666F726D61742033", "sqlite"), ("72656766", "registry"), ("504B0304", "zip"), ("1F8B", "gzip"), ("54415045", "mssql-backup")]
    kind, why = None, None
    for m, name in magic:
        hit = first.rlike(f"^(?:{m})")
        kind, why = (F.when(hit, name), F.when(hit, "magic")) if kind is None else (kind.when(hit, name), why.when(hit, "magic"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    tests = [(F.locate("00", first) % 2 == 1, "binary"), (text.rlike(r"(?is)^\s*(?:<\?xml[^>]*>\s*)?(?:<!DOCTYPE[^>]*>\s*)?<(?:items|issues)\b"), "http-xml"), (text.rlike(r"(?is)^\s*<!doctype html|^\s*<html"), "html"), (text.rlike(r"^\s*<\?xml"), "xml"), ((F.size(lines) > 1) & F.forall(F.slice(lines, 1, 2), lambda x: x.rlike(r"^\s*\{.*\}\s*,?\s*$")), "ndjson"), (text.rlike(r"^\s*[\[{]"), "json"), ((F.size(lines) > 1) & F.get(lines, F.lit(0)).rlike(r"[,;\t|]") & (F.size(F.split(F.get(lines, F.lit(0)), r"[,;\t|]")) == F.size(F.split(F.get(lines, F.lit(1)), r"[,;\t|]"))), "delimited")]
    for hit, name in tests:
        kind, why = kind.when(hit, name), why.when(hit, "shape")
    return df.select("path", F.col("length").alias("size"), kind.otherwise("text").alias("format"), why.otherwise("none of the others").alias("reason"))


SKIPPED = r"(?:^|/)(?:node_modules|\.git|vendor|dist|build|__pycache__|\.venv|target|site-packages)/"
SOURCES = r"(?i)\.(?:py|js|ts|tsx|jsx|java|kt|go|rs|rb|php|cs|c|h|cpp|swift|scala|sh|ps1|sql|ya?ml|json|toml|ini|cfg|conf|env|properties|xml|config|tf|tfvars|pem|key|txt|md|log|html)$|(?:^|/)(?:\.env[^/]*|Dockerfile|Jenkinsfile|Makefile)$"


def read_corpus(spark: SparkSession, root: str, all_files: bool = False, most: int = 100 << 20) -> DataFrame:
    """(path, size, modified, text) of the source and configuration files under a root."""
    df = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True)
    base = df.select(F.regexp_replace("_metadata.file_path", "^file:/+", "/").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("text"))
    wanted = base.where(~F.col("path").rlike(SKIPPED) & (F.col("size") <= most))
    return wanted.where(~F.contains("text", F.lit("\x00"))) if all_files else wanted.where(F.col("path").rlike(SOURCES))


def project_of(path: Column, root: str) -> Column:
    inside = F.regexp_replace(path, "^" + re.escape(root.rstrip("/")) + "/", "")
    return F.when(inside.contains("/"), F.split_part(inside, F.lit("/"), F.lit(1))).otherwise(F.lit(root.rstrip("/").rsplit("/", 1)[-1]))


def read_http_xml(spark: SparkSession, path: str) -> DataFrame:
    """One row per exported item, request and response decoded."""
    fields = "time url port protocol method path extension status responselength mimetype comment".split()
    body = "struct<_VALUE:string,_base64:boolean>"
    schema = ", ".join(f"{f} string" for f in fields) + f", host struct<_VALUE:string,_ip:string>, request {body}, response {body}"
    df = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
    text = lambda c: F.when(F.col(f"{c}._base64"), F.try_to_binary(f"{c}._VALUE", F.lit("base64")).cast("string")).otherwise(F.col(f"{c}._VALUE"))
    return df.select(*fields, F.col("host._VALUE").alias("host"), F.col("host._ip").alias("host_ip"), text("request").alias("request"), text("response").alias("response"), F.col("_metadata.file_path").alias("file") if "_metadata" in df.columns else F.lit(path).alias("file"))


def split_http(message: Column) -> Column:
    """struct<start, headers, body> of an HTTP message."""
    norm = F.replace(message, F.lit("\r\n"), F.lit("\n"))
    head = F.substring_index(norm, "\n\n", 1)
    return F.struct(F.substring_index(head, "\n", 1).alias("start"), F.regexp_replace(head, r"^[^\n]*\n?", "").alias("headers"), F.when(norm.contains("\n\n"), F.regexp_replace(norm, r"(?s)^.*?\n\n", "")).otherwise("").alias("body"))


def http_header(headers: Column, name: str) -> Column:
    found = F.regexp_extract_all(headers, F.lit(rf"(?im)^{re.escape(name)}\s*:\s*(.*)$"), F.lit(1))
    return F.concat_ws(", ", F.transform(found, lambda x: F.trim(x)))


def read_http_json(spark: SparkSession, path: str, wrappers: tuple[str, ...] = ("proxyHistory", "siteMap", "auditItems", "issues", "items", "history")) -> DataFrame:
    """Items of every wrapper key, labelled by it."""
    df = spark.read.option("multiLine", True).json(path)
    out = None
    for name in df.columns:
        if name.lower() in {w.lower() for w in wrappers}:
            part = df.select(F.lit(name).alias("source"), F.explode(name).alias("i")).select("source", "i.*")
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return df if out is None else out


def read_portscan_xml(spark: SparkSession, path: str) -> DataFrame:
    """(address, hostname, protocol, port, state, service)."""
    schema = "address array<struct<_addr:string,_addrtype:string>>, hostnames struct<hostname:array<struct<_name:string>>>, ports struct<port:array<struct<_protocol:string,_portid:int,state:struct<_state:string>,service:struct<_name:string>>>>"
    df = spark.read.format("xml").option("rowTag", "host").schema(schema).load(path)
    return df.select(F.col("address")[0]["_addr"].alias("address"), F.get("hostnames.hostname", F.lit(0))["_name"].alias("hostname"), F.explode_outer("ports.port").alias("p")).select("address", "hostname", F.col("p._protocol").alias("protocol"), F.col("p._portid").alias("port"), F.col("p.state._state").alias("state"), F.col("p.service._name").alias("service"))


MAIL = "msg_sha256 string, headers array<struct<name:string,value:string>>, plain string, html string, anchors array<struct<href:string,text:string>>, attachments array<struct<name:string,type:string,size:long,sha256:string,head:binary>>, parts array<string>"


def parse_mail(files: DataFrame) -> DataFrame:
    """Messages (column content: binary) parsed in Arrow batches; one message a row."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import email
        import hashlib
        from email import policy

        for b in batches:
            rows = []
            for raw in b.content:
                raw = bytes(raw)
                m = email.message_from_bytes(raw, policy=policy.compat32.clone(raise_on_defect=False))
                text = {"text/plain": [], "text/html": []}
                files, parts = [], []
                for p in m.walk():
                    parts.append(p.get_content_type())
                    if p.is_multipart():
                        continue
                    data = p.get_payload(decode=True) or b""
                    if p.get_filename():
                        files.append({"name": p.get_filename(), "type": p.get_content_type(), "size": len(data), "sha256": hashlib.sha256(data).hexdigest(), "head": data[:64]})
                    elif p.get_content_type() in text:
                        text[p.get_content_type()].append(data.decode(p.get_content_charset() or "utf-8", "replace"))
                html = "\n".join(text["text/html"])
                anchors = [{"href": a, "text": re.sub(r"<[^>]+>", "", t).strip()} for a, t in re.findall(r"""(?is)<a\b[^>]*href=["']?([^"'\s>]+)[^>]*>(.*?)</a>""", html)]
                rows.append((hashlib.sha256(raw).hexdigest(), [{"name": k, "value": str(v)} for k, v in m.items()], "\n".join(text["text/plain"]), html, anchors, files, parts))
            yield pd.DataFrame(rows, columns=["msg_sha256", "headers", "plain", "html", "anchors", "attachments", "parts"], dtype=object)

    return files.select("content").mapInPandas(each, MAIL)


def read_mail(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Messages of all sizes, or of at most `most` bytes."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return parse_mail(found if most is None else found.where(F.col("length") <= most))


#: Elements whose content is no visible text; each with a pattern of its own, as a back-reference would search to the end of the
#: page from every opening tag.
_FURNITURE = "script style nav header footer aside form noscript svg".split()


def html_to_text(html: Column) -> Column:
    """Visible text: scripts, styles and page furniture dropped, blocks on lines of their own, list items marked."""
    t = html
    for name in _FURNITURE:
        t = F.regexp_replace(t, rf"(?i)<{name}\b(?:[^<]|<(?!/{name}\b))*+</{name}\s*>", " ")

    def visible(t: Column) -> Column:
        inner = F.coalesce(*[F.nullif(F.regexp_extract(t, rf"(?i)<{name}\b[^>]*>((?:[^<]|<(?!/{name}>))*+)</{name}>", 1), F.lit("")) for name in ("main", "article")], F.lit(""))
        return let(inner, lambda main: F.when(F.length(main) >= 200, main).otherwise(t))

    t = let(t, visible)
    t = F.regexp_replace(F.regexp_replace(t, r"(?is)<!--.*?-->|<head\b.*?</head>", " "), r"(?i)<li\b[^>]*>", "\n- ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)<(?:br|/?(?:p|div|h[1-6]|ul|ol|tr|table|section|main|article|blockquote|pre))\b[^>]*>", "\n"), r"<[^>]+>", "")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    rows = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    return let(rows, lambda r: F.array_join(F.filter(r, lambda x, i: (i == 0) | (F.get(r, i - 1) != x)), "\n"))


def html_title(html: Column) -> Column:
    return F.left(F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " ")), F.lit(500))


def html_inputs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"""(?i)<input\b[^>]*\bname=["']?([^"'\s>]+)"""), F.lit(1))


def write_findings(df: DataFrame, path: str, fmt: str = "json") -> None:
    """fmt text: the columns of a row with tabs between them."""
    if fmt == "text":
        df = df.select(F.concat_ws("\t", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]).alias("value"))
    writer = df.write.mode("errorifexists")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def run_stamp(now: Column) -> Column:
    """The stamp of a run, in Indian time."""
    return F.concat(F.date_format(F.from_utc_timestamp(now, "Asia/Kolkata"), "dd_MMM_yyyy_HHmm"), F.lit("_IST"))


def write_report_pack(records: DataFrame, findings: DataFrame, path: str) -> str:
    """Of one run, under path/stamp: the records of each project as JSON lines and CSV, a summary of the projects, and the
    rotation report. Records as report_records() gives them. Returns where it is."""
    from ..operators import detect

    stamp = records.sparkSession.range(1).select(run_stamp(F.current_timestamp())).first()[0]
    at = f"{path}/{stamp}"
    records.write.mode("errorifexists").partitionBy("project").json(f"{at}/json")
    records.write.mode("errorifexists").partitionBy("project").option("header", True).csv(f"{at}/csv")
    detect.project_summary(records).write.mode("errorifexists").json(f"{at}/summary")
    detect.rotation(findings).orderBy("rank", F.desc("files")).write.mode("errorifexists").json(f"{at}/rotation")
    return at


def maybe_base64(text: Column) -> Column:
    """The decoded text where it decodes to an HTTP message, else the text."""
    compact = F.regexp_replace(text, r"\s+", "")
    padded = F.concat(compact, F.repeat(F.lit("="), (F.lit(4) - F.length(compact) % 4) % 4))
    decoded = F.try_to_binary(padded, F.lit("base64")).cast("string")
    fits = (F.length(compact) >= 16) & compact.rlike(r"^[A-Za-z0-9+/]+=*$") & (F.contains(F.left(decoded, F.lit(80)), F.lit("HTTP/")) | F.contains(F.left(decoded, F.lit(200)), F.lit("\r\n")))
    return F.when(fits, decoded).otherwise(text)


def http_extras(items: DataFrame, request: str = "request", response: str = "response") -> DataFrame:
    """items with method, status, query, cookie names, set_cookie, authorization scheme, location and form fields."""
    from ..functions.scalars import form_fields

    a, b = split_http(maybe_base64(F.col(request))), split_http(maybe_base64(F.col(response)))
    out = items.withColumn("_a", a).withColumn("_b", b)
    names = F.transform(F.filter(F.split(http_header(F.col("_a.headers"), "Cookie"), r";\s*"), lambda c: c != ""), lambda c: F.split_part(c, F.lit("="), F.lit(1)))
    target = F.split_part(F.col("_a.start"), F.lit(" "), F.lit(2))
    return out.withColumns({
        "method": F.split_part("_a.start", F.lit(" "), F.lit(1)), "status": F.regexp_extract("_b.start", r"^HTTP/\S+\s+(\d{3})", 1), "query": F.when(F.contains(target, F.lit("?")), F.substring_index(target, "?", -1)).otherwise(""), "cookies": names,
        "set_cookie": http_header(F.col("_b.headers"), "Set-Cookie"), "authorization": F.split_part(http_header(F.col("_a.headers"), "Authorization"), F.lit(" "), F.lit(1)), "location": http_header(F.col("_b.headers"), "Location"),
        "form": F.when(F.contains(F.lower(http_header(F.col("_a.headers"), "Content-Type")), F.lit("urlencoded")), form_fields(F.col("_a.body"))),
    }).drop("_a", "_b")
