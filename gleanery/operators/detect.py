"""Detection of sensitive values as canonical findings, with built-in functions only.

A text is cut into blocks that end with lines. In a block, a pattern runs only where the literals are that it needs; its
positions come from setting each match between marks and splitting there. Values of unbounded length are looked for in whole
lines where a line is longer than a block. Validators are Columns over the value and 96
characters of context on either side. Overlaps are resolved among candidates that touch, so work grows with the text.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import scalars as S
from ..functions.spans import BLOCK, MARK, blocks, let, long_lines, matches, unmarked
from .scans import running_sum, with_neighbours

_CANDIDATE = "array<struct<part:string,at:int,spec:int,before:string,lines:int,head:string>>"
#: Kinds that are judged by the line they stand in.
FIELDS = ("password", "username", "secret")
NEAR = 96
#: Whole PEM blocks, from the first line to the last.
PEM = {
    "private-key": r"(?s)-----BEGIN (?:[A-Z0-9 ]+ )?PRIVATE KEY-----.*?-----END (?:[A-Z0-9 ]+ )?PRIVATE KEY-----",
    "pem-certificate": r"(?s)-----BEGIN CERTIFICATE-----.*?-----END CERTIFICATE-----",
}
#: Kinds whose values may be of any length; a value of another kind is shorter than what a block sees after its end.
LONG = {
    "bearer", "basic-auth", "jwt", "github-token", "gitlab-token", "slack-token", "stripe-key", "azure-key", "sendgrid-key", "npm-token", "pypi-token", "db-uri", "ssh-key", "email", "url",
    "secret-in-url", "session-cookie", "insecure-cookie", "sql-error", "stack-trace", "xxe", "java-serialized", "shell-metachar",
}
#: What tells units apart: their names, and their texts where names are repeated. Positions in a block of a unit's candidates.
UNIT = ["source", "unit_id", "_row"]
SPAN = 1 << 16
#: Literals (lower case) without which a pattern cannot match: one of each group must be there. "0" stands for any digit.
NEEDS: dict[str, tuple[tuple[str, ...], ...]] = {
    "private-key": (("-----begin",),), "pem-certificate": (("-----begin",),), "bearer": (("bearer",),), "basic-auth": (("basic",),), "jwt": (("eyj",),),
    "aws-access-key": (("akia", "asia"),), "github-token": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"),), "gitlab-token": (("glpat-", "glptt-", "gldt-", "glrt-", "glsoat-"),),
    "slack-token": (("xox", "hooks.slack"),), "stripe-key": (("_live_", "_test_", "whsec_"),), "azure-key": (("accountkey", "sharedaccess"),), "sendgrid-key": (("sg.",),), "twilio-sid": (("sk", "ac"), ("0",)),
    "npm-token": (("npm_",),), "pypi-token": (("pypi-",),), "google-api-key": (("aiza",),), "db-uri": (("://",), ("postgres", "mysql", "mongodb", "redis", "amqp", "mssql")), "ssh-key": (("ssh-",),), "email": (("@",),), "upi": (("@upi", "@ok", "@ybl", "@paytm", "@ibl", "@axl", "@apl", "@waaxis"),), "url": (("://",),),
    "secret-in-url": (("?", "&"), ("=",)), "iban": (("0",),), "pan": (("0",),), "aadhaar": (("0",),), "credit-card": (("0",),), "indian-phone": (("0",),), "intl-phone": (("+",), ("0",)), "passport": (("0",),),
    "uuid": (("-",), ("0",)), "bank-account": (("acc",), ("0",)), "ipv4": (("0",), (".",)), "ipv6": (("::", ":"),), "internal-host": ((".internal", ".corp", ".lan", ".local", ".intranet"),), "domain": ((".",),),
    "password": (("pass", "pw"), ("=", ":", "<")), "username": (("user", "uname", "usr", "login", "account"), ("=", ":", "<")), "secret": (("key", "secret", "cred", "token", "jwt", "pat"), ("=", ":", "<")),
    "session-cookie": (("sess", "sid"), ("=",)), "insecure-cookie": (("set-cookie",),), "cors-wildcard": (("access-control",),), "debug-enabled": (("debug", "development"),), "tls-verify-disabled": (("verify", "node_tls"),),
    "unrestricted-bind": (("0.0.0.0",),), "guessable-id": (("?", "&"), ("=",)), "sql-error": (("sql", "ora-", "unclosed"),), "sql-fragment": (("'", "union", "drop"),), "stack-trace": (("traceback", "exception", ".java"),),
    "xxe": (("<!doctype",),), "ldap-filter": (("(",), ("=",)), "xpath-fragment": (("//",), ("[",)), "java-serialized": (("ro0ab",),), "directory-listing": (("index of",),), "shell-metachar": (("?", "&"), ("=",)),
}


def _may_match(kind: str, lowered: Column, digits: Column) -> Column:
    out = F.lit(True)
    for group in NEEDS.get(kind, ()):
        some = F.lit(False)
        for x in group:
            some = some | (digits if x == "0" else F.contains(lowered, F.lit(x)))
        out = out & some
    return out


def _spans(text: Column, spec: P.Spec, number: int, may: Column) -> Column:
    """Candidates of one pattern in a block: the value's place, not that of what stands before it, the NEAR characters before it, the
    line ends before it, and for a field what stands before it in its line. A block is short, so one fold over its parts is cheap."""
    marked = F.regexp_replace(text, F.lit(f"({spec.before})({spec.value})"), F.lit(f"$1{MARK}$2{MARK}"))
    field = spec.kind in FIELDS
    first = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), F.lit("").alias("before"), F.lit(0).alias("lines"), F.lit("").alias("head"), F.array().cast(_CANDIDATE).alias("found"))

    def step(a: Column, part: Column) -> Column:
        span = F.struct(part.alias("part"), a["at"].alias("at"), F.lit(number).alias("spec"), a["before"].alias("before"), a["lines"].alias("lines"), a["head"].alias("head"))
        lines = F.length(part) - F.length(F.replace(part, F.lit("\n"), F.lit("")))
        return F.struct(
            (a["at"] + F.length(part)).cast("int").alias("at"), (~a["inside"]).alias("inside"), F.right(F.concat(a["before"], F.right(part, F.lit(NEAR))), F.lit(NEAR)).alias("before"), (a["lines"] + lines).cast("int").alias("lines"),
            (F.substring_index(F.concat(a["head"], part), "\n", -1) if field else F.lit("")).alias("head"), F.when(a["inside"], F.concat(a["found"], F.array(span))).otherwise(a["found"]).alias("found"),
        )

    none = F.array().cast(_CANDIDATE)
    # most patterns that may match do not, and their text is not split
    folded = let(marked, lambda m: F.when(F.contains(m, F.lit(MARK)), F.aggregate(F.split(m, MARK, -1), first, step, lambda a: a["found"])).otherwise(none))
    return F.when(may, folded).otherwise(none)


def unquoted(value: Column) -> Column:
    v = F.regexp_replace(F.regexp_replace(F.trim(value), r"[;,]+$", ""), r"""^(?:[fFrRbBuU]{1,2}|\$|@)(?=["'`])""", "")
    return F.regexp_replace(v, r"""^(["'`])(.*)\1$""", "$2")


def origin(value: Column) -> Column:
    """Where a field's value comes from: literal, environment, reference, call, placeholder or empty."""
    v = F.regexp_replace(F.regexp_replace(F.trim(value), r"[;,]+$", ""), r"""^(?:[fFrRbBuU]{1,2}|\$|@)(?=["'`])""", "")
    whole = let(v, lambda v: v.rlike(r"""(?s)^(["'`]).*\1$""") & (F.length(v) >= 2))
    return let(whole, lambda quoted: let(unquoted(value), lambda inner: _origin(quoted, inner)))


def _origin(quoted: Column, inner: Column) -> Column:
    return (
        F.when(quoted & inner.rlike(r"\{[^}]*\}|\$\{|%\("), "environment").when(inner == "", "empty").when(inner.rlike(P.INTERPOLATION), "environment")
        .when(inner.rlike(r"^(?:<[^>]*>|\[[^\]]*\]|\{[^}]*\})$") | inner.rlike(r"(?i)^[x*.#\-_\s]{3,}$") | F.lower(inner).isin(P.PLACEHOLDERS), "placeholder")
        .when(quoted, "literal").when(inner.rlike(P.ENV_READ), "environment").when(inner.rlike(r"^[A-Za-z_][\w.$]*\s*\("), "call")
        .when(inner.rlike(r"""^[A-Za-z_$][\w.$\[\]'"-]*$""") & inner.rlike(r"[.\[]"), "reference").otherwise("literal")
    )


def field_score(kind: str, value: Column, context: Column, line: Column) -> Column:
    """Points for a named field holding a credential; see level()."""
    return let(origin(value), lambda o: let(unquoted(value), lambda v: _points(kind, o, v, context, line)))


def _points(kind: str, o: Column, v: Column, context: Column, line: Column) -> Column:
    literal = o == "literal"
    points = F.lit(20) + F.when(literal, 25).when(o == "placeholder", -80).when(o == "environment", -50).when(o.isin("reference", "call"), -45).otherwise(0)
    weak = F.lower(v).isin(P.WEAK) if kind != "username" else F.lit(False)
    points = points + F.when(weak, 15).when(S.looks_random(v), 10).otherwise(0)
    if kind == "password":
        points = points + F.when(literal & (F.length(v) >= 8), 10).otherwise(0)
    elif kind == "secret":
        points = points + F.when(literal & (F.length(v) < 8), -40).when(literal & (F.length(v) >= 16) & (S.entropy(v) >= 3.5), 15).otherwise(0)
    else:
        points = points - 10
    points = points + F.when(line.rlike(P.NEGATIVE), -40).otherwise(0) + F.when(context.rlike(P.ILLUSTRATION), -25).otherwise(0) + F.when(line.rlike(P.COMMENT), -10).otherwise(20)
    return F.when(o == "empty", 0).otherwise(points)


def level(points: Column) -> Column:
    return F.when(points >= 90, "critical").when(points >= 75, "high").when(points >= 55, "medium")


def _confidence(kind: str, v: Column, near: Column, line: Column) -> Column:
    """What a candidate's value and context say; null rejects it."""
    d = S.digits(v)
    if kind in FIELDS:
        return let(field_score(kind, v, near, line), level)
    if kind == "jwt":
        head = F.split_part(v, F.lit("."), F.lit(1))
        padded = F.concat(F.translate(head, "-_", "+/"), F.repeat(F.lit("="), (F.lit(4) - F.length(head) % 4) % 4))
        text = F.try_to_binary(padded, F.lit("base64")).cast("string")
        alg = F.get_json_object(text, "$.alg")
        return F.when(F.get_json_object(text, "$").startswith("{"), F.when(F.lower(alg) == "none", "critical").when(F.length(alg) > 0, "high").otherwise("medium"))
    if kind == "stripe-key":
        return F.when(v.startswith("pk_"), "medium").when(v.contains("_test_"), "high").otherwise("critical")
    if kind == "db-uri":
        return F.when(F.substring_index(v, "://", -1).contains("@"), "critical").otherwise("medium")
    if kind == "upi":
        return F.when(F.length(F.split_part(v, F.lit("@"), F.lit(1))) >= 2, "high")
    if kind == "url":
        host = S.url_host(v)
        return F.when(F.length(host) > 0, F.when(F.try_parse_url(v, F.lit("USERINFO")).isNotNull(), "critical").when(host.isin("localhost", "127.0.0.1", "[::1]") | host.endswith(".localhost"), "low").otherwise("medium"))
    if kind == "iban":
        return F.when(S.mod97(v), "high")
    if kind == "swift":
        hinted, long = near.rlike(P.BANK_WORDS), F.length(v) == 11
        known = F.substring(v, 5, 2).isin(P.COUNTRIES) & v.rlike(r"\d")
        return F.when(hinted, "high").when(known & long, "medium")
    if kind == "pan":
        return F.when(F.substring(v, 4, 1).isin(list("PCHABGJLFT")), "high").otherwise("medium")
    if kind == "aadhaar":
        return F.when(S.verhoeff(v), "high")
    if kind == "credit-card":
        return F.when(F.length(d).between(13, 19) & S.luhn(v), F.when(d.rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5)|35|3[068]|60|65|81|82|508)"), "high").otherwise("medium"))
    if kind == "indian-phone":
        return F.when(F.regexp_replace(d, "^91(?=.{10}$)", "").rlike(r"^[6-9]\d{9}$"), "medium")
    if kind == "intl-phone":
        return F.when(F.length(d).between(8, 15), F.when(near.rlike(P.PHONE_WORDS), "medium").otherwise("low"))
    if kind == "passport":
        return F.when(near.rlike(P.PASSPORT_WORDS), "medium")
    if kind == "uuid":
        return F.when(near.rlike(P.ID_WORDS), "medium").otherwise("low")
    if kind == "bank-account":
        return F.when(F.length(d).between(8, 18) & near.rlike(P.BANK_WORDS), "medium")
    if kind == "ipv4":
        return let(S.ipv4_number(v), lambda n: F.when(n.isNotNull(), F.when(S.in_net(n, "loopback") | S.in_net(n, "unspecified") | S.in_net(n, "multicast") | S.in_net(n, "shared"), "low").otherwise("medium")))
    if kind == "ipv6":
        return let(S.ipv6_hex(v), lambda h: F.when(h.isNotNull(), F.when(h.isin("0" * 31 + "1", "0" * 32) | h.startswith("ff"), "low").otherwise("medium")))
    if kind == "domain":
        last, rest = F.element_at(F.split(v, r"\."), -1), F.regexp_replace(v, r"\.[^.]*$", "")
        host = (F.lower(last).isin(P.SUFFIXES) | (F.length(last) == 2)) & last.rlike("^(?:[a-z]+|[A-Z]+)$") & ~F.exists(F.split(rest, r"\."), lambda p: p.rlike("^[A-Z]") & (p != F.upper(p)))
        return F.when(host & ~near.contains(F.concat(v, F.lit("("))), "low")
    if kind == "session-cookie":
        n = F.length(F.regexp_replace(v, "^[^=]*=", ""))
        return F.when(n >= 16, "high").when(n >= 8, "medium")
    if kind == "insecure-cookie":
        return F.when(~(F.lower(v).contains("secure") & F.lower(v).contains("httponly")), "medium")
    raise KeyError(kind)


def _rows(units: DataFrame, source: str, unit: str, text: str) -> DataFrame:
    """(source, unit_id, _row, text): _row tells rows of one name apart by what they hold."""
    return units.select(F.col(source).cast("string").alias("source"), F.col(unit).cast("string").alias("unit_id"), F.unhex(F.md5(F.col(text))).alias("_row"), unmarked(F.col(text)).alias("text")).where("text is not null")


def candidates(units: DataFrame, source: str, unit: str, text: str, kinds: Iterable[str] | None = None) -> DataFrame:
    """(source, unit_id, _row, spec, start, end, value, context, line_text, line): every match of the asked kinds before
    validation. Only a value that goes on over line ends for more than spans.AFTER characters is seen in part."""
    wanted = set(kinds or P.KINDS)
    rows = _rows(units, source, unit, text)
    each = rows.select(*UNIT, F.explode(blocks(F.col("text"))).alias("b")).select(*UNIT, "b.*")
    each = each.withColumn("lowered", F.lower("text")).withColumn("digits", F.col("text").rlike("[0-9]"))
    ahead = F.left("text", F.col("low"))
    each = each.withColumn("lead", F.length(ahead) - F.length(F.replace(ahead, F.lit("\n"), F.lit(""))))
    may = {k: _may_match(k, F.col("lowered"), F.col("digits")) for k in P.KINDS if k in wanted}
    found = F.concat(*[_spans(F.col("text"), s, i, may[s.kind]) for i, s in enumerate(P.SPECS) if s.kind in wanted])
    long = [i for i, s in enumerate(P.SPECS) if s.kind in wanted & LONG]
    text, low, high = F.col("text"), F.col("low"), F.col("high")

    def owned(c: Column) -> Column:
        here = (F.length(c["part"]) > 0) & (c["at"] >= low) & (c["at"] < high)
        return here & (~c["spec"].isin(long) | (c["at"] - low >= F.col("cut"))) if long else here

    fields = [i for i, s in enumerate(P.SPECS) if s.kind in FIELDS]

    def detailed(c: Column) -> Column:
        to = c["at"] + F.length(c["part"])
        line = F.when(c["spec"].isin(fields), F.concat(c["head"], F.substring_index(F.substring(text, c["at"] + 1, F.length(text)), "\n", 1)))
        return F.struct(
            c["spec"].alias("spec"), (F.col("at") + c["at"]).cast("int").alias("start"), (F.col("at") + to).cast("int").alias("end"), c["part"].alias("value"), F.concat(c["before"], c["part"], F.substring(text, to + 1, F.lit(NEAR))).alias("context"),
            line.alias("line_text"), (F.col("line") + c["lines"] - F.col("lead") + 1).cast("long").alias("line"),
        )

    # context and line are cut out before the candidates become rows, so no row carries its block
    out = each.select(*UNIT, F.explode(F.transform(F.filter(found, owned), detailed)).alias("c")).select(*UNIT, "c.*")
    if not long:
        return out
    # lines over several blocks, whole
    whole = rows.where(F.length("text") > BLOCK).select(*UNIT, F.explode(long_lines(F.col("text"))).alias("b")).select(*UNIT, "b.*")
    whole = whole.withColumn("lowered", F.lower("text")).withColumn("digits", F.col("text").rlike("[0-9]"))

    specs = F.array(*[F.struct(F.lit(i).alias("spec"), F.lit(P.SPECS[i].before).alias("before"), F.lit(P.SPECS[i].value).alias("value"), may[P.SPECS[i].kind].alias("may")) for i in long])
    place = lambda m, x: F.struct(m["part"].alias("part"), m["at"].cast("int").alias("at"), x["spec"].alias("spec"))
    spans = F.flatten(F.transform(F.filter(specs, lambda x: x["may"]), lambda x: F.transform(matches(text, x["value"], x["before"]), lambda m: place(m, x))))
    inside = F.filter(spans, lambda c: (F.length(c["part"]) > 0) & (c["at"] >= low) & (c["at"] < high))

    def told(c: Column) -> Column:
        start, to = c["at"], c["at"] + F.length(c["part"])
        near = F.substring(text, F.greatest(F.lit(1), start + 1 - NEAR), to - F.greatest(F.lit(0), start - NEAR) + NEAR)
        return F.struct(
            c["spec"].alias("spec"), (F.col("at") + start).cast("int").alias("start"), (F.col("at") + to).cast("int").alias("end"), c["part"].alias("value"), near.cast("string").alias("context"),
            F.lit(None).cast("string").alias("line_text"), (F.col("line") + 1).cast("long").alias("line"),
        )

    return out.unionByName(whole.select(*UNIT, F.explode(F.transform(inside, told)).alias("c")).select(*UNIT, "c.*"))


def validated(found: DataFrame, kinds: Iterable[str] | None = None) -> DataFrame:
    wanted = set(kinds or P.KINDS)
    v = F.col("value")
    cases = None
    kind_of = F.get(F.lit([s.kind for s in P.SPECS]), F.col("spec"))
    for kind in (k for k in P.KINDS if k in wanted):
        fixed = next(s.confidence for s in P.SPECS if s.kind == kind)
        says = F.lit(fixed) if fixed else _confidence(kind, v, F.col("context"), F.col("line_text"))
        cases = F.when(F.col("kind") == kind, says) if cases is None else cases.when(F.col("kind") == kind, says)
    named = found.withColumn("kind", kind_of)
    field = F.col("kind").isin(*FIELDS)
    clean = F.when(field, unquoted(v)).when(F.col("kind") == "credit-card", F.regexp_replace(v, "[ -]+$", "")).otherwise(v)
    # a filter on a column would be pushed below it and work the rules out twice; an array's filter is not
    said = F.filter(F.array(F.struct(cases.alias("confidence"), clean.alias("value"))), lambda s: s["confidence"].isNotNull())
    out = named.select(*[c for c in named.columns if c != "value"], F.explode(said).alias("s")).select("*", "s.*").drop("s")
    return out.withColumn("end", F.when(F.col("kind") == "credit-card", F.col("start") + F.length("value")).otherwise(F.col("end")).cast("int"))


def resolve_overlaps(found: DataFrame) -> DataFrame:
    """Of overlapping candidates of a unit those that win: by start, priority, longest; locations (and addresses) compete with
    one another, a url keeps what lies in it out, other kinds stand beside locations, and the better kind wins."""
    first = {k: i for i, k in reversed(list(enumerate(s.kind for s in P.SPECS)))}
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in first.items() for x in kv]), F.col("kind"))
    item = F.struct(F.col("start"), rank.alias("rank"), (-(F.col("end") - F.col("start"))).alias("short"), F.col("end"), "kind", "confidence", "value", "context", "line")
    # runs of candidates that touch one another; those of different runs never compete. A unit is scanned in blocks of SPAN
    # characters: a candidate that goes on over a block's end is seen in the next ones too. A run within a block is whole; of the
    # others a block has two at most, and they are put together in order
    block = lambda x: F.floor(x / SPAN).cast("long")
    marked = found.withColumn("_block", F.explode(F.sequence(block(F.col("start")), block(F.greatest(F.col("start"), F.col("end") - 1))))).withColumn("_own", F.col("_block") == block(F.col("start")))
    order = Window.partitionBy(*UNIT, "_block").orderBy("start", F.desc("end"))
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    head = F.when(F.col("_own") & F.coalesce(F.col("start") >= reach, F.lit(True)), F.col("start"))
    runs = marked.withColumn("_head", head).withColumn("_run", F.coalesce(F.max("_head").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(-1))).where("_own")
    parts = runs.groupBy(*UNIT, "_block", "_run").agg(F.collect_set(item).alias("items"), F.max("end").alias("_end"))
    opened, goes_on = F.col("_run") < 0, F.col("_end") > (F.col("_block") + 1) * SPAN
    parts = parts.withColumn("_key", F.when(opened | goes_on, -1).otherwise(F.col("_run")))
    chain = Window.partitionBy(*UNIT, "_key").orderBy("_block", "_run").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("_chain", F.sum(F.when(opened, 0).otherwise(1)).over(chain))
    units = parts.groupBy(*UNIT, "_key", "_chain").agg(F.array_sort(F.flatten(F.collect_list("items"))).alias("items"))
    empty = F.slice("items", 1, 0)

    def step(taken: Column, x: Column) -> Column:
        over = F.filter(taken, lambda o: (x["start"] < o["end"]) & (o["start"] < x["end"]))
        place = x["kind"].isin(P.LOCATIONS)
        in_url = F.exists(over, lambda o: (o["kind"] == "url") & (o["start"] <= x["start"]) & (x["end"] <= o["end"]))
        better = F.exists(over, lambda o: o["rank"] <= x["rank"])
        beside = ~place & F.forall(over, lambda o: o["kind"].isin(P.LOCATIONS))
        rest = F.filter(taken, lambda o: ~((x["start"] < o["end"]) & (o["start"] < x["end"])))
        return F.when((F.size(over) == 0) | beside, F.concat(taken, F.array(x))).when((place & in_url) | better | F.exists(over, lambda o: o["kind"] == x["kind"]), taken).otherwise(F.concat(rest, F.array(x)))

    kept = units.select(*UNIT, F.explode(F.aggregate("items", empty, step)).alias("f"))
    return kept.select(*UNIT, "f.line", "f.start", "f.end", "f.kind", "f.value", "f.confidence", "f.context")


def pair_credentials(findings: DataFrame, window: int = 5) -> DataFrame:
    """A username and a credential within `window` lines of each other in a unit raise each other's confidence by one level."""
    unit = [k for k in UNIT if k in findings.columns]
    near = Window.partitionBy(*unit, "_block").orderBy("line").rangeBetween(-window, window)
    proof = F.col("kind").isin("password", "secret", "bearer", "basic-auth", "jwt")
    paired = F.when(F.col("kind") == "username", F.max(proof).over(near)).when(proof, F.max(F.col("kind") == "username").over(near)).otherwise(False)
    raised = F.when(F.col("confidence") == "low", "medium").when(F.col("confidence") == "medium", "high").otherwise("critical")
    return with_neighbours(findings, "line", window).withColumn("confidence", F.when(paired, raised).otherwise(F.col("confidence"))).where("_own").drop("_block", "_own")


def _found(units: DataFrame, source: str, unit: str, text: str, kinds: Iterable[str] | None, keep: Column | None = None) -> DataFrame:
    found = validated(candidates(units, source, unit, text, kinds), kinds)
    return pair_credentials(resolve_overlaps(found if keep is None else found.where(keep)))


def detect(units: DataFrame, source: str = "source", unit: str = "doc_id", text: str = "text", kinds: Iterable[str] | None = None, keep: Column | None = None) -> DataFrame:
    """Canonical findings. keep: a predicate on findings, applied before overlaps are resolved. Rows of one name are units of their
    own if their texts differ; repeated rows are one unit."""
    found = _found(units, source, unit, text, kinds, keep)
    category = F.element_at(F.create_map(*[F.lit(x) for kv in P.CATEGORY.items() for x in kv]), F.col("kind"))
    return found.select("source", "unit_id", "line", "start", "end", "kind", category.alias("category"), "value", "confidence", "context", F.lit(None).cast("long").alias("packet"), F.lit(None).cast("long").alias("item"))


def message_findings(messages: DataFrame, key: str, parts: tuple[str, ...] = ("request", "response"), kinds: Iterable[str] | None = None) -> DataFrame:
    """Findings in the texts of each message (columns `parts`), with where they stand: the part, head or body, and the line."""
    cells = messages.select(F.col(key), F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.col(p).alias("text")) for p in parts])).alias("c")).select(key, "c.*").where("text is not null")
    heads = F.length(F.regexp_replace(F.substring_index(F.regexp_replace("text", "\r\n", "\n"), "\n\n", 1), "[^\n]", "")) + 1
    sizes = cells.select(F.col("part").alias("source"), F.col(key).cast("string").alias("unit_id"), heads.alias("_head")).groupBy("source", "unit_id").agg(F.max("_head").alias("_head"))
    found = detect(cells, "part", key, "text", kinds).join(sizes, ["source", "unit_id"])
    place = F.when(F.col("line") <= F.col("_head"), "head").otherwise("body")
    return found.select("unit_id", F.col("source").alias("part"), place.alias("place"), "line", "start", "end", "kind", "category", "value", "confidence")


# -- choices over findings


def expand_kinds(words: str) -> list[str]:
    """The kinds that plain words ask for, with exact kind names."""
    import re

    asked = [k for pattern, kinds in P.ASKED if re.search(pattern, words, re.I) for k in kinds]
    return list(dict.fromkeys([*asked, *[k for k in P.KINDS if re.search(rf"(?<![\w-]){k}(?![\w-])", words.lower())]]))


def filter_kinds(findings: DataFrame, kinds: list[str]) -> DataFrame:
    k = F.translate(F.lower("kind"), "_", "-")
    return findings.where(F.exists(F.lit([x.lower().replace("_", "-") for x in kinds]), lambda w: k.contains(w) | w.contains(k)))


def filter_needles(findings: DataFrame, needles: list[str], column: str = "value") -> DataFrame:
    v, only = F.lower(column), S.digits(F.col(column))
    return findings.where(F.exists(F.lit([n.lower() for n in needles]), lambda n: v.contains(n) | ((F.length(S.digits(n)) >= 6) & (F.length(only) >= 6) & (only.contains(S.digits(n)) | S.digits(n).contains(only)))))


def rank_of(confidence: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in P.LEVELS.items() for x in kv]), F.lower(confidence)), F.lit(1))


def min_confidence(findings: DataFrame, least: str) -> DataFrame:
    return findings.where(rank_of(F.col("confidence")) >= P.LEVELS[least])


def distinct_findings(findings: DataFrame) -> DataFrame:
    """The first of each kind and value of a source."""
    first = Window.partitionBy("source", "kind", "value").orderBy("unit_id", "line", "start")
    return findings.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def with_path_context(findings: DataFrame, path: str) -> DataFrame:
    """Confidence moved by where the file lies; no finding is dropped."""
    points = sum((F.when(F.translate(path, "\\", "/").rlike(p), n).otherwise(0) for p, n in P.PATH_POINTS), F.lit(0))
    base = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in P.SCORE.items() for x in kv]), F.col("confidence")), F.lit(45))
    score = base + points
    moved = F.when(score >= 95, "critical").when(score >= 80, "high").when(score >= 60, "medium").otherwise("low")
    return findings.withColumn("confidence", F.when(points == 0, F.col("confidence")).otherwise(moved))


#: Characters in the pieces that texts are put together from again.
PIECE = 4096


def redact(units: DataFrame, source: str = "source", unit: str = "doc_id", text: str = "text", kinds: Iterable[str] | None = None, everywhere: bool = False) -> DataFrame:
    """(source, unit_id, redacted, n): texts with each finding replaced by [REDACTED:kind]; a PEM block goes as a whole.

    n counts the findings, also one that lies within another. With everywhere, a value found once in a unit is replaced wherever it
    stands in the unit's texts, and n counts the marks. Rows of one name keep their
    own findings. A text is put together from pieces of PIECE characters, each with its spans, so work grows with the text.
    """
    wanted = set(kinds or P.KINDS)
    for kind, pattern in PEM.items():
        if kind in wanted:
            held = F.regexp_count(text, F.lit(pattern))
            units = units.withColumn("_pem", (F.col("_pem") if "_pem" in units.columns else F.lit(0)) + F.coalesce(held, F.lit(0))).withColumn(text, F.regexp_replace(text, pattern, f"[REDACTED:{kind}]"))
    units = units if "_pem" in units.columns else units.withColumn("_pem", F.lit(0))
    own = units.select(F.col(source).cast("string").alias("source"), F.col(unit).cast("string").alias("unit_id"), F.unhex(F.md5(F.col(text))).alias("_row"), F.col(text).alias("text"), "_pem")
    found = _found(units, source, unit, text, kinds).select(*UNIT, "start", "end", "kind", "value")
    if everywhere:
        found = found.select(*UNIT, "start", "end", "kind").unionByName(repeats(own, found)).distinct()
    return _replaced(own, found.select(*UNIT, "start", "end", "kind"), marks_only=everywhere)


_PART = "struct<from:int,to:int,kind:string,n:int>"


def _replaced(own: DataFrame, spans: DataFrame, marks_only: bool) -> DataFrame:
    """own (UNIT, text, _pem) with its spans replaced; of overlapping spans the first and longest counts. A span's mark stands in
    the piece that it begins in, and pieces leave out what a span covers."""
    row = [F.col(k) for k in UNIT]
    order = Window.partitionBy(*UNIT, "_block").orderBy("start", F.desc("end"), "kind")
    block = lambda x: F.floor(x / SPAN).cast("long")
    seen = spans.withColumn("_block", F.explode(F.sequence(block(F.col("start")), block(F.col("end") - 1)))).withColumn("_own", F.col("_block") == block(F.col("start")))
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    # where spans touch, what the one before covers is left out; the one that begins within it has no mark of its own
    within = F.col("end") <= F.col("_reach")
    flat = seen.withColumn("_reach", F.coalesce(reach, F.lit(0))).where("_own")
    flat = flat.select(*UNIT, F.when(within, F.col("start")).otherwise(F.greatest("start", "_reach")).alias("start"), "end", F.when(F.col("start") >= F.col("_reach"), F.col("kind")).alias("kind"), within.alias("_within"))
    piece = lambda x: F.floor(x / PIECE).cast("int")
    each = flat.withColumn("piece", F.explode(F.when(F.col("_within"), F.array(piece(F.col("start")))).otherwise(F.sequence(piece(F.col("start")), piece(F.col("end") - 1)))))
    first_piece = piece(F.col("start")) == F.col("piece")
    place = lambda x: F.when(~F.col("_within"), x.cast("int"))
    here = F.struct(
        place(F.greatest(F.lit(0), F.col("start") - F.col("piece") * PIECE)).alias("from"), place(F.least(F.lit(PIECE), F.col("end") - F.col("piece") * PIECE)).alias("to"),
        F.when(first_piece, F.col("kind")).alias("kind"), first_piece.cast("int").alias("n"),
    )
    none = own.distinct().select(*row, F.explode(F.sequence(F.lit(0), piece(F.greatest(F.lit(0), F.length("text") - 1)))).alias("piece"), F.lit(None).cast(_PART).alias("s"))
    pieces = each.select(*row, "piece", here.alias("s")).unionByName(none).groupBy(*UNIT, "piece").agg(F.array_sort(F.collect_list("s")).alias("s"))
    lists = pieces.groupBy(*UNIT).agg(F.transform(F.array_sort(F.collect_list(F.struct("piece", "s"))), lambda p: p["s"]).alias("spans"))
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def put(text: Column, spans: Column) -> Column:
        def step(a: Column, s: Column) -> Column:
            mark = F.coalesce(F.concat(F.lit("[REDACTED:"), s["kind"], F.lit("]")), F.lit(""))
            new = F.struct(s["to"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, s["from"] - a["at"]), mark).alias("out"))
            return F.when(s["from"].isNull(), a).otherwise(new)

        return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, first, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.lit(PIECE)))))

    cut = F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))
    joined = own.join(lists.select(*[F.col(k).alias(f"_{k}") for k in UNIT], "spans"), F.col("source").eqNullSafe(F.col("_source")) & F.col("unit_id").eqNullSafe(F.col("_unit_id")) & F.col("_row").eqNullSafe(F.col("__row")), "left")
    marks = F.aggregate("spans", F.lit(0), lambda n, p: n + (F.size(F.filter(p, lambda s: s["kind"].isNotNull())) if marks_only else F.aggregate(p, F.lit(0), lambda m, s: m + s["n"])))
    out = F.array_join(F.transform(cut, lambda t, i: put(t, F.coalesce(F.get("spans", i), F.array().cast(f"array<{_PART}>")))), "")
    return joined.select("source", "unit_id", F.when(F.col("text").isNotNull(), F.coalesce(out, F.col("text"))).alias("redacted"), (F.coalesce(marks, F.lit(0)) + F.col("_pem")).alias("n"))


def repeats(own: DataFrame, found: DataFrame, least: int = 4) -> DataFrame:
    """Where values of `least` characters or more that were found in a unit stand in any of its texts: (UNIT, start, end, kind).

    An automaton of a unit's values runs over its texts once, in Arrow batches; overlapping places are all reported.
    """
    values = found.where(F.length("value") >= least).groupBy("source", "unit_id", "value").agg(F.min("kind").alias("kind"))
    known = values.groupBy("source", "unit_id").agg(F.collect_list(F.struct("value", "kind")).alias("values"))
    rows = own.where("text is not null").select(*UNIT, "text").distinct().join(known, ["source", "unit_id"])

    def search(batches):
        import ahocorasick
        import pandas as pd

        for b in batches:
            out = []
            for source, unit, row, text, values in zip(b.source, b.unit_id, b._row, b.text, b["values"], strict=True):
                automaton = ahocorasick.Automaton()
                for v in values:
                    automaton.add_word(v["value"], (len(v["value"]), v["kind"]))
                automaton.make_automaton()
                out += [(source, unit, row, end + 1 - n, end + 1, kind) for end, (n, kind) in automaton.iter(text)]
            yield pd.DataFrame(out, columns=[*UNIT, "start", "end", "kind"])

    return rows.mapInPandas(search, "source string, unit_id string, _row binary, start int, end int, kind string")


# -- orders and roll-ups


def in_order(findings: DataFrame) -> DataFrame:
    """By source, unit, line and start."""
    return findings.orderBy("source", "unit_id", "line", "start", "end", "kind")


def by_severity(findings: DataFrame) -> DataFrame:
    """The worst first, then family, then place."""
    family = F.array_position(F.lit(list(dict.fromkeys(P.CATEGORY.values()))), F.col("category"))
    return findings.orderBy(F.desc(rank_of(F.col("confidence"))), family, "kind", "source", "unit_id", "line", "start")


def inventory(findings: DataFrame) -> DataFrame:
    """Per kind: findings, distinct values, units, top confidence."""
    top = F.max(rank_of(F.col("confidence")))
    out = findings.groupBy("kind", "category").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_values"), F.count_distinct("unit_id").alias("n_units"), top.alias("top"))
    return out.withColumn("top", F.get(F.lit(["", *P.LEVELS]), F.col("top")))


#: What a finding of a category can be used for, and what to do.
EXPOSURE = {
    "secret": "Acts for a service. Revoke it and issue another.",
    "authentication": "Lets its holder act as a user. Rotate it and keep it out of pages and logs.",
    "identity": "Identifies a person. Keep no copy that is not needed.",
    "financial": "Can be used for fraud. Restrict who can export it.",
    "network": "Shows where systems are. Check that it is meant to be public.",
    "http": "A weak setting of a web service. Mend the flag or header.",
    "injection": "Input that may be executed. Do not run it; review where it came from.",
    "config": "An unsafe setting. Turn it off outside development.",
}


def exposure_note(category: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in EXPOSURE.items() for x in kv]), category), F.lit("Check who can read this."))


def analyst_report(findings: DataFrame) -> DataFrame:
    """The inventory with what each kind exposes, worst first."""
    out = inventory(findings)
    return out.withColumn("exposure", exposure_note(F.col("category"))).orderBy(F.desc(rank_of(F.col("top"))), F.desc("n"), "kind")


def kinds_in_question(flagged: list[str], asked: list[str]) -> list[str]:
    """Kinds that a flag and a question both name; else those that either names."""
    return [k for k in flagged if k in asked] or flagged or asked


def project_summary(records: DataFrame) -> DataFrame:
    """Per project of report records: files, findings, distinct values, and how many of each severity."""
    levels = [F.count_if(F.col("severity") == x.upper()).alias(x) for x in reversed(P.LEVELS)]
    return records.groupBy("project").agg(F.count_distinct("file").alias("files"), F.count("*").alias("findings"), F.count_distinct("fingerprint").alias("n_values"), *levels)


def tally(findings: DataFrame) -> DataFrame:
    return findings.groupBy("confidence").agg(F.count("*").alias("n"))


def report_records(findings: DataFrame) -> DataFrame:
    """One row per finding for the report files."""
    score = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in P.SCORE.items() for x in kv]), F.col("confidence")), F.lit(45))
    family = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in P.REPORT_CATEGORY.items() for x in kv]), F.col("category")), F.lit("SECRET"))
    return findings.select(
        F.col("source").alias("project"), F.col("unit_id").alias("file"), "line", "packet", "item", F.col("kind").alias("detector"), family.alias("category"), "value",
        score.alias("confidence"), F.upper("confidence").alias("severity"), S.line_snippet(F.col("context")).alias("context"), S.fingerprint(F.col("kind"), F.col("value")).alias("fingerprint"), S.redacted_preview(F.col("value")).alias("redacted"),
    )


def rotation(findings: DataFrame, most: int = 20) -> DataFrame:
    """Per leaked value: kind, worst confidence, where it is, in the order in which to rotate.

    A value's places are counted in full; the list of the first `most` is kept by rank, so a value found everywhere is no large list."""
    marked = findings.withColumn("fingerprint", S.fingerprint(F.col("kind"), F.col("value")))
    place = F.concat_ws("/", "source", "unit_id")
    sums = marked.groupBy("fingerprint", "kind").agg(F.max(rank_of(F.col("confidence"))).alias("worst"), F.count_distinct("source").alias("projects"), F.count_distinct(place).alias("files"), F.count("*").alias("occurrences"))
    order = Window.partitionBy("fingerprint", "kind").orderBy("place")
    first = marked.select("fingerprint", "kind", place.alias("place")).distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    lists = first.groupBy("fingerprint", "kind").agg(F.concat_ws(", ", F.array_sort(F.collect_list("place"))).alias("places"))
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for r, ks in P.ROTATION.items() for k in ks for x in (k, r)]), F.col("kind")), F.lit(2))
    out = sums.join(lists, ["fingerprint", "kind"]).withColumn("rank", rank).withColumn("severity", F.upper(F.get(F.lit(["", *P.LEVELS]), F.col("worst"))))
    more = F.when(F.col("files") > most, F.concat(F.col("places"), F.lit(" +"), (F.col("files") - most).cast("string"), F.lit(" more"))).otherwise(F.col("places"))
    return out.select("fingerprint", "kind", "severity", "projects", "files", "occurrences", more.alias("places"), "rank")


def scan_totals(units: DataFrame, findings: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """One row: units, bytes, lines, projects, findings."""
    lines = F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1
    a = units.agg(F.count("*").alias("units"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes"), F.coalesce(F.sum(lines), F.lit(0)).alias("lines"), F.count_distinct(source).alias("projects"))
    return a.crossJoin(findings.agg(F.count("*").alias("findings")))  # one row by one row


def resume(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that are new or changed since the manifest."""
    return listing.join(manifest, ["path", "size", "modified"], "left_anti")


def prune(records: DataFrame, listing: DataFrame, rescanned: DataFrame) -> DataFrame:
    """Records of files that are still there and were not scanned again."""
    return records.join(listing.select(F.col("path").alias("file")).distinct(), "file", "left_semi").join(rescanned.select(F.col("path").alias("file")).distinct(), "file", "left_anti")


def analyst_kinds(findings: DataFrame, remote: bool = False) -> DataFrame:
    """The kinds that matter most; with remote, those that must be redacted before they leave."""
    return findings.where(F.col("kind").isin(P.REMOTE if remote else P.ANALYST))


def with_native_ids(findings: DataFrame, rows: DataFrame, *ids: str) -> DataFrame:
    """Findings with the numbers that their rows carry (packet, item), joined on unit_id."""
    own = rows.select(F.col("unit_id").cast("string").alias("unit_id"), *ids)
    return findings.drop(*ids).join(own, "unit_id", "left")


def item_numbers(lines: DataFrame, *keys: str, order: str = "line", text: str = "text", tag: str = "<item>") -> DataFrame:
    """Lines with the number of item tags up to each, in order."""
    return running_sum(lines, list(keys), order, F.size(F.split(F.col(text), tag)) - 1, "item")
