"""Scalar functions as Columns: checksums, entropy, addresses, masking, text cleaning, URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import let

# fixed values: the multiplication and permutation tables of the Verhoeff checksum
_D = [[0, 1, 2, 3, 4, 5, 6, 7, 8, 9], [1, 2, 3, 4, 0, 6, 7, 8, 9, 5], [2, 3, 4, 0, 1, 7, 8, 9, 5, 6], [3, 4, 0, 1, 2, 8, 9, 5, 6, 7], [4, 0, 1, 2, 3, 9, 5, 6, 7, 8], [5, 9, 8, 7, 6, 0, 4, 3, 2, 1], [6, 5, 9, 8, 7, 1, 0, 4, 3, 2], [7, 6, 5, 9, 8, 2, 1, 0, 4, 3], [8, 7, 6, 5, 9, 3, 2, 1, 0, 4], [9, 8, 7, 6, 5, 4, 3, 2, 1, 0]]
_P = [[0, 1, 2, 3, 4, 5, 6, 7, 8, 9], [1, 5, 7, 6, 2, 8, 3, 0, 9, 4], [5, 8, 0, 3, 7, 9, 6, 1, 4, 2], [8, 9, 1, 6, 0, 4, 3, 5, 2, 7], [9, 4, 5, 3, 1, 2, 6, 8, 7, 0], [4, 2, 8, 6, 5, 7, 3, 9, 0, 1], [2, 7, 9, 3, 8, 0, 6, 4, 1, 5], [7, 0, 4, 6, 9, 1, 3, 2, 5, 8]]


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def luhn(value: Column) -> Column:
    """Digits pass the Luhn check and are not all the same."""
    d = digits(value)
    return F.call_function("luhn_check", d) & ~d.rlike(r"^(\d)\1*$")


def verhoeff(value: Column) -> Column:
    d = F.transform(F.split(F.reverse(digits(value)), ""), lambda c: c.cast("int"))
    perm, mult = F.lit([x for row in _P for x in row]), F.lit([x for row in _D for x in row])
    steps = F.transform(d, lambda c, i: F.get(perm, (i % 8) * 10 + c))
    return F.aggregate(steps, F.lit(0), lambda a, p: F.get(mult, a * 10 + p)) == 0


def mod97(value: Column) -> Column:
    """The IBAN check: four characters to the end, letters to numbers, remainder 1 by 97."""
    v = F.upper(F.replace(value, F.lit(" "), F.lit("")))
    turned = F.concat(F.substring(v, 5, 64), F.substring(v, 1, 4))
    numbers = F.transform(F.split(turned, ""), lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55))
    return F.length(v).between(15, 34) & (F.aggregate(numbers, F.lit(0).cast("bigint"), lambda a, n: (F.when(n > 9, a * 100).otherwise(a * 10) + n) % 97) == 1)


def entropy(value: Column) -> Column:
    """Shannon bits a character."""
    share = lambda letters: F.transform(F.array_distinct(letters), lambda c: F.size(F.filter(letters, lambda x: x == c)) / F.size(letters))
    return F.when(F.length(value) > 0, F.aggregate(let(F.split(value, ""), share), F.lit(0.0), lambda a, p: a - p * F.log2(p))).otherwise(0.0)


def looks_random(value: Column) -> Column:
    classes = sum((value.rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", r"\d", "[^A-Za-z0-9]")), F.lit(0))
    return (F.length(value) >= 12) & (classes >= 2) & (entropy(value) >= 3.2)


def ipv4_number(value: Column) -> Column:
    """The address as a number; null if a part is over 255 or has a leading zero."""
    parts = F.split(value, r"\.")
    good = value.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$")
    return F.when(good, F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, p: a * 256 + p.try_cast("bigint")))


def ipv6_hex(value: Column) -> Column:
    """The address as 32 hexadecimal digits, its zone left out; null if it is none. The last two groups may be an IPv4 address."""
    run = "[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*"

    def with_tail(v: Column) -> Column:
        tail = lambda n: F.concat(F.hex(F.shiftright(n, 16)), F.lit(":"), F.hex(n.bitwiseAND(65535)))
        return let(F.regexp_extract(v, r":((?:\d+\.){3}\d+)$", 1), lambda four: F.when(four == "", v).otherwise(F.concat(F.left(v, F.length(v) - F.length(four)), F.lower(let(ipv4_number(four), tail)))))

    def filled(v: Column) -> Column:
        groups = lambda i: F.transform(F.filter(F.split(F.split_part(v, F.lit("::"), F.lit(i)), ":"), lambda g: g != ""), lambda g: F.lpad(g, 4, "0"))

        def put(x: Column) -> Column:
            n = F.size(x["a"]) + F.size(x["b"])
            return F.when(F.when(v.contains("::"), n <= 7).otherwise(n == 8), F.concat(F.array_join(x["a"], ""), F.repeat(F.lit("0000"), F.lit(8) - n), F.array_join(x["b"], "")))

        return F.when(v.rlike(f"^(?:{run})?(?:::(?:{run})?)?$"), let(F.struct(groups(1).alias("a"), groups(2).alias("b")), put))

    return let(let(F.lower(F.regexp_replace(value, "%[^%]+$", "")), with_tail), filled)


def ip_bits(value: Column) -> Column:
    """The address as a string of 32 or 128 bits; null if it is none."""
    half = lambda six, i: F.lpad(F.conv(F.substring(six, i, 16), 16, 2), 64, "0")
    return F.coalesce(F.lpad(F.conv(ipv4_number(value).cast("string"), 10, 2), 32, "0"), let(ipv6_hex(value), lambda six: F.concat(half(six, 1), half(six, 17))))


# fixed values: private, loopback and other special networks (first address, bits)
_NETS = {"loopback": [("127.0.0.0", 8)], "unspecified": [("0.0.0.0", 32)], "multicast": [("224.0.0.0", 4)], "private": [("10.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16), ("169.254.0.0", 16), ("192.0.0.0", 29), ("192.0.2.0", 24), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("240.0.0.0", 4), ("0.0.0.0", 8), ("127.0.0.0", 8)], "shared": [("100.64.0.0", 10)]}


def in_net(number: Column, name: str) -> Column:
    found = F.lit(False)
    for first, bits in _NETS[name]:
        a, b, c, d = map(int, first.split("."))
        low = ((a * 256 + b) * 256 + c) * 256 + d
        found = found | number.between(low, low + (1 << (32 - bits)) - 1)
    return found


def is_private(value: Column) -> Column:
    return F.coalesce(let(ipv4_number(value), lambda n: in_net(n, "private")), F.lit(False))


def is_public_address(value: Column) -> Column:
    return F.coalesce(let(ipv4_number(value), lambda n: ~(in_net(n, "private") | in_net(n, "multicast") | in_net(n, "shared"))), F.lit(False))


def host_scope(value: Column) -> Column:
    scope = lambda n: F.when(value.isin("0.0.0.0", "*", "::", "[::]"), "all").when(in_net(n, "loopback") | value.isin("::1", "localhost", "[::1]"), "local").when(in_net(n, "private"), "private").otherwise("public")
    return let(ipv4_number(value), scope)


def fingerprint(kind: Column, value: Column) -> Column:
    return F.sha2(F.concat(F.lower(F.trim(kind)), F.lit("\n"), F.trim(value)), 256)


def redacted_preview(value: Column) -> Column:
    return F.when(F.length(value) <= 8, F.concat(F.left(value, F.lit(2)), F.lit("***"))).otherwise(F.concat(F.left(value, F.lit(4)), F.lit("***"), F.right(value, F.lit(4))))


def line_snippet(line: Column, most: int = 160) -> Column:
    flat = F.trim(F.regexp_replace(line, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.left(flat, F.lit(most - 1)), F.lit("…"))).otherwise(flat)


def cell_text(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"\s+", " "))


def clean_text(text: Column, most: int = 500_000) -> Column:
    """Without terminal escapes and control characters; a longer text keeps its head and tail."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\x1b\[[0-9;?]*[ -/]*[@-~]", ""), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return F.when(F.length(plain) > most, F.concat(F.left(plain, F.lit(most // 2)), F.lit("\n…\n"), F.right(plain, F.lit(most // 2)))).otherwise(plain)


def safe_project_name(name: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", ""), F.lit("")), F.lit("project"))


def record_fingerprint(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def url_host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def registrable_domain(host: Column) -> Column:
    """The last two labels, or three under a two-letter suffix with a short second label (co.uk)."""

    def last(labels: Column) -> Column:
        deep = (F.size(labels) > 2) & F.element_at(labels, -1).rlike("^[a-z]{2}$") & F.element_at(labels, -2).isin("co", "com", "org", "net", "gov", "ac", "edu")
        return F.when(F.size(labels) < 2, F.array_join(labels, ".")).otherwise(F.array_join(let(F.when(deep, 3).otherwise(2), lambda n: F.slice(labels, -n, n)), "."))

    return let(F.lower(host), lambda own: F.when(own.rlike(r"^[\d.]+$"), own).otherwise(let(F.split(own, r"\."), last)))


def defang(text: Column) -> Column:
    return F.replace(F.regexp_replace(F.regexp_replace(text, "(?i)http", "hxxp"), r"\.", "[.]"), F.lit("@"), F.lit("[@]"))


# fixed values: hosts that shorten links, and suffixes often abused
SHORTENERS = ["bit.ly", "tinyurl.com", "t.co", "goo.gl", "ow.ly", "is.gd", "buff.ly", "cutt.ly", "rb.gy", "shorturl.at"]
ABUSED = ["zip", "mov", "xyz", "top", "click", "link", "work", "gq", "tk", "ml", "cf", "ga", "icu", "rest", "country"]


def url_flags(url: Column) -> Column:
    """What makes a URL suspicious, in words."""
    host = url_host(url)
    tests = [
        (host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "bare ip"), (F.try_parse_url(url, F.lit("USERINFO")).isNotNull(), "credentials"), (host.contains("xn--"), "punycode"), (registrable_domain(host).isin(SHORTENERS), "shortener"),
        (F.element_at(F.split(host, r"\."), -1).isin(ABUSED), "abused suffix"), (F.length(url) > 160, "long"), (F.size(F.regexp_extract_all(url, F.lit("%[0-9A-Fa-f]{2}"), F.lit(0))) > 8, "heavy encoding"), (F.lower(url).startswith("http://"), "plain http"),
    ]
    return F.filter(F.array(*[F.when(t, F.lit(w)) for t, w in tests]), lambda x: x.isNotNull())


def json_path(column: Column, path: str) -> Column:
    """a.b[0] through JSON text; null on a miss."""
    return F.get_json_object(column, "$" + ("" if path.startswith("[") else ".") + path)


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing else; null is none. Spark's parser stops after the first value, so the text is
    tried as an item of an array and of an object: what may follow it in one may not in the other."""
    tried = [F.try_parse_json(F.concat(F.lit(a), text, F.lit(z))).isNotNull() for a, z in (("[", "]"), ('{"_":', "}"))]
    return tried[0] & tried[1]


def url_path(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))


# fixed values: form fields that frameworks add
NOISE_FIELDS = ["__viewstate", "__viewstategenerator", "__eventvalidation", "__eventtarget", "__eventargument", "__viewstateencrypted", "__lastfocus", "__requestverificationtoken"]


def drop_noise_fields(fields: Column) -> Column:
    """array<struct<name, value>> without what frameworks add."""
    return F.filter(fields, lambda f: ~F.lower(f["name"]).isin(NOISE_FIELDS))


def form_fields(body: Column) -> Column:
    """name=value pairs of a URL-encoded body, decoded, without what frameworks add."""
    pairs = F.filter(F.split(F.coalesce(body, F.lit("")), "&"), lambda p: p.contains("="))
    decoded = F.transform(pairs, lambda p: F.struct(F.coalesce(F.try_url_decode(F.split_part(p, F.lit("="), F.lit(1))), F.lit("")).alias("name"), F.coalesce(F.try_url_decode(F.regexp_replace(p, "^[^=]*=", "")), F.lit("")).alias("value")))
    return drop_noise_fields(decoded)


def normalise_target(value: Column) -> Column:
    """struct<kind: ip or domain, target> of what a user gives as a target: without scheme, user, path, port and last dots; null
    if it is neither."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(value), r"^[^/]*://(?:[^/@]*@)?", ""), r"[/?#].*$", "")
    bare = F.lower(F.regexp_replace(bare, r"\.+$", ""))
    six = bare.rlike(r"^\[?[0-9a-f:]*:[0-9a-f:]*:[0-9a-f:]*\]?(?::\d+)?$")
    clean = F.when(six, F.regexp_replace(F.regexp_replace(bare, r"\]:\d+$", "]"), r"[\[\]]", "")).otherwise(F.regexp_replace(bare, r":[^:]*$", ""))
    domain = clean.rlike(r"^(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z0-9-]{2,63}$")
    kind = F.when(six | ipv4_number(clean).isNotNull(), "ip").when(domain, "domain")
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), clean.alias("target")))


def days_since(day: Column, today: Column) -> Column:
    parsed = F.coalesce(F.try_to_date(day, "yyyy-MM-dd"), F.try_to_date(day, "yyyyMMdd"), F.try_to_date(day, "dd-MMM-yyyy"))
    return F.datediff(today, parsed)


def ttl_left(expires: Column, now: Column) -> Column:
    return F.greatest(F.lit(0), F.unix_timestamp(expires) - F.unix_timestamp(now))
