"""Secret scans with a recursive decoding worklist.

A text is a layer. Every decoder (URL escapes, Unicode escapes, base64 with or without compression inside) that changes a layer
makes a new one, in which each encoded part is replaced by what it holds; the new layer is put on the worklist unless its
content was seen before (so cycles end), until nothing is left. Each layer is scanned anew. A layer knows its runs: stretches
of characters and the rule by which they come from the layer before; so a finding in any layer is a span of the original, and
a layer costs its text and a few numbers a run. Compressed parts are unpacked as a stream: what they hold beyond WINDOW
characters comes as further layers, one at a time.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import html
import lzma
import re
import zlib
from array import array
from bisect import bisect_right
from collections import deque
from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The kinds, in the order of the results, and their patterns.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of at least 24
#: The names of assignments with what follows within a value, where neither white space nor quotes can stand.
_WITHIN = re.compile(r"(?ai:password|passwd|secret|token|api_?key)=")
#: Characters of unpacked content in one layer, which is cut at white space, and the most where there is none; layers overlap by
#: OVERLAP characters. All findings in unpacked content have the span of the compressed part, so one that is cut keeps its span.
WINDOW, OVERLAP, SOLID = 4 << 20, 4096, 16 << 20


class Finding(NamedTuple):
    kind: str
    start: int
    end: int
    value: str
    layer: str


#: How a run comes from the layer before. Above zero: so many characters there for each here. WHOLE: all of a stretch for each.
#: DIGITS: the base64 digits that hold a byte.
WHOLE, DIGITS = 0, -1


class Run(NamedTuple):
    """low, high: the stretch in the layer before; of DIGITS, the place of the first digit, and the byte that the run begins with.
    width, gap: digits in a line and characters between lines."""

    text: str
    form: int
    low: int
    high: int
    width: int = 1 << 62
    gap: int = 0


class Layer:
    """at, form, low, high, width, gap: of each run, where it begins and how it comes from the original."""

    def __init__(self, text: str, how: str = ""):
        self.text, self.how = text, how
        self.at, self.form, self.low, self.high, self.width, self.gap = (array("q") for _ in range(6))

    def add(self, at: int, form: int, low: int, high: int, width: int = 1 << 62, gap: int = 0) -> None:
        for own, x in ((self.at, at), (self.form, form), (self.low, low), (self.high, high), (self.width, width), (self.gap, gap)):
            own.append(x)

    def run(self, i: int) -> int:
        return bisect_right(self.at, i) - 1

    def place(self, i: int, k: int | None = None) -> tuple[int, int]:
        """The stretch of the original that a character comes from."""
        k = self.run(i) if k is None else k
        form, low, j = self.form[k], self.low[k], i - self.at[k]
        if form > 0:
            return low + form * j, low + form * (j + 1)
        if form == WHOLE:
            return low, self.high[k]
        byte = self.high[k] + j
        first, last = byte * 8 // 6, (byte * 8 + 7) // 6
        return low + first + first // self.width[k] * self.gap[k], low + last + last // self.width[k] * self.gap[k] + 1

    def origin(self, start: int, end: int) -> tuple[int, int]:
        """The span of the original; places only go up, so the first and the last character tell."""
        return self.place(start)[0], self.place(end - 1)[1]

    def decoded(self, start: int, end: int) -> bool:
        """Whether a decoder made any of these characters."""
        k = self.run(start)
        return k != self.run(end - 1) or self.form[k] != 1

    def then(self, runs: list[Run], how: str) -> Layer:
        """The layer of these runs, whose places are of this layer."""
        out = Layer("".join(r.text for r in runs), f"{self.how}>{how}" if self.how else how)
        at = 0
        for r in runs:
            n = len(r.text)
            if not n:
                continue
            a, b = self.run(r.low), self.run((r.high if r.form != DIGITS else r.low + 1) - 1)
            if r.form == 1:
                for k in range(a, b + 1):
                    i = max(r.low, self.at[k])
                    own = self.form[k]
                    low = self.place(i, k)[0] if own > 0 else self.low[k]
                    out.add(at + i - r.low, own, low, self.high[k] + (i - self.at[k] if own == DIGITS else 0), self.width[k], self.gap[k])
            elif r.form == WHOLE:
                out.add(at, WHOLE, *self.origin(r.low, r.high))
            elif a == b and self.form[a] == WHOLE:
                out.add(at, WHOLE, self.low[a], self.high[a])
            elif r.form > 0 and a == b and self.form[a] > 0:
                out.add(at, r.form * self.form[a], self.place(r.low, a)[0], 0)
            elif r.form == DIGITS and self.form[a] == 1 and self.run(r.low + (n * 8 + 7) // 6 + (n * 8 // 6) // r.width * r.gap - 1) == a:
                out.add(at, DIGITS, self.place(r.low, a)[0], 0, r.width, r.gap)
            else:  # each character by itself
                for j in range(n):
                    if r.form > 0:
                        low, high = r.low + r.form * j, r.low + r.form * (j + 1)
                    else:
                        first, last = j * 8 // 6, (j * 8 + 7) // 6
                        low, high = r.low + first + first // r.width * r.gap, r.low + last + last // r.width * r.gap + 1
                    out.add(at + j, WHOLE, *self.origin(low, high))
            at += n
        return out


def original(text: str) -> Layer:
    layer = Layer(text)
    layer.add(0, 1, 0, len(text))
    return layer


def matches(text: str) -> Iterator[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind that pass."""
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= 6:
            yield "assign", m.start(), m.end()
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 20:
                yield "access", m.start(), m.end()
    for m in HEX.finditer(text):
        yield "hex", m.start(), m.end()


#: A decoded part: where it stands, its runs, and further content that comes in layers of its own.
class Part(NamedTuple):
    start: int
    end: int
    runs: list[Run]
    more: Iterator[str] | None = None


_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\U[0-9A-Fa-f]{8})+|&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});")
_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|\\U([0-9A-Fa-f]{8})")
#: The least that a finding or an encoded part is made of; bytes without it can be neither.
_PLAIN = re.compile(rb"[\t\x20-\x7e]{12}")
#: Base64 in lines of one length, and in one piece. The least finding has 12 characters, 16 digits; a part of one can be shorter.
_LINES = re.compile(r"(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{16,}+\r?\n)+[A-Za-z0-9+/]{2,}+={0,2}")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{8,}={0,2}")
_CUT = re.compile(r"[+/_-]")


def url_parts(text: str) -> Iterator[Part]:
    for m in _URL.finditer(text) if "%" in text else ():
        raw = bytes.fromhex(m[0].replace("%", ""))
        if raw.isascii():
            yield Part(m.start(), m.end(), [Run(raw.decode(), 3, m.start(), m.end())])
            continue
        runs, at = [], m.start()
        for c in raw.decode("utf-8", "surrogateescape"):
            end = at + 3 * len(c.encode("utf-8", "surrogateescape"))
            lone = "\udc80" <= c <= "\udcff"  # a byte of no character stays as it is
            runs.append(Run(text[at:end], 1, at, end) if lone else Run(c, WHOLE, at, end))
            at = end
        if any(r.form != 1 for r in runs):
            yield Part(m.start(), m.end(), runs)


def unicode_parts(text: str) -> Iterator[Part]:
    for m in _UNICODE.finditer(text) if "\\" in text or "&#" in text else ():
        if m[0][0] == "&":
            yield Part(m.start(), m.end(), [Run(html.unescape(m[0]), WHOLE, m.start(), m.end())])
            continue
        units = [(int(e[1] or e[2] or e[3], 16), m.start() + e.start(), m.start() + e.end()) for e in _ESCAPE.finditer(m[0])]
        runs, i = [], 0
        while i < len(units):
            code, start, end = units[i]
            if 0xD800 <= code < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1][0] < 0xE000:
                code, end, i = 0x10000 + ((code - 0xD800) << 10) + units[i + 1][0] - 0xDC00, units[i + 1][2], i + 1
            none = code > 0x10FFFF or 0xD800 <= code < 0xE000  # no character: left as it is
            runs.append(Run(text[start:end], 1, start, end) if none else Run(chr(code), WHOLE, start, end))
            i += 1
        if any(r.form != 1 for r in runs):
            yield Part(m.start(), m.end(), runs)


def unpacker(head: bytes) -> Callable[[], object] | None:
    """What unpacks bytes that begin so; None if they are not compressed."""
    if head[:2] == b"\x1f\x8b" or (len(head) > 2 and head[0] == 0x78 and (head[0] * 256 + head[1]) % 31 == 0):
        return lambda: zlib.decompressobj(wbits=47)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor
    return lzma.LZMADecompressor if head[:6] == b"\xfd7zXZ\x00" else None


def unpack(blocks: Iterator[bytes], make: Callable[[], object], size: int = 1 << 20) -> Iterator[bytes]:
    """What compressed bytes hold, in blocks of at most `size`: all members one after another, and of broken ones what can be had."""
    work, rest = make(), b""
    for block in blocks:
        rest += block
        while rest or getattr(work, "unconsumed_tail", b"") or not getattr(work, "needs_input", True):
            try:
                got = work.decompress(rest, size)
            except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
                return
            rest = getattr(work, "unconsumed_tail", b"")
            if got:
                yield got
            if work.eof:
                rest = work.unused_data
                if (make := unpacker(rest)) is None:
                    return
                work = make()
            elif not got and not rest:
                break


def held(raw: bytes) -> Iterator[bytes] | None:
    """What compressed bytes hold, compressed in compressed down to the innermost; None if they hold nothing."""
    blocks: Iterator[bytes] = iter([raw])
    seen: set[bytes] = set()
    head = raw
    while (make := unpacker(head)) is not None and (mark := hashlib.blake2b(head[: 1 << 16], digest_size=16).digest()) not in seen:
        seen.add(mark)  # content that unpacks to itself ends here
        inner = unpack(blocks, make)
        head = next(inner, b"")
        while len(head) < 8 and (more := next(inner, b"")):
            head += more
        if not head:
            return None if len(seen) == 1 else iter(())
        blocks = chain([head], inner)
    return blocks if seen else None


def windows(blocks: Iterator[bytes]) -> Iterator[str]:
    """The text of unpacked content, about WINDOW characters at a time, cut at white space, or after SOLID characters without any."""
    read = codecs.getincrementaldecoder("utf-8")("replace")
    last = lambda t: max(t.rfind(" "), t.rfind("\n"))
    pending: list[str] = []
    size, space = 0, -1  # characters in pending, and where the last white space is
    for block in blocks:
        new = read.decode(block)
        pending.append(new)
        space = size + at if (at := last(new)) >= 0 else space
        size += len(new)
        while size > WINDOW and (space >= OVERLAP or size > SOLID):
            text, at = "".join(pending), space if space >= OVERLAP else size - 1
            yield text[: at + 1]
            text = text[max(at + 1 - OVERLAP, text.find(" ", at - OVERLAP, at) + 1) :]
            pending, size, space = [text], len(text), last(text)
    if text := "".join(pending) + read.decode(b"", True):
        yield text


def printable(raw: bytes) -> str | None:
    """The bytes as text if they are UTF-8 without control characters but white space."""
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    return text if text and all(c >= " " and c != "\x7f" or c in "\t\n\r\f\v" for c in text) else None


def from_base64(digits: str) -> bytes | None:
    body = digits.rstrip("=")
    if len(body) % 4 == 1 or ("+" in body or "/" in body) and ("-" in body or "_" in body):
        return None
    try:
        return base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def base64_part(text: str, start: int, end: int, width: int = 1 << 62, gap: int = 0) -> Part | None:
    """What the digits between start and end hold, if it is text, has text in it or is compressed."""
    digits = text[start:end]
    raw = from_base64(digits if not gap else re.sub(r"\s", "", digits))
    if not raw:
        return None
    got = printable(raw)
    if got is None and (blocks := held(raw)) is not None:
        more = windows(blocks)
        first = next(more, "")
        return Part(start, end, [Run(first, WHOLE, start, end)], more) if first else None
    if got is None and (end - start < 16 or not _PLAIN.search(raw)):
        return None
    if got is None or got.isascii():
        return Part(start, end, [Run(got or raw.decode("latin-1"), DIGITS, start, 0, width, gap)])
    runs, byte = [], 0
    for c in got:  # a character of several bytes is a run of its own
        n = len(c.encode())
        a, b = byte * 8 // 6, ((byte + n) * 8 - 1) // 6
        runs.append(Run(c, WHOLE, start + a + a // width * gap, start + b + b // width * gap + 1))
        byte += n
    return Part(start, end, runs)


def promising(digits: str) -> bool:
    """Whether the first digits may begin text or something compressed."""
    raw = from_base64(digits[: len(digits) // 4 * 4]) or b""
    return unpacker(raw) is not None or bool(raw) and all(c >= 32 and c != 127 or c in b"\t\n\r\f\v" for c in raw)


def in_run(text: str, start: int, end: int) -> Iterator[Part]:
    """Base64 in a run of its characters: all of it, or what begins after a / + - _ of it and ends there or before another."""
    if (part := base64_part(text, start, end)) is not None:
        yield part
        return
    cuts = [m.start() for m in _CUT.finditer(text, start, end)]
    stops = {kinds: [c for c in cuts if text[c] in kinds] for kinds in ("/+", "-_")}
    done = start
    for at in (start, *(c + 1 for c in cuts)):
        if at < done or end - at < 16 or not promising(text[at : min(end, at + 24)].rstrip("=")):
            continue
        ends = [end]
        for own in stops.values():
            k = bisect_right(own, at - 1)
            ends += own[k : k + 1]
        for stop in ends:
            if stop - at >= 16 and (at, stop) != (start, end) and (part := base64_part(text, at, stop)) is not None:
                yield part
                done = stop
                break


def base64_parts(text: str) -> Iterator[Part]:
    taken: list[Part] = []
    for m in _LINES.finditer(text):
        rows = re.split(r"\r?\n", m[0])
        gap = 2 if "\r" in m[0] else 1
        even = len({len(r) for r in rows[:-1]}) == 1 and len(rows[-1].rstrip("=")) <= len(rows[0]) and m[0].count("\r") in (0, len(rows) - 1)
        if even and (part := base64_part(text, m.start(), m.end(), len(rows[0]), gap)) is not None:
            taken.append(part)
    stop, k = 0, 0
    for m in _BASE64.finditer(text):
        while k < len(taken) and taken[k].start <= m.start():
            yield taken[k]
            stop, k = taken[k].end, k + 1
        if m.start() >= stop:
            yield from in_run(text, m.start(), m.end() if k == len(taken) else min(m.end(), taken[k].start))
    yield from taken[k:]


DECODERS: dict[str, Callable[[str], Iterator[Part]]] = {"url": url_parts, "unicode": unicode_parts, "base64": base64_parts}


def next_layers(layer: Layer, parts: Iterator[Part], how: str) -> Iterator[Layer]:
    """The layer with each part replaced by what it holds; then what parts hold beyond that."""
    runs, at, more = [], 0, []
    for p in parts:
        if at < p.start:
            runs.append(Run(layer.text[at : p.start], 1, at, p.start))
        runs += p.runs
        at = p.end
        if p.more is not None:
            more.append(p)
    if not at:
        return
    runs.append(Run(layer.text[at:], 1, at, len(layer.text)))
    yield layer.then(runs, how)
    del runs
    for p in more:
        for text in p.more:
            yield layer.then([Run(text, WHOLE, p.start, p.end)], how)


def inner(layer: Layer) -> Iterator[tuple[str, int, int]]:
    """Assignments within the value of another one, where a decoder made them; they end where it ends."""
    for m in ASSIGN.finditer(layer.text):
        for own in _WITHIN.finditer(layer.text, m.start(2), m.end(2)):
            if m.end(2) - own.end() >= 6 and layer.decoded(own.start(), m.end(2)):
                yield "assign", own.start(), m.end(2)


def scan(text: str | None) -> tuple[list[Finding], list[Finding]]:
    """Base findings, by start and then kind as listed, and those that only decoded layers show, by start, kind and end.

    A finding of a deeper layer counts if no finding so far has its kind, its span of the original and its value.
    """
    text = text or ""
    rank = {k: i for i, k in enumerate(KINDS)}
    base = sorted((Finding(k, a, b, text[a:b], "") for k, a, b in matches(text)), key=lambda f: (f.start, rank[f.kind]))
    more: list[Finding] = []
    known = {(f.kind, f.start, f.end, f.value) for f in base}
    seen: set[bytes] = set()
    work: deque[Iterator[Layer]] = deque([iter([original(text)])])
    while work:
        layer = next(work[0], None)
        if layer is None:
            work.popleft()
            continue
        digest = hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        if digest in seen:
            continue
        seen.add(digest)
        if layer.how:
            for k, a, b in (*matches(layer.text), *inner(layer)):
                start, end = layer.origin(a, b)
                if (k, start, end, layer.text[a:b]) not in known:
                    known.add((k, start, end, layer.text[a:b]))
                    more.append(Finding(k, start, end, layer.text[a:b], layer.how))
        work.extend(next_layers(layer, decode(layer.text), how) for how, decode in DECODERS.items())
    return base, sorted(more, key=lambda f: (f.start, rank[f.kind], f.end))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, base and more, arrays of struct<kind, start, end, value, layer> in code points of the text.

    layer names the decoders on the way, empty for the text itself. Null and empty texts have no finding; repeated rows are
    scanned each for itself; an empty table gives no rows. A task holds one batch of texts and the layers of one text that are
    still to be decoded; work grows with a text's length times the layers it has.
    """
    schema = "array<struct<kind:string,start:long,end:long,value:string,layer:string>>"

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [scan(t) for t in b.text]
            yield pd.DataFrame({"doc_id": b.doc_id, "base": pd.Series([[f._asdict() for f in x] for x, _ in found], dtype=object), "more": pd.Series([[f._asdict() for f in x] for _, x in found], dtype=object)})

    chosen = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    out = chosen.mapInPandas(each, f"doc_id string, base {schema}, more {schema}")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))
