"""PII: base kinds by pattern, and terms that disclose them by corpus co-occurrence; DataFrame functions only.

Information-theoretic sanitisation: a protected entity (the value of a base span) carries -log2 p(entity) bits. A term near it
discloses PMI(term, entity) = log2(p(term, entity) / (p(term) p(entity))) of them, where each p is a share of all documents:
of those that hold the term, hold the entity, or hold the term near the entity. Terms that stand near an entity in at least
`support` different contexts (copies of one context count once) and disclose at least `threshold` of its bits become spans
wherever they occur in documents that hold the entity. In the sanitised text base spans are generalised to their kind and
terms to [word].

Positions: each match is set between marks, the text is split at them, and starts are sums of lengths. The mark is a
noncharacter, and one that a text holds itself is first replaced by another that no pattern matches either. Work grows with a
text's length, however many matches it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans
from ..functions.spans import let
from .common import stash

#: The base kinds in the order of the results, and their patterns. Nothing follows the repeats, so they need not
#: give back (++); that keeps the matcher's stack flat on long runs. A run of an address's first characters is tried from its start,
#: or from where the last match ended (\\G), and from nowhere within: what fails there fails within, so work grows with the text.
KINDS = ("email", "ip", "card", "phone", "term")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to match at all.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
TERM = r"\p{L}{2,}"
#: Characters on either side of a mention that are its context, and those of a block of text that contexts are taken from.
CONTEXT, BLOCK = 80, 1024
SPAN = "array<struct<kind:int,start:long,end:long,value:string>>"


def matches(text: Column, pattern: str, kind: int) -> Column:
    """All leftmost non-overlapping matches as spans; the text must not hold the mark."""
    return F.transform(spans.matches(text, pattern), lambda x: F.struct(F.lit(kind).alias("kind"), x["at"].alias("start"), (x["at"] + F.length(x["part"])).alias("end"), x["part"].alias("value")))


def unmarked(text: Column) -> Column:
    return spans.unmarked(F.coalesce(text, F.lit("")))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes(kind: str, value: Column) -> Column:
    """Whether a match of the kind's pattern counts."""
    n = F.length(digits(value))
    return {
        "email": F.lit(True),
        "ip": F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$")),
        "card": n.between(13, 19) & F.call_function("luhn_check", F.substring(digits(value), 1, 19)),
        "phone": n.between(9, 15),
    }[kind]


def spans_of(text: Column, kind: str) -> Column:
    found = F.filter(matches(text, PATTERNS[kind], KINDS.index(kind)), lambda s: passes(kind, s["value"]))
    return F.when(text.rlike(NEEDS[kind]), found).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """Spans of the base kinds, by kind as listed and then start; text without marks."""
    return F.concat(*[spans_of(text, k) for k in KINDS[:4]])


def count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def described(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def words_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1)))


def disclosing_terms(found: DataFrame, docs: DataFrame, text_col: str, threshold: float, support: int) -> DataFrame:
    """(value, term, disclosure, contexts): terms that disclose at least `threshold` of an entity's bits.

    found: row_id, text and base of the documents that hold a base span.
    """
    # contexts are taken from blocks of the text, so that a match costs the same in a text of any length
    cut = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def piece(blocks: Column, start: Column, n: Column) -> Column:
        i = F.floor(start / BLOCK).cast("int")
        return F.substring(F.concat(F.coalesce(F.get(blocks, i), F.lit("")), F.coalesce(F.get(blocks, i + 1), F.lit(""))), (start - i * BLOCK + 1).cast("int"), n)

    def context(blocks: Column, s: Column) -> Column:
        low = F.greatest(F.lit(0).cast("long"), s["start"] - CONTEXT - 1)
        before, after = piece(blocks, low, (s["start"] - low).cast("int")), piece(blocks, s["end"], F.lit(CONTEXT + 1))
        # a word that the context cuts is no word of it
        before = F.when(F.length(before) > CONTEXT, F.regexp_replace(before, r"^(?:\p{L}+|[^\p{L}])", "")).otherwise(before)
        after = F.when(F.length(after) > CONTEXT, F.regexp_replace(after, r"(?:\p{L}+|[^\p{L}])$", "")).otherwise(after)
        return F.struct(F.lower(s["value"]).alias("value"), F.concat(before, F.lit(" . "), after).alias("context"))

    each = found.select("row_id", F.explode(let(cut, lambda blocks: F.transform("base", lambda s: context(blocks, s)))).alias("s"))
    near = each.select("row_id", "s.*")
    near = stash(near.select("row_id", "value", F.xxhash64("context").alias("context"), words_of(F.col("context")).alias("terms")), "contexts")
    entity = near.select("row_id", "value").distinct().groupBy("value").agg(F.count("*").alias("n_entity"))
    pairs = near.select("row_id", "value", "context", F.explode("terms").alias("term"))
    # first by context, so that a group of copies is one row before anything is counted distinctly
    contexts = pairs.groupBy("value", "term", "context").agg(F.count("*").alias("n")).groupBy("value", "term").agg(F.count("*").alias("contexts")).where(F.col("contexts") >= support)
    contexts = stash(contexts, "supported")
    together = pairs.join(contexts, ["value", "term"], "left_semi").select("value", "term", "row_id").distinct().groupBy("value", "term").agg(F.count("*").alias("n_both"))
    both = stash(contexts.join(together, ["value", "term"]).join(entity, "value"), "near")
    # documents that hold each term, over all documents and whole texts; only the terms in question travel
    asked = stash(both.select("term").distinct(), "terms")
    # each task sums its words before they are dealt out, so the join meets a word once and not once a document; an inner join,
    # as a semi join would be pushed below the sums
    words = docs.select(F.explode(words_of(F.coalesce(F.col(text_col), F.lit("")))).alias("term"))
    often = words.groupBy("term").agg(F.count("*").alias("n_term")).join(asked, "term")
    total = F.lit(float(max(1, docs.count())))
    pmi = F.log2(F.col("n_both") * total / (F.col("n_term") * F.col("n_entity")))
    bits = F.log2(total / F.col("n_entity"))
    scored = both.join(often, "term").withColumn("disclosure", F.when(bits > 0, pmi / bits).otherwise(0.0))
    return scored.where(F.col("disclosure") >= threshold).select("value", "term", "disclosure", "contexts")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, support: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, base (spans of the base kinds), terms (spans that the method adds; value: the word).

    Null and empty texts have no span; very long ones with many matches take time in proportion. Repeated rows are found each
    for itself. An empty table gives no rows. Other columns of docs take no part.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("doc_id"), unmarked(F.col(text_col)).alias("text"))
    marked = rows.withColumn("base", base_spans(F.col("text")))
    holding = F.size("base") > 0
    marked = stash(marked.select("row_id", "doc_id", "base", F.when(holding, F.col("text")).alias("text")), "base")
    found = marked.where(holding)
    strong = stash(disclosing_terms(found, docs, text_col, threshold, support), "disclosing")
    values = found.select("row_id", F.explode(F.array_distinct(F.transform("base", lambda s: F.lower(s["value"])))).alias("value"))
    per_row = values.join(strong, "value").groupBy("row_id").agg(F.collect_set("term").alias("words"))  # of one text's entities
    words = found.select("row_id", "text").join(per_row, "row_id")
    own = F.filter(matches(F.col("text"), TERM, 4), lambda s: F.array_contains("words", F.lower(s["value"])))
    terms = words.select("row_id", own.alias("terms"))
    return marked.join(terms, "row_id", "left").select("doc_id", "base", F.coalesce("terms", F.array().cast(SPAN)).alias("terms"))


def sanitised(text: Column, found: Column) -> Column:
    """The text with each span replaced: base kinds by [kind], terms by [word]; a span that overlaps an earlier one goes with it."""
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    names = F.array(*[F.lit(f"[{k}]") for k in (*KINDS[:4], "word")])
    first = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int"))
        fits = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fits, F.concat(acc["out"], gap, F.get(names, s["kind"]))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(ordered, first, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, F.length(text))))
