"""URL filters by a path-template tree, with DataFrame functions only.

Each host has a tree of path segments. Digits in a segment become <n>, long hexadecimal runs <h>; then, from the root on, the
branches of one parent are generalised to * where there are many and each has less than its share (variable parts), and merged
into * where the bad share of their labelled pages does not differ from that of their siblings without them (a two-sided test
at about 5 %, in which the siblings' share is shrunk to the share of bad pages among all labelled ones, so branches with few
labels or none merge, and only those that labels set apart keep their name). What all shapes of a node have in common is
passed in one step, so the work depends on where paths part and not on how deep they are. A template is rejected when the
smoothed share of bad among its labelled pages reaches `reject` for sure, that is, less `sure` standard errors: labelled
evidence, and not the prior alone.

Pages are first summed by host and path shape, so a host of any size is summed where its rows lie, and all later levels
work on the shapes alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, stash

#: (host, path, verdict); at most MOST_RULES, as they travel with the plan (more raise an error).
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
MOST_RULES = 5000
#: A shape of a path with more than a HOT-th of all pages is joined in PIECES tasks.
HOT, PIECES = 1000, 16
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct<length, rule, verdict> of the longest rule that fits, or null: its host or a subdomain of it, and a path that
    starts with the rule's."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    fits = [F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)), F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in rules]
    return F.array_max(F.filter(F.array(*fits), lambda x: x.isNotNull())) if fits else F.lit(None).cast("struct<length:int,rule:string,verdict:string>")


def shape(path: Column) -> Column:
    """The path's segments with their variable characters generalised."""
    short = F.regexp_replace(path, r"(?<![0-9A-Za-z])[0-9a-f]{8,}(?![0-9A-Za-z])", "<h>")
    parts = F.split(F.regexp_replace(F.regexp_replace(short, "^/", ""), "[0-9]+", "<n>"), "/", -1)
    return F.when(path == "", F.array().cast("array<string>")).otherwise(parts)


def templates(shapes: DataFrame, prior: float, strength: float = 4.0, most_kids: int = 16, z: float = 1.96) -> DataFrame:
    """shapes (host, segments, n, labelled, bad), one row a host and shape, with template: array<string>. prior: the share of bad
    among all labelled pages."""
    active = shapes.withColumn("template", F.array().cast("array<string>")).withColumn("rest", F.col("segments"))
    done = active.where("false")
    while not active.isEmpty():
        # the node's common way: that of its least and its greatest rest
        ends = active.groupBy("host", "template").agg(F.min("rest").alias("lo"), F.max("rest").alias("hi"))
        parted = F.array_position(F.zip_with("lo", "hi", lambda x, y: F.coalesce(x == y, F.lit(False))), F.lit(False)).cast("int")
        ends = ends.select("host", "template", F.when(parted == 0, F.size("lo")).otherwise(parted - 1).alias("way"))
        on = active.join(ends, ["host", "template"]).withColumn("template", F.concat("template", F.slice("rest", F.lit(1), F.col("way"))))
        on = on.withColumn("rest", F.slice("rest", F.col("way") + 1, F.size("rest"))).drop("way").withColumn("segment", F.get("rest", F.lit(0)))
        kids = on.where("segment is not null").groupBy("host", "template", "segment").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "bad")])
        parent = kids.groupBy("host", "template").agg(F.count("*").alias("kids"), *[F.sum(c).alias(f"all_{c}") for c in ("n", "labelled", "bad")])
        both = kids.join(parent, ["host", "template"])
        variable = (F.col("kids") > most_kids) & (F.col("n") * F.col("kids") < F.col("all_n"))
        others = F.col("all_labelled") - F.col("labelled") + F.lit(strength)
        rate = (F.col("all_bad") - F.col("bad") + F.lit(strength * prior)) / others
        spread = F.col("labelled") * rate * (1 - rate) * (1 + F.col("labelled") / others)
        similar = (F.col("kids") > 1) & (F.abs(F.col("bad") - F.col("labelled") * rate) <= z * F.sqrt(spread))
        named = both.select("host", "template", "segment", F.when(variable | similar, F.lit("*")).otherwise(F.col("segment")).alias("node"))
        grown = on.join(named, ["host", "template", "segment"], "left").withColumn("template", F.when(F.col("node").isNull(), F.col("template")).otherwise(F.concat("template", F.array("node"))))
        now = stash(grown.withColumn("rest", F.slice("rest", 2, F.greatest(F.lit(0), F.size("rest") - 1))).select(*active.columns), "templates")
        done, active = done.unionByName(now.where("size(rest) = 0")), now.where("size(rest) > 0")
    return done.drop("rest")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", label: Column | None = None, rules: Sequence[tuple[str, str, str]] = RULES, strength: float = 4.0, reject: float = 0.5, sure: float = 1.64) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict (allow, block), template, purity (smoothed share of bad).

    label: 1 for bad, 0 for good, null for unknown; without it, what the rules say. A rule's verdict holds where one fits;
    elsewhere the template's. Of rules of one length that fit, the one that sorts last counts. Null urls and those without ://
    have an empty host and path and are allowed unless labels say otherwise. Repeated rows are judged alike; a path may have any
    number of segments. An empty table gives no rows; other columns take no part.
    """
    base = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"), (label if label is not None else F.lit(None)).cast("int").alias("given"))
    base = base.withColumn("hit", longest_rule(F.col("host"), F.col("path"), rules)).withColumn("segments", shape(F.col("path")))
    known = F.col("given") if label is not None else F.when(F.col("hit").isNotNull(), (F.col("hit.verdict") == "block").cast("int"))
    base = base.withColumn("known", known)
    sums = [F.count("*").alias("n"), F.count("known").alias("labelled"), F.coalesce(F.sum("known"), F.lit(0)).alias("bad")]
    shapes = stash(base.groupBy("host", "segments").agg(*sums), "shapes")
    whole = shapes.agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")).first()
    prior = ((whole.bad or 0) + 1) / ((whole.labelled or 0) + 2)
    tree = templates(shapes, prior, strength)
    pure = tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    pure = pure.withColumn("purity", (F.col("bad") + F.lit(strength * prior)) / (F.col("labelled") + F.lit(strength)))
    error = F.sqrt(F.col("purity") * (1 - F.col("purity")) / (F.col("labelled") + F.lit(strength + 1)))
    pure = pure.withColumn("rejected", (F.col("labelled") > 0) & (F.col("purity") - sure * error >= reject))
    judged = tree.select("host", "segments", "template").join(pure, ["host", "template"]).select(F.col("host").alias("of"), F.col("segments").alias("cut"), F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity", "rejected")
    # shapes of more than a HOT-th of all pages, fewer than HOT in number, are joined in PIECES tasks each
    hot = F.broadcast(shapes.where(F.col("n") * HOT > whole.n).select(F.col("host").alias("_h"), F.col("segments").alias("_s"))) if whole.n else None
    if hot is not None:
        base = base.join(hot, (F.col("host") == F.col("_h")) & (F.col("segments") == F.col("_s")), "left").withColumn("piece", F.when(F.col("_h").isNull(), 0).otherwise(F.pmod(F.xxhash64("page_id", "path"), F.lit(PIECES))).cast("int")).drop("_h", "_s")
        judged = judged.join(hot, (F.col("of") == F.col("_h")) & (F.col("cut") == F.col("_s")), "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.when(F.col("_h").isNull(), 0).otherwise(PIECES - 1)))).drop("_h", "_s")
    else:
        base, judged = base.withColumn("piece", F.lit(0)), judged.withColumn("part", F.lit(0))
    out = base.join(judged, (F.col("host") == F.col("of")) & (F.col("segments") == F.col("cut")) & (F.col("piece") == F.col("part")))
    verdict = F.coalesce(F.col("hit.verdict"), F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")
