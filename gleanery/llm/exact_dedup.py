"""Exact dedup by content-defined chunk recipes, with DataFrame functions only.

Each text is cut where its own content says so (after a sentence mark or line end, 128 to 2,048 characters a chunk), so equal
passages are cut alike in every document. A chunk is stood for by a 64-bit identifier. The chunk dictionary verifies every
identifier against the SHA-256 and length of all chunks that carry it; identifiers that stand for more than one content are
replaced by ones made of the digest. Documents are equal when their ordered identifier lists are. Only identifiers and digests
are shuffled; the texts are read once, where they lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CASED_BEYOND_ASCII, LOWER, UPPER, stash

#: Cuts at sentence marks and line ends, whatever the letters' case.
CHUNK = r"(?s).{128,2047}?[.!?\n]|.{1,2048}"
#: A group of over 1/HOT of the rows is joined in several tasks; bytes of names of dropped rows that are sent to every executor.
HOT, SHIPPED = 1000, 64 << 20


def chunks(text: Column) -> Column:
    """The text's chunks, A-Z lower-cased; their concatenation is the normalised text. Null and empty: no chunk."""
    fold = lambda c: F.when(c.rlike(CASED_BEYOND_ASCII), F.translate(c, UPPER, LOWER)).otherwise(F.lower(c))
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CHUNK), F.lit(0)), fold)


def chunk_recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(row_id, doc_id, text_sha256, recipe array<struct<h, len, sha>>, and the columns named in keep), written once.

    row_id tells repeated rows apart; it is fixed by being written.
    """
    cut = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("doc_id"), chunks(F.col(text_col)).alias("chunks"), F.struct(*keep).alias("kept") if keep else F.lit(None).cast("int").alias("kept"))
    recipe = F.transform("chunks", lambda c: F.struct(F.xxhash64(c).alias("h"), F.octet_length(c).alias("len"), F.unhex(F.sha2(c, 256)).alias("sha")))
    return stash(cut.select("row_id", "doc_id", F.sha2(F.array_join("chunks", ""), 256).alias("text_sha256"), recipe.alias("recipe"), "kept"), "recipes")


def chunk_dictionary(recipes: DataFrame) -> DataFrame:
    """One row per 64-bit identifier: chunk_id, occurrences, len, sha256, verified (false if it stands for several contents)."""
    each = recipes.select(F.explode("recipe").alias("c")).select("c.*")
    found = each.groupBy("h").agg(F.count("*").alias("occurrences"), F.min("sha").alias("lo"), F.max("sha").alias("hi"), F.min("len").alias("len"), F.max("len").alias("most"))
    return found.select(F.col("h").alias("chunk_id"), "occurrences", "len", F.lower(F.hex("lo")).alias("sha256"), ((F.col("lo") == F.col("hi")) & (F.col("len") == F.col("most"))).alias("verified"))


def identified(recipes: DataFrame) -> DataFrame:
    """recipes with ids: array<binary>, the ordered list of verified identifiers.

    Nearly always every 64-bit identifier is verified and the list needs no shuffle; else the chunks are joined to those
    that are not, and these take 64 bits and the digest as their identifier.
    """
    clash = stash(chunk_dictionary(recipes).where("not verified").select("chunk_id"), "clashes")
    if clash.isEmpty():
        return recipes.withColumn("ids", F.transform("recipe", lambda c: F.unhex(F.lpad(F.hex(c["h"]), 16, "0"))))
    each = recipes.select("row_id", F.posexplode("recipe").alias("pos", "c")).join(clash, F.col("c.h") == F.col("chunk_id"), "left")
    plain = F.unhex(F.lpad(F.hex("c.h"), 16, "0"))
    ids = each.select("row_id", "pos", F.when(F.col("chunk_id").isNull(), plain).otherwise(F.concat(plain, F.col("c.sha"))).alias("id"))
    lists = ids.groupBy("row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids"))
    return recipes.join(lists, "row_id", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<binary>")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256 and, if asked for, the columns in keep.

    Equal: identical after lower-casing A-Z; null counts as empty. The row with the largest doc_id stays (a null id is the
    least; of repeated rows with that id, one). An empty table gives no rows. A very long text is a long list of chunks. Other
    columns of docs, whatever their names, take no part.
    """
    listed = identified(chunk_recipes(docs, id_col, text_col, keep))
    # the count and the largest row of each list; a group of any size is summed before it is shuffled
    groups = listed.groupBy("ids").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row_id")).alias("top"))
    groups = stash(groups.withColumnRenamed("ids", "same"), "groups")
    # a group with over 1/HOT of all rows is dealt out over as many salts as it has such shares; there are HOT such groups at most
    part = F.ceil(F.col("group_size") * HOT / F.lit(max(1, listed.count()))).cast("int")
    hot = groups.where(part > 1).select(F.xxhash64("same").alias("list"), part.alias("salts")).groupBy("list").agg(F.max("salts").alias("salts"))
    salted = lambda rows, ids: rows.join(F.broadcast(hot), F.xxhash64(ids) == F.col("list"), "left").drop("list").withColumn("salts", F.coalesce("salts", F.lit(1)))
    left = salted(listed, "ids").withColumn("salt", F.expr("cast(pmod(xxhash64(row_id), salts) as int)"))
    right = salted(groups, "same").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    out = left.join(right, (F.col("ids") == F.col("same")) & (F.col("salt") == F.col("other")))
    chosen = ["doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("row_id") == F.col("top.row_id")).alias("kept"), "text_sha256"]
    return out.select(*chosen, *([F.col(f"kept.{c}").alias(f"_{c}") for c in keep]))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the copies, columns as they were.

    What goes is named by its id and the SHA-256 of its text as it is; docs is read again without these names, so texts are not
    moved while the names are few enough for every executor (SHIPPED bytes at most); beyond that they are joined. Repeated
    rows with one id and text share a name; if one of them stays, one of them is kept.
    """
    mark = F.unhex(F.sha2(F.coalesce(docs[text_col], F.lit("")).cast("binary"), 256))
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), mark.alias("mark"))
    found = exact_groups(own, keep=("mark",)).where("group_size > 1")
    names = stash(found.groupBy("doc_id", "_mark").agg(F.count_if("kept").alias("stay"), F.count("*").alias("rows")), "names")
    named = lambda some: docs[id_col].eqNullSafe(some["doc_id"]) & (mark == some["_mark"])
    gone, twice = names.where("stay = 0"), names.where("stay > 0 and rows > 1")
    size = names.agg(F.sum(F.coalesce(F.octet_length(F.col("doc_id").cast("string")), F.lit(0)) + 48)).first()[0] or 0
    shipped = F.broadcast if size <= SHIPPED else (lambda some: some)
    if twice.isEmpty():
        return docs.join(shipped(gone), named(gone), "left_anti")
    plain = docs.join(shipped(names.where("stay = 0 or rows > 1")), named(names), "left_anti")
    return plain.unionAll(docs.join(shipped(twice), named(twice), "left_semi").dropDuplicates([id_col, text_col]))
