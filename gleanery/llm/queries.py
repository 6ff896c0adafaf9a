"""The registered queries opN_<name>: each applies its operator to a whole table and shapes the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, exact_dedup, hmm, mixing, odd_sketch, packing, pii, prefix_trie, ranked, secrets, simhash, toxicity, url_filter
from .common import MADE, table, tidy


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "spans")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(table(spark, sf_dir, "documents"), width=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recall of op4_ann against brute force."""
    return ann.recall(table(spark, sf_dir, "embeddings"), op4_ann(spark, sf_dir))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    counts = [pii.count_of(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(pii.described(F.col("base")), 256).alias("base_sha256"), pii.described(F.concat("base", "terms")).alias("spans"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), "source")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(secrets.find(table(spark, sf_dir, "documents")))


def secret_digest(found: DataFrame) -> DataFrame:
    counts = [F.size(F.filter("base", _is_kind(k))).cast("long").alias(f"n_{k}") for k in secrets.KINDS]
    base = _described(F.col("base"))
    order = F.array(*[F.lit(k) for k in secrets.KINDS])
    rank = lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))
    whole = F.array_distinct(F.array_sort(F.transform(F.concat("base", "more"), rank)))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), _described(whole).alias("spans"))


def _is_kind(kind: str):
    return lambda s: s["kind"] == kind


def _described(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokens=4096, end_id=1)


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = odd_sketch.near_classes(table(spark, sf_dir, "documents"), width=5, similarity=0.85)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op12_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=20)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def tidied(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query; of the tables that it writes on the way only those that its result reads are left."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = len(MADE)
        return tidy(query(spark, sf_dir), made)

    return run


_ALL: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_toxicity": op2_toxicity,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_ann": op4_ann,
    "op5_pii": op5_pii,
    "op6_mixing": op6_mixing,
    "op7_simhash": op7_simhash,
    "op8_secrets": op8_secrets,
    "op9_hmm": op9_hmm,
    "op10_packing": op10_packing,
    "op11_minhash": op11_minhash,
    "op12_ranked": op12_ranked,
    "op13_prefix_trie": op13_prefix_trie,
    "ann_recall": ann_recall,
}
QUERIES = {name: tidied(query) for name, query in _ALL.items()}
