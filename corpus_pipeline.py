"""The corpus pipeline: documents through toxicity, exact dedup, near dedup, mixing and packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and is written as Parquet before the next.
When a stage begins, tables that earlier stages wrote for themselves are removed, but for those that its input still reads;
one pipeline runs in a driver at a time. Batches of rows that go to Python are set to ROWS.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from gleanery.llm import common, exact_dedup, mixing, packing, simhash, toxicity
from gleanery.llm.common import stash, table

#: Rows in a batch that goes to Python: few, as a row is a whole text.
ROWS = 1000
#: Tables that stages have written for themselves.
_own: list[str] = []


def stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(f)
    def begin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS)
        read = docs.inputFiles()
        over = [p for p in _own if not any(p.rsplit("/", 1)[1] in f for f in read)]
        common.discard(spark, over)
        _own[:] = [p for p in _own if p not in over]
        made = len(common.MADE)
        out = f(spark, docs, sf_dir)
        _own.extend(common.MADE[made:])
        return out

    return begin


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under 0.3; the columns of documents."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


@stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the largest doc_id."""
    return exact_dedup.drop_exact_copies(docs)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies (five-word shingles, similarity 0.8 or more), that with the smallest doc_id."""
    return simhash.drop_near_copies(docs)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as it takes them, with the columns of documents."""
    return mixing.mixed_documents(docs).select(*docs.columns)


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of at most 4,096 tokens."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("packing", pack_sequences)]

#: SQL can express neither the conditional random field nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stash(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
