"""Extensions: enrichers by name, detectors of one's own, and detection from SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import patterns as P

Enricher = Callable[[DataFrame], DataFrame]
_enrichers: dict[str, Enricher] = {}


def enricher(name: str) -> Callable[[Enricher], Enricher]:
    def add(f: Enricher) -> Enricher:
        _enrichers[name] = f
        return f

    return add


def enrich(df: DataFrame, *names: str) -> DataFrame:
    """df through the named enrichers in order; all of them if none is named."""
    for name in names or tuple(_enrichers):
        df = df.transform(_enrichers[name])
    return df


def add_detector(kind: str, category: str, value: str, before: str = "", confidence: str = "medium") -> None:
    """A detector of one's own: a pattern with a fixed confidence, behind the built-in ones."""
    if kind in P.CATEGORY:
        raise ValueError(f"{kind} is there already")
    P.SPECS.append(P.Spec(kind, category, before, value, confidence))
    P.KINDS.append(kind)
    P.CATEGORY[kind] = category


def findings_view(spark: SparkSession, table: str, view: str, source: str, unit: str, text: str) -> None:
    """A view of the findings in a table, for SQL users."""
    from .detect import detect

    detect(spark.table(table), source, unit, text).createOrReplaceTempView(view)
