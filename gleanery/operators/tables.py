"""Evidence tables: names, types, conversion, flattening, unions, profiles."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


_WHOLE, _REAL = r"^\s*[+-]?\d{1,18}\s*$", r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$"


def safe_names(names: Iterable[str]) -> list[str]:
    """Word characters only, no leading digit, at most 60 long, unique in any case."""
    out: list[str] = []
    for i, name in enumerate(names):
        base = re.sub(r"\W+", "_", str(name)).strip("_") or f"col_{i + 1}"
        base = (f"col_{base}" if base[0].isdigit() else base)[:60]
        name, n = base, 2
        while name.lower() in {x.lower() for x in out}:
            name, n = f"{base}_{n}", n + 1
        out.append(name)
    return out


def safe_columns(df: DataFrame) -> DataFrame:
    """df under safe names; each column's metadata holds its source name."""
    pairs = list(zip(df.columns, safe_names(df.columns), strict=True))
    plain = df.toDF(*[f"_{i}" for i in range(len(pairs))])
    return plain.select(*[F.col(f"_{i}").alias(new, metadata={"source_name": old}) for i, (old, new) in enumerate(pairs)])


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def infer_types(df: DataFrame) -> dict[str, str]:
    """INTEGER, REAL or TEXT for each column, over all rows, in one pass; blanks say nothing, and all blank is TEXT."""
    cols = df.columns
    c = [F.col(f"`{x}`").cast("string") for x in cols]
    tests = [a for i, x in enumerate(c) for a in (F.bool_and(blank(x) | x.rlike(_WHOLE)).alias(f"w{i}"), F.bool_and(blank(x) | x.rlike(_REAL)).alias(f"r{i}"), F.count_if(~blank(x)).alias(f"n{i}"))]
    row = df.agg(*tests).first() if cols else None
    return {x: "TEXT" if not row[f"n{i}"] else "INTEGER" if row[f"w{i}"] else "REAL" if row[f"r{i}"] else "TEXT" for i, x in enumerate(cols)}


def convert(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Typed columns; blanks are null, booleans 0 and 1; what does not convert is null there and kept in _rescued."""
    to = {"INTEGER": "bigint", "REAL": "double", "TEXT": "string"}
    out, kept = [], []
    for x in df.columns:
        c = F.col(f"`{x}`").cast("string")
        c = F.when(blank(c), None).otherwise(c)
        plain = F.trim(c)
        if kinds[x] != "TEXT":
            plain = F.when(F.lower(plain) == "true", "1").when(F.lower(plain) == "false", "0").otherwise(plain)
        typed = c if kinds[x] == "TEXT" else plain.try_cast(to[kinds[x]])
        out.append(typed.alias(x))
        kept.append(F.when(c.isNotNull() & typed.isNull(), F.struct(F.lit(x).alias("key"), c.alias("value"))))
    rescued = F.map_from_entries(F.filter(F.array(*kept), lambda e: e.isNotNull()))
    return df.select(*out, rescued.alias("_rescued"))


def flatten(df: DataFrame, depth: int = 2) -> DataFrame:
    """Structs to dotted columns down to `depth`; arrays, maps and deeper structs to JSON text."""
    out: list[Column] = []

    def walk(column: Column, name: str, kind: T.DataType, left: int) -> None:
        if isinstance(kind, T.StructType) and left > 0:
            for f in kind.fields:
                walk(column.getField(f.name), f"{name}.{f.name}", f.dataType, left - 1)
        elif isinstance(kind, T.StructType | T.ArrayType | T.MapType):
            out.append(F.to_json(column).alias(name))
        else:
            out.append(column.alias(name))

    for f in df.schema.fields:
        walk(F.col(f"`{f.name}`"), f.name, f.dataType, depth - 1)
    return df.select(*out)


def union_keys(df: DataFrame, column: str, order: str) -> DataFrame:
    """(key, first, n): the keys of all JSON objects, by where each is first seen."""
    keys = df.select(F.col(order).alias("at"), F.posexplode(F.expr(f"json_object_keys(`{column}`)")).alias("pos", "key"))
    return keys.groupBy("key").agg(F.min(F.struct("at", "pos")).alias("first"), F.count("*").alias("n"))


def union_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """All rows with the table's name; binary columns as hex of 80 bytes."""
    out = None
    for name, df in tables.items():
        shown = df.select(*[F.hex(F.substring(c, 1, 80)).alias(c) if t == "binary" else F.col(f"`{c}`") for c, t in df.dtypes]).withColumn("table", F.lit(name))
        out = shown if out is None else out.unionByName(shown, allowMissingColumns=True)
    return out


def profile(df: DataFrame, approximate: bool = False, samples: int = 3) -> DataFrame:
    """One row per column: non_null, distinct, min, max (as text, by the column's own order), samples."""
    cols = df.columns
    c = [F.col(f"`{x}`") for x in cols]
    count = F.approx_count_distinct if approximate else F.count_distinct
    text = [x.cast("string") for x in c]
    ranges = df.agg(*[a for i, x in enumerate(c) for a in (F.min(x).cast("string").alias(f"a{i}"), F.max(x).cast("string").alias(f"b{i}"))])
    ends = ranges.select(F.explode(F.array(*[F.struct(F.lit(x).alias("column"), F.col(f"a{i}").alias("min"), F.col(f"b{i}").alias("max")) for i, x in enumerate(cols)])).alias("e")).select("e.*")
    long = df.select(F.explode(F.array(*[F.struct(F.lit(x).alias("column"), t.alias("value")) for x, t in zip(cols, text, strict=True)])).alias("e")).select("e.*")
    stats = long.groupBy("column").agg(F.count("value").alias("non_null"), count("value").alias("distinct"))
    some = Window.partitionBy("column").orderBy("value")
    first = long.where("value is not null").distinct().withColumn("n", F.row_number().over(some)).where(F.col("n") <= samples)
    shown = first.groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("samples"))
    kinds = F.create_map(*[F.lit(v) for x, k in df.dtypes for v in (x, k)])
    return stats.join(ends, "column").join(shown, "column", "left").select("column", F.element_at(kinds, F.col("column")).alias("type"), "non_null", "distinct", "min", "max", F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))


def briefing(profiled: DataFrame, rows: int) -> DataFrame:
    """One line of text a column: name, type, distinct, empties, examples, whether it holds JSON."""
    json = F.forall("samples", lambda s: s.rlike(r"^\s*[\[{]")) & (F.size("samples") > 0)
    shown = F.array_join(F.transform("samples", lambda s: F.left(s, F.lit(24))), ", ")
    text = F.concat(F.col("column"), F.lit(" "), F.col("type"), F.lit(", "), F.col("distinct").cast("string"), F.lit(" distinct, "), (F.lit(rows) - F.col("non_null")).cast("string"), F.lit(" empty, e.g. "), shown, F.when(json, " (JSON text)").otherwise(""))
    return profiled.select("column", text.alias("line"))


def merge_first_nonblank(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: of each column the first value in order that is not blank."""
    rest = [c for c in df.columns if c not in (key, order)]
    first = [F.min_by(F.col(c), F.when(~blank(F.col(c).cast("string")), F.col(order))).alias(c) for c in rest]
    return df.groupBy(key).agg(*first)


def insert_missing(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """current with the incoming rows whose key it lacks, in the shared columns; nothing is overwritten."""
    new = incoming.join(current.select(key).distinct(), key, "left_anti")
    return current.unionByName(new.select(*[c for c in incoming.columns if c in current.columns]), allowMissingColumns=True)


def diff_snapshots(before: DataFrame, after: DataFrame, path: str = "path", digest: str = "sha256") -> DataFrame:
    """(path, change): added, removed or changed."""
    a, b = before.select(F.col(path).alias("path"), F.col(digest).alias("old")), after.select(F.col(path).alias("path"), F.col(digest).alias("new"))
    both = a.join(b, "path", "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return both.select("path", change.alias("change")).where("change is not null")


def upsert_hits(store: DataFrame, events: DataFrame, keys: list[str], text: list[str]) -> DataFrame:
    """One row a key: newest texts, and hits added up. Both sides hold keys, texts, updated_at and hit_count."""
    both = store.unionByName(events)
    newest = [F.max_by(c, "updated_at").alias(c) for c in text]
    return both.groupBy(*keys).agg(*newest, F.max("updated_at").alias("updated_at"), F.sum("hit_count").alias("hit_count"))


def expire(registry: DataFrame, now: Column) -> DataFrame:
    return registry.where(F.col("expires_at") > now)


def resolve_dataset(registry: DataFrame, name: str) -> DataFrame:
    """By id, id prefix or name; the newest first."""
    return registry.where((F.col("id") == name) | F.startswith("id", F.lit(name)) | (F.lower("name") == name.lower())).orderBy(F.desc("created_at"))


def next_dataset_name(registry: DataFrame) -> str:
    used = registry.select(F.regexp_extract("name", r"^dt(\d+)$", 1).try_cast("int").alias("n")).agg(F.max("n")).first()[0]
    return f"dt{(used or 0) + 1}"


def register(registry: DataFrame, name: str | None, source: str, now: Column, hours: float = 4.0) -> DataFrame:
    """registry with one dataset more; without a name it gets the next one."""
    own = registry.sparkSession.range(1).select(
        F.sha2(F.concat_ws("\n", F.lit(name or next_dataset_name(registry)), F.lit(source), now.cast("string")), 256).alias("id"), F.lit(name or next_dataset_name(registry)).alias("name"),
        F.lit(source).alias("source"), now.alias("created_at"), (now + F.make_dt_interval(hours=F.lit(0), mins=F.lit(0), secs=F.lit(hours * 3600.0))).alias("expires_at"),
    )
    return registry.unionByName(own, allowMissingColumns=True)


def list_datasets(registry: DataFrame, now: Column) -> DataFrame:
    """Datasets that have not expired, newest first."""
    return expire(registry, now).orderBy(F.desc("created_at"), "id")


def rank_store(store: DataFrame, needle: str | None = None, text: tuple[str, ...] = ("tool", "operation", "purpose", "labels", "intent", "source"), n: int | None = None) -> DataFrame:
    """Stored entries, most used first, then newest, then by falling id; with a needle those that have it in a text column."""
    from .query import search_turns

    some = search_turns(store, needle, [c for c in text if c in store.columns]) if needle else store
    ranked = some.orderBy(F.desc("hit_count"), F.desc("updated_at"), F.desc("id"))
    return ranked if n is None else ranked.limit(n)


def item_in_order(rows: DataFrame, file: str, position: str) -> DataFrame:
    """rows with item: their number in the file, from 1, in export order."""
    return rows.withColumn("item", F.row_number().over(Window.partitionBy(file).orderBy(position)))


def file_hash(content: Column) -> Column:
    """SHA-256 of a whole file."""
    return F.sha2(content.cast("binary"), 256)


def row_where(df: DataFrame) -> Column:
    """Where a row is, for a reader: its packet and item, and the first of url, time, id, path, host that it has; else the first
    column."""
    have = {c.lower(): c for c in df.columns}
    told = lambda c: F.trim(F.col(f"`{have[c]}`").cast("string"))
    numbers = [F.when(~F.coalesce(told(c), F.lit("")).isin("", "0"), F.concat(F.lit(label + " "), told(c))) for c, label in (("packet", "packet"), ("item", "item"), ("frame", "packet")) if c in have]
    places = [F.when(told(c) != "", told(c)) for c in ("url", "time", "id", "path", "host") if c in have]
    place = F.coalesce(*places) if places else F.lit(None).cast("string")
    parts = F.array_compact(F.array(*numbers, place) if numbers else F.array(place))
    return F.when(F.size(parts) > 0, F.array_join(parts, " · ")).otherwise(F.coalesce(F.col(f"`{df.columns[0]}`").cast("string"), F.lit("")))


def finding_where(*columns: str) -> Column:
    return F.concat_ws(" · ", *[F.concat(F.lit(c + " "), F.col(c).cast("string")) for c in columns])


def dataset_findings(df: DataFrame, key: str, kinds: list[str] | None = None, needles: list[str] | None = None) -> DataFrame:
    """Findings in any table: from columns whose names hint at secrets, and by detection over all text cells."""
    from . import detect

    hints = ("password", "secret", "token", "api_key", "apikey", "credential", "email", "phone", "card", "iban", "ssn", "passwd", "auth", "cookie")
    cols = [c for c, t in df.dtypes if t == "string" and c != key]
    cells = df.select(F.col(key).cast("string").alias("row"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("text")) for c in cols])).alias("c")).select("row", "c.*").where(~blank(F.col("text")))
    found = detect.detect(cells, "column", "row", "text", kinds).select(F.col("unit_id").alias("row"), F.col("source").alias("column"), "kind", "value", "confidence")
    hinted = cells.where(F.exists(F.lit(list(hints)), lambda h: F.lower("column").contains(h))).select("row", "column", F.lower("column").alias("kind"), F.col("text").alias("value"), F.lit("medium").alias("confidence"))
    new = hinted.join(found.select("row", "column", "value").distinct(), ["row", "column", "value"], "left_anti")
    out = found.unionByName(new if kinds is None else detect.filter_kinds(new, kinds)).dropDuplicates(["row", "column", "kind", "value"])
    return detect.filter_needles(out, needles) if needles else out


