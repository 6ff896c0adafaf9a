"""Read-only queries, search, slices and line operators."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_json
from ..functions.spans import lines_of, matches, unmarked
from .scans import previous

_REFUSED = "insert update delete drop alter create replace truncate merge attach detach pragma vacuum grant revoke call load set".split()


def guard(sql: str) -> str:
    """The statement if it is one SELECT or WITH without words that write; else ValueError."""
    bare = re.sub(r"/\*.*?\*/|--[^\n]*", " ", sql, flags=re.S).strip()
    if ";" in bare.rstrip(";") or not re.match(r"(?i)(select|with)\b", bare):
        raise ValueError("one SELECT or WITH statement only")
    if found := re.search(rf"(?i)\b({'|'.join(_REFUSED)})\b", bare):
        raise ValueError(f"{found[1]} is not allowed")
    return bare.rstrip(";")


def query(df: DataFrame, sql: str, limit: int | None = None, view: str = "data", seen: Observation | None = None) -> DataFrame:
    """A guarded statement over df as the view `data`; with a limit, the first rows in order of all columns, and `seen` tells how
    many there were."""
    df.createOrReplaceTempView(view)
    out = df.sparkSession.sql(guard(sql))
    return out if limit is None else counted(out, seen).orderBy(F.struct(*[F.col(f"`{c}`") for c in out.columns])).limit(limit)


def counted(df: DataFrame, seen: Observation | None) -> DataFrame:
    """df; once it ran, seen.get["rows"] is the number of its rows. Sort by a struct before a cap: Spark leaves out a sort by columns
    that are in order already, and then reads no further than the cap."""
    return df if seen is None else df.observe(seen, F.count(F.lit(1)).alias("rows"))


def omitted(seen: Observation, limit: int) -> int:
    return max(0, seen.get["rows"] - limit)


def limit_with_flag(df: DataFrame, n: int) -> tuple[list, bool]:
    rows = df.limit(n + 1).collect()
    return rows[:n], len(rows) > n


def head(df: DataFrame, n: int = 20, columns: tuple[str, ...] = ()) -> DataFrame:
    chosen = [c for c in columns if c in df.columns]
    return (df.select(*chosen) if chosen else df).limit(n)


def any_cell(df: DataFrame, test) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(test(F.col(f"`{c}`").cast("string")), F.lit(False)) for c in df.columns])


def search(df: DataFrame, needle: str) -> DataFrame:
    """Rows with the needle in any cell, in any case; % and _ are wildcards."""
    return df.where(any_cell(df, lambda c: c.ilike(f"%{needle}%")))


def grep_rows(df: DataFrame, needle: str) -> DataFrame:
    return df.where(any_cell(df, lambda c: F.contains(F.lower(c), F.lit(needle.lower()))))


def project_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    wanted = {k.lower() for k in keys}
    return df.select(*[c for c in df.columns if c.lower() in wanted])


def project_columns(df: DataFrame, keys: list[str]) -> DataFrame:
    """As project_keys, but all columns if none is there."""
    out = project_keys(df, keys)
    return out if out.columns else df


def lines(df: DataFrame, text: str = "text", *keys: str) -> DataFrame:
    """(keys, line, text): one row per line, from 1; an empty piece after the last line end is no line."""
    return df.select(*keys, F.posexplode(lines_of(F.col(text))).alias("_at", "text")).select(*keys, (F.col("_at") + 1).alias("line"), "text")


def grep_lines(df: DataFrame, needle: str, text: str = "text") -> DataFrame:
    return df.where(F.contains(F.lower(text), F.lit(needle.lower())))


def grep_counts(df: DataFrame, needle: str, cap: int, text: str = "text") -> DataFrame:
    """One row: original, matched, kept."""
    return df.agg(F.count("*").alias("original"), F.count_if(F.contains(F.lower(text), F.lit(needle.lower()))).alias("matched")).withColumn("kept", F.least(F.lit(cap).cast("long"), "matched"))


def slice_rows(df: DataFrame, order: list[str], head: int | None = None, tail: int | None = None, limit: int | None = None, seen: Observation | None = None) -> DataFrame:
    """The first `head` rows, else the last `tail`, at most `limit`; in order. Without any of them, all. `seen` counts df's rows."""
    sizes = [n for n in (head or tail, limit) if n is not None]
    if not sizes:
        return df.orderBy(*order)
    n, df = min(sizes), counted(df, seen)
    if not head and tail:
        return df.orderBy(F.struct(*order).desc()).limit(n).orderBy(*order)
    return df.orderBy(F.struct(*order)).limit(n)


def newest(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The newest n rows of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def search_turns(df: DataFrame, needle: str, columns: list[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{needle}%") for c in columns]))


def search_corpus(df: DataFrame, pattern: str, *keys: str, text: str = "text", regex: bool = False, case: bool = True) -> DataFrame:
    """(keys, line, column, text, match): one row per match."""
    found = pattern if regex else re.escape(pattern)
    found = f"(?i){found}" if not case else found
    each = lines(df, text, *keys)
    hit = each.withColumn("text", unmarked(F.col("text"))).where(F.col("text").rlike(found))
    return hit.select(*keys, "line", "text", F.explode(matches(F.col("text"), found)).alias("m")).select(*keys, "line", (F.col("m.at") + 1).cast("int").alias("column"), "text", F.col("m.part").alias("match"))


def relevant_lines(df: DataFrame, words: list[str], keys: list[str], order: str = "line", text: str = "text", budget: int | None = None, ends: int = 24) -> DataFrame:
    """Lines that a question is about: first of equal normalised lines, those with a word and their neighbours, the first and
    last lines; with a budget, up to so many characters for each key."""
    norm = F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")
    once = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, norm).orderBy(order))).where("_r = 1").drop("_r")
    by = Window.partitionBy(*keys).orderBy(order)
    hit = F.exists(F.lit([w.lower() for w in words]), lambda w: F.contains(F.lower(text), w))
    marked = once.withColumn("_hit", hit).withColumn("_near", F.coalesce(F.lag("_hit").over(by), F.lit(False)) | F.coalesce(F.lead("_hit").over(by), F.lit(False)))
    marked = marked.withColumn("_a", F.row_number().over(by)).withColumn("_b", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order))))
    kept = marked.where(F.col("_hit") | F.col("_near") | (F.col("_a") <= ends) | (F.col("_b") <= ends))
    if budget is None:
        return kept.select(*df.columns)
    sofar = F.sum(F.length(text) + 1).over(Window.partitionBy(*keys).orderBy(F.desc("_hit"), F.desc("_near"), order))
    return kept.withColumn("_sum", sofar).where(F.col("_sum") <= budget).select(*df.columns)


def collapse_repeats(df: DataFrame, keys: list[str], order: str, text: str = "text") -> DataFrame:
    """Without lines equal to the one before; first_occurrences() drops all later ones."""
    return previous(df, keys, order, text, "_p").where(F.col("_p").isNull() | (F.col("_p") != F.col(text))).drop("_p")


def first_occurrences(df: DataFrame, keys: list[str], order: str, text: str = "text") -> DataFrame:
    """The first of lines that are equal but for case, space and the ends; blank ones go."""
    norm = F.trim(F.regexp_replace(F.lower(F.col(text)), r"\s+", " "))
    first = Window.partitionBy(*keys, "_norm").orderBy(order)
    return df.withColumn("_norm", norm).where("_norm <> ''").withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r", "_norm")


def find_files(df: DataFrame, name: str, path: str = "path") -> DataFrame:
    """Paths that contain the name or match its glob, entry points first, then depth, then path."""
    glob = "(?i)" + re.escape(name).replace(r"\*", ".*").replace(r"\?", ".")
    base = F.element_at(F.split(path, "/"), -1)
    main = base.rlike(r"(?i)^(?:main|app|index|server|manage|__main__|cli)\.\w+$")
    return df.where(F.col(path).rlike(glob)).withColumn("depth", F.size(F.split(path, "/"))).withColumn("entrypoint", main).orderBy(F.desc("entrypoint"), "depth", path)


def symbols(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, line, kind, name, symbol): functions and classes of Python texts, symbol with the names that it is nested in.

    Nesting is by indent: a definition belongs to the last one before it with a smaller indent, unless a line with no more indent
    than that one stands between. A tab counts as eight; lines that are blank or comments end nothing. Strings over several lines
    are not told from code.
    """
    own = F.regexp_extract_all(F.col(text), F.lit(r"(?m)^[ \t]*[^\s#].*$"), F.lit(0))
    first = F.struct(F.array().cast("array<struct<indent:int,name:string>>").alias("open"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, row: Column) -> Column:
        indent = F.length(F.replace(F.regexp_extract(row, r"^([ \t]*)", 1), F.lit("\t"), F.lit(" " * 8)))
        name = F.regexp_extract(row, r"^\s*(?:async\s+def|def|class)\s+(\w+)", 1)
        within = F.filter(a["open"], lambda o: o["indent"] < indent)
        here = F.struct(indent.cast("int").alias("indent"), name.alias("name"))
        told = F.array_join(F.concat(F.transform(within, lambda o: o["name"]), F.array(name)), ".")
        return F.struct(F.when(name == "", within).otherwise(F.concat(within, F.array(here))).alias("open"), F.when(name == "", a["out"]).otherwise(F.concat(a["out"], F.array(told))).alias("out"))

    names = F.aggregate(own, first, step, lambda a: a["out"])
    # the n-th definition of a text is on its n-th defining line
    places = F.filter(F.transform(lines_of(F.col(text)), lambda x, i: F.struct((i + 1).alias("line"), F.regexp_extract(x, r"^\s*(async\s+def|def|class)\s+\w+", 1).alias("kind"))), lambda x: x["kind"] != "")
    each = df.select(*keys, F.explode(F.arrays_zip(names.alias("symbol"), places.alias("place"))).alias("s"))
    return each.select(*keys, F.col("s.place.line").alias("line"), F.when(F.col("s.place.kind") == "class", "class").otherwise("function").alias("kind"), F.substring_index("s.symbol", ".", -1).alias("name"), F.col("s.symbol").alias("symbol"))


def find_symbol(df: DataFrame, name: str, *keys: str, text: str = "text") -> DataFrame:
    """Definitions of a function or class, with the names they are nested in, and other lines that name it."""
    word = rf"\b{re.escape(name)}\b"
    named = lines(df, text, *keys).where(F.col("text").rlike(word)).withColumn("role", F.when(F.col("text").rlike(rf"^\s*(?:async\s+)?(?:def|class)\s+{re.escape(name)}\b"), "definition").otherwise("reference"))
    where = symbols(df, *keys, text=text).where(F.col("name") == name).select(*keys, "line", "symbol")
    return named.join(where, [*keys, "line"], "left")


def json_schema(df: DataFrame, column: str) -> DataFrame:
    """(key, type, n): top-level keys of JSON objects and the shapes of their values."""
    keys = df.select(F.col(column).alias("j"), F.explode(F.expr(f"json_object_keys(`{column}`)")).alias("key"))
    value = F.expr("get_json_object(j, concat('$.', key))")
    shape = F.when(value.isNull(), "null").when(value.rlike(r"^\s*\{"), "object").when(value.rlike(r"^\s*\["), "array").when(value.isin("true", "false"), "boolean").when(value.rlike(r"^-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?$"), "number").otherwise("string")
    return keys.groupBy("key", shape.alias("type")).agg(F.count("*").alias("n"))


def classify_text(column: Column) -> Column:
    """json, jsonl, table or text."""
    rows = F.filter(F.split(column, "\r?\n"), lambda x: F.trim(x) != "")
    valid = lambda x: is_json(x) & x.rlike(r"^\s*[\[{]")
    width = F.transform(rows, lambda x: F.size(F.split(x, "[,\t;|]")))
    return F.when(valid(column), "json").when((F.size(rows) > 1) & F.forall(rows, valid), "jsonl").when(F.size(rows).between(2, 20_000) & (F.array_min(width) == F.array_max(width)) & (F.array_min(width) > 1), "table").otherwise("text")


def bounded_json(column: Column, depth: int = 8, keys: int = 100, items: int = 50, half: int = 1000) -> Column:
    """JSON text cut to a depth, keys, items and string lengths, with the counts of what was left out; Arrow batches."""
    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        import json

        def bound(x, left: int):
            if isinstance(x, str):
                return x if len(x) <= 2 * half else f"{x[:half]}…({len(x) - 2 * half} left out)…{x[-half:]}"
            if isinstance(x, dict):
                some = list(x.items())[:keys] if left else []
                return {k: bound(v, left - 1) for k, v in some} | ({"…": f"{len(x) - len(some)} keys left out"} if len(x) > len(some) else {})
            if isinstance(x, list):
                some = x[:items] if left else []
                return [bound(v, left - 1) for v in some] + ([f"…{len(x) - len(some)} items left out"] if len(x) > len(some) else [])
            return x

        out = []
        for t in texts:
            try:
                out.append(None if t is None else json.dumps(bound(json.loads(t), depth), ensure_ascii=False))
            except ValueError:
                out.append(t)
        return pd.Series(out, dtype=object)

    return cut(column)


# fixed values: languages by extension
LANGUAGES = {"py": "Python", "js": "JavaScript", "jsx": "JavaScript", "ts": "TypeScript", "tsx": "TypeScript", "java": "Java", "kt": "Kotlin", "go": "Go", "rs": "Rust", "rb": "Ruby", "php": "PHP", "cs": "C#", "c": "C", "h": "C", "cpp": "C++", "swift": "Swift", "scala": "Scala", "sh": "Shell", "sql": "SQL", "html": "HTML", "css": "CSS"}


def languages(df: DataFrame, path: str = "path") -> DataFrame:
    """(language, files, entrypoints): how many files of each language, and which of them start a program."""
    name = F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), F.lower(F.element_at(F.split(path, r"\."), -1)))
    main = F.element_at(F.split(path, "/"), -1).rlike(r"(?i)^(?:main|app|index|server|manage|__main__|cli)\.\w+$")
    return df.select(F.col(path).alias("path"), name.alias("language"), main.alias("main")).where("language is not null").groupBy("language").agg(F.count("*").alias("files"), F.count_if("main").alias("entrypoints"))
