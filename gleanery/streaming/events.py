"""Structured Streaming: windows with late data, deduplicated findings, running counts, retention."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def read_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).load(path)


def with_time(df: DataFrame, column: str = "ts") -> DataFrame:
    """Event time with a zone, as watermarks need it."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def windowed_counts(df: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes", keys: tuple[str, ...] = ("event_type",), column: str = "ts") -> DataFrame:
    timed = with_time(df, column).withWatermark(column, late) if df.isStreaming else with_time(df, column)
    w = F.window(column, size, slide) if slide else F.window(column, size)
    out = timed.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def session_counts(df: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", key: str = "user_id", column: str = "ts") -> DataFrame:
    timed = with_time(df, column).withWatermark(column, late) if df.isStreaming else with_time(df, column)
    out = timed.groupBy(F.session_window(column, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def distinct_in_time(df: DataFrame, keys: list[str], column: str = "ts", late: str = "1 hour") -> DataFrame:
    return with_time(df, column).withWatermark(column, late).dropDuplicatesWithinWatermark(keys)


def stream_grep(df: DataFrame, needle: str, column: str = "text") -> DataFrame:
    """Running count of rows that hold the needle."""
    return df.where(F.contains(F.lower(column), F.lit(needle.lower()))).agg(F.count("*").alias("matched"))


def append_by_project(df: DataFrame, path: str, checkpoint: str, key: str = "project", transform: Callable[[DataFrame], DataFrame] = lambda d: d):
    """Each micro-batch appended under its project; available data once, then stop. A batch that runs twice replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key, "batch").parquet(path)

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def expired(df: DataFrame, ttl: str, now: str, column: str = "ts") -> DataFrame:
    """Rows older than ttl at a moment."""
    return with_time(df, column).where(F.col(column) + F.expr(f"interval {ttl}") <= F.lit(now).cast("timestamp"))


# -- state kept by key; these need the RocksDB state store (spark.sql.streaming.stateStore.providerClass)


def _millis(moment: pd.Timestamp) -> int:
    return int(moment.timestamp() * 1000)


class Expiry(StatefulProcessor):
    """Remembers when each key was last seen; a timer puts it out once the watermark is past that moment and the time to live."""

    def __init__(self, key: str, column: str, ttl_ms: int):
        self.key, self.column, self.ttl_ms = key, column, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = max(_millis(b[self.column].max()) for b in rows)
        before = self.seen.get()[0] if self.seen.exists() else None
        if before is None or newest > before:
            if before is not None:
                self.handle.deleteTimer(before + self.ttl_ms)
            self.seen.update((newest,))
            self.handle.registerTimer(newest + self.ttl_ms)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = self.seen.get()[0]
        self.seen.clear()
        yield pd.DataFrame({self.key: [key[0]], "last_seen": [pd.Timestamp(at, unit="ms", tz="UTC")], "expired_at": [pd.Timestamp(at + self.ttl_ms, unit="ms", tz="UTC")]})

    def close(self) -> None:
        pass


def expire_keys(df: DataFrame, key: str, ttl: pd.Timedelta, late: str = "10 minutes", column: str = "ts") -> DataFrame:
    """A row (key, last_seen, expired_at) for each key that was not seen for `ttl`; a key that is seen again in time is renewed, and
    one that comes back after it went out begins anew. Rows behind the watermark do not count."""
    kind = df.schema[key].dataType.simpleString()
    timed = with_time(df, column).withWatermark(column, late).select(key, column)
    return timed.groupBy(key).transformWithStateInPandas(Expiry(key, column, int(ttl.total_seconds() * 1000)), f"{key} {kind}, last_seen timestamp, expired_at timestamp", "Append", "EventTime")


class Newest(StatefulProcessor):
    """The newest n rows of each key, in state that holds no more than that."""

    def __init__(self, key: str, order: str, n: int, columns: list[str], schema: str):
        self.key, self.order, self.n, self.columns, self.schema = key, order, n, columns, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame([tuple(r) for r in self.kept.get()], columns=self.columns)
        both = pd.concat([x for x in (held, *(b[self.columns] for b in rows)) if len(x)])
        top = both.sort_values([self.order, *[c for c in self.columns if c != self.order]], ascending=False, kind="stable").head(self.n)
        self.kept.put([tuple(r) for r in top.itertuples(index=False)])
        out = top.copy()
        out.insert(0, self.key, key[0])
        out.insert(1, "rank", range(1, len(out) + 1))
        yield out

    def close(self) -> None:
        pass


def newest_by_key(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """After each batch, for the keys that it touched, their newest n rows with a rank. The other columns are numbers or strings."""
    columns = [c for c in df.columns if c != key]
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)
    kind = df.schema[key].dataType.simpleString()
    return df.groupBy(key).transformWithStateInPandas(Newest(key, order, n, columns, schema), f"{key} {kind}, rank long, {schema}", "Update", "None")


def counts_with_late(df: DataFrame, key: str, size: pd.Timedelta, late: str = "10 minutes", column: str = "ts") -> DataFrame:
    """Counts of windows that keep the late: (key, start, n, n_late), put out again whenever they change. A row is late if its window
    had ended by the watermark; it is counted beside the others and never lost, so n and n_late add up to the input.

    State holds a key's open windows; a closed one is forgotten with the next rows of its key, and late rows of it count from
    zero again: sum n_late, take the last n.
    """
    width = int(size.total_seconds() * 1000)
    kind = df.schema[key].dataType.simpleString()

    def count(own, batches, state):
        mark = state.getCurrentWatermarkMs()
        held = dict(zip(*state.get, strict=True)) if state.exists else {}
        new: dict[int, list[int]] = {}
        for b in batches:
            starts = b[column].map(_millis) // width * width
            for start, n in starts.value_counts().items():
                both = new.setdefault(int(start), [0, 0])
                both[start + width <= mark] += int(n)
        for start, (n, _) in new.items():
            held[start] = held.get(start, 0) + n
        out = [(own[0], pd.Timestamp(s, unit="ms", tz="UTC"), held[s] if new[s][0] else 0, new[s][1]) for s in sorted(new)]
        held = {s: n for s, n in held.items() if s + width > mark}
        state.update((list(held), list(held.values())))
        yield pd.DataFrame(out, columns=[key, "start", "n", "n_late"])

    timed = with_time(df, column).withWatermark(column, late).select(key, column)
    return timed.groupBy(key).applyInPandasWithState(count, f"{key} {kind}, start timestamp, n long, n_late long", "starts array<long>, counts array<long>", "update", "NoTimeout")
