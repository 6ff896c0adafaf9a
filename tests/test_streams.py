"""State by key in streams: expiry with renewal and late rows, newest rows, counts that keep the late."""

import collections

import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from gleanery.operators import query
from gleanery.streaming import events

T0 = pd.Timestamp("2024-01-01 00:00:00")
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(PROVIDER)


def fed(spark, tmp_path, batches, schema, build):
    """What each batch puts out; one file of rows a batch."""
    source, out = tmp_path / "in", []
    source.mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    started = build(stream)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/made{i}")
        (made,) = (tmp_path / f"made{i}").glob("part-*.parquet")
        made.rename(source / f"{i:03}.parquet")
        got: list[Row] = []
        mode, frame = started
        q = frame.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda b, _, got=got: got.extend(b.collect())).trigger(availableNow=True).start()
        q.awaitTermination(120)
        out.append(got)
    return out


def at(minutes):
    return (T0 + pd.Timedelta(minutes=minutes)).to_pydatetime()


def test_keys_expire_are_renewed_and_come_back(rocks, tmp_path):
    batches = [[("a", at(0)), ("b", at(1))], [("a", at(50))], [("c", at(75))], [("b", at(2)), ("d", at(130))], [("b", at(140))], [("d", at(300))]]
    out = fed(rocks, tmp_path, batches, "k string, ts timestamp", lambda s: ("append", events.expire_keys(s, "k", pd.Timedelta(minutes=60), "5 minutes")))
    got = [(r.k, r.last_seen, r.expired_at) for some in out for r in some]
    # b at minute 2 is behind the watermark by then and renews nothing; b at 140 begins anew
    want = [("a", at(50)), ("b", at(1)), ("b", at(140)), ("c", at(75))]
    assert sorted(got) == sorted((k, t, t + pd.Timedelta(minutes=60).to_pytimedelta()) for k, t in want)


def test_state_holds_the_newest(rocks, tmp_path):
    batches = [[("a", i, f"x{i}") for i in range(5)] + [("b", 1, "y")], [("a", 2, "late"), ("a", 9, "z")], [("b", 0, "w"), ("b", 3, "v"), ("b", 4, "u")]]
    out = fed(rocks, tmp_path, batches, "k string, n int, v string", lambda s: ("update", events.newest_by_key(s, "k", "n", 3)))
    seen, now = [], {}
    for some, got in zip(batches, out, strict=True):
        seen += some
        now.update({k: sorted((r.rank, r.n) for r in got if r.k == k) for k in {r.k for r in got}})
        frame = query.newest(rocks.createDataFrame(seen, "k string, n int, v string"), ["k"], "n", 3).collect()
        want = collections.defaultdict(list)
        for r in sorted(frame, key=lambda r: -r.n):
            want[r.k].append((len(want[r.k]) + 1, r.n))
        assert now == dict(want)


def test_late_rows_are_counted(spark, tmp_path):
    batches = [[("a", at(1)), ("a", at(2)), ("b", at(3))], [("a", at(61))], [("a", at(4)), ("b", at(5)), ("a", at(59))], [("b", at(200)), ("a", at(62))], [("a", at(3)), ("b", at(6))]]
    out = fed(spark, tmp_path, batches, "k string, ts timestamp", lambda s: ("update", events.counts_with_late(s, "k", pd.Timedelta(minutes=10), "5 minutes")))
    last, late = {}, collections.Counter()
    for some in out:
        for r in some:
            if r.n:
                last[(r.k, r.start)] = r.n
            late[r.k] += r.n_late
    assert sum(last.values()) + sum(late.values()) == sum(map(len, batches)) and late["a"] > 0 and late["b"] > 0


def test_caps_tell_what_they_left_out(spark):
    from pyspark.sql import Observation

    df = spark.range(100).withColumn("k", F.col("id") % 7)
    assert query.query(df, "SELECT id FROM data").count() == 100 and query.slice_rows(df, ["id"]).count() == 100
    seen = Observation()
    assert [r.id for r in query.query(df, "SELECT id FROM data", 3, seen=seen).collect()] == [0, 1, 2] and query.omitted(seen, 3) == 97
    seen = Observation()
    assert query.slice_rows(df, ["id"], tail=10, limit=4, seen=seen).count() == 4 and query.omitted(seen, 4) == 96
