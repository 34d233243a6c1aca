"""Versioned tables and streams: restarts, replays, writers that meet."""

import pytest
from pyspark.sql import functions as F

from sigmaspark.operators import lifecycle
from sigmaspark.sources import versioned
from sigmaspark.sources.versioned import VersionedTable
from sigmaspark.streaming import ordered, streams


def add(old, new):
    return old.unionByName(new).groupBy("k").agg(F.sum("n").alias("n"))


def rows(df):
    return sorted((r.k, r.n) for r in df.collect())


def table(spark, buckets=16):
    return VersionedTable(spark, streams.shared_path(spark)).create("k long, n long", ["k"], buckets)


def batch(spark, *pairs):
    return spark.createDataFrame(pairs, "k long, n long")


def test_only_touched_buckets_are_written(spark):
    t = table(spark)
    t.commit(batch(spark, *[(k, 1) for k in range(200)]), add)
    before = t.manifest()
    t.commit(batch(spark, (7, 5), (None, 1)), add)
    after = t.manifest()
    assert sum(before.folders.get(b) != f for b, f in after.folders.items()) <= 2
    assert dict(r for r in rows(t.read().where("k is not null")))[7] == 6 and t.read().count() == 201
    assert t.read(1).count() == 200  # older versions stay readable
    assert t.vacuum() >= 0 and t.read().count() == 201 and len(t.versions()) == 1
    t.commit(batch(spark), add)  # an empty batch
    assert t.read().count() == 201


def test_writers_that_meet(spark, monkeypatch):
    t, other = table(spark, 4), None
    t.commit(batch(spark, *[(k, 1) for k in range(20)]), add)
    put, once = VersionedTable._put, []

    def late(self, m):
        if not once:
            once.append(1)
            VersionedTable(spark, t.path).commit(batch(spark, (3, 10), (4, 10)), add)
        put(self, m)

    monkeypatch.setattr(VersionedTable, "_put", late)
    t.commit(batch(spark, (3, 100)), add)
    got = dict(rows(t.read()))
    assert got[3] == 111 and got[4] == 11 and len(got) == 20 and other is None


@pytest.mark.parametrize("when", ["before", "after"])
def test_restart(spark, monkeypatch, when):
    """The driver dies before or after the version is put in place; the stream begins again and each row counts once."""
    folder = streams.shared_path(spark)
    for b in range(3):
        batch(spark, *[(k, 1) for k in range(b, 20)]).repartition(1).write.parquet(f"{folder}/{b}")
    stream = lambda: streams.file_stream(spark, folder, batch(spark).schema)
    t = table(spark)
    put = VersionedTable._put

    def dies(self, m):
        if m.version == 2:
            if when == "after":
                put(self, m)
            raise RuntimeError("lost")
        put(self, m)

    monkeypatch.setattr(VersionedTable, "_put", dies)
    with pytest.raises(Exception, match="lost"):
        streams.ingest(stream(), lambda b: b, t, add)
    monkeypatch.setattr(VersionedTable, "_put", put)
    again = VersionedTable(spark, t.path)  # nothing is remembered but the folder
    assert rows(streams.ingest(stream(), lambda b: b, again, add)) == [(k, min(k + 1, 3)) for k in range(20)]
    assert len(again.versions()) == 4


def test_merges_of_the_lifecycle(spark):
    t = VersionedTable(spark, streams.shared_path(spark)).create("k long, status string, preview string", ["k"], 4)
    t.commit(spark.createDataFrame([(1, "old", "p"), (2, "old", None)], "k long, status string, preview string"), lambda old, new: new)
    t.commit(spark.createDataFrame([(1, "new", None), (3, "new", "q")], "k long, status string, preview string"), lambda old, new: lifecycle.merge_keep(old, new, ["k"], ["preview"]))
    assert sorted(map(tuple, t.read().collect())) == [(1, "new", "p"), (2, "old", None), (3, "new", "q")]
    with pytest.raises(ValueError, match="moved"):
        t.commit(spark.createDataFrame([(1, "x", "y")], "k long, status string, preview string"), lambda old, new: old.withColumn("k", F.col("k") + 1000))


EVENTS = "event_id long, job long, status string, kind string, ts timestamp"


def test_order_survives_files_and_restarts(spark):
    """Rows of a job lie in files out of order; a restart lies between them; one is too late."""
    states = ["queued", "validating", "failed", "processing", "ready", "queued", "ready"]
    row = lambda n, status: spark.createDataFrame([(n, 1, status, "x")], "event_id long, job long, status string, kind string").withColumn("ts", F.timestamp_seconds(F.lit(n * 60)))
    folder, path = streams.shared_path(spark), streams.shared_path(spark)
    out = None
    for turn in ([1, 0, 3, 2], [6, 4, 5], [400], [9], [800], [1200]):
        for n in turn:
            row(n, states[n] if n < len(states) else "late" if n == 9 else "queued").repartition(1).write.parquet(f"{folder}/{turn[0]:04d}-{n}")
        stream = ordered.transition_violations(streams.file_stream(spark, folder, row(0, "queued").schema), "10 minutes")
        out = streams.run_once(stream, "append", path=path)
    got = sorted((r.event_id, r.previous, r.status) for r in out.collect())
    want = [(n, a, b) for n, (a, b) in enumerate(zip(states, states[1:], strict=False), 1) if b not in lifecycle.NEXT.get(a, [])]
    assert got == sorted([*want, (400, "ready", "queued")])


def test_leases_by_timers(spark):
    at = [(1, "a", "claim", 0), (2, "b", "claim", 10), (3, "a", "renew", 50), (4, "b", "renew", 60), (5, "b", "claim", 200), (6, "a", "complete", 210), (7, "b", "complete", 220), (8, "c", "claim", 230)]
    rows_ = [(n, 1, w, k, t) for n, w, k, t in at] + [(99, 2, "z", "claim", 5000)]
    df = spark.createDataFrame(rows_, "event_id long, task long, worker string, kind string, t long").withColumn("ts", F.timestamp_seconds(F.col("t") + 1000)).drop("t")
    folder = streams.shared_path(spark)
    df.repartition(1).write.parquet(folder)
    out = streams.run_once(ordered.lease_watch(streams.file_stream(spark, folder, df.schema), 100, "10 seconds"), "append")
    got = {(r.event_id, r.worker, r.outcome, r.at_us // 1_000_000 - 1000) for r in out.collect()}
    assert got == {(2, "b", "refused", 10), (4, "b", "lost", 60), (None, "a", "expired", 150), (6, "a", "lost", 210), (None, "c", "expired", 330)}


def test_conflicts_are_told(spark):
    t = table(spark)
    with pytest.raises(versioned.Conflict):
        t._put(t.manifest())
