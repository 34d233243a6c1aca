"""Jobs that share a slot of state keep their own order."""

from pyspark.sql import functions as F

from sigmaspark.streaming import ordered, streams


def test_jobs_in_two_slots(spark, monkeypatch):
    monkeypatch.setattr(ordered, "SLOTS", 2)
    states = ["queued", "ready", "queued", "failed"]  # two moves that are not allowed, for each job
    rows = [(10 * job + n, job, s, "x", 1000 + 60 * n) for job in range(20) for n, s in enumerate(states)] + [(999, 99, "queued", "x", 90_000)]
    df = spark.createDataFrame(rows, "event_id long, job long, status string, kind string, t long").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    folder = streams.shared_path(spark)
    df.orderBy(F.desc("event_id")).coalesce(1).write.parquet(folder)
    out = streams.run_once(ordered.transition_violations(streams.file_stream(spark, folder, df.schema), "10 minutes"), "append")
    want = [(j, 10 * j + n, states[n - 1], states[n]) for j in range(20) for n in (1, 2)]
    assert sorted(map(tuple, out.select("job", "event_id", "previous", "status").collect())) == want
