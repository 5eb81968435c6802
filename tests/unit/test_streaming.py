"""Streams give what the batch operators give."""

import datetime as dt

from pyspark.sql import functions as F

from wicker.operators import queue
from wicker.streaming import jobs

T0 = dt.datetime(2024, 1, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def drained(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return [tuple(r) for r in spark.table(name).collect()]


def stream(spark, tmp_path, rows, schema):
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_deliveries(spark, tmp_path):
    s = stream(spark, tmp_path, [[(1, at(0)), (2, at(1)), (1, at(2))], [(1, at(3)), (3, at(4))]], "delivery_id long, received_at timestamp")
    assert sorted(r[0] for r in drained(spark, jobs.first_deliveries(s), "deliveries")) == [1, 2, 3]


def test_debounce(spark, tmp_path):
    rows = [("a.py", at(0)), ("x.swp", at(0.2)), ("x.swp", at(5)), ("b.py", at(10))]
    s = stream(spark, tmp_path, [rows, [("end.py", at(1000))], [("end.py", at(2000))]], "path string, ts timestamp")
    wanted = queue.watched(F.col("path"), ("py",))
    got = drained(spark, jobs.debounced(s, "ts", wanted, "300 milliseconds", "1 second").select("n_events", "n_wanted"), "bursts")
    batch = queue.debounced(spark.createDataFrame(rows, "path string, ts timestamp"), "ts", wanted).select("n_events", "n_wanted")
    assert sorted(map(tuple, batch.collect())) == [(1, 1), (2, 1)]
    assert sorted(got) == [(1, 1), (1, 1), (2, 1)]  # and the first of the two later events, which the second one ended


def test_leases(spark, tmp_path):
    parts = [[(1, at(0), "a", "claim"), (2, at(0), "a", "claim")], [(1, at(30), "a", "renew"), (2, at(10), "a", "done")], [(9, at(500), "z", "claim")], [(9, at(501), "z", "renew")]]
    s = stream(spark, tmp_path, parts, "job_id long, ts timestamp, owner string, what string")
    got = set(drained(spark, jobs.leases(s), "leases"))
    assert {(1, "claimed", "a"), (2, "claimed", "a"), (2, "done", "a"), (9, "claimed", "z")} <= got and (2, "reclaimed", "a") not in got
    assert (1, "reclaimed", "a") in got
