"""Streams against the same operators in batch, and bounded state."""

import datetime as dt

from pyspark.sql import functions as F

from kvloom.operators import strings
from kvloom.sources import views as V
from kvloom.streaming import keyspace as K


def split_events(spark, data, tmp_path, files):
    """The events in several files, read one a batch."""
    events = spark.read.parquet(f"{data}/events.parquet").orderBy("event_id")
    n = events.count()
    for i in range(files):
        part = events.where(F.floor(F.col("event_id") * files / n) == i).coalesce(1)
        part.write.mode("append").parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_keyspace_over_batches(spark, data, tmp_path):
    folder = split_events(spark, data, tmp_path, 3)
    stream = K.keep_last(K.commands(K.source(spark, folder)))
    got = K.last_versions(K.drain(spark, stream, "update"), "key").collect()
    log = V.log(spark, data).withColumn("value", F.col("op"))
    want = strings.last_write(log).join(log.groupBy("key").agg(F.count(F.lit(1)).alias("writes")), "key").collect()
    assert sorted((r.key, r.value, r.writes) for r in got) == sorted((r.key, r.value, r.writes) for r in want)


def test_dedupe_with_bounded_state(spark, tmp_path):
    at = dt.datetime(2024, 1, 1, 12)
    rows = [(i, at + dt.timedelta(minutes=i)) for i in (0, 1, 1, 2, 0, 3)]
    spark.createDataFrame(rows, "seq long, at timestamp").coalesce(1).write.parquet(f"{tmp_path}/log.parquet")
    source = K.source(spark, str(tmp_path), "log")
    out = K.drain(spark, K.deduped(source, "seq", "at").select("seq"))
    assert sorted(r.seq for r in out.collect()) == [0, 1, 2, 3]
