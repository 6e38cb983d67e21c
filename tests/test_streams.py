"""Streams of more batches than a query's progress tells of, and of none."""

import datetime

from terrane.streaming import upsert


def test_many_batches(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    kind = pa.schema([("ts", pa.timestamp("us")), ("event_type", pa.string()), ("value", pa.float64())])
    for k in range(12):
        at = datetime.datetime(2024, 1, 1, k)
        pq.write_table(pa.table({"ts": [at], "event_type": ["x"], "value": [float(k)]}, schema=kind), tmp_path / f"{k:02}.parquet")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    stream = upsert._stream
    try:
        upsert._stream = lambda s, p: s.readStream.schema(s.read.parquet(p).schema).option("maxFilesPerTrigger", 2).parquet(p)
        got = upsert.windows(spark, str(tmp_path), "1 hour").collect()
        kept = upsert.replay(spark, str(tmp_path), ["event_type", "ts", "value"], "event_type", ["ts"]).collect()
    finally:
        upsert._stream = stream
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    assert len(got) == 12 and sum(r.total for r in got) == 66
    assert [r.value for r in kept] == [11.0]


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], "ts timestamp, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/none")
    assert upsert.windows(spark, f"{tmp_path}/none", "1 hour").collect() == []
