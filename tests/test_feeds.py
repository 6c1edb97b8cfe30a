"""Feeds over tables of more files than one batch takes."""

from collections import Counter

from pyspark.sql import functions as F

from vinctum.streaming import feeds


def _parts(spark, path, name, rows, schema):
    """A table of 20 files, in no order, each written twice."""
    for i in range(20):
        spark.createDataFrame(rows[(7 * i) % 20 :: 20] * 2, schema).coalesce(1).write.mode("append").parquet(f"{path}/{name}.parquet")


def test_feed_keeps_late_rows_and_each_id_once(spark, tmp_path):
    # an id comes again 100 hours later, in another file
    rows = [(i % 100, f"2024-01-{1 + i // 24 % 28:02d} {i % 24:02d}:00:00", "error") for i in range(200)]
    _parts(spark, tmp_path, "events", rows, "event_id long, ts string, event_type string")
    s = feeds.read_table_stream(spark, str(tmp_path), "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = feeds.case_feed(s, "event_id", "event_type = 'error'")
    out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(100))


def test_refresh_writes_a_content_once_over_all_batches(spark, tmp_path):
    rows = [(i, f"h{i % 30}") for i in range(200)]
    _parts(spark, tmp_path, "pages", rows, "page_id long, content_hash string")
    seen = spark.createDataFrame([("h3",)], "content_hash string")
    feeds.refresh(feeds.read_table_stream(spark, str(tmp_path), "pages"), seen, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.select("epoch").distinct().count() > 1
    assert sorted(r.content_hash for r in got.collect()) == sorted(f"h{i}" for i in range(30) if i != 3)


def test_state_is_bounded_and_no_row_is_lost_over_fifty_batches(spark, tmp_path):
    """Ids come twice, in another batch and out of order; with keep_days the state holds the last days only."""
    schema = "event_id long, ts timestamp, event_type string"
    for i in range(50):
        day = lambda k: f"2024-{1 + k // 28:02d}-{1 + k % 28:02d} 10:00:00"  # noqa: B023, E731
        rows = [(20 * i + k, day(2 * i), "error") for k in range(20)] + [(20 * (i - 1) + k, day(2 * i - 2), "error") for k in range(20) if i] + [(None, day(2 * i), "error")]
        spark.createDataFrame(rows, "event_id long, ts string, event_type string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i:02d}.parquet")
        if i == 0:
            (tmp_path / "in" / "events.parquet").mkdir()
    stream = spark.readStream.schema("event_id long, ts string, event_type string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    sizes, rows = [], []
    q = feeds.case_feed(stream, "event_id", "event_type = 'error'", "ts", keep_days=6).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
    q.awaitTermination()
    for p in q.recentProgress:
        if p.numInputRows:
            rows.append(p.numInputRows)
            sizes.append(p.stateOperators[0].memoryUsedBytes)
    got = [r.event_id for r in spark.read.schema(schema).parquet(f"{tmp_path}/out").collect()]
    assert sorted(got) == list(range(1000))
    assert len(rows) >= 40 and max(rows) <= 41
    half = len(sizes) // 2
    assert max(sizes[half:]) < 1.3 * max(sizes[5:half])


def test_notifications_of_three_streams_once_each(spark, tmp_path):
    links = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "case_id long, user_id long")
    sources = {}
    for kind, n in (("match", 4), ("evidencia", 6), ("mensaje", 3)):
        for part in range(3):  # the third part is replayed
            spark.createDataFrame([(1 + i % 3, f"e{i}", "2024-01-01 00:00:00") for i in range(n) if part == 2 or i % 2 == part], "case_id long, event_id string, at string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{kind}.parquet")
        sources[kind] = (feeds.read_table_stream(spark, str(tmp_path), kind, 1), f"nuevo {kind}")
    feeds.notify(sources, links, f"{tmp_path}/out", f"{tmp_path}/state", keep_days=30).awaitTermination()
    got = sorted((r.kind, r.event, r.user_id) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    want = sorted((k, f"{k}|e{i}", u) for k, n in (("match", 4), ("evidencia", 6), ("mensaje", 3)) for i in range(n) for c, u in ((1, 10), (1, 11), (2, 12)) if c == 1 + i % 3)
    assert got == want


def test_rows_written_once_give_the_notifications_and_their_counts(spark, tmp_path):
    links = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (2, None), (7, 1), (None, 3)], "case_id long, user_id long")
    sources = {}
    for kind, n in (("match", 5), ("mensaje", 40)):
        for part in range(2):  # the second part is a replay
            spark.createDataFrame([(1 + i % 3, f"e{i}", "2024-01-01 00:00:00") for i in range(n)], "case_id long, event_id string, at string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{kind}.parquet")
        sources[kind] = (feeds.read_table_stream(spark, str(tmp_path), kind, 1), kind)
    feeds.notify(sources, links, f"{tmp_path}/out", f"{tmp_path}/state", keep_days=30, expand=False).awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out").select("case_id", "kind", "text", "event")
    assert rows.count() == 45  # not one per row and user
    all_of = [(1 + i % 3, k, u) for k, n in (("match", 5), ("mensaje", 40)) for i in range(n) for c, u in ((1, 10), (1, 11), (2, 12), (2, None)) if c == 1 + i % 3]
    assert sorted(((r.case_id, r.kind, r.user_id) for r in feeds.notified(rows, links).collect()), key=repr) == sorted(all_of, key=repr)
    assert {(r.case_id, r.kind): r.n for r in feeds.count_notified(rows, links).collect()} == Counter(x[:2] for x in all_of)
