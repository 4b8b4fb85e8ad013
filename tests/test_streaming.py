import datetime as dt
import time

import pytest
from pyspark.sql import functions as F
from tests.conftest import SMALL

from deskline.operators import analytics, corrections, keywords, memo
from deskline.operators.intake import accepted, with_texts
from deskline.streaming import jobs
from registered.views import Given


@pytest.fixture(scope="module")
def given(spark):
    return Given(spark, SMALL)


def files_in_time_order(df, by, path, n=3):
    """n files, the earlier rows in the earlier file."""
    bounds = df.approxQuantile(by, [i / n for i in range(1, n)], 0.0) if dict(df.dtypes)[by] in ("bigint", "double") else None
    bounds = [float("-inf"), *bounds, float("inf")]
    for low, high in zip(bounds, bounds[1:]):
        df.where((F.col(by) > low) & (F.col(by) <= high)).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are taken in order of their modification time
    return path


def test_intake_equals_batch(spark, given, tmp_path):
    source = files_in_time_order(given.intake(), "id", str(tmp_path / "in"))
    stream = jobs.file_stream(spark, source, given.intake().schema, files_per_batch=1)
    query = jobs.intake(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    assert len(query.recentProgress) >= 3
    got = spark.read.parquet(str(tmp_path / "out")).drop("status")
    want = keywords.classify_by_keywords(with_texts(accepted(given.intake())), "full_text")
    assert got.count() == want.count() and got.exceptAll(want.select(got.columns)).count() == 0


def test_memo_over_several_batches_equals_batch(spark, given, tmp_path):
    requests = given.requests()
    source = files_in_time_order(requests, "request_id", str(tmp_path / "in"), 4)
    stream = jobs.file_stream(spark, source, requests.schema, files_per_batch=1)
    query = jobs.memo(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "hits"))
    assert got.select("batch").distinct().count() == 4
    # The state has one row per key, and none that is gone by the end of its batch.
    state = spark.read.parquet(str(tmp_path / "out" / "alive" / "batch=3"))
    now = requests.agg(F.max("ts")).first()[0]
    assert state.groupBy("key").count().where("count > 1").isEmpty() and 0 < state.count() <= requests.select("key").distinct().count()
    assert state.where(F.col("written_at") <= F.lit(now - dt.timedelta(days=7))).isEmpty()
    want = memo.with_hits(requests)
    assert got.select(want.columns).exceptAll(want).count() == 0 and got.count() == want.count()


def test_corrections_over_several_batches_equal_batch(spark, given, tmp_path):
    feed = given.corrections()
    source = files_in_time_order(feed, "ticket_id", str(tmp_path / "in"))
    stream = jobs.file_stream(spark, source, feed.schema, files_per_batch=1)
    jobs.corrections(stream, given.tickets(), str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    log = spark.read.parquet(str(tmp_path / "log"))
    want_log = corrections.feedback_rows(given.tickets(), feed)
    assert log.drop("batch").exceptAll(want_log).count() == 0 and log.count() == want_log.count()
    got, want = jobs.current_tickets(given.tickets(), log), corrections.corrected_tickets(given.tickets(), feed)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_first_seen_keeps_one_row_per_key(spark, given, tmp_path):
    requests = given.requests().withColumn("ts", F.col("ts").cast("timestamp"))
    source = files_in_time_order(requests, "request_id", str(tmp_path / "in"))
    stream = jobs.file_stream(spark, source, requests.schema, files_per_batch=1)
    jobs.first_seen(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "60 days").awaitTermination()
    windows = jobs.first_seen_now(spark, str(tmp_path / "out"))
    assert windows.groupBy("key", "period_start").count().where("count > 1").isEmpty()
    got = windows.groupBy("key").agg(F.min("ts").alias("ts"))
    want = requests.groupBy("key").agg(F.min("ts").alias("ts"))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_windows_and_totals_equal_batch(spark, given, tmp_path):
    tickets = given.tickets().withColumn("created_at", F.col("created_at").cast("timestamp"))
    source = files_in_time_order(tickets, "id", str(tmp_path / "in"))

    def stream():
        return jobs.file_stream(spark, source, tickets.schema, files_per_batch=1)

    for days, period in ((7, "week"), (1, "day")):
        out = str(tmp_path / f"w{days}")
        jobs.accuracy_windows(stream(), out, out + "cp", days).awaitTermination()
        want = analytics.accuracy_by_period(given.tickets(), period).drop("accuracy")
        assert sorted(map(tuple, jobs.latest_version(spark, out).collect())) == sorted(map(tuple, want.collect()))
    out = str(tmp_path / "closed")
    jobs.accuracy_windows(stream(), out, out + "cp", 7, "1 day", "append").awaitTermination()
    closed = sorted(map(tuple, spark.read.parquet(out).drop("v").collect()))
    weeks = sorted(map(tuple, analytics.accuracy_by_period(given.tickets()).drop("accuracy").collect()))
    assert len(closed) >= len(weeks) - 2 and closed == weeks[: len(closed)]
    out = str(tmp_path / "totals")
    jobs.running_totals(stream(), out, out + "cp").awaitTermination()
    got = {r.category: (r.tickets, r.mean_confidence) for r in jobs.latest_version(spark, out).collect()}
    want = {r.category: r for r in analytics.totals_by_category(given.tickets()).collect()}
    assert got.keys() == want.keys()
    for c, (n, mean) in got.items():
        assert n == want[c].tickets
        assert mean == (pytest.approx(want[c].confidence_sum / want[c].confidence_n) if want[c].confidence_n else None)
