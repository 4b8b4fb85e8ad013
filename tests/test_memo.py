import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from deskline.operators import memo
from deskline.sources.schemas import MEMO, RESULT

DAY = dt.timedelta(days=1)
START = dt.datetime(2024, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame(rows, "request_id long, key string, ts timestamp_ntz")


def brute_force(rows, ttl=7 * DAY, prior=()):
    """Request by request, in time order."""
    written = {}
    for key, at in prior:
        written[key] = max(at, written.get(key, at))
    hits = {}
    for rid, key, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        hits[rid] = key in written and ts < written[key] + ttl
        if not hits[rid]:
            written[key] = ts
    return hits


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    made = []
    for i in range(1500):
        key = "hot" if i % 3 == 0 else f"k{rnd.randrange(60)}"
        # Whole hours: many equal times and exact expiries.
        made.append((i, key, START + dt.timedelta(hours=rnd.randrange(24 * 80))))
    return made


@pytest.mark.parametrize("partitions", [None, 3, 40])
def test_hits_equal_a_request_by_request_memo(spark, rows, partitions):
    got = {r.request_id: r.hit for r in memo.with_hits(frame(spark, rows), partitions=partitions).collect()}
    assert got == brute_force(rows)


@pytest.mark.parametrize("partitions", [2, 30])
def test_entries_from_before_the_batch(spark, rows, partitions):
    prior = [("hot", START - 3 * DAY), ("hot", START - 9 * DAY), ("k1", START - 7 * DAY), ("k2", START - 6 * DAY), ("zz", START)]
    before = spark.createDataFrame(prior, "key string, written_at timestamp_ntz")
    got = {r.request_id: r.hit for r in memo.with_hits(frame(spark, rows), prior=before, partitions=partitions).collect()}
    assert got == brute_force(rows, prior=prior)


def test_lifetime_is_fixed_and_ends_exactly(spark):
    rows = [(i, "k", START + i * 4 * DAY) for i in range(4)] + [(9, "x", START), (10, "x", START + 7 * DAY)]
    got = {r.request_id: r.hit for r in memo.with_hits(frame(spark, rows)).collect()}
    # 0 miss, day 4 hit, day 8 miss (not refreshed on day 4), day 12 hit; exactly 7 days: gone.
    assert got == {0: False, 1: True, 2: False, 3: True, 9: False, 10: False}


def test_a_minute_to_live_over_a_month(spark):
    """One key with nearly all requests, over many tasks: 43,200 lifetimes, and pieces both longer and shorter than one."""
    rnd = random.Random(8)
    made = [(i, "hot" if i % 50 else None, START + dt.timedelta(seconds=rnd.randrange(30 * 86400))) for i in range(6000)]
    made += [(10_000 + i, "hot", START + 40 * DAY + dt.timedelta(seconds=i % 150)) for i in range(3000)]
    got = {r.request_id: r.hit for r in memo.with_hits(frame(spark, made), ttl=60, partitions=25).collect()}
    assert got == brute_force(made, ttl=dt.timedelta(seconds=60))


@pytest.mark.parametrize("ttl", [1, 3, 10])
def test_many_equal_times(spark, ttl):
    rnd = random.Random(ttl)
    made = [(i, rnd.choice("ab"), START + dt.timedelta(seconds=rnd.randrange(40))) for i in range(400)]
    got = {r.request_id: r.hit for r in memo.with_hits(frame(spark, made), ttl=ttl, partitions=15).collect()}
    assert got == brute_force(made, ttl=dt.timedelta(seconds=ttl))


def test_no_task_holds_much_of_a_heavy_key(spark):
    """90 % of the requests have one key, and 90 % of the entries another."""
    asked = spark.range(20_000).selectExpr("id as request_id", "if(id % 10 = 0, 'b', 'a') as key", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id) as ts")
    written = asked.selectExpr("if(key = 'a', 'b', 'a') as key", "ts as written_at", "struct(request_id as v) as result")
    found = memo.looked_up(asked, written, partitions=20)
    assert found.count() == 20_000 and found.where("hit").count() > 19_000
    sizes = [r["n"] for r in asked.repartitionByRange(20, "key", "ts").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 2_500


def test_no_requests(spark):
    assert memo.with_hits(frame(spark, [])).count() == 0


@pytest.mark.parametrize("partitions", [None, 7, 60])
def test_lookup_finds_the_last_live_entry(spark, rows, partitions):
    rnd = random.Random(6)
    writes = [(rnd.choice(["hot", "k1", "k2", "k3", "none"]), START + dt.timedelta(hours=rnd.randrange(24 * 80))) for _ in range(150)]
    writes = sorted(set(writes))
    entries = spark.createDataFrame(writes, "key string, written_at timestamp_ntz").select(
        "key", "written_at", F.struct(F.col("written_at").cast("string").alias("v")).alias("result")
    )
    got = memo.looked_up(frame(spark, rows).withColumn("extra", F.lit(1)), entries, partitions=partitions).collect()
    assert len(got) == len(rows)
    for r in got:
        seen = [at for key, at in writes if key == r.key and at <= r.ts]
        live = max(seen) if seen and r.ts < max(seen) + 7 * DAY else None
        assert (r.hit, r.written_at) == (live is not None, live) and r.extra == 1
        assert (r.result.v if r.result else None) == (str(live) if live else None)


def test_lookup_agrees_with_the_fold_when_entries_are_the_misses(spark, rows):
    requests = frame(spark, rows)
    entries = memo.misses(requests).select(
        "key", F.col("ts").alias("written_at"), F.struct("request_id").alias("result"), F.col("request_id").alias("entry_id")
    )
    got = {r.request_id: r.hit for r in memo.looked_up(requests, entries).collect()}
    assert got == brute_force(rows)


def test_live_invalidated_and_stats(spark):
    entries = spark.createDataFrame(
        [("a", START), ("a", START + 3 * DAY), ("b", START), ("c", START + 20 * DAY)], "key string, written_at timestamp_ntz"
    )
    at = F.lit("2024-01-09 00:00:00").cast("timestamp_ntz")
    assert [(r.key, r.written_at) for r in memo.live_entries(entries, at).collect()] == [("a", START + 3 * DAY)]
    keys = spark.createDataFrame([("a",), ("a",)], "key string")
    assert sorted(r.key for r in memo.invalidated(entries, keys).collect()) == ["b", "c"]
    flagged = spark.createDataFrame([(True,)] * 1 + [(False,)] * 15, "hit boolean")
    assert tuple(memo.cache_stats(flagged, entries, at).first()) == (1, 15, 6.2, 1)
    assert tuple(memo.hit_rate(flagged.where("false")).first()) == (0, 0, 0.0)


def test_results_as_text_and_back(spark):
    result = ("Network Issue", 0.5, None, ["a"], [("7", None, 0.25)])
    entries = spark.createDataFrame([("k", START, result)], MEMO)
    text = memo.as_text(entries)
    assert text.first().result.startswith('{"category":"Network Issue","confidence":0.5')
    assert memo.from_text(text, RESULT).first().result == entries.first().result
