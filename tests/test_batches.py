"""The store: all or nothing, repeated batches, merge on read, waiting corrections; the jobs that write it."""

import pytest
from pyspark.sql import functions as F
from tests.conftest import SMALL
from tests.test_streaming import files_in_time_order

from deskline.operators import corrections, memo, vectors
from deskline.plans import classify as plan
from deskline.plans import store as jobs
from deskline.sources import schemas
from deskline.sources.store import Store
from deskline.streaming import jobs as streams
from registered.views import Given


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


@pytest.fixture(scope="module")
def asked(spark):
    given = Given(spark, SMALL)
    vectors_ = given.table("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return given.intake().where("id < 90").join(vectors_, "id", "left")


@pytest.fixture(scope="module")
def answers(spark):
    return Given(spark, SMALL).answers()


def rows(df):
    return sorted(map(repr, df.collect()))


def some_vectors(spark, ids, text="d"):
    return vectors.vector_rows(
        spark.createDataFrame([(str(i), f"{text} {i}", "Network Issue", [float(i), 1.0]) for i in ids], "id string, document string, category string, embedding array<float>")
    )


def test_two_batches_equal_one(spark, asked, answers, store, tmp_path):
    halves = [asked.where("id < 45"), asked.where("id >= 45")]
    for batch, part in enumerate(halves):
        jobs.store_tickets(store, batch, part, answers)
    jobs.store_tickets(store, 1, halves[1], answers)  # repeated: replaces itself
    one = Store(spark, str(tmp_path / "one"))
    jobs.store_tickets(one, 0, asked, answers)
    for table in ("tickets", "memo", "refused"):
        assert rows(store.read(table)) == rows(one.read(table)) != []
    assert rows(store.vectors()) == rows(one.vectors())
    # An earlier batch repeated sees what it saw, not what came later.
    jobs.store_tickets(store, 0, halves[0], answers)
    assert rows(store.tickets()) == rows(one.tickets())
    store.compact()
    assert len(store.manifests()) == 1 and rows(store.tickets()) == rows(one.tickets()) and rows(store.read("memo")) == rows(one.read("memo"))


def test_an_unfinished_batch_is_not_seen(spark, store, monkeypatch):
    jobs.store_vectors(store, 0, some_vectors(spark, [1]))
    create = type(spark).createDataFrame

    def dies(self, data, *rest, **more):
        if rest and rest[0] == schemas.MANIFEST:
            raise RuntimeError("lost")
        return create(self, data, *rest, **more)

    monkeypatch.setattr(type(spark), "createDataFrame", dies)
    with pytest.raises(RuntimeError):
        jobs.store_vectors(store, 1, some_vectors(spark, [1, 2], "new"))
    monkeypatch.undo()
    assert [r["document"] for r in store.vectors().collect()] == ["d 1"]
    jobs.store_vectors(store, 1, some_vectors(spark, [1, 2], "new"))
    assert sorted(r["document"] for r in store.vectors().collect()) == ["new 1", "new 2"]


def test_vectors_are_folded_on_read(spark, store):
    jobs.store_vectors(store, 0, some_vectors(spark, range(6)))
    many = some_vectors(spark, [1, 9], "a").withColumn("turn", F.lit(1)).unionByName(some_vectors(spark, [1], "b").withColumn("turn", F.lit(2)))
    jobs.store_vectors(store, 1, many, "turn")
    jobs.delete_vectors(store, 2, spark.createDataFrame([("2",), ("2",), ("9",), ("77",)], "id string"))
    jobs.store_vectors(store, 3, some_vectors(spark, [2], "c"))
    want = {"0": "d 0", "1": "b 1", "2": "c 2", "3": "d 3", "4": "d 4", "5": "d 5"}
    found = lambda before=None: {r["id"]: r["document"] for r in store.vectors(before).collect()}
    assert found() == want and "2" not in found(3) and found(2)["9"] == "a 9"
    store.compact()
    assert found() == want
    with pytest.raises(ValueError):
        jobs.store_vectors(store, 2, some_vectors(spark, [1]))
    jobs.delete_vectors(store, 4, spark.createDataFrame([("0",)], "id string"))
    assert found() == {k: v for k, v in want.items() if k != "0"}


def test_an_empty_store(store):
    assert store.tickets().isEmpty() and store.vectors().isEmpty() and store.pending().isEmpty() and store.manifests() == []
    store.compact()
    with pytest.raises(ValueError):
        store.commit(0, {"unknown": store.pending()})


def test_corrections_wait_for_their_tickets(spark, store, seeds):
    late = [("c1", "4", "Network Issue", None, "2024-01-02"), ("c2", "4", "Battery Issue", "x", "2024-01-03"), ("c3", "99", "Battery Issue", None, "2024-01-02"),
            ("c4", "1", "Billing", None, "2024-01-02"), ("c5", "1", "General Question", None, "2024-01-05")]
    feed = spark.createDataFrame(late, "correction_id string, ticket_id string, corrected_category string, feedback string, at string")
    feed = feed.withColumn("corrected_at", F.col("at").cast("timestamp_ntz"))
    jobs.store_corrections(store, 0, feed, seeds.where("id < 3"))
    assert sorted(r["correction_id"] for r in store.pending().collect()) == ["c1", "c2", "c3"]
    jobs.store_corrections(store, 1, feed.where("false"), seeds.where("id >= 3"))
    jobs.store_corrections(store, 1, feed.where("false"), seeds.where("id >= 3"))
    assert rows(store.tickets()) == rows(corrections.corrected_tickets(seeds, feed).select(store.tickets().columns))
    assert rows(store.read("feedback")) == rows(corrections.feedback_rows(seeds, feed).select(store.read("feedback").columns))
    assert [(r["id"], r["problem"]) for r in store.read("refused").collect()] == [("c4", "unknown category")]
    assert [(r["id"], r["problem"]) for r in jobs.still_pending(store).collect()] == [("c3", "ticket not found")]
    store.compact()
    assert store.tickets().where("status = 'corrected'").count() == 5 and store.pending().count() == 1


def test_ticket_stream_fills_the_store(spark, asked, answers, store, tmp_path):
    source = files_in_time_order(asked, "id", str(tmp_path / "in"), 2)
    stream = streams.file_stream(spark, source, asked.schema, files_per_batch=1)
    streams.store_tickets(stream, store, str(tmp_path / "cp"), answers).awaitTermination()
    assert [m["batch"] for m in store.manifests()] == [0, 1]
    whole = plan.create_and_classify(asked.where("length(description) between 10 and 5000 and (title is null or length(title) <= 255)"), store.vectors(0), answers)
    assert rows(store.tickets()) == rows(whole.tickets)


@pytest.mark.parametrize("files", [1, 5])
def test_first_seen_does_not_depend_on_the_files(spark, tmp_path, files):
    requests = Given(spark, SMALL).requests().withColumn("ts", F.col("ts").cast("timestamp"))
    path = str(tmp_path / "in")
    for k in range(files):  # dealt out across the whole time, not in its order
        requests.where(F.col("request_id") % files == k).coalesce(1).write.mode("append").parquet(path)
    stream = streams.file_stream(spark, path, requests.schema, files_per_batch=1)
    streams.first_seen(stream, str(tmp_path / "out"), str(tmp_path / "cp"), delay="400 days").awaitTermination()
    got = streams.first_seen_now(spark, str(tmp_path / "out"))
    want = requests.groupBy("key", F.window("ts", "7 days").alias("w")).agg(F.min("ts").alias("ts")).select("key", F.col("w.start").alias("period_start"), "ts")
    assert rows(got) == rows(want)


def test_memo_of_an_empty_micro_batch_keeps_the_state(spark, tmp_path):
    requests = Given(spark, SMALL).requests()
    assert memo.with_hits(requests.where("false"), prior=requests.select("key", F.col("ts").alias("written_at"))).isEmpty()
