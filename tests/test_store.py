"""What one batch stores is what the next one reads; the working folder; refused vectors."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from tests.conftest import plan_of

from deskline import session
from deskline.operators import listing, similar
from deskline.plans.classify import create_and_classify
from deskline.sources import tables


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    assert "deskline" in session.work_dir(spark, "x")

    class Session:
        def __init__(self, master, folder):
            self.conf = {"spark.checkpoint.dir": folder}
            self.sparkContext = SimpleNamespace(master=master)

    with pytest.raises(ValueError):
        session.work_dir(Session("spark://host:7077", None), "x")
    assert session.work_dir(Session("local[8]", None), "x")
    assert session.work_dir(Session("spark://host:7077", "hdfs://x/y/"), "x").startswith("hdfs://x/y/deskline/")


def test_repeated_fields_have_their_last_value(spark):
    raw = '{"category":"Network Issue","category":"Battery Issue"}'
    row = spark.createDataFrame([(raw,)], "raw string").select(F.expr("try_variant_get(try_parse_json(raw), '$.category', 'string')").alias("c"))
    assert row.first()["c"] == "Battery Issue"


def _batch(spark, ids, day):
    return spark.createDataFrame(
        [(str(i), f"title {i}", f"wifi is down in room {i}", [float(i % 3 + 1), 1.0, 0.5]) for i in ids],
        "id string, title string, description string, embedding array<float>",
    ).withColumn("created_at", F.lit(f"2024-01-0{day} 00:00:00").cast("timestamp_ntz"))


def test_the_next_batch_reads_the_stored_vectors(spark, tmp_path):
    path = str(tmp_path / "vectors")
    stored = create_and_classify(_batch(spark, range(4), 1))
    tables.append(stored.vectors, path)
    corpus = tables.read_vectors(spark, path)
    assert "created_at" in corpus.columns and corpus.count() == 4
    answers = spark.createDataFrame([(str(i), '{"category":"Network Issue","confidence":0.9}') for i in range(4, 8)], "ticket_id string, raw string")
    again = create_and_classify(_batch(spark, range(4, 8), 2), corpus=corpus, answers=answers)
    seen = again.records.select(F.size("classification.similar_tickets").alias("n")).collect()
    assert all(r["n"] == 3 for r in seen)
    tables.append(again.vectors, path)
    assert tables.read_vectors(spark, path).count() == 8


def test_vectors_of_other_lengths_are_refused(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0]), (4, []), (5, None), (6, [1.0, None]), (7, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>").withColumn("category", F.lit("c"))
    asked = df.select(F.col("id").alias("query_id"), "embedding")
    found = similar.nearest(asked, df, 2, exclude_self=True).collect()
    assert {(r["query_id"], r["id"]) for r in found} == {(a, b) for a in (1, 2, 7) for b in (1, 2, 7) if a != b}
    assert {r["id"] for r in similar.refused_vectors(df, df).collect()} == {3, 4, 5, 6}


def test_later_days_are_not_read(spark, tmp_path, seeds):
    path = str(tmp_path / "tickets")
    tables.append(seeds, path)
    stored = spark.read.parquet(path)
    after = listing.page_after(stored, "2024-01-01 00:00:00", "2")
    assert "PartitionFilters: [isnotnull(day" in plan_of(after)
    assert [r["id"] for r in after.collect()] == ["3", "4", "5"]
