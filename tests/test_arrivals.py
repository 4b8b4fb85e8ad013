"""The registered streams: tables of many files, and parts that are written and read by many tasks."""

from registered import queries
from registered.views import Given


def test_streams_of_tables_in_folders(spark, tmp_path):
    rows = [(i, f"The words of {i}, in a row." * 3, "en", "web", 60) for i in range(8)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    (tmp_path / "whole").mkdir()
    documents.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    documents.toPandas().to_parquet(f"{tmp_path}/whole/documents.parquet")
    for folder in (tmp_path, tmp_path / "whole"):
        got = queries.all_queries()["stream_intake"](spark, str(folder))
        assert sorted(r["id"] for r in got.collect()) == list(range(8))


def test_a_part_is_as_many_files_as_tasks_and_parts_follow_in_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "work_dir", lambda _, name: f"{tmp_path}/{name}")
    rows = spark.range(0, 80, 1, 4).selectExpr("id", "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, id) as ts").repartition(4)
    for k, stream in enumerate(queries._arriving(Given(spark, str(tmp_path)), rows, "ts", "rows")):
        assert len(list((tmp_path / "rows").glob("*.parquet"))) == 4 * (k + 1)
        got = []
        write = lambda batch, _: got.append(sorted(r["id"] for r in batch.collect()))  # noqa: B023, E731
        stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
        assert got == [list(range(20 * k, 20 * k + 20))]
    assert k == queries.PARTS - 1
