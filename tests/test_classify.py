import datetime as dt

import pytest
from pyspark.sql import functions as F

from deskline.constants import KEYWORD_REASONING, MEMO_PREFIX
from deskline.plans import classify as plan
from deskline.sources.schemas import MEMO
from deskline.sources.tables import append, read_memo, read_tickets

START = dt.datetime(2024, 1, 1)


def hours(n):
    return START + dt.timedelta(hours=n)


@pytest.fixture(scope="module")
def batch(spark):
    rows = [
        # id, title, description, hour, vector
        (1, "WiFi not working", "I cannot connect to the office network", 0, [1.0, 0.0]),
        (2, "wifi NOT  working", "I cannot connect to the office network", 1, [1.0, 0.1]),  # same text as 1
        (3, None, "broken screen and a cracked button", 2, [0.0, 1.0]),  # no usable answer
        (4, None, "broken screen and a cracked button", 3, [0.1, 1.0]),  # same text, answer usable
        (5, None, "Broken screen and a cracked button", 4, [0.2, 1.0]),  # now remembered
        (6, "WiFi not working", "I cannot connect to the office network", 24 * 7, [1.0, 0.2]),  # exactly expired
        (7, None, "text without any vector", 5, None),
    ]
    df = spark.createDataFrame(rows, "id long, title string, description string, h int, embedding array<float>")
    return df.withColumn("created_at", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,h,0,0)")).drop("h")


@pytest.fixture(scope="module")
def answers(spark):
    good = '{"category":"Network Issue","confidence":0.93,"reasoning":"wifi","key_indicators":["wifi"]}'
    rows = [
        (1, good), (2, '{"category":"Battery Issue"}'), (3, "no json"), (4, '{"category":"Product Issue","confidence":0.8}'),
        (6, '{"category":"Software Issue","confidence":"0.6"}'), (7, good),
    ]
    return spark.createDataFrame(rows, "ticket_id long, raw string")


def by_id(df):
    return {r.id: r for r in df.collect()}


def test_memo_answers_and_fallback(spark, batch, answers):
    got = by_id(plan.classify(batch, None, answers))
    assert (got[1].category, got[1].confidence, got[1].cached, got[1].writes) == ("Network Issue", 0.93, False, True)
    assert (got[2].category, got[2].cached, got[2].reasoning, got[2].key_indicators) == ("Network Issue", True, "wifi", ["wifi"])
    assert (got[3].category, got[3].confidence, got[3].fallback, got[3].writes) == ("Product Issue", 0.7, True, False)
    assert got[3].reasoning == KEYWORD_REASONING and got[3].key_indicators == ["broken", "cracked", "screen"]
    assert (got[4].cached, got[4].writes, got[4].confidence) == (False, True, 0.8)  # keyword results are not remembered
    assert (got[5].cached, got[5].category, got[5].confidence, got[5].fallback) == (True, "Product Issue", 0.8, False)
    assert (got[6].cached, got[6].category, got[6].writes) == (False, "Software Issue", True)
    assert not any(r.rag_used or r.similar_tickets for r in got.values())


def test_preview_uses_no_memo(spark, batch, answers):
    got = by_id(plan.classify(batch, None, answers, use_memo=False))
    assert not any(r.cached or r.writes for r in got.values())
    assert (got[2].category, got[2].confidence) == ("Battery Issue", 0.5)
    assert (got[5].category, got[5].fallback) == ("Product Issue", True)


def test_neighbours_are_earlier_tickets_only(spark, batch, answers):
    empty = spark.createDataFrame([], "id long, document string, category string, embedding array<float>, created_at timestamp_ntz")
    got = by_id(plan.classify(batch, empty, answers, add_batch=True))
    assert got[1].similar_tickets == [] and got[1].rag_used is False
    assert got[2].cached and got[2].rag_used is False and got[2].similar_tickets == []
    assert [(r.id, r.category) for r in got[4].similar_tickets][0] == ("3", "Product Issue") and got[4].rag_used
    assert len(got[4].similar_tickets) == 3
    assert got[3].similar_tickets == [] and got[3].rag_used is False  # fallback carries none
    # a hit shows the neighbours stored with the entry, but says it searched none
    assert got[5].similar_tickets == got[4].similar_tickets and got[5].rag_used is False
    assert [(r.id, r.similarity) for r in got[6].similar_tickets] == [("2", 1.0), ("1", 0.98), ("5", 0.38)]
    assert got[7].similar_tickets == [] and not got[7].rag_used


def test_prior_memo_and_its_result(spark, batch, answers):
    key = by_id(plan.classify(batch, None, answers))[1].memo_key
    assert key.startswith(MEMO_PREFIX)
    stored = ("General Question", 0.33, "kept", ["k"], [("77", "X", 0.5)])
    memo = spark.createDataFrame([(key, START - dt.timedelta(days=2), stored)], MEMO)
    got = by_id(plan.classify(batch, None, answers, memo))
    assert (got[1].cached, got[1].category, got[1].confidence) == (True, "General Question", 0.33)
    assert got[1].similar_tickets[0].id == "77" and not got[1].writes
    assert got[6].cached is False and got[6].writes  # the old entry is gone by then
    expired = spark.createDataFrame([(key, START - dt.timedelta(days=7), stored)], MEMO)
    assert by_id(plan.classify(batch, None, answers, expired))[1].cached is False


def test_create_and_classify_fills_the_stores(spark, batch, answers, tmp_path):
    empty = spark.createDataFrame([], "id string, category string, embedding array<float>, created_at timestamp_ntz")
    stored = plan.create_and_classify(batch, empty, answers)
    append(stored.tickets, str(tmp_path / "tickets"))
    append(stored.memo, str(tmp_path / "memo"), "written_at")
    tickets = by_id(read_tickets(spark, str(tmp_path / "tickets")))
    assert len(tickets) == 7 and {t.status for t in tickets.values()} == {"classified"}
    assert tickets["7"].title == "text without any vector" and tickets["1"].title == "WiFi not working"
    vectors = by_id(stored.vectors)
    assert vectors["3"].document == "broken screen and a cracked button. broken screen and a cracked button"
    assert vectors["3"].metadata == {"category": "Product Issue"}
    memo = read_memo(spark, str(tmp_path / "memo")).collect()
    assert len(memo) == 4 and {m.result.category for m in memo} == {"Network Issue", "Product Issue", "Software Issue"}
    record = stored.records.where("ticket.id = '6'").first()
    assert record.classification.category == "Software Issue" and len(record.classification.similar_tickets) == 3


def test_prompts(spark, batch):
    corpus = batch.where("embedding is not null").select(
        "id", F.col("description").alias("document"), F.lit("Network Issue").alias("category"), "embedding", "created_at"
    )
    got = by_id(plan.prompts(batch, corpus))
    assert got[1].context == "No similar tickets found." and got[7].context == "No similar tickets found."
    assert got[2].context == '- [Network Issue] "I cannot connect to the office network..." (similarity: 100%)'
    assert got[4].context.count("\n") == 2 and got[4].context in got[4].prompt


def test_one_answer_per_ticket(batch, answers):
    late = answers.where("ticket_id = 1").withColumn("raw", F.lit('{"category":"Battery Issue"}')).withColumn("answered_at", F.lit(hours(2)))
    early = answers.withColumn("answered_at", F.lit(hours(1)))
    found = plan.judged(batch, early.unionByName(late).unionByName(late)).collect()
    assert sorted(r.id for r in found) == [1, 2, 3, 4, 5, 6, 7]
    assert {r.id: r.category for r in found}[1] == "Battery Issue"
    assert plan.judged(batch, answers.unionByName(answers)).count() == 7
