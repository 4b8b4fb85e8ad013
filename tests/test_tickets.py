import pytest
from pyspark.sql import functions as F
from tests.conftest import SMALL, plan_of

from deskline.constants import CATEGORIES, KEYWORDS
from deskline.operators import analytics, corrections, intake, keywords, listing, vectors
from deskline.plans.overview import overview
from deskline.sources import schemas, tables
from registered.views import Given


# ---- keywords --------------------------------------------------------------------


def by_keywords(spark, texts, rules=KEYWORDS):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = keywords.classify_by_keywords(df, "text", rules).orderBy("i").collect()
    return [(r.kw_category, r.kw_confidence, r.kw_indicators) for r in rows]


def brute_force(text, rules=KEYWORDS):
    hits = {c: [w for w in ws if w in text.lower()] for c, ws in rules.items()}
    total = sum(map(len, hits.values()))
    winner = max(rules, key=lambda c: (len(hits[c]), -list(rules).index(c)))
    share = len(hits[winner]) / total if total else 0
    confidence = round(min(0.4 + share * 0.4, 0.7), 2) if total else 0.3
    return winner, confidence, hits[winner][:3]


def test_seed_tickets_score_their_own_category(spark, seeds):
    rows = keywords.classify_by_keywords(intake.with_texts(seeds), "full_text").orderBy("id").collect()
    assert [r.kw_category for r in rows] == CATEGORIES
    assert {r.kw_confidence for r in rows} == {0.7}
    assert [r.kw_indicators for r in rows] == [
        ["cracked", "screen"], ["crash", "install", "app"], ["wifi", "network", "connect"], ["battery", "drain"],
        ["how do", "password", "help"],
    ]


def test_no_hit_is_the_first_category(spark):
    assert by_keywords(spark, ["Zzzz qqqq 12345"]) == [("Product Issue", 0.3, [])]


def test_substrings_count_once_and_ties_take_the_first(spark):
    assert by_keywords(spark, ["It happens: app app app"])[0] == ("Software Issue", 0.7, ["app"])
    assert by_keywords(spark, ["connection"])[0] == ("Network Issue", 0.7, ["connection", "connect"])
    assert by_keywords(spark, ["bug on the screen"])[0] == ("Product Issue", 0.6, ["screen"])


def test_keywords_against_brute_force_on_whole_documents(spark):
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    texts += [" ".join(ws[: n + 1]) + " " + " ".join(vs[:m]) for ws in KEYWORDS.values() for vs in KEYWORDS.values() for n in range(5) for m in range(4)]
    assert by_keywords(spark, texts) == [brute_force(t) for t in texts]


def test_keyword_plan_has_no_shuffle_and_is_generated_code(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    plan = plan_of(keywords.classify_by_keywords(df, "text"))
    assert "Exchange" not in plan and "Join" not in plan
    projects = [line for line in plan.splitlines() if "Project (" in line]
    assert projects and all(line.lstrip(" +-:").startswith("* Project") for line in projects)


def test_category_dimension(spark):
    rows = keywords.category_dimension(spark).orderBy("ord").collect()
    assert [r.category for r in rows] == CATEGORIES and {r.category_count for r in rows} == {5}


# ---- intake ------------------------------------------------------------------------


def test_intake_bounds(spark):
    rows = [
        ("ok", None, "x" * 10), ("ok2", "t" * 255, "x" * 5000), ("title", "t" * 256, "x" * 10),
        ("short", "", "x" * 9), ("long", None, "x" * 5001), ("none", "t", None), ("chars", None, "\U0001f600" * 10),
    ]
    df = spark.createDataFrame(rows, "id string, title string, description string")
    assert {r.id for r in intake.accepted(df).collect()} == {"ok", "ok2", "chars"}
    assert {r.id: r.problem for r in intake.rejected(df).collect()} == {
        "title": "title too long", "short": "description too short", "long": "description too long",
        "none": "description missing",
    }


# ---- listing ---------------------------------------------------------------------------


def test_pages_cover_everything_once(spark):
    tickets = Given(spark, SMALL).tickets()
    total = listing.page_totals(tickets, 1, 100, "corrected").first()
    pages = [listing.page(tickets, p, 100, "corrected").collect() for p in range(1, total.pages + 1)]
    ids = [r.id for p in pages for r in p]
    assert len(ids) == len(set(ids)) == total.total
    times = [r.created_at for p in pages for r in p]
    assert times == sorted(times, reverse=True)
    last = pages[0][-1]
    after = listing.page_after(tickets, str(last.created_at), last.id, 100, "corrected").collect()
    assert [r.id for r in after] == [r.id for r in pages[1]]


def test_empty_filters_mean_no_filter_and_unknown_ones_no_rows(spark, seeds):
    assert listing.page_totals(seeds, status="", category="").first().total == 5
    assert tuple(listing.page_totals(seeds, status="nonsense").first()) == (0, 1, 20, 1)
    assert listing.ticket_by_id(seeds, "3").first().title == "WiFi keeps disconnecting"
    assert listing.ticket_by_id(seeds, "9").count() == 0
    assert [r.id for r in listing.recent(seeds).collect()] == ["1", "2", "3", "4", "5"]
    for bad in ({"page": 0}, {"limit": 0}, {"limit": 101}):
        with pytest.raises(ValueError):
            listing.page(seeds, **bad)


def test_page_is_a_top_n_and_lookup_is_pushed_down(spark, tmp_path):
    path = str(tmp_path / "tickets")
    tables.append(Given(spark, SMALL).tickets(), path)
    tickets = tables.read_tickets(spark, path).drop("id").withColumn("id", F.col("title"))
    assert "TakeOrderedAndProject" in plan_of(listing.page(tickets, 2, 10))
    plan = plan_of(listing.filtered(tickets, "open", "Network Issue"))
    assert "EqualTo(status,open)" in plan and "EqualTo(predicted_category,Network Issue)" in plan


# ---- analytics -----------------------------------------------------------------------------


def test_reports_on_the_seeds(spark, seeds):
    assert tuple(analytics.accuracy_metrics(seeds).first()) == (5, 5, 100.0)
    assert [tuple(r) for r in analytics.category_distribution(seeds).collect()] == [(c, 1, 20.0) for c in sorted(CATEGORIES)]
    requests = spark.createDataFrame([(True,), (True,), (False,)], "hit boolean")
    row = overview(seeds, requests, seeds).first()
    assert row.total_tickets == 5 and row.avg_confidence == 91.0 and row.cache_hit_rate == 66.7
    assert row.vector_store_count == 5 and tuple(row.accuracy) == (5, 5, 100.0)
    assert [tuple(c) for c in row.category_distribution] == [(c, 1, 20.0) for c in sorted(CATEGORIES)]


def test_reports_on_nothing(spark, seeds):
    nothing = seeds.where("false")
    assert tuple(analytics.accuracy_metrics(nothing).first()) == (0, 0, 0.0)
    row = overview(nothing, spark.createDataFrame([], "hit boolean"), nothing).first()
    assert (row.total_tickets, row.avg_confidence, row.cache_hit_rate, row.vector_store_count) == (0, 0.0, 0.0, 0)
    assert row.category_distribution == [] and tuple(row.accuracy) == (0, 0, 0.0)


def test_percentages_have_different_bases(spark, seeds):
    open_one = seeds.limit(1).withColumn("predicted_category", F.lit(None).cast("string"))
    tickets = seeds.unionByName(open_one)
    assert {r.percentage for r in analytics.category_distribution(tickets).collect()} == {20.0}
    assert {r.percentage for r in analytics.api_distribution(tickets).collect()} == {16.7}


def test_trend(spark, seeds):
    wrong = seeds.withColumns({"actual_category": F.lit("Battery Issue"), "created_at": F.expr("created_at + interval 7 days")})
    rows = analytics.accuracy_trend(seeds.unionByName(wrong)).orderBy("period_start").collect()
    assert [(r.current, r.previous, r.change, r.trend) for r in rows] == [(100.0, None, None, "stable"), (20.0, 100.0, -80.0, "down")]
    assert str(rows[0].period_start) == "2024-01-01"


def test_feedback_matrix(spark):
    log = spark.createDataFrame(
        [("Network Issue", "Battery Issue")] * 2 + [("Network Issue", "Network Issue"), (None, "Battery Issue")], "old_label string, new_label string"
    )
    rows = {r.old_label: r for r in analytics.feedback_matrix(log).collect()}
    assert (rows["Network Issue"]["Battery Issue"], rows["Network Issue"]["Network Issue"], rows["Network Issue"]["Product Issue"]) == (2, 1, 0)
    assert rows[None]["Battery Issue"] == 1


def test_overview_scans_the_tickets_once(spark):
    given = Given(spark, SMALL)
    plan = plan_of(analytics.overview_figures(given.tickets()))
    assert plan.count(") Scan parquet") == 1 and "Join" not in plan


# ---- corrections -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def feed(spark):
    rows = [
        ("c1", "1", "Software Issue", "no", "2024-01-02 00:00:00"),
        ("c2", "1", "Battery Issue", None, "2024-01-03 00:00:00"),
        ("c3", "2", "Software Issue", "confirmed", "2024-01-02 00:00:00"),
        ("c4", "9", "Software Issue", None, "2024-01-02 00:00:00"),
        ("c5", "3", "Billing", None, "2024-01-02 00:00:00"),
        ("c6", "3", "Battery Issue", "x" * 1001, "2024-01-02 00:00:00"),
        ("c7", "1", "Billing", None, "2024-01-09 00:00:00"),
    ]
    df = spark.createDataFrame(rows, "correction_id string, ticket_id string, corrected_category string, feedback string, at string")
    return df.select("correction_id", "ticket_id", "corrected_category", "feedback", F.col("at").cast("timestamp_ntz").alias("corrected_at"))


def test_corrections(spark, seeds, feed):
    fresh = seeds.withColumns({"status": F.lit("classified"), "actual_category": F.lit(None).cast("string")})
    after = {r.id: r for r in corrections.corrected_tickets(fresh, feed).collect()}
    assert after["1"].actual_category == "Battery Issue" and after["1"].status == "corrected"
    assert str(after["1"].updated_at) == "2024-01-03 00:00:00" and after["1"].predicted_category == "Product Issue"
    assert after["2"].status == "corrected"  # also where the prediction was confirmed
    assert after["3"].status == "classified" and after["3"].actual_category is None
    log = {r.id: (r.old_label, r.new_label) for r in corrections.feedback_rows(fresh, feed).collect()}
    assert log == {
        "c1": ("Product Issue", "Software Issue"), "c2": ("Product Issue", "Battery Issue"), "c3": ("Software Issue", "Software Issue"),
    }
    refused = {r.correction_id: r.problem for r in corrections.refused_corrections(fresh, feed).collect()}
    assert refused == {"c4": "ticket not found", "c5": "unknown category", "c6": "feedback too long", "c7": "unknown category"}
    twice = corrections.corrected_tickets(corrections.corrected_tickets(fresh, feed), feed)
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, corrections.corrected_tickets(fresh, feed).collect()))


def test_latest_correction_is_thinned_before_the_shuffle(spark, feed):
    assert "WindowGroupLimit" in plan_of(corrections.latest_per_ticket(feed))


def test_cascade_and_orphans(spark, seeds, feed):
    log = feed.select(F.col("correction_id").alias("id"), "ticket_id")
    kept = {r.id for r in corrections.feedback_of_known(log, seeds).collect()}
    lost = {r.id for r in corrections.feedback_orphans(log, seeds).collect()}
    assert lost == {"c4"} and kept | lost == {f"c{i}" for i in range(1, 8)} and not kept & lost


# ---- vector table and stores ---------------------------------------------------------------------


def test_vector_upsert_and_metadata(spark):
    def rows(values):
        df = spark.createDataFrame(values, "id string, document string, category string, own map<string,string>, n int")
        made = vectors.vector_rows(df.withColumn("embedding", F.array(F.lit(1.0).cast("float"))), "own")
        return made.join(df.select("id", "document", "n"), ["id", "document"])

    old = rows([("a", "old a", "X", None, 0), ("b", "old b", None, None, 0)]).drop("n")
    new = rows([("b", "new b1", "Y", None, 1), ("b", "new b2", "Y", {"category": "Z", "src": "mail"}, 2), ("c", "new c", "Q", {"src": "web"}, 1)])
    after = {r.id: r for r in vectors.upserted(old, new, "n").collect()}
    assert {i: r.document for i, r in after.items()} == {"a": "old a", "b": "new b2", "c": "new c"}
    assert after["b"].metadata == {"category": "Z", "src": "mail"} and after["b"].category == "Z"
    assert after["c"].metadata == {"category": "Q", "src": "web"} and after["a"].metadata == {"category": "X"}
    assert {r.category: r["count"] for r in analytics.vector_stats(old).collect()} == {"X": 1, "unknown": 1}
    gone = spark.createDataFrame([("a",), ("a",), ("zz",)], "id string")
    assert [r.id for r in vectors.without_ids(old, gone).collect()] == ["b"]
    assert vectors.category_examples(old, "none").count() == 0


def test_new_ticket_rows_and_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [("1", None, "a description", "Network Issue", 0.5, "r"), ("2", "t", "another one", "", None, None)],
        "id string, title string, description string, category string, confidence double, reasoning string",
    )
    now = F.lit("2024-02-03 04:05:06").cast("timestamp_ntz")
    tables.append(tables.new_ticket_rows(df, F.col("id"), now), str(tmp_path / "t"))
    back = {r.id: r for r in tables.read_tickets(spark, str(tmp_path / "t")).collect()}
    assert back["1"].status == "classified" and back["1"].title == "a description"
    assert back["2"].status == "open" and str(back["2"].created_at) == "2024-02-03 04:05:06"
    fresh = tables.new_ticket_rows(df).collect()
    assert len({r.id for r in fresh}) == 2 and all(len(r.id) == 36 and r.created_at for r in fresh)
    version = tables.write_version(tables.read_tickets(spark, str(tmp_path / "t")), str(tmp_path / "versions"), 1)
    assert tables.read_tickets(spark, version).count() == 2


def test_every_store_reads_with_its_schema(spark, tmp_path):
    for name, schema, read in [
        ("f", schemas.FEEDBACK, tables.read_feedback), ("v", schemas.VECTORS, tables.read_vectors),
        ("m", schemas.MEMO, tables.read_memo), ("a", schemas.ANSWERS, tables.read_answers),
    ]:
        path = str(tmp_path / name)
        spark.createDataFrame([], schema).write.parquet(path)
        assert read(spark, path).columns == schema.fieldNames()
    lines = tmp_path / "a.jsonl"
    lines.write_text('{"ticket_id": "1", "raw": "{}"}\n')
    assert tables.read_answers(spark, str(lines), "json").first().raw == "{}"


def test_deep_pages_by_counts_equal_plain_pages(spark, tmp_path):
    rows = [(str(i), "t", "d", "Network Issue" if i % 3 else None, None, None, None, "open" if i % 2 else "classified", None if i % 11 == 0 else f"2024-01-{1 + i * 7 % 19:02d} 0{i % 5}:00:00") for i in range(200)]
    names = "id string, title string, description string, predicted_category string, actual_category string, confidence_score double, reasoning string, status string, at string"
    df = spark.createDataFrame(rows, names).withColumn("created_at", F.col("at").cast("timestamp_ntz")).withColumn("updated_at", F.col("created_at")).drop("at")
    tables.append(df, str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    counts = listing.day_counts(stored)
    for kind in ({}, {"status": "open"}, {"status": "open", "category": "Network Issue"}, {"status": "none"}):
        for number in (1, 2, 5, 9, 10, 11, 40):
            got = listing.page_by_counts(stored, counts, number, 20, **kind).collect()
            assert got == listing.page(stored, number, 20, **kind).collect(), (kind, number)
    deep = listing.page_by_counts(stored, counts, 4, 20)
    assert "PartitionFilters: [isnotnull(day" in plan_of(deep)


def test_kept_figures_equal_the_overview(spark, seeds):
    from deskline.plans import overview as o

    requests = spark.createDataFrame([(1, "k", True), (2, "k", False), (3, "l", False)], "request_id long, key string, hit boolean").withColumn("ts", F.lit("2024-01-05").cast("timestamp_ntz"))
    vectors = spark.createDataFrame([("a", "2024-01-01"), ("b", None)], "id string, at string").withColumn("created_at", F.col("at").cast("timestamp_ntz"))
    parts = o.day_figures(seeds.where("id < 3"), requests).unionByName(o.day_figures(seeds.where("id >= 3"), vectors=vectors)).unionByName(o.day_figures(seeds.where("false")))
    for figures in (parts, o.folded(parts)):
        assert o.overview_of(figures).collect() == o.overview(seeds, requests, vectors).collect()
    empty = o.overview_of(parts.where("false")).first()
    assert empty == o.overview(seeds.where("false"), requests.where("false"), vectors.where("false")).first()


def test_neighbours_vote_by_similarity(spark):
    from deskline.operators import similar

    rows = [(1, 1, "a", "X", 0.9), (1, 2, "b", "Y", 0.5), (1, 3, "c", "Y", 0.5), (2, 1, "a", "Y", 0.4), (2, 2, "b", "X", 0.4), (3, 1, "a", None, 0.9), (4, 1, "a", "Z", 0.0), (4, 2, "a", None, 0.0)]
    got = similar.vote(spark.createDataFrame(rows, "query_id int, rank long, id string, category string, similarity double"))
    assert sorted(map(tuple, got.collect())) == [(1, "Y", 2, 0.53), (2, "X", 1, 0.5), (4, "Z", 1, 0.0)]
