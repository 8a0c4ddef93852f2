from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import functions as F
from samples import API_ITEM, DETAIL_PAGE, LIST_ITEM, result_html

from lotledger.plans.runs import RunContext
from lotledger.schemas import ANOMALY_FIELDS, REQUEST_LOG_FIELDS, RUN_FIELDS, shaped
from lotledger.sources.raw_pages import register_pages
from lotledger.streaming import feed
from lotledger.streaming.ingest import (
    Store,
    crawl_state,
    current_targets,
    ingest_pages,
    land_pages,
    seen_pages,
    start_ingest,
    stored_anomalies,
    stored_lots,
    stored_runs,
)

SECOND = {**LIST_ITEM, "id": 2, "title": "2001 Land Rover Discovery SE", "url": "https://bringatrailer.com/listing/disco/"}


def _page(spark, number, kind, url, content, content_type="text/html"):
    rows = [(str(number), "bring_a_trailer", kind, url, 200, content_type, content, datetime(2026, 4, 1, number))]
    fetched = spark.createDataFrame(
        rows, "id string, source string, target_type string, url string, status_code int, content_type string,"
        " content string, fetched_at timestamp",
    )
    return register_pages(fetched)


def _pages(spark):
    listing = result_html([LIST_ITEM, SECOND, {**SECOND, "title": "Wheels"}], 3, {"keyword": 7})
    return [
        _page(spark, 1, "bat_model_page", "https://bringatrailer.com/porsche/", listing),
        _page(spark, 2, "bat_detail_page", LIST_ITEM["url"].rstrip("/"), DETAIL_PAGE),
        _page(
            spark, 3, "bat_api_completed_results", "https://bringatrailer.com/api",
            json.dumps({"items": [{**LIST_ITEM, "current_bid": 97000, "bids": None}]}), "application/json",
        ),
    ]


def _state(spark, store):
    rows = stored_lots(spark, store).orderBy("canonical_url").collect()
    return [(r.source_auction_id, r.high_bid, r.bid_count, r.mileage, r.vin, len(r.image_urls)) for r in rows]


EXPECTED = [("70412233", 97000, 1206, 18000, "WUARNAFG5BN000417", 4), ("2", 96500, 31, None, None, 1)]


def _runs(spark, store):
    rows = spark.read.parquet(store.table("parse_runs")).collect()
    return {r.raw_page_id: (r.parser_name, r.records_found, r.records_inserted, r.records_updated, r.targets_discovered)
            for r in rows}


def test_stream_parses_each_page_once_and_keeps_progress(spark, tmp_path):
    landing, store = str(tmp_path / "landing"), Store(str(tmp_path / "store"))
    first, second, third = _pages(spark)
    for landed in (first.unionByName(second), third.unionByName(second)):  # page 2 lands twice
        landed.coalesce(1).write.mode("append").parquet(landing)
        start_ingest(spark, landing, store, str(tmp_path / "check"), buckets=4).awaitTermination()
    expected_runs = {
        "1": ("bat_completed_results", 2, 2, 0, 4),
        "2": ("bat_detail_page", 1, 0, 1, 0),
        "3": ("bat_completed_results", 1, 0, 1, 0),
    }
    assert _state(spark, store) == EXPECTED and _runs(spark, store) == expected_runs
    links = sorted((r.raw_page_id, r.relationship_type) for r in spark.read.parquet(store.table("links")).collect())
    assert links == [("1", "list"), ("1", "list"), ("2", "detail"), ("3", "list")]
    rejects = spark.read.parquet(store.table("rejects_list")).collect()
    assert [r.skip_reason for r in rejects] == ["parts_or_non_car"]
    targets = current_targets(spark, store)
    assert sorted((r.target_type, r.priority) for r in targets.collect()) == [
        ("bat_api_completed_results", 30), ("bat_api_completed_results", 30), ("bat_detail_page", 80),
        ("bat_detail_page", 80),
    ]
    # The last batch again, as after a lost driver: nothing changes.
    ingest_pages(third.unionByName(second), store, "000000001", buckets=4)
    assert _state(spark, store) == EXPECTED and _runs(spark, store) == expected_runs


def test_refused_pages_are_kept_but_not_parsed(spark, tmp_path):
    store = Store(str(tmp_path / "store"))
    first, second, _ = _pages(spark)
    refused = first.withColumns({"id": F.lit("9"), "status_code": F.lit(429)})
    failed = second.withColumns({"id": F.lit("8"), "fetch_error": F.lit("timed out")})
    ingest_pages(first.unionByName(refused).unionByName(failed), store, "000000000", buckets=4)
    assert {r.id for r in spark.read.parquet(store.table("landed")).collect()} == {"1", "8", "9"}
    assert set(_runs(spark, store)) == {"1"}
    raised = spark.read.option("basePath", store.table("anomalies")).parquet(f"{store.table('anomalies')}/batch=000000000-fetch")
    assert [(r.code, r.severity, r.metadata["status_code"]) for r in raised.collect()] == [("blocked_response", "critical", "429")]


def test_feed_counts_update_with_the_stream(spark, tmp_path):
    folder = str(tmp_path / "logs")

    def add(*rows):
        logs = spark.createDataFrame(rows, "id string, source string, outcome string, parsed_lot_count int, created_at timestamp")
        shaped(logs, REQUEST_LOG_FIELDS).coalesce(1).write.mode("append").parquet(folder)

    def drain():
        query = (
            feed.feed_counts(feed.log_stream(spark, folder)).writeStream.outputMode("complete").format("memory")
            .queryName("feed").option("checkpointLocation", str(tmp_path / "feed")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        return {(r.source, r.event): (r.events, r.lots) for r in spark.table("feed").collect()}

    add(("1", "a", "success", 5, datetime(2026, 1, 1)), ("2", "a", "retry", None, datetime(2026, 1, 1)))
    assert drain() == {("a", "progress"): (1, 5), ("a", "warning"): (1, 0)}
    add(("3", "a", "success", 2, datetime(2026, 1, 2)), ("4", "b", "blocked", None, datetime(2026, 1, 2)))
    assert drain() == {("a", "progress"): (2, 7), ("a", "warning"): (1, 0), ("b", "error"): (1, 0)}


def test_daily_counts_close_behind_the_watermark(spark, tmp_path):
    folder = str(tmp_path / "logs")
    for day in (1, 1, 4, 9):
        logs = spark.createDataFrame([(str(day), "a", datetime(2026, 1, day))], "id string, source string, created_at timestamp")
        shaped(logs, REQUEST_LOG_FIELDS).coalesce(1).write.mode("append").parquet(folder)
    query = (
        feed.daily_counts(feed.log_stream(spark, folder)).writeStream.outputMode("append").format("memory")
        .queryName("daily").option("checkpointLocation", str(tmp_path / "daily")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    closed = {(str(r.day), r.requests) for r in spark.table("daily").collect()}
    assert closed == {("2026-01-01", 2), ("2026-01-04", 1)}
    assert spark.read.parquet(folder).agg(F.count("*")).first()[0] == 4


def test_both_sites_in_one_batch(spark, tmp_path):
    """Answers of the second site become lots in the same batch; an answer without items and one without a lot raise anomalies."""
    store = Store(str(tmp_path / "store"))
    answers = [
        {"auctions": [API_ITEM, {**API_ITEM, "id": "b2", "auction_end": None}, {**API_ITEM, "id": "b3", "title": "Audi R8"}], "count": 3, "total": 3},
        {"auctions": [], "count": 0, "total": 0},
        {"auctions": [{**API_ITEM, "id": ""}], "count": 1, "total": 1},
        [],
    ]
    pages = [
        _page(spark, 10 + k, "closed_auction_search", f"https://carsandbids.com/past-auctions/?q={k}", json.dumps(body), "application/json")
        .withColumn("source", F.lit("cars_and_bids"))
        for k, body in enumerate(answers)
    ]
    batch = _pages(spark)[0]
    for page in pages:
        batch = batch.unionByName(page)
    for _ in range(2):  # the second time nothing changes
        ingest_pages(batch, store, "000000001", buckets=4)
        lots = {(r.source, r.source_auction_id): r for r in stored_lots(spark, store).collect()}
        assert set(lots) == {("bring_a_trailer", "70412233"), ("bring_a_trailer", "2"), ("cars_and_bids", "qz81kd"), ("cars_and_bids", "b2")}
        assert lots["cars_and_bids", "b2"].ended_at == datetime(2026, 4, 1, 10) and lots["cars_and_bids", "qz81kd"].sold_price == 24750
        anomalies = spark.read.parquet(store.table("anomalies")).collect()
        assert sorted((a.run_id, a.source, a.severity, a.code) for a in anomalies) == [
            ("11", "cars_and_bids", "critical", "no_closed_auction_response"),
            ("12", "cars_and_bids", "warning", "zero_parsed_lots"),
            ("13", "cars_and_bids", "critical", "no_closed_auction_response"),
        ]
        runs = _runs(spark, store)
        assert runs["10"] == ("captured_auctions", 2, 2, 0, 0) and runs["11"] == ("captured_auctions", 0, 0, 0, 0)
        assert {t.source for t in current_targets(spark, store).collect()} == {"bring_a_trailer"}


def test_run_is_judged_and_closed_once(spark, tmp_path):
    """All rules of a run in one table, its record and the crawl state; a batch that comes again after its lots got details changes none."""
    store, run = Store(str(tmp_path / "store")), RunContext(page_limit=2)
    first, detail, _ = _pages(spark)
    directory = _page(spark, 4, "bat_models_directory", "https://bringatrailer.com/models/", "<html></html>")
    answer = _page(spark, 5, "closed_auction_search", "https://carsandbids.com/past-auctions/", json.dumps({"auctions": []}), "application/json")
    refused = _page(spark, 6, "bat_model_page", "https://bringatrailer.com/audi/", "").withColumn("status_code", F.lit(403))
    batch = first.unionByName(directory).unionByName(answer.withColumn("source", F.lit("cars_and_bids"))).unionByName(refused)

    def seen():
        anomalies = sorted((a.code, a.run_id or "", a.source) for a in stored_anomalies(spark, store).collect())
        records = sorted((r.id, r.source, r.status, r.records_found, r.records_inserted) for r in stored_runs(spark, store).collect())
        state = {r.source: (r.state["records_found"], r.state["last_status"]) for r in crawl_state(spark, store).collect()}
        return anomalies, records, state

    ingest_pages(batch, store, "000000001", buckets=4, run=run)
    expected = (
        [
            ("bat_pagination_incomplete", "000000001", "bring_a_trailer"),
            ("blocked_response", "", "bring_a_trailer"),
            ("missing_detail_enrichment", "000000001", "bring_a_trailer"),
            ("models_directory_empty", "000000001", "bring_a_trailer"),
            ("no_closed_auction_response", "000000001", "cars_and_bids"),
            ("zero_lots", "000000001", "cars_and_bids"),
        ],
        [("000000001", "bring_a_trailer", "success", 2, 2), ("000000001", "cars_and_bids", "success", 0, 0)],
        {"bring_a_trailer": ("2", '"success"'), "cars_and_bids": ("0", '"success"')},
    )
    assert seen() == expected
    assert all(a.created_at is not None for a in stored_anomalies(spark, store).collect())
    ingest_pages(detail, store, "000000002", buckets=4)  # no run: nothing to close
    ingest_pages(batch, store, "000000001", buckets=4, run=run)
    assert seen() == expected


def test_batch_reads_seen_pages_of_its_own_months_only(spark, tmp_path):
    store = Store(str(tmp_path / "store"))
    page = _page(spark, 1, "bat_model_page", "https://bringatrailer.com/a/", "x")
    days = [page.withColumns({"id": F.lit(f"p{month}"), "fetched_at": F.lit(f"2026-0{month}-02").cast("timestamp")}) for month in (3, 4, 5)]
    for number, landing in enumerate(days):
        land_pages(landing, store, f"00000000{number}")
    again = days[1].unionByName(page.withColumns({"id": F.lit("new"), "fetched_at": F.lit("2026-04-02 12:00:00").cast("timestamp")}))
    for _ in range(2):  # the batch itself comes twice, too
        assert [r.id for r in land_pages(again, store, "000000003").collect()] == ["new"]
    read = seen_pages(spark, store, ["2026-04-02", "2026-06-09"], "000000004")
    assert sorted(r.id for r in read.collect()) == ["new", "p4"]
    assert read.inputFiles() and all("/month=2026-04/" in f for f in read.inputFiles())


def test_feed_of_all_kinds_as_stream_and_as_frame(spark, tmp_path):
    """Requests, anomalies and runs in one feed; a run starts and ends once, however often its record comes."""
    folders = {name: str(tmp_path / name) for name in ("logs", "anomalies", "runs")}

    def add(name, fields, schema, *rows):
        shaped(spark.createDataFrame(rows, schema), fields).coalesce(1).write.mode("append").parquet(folders[name])

    def run(*rows):
        add("runs", RUN_FIELDS, "id string, source string, status string, started_at timestamp, finished_at timestamp, records_found int, error string", *rows)

    def counted(rows):
        return {(r.source, r.event): (r.events, r.lots) for r in rows.collect()}

    def drain():
        parts = feed.log_stream(spark, folders["logs"]), feed.anomaly_stream(spark, folders["anomalies"]), feed.run_stream(spark, folders["runs"])
        query = (
            feed.event_counts(feed.events(*parts)).writeStream.outputMode("complete").format("memory")
            .queryName("feed_all").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        frames = feed.events(*[spark.read.parquet(folders[n]) for n in ("logs", "anomalies", "runs")])
        streamed = counted(spark.table("feed_all"))
        assert streamed == counted(feed.event_counts(frames))
        return streamed

    day = datetime(2026, 1, 1)
    add("logs", REQUEST_LOG_FIELDS, "id string, source string, outcome string, parsed_lot_count int, created_at timestamp", ("1", "a", "success", 5, day))
    add("anomalies", ANOMALY_FIELDS, "source string, severity string, message string, created_at timestamp", ("a", "critical", "m", day), ("b", "warning", "m", day))
    run(("r1", "a", "running", day, None, None, None), ("r2", "b", "running", day, None, None, None))
    assert drain() == {("a", "progress"): (1, 5), ("a", "error"): (1, 0), ("b", "warning"): (1, 0), ("a", "start"): (1, 0), ("b", "start"): (1, 0)}
    ended = datetime(2026, 1, 1, 3)
    run(("r1", "a", "success", day, ended, 5, None), ("r2", "b", "error", day, ended, 0, "lost"), ("r1", "a", "success", day, ended, 5, None))
    assert drain() == {
        ("a", "progress"): (1, 5), ("a", "error"): (1, 0), ("b", "warning"): (1, 0), ("a", "start"): (1, 0), ("b", "start"): (1, 0),
        ("a", "complete"): (1, 5), ("b", "error"): (1, 0),
    }
