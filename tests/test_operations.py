from __future__ import annotations

import gzip
from datetime import datetime

from pyspark.sql import functions as F

from lotledger.operators import operations, paging, quality, tallies, targets
from lotledger.operators.provenance import match_detail_pages, missing_links
from lotledger.schemas import ANOMALY_FIELDS, LOT_FIELDS, REQUEST_LOG_FIELDS, TARGET_FIELDS, ddl, shaped
from lotledger.sources import raw_pages, seeds, tables
from lotledger.streaming.ingest import Store, current_targets, land_pages, queue_targets


def at(day, hour=0):
    return datetime(2026, 1, day, hour)


def test_source_health(spark):
    runs = spark.createDataFrame(
        [("1", "bring_a_trailer", "success", at(5), at(5, 1), 12, 3, 9), ("2", "bring_a_trailer", "error", at(4), at(4, 1), 0, 0, 0)],
        "id string, source string, status string, started_at timestamp, finished_at timestamp, records_found int,"
        " records_inserted int, records_updated int",
    )
    anomalies = spark.createDataFrame(
        [("1", "bring_a_trailer", "warning", "c", "old", at(1)), ("2", "bring_a_trailer", "critical", "c", "new", at(2))],
        "id string, source string, severity string, code string, message string, created_at timestamp",
    )

    def health(frame, now):
        rows = operations.source_health(frame, anomalies, F.lit(now)).collect()
        return {r.source: r for r in rows}

    found = health(runs, at(6))
    first = found["bring_a_trailer"]
    assert (first.state, first.records_found, first.latest_anomaly_message) == ("idle", 12, "new")
    assert (found["cars_and_bids"].state, found["cars_and_bids"].records_found) == ("stale", 0)
    assert health(runs, at(7))["bring_a_trailer"].state == "stale"
    assert health(runs.where("id = '2'"), at(5))["bring_a_trailer"].state == "error"
    running = runs.withColumn("status", F.lit("running"))
    assert health(running, at(5))["bring_a_trailer"].state == "running"


def test_targets_share_a_fingerprint(spark):
    columns = ("source string, target_type string, url string, priority int, discovered_from string,"
               " metadata map<string,string>, ord long")
    nothing = spark.createDataFrame([], ddl(TARGET_FIELDS))
    found = spark.createDataFrame(
        [("s", "t", "https://X.com/a/", 80, "p1", {"k": '"1"', "a": "1"}, 1), ("s", "t", "https://x.com/a", 20, "p2", {"k": '"2"'}, 2),
         ("s", "t", "https://x.com/a", 90, "p3", {"request_payload": '{"page":2}'}, 3)],
        columns,
    )
    queued = targets.enqueue(nothing, found, F.lit(at(1)))
    rows = {r.discovered_from: r for r in queued.collect()}
    assert rows.keys() == {"p1", "p3"}
    assert (rows["p1"].url, rows["p1"].priority, rows["p1"].metadata) == ("https://X.com/a/", 20, {"k": '"2"', "a": "1"})
    known = shaped(queued, TARGET_FIELDS).withColumn("state", F.lit("fetched"))
    again = targets.enqueue(known, found.where("ord = 1").withColumn("priority", F.lit(5)), F.lit(at(2)))
    row = again.first()
    assert (row.state, row.priority, row.is_new, row.created_at, row.metadata["k"]) == ("fetched", 5, False, at(1), '"1"')
    assert targets.after_enqueue(known, again).count() == 2
    ids = [r.id for r in queued.orderBy("discovered_from").collect()]
    events = spark.createDataFrame(
        [(ids[0], 1, "failed_retryable", "slow", None), (ids[0], 2, "fetched", None, "page"), (ids[1], 1, "blocked", "429", None)],
        "target_id string, ord int, event string, error string, raw_page_id string",
    )
    after = {r.id: r for r in targets.current_state(shaped(queued, TARGET_FIELDS), events).collect()}
    assert (after[ids[0]].state, after[ids[0]].attempts, after[ids[0]].metadata["raw_page_id"]) == ("fetched", 2, '"page"')
    assert (after[ids[1]].state, after[ids[1]].last_error) == ("blocked", "429")
    seeded = targets.seed_targets(seeds.make_entries(spark), ["audi", "bmw"]).collect()
    assert [(r.url, r.priority) for r in seeded] == [("https://bringatrailer.com/audi/", 20), ("https://bringatrailer.com/bmw/", 20)]
    limits = spark.range(1).select(
        targets.page_limit(F.lit(9), "incremental", 5).alias("a"), targets.page_limit(F.lit(9), "backfill", 5).alias("b"))
    assert tuple(limits.first()) == (5, 9)


def test_rules(spark):
    tally = spark.createDataFrame(
        [("r", "p1", 3, 0, 0, {"no_title": 3}), ("r", "p2", 2, 0, 2, {}), ("r", "p3", 0, 0, 0, {})],
        "run_id string, page string, raw_item_count long, parsed_lot_count long, duplicate_count long, skip_counts map<string,int>",
    )
    assert [r.message.split()[2] for r in quality.nothing_parsed(tally).collect()] == ["p1"]
    assert quality.nothing_parsed(tally, "cars_and_bids").count() == 2
    assert quality.no_response(tally).first().code == "no_closed_auction_response"
    empty = spark.createDataFrame([], "key string")
    rows = quality.all_anomalies(quality.empty_directory(empty), quality.no_response(tally))
    assert sorted(r.code for r in rows.collect()) == ["models_directory_empty", "no_closed_auction_response"]
    pages = spark.createDataFrame([("u1", True), ("u2", False)], "url string, detail_error boolean")
    assert [r.url for r in quality.unreadable_details(pages).collect()] == ["u1"]


def test_state_is_merged(spark):
    old = spark.createDataFrame([("s", "m", {"a": "1", "b": "2"}, at(1))], "source string, mode string, state map<string,string>, last_run_at timestamp")
    new = spark.createDataFrame([("s", "m", {"b": "3"}, at(2)), ("t", "m", {"c": "4"}, at(2))], old.schema)
    merged = {r.source: r for r in tallies.merge_state(old, new).collect()}
    assert (merged["s"].state, merged["s"].last_run_at) == ({"a": "1", "b": "3"}, at(2)) and merged["t"].state == {"c": "4"}


def test_detail_pages_find_their_lot(spark):
    lots = shaped(
        spark.createDataFrame(
            [("1", "bring_a_trailer", "https://x.com/a/"), ("2", "bring_a_trailer", "https://x.com/b"), ("3", "bring_a_trailer", "https://x.com/b/")],
            "id string, source string, canonical_url string"), LOT_FIELDS)
    pages = spark.createDataFrame(
        [("p1", "https://x.com/a", "https://x.com/a"), ("p2", "https://x.com/b", "https://x.com/b"), ("p3", "https://x.com/c", "https://x.com/c")],
        "id string, url string, canonical_url string")
    one, several = match_detail_pages(pages, lots)
    assert [(r.id, r.lot_id) for r in one.collect()] == [("p1", "1")] and [r.id for r in several.collect()] == ["p2"]
    links = spark.createDataFrame([("p1", "1", "list"), ("p1", "1", "list"), ("p1", "1", "detail")], "raw_page_id string, lot_id string, relationship_type string")
    assert missing_links(links.where("relationship_type = 'list'"), links).count() == 1


def test_stored_pages_and_logs(spark, tmp_path):
    fetched = spark.createDataFrame(
        [(str(i), "s", "bat_detail_page", f"https://x.com/{i}/", "same" if i < 3 else "é", "text/html; charset=x", at(1)) for i in range(4)],
        "id string, source string, target_type string, url string, content string, content_type string, fetched_at timestamp")
    pages = raw_pages.register_pages(fetched)
    row = pages.where("id = '3'").first()
    assert (row.size_bytes, row.canonical_url, row.metadata) == (2, "https://x.com/3", {"target_priority": "80"})
    assert row.artifact_uri == f"local://s/2026/01/01/{row.content_sha256}.html.gz"
    folder = str(tmp_path / "artifacts")
    raw_pages.save_artifacts(spark, pages, folder)
    raw_pages.save_artifacts(spark, pages, folder)
    assert spark.read.parquet(folder).count() == 2
    assert {r.id: r.content for r in raw_pages.load_artifacts(spark, pages, folder).collect()} == {"0": "same", "1": "same", "2": "same", "3": "é"}
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a.html.gz").write_bytes(gzip.compress(b"<p>\nx</p>"))
    assert [r.content for r in raw_pages.read_page_files(spark, str(tmp_path / "files")).collect()] == ["<p>\nx</p>"]

    logs = spark.createDataFrame([("1", "s", at(1)), ("2", "s", at(9)), ("3", "s", at(9, 12))], "id string, source string, created_at timestamp")
    log = tables.BatchLog(spark, str(tmp_path / "logs"), REQUEST_LOG_FIELDS)
    log.append(logs, "b1")
    log.prune(F.lit(at(12, 6)), 3)
    assert [r.id for r in log.read().collect()] == ["3"]
    found = tables.BatchLog(spark, str(tmp_path / "an"), ANOMALY_FIELDS)
    assert found.read().count() == 0
    found.append(spark.createDataFrame([("s", at(1))], "source string, created_at timestamp"), "b1")
    assert found.read().count() == 1
    assert tables.read_or_empty(spark, str(tmp_path / "none"), ANOMALY_FIELDS).count() == 0


def test_a_log_survives_retries_and_keeps_newer_files(spark, tmp_path):
    log = tables.BatchLog(spark, str(tmp_path / "logs"), REQUEST_LOG_FIELDS)

    def rows(*named):
        return spark.createDataFrame(named, "id string, created_at timestamp")

    log.append(rows(("old", at(1)), ("lost", at(2))), "000000001")  # a first try that told other rows, on other days
    log.append(rows(("old", at(1)), ("early", at(9, 5)), ("late", at(9, 7)), ("new", at(12)), ("undated", None)), "000000001")
    log.append(rows(("alone", at(9, 1)), ("last", at(13))), "000000002")
    assert {r.id for r in log.read().collect()} == {"old", "early", "late", "new", "undated", "alone", "last"}
    newer = lambda: {p: p.stat().st_mtime_ns for d in ("12", "13") for p in (tmp_path / "logs").glob(f"*/day=2026-01-{d}/*.parquet")}
    files = newer()
    # What a prune lost between its steps leaves behind: the kept rows of the split day, still to be put in place.
    split = log.read().where("id = 'late'").drop("day")
    split.write.parquet(str(tmp_path / "logs.kept" / "day=2026-01-09"))
    for _ in range(2):
        log.prune(F.lit(at(12, 6)), 3)
        assert {(r.id, r.batch) for r in log.read().collect()} == {
            ("late", "000000001"), ("new", "000000001"), ("undated", "000000001"), ("last", "000000002"),
        }
    assert len(files) == 2 and newer() == files
    assert not list((tmp_path / "logs").glob("*/day=2026-01-01")) and not list((tmp_path / "logs").glob("batch=000000002/day=2026-01-09"))


def test_landed_pages_move_their_targets(spark, tmp_path):
    store = Store(str(tmp_path / "store"))
    found = spark.createDataFrame(
        [("bring_a_trailer", "t", f"https://x.com/{name}/", 80, {}, i) for i, name in enumerate("abcdef")],
        "source string, target_type string, url string, priority int, metadata map<string,string>, ord int",
    ).withColumn("discovered_from", F.lit(None).cast("string"))
    queue_targets(found, store, "000000000", F.lit(at(1)))

    def land(batch, *pages, **how):
        told = spark.createDataFrame(
            [(i, "bring_a_trailer", "t", f"https://X.com/{name}", status, error, at(day), note) for i, name, status, error, day, note in pages],
            "id string, source string, target_type string, url string, status_code int, fetch_error string, fetched_at timestamp,"
            " metadata map<string,string>",
        )
        land_pages(told, store, batch, **how)

    wait = {"retry_delay_seconds": "90.5"}
    land("000000001", ("1", "a", 200, "", 2, None), ("2", "b", 503, None, 2, wait), ("3", "c", 429, None, 2, None),
         ("4", "d", 404, None, 2, {}), ("5", "e", None, "timed out", 2, wait), ("9", "unknown", 200, None, 2, None))
    second = [("6", "b", None, "reset", 3, wait), ("7", "e", 200, None, 3, None), ("1", "a", 200, "", 2, None)]
    land("000000002", *second)
    land("000000002", *second)  # once more, as after a lost driver
    land("000000003", ("2", "b", 503, None, 2, wait), again=True)  # history read again
    queue_targets(found.where("ord = 0").withColumn("priority", F.lit(5)), store, "000000004", F.lit(at(4)))  # found again
    rows = {r.url[-2]: r for r in current_targets(spark, store).collect()}
    assert {k: (r.state, r.attempts, r.last_error) for k, r in rows.items()} == {
        "a": ("fetched", 1, None), "b": ("pending", 2, "reset"), "c": ("blocked", 1, "BaT returned 429"),
        "d": ("error", 1, "BaT returned 404"), "e": ("fetched", 2, "timed out"), "f": ("pending", 0, None),
    }
    assert rows["a"].priority == 5 and rows["e"].metadata["raw_page_id"] == '"7"' and "raw_page_id" not in rows["b"].metadata
    assert rows["b"].next_fetch_at == datetime(2026, 1, 3, 0, 1, 30, 500000) and rows["e"].next_fetch_at is None

    def ready(when):
        return [r.url[-2] for r in paging.ready_targets(current_targets(spark, store), "bring_a_trailer", F.lit(when), 9).collect()]

    assert sorted(ready(datetime(2026, 1, 3, 0, 1))) == ["f"] and sorted(ready(datetime(2026, 1, 3, 0, 2))) == ["b", "f"]
