"""What large jobs must not do: parse items twice for one tally, or carry in a shuffle what is not asked for."""

from __future__ import annotations

import json
from html import unescape
from html.entities import html5

from pyspark.sql import functions as F
from samples import API_ITEM, LIST_ITEM

from lotledger.functions.text import NAMED, html_unescape
from lotledger.operators import list_items, tallies
from lotledger.plans import ingest_queries


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_tally_parses_its_items_once(spark):
    told = [
        ("r", 1, "a", "T"), ("r", 1, "a", "T"), ("r", 2, "a", "T"), ("r", 2, "b", "T"), ("r", 2, "b", None), ("s", 2, "a", "T"),
        ("s", 3, "c", None), (None, 4, "d", "T"), ("r", None, "d", "T"), ("r", None, "a", "T"),
    ]
    rows = [
        (run, page, (n, page or 0), json.dumps({**LIST_ITEM, "url": url, "title": name and LIST_ITEM["title"]}))
        for n, (run, page, url, name) in enumerate(told)
    ]
    items = spark.createDataFrame(rows, "run_id string, page long, ord struct<n:int,page:long>, j string")
    parsed = list_items.first_site_lots(items.withColumn("item", F.try_parse_json("j")))
    tally = tallies.page_tally(parsed.withColumn("canonical_url", F.col("lot.canonical_url")))
    assert plan(tally).count("LogicalRDD") == 1
    found = {(r.run_id, r.page): (r.raw_item_count, r.parsed_lot_count, r.duplicate_count, r.skip_counts) for r in tally.collect()}
    # A lot without a known run or page is nobody's first.
    assert found == {
        ("r", 1): (2, 1, 1, {}), ("r", 2): (3, 1, 1, {"no_title": 1}), ("s", 2): (1, 1, 0, {}), ("s", 3): (1, 0, 0, {"no_title": 1}),
        (None, 4): (1, 0, 1, {}), ("r", None): (2, 0, 2, {}),
    }
    assert dict(tally.dtypes) == {
        "run_id": "string", "page": "bigint", "raw_item_count": "bigint", "parsed_lot_count": "bigint", "duplicate_count": "bigint",
        "skip_counts": "map<string,int>",
    }


def test_names_are_looked_up_by_their_letter(spark):
    texts = [f"a&{n}b" for n in html5] + ["&h=2", "&notit;x", "&resize=300&amp;b", "&q;", "&zwnjx", "&a", "&_x;", "&Z1;", "&ééé;", "&frac12x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    resolved = rows.select("t", html_unescape(F.col("t")).alias("u"))
    assert isinstance(json.loads(NAMED), list) and max(len(part) for part in json.loads(NAMED)) < len(html5) // 10
    assert [r for r in resolved.collect() if r.u != unescape(r.t)] == []


def test_a_replay_reads_its_pages_once(spark, monkeypatch):
    pages = [
        ("two", "bring_a_trailer", json.dumps({"items": [LIST_ITEM, {**LIST_ITEM, "id": 2, "url": "https://x/2"}], "pages_total": 3})),
        ("none", "bring_a_trailer", json.dumps({"items": []})), ("bad", "bring_a_trailer", "{"), ("lost", "bring_a_trailer", json.dumps({"items": [None]})),
        ("c", "cars_and_bids", json.dumps({"auctions": [API_ITEM]})), ("c0", "cars_and_bids", json.dumps({"auctions": []})),
    ]
    rows = spark.createDataFrame(
        [(i, s, "bat_api_completed_results" if s[0] == "b" else "search", f"https://x/{i}", "application/json", c) for i, s, c in pages],
        "id string, source string, target_type string, url string, content_type string, content string",
    ).withColumn("fetched_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    monkeypatch.setattr(ingest_queries.derived, "result_pages", lambda *_: rows)
    monkeypatch.setattr(ingest_queries.derived, "captured_answers", lambda *_: rows.where("false"))
    once, again = (ingest_queries._replayed(spark, "", both_sites=True, pages_again=p) for p in (True, False))
    for part in ("parse_runs", "anomalies"):
        found, wanted = (getattr(r, part) for r in (once, again))
        assert {f.split("/")[-2] for f in found.inputFiles()} <= {"items", "identities"}
        texts = lambda df: sorted(r.t for r in df.select(F.to_json(F.struct(*df.columns)).alias("t")).collect())
        assert found.columns == wanted.columns and texts(found) == texts(wanted) != []
    assert [r.status for r in once.parse_runs.where("raw_page_id = 'bad'").collect()] == ["error"]
