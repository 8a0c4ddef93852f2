"""What the plans of large jobs must not do: carry unread fields, put unread lots together, parse a page for each part of a result."""

from __future__ import annotations

import json
from html import unescape

from pyspark.sql import functions as F
from pyspark.sql import types as T
from samples import LIST_ITEM

from lotledger.functions.images import ordered_distinct
from lotledger.functions.text import html_unescape
from lotledger.functions.variants import elements, is_object, loose_number, plain_text, strict_number
from lotledger.operators import detail_pages, list_items, upsert
from lotledger.plans import ingest_queries


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def whole_plan(df):
    """The plan with all its columns, none left out for brevity."""
    setting = "spark.sql.debug.maxToStringFields"
    df.sparkSession.conf.set(setting, "10000")
    try:
        return plan(df)
    finally:
        df.sparkSession.conf.unset(setting)


def one_record(spark):
    columns = {"id": "a", "source": "s", "source_auction_id": "1", "canonical_url": "u", "transmission": "A", "title": "T", "trim": "t"}
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()])
    return row.withColumns({
        "ended_at": F.lit("1998-01-01").cast("timestamp_ntz"), "detail_scraped_at": F.lit(None).cast("timestamp_ntz"),
        "seen": F.struct(F.lit(1).alias("n")), "ord": F.struct(F.lit(1).alias("n")),
    })


def test_early_lots_carry_the_needed_fields_only(spark, monkeypatch):
    monkeypatch.setattr(ingest_queries, "_records", lambda *_: one_record(spark))
    stored, late = ingest_queries._early_and_late(spark, "", *upsert.RAW_KEY)
    assert stored.columns == ["id", *upsert.RAW_KEY] and late.columns == ["ord", *upsert.RAW_KEY]
    assert "T AS title" not in plan(stored) and stored.count() == 1


def test_rejects_put_no_lot_together(spark):
    rows = spark.createDataFrame([(json.dumps(i),) for i in (LIST_ITEM, {**LIST_ITEM, "title": None})], "j string")
    parsed = list_items.first_site_lots(rows.select(F.try_parse_json("j").alias("item")))
    lost = list_items.rejected(parsed)
    assert "vehicle_details" not in plan(lost) and "ArrowEvalPython" not in plan(lost)
    assert [r.skip_reason for r in lost.collect()] == ["no_title"]
    assert [r.lot is None for r in parsed.orderBy("skip_reason").collect()] == [False, True]


def test_replayed_items_are_parsed_once(spark, monkeypatch):
    monkeypatch.setattr(ingest_queries.derived, "result_pages", lambda *_: spark.createDataFrame(
        [("p", "bring_a_trailer", "bat_api_completed_results", "https://x/", "application/json", json.dumps({"items": [LIST_ITEM]}))],
        "id string, source string, target_type string, url string, content_type string, content string",
    ).withColumn("fetched_at", F.lit("2024-01-01").cast("timestamp_ntz")))
    parsed = ingest_queries._replayed(spark, "", pages_again=True)
    for part in (parsed.lots, parsed.links, parsed.parse_runs, parsed.anomalies):
        assert "parse_json" not in plan(part) and "VariantExpressionEvalUtils.parse" not in plan(part)
    assert [r.record_count for r in parsed.lots.collect()] == [1]
    assert [(r.status, r.records_found) for r in parsed.parse_runs.collect()] == [("success", 1)]


def test_character_references(spark):
    texts = [
        "", "&", "&&amp;", "a & b", "&notit;", "&am", "&AMP;amp;", "&#;", "&#x;", "&#00065;x", "&#128;", "&#0;", "&#xd800;", "&#65279;",
        "&#x1f600;", "&#x110000;", "&#99999999999;", "&#11;", "&#xfdd0;", "&acE;", "&" + "q" * 40 + ";", "\U0001f600&lt;\n&gt", None,
    ]
    rows = spark.createDataFrame([(t,) for t in texts], T.StructType([T.StructField("t", T.StringType())]))
    for r in rows.select("t", html_unescape(F.col("t")).alias("u")).collect():
        assert r.u == (None if r.t is None else unescape(r.t))


def test_distinct_urls_keep_their_order(spark):
    rows = spark.range(1).select(F.array(*[F.lit(u) for u in ("b", "", "a", "b")], F.lit(None)).alias("u"), F.lit(None).cast("array<string>").alias("n"))
    assert rows.select(ordered_distinct(F.col("u")), ordered_distinct(F.col("n"))).first()[:] == (["b", "a"], None)


def test_a_lot_reads_each_field_of_its_item_once(spark):
    rows = spark.createDataFrame([(json.dumps(LIST_ITEM),)], "j string").select(F.try_parse_json("j").alias("item"))
    for lots in (list_items.first_site_lots(rows), list_items.second_site_lots(rows, F.lit("2026-01-01").cast("timestamp"))):
        text = whole_plan(lots)
        for name in ("bid_count", "image", "image_url", "images"):
            assert text.count(f"$['{name}']") == 1, name


def test_kinds_of_values(spark):
    values = ['"a"', '""', '" 12 "', '"x 1,200 y"', "5", "5.5", "true", "null", "[1]", "[]", '{"a":1}', "{}", None]
    rows = spark.createDataFrame([(v,) for v in values], "j string").select("j", F.try_parse_json("j").alias("v"))
    found = rows.select(
        "j", plain_text(F.col("v")).alias("text"), loose_number(F.col("v")).alias("loose"), strict_number(F.col("v")).alias("strict"),
        F.size(elements(F.col("v"))).alias("members"), F.coalesce(is_object(F.col("v")), F.lit(False)).alias("object"),
    ).collect()
    assert {r.j: r[1:] for r in found} == {
        '"a"': ("a", None, None, 0, False), '""': (None, None, None, 0, False), '" 12 "': (" 12 ", 12, 12, 0, False),
        '"x 1,200 y"': ("x 1,200 y", 1200, None, 0, False), "5": ("5", 5, 5, 0, False), "5.5": ("5.5", 5, 5, 0, False),
        "true": ("true", 1, 1, 0, False), "null": (None, None, None, 0, False), "[1]": (None, None, None, 1, False),
        "[]": (None, None, None, 0, False), '{"a":1}': (None, None, None, 0, True), "{}": (None, None, None, 0, True),
        None: (None, None, None, 0, False),
    }


def test_bullets_are_lowered_once(spark):
    page = "<strong>Listing Details</strong><ul><li>Chassis: ab</li><li>12k Miles</li><li>AWD</li><li>Manual Trans</li></ul>"
    read = detail_pages.detail_payload(spark.createDataFrame([(page + '<div class="POST-EXCERPT"><img src="/wp-content/uploads/a.jpg"></div></div>',)], "html string"))
    assert whole_plan(read).count("lower(") <= 4
    row = read.first().detail
    assert (row.extracted.chassis, row.extracted.mileage, row.extracted.drivetrain, row.extracted.transmission) == ("AB", 12000, "AWD", "Manual Trans")
    assert row.image_urls == ["/wp-content/uploads/a.jpg"]
