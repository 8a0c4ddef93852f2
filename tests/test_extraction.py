from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from samples import API_ITEM, DETAIL_PAGE, LIST_ITEM, result_html

from lotledger.functions import urls
from lotledger.functions.identifiers import chassis_identifier, is_vin
from lotledger.functions.text import visible_text
from lotledger.functions.titles import display_name, is_non_car
from lotledger.operators import detail_pages, list_items
from lotledger.sources import seeds
from lotledger.sources.listing_pages import captured_auctions, exploded_items, with_paging, with_payload

THEN = datetime(2026, 5, 1)


def parse(spark, items, second=False):
    rows = [(i, json.dumps(item)) for i, item in enumerate(items)]
    df = spark.createDataFrame(rows, "n int, j string").select("n", F.try_parse_json("j").alias("item"))
    parsed = list_items.second_site_lots(df, F.lit(THEN)) if second else list_items.first_site_lots(df)
    return [(r.skip_reason, r.lot) for r in parsed.orderBy("n").collect()]


def test_list_item_values(spark):
    changes = [
        {},
        {"sold_text": "Bid to USD $88,000 on 7/14/25", "current_bid": None},
        {"current_bid": " "},
        {"current_bid": "USD $96,750"},
        {"sold_text": "Sold for USD $1,000", "timestamp_end": 1751500806},
        {"sold_text": "Sold for USD $1,000", "timestamp_end": 1751500806000},
        {"sold_text": "Listing Withdrawn at $5 on 12/31/1998"},
        {"sold_text": "Reserve not met $7 on 1/2/70", "id": None, "noreserve": 1},
        {"title": "11k-Mile 2016 Mercedes-AMG GT S"},
        {"title": "2,300-Mile 2001 Land Rover Discovery SE Estoril Blue"},
        {"title": "32.3k-Mile No Reserve: 1967 Alfa Romeo Duetto"},
        {"title": "1967 Lotus"},
        {"bids": "17 bids", "bid_count": None},
        {"images": ["https://i/a.jpg", {"src": "https://i/b.jpg"}, 5, {"url": 7}], "image": "https://i/a.jpg"},
    ]
    lots = [lot for reason, lot in parse(spark, [{**LIST_ITEM, **c} for c in changes])]
    first = lots[0]
    assert (first.source, first.source_auction_id, first.auction_status) == ("bring_a_trailer", "70412233", "sold")
    assert (first.sold_price, first.high_bid, first.bid_count, first.year) == (96500, 96500, 31, 2011)
    assert (first.make, first.model, first.trim) == ("Audi", "R8", "V10 Spyder")
    assert first.ended_at == datetime(2025, 7, 14) and first.location == "Canada"
    assert first.vehicle_details == {"country": '"Canada"', "no_reserve": "false"}
    assert json.loads(first.list_payload) == LIST_ITEM
    assert (lots[1].auction_status, lots[1].sold_price, lots[1].high_bid) == ("reserve_not_met", None, 88000)
    assert [lot.high_bid for lot in lots[2:4]] == [96500, 96750]
    assert {lot.ended_at for lot in lots[4:6]} == {datetime(2025, 7, 3, 0, 0, 6)}
    assert (lots[6].auction_status, lots[6].ended_at) == ("withdrawn", datetime(1998, 12, 31))
    assert (lots[7].auction_status, lots[7].ended_at, lots[7].source_auction_id) == (
        "reserve_not_met", datetime(1970, 1, 2), None)
    assert lots[7].vehicle_details["no_reserve"] == "true"
    assert (lots[8].mileage, lots[8].make, lots[8].model, lots[8].trim) == (11000, "Mercedes-AMG", "GT", "S")
    assert (lots[9].mileage, lots[9].make, lots[9].exterior_color) == (2300, "Land Rover", "Blue")
    assert (lots[10].mileage, lots[10].make, lots[10].model, lots[10].trim) == (32299, "Alfa Romeo", "Duetto", None)
    assert (lots[11].make, lots[11].model) == (None, None)
    assert lots[12].bid_count == 17
    assert lots[13].image_urls == ["https://i/a.jpg", "https://img.example/thumb.jpg", "https://i/b.jpg"]


def test_list_item_reasons(spark):
    cases = [
        ({"title": ""}, "no_title"), ({"title": None}, "no_title"), ({"title": 5}, "parse_error"),
        ({"title": "Spare Audi R8 Bucket Seats"}, "parts_or_non_car"),
        ({"title": "19&quot; Wheels"}, "parts_or_non_car"), ({"title": "1971 Airstream Overlander"}, "parts_or_non_car"),
        ({"title": "AJS Model 16"}, "parts_or_non_car"), ({"title": "1958 Porsche-Diesel Standard"}, "parts_or_non_car"),
        ({"url": ""}, "no_url"), ({"title": "Porsche 911"}, "no_year"), ({"sold_text": "Sold on 7/14/25"}, "no_price"),
        ({"sold_text": "Sold for $0 on 7/14/25"}, "no_price"), ({"sold_text": "Sold for $, on 7/14/25"}, "parse_error"),
        ({"sold_text": None}, "parse_error"), ({"sold_text": "Sold for $5"}, "no_end_date"),
        ({"sold_text": "Sold for $5 on 2/30/26"}, "no_end_date"), ({"title": ",-Mile 1997 Lotus Elise"}, "parse_error"),
    ]
    found = parse(spark, [{**LIST_ITEM, **change} for change, _ in cases] + [5])
    assert [reason for reason, _ in found] == [reason for _, reason in cases] + ["parse_error"]
    absent = {k: v for k, v in LIST_ITEM.items() if k != "sold_text"}
    assert parse(spark, [absent])[0][0] == "no_price"


def test_api_items(spark):
    changes = [
        {}, {"status": "no_sale", "sale_amount": None}, {"seller": "plain", "main_photo": {"url": "https://i/1.jpg"}},
        {"auction_end": None, "mileage": None, "transmission": 6, "location": {"a": 1}, "bid_count": 0, "num_bids": "7"},
        {"photos": ["https://i/p.jpg", {"large_url": "https://i/l.jpg"}], "main_photo": None, "drivetrain": True},
    ]
    lots = [lot for _, lot in parse(spark, [{**API_ITEM, **c} for c in changes], second=True)]
    first = lots[0]
    assert first.canonical_url == "https://carsandbids.com/auctions/qz81kd/"
    assert (first.sold_price, first.high_bid, first.bid_count, first.mileage) == (24750, 24750, 27, 41300)
    assert first.ended_at == datetime(2025, 11, 3, 20, 15, 9, 250000)
    assert (first.exterior_color, first.seller) == ("Blue", "northfork")
    assert first.image_urls == ["https://media.example/qz81kd/front.jpg"]
    assert first.vehicle_details == {"transmission": '"Manual"', "no_reserve": "false", "seller": '{"username":"northfork"}'}
    assert (lots[1].auction_status, lots[1].sold_price, lots[1].high_bid) == ("reserve_not_met", None, 24750)
    assert (lots[2].seller, lots[2].image_urls) == ("plain", ["https://i/1.jpg"])
    assert (lots[3].ended_at, lots[3].mileage, lots[3].transmission, lots[3].location) == (THEN, None, "6", None)
    assert lots[3].bid_count == 7
    assert lots[4].image_urls == ["https://i/p.jpg", "https://i/l.jpg"] and lots[4].drivetrain == "true"
    reasons = [{"id": ""}, {"title": None}, {"title": "Porsche 911"}, {"sale_amount": None}, {"sale_amount": 0},
               {"status": "withdrawn", "sale_amount": None, "current_bid": 0}, {"mileage": 5}]
    assert [r for r, _ in parse(spark, [{**API_ITEM, **c} for c in reasons], second=True)] == [
        "no_url", "no_title", "no_year", "no_price", "no_price", "no_price", "parse_error"]


def test_detail_page(spark):
    df = spark.createDataFrame([(1, DETAIL_PAGE), (2, "<html></html>"), (3, "<strong>Listing Details</strong><ul><li>. k Miles</li></ul>")], "n int, html string")
    rows = {r.n: r for r in detail_pages.detail_payload(df).collect()}
    d = rows[1].detail
    assert (d.seller, d.location, d.seller_type, d.lot_number, d.bid_count) == (
        "some & seller", "Duluth, Minnesota", "Dealer", "118204", 1206)
    assert d.description == "Fine & dandy" and json.loads(d.product_payload)["@type"] == "Product"
    assert d.image_urls == ["https://b.example/hero.jpg", "https://b.example/wp-content/uploads/intro.jpg",
                            "https://b.example/wp-content/uploads/second.jpg"]
    e = d.extracted
    assert (e.chassis, e.mileage, e.exterior_color, e.interior_color) == (
        "WUARNAFG5BN000417", 18000, "Estoril Blue Paint", "Brown Leather Upholstery")
    assert (e.transmission, e.drivetrain, e.engine) == ("Six-Speed R Tronic Transaxle", "All-Wheel Drive", "5.2-Liter V10")
    assert len(d.listing_details) == 10 and "21-Gallon Fuel Tank, 2.5-liter" in d.listing_details
    assert rows[2].detail.listing_details == [] and rows[2].detail.bid_count is None and not rows[2].detail_error
    assert rows[3].detail_error


def test_bid_count_forms(spark):
    forms = [
        ('<span class="x number-bids-value y">37</span>', 37),
        ('<td class="listing-stats-label">Bids</td> <td class="listing-stats-value">24</td>', 24),
        ('<b class="bid-count">1,204 bids</b>', 1204), ("<p><b> 9 </b> <i>bids</i></p>", 9), ("it had 12 bids", None),
    ]
    df = spark.createDataFrame([(i, f) for i, (f, _) in enumerate(forms)], "n int, h string")
    got = [r.b for r in df.select("n", detail_pages.bid_count(F.col("h")).alias("b")).orderBy("n").collect()]
    assert got == [n for _, n in forms]


@pytest.mark.parametrize(
    "text, year, identifier, vin",
    [
        ("Chassis: VIN: 1HGEJ8144XL000123", 2000, "1HGEJ8144XL000123", True),
        ("Chassis: bk4410237, Model#20733", 1973, "BK4410237", True),
        ("Chassis: WP0ZZZ99Z3S69O123", 2003, "WP0ZZZ99Z3S69O123", False),
        ("Chassis No.: serial # 12  34", None, "12 34", True),
        ("Chassis number: Serial #: 12  34", 1990, "12 34", False),
        ("Chassis: ", 1990, None, None),
    ],
)
def test_chassis(spark, text, year, identifier, vin):
    df = spark.createDataFrame([(text, year)], "t string, y int")
    row = df.select(chassis_identifier(F.col("t")).alias("c"), F.col("y")).select("c", is_vin(F.col("c"), F.col("y")).alias("v")).first()
    assert row.c == identifier
    if identifier is not None:
        assert row.v is vin


def test_result_pages_and_directory(spark, tmp_path):
    pages = spark.createDataFrame(
        [
            ("1", "bat_model_page", "text/html", result_html([LIST_ITEM, {**LIST_ITEM, "id": 2}], 214, {"k": 1})),
            ("2", "bat_model_page", "text/html", "<script>var auctionsCompletedInitialData = {broken};</script>"),
            ("3", "bat_api_completed_results", "text/plain", json.dumps({"items": [LIST_ITEM], "pages_total": " ", "base_filter": {"k": 1}})),
            ("4", "other", "application/json", "no json"),
        ],
        "id string, target_type string, content_type string, content string",
    )
    loaded = with_paging(with_payload(pages))
    rows = {r.id: r for r in loaded.drop("payload").collect()}
    assert (rows["1"].pages_total, rows["1"].items_total, rows["1"].item_count, rows["1"].base_filter) == (214, 5121, 2, '{"k":1}')
    assert (rows["2"].pages_total, rows["2"].item_count) == (1, 0)
    assert (rows["3"].pages_total, rows["3"].item_count, rows["3"].base_filter) == (1, 1, "{}")
    assert rows["4"].item_count == 0
    assert [(r.id, r.pos) for r in exploded_items(loaded).orderBy("id", "pos").collect()] == [("1", 0), ("1", 1), ("3", 0)]

    link = '<a class="x previous-listing-image-link" href="{}"><div>\n<img src="s" alt="{}"></a>'
    html = "".join(
        link.format(*p) for p in [
            ("https://bringatrailer.com/porsche/911/", "Porsche 911 &amp; 912"), ("https://bringatrailer.com/wheels/", "Wheels"),
            ("https://bringatrailer.com/bmw/motorcycles/", "BMW"), ("https://bringatrailer.com/x/", "Airstream"),
            ("https://bringatrailer.com/porsche/911/", "Again"), ("https://bringatrailer.com/chevrolet/corvette/", "Corvette"),
        ]
    )
    entries = seeds.model_entries(spark.createDataFrame([("1", html)], "id string, content string")).collect()
    assert [(e.key, e.label, e.path) for e in entries] == [("porsche-911", "Porsche 911 & 912", "porsche/911")]
    assert seeds.make_entries(spark).count() == 44
    assert seeds.search_entries(spark).count() == 1 and seeds.search_entries(spark, ["audi"]).count() == 0

    (tmp_path / "answer.json").write_text(json.dumps({"auctions": [API_ITEM, API_ITEM], "count": 2, "total": 9}, indent=1))
    captured = captured_auctions(spark, str(tmp_path)).drop("item").collect()
    assert [(r.pos, r["count"], r.total) for r in captured] == [(0, 2, 9), (1, 2, 9)]


def test_urls(spark):
    cases = {
        "http://A.Example.com/x/?b=2&a=1#top": "http://a.example.com/x?a=1&b=2",
        "HTTPS://A.com": "https://a.com/",
        "https://x.com/p?q=a+b%20c&z&=3&&~*=%7E": "https://x.com/p?=3&q=a+b+c&z=&~%2A=~",
        " https://x.com/Path/To/ ": "https://x.com/Path/To",
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    assert {r.u: r.c for r in df.select("u", urls.canonical_url(F.col("u")).alias("c")).collect()} == cases


def test_small_text_functions(spark):
    df = spark.createDataFrame([("<p>a&nbsp;&amp;  b</p><br>c", "2019 Porsche 911")], "h string, t string")
    row = df.select(
        visible_text(F.col("h")).alias("v"), is_non_car(F.col("t")).alias("n"),
        display_name(F.lit(None).cast("string"), F.lit(1990), F.lit("")).alias("a"),
        display_name(F.lit(None).cast("string"), F.lit(None).cast("string")).alias("b"),
    ).first()
    assert tuple(row) == ("a & b c", False, "1990", "Unknown vehicle")
