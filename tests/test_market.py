from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from lotledger.operators import market, paging
from lotledger.operators.filters import chart_criteria, keep, like_pattern, listed, market_predicates
from lotledger.operators.medians import profile, value_counts
from lotledger.schemas import LOT_FIELDS, shaped

COLUMNS = ("id string, source string, auction_status string, sold_price int, high_bid int, ended_at timestamp, year int,"
           " make string, model string, trim string, mileage int, exterior_color string, transmission string,"
           " title string, created_at timestamp")
ROWS = [
    ("1", "bring_a_trailer", "sold", 182000, 182000, datetime(2025, 1, 15), 2018, "Porsche", "911", "GT3", 9300, "White", "Manual", "2018 Porsche 911 GT3", datetime(2025, 2, 1)),
    ("2", "cars_and_bids", "sold", 121000, 121000, datetime(2025, 2, 20), 2017, "Audi", "R8", "V10 Plus", 18400, "Blue", "Automatic", "2017 Audi R8", datetime(2025, 2, 2)),
    ("3", "bring_a_trailer", "reserve_not_met", None, 175000, datetime(2025, 3, 10), 2018, "Porsche", "911", "GT3", 12800, "White", "Manual", "2018 Porsche 911 GT3", datetime(2025, 2, 3)),
]
ODD = [
    ("4", "bring_a_trailer", "sold", 0, 0, datetime(2025, 2, 25), None, "", None, None, 0, None, "", None, datetime(2025, 2, 4)),
    ("5", "bring_a_trailer", "withdrawn", None, None, None, 1999, "Lotus", "Elise", None, None, None, None, "100%_x", datetime(2025, 2, 5)),
]


@pytest.fixture(scope="module")
def lots(spark):
    return shaped(spark.createDataFrame(ROWS, COLUMNS), LOT_FIELDS)


@pytest.fixture(scope="module")
def odd(spark):
    return shaped(spark.createDataFrame(ROWS + ODD, COLUMNS), LOT_FIELDS)


def ids(df):
    return [r.id for r in df.collect()]


def test_summary(lots, odd):
    row = market.market_summary(lots).first()
    assert (row.total_count, row.sold_count, row.median_sale_price, row.average_sale_price) == (3, 2, 151500, 151500)
    assert (row.low_sale_price, row.high_sale_price, row.average_mileage, row.sell_through_rate) == (121000, 182000, 13500, 0.667)
    # Anchor 2025-02-20: 30 days back is 2025-01-21, so the Porsche falls into the earlier window.
    assert (row.movement_30_day, row.movement_90_day) == (-33.5, None)
    with_zero = market.market_summary(odd).first()
    # A price of 0 moves the anchor to 2025-02-25 and counts as a sale, but not for the movement.
    assert (with_zero.sold_count, with_zero.median_sale_price, with_zero.low_sale_price) == (3, 121000, 0)
    assert with_zero.movement_30_day == -33.5
    empty = market.market_summary(lots.where("id = 'none'")).first()
    assert (empty.total_count, empty.sold_count) == (0, 0)
    assert all(empty[c] is None for c in empty.asDict() if c not in ("total_count", "sold_count"))


def test_history_trend_histogram(odd):
    history = market.price_history(keep(odd, market_predicates(only_sold=True))).collect()
    assert [tuple(r) for r in history] == [
        (date(2025, 1, 1), 182000, 182000, 182000, 182000, 1), (date(2025, 2, 1), 60500, 60500, 0, 121000, 2)]
    trend = market.price_trend(odd).first()
    assert trend.n == 2 and trend.slope == round((121000 - 182000) / 36, 4)
    assert [tuple(p) for p in trend.points] == [(20103.0, 182000.0), (20139.0, 121000.0)]
    single = market.price_trend(odd.where("id = '1'")).first()
    assert (single.slope, single.intercept, [tuple(p) for p in single.points]) == (0.0, 182000.0, [(20103.0, 182000.0)])
    flat = market.price_trend(odd.where("id in ('1', '2')").withColumn("ended_at", F.lit(datetime(2025, 1, 15)))).first()
    assert (flat.slope, flat.intercept, len(flat.points)) == (0.0, 151500.0, 2)
    assert market.price_trend(odd.where("id = '4'")).count() == 0
    assert [tuple(r) for r in market.price_histogram(odd).collect()] == [("100K", 100, 1), ("150K", 150, 2)]
    assert market.mileage_price_points(odd).count() == 3


def test_facets(odd):
    found = {}
    for r in market.facet_values(odd).collect():
        found.setdefault(r.facet, []).append(r.value)
    assert found["makes"] == ["Audi", "Lotus", "Porsche"] and found["years"] == ["1999", "2017", "2018"]
    assert found["transmissions"] == ["Automatic", "Manual"]
    ranges = market.facet_ranges(odd).first()
    assert (ranges.price_minimum, ranges.date_maximum) == (0, date(2025, 3, 10))


def test_filters(odd):
    assert listed(["a, b", " ", "c"]) == ["a", "b", "c"] and listed(None) == []
    assert ids(keep(odd, market_predicates(make="porsche"))) == []
    assert ids(keep(odd, market_predicates(make=["Porsche,Audi"], year_max=2017))) == ["2"]
    assert ids(keep(odd, market_predicates(ended_from=date(2025, 2, 20), ended_to=date(2025, 3, 10)))) == ["2", "3", "4"]
    assert ids(keep(odd, market_predicates(search=" r8 "))) == ["2"]
    assert ids(keep(odd, market_predicates(search=r"100\%\_x"))) == ["5"]
    assert ids(keep(odd, market_predicates(search="9_1"))) == ["1", "3"]
    assert len(ids(keep(odd, market_predicates(search="  ")))) == 5
    assert like_pattern(r"a\b\%") == r"%ab\%%"
    assert ids(keep(odd, market_predicates(price_min=0, price_max=130000))) == ["2", "4"]
    assert chart_criteria({"auction_status": ["x"], "make": "y"}) == {"make": "y", "only_sold": True}
    with pytest.raises(TypeError):
        market_predicates(colour="x")


def test_order_and_pages(odd):
    order = lambda sort: ids(paging.ordered(odd, paging.sort_keys(sort)))
    assert order("ended_at_desc") == order("unknown") == ["5", "3", "4", "2", "1"]
    assert order("price_asc") == ["4", "2", "1", "5", "3"] and order("price_desc") == ["5", "3", "1", "2", "4"]
    for sort in paging.SORTS:
        keys = paging.sort_keys(sort)
        paged = [i for n in (1, 2, 3) for i in ids(paging.page(odd, n, 2, keys))]
        assert paged == order(sort)
        walked, last = [], None
        while True:
            rows = (paging.page(odd, 1, 2, keys) if last is None else paging.page_after(odd, last, 2, keys)).collect()
            if not rows:
                break
            walked += [r.id for r in rows]
            last = {k.column: rows[-1][k.column] for k in keys}
        assert walked == order(sort)
    assert ids(paging.page(odd, 1, 1000, paging.sort_keys())) == order("ended_at_desc")  # pages have no greatest size
    for number, size in ((0, 10), (1, 0)):
        with pytest.raises(ValueError):
            paging.page(odd, number, size, paging.sort_keys())


def test_profile_matches_sorted_middle(spark):
    import random
    import statistics

    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.4 else f"g{rng.randrange(9)}", rng.choice([0, 7, 65535, 65536, 70000, 2**31 - 1, rng.randrange(10**7)]))
            for _ in range(4000)]
    counts = value_counts(spark.createDataFrame(rows, "g string, v int"), ["g"], "v")
    got = {r.g: (r.n, r.total, r.lowest, r.highest, r.median) for r in profile(counts, ["g"], "v").collect()}
    for g in {g for g, _ in rows}:
        values = [v for k, v in rows if k == g]
        assert got[g] == (len(values), sum(values), min(values), max(values), float(statistics.median(values)))


def test_images_and_details(spark, lots):
    with_images = lots.withColumn("image_urls", F.array(F.lit("a"), F.lit(""), F.lit("b"), F.lit("a")))
    rows = market.image_rows(with_images.where("id = '1'")).orderBy("position").collect()
    assert [(r.position, r.image_url) for r in rows] == [(0, "a"), (1, "b")]
    detail = market.lot_details(market.by_id(with_images, "1")).first()
    assert [i.image_url for i in detail.images] == ["a", "", "b", "a"] and detail.images[2].position == 2
    assert market.by_id(lots, "none").count() == 0


def test_filters_and_columns_reach_the_scan(spark, odd, tmp_path):
    folder = str(tmp_path / "lots")
    odd.write.parquet(folder)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    wanted = market_predicates(make="Audi,Lotus", year_min=1990, ended_from=date(2025, 1, 1), only_sold=True)
    history = market.price_history(keep(spark.read.parquet(folder), wanted))
    plan = history._jdf.queryExecution().executedPlan().toString()
    for pushed in ("In(make, [Audi,Lotus])", "GreaterThanOrEqual(year,1990)", "EqualTo(auction_status,sold)",
                   "IsNotNull(sold_price)", "GreaterThanOrEqual(ended_at,"):
        assert pushed in plan, pushed
    schema = plan.split("ReadSchema: ")[1].split(">")[0]
    assert "title" not in schema and "detail_html" not in schema
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
