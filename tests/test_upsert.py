from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotledger.operators import upsert
from lotledger.schemas import DETAIL_FIELDS, LOT_FIELDS, RECORD_FIELDS, ddl

BASE = datetime(2026, 1, 1)


def now():
    return F.lit(datetime(2026, 5, 1))


def record(**values):
    full = {name: None for name in RECORD_FIELDS}
    full |= {"source": "a", "canonical_url": "https://u/1", "auction_status": "sold", "currency": "USD",
             "vehicle_details": {}, "list_payload": "{}", "detail_payload": "{}", "image_urls": []}
    return full | values


def frame(spark, rows):
    schema = T._parse_datatype_string(ddl({**RECORD_FIELDS, "ord": "long"}))
    return spark.createDataFrame([tuple({**r, "ord": i}[f.name] for f in schema) for i, r in enumerate(rows)], schema)


def stored(spark, rows):
    schema = T._parse_datatype_string(ddl(LOT_FIELDS))
    full = [{**r, "created_at": BASE, "updated_at": BASE} for r in rows]
    return spark.createDataFrame([tuple(r[f.name] for f in schema) for r in full], schema)


def one_by_one(current, incoming):
    """The rule, applied record by record."""
    if current is None:
        return dict(incoming)
    keeps = incoming["detail_scraped_at"] is None and current["detail_scraped_at"] is not None
    state = dict(current)
    for name, value in incoming.items():
        if name == "image_urls" and keeps:
            continue
        if keeps and name in DETAIL_FIELDS:
            if value is None or value in ({}, "{}"):
                continue
            if name == "vehicle_details":
                value = {**current[name], **value}
        state[name] = value
    return state


def random_record(rng, lot, turn):
    detailed = rng.random() < 0.35
    pick = lambda *options: rng.choice(options)
    return record(
        source_auction_id=str(lot), canonical_url=f"https://u/{lot}", high_bid=rng.randrange(100),
        auction_status=pick("sold", "reserve_not_met"), bid_count=pick(None, rng.randrange(50)),
        mileage=pick(None, rng.randrange(9)), seller=pick(None, "x", "y"), vin=pick(None, "v"), engine=pick(None, "", "e"),
        vehicle_details=pick({}, {"a": str(turn)}, {"b": "null", "c": str(turn)}),
        detail_payload=pick("{}", f'{{"t":{turn}}}'), detail_html="h" if detailed else None,
        detail_scraped_at=BASE + timedelta(hours=rng.randrange(99)) if detailed else None,
        image_urls=pick([], ["p"], ["q", "p"]), title=pick(None, "t"),
    )


def test_closed_form_equals_record_by_record(spark):
    rng = random.Random(7)
    lots, records, expected = range(150), [], {}
    before = {}
    for lot in lots:
        if rng.random() < 0.5:
            before[lot] = random_record(rng, lot, 0)
    for turn in range(1, 900):
        lot = rng.choice(lots) if rng.random() > 0.33 else 0
        records.append(random_record(rng, lot, turn))
    for lot, row in before.items():
        expected[lot] = dict(row)
    for row in records:
        lot = int(row["source_auction_id"])
        expected[lot] = one_by_one(expected.get(lot), row)
    touched = {int(r["source_auction_id"]) for r in records}
    existing = stored(spark, [{**row, "id": f"lot-{lot}"} for lot, row in before.items()])
    result = upsert.upsert_lots(existing, frame(spark, records), now())
    got = {int(r.source_auction_id): r for r in result.lots.collect()}
    assert got.keys() == touched and result.conflicts.count() == 0
    for lot, row in got.items():
        assert row.inserted == (lot not in before)
        for name in RECORD_FIELDS:
            want = expected[lot][name]
            assert row[name] == want, (lot, name)
    assert sum(r.record_count for r in got.values()) == len(records)
    whole = upsert.apply_changes(existing, result.lots)
    assert whole.count() == len(touched | before.keys())


def test_identity(spark):
    existing = stored(spark, [
        {**record(source_auction_id="1", canonical_url="https://u/1"), "id": "one"},
        {**record(source_auction_id=None, canonical_url="https://u/2"), "id": "two"},
        {**record(source_auction_id="3", canonical_url="https://u/3"), "id": "three"},
    ])
    rows = [
        record(source_auction_id="1", canonical_url="https://u/new"),  # id wins over an unknown url
        record(source_auction_id=None, canonical_url="https://u/1"),  # url of a known lot
        record(source_auction_id="2", canonical_url="https://u/2"),  # url match, the id is new
        record(source_auction_id=None, canonical_url="https://u/new"),  # url known from the batch
        record(source="b", source_auction_id="1", canonical_url="https://u/1"),  # another source
        record(source_auction_id="9", canonical_url="https://u/9"),
        record(source_auction_id="", canonical_url="https://u/9"),
        record(source_auction_id="1", canonical_url="https://u/3"),  # id and url disagree
        record(source_auction_id=None, canonical_url="https://u/3"),  # the url's stored lot, whatever the row before
        record(source_auction_id="7", canonical_url="https://u/7"),
        record(source_auction_id="8", canonical_url="https://u/7"),  # two ids on one url
    ]
    result = upsert.resolve_identities(existing, frame(spark, rows)).collect()
    found = {(r.source, r.source_auction_id, r.canonical_url[-1]): (r.lot_id, r.conflict) for r in result}
    assert found[("a", None, "1")] == found[("a", "1", "w")] == found[("a", None, "w")] == ("one", None)
    assert found[("a", "7", "7")][1] is None and found[("a", "8", "7")][1] == "url_shared_by_ids"
    assert found[("a", "1", "3")] == ("one", "id_and_url_disagree")
    assert found[("a", None, "3")] == ("three", None)
    assert found[("a", "2", "2")] == ("two", None)
    assert found[("b", "1", "1")][1] is None and len(found[("b", "1", "1")][0]) == 64
    assert found[("a", "9", "9")][0] == found[("a", None, "9")][0]


def test_conflicts_lose_no_record(spark):
    existing = stored(spark, [
        {**record(source_auction_id="1", canonical_url="https://u/1"), "id": "one"},
        {**record(source_auction_id="5", canonical_url="https://u/5"), "id": "five"},
    ])
    rows = [
        record(source_auction_id="A", canonical_url="https://u/s", high_bid=1),
        record(source_auction_id="B", canonical_url="https://u/s", high_bid=2, title="whole", vehicle_details={"k": "v"}),
        record(source_auction_id=None, canonical_url="https://u/s", high_bid=3),
        record(source_auction_id="B", canonical_url="https://u/b", high_bid=4),  # the id's other url is merged
        record(source_auction_id="1", canonical_url="https://u/5", high_bid=5),  # disagrees with the stored lot
        record(source_auction_id="5", canonical_url="https://u/5", high_bid=6),
        record(source_auction_id="1", canonical_url="https://u/1", high_bid=7),
    ]
    batch = frame(spark, rows)
    result = upsert.upsert_lots(existing, batch, now())
    lots = {(r.source_auction_id, r.canonical_url[-1]): (r.high_bid, r.record_count) for r in result.lots.collect()}
    assert lots == {(None, "s"): (3, 2), ("B", "b"): (4, 1), ("5", "5"): (6, 1), ("1", "1"): (7, 1)}
    apart = {r.ord: r for r in result.conflicts.collect()}
    assert {k: r.conflict for k, r in apart.items()} == {1: "url_shared_by_ids", 4: "url_shared_by_ids"}
    assert (apart[1].title, apart[1].high_bid, apart[1].vehicle_details) == ("whole", 2, {"k": "v"})
    counted = upsert.run_counters(batch.withColumn("run_id", F.lit("r")), result.identities, existing).first()
    assert tuple(counted) == ("r", 7, 2, 3)


def test_detail_survives_a_later_list_record(spark):
    seen = datetime(2026, 3, 1)
    detailed = record(source_auction_id="1", vin="V", mileage=5, bid_count=3, sold_price=10, detail_html="h",
                      detail_scraped_at=seen, detail_payload='{"a":1}', image_urls=["x", "y"], vehicle_details={"k": "1"})
    later = record(source_auction_id="1", sold_price=20, image_urls=["thumb"], vehicle_details={"n": "2"})
    row = upsert.upsert_lots(stored(spark, []), frame(spark, [detailed, later]), now()).lots.first()
    assert (row.sold_price, row.vin, row.mileage, row.bid_count, row.image_urls) == (20, "V", 5, 3, ["x", "y"])
    assert row.vehicle_details == {"k": "1", "n": "2"} and row.detail_scraped_at == seen
    unsold = record(source_auction_id="1", auction_status="reserve_not_met", high_bid=9, image_urls=["n", "n", ""])
    first = record(source_auction_id="1", sold_price=8, image_urls=["o"])
    row = upsert.upsert_lots(stored(spark, []), frame(spark, [first, unsold]), now()).lots.first()
    assert (row.auction_status, row.sold_price, row.image_urls, row.inserted) == ("reserve_not_met", None, ["n"], True)


def test_page_text_is_carried_once(spark):
    """The state that is shuffled has one column for the text of a detail page, and the identities are kept once."""
    first = frame(spark, [record(source_auction_id="1", detail_html="<p>")])
    state = upsert._states(first.withColumn("at", F.struct(F.lit(1), "ord")), ["source"])
    assert state.schema.simpleString().count("detail_html") == 1 and "detail_html" in str(state.columns)
    calls = []

    def keep(df):
        calls.append(df.columns)
        return df

    result = upsert.upsert_lots(stored(spark, []), first, now(), keep=keep)
    assert result.lots.first().detail_html == "<p>"
    assert len(calls) == 1 and "lot_id" in calls[0]


def test_blank_and_missing_payloads_stay_apart(spark):
    day = BASE + timedelta(days=1)
    told = [("1", [None]), ("2", ["{}"]), ("3", ['{"a":1}', None]), ("4", ['{"a":1}', "{}"])]
    rows = [record(source_auction_id=i, canonical_url=f"https://u/{i}", detail_payload=p) for i, ps in told for p in ps]
    detailed = [dict(r, source_auction_id="d" + r["source_auction_id"], canonical_url=r["canonical_url"] + "d", detail_scraped_at=day) for r in rows]
    lots = upsert.upsert_lots(stored(spark, []), frame(spark, rows + detailed), now()).lots
    found = {r.source_auction_id: r.detail_payload for r in lots.collect()}
    assert found == {"1": None, "2": "{}", "3": None, "4": "{}", "d1": None, "d2": "{}", "d3": None, "d4": "{}"}
