"""Sale texts, auction status, end times and bid counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotledger.functions.text import matched
from lotledger.functions.variants import loose_number

# Status names and the limits of the end-time field, field names that may hold a bid count.
SOLD, NOT_MET, WITHDRAWN, UNKNOWN = "sold", "reserve_not_met", "withdrawn", "unknown"
MILLISECONDS_ABOVE = 10_000_000_000
LAST_SECOND_OF_9999 = 253_402_300_799
BID_COUNT_KEYS = ["bid_count", "bids", "num_bids"]
# End of fixed values.


def is_sold_text(text: Column) -> Column:
    return F.startswith(text, F.lit("Sold"))


def price_digits(text: Column) -> Column:
    """Digits and commas of the first dollar amount."""
    return matched(text, r"\$([\d,]+)")


def date_parts(text: Column) -> Column:
    """[month, day, year] of `on M/D/YY` or `on M/D/YYYY`; NULL without a date."""
    return F.split(matched(text, r"on\s+(\d{1,2}/\d{1,2}/\d{2,4})"), "/")


def sale_date(parts: Column) -> Column:
    """Midnight of that day; two-digit years from 69 on are 19xx, impossible days are NULL."""
    digits, number = F.length(parts[2]), parts[2].cast("int")
    year = (
        F.when((digits == 2) & (number >= 69), number + 1900)
        .when(digits == 2, number + 2000)
        .when((digits == 4) & (number >= 1), number)
    )
    zero = F.lit(0)
    return F.try_make_timestamp(year, parts[0].cast("int"), parts[1].cast("int"), zero, zero, zero)


def text_status(text: Column) -> Column:
    """Status told by a sale text."""
    return (
        F.when(is_sold_text(text), SOLD)
        .when(F.startswith(text, F.lit("Bid to")) | F.contains(text, F.lit("Reserve not met")), NOT_MET)
        .when(F.contains(F.lower(text), F.lit("withdrawn")), WITHDRAWN)
        .otherwise(UNKNOWN)
    )


def site_status(status: Column) -> Column:
    """Status told by a status field."""
    return (
        F.when(status == "sold", SOLD)
        .when(status.isin("reserve_not_met", "no_sale", "unsold"), NOT_MET)
        .when(status == "withdrawn", WITHDRAWN)
        .otherwise(UNKNOWN)
    )


def end_time(raw: Column) -> Column:
    """Epoch seconds or milliseconds (bigint) as a timestamp; NULL unless positive."""
    seconds = F.when(raw > MILLISECONDS_ABOVE, F.floor(raw / 1000)).otherwise(raw)
    return F.timestamp_seconds(F.when(seconds.between(1, LAST_SECOND_OF_9999), seconds))


def iso_end_time(text: Column) -> Column:
    """ISO time text as a UTC timestamp; NULL when it is none."""
    return F.try_to_timestamp(F.when(text != "", text))


def first_bid_count(counts: list[Column]) -> Column:
    """First of the count fields (VARIANT) that holds a number."""
    return F.coalesce(*[loose_number(c) for c in counts])
