"""Row filters of the market and the operations queries, as lists of predicates."""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotledger.functions.sales import SOLD

TEXT_CRITERIA = ["source", "auction_status", "make", "model", "transmission", "exterior_color"]
SEARCHED = ["title", "make", "model", "trim"]
# Outcomes that count as errors.
ERROR_OUTCOMES = ["error", "retry", "blocked", "selector_missing"]


def listed(values: str | Iterable[str] | None) -> list[str]:
    """`["a, b", "c"]` to `["a", "b", "c"]`; blanks drop out, nothing means no filter."""
    if not values:
        return []
    given = [values] if isinstance(values, str) else values
    return [part.strip() for value in given for part in value.split(",") if part.strip()]


def like_pattern(text: str) -> str:
    """`%text%`; `%` and `_` in the text stay wildcards.

    A backslash before any other character means that character, which Spark spells
    without the backslash.
    """
    return "%" + re.sub(r"\\([^%_\\])", r"\1", text) + "%"


def contains_text(column: str, text: str) -> Column:
    return F.col(column).ilike(like_pattern(text))


def sold_only() -> Column:
    return (F.col("auction_status") == SOLD) & F.col("sold_price").isNotNull()


def _day(column: str) -> Column:
    return F.to_date(F.col(column))


def market_predicates(
    *,
    year_min: int | None = None,
    year_max: int | None = None,
    price_min: int | None = None,
    price_max: int | None = None,
    mileage_min: int | None = None,
    mileage_max: int | None = None,
    ended_from: date | None = None,
    ended_to: date | None = None,
    only_sold: bool = False,
    search: str | None = None,
    **texts: str | Iterable[str] | None,
) -> list[Column]:
    """All given criteria; `texts` takes the multi-value ones in TEXT_CRITERIA."""
    unknown = set(texts) - set(TEXT_CRITERIA)
    if unknown:
        raise TypeError(f"unknown criteria: {sorted(unknown)}")
    predicates = [
        F.col(name).isin(listed(texts.get(name))) for name in TEXT_CRITERIA if listed(texts.get(name))
    ]
    ranges = [
        (F.col("year"), year_min, year_max),
        (F.col("mileage"), mileage_min, mileage_max),
        (_day("ended_at"), ended_from, ended_to),
        (F.col("sold_price"), price_min, price_max),
    ]
    for column, low, high in ranges:
        if low is not None:
            predicates.append(column >= F.lit(low))
        if high is not None:
            predicates.append(column <= F.lit(high))
    if only_sold:
        predicates.append(sold_only())
    if search:
        hits = [contains_text(name, search.strip()) for name in SEARCHED]
        predicates.append(reduce(lambda a, b: a | b, hits))
    return predicates


def chart_criteria(criteria: dict) -> dict:
    """Charts always look at sales: the status criterion is dropped, sold-only is set."""
    return {**{k: v for k, v in criteria.items() if k != "auction_status"}, "only_sold": True}


def operations_predicates(
    *,
    source: str | None = None,
    auction_status: str | None = None,
    make: str | None = None,
    model: str | None = None,
    year: int | None = None,
    ended_from: date | None = None,
    ended_to: date | None = None,
    is_sold: bool | None = None,
) -> list[Column]:
    predicates = equal_to(source=source, auction_status=auction_status)
    predicates += [contains_text(c, v) for c, v in (("make", make), ("model", model)) if v]
    if year is not None:
        predicates.append(F.col("year") == year)
    if ended_from:
        predicates.append(_day("ended_at") >= F.lit(ended_from))
    if ended_to:
        predicates.append(_day("ended_at") <= F.lit(ended_to))
    if is_sold is not None:
        status = F.col("auction_status")
        predicates.append(status == SOLD if is_sold else status != SOLD)
    return predicates


def equal_to(**wanted: object) -> list[Column]:
    """Equality on every criterion that is given; empty texts and 0 count as not given."""
    return [F.col(name) == F.lit(value) for name, value in wanted.items() if value]


def request_log_predicates(*, errors_only: bool = False, **wanted: object) -> list[Column]:
    """`wanted` may name source, run_id, outcome and status_code."""
    predicates = equal_to(**wanted)
    if errors_only:
        predicates.append(F.col("outcome").isin(ERROR_OUTCOMES))
    return predicates


def run_predicates(*, errors_only: bool = False, source: str | None = None) -> list[Column]:
    return equal_to(source=source) + ([F.col("error").isNotNull()] if errors_only else [])


def raw_page_predicates(
    *,
    source: str | None = None,
    target_type: str | None = None,
    status_code: int | None = None,
    url: str | None = None,
) -> list[Column]:
    predicates = equal_to(source=source, target_type=target_type)
    if status_code is not None:
        predicates.append(F.col("status_code") == status_code)
    if url:
        predicates.append(contains_text("url", url))
    return predicates


def keep(df: DataFrame, predicates: list[Column]) -> DataFrame:
    """Rows for which all predicates hold."""
    return df.where(reduce(lambda a, b: a & b, predicates)) if predicates else df
