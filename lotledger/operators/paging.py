"""Sort orders, pages and newest-first lists.

Every order ends with the id, so that pages never overlap. Null order is spelled out:
descending puts NULL first, ascending puts it last.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotledger.operators.market import total_count


@dataclass(frozen=True)
class Key:
    column: str
    descending: bool = False
    nulls_last_anyway: bool = False

    @property
    def nulls_first(self) -> bool:
        return self.descending and not self.nulls_last_anyway

    def order(self) -> Column:
        if self.descending:
            return F.desc_nulls_first(self.column) if self.nulls_first else F.desc_nulls_last(self.column)
        return F.asc_nulls_last(self.column)

    def same(self, value: object) -> Column:
        return F.col(self.column).eqNullSafe(F.lit(value))

    def after(self, value: object) -> Column:
        """Rows that sort behind `value` on this key."""
        column = F.col(self.column)
        if value is None:
            return column.isNotNull() if self.nulls_first else F.lit(False)
        behind = column < F.lit(value) if self.descending else column > F.lit(value)
        return behind if self.nulls_first else behind | column.isNull()


NEWEST = Key("created_at", descending=True)
ID = Key("id")
SORTS: dict[str, Key] = {
    "ended_at_desc": Key("ended_at", descending=True),
    "ended_at_asc": Key("ended_at"),
    "price_desc": Key("sold_price", descending=True),
    "price_asc": Key("sold_price"),
    "mileage_desc": Key("mileage", descending=True),
    "mileage_asc": Key("mileage"),
}


def sort_keys(sort: str = "ended_at_desc") -> list[Key]:
    """Unknown names mean newest end first; ties go to the newest record, then the id."""
    return [SORTS.get(sort, SORTS["ended_at_desc"]), NEWEST, ID]


def ordered(df: DataFrame, keys: list[Key]) -> DataFrame:
    return df.orderBy(*[k.order() for k in keys])


def page(df: DataFrame, number: int, size: int, keys: list[Key]) -> DataFrame:
    """Page `number` (from 1) of `size` rows."""
    if number < 1 or size < 1:
        raise ValueError("page and size from 1")
    return ordered(df, keys).offset((number - 1) * size).limit(size)


def page_after(df: DataFrame, last: dict[str, object], size: int, keys: list[Key]) -> DataFrame:
    """The `size` rows behind the row `last` (its key values).

    The cost does not grow with the depth of the page: no rows are skipped, and the
    comparison on the leading key reaches the file scan.
    """
    condition = F.lit(False)
    for key in reversed(keys):
        condition = key.after(last[key.column]) | (key.same(last[key.column]) & condition)
    return ordered(df.where(condition), keys).limit(size)


def lots_page(lots: DataFrame, number: int = 1, size: int = 50, sort: str = "ended_at_desc") -> tuple[DataFrame, DataFrame]:
    """(rows of the page, one-row total) of the already filtered lots."""
    return page(lots, number, size, sort_keys(sort)), total_count(lots)


def newest(df: DataFrame, limit: int, *columns: str) -> DataFrame:
    """Newest `limit` rows by the given time columns, then by id."""
    return ordered(df, [*[Key(c, descending=True) for c in columns], ID]).limit(limit)


def targets_by_urgency(targets: DataFrame, limit: int) -> DataFrame:
    return ordered(targets, [Key("priority"), NEWEST, ID]).limit(limit)


def ready_targets(targets: DataFrame, source: str, now: Column, limit: int) -> DataFrame:
    """Pending targets whose time has come: most urgent first, then the longest waiting."""
    due = F.col("next_fetch_at").isNull() | (F.col("next_fetch_at") <= now)
    ready = targets.where((F.col("source") == source) & (F.col("state") == "pending") & due)
    return ordered(ready, [Key("priority"), Key("created_at"), ID]).limit(limit)


def lots_without_detail(lots: DataFrame, source: str, limit: int | None = None) -> DataFrame:
    """Lots of a source whose detail page has not been read: all, or the newest `limit`."""
    missing = lots.where((F.col("source") == source) & F.col("detail_scraped_at").isNull())
    if limit is None:
        return missing
    return ordered(missing, [Key("ended_at", True, nulls_last_anyway=True), NEWEST, ID]).limit(limit)
