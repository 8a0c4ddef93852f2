"""Items and paging data of result pages: embedded in HTML, from the JSON API, or captured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotledger.functions.barriers import computed_once
from lotledger.functions.variants import elements, is_truthy, loose_number, member
from lotledger.schemas import RESULTS_API, SECOND_SITE

# Fixed value: the script variable that carries the result list.
EMBEDDED = r"(?s)var\s+auctionsCompletedInitialData\s*=\s*(\{.*?\})\s*;"


def is_json_page(content_type: Column, target_type: Column) -> Column:
    return F.contains(content_type, F.lit("json")) | (target_type == RESULTS_API)


def with_payload(pages: DataFrame) -> DataFrame:
    """Adds `payload` (VARIANT): the result data of a page, NULL when there is none.

    HTML carries it in a script variable; JSON pages are it. Text that is no JSON gives NULL.
    """
    json_page = F.coalesce(is_json_page(F.col("content_type"), F.col("target_type")), F.lit(False))
    text = F.when(json_page, F.col("content")).otherwise(F.regexp_extract("content", EMBEDDED, 1))
    return computed_once(pages, pages.columns, payload=F.try_parse_json(text), is_json=json_page)


def listed(pages: DataFrame, site: str = "source") -> Column:
    """The result list of a page: `auctions` in the answers of the second site, else `items`."""
    items = member(F.col("payload"), "items")
    if site not in pages.columns:
        return elements(items)
    return elements(F.when(F.col(site) == SECOND_SITE, member(F.col("payload"), "auctions")).otherwise(items))


def exploded_items(pages: DataFrame, site: str = "source", outer: bool = False) -> DataFrame:
    """One row per item: page columns, `pos` and `item`; `site` names the column that tells the site.

    With `outer` a page without items has one row, in which `pos` is NULL.
    """
    carried = [c for c in pages.columns if c not in ("payload", "is_json", "content")]
    each = F.posexplode_outer if outer else F.posexplode
    return pages.select(*carried, each(listed(pages, site)).alias("pos", "item"))


def with_paging(pages: DataFrame) -> DataFrame:
    """Adds items_total, items_per_page, page_current, pages_total, base_filter, item_count.

    A blank or zero number of pages counts as one. JSON pages do not tell a base filter, the second site's answers tell a total only.
    """
    payload = F.col("payload")

    def number(name: str) -> Column:
        return loose_number(member(payload, name)).try_cast("int")

    base = member(payload, "base_filter")
    return computed_once(
        pages,
        pages.columns,
        items_total=F.coalesce(number("items_total"), number("total")),
        items_per_page=number("items_per_page"),
        page_current=number("page_current"),
        pages_total=F.coalesce(F.nullif(number("pages_total"), F.lit(0)), F.lit(1)),
        base_filter=F.when(~F.col("is_json") & is_truthy(base), F.to_json(base)).otherwise("{}"),
        item_count=F.size(listed(pages)),
    )


def captured_auctions(spark: SparkSession, folder: str) -> DataFrame:
    """Captured API answers of the second site: page, pos, count, total, item."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True)
    read = files.select(
        F.col("_metadata.file_path").alias("page"), F.try_parse_json("value").alias("payload")
    )
    return read.select(
        "page",
        loose_number(member(F.col("payload"), "count")).alias("count"),
        loose_number(member(F.col("payload"), "total")).alias("total"),
        F.posexplode(elements(member(F.col("payload"), "auctions"))).alias("pos", "item"),
    )
