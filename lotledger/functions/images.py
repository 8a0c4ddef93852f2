"""Image URL lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotledger.functions.variants import as_text, elements, filled_text, is_object, member

# Field names that may hold an image.
ITEM_KEYS = ["image", "image_url", "thumbnail", "thumbnail_url"]
LISTED_KEYS = ["url", "src", "large_url", "thumbnail_url"]
PHOTO_KEYS = ["main_photo", "photo", "image", "image_url", "thumbnail_url"]
PHOTO_LIST_KEYS = ["photos", "images"]
# End of fixed values.


def ordered_distinct(urls: Column) -> Column:
    """Without NULL and empty members; the first of equal ones keeps its place."""
    return F.array_except(urls, F.array(F.lit(None).cast("string"), F.lit("")))


def _listed(image: Column) -> Column:
    return F.coalesce(
        filled_text(image),
        F.when(is_object(image), F.coalesce(*[filled_text(member(image, k)) for k in LISTED_KEYS])),
    )


def item_images(single: list[Column], images: Column) -> Column:
    """Images of an item by the values of ITEM_KEYS and of its list (VARIANT)."""
    listed = F.transform(elements(images), _listed)
    return ordered_distinct(F.concat(F.array(*[filled_text(v) for v in single]), listed))


def _photo(value: Column) -> Column:
    """A text, or an object with url/src, or one with base_url and path."""
    base, path = as_text(member(value, "base_url")), as_text(member(value, "path"))
    scheme = F.when(base.rlike("^https?://"), "").otherwise("https://")
    joined = F.concat(scheme, F.rtrim(base, F.lit("/")), F.lit("/"), F.ltrim(path, F.lit("/")))
    return F.coalesce(
        filled_text(value),
        F.when(
            is_object(value),
            F.coalesce(filled_text(member(value, "url")), filled_text(member(value, "src")), joined),
        ),
    )


def photo_images(single: list[Column], lists: list[Column]) -> Column:
    """Images of an item by the values of PHOTO_KEYS and PHOTO_LIST_KEYS (VARIANT)."""
    listed = [F.transform(elements(v), _listed) for v in lists]
    return ordered_distinct(F.concat(F.array(*[_photo(v) for v in single]), *listed))


def bare_image_url(url: Column) -> Column:
    """Without query and fragment."""
    return F.regexp_replace(url, r"(?s)[?#].*$", "")
