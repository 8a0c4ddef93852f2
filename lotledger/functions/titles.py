"""Reading year, make, model, trim, mileage and colour out of listing titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotledger.functions.text import blank_to_null, grouped_number, html_unescape, matched, words

# Patterns and word lists that decide the extraction results.
YEAR = r"\b(19|20)\d{2}\b"
AFTER_YEAR = r"(?s)\b(?:19|20)\d{2}\b(.*)$"
LEADING_YEAR = r"^\s*(?:19|20)\d{2}\s+"
EDGE_PUNCTUATION = " ,:-"
TWO_PART_MAKES = [
    "Alfa Romeo",
    "Aston Martin",
    "De Tomaso",
    "Land Rover",
    "Mercedes-AMG",
    "Mercedes-Benz",
    "Porsche-Diesel",
    "Rolls-Royce",
]
NON_CAR_MAKES = [
    "Airstream",
    "AJS",
    "Porsche-Diesel",
    "Harley-Davidson",
    "Ducati",
    "Moto Guzzi",
    "BSA",
]
NON_CAR_TERMS = [
    "wheels?",
    "tires?",
    "seats?",
    "engine",
    "transmission",
    "parts?",
    "trailer",
    "camper",
    "motorhome",
    "rv conversion",
    "tractor",
    "go-?kart",
    "side-?by-?side",
    "sidecar",
    "scrambler",
    "minibike",
    "scooter",
    "boat",
    "aircraft",
]
COLORS = [
    "white", "black", "silver", "grey", "gray", "blue", "red", "yellow", "green", "orange",
    "brown", "purple", "gold", "tan", "beige", "guards red", "chalk", "python green",
    "miami blue", "racing yellow", "shark blue", "jet black", "gulf blue", "dark sea blue",
    "lava orange", "lizard green", "riviera blue", "signal green", "voodoo blue", "pts",
    "arena red", "gentian blue", "crayon", "gt silver", "carrara white", "nardo gray",
    "sepang blue", "mythos black", "navarra blue",
]
# End of fixed values.


def model_year(title: Column) -> Column:
    """First year from 1900 to 2099 in the title."""
    return matched(title, YEAR, 0).cast("int")


def after_year(title: Column) -> Column:
    """What follows the year, without separators at its ends; '' without a year."""
    return F.btrim(F.regexp_extract(title, AFTER_YEAR, 1), F.lit(EDGE_PUNCTUATION))


def thousands_mileage(digits: Column) -> Column:
    """`32.3` of `32.3k` as miles: double arithmetic, cut off, so 32.3 gives 32299."""
    return (F.replace(digits, F.lit(","), F.lit("")).try_cast("double") * 1000).try_cast("int")


def mileage_digits(text: Column, thousands: str, plain: str) -> Column:
    """struct(short, full): the digits of the `k` form and of the plain form; a text that tells no miles is not searched."""
    told = F.contains(F.lower(text), F.lit("mile"))
    return F.struct(
        F.when(told, matched(text, thousands)).alias("short"), F.when(told, matched(text, plain)).alias("full")
    )


def title_mileage_digits(title: Column) -> Column:
    return mileage_digits(title, r"([\d,.]+)k-?[Mm]ile", r"([\d,]+)\s*-?\s*[Mm]ile")


def miles_of(digits: Column) -> Column:
    """The `k` form counts first; digits that make no number (`,-Mile`) give NULL."""
    return F.when(digits["short"].isNotNull(), thousands_mileage(digits["short"])).otherwise(
        grouped_number(digits["full"]).try_cast("int")
    )


def has_digits(digits: Column) -> Column:
    return digits["short"].isNotNull() | digits["full"].isNotNull()


def color_name(text: Column) -> Column:
    """First known colour word, capitalised."""
    return F.initcap(matched(text, rf"(?i)\b({'|'.join(COLORS)})\b", 0))


def non_car_by_name(readable: Column) -> Column:
    """Parts, trailers, motorcycles and the like, by an unescaped title."""
    makes = rf"(?i)^({'|'.join(NON_CAR_MAKES)}) "
    terms = rf"(?i)\b({'|'.join(NON_CAR_TERMS)})\b"
    return readable.rlike(makes) | after_year(readable).rlike(makes) | readable.rlike(terms)


def is_non_car(title: Column) -> Column:
    return non_car_by_name(F.trim(html_unescape(title)))


def split_vehicle(tail: Column) -> Column:
    """struct(make, rest) of the words after the year; `rest` are the words after the make.

    The known two-part makes come first; a one-word make needs at least one word after it.
    """
    spelled = F.create_map(*[F.lit(x) for m in TWO_PART_MAKES for x in (m.lower(), m)])
    known = F.lower(matched(tail, rf"(?i)^({'|'.join(TWO_PART_MAKES)}) "))
    return F.struct(
        F.try_element_at(spelled, known).alias("known"),
        words(tail).alias("words"),
        words(F.substring(tail, F.length(known) + 1, F.length(tail))).alias("after"),
    )


def make_model_trim(parts: Column) -> Column:
    """struct(make, model, trim) from `split_vehicle`."""
    known, plain = parts["known"], parts["words"]
    rest = F.when(known.isNotNull(), parts["after"]).otherwise(F.slice(plain, F.lit(2), F.size(plain)))
    named = known.isNotNull() | (F.size(plain) >= 2)
    return F.struct(
        F.coalesce(known, F.when(named, F.get(plain, F.lit(0)))).alias("make"),
        F.when(named, F.get(rest, F.lit(0))).alias("model"),
        F.when(named, blank_to_null(F.array_join(F.slice(rest, F.lit(2), F.size(rest)), " "))).alias("trim"),
    )


def words_without_year(title: Column) -> Column:
    """`split_vehicle` for titles with a leading year and one-word makes only."""
    plain = words(F.regexp_replace(title, LEADING_YEAR, ""))
    nothing = F.lit(None).cast("string")
    return F.struct(nothing.alias("known"), plain.alias("words"), plain.alias("after"))


def display_name(title: Column, *parts: Column) -> Column:
    """The title, else the filled parts in order, else a fixed wording."""
    filled = [F.when(p.cast("string") != "", p.cast("string")) for p in parts]
    return F.coalesce(title, blank_to_null(F.concat_ws(" ", *filled)), F.lit("Unknown vehicle"))
