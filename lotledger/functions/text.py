"""Text helpers: unescaping, tag removal, word splitting."""

from __future__ import annotations

import json
from html import unescape
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotledger.functions.variants import blank_to_null

# Whitespace as in Unicode, so that a no-break space counts as well.
SPACES = r"(?U)\s+"


# What `html.unescape` takes for a character reference.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
# A map is searched entry by entry, so names have one for each first letter, and the usual names are compared first.
NAMED = json.dumps([{n: c for n, c in html5.items() if n[0] == chr(k)} for k in range(ord("A"), ord("z") + 1)])
# What a name can begin with; nothing else is looked up.
NAME = "^&([A-Za-z][A-Za-z0-9]*;?)"
USUAL = ["amp;", "quot;", "nbsp;", "lt;", "gt;", "apos;", "ldquo;", "rdquo;", "lsquo;", "rsquo;", "ndash;", "mdash;"]
# Numbers that do not stand for the character of that number; those above, and surrogates, are no characters at all.
ODD_NUMBERS = [*range(0xA0), 0xFEFF, *range(0xFDD0, 0xFDF0), *(p * 0x10000 + n for p in range(17) for n in (0xFFFE, 0xFFFF))]
NUMBERED = json.dumps({str(n): unescape(f"&#{n};") for n in ODD_NUMBERS})


def _table(entries: str) -> Column:
    return F.from_json(F.lit(entries), "map<string,string>")


def _numbered(reference: Column) -> Column:
    digits = F.ltrim(F.regexp_extract(reference, "^&#[xX]?([0-9a-fA-F]+)", 1), F.lit("0"))
    plain = F.when(reference.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits)
    number = F.when(digits == "", 0).when(F.length(digits) < 8, plain.cast("int"))
    # Four bytes of the code point.
    character = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return (
        F.when(number.isNull() | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF), "\ufffd")
        .when(number.isin(ODD_NUMBERS), F.try_element_at(_table(NUMBERED), number.cast("string")))
        .otherwise(character)
    )


def _named(reference: Column) -> Column:
    """The character of a name, else of its longest beginning that is one, with the rest behind it; else the text as it is."""
    name = F.regexp_extract(reference, NAME, 1)
    listed = F.get(F.from_json(F.lit(NAMED), "array<map<string,string>>"), F.ascii(name) - ord("A"))

    def beginning(n: Column) -> Column:
        found = F.try_element_at(listed, F.substring(name, F.lit(1), n))
        return F.concat(found, F.substring(reference, n + 2, F.length(reference)))

    beginnings = F.when(F.length(name) > 1, F.transform(F.sequence(F.length(name), F.lit(2), F.lit(-1)), beginning))
    known = F.get(F.filter(beginnings, lambda t: t.isNotNull()), 0)
    usual = F.lit(None).cast("string")
    for entry in reversed(USUAL):
        usual = F.when(reference == f"&{entry}", html5[entry]).otherwise(usual)
    return F.coalesce(usual, known, reference)


def html_unescape(text: Column) -> Column:
    """Resolve HTML character references as `html.unescape` does; a text without an `&` costs one look at it."""
    between = F.split(text, REFERENCE, -1)
    resolved = F.transform(
        F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)),
        lambda r, i: F.concat(
            F.when(F.startswith(r, F.lit("&#")), _numbered(r)).otherwise(_named(r)), F.get(between, i + 1)
        ),
    )
    return F.when(F.contains(text, F.lit("&")), F.concat(F.get(between, F.lit(0)), F.array_join(resolved, ""))).otherwise(text)


def html_unescape_each(texts: Column) -> Column:
    """`html_unescape` for the members of an array."""
    escaped = F.exists(texts, lambda t: F.contains(t, F.lit("&")))
    return F.when(escaped, F.transform(texts, html_unescape)).otherwise(texts)


def without_tags(html: Column) -> Column:
    return F.regexp_replace(html, r"<[^>]+>", " ")


def squeezed(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def visible_text(html: Column) -> Column:
    """HTML fragment to its text."""
    return squeezed(html_unescape(without_tags(html)))


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def matched(text: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match; NULL without a match (or with an empty group)."""
    return blank_to_null(F.regexp_extract(text, pattern, group))


def grouped_number(digits: Column) -> Column:
    """`12,345` as a number; NULL when only commas are left."""
    return F.replace(digits, F.lit(","), F.lit("")).try_cast("bigint")


def text_before_match(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, f"(?s){pattern}.*$", "")
