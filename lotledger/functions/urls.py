"""Canonical URLs, request fingerprints and content addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scheme, host, path and query of a URL; the fragment is not captured.
URL_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
FIELD_SEPARATOR = "\u001f"


def _decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def _encoded(text: Column) -> Column:
    """Form encoding with `~` left alone and `*` escaped."""
    return F.replace(
        F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")
    )


def _sorted_query(query: Column) -> Column:
    fields = F.filter(F.split(query, "&"), lambda f: f != "")
    pairs = F.transform(
        fields,
        lambda f: F.struct(
            _decoded(F.substring_index(f, "=", 1)).alias("name"),
            _decoded(
                F.when(
                    F.contains(f, F.lit("=")),
                    F.substring(f, F.instr(f, "=") + 1, F.length(f)),
                ).otherwise("")
            ).alias("value"),
        ),
    )
    return F.array_join(
        F.transform(
            F.array_sort(pairs),
            lambda p: F.concat(_encoded(p["name"]), F.lit("="), _encoded(p["value"])),
        ),
        "&",
    )


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no trailing slash, sorted query, no fragment."""
    clean = F.trim(url)
    scheme, host, path, query = (F.regexp_extract(clean, URL_PARTS, g) for g in (1, 2, 3, 4))
    scheme = F.when(scheme == "", "https").otherwise(F.lower(scheme))
    path = F.when(path.isin("", "/"), "/").otherwise(F.regexp_replace(path, "/+$", ""))
    ordered = _sorted_query(query)
    return F.concat(
        scheme,
        F.lit("://"),
        F.lower(host),
        path,
        F.when(ordered == "", "").otherwise(F.concat(F.lit("?"), ordered)),
    )


def request_fingerprint(
    source: Column, target_type: Column, url: Column, method: Column | None = None,
    payload: Column | None = None,
) -> Column:
    """Stable digest of what makes two requests the same (the URL is made canonical)."""
    return F.sha2(
        F.concat_ws(
            FIELD_SEPARATOR,
            source,
            target_type,
            F.upper(method) if method is not None else F.lit("GET"),
            canonical_url(url),
            F.coalesce(payload, F.lit("{}")) if payload is not None else F.lit("{}"),
        ),
        256,
    )


def content_extension(content_type: Column) -> Column:
    lowered = F.lower(content_type)
    return (
        F.when(F.contains(lowered, F.lit("json")), "json")
        .when(F.contains(lowered, F.lit("html")), "html")
        .otherwise("bin")
    )


def artifact_uri(source: Column, fetched_at: Column, digest: Column, content_type: Column) -> Column:
    """`local://source/YYYY/MM/DD/<digest>.<extension>.gz`."""
    return F.concat(
        F.lit("local://"),
        F.concat_ws("/", source, F.date_format(fetched_at, "yyyy/MM/dd"), digest),
        F.lit("."),
        content_extension(content_type),
        F.lit(".gz"),
    )


def is_blocking(status_code: Column) -> Column:
    """Status codes by which a site refuses further requests."""
    return F.coalesce(status_code.isin(401, 403, 407, 429), F.lit(False))


def request_outcome(status_code: Column, attempt: Column, max_attempts: int = 3) -> Column:
    """success, blocked, retry (server error or no answer, attempts left) or error."""
    retryable = status_code.isNull() | (status_code >= 500)
    return (
        F.when(is_blocking(status_code), "blocked")
        .when(status_code < 400, "success")
        .when(retryable & (attempt < max_attempts), "retry")
        .otherwise("error")
    )
