"""Facts carried in search and offer URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faretide import fixed_values as fv
from faretide.functions.text import first_filled, first_match

_QUERY = r"\?([^#]*)"
_FROM = "filter[from]"


def _decoded(col: Column) -> Column:
    return F.coalesce(F.try_url_decode(col), col)


def url_filters(col: Column) -> Column:
    """Query parameters as ``map<string,string>``, decoded; a repeated key keeps its first value."""
    pairs = F.transform(
        F.filter(F.split(F.regexp_extract(col, _QUERY, 1), "&"), lambda p: p.contains("=")),
        lambda p: F.struct(
            _decoded(F.substring_index(p, "=", 1)).alias("k"),
            _decoded(F.regexp_replace(p, "^[^=]*=", "")).alias("v"),
        ),
    )

    def is_first(ps: Column):
        return lambda p, i: F.array_position(ps["k"], p["k"]) == i + 1

    # The one-element array names the parsed pairs, so that they are parsed once.
    return F.get(
        F.transform(F.array(pairs), lambda ps: F.map_from_entries(F.filter(ps, is_first(ps)))), F.lit(0)
    )


def _plain_or_encoded(char: str) -> str:
    """Pattern of a character of a key, which may also be percent-encoded."""
    if char.isalnum():
        return char
    codes = "".join(f"%{b:02x}" for b in char.encode())
    return rf"(?:\{char}|(?i:{codes}))"


def url_parameter(col: Column, name: str) -> Column:
    """One decoded query parameter, null when absent, without building the whole map."""
    return _decoded(first_match(col, rf"[?&]{''.join(map(_plain_or_encoded, name))}=([^&#]*)"))


def airport_from_url(col: Column) -> Column:
    """First departure airport of the raw search URL, or the all-airports text."""
    raw = F.regexp_extract(F.coalesce(col, F.lit("")), r"filter\[from\]=([^&]*)", 1)
    return F.when(raw == "", F.lit(fv.ALL_AIRPORTS)).otherwise(F.substring_index(raw, ",", 1))


def departure_from_url(col: Column) -> Column:
    """First departure airport of the decoded query; null when absent or empty."""
    return F.nullif(F.trim(F.substring_index(url_parameter(col, _FROM), ",", 1)), F.lit(""))


def airport_name(col: Column) -> Column:
    """Display name of an airport code; unknown codes pass through."""
    names = F.create_map(*[F.lit(x) for pair in fv.AIRPORT_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, col), col)


def airport_or_base(col: Column) -> Column:
    """Display airport with the base city standing in for a missing one."""
    shown = first_filled(col, F.lit(fv.BASE_AIRPORT))
    return (
        F.when(shown == fv.BASE_AIRPORT, F.lit(fv.AIRPORT_NAMES["Warszawa"]))
        .when(shown == "Warszawa-Radom", F.lit(fv.AIRPORT_NAMES["Warszawa-Radom"]))
        .otherwise(shown)
    )


def price_limit(col: Column) -> Column:
    return F.regexp_extract(col, r"PriceTo\]?=(\d+)", 1).try_cast("double")


def trip_window(col: Column) -> Column:
    """Requested travel window of a search URL as two dates."""

    def day(name: str) -> Column:
        text = url_parameter(col, f"filter[{name}]")
        return F.to_date(F.try_to_timestamp(text, F.lit("dd-MM-yyyy")))

    return F.struct(day("whenFrom").alias("start"), day("whenTo").alias("end"))


def duration_range(col: Column) -> Column:
    """``a:b`` nights of a search URL as ``a-b``, or ``a`` when both are equal."""
    pattern = r"duration\]?=(\d+):(\d+)"
    low, high = F.regexp_extract(col, pattern, 1), F.regexp_extract(col, pattern, 2)
    unit = F.lit(" " + fv.DURATION_RANGE_UNIT)
    return F.when(
        low != "", F.when(low == high, F.concat(low, unit)).otherwise(F.concat(low, F.lit("-"), high, unit))
    )


def destination_slug(col: Column) -> Column:
    """Destination segment of a search URL, else of an offer URL, else empty."""
    search = first_match(col, fv.DESTINATION_PATH + r"([^/?#]+)/?")
    offer = first_match(col, fv.OFFER_PATH + r"([^,/?#]+),")
    return F.lower(F.coalesce(search, offer, F.lit("")))


def absolute_url(col: Column, base: str) -> Column:
    """Resolve a relative link against ``base``; fragments and absolute links stay."""
    link, root = F.trim(col), base.rstrip("/")
    return (
        F.when(link.isNull() | (link == ""), F.lit(""))
        .when(link.rlike("^https?://") | link.startswith("#"), link)
        .when(link.startswith("/"), F.concat(F.lit(root), link))
        .otherwise(F.concat(F.lit(root + "/"), link))
    )


def link_or(offer_url: Column, search_url: Column) -> Column:
    """Offer link, else the search link."""
    return F.coalesce(first_filled(offer_url), F.trim(search_url))
