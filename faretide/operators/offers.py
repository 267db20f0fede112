"""Stored offer cards to observation records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faretide import fixed_values as fv
from faretide.functions.markup import (
    card_texts,
    image_from_markup,
    offer_link_from_markup,
    visible_text,
)
from faretide.functions.text import (
    clean_text,
    dates_from_text,
    duration_from_text,
    fill_default,
    first_filled,
    first_words,
    parse_price,
)
from faretide.functions.urls import airport_from_url
from faretide.operators.filters import long_enough


def parse_offers(
    cards: DataFrame,
    html_col: str = "html",
    url_col: str = "url",
    text_col: str | None = None,
    base_url: str = "",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One record per card with enough text; all work is column expressions.

    ``url_col`` is the search the card came from. A price of 0 means that none
    could be read.
    """
    html = F.col(html_col)
    texts = cards.withColumn("_text", F.col(text_col) if text_col else visible_text(html))
    kept = long_enough(texts, "_text").withColumn("_card", card_texts(html))
    name = first_filled(F.col("_card.name"), first_words(F.col("_text"), fv.NAME_FALLBACK_WORDS))
    price_text = F.coalesce(F.col("_card.price"), F.lit(""))
    dates = fill_default(F.coalesce(F.col("_card.dates"), dates_from_text(F.col("_text"))), fv.DEFAULT_DATES)
    duration = fill_default(F.coalesce(F.col("_card.duration"), duration_from_text(F.col("_text"))), fv.DEFAULT_DURATION)
    return kept.select(
        *keep,
        F.left(clean_text(name), F.lit(fv.NAME_LIMIT)).alias("hotel_name"),
        parse_price(price_text).alias("price"),
        F.left(clean_text(dates), F.lit(fv.DATES_LIMIT)).alias("dates"),
        F.left(clean_text(duration), F.lit(fv.DURATION_LIMIT)).alias("duration"),
        F.lit("").alias("rating"),
        airport_from_url(F.col(url_col)).alias("departure_airport"),
        F.col(url_col).alias("url"),
        image_from_markup(html).alias("image_url"),
        offer_link_from_markup(html, base_url).alias("offer_url"),
    )
