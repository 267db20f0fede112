"""Facts carried in offer-card markup, by pattern and without a DOM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faretide import fixed_values as fv
from faretide.functions.text import clean_text, first_match, is_date_text, is_duration_text
from faretide.functions.urls import absolute_url

_TAG = r"(?s)<[^>]*>"
_ENTITIES = [("&nbsp;", " "), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]


def strip_tags(col: Column) -> Column:
    """Markup to text: tags become blanks, the common entities are decoded."""
    text = F.regexp_replace(col, _TAG, " ")
    for entity, char in _ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return clean_text(text)


def _without_hidden(html: Column) -> Column:
    # Every alternative starts after one "<", so that other characters are passed over without trying them.
    hidden = r"(?is)<(?:script\b.*?</script\s*>|style\b.*?</style\s*>|!--.*?-->)"
    return F.regexp_replace(html, hidden, " ")


def visible_text(html: Column) -> Column:
    """Text of a document without scripts, styles and comments."""
    return strip_tags(_without_hidden(html))


def _named(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


_SOUGHT = {
    *fv.NAME_CLASSES,
    *fv.NAME_CLASS_PARTS,
    "price",
    fv.WHOLE_PARTY_CLASS,
    *fv.PRICE_CLASSES,
    *fv.PRICE_CLASS_PARTS,
    *fv.DATE_CLASSES,
    *fv.DATE_CLASS_PARTS,
    *fv.DATE_ATTRIBUTES,
    *fv.DATE_LAST_CLASSES,
    *fv.DURATION_CLASSES,
    *fv.DURATION_CLASS_PARTS,
    *fv.DURATION_ATTRIBUTES,
}
# Whatever the selectors below look for in classes and data attributes; a value that holds another is found by that.
_SELECTABLE = "(?i)" + "|".join(rf"\Q{v}\E" for v in sorted(_SOUGHT) if not any(w in v for w in _SOUGHT - {v}))


def _parsed(html: Column, use) -> Column:
    """``use(elements)`` with the elements of a card that are headings, or whose tag names what a selector looks for.

    The markup is cut at every ``<``; each element has its tag name, classes, data attributes and text. The text
    runs to the first closing tag of that name, or to the next tag if it is never closed; images have none.
    No pattern repeats an alternation, and all work is linear but for unclosed tags.
    """

    def inner_text(card: Column, at: Column, name: Column) -> Column:
        closing = F.concat(F.lit("/"), name)
        after = F.slice(card["names"], at + 1, F.size(card["names"]))
        close = F.when(F.array_contains(card["closing"], closing), F.array_position(after, closing)).otherwise(1)
        return strip_tags(F.array_join(F.slice(card["texts"], at, F.greatest(close.cast("int"), F.lit(1))), " "))

    def elements(card: Column) -> Column:
        def element(tag: Column, i: Column) -> Column:
            name = F.get(card["names"], i)
            kind = F.regexp_extract(tag, r"""(?i)\sclass\s*=\s*["']([^"']*)""", 1)
            data = F.when(
                tag.rlike(r"(?i)\sdata-"), F.regexp_extract_all(F.lower(tag), F.lit(r"\s(data-[a-z]+)"), F.lit(1))
            ).otherwise(F.array().cast("array<string>"))
            # Texts are taken only of elements that a selector may choose.
            marked = (i > 0) & (name >= "a") & (name.isin(fv.HEADING_TAGS) | tag.rlike(_SELECTABLE))
            whole = F.when(name.isin("img", "input"), F.lit("")).otherwise(inner_text(card, i + 1, name))
            return F.when(
                marked,
                F.struct(name.alias("name"), kind.alias("class"), F.split(kind, r"\s+").alias("classes"), data.alias("data"), whole.alias("text")),
            )

        return F.filter(F.transform(card["tags"], element), lambda e: e.isNotNull())

    def card(pieces: Column) -> Column:
        is_text = lambda s, i: (i == 0) | ~s.rlike(r"^[/A-Za-z!]")
        # Lower case is dear beside the rest of a card, and most tags are written in it.
        lowered = lambda n: F.when(n.rlike("[A-Z]"), F.lower(n)).otherwise(n)
        raw = F.transform(pieces, lambda s: F.regexp_extract(s, r"^/?[A-Za-z][A-Za-z0-9]*", 0))
        names = F.transform(raw, lowered)
        return F.struct(
            names.alias("names"),
            F.array_distinct(F.filter(names, lambda n: n.startswith("/"))).alias("closing"),
            F.transform(pieces, lambda s: F.substring_index(s, ">", 1)).alias("tags"),
            F.transform(
                pieces, lambda s, i: F.when(is_text(s, i), s).otherwise(F.regexp_replace(s, r"^[^>]*>?", ""))
            ).alias("texts"),
        )

    return _named(
        F.split(_without_hidden(html), "<"),
        lambda pieces: _named(card(pieces), lambda c: _named(elements(c), use)),
    )


def _selectors(*groups: tuple[str, list[str]]) -> list[tuple[str, str]]:
    """Selectors in priority order: (kind, value)."""
    return [(kind, v) for kind, values in groups for v in values]


def _selected(e: Column, kind: str, value: str) -> Column:
    if kind == "tag":
        return e["name"] == value
    if kind == "part":
        return F.contains(e["class"], F.lit(value))
    return F.array_contains(e["classes" if kind == "class" else "data"], value)


def _first_of(elements: Column, kind: str, value: str) -> Column:
    """Text of the first element of a selector; null if it has none."""
    return F.get(F.filter(elements, lambda e: _selected(e, kind, value)), F.lit(0))["text"]


def _first_text(elements: Column, selectors: list[tuple[str, str]]) -> Column:
    """Text of the first element of the first selector whose first element is not blank; the selectors after it are not tried."""
    return F.coalesce(*[F.nullif(_first_of(elements, *s), F.lit("")) for s in selectors])


def _first_accepted(elements: Column, selectors: list[tuple[str, str]], accepts) -> Column:
    """First accepted text among all elements of the first selector that gives one."""
    return _named(
        F.filter(elements, lambda e: accepts(e["text"])),
        lambda found: F.when(F.size(found) > 0, F.coalesce(*[_first_of(found, *s) for s in selectors])),
    )


def _heading(elements: Column) -> Column:
    tiers = [("tag", fv.HEADING_TAGS), ("class", fv.NAME_CLASSES), ("part", fv.NAME_CLASS_PARTS)]
    return _first_text(elements, _selectors(*tiers))


def _price_text(elements: Column) -> Column:
    """The price for the whole party first, then exact classes, then parts of class names."""
    marker = "|".join(fv.WHOLE_PARTY_MARKERS)
    of_party = lambda e: _selected(e, "part", "price") & F.lower(e["text"]).rlike(marker)
    party = F.get(F.filter(elements, of_party), F.lit(0))["text"]
    tiers = [("part", [fv.WHOLE_PARTY_CLASS]), ("class", fv.PRICE_CLASSES), ("part", fv.PRICE_CLASS_PARTS)]
    return F.coalesce(party, _first_text(elements, _selectors(*tiers)))


def _dates(elements: Column) -> Column:
    tiers = [("class", fv.DATE_CLASSES), ("part", fv.DATE_CLASS_PARTS), ("data", fv.DATE_ATTRIBUTES)]
    return _first_accepted(elements, _selectors(*tiers, ("class", fv.DATE_LAST_CLASSES)), is_date_text)


def _duration(elements: Column) -> Column:
    tiers = [("class", fv.DURATION_CLASSES), ("part", fv.DURATION_CLASS_PARTS), ("data", fv.DURATION_ATTRIBUTES)]
    return _first_accepted(elements, _selectors(*tiers), is_duration_text)


def heading_from_markup(html: Column) -> Column:
    """Text of the highest-level heading, else of the first name-like element; null if none."""
    return _parsed(html, _heading)


def price_text_from_markup(html: Column) -> Column:
    """Text of the price element, the whole-party price first; null if none."""
    return _parsed(html, _price_text)


def card_texts(html: Column) -> Column:
    """Struct of the heading, price, dates and duration texts of a card; each null if there is none."""
    return _parsed(
        html,
        lambda elements: F.struct(
            _heading(elements).alias("name"),
            _price_text(elements).alias("price"),
            _dates(elements).alias("dates"),
            _duration(elements).alias("duration"),
        ),
    )


def image_from_markup(html: Column) -> Column:
    """First image address: an ``<img>`` attribute, else a CSS ``url(...)``; http only, else empty."""
    image = F.regexp_substr(html, F.lit(r"(?is)<img\b[^>]*>"))
    attributes = [
        first_match(image, rf'(?i)\s{name}\s*=\s*["\'](http[^"\']*)["\']') for name in fv.IMAGE_ATTRIBUTES
    ]
    background = first_match(html, r"url\(\s*[\"']?(http[^)\"']+)")
    return F.trim(F.coalesce(*attributes, background, F.lit("")))


def links_from_markup(html: Column) -> Column:
    """All anchor tags, in document order."""
    return F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*\bhref\s*=[^>]*>"), F.lit(0))


def _href(anchor: Column) -> Column:
    return F.trim(F.regexp_extract(anchor, r'(?is)\bhref\s*=\s*["\']([^"\']*)["\']', 1))


def _with_class(name: str):
    pattern = rf'class\s*=\s*["\'][^"\']*\b{name}\b'
    return lambda a: a["tag"].rlike(pattern)


def offer_link_from_markup(html: Column, base: str) -> Column:
    """Link of an offer card, absolute, by priority; empty if none.

    A card that is itself a link comes first, then the two known link classes,
    the offer path, and last any link that mentions an offer.
    """
    own = _href(F.regexp_substr(html, F.lit(r"(?is)^\s*<a\b[^>]*>")))

    def choose(links: Column) -> Column:
        def first_link(condition) -> Column:
            return F.get(F.filter(links, condition), F.lit(0))["href"]

        tries = [first_link(_with_class(name)) for name in fv.LINK_CLASSES]
        tries.append(first_link(lambda a: F.contains(a["href"], F.lit(fv.OFFER_PATH))))
        tries.append(first_link(lambda a: F.contains(F.lower(a["href"]), F.lit("offer"))))
        return F.coalesce(*tries)

    links = F.filter(
        F.transform(links_from_markup(html), lambda a: F.struct(a.alias("tag"), _href(a).alias("href"))),
        lambda a: a["href"] != "",
    )
    # The one-element array names the parsed links, so that they are parsed once.
    chosen = F.get(F.transform(F.array(links), choose), F.lit(0))
    return absolute_url(F.coalesce(F.nullif(own, F.lit("")), chosen, F.lit("")), base)
