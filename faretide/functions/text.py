"""Names, dates, durations and prices found in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faretide import fixed_values as fv

# Unicode white space, so that a no-break space collapses like any other.
_BLANKS = r"(?U)\s+"
_TRIP_DATE = r"(\d{1,2})[.-](\d{1,2})[.-](\d{4})"
_TWO_TRIP_DATES = rf"(?s)^.*?{_TRIP_DATE}.*?{_TRIP_DATE}.*$"
_DAY_MONTH = r"\d{1,2}[./-]\d{1,2}"
_COUNT_UNIT = r"(?i)\d\s*[dn]"
_NUMBER = r"([0-9][0-9\s\x{00A0}\x{202F}]*(?:\.[0-9]+)?)"


def _or_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def first_match(col: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null without one. The scan stops at the match."""
    found = F.regexp_substr(col, F.lit(pattern))
    return F.when(found.isNotNull(), F.regexp_extract(col, pattern, group))


def clean_text(col: Column) -> Column:
    """Collapse runs of white space to one blank and trim."""
    return F.trim(F.regexp_replace(col, _BLANKS, " "))


def normalize_text(col: Column) -> Column:
    """Lower-case, blank-collapsed form used to compare names."""
    return F.lower(clean_text(col))


def normalize_dates(col: Column) -> Column:
    """``d.m.yyyy - d.m.yyyy`` (or with dashes) to ``yyyy-mm-dd|yyyy-mm-dd``.

    Text with fewer than two dates is only trimmed.
    """
    iso = F.regexp_replace(col, _TWO_TRIP_DATES, "$3-$2-$1|$6-$5-$4")
    padded = F.regexp_replace(iso, r"\b(\d)\b", "0$1")
    return F.when(col.rlike(_TWO_TRIP_DATES), padded).otherwise(F.trim(col))


def trip_dates(col: Column) -> Column:
    """Struct of the first and last trip day, null when the text holds no range."""
    both = normalize_dates(col)
    return F.struct(
        F.substring_index(both, "|", 1).try_cast("date").alias("trip_start"),
        F.when(both.contains("|"), F.substring_index(both, "|", -1).try_cast("date")).alias("trip_end"),
    )


def parse_price(col: Column) -> Column:
    """First number of a price text: ``6.233,50 PLN`` -> 6233.5; none -> 0.

    Dots group thousands and a comma starts the decimals.
    """
    plain = F.translate(F.translate(col, ".", ""), ",", ".")
    number = F.regexp_replace(F.regexp_extract(plain, _NUMBER, 1), _BLANKS, "")
    return F.coalesce(number.try_cast("double"), F.lit(0.0))


def preferred_price_text(texts: Column) -> Column:
    """Out of several price texts, the first that states a price for the whole party.

    Falls back to the first text with a digit.
    """
    marker = "|".join(fv.WHOLE_PARTY_MARKERS)
    with_number = F.filter(texts, lambda t: t.rlike("[0-9]"))

    def choose(found: Column) -> Column:
        party = F.filter(found, lambda t: F.lower(t).rlike(marker))
        return F.coalesce(F.get(party, F.lit(0)), F.get(found, F.lit(0)))

    # The one-element array names the filtered texts, so that they are built once.
    return F.trim(F.get(F.transform(F.array(with_number), choose), F.lit(0)))


def is_date_text(col: Column) -> Column:
    stop = "|".join(fv.RATING_WORDS)
    return F.coalesce(
        (F.length(F.trim(col)) >= 5) & col.rlike(_DAY_MONTH) & ~F.lower(col).rlike(stop), F.lit(False)
    )


def is_duration_text(col: Column) -> Column:
    return F.coalesce((F.length(F.trim(col)) >= 2) & col.rlike(_COUNT_UNIT), F.lit(False))


def dates_from_text(col: Column) -> Column:
    """First date range by pattern priority, else empty."""
    tries = [F.regexp_substr(col, F.lit(p)) for p in fv.DATE_RANGE_PATTERNS]
    return F.coalesce(*tries, F.lit(""))


def duration_from_text(col: Column) -> Column:
    """``7 nights`` style text; a bare ``14d`` becomes ``14 dni``; none -> empty."""
    named = rf"(?i)(\d+)\s*({'|'.join(fv.DURATION_UNITS)})"
    tries = [F.regexp_replace(F.regexp_substr(col, F.lit(named)), r"^(\d+)\s*", "$1 ")]
    for letter in "dn":
        short = F.regexp_substr(col, F.lit(rf"(?i)\d+\s*{letter}"))
        tries.append(F.concat(F.regexp_extract(short, r"\d+", 0), F.lit(" " + fv.DURATION_DEFAULT_UNIT)))
    return F.coalesce(*tries, F.lit(""))


def nights_range(col: Column) -> Column:
    """Smallest and largest count in a duration text such as ``7 dni`` or ``6-15``."""
    counts = F.transform(
        F.regexp_extract_all(col, F.lit(r"\d+"), F.lit(0)), lambda n: n.try_cast("int")
    )
    return F.struct(
        F.array_min(counts).alias("nights_min"), F.array_max(counts).alias("nights_max")
    )


def fill_default(col: Column, default: str) -> Column:
    return F.coalesce(_or_null(F.trim(col)), F.lit(default))


def first_filled(*cols: Column) -> Column:
    """First column that is neither null nor blank."""
    return F.coalesce(*[_or_null(F.trim(c)) for c in cols])


def slugify(col: Column) -> Column:
    """URL-safe form of a name: ASCII letters and digits joined by single dashes."""
    dashed = F.regexp_replace(F.lower(col), r"[^a-z0-9]+", "-")
    return F.coalesce(_or_null(F.trim(dashed, F.lit("-"))), F.lit("hotel"))


def safe_name(col: Column, index: Column) -> Column:
    """File-system-safe name: letters, digits, blanks, ``-`` and ``_``, plus a number."""
    kept = F.rtrim(F.regexp_replace(col, r"[^\p{L}\p{N} _-]", ""))
    number = index.cast("string")
    padded = F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number)
    return F.concat(F.substring(kept, 1, 50), F.lit("_"), padded)


def ellipsis(col: Column, width: int) -> Column:
    return F.when(F.length(col) > width, F.concat(F.substring(col, 1, width), F.lit("..."))).otherwise(col)


def contains_term(col: Column, term: str) -> Column:
    return F.contains(F.lower(col), F.lit(term.lower()))


def first_words(col: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(clean_text(col), " "), 1, n), " ")
