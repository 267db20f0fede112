"""Price arithmetic, labels and alert keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faretide import fixed_values as fv


def finite(price: Column) -> Column:
    """The price, or null where it is NaN or infinite: such prices count as missing in every measure."""
    return F.when(F.abs(price) < float("inf"), price)


def exact(price: Column) -> Column:
    """Price as a decimal with ten places; NaN and infinite prices count as missing."""
    return price.try_cast("decimal(28,10)")


def money_mean(price: Column) -> Column:
    """Mean price (aggregate).

    A decimal sum does not depend on the order of its terms, so the mean is
    the same whatever the partitioning or however often a task is retried.
    """
    return mean_of_sums(F.sum(exact(price)), F.count(exact(price)))


def mean_of_sums(total: Column, n: Column) -> Column:
    return F.try_divide(total.cast("double"), n.cast("double"))


def pct_change(new: Column, old: Column, on_zero: float | None = 0.0) -> Column:
    """Change in percent of ``old``.

    ``on_zero=0.0``: a previous price that is not positive gives 0 (alerts, trends).
    ``on_zero=None``: a zero previous price gives null (movers).
    """
    if on_zero is None:
        return F.try_divide(new - old, old) * 100
    return F.when(old > 0, (new - old) / old * 100).otherwise(F.lit(on_zero))


def savings(base: Column, alternative: Column) -> Column:
    return base - alternative


def savings_pct(base: Column, alternative: Column) -> Column:
    return F.try_divide(base - alternative, base) * 100


def rounded(col: Column, digits: int) -> Column:
    return F.round(col, digits)


def direction(change: Column) -> Column:
    return F.when(change < 0, F.lit("price_drop")).otherwise(F.lit("price_increase"))


def _three_way(change: Column, position: int) -> Column:
    return (
        F.when(change < 0, F.lit(fv.STATUS_DROP[position]))
        .when(change > 0, F.lit(fv.STATUS_RISE[position]))
        .otherwise(F.lit(fv.STATUS_SAME[position]))
    )


def trend_status(change: Column) -> Column:
    return _three_way(change, 0)


def trend_colour(change: Column) -> Column:
    return _three_way(change, 1)


def change_class(change: Column) -> Column:
    """``decrease`` / ``increase`` / ``stable``; an unknown change is stable."""
    return (
        F.when(change < 0, F.lit("decrease")).when(change > 0, F.lit("increase")).otherwise(F.lit("stable"))
    )


def _one_decimal(col: Column) -> Column:
    """Text with one decimal, half up on the printed value; negative zero loses its sign."""
    return col.cast("decimal(38,1)").cast("string")


def alert_key(hotel: Column, when: Column, pct: Column, signed: bool = True) -> Column:
    """Key that makes one alert recognisable across repeated scans.

    ``signed`` writes an explicit plus, as run-to-run alerts do.
    """
    number = _one_decimal(pct)
    if signed:
        number = F.when(pct >= 0, F.concat(F.lit("+"), number)).otherwise(number)
    stamp = F.date_format(when.cast("timestamp_ntz"), fv.KEY_TIME_FORMAT)
    return F.concat_ws("_", hotel, stamp, number)


def arrow(change: Column) -> Column:
    return F.when(change > 0, F.lit("↑")).when(change < 0, F.lit("↓")).otherwise(F.lit("→"))


def delta_label(change: Column, pct: Column) -> Column:
    """``↑ +4.2%`` style label; a dash when the change is unknown."""
    sign = F.when(change > 0, F.lit("+")).otherwise(F.lit(""))
    text = F.concat(arrow(change), F.lit(" "), sign, _one_decimal(pct), F.lit("%"))
    return F.when(change.isNull() | pct.isNull(), F.lit(fv.NO_VALUE)).otherwise(text)


def whole(col: Column) -> Column:
    """Price without decimals, as text."""
    return F.round(col, 0).cast("decimal(38,0)").cast("string")


def signed_whole(col: Column) -> Column:
    return F.when(col >= 0, F.concat(F.lit("+"), whole(col))).otherwise(whole(col))


def signed_pct(col: Column) -> Column:
    text = _one_decimal(col)
    return F.concat(F.when(col >= 0, F.concat(F.lit("+"), text)).otherwise(text), F.lit("%"))
