"""Aggregations."""

from pyspark.sql import functions as F

from faretide.adapters import events_obs, lineitem_obs, orders_obs, table
from faretide.functions import money
from faretide.operators import ranking, stats
from faretide.registry import query
from faretide.registry import sql as q
from faretide.sources.observations import union_datasets

_W = f"WITH {q.EVENTS} "
_L = f"WITH {q.LINEITEM} "


@query(
    "a01_kpis",
    _W + f"SELECT dataset, count(*) AS offers, count(DISTINCT hotel_name) AS hotels, {q.MEAN} AS mean_price, min(price) AS min_price, max(price) AS max_price FROM obs GROUP BY 1",
)
def a01(spark, sf_dir):
    return stats.kpis(events_obs(spark, sf_dir))


@query(
    "a01_approx_kpis",
    _L + f"""SELECT dataset, count(*) AS offers, true AS near, {q.MEAN} AS mean_price, min(price) AS min_price,
        max(price) AS max_price FROM line_obs GROUP BY 1""",
)
def a01b(spark, sf_dir):
    """The sketched number of items must be within 5 % of the exact one."""
    obs = lineitem_obs(spark, sf_dir)
    both = stats.approx_kpis(obs).join(stats.kpis(obs).select("dataset", F.col("hotels").alias("exact")), "dataset")
    near = F.abs(F.col("hotels") - F.col("exact")) <= 0.05 * F.col("exact")
    return both.select("dataset", "offers", near.alias("near"), "mean_price", "min_price", "max_price")


@query(
    "a01_fractional_prices",
    _W + f"""SELECT dataset, count(*) AS offers, count(DISTINCT hotel_name) AS hotels, CAST({q.half_up('round(avg(price / 7), 9)', 6)} AS DOUBLE) AS mean_price,
        min(price / 7) AS min_price, max(price / 7) AS max_price FROM obs GROUP BY 1""",
)
def a01c(spark, sf_dir):
    """Prices with more than two decimals."""
    return stats.kpis(events_obs(spark, sf_dir).withColumn("price", F.col("price") / 7))


@query(
    "a02_describe_prices",
    _L + f"""SELECT dataset, count(*) AS offers, count(DISTINCT hotel_name) AS hotels, {q.MEAN} AS mean_price,
        min(price) AS min_price, max(price) AS max_price, round(median(price), 4) AS median_price,
        round(stddev_samp(price), 4) AS std_price, min(observed_at) AS first_seen, max(observed_at) AS last_seen
        FROM line_obs GROUP BY 1""",
)
def a02(spark, sf_dir):
    return (
        stats.describe_prices(lineitem_obs(spark, sf_dir))
        .withColumn("median_price", money.rounded(F.col("median_price"), 4))
        .withColumn("std_price", money.rounded(F.col("std_price"), 4))
    )


_DAILY = f"{q.MEAN} AS mean_price, min(price) AS min_price, max(price) AS max_price"


@query("a03_daily_mean_min_max", _W + f"SELECT obs_date::VARCHAR AS day, {_DAILY} FROM obs GROUP BY 1")
def a03(spark, sf_dir):
    return stats.daily_stats(events_obs(spark, sf_dir)).select("day", "mean_price", "min_price", "max_price")


@query(
    "a04_daily_rounded",
    _L + f"""SELECT obs_date::VARCHAR AS day, CAST({q.half_up(q.CLEAN_MEAN, 2)} AS DOUBLE) AS mean_price, min(price) AS min_price,
        max(price) AS max_price, count(*) AS offers FROM line_obs GROUP BY 1""",
)
def a04(spark, sf_dir):
    return stats.daily_stats(lineitem_obs(spark, sf_dir)).select(
        "day", money.rounded(F.round("mean_price", 9), 2).alias("mean_price"), "min_price", "max_price", "offers"
    )


@query(
    "a05_daily_distribution",
    _W + """, b AS (SELECT obs_date AS day, quantile_cont(price, 0.25) AS q1, median(price) AS m, quantile_cont(price, 0.75) AS q3 FROM obs GROUP BY 1),
        j AS (SELECT b.*, price, price BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5 AS inside FROM obs JOIN b ON obs_date = day)
        SELECT day::VARCHAR AS day, round(any_value(q1), 4) AS q1, round(any_value(m), 4) AS median_price, round(any_value(q3), 4) AS q3,
          min(price) FILTER (inside) AS whisker_low, max(price) FILTER (inside) AS whisker_high,
          count(*) FILTER (NOT inside) AS outliers, count(*) AS offers FROM j GROUP BY j.day""",
)
def a05(spark, sf_dir):
    boxes = stats.daily_distribution(events_obs(spark, sf_dir)).drop("dataset")
    return boxes.select(
        "day",
        *[money.rounded(F.col(c), 4).alias(c) for c in ("q1", "median_price", "q3")],
        "whisker_low",
        "whisker_high",
        "outliers",
        "offers",
    )


@query(
    "a06_offers_per_item",
    _W + """SELECT hotel_name, count(*) AS offers, row_number() OVER (ORDER BY count(*) DESC, hotel_name)::INT AS position
        FROM obs GROUP BY 1 QUALIFY position <= 20""",
)
def a06(spark, sf_dir):
    return stats.offers_per_item(events_obs(spark, sf_dir)).drop("dataset")


@query(
    "a07_cheapest_row",
    _L + """SELECT hotel_name, min(price) AS price, arg_min(seq, (price, seq)) AS seq,
        arg_min(departure_airport, (price, seq)) AS departure_airport, arg_min(dates, (price, seq)) AS dates FROM line_obs GROUP BY 1""",
)
def a07(spark, sf_dir):
    offers = lineitem_obs(spark, sf_dir).select(
        "dataset", "hotel_name", "price", "seq", "departure_airport", "dates"
    )
    return stats.cheapest(offers).drop("dataset")


@query(
    "a09_first_last_change",
    _W + f""", e AS (SELECT hotel_name, arg_min(price, (observed_at, seq)) AS first_price,
        arg_max(price, (observed_at, seq)) AS last_price, count(*) AS records FROM obs GROUP BY 1 HAVING count(*) >= 2)
        SELECT *, last_price - first_price AS price_change, {q.pct('last_price', 'first_price')} AS price_change_pct FROM e""",
)
def a09(spark, sf_dir):
    return stats.first_last_change(events_obs(spark, sf_dir)).drop("dataset")


@query(
    "a09_since_start",
    _W + """, e AS (SELECT hotel_name, arg_min(price, (observed_at, seq)) - 20 AS f, arg_max(price, (observed_at, seq)) - 20 AS l FROM obs GROUP BY 1)
        SELECT hotel_name, CASE WHEN f <> 0 THEN l - f END AS price_change, CASE WHEN f <> 0 THEN (l - f) / f * 100 END AS price_change_pct FROM e""",
)
def a09b(spark, sf_dir):
    shifted = events_obs(spark, sf_dir).withColumn("price", F.col("price") - 20)
    return stats.since_start(shifted).select("hotel_name", "price_change", "price_change_pct")


@query(
    "a10_latest",
    _W + """SELECT hotel_name, arg_max(price, (observed_at, seq)) AS price, max(observed_at) AS observed_at,
        arg_max(seq, (observed_at, seq)) AS seq, arg_max(departure_airport, (observed_at, seq)) AS departure_airport FROM obs GROUP BY 1""",
)
def a10(spark, sf_dir):
    offers = events_obs(spark, sf_dir).select(
        "dataset", "hotel_name", "price", "observed_at", "seq", "departure_airport"
    )
    return stats.latest(offers).drop("dataset")


@query(
    "a10_latest_tied_times",
    f"""WITH {q.ORDERS} SELECT hotel_name, arg_max(price, (observed_at, seq)) AS price, arg_max(seq, (observed_at, seq)) AS seq
        FROM orders_obs GROUP BY 1""",
)
def a10b(spark, sf_dir):
    return stats.latest(orders_obs(spark, sf_dir)).select("hotel_name", "price", "seq")


_STATUS = "CASE WHEN {c} < 0 THEN '📉 СНИЖЕНИЕ' WHEN {c} > 0 THEN '📈 ПОВЫШЕНИЕ' ELSE '➡️ БЕЗ ИЗМЕНЕНИЙ' END"
_PROFILE = f"""SELECT hotel_name, arg_min(price, (observed_at, seq)) AS first_price, arg_max(price, (observed_at, seq)) AS last_price,
    min(price) AS min_price, max(price) AS max_price, {q.MEAN} AS avg_price, count(*) AS records,
    min(observed_at) AS first_date, max(observed_at) AS last_date"""


@query(
    "a12_watchlist",
    _W + f""", k AS (SELECT DISTINCT hotel_name FROM (SELECT * FROM obs ORDER BY price, seq LIMIT 15)),
        p AS ({_PROFILE} FROM obs WHERE hotel_name IN (SELECT hotel_name FROM k) GROUP BY 1 HAVING count(*) >= 2)
        SELECT *, last_price - first_price AS price_change, {q.pct('last_price', 'first_price')} AS price_change_pct,
          {_STATUS.format(c='(last_price - first_price)')} AS status,
          CASE WHEN last_price < first_price THEN 'green' WHEN last_price > first_price THEN 'red' ELSE 'gray' END AS status_color FROM p""",
)
def a12(spark, sf_dir):
    return stats.watchlist(events_obs(spark, sf_dir), 15).drop("dataset")


@query(
    "a18_run_status",
    """SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS successful, count(*) FILTER (o_orderstatus = 'O') AS failed FROM orders""",
)
def a18(spark, sf_dir):
    status = (
        F.when(F.col("o_orderstatus") == "F", F.lit("success"))
        .when(F.col("o_orderstatus") == "O", F.lit("error"))
        .otherwise(F.lit("running"))
    )
    return stats.run_status_summary(table(spark, sf_dir, "orders").select(status.alias("status")))


@query(
    "a18_run_failures",
    """SELECT 'order' || o_orderkey AS dataset, o_orderpriority AS message FROM orders WHERE o_orderstatus = 'O'""",
)
def a18b(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("order"), F.col("o_orderkey").cast("string")).alias("dataset"),
        F.when(F.col("o_orderstatus") == "O", F.lit("error")).otherwise(F.lit("success")).alias("status"),
        F.col("o_orderpriority").alias("message"),
    )
    return stats.run_failures(runs)


@query(
    "a19_price_histogram",
    _L + """, e AS (SELECT min(price) AS lo, max(price) AS hi FROM line_obs)
        SELECT least(floor((price - lo) / ((hi - lo) / 20)) + 1, 20)::BIGINT AS bucket, count(*) AS offers FROM line_obs, e GROUP BY 1""",
)
def a19(spark, sf_dir):
    return stats.price_histogram(lineitem_obs(spark, sf_dir)).select("bucket", "offers")


@query(
    "a20_item_stats",
    _L + f""", p AS ({_PROFILE} FROM line_obs GROUP BY 1)
        SELECT *, last_price - first_price AS price_change, {q.pct('last_price', 'first_price')} AS price_change_pct FROM p""",
)
def a20(spark, sf_dir):
    return stats.item_stats(lineitem_obs(spark, sf_dir)).drop("dataset")


@query(
    "a21_kpi_rollup",
    f"""WITH {q.EVENTS}, {q.ORDERS}, u AS (SELECT dataset, obs_date, price FROM obs UNION ALL SELECT dataset, obs_date, price FROM orders_obs)
        SELECT dataset, obs_date::VARCHAR AS day, count(price) AS offers, {q.MEAN} AS mean_price, min(price) AS min_price, max(price) AS max_price
        FROM u GROUP BY ROLLUP (dataset, obs_date)""",
)
def a21(spark, sf_dir):
    both = union_datasets({"events": events_obs(spark, sf_dir), "orders": orders_obs(spark, sf_dir)})
    return stats.kpi_rollup(both)


@query(
    "w10_last_row",
    f"WITH {q.ORDERS} SELECT hotel_name, price, seq, observed_at FROM orders_obs QUALIFY row_number() OVER (PARTITION BY hotel_name ORDER BY observed_at DESC, seq DESC) = 1",
)
def w10(spark, sf_dir):
    rows = orders_obs(spark, sf_dir).select("hotel_name", "price", "seq", "observed_at")
    return ranking.last_by(rows, ["hotel_name"], ["observed_at", "seq"])


@query(
    "w11_first_row",
    f"WITH {q.ORDERS} SELECT hotel_name, price, seq, observed_at FROM orders_obs QUALIFY row_number() OVER (PARTITION BY hotel_name ORDER BY observed_at, seq) = 1",
)
def w11(spark, sf_dir):
    rows = orders_obs(spark, sf_dir).select("hotel_name", "price", "seq", "observed_at")
    return ranking.first_by(rows, ["hotel_name"], ["observed_at", "seq"])


@query(
    "o06_most_observed",
    _W + f""", e AS (SELECT hotel_name, arg_min(price, (observed_at, seq)) AS first_price,
        arg_max(price, (observed_at, seq)) AS last_price, count(*) AS records FROM obs GROUP BY 1 HAVING count(*) >= 2)
        SELECT *, last_price - first_price AS price_change, {q.pct('last_price', 'first_price')} AS price_change_pct,
          row_number() OVER (ORDER BY records DESC, hotel_name)::INT AS position FROM e QUALIFY position <= 10""",
)
def o06(spark, sf_dir):
    return stats.most_observed(events_obs(spark, sf_dir)).drop("dataset")


@query(
    "m01_pct_change_zero",
    f"SELECT event_id, {q.pct('value', '(value - 20)')} AS pct FROM events",
)
def m01(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", money.pct_change(F.col("value"), F.col("value") - 20).alias("pct")
    )


@query(
    "m02_pct_change_null",
    "SELECT event_id, CASE WHEN floor(value / 50) <> 0 THEN (value - floor(value / 50)) / floor(value / 50) * 100 END AS pct FROM events",
)
def m02(spark, sf_dir):
    old = F.floor(F.col("value") / 50).cast("double")
    return table(spark, sf_dir, "events").select("event_id", money.pct_change(F.col("value"), old, None).alias("pct"))


@query(
    "m03_savings",
    "SELECT p_partkey, p_retailprice - p_size AS savings, (p_retailprice - p_size) / p_retailprice * 100 AS savings_percent FROM part",
)
def m03(spark, sf_dir):
    base, alt = F.col("p_retailprice"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey", money.savings(base, alt).alias("savings"), money.savings_pct(base, alt).alias("savings_percent")
    )


@query(
    "m04_direction",
    "SELECT event_id, CASE WHEN value - 50 < 0 THEN 'price_drop' ELSE 'price_increase' END AS alert_type FROM events",
)
def m04(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", money.direction(F.col("value") - 50).alias("alert_type"))


@query(
    "m05_trend_status",
    f"SELECT event_id, {_STATUS.format(c='(floor(value) - 50)')} AS status, CASE WHEN floor(value) < 50 THEN 'green' WHEN floor(value) > 50 THEN 'red' ELSE 'gray' END AS colour FROM events",
)
def m05(spark, sf_dir):
    change = F.floor("value") - 50
    return table(spark, sf_dir, "events").select(
        "event_id", money.trend_status(change).alias("status"), money.trend_colour(change).alias("colour")
    )


@query(
    "m07_rounding",
    f"""SELECT event_id, CAST({q.half_up('value / 7', 0)} AS DOUBLE) AS r0, CAST({q.half_up('value / 7', 1)} AS DOUBLE) AS r1,
        CAST({q.half_up('value / 7', 2)} AS DOUBLE) AS r2 FROM events""",
)
def m07(spark, sf_dir):
    value = F.col("value") / 7
    return table(spark, sf_dir, "events").select(
        "event_id", *[money.rounded(value, n).alias(f"r{n}") for n in (0, 1, 2)]
    )


# Some prices are NaN or infinite; the twins see them as missing.
_GAPS = _W + ", kept AS (SELECT * REPLACE (CASE WHEN seq % 7 = 0 OR seq % 11 = 1 OR seq % 13 = 2 THEN NULL ELSE price END AS price) FROM obs)"


def _with_gaps(spark, sf_dir):
    seq, number = F.col("seq"), lambda text: F.lit(float(text))
    price = (
        F.when(seq % 7 == 0, number("nan"))
        .when(seq % 11 == 1, number("inf"))
        .when(seq % 13 == 2, number("-inf"))
        .otherwise(F.col("price"))
    )
    return events_obs(spark, sf_dir).withColumn("price", price)


@query(
    "a02_not_finite",
    _GAPS + f""" SELECT dataset, count(*) AS offers, count(DISTINCT hotel_name) AS hotels, {q.MEAN} AS mean_price,
        min(price) AS min_price, max(price) AS max_price, round(median(price), 4) AS median_price, round(stddev_samp(price), 4) AS std_price
        FROM kept GROUP BY 1""",
)
def a02b(spark, sf_dir):
    out = stats.describe_prices(_with_gaps(spark, sf_dir)).drop("first_seen", "last_seen")
    return out.withColumn("median_price", F.round("median_price", 4)).withColumn("std_price", F.round("std_price", 4))


@query("a03_not_finite", _GAPS + f" SELECT obs_date::VARCHAR AS day, {_DAILY}, count(price) AS offers FROM kept GROUP BY 1")
def a03b(spark, sf_dir):
    return stats.daily_stats(_with_gaps(spark, sf_dir)).drop("dataset")


@query(
    "a05_not_finite",
    _GAPS + """, b AS (SELECT obs_date AS day, quantile_cont(price, 0.25) AS q1, median(price) AS m, quantile_cont(price, 0.75) AS q3 FROM kept GROUP BY 1),
        j AS (SELECT b.*, price, price BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5 AS inside FROM kept JOIN b ON obs_date = day WHERE price IS NOT NULL)
        SELECT day::VARCHAR AS day, round(any_value(q1), 4) AS q1, round(any_value(m), 4) AS median_price, round(any_value(q3), 4) AS q3,
          min(price) FILTER (inside) AS whisker_low, max(price) FILTER (inside) AS whisker_high,
          count(*) FILTER (NOT inside) AS outliers, count(*) AS offers FROM j GROUP BY j.day""",
)
def a05b(spark, sf_dir):
    boxes = stats.daily_distribution(_with_gaps(spark, sf_dir)).drop("dataset")
    return boxes.select("day", *[F.round(c, 4).alias(c) for c in ("q1", "median_price", "q3")],
                        "whisker_low", "whisker_high", "outliers", "offers")


@query(
    "a19_not_finite",
    _GAPS + """, e AS (SELECT min(price) AS lo, max(price) AS hi FROM kept)
        SELECT least(floor((price - lo) / ((hi - lo) / 20)) + 1, 20)::BIGINT AS bucket, count(*) AS offers FROM kept, e WHERE price IS NOT NULL GROUP BY 1""",
)
def a19b(spark, sf_dir):
    return stats.price_histogram(_with_gaps(spark, sf_dir)).select("bucket", "offers")


@query(
    "a20_not_finite",
    # The first and last rows count, also those whose price is missing.
    _GAPS + f""", p AS ({_PROFILE.replace('arg_min(', 'arg_min_null(').replace('arg_max(', 'arg_max_null(')} FROM kept GROUP BY 1)
        SELECT *, last_price - first_price AS price_change, {q.pct('last_price', 'first_price')} AS price_change_pct FROM p""",
)
def a20b(spark, sf_dir):
    return stats.item_stats(_with_gaps(spark, sf_dir)).drop("dataset")
