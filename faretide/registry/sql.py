"""Shared SQL fragments of the twins."""

SEARCH = "https://search.example.com"

_DAY = "strftime({d}, '%d-%m-%Y')"


def _url(day: str, place: str, departure: str, number: str) -> str:
    return (
        f"'{SEARCH}/kierunek/' || {place} || '/?filter[whenFrom]=' || strftime({day}, '%d-%m-%Y')"
        f" || '&filter[whenTo]=' || strftime({day} + INTERVAL 14 DAY, '%d-%m-%Y')"
        f" || '&filter[duration]=7:' || ({number} % 9 + 7) || '&filter[from]=' || {departure}"
        f" || '&filter[PriceTo]=' || ({number} % 50 * 100 + 5000) || '&order_by=ofr_price'"
    )


def _trip(day: str) -> str:
    return f"strftime({day}, '%d.%m.%Y') || ' - ' || strftime({day} + INTERVAL 7 DAY, '%d.%m.%Y')"


EVENTS = f"""obs AS (
  SELECT 'events' AS dataset, 'hotel_' || user_id AS hotel_name, value AS price,
         {_trip('ts')} AS dates, (user_id % 8 + 7) || ' dni' AS duration,
         event_type AS departure_airport,
         {_url('ts', "'dest' || (user_id % 3)", "CASE WHEN event_type = 'error' THEN '' ELSE event_type || ',Warszawa-Radom' END", 'user_id')} AS url,
         CASE WHEN event_type = 'view' THEN 'http://img.example.com/' || event_id ELSE '' END AS image_url,
         CASE WHEN event_type = 'purchase' THEN '{SEARCH}/wycieczka/dest' || (user_id % 3) || ',offer,' || event_id ELSE '' END AS offer_url,
         ts AS observed_at, CAST(ts AS DATE) AS obs_date, event_id AS seq
  FROM events)"""

LINEITEM = f"""line_obs AS (
  SELECT 'lineitem' AS dataset, 'hotel_' || l_partkey AS hotel_name, l_extendedprice AS price,
         {_trip('l_shipdate')} AS dates, (l_partkey % 8 + 7) || ' dni' AS duration,
         n_name AS departure_airport,
         {_url('l_shipdate', "'dest' || (l_partkey % 3)", 'n_name', 'l_partkey')} AS url,
         '{SEARCH}/wycieczka/dest' || (l_partkey % 3) || ',offer,' || l_orderkey AS offer_url,
         l_shipdate AS observed_at, CAST(l_shipdate AS DATE) AS obs_date,
         (l_orderkey * 8 + l_linenumber) * 1000000 + l_suppkey AS seq, n_nationkey
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
base AS (SELECT * FROM line_obs WHERE n_nationkey = (SELECT min(s_nationkey) FROM supplier))"""

ORDERS = f"""orders_obs AS (
  SELECT 'orders' AS dataset, 'hotel_' || o_custkey AS hotel_name, o_totalprice AS price,
         {_trip('o_orderdate')} AS dates, o_orderpriority AS departure_airport,
         o_orderdate AS observed_at, CAST(o_orderdate AS DATE) AS obs_date, o_orderkey AS seq
  FROM orders)"""

PCT = "CASE WHEN {old} > 0 THEN ({new} - {old}) / {old} * 100 ELSE 0.0 END"


def pct(new: str, old: str) -> str:
    return PCT.format(new=new, old=old)


def half_up(expr: str, digits: int) -> str:
    """Round half up on the printed decimal value."""
    return f"round(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38, 18)), {digits})"


def one_decimal(expr: str) -> str:
    return f"CAST(CAST({half_up(expr, 1)} AS DECIMAL(38, 1)) AS VARCHAR)"


def runs(minutes: int, source: str = "obs") -> str:
    """CTEs ``tagged`` (rows with run_id, run_start) and ``run_price`` (last price per item and run)."""
    return f"""
gaps AS (
  SELECT *, CASE WHEN observed_at - lag(observed_at) OVER w > INTERVAL {minutes} MINUTE
                   OR lag(observed_at) OVER w IS NULL THEN 1 ELSE 0 END AS starts
  FROM {source} WINDOW w AS (PARTITION BY dataset ORDER BY observed_at, seq)),
numbered AS (
  SELECT *, CAST(sum(starts) OVER (PARTITION BY dataset ORDER BY observed_at, seq
                                   ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_id FROM gaps),
tagged AS (
  SELECT *, min(observed_at) OVER (PARTITION BY dataset, run_id) AS run_start FROM numbered),
run_price AS (
  SELECT dataset, run_id, hotel_name, min(run_start) AS run_start,
         arg_max(price, (observed_at, seq)) AS price
  FROM tagged GROUP BY dataset, run_id, hotel_name)"""


# Sums of floats depend on their order, so means are cut to nine decimals before they are rounded half up to six.
CLEAN_MEAN = "round(avg(price), 9)"
MEAN = f"CAST({half_up(CLEAN_MEAN, 6)} AS DOUBLE)"
