"""Price changes of items and alerts."""

from pyspark.sql import functions as F

from faretide import fixed_values as fv
from faretide.adapters import events_obs, lineitem_obs, orders_obs
from faretide.functions.money import alert_key
from faretide.operators import alerts, changes, tables
from faretide.registry import query
from faretide.registry import sql as q

_W = f"WITH {q.EVENTS}"
_CHANGE = f"new_price - old_price AS price_change, {q.pct('new_price', 'old_price')} AS price_change_pct"


def _pairs_sql(source):
    return f"""pairs AS (SELECT dataset, hotel_name, lag(price) OVER w AS old_price, price AS new_price, observed_at AS changed_at,
        lag(seq) OVER w AS prev_seq FROM {source} WINDOW w AS (PARTITION BY dataset, hotel_name ORDER BY observed_at, seq)),
      scored AS (SELECT dataset, hotel_name, old_price, new_price, {_CHANGE}, changed_at FROM pairs WHERE prev_seq IS NOT NULL),
      alert AS (SELECT *, CASE WHEN price_change < 0 THEN 'price_drop' ELSE 'price_increase' END AS alert_type,
        hotel_name || '_' || strftime(changed_at, '%Y-%m-%d_%H-%M') || '_' || {q.one_decimal('price_change_pct')} AS unique_key
        FROM scored WHERE abs(price_change_pct) >= 4)"""


CONSECUTIVE = (
    _W
    + ", "
    + _pairs_sql("obs")
    + " SELECT hotel_name, old_price, new_price, price_change, price_change_pct, changed_at, alert_type FROM alert"
)
_COLUMNS = ["hotel_name", "old_price", "new_price", "price_change", "price_change_pct", "changed_at", "alert_type"]


@query("w01_consecutive_changes", CONSECUTIVE)
def w01(spark, sf_dir):
    return changes.consecutive_changes(events_obs(spark, sf_dir)).select(*_COLUMNS)


@query(
    "w01_tied_times",
    f"WITH {q.ORDERS}, {_pairs_sql('orders_obs')} SELECT hotel_name, old_price, new_price, price_change, price_change_pct, changed_at, alert_type FROM alert",
)
def w01b(spark, sf_dir):
    return changes.consecutive_changes(orders_obs(spark, sf_dir)).select(*_COLUMNS)


@query(
    "w01_hot_items",
    _W + ", hot AS (SELECT * REPLACE (departure_airport AS hotel_name) FROM obs), " + _pairs_sql("hot")
    + " SELECT hotel_name, old_price, new_price, price_change, price_change_pct, changed_at, alert_type FROM alert",
)
def w01c(spark, sf_dir):
    """All rows of one event type are one item's: each is read in range blocks, none in one task."""
    hot = events_obs(spark, sf_dir).withColumn("hotel_name", F.col("departure_airport"))
    return changes.consecutive_changes(hot, max_rows=1500).select(*_COLUMNS)


@query(
    "w04_window_changes",
    _W + f""", m AS (SELECT max(observed_at) AS mx FROM obs),
        r AS (SELECT hotel_name, price, observed_at, seq, mx, row_number() OVER (PARTITION BY hotel_name ORDER BY observed_at DESC, seq DESC) AS rn FROM obs, m),
        h AS (SELECT unnest([24, 48, 168]) AS window_hours),
        b AS (SELECT hotel_name, window_hours, max(price) FILTER (rn = 1) AS new_price, max(observed_at) AS latest_at,
                CASE WHEN count(*) FILTER (observed_at >= mx - window_hours * INTERVAL 1 HOUR) >= 2
                  THEN arg_min(price, (observed_at, seq)) FILTER (observed_at >= mx - window_hours * INTERVAL 1 HOUR)
                  ELSE max(price) FILTER (rn = 2) END AS old_price FROM r, h GROUP BY 1, 2)
        SELECT hotel_name, window_hours::INT AS window_hours, old_price, new_price, new_price - old_price AS price_change,
          (new_price - old_price) / old_price * 100 AS price_change_pct, latest_at FROM b WHERE old_price <> 0 AND new_price <> old_price""",
)
def w04(spark, sf_dir):
    return changes.window_changes(events_obs(spark, sf_dir)).drop("dataset")


_MOVERS = """, m AS (SELECT max(observed_at) AS mx FROM obs),
        r AS (SELECT hotel_name, price, observed_at, seq, mx, row_number() OVER (PARTITION BY hotel_name ORDER BY observed_at DESC, seq DESC) AS rn FROM obs, m),
        h AS (SELECT unnest([24, 48, 168]) AS window_hours),
        b AS (SELECT hotel_name, window_hours, max(price) FILTER (rn = 1) AS new_price,
                CASE WHEN count(*) FILTER (observed_at >= mx - window_hours * INTERVAL 1 HOUR) >= 2
                  THEN arg_min(price, (observed_at, seq)) FILTER (observed_at >= mx - window_hours * INTERVAL 1 HOUR)
                  ELSE max(price) FILTER (rn = 2) END AS old_price FROM r, h GROUP BY 1, 2),
        c AS (SELECT hotel_name, window_hours::INT AS window_hours, old_price, new_price, new_price - old_price AS price_change,
                CASE WHEN new_price < old_price THEN 'decrease' ELSE 'increase' END AS side FROM b WHERE old_price <> 0 AND new_price <> old_price),
        movers AS (SELECT *, row_number() OVER (PARTITION BY window_hours, side ORDER BY abs(price_change) DESC, hotel_name)::INT AS position
        FROM c QUALIFY position <= 5)"""


@query("o04_movers", _W + _MOVERS + " SELECT * FROM movers")
def o04(spark, sf_dir):
    return changes.movers(events_obs(spark, sf_dir)).select(
        "hotel_name", "window_hours", "old_price", "new_price", "price_change", "side", "position"
    )


@query(
    "w08_extreme_labels",
    _W + f""", m AS (SELECT max(observed_at) AS mx FROM obs),
        e AS (SELECT hotel_name, arg_max(price, (observed_at, seq)) AS price,
          min(price) FILTER (observed_at >= mx - INTERVAL 7 DAY) AS n7, max(price) FILTER (observed_at >= mx - INTERVAL 7 DAY) AS x7,
          min(price) FILTER (observed_at >= mx - INTERVAL 30 DAY) AS n30, max(price) FILTER (observed_at >= mx - INTERVAL 30 DAY) AS x30
          FROM obs, m GROUP BY 1)
        SELECT hotel_name, price, concat_ws(';', CASE WHEN price <= n7 THEN '{fv.NEW_MINIMUM % 7}' END, CASE WHEN price >= x7 THEN '{fv.NEW_MAXIMUM % 7}' END,
          CASE WHEN price <= n30 THEN '{fv.NEW_MINIMUM % 30}' END, CASE WHEN price >= x30 THEN '{fv.NEW_MAXIMUM % 30}' END) AS labels FROM e""",
)
def w08(spark, sf_dir):
    labelled = changes.extreme_labels(events_obs(spark, sf_dir))
    return labelled.select("hotel_name", "price", F.array_join("labels", ";").alias("labels"))


@query(
    "j11_newest_time",
    f"""WITH {q.LINEITEM}, m AS (SELECT max(observed_at) AS mx FROM line_obs),
        s AS (SELECT hotel_name, arg_max(price, (observed_at, seq)) FILTER (observed_at < mx) AS old_price,
          arg_min(price, (observed_at, seq)) FILTER (observed_at = mx) AS new_price FROM line_obs, m GROUP BY 1)
        SELECT hotel_name, old_price, new_price, new_price - old_price AS price_change, (new_price - old_price) / old_price * 100 AS price_change_pct
        FROM s WHERE new_price IS NOT NULL AND old_price IS NOT NULL AND abs(new_price - old_price) >= 100""",
)
def j11(spark, sf_dir):
    return changes.snapshot_changes(lineitem_obs(spark, sf_dir)).drop("dataset")


@query(
    "j11_newest_run",
    _W + f""", {q.runs(30)}, l AS (SELECT max(run_id) AS last_run FROM tagged),
        s AS (SELECT hotel_name, arg_max(price, (observed_at, seq)) FILTER (run_id < last_run) AS old_price,
          arg_min(price, (observed_at, seq)) FILTER (run_id = last_run) AS new_price FROM tagged, l GROUP BY 1)
        SELECT hotel_name, old_price, new_price, new_price - old_price AS price_change, (new_price - old_price) / old_price * 100 AS price_change_pct
        FROM s WHERE new_price IS NOT NULL AND old_price IS NOT NULL AND abs(new_price - old_price) >= 5""",
)
def j11b(spark, sf_dir):
    found = changes.snapshot_changes(events_obs(spark, sf_dir), 5.0, "last_run", "30 minutes")
    return found.drop("dataset")


@query(
    "m06_alert_keys",
    _W + ", " + _pairs_sql("obs") + f""" SELECT hotel_name, changed_at, old_price, new_price, unique_key,
        hotel_name || '_' || strftime(changed_at, '%Y-%m-%d_%H-%M') || '_' || CASE WHEN price_change_pct >= 0 THEN '+' ELSE '' END
        || {q.one_decimal('price_change_pct')} AS signed_key FROM alert""",
)
def m06(spark, sf_dir):
    found = changes.consecutive_changes(events_obs(spark, sf_dir))
    signed = alert_key(F.col("hotel_name"), F.col("changed_at"), F.col("price_change_pct"))
    return found.select(
        "hotel_name", "changed_at", "old_price", "new_price", "unique_key", signed.alias("signed_key")
    )


def _halves(spark, sf_dir):
    """All alerts, and those of the first half of the month as history."""
    found = changes.consecutive_changes(events_obs(spark, sf_dir))
    return found, found.filter(F.col("changed_at") < F.lit("2024-01-16").cast("timestamp"))


@query(
    "j08_new_alerts",
    _W + ", " + _pairs_sql("obs") + """ SELECT DISTINCT unique_key FROM alert WHERE unique_key NOT IN
        (SELECT unique_key FROM alert WHERE changed_at < TIMESTAMP '2024-01-16')""",
)
def j08(spark, sf_dir):
    found, history = _halves(spark, sf_dir)
    return alerts.new_alerts(found, history).select("unique_key")


@query(
    "j03_missing_items",
    _W + f""", cur AS (SELECT DISTINCT hotel_name FROM obs WHERE observed_at >= TIMESTAMP '2024-01-30'),
        h AS (SELECT hotel_name, arg_max(price, (observed_at, seq)) AS old_price, max(observed_at) AS seen FROM obs WHERE observed_at < TIMESTAMP '2024-01-30' GROUP BY 1)
        SELECT hotel_name, 'missing' AS alert_type, old_price, CAST(NULL AS DOUBLE) AS new_price, '2024-01-30T00:00:00+00:00' AS timestamp,
          '{fv.MISSING_NOTE}{fv.MISSING_NOTE_LIMIT % 8100}' AS note, hotel_name || '_' || strftime(seen, '%Y-%m-%d_%H-%M') || '_missing' AS unique_key
        FROM h WHERE hotel_name NOT IN (SELECT hotel_name FROM cur)""",
)
def j03(spark, sf_dir):
    obs, cut = events_obs(spark, sf_dir), F.lit("2024-01-30").cast("timestamp")
    before, now = obs.filter(F.col("observed_at") < cut), obs.filter(F.col("observed_at") >= cut)
    return alerts.missing_items(before, now, 8100.0, "2024-01-30T00:00:00+00:00").drop("dataset")


@query(
    "a16_alert_counts",
    _W + ", " + _pairs_sql("obs") + " SELECT count(*) AS total, count(*) FILTER (price_change < 0) AS drops, count(*) FILTER (price_change > 0) AS increases FROM alert",
)
def a16(spark, sf_dir):
    return alerts.alert_counts(changes.consecutive_changes(events_obs(spark, sf_dir))).drop("dataset")


@query(
    "o05_top_alerts",
    _W + ", " + _pairs_sql("obs") + """, s AS (SELECT *, CASE WHEN price_change < 0 THEN 'drop' ELSE 'increase' END AS side FROM alert WHERE price_change <> 0)
        SELECT hotel_name, side, price_change, changed_at, row_number() OVER (PARTITION BY side ORDER BY abs(price_change) DESC, hotel_name, unique_key)::INT AS position
        FROM s QUALIFY position <= 10""",
)
def o05(spark, sf_dir):
    top = alerts.top_alerts(changes.consecutive_changes(events_obs(spark, sf_dir)))
    return top.select("hotel_name", "side", "price_change", "changed_at", "position")


_DELTA = """CASE WHEN {c} IS NULL THEN '—' WHEN {c} > 0 THEN '↑ +' || {p} || '%' WHEN {c} < 0 THEN '↓ ' || {p} || '%' ELSE '→ ' || {p} || '%' END"""
ITEMS = f""", m AS (SELECT max(observed_at) AS mx FROM obs),
   r AS (SELECT *, row_number() OVER (PARTITION BY hotel_name ORDER BY observed_at DESC, seq DESC) AS rn,
                row_number() OVER (PARTITION BY hotel_name ORDER BY observed_at, seq) AS fn FROM obs, m),
   i0 AS (SELECT hotel_name, max(price) FILTER (rn = 1) AS price, max(dates) FILTER (rn = 1) AS dates, max(duration) FILTER (rn = 1) AS duration,
          max(departure_airport) FILTER (rn = 1) AS departure_airport, max(offer_url) FILTER (rn = 1) AS offer_url, max(observed_at) AS observed_at,
          max(price) FILTER (fn = 1) AS first_price,
          CASE WHEN count(*) FILTER (observed_at >= mx - INTERVAL 48 HOUR) >= 2
               THEN arg_min(price, (observed_at, seq)) FILTER (observed_at >= mx - INTERVAL 48 HOUR) ELSE max(price) FILTER (rn = 2) END AS base,
          min(price) FILTER (observed_at >= mx - INTERVAL 7 DAY) AS n7, max(price) FILTER (observed_at >= mx - INTERVAL 7 DAY) AS x7,
          min(price) FILTER (observed_at >= mx - INTERVAL 30 DAY) AS n30, max(price) FILTER (observed_at >= mx - INTERVAL 30 DAY) AS x30
        FROM r GROUP BY 1),
   items AS (SELECT *, CASE WHEN base <> 0 AND base <> price THEN price - base END AS delta,
          CASE WHEN base <> 0 AND base <> price THEN (price - base) / base * 100 END AS delta_pct,
          CASE WHEN first_price <> 0 THEN price - first_price END AS since_start,
          CASE WHEN first_price <> 0 THEN (price - first_price) / first_price * 100 END AS since_start_pct,
          concat_ws(';', CASE WHEN price <= n7 THEN '{fv.NEW_MINIMUM % 7}' END, CASE WHEN price >= x7 THEN '{fv.NEW_MAXIMUM % 7}' END,
          CASE WHEN price <= n30 THEN '{fv.NEW_MINIMUM % 30}' END, CASE WHEN price >= x30 THEN '{fv.NEW_MAXIMUM % 30}' END) AS labels FROM i0)"""


@query(
    "j12_item_table",
    _W + ITEMS + " SELECT hotel_name, price, dates, duration, departure_airport, offer_url, observed_at, delta, delta_pct, since_start, since_start_pct, labels FROM items",
)
def j12(spark, sf_dir):
    table = tables.item_table(events_obs(spark, sf_dir)).drop("dataset")
    return table.withColumn("labels", F.array_join("labels", ";"))


@query(
    "r06_item_rows",
    _W + ITEMS + f""" SELECT hotel_name, replace(hotel_name, '_', '-') AS slug, CAST(CAST({q.half_up('price', 0)} AS BIGINT) AS VARCHAR) || ' PLN' AS price_text, price AS price_sort,
        {_DELTA.format(c='delta', p=q.one_decimal('delta_pct'))} AS delta_text, coalesce(delta_pct, 0.0) AS delta_sort,
        {_DELTA.format(c='since_start', p=q.one_decimal('since_start_pct'))} AS since_text, coalesce(since_start_pct, 0.0) AS since_sort,
        dates, duration, departure_airport AS airport, CASE WHEN offer_url = '' THEN '—' ELSE offer_url END AS offer_link FROM items""",
)
def r06(spark, sf_dir):
    return tables.item_rows(tables.item_table(events_obs(spark, sf_dir))).drop("dataset")
