"""Report rows and the alert feed."""

from pyspark.sql import functions as F

from faretide import fixed_values as fv
from faretide.adapters import base_and_any, events_obs, lineitem_obs, table
from faretide.operators import airports, alerts, changes, reports
from faretide.plans.runs import tag_runs
from faretide.registry import query
from faretide.registry import sql as q
from faretide.registry.airport_queries import CHEAPER, MISSING
from faretide.registry.change_queries import _MOVERS, _pairs_sql
from faretide.registry.run_queries import GAP, RUN_ALERTS
from faretide.sources.alerts import canonical_alerts
from faretide.schema import RAW_ALERT


def _whole(expr):
    return f"CAST(CAST({q.half_up(expr, 0)} AS BIGINT) AS VARCHAR)"


def _signed(expr):
    return f"CASE WHEN {expr} >= 0 THEN '+' ELSE '' END || {_whole(expr)}"


def _signed_pct(expr):
    return f"CASE WHEN {expr} >= 0 THEN '+' ELSE '' END || {q.one_decimal(expr)} || '%'"


def _change_line(width):
    return (
        f"left(hotel_name, {width}) || ': ' || {_whole('old_price')} || ' → ' || {_whole('new_price')} || ' PLN, ' || "
        f"{_signed('price_change')} || ' PLN (' || {_signed_pct('price_change_pct')} || ')'"
    )


def _money(expr):
    return f"CAST(CAST({q.half_up(expr, 2)} AS DECIMAL(38, 2)) AS VARCHAR)"


@query(
    "r01_comparison_report",
    f"WITH {q.LINEITEM}" + CHEAPER + MISSING.format(cap=8000) + f""" SELECT section, position, line FROM (
      SELECT 'missing' AS section, row_number() OVER (ORDER BY price, hotel_name) AS position,
        left(hotel_name, 50) || ' | ' || {_whole('price')} || ' PLN | ' || departure_airport AS line FROM missing
      UNION ALL SELECT 'cheaper', row_number() OVER (ORDER BY savings DESC, hotel_name), left(hotel_name, 40) || ' | ' || {_whole('base_price')} || ' PLN | ' ||
        best_departure_airport || ': ' || {_whole('best_other_price')} || ' PLN | ' || {_whole('savings')} || ' PLN (' || {q.one_decimal('savings_percent')} || '%)' FROM cheaper)
      WHERE position <= 20""",
)
def r01(spark, sf_dir):
    base, everything = base_and_any(spark, sf_dir)
    missing = airports.missing_in_base(base, everything)
    cheaper = airports.cheaper_alternatives(base, everything, taken={"departure_airport": "best_departure_airport"})
    return reports.comparison_rows(missing, cheaper).drop("dataset")


@query(
    "r02_alert_report",
    f"WITH {q.EVENTS}, " + _pairs_sql("obs") + f""" SELECT CASE WHEN price_change < 0 THEN 'drop' ELSE 'increase' END AS section,
      row_number() OVER (PARTITION BY price_change < 0 ORDER BY hotel_name, changed_at, old_price, new_price) AS position,
      {_change_line(50)} || ', ' || strftime(changed_at, '%Y-%m-%dT%H:%M:%S') AS line FROM alert WHERE price_change <> 0""",
)
def r02(spark, sf_dir):
    found = changes.consecutive_changes(events_obs(spark, sf_dir))
    return reports.alert_report_rows(found).drop("dataset")


@query(
    "r03_alert_summary",
    RUN_ALERTS + f""", top AS (SELECT *, CASE WHEN price_change < 0 THEN 'drop' ELSE 'increase' END AS section, row_number() OVER (PARTITION BY price_change < 0
        ORDER BY abs(price_change) DESC, hotel_name, unique_key) AS position FROM alert WHERE price_change <> 0)
      SELECT * FROM (SELECT 'count' AS section, 1 AS position, 'total: ' || count(*) AS line FROM alert
      UNION ALL SELECT 'count', 2, 'drops: ' || count(*) FROM alert WHERE price_change < 0
      UNION ALL SELECT 'count', 3, 'increases: ' || count(*) FROM alert WHERE price_change > 0) WHERE EXISTS (SELECT 1 FROM alert)
      UNION ALL SELECT section, position, hotel_name || ': ' || old_price || ' → ' || new_price || ' PLN (' || {_signed_pct('price_change_pct')} || ')' FROM top WHERE position <= 10""",
)
def r03(spark, sf_dir):
    obs = events_obs(spark, sf_dir).select("dataset", "hotel_name", "price", "observed_at", "seq")
    return reports.alert_summary_rows(changes.run_changes(tag_runs(obs, GAP))).drop("dataset")


@query(
    "r04_price_report",
    f"""WITH {q.EVENTS}, k AS (SELECT count(*) AS n, count(DISTINCT hotel_name) AS h, {q.MEAN} AS m, min(price) AS lo, max(price) AS hi FROM obs),
      top AS (SELECT *, row_number() OVER (ORDER BY price, seq) AS position FROM obs QUALIFY position <= 5)
      SELECT 'statistics' AS section, 1 AS position, 'offers: ' || n AS line FROM k UNION ALL SELECT 'statistics', 2, 'hotels: ' || h FROM k
      UNION ALL SELECT 'statistics', 3, 'mean: ' || {_money('m')} FROM k UNION ALL SELECT 'statistics', 4, 'min: ' || {_money('lo')} FROM k
      UNION ALL SELECT 'statistics', 5, 'max: ' || {_money('hi')} FROM k
      UNION ALL SELECT 'cheapest', position, hotel_name || ' - ' || {_money('price')} || ' PLN | ' || dates || ' | ' || strftime(observed_at, '%Y-%m-%dT%H:%M:%S.%f') FROM top""",
)
def r04(spark, sf_dir):
    return reports.price_report_rows(events_obs(spark, sf_dir)).drop("dataset")


@query(
    "r05_snapshot_report",
    f"""WITH {q.LINEITEM}, m AS (SELECT max(observed_at) AS mx FROM line_obs),
        s AS (SELECT hotel_name, arg_max(price, (observed_at, seq)) FILTER (observed_at < mx) AS old_price,
          arg_min(price, (observed_at, seq)) FILTER (observed_at = mx) AS new_price FROM line_obs, m GROUP BY 1),
        c AS (SELECT *, new_price - old_price AS price_change, (new_price - old_price) / old_price * 100 AS price_change_pct FROM s
          WHERE new_price IS NOT NULL AND old_price IS NOT NULL AND abs(new_price - old_price) >= 100)
        SELECT 'snapshot' AS section, row_number() OVER (ORDER BY abs(price_change) DESC, hotel_name) AS position,
          CASE WHEN price_change > 0 THEN '📈 ' ELSE '📉 ' END || {_change_line(40)} AS line FROM c QUALIFY position <= 10""",
)
def r05(spark, sf_dir):
    return reports.snapshot_rows(changes.snapshot_changes(lineitem_obs(spark, sf_dir))).drop("dataset")


@query(
    "r07_mover_blocks",
    f"WITH {q.EVENTS}" + _MOVERS + f""" SELECT side || '_' || window_hours || 'h' AS section, position::BIGINT AS position,
        {_change_line(100)} AS line FROM (SELECT *, price_change / old_price * 100 AS price_change_pct FROM movers) WHERE window_hours IN (24, 168)""",
)
def r07(spark, sf_dir):
    return reports.mover_rows(events_obs(spark, sf_dir)).drop("dataset")


_FEED_SQL = """WITH raw AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'hotel_' || user_id END AS hotel_name,
      CASE WHEN event_id % 2 = 1 AND event_id % 5 <> 0 THEN 'stary ' || user_id END AS hotel, value AS v, event_id % 4 AS k, event_id % 7 AS z, ts FROM events)"""


def _raw_alerts(spark, sf_dir):
    """Alerts in the current, the legacy and the missing-item shape."""
    event = table(spark, sf_dir, "events")
    key, user, value = F.col("event_id"), F.col("user_id").cast("string"), F.col("value")
    iso = F.date_format("ts", fv.ISO_FORMAT)
    kind, zone = key % 4, key % 7
    columns = {
        "hotel_name": F.when(key % 2 == 0, F.concat(F.lit("hotel_"), user)),
        "hotel": F.when((key % 2 == 1) & (key % 5 != 0), F.concat(F.lit("stary "), user)),
        "old_price": F.when(kind == 0, value),
        "from": F.when(kind == 1, value),
        "previous_price": F.when(kind >= 2, value),
        "new_price": F.when(kind == 0, value + 1),
        "to": F.when(kind == 1, value - 1),
        "current_price": F.when(kind == 2, value),
        "price_change": F.when(kind == 0, F.lit(1.0)).when(kind == 1, F.lit(-1.0)),
        "price_change_pct": F.when(kind == 0, F.lit(4.0)).when(kind == 1, F.lit(-12.5)),
        "type": F.when(kind == 3, F.lit("missing")),
        "alert_type": F.when(kind == 0, F.lit("price_increase")),
        "created_at": F.when(zone == 0, F.concat(iso, F.lit("+02:00"))).when(zone == 1, iso),
        "timestamp": F.when(zone == 2, iso),
        "time": F.when(zone == 3, iso).when(zone == 4, F.lit("wczoraj")),
        "unique_key": key.cast("string"),
        "note": F.when(key % 8 == 3, F.lit("brak")),
    }
    return event.select(
        *[
            columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in RAW_ALERT.fields
        ]
    )


@query(
    "p33_legacy_alert_fields",
    _FEED_SQL + """ SELECT event_id::VARCHAR AS unique_key, coalesce(hotel_name, hotel) AS hotel_name, v AS old_price,
      CASE k WHEN 0 THEN v + 1 WHEN 1 THEN v - 1 WHEN 2 THEN v END AS new_price,
      CASE k WHEN 0 THEN 'price_increase' WHEN 3 THEN 'missing' END AS alert_type FROM raw""",
)
def p33(spark, sf_dir):
    folded = canonical_alerts(_raw_alerts(spark, sf_dir))
    return folded.select("unique_key", "hotel_name", "old_price", "new_price", "alert_type")


@query(
    "o08_alert_feed_order",
    _FEED_SQL + """, t AS (SELECT event_id, CASE z WHEN 0 THEN ts - INTERVAL 2 HOUR WHEN 1 THEN ts WHEN 2 THEN ts WHEN 3 THEN ts END AS feed_time FROM raw)
      SELECT event_id::VARCHAR AS unique_key, feed_time FROM t ORDER BY feed_time DESC NULLS LAST, unique_key""",
)
def o08(spark, sf_dir):
    return alerts.alert_feed(canonical_alerts(_raw_alerts(spark, sf_dir))).select("unique_key", "feed_time")


@query(
    "r08_feed_rows",
    _FEED_SQL + """ SELECT coalesce(hotel_name, hotel, 'Unknown') AS hotel_name,
      CASE k WHEN 3 THEN 'missing' WHEN 0 THEN 'increase' WHEN 1 THEN 'decrease' ELSE '' END AS direction,
      CASE k WHEN 3 THEN '— ' || CASE WHEN event_id % 8 = 3 THEN 'brak' ELSE 'Отель пропал из выдачи' END
             WHEN 0 THEN '↑ +4.0%' WHEN 1 THEN '↓ -12.5%' ELSE '→ +0.0%' END AS change_text,
      CASE k WHEN 3 THEN v || ' → —' WHEN 0 THEN v || ' → ' || (v + 1) || ' PLN' WHEN 1 THEN v || ' → ' || (v - 1) || ' PLN' ELSE v || ' → ' || v || ' PLN' END AS price_text
      FROM raw""",
)
def r08(spark, sf_dir):
    rows = alerts.feed_rows(canonical_alerts(_raw_alerts(spark, sf_dir)))
    return rows.select("hotel_name", "direction", "change_text", "price_text")
