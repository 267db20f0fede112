"""Runs, top-n index and trend index."""

from pyspark.sql import functions as F

from faretide.adapters import events_obs
from faretide.operators import changes, topn
from faretide.plans.runs import run_prices, run_times, tag_runs
from faretide.registry import query
from faretide.registry import sql as q

GAP = "15 minutes"
_W = f"WITH {q.EVENTS}, {q.runs(15)}"


def _tagged(spark, sf_dir, gap=GAP):
    obs = events_obs(spark, sf_dir).select("dataset", "hotel_name", "price", "observed_at", "seq")
    return tag_runs(obs, gap)


@query(
    "w02_run_segmentation",
    f"WITH {q.EVENTS}, {q.runs(5)} SELECT seq, run_id, run_start FROM tagged",
)
def w02(spark, sf_dir):
    return _tagged(spark, sf_dir, "5 minutes").select("seq", "run_id", "run_start")


@query(
    "w03_run_times",
    _W + " SELECT run_id, min(observed_at) AS run_start, max(observed_at) AS run_end FROM tagged GROUP BY 1",
)
def w03(spark, sf_dir):
    return run_times(events_obs(spark, sf_dir), GAP).drop("dataset")


@query("a11_run_prices", _W + " SELECT run_id, hotel_name, run_start, price FROM run_price")
def a11(spark, sf_dir):
    return run_prices(_tagged(spark, sf_dir)).drop("dataset")


def _change_sql(minutes):
    return f"""WITH {q.EVENTS}, {q.runs(minutes)},
      pairs AS (SELECT c.hotel_name, c.run_id, p.price AS old_price, c.price AS new_price, c.run_start AS changed_at
        FROM run_price c JOIN run_price p ON c.hotel_name = p.hotel_name AND c.run_id = p.run_id + 1),
      scored AS (SELECT *, new_price - old_price AS price_change, {q.pct('new_price', 'old_price')} AS price_change_pct FROM pairs),
      alert AS (SELECT *, CASE WHEN price_change < 0 THEN 'price_drop' ELSE 'price_increase' END AS alert_type,
        hotel_name || '_' || strftime(changed_at, '%Y-%m-%d_%H-%M') || '_' || CASE WHEN price_change_pct >= 0 THEN '+' ELSE '' END
        || {q.one_decimal('price_change_pct')} AS unique_key FROM scored WHERE abs(price_change_pct) >= 4)"""


RUN_ALERTS = _change_sql(15)
_ALERT = "hotel_name, old_price, new_price, price_change, price_change_pct, changed_at, alert_type, unique_key"


@query("j04_run_changes", RUN_ALERTS + f" SELECT {_ALERT} FROM alert")
def j04(spark, sf_dir):
    return changes.run_changes(_tagged(spark, sf_dir)).select(*_ALERT.split(", "))


@query("j04_run_changes_default_gap", _change_sql(5) + f" SELECT {_ALERT} FROM alert")
def j04b(spark, sf_dir):
    return changes.run_changes(_tagged(spark, sf_dir, "5 minutes")).select(*_ALERT.split(", "))


@query("w12_previous_run_only", RUN_ALERTS + " SELECT hotel_name, run_id, old_price, new_price FROM pairs")
def w12(spark, sf_dir):
    return changes.run_pairs(_tagged(spark, sf_dir)).select("hotel_name", "run_id", "old_price", "new_price")


_POSITION = """(CASE WHEN count(*) OVER (PARTITION BY run_id) < 10 THEN 1 + (SELECT count(*) FROM {t} c WHERE c.run_id = p.run_id AND c.price < p.price)
     ELSE row_number() OVER (PARTITION BY run_id ORDER BY price, hotel_name) END)::INT AS position"""
_STRICT = f""", ranked AS (SELECT *, {_POSITION.format(t='run_price')} FROM run_price p),
   members AS (SELECT * FROM ranked WHERE position <= 10)"""
_SHARED = """, ranked AS (SELECT *, rank() OVER (PARTITION BY run_id ORDER BY price)::INT AS position FROM run_price),
   members AS (SELECT * FROM ranked WHERE position <= 10)"""
_LAST = f""", current AS (SELECT hotel_name, arg_max(price, (observed_at, seq)) AS price FROM obs GROUP BY 1),
   last_run AS (SELECT max(run_id) AS run_id, max(run_start) AS run_start FROM tagged),
   fixed_price AS (SELECT dataset, run_id, hotel_name, run_start, price FROM run_price WHERE run_id < (SELECT run_id FROM last_run)
      OR (SELECT count(*) FROM current) < 10
      UNION ALL SELECT 'events', run_id, hotel_name, run_start, price FROM current, last_run WHERE (SELECT count(*) FROM current) >= 10),
   ranked AS (SELECT *, {_POSITION.format(t='fixed_price')} FROM fixed_price p),
   members AS (SELECT * FROM ranked WHERE position <= 10)"""
_MEMBER = "run_id, run_start, hotel_name, price, position"


@query("w05_strict_members", _W + _STRICT + f" SELECT {_MEMBER} FROM members")
def w05(spark, sf_dir):
    return topn.top_members(_tagged(spark, sf_dir)).select(*_MEMBER.split(", "))


def _small(spark, sf_dir):
    """Runs cut to at most nine items, and prices in steps of 50: positions are shared in most of them."""
    user = F.substring_index("hotel_name", "_", -1).cast("bigint")
    stepped = _tagged(spark, sf_dir).withColumn("price", (F.floor(F.col("price") / 50) * 50).cast("double"))
    return stepped.filter((user % 15 < F.col("run_id") % 5) | (F.col("run_id") % 7 == 0))


@query(
    "w05_small_runs",
    _W.replace("value AS price", "floor(value / 50) * 50 AS price")
    + ", small AS (SELECT * FROM run_price WHERE CAST(split_part(hotel_name, '_', 2) AS BIGINT) % 15 < run_id % 5 OR run_id % 7 = 0)"
    + _STRICT.replace("run_price", "small") + f" SELECT {_MEMBER} FROM members",
)
def w05b(spark, sf_dir):
    return topn.top_members(_small(spark, sf_dir)).select(*_MEMBER.split(", "))


@query(
    "w06_shared_members",
    _W.replace("value AS price", "floor(value / 50) * 50 AS price") + _SHARED + f" SELECT {_MEMBER} FROM members",
)
def w06(spark, sf_dir):
    """Prices in steps of 50, so that positions are shared."""
    rounded = _tagged(spark, sf_dir).withColumn("price", (F.floor(F.col("price") / 50) * 50).cast("double"))
    return topn.top_members(rounded, ties="shared").select(*_MEMBER.split(", "))


@query("w09_corrected_members", _W + _LAST + f" SELECT {_MEMBER} FROM members")
def w09(spark, sf_dir):
    return topn.top_members(_tagged(spark, sf_dir), correct_last=True).select(*_MEMBER.split(", "))


_INDEX = f""", idx AS (SELECT run_id, min(run_start) AS run_start, avg(price) AS avg_price, count(*) AS members FROM members GROUP BY 1)"""


@query("a13_topn_index", _W + _STRICT + _INDEX + " SELECT * REPLACE (round(avg_price, 6) AS avg_price) FROM idx")
def a13(spark, sf_dir):
    return topn.topn_index(_tagged(spark, sf_dir)).select("run_id", "run_start", "avg_price", "members")


@query(
    "w07_index_change",
    _W + _STRICT + _INDEX + """ SELECT run_id, round(avg_price, 6) AS avg_price, round(coalesce(avg_price - lag(avg_price) OVER w, 0.0), 6) AS avg_change,
        round(coalesce((avg_price - lag(avg_price) OVER w) / lag(avg_price) OVER w * 100, 0.0), 6) AS avg_change_pct
        FROM idx WINDOW w AS (ORDER BY run_id)""",
)
def w07(spark, sf_dir):
    return topn.topn_index(_tagged(spark, sf_dir)).select("run_id", "avg_price", "avg_change", "avg_change_pct")


_DIFF = """, diff AS (SELECT coalesce(c.run_id, p.run_id + 1) AS run_id, coalesce(c.hotel_name, p.hotel_name) AS hotel_name,
     CASE WHEN c.price IS NULL THEN 'left' WHEN p.price IS NULL THEN 'entered' WHEN p.price <> c.price THEN 'repriced' END AS kind,
     p.price AS old_price, c.price AS new_price, c.price - p.price AS price_change, (c.price - p.price) / p.price * 100 AS price_change_pct,
     coalesce(c.position, p.position)::BIGINT AS position
   FROM members c FULL JOIN members p ON c.hotel_name = p.hotel_name AND c.run_id = p.run_id + 1),
   kept AS (SELECT * FROM diff WHERE kind IS NOT NULL AND run_id > 1 AND run_id <= (SELECT max(run_id) FROM members))"""


@query("j05_topn_diff", _W + _STRICT + _DIFF + " SELECT * FROM kept")
def j05(spark, sf_dir):
    return topn.topn_diff(_tagged(spark, sf_dir)).drop("dataset")


_LISTS = """, lists AS (SELECT run_id,
      string_agg(hotel_name || ':' || old_price || '>' || new_price, ';' ORDER BY position, hotel_name) FILTER (kind = 'repriced') AS price_changes,
      string_agg(hotel_name || ':' || new_price, ';' ORDER BY position, hotel_name) FILTER (kind = 'entered') AS new_hotels,
      string_agg(hotel_name || ':' || old_price, ';' ORDER BY position, hotel_name) FILTER (kind = 'left') AS removed_hotels
   FROM kept GROUP BY 1)"""


def _joined(column, *fields):
    def entry(e):
        parts = [e["name"], F.lit(":")]
        for i, f in enumerate(fields):
            parts += ([F.lit(">")] if i else []) + [e[f].cast("string")]
        return F.concat(*parts)

    return F.nullif(F.array_join(F.transform(column, entry), ";"), F.lit("")).alias(column)


@query("m08_change_lists", _W + _STRICT + _DIFF + _LISTS + " SELECT * FROM lists")
def m08(spark, sf_dir):
    lists = topn.change_lists(topn.topn_diff(_tagged(spark, sf_dir)))
    return lists.select(
        "run_id",
        _joined("price_changes", "old_price", "new_price"),
        _joined("new_hotels", "price"),
        _joined("removed_hotels", "price"),
    )


@query(
    "m09_hover_records",
    _W + _STRICT + _INDEX + _DIFF + _LISTS + """, ch AS (SELECT * REPLACE (round(avg_price, 6) AS avg_price), round(coalesce(avg_price - lag(avg_price) OVER (ORDER BY run_id), 0.0), 6) AS avg_change FROM idx)
      SELECT ch.run_id, '📊 ТОП-10 (' || strftime(run_start, '%Y-%m-%d %H:%M') || ')' AS title, avg_price,
        CASE WHEN avg_change > 0 THEN '↑' WHEN avg_change < 0 THEN '↓' END AS arrow,
        CASE WHEN avg_change <> 0 THEN avg_change END AS avg_change, price_changes, new_hotels, removed_hotels,
        price_changes IS NULL AND new_hotels IS NULL AND removed_hotels IS NULL AND avg_change = 0 AS no_changes
      FROM ch LEFT JOIN lists USING (run_id)""",
)
def m09(spark, sf_dir):
    records = topn.hover_records(_tagged(spark, sf_dir))
    return records.select(
        "run_id",
        "title",
        "avg_price",
        F.col("avg_move.arrow").alias("arrow"),
        F.col("avg_move.avg_change").alias("avg_change"),
        _joined("price_changes", "old_price", "new_price"),
        _joined("new_hotels", "price"),
        _joined("removed_hotels", "price"),
        "no_changes",
    )


@query(
    "a14_trend_index",
    RUN_ALERTS + """ SELECT run_id, min(changed_at) AS run_start, round(avg(price_change_pct), 6) AS avg_change_pct, count(*) AS compared_items,
        any_value((SELECT count(*) FROM run_price r WHERE r.run_id = scored.run_id)) AS items FROM scored WHERE old_price > 0 GROUP BY run_id""",
)
def a14(spark, sf_dir):
    index = topn.trend_index(_tagged(spark, sf_dir)).drop("dataset")
    return index.withColumn("avg_change_pct", F.round("avg_change_pct", 6))


@query(
    "a14_trend_changes",
    RUN_ALERTS + """ SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY hotel_name) AS position, hotel_name AS name, old_price, new_price,
        price_change_pct AS change_percent FROM scored WHERE old_price > 0""",
)
def a14b(spark, sf_dir):
    """The items behind every point of the trend index, here in parts of seven."""
    lists = topn.trend_changes(_tagged(spark, sf_dir), 7)
    listed = lists.select("run_id", "part", F.inline("price_changes"))
    # Each entry stands in the part that its position says.
    return listed.filter(F.floor((F.col("position") - 1) / 7) == F.col("part")).drop("part")
