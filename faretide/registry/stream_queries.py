"""Streams over the event table, run to their end."""

from pyspark.sql import functions as F

from faretide.adapters import events_obs, events_stream, shape_events, table
from faretide.registry import query
from faretide.registry import sql as q
from faretide.registry.change_queries import _COLUMNS, CONSECUTIVE
from faretide.plans.runs import tag_runs
from faretide.schema import OBSERVATION
from faretide.session import scratch_path
from faretide.sources.observations import export_csv, read_table
from faretide.streaming import ordered, run_table, windows
from faretide.streaming.alerts import alert_stream, append_new_alerts, emit_once, pair_stream, repaired_alerts
from faretide.streaming.core import result_of
from faretide.streaming.ingest import ingest_files, ingest_stream

_W = f"WITH {q.EVENTS}, mark AS (SELECT max(observed_at) - INTERVAL 1 HOUR AS low FROM obs)"
_STATS = f"count(*) AS offers, {q.MEAN} AS mean_price, min(price) AS min_price, max(price) AS max_price"


@query("t01_ingest_stream", _W + " SELECT dataset, hotel_name, price, observed_at, obs_date::VARCHAR AS obs_date, seq FROM obs")
def t01(spark, sf_dir):
    root = scratch_path(spark, "ingest")
    ingest_stream(events_stream(spark, sf_dir).select(*OBSERVATION.fieldNames()), f"{root}/out", f"{root}/state")
    return read_table(spark, f"{root}/out").select("dataset", "hotel_name", "price", "observed_at", "obs_date", "seq")


@query("t01_ingest_files", _W + " SELECT hotel_name, price, observed_at, obs_date::VARCHAR AS obs_date FROM obs")
def t01b(spark, sf_dir):
    root = scratch_path(spark, "ingest")
    export_csv(events_obs(spark, sf_dir), f"{root}/in")
    for _ in range(2):  # the second start finds no new files
        ingest_files(spark, f"{root}/in", f"{root}/out", f"{root}/state", "events")
    read = read_table(spark, f"{root}/out")
    return read.select("hotel_name", "price", "observed_at", "obs_date")


@query("t01_older_files", _W + " SELECT hotel_name, price, CASE WHEN seq % 2 = 0 THEN dates END AS dates, observed_at FROM obs")
def t01c(spark, sf_dir):
    """Files with old and new headers in one folder; a line with a surplus field is left out."""
    root, obs = scratch_path(spark, "ingest"), events_obs(spark, sf_dir)
    export_csv(obs.filter(F.col("seq") % 2 == 0), f"{root}/in")
    older = obs.filter(F.col("seq") % 2 == 1).select("scraped_at", F.col("price").cast("string").alias("price"), "hotel_name")
    older.write.mode("append").option("header", True).option("quoteAll", True).csv(f"{root}/in")
    surplus = spark.range(1).select(F.lit('"scraped_at","price","hotel_name"\n"2025-01-01","1","x","more"').alias("value"))
    surplus.write.mode("append").text(f"{root}/in")
    ingest_files(spark, f"{root}/in", f"{root}/out", f"{root}/state", "events")
    return read_table(spark, f"{root}/out").select("hotel_name", "price", "dates", "observed_at")


@query("t02_alert_stream", CONSECUTIVE)
def t02(spark, sf_dir):
    return result_of(spark, alert_stream(events_stream(spark, sf_dir)), "alerts").select(*_COLUMNS)


@query("t02_repaired_alerts", CONSECUTIVE)
def t02b(spark, sf_dir):
    """Alerts of a stream that lacks a ninth of the rows, put right when these come late."""
    obs = shape_events(table(spark, sf_dir, "events"))
    late = F.col("seq") % 9 == 0
    early = result_of(spark, alert_stream(events_stream(spark, sf_dir).filter(~late)), "alerts")
    return repaired_alerts(early, obs, obs.filter(late)).select(*_COLUMNS)


def _shuffled(spark, sf_dir, root, files=6):
    """The events in files that mix all times, so that most rows of a file are late; two thirds now, the rest later."""
    obs = shape_events(table(spark, sf_dir, "events"))
    deal = F.pmod(F.xxhash64("seq"), F.lit(files)).cast("int")
    return obs, [obs.filter((deal % 3 == 0) == later).repartitionById(files, deal) for later in (False, True)], f"{root}/in"


@query("t02_healing_feed", CONSECUTIVE)
def t02c(spark, sf_dir):
    """Alerts from the signed pairs of a stream over shuffled files, in two starts; no observation is read again."""
    root = scratch_path(spark, "feed")
    obs, starts, source = _shuffled(spark, sf_dir, root)
    for rows in starts:
        rows.write.mode("append").parquet(source)
        stream = spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 2).parquet(source)
        ordered.feed_pairs(stream, f"{root}/feed", f"{root}/state", "7 days")
    return ordered.standing_alerts(ordered.read_feed(spark, f"{root}/feed")).select(*_COLUMNS)


@query("t03_emit_once", "SELECT user_id, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1")
def t03(spark, sf_dir):
    """One row per user and event type, however many events there are."""
    keyed = events_stream(spark, sf_dir).select(
        "observed_at", "hotel_name", F.concat_ws("_", "hotel_name", "departure_airport").alias("unique_key")
    )
    once = result_of(spark, emit_once(keyed, "40 days"), "once")
    user = F.substring_index("hotel_name", "_", -1).cast("bigint").alias("user_id")
    return once.groupBy(user).agg(F.count("unique_key").alias("kinds"))


@query("t03_append_new_alerts", "SELECT DISTINCT 'hotel_' || user_id || '_' || event_type AS unique_key FROM events")
def t03b(spark, sf_dir):
    root = scratch_path(spark, "once")
    for attempt in range(2):  # replayed from the start, nothing is added again
        keyed = events_stream(spark, sf_dir).select(
            "hotel_name", F.concat_ws("_", "hotel_name", "departure_airport").alias("unique_key")
        )
        append_new_alerts(keyed, f"{root}/out", f"{root}/state{attempt}")
    return spark.read.parquet(f"{root}/out").select("unique_key")


@query(
    "t04_daily_windows",
    _W + f""" SELECT date_trunc('day', observed_at)::TIMESTAMP AS window_start, date_trunc('day', observed_at)::TIMESTAMP + INTERVAL 1 DAY AS window_end, {_STATS}
      FROM obs GROUP BY 1, 2 HAVING date_trunc('day', observed_at)::TIMESTAMP + INTERVAL 1 DAY <= (SELECT low FROM mark)""",
)
def t04(spark, sf_dir):
    return result_of(spark, windows.stats_stream(events_stream(spark, sf_dir)), "daily").drop("dataset")


@query(
    "t05_sliding_windows",
    _W + f""", w AS (SELECT price, date_trunc('hour', observed_at)::TIMESTAMP - h * INTERVAL 1 HOUR AS window_start FROM obs, (SELECT unnest(range(24)) AS h))
      SELECT window_start, window_start + INTERVAL 24 HOUR AS window_end, {_STATS} FROM w GROUP BY 1
      HAVING window_start + INTERVAL 24 HOUR <= (SELECT low FROM mark)""",
)
def t05(spark, sf_dir):
    stream = windows.stats_stream(events_stream(spark, sf_dir), "24 hours", "1 hour")
    return result_of(spark, stream, "sliding").drop("dataset")


@query(
    "t05_sliding_changes",
    _W + """, w AS (SELECT hotel_name, price, observed_at, seq, date_trunc('hour', observed_at)::TIMESTAMP - h * INTERVAL 1 HOUR AS window_start FROM obs, (SELECT unnest(range(24)) AS h))
      SELECT hotel_name, window_start, window_start + INTERVAL 24 HOUR AS window_end, arg_min(price, (observed_at, seq)) AS first_price, arg_max(price, (observed_at, seq)) AS last_price,
        arg_max(price, (observed_at, seq)) - arg_min(price, (observed_at, seq)) AS price_change, count(*) AS offers FROM w GROUP BY 1, 2
      HAVING window_start + INTERVAL 24 HOUR <= (SELECT low FROM mark)""",
)
def t05b(spark, sf_dir):
    return result_of(spark, windows.change_window_stream(events_stream(spark, sf_dir)), "moves").drop("dataset")


@query(
    "t06_session_runs",
    _W + f""", {q.runs(5)} SELECT run_start AS window_start, max(observed_at) + INTERVAL 5 MINUTE AS window_end, {_STATS} FROM tagged GROUP BY run_id, run_start
      HAVING max(observed_at) + INTERVAL 5 MINUTE <= (SELECT low FROM mark)""",
)
def t06(spark, sf_dir):
    return result_of(spark, windows.session_stream(events_stream(spark, sf_dir)), "sessions").drop("dataset")


def _run_table(spark, sf_dir):
    """A run table fed with shuffled files in two starts."""
    root = scratch_path(spark, "runs")
    obs, starts, source = _shuffled(spark, sf_dir, root)
    for rows in starts:
        rows.write.mode("append").parquet(source)
        stream = spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 3).parquet(source)
        run_table.run_table_stream(stream, f"{root}/runs", f"{root}/state")
    return obs, f"{root}/runs"


@query("t06_run_table", f"WITH {q.EVENTS}, {q.runs(5)} SELECT dataset, run_id, run_start, max(observed_at) AS run_end FROM tagged GROUP BY 1, 2, 3")
def t06b(spark, sf_dir):
    return run_table.stored_runs(spark, _run_table(spark, sf_dir)[1])


@query("w02_stored_runs", f"WITH {q.EVENTS}, {q.runs(5)} SELECT seq, run_id, run_start FROM tagged")
def w02b(spark, sf_dir):
    """Rows tagged from the stored run table."""
    obs, path = _run_table(spark, sf_dir)
    return tag_runs(obs, cells=run_table.stored_run_cells(spark, path)).select("seq", "run_id", "run_start")


@query(
    "t07_missing_by_timeout",
    _W + """, l AS (SELECT hotel_name, arg_max(price, (observed_at, seq)) AS old_price, max(observed_at) AS changed_at FROM obs GROUP BY 1)
      SELECT * FROM l WHERE epoch_us(changed_at) // 1000 + 6 * 3600000 < epoch_us((SELECT low FROM mark)) // 1000""",
)
def t07(spark, sf_dir):
    stream = pair_stream(events_stream(spark, sf_dir), missing_after_hours=6)
    out = result_of(spark, stream, "missing")
    return out.filter(F.col("kind") == "missing").select("hotel_name", "old_price", "changed_at")


@query(
    "t08_repaired_days",
    f"WITH {q.EVENTS} SELECT obs_date::VARCHAR AS day, {q.MEAN} AS mean_price, min(price) AS min_price, max(price) AS max_price, count(*) AS offers FROM obs WHERE obs_date IN (SELECT obs_date FROM obs WHERE price > 350) GROUP BY 1",
)
def t08(spark, sf_dir):
    obs = shape_events(table(spark, sf_dir, "events"))
    return windows.repaired_days(obs, obs.filter(F.col("price") > 350)).drop("dataset")
