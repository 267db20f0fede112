"""Sources and sinks: what is written from whole tables reads back the same."""

from pyspark.sql import functions as F

from faretide import fixed_values as fv
from faretide.adapters import base_and_any, events_obs, table
from faretide.operators import changes
from faretide.registry import query
from faretide.registry import sql as q
from faretide.registry.airport_queries import CHEAPER, cheaper_with_texts
from faretide.registry.change_queries import _pairs_sql
from faretide.schema import CHEAPER_ALTERNATIVE
from faretide.session import scratch_path
from faretide.sources import alerts as alert_source
from faretide.sources import documents
from faretide.sources import observations as source
from faretide.sources import storage
from faretide.sources.series import price_series

_W = f"WITH {q.EVENTS} "
_FIELDS = ["hotel_name", "price", "dates", "duration", "rating", "departure_airport", "url", "image_url", "offer_url", "observed_at", "obs_date"]


def _quoted(spark, sf_dir):
    """Event observations whose names hold quotes and commas."""
    return events_obs(spark, sf_dir).withColumn(
        "hotel_name", F.concat(F.lit('Hotel "'), F.col("hotel_name"), F.lit('", spa'))
    )


_QUOTED = """'Hotel "' || hotel_name || '", spa'"""


@query(
    "s01_read_csv",
    _W + f"SELECT {_QUOTED} AS hotel_name, price, dates, duration, NULL::VARCHAR AS rating, departure_airport, url, nullif(image_url, '') AS image_url, nullif(offer_url, '') AS offer_url, observed_at, obs_date::VARCHAR AS obs_date FROM obs",
)
def s01(spark, sf_dir):
    path = scratch_path(spark, "csv")
    source.export_csv(_quoted(spark, sf_dir), path)
    return source.read_observations(spark, path, "events").select(*_FIELDS)


@query(
    "s02_sequence_numbers",
    "SELECT 1000 + row_number() OVER (ORDER BY CASE WHEN event_id < 20 THEN 0 ELSE 1 END, event_id) - 1 AS seq, value AS price FROM events",
)
def s02(spark, sf_dir):
    """Numbers follow path, block and line over files of unlike size, the smallest first, and go on after a table."""
    path = scratch_path(spark, "csv")
    obs = events_obs(spark, sf_dir)
    # Parts of the order are files of their own, named in their order, so no task writes or sorts all rows.
    in_order = lambda df: df.orderBy("seq")
    source.export_csv(in_order(obs.filter("seq < 20")), f"{path}/a")
    source.export_csv(in_order(obs.filter("seq >= 20")), f"{path}/b")
    first = source.read_observations(spark, f"{path}/a", "events", seq_start=1000)
    both = source.read_observations(spark, [f"{path}/b", f"{path}/a"], "events", seq_start=1000)
    # The second file's numbers are also those of a later read that goes on where a table ends.
    source.append_observations(first, f"{path}/table")
    later = source.read_observations(spark, f"{path}/b", "events", seq_start=source.next_seq(spark, f"{path}/table"))
    table = source.read_table(spark, f"{path}/table").select("seq", "price")
    return both.select("seq", "price").intersectAll(table.unionAll(later.select("seq", "price")))


@query(
    "s03_older_files",
    _W + """SELECT hotel_name, price, CASE WHEN seq % 2 = 0 THEN dates END AS dates, CASE WHEN seq % 2 = 0 THEN departure_airport END AS departure_airport, observed_at FROM obs""",
)
def s03(spark, sf_dir):
    obs = events_obs(spark, sf_dir)
    new, old = scratch_path(spark, "csv"), scratch_path(spark, "csv")
    source.export_csv(obs.filter(F.col("seq") % 2 == 0), new)
    older = obs.filter(F.col("seq") % 2 == 1).select("scraped_at", F.col("price").cast("string").alias("price"), "hotel_name")
    older.write.option("header", True).option("quoteAll", True).csv(old)
    read = source.read_observations(spark, [new, old], "events")
    return read.select("hotel_name", "price", "dates", "departure_airport", "observed_at")


@query(
    "s03_mixed_folder",
    _W + """SELECT hotel_name, price, CASE WHEN seq % 2 = 0 THEN dates END AS dates, CASE WHEN seq % 2 = 0 THEN departure_airport END AS departure_airport, observed_at FROM obs""",
)
def s03c(spark, sf_dir):
    """Files with old and new headers in one folder."""
    obs, path = events_obs(spark, sf_dir), scratch_path(spark, "csv")
    source.export_csv(obs.filter(F.col("seq") % 2 == 0), path)
    older = obs.filter(F.col("seq") % 2 == 1).select("scraped_at", F.col("price").cast("string").alias("price"), "hotel_name")
    older.write.mode("append").option("header", True).option("quoteAll", True).csv(path)
    read = source.read_observations(spark, path, "events")
    return read.select("hotel_name", "price", "dates", "departure_airport", "observed_at")


@query(
    "s03_trip_facts",
    _W + """SELECT seq, obs_date::VARCHAR AS trip_start, (observed_at + INTERVAL 7 DAY)::DATE::VARCHAR AS trip_end,
      CAST(regexp_extract(duration, '\\d+') AS INTEGER) AS nights_min, CAST(regexp_extract(duration, '\\d+') AS INTEGER) AS nights_max,
      CASE WHEN departure_airport <> 'error' THEN departure_airport END AS airport FROM obs""",
)
def s03b(spark, sf_dir):
    facts = source.with_trip_facts(events_obs(spark, sf_dir))
    return facts.select("seq", "trip_start", "trip_end", "nights_min", "nights_max", "airport")


@query("s04_missing_dataset", _W + "SELECT hotel_name, price FROM obs")
def s04(spark, sf_dir):
    nothing = source.read_observations(spark, scratch_path(spark, "absent"), "events")
    return nothing.unionByName(events_obs(spark, sf_dir)).select("hotel_name", "price")


@query("s05_append_observations", _W + "SELECT dataset, hotel_name, price, observed_at, obs_date::VARCHAR AS obs_date, seq FROM obs UNION ALL SELECT dataset, hotel_name, price, observed_at, obs_date::VARCHAR, seq FROM obs WHERE seq % 3 = 0")
def s05(spark, sf_dir):
    obs, path = events_obs(spark, sf_dir), scratch_path(spark, "table")
    source.append_observations(obs, path)
    source.append_observations(obs.filter(F.col("seq") % 3 == 0), path)
    return source.read_table(spark, path).select("dataset", "hotel_name", "price", "observed_at", "obs_date", "seq")


@query("s06_export_csv", _W + f"SELECT {_QUOTED} AS hotel_name, price::VARCHAR AS price, departure_airport, strftime(observed_at, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS scraped_at, url FROM obs")
def s06(spark, sf_dir):
    path = scratch_path(spark, "csv")
    source.export_csv(_quoted(spark, sf_dir), path)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.select("hotel_name", "price", "departure_airport", "scraped_at", "url")


def _alert_lines(found):
    return found.select(
        "hotel_name",
        "old_price",
        "new_price",
        "price_change",
        "price_change_pct",
        F.date_format(F.col("changed_at").cast("timestamp_ntz"), fv.ISO_FORMAT).alias("timestamp"),
        "alert_type",
        "unique_key",
    )


@query(
    "s07_read_alerts",
    _W + ", " + _pairs_sql("obs") + " SELECT hotel_name, old_price, new_price, alert_type, strftime(changed_at, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp FROM alert",
)
def s07(spark, sf_dir):
    """Half of the alerts as bare rows, half wrapped in one document per item and day."""
    rows = _alert_lines(changes.consecutive_changes(events_obs(spark, sf_dir)))
    path = scratch_path(spark, "alerts")
    rise = F.col("alert_type") == "price_increase"
    rows.filter(rise).write.json(path)
    day = F.substring("timestamp", 1, 10).alias("day")
    wrapped = rows.filter(~rise).groupBy("hotel_name", day).agg(F.collect_list(F.struct(*rows.columns)).alias("alerts"))
    wrapped.select("alerts").write.mode("append").json(path)
    read = alert_source.read_alerts(spark, path, multiline=False)
    return read.select("hotel_name", "old_price", "new_price", "alert_type", "timestamp")


@query(
    "s08_append_alerts",
    _W + ", " + _pairs_sql("obs") + " SELECT DISTINCT unique_key FROM alert",
)
def s08(spark, sf_dir):
    rows = _alert_lines(changes.consecutive_changes(events_obs(spark, sf_dir)))
    path = scratch_path(spark, "alerts")
    alert_source.append_alerts(rows.filter(F.col("alert_type") == "price_drop"), path)
    alert_source.append_alerts(rows, path)
    alert_source.append_alerts(rows, path)
    return alert_source.read_alert_table(spark, path).select("unique_key")


@query("s09_comparison_document", f"WITH {q.LINEITEM}" + CHEAPER + " SELECT * FROM cheaper")
def s09(spark, sf_dir):
    path = scratch_path(spark, "comparison")
    documents.write_document(cheaper_with_texts(*base_and_any(spark, sf_dir)), path)
    return documents.read_document(spark, path, CHEAPER_ALTERNATIVE)


@query(
    "s10_summary_document",
    _W + f""", top AS (SELECT hotel_name, price, dates, row_number() OVER (ORDER BY price, seq) AS p FROM obs QUALIFY p <= 5)
      SELECT count(*) AS total_offers, count(DISTINCT hotel_name) AS unique_hotels, strftime(min(observed_at), '%Y-%m-%dT%H:%M:%S.%f') AS start_at,
      strftime(max(observed_at), '%Y-%m-%dT%H:%M:%S.%f') AS end_at, {q.MEAN} AS mean, round(median(price), 4) AS median, min(price) AS min, max(price) AS max,
      round(stddev_samp(price), 4) AS std, (SELECT string_agg(hotel_name || '|' || price || '|' || dates, ';' ORDER BY p) FROM top) AS cheapest FROM obs""",
)
def s10(spark, sf_dir):
    summary = documents.summary_document(events_obs(spark, sf_dir))
    stats = F.col("price_stats")
    offers = F.transform("top_cheap_offers", lambda o: F.concat_ws("|", o["hotel_name"], o["price"].cast("string"), o["dates"]))
    return summary.select(
        "total_offers",
        "unique_hotels",
        F.col("date_range")["start"].alias("start_at"),
        F.col("date_range")["end"].alias("end_at"),
        stats["mean"].alias("mean"),
        F.round(stats["median"], 4).alias("median"),
        stats["min"].alias("min"),
        stats["max"].alias("max"),
        F.round(stats["std"], 4).alias("std"),
        F.array_join(offers, ";").alias("cheapest"),
    )


@query(
    "s12_price_series",
    _W + """SELECT replace(hotel_name, '_', '-') AS slug, hotel_name, string_agg(strftime(observed_at, '%Y-%m-%d %H:%M'), ',' ORDER BY observed_at, seq) AS x,
      string_agg(price::VARCHAR, ',' ORDER BY observed_at, seq) AS y FROM obs GROUP BY hotel_name""",
)
def s12(spark, sf_dir):
    series = price_series(events_obs(spark, sf_dir))
    y = F.transform("y", lambda p: p.cast("string"))
    return series.select("slug", "hotel_name", F.array_join("x", ",").alias("x"), F.array_join(y, ",").alias("y"))


@query(
    "s12_price_series_parts",
    """SELECT event_type AS slug, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS position,
      strftime(ts, '%Y-%m-%d %H:%M') AS x, value AS y FROM events""",
)
def s12b(spark, sf_dir):
    """Every point in its place, when all rows of one event type are one item's and come in parts."""
    hot = events_obs(spark, sf_dir).withColumn("hotel_name", F.col("departure_airport"))
    series = price_series(hot, max_points=1500)
    # Parts in order, and points in order within them, give back the whole series.
    points = series.select("slug", "part", F.posexplode(F.arrays_zip("x", "y")).alias("at", "p"))
    return points.select("slug", (F.col("part") * 1500 + F.col("at") + 1).cast("long").alias("position"), "p.x", "p.y")


@query(
    "s13_search_definitions",
    _W + """SELECT url, count(*) AS times, 8100::BIGINT AS max_price_threshold, CAST(regexp_extract(url, 'PriceTo\\]=(\\d+)', 1) AS DOUBLE) AS price_limit,
      regexp_extract(url, 'from\\]=([^&]*)', 1) AS departures FROM obs GROUP BY url""",
)
def s13(spark, sf_dir):
    path = scratch_path(spark, "searches")
    events_obs(spark, sf_dir).select("url", F.lit("x").alias("data_dir")).write.json(path)
    read = documents.read_search_definitions(spark, path, {"max_price_threshold": 8100}, multiline=False)
    return read.groupBy(
        "url", "max_price_threshold", "price_limit", F.col("filters")["filter[from]"].alias("departures")
    ).agg(F.count(F.lit(1)).alias("times"))


@query(
    "s14_defaults_overlay",
    """SELECT event_id, CAST(10 + event_id % 60 AS VARCHAR) AS retention, CASE WHEN event_id % 2 = 0 THEN '100' ELSE '5' END AS threshold, '09:00' AS daily, 9 + event_id % 2 AS settings FROM events""",
)
def s14(spark, sf_dir):
    given = F.map_from_arrays(
        F.array_compact(F.array(F.lit("data_retention_days"), F.when(F.col("event_id") % 2 == 1, F.lit("min_price_change_threshold")), F.when(F.col("event_id") % 2 == 1, F.lit("zone")))),
        F.array_compact(F.array((F.col("event_id") % 60 + 10).cast("string"), F.when(F.col("event_id") % 2 == 1, F.lit("5")), F.when(F.col("event_id") % 2 == 1, F.lit("UTC")))),
    )
    merged = table(spark, sf_dir, "events").select("event_id", documents.overlay(given).alias("s"))
    return merged.select(
        "event_id",
        F.col("s")["data_retention_days"].alias("retention"),
        F.col("s")["min_price_change_threshold"].alias("threshold"),
        F.col("s")["intervals.daily"].alias("daily"),
        F.size("s").cast("bigint").alias("settings"),
    )


@query(
    "s15_retention",
    _W + "SELECT seq FROM obs WHERE obs_date >= (SELECT max(obs_date) FROM obs) - 7",
)
def s15(spark, sf_dir):
    path = scratch_path(spark, "table")
    source.append_observations(events_obs(spark, sf_dir), path)
    return source.retain(source.read_table(spark, path), 7).select("seq")


@query(
    "s15_freed_storage",
    _W + "SELECT seq, hotel_name, price FROM obs WHERE obs_date >= (SELECT max(obs_date) FROM obs) - 7",
)
def s15_freed(spark, sf_dir):
    """Three appends, their small files of closed days rewritten, and all but eight days deleted."""
    obs, path = events_obs(spark, sf_dir), scratch_path(spark, "table")
    for k in range(3):
        source.append_observations(obs.filter(F.col("seq") % 3 == k), path)
    storage.compact_days(spark, path)
    storage.drop_old_days(spark, path, 7)
    return source.read_table(spark, path).select("seq", "hotel_name", "price")
