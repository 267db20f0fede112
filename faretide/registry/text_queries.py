"""Time, text, URL and markup projections over whole tables."""

from pyspark.sql import functions as F

from faretide import fixed_values as fv
from faretide.adapters import SEARCH, events_obs, orders_obs, table
from faretide.functions import markup, money, text, timestamps, urls
from faretide.operators.filters import with_valid_time
from faretide.operators.offers import parse_offers
from faretide.registry import query
from faretide.registry import sql as q

_BLANK = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
_ISO_SQL = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')"


def _mixed_times(spark, sf_dir):
    """Event times as zoned, naive and unreadable text."""
    iso = F.date_format("ts", _ISO)
    kind = F.col("event_id") % 5
    raw = (
        F.when(kind == 0, F.concat(iso, F.lit("+00:00")))
        .when(kind == 1, iso)
        .when(kind == 2, F.concat(iso, F.lit("Z")))
        .when(kind == 3, F.concat(iso, F.lit("+02:00")))
        .otherwise(F.lit("brak"))
    )
    return table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))


@query(
    "p01_normalize_ts",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN ts WHEN 1 THEN ts - INTERVAL 1 HOUR
              WHEN 2 THEN ts WHEN 3 THEN ts - INTERVAL 2 HOUR END AS observed_at FROM events""",
)
def p01(spark, sf_dir):
    return _mixed_times(spark, sf_dir).select(
        "event_id", timestamps.normalize_ts(F.col("raw"), "Europe/Warsaw").alias("observed_at")
    )


@query(
    "p02_utc_ts",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN ts WHEN 1 THEN ts
              WHEN 2 THEN ts WHEN 3 THEN ts - INTERVAL 2 HOUR END AS observed_at FROM events""",
)
def p02(spark, sf_dir):
    return _mixed_times(spark, sf_dir).select(
        "event_id", timestamps.utc_ts(F.col("raw")).alias("observed_at")
    )


@query("p03_valid_time_only", "SELECT event_id FROM events WHERE event_id % 5 <> 4")
def p03(spark, sf_dir):
    return with_valid_time(p02(spark, sf_dir)).select("event_id")


@query(
    "p04_calendar_day",
    """SELECT event_id, CAST(CAST(ts + INTERVAL 1 HOUR AS DATE) AS VARCHAR) AS day FROM events""",
)
def p04(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", timestamps.obs_day(F.col("ts").cast("timestamp"), "Europe/Warsaw").alias("day")
    )


@query(
    "p05_display_times",
    f"""SELECT event_id, strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M') AS minute,
               strftime(ts + INTERVAL 1 HOUR, '%d.%m.%Y %H:%M') AS header, {_ISO_SQL} AS iso FROM events""",
)
def p05(spark, sf_dir):
    at = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        "event_id",
        timestamps.minute_text(at, "Europe/Warsaw").alias("minute"),
        timestamps.header_text(at, "Europe/Warsaw").alias("header"),
        timestamps.iso_text(at).alias("iso"),
    )


@query(
    "p06_clean_text",
    f"""WITH c AS (SELECT doc_id, trim(regexp_replace(text, '{_BLANK}', ' ', 'g')) AS t FROM documents)
        SELECT doc_id, md5(t) AS digest, length(t) AS chars FROM c""",
)
def p06(spark, sf_dir):
    t = text.clean_text(F.col("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    return docs.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("bigint").alias("chars"))


@query(
    "p07_normalize_text",
    f"""SELECT doc_id, md5(lower(trim(regexp_replace(text, '{_BLANK}', ' ', 'g')))) AS digest FROM documents""",
)
def p07(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(text.normalize_text(F.col("text"))).alias("digest")
    )


_DATE_TEXT = """CASE o_orderkey % 4
    WHEN 0 THEN strftime(o_orderdate, '%d.%m.%Y') || ' - ' || strftime(o_orderdate + INTERVAL 7 DAY, '%d.%m.%Y')
    WHEN 1 THEN strftime(o_orderdate, '%-d-%-m-%Y') || ' do ' || strftime(o_orderdate + INTERVAL 9 DAY, '%-d-%-m-%Y')
    WHEN 2 THEN '  od ' || strftime(o_orderdate, '%d.%m.%Y') || ' '
    ELSE strftime(o_orderdate, '%d/%m/%Y') END"""


def _date_texts(spark, sf_dir):
    day, later = F.col("o_orderdate"), F.date_add(F.to_date("o_orderdate"), F.when(F.col("o_orderkey") % 4 == 0, 7).otherwise(9))
    kind = F.col("o_orderkey") % 4
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(kind == 0, F.concat_ws(" - ", F.date_format(day, "dd.MM.yyyy"), F.date_format(later, "dd.MM.yyyy")))
        .when(kind == 1, F.concat_ws(" do ", F.date_format(day, "d-M-yyyy"), F.date_format(later, "d-M-yyyy")))
        .when(kind == 2, F.concat(F.lit("  od "), F.date_format(day, "dd.MM.yyyy"), F.lit(" ")))
        .otherwise(F.date_format(day, "dd/MM/yyyy"))
        .alias("dates"),
    )


@query(
    "p08_normalize_dates",
    f"""WITH t AS (SELECT o_orderkey, {_DATE_TEXT} AS d FROM orders),
        m AS (SELECT *, regexp_extract_all(d, '(\\d{{1,2}})[.-](\\d{{1,2}})[.-](\\d{{4}})', 1) AS dd,
                     regexp_extract_all(d, '(\\d{{1,2}})[.-](\\d{{1,2}})[.-](\\d{{4}})', 2) AS mm,
                     regexp_extract_all(d, '(\\d{{1,2}})[.-](\\d{{1,2}})[.-](\\d{{4}})', 3) AS yy FROM t)
        SELECT o_orderkey, CASE WHEN len(dd) >= 2 THEN
          yy[1] || '-' || lpad(mm[1], 2, '0') || '-' || lpad(dd[1], 2, '0') || '|' ||
          yy[2] || '-' || lpad(mm[2], 2, '0') || '-' || lpad(dd[2], 2, '0') ELSE trim(d) END AS dates_norm FROM m""",
)
def p08(spark, sf_dir):
    return _date_texts(spark, sf_dir).select(
        "o_orderkey", text.normalize_dates(F.col("dates")).alias("dates_norm")
    )


@query(
    "p08_trip_dates",
    f"""SELECT seq, CAST(observed_at AS DATE)::VARCHAR AS trip_start, CAST(observed_at + INTERVAL 7 DAY AS DATE)::VARCHAR AS trip_end
        FROM ({'WITH ' + q.ORDERS + ' SELECT * FROM orders_obs'})""",
)
def p08b(spark, sf_dir):
    days = text.trip_dates(F.col("dates"))
    return orders_obs(spark, sf_dir).select("seq", days["trip_start"].alias("trip_start"), days["trip_end"].alias("trip_end"))


@query(
    "p09_airport_from_url",
    f"""WITH {q.EVENTS} SELECT seq, CASE WHEN departure_airport = 'error' THEN '{fv.ALL_AIRPORTS}'
        ELSE departure_airport END AS airport FROM obs""",
)
def p09(spark, sf_dir):
    return events_obs(spark, sf_dir).select("seq", urls.airport_from_url(F.col("url")).alias("airport"))


def _encoded(spark, sf_dir):
    """Event URLs with the airport list percent-encoded."""
    return events_obs(spark, sf_dir).withColumn(
        "url", F.replace("url", F.lit(",Warszawa"), F.lit("%2CWarszawa"))
    )


@query(
    "p10_departure_from_url",
    f"""WITH {q.EVENTS} SELECT seq, CASE WHEN departure_airport <> 'error' THEN departure_airport END AS airport FROM obs""",
)
def p10(spark, sf_dir):
    return _encoded(spark, sf_dir).select("seq", urls.departure_from_url(F.col("url")).alias("airport"))


@query(
    "p10_encoded_keys",
    f"""WITH {q.EVENTS} SELECT seq, CASE WHEN departure_airport <> 'error' THEN departure_airport END AS airport,
        CAST(observed_at AS DATE)::VARCHAR AS window_from FROM obs""",
)
def p10b(spark, sf_dir):
    """Addresses whose keys are percent-encoded, in either case of letters."""
    lower = F.col("seq") % 2 == 0
    encoded = F.when(lower, F.replace(F.replace("url", F.lit("["), F.lit("%5b")), F.lit("]"), F.lit("%5d"))).otherwise(
        F.replace(F.replace("url", F.lit("["), F.lit("%5B")), F.lit("]"), F.lit("%5D"))
    )
    obs = events_obs(spark, sf_dir).withColumn("url", encoded)
    return obs.select(
        "seq",
        urls.departure_from_url(F.col("url")).alias("airport"),
        urls.trip_window(F.col("url"))["start"].alias("window_from"),
    )


_CODES = list(fv.AIRPORT_NAMES)


def _airport_codes(spark, sf_dir):
    """Events with one of the known airport codes, or an unknown one."""
    codes = F.array(*[F.lit(c) for c in [*_CODES, "Praga"]])
    at = (F.col("event_id") % (len(_CODES) + 1)).cast("int")
    return table(spark, sf_dir, "events").select("event_id", F.get(codes, at).alias("code"))


_CODE_LIST = "[" + ", ".join(f"'{c}'" for c in [*_CODES, "Praga"]) + "]"
_NAME_LIST = "[" + ", ".join(f"'{c}'" for c in [*fv.AIRPORT_NAMES.values(), "Praga"]) + "]"


@query(
    "p11_airport_name",
    f"SELECT event_id, ({_NAME_LIST})[event_id % {len(_CODES) + 1} + 1] AS airport FROM events",
)
def p11(spark, sf_dir):
    return _airport_codes(spark, sf_dir).select("event_id", urls.airport_name(F.col("code")).alias("airport"))


@query(
    "p12_airport_or_base",
    f"""WITH c AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN ''
                   ELSE ({_CODE_LIST})[event_id % {len(_CODES) + 1} + 1] END AS code FROM events)
        SELECT event_id, CASE WHEN code IS NULL OR code IN ('', 'Warszawa') THEN 'Варшава'
               WHEN code = 'Warszawa-Radom' THEN 'Варшава-Радом' ELSE code END AS airport FROM c""",
)
def p12(spark, sf_dir):
    kind = F.col("event_id") % 6
    code = F.when(kind == 0, F.lit(None)).when(kind == 1, F.lit("")).otherwise(F.col("code"))
    return _airport_codes(spark, sf_dir).select("event_id", urls.airport_or_base(code).alias("airport"))


@query(
    "p13_url_filters",
    f"""WITH {q.EVENTS} SELECT seq, 6 AS parameters,
          regexp_extract(url, 'filter\\[whenFrom\\]=([^&]*)', 1) AS when_from,
          regexp_extract(url, 'filter\\[from\\]=([^&]*)', 1) AS departures,
          regexp_extract(url, 'order_by=([^&]*)', 1) AS order_by FROM obs""",
)
def p13(spark, sf_dir):
    found = _encoded(spark, sf_dir).select("seq", urls.url_filters(F.col("url")).alias("f"))
    return found.select(
        "seq",
        F.size("f").alias("parameters"),
        F.col("f")["filter[whenFrom]"].alias("when_from"),
        F.col("f")["filter[from]"].alias("departures"),
        F.col("f")["order_by"].alias("order_by"),
    )


@query(
    "p13_page_parameters",
    """SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page_no,
              nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') AS ref,
              nullif(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), '') AS source FROM pages""",
)
def p13b(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select("page_id", urls.url_filters(F.col("url")).alias("f"))
    return found.select(
        "page_id",
        F.col("f")["page"].alias("page_no"),
        F.col("f")["ref"].alias("ref"),
        F.col("f")["utm_source"].alias("source"),
    )


@query(
    "p14_price_limit",
    "SELECT event_id AS seq, CAST(user_id % 50 * 100 + 5000 AS DOUBLE) AS price_limit FROM events",
)
def p14(spark, sf_dir):
    return events_obs(spark, sf_dir).select("seq", urls.price_limit(F.col("url")).alias("price_limit"))


@query(
    "p15_trip_window",
    """SELECT event_id AS seq, CAST(ts AS DATE)::VARCHAR AS window_from, CAST(ts + INTERVAL 14 DAY AS DATE)::VARCHAR AS window_to FROM events""",
)
def p15(spark, sf_dir):
    window = urls.trip_window(F.col("url"))
    return events_obs(spark, sf_dir).select(
        "seq", window["start"].alias("window_from"), window["end"].alias("window_to")
    )


@query(
    "p16_duration_range",
    f"""SELECT event_id AS seq, CASE WHEN user_id % 9 = 0 THEN '7' ELSE '7-' || (user_id % 9 + 7) END
        || ' {fv.DURATION_RANGE_UNIT}' AS duration FROM events""",
)
def p16(spark, sf_dir):
    return events_obs(spark, sf_dir).select("seq", urls.duration_range(F.col("url")).alias("duration"))


@query(
    "p17_destination_slug",
    """SELECT event_id AS seq, 'dest' || (user_id % 3) AS from_search,
              CASE WHEN event_type = 'purchase' THEN 'dest' || (user_id % 3) ELSE '' END AS from_offer FROM events""",
)
def p17(spark, sf_dir):
    return events_obs(spark, sf_dir).select(
        "seq",
        urls.destination_slug(F.col("url")).alias("from_search"),
        urls.destination_slug(F.col("offer_url")).alias("from_offer"),
    )


@query(
    "p18_absolute_url",
    f"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]*)"', 1)) AS href FROM pages)
        SELECT page_id, CASE WHEN trim(href) = '' THEN '' WHEN trim(href) LIKE 'http%' OR trim(href) LIKE '#%' THEN trim(href)
               WHEN trim(href) LIKE '/%' THEN '{SEARCH}' || trim(href) ELSE '{SEARCH}/' || trim(href) END AS link,
               count(*) AS times FROM l GROUP BY ALL""",
)
def p18(spark, sf_dir):
    hrefs = F.explode(F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1)))
    links = table(spark, sf_dir, "pages").select("page_id", hrefs.alias("href"))
    return links.groupBy("page_id", urls.absolute_url(F.col("href"), SEARCH).alias("link")).agg(
        F.count(F.lit(1)).alias("times")
    )


_PRICE_TEXT = """CASE o_orderkey % 5
    WHEN 0 THEN v || ' PLN za wszystkich'
    WHEN 1 THEN 'od ' || (v // 1000) || ' ' || lpad(CAST(v % 1000 AS VARCHAR), 3, '0') || ',50 zł'
    WHEN 2 THEN (v // 1000) || '.' || lpad(CAST(v % 1000 AS VARCHAR), 3, '0') || ',25 PLN'
    WHEN 3 THEN (v // 1000) || chr(160) || lpad(CAST(v % 1000 AS VARCHAR), 3, '0') || ' PLN za osobę'
    ELSE 'cena na zapytanie' END"""
_PRICES = f"prices AS (SELECT o_orderkey, o_orderdate, {_PRICE_TEXT} AS t FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders))"


def _price_texts(spark, sf_dir):
    v = F.floor("o_totalprice").cast("bigint")
    kind = F.col("o_orderkey") % 5
    high = F.floor(v / 1000).cast("string")
    low = F.lpad((v % 1000).cast("string"), 3, "0")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_orderdate",
        F.when(kind == 0, F.concat(v.cast("string"), F.lit(" PLN za wszystkich")))
        .when(kind == 1, F.concat(F.lit("od "), high, F.lit(" "), low, F.lit(",50 zł")))
        .when(kind == 2, F.concat(high, F.lit("."), low, F.lit(",25 PLN")))
        .when(kind == 3, F.concat(high, F.lit("\u00a0"), low, F.lit(" PLN za osobę")))
        .otherwise(F.lit("cena na zapytanie"))
        .alias("t"),
    )


_PARSED = r"""coalesce(TRY_CAST(regexp_replace(regexp_extract(replace(replace({t}, '.', ''), ',', '.'),
    '([0-9][0-9\s\x{{A0}}]*(?:\.[0-9]+)?)', 1), '[\s\x{{A0}}]+', '', 'g') AS DOUBLE), 0.0)"""


@query("p19_parse_price", f"WITH {_PRICES} SELECT o_orderkey, {_PARSED.format(t='t')} AS price FROM prices")
def p19(spark, sf_dir):
    return _price_texts(spark, sf_dir).select("o_orderkey", text.parse_price(F.col("t")).alias("price"))


@query(
    "p20_whole_party_price",
    f"""WITH {_PRICES} SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN 'razem 99 PLN' WHEN o_orderkey % 5 = 0 THEN t
        WHEN o_orderkey % 2 = 0 THEN 'Za wszystkie osoby 12 000 PLN' ELSE t END AS chosen FROM prices""",
)
def p20(spark, sf_dir):
    party = F.when(
        (F.col("o_orderkey") % 2 == 0) & ~(F.col("o_orderkey") % 5).isin(0, 4),
        F.lit("Za wszystkie osoby 12 000 PLN"),
    ).otherwise(F.lit("razem 99 PLN"))
    return _price_texts(spark, sf_dir).select(
        "o_orderkey",
        text.preferred_price_text(F.array(F.col("t"), party)).alias("chosen"),
    )


@query(
    "p21_is_date_text",
    r"""SELECT doc_id, length(trim(text)) >= 5
        AND NOT regexp_matches(lower(text), 'tripadvisor|ocena|opinii|rating|stars')
        AND (regexp_matches(text, '\d{1,2}\.\d{1,2}\.\d{4}') OR regexp_matches(text, '\d{1,2}\.\d{1,2}')
          OR regexp_matches(text, '\d{1,2}/\d{1,2}/\d{4}') OR regexp_matches(text, '\d{1,2}/\d{1,2}')
          OR regexp_matches(text, '\d{1,2}-\d{1,2}-\d{4}') OR regexp_matches(text, '\d{1,2}-\d{1,2}')) AS is_date
        FROM documents""",
)
def p21(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.is_date_text(F.col("text")).alias("is_date"))


@query(
    "p22_is_duration_text",
    r"""SELECT doc_id, length(trim(text)) >= 2 AND (regexp_matches(text, '(?i)\d+\s*(dni|noclegów|days|nights|noclegi)')
        OR regexp_matches(text, '(?i)\d+\s*d') OR regexp_matches(text, '(?i)\d+\s*n')) AS is_duration FROM documents""",
)
def p22(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.is_duration_text(F.col("text")).alias("is_duration")
    )


_CARD = f"""cards AS (SELECT o_orderkey, CASE o_orderkey % 3
    WHEN 0 THEN 'Wylot ' || d || ', pobyt ' || (o_orderkey % 15 + 1) || ' noclegów, HB'
    WHEN 1 THEN d || ' ' || (o_orderkey % 15 + 1) || 'd all inclusive'
    ELSE 'termin ' || strftime(o_orderdate, '%d.%m') || ' - ' || strftime(o_orderdate + INTERVAL 5 DAY, '%d.%m') || ' bez wyżywienia' END AS t
    FROM (SELECT *, {_DATE_TEXT} AS d FROM orders))"""
_RANGES = [
    r"\d{1,2}\.\d{1,2}\.\d{4}\s*-\s*\d{1,2}\.\d{1,2}\.\d{4}",
    r"\d{1,2}\.\d{1,2}\s*-\s*\d{1,2}\.\d{1,2}",
    r"\d{1,2}/\d{1,2}/\d{4}\s*-\s*\d{1,2}/\d{1,2}/\d{4}",
    r"\d{1,2}-\d{1,2}-\d{4}\s*-\s*\d{1,2}-\d{1,2}-\d{4}",
]


def _dates_sql(t):
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({t}, '{p}'), '')" for p in _RANGES) + ", '')"


def _duration_sql(t):
    words = r"(?i)(\d+)\s*(dni|noclegów|days|nights|noclegi)"
    return (
        f"coalesce(CASE WHEN regexp_matches({t}, '{words}') THEN regexp_extract({t}, '{words}', 1) || ' ' || regexp_extract({t}, '{words}', 2) END,"
        rf" nullif(regexp_extract({t}, '(?i)(\d+)\s*d', 1), '') || ' dni', nullif(regexp_extract({t}, '(?i)(\d+)\s*n', 1), '') || ' dni', '')"
    )


def _cards(spark, sf_dir):
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    nights = (key % 15 + 1).cast("string")
    short = F.date_format(F.date_add(F.to_date(day), 5), "dd.MM")
    dated = table(spark, sf_dir, "orders").join(_date_texts(spark, sf_dir), "o_orderkey")
    return dated.select(
        "o_orderkey",
        F.when(key % 3 == 0, F.concat(F.lit("Wylot "), "dates", F.lit(", pobyt "), nights, F.lit(" noclegów, HB")))
        .when(key % 3 == 1, F.concat("dates", F.lit(" "), nights, F.lit("d all inclusive")))
        .otherwise(F.concat(F.lit("termin "), F.date_format(day, "dd.MM"), F.lit(" - "), short, F.lit(" bez wyżywienia")))
        .alias("t"),
    )


@query("p23_dates_from_text", f"WITH {_CARD} SELECT o_orderkey, {_dates_sql('t')} AS dates FROM cards")
def p23(spark, sf_dir):
    return _cards(spark, sf_dir).select("o_orderkey", text.dates_from_text(F.col("t")).alias("dates"))


@query(
    "p24_duration_from_text",
    f"WITH {_CARD} SELECT o_orderkey, {_duration_sql('t')} AS duration FROM cards",
)
def p24(spark, sf_dir):
    return _cards(spark, sf_dir).select("o_orderkey", text.duration_from_text(F.col("t")).alias("duration"))


_IMAGE_SQL = """CASE page_id % 4
    WHEN 0 THEN '<div><img alt="a" data-src="http://img.example.com/' || page_id || '.jpg"></div>'
    WHEN 1 THEN '<div><img src="/local.png"></div><p style="background: url(''http://img.example.com/bg' || page_id || ''')">'
    WHEN 2 THEN '<div><img src=''http://img.example.com/s' || page_id || '.png'' data-src="http://img.example.com/x"></div>'
    ELSE '<div>brak</div>' END"""


def _illustrated(spark, sf_dir):
    page, kind = F.col("page_id").cast("string"), F.col("page_id") % 4
    image = (
        F.when(kind == 0, F.concat(F.lit('<div><img alt="a" data-src="http://img.example.com/'), page, F.lit('.jpg"></div>')))
        .when(kind == 1, F.concat(F.lit("<div><img src=\"/local.png\"></div><p style=\"background: url('http://img.example.com/bg"), page, F.lit("')\">")))
        .when(kind == 2, F.concat(F.lit("<div><img src='http://img.example.com/s"), page, F.lit(".png' data-src=\"http://img.example.com/x\"></div>")))
        .otherwise(F.lit("<div>brak</div>"))
    )
    return table(spark, sf_dir, "pages").withColumn("html", F.concat(image, F.col("html")))


@query(
    "p25_image_from_markup",
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'http://img.example.com/' || page_id || '.jpg'
              WHEN 1 THEN 'http://img.example.com/bg' || page_id
              WHEN 2 THEN 'http://img.example.com/s' || page_id || '.png' ELSE '' END AS image_url FROM pages""",
)
def p25(spark, sf_dir):
    return _illustrated(spark, sf_dir).select("page_id", markup.image_from_markup(F.col("html")).alias("image_url"))


def _linked(spark, sf_dir):
    """Pages that also carry one of the known offer links, after their own links."""
    page, kind = F.col("page_id").cast("string"), F.col("page_id") % 5
    link = (
        F.when(kind == 0, F.concat(F.lit('<a class="btn image-link" href="/img/'), page, F.lit('">x</a>')))
        .when(kind == 1, F.concat(F.lit('<a href="/wycieczka/w'), page, F.lit('">x</a><a class="offer-con" href="/con/'), page, F.lit('">y</a>')))
        .when(kind == 2, F.concat(F.lit('<a href="https://o.example.com/wycieczka/w'), page, F.lit('">x</a>')))
        .when(kind == 3, F.concat(F.lit('<a href="Special-Offer/'), page, F.lit('">x</a>')))
        .otherwise(F.lit(""))
    )
    return table(spark, sf_dir, "pages").withColumn("html", F.concat(F.col("html"), link))


@query(
    "p26_offer_link_from_markup",
    f"""SELECT page_id, CASE page_id % 5 WHEN 0 THEN '{SEARCH}/img/' || page_id WHEN 1 THEN '{SEARCH}/con/' || page_id
               WHEN 2 THEN 'https://o.example.com/wycieczka/w' || page_id
               ELSE coalesce('{SEARCH}' || (list_filter(regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]*)"', 1), lambda x: lower(x) LIKE '%offer%'))[1],
                    CASE WHEN page_id % 5 = 3 THEN '{SEARCH}/Special-Offer/' || page_id ELSE '' END) END AS offer_url FROM pages""",
)
def p26(spark, sf_dir):
    return _linked(spark, sf_dir).select(
        "page_id", markup.offer_link_from_markup(F.col("html"), SEARCH).alias("offer_url")
    )


def _strip_sql(t):
    out = f"regexp_replace({t}, '(?s)<[^>]*>', ' ', 'g')"
    for entity, char in [("&nbsp;", " "), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]:
        out = f"replace({out}, '{entity}', '{char}')"
    return f"trim(regexp_replace({out}, '{_BLANK}', ' ', 'g'))"


_VISIBLE = _strip_sql(
    r"regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g')"
)


@query(
    "p27_parse_offers",
    f"""WITH t AS (SELECT *, {_VISIBLE} AS txt, {_strip_sql("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1\\s*>', 1)")} AS h FROM pages)
        SELECT page_id, left(coalesce(nullif(h, ''), array_to_string(string_split(txt, ' ')[1:5], ' ')), 100) AS hotel_name,
               0.0::DOUBLE AS price,
               left(trim(regexp_replace(coalesce(nullif({_dates_sql('txt')}, ''), '{fv.DEFAULT_DATES}'), '{_BLANK}', ' ', 'g')), 50) AS dates,
               left(coalesce(nullif({_duration_sql('txt')}, ''), '{fv.DEFAULT_DURATION}'), 30) AS duration,
               '{fv.ALL_AIRPORTS}' AS departure_airport, md5(txt) AS text_digest
        FROM t WHERE length(txt) >= 10""",
)
def p27(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("txt", markup.visible_text(F.col("html")))
    offers = parse_offers(pages, text_col="txt", base_url=SEARCH, keep=("page_id", "txt"))
    return offers.select(
        "page_id", "hotel_name", "price", "dates", "duration", "departure_airport", F.md5("txt").alias("text_digest")
    )


@query(
    "p27_parse_offer_prices",
    f"""WITH {_PRICES} SELECT o_orderkey, 'Hotel ' || o_orderkey || ' & Spa' AS hotel_name,
        CASE WHEN o_orderkey % 5 = 0 THEN {_PARSED.format(t='t')} WHEN o_orderkey % 2 = 0 THEN 5000.0
             ELSE {_PARSED.format(t='t')} END AS price FROM prices""",
)
def p27b(spark, sf_dir):
    second = F.when(F.col("o_orderkey") % 2 == 0, F.lit("5 000 PLN za wszystkich")).otherwise(F.lit(""))
    cards = _price_texts(spark, sf_dir).select(
        "o_orderkey",
        F.concat(
            F.lit('<div class="card"><h3> Hotel <b>'), F.col("o_orderkey").cast("string"),
            F.lit('</b> &amp; Spa</h3><span class="price-view">'), F.col("t"),
            F.lit('</span><span class="old price">'), second, F.lit("</span></div>"),
        ).alias("html"),
        F.lit("").alias("url"),
    )
    offers = parse_offers(cards, base_url=SEARCH, keep=("o_orderkey",))
    return offers.select("o_orderkey", "hotel_name", "price")


@query(
    "p27_card_tiers",
    f"""SELECT o_orderkey, 'Hotel ' || o_orderkey AS hotel_name,
        CASE WHEN o_orderkey % 4 = 3 THEN 1000.0 + o_orderkey % 900 ELSE 500.0 + o_orderkey % 400 END::DOUBLE AS price,
        CASE WHEN o_orderkey % 3 = 2 THEN '{fv.DEFAULT_DATES}' ELSE strftime(o_orderdate, '%d.%m.%Y') END AS dates,
        CASE WHEN o_orderkey % 3 = 2 THEN '5 dni' ELSE (o_orderkey % 15 + 1) || ' nights' END AS duration FROM orders""",
)
def p27c(spark, sf_dir):
    """Cards with an old price before the price, a subtitle before the name, and elements for dates and nights."""
    key = F.col("o_orderkey")
    number = lambda c: c.cast("string")
    party = F.when(
        key % 4 == 3,
        F.concat(F.lit('<i class="old-price">'), number(1000 + key % 900), F.lit(" PLN za wszystkich</i>")),
    ).otherwise(F.lit(""))
    day = F.date_format("o_orderdate", "dd.MM.yyyy")
    facts = F.when(
        key % 3 == 2, F.lit('<p class="date">ocena 4.5</p><p class="info">pobyt 5 dni</p>')
    ).otherwise(
        F.concat(
            F.lit('<p class="update">ocena 4.5/5</p><p data-date="x">'), day,
            F.lit('</p><b class="stay-duration">'), number(key % 15 + 1), F.lit(" nights</b>"),
        )
    )
    html = F.concat(
        F.lit('<div class="card"><span class="price-old">999 PLN</span><u class="subtitle">5 gwiazdek</u><u class="name">Hotel '),
        number(key), F.lit('</u><img class="price" src="x"><s class="cost">'), number(500 + key % 400),
        F.lit(" PLN</s>"), party, facts, F.lit("</div>"),
    )
    # The image carries the class "price" and has no text, so the next class counts.
    cards = table(spark, sf_dir, "orders").select("o_orderkey", html.alias("html"), F.lit("").alias("url"))
    offers = parse_offers(cards, base_url=SEARCH, keep=("o_orderkey",))
    return offers.select("o_orderkey", "hotel_name", "price", "dates", "duration")


@query(
    "p28_default_fill",
    f"""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{fv.DEFAULT_DATES}' ELSE event_type END AS dates FROM events""",
)
def p28(spark, sf_dir):
    raw = F.when(F.col("event_id") % 3 == 0, F.when(F.col("event_id") % 2 == 0, F.lit(" "))).otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", text.fill_default(raw, fv.DEFAULT_DATES).alias("dates"))


_HEADING = "(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"
# Every heading of every page, with its place on the page.
_HEADINGS = f"""(SELECT page_id, unnest(l) AS h, unnest(range(len(l)))::INT AS place
        FROM (SELECT page_id, regexp_extract_all(html, '{_HEADING}', 1) AS l FROM pages))"""


def _headings(spark, sf_dir):
    found = F.regexp_extract_all("html", F.lit(_HEADING), 1)
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("place", "h"))


@query(
    "p29_slugify",
    f"SELECT page_id, place, coalesce(nullif(trim(regexp_replace(lower(h), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'hotel') AS slug FROM {_HEADINGS}",
)
def p29(spark, sf_dir):
    return _headings(spark, sf_dir).select("page_id", "place", text.slugify(F.col("h")).alias("slug"))


@query(
    "p30_safe_name",
    rf"""SELECT page_id, place, left(rtrim(regexp_replace(h, '[^\p{{L}}\p{{N}} _-]', '', 'g')), 50) || '_' ||
               CASE WHEN page_id < 10 THEN '0' ELSE '' END || page_id AS file_name FROM {_HEADINGS}""",
)
def p30(spark, sf_dir):
    return _headings(spark, sf_dir).select(
        "page_id", "place", text.safe_name(F.col("h"), F.col("page_id")).alias("file_name")
    )


@query(
    "p31_ellipsis",
    f"""SELECT page_id, place, CASE WHEN length(h) > 10 THEN left(h, 10) || '...' ELSE h END AS w10,
              CASE WHEN length(h) > 40 THEN left(h, 40) || '...' ELSE h END AS w40,
              CASE WHEN length(h) > 60 THEN left(h, 60) || '...' ELSE h END AS w60 FROM {_HEADINGS}""",
)
def p31(spark, sf_dir):
    cut = [text.ellipsis(F.col("h"), n).alias(f"w{n}") for n in (10, 40, 60)]
    return _headings(spark, sf_dir).select("page_id", "place", *cut)


@query(
    "p32_link_or_search",
    f"WITH {q.EVENTS} SELECT seq, CASE WHEN offer_url <> '' THEN offer_url ELSE url END AS link FROM obs",
)
def p32(spark, sf_dir):
    return events_obs(spark, sf_dir).select("seq", urls.link_or(F.col("offer_url"), F.col("url")).alias("link"))


@query(
    "p34_delta_label",
    f"""WITH d AS (SELECT event_id, value - 50 AS c, (value - 50) / 50 * 100 AS p FROM events)
        SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '—' ELSE
          CASE WHEN c > 0 THEN '↑ +' WHEN c < 0 THEN '↓ ' ELSE '→ ' END || {q.one_decimal('p')} || '%' END AS label FROM d""",
)
def p34(spark, sf_dir):
    change = F.when(F.col("event_id") % 7 != 0, F.col("value") - 50)
    return table(spark, sf_dir, "events").select(
        "event_id", money.delta_label(change, (F.col("value") - 50) / 50 * 100).alias("label")
    )
