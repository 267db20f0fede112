"""Column functions on the awkward inputs."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from faretide.functions import markup, money, text, timestamps, urls
from faretide.operators.offers import parse_offers


@pytest.fixture(scope="module")
def apply(spark):
    """Evaluate a column function on each input string."""

    def run(fn, values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
        return [r["r"] for r in df.select("i", fn(F.col("v")).alias("r")).orderBy("i").collect()]

    return run


def test_clean_and_normalize(apply):
    raw = ["  A   b\n\tc ", "", None]
    assert apply(text.clean_text, raw) == ["A b c", "", None]
    assert apply(text.normalize_text, raw) == ["a b c", "", None]


def test_normalize_dates(apply):
    raw = ["24.09.2025 - 1.10.2025", "24-09-2025 do 01-10-2025", "wylot 5.1.2025, powrót 12-01-2025, 3.3.2026", " 24.09.2025 ", "brak 5-6", None]
    assert apply(text.normalize_dates, raw) == [
        "2025-09-24|2025-10-01",
        "2025-09-24|2025-10-01",
        "2025-01-05|2025-01-12",
        "24.09.2025",
        "brak 5-6",
        None,
    ]


def test_parse_price(apply):
    raw = ["6 233 PLN", "6.233,50 PLN", "od 7 264 zł", "7 264 zł", "cena", "", None, " - 12", "za 2 osoby"]
    assert apply(text.parse_price, raw) == [6233.0, 6233.5, 7264.0, 7264.0, 0.0, 0.0, 0.0, 12.0, 2.0]


def test_date_and_duration_texts(apply):
    assert apply(text.is_date_text, ["20.09 - 04.10", "20/09/2025", "1-2", "Ocena 4.5 / 10.5", None]) == [
        True, True, False, False, False]
    assert apply(text.is_duration_text, ["7 dni", "14d", "7 Nights", "dni", "8", None]) == [
        True, True, True, False, False, False]
    assert apply(text.dates_from_text, ["x 20.09 - 04.10 y", "1/2/2025 - 3/2/2025", "20-09-2025-04-10-2025", "20.09"]) == [
        "20.09 - 04.10", "1/2/2025 - 3/2/2025", "20-09-2025-04-10-2025", ""]
    assert apply(text.duration_from_text, ["pobyt 7 NIGHTS", "14d", "9 n.", "6 noclegów, 7 dni", "x"]) == [
        "7 NIGHTS", "14 dni", "9 dni", "6 noclegów", ""]


def test_names(apply):
    assert apply(text.slugify, ["Aqua Sun (Ex. Eri)", "--", "Żółć 1"]) == ["aqua-sun-ex-eri", "hotel", "1"]
    assert apply(lambda c: text.safe_name(c, F.lit(3)), ["A/b: c_d-e! "]) == ["Ab c_d-e_03"]
    assert apply(lambda c: text.safe_name(c, F.lit(123)), ["a"]) == ["a_123"]
    assert apply(lambda c: text.ellipsis(c, 3), ["abc", "abcd"]) == ["abc", "abc..."]


def test_mixed_timestamps(apply):
    raw = ["2025-09-06T21:21:49.628394", "2025-09-20T10:44:15+00:00", "2025-09-20T10:44:15Z", "2025-09-20T10:44:15+02:00", "", "x", None]
    utc = [None if v is None else v.replace(microsecond=0) for v in apply(lambda c: timestamps.utc_ts(c).cast("timestamp_ntz"), raw)]
    assert utc == [
        dt.datetime(2025, 9, 6, 21, 21, 49), dt.datetime(2025, 9, 20, 10, 44, 15),
        dt.datetime(2025, 9, 20, 10, 44, 15), dt.datetime(2025, 9, 20, 8, 44, 15), None, None, None]
    local = apply(lambda c: timestamps.normalize_ts(c, "Europe/Warsaw").cast("timestamp_ntz"), raw[:2])
    assert [v.hour for v in local] == [19, 10]


def test_urls(apply):
    base = "https://search.example.com/kierunek/grecja/?filter[whenFrom]=20-09-2025&filter[whenTo]=04-10-2025&filter[duration]=6:15&"
    raw = [
        base + "filter[from]=Warszawa,Warszawa-Radom&filter[PriceTo]=8100",
        base + "filter[from]=&filter[PriceTo]=30000",
        "https://search.example.com/?filter%5Bfrom%5D=x&filter[from]=Krakow%2CLodz&filter[from]=Lodz",
        "https://search.example.com/wycieczka/egipt,hotel,1",
        None,
    ]
    assert apply(urls.airport_from_url, raw) == ["Warszawa", "Все аэропорты", "Krakow%2CLodz", "Все аэропорты", "Все аэропорты"]
    assert apply(urls.departure_from_url, raw) == ["Warszawa", None, "x", None, None]
    assert apply(urls.price_limit, raw) == [8100.0, 30000.0, None, None, None]
    assert apply(urls.destination_slug, raw) == ["grecja", "grecja", "", "egipt", ""]
    assert apply(urls.duration_range, raw)[0] == "6-15 дней"
    assert apply(urls.duration_range, ["?filter[duration]=7:7"]) == ["7 дней"]
    assert apply(lambda c: urls.trip_window(c)["end"], raw)[0] == dt.date(2025, 10, 4)
    filters = apply(urls.url_filters, raw)
    assert filters[0]["filter[from]"] == "Warszawa,Warszawa-Radom"
    assert filters[2] == {"filter[from]": "x"} and filters[3] == {}


def test_absolute_url(apply):
    raw = ["/a", "b/c", "#top", "http://x.example/y", " ", None]
    assert apply(lambda c: urls.absolute_url(c, "https://o.example/"), raw) == [
        "https://o.example/a", "https://o.example/b/c", "#top", "http://x.example/y", "", ""]


def test_airports(apply):
    assert apply(urls.airport_name, ["Gdansk", "Praga", None]) == ["Гданьск", "Praga", None]
    assert apply(urls.airport_or_base, ["", None, "Warszawa", "Warszawa-Radom", "Krakow"]) == [
        "Варшава", "Варшава", "Варшава", "Варшава-Радом", "Krakow"]


def test_money_labels(spark):
    rows = [(4.0, 4.25), (-4.0, -12.35), (0.0, 0.0), (None, None)]
    df = spark.createDataFrame(rows, "c double, p double")
    got = [r[0] for r in df.select(money.delta_label(F.col("c"), F.col("p"))).collect()]
    assert got == ["↑ +4.3%", "↓ -12.4%", "→ 0.0%", "—"]
    pct = df.select(money.pct_change(F.lit(5.0), F.lit(0.0)), money.pct_change(F.lit(5.0), F.lit(0.0), None)).first()
    assert tuple(pct) == (0.0, None)


CARD = """<a class="image-link" href="/img/1"><img src="data:x" data-src="https://i.example/1.jpg"></a>
<div><h3>  Sea  <b>View</b> &amp; Spa</h3><p class="date">24.09.2025 - 01.10.2025</p><span>7 noclegów</span>
<span class="price">od 3 100 zł za osobę</span><span class="price total">6 200 zł za wszystkich</span></div>"""


def test_parse_offers(spark):
    rows = [(1, CARD), (2, "<p>za mało</p>"), (3, "<div>jeden dwa trzy cztery pięć sześć</div>")]
    cards = spark.createDataFrame(rows, "i int, html string").withColumn("url", F.lit("?filter[from]=Krakow"))
    got = {r["i"]: r for r in parse_offers(cards, base_url="https://o.example", keep=("i",)).collect()}
    assert set(got) == {1, 3}
    one, three = got[1], got[3]
    assert (one["hotel_name"], one["price"], one["dates"], one["duration"]) == (
        "Sea View & Spa", 6200.0, "24.09.2025 - 01.10.2025", "7 noclegów")
    assert (one["image_url"], one["offer_url"], one["departure_airport"]) == (
        "https://i.example/1.jpg", "https://o.example/img/1", "Krakow")
    assert (three["hotel_name"], three["price"], three["duration"]) == ("jeden dwa trzy cztery pięć", 0.0, "6-15 дней")


def test_link_priority(apply):
    pages = [
        '<a href="/x">x</a><a class="offer-con" href="/con">y</a><a class="image-link" href="/img">z</a>',
        '<a href="/x">x</a><a class="offer-con" href="/con">y</a><a href="/wycieczka/1">z</a>',
        '<a href="/offer/2">x</a><a href="/wycieczka/1">z</a>',
        '<a href="/x">x</a><a href="/Best-OFFER">y</a>',
        '<a href="/self"><b>card</b></a>',
        '<div><a href="/x">x</a></div>',
        "<div>none</div>",
    ]
    got = apply(lambda c: markup.offer_link_from_markup(c, "https://o.example"), pages)
    assert [g.removeprefix("https://o.example") for g in got] == [
        "/x", "/x", "/offer/2", "/x", "/self", "", ""]
    inner = ["<div>" + p + "</div>" for p in pages[:4]]
    got = apply(lambda c: markup.offer_link_from_markup(c, "https://o.example"), inner)
    assert [g.removeprefix("https://o.example") for g in got] == ["/img", "/con", "/wycieczka/1", "/Best-OFFER"]


def _card(spark, html):
    return spark.createDataFrame([(html,)], "html string").select(markup.card_texts(F.col("html")).alias("c")).first()["c"]


def test_card_tiers(spark):
    got = _card(
        spark,
        '<span class="price-old">999</span><span class="price">777</span><b class="subtitle">5 gwiazdek</b>'
        '<b class="name">N</b><span class="date">20.09.2025</span><i data-nights="1">7 nocy</i>',
    )
    assert (got["name"], got["price"], got["dates"], got["duration"]) == ("N", "777", "20.09.2025", "7 nocy")
    # A blank first element gives way to the next selector; a part of a class name comes last.
    got = _card(spark, '<i class="price"> </i><i class="price">1</i><i class="value">2</i><p class="x-title">T</p>')
    assert (got["name"], got["price"]) == ("T", "2")
    got = _card(spark, '<i class="price">1</i><i class="price-view-2">2 PLN</i><i class="my-price">3 Za wszystkich</i>')
    assert got["price"] == "3 Za wszystkich"
    assert _card(spark, '<i class="price">1</i><i class="price-view-2">2 PLN</i>')["price"] == "2 PLN"
    assert _card(spark, None)["name"] is None and _card(spark, "a < b > c <")["price"] is None


def test_card_of_odd_shape(spark):
    assert _card(spark, "<h1>" + " " * 20_000 + "Name</h1>")["name"] == "Name"
    assert _card(spark, "<h1>" + "<b>" * 20_000 + "Name</h1>")["name"] == "Name"
    started = time.time()
    got = _card(spark, '<span class="price">9 PLN' * 8_000)
    assert got["price"] == "9 PLN" and time.time() - started < 10


def test_first_accepted_and_party_prices_follow_the_selectors_in_order(spark):
    """Selectors are tried in order and no further than the first that gives a text; tags may be in capitals."""
    cards = [
        ('<DIV CLASS="x"><U class="name"> </U><b class="hotel-name">B</b></DIV>', ("B", None, None)),
        ('<p class="price">1 PLN</p><p class="old-price">2 PLN ZA WSZYSTKICH</p>', (None, "2 PLN ZA WSZYSTKICH", None)),
        ('<p DATA-DATE>03.04 - 05.04</p><p class="when">01.02 - 02.02</p>', (None, None, "03.04 - 05.04")),
        ("<SCRIPT>x<b class='price'>1</b></SCRIPT ><!-- <h1>n</h1> --><b class='cost'>7</b><STYLE>h</STYLE>", (None, "7", None)),
    ]
    df = spark.createDataFrame([(k, html) for k, (html, _) in enumerate(cards)], "k int, html string")
    found = df.select("k", markup.card_texts(F.col("html")).alias("c")).orderBy("k").collect()
    assert [(r["c"]["name"], r["c"]["price"], r["c"]["dates"]) for r in found] == [want for _, want in cards]
    # No alternative is tried at a character that begins no tag, and no selector is one of another.
    plan = df.select(markup.visible_text(F.col("html")))._jdf.queryExecution().analyzed().toString()
    assert "<(?:script" in plan
    parts = [v.removeprefix(r"\Q").removesuffix(r"\E") for v in markup._SELECTABLE.removeprefix("(?i)").split("|")]
    assert not any(a != b and a in b for a in parts for b in parts)
