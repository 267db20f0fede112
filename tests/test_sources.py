"""Files in and out."""

import json

from conftest import as_set, at

from faretide.fixed_values import OBSERVATION_COLUMNS
from faretide.schema import OBSERVATION
from faretide.sources import documents, images, observations

HEADER = ",".join(f'"{c}"' for c in OBSERVATION_COLUMNS)


def line(name, price="10", when="2025-01-01T00:00:00+00:00", extra=(), drop=0):
    fields = [name, price, "d", "7 dni", "", "Krakow", when, "u", "", "o", *extra]
    fields = fields[: len(fields) - drop] if drop else fields
    return ",".join('"' + f.replace('"', '""') + '"' for f in fields)


def test_csv_cases(spark, tmp_path):
    path = tmp_path / "obs.csv"
    rows = [
        line('A ""x"" b'),
        line("over", extra=["surplus"]),
        line("short", drop=2),
        line("bad time", when="wczoraj"),
        line("naive", when="2025-01-01T12:00:00"),
        line("z", when="2025-01-01T12:00:00Z"),
        line("no price", price="brak"),
        line("zero", price="0"),
    ]
    path.write_text("\n".join([HEADER, *rows]) + "\n", encoding="utf-8")
    read = observations.read_observations(spark, str(path), "d", "Europe/Warsaw")
    got = {r["hotel_name"]: r for r in read.collect()}
    assert set(got) == {'A ""x"" b', "short", "naive", "z", "no price", "zero"}
    assert got["short"]["offer_url"] is None and got["no price"]["price"] is None
    assert read.schema.fieldNames() == OBSERVATION.fieldNames()
    hours = {n: got[n]["observed_at"].astimezone(at("2025-01-01T00:00:00").tzinfo).hour for n in ("naive", "z")}
    assert hours == {"naive": 11, "z": 12}
    ordered = [r["hotel_name"] for r in read.orderBy("seq").collect()]
    assert ordered == ['A ""x"" b', "short", "naive", "z", "no price", "zero"]


def test_columns_by_header_name(spark, tmp_path):
    (tmp_path / "new.csv").write_text(HEADER + "\n" + line("new") + "\n")
    (tmp_path / "old.csv").write_text('"scraped_at","price","hotel_name"\n"2025-01-01T00:00:00","5","old"\n')
    paths = [str(tmp_path / "new.csv"), str(tmp_path / "old.csv"), str(tmp_path / "absent.csv")]
    read = observations.read_observations(spark, paths, "d")
    assert as_set(read, "hotel_name", "price", "duration") == [("new", 10.0, "7 dni"), ("old", 5.0, None)]
    only_old = observations.read_observations(spark, paths[1:], "d")
    assert as_set(only_old, "hotel_name", "duration", "url") == [("old", "", "")]


def test_empty_files(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "header.csv").write_text(HEADER + "\n")
    for name in ("empty.csv", "header.csv", "absent.csv"):
        read = observations.read_observations(spark, str(tmp_path / name), "d")
        assert read.count() == 0 and read.schema.fieldNames() == OBSERVATION.fieldNames()


def test_line_breaks_in_fields(spark, tmp_path):
    (tmp_path / "ml.csv").write_text(HEADER + "\n" + line("two\nlines") + "\n")
    read = observations.read_observations(spark, str(tmp_path / "ml.csv"), "d", multiline=True)
    assert as_set(read, "hotel_name") == [("two\nlines",)]


def test_append_keeps_every_point_and_prunes(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + "\n" + line("a") + "\n" + line("b", when="2025-03-01T00:00:00") + "\n")
    obs = observations.read_observations(spark, str(tmp_path / "a.csv"), "d")
    table = str(tmp_path / "table")
    observations.append_observations(obs, table)
    observations.append_observations(obs, table)
    read = observations.read_table(spark, table)
    assert read.count() == 4
    assert as_set(observations.retain(read, 30), "hotel_name") == [("b",), ("b",)]
    plan = read.filter("dataset = 'd' and obs_date = date'2025-01-01'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(dataset" in plan
    assert observations.read_table(spark, str(tmp_path / "none")).count() == 0


def test_export_is_quoted_and_ordered(spark, make_obs, tmp_path):
    out = str(tmp_path / "out")
    observations.export_csv(make_obs([{"hotel_name": 'a "b"', "price": 1.5}]), out)
    parts = [p.read_text().splitlines() for p in (tmp_path / "out").glob("part-*.csv")]
    text = next(p for p in parts if len(p) > 1)
    assert text[0] == HEADER
    assert text[1].startswith('"a ""b""","1.5",')


def test_image_map_keeps_the_first(spark, make_obs):
    obs = make_obs(
        [
            {"hotel_name": "a", "image_url": "data:x"},
            {"hotel_name": "a", "image_url": " http://i/1 "},
            {"hotel_name": "a", "image_url": "http://i/2"},
            {"hotel_name": "k", "image_url": "http://i/3"},
        ]
    )
    known = spark.createDataFrame([("k", "http://old")], "hotel_name string, image_url string")
    merged = images.merge_image_map(known, obs)
    assert as_set(merged, "hotel_name", "image_url") == [("a", "http://i/1"), ("k", "http://old")]
    items = spark.createDataFrame([("a",), ("none",)], "hotel_name string")
    assert as_set(images.with_images(items, merged), "hotel_name", "image_url") == [("a", "http://i/1"), ("none", None)]


def test_search_definitions(spark, tmp_path):
    doc = {
        "url": "https://s.example/kierunek/grecja/?filter[whenFrom]=20-09-2025&filter[from]=Krakow&filter[PriceTo]=8100&filter[duration]=7:15",
        "max_price_threshold": 8100,
        "output_data_file": "x.csv",
    }
    (tmp_path / "c.json").write_text(json.dumps(doc, indent=2))
    row = documents.read_search_definitions(spark, str(tmp_path / "c.json"), {"max_retries": 3}).first()
    assert (row["price_limit"], row["max_retries"], row["duration_range"]) == (8100.0, 3, "7-15 дней")
    assert row["filters"]["filter[from]"] == "Krakow"


def test_summary_document(make_obs, spark, tmp_path):
    obs = make_obs([{"hotel_name": h, "price": p, "dates": "x"} for h, p in [("a", 2.0), ("b", 1.0), ("b", 1.0), ("c", 9.0)]])
    row = documents.summary_document(obs, n=3, analysis_date="2025-01-02").first()
    assert [o["hotel_name"] for o in row["top_cheap_offers"]] == ["b", "b", "a"]
    assert (row["total_offers"], row["unique_hotels"], row["price_stats"]["median"]) == (4, 3, 1.5)
    documents.write_document(documents.summary_document(obs), str(tmp_path / "s"))
    back = json.loads(next((tmp_path / "s").glob("part-*.json")).read_text())
    assert back["price_stats"]["max"] == 9.0


def test_trailing_window_prunes_days(spark, make_obs, tmp_path):
    from pyspark.sql import functions as F

    from faretide.operators.filters import trailing_window

    table = str(tmp_path / "table")
    days = [{"hotel_name": "h", "price": float(d), "observed_at": at(f"2025-01-{d:02d}T00:00:00")} for d in range(1, 21)]
    make_obs(days).withColumn("obs_date", F.to_date("observed_at")).write.partitionBy("dataset", "obs_date").parquet(table)
    recent = trailing_window(spark.read.parquet(table), 48)
    assert as_set(recent, "price") == [(18.0,), (19.0,), (20.0,)]
    recent.collect()
    assert "PartitionFilters: [isnotnull(obs_date" in recent._jdf.queryExecution().toString()


def test_optional_airport_column(spark, tmp_path):
    (tmp_path / "x.csv").write_text(
        '"hotel_name","price","scraped_at","from_airport","dates","duration","url"\n'
        '"a","1","2025-01-01T00:00:00","Lodz","1.1.2025 - 8.1.2025","6-15 dni","?filter[from]=Krakow"\n'
        '"b","1","2025-01-01T00:00:00","","x","","?filter[from]=Krakow"\n'
    )
    read = observations.read_observations(spark, str(tmp_path / "x.csv"), "d")
    facts = {r["hotel_name"]: r for r in observations.with_trip_facts(read).collect()}
    assert (facts["a"]["airport"], facts["b"]["airport"]) == ("Lodz", "Краков")
    assert (str(facts["a"]["trip_end"]), facts["a"]["nights_min"], facts["a"]["nights_max"]) == ("2025-01-08", 6, 15)
    assert (facts["b"]["trip_start"], facts["b"]["nights_min"]) == (None, None)


def test_mixed_headers_and_order_in_one_folder(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a first.csv").write_text(HEADER + "\n" + line("small") + "\n")
    many = "\n".join(line(f"n{i}", extra=["surplus"] if i == 3 else ()) for i in range(50))
    (folder / "b_second.csv").write_text(HEADER + "\n" + many + "\n")
    (folder / "c_old.csv").write_text('"scraped_at","price","hotel_name"\n"2025-01-01T00:00:00","5","old"\n')
    read = observations.read_observations(spark, str(folder), "d", seq_start=7)
    got = [(r["seq"], r["hotel_name"]) for r in read.orderBy("seq").collect()]
    names = ["small", *[f"n{i}" for i in range(50) if i != 3], "old"]
    assert got == list(enumerate(names, 7))
    table = str(tmp_path / "table")
    assert observations.next_seq(spark, table) == 0
    observations.append_observations(read, table)
    assert observations.next_seq(spark, table) == 7 + len(names)


def test_retention_counts_back_from_each_datasets_newest_day(spark, make_obs):
    obs = make_obs(
        [{"dataset": d, "hotel_name": n, "observed_at": at(f"2025-{m}T00:00:00")} for d, n, m in (
            ("old", "a", "01-01"), ("old", "b", "01-20"), ("new", "c", "06-01"), ("new", "d", "06-20"))]
    )
    dated = obs.selectExpr("*", "to_date(observed_at) AS obs_date")
    assert as_set(observations.retain(dated, 10), "hotel_name") == [("b",), ("d",)]


def bytes_read(spark):
    """What all stages so far have read from files."""
    context = spark.sparkContext
    store = context._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
    return sum(stages.apply(i).inputBytes() for i in range(stages.size()))


def test_files_are_read_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(4):
        rows = "\n".join(line(f"h{i}-{k}-" + "abcdefgh"[k % 8] * 150) for k in range(3000))
        (folder / f"{i}.csv").write_text(HEADER + "\n" + rows + "\n")
    size = sum(p.stat().st_size for p in folder.iterdir())
    before = bytes_read(spark)
    read = observations.read_observations(spark, str(folder), "d")
    assert size <= bytes_read(spark) - before <= 1.05 * size
    assert read.selectExpr("count(*)", "min(seq)", "max(seq)").first()[:] == (12_000, 0, 11_999)
    assert "csv" not in read._jdf.queryExecution().toString().lower().replace(str(tmp_path).lower(), "")
    assert bytes_read(spark) - before <= 1.5 * size


def test_first_lines_are_read_in_small_pieces(tmp_path, monkeypatch):
    cases = {
        "a.csv": (HEADER + "\r\n" + "x" * 10_000_000, HEADER), "b.csv": ("\n \n" + HEADER, HEADER), "c.csv": ("", ""),
        "d e%20.csv": ("y" * 40_000 + "\n1", "y" * 40_000), "f.csv": ("old\rmac", "old"), "g.csv": ("\n\n", ""),
    }
    pieces = []

    class Counted:
        def __init__(self, file):
            self.file = file

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

        def read(self, size):
            pieces.append(size)
            return self.file.read(size)

    opened = observations._open
    monkeypatch.setattr(observations, "_open", lambda path: Counted(opened(path)))
    for name, (text, want) in cases.items():
        (tmp_path / name).write_text(text, newline="")
        pieces.clear()
        assert observations._first_line(f"file:{tmp_path}/{name}") == want
        assert sum(pieces) <= 3 * max(len(want), 1 << 14)


def test_storage_that_arrow_cannot_open(spark, tmp_path, monkeypatch):
    """Headers then come from Spark's reader, which stops at the first line."""
    (tmp_path / "a.csv").write_text("\n" + HEADER + "\n" + line("a") + "\n")
    (tmp_path / "b.csv").write_text("")
    read = observations._heads

    def closed(batches):
        import pyarrow as pa

        for batch in read(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.nulls(batch.num_rows, pa.string())], ["path", "line"])

    monkeypatch.setattr(observations, "_heads", closed)
    assert as_set(observations.read_observations(spark, str(tmp_path), "d"), "hotel_name", "seq") == [("a", 0)]
