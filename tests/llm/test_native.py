"""Decontamination and chat perspectives against brute force; archives; the pipeline; the queries."""

import gzip
import os
import re
import zlib

import duckdb
import pytest
from helpers import component_ids, corpus, frame, sentences, without_repeats

from faretide.llm import chat, decontaminate, queries, warc
from faretide.session import scratch_path
from tools.check_queries import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.SQL))
def test_sql_twin(spark, name):
    got = queries.QUERIES[name](spark, SF_DIR).toPandas()
    assert compare(got, connect(SF_DIR).execute(queries.SQL[name]).df()) == ""


def grams(text, n=5):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


@pytest.mark.parametrize("limit", [500_000, 0])
def test_decontamination(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
    docs = corpus()
    long = next(t for _, t in docs if t and len(t.split()) > 1000).split()
    items = [
        (1, " ".join(long[100:140])), (2, " ".join(long[200:208]).upper() + "!"), (3, "one two three"), (4, None), (5, ""),
        (6, " ".join([*long[300:330], "new", "words", "end"])), (7, " ".join([*long[400:410], *"a b c d e f g".split()])),
        (8, " ".join(long[500:505])), (8, " ".join(long[500:505])), (None, " ".join(long[1:30])),
    ]
    table = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, grams int")
    found = {(r["doc_id"], r["item_id"]): (r["n_shingles"], r["n_shared"]) for r in decontaminate.contaminated(frame(spark, docs), table).collect()}
    want = {}
    for d, t in docs:
        for i, u in items:
            both, own = len(grams(t) & grams(u)), len(grams(u))
            if i is not None and own and 100 * both >= 80 * own:
                want[d, i] = (own, both)
    assert found == want and want
    assert decontaminate.contaminated(frame(spark, []), table).count() == 0
    assert decontaminate.contaminated(frame(spark, docs), table.limit(0)).count() == 0


def render(turns, speaker):
    text, spans = "", []
    for role, said in turns:
        head = "assistant" if role == speaker else "system" if role == "system" else f"user name={role}"
        text += f"<|im_start|>{head}\n"
        start = len(text)
        text += said + "<|im_end|>\n"
        if role == speaker:
            spans.append((start, len(text)))
    return text, spans


def test_perspectives(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "é hi"), (1, 2, "assistant", None), (1, 3, None, "x"), (1, 3, "user", ""),
            (2, 0, "system", "alone"), (3, None, "user", "a"), (3, 5, "user", "b"), (3, 5, "user", "b"), (None, 1, "user", "lost")]
    rows += [(9, t, f"p{t % 3}", "word " * (t % 4)) for t in range(150)]
    table = spark.createDataFrame([(*r, 0, "x") for r in rows], "conv_id long, turn long, role string, text string, part int, place string")
    found = {(r["conv_id"], r["part"], r["speaker"]): r for r in chat.perspectives(table).collect()}
    want = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r[1] if r[1] is not None else -1, r[2] or "unknown", r[3] or "") for r in rows if r[0] == conv)
        for part in range(0, -(-len(turns) // 64)):
            own = [(role, said) for _, role, said in turns[64 * part : 64 * part + 64]]
            for speaker in {role for role, _ in own} - {"system"}:
                want[conv, part, speaker] = render(own, speaker)
    assert {k: (r["text"], [tuple(s) for s in r["spans"]]) for k, r in found.items()} == want
    assert chat.perspectives(table.limit(0)).count() == 0


def test_silent_participants_have_every_part(spark):
    # b is silent in the second part, everybody but the system in the third; both dialogues, with and without id.
    names = ["a", "b"] * 32 + ["a"] * 64 + ["system"] * 64 + [None]
    rows = [(conv, t, name, f"w{t}") for conv in (1, None) for t, name in enumerate(names)] + [(2, 0, "c", "alone")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {(r["conv_id"], r["part"], r["speaker"]): r for r in chat.perspectives(table).collect()}
    turns = [(name or "unknown", f"w{t}") for t, name in enumerate(names)]
    want = {(conv, part, who): render(turns[64 * part : 64 * part + 64], who)
            for conv in (1, None) for part in range(4) for who in ("a", "b", "unknown")}
    want[2, 0, "c"] = render([("c", "alone")], "c")
    assert {k: (r["text"], [tuple(s) for s in r["spans"]]) for k, r in found.items()} == want
    for who in ("a", "b", "unknown"):
        pieces = "".join(found[1, part, who]["text"] for part in range(4))
        assert pieces == render(turns, who)[0]


@pytest.fixture(scope="module")
def archive(spark):
    big = "x" * 150 + "é"
    rows = [(1, "http://a/\r\nX: 1", big), (2, None, big), (3, "u", None), (4, "u", ""), (None, "u", big), (5, "v", "short"),
            (6, "v", "short"), (2, "dup", "other" * 50), (7, "w", "<html>\r\n\r\nWARC/1.1\r\n" + big * 10_000), (8, "w", big)]
    folder = scratch_path(spark, "test-warc")
    pages = spark.createDataFrame([(*r, "d", "x") for r in rows], "page_id long, url string, html string, digest string, refers_to string")
    files = warc.write_archives(pages, folder, file_bytes=3000).collect()
    assert sum(f["records"] for f in files) == len(rows)
    return folder


def test_archives(spark, archive):
    found = {(r["page_id"], r["payload_bytes"]): (r["record_type"], r["refers_to"]) for r in warc.page_records(spark, archive).collect()}
    assert found == {
        (1, 152): ("response", None), (2, 152): ("revisit", 1), (3, 0): ("response", None), (4, 0): ("response", None),
        (None, 152): ("response", None), (5, 5): ("response", None), (6, 5): ("response", None), (2, 250): ("response", None),
        (7, 1520020): ("response", None), (8, 152): ("revisit", 1)}
    uris = {r["page_id"]: r["target_uri"] for r in warc.read_archives(spark, archive, ["page_id", "target_uri"]).collect()}
    assert uris[1] == "http://a/%0D%0AX:%201"


def test_predicates_reach_the_reader(spark, archive):
    rows = warc.read_archives(spark, archive, ["page_id", "record_type"]).filter("record_type = 'revisit' and page_id > 2")
    assert not re.search(r"\bFilter\b", rows._jdf.queryExecution().executedPlan().toString())
    assert [tuple(r) for r in rows.collect()] == [(8, "revisit")]
    with pytest.raises(Exception, match="no columns"):
        warc.read_archives(spark, archive).sparkSession.read.format("warc").schema("nothing int").load(archive).collect()


def test_archives_of_other_writers(spark, archive, tmp_path):
    want = sorted(map(tuple, warc.read_archives(spark, archive).collect()), key=repr)
    packed, plain = tmp_path / "packed", tmp_path / "plain"
    packed.mkdir(), plain.mkdir()
    source = archive.removeprefix("file://").removeprefix("file:")
    for name in os.listdir(source):
        if not name.endswith(".warc.gz"):
            continue
        data, members, whole = open(f"{source}/{name}", "rb").read(), b"", b""
        while data:
            engine = zlib.decompressobj(31)
            text = engine.decompress(data)
            data, members, whole = engine.unused_data, members + gzip.compress(text), whole + text
        (packed / name).write_bytes(members)
        (plain / name[:-3]).write_bytes(whole)
    for folder in (packed, plain):
        assert sorted(map(tuple, warc.read_archives(spark, f"file://{folder}").collect()), key=repr) == want


def test_no_pages(spark):
    folder = scratch_path(spark, "test-warc")
    os.makedirs(folder.removeprefix("file://").removeprefix("file:"))
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.write_archives(pages, folder).count() == 0 and warc.page_records(spark, folder).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "near-duplicate removal", "substring removal", "decontamination", "best-fit packing"]
    labels = duckdb.sql(f"select doc_id, quality from '{SF_DIR}/labels.parquet'").fetchall()
    kept = stages["quality classifier"](spark, docs, SF_DIR)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    # Few labels at this size: good documents stay, and most others go.
    assert sum(i in ids for i, q in labels if q) >= 0.97 * sum(q for _, q in labels)
    assert sum((i in ids) == bool(q) for i, q in labels) >= 0.85 * len(labels)
    whole = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r["doc_id"] for r in whole} <= ids and max(r["offset"] + r["length"] for r in whole) <= 2048
    # Odd rows pass every stage.
    odd = frame(spark, [(1, None), (2, ""), (None, sentences(__import__("random").Random(1), 40)), (3, "x" * 3000)])
    odd = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF_DIR).collect()
        assert name == "quality classifier" or len({r["doc_id"] for r in out}) >= 3
    empty = odd.limit(0)
    assert all(stage(spark, empty, SF_DIR).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_stages_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    stages, rows = dict(corpus_pipeline.STAGES), corpus()
    docs = frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    label = component_ids(rows, 5, 80)
    unique = stages["near-duplicate removal"](spark, docs, "")
    assert unique.columns == docs.columns
    left = [(r["doc_id"], r["text"]) for r in unique.collect()]
    assert sorted(i for i, _ in left) == sorted(i for i in label if label[i] == i)
    cut = {r["doc_id"]: r for r in stages["substring removal"](spark, docs, "").collect()}
    want = without_repeats(rows, corpus_pipeline.PASSAGE_WORDS)
    texts = dict(rows)
    assert {i: r["text"] for i, r in cut.items()} == {
        i: texts[i] if not gone else kept for i, (kept, n, gone) in want.items() if not gone or gone < n
    }
    assert all(r["n_chars"] == len(r["text"] or "") for r in cut.values())
    items = [(1, " ".join(texts[0].split()[3:30])), (2, "nowhere to be found at all in here")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = {r["doc_id"] for r in stages["decontamination"](spark, docs, str(tmp_path)).collect()}
    held = {i for i, t in rows if 100 * len(grams(t) & grams(items[0][1])) >= 80 * len(grams(items[0][1]))}
    assert held and clean == {i for i, _ in rows} - held
