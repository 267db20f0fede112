"""The SQL twin of the perspectives on dialogues in which somebody is silent in a part."""

import duckdb
from pyspark.sql import functions as F

from faretide.llm import chat


def test_silent_participants(spark, tmp_path):
    rows = [(1, t, "system" if t == 0 else "ann" if t < 100 and t % 2 else "bob" if t % 2 else "cleo", f"said {t}") for t in range(200)]
    rows += [(2, 0, "system", "alone"), (3, 0, None, None), (3, 1, "ann", "x"), (None, 5, "bob", "no id"), (None, 6, "system", "s")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.perspectives(table).withColumn(
        "spans", F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), " ")
    )
    table.coalesce(1).write.parquet(str(tmp_path / "c"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/c/*.parquet')")
    want = con.execute(f"SELECT conv_id, part, speaker, text, spans, n_turns, n_own FROM ({chat.SQL})").fetchall()
    got = [tuple(r) for r in out.select("conv_id", "part", "speaker", "text", "spans", "n_turns", "n_own").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    # Every participant of the long dialogue has a row for each of its four parts, with or without words of their own.
    assert sum(r[0] == 1 for r in got) == 12 and any(r[0] == 1 and r[6] == 0 for r in got)
