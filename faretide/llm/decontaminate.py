"""Benchmark decontamination by size-partitioned MinHash containment search, with built-in functions only.

A test item is found in a document if the document holds at least ``percent`` % of the item's distinct
shingles (five consecutive words; words are lower-cased runs of letters and digits). The
MinHash sketch of a long document says nothing about a short passage in it, so the search is asymmetric:
items keep a sketch, the shingles with the least hashes, and documents probe it with all theirs.
Items are partitioned by size. Small items keep every shingle, larger ones
``SKETCH`` of them, so an item with 80 % of its shingles in a document is missed with probability 0.2^12 = 4e-9
at most. A document skips the partitions whose items it is too short to hold. Candidates are
verified on the exact shingles of the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
PERCENT = 80
SKETCH = 12
# A sketch table of at most this many narrow rows is sent to every executor; a larger one is joined by shuffle.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; none for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles(tokens: Column, length: int) -> Column:
    """All runs of ``length`` words, each as one string; none if there are fewer words."""
    last = F.size(tokens) - length
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i + 1, length), " "))


def hashes(tokens: Column, length: int) -> Column:
    """Hashes of the same runs, from the hashes of their words; ``tokens`` is a column, so words are hashed once."""
    last = F.size(tokens) - length
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    runs = F.transform(
        F.array(F.transform(tokens, lambda w: F.xxhash64(w))),
        lambda h: F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(length)])),
    )
    return F.get(runs, F.lit(0))


def item_sketches(items: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, sketch: int = SKETCH) -> DataFrame:
    """``partition, need, item_id, hash``: sketch rows; ``need`` is how many shingles a document must have."""
    n = F.size("grams")
    sized = items.select(
        "item_id",
        n.alias("n"),
        F.array_sort(
            F.transform("grams", lambda g: F.xxhash64(*[F.xxhash64(F.get(F.split(g, " "), F.lit(k))) for k in range(shingle)]))
        ).alias("hashes"),
    )
    # A partition holds the sizes between two powers of two.
    bound = F.floor(F.log2("n"))
    return sized.select(
        bound.alias("partition"),
        F.ceil(F.pow(F.lit(2), bound) * percent / 100).alias("need"),
        "item_id",
        F.explode(F.slice("hashes", 1, sketch)).alias("hash"),
    )


def contaminated(
    docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, sketch: int = SKETCH
) -> DataFrame:
    """``doc_id, item_id, n_shingles, n_shared``: every document with every test item it holds.

    ``n_shingles`` counts the item's distinct shingles, ``n_shared`` those found in the document;
    100 * n_shared >= ``percent`` * n_shingles. Items with fewer words than ``shingle``, null or empty, have no
    shingles and are never found. Documents with fewer hold nothing. Rows without id are left out;
    rows that repeat an id count as one document or item with the shingles of all of them. Other columns
    are ignored. Empty tables give no rows.
    """
    items = (
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
        .filter("item_id is not null")
        .select("item_id", words(F.col("text")).alias("tokens"))
        .select("item_id", F.explode(shingles(F.col("tokens"), shingle)).alias("gram"))
        .groupBy("item_id")
        .agg(F.collect_set("gram").alias("grams"))
    )
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).filter("doc_id is not null")
    sketches = item_sketches(items, shingle, percent, sketch)
    if sketches.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        sketches = F.broadcast(sketches)
    tokens = texts.select("doc_id", words(F.col("text")).alias("tokens"))
    probes = tokens.select(
        "doc_id",
        (F.size("tokens") - (shingle - 1)).alias("most"),
        F.explode(hashes(F.col("tokens"), shingle)).alias("hash"),
    )
    candidates = (
        probes.join(sketches, "hash").filter("most >= need").select("doc_id", "item_id").distinct()
    )
    # The texts go once through a shuffle at any size; candidates are few.
    grams = (
        texts.hint("merge")
        .join(candidates.groupBy("doc_id").agg(F.collect_set("item_id").alias("item_ids")), "doc_id")
        .select("doc_id", "item_ids", words(F.col("text")).alias("tokens"))
        .select("doc_id", "item_ids", F.array_distinct(shingles(F.col("tokens"), shingle)).alias("held"))
    )
    pairs = grams.select("doc_id", "held", F.explode("item_ids").alias("item_id")).join(items, "item_id")
    shared = pairs.select(
        "doc_id", "item_id", F.size("grams").alias("n"), F.explode(F.array_intersect("grams", "held")).alias("gram")
    )
    counted = shared.groupBy("doc_id", "item_id").agg(
        F.max("n").cast("long").alias("n_shingles"), F.count_distinct("gram").alias("n_shared")
    )
    return counted.filter(F.col("n_shared") * 100 >= F.col("n_shingles") * percent)


SQL = f"""
WITH item_words AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w
  FROM benchmark),
items AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM item_words)),
sizes AS (SELECT item_id, count(*) AS n_shingles FROM items GROUP BY item_id),
doc_words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w
  FROM documents),
held AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM doc_words)),
shared AS (
  SELECT doc_id, item_id, count(*) AS n_shared FROM held JOIN items USING (gram) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_shared FROM shared JOIN sizes USING (item_id)
WHERE 100 * n_shared >= {PERCENT} * n_shingles
"""
