"""Consecutive price pairs of a stream in any order: late rows heal what was emitted before.

The rows of an item are kept in time order in panes of one ``width``. A new row is put between its neighbours: the
pair of these two is taken back (sign -1) and the two pairs with the new row are given out (sign 1). The sum of all signs
of a pair is 1 if it stands and 0 if it does not, so whoever reads the feed adds signs up and rescans no observations.

A micro-batch is folded in two steps, each a window over many items at once, so that its cost follows its rows and not
the number of items:

1. Rows by (item, pane), so that an item with very many rows spreads over its panes. The rows held of the panes that the batch
   touches are read from the feed's own folder. Out come pairs inside the pane, and its first and last row (an edge, sign 0).
2. Edges by item, one row per pane. Out come the pairs between the last row of one pane and the first row of the next.

The feed is a Parquet table of the folders ``inside`` and ``between``; beside them ``rows`` holds what each batch brought. A batch
writes folders of its own and overwrites them when it is repeated, so a stream that starts again goes on where it stopped.
``inserted`` and ``replaced`` state the rules of the two steps on plain lists.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faretide import fixed_values as fv
from faretide.operators.changes import as_alerts
from faretide.plans.runs import gap_micros
from faretide.schema import KEY

# A row of an item: time in microseconds, sequence number, price.
Row = tuple[int, int, float]

FEED = (
    "dataset string, hotel_name string, pane long, sign int, offers long, old_us long, old_seq long, old_price double, "
    "new_us long, new_seq long, new_price double"
)
_NAMES = [c.split()[0] for c in FEED.split(", ")]
_ROWS = "dataset string, hotel_name string, us long, seq long, price double, ingest_batch long, pane long"
# Folders of at most this many panes are named one by one; beyond that, all between the first and the last are read.
_LISTED = 1000


def inserted(held: list[Row], fresh: list[Row]) -> tuple[list[Row], list[tuple[int, Row, Row]]]:
    """Both sorted lists in one, and the signed pairs of neighbours that change. Equal positions keep the held row first."""
    merged, changes = [], []
    k = 0
    for row in fresh:
        while k < len(held) and held[k][:2] <= row[:2]:
            merged.append(held[k])
            k += 1
        merged.append(row)
    merged += held[k:]
    new = {id(r) for r in fresh}
    before = None  # the last held row passed
    for i, row in enumerate(merged):
        last = merged[i - 1] if i else None
        if last is not None and (id(row) in new or id(last) in new):
            changes.append((1, last, row))
        if id(row) not in new:
            if before is not None and last is not before:
                changes.append((-1, before, row))
            before = row
    return merged, changes


def replaced(held: list[tuple], updates: Iterable[tuple]) -> tuple[list[tuple], list[tuple[int, Row, Row]]]:
    """Edges (pane, offers, first row, last row) with newer ones put in, and the signed pairs between panes that change.

    An edge with fewer offers than the one held is older than it and counts for nothing.
    """
    after = list(held)
    for edge in updates:
        at = bisect_left(after, edge[0], key=lambda e: e[0])
        if at < len(after) and after[at][0] == edge[0]:
            if after[at][1] < edge[1]:
                after[at] = edge
        else:
            after.insert(at, edge)
    links = lambda edges: {(a[3], b[2]) for a, b in zip(edges, edges[1:])}
    old, new = links(held), links(after)
    return after, [(-1, *p) for p in old - new] + [(1, *p) for p in new - old]


def _number(price: Column) -> Column:
    """Prices as numbers in the feed; a missing one is NaN there."""
    return F.coalesce(price.cast("double"), F.lit(float("nan")))


def _write(df: DataFrame, path: str, folders: list[str]) -> None:
    """Write a batch's rows; those of the same batch, if it is repeated, are replaced."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
    writer.partitionBy(*folders).parquet(path)


def _row(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).alias(c) for c in ("us", "seq", "price")])


def _signed(sign: int, old: Column, new: Column, offers: Column | None = None) -> Column:
    none = F.lit(None).cast("long")
    return F.struct(F.lit(sign).alias("sign"), (none if offers is None else offers).alias("offers"), old.alias("old"), new.alias("new"))


def _feed_rows(changes: DataFrame, pane: Column, batch_id: int) -> DataFrame:
    """Rows of the feed from ``_change(sign, offers, old, new)``."""
    ends = [F.col(f"_change.{end}.{c}").alias(f"{end}_{c}") for end in ("old", "new") for c in ("us", "seq", "price")]
    return changes.select(
        *KEY, pane.cast("long").alias("pane"), "_change.sign", "_change.offers", *ends,
        F.lit(batch_id).cast("long").alias("ingest_batch"),
    )


def _inside(rows: DataFrame, batch_id: int) -> DataFrame:
    """Signed pairs inside the panes, and the edge of every pane that the batch touches."""
    place = Window.partitionBy(*KEY, "pane").orderBy("us", "seq", "ingest_batch", "price")
    so_far = place.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    passed = place.rowsBetween(Window.unboundedPreceding, -1)
    row, fresh = _row(), F.col("ingest_batch") == batch_id
    placed = rows.select(
        *KEY, "pane", row.alias("_row"), fresh.alias("_fresh"),
        F.lag(row).over(place).alias("_last"),
        F.coalesce(F.lag(fresh).over(place), F.lit(False)).alias("_after_fresh"),
        F.last(F.when(~fresh, row), ignorenulls=True).over(passed).alias("_held"),
        F.first(row).over(so_far).alias("_first"),
        F.max(fresh).over(so_far).alias("_touched"),
        F.row_number().over(place).cast("long").alias("_n"),
        F.lead(F.lit(1)).over(place).isNull().alias("_ends"),
    )
    here = F.col("_row")
    changes = F.array(
        F.when(F.col("_last").isNotNull() & (F.col("_fresh") | F.col("_after_fresh")), _signed(1, F.col("_last"), here)),
        F.when(F.col("_held").isNotNull() & ~F.col("_fresh") & F.col("_after_fresh"), _signed(-1, F.col("_held"), here)),
        F.when(F.col("_ends") & F.col("_touched"), _signed(0, F.col("_first"), here, F.col("_n"))),
    )
    out = placed.select(*KEY, "pane", F.explode(F.array_compact(changes)).alias("_change"))
    return _feed_rows(out, F.col("pane"), batch_id).withColumn("edge", F.col("sign") == 0)


def _between(edges: DataFrame, batch_id: int) -> DataFrame:
    """Signed pairs between neighbouring panes, from the newest edges before and after the batch."""
    edge = F.struct(_row("old_").alias("first"), _row("new_").alias("last"))
    earlier = F.col("ingest_batch") < batch_id
    panes = edges.groupBy(*KEY, "pane").agg(
        F.max_by(edge, "ingest_batch").alias("_now"),
        F.max_by(F.when(earlier, edge), F.when(earlier, F.col("ingest_batch"))).alias("_was"),
    )
    passed = Window.partitionBy(*KEY).orderBy("pane").rowsBetween(Window.unboundedPreceding, -1)
    linked = panes.select(
        *KEY, "_now", "_was",
        F.last("_now.last").over(passed).alias("_now_last"),
        F.last("_was.last", ignorenulls=True).over(passed).alias("_was_last"),
    )
    now = F.when(F.col("_now_last").isNotNull(), F.struct(F.col("_now_last").alias("old"), F.col("_now.first").alias("new")))
    was = F.when(
        F.col("_was_last").isNotNull() & F.col("_was").isNotNull(),
        F.struct(F.col("_was_last").alias("old"), F.col("_was.first").alias("new")),
    )
    linked = linked.select(*KEY, now.alias("_link"), was.alias("_old_link"))
    changed = linked.filter(~F.col("_link").eqNullSafe(F.col("_old_link")))
    changes = F.array(
        F.when(F.col("_link").isNotNull(), _signed(1, F.col("_link.old"), F.col("_link.new"))),
        F.when(F.col("_old_link").isNotNull(), _signed(-1, F.col("_old_link.old"), F.col("_old_link.new"))),
    )
    out = changed.select(*KEY, F.explode(F.array_compact(changes)).alias("_change"))
    return _feed_rows(out, F.lit(None), batch_id)


def _edges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{FEED}, ingest_batch long, edge boolean").parquet(f"{path}/inside").filter("edge")


def fold_pairs(rows: DataFrame, path: str, batch_id: int, delay: str | None = None) -> None:
    """Put the rows of a batch, each with its pane, into the feed at ``path``."""
    spark = rows.sparkSession
    if delay:
        try:
            newest = _edges(spark, path).filter(F.col("ingest_batch") < batch_id).agg(F.max("new_us").alias("us")).first()["us"]
        except AnalysisException:
            newest = None
        if newest is not None:
            rows = rows.filter(F.col("us") > newest - gap_micros(delay))
    fresh = rows.withColumn("ingest_batch", F.lit(batch_id).cast("long"))
    _write(fresh.hint("rebalance", "pane"), f"{path}/rows", ["ingest_batch", "pane"])
    try:
        stored = spark.read.schema(_ROWS).parquet(f"{path}/rows").filter(F.col("ingest_batch") <= batch_id)
    except AnalysisException:  # no row yet
        return
    # Panes are cells of time, the same for all items: a few per batch.
    touched = stored.filter(F.col("ingest_batch") == batch_id).select("pane").distinct()
    panes = [r["pane"] for r in touched.limit(_LISTED + 1).collect()]
    if not panes:
        return
    if len(panes) <= _LISTED:
        wanted = F.col("pane").isin(*panes)
    else:
        wanted = F.col("pane").between(*touched.agg(F.min("pane"), F.max("pane")).first())
    _write(_inside(stored.filter(wanted), batch_id), f"{path}/inside", ["ingest_batch", "edge"])
    held = _edges(spark, path).filter(F.col("ingest_batch") <= batch_id)
    _write(_between(held, batch_id), f"{path}/between", ["ingest_batch"])


def feed_pairs(
    stream: DataFrame, path: str, checkpoint: str, width: str = "1 day", delay: str | None = None
) -> None:
    """Bring the feed at ``path`` up to date with everything that ``stream`` holds now, late rows included.

    ``width`` bounds the rows that one task sorts of an item. Without ``delay`` rows may be late by any
    time; with it, rows that lie further back than that from the newest row of earlier batches are dropped. Rows of equal time
    and ``seq`` are all kept, in the order of arrival, those of one batch by price.
    """
    us, step = F.unix_micros("observed_at"), F.lit(gap_micros(width))
    rows = stream.withColumn("observed_at", F.col("observed_at").cast("timestamp")).filter(
        "observed_at is not null and seq is not null"
    )
    rows = rows.select(
        *KEY, us.alias("us"), F.col("seq").cast("long").alias("seq"), _number(F.col("price")).alias("price"),
        F.floor((us - F.pmod(us, step)) / step).alias("pane"),
    )
    query = (
        rows.writeStream.foreachBatch(lambda batch, batch_id: fold_pairs(batch, path, batch_id, delay))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """All signed pairs of a feed, in no order; empty before anything was fed."""
    parts = []
    for folder in ("inside", "between"):
        try:
            parts.append(spark.read.schema(FEED).parquet(f"{path}/{folder}").select(*_NAMES).filter("sign <> 0"))
        except AnalysisException:
            continue
    feed = parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0] if parts else spark.createDataFrame([], FEED)
    price = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return feed.select(
        *KEY, "sign", "old_us", "old_seq", price("old_price"), "new_us", "new_seq", price("new_price"),
        F.timestamp_micros("new_us").alias("changed_at"),
    )


def signed_alerts(feed: DataFrame, threshold: float = fv.ALERT_THRESHOLD_PCT) -> DataFrame:
    """Alerts of a feed, each with ``sign``: 1 raises it, -1 withdraws it."""
    # ``as_alerts`` names its columns; the sign goes along beside it, half by half.
    halves = [
        as_alerts(feed.filter(F.col("sign") == sign), threshold, signed=False).withColumn("sign", F.lit(sign))
        for sign in (1, -1)
    ]
    return halves[0].unionByName(halves[1])


def standing_pairs(feed: DataFrame) -> DataFrame:
    """Pairs that stand: equal to ``consecutive_pairs`` of all rows fed so far, from the feed alone."""
    columns = [c for c in feed.columns if c != "sign"]
    summed = feed.groupBy(*columns).agg(F.sum("sign").alias("_n")).filter(F.col("_n") > 0)
    # Equal rows of one place make equal pairs, each of which stands.
    rows = summed.withColumn("_each", F.explode(F.sequence(F.lit(1).cast("bigint"), "_n")))
    return rows.select(*KEY, "old_price", "new_price", "changed_at")


def standing_alerts(feed: DataFrame, threshold: float = fv.ALERT_THRESHOLD_PCT) -> DataFrame:
    """Alerts that stand: equal to ``consecutive_changes`` of all rows fed so far."""
    return as_alerts(standing_pairs(feed), threshold, signed=False)
