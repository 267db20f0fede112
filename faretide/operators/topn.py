"""The n cheapest items of every run, and how the set and its mean move."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faretide import fixed_values as fv
from faretide.functions.money import arrow, exact, mean_of_sums, pct_change
from faretide.functions.timestamps import minute_text
from faretide.operators.changes import run_series
from faretide.operators.stats import latest
from faretide.plans.runs import run_prices
from faretide.plans.shape import pin, running_total

_RUN = ["dataset", "run_id"]
# Items of one row of a change list.
PART_ITEMS = 10_000


def top_members(
    tagged: DataFrame, n: int = fv.TOP_N, ties: str = "strict", correct_last: bool = False
) -> DataFrame:
    """Members of each run's top n with their position.

    ``strict`` numbers them 1..n, equal prices in name order, but in runs of fewer than n items equal prices
    share a position. ``shared`` gives equal prices one position and lets all of them in at the cut.
    ``correct_last`` rebuilds the newest run of a dataset from the latest row
    of every item, if there are at least n items.
    """
    prices = run_prices(tagged).select(*_RUN, "run_start", "hotel_name", "price")
    if correct_last:
        prices = _with_corrected_last(tagged, prices, n)
    run = Window.partitionBy(*_RUN)
    position = (
        F.row_number().over(run.orderBy("price", "hotel_name"))
        if ties == "strict"
        else F.rank().over(run.orderBy("price"))
    )
    members = prices.withColumn("position", position).filter(F.col("position") <= n)
    if ties == "shared":
        return members
    # At most n rows of each run are left; with fewer, they are the whole run.
    few = F.count(F.lit(1)).over(run) < n
    return members.withColumn("position", F.when(few, F.rank().over(run.orderBy("price"))).otherwise(F.col("position")))


def _with_corrected_last(tagged: DataFrame, prices: DataFrame, n: int) -> DataFrame:
    current = latest(tagged.select("dataset", "hotel_name", "price", "observed_at", "seq", "run_id", "run_start"))
    # One row per dataset, used twice.
    facts = current.groupBy("dataset").agg(
        F.max("run_id").alias("_last_run"),
        F.max("run_start").alias("_last_start"),
        F.count(F.lit(1)).alias("_items"),
    )
    facts = pin(facts.filter(F.col("_items") >= n))
    earlier = prices.join(facts, "dataset", "left").filter(
        F.col("_last_run").isNull() | (F.col("run_id") < F.col("_last_run"))
    )
    rebuilt = current.join(facts, "dataset").select(
        "dataset",
        F.col("_last_run").alias("run_id"),
        F.col("_last_start").alias("run_start"),
        "hotel_name",
        "price",
    )
    return earlier.select(*prices.columns).unionByName(rebuilt)


def topn_index(
    tagged: DataFrame, n: int = fv.TOP_N, ties: str = "strict", correct_last: bool = False
) -> DataFrame:
    """Mean price of the top n per run and its change against the run before; 0 for the first."""
    return index_of(top_members(tagged, n, ties, correct_last), n)


def index_of(members: DataFrame, n: int = fv.TOP_N) -> DataFrame:
    """``topn_index`` from the members of each run.

    Members that share the last position may be more than n; the mean is over
    the n lowest prices, and those beyond all have the highest price.
    """
    spare = F.greatest(F.count(F.lit(1)) - n, F.lit(0))
    total = F.sum(exact(F.col("price"))) - spare.cast("decimal(9,0)") * exact(F.max("price"))
    runs = members.groupBy(*_RUN).agg(
        F.min("run_start").alias("run_start"),
        mean_of_sums(total, F.count(F.lit(1)) - spare).alias("avg_price"),
        F.count(F.lit(1)).alias("members"),
    )
    # One row per run.
    before = F.lag("avg_price").over(Window.partitionBy("dataset").orderBy("run_id"))
    return (
        runs.withColumn("_before", before)
        .withColumn("avg_change", F.coalesce(F.col("avg_price") - F.col("_before"), F.lit(0.0)))
        .withColumn(
            "avg_change_pct",
            F.coalesce(pct_change(F.col("avg_price"), F.col("_before"), on_zero=None), F.lit(0.0)),
        )
        .drop("_before")
    )


def topn_diff(
    tagged: DataFrame, n: int = fv.TOP_N, ties: str = "strict", correct_last: bool = False
) -> DataFrame:
    """Items that entered or left the top n, or changed price in it, from run to run."""
    return diff_of(top_members(tagged, n, ties, correct_last))


def diff_of(members: DataFrame) -> DataFrame:
    """``topn_diff`` from the members of each run."""
    members = members.select("dataset", "run_id", "hotel_name", "price", "position")
    # At most n rows (plus ties) are left of each run, so this window is over a small table.
    newest = F.max("run_id").over(Window.partitionBy("dataset"))
    members = members.withColumn("_newest", newest)
    before = members.filter(F.col("run_id") < F.col("_newest")).select(
        "dataset",
        (F.col("run_id") + 1).alias("run_id"),
        "hotel_name",
        F.col("price").alias("old_price"),
        F.col("position").alias("old_position"),
    )
    both = members.join(before, ["dataset", "run_id", "hotel_name"], "full_outer")
    old, new = F.col("old_price"), F.col("price")
    kind = (
        F.when(new.isNull(), F.lit("left"))
        .when(old.isNull(), F.lit("entered"))
        .when(old != new, F.lit("repriced"))
    )
    return (
        both.filter(F.col("run_id") > 1)
        .withColumn("kind", kind)
        .filter(F.col("kind").isNotNull())
        .select(
            "dataset",
            "run_id",
            "hotel_name",
            "kind",
            "old_price",
            F.col("price").alias("new_price"),
            (new - old).alias("price_change"),
            pct_change(new, old, on_zero=None).alias("price_change_pct"),
            F.coalesce("position", "old_position").cast("bigint").alias("position"),
        )
    )


def change_lists(diff: DataFrame) -> DataFrame:
    """Per run the repriced, new and removed items as arrays; at most 2n entries a run if ties are strict."""

    def listed(kind: str, *fields) -> F.Column:
        entry = F.struct(F.col("position"), F.col("hotel_name").alias("name"), *fields)
        return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, entry)))

    old = F.col("old_price").alias("old_price")
    new = F.col("new_price").alias("new_price")
    return diff.groupBy(*_RUN).agg(
        listed(
            "repriced",
            old,
            new,
            F.col("price_change").alias("change"),
            F.col("price_change_pct").alias("change_percent"),
        ).alias("price_changes"),
        listed("entered", F.col("new_price").alias("price")).alias("new_hotels"),
        listed("left", F.col("old_price").alias("price")).alias("removed_hotels"),
    )


def hover_records(
    tagged: DataFrame, n: int = fv.TOP_N, correct_last: bool = False, tz: str = "UTC"
) -> DataFrame:
    """Per run: title, mean, its change, the change lists and whether nothing changed."""
    members = pin(top_members(tagged, n, "strict", correct_last))
    index, lists = index_of(members, n), change_lists(diff_of(members))
    named = ("price_changes", "new_hotels", "removed_hotels")
    joined = index.join(lists, _RUN, "left")
    empty = [F.coalesce(F.size(c), F.lit(0)) <= 0 for c in named]
    moved = F.col("avg_change") != 0
    return joined.select(
        *_RUN,
        F.concat(
            F.lit((fv.TOP_TITLE % (n, "")).rstrip(")")), minute_text(F.col("run_start"), tz), F.lit(")")
        ).alias("title"),
        "avg_price",
        F.when(moved, F.struct(arrow(F.col("avg_change")).alias("arrow"), "avg_change", "avg_change_pct")).alias(
            "avg_move"
        ),
        *named,
        (empty[0] & empty[1] & empty[2] & ~moved).alias("no_changes"),
    )


def trend_index(tagged: DataFrame) -> DataFrame:
    """Mean percentage change of items also seen, at a positive price, in the run before."""
    compared = F.col("follows") & (F.col("old_price") > 0)
    change = pct_change(F.col("new_price"), F.col("old_price"))
    runs = run_series(tagged).groupBy(*_RUN).agg(
        F.min("changed_at").alias("run_start"),
        F.avg(F.when(compared, change)).alias("avg_change_pct"),
        F.count_if(compared).alias("compared_items"),
        F.count(F.lit(1)).alias("items"),
    )
    return runs.filter(F.col("compared_items") > 0)


def trend_changes(tagged: DataFrame, part_items: int = PART_ITEMS) -> DataFrame:
    """The items behind each point of the trend index, in name order, in parts of ``part_items`` items.

    One row per run and part with ``price_changes(position, name, old_price, new_price, change_percent)``. Positions count from 1 over
    the whole run, whose items may lie in many tasks, so parts follow each other and no row holds an unbounded run.
    """
    compared = run_series(tagged).filter(F.col("follows") & (F.col("old_price") > 0))
    placed = running_total(
        compared.select(*_RUN, "hotel_name", "changed_at", "old_price", "new_price"), F.lit(1), _RUN, ["hotel_name"], "_position"
    )
    entry = F.struct(
        F.col("_position").alias("position"),
        F.col("hotel_name").alias("name"),
        "old_price",
        "new_price",
        pct_change(F.col("new_price"), F.col("old_price")).alias("change_percent"),
    )
    part = F.floor((F.col("_position") - 1) / part_items).cast("int")
    return placed.groupBy(*_RUN, part.alias("part")).agg(
        F.min("changed_at").alias("run_start"), F.array_sort(F.collect_list(entry)).alias("price_changes")
    )
