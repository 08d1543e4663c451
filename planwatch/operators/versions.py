"""Version chains: nothing is overwritten, and what arrives late takes its place by date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from planwatch.functions import bands
from planwatch.operators.matching import match_conditions
from planwatch.session import written


def chains(rows: DataFrame, keys: list[str], at: str, prices: str = "prices", tie: str | None = None) -> DataFrame:
    """Chains of dated price columns: a row whose prices equal those before it confirms them and makes no version.

    Adds version (from 1), confirmed (the last date at which the prices still held), next_at and is_current. The chain depends
    on dates only, not on the order of arrival; of rows with one date the first by ``tie`` counts first."""
    w = W.partitionBy(*keys).orderBy(at, *([tie] if tie else []))
    starts = F.coalesce(~F.lag(prices).over(w).eqNullSafe(F.col(prices)), F.lit(True)) | (F.row_number().over(w) == 1)
    marked = rows.withColumn("_new", starts.cast("int")).withColumn("version", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int"))
    held = marked.withColumn("confirmed", F.max(at).over(W.partitionBy(*keys, "version"))).where("_new = 1").drop("_new")
    by = W.partitionBy(*keys).orderBy("version")
    return held.withColumn("next_at", F.lead(at).over(by)).withColumn("is_current", F.col("next_at").isNull())


def diff(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, old_place, new_place, change, n_changed, variation): equal, changed, added or removed, for old and new columns (keys, tags, prices).

    Columns of one key match by condition, not by position; a band counts as changed where both sides sell it at another price, and variation
    is the median of how much. Columns without a registration are no rows of either."""
    pairs = match_conditions(old, new, keys, order)
    moved = bands.changed(F.col("old.prices"), F.col("new.prices"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.size(moved) == 0, "equal").otherwise("changed")
    both = change.isin("equal", "changed")
    place = lambda side: F.col(f"{side}.{order[0]}")
    return pairs.select(*keys, place("old").alias("old_place"), place("new").alias("new_place"), change.alias("change"), F.when(both, F.size(moved)).alias("n_changed"), F.when(both, bands.middle(bands.variation(F.col("old.prices"), F.col("new.prices")))).alias("variation"))


def reordered(old: DataFrame, new: DataFrame, doc: list[str], product: str, at: str) -> DataFrame:
    """(doc, common, reordered): whether the products that two versions of a document share come in another order of first appearance.

    Orders are compared by neighbours: a product whose successor among the common ones differs shows it, so no list is gathered."""
    first = lambda df, name: df.groupBy(*doc, product).agg(F.min(at).alias(name))
    both = first(old, "_a").join(first(new, "_b"), [*doc, product])
    following = lambda c: F.lead(product).over(W.partitionBy(*doc).orderBy(c, product))
    moved = both.withColumns({"_x": following("_a"), "_y": following("_b")})
    return moved.groupBy(*doc).agg(F.count("*").alias("common"), F.bool_or(~F.col("_x").eqNullSafe(F.col("_y"))).alias("reordered"))


def retired(current: DataFrame, incoming: DataFrame, product: str, condition: str) -> DataFrame:
    """Current rows that the incoming document doesn't have any more, with reason: product_removed, or condition_changed if the
    product is still there under another condition."""
    gone = current.join(incoming.select(product, condition).distinct(), [product, condition], "left_anti")
    there = incoming.select(product).distinct().withColumn("_there", F.lit(True))
    return gone.join(there, product, "left").withColumn("reason", F.when(F.col("_there"), "condition_changed").otherwise("product_removed")).drop("_there")


def neighbours(docs: DataFrame, series: str, at: str, doc: str) -> DataFrame:
    """``docs`` with newest_later, the newest document of the series with a later date, and previous, the last strictly earlier one; of
    documents with one date the largest id."""
    by_date = docs.groupBy(series, at).agg(F.max(doc).alias("_doc"))
    w = W.partitionBy(series).orderBy(at)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    newest = F.last(F.struct(F.col(at).alias("at"), F.col("_doc").alias("doc"))).over(whole)
    placed = by_date.withColumns({"previous": F.lag("_doc").over(w), "_newest": newest})
    placed = placed.withColumn("newest_later", F.when(F.col("_newest.at") > F.col(at), F.col("_newest.doc"))).select(series, at, "previous", "newest_later")
    return docs.join(placed, [series, at])


def corrected(cells: DataFrame, corrections: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Cells with the latest correction of each: an append-only log, read latest-wins."""
    last = corrections.groupBy(*keys).agg(F.max_by("value", at).alias("chosen"))
    return cells.join(last, keys, "left")


def roots(tables: DataFrame, key: str, superseded_by: str, rounds: int = 64) -> DataFrame:
    """``tables`` with root, the oldest table of the history that leads to each: of several that one superseded the largest key is its predecessor.

    Each round doubles how far a table sees back, so a history of n tables takes log2(n) rounds, each a join on the key, written to the shared folder. A table
    whose predecessors lead back to itself has no root, which is an error after ``rounds``.
    """
    before = tables.where(F.col(superseded_by).isNotNull()).groupBy(F.col(superseded_by).alias("_key")).agg(F.max(key).alias("_up"))
    ids = tables.select(F.col(key).alias("_key")).distinct()
    seen = written(ids.join(before, "_key", "left").withColumn("_up", F.coalesce("_up", "_key")), "predecessors")
    for _ in range(rounds):
        further = seen.select(F.col("_key").alias("_up"), F.col("_up").alias("_next"))
        now = written(seen.join(further, "_up", "left").select("_key", F.coalesce("_next", "_up").alias("_up"), (F.col("_next") != F.col("_up")).alias("_moved")), "predecessors")
        seen = now.drop("_moved")
        if now.where("_moved").isEmpty():
            return tables.join(seen.select(F.col("_key").alias(key), F.col("_up").alias("root")), key)
    raise ValueError("a history leads back to itself")
