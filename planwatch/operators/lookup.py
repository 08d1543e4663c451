"""Look-ups: top-1, as-of, intervals, nearest neighbours, semi and anti joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from planwatch.functions.tags import compatible


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def last_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key, in load order: an upsert."""
    return first_by(rows, keys, [c.desc() for c in order])


def as_of(materials: DataFrame, notes: DataFrame, key: str, at: str, noted: str) -> DataFrame:
    """``materials`` with note_date: the latest note at or before ``at``, else the earliest of the key; the latest of all for a material
    without a date; null without notes.

    Both sides go through one window, notes first on equal dates, so nothing is paired with more than one row.
    """
    m = materials.withColumns({"_at": F.col(at), "_kind": F.lit(1), "_note": F.lit(None).cast(notes.schema[noted].dataType)})
    n = notes.select(F.col(key), F.col(noted).alias("_at"), F.lit(0).alias("_kind"), F.col(noted).alias("_note"))
    w = W.partitionBy(key)
    both = m.unionByName(n, allowMissingColumns=True)
    before = F.last("_note", ignorenulls=True).over(w.orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, 0))
    found = both.withColumn("note_date", F.when(F.col("_at").isNull(), F.max("_note").over(w)).otherwise(F.coalesce(before, F.min("_note").over(w))))
    return found.where("_kind = 1").drop("_at", "_kind", "_note")


def plausible(materials: DataFrame, notes: DataFrame, key: str, at: str, noted: str, before: int = 365, after: int = 180) -> DataFrame:
    """(materials, note_date) for each note from ``before`` days before the material to ``after`` days behind it; else that of ``as_of``.

    Dates fall into cells as long as the interval; a material looks into the two or three cells that its own touches."""
    width = before + after
    day = lambda c: F.unix_date(c)
    m = materials.withColumn("_id", F.struct(*materials.columns)).distinct()
    lo, hi = day(F.col(at)) - before, day(F.col(at)) + after
    cells = m.withColumn("_cell", F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width))))
    n = notes.select(F.col(key), F.col(noted).alias("note_date"), F.floor(day(F.col(noted)) / width).alias("_cell"))
    hit = cells.join(n, [key, "_cell"]).where(day(F.col("note_date")).between(lo, hi)).select(*materials.columns, "note_date").distinct()
    missed = m.join(hit.select(*materials.columns).distinct(), materials.columns, "left_anti").select(*materials.columns)
    return hit.unionByName(as_of(missed, notes, key, at, noted))


def nearest(points: DataFrame, anchors: DataFrame, page: list[str], x: str, anchor_x: str, within: float, order: list[Column]) -> DataFrame:
    """Each point with its nearest anchor of the same page at most ``within`` away; points without one go. Cells of that width make the join an equality."""
    p = points.withColumn("_cell", F.explode(F.array(*[(F.floor(F.col(x) / within) + d) for d in (-1, 0, 1)])))
    a = anchors.withColumn("_cell", F.floor(F.col(anchor_x) / within))
    pairs = p.join(a, [*page, "_cell"]).drop("_cell").withColumn("distance", F.abs(F.col(x) - F.col(anchor_x))).where(F.col("distance") <= within)
    return first_by(pairs, points.columns, [F.col("distance"), *order])


def other_sources(rows: DataFrame, key: str, source: list[str], place: str) -> DataFrame:
    """(key, own, peer) as structs: each row (key, source, place, tags) with the row of the same key in each other source that is to be compared with it.

    Only compatible tags compare; of several rows of a source the one with the most tags in common counts, then the nearest place, then the
    first. A key's rows meet by an equality, and each keeps one row for each other source."""
    a = rows.select(key, F.struct(*rows.columns).alias("own"), F.struct(*source).alias("_a"))
    b = rows.select(key, F.struct(*rows.columns).alias("peer"), F.struct(*source).alias("_b"))
    pairs = a.join(b, key).where((F.col("_a") != F.col("_b")) & compatible(F.col("own.tags"), F.col("peer.tags")))
    common, gap = F.size(F.array_intersect("own.tags", "peer.tags")), F.abs(F.col(f"own.{place}") - F.col(f"peer.{place}"))
    return pairs.groupBy(key, "own", "_b").agg(F.min_by("peer", F.struct(-common, gap, F.col(f"peer.{place}"))).alias("peer")).select(key, "own", "peer")


def not_yet(candidates: DataFrame, raised: DataFrame, key: list[str]) -> DataFrame:
    """The candidates whose idempotency key wasn't raised before, one for each key."""
    return candidates.dropDuplicates(key).join(raised.select(*key).distinct(), key, "left_anti")
