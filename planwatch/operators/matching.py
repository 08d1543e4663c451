"""Greedy one-to-one matching: of all edges the best goes first, then the best of those that both ends still allow.

The order of edges is strict and total. So an edge that is the best of both its ends is taken, whatever else happens: each round takes
all such edges and drops those that touch them, until none is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from planwatch.functions import bands, tags
from planwatch.session import written


def greedy(edges: DataFrame, group: list[str], left: str, right: str, order: list[Column]) -> DataFrame:
    """The matched rows of ``edges`` (group, left, right, what ``order`` needs). Groups match side by side.

    Rounds stop when no edge is left, after the smaller side's number of them at most. Each round is written to the shared
    folder, so the plan doesn't grow with the rounds; so are the edges, which each round reads twice.
    """
    taken, rest = None, written(edges, "edges")
    while True:
        best = lambda side: F.row_number().over(W.partitionBy(*group, side).orderBy(*order))
        ranked = rest.withColumns({"_l": best(left), "_r": best(right)})
        now = written(ranked.where("_l = 1 and _r = 1").drop("_l", "_r"), "matched")
        if now.isEmpty():
            return taken if taken is not None else now
        taken = now if taken is None else taken.unionByName(now)
        rest = rest.join(now.select(*group, left), [*group, left], "left_anti").join(now.select(*group, right), [*group, right], "left_anti")
        rest = written(rest, "edges")


def _numbered(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("place", F.row_number().over(W.partitionBy(*group).orderBy(*order)) - 1)


def placed(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``df``, written, with place: the number of each row in its group, from 0, by ``order``, for groups too large for one task.

    All rows are sorted by ranges side by side. The part of a group that a range has is numbered on from the parts before it; nulls of a group's columns are alike."""
    ids = written(df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("_id", F.monotonically_increasing_id()), "placed")
    ids = ids.withColumn("_part", F.shiftright("_id", 33))  # the number of the range, as monotonically_increasing_id states it
    w = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = ids.groupBy(*group, "_part").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    parts = parts.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(group)], F.col("_part").alias("_of"), (F.col("_before") - F.col("_first")).alias("_shift"))
    on = F.col("_part") == F.col("_of")
    for i, c in enumerate(group):
        on = on & F.col(c).eqNullSafe(F.col(f"_{i}"))
    return ids.join(F.broadcast(parts), on).select(*df.columns, (F.col("_id") + F.col("_shift")).cast("int").alias("place"))


_WIDE = 1 << 40  # more than any two places are apart


def _best(options: DataFrame, node: list[str]) -> DataFrame:
    """(node, key, low): the key of each row's best edges, and whether one of them leads to a lower place, or to the same one from the right.

    Of each kind a row meets the nearest places of the other side, below and above it; no pairs are listed."""
    up, down = W.partitionBy("kind").orderBy("place", "side"), W.partitionBy("kind").orderBy(F.desc("place"), F.desc("side"))
    near = lambda side, w: F.last(F.when(F.col("side") == side, F.col("place")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    met = options.withColumns({"_b0": near(0, up), "_b1": near(1, up)}).withColumns({"_a0": near(0, down), "_a1": near(1, down)})
    other = lambda c: F.when(F.col("side") == 0, F.col(f"{c}1")).otherwise(F.col(f"{c}0"))
    shift = F.col("common").cast("bigint") * _WIDE
    keys = met.groupBy(*node).agg(F.min(F.col("place") - other("_b") - shift).alias("_lo"), F.min(other("_a") - F.col("place") - shift).alias("_hi"))
    key = F.least("_lo", "_hi")
    return keys.where(key.isNotNull()).select(*node, key.alias("key"), F.coalesce(F.col("_lo") == key, F.lit(False)).alias("low"))


def _sure(best: DataFrame, group: list[str]) -> DataFrame:
    """(group, i, j) of the edges that come first at both ends, or will once those before them in their chain are taken.

    Rows whose best edges are alike and lead to each other make a chain of equal steps, whose edges are taken by turns from its lower end. A chain whose lower
    end has an equal edge to a row outside it waits: that row has a better edge and may lose it."""
    far = F.pmod("key", F.lit(_WIDE))
    step = lambda same, apart: F.when(far == 0, same).otherwise(apart)
    at = best.withColumn("_at", step(F.col("side").cast("bigint"), F.floor(F.try_divide(F.col("place"), far))))
    chain = at.withColumns({"_from": step(F.col("place"), F.try_mod(F.col("place"), far)), "_turn": step(F.lit(0), (F.col("side") + F.col("_at")) % 2)})
    own = [*group, "key", "_from", "_turn"]
    w = W.partitionBy(*own).orderBy("_at")
    begins = F.when(F.col("low") & F.coalesce(F.lag("_at").over(w) == F.col("_at") - 1, F.lit(False)), 0).otherwise(1)
    runs = chain.withColumn("_begins", begins).withColumn("_run", F.sum("_begins").over(w.rowsBetween(W.unboundedPreceding, 0)))
    w = W.partitionBy(*own, "_run").orderBy("_at")
    taken = runs.withColumns({"_n": F.row_number().over(w), "_waits": F.first("low").over(w)}).where("_n % 2 = 0 and not _waits")
    side = lambda s: F.when(F.col("side") == s, F.col("place")).otherwise(F.col("place") - far)
    return taken.select(*group, side(0).alias("i"), side(1).alias("j"))


def _matched_places(a: DataFrame, b: DataFrame, group: list[str]) -> DataFrame:
    """(group, i, j): the greedy matching of rows (group, i, tags) and (group, j, tags) by tags in common, distance and places, without listing the edges.

    Rows of one place and side are one a group. What two rows have in common depends on their tags alone, so edges are of as many kinds as
    compatible tags meet in a group, and a row's best edge of a kind is to its nearest place. Each round takes the best edges of all rows that are sure; of
    equal ones a whole chain at once, so that rounds grow with the chains of ever longer distances, not with the rows."""
    tagged = a.select(*group, F.col("tags").alias("_ta")).distinct().join(b.select(*group, F.col("tags").alias("_tb")).distinct(), group)
    common = F.size(F.array_intersect("_ta", "_tb"))
    kinds = written(tagged.where(tags.compatible(F.col("_ta"), F.col("_tb"))).withColumns({"common": common, "kind": F.monotonically_increasing_id()}), "kinds")
    node = [*group, "side", "place"]
    of = lambda rows, side, place, own: rows.join(kinds.withColumnRenamed(own, "tags"), [*group, "tags"]).select(*group, F.lit(side).alias("side"), F.col(place).cast("bigint").alias("place"), "kind", "common")
    rest = written(of(a, 0, "i", "_ta").unionByName(of(b, 1, "j", "_tb")), "edges")
    taken = None
    while True:
        now = written(_sure(_best(rest, node), group), "matched")
        if now.isEmpty():
            return now if taken is None else taken
        taken = now if taken is None else taken.unionByName(now)
        ends = now.select(*group, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("i").alias("place")), F.struct(F.lit(1).alias("side"), F.col("j").alias("place")))).alias("e")).select(*group, "e.*")
        rest = written(rest.join(ends, node, "left_anti"), "edges")


def match_conditions(old: DataFrame, new: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """(group, old, new) with structs of the rows of either side, ``tags`` among them; one side null for what stays over.

    Only compatible tags match: the most tags in common first, then the nearest place, then the first places.
    """
    a = _numbered(old, group, order).select(*group, F.col("place").alias("i"), F.struct(*old.columns).alias("old"))
    b = _numbered(new, group, order).select(*group, F.col("place").alias("j"), F.struct(*new.columns).alias("new"))
    pairs = _matched_places(a.select(*group, "i", "old.tags"), b.select(*group, "j", "new.tags"), group).select(*group, F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"))
    matched = a.join(pairs, [*group, "i"]).join(b, [*group, "j"]).select(*group, "old", "new")
    only_old = a.join(pairs, [*group, "i"], "left_anti").select(*group, "old", F.lit(None).cast(b.schema["new"].dataType).alias("new"))
    only_new = b.join(pairs, [*group, "j"], "left_anti").select(*group, F.lit(None).cast(a.schema["old"].dataType).alias("old"), "new")
    return matched.unionByName(only_old).unionByName(only_new)


def match_readings(a: DataFrame, b: DataFrame, group: list[str]) -> DataFrame:
    """(group, i, j, equal) of two readers' columns (group, place, page, prices): by the number of equal prices, at least 3 on one page
    and 8 on neighbouring pages. Ties go to the smaller distance of pages, then to the largest places."""
    left = a.select(*group, F.col("place").alias("i"), F.col("page").alias("pa"), F.col("prices").alias("xa"))
    right = b.select(*group, F.col("place").alias("j"), F.col("page").alias("pb"), F.col("prices").alias("xb"))
    gap = F.abs(F.col("pa") - F.col("pb"))
    beside = left.withColumn("pb", F.explode(F.array(F.col("pa") - 1, F.col("pa"), F.col("pa") + 1)))  # so that only neighbouring pages meet
    equal, same = bands.agreement(F.col("xa"), F.col("xb")), gap == 0
    may = bands.may_agree(F.col("xa"), F.col("xb"), 8) | (same & bands.may_agree(F.col("xa"), F.col("xb"), 3))
    enough = F.when(may, equal >= F.when(same, 3).otherwise(8)).otherwise(False)  # few pairs may agree: only these are counted, once each
    edges = beside.join(right, [*group, "pb"]).where(enough).select(*group, "i", "j", equal.alias("equal"), gap.alias("gap"))
    return greedy(edges, group, "i", "j", [F.desc("equal"), F.col("gap"), F.desc("i"), F.desc("j")])


def first_of_signature(rows: DataFrame, signature: list[str], order: list[str]) -> DataFrame:
    """``rows`` with is_first: whether no earlier row has the same signature, nulls alike."""
    return rows.withColumn("is_first", F.row_number().over(W.partitionBy(*signature).orderBy(*order)) == 1)


def leftovers(rows: DataFrame, matched: DataFrame, group: list[str], signature: list[str], order: list[str]) -> DataFrame:
    """The rows (group, place, ...) that no match took, with repeated: whether a taken row, or an earlier one of them, has the same signature. Repeated
    ones are copies to drop, and their number is what is told of them; the others are columns that one reader alone has read."""
    taken = matched.select(*group, F.col("j").alias("place")).withColumn("_taken", F.lit(True))
    marked = rows.join(taken, [*group, "place"], "left").withColumn("_taken", F.coalesce("_taken", F.lit(False)))
    first = F.row_number().over(W.partitionBy(*group, *signature).orderBy(F.desc("_taken"), *order))
    return marked.withColumn("repeated", first > 1).where("not _taken").drop("_taken")
