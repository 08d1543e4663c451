"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact budgets. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from planwatch.llm.common import WORD, Numbered, documents, written

WEIGHTS = (5, 2, 1)
TOTAL = 1.5  # of all sizes
MOST = 2  # times a source's size


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: int = MOST) -> DataFrame:
    """(source, source_size, target) of a table (source, source_size) with a row for each source.

    Sources in order of code points, null last, get the weights in turn. A target is the level times the weight, up to
    ``most`` times the size: sorted by cap over weight, the level is what the uncapped rest shares, at the first source that it doesn't cap.
    """
    cap = F.col("source_size") * most
    ranked = sizes.withColumn("place", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")))
    order = W.orderBy((cap / F.col("weight")).asc(), F.col("place"))
    below, rest = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    goal = F.sum("source_size").over(W.partitionBy()).cast("double") * F.lit(total)
    level = (goal - F.coalesce(F.sum(cap).over(below), F.lit(0))) / F.sum("weight").over(rest)
    levels = ranked.withColumn("level", F.when(level * F.col("weight") <= cap, level))
    levels = levels.withColumn("level", F.first("level", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return levels.select("source", "source_size", F.least(cap.cast("double"), F.coalesce(F.col("level") * F.col("weight"), cap.cast("double"))).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: int = MOST, seed: str = "mix", row_col: str | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of ``docs``, and row, the column ``row_col`` that numbers rows, if there is one.

    Each source runs through its documents in hash-random order, whole epochs first; the last epoch is cut at the exact
    budget (the target rounded down), inside a document if need be. ``taken`` is the number of words that the mix takes,
    repeats counted: whole copies, then the first words of one more.

    The order is that of md5(seed, doc_id). Its first three hex digits part a source into up to 4,096 ranges, so that no
    task sorts a whole source: a range sums its own rows and starts from the sum of the ranges before it, of which there is a
    row each. Null and empty texts have size 0 and are never taken. Null sources are one source, last in order. Rows with equal
    doc_id, and those without one, stand side by side, shorter first, then by row; identical rows may swap places. Words are counted
    once, in a table of narrow rows. An empty table gives no rows.
    """
    row = F.col(row_col) if row_col else F.lit(0).cast("bigint")
    rows = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), row.alias("row")), "sizes")
    rows = rows.withColumn("key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))).withColumn("range", F.substring("key", 1, 3))
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    goals = targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, total, most)
    before = F.sum("range_size").over(W.partitionBy("source").orderBy("range")) - F.col("range_size")
    starts = ranges.withColumn("before", before).alias("r").join(goals.alias("g"), F.col("r.source").eqNullSafe(F.col("g.source"))).select("r.source", "range", "before", "source_size", "target")
    within = F.sum("size").over(W.partitionBy("source", "range").orderBy("key", F.col("doc_id"), "size", "row").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    placed = rows.withColumn("within", within).alias("d").join(starts.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.range") == F.col("s.range")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    budget = F.floor(F.col("target")) - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), budget - F.col("before") - F.col("within")))
    return placed.select("doc_id", "size", "source_size", "target", (epochs * F.col("size") + part).cast("bigint").alias("taken"), *(["row"] if row_col else []))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns over all documents, as ``mix`` says it for nulls, ties and repeated rows."""
    return mix(documents(spark, sf_dir))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """Pipeline stage: each row as often as the mix takes it; where the budget ends inside one, its first words.

    A row that the mix takes twice comes twice, one that it leaves out doesn't; null and empty texts have nothing to take and go. Rows are
    told apart by their number, not by doc_id, so rows that share an id, and those without one, each get their own share. n_chars is
    counted anew where a text was cut. Other columns stay, whatever their names; an empty table gives no rows.
    """
    own = Numbered(docs, "to-mix")
    text, n_chars = own.of("text"), own.of("n_chars")
    taken = mix(own.rows, own.of("doc_id"), text, own.of("source"), row_col="row").where("taken > 0").select("row", "taken", "size")
    whole, rest = F.expr("cast(taken div size as int)"), F.expr("cast(taken % size as int)")
    copies = own.rows.join(taken, "row").withColumn("words", F.explode(F.concat(F.array_repeat(F.lit(-1), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))))
    # The first words of a text, with the white space between them.
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), 1, F.greatest("words", F.lit(1))), "")
    kept = copies.withColumn("cut", F.when(F.col("words") >= 0, cut))
    return own.named(kept.withColumns({text: F.coalesce("cut", text), n_chars: F.when(F.col("cut").isNull(), F.col(n_chars)).otherwise(F.length("cut")).cast(docs.schema["n_chars"].dataType)}))


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 2 AS cap FROM s),
l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 - coalesce(CAST(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0))
     / CAST(sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM w),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), (SELECT arg_min(level, (cap / weight, place)) FROM l WHERE level * weight <= cap) * weight) AS target FROM l),
p AS (SELECT doc_id, size, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(
  (CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END) * size
  + greatest(0, least(size, floor(target) - (CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END) * source_size - before)) AS BIGINT) AS taken
FROM p
"""
