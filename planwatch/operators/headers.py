"""Headers of tables: the words above each, and what they say of its columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from planwatch.functions.text import written_registration

#: Shares of the least step between columns: how far a registration, and a word of the header's text, may stand from its column.
REACH, BESIDE = 0.6, 0.5
#: The step of a table with one column.
ALONE = 200.0
#: A header's text is cut to so many characters from its end.
LONGEST = 80


def above(tables: DataFrame, words: DataFrame, page: list[str]) -> DataFrame:
    """(page, table, text, x0, xc, yc, below) of words (page, text, x0, xc, yc) between a table (page, table, top, base, x0, x1) and the lowest one that ends above it at
    the same width; below is the way down to the table. Tables and words meet on their page, where both are few."""
    t = tables.select(*page, "table", "top", "base", "x0", "x1")
    other = t.select(*page, F.col("base").alias("_base"), F.col("table").alias("_other"), F.col("x0").alias("_x0"), F.col("x1").alias("_x1"))
    over = (F.col("_other") != F.col("table")) & (F.col("_base") <= F.col("top")) & (F.col("_x0") < F.col("x1")) & (F.col("x0") < F.col("_x1"))
    limit = t.join(other, page).where(over).groupBy(*page, "table").agg(F.max("_base").alias("_limit"))
    bounded = t.join(limit, [*page, "table"], "left").withColumn("_limit", F.greatest(F.coalesce("_limit", F.lit(0.0)), F.lit(0.0)))
    areas = bounded.select(*page, "table", F.col("top").alias("_top"), "_limit", F.col("x0").alias("_x0"), F.col("x1").alias("_x1"))
    inside = (F.col("yc") >= F.col("_limit") - 2) & (F.col("yc") < F.col("_top")) & F.col("xc").between(F.col("_x0") - 10, F.col("_x1") + 10)
    return words.join(areas, page).where(inside).select(*page, "table", "text", "x0", "xc", "yc", (F.col("_top") - F.col("yc")).alias("below"))


def assigned(columns: DataFrame, words: DataFrame, table: list[str]) -> DataFrame:
    """``columns`` (table, column, x) with registration, the one that holds the column, and header, its text, of header words (table, text, x0, xc, yc, below).

    A registration belongs to the column that is nearest to it, the leftmost of two, at most REACH of the least step between columns away; of several at
    one column the lowest holds it, then the leftmost. The text is that of the other words within BESIDE, line by line; a word
    midway stands in both columns. A column without words has no registration and an empty header. A table's columns travel with its
    words as one short array, so no word is paired with them.
    """
    step = F.col("x") - F.lag("x").over(W.partitionBy(*table).orderBy("x", "column"))
    of = columns.withColumn("_step", step).groupBy(*table).agg(F.coalesce(F.min("_step"), F.lit(ALONE)).alias("_step"), F.array_sort(F.collect_list(F.struct("x", "column"))).alias("_columns"))
    away = lambda c: F.abs(c["x"] - F.col("xc"))
    read = words.join(of, table).withColumn("_registration", written_registration(F.col("text")))
    nearest = F.array_min(F.transform("_columns", lambda c: F.struct(away(c).alias("away"), c["x"].alias("x"), c["column"].alias("column"))))
    near = read.where("_registration is not null").withColumn("_n", nearest).where(F.col("_n.away") <= REACH * F.col("_step"))
    held = near.groupBy(*table, F.col("_n.column").alias("column")).agg(F.min_by("_registration", F.struct("below", "x0", "text")).alias("registration"))
    beside = read.where("_registration is null").withColumn("_c", F.explode(F.filter("_columns", lambda c: away(c) <= BESIDE * F.col("_step"))))
    said = beside.groupBy(*table, F.col("_c.column").alias("column")).agg(F.array_sort(F.collect_list(F.struct(F.bround("yc").alias("line"), "x0", "text"))).alias("_words"))
    header = F.right(F.array_join(F.transform("_words", lambda w: w["text"]), " "), F.lit(LONGEST))
    key = [*table, "column"]
    return columns.join(held, key, "left").join(said.select(*key, header.alias("header")), key, "left").withColumn("header", F.coalesce("header", F.lit("")))
