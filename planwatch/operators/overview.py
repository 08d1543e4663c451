"""What a start page shows: figures of all documents, prices, tables and events, in one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def figures(documents: DataFrame, cells: DataFrame, versions: DataFrame, events: DataFrame, today: Column) -> DataFrame:
    """One row over documents (status, with_product, open_with_product, cost), cells (product, status, review, corrected), versions (operator, until, is_current)
    and events (severity, resolved).

    to_review leaves out the columns without a product, which without_product counts: there the product is open, not the price. with_product and automatic_with_product are
    as each document was read, before any review. A table has expired on the day after its last one. Each table is one row before they are joined."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    each = documents.groupBy("status").agg(F.count("*").alias("n"), total("with_product"), total("open_with_product"), total("cost"))
    n = F.struct(F.coalesce("status", F.lit("")).alias("status"), "n")
    docs = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("documents"), F.map_from_entries(F.array_sort(F.collect_list(n))).alias("by_status"), total("with_product"), F.coalesce(F.sum(F.col("with_product") - F.col("open_with_product")), F.lit(0)).alias("automatic_with_product"), total("cost"))
    named, review = F.coalesce("product", F.lit("")) != "", F.coalesce("review", F.lit(False))
    read = cells.agg(
        F.count("*").alias("prices"), F.count_if(F.col("status") == "confirmed").alias("confirmed"), F.count_if(~review & ~F.coalesce("corrected", F.lit(False))).alias("automatic"),
        F.count_if(review & named).alias("to_review"), F.count_if(~named).alias("without_product"),
    )
    current = versions.where("is_current").agg(F.count("*").alias("tables"), F.count_distinct("operator").alias("operators"), F.count_if(F.col("until") < today).alias("expired"))
    open_ = events.agg(F.count_if(~F.coalesce("resolved", F.lit(False)) & (F.col("severity") != "info")).alias("open_events"))
    row = docs.withColumn("_one", F.lit(1))
    for other in (read, current, open_):
        row = row.join(other.withColumn("_one", F.lit(1)), "_one")
    return row.drop("_one")
