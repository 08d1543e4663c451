"""Domain views derived from the star schema, in DataFrames and, for the oracle, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planwatch.functions.bands import to_wide
from planwatch.plans.registry import Tables

#: (product, source, version, band, cents): the mean unit price in whole cents. Ten parts are a product, so products grow with the data.
PRICES = """prices AS (SELECT lpad(CAST(l_partkey // 10 AS VARCHAR), 9, '0') AS product, CAST(l_suppkey % 5 AS INT) AS source, CAST(date_trunc('year', l_shipdate) AS DATE) AS version,
  CAST(least(9, (CAST(l_quantity AS BIGINT) - 1) // 5) AS INT) AS band, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) // sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS cents FROM lineitem GROUP BY ALL)"""
#: Two readings: reader B misses some prices and misreads others.
READINGS = PRICES + """, readings AS (SELECT product, source, version, band, CASE WHEN (CAST(product AS INT) * 7 + band + source) % 19 = 3 THEN NULL ELSE cents END AS a,
  CASE WHEN (CAST(product AS INT) * 7 + band) % 17 = 0 THEN NULL WHEN (CAST(product AS INT) * 7 + band) % 17 = 1 THEN cents + 9 ELSE cents END AS b FROM prices)"""
WIDE = PRICES + """, wide AS (SELECT product, source, version, list_transform(range(10), lambda i: map_extract(m, CAST(i AS INT))[1]) AS prices FROM (SELECT product, source, version, map_from_entries(list((band, cents))) AS m FROM prices GROUP BY ALL))"""


def prices(t: Tables) -> DataFrame:
    q = F.col("l_quantity").cast("bigint")
    line = t.lineitem.select(
        F.lpad(F.expr("l_partkey div 10").cast("string"), 9, "0").alias("product"), (F.col("l_suppkey") % 5).cast("int").alias("source"), F.trunc("l_shipdate", "year").alias("version"),
        F.least(F.lit(9), F.floor((q - 1) / 5)).cast("int").alias("band"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("x"), q.alias("q"),
    )
    return line.groupBy("product", "source", "version", "band").agg(F.sum("x").alias("x"), F.sum("q").alias("q")).select("product", "source", "version", "band", F.expr("x div q").alias("cents"))


def readings(t: Tables) -> DataFrame:
    mark = F.col("product").cast("int") * 7 + F.col("band")
    a = F.when((mark + F.col("source")) % 19 != 3, F.col("cents"))
    b = F.when(mark % 17 == 1, F.col("cents") + 9).when(mark % 17 != 0, F.col("cents"))
    return prices(t).select("product", "source", "version", "band", a.alias("a"), b.alias("b"))


def wide(t: Tables) -> DataFrame:
    return to_wide(prices(t), ["product", "source", "version"], price="cents")
