"""Ten age bands: a price column is an array of ten nullable prices, or ten rows."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The legal bands.
LABELS = ("00-18", "19-23", "24-28", "29-33", "34-38", "39-43", "44-48", "49-53", "54-58", "59+")
BANDS = len(LABELS)


def band_of_age(age: Column) -> Column:
    """Up to 18 is band 0, then one for each five years, 59 and more band 9; null outside 0 to 120."""
    return F.when(age.between(0, 120), F.when(age <= 18, 0).otherwise(F.least(F.lit(9), F.floor((age - 14) / 5)))).cast("int")


def padded(prices: Column) -> Column:
    """Exactly ten values: cut, or filled with nulls."""
    return F.slice(F.concat(prices, F.array_repeat(F.lit(None), BANDS)), 1, BANDS)


def to_wide(long: DataFrame, keys: list[str], band: str = "band", price: str = "price") -> DataFrame:
    """One row for each column, ``prices`` in order of band, null where there is none; of repeated bands the least price."""
    by_band = F.map_from_entries(F.collect_list(F.struct(band, price)))
    once = long.groupBy(*keys, band).agg(F.min(price).alias(price))
    return once.groupBy(*keys).agg(by_band.alias("m")).select(*keys, F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.try_element_at("m", b)).alias("prices"))


def to_long(wide: DataFrame, keys: list[str], prices: str = "prices") -> DataFrame:
    return wide.select(*keys, F.posexplode(prices).alias("band", "price")).where(F.col("price").isNotNull())


def present(prices: Column) -> Column:
    return F.filter(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.get(prices, b).isNotNull())


def is_complete(prices: Column) -> Column:
    """Sold from some band on to the last one, without holes."""
    p = present(prices)
    return F.when(F.size(p) > 0, F.size(p) == F.lit(BANDS) - F.array_min(p)).otherwise(False)


def unread(prices: Column) -> Column:
    """The bands without a price behind the first that has one."""
    p = present(prices)
    return F.when(F.size(p) > 0, F.array_except(F.sequence(F.array_min(p), F.lit(BANDS - 1)), p)).otherwise(F.array().cast("array<int>"))


def changed(old: Column, new: Column, least: float = 0.005) -> Column:
    """The bands that both sides sell at prices ``least`` or more apart."""
    differ = lambda b: F.coalesce(F.abs(F.get(old, b) - F.get(new, b)) >= least, F.lit(False))
    return F.filter(F.sequence(F.lit(0), F.lit(BANDS - 1)), differ)


def variation(old: Column, new: Column, least: float = 0.005) -> Column:
    """The ratios, less one, of the prices of the changed bands; a band that was free has none."""
    ratio = lambda b: F.try_divide(F.get(new, b).cast("double"), F.get(old, b).cast("double")) - 1
    return F.filter(F.transform(changed(old, new, least), ratio), lambda x: x.isNotNull())


def middle(values: Column) -> Column:
    """The exact median of an array of numbers; null of an empty one."""
    v, n = F.array_sort(values), F.size(values)
    at = lambda i: F.get(v, i.cast("int"))
    return F.when(n > 0, (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2)


def agreement(a: Column, b: Column, least: float = 0.005) -> Column:
    """How many bands both have with the same price."""
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.coalesce(F.abs(F.get(a, i) - F.get(b, i)) < least, F.lit(False))))


def may_agree(a: Column, b: Column, n: int, least: float = 0.005) -> Column:
    """Whether one of the bands agrees of which one must if ``n`` do; null or false if not. It is compiled and far quicker than ``agreement``."""
    one = [F.abs(F.get(a, F.lit(i)) - F.get(b, F.lit(i))) < least for i in range(BANDS - n + 1)]
    return reduce(or_, one)
