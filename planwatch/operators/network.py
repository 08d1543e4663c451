"""Hospital networks: summaries of links and lists of change requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def active(links: DataFrame, end: str) -> DataFrame:
    return links.where(F.coalesce(F.col(end).cast("string"), F.lit("")) == "")


def summary(links: DataFrame, plan: str, region: str, hospital: str, urgent: Column) -> DataFrame:
    """Distinct hospitals, and those with an emergency ward, for each plan and region."""
    once = links.groupBy(plan, region, hospital).agg(F.max(urgent.cast("int")).alias("u"))
    return once.groupBy(plan, region).agg(F.count(hospital).alias("hospitals"), F.sum(F.when(F.col(hospital).isNotNull(), F.col("u")).otherwise(0)).cast("bigint").alias("urgent"))


def one_row_each(links: DataFrame, keys: list[str], best: Column, columns: list[str]) -> DataFrame:
    """One row for each hospital: the columns of the link that ``best`` puts last."""
    return links.groupBy(*keys).agg(F.max_by(F.struct(*columns), best).alias("r")).select(*keys, "r.*")


def totals(summaries: DataFrame, plan: str, region: str) -> DataFrame:
    """Hospitals of a plan over all regions, and the map of its regions."""
    return summaries.groupBy(plan).agg(F.sum("hospitals").alias("hospitals"), F.sum("urgent").alias("urgent"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(region), "hospitals")))).alias("by_region"))


def changes(requests: DataFrame, protocol: str, order: str, sides: dict[str, tuple[Column, str]]) -> DataFrame:
    """For each protocol the distinct names of each side in order of first mention. sides: name of the list -> (which rows, column)."""
    lists = {}
    for name, (which, column) in sides.items():
        ordered = F.array_sort(F.collect_list(F.when(which, F.struct(F.col(order), F.col(column)))))
        lists[name] = F.array_distinct(ordered[column])
    return requests.groupBy(protocol).agg(*[c.alias(k) for k, c in lists.items()])


def approved(requests: DataFrame, today: Column, region: str | None = None, ahead: bool = False, days: int = 90) -> DataFrame:
    """Requests (result, effective, region_out, region_in, ...) that were granted and are in force since at most ``days`` days, or will be; of one
    region on either side if given, and only those still ahead if asked for."""
    kept = requests.where(F.lower("result").startswith("deferid") & (F.col("effective") >= F.date_sub(today, days)))
    if region:
        kept = kept.where((F.col("region_out") == region) | (F.col("region_in") == region))
    return kept.where(F.col("effective") >= today) if ahead else kept


def of_plans(requests: DataFrame, plans: DataFrame, key: str = "plan") -> DataFrame:
    """The requests of the plans asked for: the reading of a register can drop the others before anything else."""
    return requests.join(plans.select(key).distinct(), key, "left_semi")


def municipality(links: DataFrame, names: DataFrame, code: str = "code", name: str = "municipality") -> DataFrame:
    """``links`` with the name of each row's municipality: its own, else the register's (code, name), else the code itself."""
    known = names.select(F.col("code").alias(code), F.col("name").alias("_name"))
    own = F.nullif(F.trim(F.coalesce(name, F.lit(""))), F.lit(""))
    return links.join(known, code, "left").withColumn(name, F.coalesce(own, "_name", F.col(code).cast("string"))).drop("_name")
