"""Where users add what the package lacks: rules on price columns, connectors to sources, and a table function for SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

#: name -> function of prices by band (keys, band, price) and the keys, which gives findings (keys, rule, severity, bands).
RULES: dict[str, Callable[[DataFrame, list[str]], DataFrame]] = {}
#: kind -> function of a session and the sources of that kind (source, url, config: map), which gives candidates (source, url, title).
CONNECTORS: dict[str, Callable[[SparkSession, DataFrame], DataFrame]] = {}

SEVERITIES = ("error", "alert", "info")


def rule(name: str):
    """Registers a rule. A name that is there already is an error: what it names is not replaced unseen."""

    def register(f: Callable[[DataFrame, list[str]], DataFrame]):
        if name in RULES:
            raise ValueError(f"there is a rule {name} already")
        RULES[name] = f
        return f

    return register


def connector(kind: str):
    """Registers a connector for sources of a kind."""

    def register(f: Callable[[SparkSession, DataFrame], DataFrame]):
        if kind in CONNECTORS:
            raise ValueError(f"there is a connector for {kind} already")
        CONNECTORS[kind] = f
        return f

    return register


def findings(long: DataFrame, keys: list[str], *others: DataFrame) -> DataFrame:
    """(keys, rule, severity, bands) of all registered rules, and of ``others`` before them. Rules see the same rows, and a severity that isn't one is an error
    of the query, so a rule can't hide what it finds by a misspelt word."""
    names = [*keys, "rule", "severity", "bands"]
    known = F.when(F.col("severity").isin(*SEVERITIES), F.col("severity")).otherwise(F.raise_error(F.concat(F.lit("unknown severity: "), F.coalesce("severity", F.lit("null")))))
    own = [f(long, keys).select(*keys, F.lit(name).alias("rule"), known.cast("string").alias("severity"), F.col("bands").cast("array<int>").alias("bands")) for name, f in RULES.items()]
    return reduce(DataFrame.unionByName, [*(o.select(*names) for o in others), *own])


def candidates(spark: SparkSession, sources: DataFrame) -> DataFrame:
    """(source, url, title) of the sources (source, kind, url, config) whose kind has a connector, each address of a source once."""
    found = [f(spark, sources.where(F.col("kind") == kind)).select("source", "url", "title") for kind, f in CONNECTORS.items()]
    nothing = spark.createDataFrame([], "source string, url string, title string")
    return reduce(DataFrame.unionByName, found, nothing).groupBy("source", "url").agg(F.min("title").alias("title"))


@udtf(returnType="line int, label string, price string")
class PriceLines:
    """A page's text as lines that end in an amount: its number from 0, what stands before the amount, and the amount as written."""

    def eval(self, text: str | None) -> Iterator[tuple[int, str, str]]:
        for i, line in enumerate((text or "").split("\n")):
            words = line.split()
            if len(words) > 1 and any(c.isdigit() for c in words[-1]) and all(c.isdigit() or c in ".," for c in words[-1]):
                yield i, " ".join(w for w in words[:-1] if w != "R$"), words[-1]


def register_sql(spark: SparkSession) -> SparkSession:
    """The session with ``price_lines(text)`` for SQL: SELECT d.doc_id, l.* FROM docs d, LATERAL price_lines(d.text) l."""
    spark.udtf.register("price_lines", PriceLines)
    return spark
