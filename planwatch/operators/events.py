"""Events: findings, divergences, newer notes and network changes, each raised once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from planwatch.functions.text import written_date
from planwatch.operators.lookup import not_yet
from planwatch.operators.versions import neighbours

#: Which event a rule's findings become.
EVENT_OF_RULE = {"unknown_plan": "plan", "suspended": "plan", "not_active": "plan", "operator_cancelled": "operator", "off_pattern": "reference", "below_minimum": "reference", "out_of_band": "reference", "newer_note": "reference"}


def of_findings(findings: DataFrame) -> DataFrame:
    """(doc, type, severity, n, title) of findings (doc, rule, severity, message): one event for each type and severity, equal messages once."""
    types = F.create_map(*[F.lit(x) for kv in EVENT_OF_RULE.items() for x in kv])
    kind = F.coalesce(F.try_element_at(types, F.col("rule")), F.lit("table"))
    n = F.count_distinct("message")
    title = F.when(n == 1, F.min("message")).otherwise(F.concat(n.cast("string"), F.lit(" findings")))
    return findings.withColumn("type", kind).groupBy("doc", "type", "severity").agg(n.alias("n"), title.alias("title"))


def of_divergences(pairs: DataFrame) -> DataFrame:
    """(doc, other, n, variation, title) of divergences (doc, other, variation as a ratio less one), by the other source."""
    m, n = F.median("variation"), F.count("*")
    way = F.when(m > 0, "dearer").when(m < 0, "cheaper").otherwise("mixed")
    return pairs.groupBy("doc", "other").agg(n.alias("n"), m.alias("variation"), F.concat(n.cast("string"), F.lit(" columns, "), way).alias("title"))


def of_newer_notes(published: DataFrame, notes: DataFrame, raised: DataFrame, days: int = 30) -> DataFrame:
    """(key, doc, n) of published (doc, product, dated) whose product has a note (product, noted) over ``days`` later: one event for each
    document and latest note, key doc:date, unless raised (key) before."""
    last = notes.groupBy("product").agg(F.max("noted").alias("noted"))
    late = published.join(last, "product").where(F.datediff("noted", "dated") > days)
    each = late.groupBy("doc").agg(F.count_distinct("product").alias("n"), F.max("noted").alias("noted"))
    return not_yet(each.withColumn("key", F.concat_ws(":", F.col("doc").cast("string"), F.col("noted").cast("string"))), raised, ["key"]).select("key", "doc", "n")


def of_network_changes(changes: DataFrame, published: DataFrame, raised: DataFrame) -> DataFrame:
    """(protocol, plans, severity) of approved changes (protocol, plan, included): one event for each protocol over the published plans (plan),
    an alert if no hospital takes the place of those excluded."""
    held = changes.join(published.select("plan").distinct(), "plan", "left_semi")
    substitute = F.max((F.size("included") > 0).cast("int")) == 1
    each = held.groupBy("protocol").agg(F.count_distinct("plan").alias("plans"), F.when(substitute, "info").otherwise("alert").alias("severity"))
    return not_yet(each, raised, ["protocol"])


def of_captures(new: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc, kind, message) of newly collected documents (doc, series, dated, notes) against all of their series (doc, series, dated, status):
    ``older`` if the series has a later one, whose date the message gives, ``version`` if it has an earlier one, else ``first``. Discarded documents
    and those that failed don't count as later."""
    placed = neighbours(docs.where(~F.col("status").isin("discarded", "error")).select("series", "dated", "doc"), "series", "dated", "doc")
    later = placed.select("doc", "newest_later").join(docs.select(F.col("doc").alias("newest_later"), F.col("dated").alias("_later")), "newest_later", "left")
    earlier = neighbours(docs.select("series", "dated", "doc"), "series", "dated", "doc").select("doc", "previous").join(docs.select(F.col("doc").alias("previous"), F.col("dated").alias("_before")), "previous", "left")
    both = new.join(later.select("doc", "_later"), "doc", "left").join(earlier.select("doc", "_before"), "doc", "left")
    kind = F.when(F.col("_later").isNotNull(), "older").when(F.col("_before").isNotNull(), "version").otherwise("first")
    said = (
        F.when(F.col("_later").isNotNull(), F.concat(F.lit("version of "), written_date(F.col("dated")), F.lit(", before that of "), written_date(F.col("_later"))))
        .when(F.col("_before").isNotNull(), F.concat(F.lit("new version; the one before is of "), written_date(F.col("_before"))))
        .otherwise(F.lit("not seen before"))
    )
    return both.select("doc", kind.alias("kind"), F.concat_ws("; ", said, F.array_join("notes", "; ")).alias("message"))


def of_runs(runs: DataFrame) -> DataFrame:
    """(run, kind, message) of runs (run, capture, at, outcome, message, found, complete): a failed run, and one that found nothing where the latest
    earlier one that ended well found something, if the capture lists all there is (complete)."""
    w = W.partitionBy("capture").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    before = F.last(F.when((F.col("outcome") == "ok") & (F.col("found") > 0), F.col("found")), ignorenulls=True).over(w)
    placed = runs.withColumn("_before", before)
    broke = (F.col("outcome") == "ok") & (F.col("found") == 0) & F.col("complete") & F.col("_before").isNotNull()
    kind = F.when(F.col("outcome") == "error", "failed").when(broke, "found_nothing")
    said = F.when(F.col("outcome") == "error", F.col("message")).when(broke, F.concat(F.lit("found nothing, "), F.col("_before").cast("string"), F.lit(" before")))
    return placed.withColumn("kind", kind).where("kind is not null").select("run", "kind", said.alias("message"))


def daily_sync(operators: DataFrame, plans: DataFrame, network: DataFrame, notes: DataFrame, documents: DataFrame, raised: DataFrame, today: Column) -> DataFrame:
    """(kind, key, severity) of what has changed around published tables, each raised once.

    Operators (operator, active) that are cancelled; published plans (plan, status) that aren't active or that the register doesn't know; approved
    network changes (protocol, severity); newer notes (key); documents (doc, until, status) whose validity ends today or ended. ``raised`` is (kind, key); an
    open event about a plan (resolved false) blocks another, a resolved one doesn't."""
    text = lambda c: F.col(c).cast("string").alias("key")
    all_ = operators.where("not active").select(F.lit("operator_cancelled").alias("kind"), text("operator"), F.lit("error").alias("severity"))
    all_ = all_.unionByName(plans.where(F.coalesce(F.col("status") != "active", F.lit(True))).select(F.lit("plan_not_active").alias("kind"), text("plan"), F.lit("alert").alias("severity")))
    all_ = all_.unionByName(network.select(F.lit("network_changed").alias("kind"), text("protocol"), "severity"))
    all_ = all_.unionByName(notes.select(F.lit("newer_note").alias("kind"), text("key"), F.lit("alert").alias("severity")))
    ended = documents.where((F.col("status") == "published") & (F.col("until") <= today))
    all_ = all_.unionByName(ended.select(F.lit("expired").alias("kind"), text("doc"), F.lit("alert").alias("severity")))
    return not_yet(all_, raised.where((F.col("kind") != "plan_not_active") | ~F.col("resolved")), ["kind", "key"])
