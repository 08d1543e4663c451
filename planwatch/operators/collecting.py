"""Collection: outcomes of runs, series of what was found, sources that are loaded anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from planwatch.functions.text import validity

OUTCOMES = ("new", "known", "unchanged", "blocked", "error")


def run_counters(fetched: DataFrame, run: list[str], outcome: str = "outcome") -> DataFrame:
    """(run, found, and a count of each outcome), one row for each run."""
    return fetched.groupBy(*run).agg(F.count("*").alias("found"), *[F.count_if(F.col(outcome) == o).alias(o) for o in OUTCOMES])


def resolved_series(items: DataFrame, seen: DataFrame, docs: DataFrame, otherwise: Column) -> DataFrame:
    """``items`` (source, key) with series: that of the item which its source showed first under this key, else that of the first
    document whose address reduces to the key, else ``otherwise``.

    ``seen`` is (source, key, series, at), ``docs`` is (key, series, at); each is reduced to a row a key before it is joined.
    """
    first = F.min_by("series", F.struct("at", "series"))
    own = seen.groupBy("source", "key").agg(first.alias("_own"))
    any_ = docs.groupBy("key").agg(first.alias("_any"))
    return items.join(own, ["source", "key"], "left").join(any_, "key", "left").withColumn("series", F.coalesce("_own", "_any", otherwise)).drop("_own", "_any")


def last_results(runs: DataFrame, capture: list[str], at: str, found: str, least: int = 1) -> DataFrame:
    """``runs`` with before: what the latest earlier run of the capture found that found ``least`` or more; null without one."""
    w = W.partitionBy(*capture).orderBy(at).rowsBetween(W.unboundedPreceding, -1)
    return runs.withColumn("before", F.last(F.when(F.col(found) >= least, F.col(found)), ignorenulls=True).over(w))


def loaded(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of both, a key's new row in place of its old one, with fresh: whether it is new. Both have the same columns, a row a key."""
    both = old.withColumn("fresh", F.lit(False)).unionByName(new.withColumn("fresh", F.lit(True)))
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "fresh").alias("_row")).select(*keys, "_row.*")


def of_known_series(candidates: DataFrame, seen: DataFrame, docs: DataFrame) -> DataFrame:
    """The candidates (source, key) whose source has shown the key before, or whose key a document's address reduces to."""
    known = seen.select("source", "key").union(docs.select("source", "key")).distinct()
    return candidates.join(known, ["source", "key"], "left_semi")


def material_date(*sources: Column) -> Column:
    """The date of a material: the first that is known, in order, as that of its document, the reading's, the printed one."""
    return F.coalesce(*sources)


def printed_validity(lines: DataFrame, pages: int = 3) -> DataFrame:
    """(doc, starts, ends): the first validity that a line (doc, page, line, text) of a document's first pages states."""
    said = lines.where(F.col("page") <= pages).withColumns({"starts": validity(F.col("text")), "ends": validity(F.col("text"), last=True)}).where("starts is not null")
    return said.groupBy("doc").agg(F.min_by(F.struct("starts", "ends"), F.struct("page", "line")).alias("r")).select("doc", "r.*")


def run_totals(documents: DataFrame, by: list[str]) -> DataFrame:
    """What a reading of many documents comes to: documents, prices, and those confirmed, to review and read by one only."""
    sums = {c: F.sum(c).cast("bigint").alias(c) for c in ("cells", "confirmed", "to_review", "alone")}
    return documents.groupBy(*by).agg(F.count("*").alias("documents"), *sums.values())


def latest_notes(notes: DataFrame, plan: str = "plan", note: str = "note", dated: str = "dated", loaded: str = "loaded") -> DataFrame:
    """Of each plan and note the bands of its latest date; a band that was loaded twice for it as it came last. notes: (plan, note, dated, band, loaded, ...)."""
    latest = notes.withColumn("_last", F.max(dated).over(W.partitionBy(plan, note))).where(F.col(dated) == F.col("_last")).drop("_last")
    rest = [c for c in notes.columns if c not in (plan, note, "band")]
    return latest.groupBy(plan, note, "band").agg(F.max_by(F.struct(*rest), loaded).alias("_r")).select(plan, note, "band", "_r.*")


def operators_by_name(operators: DataFrame, fragment: str) -> DataFrame:
    """Operators (name, trade_name, active) whose name or trade name holds the fragment in either case, active ones first."""
    hit = F.contains(F.upper("name"), F.lit(fragment.upper())) | F.coalesce(F.contains(F.upper("trade_name"), F.lit(fragment.upper())), F.lit(False))
    return operators.where(hit).orderBy(F.desc("active"), "name")


def tables_of_operators(operators: DataFrame, tables: DataFrame, name: str = "name", operator: str = "operator", size: int = 3) -> DataFrame:
    """(operator, table) pairs where a table's operator holds the first word of an operator's name, in either case.

    A word is held just if its first ``size`` letters are, somewhere; so the different names meet by runs of so many letters, and
    only names that share one are compared. Shorter words are looked up as they are, among runs of their own length."""
    first = operators.select(F.col(name).alias("_name"), F.lower(F.split(F.trim(name), r"\s+")[0]).alias("_word")).where("_word <> ''").distinct()
    first = first.withColumn("_run", F.left("_word", F.lit(size)))
    held = tables.select(F.col(operator).alias("_operator")).distinct().withColumn("_low", F.lower("_operator"))
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("_low"), F.lit(1))), lambda i: F.substr("_low", i, F.lit(n)))
    spread = held.withColumn("_run", F.explode(F.array_distinct(F.concat(*[runs(n) for n in range(1, size + 1)]))))
    pairs = first.join(spread, "_run").where(F.contains("_low", F.col("_word"))).select("_name", "_operator").distinct()
    return pairs.join(tables.withColumn("_operator", F.col(operator)), "_operator").select(F.col("_name").alias("asked"), *tables.columns)


def fault_seed(keys: list[str]) -> Column:
    """A number from the hash of a price's keys and band, by which ``mutated`` plants faults: only where ``every`` divides it."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in [*keys, "band"]]).cast("binary")), 1, 8), 16, 10).cast("bigint")


def mutated(prices: DataFrame, keys: list[str], every: int = 7, swaps: bool = False) -> DataFrame:
    """Fault injection: about one price (keys, band, cents) in ``every`` has one digit changed, which one and to what by a hash of its key, so that any
    engine plants the same faults; with ``swaps`` half of them have two neighbouring digits exchanged instead. Adds true_cents and kind: large (from 1 %),
    small (from 0.1 %), cents; null where nothing was changed."""
    seed = fault_seed(keys)
    digits = F.length(F.col("cents").cast("string"))
    swap = (F.pmod(F.floor(seed / (every * 100)), F.lit(2)) == 1) & (digits > 1) if swaps else F.lit(False)
    place = F.pmod(F.floor(seed / every), digits)
    power = F.pow(F.lit(10.0), F.when(swap, F.least(place, digits - 2)).otherwise(place)).cast("bigint")
    digit, left = (F.pmod(F.floor(F.col("cents") / p), F.lit(10)) for p in (power, power * 10))
    other = F.pmod(digit + 1 + F.pmod(F.floor(seed / (every * 10)), F.lit(9)), F.lit(10))
    wrong = F.col("cents") + F.when(swap, 9 * (digit - left)).otherwise(other - digit) * power
    hit = (F.pmod(seed, F.lit(every)) == 0) & (wrong > 0)
    off = F.abs(F.col("cents") - F.col("true_cents")) / F.col("true_cents")
    planted = prices.withColumn("true_cents", F.col("cents")).withColumn("cents", F.when(hit, wrong).otherwise(F.col("cents")).cast("bigint"))
    return planted.withColumn("kind", F.when(F.col("cents") != F.col("true_cents"), F.when(off >= 0.01, "large").when(off >= 0.001, "small").otherwise("cents")))
