"""What recomputation is worth: faults planted in prices it can make anew, and how many of them it finds and repairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planwatch.functions.bands import to_long
from planwatch.operators.collecting import fault_seed, mutated
from planwatch.operators.reconcile import recompute
from planwatch.session import written

#: A price agrees with its recomputed value within this.
AGREES = 0.015


def planted(columns: DataFrame, doc: str, column: str, prices: str = "prices", every: int = 7) -> DataFrame:
    """(doc, column, band, true_cents, cents, kind, value, detected, repaired) of typing faults in prices that recomputation has a value for.

    About one such price in ``every`` gets a fault (``collecting.mutated`` with exchanged digits). Each fault is tried by itself, as a version
    of its column against the other columns of its document as they are, so faults don't hide each other. detected: the
    value contradicts the fault; repaired: and it is the true price to the cent. Null and empty columns have no such prices.
    Nothing is broadcast: Spark takes bands and values to be as small as the columns they are made of.
    """
    named = columns.select(doc, column, prices)
    some = to_long(named, [doc, column], prices).where(F.pmod(fault_seed([doc, column]), F.lit(every)) == 0)  # no others get a fault
    read = some.withColumn("cents", F.round(F.col("price") * 100).cast("bigint")).drop("price")
    known = recompute(named, doc, column, prices).select(doc, column, "band")
    faults = written(mutated(read.join(known.hint("merge"), [doc, column, "band"]), [doc, column], every, swaps=True), "faults").where("kind is not null")
    at, wrong = F.col("band"), F.col("cents") / F.lit(100.0)
    trials = faults.join(named.hint("merge"), [doc, column]).select(doc, column, at.alias("fault"), F.transform(prices, lambda p, i: F.when(i == at, wrong).otherwise(p.cast("double"))).alias(prices))
    made = recompute(trials, doc, column, prices, peers=named, trial=["fault"]).where("band = fault").select(doc, column, "band", "value")
    detected = F.coalesce(F.abs(wrong - F.col("value")) >= AGREES, F.lit(False))
    exact = F.coalesce(F.abs(F.col("value") - F.col("true_cents") / F.lit(100.0)) < 0.005, F.lit(False))
    return faults.join(made.hint("merge"), [doc, column, "band"], "left").withColumns({"detected": detected, "repaired": detected & exact})


def scores(faults: DataFrame) -> DataFrame:
    """(kind, faults, detected, repaired, share_detected, share_repaired) of ``planted`` faults."""
    n = F.count("*")
    shares = {f"share_{c}": F.count_if(c) / n for c in ("detected", "repaired")}
    return faults.groupBy("kind").agg(n.alias("faults"), *[F.count_if(c).alias(c) for c in ("detected", "repaired")], *[s.alias(k) for k, s in shares.items()])
