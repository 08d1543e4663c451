"""Publishing a document: new versions, confirmations, what is blocked or gone, and places in history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from planwatch.functions.bands import is_complete
from planwatch.operators.matching import match_conditions
from planwatch.operators.versions import chains


def publishable(columns: DataFrame, cells: DataFrame, key: str = "column_id") -> DataFrame:
    """``columns`` (key, product, prices, perhaps status) with publishable: registered, complete, no cell (key, review) left to review, and not ``ignored`` by a reviewer."""
    open_ = cells.where("review").select(key).distinct().withColumn("_open", F.lit(True))
    ok = (F.coalesce("product", F.lit("")) != "") & is_complete(F.col("prices")) & F.col("_open").isNull()
    if "status" in columns.columns:
        ok = ok & ~F.coalesce(F.col("status") == "ignored", F.lit(False))
    return columns.join(open_, key, "left").withColumn("publishable", ok).drop("_open")


def publish(versions: DataFrame, incoming: DataFrame) -> DataFrame:
    """What publishing does to (series, product, version, place, tags, prices, is_current, is_head), by incoming (series, product, place, tags, prices, publishable).

    Rows (series, product, action, version, prices): ``first``, ``version`` (supersedes the matched one), ``confirmed`` (equal prices), ``blocked`` (present,
    but not to be published: the old version stays), ``retired`` with reason. Columns match current versions by condition, the rest
    then matches heads of histories that ended, and continues them. ``place`` is that in its document: where conditions don't decide, tables
    match in the order in which their documents have them.
    """
    key = ["series", "product"]
    new = incoming.where(F.coalesce("product", F.lit("")) != "").withColumn("order_", F.col("place"))
    old = versions.withColumn("order_", F.col("place"))
    pairs = match_conditions(old.where("is_current"), new, key, ["order_"])
    left = pairs.where("old is null").select("new.*")
    again = match_conditions(old.where("is_head and not is_current"), left, key, ["order_"]).where("new is not null")
    both = pairs.where("old is not null").unionByName(again)
    there = incoming.select(*key).distinct().withColumn("_there", F.lit(True))
    of_series = incoming.select("series").distinct()
    n = F.coalesce("old.version", F.lit(0))
    action = F.when(F.col("new").isNull(), "retired").when(~F.col("new.publishable"), "blocked").when(F.col("old").isNull(), "first")
    action = action.when(F.col("old.is_current") & (F.col("old.prices") == F.col("new.prices")), "confirmed").otherwise("version")
    done = both.join(of_series, "series", "left_semi").join(there, key, "left").withColumn("action", action)
    version = F.when(F.col("action").isin("first", "version"), n + 1).otherwise(n)
    reason = F.when(F.col("action") == "retired", F.when(F.col("_there"), "condition_changed").otherwise("product_removed"))
    return done.select(*key, "action", version.alias("version"), F.coalesce("new.prices", "old.prices").alias("prices"), reason.alias("reason"))


def _arrived(chain: DataFrame, older: DataFrame, keys: list[str], arrived: str) -> DataFrame:
    """(keys, folded): the rows of ``older`` put into their chains one by one, by ``arrived``, as a struct of the chain (dated, doc, prices, is_current) and what became of
    each. A chain and what comes late of one key are few rows; keys are dealt as they hash."""
    kind = older.schema["prices"].dataType.simpleString()
    doc, dated = older.schema["doc"].dataType.simpleString(), older.schema["dated"].dataType.simpleString()
    one = f"struct<dated: {dated}, place: bigint, doc: {doc}, prices: {kind}, is_current: boolean>"
    held = F.struct("dated", F.lit(0).cast("bigint").alias("place"), "doc", "prices", F.coalesce("is_current", F.lit(False)).alias("is_current"))
    chains_ = chain.groupBy(*keys).agg(F.array_sort(F.collect_list(held)).cast(f"array<{one}>").alias("chain"))
    late = older.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(arrived).alias("arrived"), "dated", "doc", "prices"))).alias("late"))

    def put(state, x):
        earlier = F.filter(state["chain"], lambda e: e["dated"] <= x["dated"])
        later = F.filter(state["chain"], lambda e: e["dated"] > x["dated"])
        before, after = F.try_element_at(earlier, F.lit(-1)), F.try_element_at(later, F.lit(1))
        same = F.coalesce(before["prices"] == x["prices"], F.lit(False)) | F.coalesce(after["prices"] == x["prices"], F.lit(False))
        there = F.exists(state["chain"], lambda e: e["doc"] == x["doc"])
        action = F.when(there, "there").when(after.isNull() & F.coalesce(before["is_current"], F.lit(False)), "deferred").when(same, "equal").otherwise("inserted")
        new = F.struct(x["dated"], F.lit(0).cast("bigint").alias("place"), x["doc"], x["prices"], F.lit(False).alias("is_current")).cast(one)
        chain_ = F.when(action == "inserted", F.concat(earlier, F.array(new), later)).otherwise(state["chain"])
        told = F.concat(state["told"], F.array(F.struct(x["doc"].alias("doc"), x["dated"].alias("dated"), x["prices"].alias("prices"), action.alias("action"))))
        return F.struct(chain_.alias("chain"), told.alias("told"))

    told = f"array<struct<doc: {doc}, dated: {dated}, prices: {kind}, action: string>>"
    first = F.struct(F.coalesce("chain", F.array().cast(f"array<{one}>")).alias("chain"), F.array().cast(told).alias("told"))
    return chains_.join(late, keys, "full").withColumn("folded", F.aggregate(F.coalesce("late", F.array().cast(late.schema["late"].dataType)), first, put)).select(*keys, "folded")


def place_in_history(chain: DataFrame, older: DataFrame, keys: list[str], arrived: str = "doc") -> DataFrame:
    """What becomes of older rows (keys, doc, dated, prices) that arrive, one after the other, in a chain (keys, doc, dated, prices, is_current): ``there`` (the document is
    in it already), ``equal`` to the row before or behind it by then, ``deferred`` (it would supersede the current one, which only a newer document may), else ``inserted``."""
    return _arrived(chain, older, keys, arrived).select(*keys, F.inline("folded.told"))


def inserted_history(chain: DataFrame, older: DataFrame, keys: list[str], arrived: str = "doc") -> DataFrame:
    """The chain (keys, doc, dated, prices, is_current) with the rows of ``older`` that belong into it (``place_in_history``), numbered anew by date: (..., version,
    next_doc). Nothing that is current changes. Which of equal neighbours stays depends on which came first, as with documents that arrive."""
    whole = _arrived(chain, older, keys, arrived).select(*keys, F.posexplode("folded.chain").alias("n", "e"))
    w = W.partitionBy(*keys).orderBy("n")
    return whole.select(*keys, "e.doc", "e.dated", "e.prices", "e.is_current", (F.col("n") + 1).alias("version"), F.lead("e.doc").over(w).alias("next_doc"))


def history_documents(docs: DataFrame) -> DataFrame:
    """Documents under review (doc, series, dated, status) of whose series a newer one is there, discarded and failed ones aside: they go into
    history without waiting for review, as nothing that is quoted changes."""
    known = docs.where(~F.col("status").isin("discarded", "error"))
    newest = known.groupBy("series").agg(F.max("dated").alias("_newest"))
    return docs.where("status = 'review'").join(newest, "series").where("_newest > dated").drop("_newest")


def resolved_by_history(events: DataFrame, docs: DataFrame, kinds: list[str]) -> DataFrame:
    """``events`` (doc, type, resolved) without the open ones of ``kinds`` about documents (doc) that went into history: they speak of what is quoted."""
    gone = docs.select("doc").distinct().withColumn("_gone", F.lit(True))
    return events.join(gone, "doc", "left").where(~(F.coalesce("_gone", F.lit(False)) & F.col("type").isin(*kinds) & ~F.col("resolved"))).drop("_gone")


def replayed(documents: DataFrame, keys: list[str], at: str) -> DataFrame:
    """What publishing all columns of ``documents`` (keys, at, arrived, prices), one document after the other as they arrived, leads to: as a chain
    depends on dates alone, all at once. Adds late: whether a row came after one of a later date."""
    w = W.partitionBy(*keys).orderBy("arrived").rowsBetween(W.unboundedPreceding, -1)
    marked = documents.withColumn("late", F.coalesce(F.max(at).over(w) > F.col(at), F.lit(False)))
    return chains(marked, keys, at, tie="arrived")


def published_columns(columns: DataFrame, docs: DataFrame, plans: DataFrame) -> DataFrame:
    """What a published table says of itself, for columns (doc, product, column, prices, place, tags): name, operator and contract are those of the
    register's plan (product, name, operator, contract) where it knows the plan, even if they are empty, else the document's (doc, operator, contract,
    administrator, source, from, until)."""
    known = plans.withColumn("_known", F.lit(True)).withColumnsRenamed({c: f"_plan_{c}" for c in ("name", "operator", "contract")})
    of_docs = docs.withColumnsRenamed({c: f"_doc_{c}" for c in ("operator", "contract")})
    pick = lambda plan, own: F.when(F.col("_known"), F.col(plan)).otherwise(F.col(own))
    made = columns.join(of_docs, "doc").join(known, "product", "left").withColumns({"name": pick("_plan_name", "column"), "operator": pick("_plan_operator", "_doc_operator"), "contract": pick("_plan_contract", "_doc_contract")})
    return made.drop(*[c for c in made.columns if c.startswith("_")])
