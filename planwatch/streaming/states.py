"""Operators that keep state from batch to batch and from run to run: what is known of each address, and the chain of each key."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from planwatch.streaming.feeds import BLOCKED

#: The settings that these operators need: their state is kept in RocksDB, beside the checkpoint.
STATE_SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

FETCH = "capture string, url string, fixed boolean, id bigint, at timestamp_ntz, status int, sha string, etag string, modified string, fault boolean"
_ITEM = "etag string, modified string, sha string, outcome string, seen bigint"
FETCHED = "capture string, url string, id bigint, at timestamp, etag string, modified string, sha string, outcome string"
_TOLD = FETCHED.replace("at timestamp", "at bigint")  # times are microseconds in state and in Python
_FETCHED = Row(*[c.split()[0] for c in FETCHED.split(", ")])


def after_fetch(item: tuple, fetch) -> tuple:
    """What is known of an address (etag, modified, sha, outcome) after a fetch of it.

    What never changes (``fixed``) isn't asked for again once its content is known, and a fault in it is kept as one. Otherwise a refusal or an error
    changes the outcome alone, an answer 304 or the same content is unchanged, and other content brings its etag and date.
    """
    etag, modified, sha, _ = item
    if fetch.fixed and sha is not None:
        return etag, modified, sha, "unchanged"
    if fetch.status in BLOCKED:
        return etag, modified, sha, "blocked"
    if fetch.status == 304:
        return etag, modified, sha, "unchanged"
    if fetch.status != 200 or fetch.sha is None:
        return etag, modified, sha, "error"
    if fetch.fault:
        return (etag, modified, fetch.sha, "faulty") if fetch.fixed else (etag, modified, sha, "error")
    return fetch.etag, fetch.modified, fetch.sha, "unchanged" if fetch.sha == sha else "changed"


class FetchState(StatefulProcessor):
    """One value for each (capture, url). A batch's fetches of an address are taken in order of time and id; each gives a row with what is known after it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.item = handle.getValueState("item", _ITEM)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.item.get() or (None, None, None, None, None)
        item, seen = tuple(known[:4]), known[4]
        for f in sorted(rows, key=lambda f: (f.at is None, f.at, f.id is None, f.id)):
            item = after_fetch(item, f)
            seen = max((t for t in (seen, f.at) if t is not None), default=None)
            yield _FETCHED(*key, f.id, f.at, *item)
        self.item.update((*item, seen))


def fetch_states(fetches: DataFrame) -> DataFrame:
    """A stream of fetches (FETCH) as rows of FETCHED, by the state of each address. An address without a capture has one of its own."""
    rows = fetches.withColumns({"at": F.unix_micros(F.col("at").cast("timestamp")), "fixed": F.coalesce("fixed", F.lit(False)), "fault": F.coalesce("fault", F.lit(False)), "capture": F.coalesce("capture", F.lit(""))})
    return rows.groupBy("capture", "url").transformWithState(FetchState(), _TOLD, "Update", "None").withColumn("at", F.timestamp_micros("at"))


def known_addresses(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(capture, url, etag, modified, sha, outcome, seen): the state itself, as a run that ended has left it; the next run's conditional requests need it."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "item").load()
    return state.select("key.capture", "key.url", "value.*").withColumn("seen", F.timestamp_micros("seen").cast("timestamp_ntz"))


def told_apart(log: DataFrame) -> DataFrame:
    """Rows of FETCHED with ``changed`` told apart: new, or known if the same content came before, from whichever address."""
    first = F.row_number().over(W.partitionBy("sha", F.col("outcome") == "changed").orderBy("at", "id")) == 1
    return log.withColumn("outcome", F.when(F.col("outcome") != "changed", F.col("outcome")).when(first, "new").otherwise("known"))


class ChainState(StatefulProcessor):
    """A map from date to prices for each key. A row that arrives, however late, changes its own link and its neighbours', and only those go out."""

    def __init__(self, keys: list[str], prices: str):
        self.keys, self.prices = keys, prices
        self.row = Row(*keys, "dated", "place", "prices", "confirmed", "next_at")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.dated = handle.getMapState("dated", "dated bigint", f"prices array<{self.prices}>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        chain = {d[0]: [list(x) for x in p[0]] for d, p in self.dated.iterator()}
        before, arrived = links(chain), set()
        for row in rows:
            prices = list(row.prices)
            if prices not in chain.get(row.dated, []):  # rows of one date all stay, in order of their prices, nulls first
                chain[row.dated] = sorted([*chain.get(row.dated, []), prices], key=lambda ps: [(p is not None, p or 0) for p in ps])
                arrived.add(row.dated)
        for dated in arrived:
            self.dated.updateValue((dated,), (chain[dated],))
        after = links(chain)
        for at in sorted(before.keys() | after.keys()):
            if before.get(at) != after.get(at):
                yield self.row(*key, *at, *(after.get(at) or (None, None, None)))


def links(chain: dict[int, list[list]]) -> dict[tuple[int, int], tuple]:
    """(date, place among the date's) -> (prices, the last date they still held, the date of the next link), where prices differ from those before."""
    out, start = {}, None
    for dated in sorted(chain):
        for place, prices in enumerate(chain[dated]):
            if start is not None and out[start][0] == prices:
                out[start] = (prices, dated, None)
            else:
                if start is not None:
                    out[start] = (*out[start][:2], dated)
                start, out[dated, place] = (dated, place), (prices, dated, None)
    return out


def changed_links(stream: DataFrame, keys: list[str]) -> DataFrame:
    """A stream of (keys, dated, prices: array) as the links of the keys' chains that it changes: (keys, dated, place, prices, confirmed, next_at), with null prices
    where a link is none any more; ``place`` tells rows of one date apart. Dates become days since 1970; whole numbers do as well. What a batch reads and writes is what its keys' chains hold, not what came before it."""
    dated = F.unix_date("dated") if stream.schema["dated"].dataType.simpleString() == "date" else F.col("dated")
    rows = stream.select(*keys, dated.cast("bigint").alias("dated"), "prices")
    array = rows.schema["prices"].dataType.simpleString()
    schema = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys), "dated bigint", "place bigint", f"prices {array}", "confirmed bigint", "next_at bigint"])
    return rows.groupBy(*keys).transformWithState(ChainState(keys, array), schema, "Update", "None")


def append_batches(path: str):
    """A foreachBatch function: each batch in a folder of its own below ``path``, written anew if the batch runs again."""

    def each(batch: DataFrame, number: int) -> None:
        batch.withColumn("position", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return each


def current_links(log: DataFrame, keys: list[str]) -> DataFrame:
    """The chains after the batches of a log (``changed_links`` with batch): of each place the latest link, numbered from 1, with is_current."""
    last = log.groupBy(*keys, "dated", "place").agg(F.max_by(F.struct("prices", "confirmed", "next_at"), "batch").alias("link")).select(*keys, "dated", "place", "link.*").where("prices IS NOT NULL")
    return last.withColumn("version", F.row_number().over(W.partitionBy(*keys).orderBy("dated", "place"))).withColumn("is_current", F.col("next_at").isNull())


def set_up(spark: SparkSession) -> SparkSession:
    """The session with STATE_SETTINGS, where the cluster has set no provider of its own."""
    for name, value in STATE_SETTINGS.items():
        if "RocksDB" not in (spark.conf.get(name, "") or ""):
            spark.conf.set(name, value)
    return spark
