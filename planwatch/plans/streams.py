"""Queries that run streams to their end over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planwatch.plans.registry import Tables, query
from planwatch.plans.views import WIDE, wide
from planwatch.session import shared_folder
from planwatch.streaming import feeds, states


def _folder(t: Tables) -> str:
    return f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"


@query("SELECT sha256(text) AS sha, min(CAST(len(text) AS BIGINT)) AS length FROM documents GROUP BY ALL")
def stream_dedup(t: Tables) -> DataFrame:
    """Documents arrive as a stream of files; each text is kept once, by the stream's own state."""
    folder, docs = _folder(t), t.documents
    docs.select("doc_id", "text").repartition(8, "doc_id").write.parquet(f"{folder}/in")
    stream = t.spark.readStream.schema("doc_id bigint, text string").option("maxFilesPerTrigger", 4).parquet(f"{folder}/in")
    once = feeds.unseen_stream(stream, "text").select("sha", F.length("text").cast("bigint").alias("length"))
    once.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema("sha string, length bigint").parquet(f"{folder}/out")


@query(f"WITH {WIDE}, w AS (SELECT product, source, version AS dated, list_transform(prices, lambda x: x // 20000) AS prices FROM wide), moved AS (SELECT *, coalesce(CAST(prices AS VARCHAR) <> lag(CAST(prices AS VARCHAR)) OVER v, true) AS new_ FROM w WINDOW v AS (PARTITION BY product, source ORDER BY dated)), numbered AS (SELECT *, CAST(sum(new_::INT) OVER (PARTITION BY product, source ORDER BY dated) AS INT) AS version FROM moved), kept AS (SELECT *, max(dated) OVER (PARTITION BY product, source, version) AS confirmed FROM numbered QUALIFY new_) SELECT product, source, dated, version, confirmed, lead(dated) OVER (PARTITION BY product, source ORDER BY version) AS next_at, lead(dated) OVER (PARTITION BY product, source ORDER BY version) IS NULL AS is_current FROM kept")
def stream_late_insert(t: Tables) -> DataFrame:
    """Price columns arrive in an order that has nothing to do with their dates; the state of each key emits the links that change, and these lead to the chains of their dates."""
    folder, keys = _folder(t), ["product", "source"]
    rows = wide(t).select(*keys, F.col("version").alias("dated"), F.transform("prices", lambda x: F.floor(x / 20000)).alias("prices"))
    rows.repartition(4, F.xxhash64("product", "dated")).write.parquet(f"{folder}/in")
    stream = states.set_up(t.spark).readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    feeds.available_now(states.changed_links(stream, keys), states.append_batches(f"{folder}/links"), f"{folder}/state")
    made = states.current_links(t.spark.read.parquet(f"{folder}/links"), keys)
    day = lambda c: F.date_from_unix_date(F.col(c).cast("int")).alias(c)
    return made.select(*keys, day("dated"), F.col("version").cast("int").alias("version"), day("confirmed"), day("next_at"), "is_current")


ASKED = "f AS (SELECT CAST(event_id % 2 AS VARCHAR) AS capture, CAST(user_id AS VARCHAR) AS url, user_id % 3 = 0 AS fixed, event_id AS id, ts, CASE event_id % 7 WHEN 0 THEN 304 WHEN 1 THEN 403 WHEN 2 THEN 500 ELSE 200 END AS status, event_type AS sha, event_id % 11 = 0 AS fault FROM events), good AS (SELECT *, status = 200 AND (fixed OR NOT fault) AS good FROM f), prior AS (SELECT *, first_value(CASE WHEN good THEN id END IGNORE NULLS) OVER w AS first_good, last_value(CASE WHEN good THEN id END IGNORE NULLS) OVER w AS last_good, last_value(CASE WHEN good THEN sha END IGNORE NULLS) OVER w AS before FROM good WINDOW w AS (PARTITION BY capture, url ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), told AS (SELECT *, CASE WHEN fixed AND first_good IS NOT NULL THEN 'unchanged' WHEN status = 403 THEN 'blocked' WHEN status = 304 THEN 'unchanged' WHEN status <> 200 THEN 'error' WHEN fault THEN CASE WHEN fixed THEN 'faulty' ELSE 'error' END WHEN sha = before THEN 'unchanged' ELSE 'changed' END AS outcome FROM prior)"


def _asked(t: Tables) -> DataFrame:
    status = F.when(F.col("event_id") % 7 == 0, 304).when(F.col("event_id") % 7 == 1, 403).when(F.col("event_id") % 7 == 2, 500).otherwise(200)
    return t.events.select((F.col("event_id") % 2).cast("string").alias("capture"), F.col("user_id").cast("string").alias("url"), (F.col("user_id") % 3 == 0).alias("fixed"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp_ntz").alias("at"), status.cast("int").alias("status"), F.col("event_type").alias("sha"), F.concat(F.lit("e"), F.col("event_id")).alias("etag"), F.col("ts").cast("date").cast("string").alias("modified"), (F.col("event_id") % 11 == 0).alias("fault"))


def _three_runs(t: Tables) -> str:
    """Fetches as they come in three runs, each of which goes on where the one before it ended; the folder of their log and state."""
    folder, asked = _folder(t), _asked(t)
    moments = asked.approxQuantile("id", [0.33, 0.66], 0.05)
    spark = states.set_up(t.spark)
    for lo, hi in zip([None, *moments], [*moments, None]):
        part = asked if lo is None else asked.where(F.col("id") > lo)
        (part if hi is None else part.where(F.col("id") <= hi)).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(asked.schema).parquet(f"{folder}/in")
        feeds.available_now(states.fetch_states(stream), states.append_batches(f"{folder}/log"), f"{folder}/state")
    return folder


@query(f"WITH {ASKED}, last AS (SELECT capture, url, arg_max(outcome, (ts, id)) AS outcome, max(ts) AS seen FROM told GROUP BY ALL), content AS (SELECT capture, url, CASE WHEN fixed THEN arg_min(sha, (ts, id)) ELSE arg_max(sha, (ts, id)) END AS sha, CASE WHEN fixed THEN CASE WHEN arg_min(fault, (ts, id)) THEN NULL ELSE 'e' || arg_min(id, (ts, id)) END ELSE 'e' || arg_max(id, (ts, id)) END AS etag FROM good WHERE good GROUP BY capture, url, fixed) SELECT last.capture, last.url, etag, sha, outcome, seen FROM last LEFT JOIN content USING (capture, url)")
def fetch_runs(t: Tables) -> DataFrame:
    """What is known of each address after three runs, read from the state itself."""
    return states.known_addresses(t.spark, f"{_three_runs(t)}/state").select("capture", "url", "etag", "sha", "outcome", "seen")


@query(f"WITH {ASKED}, named AS (SELECT capture, CASE WHEN outcome <> 'changed' THEN outcome WHEN row_number() OVER (PARTITION BY sha, outcome = 'changed' ORDER BY ts, id) = 1 THEN 'new' ELSE 'known' END AS outcome FROM told) SELECT capture, outcome, count(*) AS n FROM named GROUP BY ALL")
def fetch_run_outcomes(t: Tables) -> DataFrame:
    """How many fetches of three runs ended how, by capture; content that came before, from any address, is known."""
    log = t.spark.read.schema(states.FETCHED).parquet(f"{_three_runs(t)}/log")
    return states.told_apart(log).groupBy("capture", "outcome").agg(F.count("*").alias("n"))


FETCHED = "s AS (SELECT user_id AS url, arg_max(event_type, ts) AS sha, max(ts) AS seen FROM events WHERE event_id % 3 = 0 GROUP BY user_id), f AS (SELECT user_id AS url, event_id, ts AS moment, CASE WHEN event_id % 5 = 0 THEN 'error' ELSE 'new' END AS outcome, CASE WHEN event_id % 5 <> 0 THEN event_type END AS sha FROM events WHERE event_id % 3 = 1)"


def _fetches(t: Tables) -> tuple[DataFrame, DataFrame]:
    state = t.events.where("event_id % 3 = 0").groupBy(F.col("user_id").alias("url")).agg(F.max_by("event_type", "ts").alias("sha"), F.max("ts").alias("seen")).withColumns({"etag": F.lit(None).cast("string"), "modified": F.lit(None).cast("string")})
    bad = F.col("event_id") % 5 == 0
    fetched = t.events.where("event_id % 3 = 1").select(F.col("user_id").alias("url"), F.when(~bad, F.col("event_type")).alias("sha"), F.lit(None).cast("string").alias("etag"), F.lit(None).cast("string").alias("modified"), F.col("ts").alias("at"), F.when(bad, "error").otherwise("new").alias("outcome"))
    return state, fetched


@query(f"WITH {FETCHED}, n AS (SELECT url, arg_max(sha, moment) FILTER (outcome <> 'error') AS sha, max(moment) AS moment FROM f GROUP BY url) SELECT coalesce(s.url, n.url) AS url, coalesce(n.sha, s.sha) AS sha, greatest(s.seen, n.moment) AS seen FROM s FULL JOIN n ON s.url = n.url")
def fetch_state(t: Tables) -> DataFrame:
    """The state of each address after a run: what came well replaces what was known."""
    return feeds.next_state(*_fetches(t)).select("url", "sha", "seen")


@query(f"WITH {FETCHED}, c AS (SELECT DISTINCT user_id AS url, user_id % 2 = 0 AS fixed FROM events) SELECT url, fixed FROM c WHERE NOT (fixed AND url IN (SELECT url FROM s))")
def fetch_plan(t: Tables) -> DataFrame:
    """Addresses to ask for: those that never change only if they weren't fetched before."""
    candidates = t.events.select(F.col("user_id").alias("url"), (F.col("user_id") % 2 == 0).alias("fixed")).distinct()
    return feeds.to_fetch(candidates, _fetches(t)[0], F.col("fixed")).select("url", "fixed")
