"""Streams of documents: exactly-once content and fetch states."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BLOCKED = (401, 403, 429)


def available_now(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs ``each`` over all that is there now, in micro-batches, and ends. An offset counts as read only once its batch ended well."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def unseen_stream(stream: DataFrame, content: str = "content") -> DataFrame:
    """The stream with sha, each content once in all batches: Spark's state store holds the hashes, dealt by hash, so a batch
    costs what it brings and not what came before it."""
    return stream.withColumn("sha", F.sha2(F.col(content).cast("binary"), 256)).dropDuplicates(["sha"])


def unseen(batch: DataFrame, seen: DataFrame, content: str = "content") -> DataFrame:
    """One row for each content that neither ``seen`` (sha) nor an earlier row of the batch has."""
    hashed = batch.withColumn("sha", F.sha2(F.col(content).cast("binary"), 256)).dropDuplicates(["sha"])
    return hashed.join(seen.select("sha").distinct(), "sha", "left_anti")


def to_fetch(candidates: DataFrame, state: DataFrame, immutable: Column) -> DataFrame:
    """``candidates`` (url) without those of sources whose addresses never change that were fetched before; the others carry the etag and the
    date (modified) that a conditional request needs. ``immutable`` is a column of candidates."""
    known = state.where("sha is not null").select("url", F.lit(True).alias("_known"), "etag", "modified").dropDuplicates(["url"])
    return candidates.withColumn("_immutable", immutable).join(known, "url", "left").where("not (_immutable and coalesce(_known, false))").drop("_immutable", "_known")


def pdf_fault(content: Column, kind: Column) -> Column:
    """Why bytes are no whole PDF: they don't begin as one, or lack its end mark in the last 2,048; null for a whole one."""
    head, tail = F.substring(content, 1, 4), F.substring(content, -2048, 2048)
    short = F.when(F.length(content) < 2048, content).otherwise(tail)
    said = F.when(F.coalesce(kind, F.lit("")) == "", F.lit("no type")).otherwise(kind)
    return F.when(head != F.lit(b"%PDF"), F.concat(F.lit("not a PDF ("), said, F.lit(")"))).when(~F.contains(short, F.lit(b"%%EOF")), F.concat(F.lit("ends without %%EOF after "), F.length(content).cast("string"), F.lit(" bytes")))


def outcomes(fetched: DataFrame, state: DataFrame) -> DataFrame:
    """Fetches (url, status, sha) against the state (url, sha) of the last good fetch, with outcome: blocked, error, unchanged
    (not modified, or the same content), known (the content came from another address) or new."""
    known = state.select("sha").distinct().withColumn("_known", F.lit(True))
    joined = fetched.join(state.select("url", F.col("sha").alias("_before")).dropDuplicates(["url"]), "url", "left").join(known, "sha", "left")
    outcome = F.when(F.col("status").isin(*BLOCKED), "blocked").when(F.col("status") == 304, "unchanged").when(F.col("status") != 200, "error")
    outcome = outcome.when(F.col("sha") == F.col("_before"), "unchanged").when(F.col("_known"), "known").otherwise("new")
    return joined.withColumn("outcome", outcome).drop("_before", "_known")


def next_state(state: DataFrame, fetched: DataFrame) -> DataFrame:
    """The state (url, sha, etag, modified, seen) after fetches with outcomes (url, sha, etag, modified, at, outcome): what came well replaces
    what was known, any fetch moves ``seen``, a blocked or failed one changes nothing else. One row for each address."""
    good = F.col("outcome").isin("new", "known", "unchanged") & F.col("sha").isNotNull()
    value = F.struct("sha", "etag", "modified")
    news = fetched.groupBy("url").agg(F.max_by(value, F.when(good, F.col("at"))).alias("_new"), F.max("at").alias("_at"))
    both = state.withColumn("_old", value).select("url", "_old", "seen").join(news, "url", "full")
    kept = F.coalesce(F.when(F.col("_new.sha").isNotNull(), F.col("_new")), F.col("_old"))
    return both.withColumn("_kept", kept).select("url", "_kept.sha", "_kept.etag", "_kept.modified", F.greatest("seen", "_at").alias("seen"))


def next_offset(state: tuple[int, int] | None, validity: int, uids: list[int], limit: int) -> tuple[tuple[int, int], list[int]]:
    """The offset (validity, last uid) of a mailbox and the uids to read: a new validity starts anew, ``limit`` a run."""
    last = state[1] if state and state[0] == validity else 0
    todo = sorted(u for u in uids if u > last)[:limit]
    return (validity, todo[-1] if todo else last), todo


def kept_offset(before: str | None, after: str | None, outcome: str, partial: bool) -> str | None:
    """The offset to store after a run: it moves on only if the run ended well and read all there was."""
    return after if outcome == "ok" and not partial else before
