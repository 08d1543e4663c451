"""Files: delimited registers, zipped registers, nested configurations and recordings."""

from __future__ import annotations

import io
import re
import uuid
import zipfile

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from planwatch.operators.lookup import first_by, last_wins
from planwatch.session import written


def register(spark: SparkSession, path: str, schema: StructType | str, sep: str = ";") -> DataFrame:
    """A delimited register with a header line, in UTF-8 with or without a byte order mark; a broken line fails the read."""
    return spark.read.schema(schema).csv(path, sep=sep, header=True, encoding="UTF-8", mode="FAILFAST", enforceSchema=True)


def both_registers(active: DataFrame, cancelled: DataFrame, key: str, width: int = 6) -> DataFrame:
    """Active and cancelled entries with active; a key in both is cancelled. Keys get leading zeros up to ``width``, longer ones stay."""
    number = F.trim(F.col(key))
    both = active.withColumn("active", F.lit(True)).unionByName(cancelled.withColumn("active", F.lit(False)), allowMissingColumns=True)
    padded = both.withColumn(key, F.when(F.length(number) < width, F.lpad(number, width, "0")).otherwise(number))
    return first_by(padded, [key], [F.col("active")])


def _opened(uri: str):
    """A file that can be sought, in any store that Arrow knows."""
    store, path = fs.FileSystem.from_uri(uri) if ":" in uri else (fs.LocalFileSystem(), uri)
    return store.open_input_file(path)


def zipped_lines(spark: SparkSession, paths: list[str], suffix: str = ".csv") -> DataFrame:
    """(archive, member, line_no, line) of the members of zip files, each member in a task of its own.

    The driver reads the archives' central directories only, a row for each member. A task opens its archive in the shared store, seeks
    its member and streams it in small batches, so neither an archive nor a member is ever held whole."""
    members = []
    for path in paths:
        with _opened(path) as f, zipfile.ZipFile(f) as z:
            members += [(path, n) for n in sorted(z.namelist()) if n.lower().endswith(suffix)]

    def run(batches):
        for batch in batches:
            for name, member in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with _opened(name) as raw, zipfile.ZipFile(raw) as z, z.open(member) as f:
                    rows: list[tuple[int, str]] = []
                    for i, line in enumerate(io.TextIOWrapper(f, encoding="utf-8-sig", newline="\n")):
                        rows.append((i, line.rstrip("\r\n")))
                        if len(rows) == 4096:
                            yield _lines(name, member, rows)
                            rows = []
                    if rows:
                        yield _lines(name, member, rows)

    listed = spark.createDataFrame(members, "archive string, member string").repartition(max(len(members), 1))
    return listed.mapInArrow(run, "archive string, member string, line_no bigint, line string")


def _lines(archive: str, member: str, rows: list[tuple[int, str]]) -> pa.RecordBatch:
    numbers, lines = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array([archive] * len(rows)), pa.array([member] * len(rows)), pa.array(numbers, pa.int64()), pa.array(lines, pa.string())], names=["archive", "member", "line_no", "line"])


def of_interest(lines: DataFrame, field: int, ids: DataFrame, sep: str = ";") -> DataFrame:
    """Lines whose field (from 1) is among ``ids`` (one column), before anything else of them is parsed; quotes around it don't count."""
    name = ids.columns[0]
    value = F.trim(F.regexp_replace(F.split_part("line", F.lit(sep), F.lit(field)), '^"|"$', ""))
    return lines.withColumn("_id", value).join(ids.select(F.col(name).cast("string").alias("_id")).distinct(), "_id", "left_semi").drop("_id")


def parsed(lines: DataFrame, schema: str, sep: str = ";") -> DataFrame:
    """The rows of zipped registers: header lines go, fields are parsed by ``schema``."""
    return lines.where("line_no > 0").select("archive", "member", "line_no", F.from_csv("line", schema, {"sep": sep}).alias("r")).select("archive", "member", "line_no", "r.*")


def configurations(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON files below a folder with their path and depth, each a whole document."""
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    return rows.withColumn("path", F.col("_metadata.file_path")).withColumn("depth", F.size(F.split("path", "/")))


def merged(configs: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """One row for each key: of each attribute the first value that isn't empty, in order of depth, then path."""
    order = F.struct("depth", "path")
    given = lambda c: F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "", order)
    return configs.groupBy(key).agg(*[F.min_by(c, given(c)).alias(c) for c in attributes])


def united_captures(configs: DataFrame, key: str, captures: str = "captures") -> DataFrame:
    """(key, capture) of the capture lists (type, name, ...) of all files: of one type and name the first in order of depth, path and list."""
    each = configs.select(key, "depth", "path", F.posexplode(captures).alias("place", "capture"))
    name = F.coalesce("capture.name", F.lit(""))
    return each.groupBy(key, F.col("capture.type"), name).agg(F.min_by("capture", F.struct("depth", "path", "place")).alias("capture")).select(key, "capture")


def violations(configs: DataFrame, kinds: list[str], patterns: tuple[str, ...] = ()) -> DataFrame:
    """(name, problem) of each configuration that lacks a name or url, has an unknown kind, a reliability outside 1 to 5, or one of the
    ``patterns`` columns that is no regular expression: each different one is compiled once, on the driver."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    checks = {"no name": blank("name"), "no url": blank("url"), "unknown kind": ~F.coalesce(F.col("kind").isin(*kinds), F.lit(False)), "reliability": ~F.coalesce(F.col("reliability").between(1, 5), F.lit(False))}
    for column in patterns:
        broken = [r[0] for r in configs.select(column).where(F.col(column).isNotNull()).distinct().toLocalIterator() if not _compiles(r[0])]
        checks[f"{column} is no pattern"] = F.coalesce(F.col(column).isin(*broken), F.lit(False)) if broken else F.lit(False)
    found = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]), lambda x: x.isNotNull())
    return configs.select("name", F.explode(found).alias("problem"))


def _compiles(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def checked(configs: DataFrame, kinds: list[str], patterns: tuple[str, ...] = ()) -> DataFrame:
    """``configs`` if none violates a rule, else an error that lists what does: nothing loads while something is wrong."""
    if wrong := violations(configs, kinds, patterns).limit(20).collect():
        raise ValueError("; ".join(f"{r['name']}: {r['problem']}" for r in wrong))
    return configs


def preferred_recording(recordings: DataFrame, models: list[str]) -> DataFrame:
    """Of each document the recording to use: by the order of ``models``, else the latest; ties by folder."""
    place = F.array_position(F.array(*map(F.lit, models)), F.col("model"))
    return first_by(recordings, ["sha"], [F.when(place == 0, len(models) + 1).otherwise(place), F.col("folder"), F.desc("recorded_at")])


def municipalities(spark: SparkSession, path: str) -> DataFrame:
    """(code, name) of a JSON list of municipalities, compressed or not."""
    return spark.read.schema("id bigint, nome string").option("multiLine", True).json(path).select(F.col("id").alias("code"), F.col("nome").alias("name"))


def recordings(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Recorded readings with sha (16 digits), model and folder from their path: ``.../folder/sha_model.json``."""
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    part = lambda i: F.regexp_extract(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), r"([^/]*)/([0-9a-f]{16})_([^/]+)\.json$", i)
    return rows.select("*", part(1).alias("folder"), part(2).alias("sha"), part(3).alias("model")).where("sha <> ''")


def write_recordings(readings: DataFrame, path: str) -> None:
    """Readings (sha, model, body) as JSON, by sha and model; a reading that is written again replaces itself only."""
    readings.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sha", "model").json(path)


def operator_mapping(configs: DataFrame) -> DataFrame:
    """(registration, channel, report) of configurations (path, registration, channel, report): of several the last file's."""
    return last_wins(configs, ["registration"], [F.col("path")]).select("registration", "channel", "report")


def write_swapped(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    """Replaces the partitions that ``df`` has, and only those, so that rerunning a document replaces its rows."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Rebuilds a table beside the old one and swaps them by renaming, so that a reader finds either whole. ``df`` may read ``path``."""
    aside = f"{path}.{uuid.uuid4().hex}"
    df.write.parquet(f"{aside}.new")
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path
    store = at(path).getFileSystem(conf)
    if store.exists(at(path)):
        store.rename(at(path), at(f"{aside}.old"))
    if not store.rename(at(f"{aside}.new"), at(path)):
        raise OSError(f"{path} could not be put in place; the new table is {aside}.new")
    store.delete(at(f"{aside}.old"), True)


def save_documents(events: DataFrame, columns: DataFrame, cells: DataFrame, folder: str) -> None:
    """Columns, cells and events (doc, ...) of reconciled documents: each document's earlier columns and cells are replaced, of its earlier
    events (resolved) those that aren't resolved. Other documents stay as they are."""
    spark, path = columns.sparkSession, f"{folder}/events"
    write_swapped(columns, f"{folder}/columns", ["doc"])
    write_swapped(cells, f"{folder}/cells", ["doc"])
    docs, all_ = columns.select("doc").distinct(), events
    if _exists(spark, path):
        earlier = spark.read.schema(events.schema).parquet(path)
        all_ = events.unionByName(earlier.where("resolved").join(docs, "doc", "left_semi").select(*events.columns))
        emptied = earlier.join(docs, "doc", "left_semi").join(all_.select("doc").distinct(), "doc", "left_anti").select("doc").distinct()
        all_ = all_.unionByName(emptied.withColumn("resolved", F.lit(None).cast("boolean")), allowMissingColumns=True)  # a mark, so that its partition is replaced
    write_swapped(written(all_.select(*events.columns), "events"), path, ["doc"])


def saved_events(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{folder}/events").where("resolved is not null")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def write_reports(columns: DataFrame, cells: DataFrame, findings: DataFrame, path: str) -> None:
    """A JSON report for each document: its columns with their cells and findings in order. A document's rows are few."""
    of = lambda df, name: df.groupBy("doc", "column").agg(F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c not in ("doc", "column")]))).alias(name))
    whole = columns.join(of(cells, "cells"), ["doc", "column"], "left").join(of(findings, "findings"), ["doc", "column"], "left")
    rest = ["column", *[c for c in whole.columns if c not in ("doc", "column")]]
    whole.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("columns")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc").json(path)


def export_snapshot(offers: DataFrame, peers: DataFrame, key: str, path: str) -> None:
    """Offers as JSON lines for a page without a server, each with the keys of the offers of other sources to compare it with (key, peer)."""
    listed = peers.groupBy(key).agg(F.array_sort(F.collect_set("peer")).alias("peers"))
    offers.join(listed, key, "left").write.mode("overwrite").json(path)


def export_answers(whole: dict[str, DataFrame], each: dict[str, tuple[DataFrame, str]], path: str) -> None:
    """Answers as JSON lines for a page without a server: ``whole`` ones in a folder each, those in ``each`` in a folder for each value of a column, which the
    folder's name tells. An answer without rows is an empty folder. What is there from before is replaced."""
    for name, df in whole.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
    for name, (df, key) in each.items():
        df.withColumn("_key", F.col(key)).repartition("_key").write.mode("overwrite").partitionBy("_key").json(f"{path}/{name}")


def mail_authenticated(headers: Column, domain: Column, server: str = "") -> Column:
    """Whether a mailbox's server confirmed that a message is its sender's domain's: DMARC passed for it, or a DKIM signature of it did. A header
    that another server than ``server`` wrote proves nothing; what a sender puts into the message is such a header.

    A header is the server's name and its results, parted by semicolons; a result is ``method=result`` and properties as ``name=value``, parted by blanks."""
    words = lambda text: F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    asked = F.lower(domain)

    def covers(value):
        """The domain itself or one below it, as a domain or behind an @."""
        host = F.substring_index(value, "@", -1)
        return (host == asked) | host.endswith(F.concat(F.lit("."), asked))

    def proves(result, method, names):
        told = lambda w: F.substring_index(w, "=", 1).isin(*names) & covers(F.substr(w, F.instr(w, "=") + 1))
        return F.array_contains(result, f"{method}=pass") & F.exists(result, told)

    parts = F.transform(headers, lambda h: F.transform(F.split(h, ";"), words))
    heard = F.filter(parts, lambda p: F.coalesce(F.get(F.get(p, F.lit(0)), F.lit(0)) == server.lower(), F.lit(False))) if server else parts
    results = F.flatten(heard)
    found = F.exists(results, lambda r: proves(r, "dmarc", ("header.from",)) | proves(r, "dkim", ("header.d", "header.i")))
    return F.coalesce(found & (asked != ""), F.lit(False))


def mail_from_trusted(messages: DataFrame, senders: list[str], server: str = "", authenticated: bool = True) -> DataFrame:
    """Messages (sender, headers) from listed addresses, or domains ('@x.com') and their subdomains, that ``server`` confirmed (``mail_authenticated``)."""
    address = F.lower(F.regexp_extract("sender", r"([^<>\s]+@[^<>\s]+)", 1))
    domain = F.substring_index(address, "@", -1)
    listed = F.exists(
        F.array(*[F.lit(s.lower().strip()) for s in senders]),
        lambda s: F.when(s.startswith("@"), (domain == F.substr(s, F.lit(2))) | domain.endswith(F.concat(F.lit("."), F.substr(s, F.lit(2))))).otherwise(address == s),
    )
    kept = messages.where(listed)
    return kept.where(mail_authenticated(F.col("headers"), domain, server)) if authenticated else kept


def api_items(responses: DataFrame, path: str, url: str = "url", title: str = "title") -> DataFrame:
    """(url, title) of the items of JSON responses (body): ``path`` leads to the list, the address may be a text or a list of texts."""
    items = F.explode(F.variant_get(F.parse_json("body"), F.lit(path), "array<variant>"))
    field = lambda name, kind: F.try_variant_get("i", F.lit(f"$.{name}"), kind)
    addresses = F.coalesce(field(url, "array<string>"), F.array(field(url, "string")))
    return responses.select(items.alias("i")).select(F.explode(addresses).alias("url"), field(title, "string").alias("title")).where("url is not null")
