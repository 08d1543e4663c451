"""Queries on collection: runs, series, registers, configurations, recordings, and the figures of reviewed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from planwatch.functions import bands
from planwatch.operators import collecting, events, reconcile
from planwatch.plans.prices import KEYS, RULES, STATUS, reconcile_status, review_flag
from planwatch.plans.registers import LINKS, network_summary
from planwatch.plans.registry import Tables, query
from planwatch.plans.views import PRICES, prices, wide
from planwatch.sources import files

TODAY = "2024-01-15"


@query("WITH seen AS (SELECT user_id AS key, event_id % 3 AS source, arg_min(event_type, (ts, event_type)) AS series FROM events WHERE event_type <> 'view' GROUP BY ALL), docs AS (SELECT o_custkey AS key, arg_min('doc_' || o_orderstatus, o_orderkey) AS series FROM orders WHERE o_custkey % 2 = 0 GROUP BY ALL) SELECT c_custkey AS key, coalesce(s.series, d.series, 's' || c_nationkey % 3 || '_' || c_custkey) AS series FROM customer LEFT JOIN seen s ON s.key = c_custkey AND s.source = c_nationkey % 3 LEFT JOIN docs d ON d.key = c_custkey")
def series_resolution(t: Tables) -> DataFrame:
    items = t.customer.select(F.col("c_custkey").alias("key"), (F.col("c_nationkey") % 3).alias("source"))
    seen = t.events.where("event_type <> 'view'").select(F.col("user_id").alias("key"), (F.col("event_id") % 3).alias("source"), F.col("event_type").alias("series"), F.col("ts").alias("at"))
    docs = t.orders.where("o_custkey % 2 = 0").select(F.col("o_custkey").alias("key"), F.concat(F.lit("doc_"), "o_orderstatus").alias("series"), F.col("o_orderkey").alias("at"))
    stem = F.concat(F.lit("s"), F.col("source").cast("string"), F.lit("_"), F.col("key").cast("string"))
    return collecting.resolved_series(items, seen, docs, stem).select("key", "series")


@query("WITH x AS (SELECT CAST(ts AS DATE) AS run, CASE WHEN event_type = 'error' THEN 'error' WHEN row_number() OVER w = 1 THEN 'new' WHEN floor(value / 50) = lag(floor(value / 50)) OVER w THEN 'unchanged' ELSE 'known' END AS outcome FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)) SELECT run, count(*) AS found, count(*) FILTER (outcome = 'new') AS new, count(*) FILTER (outcome = 'known') AS known, count(*) FILTER (outcome = 'unchanged') AS unchanged, count(*) FILTER (outcome = 'blocked') AS blocked, count(*) FILTER (outcome = 'error') AS error FROM x GROUP BY run")
def run_counters(t: Tables) -> DataFrame:
    w = W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    content = F.floor(F.col("value") / 50)
    outcome = F.when(F.col("event_type") == "error", "error").when(F.row_number().over(w) == 1, "new").when(content == F.lag(content).over(w), "unchanged").otherwise("known")
    return collecting.run_counters(t.events.select(F.col("ts").cast("date").alias("run"), outcome.alias("outcome")), ["run"])


@query("WITH r AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS found FROM events GROUP BY ALL) SELECT user_id, day, found, last_value(CASE WHEN found >= 2 THEN found END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r")
def last_results(t: Tables) -> DataFrame:
    runs = t.events.groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("found"))
    return collecting.last_results(runs, ["user_id"], "day", "found", 2)


@query("SELECT s_suppkey, s_acctbal, fresh FROM (SELECT coalesce(n.s_suppkey, o.s_suppkey) AS s_suppkey, CASE WHEN n.s_suppkey IS NULL THEN o.s_acctbal ELSE n.s_acctbal END AS s_acctbal, n.s_suppkey IS NOT NULL AS fresh FROM (SELECT s_suppkey, s_acctbal FROM supplier WHERE s_suppkey % 4 <> 0) o FULL JOIN (SELECT s_suppkey, s_acctbal * 2 AS s_acctbal FROM supplier WHERE s_suppkey % 3 = 0) n ON n.s_suppkey = o.s_suppkey)")
def source_upsert(t: Tables) -> DataFrame:
    s = t.supplier.select("s_suppkey", "s_acctbal")
    return collecting.loaded(s.where("s_suppkey % 4 <> 0"), s.where("s_suppkey % 3 = 0").withColumn("s_acctbal", F.col("s_acctbal") * 2), ["s_suppkey"])


@query("SELECT lpad(key, 6, '0') AS key, bool_and(active) AS active FROM (SELECT CAST(s_suppkey AS VARCHAR) AS key, true AS active FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT CAST(s_suppkey AS VARCHAR), false FROM supplier WHERE s_suppkey % 5 = 0) GROUP BY 1")
def register_union(t: Tables) -> DataFrame:
    s = t.supplier.select("s_suppkey", F.col("s_suppkey").cast("string").alias("key"))
    return files.both_registers(s.where("s_suppkey % 3 <> 0").select("key"), s.where("s_suppkey % 5 = 0").select("key"), "key").select("key", "active")


@query("WITH c AS (SELECT p_brand AS brand, p_size AS depth, lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS path, CASE WHEN p_partkey % 4 = 0 THEN ' ' ELSE p_name END AS name, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_type END AS type FROM part) SELECT brand, arg_min(name, (depth, path)) FILTER (trim(name) <> '') AS name, arg_min(type, (depth, path)) FILTER (type IS NOT NULL) AS type FROM c GROUP BY brand")
def config_merge(t: Tables) -> DataFrame:
    name, kind = F.when(F.col("p_partkey") % 4 == 0, " ").otherwise(F.col("p_name")), F.when(F.col("p_partkey") % 3 != 0, F.col("p_type"))
    path = F.lpad(F.col("p_partkey").cast("string"), 12, "0")
    return files.merged(t.part.select(F.col("p_brand").alias("brand"), F.col("p_size").alias("depth"), path.alias("path"), name.alias("name"), kind.alias("type")), "brand", ["name", "type"])


CONFIGS = "c AS (SELECT CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE s_name END AS name, CASE WHEN s_suppkey % 5 <> 0 THEN s_name END AS url, CASE WHEN s_suppkey % 4 = 0 THEN 'page' WHEN s_suppkey % 4 = 1 THEN 'url' WHEN s_suppkey % 4 = 2 THEN 'fax' END AS kind, s_suppkey % 7 AS reliability FROM supplier)"


@query(f"WITH {CONFIGS} SELECT name, 'no name' AS problem FROM c WHERE name = '' UNION ALL SELECT name, 'no url' FROM c WHERE url IS NULL UNION ALL SELECT name, 'unknown kind' FROM c WHERE coalesce(kind, '') NOT IN ('page', 'url') UNION ALL SELECT name, 'reliability' FROM c WHERE reliability NOT BETWEEN 1 AND 5")
def config_violations(t: Tables) -> DataFrame:
    n = F.col("s_suppkey")
    kind = F.when(n % 4 == 0, "page").when(n % 4 == 1, "url").when(n % 4 == 2, "fax")
    made = t.supplier.select(F.when(n % 7 == 0, "").otherwise(F.col("s_name")).alias("name"), F.when(n % 5 != 0, F.col("s_name")).alias("url"), kind.alias("kind"), (n % 7).alias("reliability"))
    return files.violations(made, ["page", "url"])


@query("SELECT o_custkey AS sha, o_orderpriority AS model, o_orderkey AS recorded_at FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END, o_orderstatus, o_orderkey DESC) = 1")
def recording_choice(t: Tables) -> DataFrame:
    made = t.orders.select(F.col("o_custkey").alias("sha"), F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("folder"), F.col("o_orderkey").alias("recorded_at"))
    return files.preferred_recording(made, ["1-URGENT", "3-MEDIUM"]).select("sha", "model", "recorded_at")


@query("WITH n AS (SELECT l_suppkey AS plan, l_partkey % 3 AS note, CAST(date_trunc('year', l_shipdate) AS DATE) AS dated, CAST(l_quantity AS BIGINT) % 10 AS band, l_orderkey * 10 + l_linenumber AS loaded, l_partkey AS vcm FROM lineitem), m AS (SELECT *, max(dated) OVER (PARTITION BY plan, note) AS last FROM n) SELECT plan, note, band, arg_max(dated, loaded) AS dated, max(loaded) AS loaded, arg_max(vcm, loaded) AS vcm FROM m WHERE dated = last GROUP BY plan, note, band")
def latest_notes(t: Tables) -> DataFrame:
    """Of each plan and note the bands of its latest date, each as it was loaded last."""
    notes = t.lineitem.select(F.col("l_suppkey").alias("plan"), (F.col("l_partkey") % 3).alias("note"), F.trunc("l_shipdate", "year").alias("dated"), (F.col("l_quantity").cast("bigint") % 10).alias("band"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("loaded"), F.col("l_partkey").alias("vcm"))
    return collecting.latest_notes(notes)


@query("WITH c AS (SELECT c_custkey AS key, c_nationkey AS source FROM customer), s AS (SELECT user_id AS key, event_id % 3 AS source FROM events UNION SELECT o_custkey, o_orderkey % 25 FROM orders) SELECT key, CAST(source AS BIGINT) AS source FROM c WHERE (key, source) IN (SELECT (key, source) FROM s)")
def known_series(t: Tables) -> DataFrame:
    candidates = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_nationkey").cast("bigint").alias("source"))
    seen = t.events.select((F.col("event_id") % 3).cast("bigint").alias("source"), F.col("user_id").alias("key"))
    return collecting.of_known_series(candidates, seen, t.orders.select((F.col("o_orderkey") % 25).cast("bigint").alias("source"), F.col("o_custkey").alias("key"))).select("key", "source")


@query("WITH r AS (SELECT user_id AS capture, event_id AS run, ts, CASE WHEN event_type = 'click' THEN 'error' ELSE 'ok' END AS outcome, CAST(floor(value / 30) AS BIGINT) AS found FROM events), b AS (SELECT *, last_value(CASE WHEN outcome = 'ok' AND found > 0 THEN found END IGNORE NULLS) OVER (PARTITION BY capture ORDER BY ts, run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r) SELECT run, CASE WHEN outcome = 'error' THEN 'failed' ELSE 'found_nothing' END AS kind, CASE WHEN outcome = 'error' THEN 'no answer' ELSE 'found nothing, ' || before || ' before' END AS message FROM b WHERE outcome = 'error' OR (found = 0 AND before IS NOT NULL AND capture % 2 = 0)")
def run_alerts(t: Tables) -> DataFrame:
    runs = t.events.select(F.col("user_id").alias("capture"), F.col("event_id").alias("run"), F.struct("ts", "event_id").alias("at"), F.when(F.col("event_type") == "click", "error").otherwise("ok").alias("outcome"), F.lit("no answer").alias("message"), F.floor(F.col("value") / 30).alias("found"), (F.col("user_id") % 2 == 0).alias("complete"))
    return events.of_runs(runs)


@query(f"WITH {STATUS}, c AS (SELECT source, version, count(*) AS cells, count(*) FILTER (status = 'confirmed') AS confirmed, count(*) FILTER (status <> 'confirmed') AS to_review, count(*) FILTER (status IN ('only_a', 'only_b')) AS alone FROM cells GROUP BY ALL) SELECT source, count(*) AS documents, CAST(sum(cells) AS BIGINT) AS cells, CAST(sum(confirmed) AS BIGINT) AS confirmed, CAST(sum(to_review) AS BIGINT) AS to_review, CAST(sum(alone) AS BIGINT) AS alone FROM c GROUP BY source")
def run_totals(t: Tables) -> DataFrame:
    """What reading each source's documents comes to; their summaries are those of their cells."""
    cells = reconcile_status(t).withColumns({"review": F.col("status") != "confirmed", "chosen": F.lit(None).cast("bigint")})
    each = reconcile.summary(cells, ["source", "version"])
    return collecting.run_totals(each.withColumn("alone", F.col("only_a") + F.col("only_b")), ["source"])


@query("SELECT conv_id, count(DISTINCT role || ':' || len(text) // 40) AS kinds, string_agg(DISTINCT role || ':' || len(text) // 40, ',' ORDER BY role || ':' || len(text) // 40) AS listed FROM conversations GROUP BY ALL")
def distinct_entries(t: Tables) -> DataFrame:
    """Entries of several pages, equal ones once however many fields they have."""
    entry = F.struct("role", F.expr("length(text) div 40").alias("size"))
    found = t.conversations.groupBy("conv_id").agg(F.array_distinct(F.array_sort(F.collect_list(entry))).alias("e"))
    listed = F.array_sort(F.transform("e", lambda x: F.concat_ws(":", x["role"], x["size"].cast("string"))))
    return found.select("conv_id", F.size("e").cast("bigint").alias("kinds"), F.array_join(listed, ",").alias("listed"))


@query("WITH n AS (SELECT o_custkey AS plan, CAST(o_orderdate AS DATE) AS noted, o_orderkey AS note, o_orderstatus AS band FROM orders) SELECT plan, noted, count(*) AS notes, string_agg(note || ':' || band, ',' ORDER BY note) AS listed FROM n GROUP BY ALL")
def notes_by_date(t: Tables) -> DataFrame:
    notes = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus")))
    dated = t.orders.groupBy(F.col("o_custkey").alias("plan"), F.col("o_orderdate").cast("date").alias("noted")).agg(F.count("*").alias("notes"), notes.alias("n"))
    return dated.select("plan", "noted", "notes", F.array_join(F.transform("n", lambda x: F.concat_ws(":", x["o_orderkey"].cast("string"), x["o_orderstatus"])), ",").alias("listed"))


@query(f"SELECT event_id, row_number() OVER w AS place, CAST(ts AS DATE) <= DATE '{TODAY}' AND coalesce(lag(CAST(ts AS DATE)) OVER w > DATE '{TODAY}', true) AS today FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)")
def event_timeline(t: Tables) -> DataFrame:
    """Each user's events, newest first; today marks the first that isn't ahead."""
    w, day = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")), F.col("ts").cast("date")
    past = lambda d: d <= F.lit(TODAY).cast("date")
    return t.events.select("event_id", F.row_number().over(w).cast("bigint").alias("place"), (past(day) & ~F.coalesce(past(F.lag(day).over(w)), F.lit(False))).alias("today"))


ON_PAGE = "l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_linestatus"


@query(f"SELECT l_orderkey, l_linenumber, coalesce(nullif(l_returnflag, 'N'), first_value(l_linestatus) OVER (PARTITION BY l_orderkey ORDER BY {ON_PAGE} ROWS UNBOUNDED PRECEDING)) AS tag FROM lineitem")
def page_default(t: Tables) -> DataFrame:
    """A table's own tag, else that of the topmost table of its page."""
    w = W.partitionBy("l_orderkey").orderBy(*ON_PAGE.split(", ")).rowsBetween(W.unboundedPreceding, 0)
    return t.lineitem.select("l_orderkey", "l_linenumber", F.coalesce(F.nullif(F.col("l_returnflag"), F.lit("N")), F.first("l_linestatus").over(w)).alias("tag"))


@query(f"WITH {PRICES} SELECT product, source, version, band, lag(band) OVER w AS before, cents / lag(cents) OVER w AS ratio FROM prices WINDOW w AS (PARTITION BY product, source, version ORDER BY band)")
def band_transitions(t: Tables) -> DataFrame:
    """The ratio of each price to that of the band sold before it."""
    w = W.partitionBy(*KEYS).orderBy("band")
    return prices(t).select(*KEYS, "band", F.lag("band").over(w).alias("before"), F.try_divide("cents", F.lag("cents").over(w)).alias("ratio"))


@query(f"WITH {PRICES}, f AS (SELECT product, source, version, min(band) AS first_band FROM prices GROUP BY ALL), b AS (SELECT product, source, version, CAST(unnest(range(first_band, 10)) AS INT) AS band FROM f) SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM prices p WHERE p.product = b.product AND p.source = b.source AND p.version = b.version AND p.band = b.band)")
def unread_bands(t: Tables) -> DataFrame:
    return wide(t).select(*KEYS, F.explode(bands.unread(F.col("prices"))).alias("band"))


@query(f"WITH {PRICES} SELECT product, source, version, max(cents) / min(cents) - 1 AS dispersion FROM prices GROUP BY ALL")
def price_dispersion(t: Tables) -> DataFrame:
    return wide(t).select(*KEYS, (F.try_divide(F.array_max("prices"), F.array_min("prices")) - 1).alias("dispersion"))


@query(f"WITH {STATUS}, {RULES}, named AS (SELECT DISTINCT product, source, version, unnest(bands) AS band FROM found WHERE severity <> 'info'), v AS (SELECT c.source, NOT (status <> 'confirmed' OR n.band IS NOT NULL) AS fit FROM cells c LEFT JOIN named n ON c.product = n.product AND c.source = n.source AND c.version = n.version AND c.band = n.band) SELECT source, count(*) AS cells, count(*) FILTER (fit) AS automatic, count(*) FILTER (fit) / count(*) AS share FROM v GROUP BY source")
def automation_rate(t: Tables) -> DataFrame:
    """How many prices need no review, by source."""
    automatic = F.count_if(~F.col("review"))
    return review_flag(t).groupBy("source").agg(F.count("*").alias("cells"), automatic.alias("automatic"), (automatic / F.count("*")).alias("share"))


@query(f"WITH {PRICES}, v AS (SELECT DISTINCT product, source, version FROM prices) SELECT source, product, count(*) AS versions, string_agg(CAST(version AS VARCHAR), ',' ORDER BY version DESC) AS listed FROM v GROUP BY ALL")
def history_listing(t: Tables) -> DataFrame:
    """The versions of each chain, newest first."""
    dates = F.reverse(F.array_sort(F.collect_set("version")))
    return prices(t).groupBy("source", "product").agg(F.count_distinct("version").alias("versions"), F.array_join(F.transform(dates, lambda d: d.cast("string")), ",").alias("listed"))


@query(f"WITH {LINKS}, s AS (SELECT plan, region, count(DISTINCT CASE WHEN urgent THEN hospital END) AS urgent FROM links GROUP BY plan, region) SELECT plan, CAST(sum(urgent) AS BIGINT) AS urgent FROM s GROUP BY plan")
def urgent_total(t: Tables) -> DataFrame:
    """The sum over a plan's map of regions."""
    regions = F.map_from_entries(F.collect_list(F.struct("region", "urgent")))
    return network_summary(t).groupBy("plan").agg(regions.alias("m")).select("plan", F.aggregate(F.map_values("m"), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("urgent"))
