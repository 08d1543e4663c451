"""Queries on registers, networks, events and figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from planwatch.functions.text import formatted_registration
from planwatch.operators import collecting, headers, lookup, network, overview, quote, rules
from planwatch.plans.registry import Tables, query

TODAY = "2024-01-31"


@query("SELECT c.c_custkey, o.o_orderkey, o.o_orderstatus FROM customer c LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderpriority <> '1-URGENT', o_orderkey) AS n FROM orders) o ON o.o_custkey = c.c_custkey AND n = 1")
def catalog_top1(t: Tables) -> DataFrame:
    """Each customer with the best of their orders: a left join to a dimension that was reduced to one row a key."""
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    best = lookup.first_by(t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority"), ["o_custkey"], [rank, F.col("o_orderpriority") != "1-URGENT", F.col("o_orderkey")])
    return t.customer.select("c_custkey").join(best, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey", "o_orderstatus")


MATERIALS = "materials AS (SELECT DISTINCT o_custkey AS plan, CAST(l_shipdate AS DATE) AS material FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1 AND o_custkey % 3 <> 0), notes AS (SELECT DISTINCT o_custkey AS plan, CAST(o_orderdate AS DATE) AS noted FROM orders WHERE o_custkey % 7 <> 0)"


def _materials(t: Tables) -> tuple[DataFrame, DataFrame]:
    m = t.lineitem.where("l_linenumber = 1").join(t.orders.where("o_custkey % 3 <> 0"), F.col("l_orderkey") == F.col("o_orderkey"))
    notes = t.orders.where("o_custkey % 7 <> 0").select(F.col("o_custkey").alias("plan"), F.col("o_orderdate").cast("date").alias("noted")).distinct()
    return m.select(F.col("o_custkey").alias("plan"), F.col("l_shipdate").cast("date").alias("material")).distinct(), notes


@query(f"WITH {MATERIALS} SELECT m.plan, m.material, coalesce(max(noted) FILTER (noted <= material), min(noted)) AS note_date FROM materials m LEFT JOIN notes n ON m.plan = n.plan GROUP BY ALL")
def note_asof(t: Tables) -> DataFrame:
    return lookup.as_of(*_materials(t), "plan", "material", "noted")


@query(f"WITH {MATERIALS}, hit AS (SELECT m.plan, material, noted AS note_date FROM materials m JOIN notes n ON m.plan = n.plan AND noted BETWEEN material - 365 AND material + 180) SELECT * FROM hit UNION ALL SELECT m.plan, m.material, coalesce(max(noted) FILTER (noted <= material), min(noted)) FROM materials m LEFT JOIN notes n ON m.plan = n.plan WHERE (m.plan, m.material) NOT IN (SELECT (plan, material) FROM hit) GROUP BY ALL")
def note_interval(t: Tables) -> DataFrame:
    return lookup.plausible(*_materials(t), "plan", "material", "noted")


@query("SELECT o_custkey AS plan, max(CAST(o_orderdate AS DATE)) AS last_note, date_diff('day', DATE '1998-01-01', max(CAST(o_orderdate AS DATE))) > 30 AS newer FROM orders GROUP BY ALL")
def latest_note(t: Tables) -> DataFrame:
    last = t.orders.groupBy(F.col("o_custkey").alias("plan")).agg(F.max(F.col("o_orderdate").cast("date")).alias("last_note"))
    return last.withColumn("newer", rules.newer_note(F.col("last_note"), F.lit("1998-01-01").cast("date")))


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def upsert_last_wins(t: Tables) -> DataFrame:
    return lookup.last_wins(t.events, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING')")
def active_semi(t: Tables) -> DataFrame:
    active = t.customer.where("c_acctbal > 0 and c_mktsegment = 'BUILDING'")
    return t.orders.join(active, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT DISTINCT user_id, event_type FROM events e WHERE ts >= (SELECT min(ts) FROM events) + INTERVAL 3 DAY AND NOT EXISTS (SELECT 1 FROM events r WHERE r.user_id = e.user_id AND r.event_type = e.event_type AND r.ts < (SELECT min(ts) FROM events) + INTERVAL 3 DAY)")
def event_anti(t: Tables) -> DataFrame:
    first = t.events.agg(F.min("ts").alias("first"))
    dated = t.events.join(F.broadcast(first)).withColumn("late", F.col("ts") >= F.col("first") + F.expr("INTERVAL 3 DAY"))  # one row is broadcast
    return lookup.not_yet(dated.where("late").select("user_id", "event_type"), dated.where("not late"), ["user_id", "event_type"])


@query("SELECT s_suppkey, coalesce(nullif(CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE s_name END, ''), n_name, CAST(s_nationkey AS VARCHAR)) AS place FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_nationkey % 5 <> 0")
def municipality_fallback(t: Tables) -> DataFrame:
    name = F.when(F.col("s_suppkey") % 4 == 0, F.lit("")).otherwise(F.col("s_name"))
    links = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("code"), name.alias("municipality"))
    return network.municipality(links, t.nation.where("n_nationkey % 5 <> 0").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"))).select("s_suppkey", F.col("municipality").alias("place"))


@query("WITH p AS (SELECT event_id, event_id % 5 AS page, CAST(event_id % 1000 AS DOUBLE) AS x FROM events), a AS (SELECT n_nationkey, n_regionkey AS page, n_nationkey * 41.0::DOUBLE AS pos FROM nation WHERE n_nationkey % 4 <> 2) SELECT event_id, page, x, n_nationkey, abs(x - pos) AS distance FROM p JOIN a USING (page) WHERE abs(x - pos) <= 124.6 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(x - pos), n_nationkey) = 1")
def nearest_header(t: Tables) -> DataFrame:
    anchors = t.nation.where("n_nationkey % 4 <> 2").select("n_nationkey", F.col("n_regionkey").cast("bigint").alias("page"), (F.col("n_nationkey") * F.lit(41.0)).alias("at"))
    points = t.events.select("event_id", (F.col("event_id") % 5).cast("bigint").alias("page"), (F.col("event_id") % 1000).cast("double").alias("x"))
    return lookup.nearest(points, anchors, ["page"], "x", "at", 124.6, [F.col("n_nationkey")]).select("event_id", "page", "x", "n_nationkey", "distance")


@query("""WITH cols AS (SELECT l_orderkey AS tab, l_linenumber AS col, CAST(60 * l_linenumber + min(l_suppkey % 7) AS DOUBLE) AS x FROM lineitem GROUP BY l_orderkey, l_linenumber), digits AS (SELECT *, lpad(CAST(l_partkey * 7919 % 1000000000 AS VARCHAR), 9, '0') AS d FROM lineitem),
words AS (SELECT row_number() OVER () AS id, l_orderkey AS tab, CAST(40 + l_partkey % 400 AS DOUBLE) AS xc, CAST(l_quantity * 2 AS DOUBLE) AS yc, CASE WHEN l_linenumber % 3 = 0 THEN 'Plano' || l_suppkey ELSE d[1:3] || '.' || d[4:6] || '/' || d[7:8] || '-' || d[9:9] END AS text, CASE WHEN l_linenumber % 3 <> 0 THEN d END AS registration FROM digits),
steps AS (SELECT tab, coalesce(min(gap), 200) AS step FROM (SELECT tab, x - lag(x) OVER (PARTITION BY tab ORDER BY x) AS gap FROM cols) GROUP BY tab), pairs AS (SELECT w.*, col, abs(x - xc) AS away, step FROM words w JOIN cols USING (tab) JOIN steps USING (tab)),
near AS (SELECT * FROM pairs WHERE registration IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY away, col) = 1), held AS (SELECT tab, col, registration FROM near WHERE away <= 0.6 * step QUALIFY row_number() OVER (PARTITION BY tab, col ORDER BY yc DESC, xc, text) = 1),
said AS (SELECT tab, col, right(string_agg(text, ' ' ORDER BY yc, xc, text), 80) AS header FROM pairs WHERE registration IS NULL AND away <= 0.5 * step GROUP BY tab, col)
SELECT tab, col, held.registration, coalesce(header, '') AS header FROM cols LEFT JOIN held USING (tab, col) LEFT JOIN said USING (tab, col)""")
def header_registrations(t: Tables) -> DataFrame:
    """A table an order, a column a line number; each line is a word of the header, so registrations compete for columns."""
    digits = F.lpad((F.col("l_partkey") * 7919 % 1000000000).cast("string"), 9, "0")
    columns = t.lineitem.groupBy(F.col("l_orderkey").alias("tab"), F.col("l_linenumber").alias("column")).agg(F.min(F.col("l_suppkey") % 7).alias("x")).withColumn("x", (60 * F.col("column") + F.col("x")).cast("double"))
    text = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("Plano"), F.col("l_suppkey").cast("string"))).otherwise(formatted_registration(digits))
    at = (40 + F.col("l_partkey") % 400).cast("double")
    words = t.lineitem.select(F.col("l_orderkey").alias("tab"), text.alias("text"), at.alias("x0"), at.alias("xc"), (F.col("l_quantity") * 2).cast("double").alias("yc")).withColumn("below", 120 - F.col("yc"))
    return headers.assigned(columns, words, ["tab"]).select("tab", F.col("column").alias("col"), "registration", "header")


LINKS = "links AS (SELECT l_partkey // 10 AS plan, s_nationkey AS region, l_suppkey AS hospital, l_linestatus = 'O' AS urgent, l_orderkey, l_linenumber, l_shipdate FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag <> 'R')"


def _links(t: Tables) -> DataFrame:
    ended = F.when(F.col("l_returnflag") == "R", F.lit("2000-01-01"))
    joined = network.active(t.lineitem.withColumn("end", ended), "end").join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    return joined.select(F.expr("l_partkey div 10").alias("plan"), F.col("s_nationkey").alias("region"), F.col("l_suppkey").alias("hospital"), (F.col("l_linestatus") == "O").alias("urgent"), "l_orderkey", "l_linenumber", "l_shipdate")


@query(f"WITH {LINKS} SELECT plan, region, count(DISTINCT hospital) AS hospitals, count(DISTINCT CASE WHEN urgent THEN hospital END) AS urgent FROM links GROUP BY plan, region")
def network_summary(t: Tables) -> DataFrame:
    return network.summary(_links(t), "plan", "region", "hospital", F.col("urgent"))


@query(f"WITH {LINKS} SELECT plan, hospital, urgent, l_orderkey, l_linenumber FROM links QUALIFY row_number() OVER (PARTITION BY plan, hospital ORDER BY urgent DESC, l_orderkey DESC, l_linenumber DESC) = 1")
def network_hospitals(t: Tables) -> DataFrame:
    return network.one_row_each(_links(t), ["plan", "hospital"], F.struct("urgent", "l_orderkey", "l_linenumber"), ["urgent", "l_orderkey", "l_linenumber"])


@query(f"WITH {LINKS}, s AS (SELECT plan, region, count(DISTINCT hospital) AS hospitals, count(DISTINCT CASE WHEN urgent THEN hospital END) AS urgent FROM links GROUP BY plan, region) SELECT plan, CAST(sum(hospitals) AS BIGINT) AS hospitals, CAST(sum(urgent) AS BIGINT) AS urgent, string_agg(region || ':' || hospitals, ',' ORDER BY region) AS by_region FROM s GROUP BY plan")
def network_total(t: Tables) -> DataFrame:
    total = network.totals(network_summary(t), "plan", "region")
    return total.withColumn("by_region", F.array_join(F.transform(F.map_entries("by_region"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ","))


@query("WITH x AS (SELECT o_custkey AS protocol, l_returnflag = 'R' AS out_, l_linestatus || l_suppkey % 5 AS name, l_orderkey * 10 + l_linenumber AS seq FROM lineitem JOIN orders ON o_orderkey = l_orderkey), f AS (SELECT protocol, out_, name, min(seq) AS seq FROM x GROUP BY ALL), k AS (SELECT DISTINCT protocol FROM x) SELECT protocol, coalesce(string_agg(name, ',' ORDER BY seq, name) FILTER (out_), '') AS excluded, coalesce(string_agg(name, ',' ORDER BY seq, name) FILTER (NOT out_), '') AS included FROM k JOIN f USING (protocol) GROUP BY protocol")
def changes_by_protocol(t: Tables) -> DataFrame:
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    named = lines.select(F.col("o_custkey").alias("protocol"), "l_returnflag", F.concat("l_linestatus", (F.col("l_suppkey") % 5).cast("string")).alias("name"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    out = F.col("l_returnflag") == "R"
    listed = network.changes(named, "protocol", "at", {"excluded": (out, "name"), "included": (~out, "name")})
    return listed.select("protocol", F.array_join("excluded", ",").alias("excluded"), F.array_join("included", ",").alias("included"))


@query("SELECT o_orderkey, o_custkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus LIKE 'F%' AND CAST(o_orderdate AS DATE) >= DATE '1995-06-17' - 90 AND (c_nationkey = 3 OR o_custkey % 25 = 3)")
def approved_changes(t: Tables) -> DataFrame:
    requests = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(
        "o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "F", "DEFERIDO").otherwise("negado").alias("result"), F.col("o_orderdate").cast("date").alias("effective"),
        F.col("c_nationkey").cast("string").alias("region_out"), (F.col("o_custkey") % 25).cast("string").alias("region_in"),
    )
    return network.approved(requests, F.lit("1995-06-17").cast("date"), region="3").select("o_orderkey", "o_custkey")


@query("SELECT count(*) AS events, count(DISTINCT user_id) AS users, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (value > 50) AS high, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k_total, count(DISTINCT event_type) AS types, min(ts) AS first_, max(ts) AS last_, count(*) FILTER (ts < TIMESTAMP '2024-01-31') AS expired_kpi, count(*) FILTER (CAST(ts AS DATE) <= DATE '2024-01-31') AS expired_event FROM events")
def kpi_dashboard(t: Tables) -> DataFrame:
    k, day = F.get_json_object("props", "$.k").cast("bigint"), F.lit(TODAY)
    return t.events.agg(
        F.count("*").alias("events"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("value") > 50).alias("high"), F.sum(k).alias("k_total"), F.count_distinct("event_type").alias("types"),
        F.min("ts").alias("first_"), F.max("ts").alias("last_"), F.count_if(F.col("ts") < day.cast("timestamp")).alias("expired_kpi"), F.count_if(F.col("ts").cast("date") <= day.cast("date")).alias("expired_event"),
    )


@query("""WITH d AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'O' THEN 'review' ELSE 'error' END AS status, o_custkey % 50 AS w, CASE WHEN o_custkey % 4 <> 0 THEN o_custkey % 7 END AS r, o_orderkey % 1000 AS cost FROM orders), s AS (SELECT string_agg(status || ':' || n, ',' ORDER BY status) AS by_status FROM (SELECT status, count(*) AS n FROM d GROUP BY status)),
dd AS (SELECT count(*) AS documents, CAST(sum(w) AS BIGINT) AS with_product, CAST(sum(w) - sum(r) AS BIGINT) AS automatic_with_product, CAST(sum(cost) AS BIGINT) AS cost FROM d),
c AS (SELECT count(*) AS prices, count(*) FILTER (l_returnflag = 'A') AS confirmed, count(*) FILTER (l_linestatus = 'F' AND l_quantity <= 25) AS automatic, count(*) FILTER (l_linestatus <> 'F' AND l_partkey % 5 <> 0) AS to_review, count(*) FILTER (l_partkey % 5 = 0) AS without_product FROM lineitem),
v AS (SELECT count(*) AS tables, count(DISTINCT p_brand) AS operators, count(*) FILTER (p_size < 20) AS expired FROM part WHERE p_size % 3 <> 0), e AS (SELECT count(*) FILTER (event_type NOT IN ('view', 'click')) AS open_events FROM events) SELECT * FROM dd, s, c, v, e""")
def dashboard(t: Tables) -> DataFrame:
    """The fourteen figures of the start page; costs in millionths."""
    status = F.when(F.col("o_orderstatus") == "F", "published").when(F.col("o_orderstatus") == "O", "review").otherwise("error")
    docs = t.orders.select(status.alias("status"), (F.col("o_custkey") % 50).alias("with_product"), F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey") % 7).alias("open_with_product"), (F.col("o_orderkey") % 1000).alias("cost"))
    cells = t.lineitem.select(F.when(F.col("l_partkey") % 5 != 0, F.col("l_partkey").cast("string")).alias("product"), F.when(F.col("l_returnflag") == "A", "confirmed").otherwise("divergent").alias("status"), (F.col("l_linestatus") != "F").alias("review"), (F.col("l_quantity") > 25).alias("corrected"))
    versions = t.part.select(F.col("p_brand").alias("operator"), F.date_add(F.lit("2024-01-11").cast("date"), F.col("p_size").cast("int")).alias("until"), (F.col("p_size") % 3 != 0).alias("is_current"))
    told = t.events.select((F.col("event_type") == "view").alias("resolved"), F.when(F.col("event_type") == "click", "info").otherwise("alert").alias("severity"))
    row = overview.figures(docs, cells, versions, told, F.lit(TODAY).cast("date"))
    return row.withColumn("by_status", F.array_join(F.transform(F.map_entries("by_status"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ","))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY ALL")
def event_counts(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@query("SELECT n_nationkey, segment FROM (SELECT c_nationkey AS n_nationkey, c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY n_nationkey ORDER BY n DESC, segment) = 1")
def dominant_operator(t: Tables) -> DataFrame:
    return t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.mode("c_mktsegment", True).alias("segment"))


@query("SELECT user_id, event_type FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first_id) = 1")
def first_seen_mode(t: Tables) -> DataFrame:
    counts = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    return lookup.first_by(counts, ["user_id"], [F.desc("n"), F.col("first")]).select("user_id", "event_type")


@query("SELECT conv_id, count(*) AS pages, string_agg(text, ' | ' ORDER BY turn) AS text, string_agg(DISTINCT role, ',' ORDER BY role) AS roles, string_agg('p' || turn || '.' || role, ',' ORDER BY turn) AS ids FROM conversations GROUP BY ALL")
def page_merge(t: Tables) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    c = t.conversations.groupBy("conv_id").agg(turns.alias("p"))
    return c.select(
        "conv_id", F.size("p").cast("bigint").alias("pages"), F.array_join("p.text", " | ").alias("text"), F.array_join(F.array_sort(F.array_distinct("p.role")), ",").alias("roles"),
        F.array_join(F.transform("p", lambda x: F.concat(F.lit("p"), x["turn"].cast("string"), F.lit("."), x["role"])), ",").alias("ids"),
    )


@query("WITH rates AS (SELECT * FROM (VALUES ('PROMO', 3), ('PROMO BURNISHED', 5), ('STANDARD', 2), ('ECONOMY ANODIZED', 4), ('E', 1)) v(prefix, rate)), r AS (SELECT p_partkey, p_type, p_size, arg_max(rate, length(prefix)) AS rate FROM part JOIN rates ON starts_with(p_type, prefix) GROUP BY ALL) SELECT p_type, count(*) AS n, CAST(sum(p_size * rate) AS BIGINT) AS cost FROM r GROUP BY ALL")
def cost_rollup(t: Tables) -> DataFrame:
    """Costs by the rate whose name is the longest prefix of the type. The five rates are broadcast; the join is on each prefix's length."""
    rates = t.spark.createDataFrame([("PROMO", 3), ("PROMO BURNISHED", 5), ("STANDARD", 2), ("ECONOMY ANODIZED", 4), ("E", 1)], "prefix string, rate int")
    types = t.part.groupBy("p_type").agg(F.count("*").alias("n"), F.sum("p_size").alias("size"))
    held = types.join(F.broadcast(rates), F.col("p_type").startswith(F.col("prefix")))
    return held.groupBy("p_type", "n", "size").agg(F.max_by("rate", F.length("prefix")).alias("rate")).select("p_type", "n", (F.col("size") * F.col("rate")).alias("cost"))


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_partkey % 3 ORDER BY l_tax = 0, l_suppkey, l_linenumber) - 1 AS occurrence FROM lineitem")
def occurrence_number(t: Tables) -> DataFrame:
    w = W.partitionBy("l_orderkey", F.col("l_partkey") % 3).orderBy(F.col("l_tax") == 0, "l_suppkey", "l_linenumber")
    return t.lineitem.select("l_orderkey", "l_linenumber", (F.row_number().over(w) - 1).cast("bigint").alias("occurrence"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%an%' OR p_brand ILIKE '%an%' OR CAST(p_partkey AS VARCHAR) LIKE '%12%' ORDER BY p_partkey LIMIT 500")
def text_search(t: Tables) -> DataFrame:
    """The first 500 by key whose name or brand holds the text, or whose key holds its digits: a search page."""
    hit = F.col("p_name").ilike("%an%") | F.col("p_brand").ilike("%an%") | F.col("p_partkey").cast("string").contains("12")
    return t.part.where(hit).select("p_partkey", "p_name").orderBy("p_partkey").limit(500)


@query("SELECT event_id, ts, event_type FROM events WHERE event_type <> 'view' ORDER BY ts DESC, event_id DESC LIMIT 12")
def latest_events(t: Tables) -> DataFrame:
    return t.events.where("event_type <> 'view'").select("event_id", "ts", "event_type").orderBy(F.desc("ts"), F.desc("event_id")).limit(12)


@query("SELECT l_suppkey AS id FROM lineitem WHERE l_returnflag = 'R' UNION SELECT s_suppkey FROM supplier WHERE s_acctbal > 0")
def union_distinct(t: Tables) -> DataFrame:
    return t.lineitem.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("id")).union(t.supplier.where("s_acctbal > 0").select("s_suppkey")).distinct()


@query("SELECT DISTINCT s_name AS asked, p_brand AS operator FROM part JOIN supplier ON contains(lower(p_brand), CASE WHEN s_suppkey % 3 = 0 THEN 'brand' ELSE 'rand#' || s_suppkey % 7 END)")
def name_contains(t: Tables) -> DataFrame:
    """Suppliers with the makers whose name holds the first word of theirs, which is made up here as few makers' names are words."""
    word = F.when(F.col("s_suppkey") % 3 == 0, F.lit("Brand of")).otherwise(F.concat(F.lit("Rand#"), (F.col("s_suppkey") % 7).cast("string"), F.lit(" & sons")))
    asked = t.supplier.select("s_name", word.alias("name"))
    found = collecting.tables_of_operators(asked, t.part.select(F.col("p_brand").alias("operator")).distinct())
    return found.join(asked, F.col("asked") == F.col("name")).select(F.col("s_name").alias("asked"), "operator")


@query("SELECT p_partkey, p_name, active FROM (SELECT p_partkey, p_name, p_size % 2 = 0 AS active FROM part) WHERE contains(upper(p_name), 'AL')")
def operator_search(t: Tables) -> DataFrame:
    named = t.part.select("p_partkey", F.col("p_name").alias("name"), F.lit(None).cast("string").alias("trade_name"), (F.col("p_size") % 2 == 0).alias("active"))
    return collecting.operators_by_name(named, "al").select("p_partkey", F.col("name").alias("p_name"), "active")


@query("WITH plans AS (SELECT p_partkey AS plan, p_size AS operator, CASE p_size % 5 WHEN 0 THEN 'suspended' WHEN 1 THEN 'cancelled' ELSE 'active' END AS status FROM part WHERE p_partkey % 6 <> 0), ops AS (SELECT DISTINCT p_size AS operator, p_size % 4 <> 0 AS active FROM part), c AS (SELECT DISTINCT l_partkey AS plan FROM lineitem) SELECT plan, rule, severity FROM (SELECT c.plan, 'unknown_plan' AS rule, 'error' AS severity FROM c LEFT JOIN plans p ON c.plan = p.plan WHERE p.plan IS NULL UNION ALL SELECT plan, CASE WHEN status = 'suspended' THEN 'suspended' ELSE 'not_active' END, CASE WHEN status = 'suspended' THEN 'alert' ELSE 'error' END FROM c JOIN plans USING (plan) WHERE status <> 'active' UNION ALL SELECT plan, 'operator_cancelled', 'error' FROM c JOIN plans USING (plan) JOIN ops USING (operator) WHERE NOT active)")
def plan_status(t: Tables) -> DataFrame:
    status = F.when(F.col("p_size") % 5 == 0, "suspended").when(F.col("p_size") % 5 == 1, "cancelled").otherwise("active")
    plans = t.part.where("p_partkey % 6 <> 0").select(F.col("p_partkey").alias("plan"), F.col("p_size").alias("operator"), status.alias("status"))
    ops = t.part.select(F.col("p_size").alias("operator"), (F.col("p_size") % 4 != 0).alias("active")).distinct()
    return rules.plan_status(t.lineitem.select(F.col("l_partkey").alias("plan")).distinct(), plans, ops, "plan", "operator")


@query("SELECT CASE WHEN event_type = 'purchase' THEN 'expiry' ELSE 'sync' END AS kind, user_id, max(CAST(ts AS DATE)) AS at FROM events WHERE CAST(ts AS DATE) <= DATE '2024-01-15' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND CAST(ts AS DATE) <= DATE '2024-01-10') GROUP BY ALL")
def expiry_events(t: Tables) -> DataFrame:
    """A daily sync: what has run out by the day, without those already told, one event for each key."""
    dated = t.events.withColumn("day", F.col("ts").cast("date"))
    told = dated.where("event_type = 'signup' and day <= date'2024-01-10'").select("user_id").distinct()
    kind = F.when(F.col("event_type") == "purchase", "expiry").otherwise("sync")
    return dated.where("day <= date'2024-01-15'").join(told, "user_id", "left_anti").groupBy(kind.alias("kind"), "user_id").agg(F.max("day").alias("at"))


@query("SELECT user_id, day, found, found < 2 AND lag(found) OVER (PARTITION BY user_id ORDER BY day) >= 2 AS broke FROM (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS found FROM events GROUP BY ALL)")
def source_broke(t: Tables) -> DataFrame:
    """Runs that found little after one that found much; there are no runs of zero in the data, so less than two counts."""
    runs = t.events.groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("found"))
    before = F.lag("found").over(W.partitionBy("user_id").orderBy("day"))
    return runs.withColumn("broke", (F.col("found") < 2) & (before >= 2))


@query(f"""WITH {LINKS}, offers AS (SELECT DISTINCT l_partkey // 10 AS product, l_suppkey % 3 AS source, l_suppkey // 3 % 2 AS place FROM lineitem), peers AS (SELECT a.product, a.source, a.place, string_agg(b.source || ':' || b.place, ',' ORDER BY b.source) AS peers FROM offers a JOIN offers b ON a.product = b.product AND a.source <> b.source AND a.place = b.place GROUP BY ALL),
net AS (SELECT plan AS product, string_agg(region || ':' || hospitals, ',' ORDER BY region) AS network FROM (SELECT plan, region, count(DISTINCT hospital) AS hospitals FROM links GROUP BY ALL) GROUP BY ALL),
asked AS (SELECT DISTINCT l_partkey // 10 AS product, l_orderkey AS protocol, s_nationkey AS region, CAST(l_shipdate AS DATE) AS effective FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag = 'R'),
ahead AS (SELECT product, string_agg(DISTINCT protocol, ',' ORDER BY protocol) AS changes_ahead FROM asked WHERE effective >= DATE '1999-01-01' GROUP BY ALL), regions AS (SELECT product, string_agg(region || ':' || n, ',' ORDER BY region) AS changes_by_region FROM (SELECT product, region, count(DISTINCT protocol) AS n FROM asked GROUP BY ALL) GROUP BY ALL)
SELECT product, source, place, coalesce(peers, '') AS peers, coalesce(network, '') AS network, coalesce(changes_ahead, '') AS changes_ahead, coalesce(changes_by_region, '') AS changes_by_region FROM offers LEFT JOIN peers USING (product, source, place) LEFT JOIN net USING (product) LEFT JOIN ahead USING (product) LEFT JOIN regions USING (product)""")
def quote_base(t: Tables) -> DataFrame:
    """What a page without the engine makes quotes from; lists as texts."""
    plan = F.expr("l_partkey div 10").alias("product")
    place = F.expr("l_suppkey div 3") % 2
    offers = t.lineitem.select(plan, (F.col("l_suppkey") % 3).alias("source"), place.alias("place")).distinct().withColumn("tags", F.array(F.concat(F.lit("grupo: "), F.col("place").cast("string"))))
    asked = t.lineitem.where("l_returnflag = 'R'").join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).select(plan, F.col("l_orderkey").alias("protocol"), F.col("s_nationkey").alias("region"), F.col("l_shipdate").cast("date").alias("effective"))
    found = quote.base(offers, network_summary(t).withColumnRenamed("plan", "product"), asked, F.lit("1999-01-01").cast("date"))
    pairs = lambda c, f: F.array_join(F.transform(c, f), ",").alias(c)
    joined = lambda a, b: F.concat_ws(":", a.cast("string"), b.cast("string"))
    return found.select("product", "source", "place", pairs("peers", lambda p: joined(p["source"], p["place"])), pairs("network", lambda n: joined(n["region"], n["hospitals"])), pairs("changes_ahead", lambda p: p.cast("string")), pairs("changes_by_region", lambda r: joined(r["region"], F.size(r["protocols"]))))
