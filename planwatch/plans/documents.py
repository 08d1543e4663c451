"""Queries on documents: layouts, publishing, events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planwatch.functions.bands import LABELS
from planwatch.operators import events, layout, publish
from planwatch.plans.registry import Tables, query
from planwatch.plans.views import PRICES, WIDE, prices, wide


#: Where the versions of all years to 1997 go in chains of even years to 1996.
PLACED = """w AS (SELECT product, source, CAST(year(version) AS INT) AS doc, version AS dated, CAST(prices AS VARCHAR) AS p FROM wide), c AS (SELECT *, doc = 1996 AS cur FROM w WHERE doc % 2 = 0 AND doc <= 1996),
b AS (SELECT o.product, o.source, o.doc, arg_max(c.p, c.dated) AS bp, arg_max(c.cur, c.dated) AS bcur FROM w o JOIN c ON o.product = c.product AND o.source = c.source AND c.dated <= o.dated GROUP BY ALL), a AS (SELECT o.product, o.source, o.doc, arg_min(c.p, c.dated) AS ap FROM w o JOIN c ON o.product = c.product AND o.source = c.source AND c.dated > o.dated GROUP BY ALL),
placed AS (SELECT w.*, CASE WHEN (product, source, doc) IN (SELECT (product, source, doc) FROM c) THEN 'there' WHEN ap IS NULL AND coalesce(bcur, false) THEN 'deferred' WHEN coalesce(bp = p, false) OR coalesce(ap = p, false) THEN 'equal' ELSE 'inserted' END AS action FROM w LEFT JOIN b USING (product, source, doc) LEFT JOIN a USING (product, source, doc) WHERE doc <= 1997)"""
DRAWN = "WITH c AS (SELECT p_partkey // 4 AS doc, p_partkey % 4 AS col, p_size FROM part), "


def _cells(t: Tables) -> DataFrame:
    """(doc, col, n, b, price text): ten prices for each part, four parts a document."""
    each = t.part.select(F.expr("p_partkey div 4").alias("doc"), (F.col("p_partkey") % 4).cast("int").alias("col"), F.col("p_partkey").alias("n"), "p_size").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(9))))
    cents = F.col("p_size") * 1000 + 12345 + F.col("b") * 777
    return each.withColumn("text", F.translate(F.format_number(cents / 100, 2), ",.", ".,"))


@query(DRAWN + """w AS (SELECT *, dense_rank() OVER (PARTITION BY doc ORDER BY col) - 1 AS place FROM c) SELECT doc, CAST(1 AS INT) AS page, CAST(0 AS INT) AS "table", CAST(place AS INT) AS "column", CAST(b AS INT) AS band, (p_size * 1000 + 12345 + b * 777)::DOUBLE / 100 AS price FROM w, range(10) r(b)""")
def geometric_grid(t: Tables) -> DataFrame:
    """Price grids drawn as words, a page for each four parts, slightly out of line, some with a digit drawn apart, and read back."""
    cell = _cells(t)
    y = 100 + F.col("b") * 20.0 + (F.col("n") % 3) * 0.5
    x = 200.0 + F.col("col") * 80
    apart = (F.col("n") % 5 == 0) & F.col("text").rlike(r"^\d{3}")
    word = lambda text, x0, x1: F.struct(text.alias("text"), x0.alias("x0"), x1.alias("x1"))
    drawn = F.when(apart, F.array(word(F.left("text", F.lit(1)), x, x + 8), word(F.substr("text", F.lit(2)), x + 8.2, x + 40))).otherwise(F.array(word(F.col("text"), x, x + 40)))
    price = cell.select("doc", F.explode(drawn).alias("w"), y.alias("top"), (y + 10).alias("base")).select("doc", "w.*", "top", "base")
    labels = F.element_at(F.array(*map(F.lit, LABELS)), F.col("b") + 1)
    y0 = 100 + F.col("b") * 20.0
    named = cell.select("doc", "b").distinct().select("doc", labels.alias("text"), F.lit(50.0).alias("x0"), F.lit(90.0).alias("x1"), y0.alias("top"), (y0 + 10).alias("base"))
    words = price.unionByName(named).withColumn("page", F.lit(1)).select("doc", "page", "text", "x0", "x1", "top", "base")
    return layout.grids(words)


@query(r"""WITH p AS (SELECT l_orderkey AS doc, l_linenumber AS line, min(l_partkey) AS l_partkey, CAST(round(min(l_extendedprice) * 100) AS BIGINT) AS cents FROM lineitem GROUP BY ALL), a AS (SELECT *, CAST(cents // 100 AS VARCHAR) AS whole, lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS part FROM p),
i AS (SELECT doc, line, unnest(CASE l_partkey % 4 WHEN 0 THEN [whole, ',' || part] WHEN 1 THEN [whole, ',', part] WHEN 2 THEN [whole || ',', part, ',x', ',' , 'y'] ELSE [whole, part] END) AS piece, generate_subscripts(CASE l_partkey % 4 WHEN 0 THEN [1, 2] WHEN 1 THEN [1, 2, 3] WHEN 2 THEN [1, 2, 3, 4, 5] ELSE [1, 2] END, 1) AS n FROM a),
g AS (SELECT *, sum(CASE WHEN n > 1 AND (starts_with(piece, ',') OR ends_with(before, ',')) THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY line, n) AS island FROM (SELECT *, lag(piece) OVER (PARTITION BY doc, line ORDER BY n) AS before FROM i))
SELECT doc, CAST(min(line) AS INT) AS line, string_agg(piece, '' ORDER BY n) AS text, CAST(min(n) * 20 + 80 AS DOUBLE) AS x0, CAST(max(n) * 20 + 99 AS DOUBLE) AS x1 FROM g GROUP BY doc, island""")
def joined_pieces(t: Tables) -> DataFrame:
    """Amounts that a scan parts at the comma into two to five words, and some whose parts are no pieces of one, a line for each number of an order's rows."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    rows = layout.dealt(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"), by=["l_orderkey"], words=3)
    one = rows.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_extendedprice").alias("l_extendedprice"))
    a = one.select(F.col("l_orderkey").alias("doc"), "l_linenumber", "l_partkey", F.floor(cents / 100).cast("string").alias("whole"), F.lpad((cents % 100).cast("string"), 2, "0").alias("part"))
    k, comma = F.col("l_partkey") % 4, F.lit(",")
    pieces = F.when(k == 0, F.array(F.col("whole"), F.concat(comma, "part"))).when(k == 1, F.array(F.col("whole"), comma, F.col("part"))).when(k == 2, F.array(F.concat("whole", comma), F.col("part"), F.lit(",x"), comma, F.lit("y"))).otherwise(F.array("whole", "part"))
    words = a.select("doc", F.lit(1).alias("page"), F.posexplode(pieces).alias("n", "text"), (F.col("l_linenumber") * 12.0).alias("top")).select("doc", "page", "text", (F.col("n") * 20.0 + 100).alias("x0"), (F.col("n") * 20.0 + 119).alias("x1"), "top", (F.col("top") + 8).alias("base"))
    return layout.whole_amounts(words).select("doc", F.round(F.col("top") / 12).cast("int").alias("line"), "text", "x0", "x1")


@query(DRAWN + """r AS (SELECT *, p_size % 7 <> 0 AS sold FROM c) SELECT doc, CAST(b AS INT) AS band, (p_size * 1000 + 12345 + b * 777)::DOUBLE / 100 AS price, lpad(CAST(doc * 4 + col AS VARCHAR), 9, '0') AS product, 'Plano ' || col || ' ' || lpad(CAST(doc * 4 + col AS VARCHAR), 9, '0') AS heading FROM r, range(10) x(b) WHERE sold OR b < 6""")
def transposed_grid(t: Tables) -> DataFrame:
    """Tables whose head names the bands and whose rows are products, drawn as words and read back."""
    cell = _cells(t)
    y, x = 140.0 + F.col("col") * 20, 200.0 + F.col("b") * 60
    price = cell.where("p_size % 7 <> 0 or b < 6").select("doc", "text", x.alias("x0"), (x + 40).alias("x1"), y.alias("top"), (y + 10).alias("base"))
    number = F.lpad(F.col("n").cast("string"), 9, "0")
    own = F.explode(F.array(F.struct(F.lit("Plano").alias("text"), F.lit(10.0).alias("x0")), F.struct(F.col("col").cast("string").alias("text"), F.lit(60.0).alias("x0")), F.struct(number.alias("text"), F.lit(90.0).alias("x0"))))
    first = cell.where("b = 0").select("doc", own.alias("w"), y.alias("top"), (y + 10).alias("base")).select("doc", "w.text", "w.x0", (F.col("w.x0") + 25).alias("x1"), "top", "base")
    labels = F.element_at(F.array(*map(F.lit, LABELS)), F.col("b") + 1)
    head = cell.select("doc", "b").distinct().select("doc", labels.alias("text"), (200.0 + F.col("b") * 60).alias("x0"), (240.0 + F.col("b") * 60).alias("x1"), F.lit(100.0).alias("top"), F.lit(110.0).alias("base"))
    words = price.unionByName(first).unionByName(head).withColumn("page", F.lit(1)).select("doc", "page", "text", "x0", "x1", "top", "base")
    return layout.transposed_grids(words).select("doc", "band", "price", "product", "heading")


@query("WITH d AS (SELECT o_custkey AS series, o_orderkey AS doc, CAST(o_orderdate AS DATE) AS dated, CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'O' THEN 'review' ELSE 'error' END AS status FROM orders), k AS (SELECT series, max(dated) AS newest FROM d WHERE status <> 'error' GROUP BY series), n AS (SELECT * FROM d WHERE doc % 3 = 0 AND status <> 'error'), e AS (SELECT n.doc, max(d.dated) AS before FROM n JOIN d ON d.series = n.series AND d.dated < n.dated GROUP BY n.doc) SELECT n.doc, CASE WHEN newest > n.dated THEN 'older' WHEN before IS NOT NULL THEN 'version' ELSE 'first' END AS kind, (CASE WHEN newest > n.dated THEN 'version of ' || strftime(n.dated, '%d/%m/%Y') || ', before that of ' || strftime(newest, '%d/%m/%Y') WHEN before IS NOT NULL THEN 'new version; the one before is of ' || strftime(before, '%d/%m/%Y') ELSE 'not seen before' END) || '; checked' AS message FROM n JOIN k USING (series) LEFT JOIN e ON e.doc = n.doc")
def capture_alerts(t: Tables) -> DataFrame:
    docs = _documents(t)
    return events.of_captures(docs.where("doc % 3 = 0 and status <> 'error'").select("doc", "series", "dated", F.array(F.lit("checked")).alias("notes")), docs)


def _documents(t: Tables) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "published").when(F.col("o_orderstatus") == "O", "review").otherwise("error")
    return t.orders.select(F.col("o_custkey").alias("series"), F.col("o_orderkey").alias("doc"), F.col("o_orderdate").cast("date").alias("dated"), status.alias("status"))


@query("WITH d AS (SELECT o_custkey AS series, o_orderkey AS doc, CAST(o_orderdate AS DATE) AS dated, CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'O' THEN 'review' ELSE 'error' END AS status FROM orders) SELECT doc, series, dated, status FROM d WHERE status = 'review' AND EXISTS (SELECT 1 FROM d e WHERE e.series = d.series AND e.dated > d.dated AND e.status <> 'error')")
def history_documents(t: Tables) -> DataFrame:
    return publish.history_documents(_documents(t)).select("doc", "series", "dated", "status")


@query("WITH c AS (SELECT l_orderkey AS doc, l_partkey AS product, l_linenumber AS place, l_returnflag AS col FROM lineitem), d AS (SELECT o_orderkey AS doc, o_orderpriority AS operator, o_orderstatus AS contract FROM orders), p AS (SELECT p_partkey AS product, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_name END AS name, p_brand AS operator, p_type AS contract FROM part WHERE p_partkey % 3 <> 0) SELECT c.doc, c.product, c.place, CASE WHEN p.product IS NULL THEN col ELSE p.name END AS name, CASE WHEN p.product IS NULL THEN d.operator ELSE p.operator END AS operator, CASE WHEN p.product IS NULL THEN d.contract ELSE p.contract END AS contract FROM c JOIN d USING (doc) LEFT JOIN p ON p.product = c.product")
def published_columns(t: Tables) -> DataFrame:
    columns = t.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("product"), F.col("l_linenumber").alias("place"), F.col("l_returnflag").alias("column"))
    docs = t.orders.select(F.col("o_orderkey").alias("doc"), F.col("o_orderpriority").alias("operator"), F.col("o_orderstatus").alias("contract"))
    plans = t.part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("product"), F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_name")).alias("name"), F.col("p_brand").alias("operator"), F.col("p_type").alias("contract"))
    return publish.published_columns(columns, docs, plans).select("doc", "product", "place", "name", "operator", "contract")


@query("WITH a AS (SELECT 'operator_cancelled' AS kind, CAST(s_suppkey AS VARCHAR) AS key, 'error' AS severity FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL SELECT 'plan_not_active', CAST(p_partkey AS VARCHAR), 'alert' FROM part WHERE p_size % 3 <> 0 UNION ALL SELECT DISTINCT 'network_changed', CAST(l_orderkey AS VARCHAR), 'info' FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 'newer_note', c_custkey || ':' || c_nationkey, 'alert' FROM customer WHERE c_nationkey < 5 UNION ALL SELECT 'expired', CAST(o_orderkey AS VARCHAR), 'alert' FROM orders WHERE o_orderstatus = 'F' AND CAST(o_orderdate AS DATE) <= DATE '1994-06-01'), r AS (SELECT kind, key FROM a WHERE len(key) % 2 = 0 AND (kind <> 'plan_not_active' OR CAST(key AS BIGINT) % 2 = 0)) SELECT * FROM a WHERE (kind, key) NOT IN (SELECT (kind, key) FROM r)")
def daily_sync(t: Tables) -> DataFrame:
    """Five syncs as one table; half of what they say was told before, of plans only where the event is still open."""
    operators = t.supplier.select(F.col("s_suppkey").alias("operator"), (F.col("s_suppkey") % 4 != 0).alias("active"))
    plans = t.part.select(F.col("p_partkey").alias("plan"), F.when(F.col("p_size") % 3 == 0, "active").when(F.col("p_size") % 3 == 1, "suspended").alias("status"))
    changes = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("protocol"), F.lit("info").alias("severity")).distinct()
    notes = t.customer.where("c_nationkey < 5").select(F.concat_ws(":", F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")).alias("key"))
    docs = t.orders.select(F.col("o_orderkey").alias("doc"), F.col("o_orderdate").cast("date").alias("until"), F.when(F.col("o_orderstatus") == "F", "published").otherwise("history").alias("status"))
    nothing = t.spark.createDataFrame([], "kind string, key string, resolved boolean")
    today = F.lit("1994-06-01").cast("date")
    all_ = events.daily_sync(operators, plans, changes, notes, docs, nothing, today)
    raised = all_.where(F.length("key") % 2 == 0).select("kind", "key", F.when(F.col("kind") == "plan_not_active", F.col("key").cast("bigint") % 2 == 1).otherwise(F.lit(True)).alias("resolved"))
    return events.daily_sync(operators, plans, changes, notes, docs, raised, today)


@query(f"""WITH {WIDE}, o AS (SELECT product, source, CAST(prices AS VARCHAR) AS p, source <> 3 AS cur FROM wide WHERE version = DATE '1996-01-01' AND source <> 4), n AS (SELECT product, source, CAST(prices AS VARCHAR) AS p, source <> 0 AS ok FROM wide WHERE version = DATE '1997-01-01' AND product <> '000000007')
SELECT 's' AS series, coalesce(n.product, o.product) AS product, CASE WHEN n.product IS NULL THEN 'retired' WHEN NOT ok THEN 'blocked' WHEN o.product IS NULL THEN 'first' WHEN cur AND o.p = n.p THEN 'confirmed' ELSE 'version' END AS action,
  CAST(CASE WHEN n.product IS NOT NULL AND ok AND NOT coalesce(cur AND o.p = n.p, false) THEN 1 ELSE 0 END + CASE WHEN o.product IS NOT NULL THEN 1 ELSE 0 END AS INT) AS version,
  CASE WHEN n.product IS NULL THEN CASE WHEN o.product IN (SELECT product FROM n) THEN 'condition_changed' ELSE 'product_removed' END END AS reason FROM o FULL JOIN n ON o.product = n.product AND o.source = n.source WHERE n.product IS NOT NULL OR cur""")
def publish_document(t: Tables) -> DataFrame:
    """The columns of one year published over those of the year before, with conditions by source."""
    w = wide(t).withColumn("tags", F.array(F.concat(F.lit("grupo: "), F.col("source").cast("string"))))
    old = w.where("version = date'1996-01-01' and source <> 4").select(F.lit("s").alias("series"), "product", F.lit(1).alias("version"), F.col("source").alias("place"), "tags", "prices", (F.col("source") != 3).alias("is_current"), F.lit(True).alias("is_head"))
    new = w.where("version = date'1997-01-01' and product <> '000000007'").select(F.lit("s").alias("series"), "product", F.col("source").alias("place"), "tags", "prices", (F.col("source") != 0).alias("publishable"))
    return publish.publish(old, new).select("series", "product", "action", "version", "reason")


@query(f"""WITH {WIDE}, o AS (SELECT product, CAST(source * 7 % 5 + 1 AS INT) AS version, prices, row_number() OVER (PARTITION BY product ORDER BY source) AS k FROM wide WHERE version = DATE '1996-01-01'),
n AS (SELECT product, prices, row_number() OVER (PARTITION BY product ORDER BY source) AS k FROM wide WHERE version = CASE WHEN CAST(product AS BIGINT) % 2 = 0 THEN DATE '1996-01-01' ELSE DATE '1997-01-01' END),
b AS (SELECT coalesce(o.product, n.product) AS product, CASE WHEN n.k IS NULL THEN 'retired' WHEN o.k IS NULL THEN 'first' WHEN o.prices IS NOT DISTINCT FROM n.prices THEN 'confirmed' ELSE 'version' END AS action, coalesce(version, 0) AS version FROM o FULL JOIN n ON o.product = n.product AND o.k = n.k)
SELECT 's' AS series, product, action, CAST(CASE WHEN action IN ('first', 'version') THEN version + 1 ELSE version END AS INT) AS version FROM b""")
def publish_again(t: Tables) -> DataFrame:
    """Documents with several tables of each product and no conditions, published again, half of them unchanged: tables match by their order, whatever their versions."""
    w = wide(t).withColumns({"series": F.lit("s"), "tags": F.array().cast("array<string>"), "place": F.col("source")})
    old = w.where("version = date'1996-01-01'").select("series", "product", (F.col("source") * 7 % 5 + 1).alias("version"), "place", "tags", "prices", F.lit(True).alias("is_current"), F.lit(True).alias("is_head"))
    new = w.where(F.col("version") == F.when(F.col("product").cast("bigint") % 2 == 0, F.lit("1996-01-01").cast("date")).otherwise(F.lit("1997-01-01").cast("date")))
    return publish.publish(old, new.select("series", "product", "place", "tags", "prices", F.lit(True).alias("publishable"))).select("series", "product", "action", "version")


@query(f"""WITH {WIDE}, c AS (SELECT product, source, version, len(list_filter(prices, lambda x: x IS NOT NULL)) AS n, (SELECT min(i) FROM range(10) r(i) WHERE prices[i + 1] IS NOT NULL) AS first_band FROM wide)
SELECT product, source, version, source <> 3 AND n = 10 - first_band AND NOT (source = 1 AND CAST(product AS BIGINT) % 3 = 0) AND NOT (source = 2 AND CAST(product AS BIGINT) % 5 = 0) AS publishable FROM c""")
def publishable_columns(t: Tables) -> DataFrame:
    """Columns that a document may publish: registered, whole, with no price left to review, and not set aside by a reviewer, as those of one source are here."""
    key = F.struct("product", "source", "version")
    number = F.when((F.col("source") == 2) & (F.col("product").cast("bigint") % 5 == 0), "").otherwise(F.col("product"))
    columns = wide(t).withColumns({"column_id": key, "status": F.when(F.col("source") == 3, "ignored").otherwise("open")})
    cells = prices(t).select(key.alias("column_id"), ((F.col("source") == 1) & (F.col("product").cast("bigint") % 3 == 0)).alias("review"))
    return publish.publishable(columns.withColumn("product", number), cells).select("column_id.product", "source", "version", "publishable")


FOLDED = """w AS (SELECT product, source, CAST(year(version) AS INT) AS y, CASE WHEN prices[2] IS NULL THEN 0 ELSE 1 END AS p FROM wide), late AS (SELECT *, row_number() OVER (PARTITION BY product, source ORDER BY y * 3 % 7) AS n FROM w WHERE y <> 2000),
fold AS (
  SELECT product, source, CAST(0 AS BIGINT) AS n, list({'y': y, 'p': p, 'cur': y = 2000} ORDER BY y) AS c, 0 AS doc, '' AS action FROM w WHERE y IN (1996, 2000) GROUP BY product, source
  UNION ALL
  SELECT product, source, n, CASE WHEN act = 'inserted' THEN list_concat(list_concat(head, [{'y': y, 'p': p, 'cur': false}]), tail) ELSE c END, y, act FROM (
    SELECT *, CASE WHEN len(list_filter(c, lambda e: e.y = y)) > 0 THEN 'there' WHEN len(tail) = 0 AND coalesce(head[-1].cur, false) THEN 'deferred' WHEN coalesce(head[-1].p = p, false) OR coalesce(tail[1].p = p, false) THEN 'equal' ELSE 'inserted' END AS act
    FROM (SELECT f.product, f.source, l.n, l.y, l.p, f.c, list_filter(f.c, lambda e: e.y <= l.y) AS head, list_filter(f.c, lambda e: e.y > l.y) AS tail FROM fold f JOIN late l ON l.product = f.product AND l.source = f.source AND l.n = f.n + 1))
)"""


def _late(t: Tables) -> tuple[DataFrame, DataFrame]:
    w = wide(t).select("product", "source", F.year("version").alias("doc"), F.col("version").alias("dated"), F.array(F.when(F.get("prices", F.lit(1)).isNull(), 0).otherwise(1)).alias("prices"))
    return w.where("doc in (1996, 2000)").withColumn("is_current", F.col("doc") == 2000), w.where("doc <> 2000").withColumn("arrived", F.col("doc") * 3 % 7)


@query(f"WITH RECURSIVE {WIDE}, {FOLDED} SELECT product, source, doc, action FROM fold WHERE n > 0")
def history_arrivals(t: Tables) -> DataFrame:
    """Old versions that arrive one by one, in an order that has nothing to do with their dates, many of them equal: which of equal ones stays depends on which came first."""
    return publish.place_in_history(*_late(t), ["product", "source"], "arrived").select("product", "source", "doc", "action")


@query(f"WITH RECURSIVE {WIDE}, {FOLDED}, last AS (SELECT product, source, unnest(c) AS e, generate_subscripts(c, 1) AS version FROM fold QUALIFY n = max(n) OVER (PARTITION BY product, source)) SELECT product, source, e.y AS doc, CAST(version AS INT) AS version, lead(e.y) OVER (PARTITION BY product, source ORDER BY version) AS next_doc, e.cur AS is_current FROM last")
def history_after_arrivals(t: Tables) -> DataFrame:
    """The chains that these arrivals lead to."""
    return publish.inserted_history(*_late(t), ["product", "source"], "arrived").select("product", "source", "doc", "version", "next_doc", "is_current")


@query(f"WITH {WIDE}, {PLACED} SELECT product, source, doc, action FROM placed")
def history_placement(t: Tables) -> DataFrame:
    w = wide(t).select("product", "source", F.year("version").alias("doc"), F.col("version").alias("dated"), "prices")
    chain = w.where("doc % 2 = 0").withColumn("is_current", F.col("doc") == 1996)
    return publish.place_in_history(chain.where("doc <= 1996"), w.where("doc <= 1997"), ["product", "source"]).select("product", "source", "doc", "action")


@query(f"WITH {WIDE}, {PLACED}, whole AS (SELECT product, source, doc, dated, cur FROM c UNION ALL SELECT product, source, doc, dated, false FROM placed WHERE action = 'inserted') SELECT product, source, doc, CAST(row_number() OVER v AS INT) AS version, lead(doc) OVER v AS next_doc, cur AS is_current FROM whole WINDOW v AS (PARTITION BY product, source ORDER BY dated)")
def history_inserted(t: Tables) -> DataFrame:
    """Versions of odd years that arrive late, put into chains of even years and numbered anew."""
    w = wide(t).select("product", "source", F.year("version").alias("doc"), F.col("version").alias("dated"), "prices")
    chain = w.where("doc % 2 = 0 and doc <= 1996").withColumn("is_current", F.col("doc") == 1996)
    return publish.inserted_history(chain, w.where("doc <= 1997"), ["product", "source"]).select("product", "source", "doc", "version", "next_doc", "is_current")


@query("WITH f AS (SELECT user_id AS doc, CASE event_type WHEN 'click' THEN 'suspended' WHEN 'view' THEN 'off_pattern' WHEN 'purchase' THEN 'operator_cancelled' ELSE 'decrease' END AS rule, CASE WHEN value > 50 THEN 'alert' ELSE 'info' END AS severity, props AS message FROM events) SELECT doc, CASE rule WHEN 'suspended' THEN 'plan' WHEN 'off_pattern' THEN 'reference' WHEN 'operator_cancelled' THEN 'operator' ELSE 'table' END AS type, severity, count(DISTINCT message) AS n, CASE WHEN count(DISTINCT message) = 1 THEN min(message) ELSE count(DISTINCT message) || ' findings' END AS title FROM f GROUP BY ALL")
def finding_events(t: Tables) -> DataFrame:
    rule = F.when(F.col("event_type") == "click", "suspended").when(F.col("event_type") == "view", "off_pattern").when(F.col("event_type") == "purchase", "operator_cancelled").otherwise("decrease")
    return events.of_findings(t.events.select(F.col("user_id").alias("doc"), rule.alias("rule"), F.when(F.col("value") > 50, "alert").otherwise("info").alias("severity"), F.col("props").alias("message")))


@query(f"WITH {PRICES}, p AS (SELECT DISTINCT source AS doc, product, version AS dated FROM prices WHERE version < DATE '1997-01-01'), n AS (SELECT product, max(version) AS noted FROM prices WHERE product <> '000000004' GROUP BY product), e AS (SELECT doc, count(DISTINCT product) AS n, max(noted) AS noted FROM p JOIN n USING (product) WHERE date_diff('day', dated, noted) > 30 GROUP BY doc) SELECT doc || ':' || noted AS key, doc, n FROM e WHERE doc <> 2")
def newer_note_events(t: Tables) -> DataFrame:
    p = prices(t)
    published = p.where("version < date'1997-01-01'").select(F.col("source").alias("doc"), "product", F.col("version").alias("dated")).distinct()
    notes = p.where("product <> '000000004'").select("product", F.col("version").alias("noted"))
    raised = notes.agg(F.max("noted").alias("noted")).select(F.concat(F.lit("2:"), F.col("noted").cast("string")).alias("key"))
    return events.of_newer_notes(published, notes, raised)


@query("WITH c AS (SELECT l_orderkey AS protocol, l_partkey // 10 AS plan, count(*) FILTER (l_returnflag <> 'R') AS included FROM lineitem GROUP BY ALL) SELECT protocol, count(DISTINCT plan) AS plans, CASE WHEN max(included) > 0 THEN 'info' ELSE 'alert' END AS severity FROM c WHERE plan IN (SELECT p_partkey // 10 FROM part) AND protocol % 5 <> 0 GROUP BY protocol")
def network_events(t: Tables) -> DataFrame:
    kept = F.array_compact(F.array(F.min(F.when(F.col("l_returnflag") != "R", F.col("l_suppkey")))))  # one hospital that takes a place tells as much as all
    changes = t.lineitem.groupBy(F.col("l_orderkey").alias("protocol"), F.expr("l_partkey div 10").alias("plan")).agg(kept.alias("included"))
    raised = t.orders.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("protocol"))
    return events.of_network_changes(changes, t.part.select(F.expr("p_partkey div 10").alias("plan")).distinct(), raised)
