"""Queries on prices: bands, readings, rules, versions, quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from planwatch.functions import bands, money
from planwatch.operators import collecting, events, extensions, faults, lookup, matching, network, quote, reconcile, rules, versions
from planwatch.plans.registry import Tables, query
from planwatch.plans.views import PRICES, READINGS, WIDE, prices, readings, wide

KEYS = ["product", "source", "version"]


def _latest(t: Tables) -> DataFrame:
    p = prices(t)
    return p.withColumn("_last", F.max("version").over(W.partitionBy("product", "source"))).where("version = _last").drop("_last")


def _quotes(t: Tables) -> DataFrame:
    family = t.spark.createDataFrame([(1, 38), (1, 36), (1, 9), (2, 61), (2, 59), (3, 25)], "request int, age int")
    return quote.quote(_latest(t), family, KEYS)


LATEST = PRICES + ", latest AS (SELECT * FROM prices QUALIFY version = max(version) OVER (PARTITION BY product, source))"
QUOTES = LATEST + """, need AS (SELECT * FROM (VALUES (1, 4, 2), (1, 0, 1), (2, 9, 2), (3, 2, 1)) v(request, band, people)), quotes AS (
  SELECT request, product, source, version, total FROM (SELECT request, product, source, version, CAST(sum(cents * people) AS BIGINT) AS total, count(*) AS met FROM latest JOIN need USING (band) GROUP BY ALL)
  JOIN (SELECT request, count(*) AS wanted FROM need GROUP BY request) USING (request) WHERE met = wanted)"""


@query(f"WITH {QUOTES} SELECT *, CAST(row_number() OVER (PARTITION BY request ORDER BY total, product, source) AS INT) AS place FROM quotes")
def quote_family(t: Tables) -> DataFrame:
    return _quotes(t).withColumn("place", F.row_number().over(W.partitionBy("request").orderBy("total", "product", "source")))


@query(f"WITH {QUOTES} SELECT a.request, a.product, a.source, b.source AS other, b.total - a.total AS difference, CAST(b.total AS DOUBLE) / CAST(a.total AS DOUBLE) - 1 AS ratio, b.version > a.version AS other_newer FROM quotes a JOIN quotes b ON a.request = b.request AND a.product = b.product AND a.source <> b.source WHERE abs(b.total - a.total) >= 1")
def quote_divergence(t: Tables) -> DataFrame:
    return quote.divergences(_quotes(t).withColumn("dated", F.col("version")), "product", "source")


@query(f"WITH {QUOTES} SELECT a.request, a.product, a.source // 2 AS material, b.source // 2 AS other, b.total - a.total AS difference, b.version > a.version AS other_newer FROM quotes a JOIN quotes b ON a.request = b.request AND a.product = b.product AND a.source // 2 <> b.source // 2 AND a.source % 2 = b.source % 2 WHERE abs(b.total - a.total) >= 1")
def quote_divergence_by_condition(t: Tables) -> DataFrame:
    """Materials with two tables of each product: a table is compared with the one of its own condition in each other material, and with no other."""
    two = _quotes(t).withColumns({"dated": F.col("version"), "material": F.expr("source div 2").cast("int"), "place": F.col("source") % 2, "tags": F.array(F.concat(F.lit("grupo: "), F.col("source") % 2))})
    return quote.divergences(two, "product", "material").select("request", "product", "material", "other", "difference", "other_newer")


@query(f"""WITH {QUOTES}, net AS (SELECT lpad(CAST(l_partkey // 10 AS VARCHAR), 9, '0') AS product, count(DISTINCT l_suppkey) AS hospitals, count(DISTINCT CASE WHEN s_nationkey = 3 THEN l_suppkey END) AS here FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL),
ch AS (SELECT lpad(CAST(l_partkey // 10 AS VARCHAR), 9, '0') AS product, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag = 'R' AND s_nationkey = 3 GROUP BY ALL),
o AS (SELECT a.request, a.product, a.source, count(*) AS n FROM quotes a JOIN quotes b ON a.request = b.request AND a.product = b.product AND a.source <> b.source AND a.total <> b.total GROUP BY ALL)
SELECT q.request, q.product, q.source, q.total, CAST(date_diff('day', coalesce(CASE WHEN q.source <> 2 THEN q.version + 30 END, q.version), DATE '1999-01-01') AS INT) AS days, q.source % 2 = 0 AS two_readers, net.hospitals, CASE WHEN here > 0 THEN here END AS hospitals_in_region, coalesce(ch.n, 0) AS network_changes, coalesce(o.n, 0) AS others
FROM quotes q LEFT JOIN net USING (product) LEFT JOIN ch USING (product) LEFT JOIN o ON o.request = q.request AND o.product = q.product AND o.source = q.source""")
def quote_details(t: Tables) -> DataFrame:
    """Quotes with where they come from, the plan's network and its coming changes, and how many other sources disagree."""
    lines = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).select(F.lpad(F.expr("l_partkey div 10").cast("string"), 9, "0").alias("product"), F.col("s_nationkey").cast("string").alias("region"), F.col("l_suppkey").alias("hospital"), "l_orderkey", "l_returnflag")
    networks = network.summary(lines, "product", "region", "hospital", F.lit(False))
    changes = lines.where("l_returnflag = 'R'").select("product", F.col("l_orderkey").alias("protocol"), "region", F.lit("1999-02-01").cast("date").alias("effective"))
    made = _latest(t).select(*KEYS).distinct().withColumns({"dated": F.col("version"), "published": F.col("version").cast("timestamp"), "confirmed": F.when(F.col("source") != 2, F.date_add("version", 30).cast("timestamp")), "readers": F.when(F.col("source") % 2 == 0, 2).otherwise(1)})
    found = quote.detailed(_quotes(t), KEYS, made, networks, changes, F.lit("1999-01-01").cast("timestamp"), region="3")
    return found.select("request", "product", "source", "total", "days", "two_readers", "hospitals", "hospitals_in_region", "network_changes", "others")


@query(f"WITH {PRICES} SELECT product, source, version, band, cents AS price FROM prices")
def band_long_wide(t: Tables) -> DataFrame:
    return bands.to_long(wide(t), KEYS)


@query(f"WITH {WIDE} SELECT product, source, version, CAST(n AS INT) AS n, CAST(first_band AS INT) AS first_band, n = 10 - first_band AS complete, CAST(10 - first_band - n AS INT) AS unread FROM (SELECT product, source, version, count(*) AS n, min(band) AS first_band FROM prices GROUP BY ALL)")
def band_complete(t: Tables) -> DataFrame:
    p = bands.present(F.col("prices"))
    return wide(t).select(*KEYS, F.size(p).alias("n"), F.array_min(p).alias("first_band"), bands.is_complete(F.col("prices")).alias("complete"), F.size(bands.unread(F.col("prices"))).alias("unread"))


@query("SELECT CAST(user_id % 130 - 5 AS INT) AS age, CAST(CASE WHEN user_id % 130 - 5 NOT BETWEEN 0 AND 120 THEN NULL WHEN user_id % 130 - 5 <= 18 THEN 0 WHEN user_id % 130 - 5 >= 59 THEN 9 ELSE (user_id % 130 - 5 - 14) // 5 END AS INT) AS band, count(*) AS n FROM events GROUP BY ALL")
def age_to_band(t: Tables) -> DataFrame:
    age = (F.col("user_id") % 130 - 5).cast("int")
    return t.events.select(age.alias("age"), bands.band_of_age(age).alias("band")).groupBy("age", "band").agg(F.count("*").alias("n"))


@query(f"WITH {READINGS} SELECT *, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN CASE WHEN a = b THEN 'confirmed' ELSE 'divergent' END WHEN a IS NOT NULL THEN 'only_a' ELSE 'only_b' END AS status FROM readings WHERE a IS NOT NULL OR b IS NOT NULL")
def reconcile_status(t: Tables) -> DataFrame:
    return readings(t).withColumn("status", reconcile.status(F.col("a"), F.col("b"))).where("status is not null")


STATUS = READINGS + ", cells AS (SELECT *, CASE WHEN a = b THEN 'confirmed' WHEN a <> b THEN 'divergent' WHEN a IS NOT NULL THEN 'only_a' ELSE 'only_b' END AS status FROM readings WHERE a IS NOT NULL OR b IS NOT NULL)"


@query(f"WITH {STATUS} SELECT product, count(*) FILTER (status = 'confirmed') AS confirmed, count(*) FILTER (status = 'divergent') AS divergent, count(*) FILTER (status = 'only_a') AS only_a, count(*) FILTER (status = 'only_b') AS only_b, count(*) AS cells FROM cells GROUP BY product")
def status_summary(t: Tables) -> DataFrame:
    cells = reconcile_status(t)
    return cells.groupBy("product").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("confirmed", "divergent", "only_a", "only_b")], F.count("*").alias("cells"))


FALLS = "falls AS (SELECT product, source, version, band FROM (SELECT *, lag(cents) OVER (PARTITION BY product, source, version ORDER BY band) AS before FROM prices) WHERE cents < before)"
RULES = FALLS + """, ends AS (SELECT product, source, version, max(cents) FILTER (band = 0) AS p1, max(cents) FILTER (band = 6) AS p7, max(cents) FILTER (band = 9) AS p10 FROM prices GROUP BY ALL), found AS (
  SELECT product, source, version, 'decrease' AS rule, 'error' AS severity, [band] AS bands FROM falls UNION ALL
  SELECT product, source, version, 'incomplete', 'info', [] FROM ends WHERE p1 IS NULL AND p7 IS NOT NULL AND p10 IS NOT NULL UNION ALL
  SELECT product, source, version, 'six_times', 'error', [0, 9] FROM ends WHERE p7 IS NOT NULL AND CAST(p10 AS DOUBLE) > 6 * p1 * CAST(1.001 AS DOUBLE) UNION ALL
  SELECT product, source, version, 'late_rise', 'error', [0, 6, 9] FROM ends WHERE CAST(p10 * p1 AS DOUBLE) > p7 * p7 * CAST(1.001 AS DOUBLE))"""


@query(f"""WITH {STATUS}, {RULES}, named AS (SELECT DISTINCT product, source, version, unnest(bands) AS band FROM found WHERE severity <> 'info')
SELECT c.product, c.source, c.version, c.band, status, status <> 'confirmed' OR n.band IS NOT NULL AS review FROM cells c LEFT JOIN named n ON c.product = n.product AND c.source = n.source AND c.version = n.version AND c.band = n.band""")
def review_flag(t: Tables) -> DataFrame:
    long = prices(t).withColumnRenamed("cents", "price")
    findings = extensions.findings(long, KEYS, rules.band_rules(long, KEYS))
    return reconcile.needs_review(reconcile_status(t), findings, KEYS).select(*KEYS, "band", "status", "review")


def _listed(findings: DataFrame) -> DataFrame:
    return findings.withColumn("bands", F.array_join("bands", ","))


@query(f"WITH {PRICES}, {RULES} SELECT product, source, version, rule, severity, array_to_string(bands, ',') AS bands FROM found")
def band_rules(t: Tables) -> DataFrame:
    return _listed(rules.band_rules(prices(t).withColumnRenamed("cents", "price"), KEYS))


@query(f"WITH {PRICES}, {RULES} SELECT product, source, version, rule, CASE WHEN source % 2 = 0 THEN 'info' ELSE 'error' END AS severity FROM found WHERE rule IN ('six_times', 'late_rise')")
def composite_rules(t: Tables) -> DataFrame:
    """Prices of half the sources include dental cover, as their heading says: legal ratios don't bind them."""
    heading = F.when(F.col("source") % 4 == 0, F.lit("Plano + ODONTO")).when(F.col("source") % 4 == 2, F.lit("com  Odonto")).otherwise(F.lit("Odontologia à parte"))
    composite = rules.is_composite(F.array().cast("array<string>"), heading)
    return rules.band_rules(prices(t).withColumnRenamed("cents", "price"), KEYS, composite).where("rule in ('six_times', 'late_rise')").drop("bands")


@query("SELECT p_partkey, 'registration_conflict' AS rule, 'error' AS severity FROM part WHERE p_size % 4 <> 0 AND p_size % 3 = 1")
def registration_conflicts(t: Tables) -> DataFrame:
    written = F.lpad(F.col("p_partkey").cast("string"), 9, "0")
    read = t.part.select("p_partkey", F.when(F.col("p_size") % 4 != 0, written).alias("a"), F.when(F.col("p_size") % 3 == 0, written).when(F.col("p_size") % 3 == 1, F.lpad((F.col("p_partkey") + 1).cast("string"), 9, "0")).alias("b"))
    return rules.registration_conflict(read, ["p_partkey"], "a", "b").drop("bands")


def _patterned(t: Tables) -> DataFrame:
    """(doc, c, prices): columns of one ratio pattern on different bases, with hashed misreadings and gaps, in cents."""
    base = t.part.select(F.expr("p_partkey div 25").alias("doc"), F.col("p_partkey").alias("c"), (F.col("p_size") * 1000 + 20000).alias("base"))
    mark = lambda b: (F.col("c") * 31 + b * 17) % 97
    price = lambda b: F.expr(f"base * {100 + 15 * b} div 100").cast("bigint")
    return base.select("doc", "c", F.array(*[F.when(mark(b) == 5, price(b) + 1000).when(mark(b) != 7, price(b)) for b in range(10)]).alias("prices"))


PATTERN = """WITH base AS (SELECT p_partkey // 25 AS doc, p_partkey AS c, p_size * 1000 + 20000 AS base FROM part),
cells AS (SELECT doc, c, CAST(b AS INT) AS band, CAST(CASE (c * 31 + b * 17) % 97 WHEN 7 THEN NULL WHEN 5 THEN base * (100 + 15 * b) // 100 + 1000 ELSE base * (100 + 15 * b) // 100 END AS DOUBLE) / 100 AS p FROM base, range(10) r(b)),
steps AS (SELECT a.doc, a.c, a.band AS i, z.p AS x0, a.p AS x1 FROM cells a JOIN cells z ON a.c = z.c AND z.band = a.band - 1 WHERE a.p IS NOT NULL AND z.p IS NOT NULL),
pairs AS (SELECT x.doc, x.c, y.c AS p, list(x.i ORDER BY x.i) FILTER (abs((x.x1 / x.x0) / (y.x1 / y.x0) - 1) > 1.2 * (0.005 / x.x0 + 0.005 / x.x1 + 0.005 / y.x0 + 0.005 / y.x1)) AS differ, count(*) AS known
  FROM steps x JOIN steps y ON x.doc = y.doc AND x.i = y.i AND x.c <> y.c GROUP BY ALL HAVING known >= 6),
spots AS (SELECT doc, c, p, CAST(b AS INT) AS band FROM pairs, range(10) r(b) WHERE len(list_filter(coalesce(differ, []), lambda d: d <> b AND d <> b + 1)) = 0),
est AS (SELECT spots.doc, spots.c, spots.band, count(*) AS support, median(own.p / lo.p) AS up, median(hi.p / own.p) AS down FROM spots LEFT JOIN cells own ON own.c = spots.p AND own.band = spots.band LEFT JOIN cells lo ON lo.c = spots.p AND lo.band = spots.band - 1
  LEFT JOIN cells hi ON hi.c = spots.p AND hi.band = spots.band + 1 GROUP BY ALL HAVING support >= 2),
two AS (SELECT est.*, lo.p * up AS below, hi.p / down AS above FROM est LEFT JOIN cells lo ON lo.c = est.c AND lo.band = est.band - 1 LEFT JOIN cells hi ON hi.c = est.c AND hi.band = est.band + 1),
calc AS (SELECT doc, c, band, support, CASE WHEN below IS NULL OR above IS NULL THEN coalesce(below, above) ELSE (below + above) / 2 END AS value FROM two
WHERE (below IS NULL OR above IS NULL OR abs(below - above) <= 0.03) AND coalesce(below, above) IS NOT NULL)"""


@query(f"{PATTERN} SELECT doc, c, band, support, CAST(round(value * 10) AS BIGINT) AS dimes FROM calc")
def pattern_recompute(t: Tables) -> DataFrame:
    """Rounded to dimes: the two engines may differ in the last cent of a median."""
    money = _patterned(t).withColumn("prices", F.transform("prices", lambda p: p / F.lit(100.0)))
    return reconcile.recompute(money, "doc", "c").select("doc", "c", "band", "support", F.round(F.col("value") * 10).cast("bigint").alias("dimes"))


#: Each price against a second reading, and what its value says of it.
OUTCOMES = PATTERN + """, seen AS (SELECT doc, c, band, p AS a, CASE WHEN (c + band) % 13 <> 0 THEN p END AS b FROM cells WHERE p IS NOT NULL), held AS (SELECT *, CASE WHEN b IS NULL THEN 'only_a' ELSE 'confirmed' END AS status FROM seen),
tried AS (SELECT doc, c, band, a, b, status, round(value, 2) AS value FROM held FULL JOIN calc USING (doc, c, band)),
told AS (SELECT *, CASE WHEN status = 'only_a' AND abs(a - value) <= 0.015 THEN a END AS chosen, CASE WHEN value IS NULL THEN NULL WHEN status IS NULL THEN 'suggestion' WHEN status = 'only_a' AND abs(a - value) <= 0.015 THEN 'confirmed_calc'
  WHEN status = 'confirmed' AND abs(a - value) > 0.10 THEN 'info' WHEN status = 'only_a' AND abs(a - value) > 0.025 THEN 'alert' END AS outcome FROM tried)"""


@query(f"{OUTCOMES} SELECT * FROM told")
def pattern_outcomes(t: Tables) -> DataFrame:
    """What recomputation says of each price against a second reading that misses every 13th."""
    money = _patterned(t).withColumn("prices", F.transform("prices", lambda p: p / F.lit(100.0)))
    cells = bands.to_long(money, ["doc", "c"]).withColumn("b", F.when((F.col("c") + F.col("band")) % 13 != 0, F.col("price"))).withColumnRenamed("price", "a")
    cells = cells.withColumn("status", reconcile.status(F.col("a"), F.col("b")))
    return reconcile.apply_recompute(cells, reconcile.recompute(money, "doc", "c"), ["doc", "c"])


NOTES = ", notes AS (SELECT product AS plan, source AS note, version AS note_date, band, cents AS vcm, CASE WHEN source % 2 = 0 THEN cents * 9 // 10 ELSE cents * 7 // 10 END AS low, cents * 13 // 10 AS high FROM prices WHERE {} AND product <> '000000004')"
#: Findings of columns against the notes of one date, with a key for the date.
FOUND = """tried AS (SELECT plan, source, material_date, noted, band, note, low, high, vcm, price, CAST(price AS DOUBLE) / CAST(vcm AS DOUBLE) AS ratio FROM cols JOIN dates USING (plan, source, material_date) JOIN notes USING (plan, band) WHERE note_date = noted),
best AS (SELECT plan, source, material_date, noted, arg_min(note, (spread, note)) AS note FROM (SELECT plan, source, material_date, noted, note, max(ratio) / min(ratio) - 1 AS spread FROM tried GROUP BY ALL) GROUP BY ALL),
held AS (SELECT *, median(ratio) OVER (PARTITION BY plan, source, material_date, noted) AS typical FROM tried JOIN best USING (plan, source, material_date, noted, note)),
f AS (SELECT *, noted > material_date AS later, abs(ratio / typical - 1) > 0.03 AS off, CAST(low AS DOUBLE) > 0.7::DOUBLE * vcm + 0.01 AND price < low - 0.01 AS under FROM held),
out_ AS (SELECT plan, source, material_date, noted, note, bool_or(later OR date_diff('day', noted, material_date) > 365) AS mild, array_to_string(list(band ORDER BY band), ',') AS bands FROM f WHERE NOT (off OR (under AND NOT later)) AND NOT price BETWEEN low - 0.01 AND high + 0.01 GROUP BY ALL),
found AS (SELECT plan, source, material_date, noted, note, 'off_pattern' AS rule, 'alert' AS severity, CAST(band AS VARCHAR) AS bands FROM f WHERE off UNION ALL
SELECT plan, source, material_date, noted, note, 'below_minimum', CASE WHEN later THEN 'info' ELSE 'alert' END, CASE WHEN later THEN '' ELSE CAST(band AS VARCHAR) END FROM f WHERE under UNION ALL
SELECT plan, source, material_date, noted, note, 'out_of_band', CASE WHEN mild THEN 'info' ELSE 'alert' END, CASE WHEN mild THEN '' ELSE bands END FROM out_)"""
NO_NOTE = "SELECT DISTINCT plan, source, material_date, {} CAST(NULL AS INT), 'no_note', 'info', '' FROM cols ANTI JOIN notes USING (plan)"


def _noted(t: Tables, when: str) -> tuple[DataFrame, DataFrame]:
    p = prices(t)
    low = F.when(F.col("source") % 2 == 0, F.expr("cents * 9 div 10")).otherwise(F.expr("cents * 7 div 10"))
    notes = p.where(when).where("product <> '000000004'").select(F.col("product").alias("plan"), F.col("source").alias("note"), F.col("version").alias("note_date"), "band", F.col("cents").alias("vcm"), low.alias("low"), F.expr("cents * 13 div 10").alias("high"))
    columns = p.where("version >= date'1994-01-01'").select(F.col("product").alias("plan"), "source", F.col("version").alias("material_date"), "band", F.col("cents").alias("price"))
    return columns, notes


@query(f"""WITH {PRICES}{NOTES.format("version = DATE '1995-01-01'")}, cols AS (SELECT product AS plan, source, version AS material_date, band, cents AS price FROM prices WHERE version >= DATE '1994-01-01'),
dates AS (SELECT DISTINCT plan, source, material_date, DATE '1995-01-01' AS noted FROM cols), {FOUND} SELECT * EXCLUDE (noted) FROM found UNION ALL {NO_NOTE.format("")}""")
def rule_reference_note(t: Tables) -> DataFrame:
    return _listed(rules.reference_note(*_noted(t, "version = date'1995-01-01'"), ["plan", "source", "material_date"], "plan"))


@query(f"""WITH {PRICES}{NOTES.format("version BETWEEN DATE '1994-01-01' AND DATE '1996-01-01'")}, cols AS (SELECT product AS plan, source, version AS material_date, band, cents AS price FROM prices WHERE version >= DATE '1994-01-01'),
m AS (SELECT DISTINCT plan, source, material_date FROM cols), d AS (SELECT DISTINCT plan, note_date FROM notes),
near AS (SELECT plan, source, material_date, note_date AS noted FROM m JOIN d USING (plan) WHERE note_date BETWEEN material_date - 365 AND material_date + 180),
dates AS (SELECT * FROM near UNION ALL SELECT plan, source, material_date, coalesce(max(note_date) FILTER (note_date <= material_date), min(note_date)) FROM (SELECT * FROM m ANTI JOIN near USING (plan, source, material_date)) JOIN d USING (plan) GROUP BY ALL),
{FOUND}, grave AS (SELECT plan, source, material_date, noted, count(*) FILTER (severity <> 'info') AS n FROM dates LEFT JOIN found USING (plan, source, material_date, noted) GROUP BY ALL),
chosen AS (SELECT plan, source, material_date, noted FROM grave QUALIFY row_number() OVER (PARTITION BY plan, source, material_date ORDER BY n, noted DESC) = 1)
SELECT plan, source, material_date, noted AS note_date, note, rule, severity, bands FROM found JOIN chosen USING (plan, source, material_date, noted) UNION ALL {NO_NOTE.format("CAST(NULL AS DATE),")}""")
def rule_note_at_the_time(t: Tables) -> DataFrame:
    """Each column against the notes of each plausible date, and the date that speaks against it least."""
    return _listed(rules.note_at_the_time(*_noted(t, "version between date'1994-01-01' and date'1996-01-01'"), ["plan", "source", "material_date"], "plan"))


@query(f"WITH {WIDE}, moved AS (SELECT *, coalesce(CAST(prices AS VARCHAR) <> lag(CAST(prices AS VARCHAR)) OVER w, true) AS new_ FROM (SELECT product, source, version, list_transform(prices, lambda x: x // 20000) AS prices FROM wide) WINDOW w AS (PARTITION BY product, source ORDER BY version)), numbered AS (SELECT *, CAST(sum(new_::INT) OVER (PARTITION BY product, source ORDER BY version) AS INT) AS number FROM moved), kept AS (SELECT *, max(version) OVER (PARTITION BY product, source, number) AS confirmed FROM numbered QUALIFY new_) SELECT product, source, version AS dated, number AS version, confirmed, lead(version) OVER (PARTITION BY product, source ORDER BY number) AS next_at, lead(version) OVER (PARTITION BY product, source ORDER BY number) IS NULL AS is_current FROM kept")
def version_chain(t: Tables) -> DataFrame:
    coarse = wide(t).select("product", "source", F.col("version").alias("dated"), F.transform("prices", lambda x: F.floor(x / 20000)).alias("prices"))
    return versions.chains(coarse, ["product", "source"], "dated").select("product", "source", "dated", "version", "confirmed", "next_at", "is_current")


@query("""WITH RECURSIVE o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN lead(o_orderkey, 2) OVER w ELSE lead(o_orderkey) OVER w END AS superseded_by FROM orders WINDOW w AS (PARTITION BY o_custkey % 50 ORDER BY o_orderdate, o_orderkey)),
before AS (SELECT superseded_by AS id, max(id) AS up FROM o WHERE superseded_by IS NOT NULL GROUP BY superseded_by),
down AS (SELECT id, id AS root FROM o WHERE id NOT IN (SELECT id FROM before) UNION ALL SELECT b.id, d.root FROM down d JOIN before b ON b.up = d.id)
SELECT o.id, superseded_by, root FROM o JOIN down ON down.id = o.id""")
def history_roots(t: Tables) -> DataFrame:
    """Long histories by their stored links, some with branches: each table with the oldest one that leads to it."""
    w = W.partitionBy(F.col("o_custkey") % 50).orderBy("o_orderdate", "o_orderkey")
    link = F.when(F.col("o_orderkey") % 7 == 0, F.lead("o_orderkey", 2).over(w)).otherwise(F.lead("o_orderkey").over(w))
    return versions.roots(t.orders.select(F.col("o_orderkey").alias("id"), link.alias("superseded_by")), "id", "superseded_by").select("id", "superseded_by", "root")


@query("SELECT l_orderkey AS k, l_linenumber AS line, CAST(printf('%.2f', CAST(CAST(round(l_extendedprice * 100) AS BIGINT) * 10 + 5 AS DOUBLE) / 1000) AS DOUBLE) AS half, CAST(printf('%.2f', CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS DOUBLE) / 700) AS DOUBLE) AS share, CAST(printf('%.1f', CAST(l_partkey AS DOUBLE) / 4) AS DOUBLE) AS even FROM lineitem")
def binary_rounding(t: Tables) -> DataFrame:
    """Amounts that end half-way between two cents as they are written: what the binary value is closer to decides."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    double = lambda c: c.cast("double")
    return t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), money.rounded(double(cents * 10 + 5) / 1000).alias("half"), money.rounded(double(cents) / 700).alias("share"), money.rounded(double(F.col("l_partkey")) / 4, 1).alias("even"))


@query(f"WITH {PRICES} SELECT DISTINCT product, source, version, min(version) OVER (PARTITION BY product, source) AS root, dense_rank() OVER (PARTITION BY product, source ORDER BY version) AS depth FROM prices")
def chain_root(t: Tables) -> DataFrame:
    rows = prices(t).select(*KEYS).distinct()
    w = W.partitionBy("product", "source").orderBy("version")
    return rows.withColumn("root", F.first("version").over(w)).withColumn("depth", F.row_number().over(w).cast("bigint"))


YEARS = "old_ AS (SELECT * FROM prices WHERE version = DATE '1996-01-01' AND NOT (product = '000000003' AND source = 1)), new_ AS (SELECT * FROM prices WHERE version = DATE '1997-01-01' AND NOT (product = '000000005' AND source = 2))"


def _years(t: Tables) -> tuple[DataFrame, DataFrame]:
    w = wide(t).withColumn("tags", F.array(F.concat(F.lit("grupo: "), F.col("source").cast("string"))))
    old = w.where("version = date'1996-01-01' and not (product = '000000003' and source = 1)").drop("version")
    return old, w.where("version = date'1997-01-01' and not (product = '000000005' and source = 2)").drop("version")


@query(f"""WITH {PRICES}, {YEARS}, o AS (SELECT DISTINCT product, source FROM old_), n AS (SELECT DISTINCT product, source FROM new_),
d AS (SELECT a.product, a.source, count(*) FILTER (a.cents <> b.cents) AS moved, median(b.cents / a.cents - 1) FILTER (a.cents <> b.cents) AS m FROM old_ a JOIN new_ b USING (product, source, band) GROUP BY ALL)
SELECT coalesce(o.product, n.product) AS product, o.source AS old_place, n.source AS new_place, CASE WHEN o.product IS NULL THEN 'added' WHEN n.product IS NULL THEN 'removed' WHEN coalesce(moved, 0) = 0 THEN 'equal' ELSE 'changed' END AS change,
  CASE WHEN o.product IS NOT NULL AND n.product IS NOT NULL THEN CAST(coalesce(moved, 0) AS INT) END AS n_changed, CAST(floor(m * 100000 + 0.5) AS BIGINT) AS variation
FROM o FULL JOIN n ON o.product = n.product AND o.source = n.source LEFT JOIN d ON d.product = o.product AND d.source = n.source AND o.source = n.source""")
def version_diff(t: Tables) -> DataFrame:
    """Two years of each product, matched by condition; the variation in hundred-thousandths."""
    found = versions.diff(*_years(t), ["product"], ["source"])
    return found.withColumn("variation", F.floor(F.col("variation") * 100000 + 0.5).cast("bigint"))


@query(f"WITH {PRICES}, c AS (SELECT DISTINCT product, source FROM prices WHERE version = DATE '1996-01-01'), i AS (SELECT DISTINCT product, source FROM prices WHERE version = DATE '1997-01-01' AND source <> 3 AND product <> '000000007') SELECT product, source, CASE WHEN product IN (SELECT product FROM i) THEN 'condition_changed' ELSE 'product_removed' END AS reason FROM c WHERE (product, source) NOT IN (SELECT (product, source) FROM i)")
def retire_absent(t: Tables) -> DataFrame:
    rows = prices(t).select(*KEYS).distinct()
    incoming = rows.where("version = date'1997-01-01' and source <> 3 and product <> '000000007'")
    return versions.retired(rows.where("version = date'1996-01-01'").drop("version"), incoming, "product", "source").select("product", "source", "reason")


MOVES = "moves AS (SELECT product, source, version, band, cents, lag(cents) OVER (PARTITION BY product, source, band ORDER BY version) AS before FROM prices)"


@query(f"WITH {PRICES}, {MOVES} SELECT product, version, CAST(median(cents * 10000 // before) AS DOUBLE) AS variation, count(*) AS n FROM moves WHERE before > 0 GROUP BY ALL")
def median_variation(t: Tables) -> DataFrame:
    before = F.lag("cents").over(W.partitionBy("product", "source", "band").orderBy("version"))
    moves = prices(t).withColumn("before", before).where("before > 0")
    return moves.groupBy("product", "version").agg(F.median(F.expr("cents * 10000 div before")).alias("variation"), F.count("*").alias("n"))


@query(f"""WITH {PRICES}, {MOVES}, r AS (SELECT source, version, product, median(cents * 10000 // before) AS m FROM moves WHERE before > 0 GROUP BY ALL) SELECT source, version, count(*) AS columns_, CAST(min(m) AS DOUBLE) AS least, CAST(max(m) AS DOUBLE) AS most,
  CASE WHEN count(*) = 1 THEN 'readjusted' ELSE 'readjusted ' || count(*) || ' columns' END AS title FROM r WHERE m <> 10000 GROUP BY ALL""")
def readjust_events(t: Tables) -> DataFrame:
    """One event for each document (source and version) whose columns changed, singular or plural."""
    before = F.lag("cents").over(W.partitionBy("product", "source", "band").orderBy("version"))
    each = prices(t).withColumn("before", before).where("before > 0").groupBy(*KEYS).agg(F.median(F.expr("cents * 10000 div before")).alias("m")).where("m <> 10000")
    title = F.when(F.count("*") == 1, F.lit("readjusted")).otherwise(F.concat(F.lit("readjusted "), F.count("*").cast("string"), F.lit(" columns")))
    return each.groupBy("source", "version").agg(F.count("*").alias("columns_"), F.min("m").alias("least"), F.max("m").alias("most"), title.alias("title"))


@query(f"WITH {LATEST}, s AS (SELECT a.product, a.source, b.source AS other, a.band, a.cents AS x, b.cents AS y FROM latest a JOIN latest b ON a.product = b.product AND a.band = b.band AND a.source <> b.source) SELECT product, source, other, count(*) AS differing, CAST(median(y * 10000 // x) AS DOUBLE) AS variation FROM s WHERE x <> y GROUP BY ALL")
def cross_source(t: Tables) -> DataFrame:
    """Bands whose price differs between two sources of a product, and the median of how much."""
    rows = bands.to_wide(_latest(t), ["product", "source"], price="cents").withColumns({"tags": F.array().cast("array<string>"), "place": F.col("source")})
    pairs = lookup.other_sources(rows, "product", ["source"], "place")
    each = pairs.select("product", F.col("own.source").alias("source"), F.col("peer.source").alias("other"), F.explode(F.arrays_zip(F.col("own.prices").alias("x"), F.col("peer.prices").alias("y"))).alias("z")).where("z.x <> z.y")
    return each.groupBy("product", "source", "other").agg(F.count("*").alias("differing"), F.median(F.expr("z.y * 10000 div z.x")).alias("variation"))


@query(f"WITH {LATEST}, s AS (SELECT a.product, a.source, b.source AS other, median(b.cents * 10000 // a.cents) - 10000 AS v FROM latest a JOIN latest b ON a.product = b.product AND a.band = b.band AND a.source <> b.source WHERE a.cents <> b.cents GROUP BY ALL) SELECT source AS doc, other, count(*) AS n, CAST(median(v) AS DOUBLE) AS variation, count(*) || ' columns, ' || CASE WHEN median(v) > 0 THEN 'dearer' WHEN median(v) < 0 THEN 'cheaper' ELSE 'mixed' END AS title FROM s GROUP BY ALL")
def divergence_events(t: Tables) -> DataFrame:
    """One event for each document and other source whose prices differ, in ten-thousandths."""
    pairs = cross_source(t).select(F.col("source").alias("doc"), "other", (F.col("variation") - 10000).alias("variation"))
    return events.of_divergences(pairs).select("doc", "other", "n", "variation", "title")


@query(f"WITH {PRICES}, f AS (SELECT source, product, version, min(cents) AS at FROM prices GROUP BY ALL), r AS (SELECT source, a.product, row_number() OVER (PARTITION BY source ORDER BY a.at, a.product) AS p, row_number() OVER (PARTITION BY source ORDER BY b.at, a.product) AS q FROM f a JOIN f b USING (source) WHERE a.product = b.product AND a.version = DATE '1996-01-01' AND b.version = DATE '1997-01-01') SELECT source, count(*) AS common, bool_or(p <> q) AS reordered FROM r GROUP BY source")
def reorder_flag(t: Tables) -> DataFrame:
    """Whether the products that two versions of a source share come in another order of first appearance."""
    of = lambda year: prices(t).where(F.col("version") == F.lit(f"{year}-01-01").cast("date"))
    return versions.reordered(of(1996), of(1997), ["source"], "product", "cents")


@query(f"WITH {PRICES}, s AS (SELECT *, CAST(('0x' || substr(md5(product || '|' || source || '|' || version || '|' || band), 1, 8)) AS BIGINT) AS h FROM prices), d AS (SELECT *, h // 7 % len(CAST(cents AS VARCHAR)) AS k, cents AS true_cents FROM s), e AS (SELECT *, CAST(pow(10, k) AS BIGINT) AS p FROM d), g AS (SELECT *, cents // p % 10 AS digit FROM e), m AS (SELECT *, cents + ((digit + 1 + h // 70 % 9) % 10 - digit) * p AS wrong FROM g), w AS (SELECT product, source, version, band, true_cents, CASE WHEN h % 7 = 0 AND wrong > 0 THEN wrong ELSE cents END AS cents FROM m) SELECT *, CASE WHEN cents <> true_cents THEN CASE WHEN abs(cents - true_cents) / true_cents >= 0.01 THEN 'large' WHEN abs(cents - true_cents) / true_cents >= 0.001 THEN 'small' ELSE 'cents' END END AS kind FROM w")
def fault_injection(t: Tables) -> DataFrame:
    return collecting.mutated(prices(t), KEYS).select(*KEYS, "band", "true_cents", "cents", "kind")


@query(f"""{OUTCOMES}, firsts AS (SELECT doc, c, min(band) AS first_band, count(*) AS n FROM seen GROUP BY ALL)
SELECT doc, c, band, CASE WHEN outcome = 'confirmed_calc' THEN 'confirmed_calc' ELSE status END AS status, outcome, status = 'only_a' AND outcome IS DISTINCT FROM 'confirmed_calc' OR outcome IS NOT DISTINCT FROM 'alert' OR n < 10 - first_band AS review
FROM told JOIN firsts USING (doc, c) WHERE status IS NOT NULL""")
def recompute_review(t: Tables) -> DataFrame:
    """Planted faults, what recomputation makes of them, and what is left to review."""
    money = _patterned(t).withColumn("prices", F.transform("prices", lambda p: p / F.lit(100.0)))
    cells = bands.to_long(money, ["doc", "c"]).withColumn("b", F.when((F.col("c") + F.col("band")) % 13 != 0, F.col("price"))).withColumnRenamed("price", "a")
    cells = cells.withColumn("status", reconcile.status(F.col("a"), F.col("b")))
    applied = reconcile.apply_recompute(cells, reconcile.recompute(money, "doc", "c"), ["doc", "c"])
    findings = rules.unread_bands(money, ["doc", "c"], bands.unread(F.col("prices")))
    return reconcile.reviewed_anew(applied, findings, ["doc", "c"]).select("doc", "c", "band", "status", "outcome", "review")


#: Faults in prices that have a value, each in a version of its column of its own, against the other columns as they are.
FAULTS = PATTERN + """, seeds AS (SELECT doc, c, band, CAST(round(p * 100) AS BIGINT) AS true_cents, CAST(('0x' || substr(md5(doc || '|' || c || '|' || band), 1, 8)) AS BIGINT) AS h, len(CAST(CAST(round(p * 100) AS BIGINT) AS VARCHAR)) AS n FROM calc JOIN cells USING (doc, c, band) WHERE p IS NOT NULL),
hit AS (SELECT *, h // 700 % 2 = 1 AND n > 1 AS swap FROM seeds WHERE h % 7 = 0), at_ AS (SELECT *, CAST(pow(10, CASE WHEN swap THEN least(h // 7 % n, n - 2) ELSE h // 7 % n END) AS BIGINT) AS p10 FROM hit),
wrong AS (SELECT doc, c, band, true_cents, true_cents + p10 * CASE WHEN swap THEN 9 * (true_cents // p10 % 10 - true_cents // (p10 * 10) % 10) ELSE (true_cents // p10 % 10 + 1 + h // 70 % 9) % 10 - true_cents // p10 % 10 END AS cents FROM at_),
faults AS (SELECT *, CASE WHEN abs(cents - true_cents) / true_cents >= 0.01 THEN 'large' WHEN abs(cents - true_cents) / true_cents >= 0.001 THEN 'small' ELSE 'cents' END AS kind FROM wrong WHERE cents > 0 AND cents <> true_cents),
tries AS (SELECT f.doc, f.c, f.band AS fault, x.band, CASE WHEN x.band = f.band THEN CAST(f.cents AS DOUBLE) / 100 ELSE x.p END AS p FROM faults f JOIN cells x ON x.c = f.c),
moves AS (SELECT a.doc, a.c, a.fault, a.band AS i, z.p AS x0, a.p AS x1 FROM tries a JOIN tries z ON a.c = z.c AND a.fault = z.fault AND z.band = a.band - 1 WHERE a.p IS NOT NULL AND z.p IS NOT NULL),
matched AS (SELECT x.doc, x.c, x.fault, y.c AS p, count(*) FILTER (x.i NOT IN (x.fault, x.fault + 1) AND abs((x.x1 / x.x0) / (y.x1 / y.x0) - 1) > 1.2 * (0.005 / x.x0 + 0.005 / x.x1 + 0.005 / y.x0 + 0.005 / y.x1)) AS elsewhere, count(*) AS known
  FROM moves x JOIN steps y ON x.doc = y.doc AND x.i = y.i AND x.c <> y.c GROUP BY ALL HAVING known >= 6 AND elsewhere = 0),
ests AS (SELECT m.doc, m.c, m.fault, median(own.p / lo.p) AS up, median(hi.p / own.p) AS down FROM matched m LEFT JOIN cells own ON own.c = m.p AND own.band = m.fault LEFT JOIN cells lo ON lo.c = m.p AND lo.band = m.fault - 1 LEFT JOIN cells hi ON hi.c = m.p AND hi.band = m.fault + 1 GROUP BY ALL HAVING count(*) >= 2),
ends AS (SELECT ests.*, lo.p * up AS below, hi.p / down AS above FROM ests LEFT JOIN cells lo ON lo.c = ests.c AND lo.band = fault - 1 LEFT JOIN cells hi ON hi.c = ests.c AND hi.band = fault + 1),
anew AS (SELECT doc, c, fault AS band, round(CASE WHEN below IS NULL OR above IS NULL THEN coalesce(below, above) ELSE (below + above) / 2 END, 2) AS value FROM ends WHERE below IS NULL OR above IS NULL OR abs(below - above) <= 0.03),
scored AS (SELECT doc, c, band, true_cents, cents, kind, coalesce(abs(CAST(cents AS DOUBLE) / 100 - value) >= 0.015, false) AS detected, coalesce(abs(value - CAST(true_cents AS DOUBLE) / 100) < 0.005, false) AS exact FROM faults LEFT JOIN anew USING (doc, c, band))"""


def _money(t: Tables) -> DataFrame:
    return _patterned(t).withColumn("prices", F.transform("prices", lambda p: p / F.lit(100.0)))


@query(f"{FAULTS} SELECT doc, c, band, true_cents, cents, kind, detected, detected AND exact AS repaired FROM scored")
def planted_faults(t: Tables) -> DataFrame:
    """Typing faults in prices that recomputation has a value for, and whether it finds and repairs each."""
    return faults.planted(_money(t), "doc", "c").select("doc", "c", "band", "true_cents", "cents", "kind", "detected", "repaired")


@query(f"{FAULTS} SELECT kind, count(*) AS faults, count(*) FILTER (detected) AS detected, count(*) FILTER (detected AND exact) AS repaired, count(*) FILTER (detected) / count(*) AS share_detected, count(*) FILTER (detected AND exact) / count(*) AS share_repaired FROM scored GROUP BY kind")
def fault_scores(t: Tables) -> DataFrame:
    return faults.scores(faults.planted(_money(t), "doc", "c"))


def _sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    name = F.split(F.col("p_name"), " ")
    kinds = F.array(F.lit("região: capital"), F.lit("região: interior 1"), F.lit("vidas: 1"), F.lit("vidas: 2 a 29"), F.lit("coparticipação: com"), F.lit("coparticipação: parcial"), F.lit("adesão: livre"))
    tags = F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(1)), lambda i: F.get(kinds, ((F.col("p_partkey") * (3 + i) + F.size(name) + i) % 7).cast("int")))))
    rows = t.part.select((F.col("p_partkey") % 97).alias("product"), F.col("p_partkey").alias("c"), tags.alias("tags"), F.col("p_size").alias("size"))
    return rows.where("size % 2 = 0"), rows.where("size % 2 = 1")


#: One pair after the other, best first, with what each product has taken so far.
GREEDY = """WITH RECURSIVE kinds AS (SELECT ['região: capital', 'região: interior 1', 'vidas: 1', 'vidas: 2 a 29', 'coparticipação: com', 'coparticipação: parcial', 'adesão: livre'] AS k),
rows_ AS (SELECT p_partkey % 97 AS product, p_partkey AS c, p_size % 2 AS side, len(string_split(p_name, ' ')) AS w, k FROM part, kinds),
sides AS (SELECT product, c, side, list_distinct([k[1 + (c * 3 + w) % 7], k[1 + (c * 4 + w + 1) % 7]]) AS tags, row_number() OVER (PARTITION BY product, side ORDER BY c) - 1 AS place FROM rows_),
spelt AS (SELECT *, list_transform(tags, lambda x: split_part(x, ': ', 1)) AS dims, CASE WHEN list_contains(tags, 'coparticipação: com') THEN list_concat(tags, ['coparticipação: parcial', 'coparticipação: total']) ELSE tags END AS wide FROM sides),
edges AS (SELECT a.product, a.c AS old, b.c AS new_, row_number() OVER (PARTITION BY a.product ORDER BY len(list_intersect(a.tags, b.tags)) DESC, abs(a.place - b.place), a.place, b.place) AS n FROM spelt a JOIN spelt b ON a.product = b.product AND a.side = 0 AND b.side = 1
  WHERE len(list_filter(list_intersect(a.dims, b.dims), lambda d: NOT list_contains(list_transform(list_intersect(a.wide, b.wide), lambda x: split_part(x, ': ', 1)), d))) = 0),
walk AS (SELECT product, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS olds, CAST([] AS BIGINT[]) AS news FROM (SELECT DISTINCT product FROM edges) UNION ALL
  SELECT w.product, e.n, CASE WHEN list_contains(olds, e.old) OR list_contains(news, e.new_) THEN olds ELSE list_append(olds, e.old) END, CASE WHEN list_contains(olds, e.old) OR list_contains(news, e.new_) THEN news ELSE list_append(news, e.new_) END FROM walk w JOIN edges e ON e.product = w.product AND e.n = w.n + 1),
ends AS (SELECT product, olds, news FROM walk QUALIFY row_number() OVER (PARTITION BY product ORDER BY n DESC) = 1), pairs AS (SELECT product, unnest(olds) AS old, unnest(news) AS new_ FROM ends)
SELECT product, old, new_ AS "new" FROM pairs UNION ALL SELECT product, c, NULL FROM sides WHERE side = 0 AND c NOT IN (SELECT old FROM pairs) UNION ALL SELECT product, NULL, c FROM sides WHERE side = 1 AND c NOT IN (SELECT new_ FROM pairs)"""


@query(GREEDY)
def greedy_match(t: Tables) -> DataFrame:
    return matching.match_conditions(*_sides(t), ["product"], ["c"]).select("product", F.col("old.c").alias("old"), F.col("new.c").alias("new"))


@query()
def reading_match(t: Tables) -> DataFrame:
    a = matching.placed(wide(t), ["version"], ["product", "source"]).withColumn("page", F.floor(F.col("place") / 20))
    b = a.withColumn("prices", F.transform("prices", lambda x, i: F.when((x + i) % 7 != 0, x)))
    return matching.match_readings(a, b, ["version"])


@query(f"WITH {PRICES} SELECT *, row_number() OVER (PARTITION BY product, band, cents // 5000 ORDER BY version, source) = 1 AS is_first FROM prices")
def dedup_signature(t: Tables) -> DataFrame:
    rows = prices(t).withColumn("s", F.expr("cents div 5000"))
    return matching.first_of_signature(rows, ["product", "band", "s"], ["version", "source"]).drop("s")


@query(f"WITH {PRICES}, d AS (SELECT DISTINCT source, version, product AS doc FROM prices), x AS (SELECT source, version, max(doc) AS last FROM d GROUP BY ALL), y AS (SELECT source, version, lag(last) OVER w AS previous, last_value(last) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS newest, last_value(version) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS newest_at FROM x WINDOW w AS (PARTITION BY source ORDER BY version)) SELECT source, version, doc, previous, CASE WHEN newest_at > version THEN newest END AS newest_later FROM d JOIN y USING (source, version)")
def newer_document(t: Tables) -> DataFrame:
    docs = prices(t).select("source", "version", F.col("product").alias("doc")).distinct()
    return versions.neighbours(docs, "source", "version", "doc")


@query(f"WITH {PRICES}, log AS (SELECT product, source, version, band, event_id AS seq, CAST(event_id * 3 AS BIGINT) AS value FROM prices JOIN events ON event_id % (SELECT (max(CAST(product AS INT)) + 1) * 5 FROM prices) = CAST(product AS INT) * 5 + source AND event_id % 10 = band) SELECT p.*, l.value AS chosen FROM prices p LEFT JOIN (SELECT product, source, version, band, arg_max(value, seq) AS value FROM log GROUP BY ALL) l USING (product, source, version, band)")
def corrections(t: Tables) -> DataFrame:
    """A log that may name any product and source, over all prices."""
    n = prices(t).agg((F.max(F.col("product").cast("int")) + 1) * 5).first()[0] or 1
    log = prices(t).join(t.events, (F.col("event_id") % n == F.col("product").cast("int") * 5 + F.col("source")) & (F.col("event_id") % 10 == F.col("band"))).select(*KEYS, "band", F.col("event_id").alias("at"), (F.col("event_id") * 3).alias("value"))
    return versions.corrected(prices(t), log, [*KEYS, "band"], "at")
