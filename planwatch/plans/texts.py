"""Queries on texts, links and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planwatch.functions import tags, text
from planwatch.operators import layout, rules
from planwatch.plans.registry import Tables, query
from planwatch.sources import links


@query("SELECT doc_id, md5(replace(replace(strip_accents(lower(text)), '–', '-'), '—', '-')) AS folded FROM documents")
def fold_accents(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(text.fold(F.col("text")).cast("binary")).alias("folded"))


@query("SELECT o_orderkey, CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS BIGINT) AS cents FROM orders")
def money_parse(t: Tables) -> DataFrame:
    """Totals written as in price tables and read again."""
    written = F.translate(F.format_number("o_totalprice", 2), ",.", ".,")
    return t.orders.select("o_orderkey", (text.money(written) * 100).cast("bigint").alias("cents"))


TITLES = "titles AS (SELECT p_partkey, 'Tabela ' || CASE p_size % 3 WHEN 0 THEN 'Aberta' WHEN 1 THEN 'Fechada' ELSE 'única' END || CASE p_size % 4 WHEN 0 THEN ' de 2 a 29 vidas' WHEN 1 THEN ' 1 VIDA' WHEN 2 THEN ' a partir de 30 vidas' ELSE '' END || CASE p_size % 5 WHEN 0 THEN ' com coparticipação parcial' WHEN 1 THEN ' sem coparticipação' WHEN 2 THEN ' com coparticipação total ou parcial' ELSE ' Livre Adesão' END || CASE WHEN p_size % 2 = 0 THEN ' Capital' ELSE ' Interior 2' END AS title FROM part)"


def _titles(t: Tables) -> DataFrame:
    pick = lambda n, *options: F.element_at(F.array(*map(F.lit, options)), (F.col("p_size") % n + 1).cast("int"))
    title = F.concat(F.lit("Tabela "), pick(3, "Aberta", "Fechada", "única"), pick(4, " de 2 a 29 vidas", " 1 VIDA", " a partir de 30 vidas", ""), pick(5, " com coparticipação parcial", " sem coparticipação", " com coparticipação total ou parcial", " Livre Adesão", " Livre Adesão"), pick(2, " Capital", " Interior 2"))
    return t.part.select("p_partkey", title.alias("title"))


@query(f"""WITH {TITLES}, f AS (SELECT *, strip_accents(lower(title)) AS x FROM titles) SELECT p_partkey, array_to_string(list_sort(list_filter([
  CASE WHEN contains(x, ' aberta') THEN 'tabela: aberta' END, CASE WHEN contains(x, ' fechada') THEN 'tabela: fechada' END, CASE WHEN contains(x, '2 a 29 vidas') THEN 'vidas: 2 a 29' END, CASE WHEN contains(x, ' 1 vida') THEN 'vidas: 1' END,
  CASE WHEN contains(x, 'a partir de 30 vidas') THEN 'vidas: 30 ou mais' END, CASE WHEN contains(x, 'com coparticipacao parcial') THEN 'coparticipação: parcial' END, CASE WHEN contains(x, 'sem coparticipacao') THEN 'coparticipação: sem' END,
  CASE WHEN contains(x, 'livre ades') THEN 'adesão: livre' END, CASE WHEN contains(x, 'capital') THEN 'região: capital' END, CASE WHEN contains(x, 'interior 2') THEN 'região: interior 2' END], lambda v: v IS NOT NULL)), ', ') AS tags FROM f""")
def condition_tags(t: Tables) -> DataFrame:
    return _titles(t).select("p_partkey", F.array_join(tags.condition_tags(F.col("title")), ", ").alias("tags"))


@query(r"SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]*)', 1)), '^www\.', '') || lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)) || '/t.pdf' AS series FROM pages")
def url_series_key(t: Tables) -> DataFrame:
    """Addresses of pages with a dated file below each, in the forms that dates have in names, some as copies in an archive."""
    path = F.regexp_replace("url", r"[?#].*$", "")
    name = F.element_at(F.array(*map(F.lit, ("/t_16_07_2026.pdf", "/t-2026-07-16.pdf", "/T_20260716.PDF", "/t.pdf"))), (F.col("page_id") % 4 + 1).cast("int"))
    url = F.concat(F.when(F.col("page_id") % 3 == 0, "https://web.archive.org/web/20240812162732id_/").otherwise(""), path, name)
    return t.pages.select("page_id", text.series_key(url).alias("series"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 3 THEN CAST(o_orderdate AS DATE) + 11000 END AS dated, o_orderkey % 6 = 5 OR (o_orderkey % 6 = 1 AND day(CAST(o_orderdate AS DATE) + 11000) = year(CAST(o_orderdate AS DATE) + 11000) % 100) AS monthly FROM orders")
def filename_date(t: Tables) -> DataFrame:
    """Dates written into file names in each form, and names whose digits are no date at their end, read again. Order dates are moved into this century."""
    day = F.date_add(F.col("o_orderdate").cast("date"), 11000)
    forms = ("'https://x.example/a/t_'dd_MM_yyyy'.pdf'", "'https://x.example/a/t-'yyyy-MM-dd'.pdf'", "'https://x.example/a/t_'yyyyMMdd'.PDF'", "'https://x.example/product'yyyyMMdd'8.pdf'", "'https://x.example/'yyyy-MM-dd'/t.pdf'", "'https://x.example/t_'MM-yy'.pdf'")
    url = F.coalesce(*[F.when(F.col("o_orderkey") % 6 == i, F.date_format(day, f)) for i, f in enumerate(forms)])
    monthly = text.date_in_name(url, (("ms", "-"),)) == F.trunc(day, "month")
    return t.orders.select("o_orderkey", text.date_in_name(url).alias("dated"), F.coalesce(monthly, F.lit(False)).alias("monthly"))


@query("SELECT s_suppkey, 'Hospital de ' || s_suppkey || ' LTDA da Serra' AS name FROM supplier")
def proper_case(t: Tables) -> DataFrame:
    raw = F.concat(F.lit("HOSPITAL  DE "), F.col("s_suppkey").cast("string"), F.lit(" LTDA DA SERRA"))
    return t.supplier.select("s_suppkey", text.proper_name(raw).alias("name"))


LAWFUL = {0: 18, 19: 23, 24: 28, 29: 33, 34: 38, 39: 43, 44: 48, 49: 53, 54: 58}


_STARTS, _ENDS = ", ".join(map(str, LAWFUL)), ", ".join(map(str, LAWFUL.values()))


@query(f"""WITH r AS (SELECT o_orderkey AS id, o_custkey % 9 AS i, o_orderkey % 7 = 3 AS early, o_orderkey % 5 = 1 AS late FROM orders WHERE o_orderkey % 2 = 0)
SELECT id, CAST([{_STARTS}][i + 1] + early::INT AS INT) AS a, CAST([{_ENDS}][i + 1] + late::INT AS INT) AS e, CASE WHEN NOT early AND NOT late THEN CAST(i AS INT) END AS band FROM r
UNION ALL SELECT o_orderkey, CAST(55 + o_custkey % 8 AS INT), NULL, CASE WHEN o_custkey % 8 = 4 THEN 9 END FROM orders WHERE o_orderkey % 2 = 1""")
def band_labels(t: Tables) -> DataFrame:
    """Ranges of ages, some off by a year, in four spellings, and first ages with each sign or word for "and more", by the keys of orders."""
    k = F.expr("o_orderkey div 2")
    pick = lambda *forms: F.element_at(F.array(*forms), (k % len(forms) + 1).cast("int"))
    of = lambda numbers: F.element_at(F.array(*map(F.lit, numbers)), (F.col("o_custkey") % 9 + 1).cast("int"))
    two = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    a, e = of(LAWFUL) + (F.col("o_orderkey") % 7 == 3).cast("int"), of(LAWFUL.values()) + (F.col("o_orderkey") % 5 == 1).cast("int")
    ranges = t.orders.where("o_orderkey % 2 = 0").withColumns({"a": a, "e": e})
    ranges = ranges.withColumn("label", pick(F.concat(two("a"), F.lit("-"), two("e")), F.concat(F.lit("De "), two("a"), F.lit(" a "), two("e"), F.lit(" anos")), F.concat(F.col("a").cast("string"), F.lit(" – "), two("e")), F.concat(two("a"), F.lit("\u00a0até\u00a0"), two("e"))))
    n = F.col("a").cast("string")
    more = [F.concat(F.lit(x), n, F.lit(y)) for x, y in (("", " ou mais"), ("", " anos ou +"), ("", "+"), ("", "/ +"), ("&gt; ", " anos"), ("&#62; ", ""), ("&ge; ", ""), ("acima de ", " anos"), ("a partir de ", ""), ("+ de ", ""), ("", " anos e acima"), ("", " em diante"))]
    ends = t.orders.where("o_orderkey % 2 = 1").withColumns({"a": (F.col("o_custkey") % 8 + 55).cast("int"), "e": F.lit(None).cast("int")}).withColumn("label", pick(*more))
    both = ranges.select("o_orderkey", "a", "e", "label").unionByName(ends.select("o_orderkey", "a", "e", "label"))
    return both.select(F.col("o_orderkey").alias("id"), "a", "e", text.band_of_label(F.col("label")).alias("band"))


@query("SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS number, regexp_replace(lpad(CAST(p_partkey AS VARCHAR), 9, '0'), '^(...)(...)(..)(.)$', '\\1.\\2/\\3-\\4') AS written FROM part")
def registration_numbers(t: Tables) -> DataFrame:
    written = text.formatted_registration(F.lpad(F.col("p_partkey").cast("string"), 9, "0"))
    return t.part.select("p_partkey", text.registration(F.concat(F.lit("ANS nº "), written, F.lit(" plano"))).alias("number"), written.alias("written"))


@query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 730 WHEN 1 THEN 300 WHEN 2 THEN 1 ELSE 180 END AS days, n_nationkey * 40 > CASE n_nationkey % 4 WHEN 0 THEN 730 WHEN 1 THEN 300 WHEN 2 THEN 1 ELSE 180 END AS illegal FROM nation")
def waiting_period(t: Tables) -> DataFrame:
    covers = F.array(*map(F.lit, ("Doenças pré-existentes e parto", "Parto a termo", "Urgência e emergência", "Cirurgias")))
    limit = rules.waiting_limit(F.element_at(covers, F.col("n_nationkey") % 4 + 1))
    return t.nation.select("n_nationkey", limit.alias("days"), (F.col("n_nationkey") * 40 > limit).alias("illegal"))


@query("""WITH a AS (SELECT p_partkey, p_size % 2 AS r, p_size % 4 AS rr, p_size % 3 AS c, p_size % 5 AS rc FROM part), m AS (SELECT p_partkey, CASE WHEN rr <> 2 AND (rr = 1) <> (r = 1) THEN 'room' END AS x, CASE WHEN (c = 0 AND rc IN (1, 3)) OR (c <> 0 AND rc IN (0, 4)) THEN 'copay' END AS y, CASE WHEN NOT (c = r AND c < 2) THEN 'contract' END AS z FROM a)
SELECT p_partkey, concat_ws(',', x, y, z) AS mismatches FROM m""")
def attribute_check(t: Tables) -> DataFrame:
    pick = lambda n, *options: F.element_at(F.array(*map(F.lit, options)), (F.col("p_size") % n + 1).cast("int"))
    wrong = rules.attribute_mismatches(pick(2, "enfermaria", "apartamento"), pick(3, "sem", "com", "parcial"), pick(2, "individual_familiar", "coletivo_adesao"), pick(4, "Coletiva", "Individual", "", "Coletiva"), pick(5, "Ausente", "Coparticipação", "", "Franquia", "Ausente"), pick(3, "Individual ou familiar", "Coletivo por adesão", ""))
    return t.part.select("p_partkey", F.array_join(wrong, ",").alias("mismatches"))


@query("""WITH a AS (SELECT page_id, list_filter(string_split(html, '<')[2:], lambda x: contains(x, '>') AND list_contains(['a', 'button', 'area', 'link', 'option'], lower(regexp_extract(x, '^[A-Za-z0-9]+')))) AS tags FROM pages),
h AS (SELECT page_id, CAST(generate_subscripts(tags, 1) - 1 AS INT) AS place, string_split(lower(string_split(unnest(tags), '>')[1]), 'href="') AS parts, string_split(unnest(tags), '>')[1] AS raw FROM a),
v AS (SELECT page_id, place, trim(replace(string_split(substr(raw, len(parts[1]) + 7), '"')[1], '&amp;', '&')) AS href FROM h WHERE len(parts) > 1) SELECT * FROM v WHERE href <> '' AND NOT starts_with(href, '#')""")
def link_extract(t: Tables) -> DataFrame:
    return links.tags_with_links(t.pages, "page_id", "html").select("page_id", "place", "href")


ROBOTS = ("# robots\nUser-agent: other\nDisallow: /\n\nUser-agent: *\n\nDisallow: /en/ # all\nAllow: /en/1\nDisallow: /*?*page=\nCrawl-delay: 2.5\nno rule\nDisallow: /*.html$\n", "User-Agent: *\nDisallow: /\nUser-agent: Planwatch\nUser-agent: second\nsitemap: x\nDisallow: /fr/\nDisallow:\n")


def _robots(t: Tables) -> tuple[DataFrame, DataFrame]:
    host = F.regexp_extract("url", r"^[A-Za-z]+://([^/?#]*)", 1)
    pages = t.pages.select("page_id", host.alias("host"), F.regexp_extract("url", r"^[A-Za-z]+://[^/?#]*([^#]*)", 1).alias("path"))
    body = F.when(F.length("host") % 2 == 0, F.lit(ROBOTS[0])).otherwise(F.lit(ROBOTS[1]))
    return pages, links.robots_rules(pages.select("host").distinct().withColumn("body", body), "planwatch/1.0 (reads price tables)")


@query("WITH h AS (SELECT DISTINCT regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) AS host FROM pages), r AS (SELECT * FROM (VALUES (0, 'Disallow', '/en/', 2.5::DOUBLE), (0, 'Allow', '/en/1', 2.5), (0, 'Disallow', '/*?*page=', 2.5), (0, 'Disallow', '/*.html$', 2.5), (1, 'Disallow', '/fr/', NULL), (1, 'Disallow', '', NULL)) v(odd, kind, pattern, delay)) SELECT host, kind, pattern, delay FROM h JOIN r ON len(host) % 2 = odd")
def robots_rules(t: Tables) -> DataFrame:
    return _robots(t)[1]


@query("WITH p AS (SELECT page_id, regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^#]*)', 1) AS path FROM pages) SELECT page_id, path, CASE WHEN len(host) % 2 = 1 THEN NOT starts_with(path, '/fr/') WHEN regexp_matches(path, '\\?.*page=') OR regexp_matches(path, '\\.html$') THEN false WHEN starts_with(path, '/en/1') THEN true WHEN starts_with(path, '/en/') THEN false ELSE true END AS allowed FROM p")
def robots_allow(t: Tables) -> DataFrame:
    pages, rules_ = _robots(t)
    return links.allowed(pages, rules_, "path").select("page_id", "path", "allowed")


@query("WITH p AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN '' WHEN 1 THEN '?x=1' WHEN 2 THEN '/a%20b/' || page_id WHEN 3 THEN '/%C3%A9/' || page_id WHEN 4 THEN '/c+d/100%' ELSE '/free/' || page_id END AS path FROM pages) SELECT page_id, path, page_id % 6 IN (1, 5) AS allowed FROM p")
def robots_escaped(t: Tables) -> DataFrame:
    """Rules and addresses written with escapes or without them, addresses without a path, and signs that are no escapes."""
    k = F.col("page_id")
    path = F.when(k % 6 == 0, "").when(k % 6 == 1, "?x=1").when(k % 6 == 2, F.concat(F.lit("/a%20b/"), k)).when(k % 6 == 3, F.concat(F.lit("/%C3%A9/"), k)).when(k % 6 == 4, "/c+d/100%").otherwise(F.concat(F.lit("/free/"), k))
    body = "User-agent: *\nDisallow: /a b/\nDisallow: /é\nDisallow: /c+d/*%\nDisallow: /$\nAllow: /?x=1\n"
    pages = t.pages.select("page_id", F.lit("h").alias("host"), path.alias("path"))
    return links.allowed(pages, links.robots_rules(pages.select("host").distinct().withColumn("body", F.lit(body)), "planwatch"), "path").select("page_id", "path", "allowed")


MONTH_NAMES = ("janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro")


@query(f"""WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) + 11000 AS d, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)
SELECT k, CAST(date_trunc('month', d) AS DATE) AS month, CASE WHEN k % 2 = 0 THEN d END AS iso, strftime(d, '%d/%m/%Y') AS written, 'carrier_' || k AS series, 'tabela nº ' || k AS label, CASE WHEN k % 3 = 0 THEN d WHEN k % 3 = 1 THEN CAST(date_trunc('month', d) AS DATE) END AS starts,
  CASE WHEN k % 3 = 0 THEN d + 30 WHEN k % 3 = 1 THEN last_day(d) END AS ends, cents // 100 % 1000 * 100 + cents % 100 AS price, (CASE WHEN k % 201 >= 100 THEN '+' ELSE '-' END) || abs(k % 201 - 100) // 10 || ',' || abs(k % 201 - 100) % 10 || '%' AS percent, 'x/a%20b/' || k || '%C3%A9?q=1%20' AS url FROM o""")
def text_forms(t: Tables) -> DataFrame:
    """Dates, months, validities, amounts, percentages, names and addresses, written as documents write them and read again."""
    k, d = F.col("o_orderkey"), F.date_add(F.col("o_orderdate").cast("date"), 11000)
    month = F.element_at(F.array(*map(F.lit, MONTH_NAMES)), F.month(d))
    named = F.when(k % 2 == 0, F.concat(F.lit("Tabela de "), month, F.lit(" de "), F.year(d).cast("string"))).otherwise(F.concat(F.upper(F.left(month, F.lit(3))), F.lit("/"), F.date_format(d, "yy")))
    said = F.when(k % 3 == 0, F.concat(F.lit("VÁLIDA de "), text.written_date(d), F.lit(" até "), text.written_date(F.date_add(d, 30)))).when(k % 3 == 1, F.concat(F.lit("Vigência: "), F.date_format(d, "MM/yyyy"), F.lit(" a "), F.date_format(d, "MM/yyyy"))).otherwise(F.concat(F.lit("impresso em "), text.written_date(d)))
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    amount = F.concat(F.lit("R$:"), (F.expr("cast(round(o_totalprice * 100) as bigint) div 100 % 1000")).cast("string"), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"))
    return t.orders.select(
        k.alias("k"), text.month_by_name(named).alias("month"), text.iso_date(F.when(k % 2 == 0, d.cast("string")).otherwise(text.written_date(d))).alias("iso"), text.written_date(d).alias("written"),
        text.series_of_name(F.concat(F.when(k % 2 == 0, "wayback_").otherwise(""), F.lit("carrier_"), k.cast("string"), F.date_format(d, "'_'yyyy-MM-dd'.PDF'"))).alias("series"), text.normalized(F.concat(F.lit("  Tabela\u00a0 Nº\t"), k.cast("string"))).alias("label"),
        text.validity(said).alias("starts"), text.validity(said, last=True).alias("ends"), (text.money(text.without_currency(amount)) * 100).cast("bigint").alias("price"),
        text.written_percent((k % 201 - 100) / 1000).alias("percent"), text.safe_url(F.concat(F.lit("x/a b/"), k.cast("string"), F.lit("é?q=1%20"))).alias("url"),
    )


@query("""WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) + 11000 AS d, CAST(o_custkey % 400 AS INT) AS n FROM orders) SELECT k, CASE WHEN k % 4 < 3 THEN d END AS starts, CASE WHEN k % 4 < 3 THEN d + n END AS ends FROM o""")
def stated_periods(t: Tables) -> DataFrame:
    """Both ends of a validity as materials write them: with figures, with months by name and two figures of the year, and texts with one date, which is no period."""
    k, first = F.col("o_orderkey"), F.date_add(F.col("o_orderdate").cast("date"), 11000)
    last = F.date_add(first, (F.col("o_custkey") % 400).cast("int"))
    name = lambda d: F.element_at(F.array(*map(F.lit, MONTH_NAMES)), F.month(d))
    named = lambda d: F.concat(F.date_format(d, "dd"), F.lit(" DE "), F.upper(name(d)), F.lit("/"), F.date_format(d, "yy"))
    said = F.when(k % 4 == 0, F.concat(F.lit("VÁLIDO DE "), text.written_date(first), F.lit(" A "), text.written_date(last)))
    said = said.when(k % 4 == 1, F.concat(F.lit("VIGÊNCIA "), named(first), F.lit(" A "), named(last))).when(k % 4 == 2, F.concat(F.lit("de "), F.lower(named(first)), F.lit(" até  "), named(last), F.lit(".")))
    period = text.stated_period(said.otherwise(F.concat(F.lit("impresso em "), text.written_date(first), F.lit(", "), named(last))))
    return t.orders.select(k.alias("k"), period["starts"].alias("starts"), period["ends"].alias("ends"))


@query("WITH p AS (SELECT p_partkey, p_size FROM part) SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Tabela ' || p_size || ' · 2 a 29 vidas' WHEN 1 THEN '2 a 29 vidas' WHEN 2 THEN 'Tabela ' || p_size ELSE '' END AS title, CASE WHEN p_size % 2 = 0 THEN 'coparticipação: com' ELSE 'região: capital' END AS side FROM p")
def headings(t: Tables) -> DataFrame:
    """The title of a table from the lines above it, and the condition that is written upwards or downwards beside it."""
    n = F.col("p_size")
    lines_ = F.array(F.lit("Preços por pessoa"), F.when(n % 2 == 0, F.concat(F.lit("Tabela "), n.cast("string"))).otherwise(F.lit("503.058/25-7 Plano Capital")), F.when(n % 4 < 2, F.lit("2 a 29 vidas")).otherwise(F.lit("vidas")), F.when(n % 2 == 0, F.concat(F.lit("Tabela "), n.cast("string"))).otherwise(F.lit("Pessoas")))
    written = F.when(n % 2 == 0, F.array(F.lit("Com"), F.lit("coparticipação"))).otherwise(F.array(F.lit("latipaC"), F.lit("oãiger")))
    words = t.part.select("p_partkey", F.posexplode(written).alias("y", "text"))
    titled = t.part.select("p_partkey", layout.heading_title(F.filter(lines_, lambda x: x != "vidas")).alias("title"))
    # Titles are much larger than the numbers they are made from, by which Spark sizes them; a merge broadcasts neither side.
    return titled.join(layout.side_tags(words, ["p_partkey"]).hint("merge"), "p_partkey").select("p_partkey", "title", F.array_join("tags", ",").alias("side"))


@query("SELECT sha256(text) AS sha, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY ALL")
def content_dedup(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("sha")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT md5(text) AS digest, arg_min(doc_id, (n_chars + doc_id % 7, doc_id)) AS doc_id, min(n_chars + doc_id % 7) AS at FROM documents GROUP BY ALL")
def earliest_copy(t: Tables) -> DataFrame:
    return links.earliest_copies(t.documents.select(F.md5(F.col("text").cast("binary")).alias("digest"), (F.col("n_chars") + F.col("doc_id") % 7).alias("at"), "doc_id"), "digest", "at", "doc_id")
