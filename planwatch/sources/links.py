"""Links of pages, copies in web archives, robots rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from planwatch.functions.text import safe_url, unescaped

#: The elements that may carry a link.
ELEMENTS = ("a", "button", "area", "link", "option")
#: An attribute by HTML's grammar: a name, an equals sign, and a value that ends at its own quote or, without quotes, at a blank.
_NAMED = r"""[^\s"'=<>/]+\s*=\s*"""
_VALUES = tuple(f"{q}[^{q}]*{q}" for q in "\"'") + (r"""[^\s"'>]+""",)


def _opened(html: Column) -> Column:
    """The tags of a page that open an element of ELEMENTS, as name and the rest up to the next >, in order."""
    tags = F.transform(F.filter(F.slice(F.split(html, "<"), F.lit(2), F.greatest(F.size(F.split(html, "<")) - 1, F.lit(0))), lambda x: F.contains(x, F.lit(">"))), lambda x: F.substring_index(x, ">", 1))
    named = F.transform(tags, lambda x: F.struct(F.lower(F.regexp_extract(x, "^[A-Za-z0-9]+", 0)).alias("name"), x.alias("raw")))
    return F.filter(named, lambda t: t["name"].isin(*ELEMENTS))


def _attributes(raw: Column) -> Column:
    """The attributes of a tag, as name in lower case and value without its quotes."""
    whole = F.regexp_extract_all(raw, F.lit(f"{_NAMED}(?:{'|'.join(_VALUES)})"), F.lit(0))
    value = lambda x: F.trim(F.substr(x, F.instr(x, "=") + 1))
    bare = lambda v: F.when(F.left(v, F.lit(1)).isin('"', "'"), F.substr(v, F.lit(2), F.length(v) - 2)).otherwise(v)
    return F.transform(whole, lambda x: F.struct(F.lower(F.rtrim(F.substring_index(x, "=", 1))).alias("name"), bare(F.regexp_replace(value(x), r"^\s+", "")).alias("value")))


def tags_with_links(pages: DataFrame, key: str, html: str, attributes: tuple[str, ...] = ("href",), title: str | None = None) -> DataFrame:
    """(key, place, href, title, disabled) for each element of a page that carries a link, in order.

    Reads what browsers forgive: elements and attributes in either case, values in double, single or no quotes. The link is the first of
    ``attributes`` that has a value which is neither a fragment nor a script, with its entities decoded; title is another attribute's value."""
    found = pages.select(key, F.posexplode(_opened(F.col(html))).alias("place", "tag")).select(key, "place", "tag.raw", _attributes(F.col("tag.raw")).alias("pairs"))
    of = lambda name: F.get(F.transform(F.reverse(F.filter("pairs", lambda p: p["name"] == name)), lambda p: p["value"]), 0)
    usable = lambda v: F.when((v != "") & ~v.startswith("#") & ~v.startswith("javascript:"), v)
    link = F.coalesce(*[usable(unescaped(of(a.lower()))) for a in attributes])
    name = F.trim(unescaped(of(title.lower()))) if title else F.lit(None).cast("string")
    disabled = F.array_contains(F.split(F.lower("raw"), r"[\s/=]+"), "disabled")
    return found.select(key, "place", F.trim(link).alias("href"), name.alias("title"), disabled.alias("disabled")).where("href is not null")


def absolute(href: Column, base: Column) -> Column:
    """A decoded link's address seen from its page, safe to ask for, without a fragment: full, scheme-less, rooted, a query alone, or relative
    with steps up."""
    h = F.regexp_replace(href, "#.*$", "")
    root, scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    page, folder = F.regexp_extract(base, r"^([^?#]*)", 1), F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*/|)", 1)
    path = F.when(h.startswith("/"), h).otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), h))
    query = F.regexp_extract(path, r"(\?.*)$", 1)
    up = F.lit(None).cast("array<string>")
    steps = F.split(F.regexp_extract(path, r"^([^?]*)", 1), "/")
    up = F.aggregate(
        steps, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)).when(s == ".", acc).otherwise(F.concat(acc, F.array(s))),
    )
    last = F.element_at(steps, -1)
    walked = F.concat(F.array_join(up, "/"), F.when(last.isin("..", "."), F.lit("/")).otherwise(F.lit("")), query)
    full = F.when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h).when(h.startswith("//"), F.concat(scheme, h)).when(h == "", base).when(h.startswith("?"), F.concat(page, h)).otherwise(F.concat(root, walked))
    return safe_url(full)


def wanted(found: DataFrame, include: str | None, exclude: str | None, *columns: str) -> DataFrame:
    """Rows of which some column matches ``include`` and none ``exclude``, letters in either case."""
    text = F.concat_ws(" ", *columns)
    kept = found.where(text.rlike(f"(?i){include}")) if include else found
    return kept.where(~text.rlike(f"(?i){exclude}")) if exclude else kept


def first_of_each(found: DataFrame, key: str) -> DataFrame:
    """Of equal addresses of a page the first in order."""
    return found.groupBy(key, "url").agg(F.min_by(F.struct(*[c for c in found.columns if c not in (key, "url")]), "place").alias("r")).select(key, "url", "r.*")


def fixed_addresses(configs: DataFrame, key: str, urls: str) -> DataFrame:
    """(key, url) of sources that list their addresses."""
    return configs.select(key, F.explode(F.array_distinct(urls)).alias("url"))


def archive_rows(indexes: DataFrame, key: str, body: str) -> DataFrame:
    """(key, address, at, digest) of a web archive's index answers: a JSON array whose first row names the fields of the others."""
    rows = F.from_json(body, "array<array<string>>")
    each = indexes.select(key, F.get(rows, 0).alias("head"), F.explode(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))).alias("r"))
    field = lambda name: F.get("r", (F.array_position("head", name) - 1).cast("int"))
    return each.select(key, field("original").alias("address"), field("timestamp").alias("at"), field("digest").alias("digest"))


def earliest_copies(copies: DataFrame, digest: str, at: str, what: str) -> DataFrame:
    """For each content the first copy, of several at one time the least."""
    return copies.groupBy(digest).agg(F.min_by(what, F.struct(at, what)).alias(what), F.min(at).alias(at))


def robots_rules(files: DataFrame, agent: str) -> DataFrame:
    """(host, kind, pattern, delay) of robots files (host, body) for a robot: the rules of the groups that name it, of those for all (*) where
    none does; delay is the first one that these groups give. A host without rules has none.

    A group is a run of user-agent lines and what follows; lines without a colon, comments and blank ones part nothing."""
    line = F.trim(F.regexp_replace("raw", "#.*$", ""))
    split = files.select("host", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("n", "raw")).withColumn("line", line).where(F.contains("line", F.lit(":")))
    named = split.select("host", "n", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("field"), F.trim(F.expr("substring(line, instr(line, ':') + 1)")).alias("value"))
    w = W.partitionBy("host").orderBy("n")
    speaks = F.col("field") == "user-agent"
    begins = speaks & ~F.coalesce(F.lag(speaks).over(w), F.lit(False))
    grouped = named.withColumn("_begins", begins.cast("int")).withColumn("group", F.sum("_begins").over(w.rowsBetween(W.unboundedPreceding, 0))).where("group > 0")
    product = agent.split("/")[0].strip().lower()
    agents = grouped.where("field = 'user-agent'").groupBy("host", "group").agg(F.bool_or(F.lower("value") == product).alias("own"), F.bool_or(F.col("value") == "*").alias("all"))
    any_own = F.bool_or("own").over(W.partitionBy("host"))
    mine = agents.withColumn("_own", any_own).where((F.col("_own") & F.col("own")) | (~F.col("_own") & F.col("all"))).select("host", "group")
    said = grouped.join(mine, ["host", "group"])
    delays = said.where("field = 'crawl-delay'").withColumn("d", F.col("value").try_cast("double")).where("d is not null").groupBy("host").agg(F.min_by("d", "n").alias("delay"))
    kind = F.when(F.col("field") == "allow", "Allow").when(F.col("field") == "disallow", "Disallow")
    return said.withColumn("kind", kind).where("kind is not null").join(delays, "host", "left").select("host", "kind", F.col("value").alias("pattern"), "delay")


def _decoded(text: Column) -> Column:
    """Escapes of an address as the characters they stand for; a plus sign and a percent sign that begins none stay."""
    return F.url_decode(F.replace(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B")))


def _asked_path(path: Column) -> Column:
    """What rules are held against: the path, / if it is empty, and the query, both without escapes."""
    at = F.instr(path, "?")
    before = F.when(at > 0, F.substring(path, F.lit(1), at - 1)).otherwise(path)
    query = F.when(at > 0, F.substr(path, at + 1)).otherwise("")
    return F.concat(_decoded(F.when(before == "", "/").otherwise(before)), F.when(query != "", F.concat(F.lit("?"), _decoded(query))).otherwise(""))


def _pattern(rule: Column) -> Column:
    """A robots pattern as a regular expression: escapes are decoded, * is anything, a $ at the end is the end."""
    quoted = F.regexp_replace(_decoded(F.regexp_replace(rule, r"\$$", "")), r"([.?+^$()\[\]{}|\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(quoted, F.lit("*"), F.lit(".*")), F.when(rule.endswith("$"), "$").otherwise(""))


def allowed(paths: DataFrame, rules: DataFrame, path: str, host: str = "host") -> DataFrame:
    """``paths`` (host, path with its query) with allowed by the rules (host, kind, pattern) of their host: the longest pattern that matches wins, Allow on
    ties, true without one. Both are compared without escapes, an empty path as /. Each host's rules are one row; a robots file is small."""
    rule = F.struct(F.length("pattern").alias("n"), (F.col("kind") == "Allow").alias("ok"), _pattern(F.col("pattern")).alias("re"))
    listed = rules.where("pattern <> ''").groupBy(host).agg(F.collect_set(rule).alias("_rules"))
    best = F.array_max(F.filter("_rules", lambda r: F.regexp_like(F.col("_asked"), r["re"])))
    asked = paths.withColumn("_asked", _asked_path(F.coalesce(F.col(path), F.lit(""))))
    return asked.join(listed, host, "left").withColumn("allowed", F.coalesce(best["ok"], F.lit(True))).drop("_rules", "_asked")
