"""Quotes: what a family pays under each offer that sells all its bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planwatch.functions.bands import band_of_age
from planwatch.operators.lookup import other_sources


def quote(offers: DataFrame, ages: DataFrame, keys: list[str]) -> DataFrame:
    """(request, keys, total) for offers (keys, band, cents) and requests (request, age), if the offer has each band needed.

    Two people of one band count twice. Requests are small beside offers, but the join is on the band either way."""
    invalid = ages.where(~F.coalesce(F.col("age").between(0, 120), F.lit(False)))
    need = ages.join(invalid.select("request").distinct(), "request", "left_anti").withColumn("band", band_of_age(F.col("age"))).groupBy("request", "band").agg(F.count("*").alias("people"))
    wanted = need.groupBy("request").agg(F.count("*").alias("bands"))
    sums = offers.join(need, "band").groupBy("request", *keys).agg(F.sum(F.col("cents") * F.col("people")).alias("total"), F.count("*").alias("met"))
    return sums.join(wanted, "request").where("met = bands").select("request", *keys, "total")


def by_person(offers: DataFrame, people: DataFrame, keys: list[str]) -> DataFrame:
    """(request, keys, per_person) for people (request, person, age): what each pays under an offer, in the order of ``person``, as (age, band, cents); bands that an
    offer doesn't sell are left out."""
    each = offers.join(people.withColumn("band", band_of_age(F.col("age"))), "band")
    listed = F.array_sort(F.collect_list(F.struct("person", "age", "band", "cents")))
    made = each.groupBy("request", *keys).agg(listed.alias("_p"))
    return made.select("request", *keys, F.transform("_p", lambda p: F.struct(p["age"].alias("age"), p["band"].alias("band"), p["cents"].alias("cents"))).alias("per_person"))


def divergences(quotes: DataFrame, product: str, source: str, least: int = 1, offers: DataFrame | None = None) -> DataFrame:
    """Offers of a product whose total differs by ``least`` or more from that of another source's offer of the same condition: (request, product, source, other,
    difference, ratio, other_newer) for quotes with dated, the date of the material: ratio is the other total over this one, less one; a
    material without a date is older than any with one.

    Of each other source the one offer counts whose tags fit best, then whose place is nearest (``lookup.other_sources``), among all of ``offers`` (product, source,
    place, tags), the quotes themselves if these are not given. Without tags or place a source has one offer of a product."""
    plain = {"place": F.lit(0), "tags": F.array().cast("array<string>")}
    filled = lambda df: df.withColumns({c: v for c, v in plain.items() if c not in df.columns})
    quotes = filled(quotes)
    offers = filled(offers if offers is not None else quotes).select(product, source, "place", "tags").distinct()
    pairs = other_sources(offers, product, [source], "place").select(product, F.col(f"own.{source}").alias(source), F.col("own.place").alias("place"), F.col(f"peer.{source}").alias("other"), F.col("peer.place").alias("other_place"))
    own = quotes.select("request", product, source, "place", F.col("total").alias("_a"), F.col("dated").alias("_a_dated"))
    peer = quotes.select("request", product, F.col(source).alias("other"), F.col("place").alias("other_place"), F.col("total").alias("_b"), F.col("dated").alias("_b_dated"))
    both = own.join(pairs, [product, source, "place"]).join(peer, ["request", product, "other", "other_place"])
    gap, first = F.col("_b") - F.col("_a"), F.lit("0001-01-01").cast("date")
    newer = F.coalesce("_b_dated", first) > F.coalesce("_a_dated", first)
    ratio = F.try_divide(F.col("_b").cast("double"), F.col("_a").cast("double")) - 1
    return both.where(F.abs(gap) >= least).select("request", product, source, "other", gap.alias("difference"), ratio.alias("ratio"), newer.alias("other_newer"))


def days_since(confirmed: Column, published: Column, now: Column) -> Column:
    """Whole days since a price was last confirmed, or published if it never was."""
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(F.coalesce(confirmed, published))) / 86400).cast("int")


def detailed(quotes: DataFrame, keys: list[str], versions: DataFrame, networks: DataFrame, changes: DataFrame, now: Column, region: str | None = None, source: str = "source") -> DataFrame:
    """Quotes (request, keys, total) with where they come from and what is known about their plan.

    From versions (keys, name, condition, dated, from, until, version, doc, published, confirmed, readers): all of it, and days since confirmation and
    whether two readers agreed. From networks (product, region, hospitals, urgent): the plan's totals, and those in ``region``. From approved
    changes (product, protocol, region, effective): how many there are, of the region, or without one those that are still ahead. ``others`` is
    how many other sources ask for another total. Each side is one row a key before it is joined."""
    total = networks.groupBy("product").agg(F.sum("hospitals").alias("hospitals"), F.sum("urgent").alias("urgent"), F.sum(F.when(F.col("region") == F.lit(region), F.col("hospitals"))).alias("hospitals_in_region"))
    near = changes.where(F.col("region") == F.lit(region)) if region else changes.where(F.col("effective") >= F.to_date(now))
    coming = near.groupBy("product").agg(F.count_distinct("protocol").alias("network_changes"))
    made = quotes.join(versions, keys).withColumns({"days": days_since(F.col("confirmed"), F.col("published"), now), "two_readers": F.col("readers") == 2})
    other = divergences(made, "product", source).groupBy("request", "product", source).agg(F.count("*").alias("others"))
    made = made.join(total, "product", "left").join(coming, "product", "left").join(other, ["request", "product", source], "left")
    return made.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("network_changes", "others")})


def base(offers: DataFrame, networks: DataFrame, changes: DataFrame, today: Column, product: str = "product", source: str = "source") -> DataFrame:
    """All that a quote needs, made ready for a reader without the engine: ``offers`` (product, source, place, tags, ...) with peers, the offers of the same
    condition in each other source as (source, place), network, the plan's regions as (region, hospitals, urgent), changes_ahead, the protocols still ahead of
    ``today``, and changes_by_region, all protocols of each region. networks: (product, region, hospitals, urgent), changes: (product,
    protocol, region, effective). What there is nothing of is an empty list. Each side is one row a key before it is joined."""
    key = [product, source, "place"]
    pairs = other_sources(offers.select(*key, "tags").distinct(), product, [source], "place")
    peers = pairs.groupBy(product, F.col(f"own.{source}").alias(source), F.col("own.place").alias("place")).agg(F.array_sort(F.collect_set(F.struct(F.col(f"peer.{source}").alias("source"), F.col("peer.place").alias("place")))).alias("peers"))
    network = networks.groupBy(product).agg(F.array_sort(F.collect_list(F.struct("region", "hospitals", "urgent"))).alias("network"))
    listed = lambda c: F.array_sort(F.collect_set(c))
    ahead = changes.where(F.col("effective") >= today).groupBy(product).agg(listed("protocol").alias("changes_ahead"))
    by_region = changes.where("region is not null").groupBy(product, "region").agg(listed("protocol").alias("protocols")).groupBy(product).agg(F.array_sort(F.collect_list(F.struct("region", "protocols"))).alias("changes_by_region"))
    made = offers.join(peers, key, "left")
    for side in (network, ahead, by_region):
        made = made.join(side, product, "left")
    return made.withColumns({c: F.coalesce(c, F.array().cast(made.schema[c].dataType)) for c in ("peers", "network", "changes_ahead", "changes_by_region")})
