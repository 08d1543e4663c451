"""What a caller can ask: a method for each read, over tables that are given once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planwatch.operators import network, overview
from planwatch.operators import quote as quotes
from planwatch.operators.collecting import operators_by_name
from planwatch.sources.files import export_answers


#: How each table is listed where a caller asks for no other order.
ORDERS = {
    "documents": ("-received",), "columns": ("page", "place"), "cells": ("column_id", "band"), "versions": ("product", "place", "-version"),
    "events": ("-at", "-id"), "sources": ("name",), "runs": ("-started",),
}
#: What each state and kind is called where people read it.
LABELS = {
    "processing": "em leitura", "review": "em revisão", "published": "publicado", "history": "histórico", "discarded": "descartado", "error": "erro",
}


def label(code: Column) -> Column:
    """A state's name for people; a code without one stays."""
    names = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(names, code), code)


class Planwatch:
    """Reads over tables by name: prices (keys and band, cents), versions, events, documents, links, requests, sources, runs."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame]):
        self.spark, self.tables = spark, tables

    def _asked(self, ages: list[int], contract: str, region: str) -> tuple[DataFrame, DataFrame, list[str]]:
        """The offers that are asked for, the family, and an offer's keys. Wrong ages and regions are refused."""
        if not ages or any(not 0 <= a <= 120 for a in ages):
            raise ValueError("ages must be 0 to 120, one at least")
        if region and not (len(region) == 2 and region.isalpha()):
            raise ValueError("a region has two letters")
        offers = self.tables["prices"]
        if contract:
            offers = offers.where(F.lower("contract").contains(contract.lower()))
        family = self.spark.createDataFrame([(1, n, a) for n, a in enumerate(ages)], "request int, person int, age int")
        return offers, family, [c for c in offers.columns if c not in ("band", "cents")]

    def quote(self, ages: list[int], contract: str = "", region: str = "") -> DataFrame:
        """Offers for a family, cheapest first; a blank contract asks for all kinds. Totals don't depend on the region; ``quote_details`` says what does."""
        offers, family, keys = self._asked(ages, contract, region)
        return quotes.quote(offers, family.drop("person"), keys).drop("request").orderBy("total", *keys)

    def quote_details(self, ages: list[int], contract: str = "", region: str = "", now: Column | None = None) -> DataFrame:
        """The same with what each person pays, where the price comes from, the plan's network (in ``region``, too), its approved changes (those of the region, or without one
        those ahead) and how many other sources ask for another total. Reads ``made`` (keys, dated, published, confirmed, readers), ``networks`` and ``changes`` as well."""
        offers, family, keys = self._asked(ages, contract, region)
        found = quotes.detailed(quotes.quote(offers, family.drop("person"), keys), keys, self.tables["made"], self.tables["networks"].withColumnRenamed("plan", "product"), self.tables["changes"], now if now is not None else F.current_timestamp(), region.upper() or None)
        return found.join(quotes.by_person(offers, family, keys), ["request", *keys]).drop("request").orderBy("total", *keys)

    def dashboard(self, today: Column | None = None, most: int = 12) -> DataFrame:
        """The start page in one row: its figures, and the latest events."""
        row = overview.figures(*[self.tables[n] for n in ("documents", "cells", "versions", "events")], today if today is not None else F.current_date())
        latest = self.events(most=most).agg(F.sort_array(F.collect_list(F.struct("at", "id", "type", "severity")), asc=False).alias("latest"))
        return row.withColumn("_one", F.lit(1)).join(latest.withColumn("_one", F.lit(1)), "_one").drop("_one")

    def search(self, text: str, most: int = 500) -> DataFrame:
        """Current versions whose name or operator holds the text, or whose product number holds its digits."""
        digits = "".join(c for c in text if c.isdigit())
        hit = F.lower("name").contains(text.lower()) | F.lower("operator").contains(text.lower())
        if digits:
            hit = hit | F.col("product").contains(digits)
        return self.tables["versions"].where(hit & F.col("is_current")).orderBy("product").limit(most)

    def history(self, product: str) -> DataFrame:
        return self.tables["versions"].where(F.col("product") == product).orderBy("series", "version")

    def hospitals(self, plan: str, most: int = 500) -> DataFrame:
        """A plan's hospitals: those with an emergency ward first, then by region, city and name."""
        rows = network.one_row_each(network.active(self.tables["links"], "end"), ["plan", "hospital"], F.struct("urgent", "name"), ["urgent", "region", "city", "name"])
        return rows.where(F.col("plan") == plan).orderBy(F.desc("urgent"), "region", "city", "name").limit(most)

    def changes(self, plan: str, most: int = 200) -> DataFrame:
        return self.tables["requests"].where(F.col("plan") == plan).orderBy(F.desc("requested")).limit(most)

    def events(self, kind: str | None = None, most: int = 100) -> DataFrame:
        e = self.tables["events"]
        return (e.where(F.col("type") == kind) if kind else e).orderBy(F.desc("at"), F.desc("id")).limit(most)

    def documents(self, status: str | None = None) -> DataFrame:
        d = self.tables["documents"]
        return (d.where(F.col("status") == status) if status else d).orderBy(F.desc("received"))

    def regions(self, plan: str) -> DataFrame:
        """A plan's regions (plan, region, hospitals, urgent), those with the most hospitals first."""
        return self.tables["networks"].where(F.col("plan") == plan).orderBy(F.desc("hospitals"), "region")

    def columns(self, doc: str) -> DataFrame:
        """A document's columns as they stand in it."""
        return self.tables["columns"].where(F.col("doc") == doc).orderBy("page", "table", "label")

    def listed(self, name: str) -> DataFrame:
        """A table in its own order."""
        return self.tables[name].orderBy(*[F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in ORDERS[name]])

    def operators(self, fragment: str) -> DataFrame:
        return operators_by_name(self.tables["operators"], fragment)

    def sources(self) -> DataFrame:
        return self.tables["sources"].orderBy(F.desc("reliability"), "name")

    def runs(self, capture: str) -> DataFrame:
        return self.tables["runs"].where(F.col("capture") == capture).orderBy(F.desc("started"))

    def export(self, path: str, today: Column | None = None, most: int = 500) -> None:
        """All reads as JSON below ``path`` for a page without a server: lists and the start page whole; columns of each document, regions of each plan, history of each
        product and runs of each capture in folders of their own; and ``quote_base``, from which the page makes quotes for any ages and region itself. Reads
        ``offers`` (product, source, place, tags, prices, ...) as well."""
        t, now = self.tables, today if today is not None else F.current_date()
        whole = {
            "dashboard": self.dashboard(today), "operators": t["operators"], "documents": self.documents(), "documents_in_review": self.documents("review"), "events": self.events(most=most), "sources": self.sources(),
            "tables": t["versions"].where("is_current"), "quote_base": quotes.base(t["offers"], t["networks"].withColumnRenamed("plan", "product"), t["changes"], now),
        }
        each = {"document": (t["columns"], "doc"), "network": (t["networks"], "plan"), "history": (t["versions"], "product"), "runs": (t["runs"], "capture")}
        export_answers(whole, each, path)
