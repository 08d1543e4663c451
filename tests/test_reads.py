"""Faults that are planted and scored, headers of tables, and what is exported for a page without a server."""

import glob
import json
from datetime import date

from pyspark.sql import functions as F

from planwatch.facade import Planwatch
from planwatch.operators import collecting, faults, headers, quote, reconcile

FACTORS = [1.0, 1.15, 1.3, 1.5, 1.8, 2.0, 2.4, 2.9, 3.6, 5.4]


def grid(spark):
    rows = [(d, c, [round((170.0 + 31.7 * c + 3.3 * d) * f, 2) for f in FACTORS]) for d in range(4) for c in range(6)] + [(0, 90, None), (1, 91, []), (2, 92, [None] * 10), (3, 93, [100.0 + 13 * i * i for i in range(10)])]
    return spark.createDataFrame(rows, "doc int, c int, prices array<double>")


def test_each_fault_is_tried_by_itself(spark):
    df = grid(spark)
    found = faults.planted(df, "doc", "c", every=3).collect()
    assert len(found) > 40 and not any(r["c"] >= 90 for r in found)
    whole = {(r["doc"], r["c"]): r["prices"] for r in df.collect()}
    for r in found[:6]:  # the same by a whole copy of the document with the one fault in it
        copy = [(r["doc"], c, [r["cents"] / 100 if (c, i) == (r["c"], r["band"]) else p for i, p in enumerate(ps)]) for (d, c), ps in whole.items() if d == r["doc"] and ps]
        anew = reconcile.recompute(spark.createDataFrame(copy, df.schema), "doc", "c").where((F.col("c") == r["c"]) & (F.col("band") == r["band"])).collect()
        assert [x["value"] for x in anew] == ([r["value"]] if r["value"] is not None else [])
    assert all(r["detected"] and r["repaired"] for r in found if r["kind"] == "large")
    assert all(r["true_cents"] == round(whole[r["doc"], r["c"]][r["band"]] * 100) != r["cents"] for r in found)
    total = {r["kind"]: r for r in faults.scores(faults.planted(df, "doc", "c", every=3)).collect()}
    assert sum(r["faults"] for r in total.values()) == len(found) and total["large"]["share_repaired"] == 1.0
    assert faults.scores(faults.planted(df.limit(0), "doc", "c")).count() == 0


def test_faults_change_a_digit_or_exchange_two(spark):
    rows = spark.range(4000).select(F.col("id").alias("k"), (F.col("id") % 10).cast("int").alias("band"), (F.col("id") * 37 + 1).alias("cents"))
    kinds = {"digit": 0, "swap": 0}
    for r in collecting.mutated(rows, ["k"], swaps=True).where("kind is not null").collect():
        a, b = str(r["true_cents"]), str(r["cents"]).zfill(len(str(r["true_cents"])))
        off = [i for i in range(len(a)) if a[i] != b[i]]
        exchanged = len(off) == 2 and off[1] == off[0] + 1 and a[off[0]] == b[off[1]] and a[off[1]] == b[off[0]]
        assert exchanged or len(off) == 1
        kinds["swap" if exchanged else "digit"] += 1
        share = abs(r["cents"] - r["true_cents"]) / r["true_cents"]
        assert r["kind"] == ("large" if share >= 0.01 else "small" if share >= 0.001 else "cents")
    assert min(kinds.values()) > 100


def test_the_lowest_registration_holds_a_column(spark):
    columns = spark.createDataFrame([(1, 0, 100.0), (1, 1, 200.0), (1, 2, 290.0), (2, 0, 50.0)], "tab int, column int, x double")
    words = [
        ("123.456/78-9", 90.0, 100.0, 20.0), ("111111/11-1", 91.0, 101.0, 50.0), ("222.222/22-2", 140.0, 150.0, 60.0),  # the third is as near to either, and the lowest
        ("333.333/33-3", 255.0, 255.0, 10.0), ("Ouro", 190.0, 200.0, 30.2), ("Plano", 195.0, 199.0, 20.0), ("Mais", 180.0, 190.0, 29.8), ("444.444/44-4", 400.0, 400.0, 70.0), (None, 1.0, 100.0, 1.0),
    ]
    of = [(1, *w, 80.0 - w[3]) for w in words]
    df = spark.createDataFrame(of, "tab int, text string, x0 double, xc double, yc double, below double")
    got = {(r["tab"], r["column"]): (r["registration"], r["header"]) for r in headers.assigned(columns, df, ["tab"]).collect()}
    assert got == {(1, 0): ("222222222", ""), (1, 1): (None, "Plano Mais Ouro"), (1, 2): ("333333333", ""), (2, 0): (None, "")}
    assert headers.assigned(columns.limit(0), df, ["tab"]).count() == 0 and headers.assigned(columns, df.limit(0), ["tab"]).count() == 4


def test_a_header_ends_at_the_table_above_it(spark):
    tables = spark.createDataFrame([(1, 0, 100.0, 200.0, 50.0, 150.0), (1, 1, 300.0, 400.0, 60.0, 140.0), (1, 2, 250.0, 280.0, 400.0, 500.0)], "page int, table int, top double, base double, x0 double, x1 double")
    words = spark.createDataFrame([(1, t, x, x, y) for t, x, y in [("a", 100.0, 20.0), ("b", 100.0, 198.0), ("c", 100.0, 197.0), ("d", 100.0, 299.0), ("e", 155.0, 250.0), ("f", 100.0, 300.0), ("g", 450.0, 60.0)]], "page int, text string, x0 double, xc double, yc double")
    got = {(r["table"], r["text"]): r["below"] for r in headers.above(tables, words, ["page"]).collect()}
    assert got == {(0, "a"): 80.0, (1, "b"): 102.0, (1, "d"): 1.0, (2, "g"): 190.0}


def test_quote_base_of_products_with_nothing_else(spark):
    offers = spark.createDataFrame([("p", "s", 0, ["vidas: 1"], [1.0]), ("p", "t", 0, ["vidas: 1"], [2.0]), ("p", "t", 1, ["vidas: 2 a 29"], [3.0]), ("q", "s", 0, [], [4.0])], "product string, source string, place int, tags array<string>, prices array<double>")
    networks = spark.createDataFrame([("p", "SP", 3, 1), ("p", "RJ", 2, 0)], "product string, region string, hospitals int, urgent int")
    day = date(2024, 1, 31)
    changes = spark.createDataFrame([("p", "1", "SP", day), ("p", "1", "SP", day), ("p", "2", "SP", date(2023, 1, 1)), ("p", "3", None, day)], "product string, protocol string, region string, effective date")
    got = {(r["product"], r["source"], r["place"]): r for r in quote.base(offers, networks, changes, F.lit(day)).collect()}
    assert len(got) == 4 and [tuple(p) for p in got["p", "s", 0]["peers"]] == [("t", 0)] and got["p", "t", 1]["peers"] == [] == got["q", "s", 0]["network"] == got["q", "s", 0]["changes_ahead"] == got["q", "s", 0]["changes_by_region"]
    p = got["p", "t", 0]
    assert [tuple(n) for n in p["network"]] == [("RJ", 2, 0), ("SP", 3, 1)] and p["changes_ahead"] == ["1", "3"] and [(r["region"], r["protocols"]) for r in p["changes_by_region"]] == [("SP", ["1", "2"])]


def test_everything_is_exported(spark, tmp_path):
    of = spark.createDataFrame
    offers = of([("p", "s", 0, ["vidas: 1"], [1.0])], "product string, source string, place int, tags array<string>, prices array<double>")
    tables = {
        "documents": of([(1, "review", "2024-01-01", 2, 1, 0.5), (2, "published", "2024-01-02", 1, 0, 0.0)], "id int, status string, received string, with_product int, open_with_product int, cost double"),
        "cells": of([("p", "confirmed", False, False)], "product string, status string, review boolean, corrected boolean"),
        "versions": of([("p", "a", 1, "op", date(2023, 1, 1), False), ("p", "a", 2, "op", None, True)], "product string, series string, version int, operator string, until date, is_current boolean"),
        "events": of([(1, "2024-01-01", "x", "info", False)], "id int, at string, type string, severity string, resolved boolean"),
        "operators": of([("Op", None, True)], "name string, trade_name string, active boolean"), "sources": of([("s", 3)], "name string, reliability int"), "runs": of([("c", 1, "2024")], "capture string, n int, started string"),
        "columns": of([("1", 1, 0, "A"), ("2", 1, 0, "B")], "doc string, page int, table int, label string"), "networks": of([("p", "SP", 3, 1)], "plan string, region string, hospitals int, urgent int"),
        "changes": of([], "product string, protocol string, region string, effective date"), "offers": offers,
    }
    out = str(tmp_path / "out")
    for _ in range(2):  # the second replaces the first
        Planwatch(spark, tables).export(out, F.lit("2024-01-31").cast("date"))
    read = lambda name: [json.loads(line) for f in sorted(glob.glob(f"{out}/{name}/*.json")) for line in open(f)]
    assert [len(read(n)) for n in ("operators", "documents", "documents_in_review", "events", "sources", "tables", "dashboard")] == [1, 2, 1, 1, 1, 1, 1]
    assert [r["version"] for r in read("history/_key=p")] == [1, 2] and read("document/_key=2")[0]["label"] == "B" and read("network/_key=p")[0]["hospitals"] == 3 and read("runs/_key=c")[0]["n"] == 1
    assert read("quote_base")[0]["peers"] == [] and read("quote_base")[0]["network"] == [{"region": "SP", "hospitals": 3, "urgent": 1}]
