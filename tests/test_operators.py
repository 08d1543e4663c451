"""Behaviour of the operators on small rows of our own."""

import datetime
import itertools
import random
import time
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from planwatch.facade import Planwatch
from planwatch.functions import bands, tags, text
from planwatch.operators import layout, lookup, matching, publish, quote, reconcile, rules, versions
from planwatch.sources import files, links
from planwatch.streaming import feeds

FACTORS = [1.0, 1.15, 1.3, 1.5, 1.8, 2.0, 2.4, 2.9, 3.6, 5.4]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("title,want", [
    ("Tabela 2 a 29 Vidas – Compulsório", ["adesão: compulsória", "vidas: 2 a 29"]), ("01 vida", ["vidas: 1"]), ("A partir de 30 vidas, Livre Adesão", ["adesão: livre", "vidas: 30 ou mais"]),
    ("com coparticipação total ou parcial", []), ("Coparticipação parcial", ["coparticipação: parcial"]), ("sem coparticipação", ["coparticipação: sem"]), ("com coparticipação", ["coparticipação: com"]),
    ("Titular + 2, Interior 3", ["composição: titular + 2", "região: interior 3"]), ("Titular Capital Porte II", ["composição: titular", "porte: II", "região: capital"]), ("Tabela Fechada Grupo 7", ["grupo: 7", "tabela: fechada"]), ("", []),
])
def test_condition_tags(spark, title, want):
    assert one(spark, tags.condition_tags(F.lit(title))) == want


def test_tags_combine_and_contradict(spark):
    a = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert one(spark, tags.combined(a("adesão: compulsória"), a("adesão: livre", "vidas: 1"))) == ["adesão: compulsória", "vidas: 1"]
    assert one(spark, tags.compatible(a("coparticipação: com"), a("coparticipação: total"))) is True
    assert one(spark, tags.compatible(a("coparticipação: sem"), a("coparticipação: total"))) is False
    assert one(spark, tags.compatible(a("vidas: 1"), a("região: capital"))) is True and one(spark, tags.compatible(a(), a("vidas: 1"))) is True


@pytest.mark.parametrize("f,raw,want", [
    (text.money, "1.065,14", "1065.14"), (text.money, "12,5", None), (text.money, "1065,14", None), (text.registration, "503.058/25-7", "503058257"), (text.registration, "503058257", "503058257"), (text.registration, "12", None),
    (text.formatted_registration, "503058257", "503.058/25-7"), (text.slug, "São Paulo 2024!", "s_o_paulo_2024"), (text.fold, "Não–É", "nao-e"), (text.proper_name, "HOSPITAL DE CLINICAS UTI", "Hospital de Clinicas UTI"),
    (text.series_key, "https://web.archive.org/web/20240101000000/http://www.x.com:80/a/Tabela_2024-05-17.pdf", "x.com/a/tabela.pdf"), (text.series_key, "https://x.com/t_16_07_2026.pdf", "x.com/t.pdf"), (text.series_key, "https://x.com/product201205678.pdf", "x.com/product201205678.pdf"), (text.date_in_name, "https://x.com/product201205678.pdf", None), (text.date_in_name, "https://x.com/t_16_07_2026.pdf", date(2026, 7, 16)), (text.file_name, "https://x.com/a/b%20c?d=1", "b c.pdf"), (text.date_in_name, "https://x.com/t_20240230.pdf", None), (text.date_in_name, "https://x.com/t-2024-05-01.pdf", date(2024, 5, 1)), (text.fold, "Nº 1ª ﬁm ŏ", "no 1a fim o"), (text.band_of_label, "59\u00a0anos ou mais", 9), (text.band_of_label, "&ge; 59", 9), (text.band_of_label, "&#62; 59", 9), (text.band_of_label, "5 a 10 vidas", None), (text.unescaped, "a &amp;gt; b &#233;&x;", "a &gt; b é&x;"), (text.safe_url, "http://x/a b%20ç", "http://x/a%20b%20%C3%A7"),
    (text.validity, "Vigência: 01/05/2024 a 30/04/2025", date(2024, 5, 1)), (text.validity, "válida a partir de 02/2024", date(2024, 2, 1)), (text.validity, "atualizado em 01/05/2024", None),
])
def test_texts(spark, f, raw, want):
    got = one(spark, f(F.lit(raw)))
    assert (str(got) if f is text.money and got is not None else got) == want


def test_validity_ends_with_the_month(spark):
    assert one(spark, text.validity(F.lit("vigente de 01/2024 até 02/2024"), last=True)) == date(2024, 2, 29)


@pytest.mark.parametrize("age,band", [(0, 0), (18, 0), (19, 1), (23, 1), (24, 2), (58, 8), (59, 9), (120, 9), (121, None), (-1, None)])
def test_band_of_age(spark, age, band):
    assert one(spark, bands.band_of_age(F.lit(age))) == band


def test_vectors(spark):
    a = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<double>")
    full = a(*range(1, 11))
    assert one(spark, bands.is_complete(full)) and one(spark, bands.is_complete(a(None, None, *range(8)))) and not one(spark, bands.is_complete(a(1, None, *range(8))))
    assert one(spark, bands.unread(a(None, 1, None, *range(7)))) == [2] and one(spark, F.size(bands.padded(a(1)))) == 10 and not one(spark, bands.is_complete(a()))
    assert one(spark, bands.changed(a(1, 2, 3, None, 5), a(1, 2.004, 4, 7, None))) == [2] and one(spark, bands.middle(bands.variation(a(1, 2, 4), a(2, 3, 5)))) == 0.5 and one(spark, bands.middle(a())) is None and one(spark, bands.agreement(full, full)) == 10


def test_recompute_makes_no_row_of_a_pair(spark):
    scaled = lambda base: [round(base * f, 2) for f in FACTORS]
    rows = [(d, c, scaled(100 + 10 * d + c)) for d in range(40) for c in range(5)] + [(None, 1, scaled(90)), (7, None, scaled(80)), (50, 1, None), (50, 2, [])]
    rows += [(60, 1, scaled(100)), (60, 1, scaled(200)), (60, 2, scaled(300))]  # the two of one key count together
    made = reconcile.recompute(spark.createDataFrame(rows, "doc int, c int, prices array<double>"), "doc", "c")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    got = {(r["doc"], r["c"], r["band"]): r["support"] for r in made.collect()}
    assert got == {(d, c, b): 4 for d in range(40) for c in range(5) for b in range(10)} | {(60, c, b): 2 for c in (1, 2) for b in range(10)}


def test_recompute_repairs_a_planted_error(spark):
    rows = [(1, c, [round(base * f, 2) for f in FACTORS]) for c, base in enumerate([210.0, 333.33, 150.1, 421.7])] + [(1, 9, [100.0 + 13 * i * i for i in range(10)]), (1, 10, [0.0] * 10), (1, 11, [None] * 10)]
    truth, rows[0][2][4] = rows[0][2][4], rows[0][2][4] + 30
    df = spark.createDataFrame(rows, "doc int, c int, prices array<double>")
    got = {(r["c"], r["band"]): r["value"] for r in reconcile.recompute(df, "doc", "c").collect()}
    assert abs(got[0, 4] - truth) <= 0.015 and not any(c in (9, 10, 11) for c, _ in got)
    cells = spark.createDataFrame([(1, 0, 4, truth + 30, truth, "divergent"), (1, 1, 4, rows[1][2][4] + 1, rows[1][2][4] + 1, "confirmed"), (1, 2, 4, None, 1.0, "only_b")], "doc int, c int, band int, a double, b double, status string")
    out = {r["c"]: (r["outcome"], r["chosen"]) for r in reconcile.apply_recompute(cells, reconcile.recompute(df, "doc", "c"), ["doc", "c"]).collect() if r["status"]}
    assert out == {0: ("confirmed_calc", truth), 1: ("info", None), 2: ("alert", None)}


def found(spark, prices, mixed=False):
    df = spark.createDataFrame([(1, i, float(p), mixed) for i, p in enumerate(prices) if p is not None], "k int, band int, price double, mixed boolean")
    return sorted((r["rule"], r["severity"], r["bands"]) for r in rules.band_rules(df, ["k"], F.col("mixed")).collect())


def test_band_rules(spark):
    legal = [100, 110, 120, 130, 140, 150, 300, 400, 500, 600]
    assert found(spark, legal) == [] and found(spark, [*legal[:9], 700]) == [("six_times", "error", [0, 9])] and found(spark, [*legal[:9], 700], True) == [("six_times", "info", [0, 9])]
    assert ("decrease", "error", [3]) in found(spark, [100, 110, 130, 120, *legal[4:]]) and found(spark, [None] * 6 + legal[6:]) == [("incomplete", "info", [])]
    assert found(spark, [100, *[None] * 5, 300, 400]) == [] and found(spark, [*legal[:6], None, *legal[7:]]) == []
    assert found(spark, [100, 110, 120, 130, 140, 150, 160, 400, 500, 590]) == [("late_rise", "error", [0, 6, 9])]


def test_reference_note(spark):
    vcm = [100.0 * f for f in FACTORS]
    notes = [("p", n, date(2024, 1, 1), b, v * k, v * k * 0.9, v * k * 1.3) for n, k in ((1, 1.0), (2, 7.0)) for b, v in enumerate(vcm)]
    notes = spark.createDataFrame([(p, n, d, b, v if n == 1 else v + b * 50, lo, hi) for p, n, d, b, v, lo, hi in notes], "plan string, note int, note_date date, band int, vcm double, low double, high double")
    prices = [v * 1.2 for v in vcm]
    prices[3] *= 1.2
    cols = spark.createDataFrame([("p", date(2024, 3, 1), b, v) for b, v in enumerate(prices)], "plan string, material_date date, band int, price double")
    check = lambda f, cols: sorted((r["note"] or 0, r["rule"], r["severity"], r["bands"]) for r in f(cols, notes, ["plan", "material_date"], "plan").collect())
    assert check(rules.reference_note, cols) == [(1, "off_pattern", "alert", [3])]
    high = spark.createDataFrame([("p", date(2024, 3, 1), b, v * 2) for b, v in enumerate(vcm)] + [("q", date(2024, 3, 1), 0, 1.0)], cols.schema)
    assert check(rules.reference_note, high) == [(0, "no_note", "info", []), (1, "out_of_band", "alert", list(range(10)))]
    later = notes.union(notes.select("plan", "note", F.lit("2024-06-01").cast("date"), "band", F.col("vcm") * 2, F.col("low") * 2, F.col("high") * 2))
    got = rules.note_at_the_time(high, later, ["plan", "material_date"], "plan").collect()
    assert sorted((r["plan"], r["rule"], r["note_date"]) for r in got) == [("q", "no_note", None)]  # the later note explains the prices


@pytest.mark.parametrize("name", ["recompute_review", "planted_faults", "headings"])
def test_cells_and_titles_are_not_broadcast(spark, name):
    """Spark sizes them by the small columns they are made from, so at 60 times sf0.1 it would broadcast millions of them."""
    import __spark_entry__

    plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_columns_stay_where_they_meet_their_notes(spark):
    """Columns and notes are shuffled once each, and what they give together is not."""
    notes = spark.createDataFrame([], "plan string, note int, note_date date, band int, vcm double, low double, high double")
    cols = spark.createDataFrame([], "plan string, material_date date, band int, price double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.optimizer.excludedRules", "org.apache.spark.sql.catalyst.optimizer.PropagateEmptyRelation,org.apache.spark.sql.catalyst.optimizer.ConvertToLocalRelation")
        made = rules.reference_note(cols, notes, ["plan", "material_date"], "plan")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.optimizer.excludedRules")
    assert made.count("Exchange hashpartitioning") <= 7  # three of them for columns without notes


def test_fold_looks_up_different_characters_only(spark):
    """Long texts cost what reading them does, and every character folds as Unicode's decomposition says."""
    odd = [*text._FROM, *text._SEVERAL]
    rows = spark.createDataFrame([(c, "x" + c + "Y" + c) for c in odd] + [("", "PLAIN, text"), ("", "\u6f22 \U0001f600")], "c string, t string")
    to = dict.fromkeys(text._FROM, "") | dict(zip(text._FROM, text._TO)) | text._SEVERAL
    for c, t, folded in rows.select("c", "t", text.fold(F.col("t"))).collect():
        assert folded == "".join(to.get(x, x) for x in t.lower())
    long = spark.range(40).select(F.repeat(F.concat(F.lit("Preço da opção "), "id"), 20_000).alias("t")).cache()
    long.count()
    began = time.perf_counter()
    assert long.agg(F.sum(F.length(text.fold(F.col("t"))))).first()[0] > 12_000_000
    assert time.perf_counter() - began < 6


@pytest.mark.parametrize("cover,limit", [("Doença preexistente", 730), ("Parto", 300), ("Cirurgia", 180), ("Urgência e parto", 300), ("emergencia", 1), ("CPT", 730), ("Consultas", 180)])
def test_waiting_limit(spark, cover, limit):
    assert one(spark, rules.waiting_limit(F.lit(cover))) == limit


def brute_greedy(edges, key):
    a, b, out = set(), set(), []
    for e in sorted(edges, key=key):
        if e[0] not in a and e[1] not in b:
            a.add(e[0])
            b.add(e[1])
            out.append(e)
    return sorted(out)


def test_greedy_matches_the_sorted_scan(spark):
    rng = random.Random(3)
    rows = [(g, i, j, rng.randrange(4)) for g in range(12) for i in range(rng.randrange(1, 8)) for j in range(rng.randrange(1, 8)) if rng.random() < 0.6]
    df = spark.createDataFrame(rows, "g int, i int, j int, w int")
    up = matching.greedy(df, ["g"], "i", "j", [F.desc("w"), F.abs(F.col("i") - F.col("j")), F.col("i"), F.col("j")])
    down = matching.greedy(df, ["g"], "i", "j", [F.desc("w"), F.desc("i"), F.desc("j")])
    for got, key in ((up, lambda e: (-e[2], abs(e[0] - e[1]), e[0], e[1])), (down, lambda e: (-e[2], -e[0], -e[1]))):
        have = sorted(tuple(r) for r in got.select("g", "i", "j", "w").collect())
        assert have == sorted((g, *e) for g in range(12) for e in brute_greedy([r[1:] for r in rows if r[0] == g], key))


def test_conditions_match_as_the_sorted_scan_does_without_listing_pairs(spark, monkeypatch):
    """Rows of few conditions, with long chains of equal distances; what is written grows with the rows, not with their pairs."""
    rng = random.Random(11)
    kinds = [["vidas: 1"], ["vidas: 1", "adesão: livre"], ["coparticipação: com"], ["coparticipação: parcial", "vidas: 2 a 29"], [], ["região: capital"]]
    rows = [(g, side, n, kinds[n % 5 if g == 0 else rng.randrange(6)]) for g in range(4) for side in (0, 1) for n in range(rng.randrange(20, 45))]
    rows += [(9, side, n, ["grupo: 1" if n % 2 == side else f"grupo: {2 + side}"]) for side in (0, 1) for n in range(70)]
    df = spark.createDataFrame(rows, "g int, side int, n int, tags array<string>")
    seen, write = [], matching.written
    monkeypatch.setattr(matching, "written", lambda rows_, name: seen.append(write(rows_, name)) or seen[-1])
    got = matching.match_conditions(df.where("side = 0"), df.where("side = 1"), ["g"], ["n"]).collect()
    assert sum(x.count() for x in seen) < 20 * len(rows) and len(seen) < 40
    values = lambda t: {d: {x for x in t if x.startswith(d)} | ({"coparticipação: parcial", "coparticipação: total"} if d == "coparticipação" and "coparticipação: com" in t else set()) for d in {x.split(": ")[0] for x in t}}
    fits = lambda a, b: all(values(a)[d] & values(b)[d] for d in values(a).keys() & values(b).keys())
    for g in {r[0] for r in rows}:
        old, new = ([(n, t) for g_, s, n, t in rows if (g_, s) == (g, side)] for side in (0, 1))
        edges = [(i, j, len(set(a[1]) & set(b[1]))) for i, a in enumerate(old) for j, b in enumerate(new) if fits(a[1], b[1])]
        want = [(old[i][0], new[j][0]) for i, j, _ in brute_greedy(edges, lambda e: (-e[2], abs(e[0] - e[1]), e[0], e[1]))]
        assert sorted((r["old"]["n"], r["new"]["n"]) for r in got if r["g"] == g and r["old"] and r["new"]) == sorted(want)
        assert sum(r["g"] == g for r in got) == len(old) + len(new) - len(want)


def test_permuted_conditions_pair_with_themselves(spark):
    kinds = [["vidas: 1"], ["vidas: 2 a 29"], ["vidas: 30 ou mais", "adesão: livre"], ["coparticipação: com"]]
    old = spark.createDataFrame([("p", i, k) for i, k in enumerate(kinds[:3])], "product string, n int, tags array<string>")
    new = spark.createDataFrame([("p", i, k) for i, k in enumerate([kinds[2], kinds[0], kinds[1]])], "product string, n int, tags array<string>")
    got = matching.match_conditions(old, new, ["product"], ["n"]).collect()
    assert len(got) == 3 and all(r["old"]["tags"] == r["new"]["tags"] for r in got)


def test_readings_pair_by_equal_prices(spark):
    base = [float(10 * i + 5) for i in range(10)]
    a = spark.createDataFrame([("d", 0, 1, base), ("d", 1, 1, [x + 1 for x in base])], "doc string, place int, page int, prices array<double>")
    b = spark.createDataFrame([("d", 0, 2, [x + 1 for x in base]), ("d", 1, 1, base[:3] + [0.0] * 7), ("d", 2, 5, base)], "doc string, place int, page int, prices array<double>")
    assert sorted((r["i"], r["j"], r["equal"]) for r in matching.match_readings(a, b, ["doc"]).collect()) == [(0, 1, 3), (1, 0, 10)]


def test_readings_pair_like_a_walk_and_meet_once(spark, monkeypatch):
    """Against all pairs; the edges are made once, not anew in each round, and no more of them than match the rules."""
    rng, rows = random.Random(11), []
    for place in range(60):
        prices = [rng.choice([None, 10, 20, 30]) for _ in range(10)]
        rows += [(d, side, place, (place + 2 * side) // 6, [p if rng.random() > share else rng.choice([None, 10, 40]) for p in prices]) for d in ("x", "y") for side, share in ((0, 0.0), (1, 0.15))]
    df = spark.createDataFrame(rows, "doc string, side int, place int, page int, prices array<bigint>")
    seen, write = [], matching.written
    monkeypatch.setattr(matching, "written", lambda rows_, name: seen.append((name, write(rows_, name))) or seen[-1][1])
    got = matching.match_readings(df.where("side = 0"), df.where("side = 1"), ["doc"]).collect()
    wanted = 0
    for d in ("x", "y"):
        a, b = ([(place, page, p) for d_, s, place, page, p in rows if (d_, s) == (d, side)] for side in (0, 1))
        edges = [(i, j, sum(u is not None and u == v for u, v in zip(p, q)), abs(m - n)) for i, m, p in a for j, n, q in b]
        edges = [e for e in edges if e[3] <= 1 and e[2] >= (8 if e[3] else 3)]
        wanted += len(edges)
        assert {e[3] for e in edges} == {0, 1}
        want = [e[:3] for e in brute_greedy(edges, lambda e: (-e[2], e[3], -e[0], -e[1]))]
        assert sorted((r["i"], r["j"], r["equal"]) for r in got if r["doc"] == d) == sorted(want)
    assert seen[0][0] == "edges" and seen[0][1].count() == wanted


def test_places_of_large_groups(spark):
    rows = [(g, n, f"{n % 7}") for g, size in (("a", 500), ("b", 1), (None, 40)) for n in range(size)]
    df = spark.createDataFrame(rows, "g string, n int, s string").repartition(6)
    got = matching.placed(df, ["g"], ["s", "n"])
    for g in ("a", "b", None):
        assert sorted((r["place"], r["s"], r["n"]) for r in got.collect() if r["g"] == g) == [(i, s, n) for i, (s, n) in enumerate(sorted((s, n) for h, n, s in rows if h == g))]
    assert got.schema["place"].dataType.simpleString() == "int" and matching.placed(df.limit(0), ["g"], ["n"]).count() == 0


def test_chains_do_not_depend_on_arrival(spark):
    rows = [("k", date(2024, m, 1), [float(p)]) for m, p in ((1, 10), (2, 10), (3, 12), (4, 15))]
    want = None
    for order in itertools.permutations(rows):
        df = spark.createDataFrame(list(order), "k string, dated date, prices array<double>")
        got = sorted((r["dated"], r["version"], r["confirmed"], r["is_current"]) for r in versions.chains(df, ["k"], "dated").collect())
        want = want or got
        assert got == want
    assert [g[1] for g in want] == [1, 2, 3] and want[0][2] == date(2024, 2, 1) and [g[3] for g in want] == [False, False, True]


def test_publish_actions(spark):
    schema = "series string, product string, version int, place int, tags array<string>, prices array<double>, is_current boolean, is_head boolean"
    old = spark.createDataFrame([("s", "p", 3, 0, ["vidas: 1"], [1.0], True, True), ("s", "q", 1, 1, [], [2.0], True, True), ("s", "r", 4, 2, [], [5.0], False, True), ("s", "t", 1, 3, ["vidas: 1"], [1.0], True, True)], schema)
    new = spark.createDataFrame([("s", "p", 0, ["vidas: 1"], [1.0], True), ("s", "r", 1, [], [6.0], True), ("s", "n", 2, [], [7.0], True), ("s", "t", 3, ["vidas: 2 a 29"], [1.0], False), ("s", "", 4, [], [1.0], True)], "series string, product string, place int, tags array<string>, prices array<double>, publishable boolean")
    got = sorted((r["product"], r["action"], r["version"], r["reason"]) for r in publish.publish(old, new).collect())
    assert got == [("n", "first", 1, None), ("p", "confirmed", 3, None), ("q", "retired", 1, "product_removed"), ("r", "version", 5, None), ("t", "blocked", 0, None), ("t", "retired", 1, "condition_changed")]


def test_places_in_history(spark):
    schema = "k string, doc int, dated date, prices array<double>"
    chain = spark.createDataFrame([("k", 1, date(2024, 1, 1), [1.0], False), ("k", 3, date(2024, 3, 1), [3.0], True)], schema + ", is_current boolean")
    older = spark.createDataFrame([("k", 2, date(2024, 2, 1), [2.0]), ("k", 4, date(2024, 2, 5), [3.0]), ("k", 3, date(2024, 3, 1), [3.0]), ("k", 5, date(2024, 4, 1), [9.0]), ("new", 6, date(2024, 1, 1), [1.0])], schema)
    assert sorted((r["doc"], r["action"]) for r in publish.place_in_history(chain, older, ["k"]).collect()) == [(2, "inserted"), (3, "there"), (4, "equal"), (5, "deferred"), (6, "inserted")]


def words_of_grid(dx=0.0, scale=1.0, columns=3, jitter=0.0):
    rows = []
    for b, label in enumerate(["00 a 18", "19 a 23", "24 a 28", "29 a 33", "34 a 38", "39 a 43", "44 a 48", "49 a 53", "54 a 58", "59 ou mais"]):
        y = 100 + 20 * b
        for i, w in enumerate(label.split()):
            rows.append((1, 1, w, (50 + 12 * i) * scale + dx, (60 + 12 * i) * scale + dx, y * scale, (y + 10) * scale))
        for c in range(columns):
            price = f"{100 * (c + 1) + 10 * b},{b}0"
            rows.append((1, 1, price, (200 + 80 * c) * scale + dx, (240 + 80 * c) * scale + dx, (y + jitter * c) * scale, (y + 10 + jitter * c) * scale))
    return rows


WORDS = "doc int, page int, text string, x0 double, x1 double, top double, base double"


def test_grids_survive_shuffling_moving_and_scaling(spark):
    def read(rows):
        return sorted((r["table"], r["column"], r["band"], r["price"]) for r in layout.grids(spark.createDataFrame(rows, WORDS)).collect())

    want = [(0, c, b, 100 * (c + 1) + 10 * b + b / 10) for c in range(3) for b in range(10)]
    shuffled = words_of_grid()
    random.Random(1).shuffle(shuffled)
    assert read(words_of_grid()) == want and read(shuffled) == want and read(words_of_grid(dx=33)) == want and read(words_of_grid(scale=1.4)) == want and read(words_of_grid(jitter=0.8)) == want


def test_overlapping_boxes(spark):
    boxes = spark.createDataFrame([(1, 1, 0, 0.0, 10.0, 0.0, 10.0), (1, 1, 1, 2.0, 12.0, 0.0, 10.0), (1, 1, 2, 200.0, 210.0, 0.0, 10.0), (1, 1, 3, 45.0, 55.0, 45.0, 55.0), (1, 1, 4, 46.0, 56.0, 46.0, 56.0)], "doc int, page int, id int, x0 double, x1 double, top double, base double")
    assert sorted((r["a"], r["b"]) for r in layout.overlapping(boxes).collect()) == [(0, 1), (3, 4)]


def test_plausible_notes(spark):
    m = spark.createDataFrame([("p", date(2024, 6, 1)), ("q", date(2010, 1, 1)), ("z", date(2024, 1, 1))], "plan string, at date")
    n = spark.createDataFrame([("p", date(2023, 6, 2)), ("p", date(2023, 5, 31)), ("p", date(2024, 11, 28)), ("p", date(2024, 11, 29)), ("q", date(2012, 1, 1))], "plan string, noted date")
    got = sorted((r["plan"], r["note_date"]) for r in lookup.plausible(m, n, "plan", "at", "noted").where("note_date is not null").collect())
    assert got == [("p", date(2023, 6, 2)), ("p", date(2024, 11, 28)), ("q", date(2012, 1, 1))]


def test_quote_counts_people_and_refuses_gaps(spark):
    offers = spark.createDataFrame([("a", 0, 100), ("a", 4, 300), ("b", 4, 100)], "offer string, band int, cents bigint")
    ages = spark.createDataFrame([(1, 38), (1, 36), (1, 9), (2, 200)], "request int, age int")
    assert [tuple(r) for r in quote.quote(offers, ages, ["offer"]).collect()] == [(1, "a", 700)]
    desk = Planwatch(spark, {"prices": offers})
    assert [tuple(r) for r in desk.quote([36]).collect()] == [("b", 100), ("a", 300)]
    with pytest.raises(ValueError):
        desk.quote([])


def test_registers_and_zips(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿id;name\n12;Ative\n1234567;Long\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("id;name\n000012;Gone\n", encoding="utf-8")
    a, c = (files.register(spark, str(tmp_path / f"{k}.csv"), "id string, name string") for k in "ac")
    got = sorted((r["id"], r["name"], r["active"]) for r in files.both_registers(a, c, "id").collect())
    assert got == [("000012", "Gone", False), ("1234567", "Long", True)]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("b.csv", "id;v\n1;2,5\n")
        z.writestr("a.csv", "id;v\r\n3;x\r\n")
        z.writestr("readme.txt", "no")
    lines = files.zipped_lines(spark, [str(tmp_path / "z.zip")])
    rows = files.parsed(lines, "id int, v string").collect()
    assert sorted((r["member"], r["id"], r["v"]) for r in rows) == [("a.csv", 3, "x"), ("b.csv", 1, "2,5")]
    assert [r["line"] for r in files.of_interest(lines, 1, spark.createDataFrame([(3,)], "id int")).collect()] == ["3;x"]
    assert files.zipped_lines(spark, []).count() == 0


def test_configurations_merge_by_depth(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "one.json").write_text('{"name": "s", "url": "", "kind": "page", "reliability": 9}')
    (tmp_path / "x" / "two.json").write_text('{"name": "s", "url": "http://u", "kind": "mail",\n "reliability": 3}')
    c = files.configurations(spark, str(tmp_path), "name string, url string, kind string, reliability int")
    assert [tuple(r) for r in files.merged(c, "name", ["url", "kind"]).collect()] == [("s", "http://u", "page")]
    assert sorted(r["problem"] for r in files.violations(c, ["page", "mail"]).collect()) == ["no url", "reliability"]


def test_api_items_and_mail(spark):
    body = '{"data": {"items": [{"url": "a", "title": "x"}, {"url": ["b", "c"], "title": "y"}, {"title": "z"}]}}'
    items = files.api_items(spark.createDataFrame([(body,)], "body string"), "$.data.items")
    assert sorted(tuple(r) for r in items.collect()) == [("a", "x"), ("b", "y"), ("c", "y")]
    ours, forged = "mx.our.net; dkim=pass header.d={0}", "mx.evil.net; dkim=pass header.d={0}"
    mails = [
        ("A <a@x.com>", [ours.format("x.com")]), ("b@mail.x.com", ["MX.our.net 1;\r\n dmarc=PASS (p=none) header.from=mail.x.com"]), ("c@evilx.com", [ours.format("evilx.com")]), ("d@x.com", ["mx.our.net; dkim=fail header.d=x.com"]),
        ("e@x.com", [forged.format("x.com")]), ("f@x.com", [ours.format("other.com")]), ("g@x.com", ["mx.our.net.evil.com; dkim=pass header.d=x.com"]), ("h@x.com", [ours.format("x.com.evil.org")]), ("i@y.org", [forged.format("y.org"), ours.format("y.org")]), ("j@x.com", None),
    ]
    mails = spark.createDataFrame(mails, "sender string, headers array<string>")
    assert sorted(r["sender"] for r in files.mail_from_trusted(mails, ["@x.com", "i@y.org"], "mx.our.net").collect()) == ["A <a@x.com>", "b@mail.x.com", "i@y.org"]


def test_links_and_robots(spark):
    base = F.lit("https://h.com/a/b.html?q=1")
    for href, want in (("c.pdf", "https://h.com/a/c.pdf"), ("/d e.pdf#x", "https://h.com/d%20e.pdf"), ("//o.com/x", "https://o.com/x"), ("http://y/?a=1&b=2", "http://y/?a=1&b=2"), ("../up/./c.pdf?x=../", "https://h.com/up/c.pdf?x=../"), ("?p=2", "https://h.com/a/b.html?p=2"), ("é.pdf", "https://h.com/a/%C3%A9.pdf")):
        assert one(spark, links.absolute(F.lit(href), base)) == want
    page = """<A HREF='x.pdf' title="T &amp; U">x</A><button data-url=y.pdf disabled>y</button><a href="#top">t</a><a href="javascript:z()">z</a><area
      href = "q.pdf?a=1&amp;b=2"/><img src="n.png"><option value="o.pdf">"""
    found = links.tags_with_links(spark.createDataFrame([(1, page)], "k int, html string"), "k", "html", ("href", "data-url"), "title").collect()
    assert [(r["href"], r["title"], r["disabled"]) for r in sorted(found, key=lambda r: r["place"])] == [("x.pdf", "T & U", False), ("y.pdf", None, True), ("q.pdf?a=1&b=2", None, False)]
    body = "User-agent: *\n\nDisallow: /a\nAllow: /a\nDisallow: /*.pdf$\nDisallow:\nUser-agent: bot\nDisallow: /\n"
    rules_ = links.robots_rules(spark.createDataFrame([("h", body)], "host string, body string"), "Planwatch/2")
    paths = spark.createDataFrame([("h", "/a/x"), ("h", "/b.pdf"), ("h", "/b.pdf?x"), ("h", "/c"), ("other", "/b.pdf")], "host string, path string")
    assert {(r["host"], r["path"]): r["allowed"] for r in links.allowed(paths, rules_, "path").collect()} == {("h", "/a/x"): True, ("h", "/b.pdf"): False, ("h", "/b.pdf?x"): True, ("h", "/c"): True, ("other", "/b.pdf"): True}
    assert [r["allowed"] for r in links.allowed(paths.limit(1), links.robots_rules(spark.createDataFrame([("h", body)], "host string, body string"), "Bot/1"), "path").collect()] == [False]
    index = '[["urlkey","timestamp","original","digest"],["k","2","http://x/a","D"],["k","1","http://y/a","D"]]'
    copies = links.archive_rows(spark.createDataFrame([("s", index), ("t", "[]")], "s string, body string"), "s", "body")
    assert [tuple(r) for r in links.earliest_copies(copies, "digest", "at", "address").collect()] == [("D", "http://y/a", "1")]


def test_fetch_outcomes_and_offsets(spark):
    state = spark.createDataFrame([("u1", "s1"), ("u2", "s2")], "url string, sha string")
    got = feeds.outcomes(spark.createDataFrame([("u1", 200, "s1"), ("u2", 304, None), ("u3", 200, "s2"), ("u4", 200, "s9"), ("u5", 403, None), ("u6", 500, None)], "url string, status int, sha string"), state)
    assert {r["url"]: r["outcome"] for r in got.collect()} == {"u1": "unchanged", "u2": "unchanged", "u3": "known", "u4": "new", "u5": "blocked", "u6": "error"}
    assert feeds.next_offset((7, 10), 7, [9, 11, 12, 13], 2) == ((7, 12), [11, 12]) and feeds.next_offset((7, 10), 8, [1], 5) == ((8, 1), [1]) and feeds.next_offset(None, 1, [], 5) == ((1, 0), [])


def test_series_are_resolved_in_order(spark):
    from planwatch.operators import collecting

    items = spark.createDataFrame([("a", "k1"), ("b", "k1"), ("a", "k2"), ("a", "k3"), ("a", None)], "source string, key string")
    seen = spark.createDataFrame([("a", "k1", "late", 2), ("a", "k1", "early", 1)], "source string, key string, series string, at int")
    docs = spark.createDataFrame([("k1", "doc", 5), ("k2", "doc2", 7), ("k2", "doc1", 3)], "key string, series string, at int")
    got = collecting.resolved_series(items, seen, docs, F.lit("stem")).select("source", "key", "series").collect()
    assert {(r[0], r[1]): r[2] for r in got} == {("a", "k1"): "early", ("b", "k1"): "doc", ("a", "k2"): "doc1", ("a", "k3"): "stem", ("a", None): "stem"}


def test_a_new_row_replaces_the_old_one_even_with_nulls(spark):
    from planwatch.operators import collecting

    old = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    new = spark.createDataFrame([(2, None), (3, "z")], "k int, v string")
    assert sorted(map(tuple, collecting.loaded(old, new, ["k"]).collect())) == [(1, "x", False), (2, None, True), (3, "z", True)]
    assert collecting.loaded(old.limit(0), new.limit(0), ["k"]).count() == 0


def test_last_results_pass_over_empty_runs(spark):
    from planwatch.operators import collecting

    runs = spark.createDataFrame([("c", 1, 4), ("c", 2, 0), ("c", 3, 2), ("d", 1, 0)], "capture string, at int, found int")
    got = {(r["capture"], r["at"]): r["before"] for r in collecting.last_results(runs, ["capture"], "at", "found").collect()}
    assert got == {("c", 1): None, ("c", 2): 4, ("c", 3): 4, ("d", 1): None}


def test_pdf_faults(spark):
    df = spark.createDataFrame([(b"%PDF-1.7 x %%EOF\n",), (b"<html>",), (b"%PDF-1.7 " + b"x" * 5000,), (b"%PDF" + b"x" * 5000 + b"%%EOF",), (b"",)], "c binary").select(feeds.pdf_fault(F.col("c"), F.lit("text/html")).alias("f"))
    assert [r["f"] for r in df.collect()] == [None, "not a PDF (text/html)", "ends without %%EOF after 5009 bytes", None, "not a PDF (text/html)"]


def test_offsets_are_kept_only_after_whole_runs():
    assert feeds.kept_offset("a", "b", "ok", False) == "b" and feeds.kept_offset("a", "b", "ok", True) == "a" and feeds.kept_offset(None, "b", "error", False) is None


def test_as_of_without_a_date(spark):
    m = spark.createDataFrame([("p", None), ("p", date(2020, 1, 1)), ("q", None)], "plan string, at date")
    n = spark.createDataFrame([("p", date(2021, 1, 1)), ("p", date(2023, 1, 1))], "plan string, noted date")
    assert sorted((r["plan"], str(r["at"]), r["note_date"]) for r in lookup.as_of(m, n, "plan", "at", "noted").collect() if r["plan"] == "p") == [("p", "2020-01-01", date(2021, 1, 1)), ("p", "None", date(2023, 1, 1))]


def test_other_sources_take_the_nearest_compatible_row(spark):
    schema = "product string, source int, place int, tags array<string>, price int"
    rows = spark.createDataFrame([("p", 1, 0, ["vidas: 1"], 10), ("p", 2, 0, ["vidas: 2 a 29"], 20), ("p", 2, 3, ["vidas: 1"], 30), ("p", 2, 1, [], 40), ("p", 3, 5, [], 50)], schema)
    got = {(r["own"]["price"], r["peer"]["price"]) for r in lookup.other_sources(rows, "product", ["source"], "place").collect()}
    assert got == {(10, 30), (10, 50), (20, 50), (30, 10), (30, 50), (40, 10), (40, 50), (50, 10), (50, 30)}


def test_versions_differ_by_condition_and_shared_bands(spark):
    schema = "product string, place int, tags array<string>, prices array<double>"
    old = spark.createDataFrame([("p", 0, ["vidas: 1"], [10.0, 20.0, None]), ("p", 1, ["vidas: 2 a 29"], [5.0, 6.0, 7.0])], schema)
    new = spark.createDataFrame([("p", 0, ["vidas: 2 a 29"], [5.0, 6.0, 7.0]), ("p", 1, ["vidas: 1"], [11.0, 20.0, 30.0]), ("p", 2, ["vidas: 30 ou mais"], [1.0])], schema)
    got = sorted((r["old_place"], r["new_place"], r["change"], r["n_changed"], r["variation"] and round(r["variation"], 6)) for r in versions.diff(old, new, ["product"], ["place"]).collect() if r["old_place"] is not None)
    assert got == [(0, 1, "changed", 1, 0.1), (1, 0, "equal", 0, None)]




def test_history_is_renumbered(spark):
    schema = "k string, doc int, dated date, prices array<double>"
    chain = spark.createDataFrame([("k", 1, date(2024, 1, 1), [1.0], False), ("k", 3, date(2024, 3, 1), [3.0], True)], schema + ", is_current boolean")
    older = spark.createDataFrame([("k", 2, date(2024, 2, 1), [2.0]), ("k", 4, date(2024, 2, 5), [3.0])], schema)
    got = sorted((r["version"], r["doc"], r["next_doc"], r["is_current"]) for r in publish.inserted_history(chain, older, ["k"]).collect())
    assert got == [(1, 1, 2, False), (2, 2, 3, False), (3, 3, None, True)]
    docs = spark.createDataFrame([(1, "rule", False), (1, "rule", True), (2, "rule", False), (1, "other", False)], "doc int, type string, resolved boolean")
    assert sorted(map(tuple, publish.resolved_by_history(docs, docs.where("doc = 1"), ["rule"]).collect())) == [(1, "other", False), (1, "rule", True), (2, "rule", False)]
    replay = spark.createDataFrame([("k", date(2024, 2, 1), 1, [2.0]), ("k", date(2024, 1, 1), 2, [1.0])], "k string, dated date, arrived int, prices array<double>")
    assert sorted((r["version"], r["late"]) for r in publish.replayed(replay, ["k"], "dated").collect()) == [(1, True), (2, False)]


def test_documents_are_saved_anew(spark, tmp_path):
    folder, ev = str(tmp_path / "saved"), "doc int, title string, resolved boolean"
    column, cell = spark.createDataFrame([(1, "a"), (2, "b")], "doc int, column string"), spark.createDataFrame([(1, 5), (2, 6)], "doc int, v int")
    files.save_documents(spark.createDataFrame([(1, "x", False), (1, "y", True), (2, "z", False)], ev), column, cell, folder)
    files.save_documents(spark.createDataFrame([(1, "new", False)], ev), column.where("doc = 1"), cell.where("doc = 1").withColumn("v", F.lit(7)), folder)
    assert sorted((r["doc"], r["title"]) for r in files.saved_events(spark, folder, ev).collect()) == [(1, "new"), (1, "y"), (2, "z")]
    assert sorted((r["doc"], r["v"]) for r in spark.read.parquet(f"{folder}/cells").collect()) == [(1, 7), (2, 6)]
    files.save_documents(spark.createDataFrame([], ev), column.where("doc = 2"), cell.where("doc = 2"), folder)
    assert sorted((r["doc"], r["title"]) for r in files.saved_events(spark, folder, ev).collect()) == [(1, "new"), (1, "y")]


def test_tables_are_swapped_and_exported(spark, tmp_path):
    path = str(tmp_path / "t")
    files.replace_table(spark.range(3), path)
    files.replace_table(spark.read.parquet(path).where("id > 0"), path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 2] and [p.name for p in tmp_path.iterdir()] == ["t"]
    offers, peers = spark.createDataFrame([("a", 1), ("b", 2)], "offer string, total int"), spark.createDataFrame([("a", "b"), ("a", "b")], "offer string, peer string")
    files.export_snapshot(offers, peers, "offer", str(tmp_path / "json"))
    assert {r["offer"]: r["peers"] for r in spark.read.json(str(tmp_path / "json")).collect()} == {"a": ["b"], "b": None}
    files.write_recordings(spark.createDataFrame([("0123456789abcdef", "m", "{}")], "sha string, model string, body string"), str(tmp_path / "rec"))
    (tmp_path / "read").mkdir()
    (tmp_path / "read" / "0123456789abcdef_model-1.json").write_text('{"pages": 3}')
    assert [(r["pages"], r["folder"], r["sha"], r["model"]) for r in files.recordings(spark, str(tmp_path / "read"), "pages int").collect()] == [(3, "read", "0123456789abcdef", "model-1")]
    (tmp_path / "m.json").write_text('[{"id": 35, "nome": "São Paulo", "uf": 1},\n {"id": 33, "nome": "Rio"}]')
    assert sorted(map(tuple, files.municipalities(spark, str(tmp_path / "m.json")).collect())) == [(33, "Rio"), (35, "São Paulo")]
    maps = spark.createDataFrame([("a/1.json", "r", "x", "u"), ("b/2.json", "r", "y", "v")], "path string, registration string, channel string, report string")
    assert [tuple(r) for r in files.operator_mapping(maps).collect()] == [("r", "y", "v")]
    cols, cells = spark.createDataFrame([(1, "c", 2)], "doc int, column string, page int"), spark.createDataFrame([(1, "c", 0, 5.0)], "doc int, column string, band int, price double")
    files.write_reports(cols, cells, spark.createDataFrame([], "doc int, column string, rule string"), str(tmp_path / "reports"))
    assert spark.read.json(str(tmp_path / "reports")).first()["columns"][0]["cells"][0]["price"] == 5.0


def test_configurations_are_checked_before_loading(spark):
    rows = [("a", "u", "page", 3, "x(", 0, "p1", [("page", "", "u1"), ("mail", "m", "u2")]), ("a", "u", "page", 3, "ok", 1, "p2", [("page", None, "u3")])]
    c = spark.createDataFrame(rows, "name string, url string, kind string, reliability int, include string, depth int, path string, captures array<struct<type:string,name:string,url:string>>")
    assert [r["problem"] for r in files.violations(c, ["page"], ("include",)).collect()] == ["include is no pattern"]
    with pytest.raises(ValueError, match="include is no pattern"):
        files.checked(c, ["page"], ("include",))
    assert files.checked(c.where("depth = 1"), ["page"], ("include",)).count() == 1
    assert sorted(r["capture"]["url"] for r in files.united_captures(c, "name").collect()) == ["u1", "u2"]
    assert sorted(r["url"] for r in links.fixed_addresses(spark.createDataFrame([("s", ["b", "a", "b"])], "s string, urls array<string>"), "s", "urls").collect()) == ["a", "b"]


def test_leftover_readings_and_recomputed_review(spark):
    rows = spark.createDataFrame([("d", 0, "A", [1.0]), ("d", 1, "A", [1.0]), ("d", 2, "B", [2.0]), ("d", 3, "B", [2.0])], "doc string, place int, label string, prices array<double>")
    taken = spark.createDataFrame([("d", 0)], "doc string, j int")
    assert sorted((r["place"], r["repeated"]) for r in matching.leftovers(rows, taken, ["doc"], ["label", "prices"], ["place"]).collect()) == [(1, True), (2, False), (3, True)]
    applied = spark.createDataFrame([(1, 0, "divergent", "confirmed_calc", 5.0, 5.0), (1, 1, "confirmed", None, 6.0, None), (1, 2, "only_a", "alert", 7.0, None), (1, 3, None, "suggestion", 8.0, None)], "c int, band int, status string, outcome string, value double, chosen double")
    none = spark.createDataFrame([], "c int, severity string, bands array<int>")
    assert {r["band"]: (r["status"], r["review"]) for r in reconcile.reviewed_anew(applied, none, ["c"]).collect()} == {0: ("confirmed_calc", False), 1: ("confirmed", False), 2: ("only_a", True)}
    assert [(s["band"], s["value"]) for s in reconcile.suggestions(applied, ["c"]).first()["suggested"]] == [(3, 8.0)]


def test_facade_lists_in_order(spark):
    from planwatch.facade import label

    desk = Planwatch(spark, {
        "networks": spark.createDataFrame([("p", "RJ", 2), ("p", "SP", 5), ("q", "MG", 9)], "plan string, region string, hospitals int"), "columns": spark.createDataFrame([("d", 2, "t", "b"), ("d", 1, "t", "z"), ("d", 1, "t", "a")], "doc string, page int, table string, label string"),
        "events": spark.createDataFrame([(1, 1, "k"), (2, 3, "k"), (3, 3, "j")], "id int, at int, type string"), "sources": spark.createDataFrame([("b", 5), ("a", 5), ("c", 1)], "name string, reliability int"), "operators": spark.createDataFrame([("Vida", None, False), ("Boa Vida", None, True), ("Nada", "x", True)], "name string, trade_name string, active boolean"),
    })
    assert [r["region"] for r in desk.regions("p").collect()] == ["SP", "RJ"] and [r["label"] for r in desk.columns("d").collect()] == ["a", "z", "b"]
    assert [r["id"] for r in desk.events().collect()] == [3, 2, 1] and [r["id"] for r in desk.events("k", 1).collect()] == [2] and [r["name"] for r in desk.sources().collect()] == ["a", "b", "c"]
    assert [r["name"] for r in desk.operators("vida").collect()] == ["Boa Vida", "Vida"] and [r["id"] for r in desk.listed("events").collect()] == [3, 2, 1]
    assert one(spark, label(F.lit("review"))) == "em revisão" and one(spark, label(F.lit("?"))) == "?"
    with pytest.raises(ValueError):
        desk.quote([30], region="SPX")


def test_words_drawn_over_others_and_tilted_pages(spark):
    box = "doc int, page int, id int, text string, drawn int, x0 double, x1 double, top double, base double"
    rows = [(1, 1, 0, "12", 0, 0.0, 10.0, 0.0, 10.0), (1, 1, 1, "13", 1, 1.0, 11.0, 0.0, 10.0), (1, 1, 2, "a", 2, 50.0, 60.0, 0.0, 10.0), (1, 1, 3, "a", 3, 50.5, 60.5, 0.0, 10.0)]
    assert sorted(r["id"] for r in layout.drawn_over(spark.createDataFrame(rows, box)).collect()) == [1, 2]
    words = spark.createDataFrame([(1, 1, "a", 95.0, 105.0, 95.0, 105.0)], "doc int, page int, text string, x0 double, x1 double, top double, base double")
    r = layout.upright(words, F.lit(45.0)).first()
    assert abs((r["top"] + r["base"]) / 2) < 1e-9 and abs((r["x0"] + r["x1"]) / 2 - 141.42135) < 1e-4
    lines = spark.createDataFrame([("d", 2, 0, "Vigência: 01/2024"), ("d", 1, 5, "válida de 02/03/2024 a 01/03/2025"), ("d", 4, 0, "vigente 01/2020"), ("e", 4, 0, "vigente 01/2020")], "doc string, page int, line int, text string")
    from planwatch.operators import collecting

    assert [tuple(r) for r in collecting.printed_validity(lines).collect()] == [("d", date(2024, 3, 2), date(2025, 3, 1))]


def test_tables_without_conditions_match_by_their_place(spark):
    schema = "series string, product string, version int, place int, tags array<string>, prices array<double>, is_current boolean, is_head boolean"
    old = spark.createDataFrame([("s", "p", 3, 0, [], [1.0], True, True), ("s", "p", 1, 1, [], [2.0], True, True)], schema)
    new = spark.createDataFrame([("s", "p", 0, [], [1.0], True), ("s", "p", 1, [], [2.0], True)], "series string, product string, place int, tags array<string>, prices array<double>, publishable boolean")
    assert sorted((r["action"], r["version"]) for r in publish.publish(old, new).collect()) == [("confirmed", 1), ("confirmed", 3)]


def test_equal_late_documents_enter_history_once(spark):
    schema = "k string, doc int, dated date, prices array<double>"
    chain = spark.createDataFrame([("k", 1, date(1996, 1, 1), [9.0], True)], schema + ", is_current boolean")
    for docs in ((7, 8), (8, 7)):  # the one that arrives first stays
        older = spark.createDataFrame([("k", docs[0], date(1993, 1, 1), [5.0]), ("k", docs[1], date(1994, 1, 1), [5.0])], schema)
        assert sorted((r["doc"], r["action"]) for r in publish.place_in_history(chain, older, ["k"]).collect()) == [(7, "inserted"), (8, "equal")]
        assert [r["doc"] for r in publish.inserted_history(chain, older, ["k"]).orderBy("version").collect()] == [7, 1]
    assert publish.place_in_history(chain, older.limit(0), ["k"]).collect() == [] and publish.inserted_history(chain, older.limit(0), ["k"]).count() == 1


def test_divergences_are_those_of_one_condition(spark):
    rows = [(1, "p", s, i, [f"vidas: {'1' if i == 0 else '2 a 29'}"], 100 * (i + 1) + s, date(2024, 1 + s, 1)) for s in (0, 1) for i in (0, 1)]
    quotes = spark.createDataFrame(rows, "request int, product string, source int, place int, tags array<string>, total bigint, dated date")
    assert sorted((r["source"], r["other"], r["difference"], r["other_newer"]) for r in quote.divergences(quotes, "product", "source").collect()) == [(0, 1, 1, True), (0, 1, 1, True), (1, 0, -1, False), (1, 0, -1, False)]
    some = quotes.where("place = 1 or source = 0")  # the other source's table of the condition lacks a band: none is taken in its stead
    assert quote.divergences(some, "product", "source", offers=quotes).count() == 2


@pytest.mark.parametrize("rule, path, ok", [("/", "", False), ("/", "?x=1", False), ("/a%20b/", "/a b/c", False), ("/é", "/%C3%A9/1", False), ("/x$", "/x%", True), ("/50%", "/50%/a", False), ("/a+b", "/a%2Bb", False), ("/q?a=%41", "/q?a=A", False), ("/(x)", "/x", True)])
def test_robots_compare_without_escapes(spark, rule, path, ok):
    rules_ = spark.createDataFrame([("h", "Disallow", rule)], "host string, kind string, pattern string")
    assert [r["allowed"] for r in links.allowed(spark.createDataFrame([("h", path)], "host string, path string"), rules_, "path").collect()] == [ok]


def test_notes_without_a_material_date_and_composite_prices(spark):
    notes = spark.createDataFrame([("p", 1, date(2015, 1, 1), b, 100.0 * f, 50.0 * f, 130.0 * f) for b, f in enumerate(FACTORS)], "plan string, note int, note_date date, band int, vcm double, low double, high double")
    prices = [(1, "p", None, b, 300.0 * f) for b, f in enumerate(FACTORS)]
    columns = spark.createDataFrame(prices, "c int, plan string, material_date date, band int, price double")
    for today, severity in (("2024-06-01", "info"), ("2015-06-01", "alert")):
        for f in (rules.reference_note, rules.note_at_the_time):
            assert [(r["rule"], r["severity"]) for r in f(columns, notes, ["c"], "plan", today=F.lit(today).cast("date")).collect()] == [("out_of_band", severity)]
    mixed = columns.withColumns({"material_date": F.lit("2015-03-01").cast("date"), "price": F.col("price") / 3 + 40})
    found = lambda composite: {r["rule"] for r in rules.note_at_the_time(mixed, notes, ["c"], "plan", composite).collect()}
    assert "off_pattern" in found(None) and "off_pattern" not in found(F.lit(True))


def test_quote_details_of_a_region(spark):
    """Two sources of one plan; each person's price in the order asked, the plan's network there, its changes, and the other source's total."""
    prices = [("1", s, c, b, p) for s, c, cents in ((1, "PME", (100, 200)), (2, "Adesão", (100, 260))) for b, p in zip((0, 4), cents)]
    day = datetime.date(2024, 1, 1)
    made = [("1", s, c, day, datetime.datetime(2024, 1, 1), None, s) for s, c in ((1, "PME"), (2, "Adesão"))]
    tables = {
        "prices": spark.createDataFrame(prices, "product string, source int, contract string, band int, cents bigint"),
        "made": spark.createDataFrame(made, "product string, source int, contract string, dated date, published timestamp, confirmed timestamp, readers int"),
        "networks": spark.createDataFrame([("1", "SP", 5, 2), ("1", "RJ", 3, 1)], "plan string, region string, hospitals bigint, urgent bigint"),
        "changes": spark.createDataFrame([("1", "p", "SP", day), ("1", "q", "RJ", day)], "product string, protocol string, region string, effective date"),
    }
    now = F.lit("2024-01-11").cast("timestamp")
    found = Planwatch(spark, tables).quote_details([36, 9, 38], region="sp", now=now).collect()
    assert [(r["source"], r["total"], [tuple(p) for p in r["per_person"]]) for r in found] == [(1, 500, [(36, 4, 200), (9, 0, 100), (38, 4, 200)]), (2, 620, [(36, 4, 260), (9, 0, 100), (38, 4, 260)])]
    assert [(r["days"], r["two_readers"], r["hospitals"], r["hospitals_in_region"], r["network_changes"], r["others"]) for r in found] == [(10, False, 8, 5, 1, 1), (10, True, 8, 5, 1, 1)]
    assert [r["network_changes"] for r in Planwatch(spark, tables).quote_details([9], "pme", now=now).collect()] == [0]  # both lie behind
    for ages, region in (([], ""), ([121], ""), ([30], "S1")):
        with pytest.raises(ValueError):
            Planwatch(spark, tables).quote_details(ages, region=region)


def test_dashboard_of_few_and_of_no_rows(spark):
    day = datetime.date(2024, 1, 31)
    tables = {
        "documents": spark.createDataFrame([("review", 10, 4, 1.5), ("review", None, None, None), ("published", 5, 0, 0.5)], "status string, with_product bigint, open_with_product bigint, cost double"),
        "cells": spark.createDataFrame([("1", "confirmed", False, False), ("1", "confirmed", False, True), ("1", "only_a", True, False), ("", "only_b", True, False), (None, "confirmed", None, None)], "product string, status string, review boolean, corrected boolean"),
        "versions": spark.createDataFrame([("a", day, True), ("a", datetime.date(2024, 1, 30), True), ("b", None, True), ("c", None, False)], "operator string, until date, is_current boolean"),
        "events": spark.createDataFrame([(i, i // 2, "t", "info" if i % 3 else "alert", i > 6) for i in range(20)], "id int, at int, type string, severity string, resolved boolean"),
    }
    r = Planwatch(spark, tables).dashboard(F.lit(day)).collect()[0]
    assert (r["documents"], r["by_status"], r["with_product"], r["automatic_with_product"], r["cost"]) == (3, {"published": 1, "review": 2}, 15, 11, 2.0)
    assert (r["prices"], r["confirmed"], r["automatic"], r["to_review"], r["without_product"]) == (5, 3, 2, 1, 2)
    assert (r["tables"], r["operators"], r["expired"], r["open_events"]) == (3, 2, 1, 3)
    assert [e["id"] for e in r["latest"]] == list(range(19, 7, -1))
    none = Planwatch(spark, {k: df.limit(0) for k, df in tables.items()}).dashboard(F.lit(day)).collect()[0]
    assert none["documents"] == none["prices"] == none["tables"] == none["open_events"] == none["cost"] == 0 and none["by_status"] == {} and none["latest"] == []


def test_stated_periods(spark):
    said = {
        "VÁLIDO DE 17/08/2026 A 30/09/2026": ("2026-08-17", "2026-09-30"), "VIGÊNCIA 01 DE JUNHO/26 A 31 DE DEZEMBRO/26": ("2026-06-01", "2026-12-31"), "de 1 de março/25 até 5 de abril/25 e 6 de maio/25": ("2025-03-01", "2025-04-05"),
        "17/08/2026": (None, None), "31 de dezembro/26": (None, None), "17/08/2026 e 01 de junho/26": (None, None), "01/02/2026 a 31/02/2026": ("2026-02-01", None), "": (None, None), None: (None, None), "1 de 2 de": (None, None),
    }
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string")
    got = rows.select("i", text.stated_period(F.col("s")).alias("p")).orderBy("i").collect()
    assert [tuple(d and d.isoformat() for d in r["p"]) for r in got] == list(said.values())


def test_pieces_of_amounts_join_in_chains(spark):
    word = lambda t, x0, x1, top=10.0: ("d", 1, t, x0, x1, top, top + 8)
    words = [word("1.065", 10.0, 30.0), word(",", 31.0, 33.0), word("14", 34.0, 40.0), word(",9", 42.4, 50.0), word("7", 53.0, 60.0), word("R$", 70.0, 80.0), word("12", 81.0, 90.0), word(",5", 80.0, 90.0, 14.0), word(",6", 300.0, 310.0)]
    schema = "doc string, page int, text string, x0 double, x1 double, top double, base double"
    got = layout.whole_amounts(spark.createDataFrame(words, schema)).collect()
    assert sorted((r["text"], r["x0"], r["x1"]) for r in got) == [(",5", 80.0, 90.0), (",6", 300.0, 310.0), ("1.065,14,9", 10.0, 50.0), ("12", 81.0, 90.0), ("7", 53.0, 60.0), ("R$", 70.0, 80.0)]
    assert layout.whole_amounts(spark.createDataFrame([], schema)).count() == 0


def test_pieces_are_dealt_by_their_number(spark, monkeypatch):
    from __spark_entry__ import queries

    monkeypatch.setattr(layout, "TASK", 1000, raising=False)
    got = queries()["joined_pieces"](spark, "/root/testdata/sf0.001")
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) > 5000 and max(sizes) < 1000
    assert got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0].count("Exchange") == 1


def test_lines_of_pages_in_one_task(spark):
    """Words between two lines go with the mean so far; pages don't touch, whatever their order, nor do null ones; a word without a height ends on the last line."""
    words = [(d, p, t, x, x + 5, y, y) for d, p, t, x, y in (("a", 1, "m", 9.0, 10.0), ("a", 1, "n", 1.0, 12.0), ("a", 1, "o", 5.0, 13.4), ("a", 1, "p", 0.0, 14.5), ("a", 2, "q", 0.0, 14.0), (None, 1, "r", 3.0, 5.0), (None, 1, "s", 2.0, 5.5), ("a", 2, "t", 7.0, None))]
    df = spark.createDataFrame(words, "doc string, page int, text string, x0 double, x1 double, top double, base double")
    got = {r["text"]: (r["line"], r["place"]) for r in layout.lines(df.coalesce(1)).collect()}
    assert got == {"n": (0, 0), "o": (0, 1), "m": (0, 2), "p": (1, 0), "q": (0, 0), "t": (0, 1), "s": (0, 0), "r": (0, 1)}
    assert layout.lines(df.limit(0)).count() == 0


def test_pages_are_dealt_by_rows(spark):
    words = spark.range(1000).select((F.col("id") % 50).alias("doc"), F.lit(1).alias("page"))
    assert layout.dealt(words, 100).rdd.getNumPartitions() == 10 and layout.dealt(words, 100).count() == 1000
