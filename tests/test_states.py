"""State that is kept from run to run: fetches of addresses, and chains of dated prices."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from planwatch.operators.versions import chains
from planwatch.streaming import feeds, states


def fetch(i, url="u", fixed=False, status=200, sha="s", fault=False, capture="c"):
    return (capture, url, fixed, i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), status, sha, f"e{i}", f"m{i}", fault)


def run(spark, folder, runs, query, schema):
    """Each run adds rows and goes on where the last one ended."""
    for rows in runs:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        feeds.available_now(query(states.set_up(spark).readStream.schema(schema).parquet(f"{folder}/in")), states.append_batches(f"{folder}/log"), f"{folder}/state")


def test_fetch_state_goes_on_in_the_next_run(spark, tmp_path):
    runs = [
        [fetch(1, sha="a"), fetch(2, "fixed", True, sha="b", fault=True), fetch(3, "gone", status=500, sha=None), fetch(4, None, sha="x"), fetch(4, "no capture", capture=None)],
        [fetch(5, status=304, sha=None), fetch(6, "fixed", True, sha="c"), fetch(7, "gone", status=429, sha=None), fetch(8, "other", sha="a")],
        [fetch(10, sha="a2"), fetch(9, sha="a"), fetch(11, "other", sha="z", fault=True), fetch(12, "other", sha="a")],
    ]
    run(spark, str(tmp_path), runs, states.fetch_states, states.FETCH)
    got = {(r.capture, r.url): (r.etag, r.sha, r.outcome, r.seen.hour) for r in states.known_addresses(spark, f"{tmp_path}/state").collect()}
    assert got == {
        ("c", "u"): ("e10", "a2", "changed", 10), ("c", "fixed"): (None, "b", "unchanged", 6), ("c", "gone"): (None, None, "blocked", 7), ("c", None): ("e4", "x", "changed", 4),
        ("", "no capture"): ("e4", "s", "changed", 4), ("c", "other"): ("e12", "a", "unchanged", 12),
    }
    log = states.told_apart(spark.read.parquet(f"{tmp_path}/log")).where("url in ('u', 'other')").orderBy("id")
    assert [(r.id, r.outcome) for r in log.collect()] == [(1, "new"), (5, "unchanged"), (8, "known"), (9, "unchanged"), (10, "new"), (11, "error"), (12, "unchanged")]


@pytest.mark.parametrize("seed, kind", [(1, "double"), (2, "bigint")])
def test_chains_in_state_equal_chains_at_once(spark, tmp_path, seed, kind):
    rnd, one = random.Random(seed), float if kind == "double" else int
    rows = [(k, d, [rnd.choice([one(1), one(2), None]), None]) for k in ("a", "b", None) for d in rnd.sample(range(40), 15)]
    rnd.shuffle(rows)
    schema = f"k string, dated bigint, prices array<{kind}>"
    run(spark, str(tmp_path), [rows[:3], rows[3:4], rows[4:20], rows[20:]], lambda s: states.changed_links(s, ["k"]), schema)
    log = spark.read.parquet(f"{tmp_path}/log")
    columns = ["k", "dated", "prices", "confirmed", "next_at", "version", "is_current"]
    got = sorted(map(tuple, states.current_links(log, ["k"]).select(columns).collect()), key=repr)
    assert got == sorted(map(tuple, chains(spark.createDataFrame(rows, schema), ["k"], "dated").select(columns).collect()), key=repr)
    assert log.where("batch = 1").count() <= 3  # one row changes its own link and its neighbours'


def test_rows_of_one_date_all_stay(spark, tmp_path):
    rows = [("k", dt.date(2024, 2, 1), [2.0]), ("k", dt.date(2024, 1, 1), [1.0]), ("k", dt.date(2024, 2, 1), [3.0]), ("j", dt.date(2024, 1, 1), [9.0])]
    run(spark, str(tmp_path), [[r] for r in rows], lambda s: states.changed_links(s, ["k"]), "k string, dated date, prices array<double>")
    day = lambda d: (d - dt.date(1970, 1, 1)).days
    got = sorted((r.k, r.dated, r.version, r.prices, r.is_current) for r in states.current_links(spark.read.parquet(f"{tmp_path}/log"), ["k"]).collect())
    january, february = day(dt.date(2024, 1, 1)), day(dt.date(2024, 2, 1))
    assert got == [("j", january, 1, [9.0], True), ("k", january, 1, [1.0], False), ("k", february, 2, [2.0], False), ("k", february, 3, [3.0], True)]


def test_links_of_all_orders_of_arrival_are_the_same():
    rows = [(1, [[5]]), (2, [[5]]), (3, [[6]]), (4, [[5]])]
    for order in itertools.permutations(rows):
        assert states.links(dict(order)) == {(1, 0): ([5], 2, 3), (3, 0): ([6], 3, 4), (4, 0): ([5], 4, None)}
