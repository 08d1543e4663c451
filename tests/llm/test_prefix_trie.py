"""The trie against brute force over all prefixes, with parts so small that nodes cross many of them."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from planwatch.llm import prefix_trie as trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute_rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [t for _, t in sorted(x, key=lambda y: y[0])] for c, x in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def brute_trie(paths):
    """paths: (conv_id, tuple of (role, text)), a conv_id may come twice."""
    nodes = defaultdict(list)
    for c, path in paths:
        for d in range(len(path) + 1):
            nodes[tuple(path[:d])].append((c, len(path) == d))
    children = defaultdict(list)
    for p in nodes:
        if p:
            children[p[:-1]].append(p)
    out, below = [], {}
    for p in sorted(nodes, key=len, reverse=True):
        size = len(p[-1][1].encode()) if p else 0
        leaves = sum(below[x][0] for x in children[p]) or 1
        saved = (len(nodes[p]) - 1) * size + sum(below[x][1] for x in children[p])
        below[p] = leaves, saved
        ends = ",".join(str(c) for c in sorted(c for c, e in nodes[p] if e))
        out.append((min(c for c, _ in nodes[p]), len(p), min(c for c, _ in nodes[p[:-1]]) if p else None, len(nodes[p]), len(children[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def drawn(seed, n=150):
    rnd = random.Random(seed)
    says = [("user", "hi"), ("assistant", "hallo"), ("user", ""), (None, "ü"), ("system", None), ("user", "hi ")]
    rows = []
    for c in rnd.sample(range(-20, 400), n):
        size = rnd.choice([1, 1, 2, 3, 5, 9, 14])
        turns = rnd.sample([None, *range(30)], size)
        whole = c % 3 == 0  # a third begins alike
        rows += [(c, t, *(says[i % 6] if whole else rnd.choice(says[: rnd.choice([1, 2, 6])]))) for i, t in enumerate(sorted(turns, key=lambda t: (t is not None, t or 0)))]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, part, fan", [(1, 4 << 20, 64), (2, 700, 2), (3, 300, 3), (4, 1500, 64)])
def test_trie_matches_brute_force(spark, seed, part, fan):
    rows = [r for r in drawn(seed) if r[0] >= 0]
    got = trie.prefix_trie(trie.rebuilt(trie.turn_arrays(spark.createDataFrame(rows, SCHEMA).repartition(3))), part=part, fan=fan)
    assert found(got) == brute_trie(brute_rebuilt(rows).items())


def test_a_large_group_of_copies_crosses_parts(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(3000) for t in range(3)] + [(5000 + c, 0, "user", f"alone {c}") for c in range(50)]
    got = trie.prefix_trie(trie.turn_arrays(spark.createDataFrame(rows, SCHEMA)).select("conv_id", "path"), part=2000, fan=4)
    own = defaultdict(list)
    for c, _, role, text in rows:
        own[c].append((role, text))
    assert found(got) == brute_trie(own.items())


def test_trie_of_awkward_rows(spark):
    long = [(40, t, "user", "same" if t < 300 else f"x{t % 7}") for t in range(900)] + [(41, t, "user", "same") for t in range(500)]
    rows = [(None, 1, "user", "no conversation"), (1, None, None, None), (2, 5, "user", "日本"), (2, None, "user", "first"), (3, 1, "us", "er:x"), (4, 1, "user", ":x"), (6, 1, "user", "t" * 100_000), *long]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("path", "base", "key", "Depth")})
    assert found(trie.prefix_trie(trie.rebuilt(trie.turn_arrays(docs)))) == brute_trie(brute_rebuilt(rows).items())
    assert trie.prefix_trie(trie.rebuilt(trie.turn_arrays(docs.limit(0)))).collect() == []
    turnless = spark.createDataFrame([(7, b""), (7, b""), (9, b"")], "conv_id bigint, path binary")
    assert found(trie.prefix_trie(turnless)) == brute_trie([(7, ()), (7, ()), (9, ())])


def test_turns_that_share_a_number_have_one_order(spark):
    rows = [(1, 1, "user", x) for x in "abcd"]
    paths = [trie.turn_arrays(spark.createDataFrame(r, SCHEMA)).first().path for r in (rows, rows[::-1])]
    assert paths[0] == paths[1] and len(paths[0]) == 4 * trie.TURN


def test_common_turns():
    turn = lambda s: b"".join(bytes([x]) * trie.TURN for x in s)
    for a, b in (([], []), ([1], [1, 2]), ([1, 2, 3, 4, 5], [1, 2, 3, 9, 5]), ([2], [3]), ([1, 2, 3], [1, 2, 4])):
        assert trie._common(turn(a), turn(b)) == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
