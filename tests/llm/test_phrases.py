"""Collocations against brute force over all phrases, with hashes of few keys so that indexes take several passes."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from planwatch.llm import phrases
from planwatch.llm.perfect_hash import PerfectHash

SCHEMA = "doc_id bigint, text string, lang string"


def brute(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longest = Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longest[p[i : i + k]] = max(longest[p[i : i + k]], a)
        rows = []
        for p, a in found.items():
            if 100 * longest[p] >= 80 * a:
                continue
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def drawn(seed, n=80):
    rnd = random.Random(seed)
    vocabulary = ["the", "The", "of", "new", "york", "city", "ß", "ÄB", "日本", "x\0", "a-b", "in", "deed"] + [f"w{i}" for i in range(30)]
    fixed = ["new york city hall", "in deed", "the ÄB of 日本", "of of of of of"]
    ends = [" ", "  ", "\t", ". ", ", ", "\n", "!", " ; ", "\x0b", " "]
    texts = []
    for _ in range(n):
        parts = [rnd.choice(fixed) if rnd.random() < 0.4 else rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 60))]
        texts.append((rnd.choice(["en", "en", "de", None, ""]), "".join(p + rnd.choice(ends[: rnd.choice([1, 3, 10])]) for p in parts)))
    return texts


def found(docs, **options):
    return sorted(map(tuple, phrases.collocations(docs, **options).collect()))


@pytest.mark.parametrize("seed, least, top, options", [(1, 3, 2000, {}), (2, 2, 15, {"keys": 25, "bucket": 50}), (3, 5, 7, {"keys": 40, "spare": -3})])
def test_collocations_match_brute_force(spark, seed, least, top, options):
    rows = drawn(seed)
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], SCHEMA).repartition(3)
    got = found(docs, least=least, top=top, **options)
    assert got == brute(rows, least, top) and len(got) > 5


def test_collocations_of_awkward_rows(spark):
    rows = [("en", None), ("en", ""), (None, " .,;:!? \n"), ("en", "one two " * 40), ("en", "one two " * 40), ("xx", "rare words only here"), ("de", " ".join(f"v{i % 50}" for i in range(30_000)))]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], SCHEMA).withColumns({c: F.lit(1) for c in ("n", "Word", "slot", "key", "at", "block")})
    assert found(docs) == brute(rows, 30, 2000)
    assert found(docs.limit(0)) == []
    assert found(docs.where("doc_id = 5")) == []


def test_the_first_of_each_are_the_same_by_parts(spark):
    rows = spark.createDataFrame([("a", i % 7, i) for i in range(900)] + [("b", 1, 1)], "lang string, score bigint, i bigint")
    got = phrases.top_of_each(rows, "lang", [F.col("score").desc(), F.col("i")], 50, salts=5).orderBy("lang", "rank").collect()
    want = sorted(((-(i % 7), i) for i in range(900)))[:50]
    assert [(r.lang, r.score, r.i, r["rank"]) for r in got] == [("a", -s, i, k) for k, (s, i) in enumerate(want, 1)] + [("b", 1, 1, 1)]


@pytest.mark.parametrize("n", [0, 1, 2, 5000])
def test_perfect_hash_is_minimal_and_tells_strangers(n, monkeypatch):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 63, 2 * n, np.uint64))[:n]
    checks = rng.integers(0, 1 << 63, n, np.uint64)
    for levels in (40, 1):  # with one level most are looked up by order
        monkeypatch.setattr(PerfectHash, "LEVELS", levels)
        made = PerfectHash(keys, checks)
        assert sorted(made.lookup(keys, checks).tolist()) == list(range(n))
        assert (made.stored[made.lookup(keys)] == keys).all()
        assert (made.lookup(rng.integers(1 << 63, 1 << 64, 3000, np.uint64)) == -1).all()
        assert (made.lookup(keys, checks + np.uint64(1)) == -1).all()
