"""Long repeats against brute force: every window of every text, by its words."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from planwatch.llm import grams, substrings

SCHEMA = "doc_id bigint, text string, lang string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows, width):
    lists = [words(t) for _, t in rows]
    starts = Counter(tuple(w[i : i + width]) for w in lists for i in range(len(w) - width + 1))
    out = []
    for (doc, _), w in zip(rows, lists):
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if starts[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        spans, i = [], 0
        while i < len(w):
            j = i
            while j < len(w) and gone[j]:
                j += 1
            spans += [(i, j)] if j > i else []
            i = max(j, i + 1)
        out.append((doc, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g), spans))
    return out


def found(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept, [(s.start, s.end) for s in r.spans]) for r in df.collect()), key=repr)


def planted(seed, n=60):
    """Texts that share passages at any offset, within one text too, in two languages' words."""
    rnd = random.Random(seed)
    draw = lambda k: [rnd.choice(["alpha", "Beta", "ß", "日本", "x", "y", "zz", "q"]) + str(rnd.randrange(30)) for _ in range(k)]
    shared = [draw(rnd.randrange(3, 60)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [draw(rnd.randrange(0, 25)) if rnd.random() < 0.6 else rnd.choice(shared) for _ in range(rnd.randrange(0, 6))]
        rows.append((i, rnd.choice([" ", "  ", "\n", "\t\v"]).join(x for p in parts for x in p)))
    return rows


@pytest.mark.parametrize("width, chunk, bucket", [(2, 1 << 20, 10**6), (3, 900, 100), (7, 700, 60), (8, 1 << 20, 50), (35, 500, 40)])
def test_repeats_match_brute_force(spark, width, chunk, bucket):
    rows = planted(width)
    docs = spark.createDataFrame([(d, t, "en") for d, t in rows], SCHEMA).repartition(5)
    assert found(substrings.without_repeats(docs, width=width, chunk=chunk, bucket=bucket)) == sorted(brute(rows, width), key=repr)


def test_repeats_of_awkward_rows(spark):
    long = " ".join(f"w{i % 5000}" for i in range(20_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (5, long), (6, "日 本 語 😀 x"), (7, "日 本 語 😀 y"), (8, "aa " * 50), (9, "\0 a\0 b \x1f c"), (10, "b\x1f c a\0 b \x1f c")]
    docs = spark.createDataFrame([(d, t, "en") for d, t in rows], SCHEMA).withColumns({"bucket": F.lit(1), "chunk": F.lit(2), "Kept": F.lit("x")})
    assert found(substrings.without_repeats(docs, width=4)) == sorted(brute(rows, 4), key=repr)
    assert substrings.without_repeats(docs.limit(0)).collect() == []


def test_a_passage_goes_from_many_copies_and_clean_texts_stay(spark):
    rnd = random.Random(3)
    passage = " ".join(f"p{rnd.randrange(10**6)}" for _ in range(50))
    fresh = lambda i: " ".join(f"d{i}x{k}" for k in range(40))
    rows = [(i, f"{fresh(i)[: i % 23]} {passage} {fresh(i)}") for i in range(2000)] + [(i, fresh(i)) for i in range(5000, 5300)]
    got = {r.doc_id: r for r in substrings.without_repeats(spark.createDataFrame([(d, t, "en") for d, t in rows], SCHEMA)).collect()}
    assert all(passage not in got[i].kept and "p" not in got[i].kept for i in range(2000))
    assert all(got[i].n_removed == 0 and got[i].kept == fresh(i) for i in range(5000, 5300))


def test_the_query_gives_the_digest_of_what_is_kept(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in substrings.op12_substring_dedup(spark, folder).collect())
    assert got == sorted((d, n, r, hashlib.sha256(k.encode()).hexdigest()) for d, n, r, k, _ in brute(rows, 35))


def test_hashes_tell_words_and_runs_apart(monkeypatch):
    texts = [b"a", b"a a\0 b ab", b"", b"  ba " + b"x" * 5000 + b" y", "é日".encode()]
    one = grams.Words(texts)
    assert [bytes(one.bytes[s:e]) for s, e in zip(one.starts, one.ends)] == [w for t in texts for w in t.split()]
    assert one.counts.tolist() == [len(t.split()) for t in texts]
    h = one.hashes()
    monkeypatch.setattr(grams, "BLOCK", 7)
    assert (grams.Words(texts).hashes() == h).all() and len(set(h.tolist())) == len({w for t in texts for w in t.split()})
    assert (h != one.hashes(1)).all()
    x = np.array([1, 2, 3, 1, 2, 3, 2, 1, 3], np.uint64)
    for k in (1, 2, 3, 5):
        r = grams.rolled(x, k)[: len(x) - k + 1].tolist()
        assert all((r[i] == r[j]) == (x[i : i + k].tolist() == x[j : j + k].tolist()) for i in range(len(r)) for j in range(len(r)))
