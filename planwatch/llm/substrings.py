"""Exact repeats of long runs of words, found by fixed blocks as anchors and probes by every rolling window."""

from __future__ import annotations

from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwatch.llm import grams
from planwatch.llm.common import documents, utf8

WIDTH = 35  # words of a window
CHUNK = 12 << 20  # bytes of texts that a task holds at a time
BUCKET = 1_500_000  # listed windows that a task compares at a time
SPARE = 14  # bits of a probe beyond log2 of all words: at 14, one probe of some thousands is looked at for nothing
SURE = 20  # windows are told by 2 log2(words) + 20 bits at least, so that one wrong pair in all has a chance of 2 ** -21

_PROBED = grams.LISTED.format("grams binary, many binary, anchors binary")
_EXTENDED = grams.LISTED.format("grams binary, rest binary, many binary")


class _Chunk:
    """Texts of a chunk, and the rolling windows of half the width: their hashes, different ones and which of them starts at each word."""

    def __init__(self, group: pa.Table, width: int, bits: int):
        self.group, self.width, self.block = group, width, (width + 1) // 2
        self.words = grams.Words(list(utf8(group["text"])))
        self.h = self.words.hashes()
        long_enough = np.repeat(self.words.counts >= width, self.words.counts)
        self.at = np.flatnonzero(self.words.whole(self.block) & long_enough)
        keys = grams.rolled(self.h, self.block)[self.at] >> np.uint64(64 - bits)
        self.keys, self.of, self.n = np.unique(keys, return_inverse=True, return_counts=True)

    def probes(self, n_buckets: int, bits: int) -> pa.Table:
        """Every rolling window, with whether this chunk has it twice or more, and whether it is a reference block: one at a multiple of the
        block's length. A run of ``width`` words has such a block of its own text whole within it."""
        first = np.repeat(self.words.firsts[:-1], self.words.counts)[self.at]
        anchors = np.zeros(len(self.keys), bool)
        anchors[self.of[(self.at - first) % self.block == 0]] = True
        return grams.lists(self.group["chunk"][0].as_py(), grams.cuts(self.keys, n_buckets, bits), {"grams": (grams.packed_ascending, self.keys), "many": (grams.packed_flags, self.n > 1), "anchors": (grams.packed_flags, anchors)})

    def extend(self, hits: pa.Table, rest_bits: int) -> None:
        """The windows around each hit, as the two numbers that tell them; ``starts`` are their places, ``pair`` the different ones."""
        hit = np.zeros(len(self.h) + 1, np.int64)
        hit[self.at + 1] = grams.answered(hits, len(self.keys))[self.of]
        before = np.cumsum(hit)  # hits that start before each word
        reach = np.minimum(np.arange(len(self.h)) + self.width - self.block + 1, len(self.h))
        self.starts = np.flatnonzero(self.words.whole(self.width) & (before[reach] > before[:-1]))
        one = grams.rolled(self.h, self.width)[self.starts]
        two = grams.rolled(self.words.hashes(1), self.width)[self.starts] >> np.uint64(64 - rest_bits)
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])[: len(one)]
        self.pair, self.rank = np.empty(len(order), np.int64), np.flatnonzero(new)
        self.pair[order] = np.cumsum(new) - 1
        self.one, self.two, self.pairs = one[new], two[new], np.bincount(self.pair, minlength=len(self.rank))

    def windows(self, n_buckets: int) -> pa.Table:
        return grams.lists(self.group["chunk"][0].as_py(), grams.cuts(self.one, n_buckets), {"grams": (grams.packed_ascending, self.one), "rest": (grams.packed, self.two), "many": (grams.packed_flags, self.pairs > 1)})

    def cut(self, repeated: np.ndarray) -> pa.Table:
        """What is left of each text without the words of repeated windows, and the runs of those words."""
        w, n = self.words, len(self.h)
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, self.starts[repeated[self.pair]], 1)
        np.add.at(edge, self.starts[repeated[self.pair]] + self.width, -1)
        gone = np.cumsum(edge[:-1]) > 0
        mark = np.zeros(len(w.bytes) + 1, np.int8)
        mark[w.starts[~gone]] += 1
        mark[w.ends[~gone] + 1] -= 1
        left = np.cumsum(mark[:-1], dtype=np.int8) > 0
        text = np.where(w.inside, w.bytes, np.uint8(32))[left].tobytes()  # kept words, each with the blank behind it
        ends = np.cumsum(left)[w.text_ends - 1] if len(w.text_ends) else np.zeros(0, np.int64)
        before = np.concatenate([[0], ends[:-1]])
        kept = [text[a : max(a, b - 1)] for a, b in zip(before.tolist(), ends.tolist())]
        runs = np.diff(gone, prepend=False)  # a run doesn't go on into the next text
        runs[w.firsts[:-1][w.counts > 0]] = gone[w.firsts[:-1][w.counts > 0]]
        last = np.append(~gone[1:], True) & gone
        last[(w.firsts[1:] - 1)[w.counts > 0]] = gone[(w.firsts[1:] - 1)[w.counts > 0]]
        froms, tos = np.flatnonzero(runs & gone), np.flatnonzero(last) + 1
        of = np.searchsorted(w.firsts, froms, "right") - 1
        of = of if len(of) else np.zeros(0, np.int64)
        spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(w.counts) + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(froms - w.firsts[of]), pa.array(tos - w.firsts[of])], ["start", "end"]))
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[w.firsts])
        return pa.table([self.group["doc_id"], pa.array(w.counts.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(kept, pa.binary()).cast(pa.string()), spans], names=["doc_id", "n_words", "n_removed", "kept", "spans"])


def _hits(group: pa.Table) -> pa.Table:
    """Of a bucket's lists: the windows that are a reference block somewhere and start in two places or more."""
    sizes = group["size"].to_pylist()
    found, of = np.unique(np.concatenate([grams.unpacked_ascending(x.as_py()) for x in group["grams"]]), return_inverse=True)
    many, anchors = (np.concatenate([grams.unpacked_flags(x.as_py(), n) for x, n in zip(group[c], sizes)]) for c in ("many", "anchors"))
    hit = (np.bincount(of, weights=1 + many) > 1) & (np.bincount(of, weights=anchors) > 0)
    return grams.answers(group, hit[of])


def _repeated(group: pa.Table) -> pa.Table:
    """Of a bucket's lists: the windows that start in two places or more."""
    one = np.concatenate([grams.unpacked_ascending(x.as_py()) for x in group["grams"]])
    two = np.concatenate([grams.unpacked(x.as_py(), np.uint64) for x in group["rest"]])
    many = np.concatenate([grams.unpacked_flags(x.as_py(), n) for x, n in zip(group["many"], group["size"].to_pylist())])
    order = np.lexsort((two, one))
    new = np.concatenate([[True], (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)])
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return grams.answers(group, (np.bincount(of, weights=1 + many) > 1)[of])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, chunk: int = CHUNK, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, spans) for each row: the text without each word of a run of ``width`` words that starts anywhere else, too.

    Reference blocks of half the width (rounded up) are the anchors: a run of ``width`` words has one whole within it, wherever it
    starts. Every rolling window of that length probes them; around each that starts twice or more the windows of the full width
    are compared, all occurrences at once, and what starts twice or more is the union of the maximal repeats. No pairs are made.

    ``kept`` has the words joined by one space, ``spans`` the runs of removed words as [start, end) in words. Null and empty texts have no words and
    keep an empty text; texts of fewer than ``width`` words are kept whole. Repeated rows are repeats of each other, and no copy is spared.
    A null doc_id is carried along; other columns aren't read. An empty table gives no rows. ``chunk`` and ``bucket`` bound what a task holds.
    """
    if width < 2:
        raise ValueError("a window has two words at least")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts, n_chunks, size = grams.dealt(rows, chunk, "doc_id", "text", F.spark_partition_id())
    bits = min(64, ceil(log2(max(size, 2) / 4)) + SPARE)
    rest_bits = min(64, max(1, 2 * ceil(log2(max(size, 2) / 4)) + SURE - 64))
    n_buckets = max(ceil(size / 6 / bucket), min(n_chunks, ceil(size / (4 << 20))), 1)

    def list_probes(group: pa.Table) -> pa.Table:
        return _Chunk(group, width, bits).probes(n_buckets, bits)

    def extended(group: pa.Table, hits: pa.Table) -> _Chunk:
        found = _Chunk(group, width, bits)
        found.extend(hits, rest_bits)
        return found

    def list_windows(group: pa.Table, hits: pa.Table) -> pa.Table:
        return extended(group, hits).windows(n_buckets)

    def cut(group: pa.Table, both: pa.Table) -> pa.Table:
        side = both["hits"].to_numpy(zero_copy_only=False)
        found = extended(group, both.filter(pa.array(side)))
        return found.cut(grams.answered(both.filter(pa.array(~side)), len(found.one)))

    each = texts.groupBy("chunk")
    hits = each.applyInArrow(list_probes, _PROBED).repartition(n_buckets, "bucket").groupBy("bucket").applyInArrow(_hits, grams.ANSWERED).repartition(n_chunks, "chunk")
    windows = each.cogroup(hits.groupBy("chunk")).applyInArrow(list_windows, _EXTENDED).repartition(n_buckets, "bucket")
    repeated = windows.groupBy("bucket").applyInArrow(_repeated, grams.ANSWERED).repartition(n_chunks, "chunk")
    both = hits.withColumn("hits", F.lit(True)).unionByName(repeated.withColumn("hits", F.lit(False)))
    return each.cogroup(both.groupBy("chunk")).applyInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, kept string, spans array<struct<start: bigint, end: bigint>>")


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns over all documents, as ``without_repeats`` says it for nulls, empty texts and repeated rows."""
    return without_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, row_number() OVER () AS id FROM documents),
each AS (SELECT id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM docs),
starts AS (SELECT id, place, md5(array_to_string(words[place:place + 34], ' ')) AS run FROM (SELECT id, words, unnest(range(1, len(words) - 33)) AS place FROM docs)),
repeated AS (SELECT id, place FROM starts WHERE run IN (SELECT run FROM starts GROUP BY run HAVING count(*) > 1)),
covered AS (
    SELECT each.id, word, each.place, max(CASE WHEN repeated.place IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY each.id ORDER BY each.place ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
    FROM each LEFT JOIN repeated ON each.id = repeated.id AND each.place = repeated.place
),
kept AS (SELECT id, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY place) FILTER (WHERE gone = 0) AS kept FROM covered GROUP BY id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN kept ON docs.id = kept.id
"""
