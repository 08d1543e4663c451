"""Phrase collocations: counts of candidate phrases by the slots of minimal perfect hashes, and cuts read by slot."""

from __future__ import annotations

import pickle
from functools import reduce
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from planwatch.llm import grams
from planwatch.llm.common import documents, sized, utf8, written
from planwatch.llm.perfect_hash import PerfectHash

LEAST, MOST = 30, 4  # occurrences of a candidate, words of a phrase
SCALE = 2_000_000
COVER = 80  # percent of its occurrences that a longer candidate has of one that is dropped
TOP = 2000
KEYS = 900_000  # of one hash, about: what is broadcast at once, some 16 MB
SEGMENT = 1 << 16  # slots whose counts are summed in one array
FAN = 16  # arrays that are summed at once
BUCKET = 1_500_000  # listed phrases that a task sums at a time
SPARE = 8  # bits of a listed phrase beyond log2 of the bytes

BREAKS = b".,;:!?\n\v\f\r"
_SHIFT = 21  # a slot's bits below the number of its block


def _pieces(batch: pa.RecordBatch, lang: int, text: int) -> tuple[grams.Words, list[str], np.ndarray]:
    """The words of a batch's texts in lower case, the languages there are, and each word's language."""
    words = grams.Words([t.lower() for t in utf8(batch.column(text))], b" \t" + BREAKS)  # bytes.lower() touches A-Z only
    encoded = batch.column(lang).dictionary_encode()
    of = np.repeat(encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.counts)
    return words, encoded.dictionary.to_pylist(), of


def _keys(words: grams.Words, langs: list[str], of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each word together with its language."""
    salt = lambda seed: np.array([xxhash.xxh64_intdigest(x.encode(), seed) for x in langs], np.uint64)[of] if len(of) else np.zeros(0, np.uint64)
    return tuple(grams.mixed(words.hashes(i) ^ salt(i)) for i in (0, 1))


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, n) of (lang, text): n of a null word is that of all words of the language."""

    def run(batches):
        for batch in grams.by_bytes(batches, 1):
            words, langs, of = _pieces(batch, 0, 1)
            _, first, n = np.unique(_keys(words, langs, of)[0], return_index=True, return_counts=True)
            data = words.bytes.tobytes()
            each = [data[s:e] for s, e in zip(words.starts[first].tolist(), words.ends[first].tolist())]
            all_ = np.bincount(of, minlength=len(langs))
            lang = pa.array([langs[i] for i in of[first]] + langs, pa.string())
            yield pa.RecordBatch.from_arrays([lang, pa.array(each + [None] * len(langs), pa.binary()).cast(pa.string()), pa.array(np.concatenate([n, all_]).astype(np.int64))], names=["lang", "word", "n"])

    return texts.mapInArrow(run, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Index:
    """Perfect hashes of the keys of a table (key, ...), one for each block of keys, and the table with each key's slot.

    A block has about ``keys`` keys and is built by one task; ``each`` broadcasts one block at a time, so what is broadcast at once has this bound and
    larger indexes take more passes. A slot is the number of the block, shifted, and the place in it.
    """

    def __init__(self, rows: DataFrame, name: str, keys: int, check: bool = False):
        rows = written(rows, f"{name}-keys")
        self.spark, self.n_blocks = rows.sparkSession, max(1, ceil(rows.count() / keys))
        self.size = self.n_blocks << _SHIFT
        n, columns = self.n_blocks, rows.columns
        block = F.shiftright(F.shiftrightunsigned("key", 33) * n, 31).alias("block")

        def build(group: pa.Table) -> pa.Table:
            numbers = lambda c: group[c].to_numpy().view(np.uint64)
            made = PerfectHash(numbers("key"), numbers("check") if check else None)
            slots = made.lookup(numbers("key")) + (group["block"][0].as_py() << _SHIFT)
            table = pa.table([*(group[c] for c in columns), pa.array(slots), pa.nulls(len(slots), pa.binary())], names=[*columns, "slot", "hash"])
            one = pa.table([*(pa.nulls(1, group.schema.field(c).type) for c in columns), pa.array([group["block"][0].as_py() << _SHIFT]), pa.array([pickle.dumps(made)], pa.binary())], names=table.column_names)
            return pa.concat_tables([table, one])

        schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
        both = written(rows.select(block, "*").groupBy("block").applyInArrow(build, f"{schema}, slot bigint, hash binary"), name)
        self.rows, self._hashes = both.where("hash IS NULL").drop("hash"), both.where("hash IS NOT NULL").select("slot", "hash")

    def each(self):
        """(first slot, broadcast hash) of each block."""
        for b in range(self.n_blocks):
            row = self._hashes.where(F.col("slot") == b << _SHIFT).first()
            made = self.spark.sparkContext.broadcast(pickle.loads(row["hash"]) if row else PerfectHash(np.zeros(0, np.uint64), np.zeros(0, np.uint64)))
            yield b << _SHIFT, made
            made.unpersist()


_RUNS = "at bigint, ids binary, slots binary"


def _whole(at: int, ids: np.ndarray, slots: np.ndarray) -> pa.RecordBatch:
    """A row of RUNS as it is, for rows of other passes to be merged with."""
    return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([grams.packed(ids)], pa.binary()), pa.array([grams.packed(slots)], pa.binary())], names=["at", "ids", "slots"])


def _merged(passes: list[DataFrame], width: int) -> DataFrame:
    """What the passes over the blocks of an index have found, as one table of RUNS."""

    def merged(group: pa.Table) -> pa.Table:
        most = lambda c: reduce(np.maximum, [grams.unpacked(x.as_py()) for x in group[c]])
        return pa.Table.from_batches([_in_phrases(group["at"][0].as_py(), most("ids"), most("slots") if width > 1 else None, width)])

    return written(reduce(DataFrame.unionByName, passes).groupBy("at").applyInArrow(merged, _RUNS), "runs")


def _in_phrases(at: int, ids: np.ndarray, slots: np.ndarray | None, width: int) -> pa.RecordBatch:
    """A row of RUNS with the words only that are in a frequent phrase of ``width`` words, as no longer phrase has others: of neighbours that
    are in none one stays, as 0. Without ``slots`` these are the words' own."""
    if slots is not None:
        covered = np.zeros(len(ids) + 1, np.int64)
        starts = np.flatnonzero(slots)
        covered[starts] += 1
        covered[starts + width] -= 1
        ids = np.where(np.cumsum(covered[:-1]) > 0, ids, 0)
    keep = ~((ids == 0) & (np.concatenate([[1], ids[:-1]]) == 0)) if len(ids) else np.zeros(0, bool)
    return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([grams.packed(ids[keep])], pa.binary()), pa.array([None if slots is None else grams.packed(slots[keep])], pa.binary())], names=["at", "ids", "slots"])


def encoded(texts: DataFrame, index: Index) -> DataFrame:
    """(at, ids, slots): texts as the slots of their frequent words, from 1 on; 0 parts pieces and stands for other words. ``slots`` has those of the phrases so far, here the words."""
    single = index.n_blocks == 1
    texts = texts if single else written(texts, "texts")  # so that every pass parts them alike
    passes = []
    for base, made in index.each():

        def run(batches, base=base, made=made):
            part, seq = TaskContext.get().partitionId() << 33, 0
            for batch in grams.by_bytes(batches, 1):
                words, langs, of = _pieces(batch, 0, 1)
                slot = made.value.lookup(*_keys(words, langs, of))
                table = np.zeros(256, bool)
                table[list(BREAKS)] = True
                breaks = np.cumsum(table[words.bytes])[words.starts]  # texts are parted by one, too
                ids = np.insert(np.where(slot < 0, 0, slot + base + 1), np.flatnonzero(np.diff(breaks)) + 1, 0)
                yield _in_phrases(part + seq, ids, None, 1) if single else _whole(part + seq, ids, ids)
                seq += 1

        passes.append(written(texts.mapInArrow(run, _RUNS), "encoded"))
    return passes[0] if single else _merged(passes, 1)


class Run:
    """Some texts as word numbers and as slots of phrases of ``width - 1`` words; its phrases of ``width`` words whose shorter ones are both frequent."""

    def __init__(self, ids: bytes, slots: bytes | None, width: int, size: int):
        self.ids = grams.unpacked(ids)
        self.slots = self.ids if slots is None else grams.unpacked(slots)
        n = len(self.ids) - width + 1
        self.at = np.flatnonzero((self.slots[:n] > 0) & (self.slots[1 : n + 1] > 0)) if n > 0 else np.zeros(0, np.int64)
        self.prefix, self.word = self.slots[self.at] - 1, self.ids[self.at + width - 1] - 1
        #: One to one with (prefix, word).
        self.keys = grams.mixed(self.prefix.astype(np.uint64) * np.uint64(size) + self.word.astype(np.uint64))


def _runs(batches, width: int, size: int):
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column(0)[i].as_py(), Run(batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), width, size)


def bounded(runs: DataFrame, width: int, size: int, least: int, bits: int, n_buckets: int) -> DataFrame:
    """(key) of what may be frequent: the high ``bits`` of phrases' keys, where all phrases that share them occur ``least`` times together."""

    def listed(batches):
        for at, run in _runs(batches, width, size):
            keys, n = np.unique(run.keys >> np.uint64(64 - bits), return_counts=True)
            yield from grams.lists(at, grams.cuts(keys, n_buckets, bits), {"grams": (grams.packed_ascending, keys), "counts": (grams.packed, n.astype(np.int64))}).to_batches()

    def summed(group: pa.Table) -> pa.Table:
        keys, of = np.unique(np.concatenate([grams.unpacked_ascending(x.as_py()) for x in group["grams"]]), return_inverse=True)
        n = np.bincount(of, weights=np.concatenate([grams.unpacked(x.as_py()) for x in group["counts"]]))
        return pa.table({"key": pa.array(grams.mixed(keys[n >= least]).view(np.int64))})

    return runs.mapInArrow(listed, grams.LISTED.format("grams binary, counts binary")).repartition(n_buckets, "bucket").groupBy("bucket").applyInArrow(summed, "key bigint")


def candidates(runs: DataFrame, width: int, size: int, maybe: Index, bits: int) -> DataFrame:
    """(key, prefix, word) of the different phrases that ``maybe`` has the high bits of."""
    found = []
    for _, made in maybe.each():

        def run(batches, made=made):
            for _, one in _runs(batches, width, size):
                keys, first = np.unique(one.keys, return_index=True)
                there = made.value.lookup(grams.mixed(keys >> np.uint64(64 - bits))) >= 0
                yield pa.RecordBatch.from_arrays([pa.array(keys[there].view(np.int64)), pa.array(one.prefix[first[there]]), pa.array(one.word[first[there]])], names=["key", "prefix", "word"])

        found.append(written(runs.mapInArrow(run, "key bigint, prefix bigint, word bigint").distinct(), "candidates"))
    return reduce(DataFrame.unionByName, found)  # a phrase's high bits are in one block


def counted(runs: DataFrame, width: int, size: int, index: Index) -> DataFrame:
    """(segment, counts): the occurrences of each slot. Mappers count into one array a block; arrays are summed ``FAN`` at a time, in a tree."""
    parts = []
    for base, made in index.each():

        def run(batches, base=base, made=made):
            total = np.zeros(len(made.value), np.int64)
            for _, one in _runs(batches, width, size):
                slots = made.value.lookup(one.keys)
                total += np.bincount(slots[slots >= 0], minlength=len(total))
            some = [i for i in range(0, len(total), SEGMENT) if total[i : i + SEGMENT].any()]
            columns = [pa.array([(base + i) // SEGMENT for i in some], pa.int64()), pa.array([TaskContext.get().partitionId()] * len(some), pa.int64()), pa.array([grams.packed(total[i : i + SEGMENT]) for i in some], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["segment", "part", "counts"])

        parts.append(written(runs.mapInArrow(run, "segment bigint, part bigint, counts binary"), "counts"))

    def added(group: pa.Table) -> pa.Table:
        total = reduce(np.add, (grams.unpacked(x.as_py()) for x in group["counts"]))
        return pa.table([group["segment"].slice(0, 1), pa.array([group["part"][0].as_py() // FAN]), pa.array([grams.packed(total)], pa.binary())], names=["segment", "part", "counts"])

    sums = reduce(DataFrame.unionByName, parts)
    n = (sums.agg(F.max("part")).first()[0] or 0) + 1
    while n > 0:
        sums, n = sums.groupBy("segment", (F.col("part") / FAN).cast("bigint")).applyInArrow(added, "segment bigint, part bigint, counts binary"), ceil(n / FAN) if n > FAN else 0
    return sums.select("segment", "counts")


def frequent(index: Index, counts: DataFrame, least: int) -> DataFrame:
    """(key, prefix, word, a) of the candidates that occur ``least`` times."""

    def read(left: pa.Table, right: pa.Table) -> pa.Table:
        n = grams.unpacked(right["counts"][0].as_py()) if right.num_rows else np.zeros(SEGMENT, np.int64)
        a = n[left["slot"].to_numpy() % SEGMENT] if left.num_rows else np.zeros(0, np.int64)
        return pa.table([left["key"], left["prefix"], left["word"], pa.array(a, pa.int64())], names=["key", "prefix", "word", "a"])

    rows = index.rows.withColumn("segment", F.expr(f"slot div {SEGMENT}"))
    return rows.groupBy("segment").cogroup(counts.groupBy("segment")).applyInArrow(read, "key bigint, prefix bigint, word bigint, a bigint").where(F.col("a") >= least)


def extended(runs: DataFrame, width: int, size: int, index: Index) -> DataFrame:
    """``runs`` with the slots of frequent phrases of ``width`` words, from 1 on, where they start, and the words of these only."""
    single, passes = index.n_blocks == 1, []
    for base, made in index.each():

        def run(batches, base=base, made=made):
            for at, one in _runs(batches, width, size):
                slots = made.value.lookup(one.keys)
                new = np.zeros(len(one.ids), np.int64)
                new[one.at[slots >= 0]] = slots[slots >= 0] + base + 1
                yield _in_phrases(at, one.ids, new, width) if single else _whole(at, one.ids, new)

        passes.append(written(runs.mapInArrow(run, _RUNS), "runs"))
    return passes[0] if single else _merged(passes, width)


def _with_parts(rows: DataFrame, shorter: DataFrame, width: int) -> DataFrame:
    """Frequent phrases with what their first and last ``width - 1`` words have, found by slot: the phrase, the counts of its firsts and lasts, and shorter slots."""
    first = shorter.select(F.col("slot").alias("prefix"), "lang", F.col("phrase").alias("before"), F.concat("firsts", F.array("a")).alias("firsts"), F.col("prefix").alias("pp"), F.col("suffix").alias("ps"))
    last = shorter.select(*([F.col("slot").alias("word")] if width == 2 else [F.col("prefix").alias("ps"), "word"]), F.col("slot").alias("suffix"), F.concat("lasts", F.array("a")).alias("lasts"), F.col("last"), F.col("suffix").alias("ss"))
    both = rows.join(first, "prefix").join(last, ["word"] if width == 2 else ["ps", "word"])
    return both.select("slot", "prefix", "word", "suffix", "a", "lang", F.concat_ws(" ", "before", "last").alias("phrase"), "last", "firsts", "lasts", "pp", "ps", "ss")


def top_of_each(rows: DataFrame, by: str, order: list, top: int, salts: int = 64) -> DataFrame:
    """The first ``top`` rows of each ``by`` with their rank, first within parts of each, so that no task holds all rows of one."""
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(salts))
    some = rows.withColumn("_part", part).withColumn("_place", F.row_number().over(W.partitionBy(by, "_part").orderBy(*order))).where(F.col("_place") <= top)
    return some.drop("_part", "_place").withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP, keys: int = KEYS, bucket: int = BUCKET, spare: int = SPARE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases of two to four words of each language that its texts have ``least`` times, scored by their weakest cut.

    Words that occur ``least`` times, with their language, get the slots of a perfect hash, and texts become slots. For each width, a phrase can be frequent only if both
    of its shorter ones are; of these, all that share some bits of their keys are counted together first, which rules most out. What is left are the
    candidates, whose perfect hash mappers count into, with the stored key compared at each look-up: counts are exact.
    A null lang is ``und``; a null text is empty. Repeated rows count each time. Punctuation alone, or texts of rare words only, have no phrases.
    Ties go by more occurrences, then by the phrase's bytes. An empty table gives no rows. ``keys``, ``bucket`` and ``spare`` bound what is held and change no result.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0)).cast("bigint")).first()[0]
    bits, n_buckets = min(62, ceil(log2(max(size, 2) / 4)) + spare), max(1, ceil(size / 8 / bucket), min(ceil(size / (4 << 20)), docs.sparkSession.sparkContext.defaultParallelism))
    words = written(word_counts(texts).where((F.col("n") >= least) | F.col("word").isNull()), "words")

    def hashed(batches):
        for batch in grams.by_bytes(batches, 1):
            table = grams.Words(list(utf8(batch.column(1))), b"\n")
            encoded_ = batch.column(0).dictionary_encode()
            key, check = _keys(table, encoded_.dictionary.to_pylist(), encoded_.indices.to_numpy(zero_copy_only=False).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(check.view(np.int64)), *batch.columns], names=["key", "check", "lang", "word", "a"])

    vocabulary = Index(words.where("word IS NOT NULL").select("lang", "word", "n").mapInArrow(hashed, "key bigint, check bigint, lang string, word string, a bigint"), "words", keys, check=True)
    runs = encoded(texts, vocabulary)
    none, counts = F.lit(None).cast("bigint"), F.array().cast("array<bigint>")
    levels = [vocabulary.rows.select("slot", none.alias("prefix"), none.alias("word"), none.alias("suffix"), "a", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), counts.alias("firsts"), counts.alias("lasts"), none.alias("pp"), none.alias("ps"), none.alias("ss"))]
    slots = vocabulary.size
    for width in range(2, MOST + 1):
        if slots * vocabulary.size >= 1 << 64:
            raise ValueError("too many frequent phrases for 64-bit keys")
        maybe = Index(bounded(runs, width, vocabulary.size, least, bits, n_buckets), f"maybe-{width}", keys)
        index = Index(candidates(runs, width, vocabulary.size, maybe, bits), f"candidates-{width}", keys)
        found = Index(frequent(index, counted(runs, width, vocabulary.size, index), least), f"phrases-{width}", keys)
        levels.append(written(_with_parts(found.rows, levels[-1], width), f"with-parts-{width}"))
        if width < MOST:
            runs, slots = extended(runs, width, vocabulary.size, found), found.size
    longer = [(2, c, x) for x in levels[2:] for c in (("prefix", "suffix") if x is levels[2] else ("pp", "ps", "ss"))] + [(3, c, levels[3]) for c in ("prefix", "suffix")]
    covers = reduce(DataFrame.unionByName, [x.select(F.lit(w).alias("width"), F.col(c).alias("slot"), F.col("a").alias("longest")) for w, c, x in longer]).groupBy("width", "slot").agg(F.max("longest").alias("longest"))
    each = reduce(DataFrame.unionByName, [x.select(F.lit(w).alias("width"), "slot", "lang", "phrase", "a", "firsts", "lasts") for w, x in enumerate(levels[1:], 2)])
    each = each.join(covers, ["width", "slot"], "left").where(F.col("longest").isNull() | (F.col("longest") * 100 < F.col("a") * COVER))
    cut = F.expr(f"array_min(transform(firsts, (l, i) -> struct((CAST(a AS DECIMAL(38, 0)) * {SCALE}) div (l + lasts[size(firsts) - 1 - i]) AS score, i, l AS l, lasts[size(firsts) - 1 - i] AS r)))")
    scored = each.withColumn("cut", cut).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    best = top_of_each(scored, "lang", [F.col("score").desc(), F.col("a").desc(), F.col("phrase")], top)
    totals = words.where("word IS NULL").select("lang", "n")
    return best.join(sized(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns over all documents, as ``collocations`` says it for nulls, empty texts, ties and repeated rows."""
    return collocations(documents(spark, sf_dir))


ORACLE = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
phrases AS (
    SELECT lang, k, array_to_string(words[s:s + k - 1], ' ') AS phrase, count(*) AS f
    FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS s FROM words, range(1, 5) t(k)) GROUP BY ALL
),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM phrases WHERE k = 1 GROUP BY lang),
candidates AS (SELECT *, string_split(phrase, ' ') AS words FROM phrases WHERE k > 1 AND f >= 30),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM candidates),
scored AS (
    SELECT c.lang, c.k, c.phrase, c.f AS a, x.f AS l, y.f AS r, (2000000 * c.f::HUGEINT) // (x.f + y.f) AS score,
        row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY (2000000 * c.f::HUGEINT) // (x.f + y.f), cut) AS place
    FROM cuts c JOIN phrases x ON x.lang = c.lang AND x.phrase = array_to_string(c.words[1:cut], ' ') JOIN phrases y ON y.lang = c.lang AND y.phrase = array_to_string(c.words[cut + 1:], ' ')
),
inner_ AS (
    SELECT lang, array_to_string(words[s:s + j - 1], ' ') AS phrase, max(f) AS longest
    FROM (SELECT *, unnest(range(1, k - j + 2)) AS s FROM candidates, range(2, 4) t(j) WHERE j < k) GROUP BY ALL
),
ranked AS (
    SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank
    FROM scored s LEFT JOIN inner_ i ON i.lang = s.lang AND i.phrase = s.phrase WHERE place = 1 AND (longest IS NULL OR 100 * longest < 80 * a)
)
SELECT r.lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE rank <= 2000
"""
