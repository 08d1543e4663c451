"""Language-model scores by a weighted backoff automaton over all n-grams of the training texts.

Texts are dealt into chunks of bounded size. A chunk lists its different n-grams once, with how often its training texts have them; the
lists meet in buckets of n-grams, where the counts of all chunks are summed, and each chunk gets the totals of what it listed. From these it
compiles just the part of the automaton that its own texts run through, and walks them through it from left to right. Nothing of the model is
cut, broadcast or sent to the driver.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwatch.llm.automaton import Automaton
from planwatch.llm.common import crc_remainder, documents, utf8

CHUNK = 12 << 20  # bytes of texts that a task holds at a time; on larger executors, larger chunks make fewer lists
BUCKET = 1_500_000  # listed n-grams that a task sums at a time
BLOCK = 1 << 19  # tokens whose keys are made at once
ORDER = 3  # tokens of the longest n-grams, 2 or 3
ADDED = 0.1  # to each token's count, the unknown token included
MASS = 50.0  # by held-out likelihood; what the shorter context's probabilities weigh against counts
STATE = 2  # two tokens are a state if training texts have them at least so often

_START, _END = b"a start.", b"an end. "
_START_KEY = np.uint64(int.from_bytes(_START, "big"))
_TURN, _MIX, _FOLD = np.uint64(29), np.uint64(0x9E3779B97F4A7C15), np.uint64(32)


def words(text: bytes) -> list[bytes]:
    return text.lower().split()  # bytes.lower() touches A-Z only


def _after(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    """The 64-bit keys of contexts followed by a token."""
    x = ((context << _TURN | context >> (np.uint64(64) - _TURN)) * _MIX) ^ token
    x = (x ^ x >> _FOLD) * _MIX
    return x ^ x >> _FOLD


class Chunk:
    """The hashes of the tokens of some texts, one text behind the other, each as START, its words and END."""

    def __init__(self, texts: pa.ChunkedArray):
        parts, sizes = [], []
        for batch in texts.chunks:
            for at in range(0, len(batch), 512):
                for t in utf8(batch.slice(at, 512)):
                    ws = words(t)
                    sizes.append(len(ws) + 2)
                    parts.append(b"".join([_START, *map(xxhash.xxh64_digest, ws), _END]))
        self.tokens = np.frombuffer(b"".join(parts), ">u8").astype(np.uint64)
        self.ends = np.cumsum(np.array(sizes, np.int64))
        self.starts = self.ends - sizes

    def keys(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """The key of the n-gram of that order which ends at each token, and where there is one: not where it would begin before its text."""
        out, there = self.tokens.copy() if order > 1 else self.tokens, np.ones(len(self.tokens), bool)
        for n in range(1, order):
            for end in range(len(out), n, -BLOCK):  # from the end, as each key is made of the one before it
                at = max(n, end - BLOCK)
                out[at:end] = _after(out[at - 1 : end - 1], self.tokens[at:end])
            there[self.starts + n - 1] = False
        return out, there


def _packed(numbers: np.ndarray) -> bytes:
    """64-bit numbers as compressed bytes, the low bytes of all first: small numbers take little room."""
    return zstandard.compress(np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpacked(data: bytes, kind: type = np.int64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1).T).view(kind).ravel()


def _bounds(n_buckets: int) -> np.ndarray:
    """The first key of each bucket but the first."""
    return np.array([i * (1 << 64) // n_buckets for i in range(1, n_buckets)], np.uint64)


LISTED = "bucket int, chunk bigint, level int, grams binary, counts binary"


def _lists(group: pa.Table, levels: list[tuple[int, np.ndarray, np.ndarray]], n_buckets: int) -> pa.Table:
    """LISTED rows of a chunk for (level, keys, which are of training texts): the different keys of each bucket as their differences, ascending."""
    rows, bounds = [], _bounds(n_buckets)
    for level, keys, train in levels:
        found, n = np.unique(keys[train], return_counts=True)
        held = np.setdiff1d(keys[~train], found)
        if len(held):
            found, n = np.concatenate([found, held]), np.concatenate([n, np.zeros(len(held), n.dtype)])
            by = np.argsort(found)
            found, n = found[by], n[by]
        cuts = [0, *np.searchsorted(found, bounds), len(found)]
        rows += [(b, level, _packed(np.diff(found[i:j], prepend=np.uint64(0))), _packed(n[i:j].astype(np.int64))) for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if i < j]
    bucket, level, grams, counts = zip(*rows) if rows else ([], [], [], [])
    columns = [pa.array(bucket, pa.int32()), pa.array([group["chunk"][0].as_py()] * len(rows), pa.int64()), pa.array(level, pa.int32()), pa.array(grams, pa.binary()), pa.array(counts, pa.binary())]
    return pa.table(columns, names=["bucket", "chunk", "level", "grams", "counts"])


def _training(group: pa.Table, chunk: Chunk) -> np.ndarray:
    return np.repeat(np.array(group["train"].to_pylist(), bool), np.diff(chunk.ends, prepend=0))


def listed(texts: DataFrame, n_buckets: int) -> DataFrame:
    """(bucket, chunk, level, grams, counts): each chunk's different tokens and pairs by bucket, with their number in training texts."""

    def run(group: pa.Table) -> pa.Table:
        chunk = Chunk(group["text"])
        train, (pairs, there) = _training(group, chunk), chunk.keys(2)
        return _lists(group, [(1, chunk.tokens, train), (2, pairs[there], train[there])], n_buckets)

    return texts.groupBy("chunk").applyInArrow(run, LISTED)


def listed_triples(texts: DataFrame, known: DataFrame, n_buckets: int) -> DataFrame:
    """The same of three tokens whose first two are a state by ``known`` totals: others have no arcs of their own."""

    def run(group: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(group["text"])
        pairs, there = chunk.keys(2)
        _, of = _numbered(pairs, there)
        del pairs
        triples, there = _of_states(chunk, there & (_answered(answers, 2) >= STATE)[of])
        return _lists(group, [(3, triples[there], _training(group, chunk)[there])], n_buckets)

    return texts.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(run, LISTED)


def _of_states(chunk: Chunk, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of three tokens, and where there is one whose first two are a state; ``states`` tells of each token whether a pair that is one ends there."""
    keys, there = chunk.keys(3)
    return keys, there & np.roll(states, 1)


def _ascending(keys: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places where n-grams end, ascending by key, and which of them are the first with their key. A chunk's places fit 32 bits."""
    places = np.flatnonzero(there).astype(np.int32)
    found = keys[places]
    by = np.argsort(found)
    places, found = places[by], found[by]
    del by
    new = np.ones(len(found), bool)
    np.not_equal(found[1:], found[:-1], out=new[1:])
    return places, new


def _numbered(keys: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of a chunk, ascending by key: a place where each ends; and for each place the number of the n-gram that ends there, 0 where none does."""
    places, new = _ascending(keys, there)
    number = np.cumsum(new, dtype=np.int32)
    number -= 1
    of = np.zeros(len(keys), np.int32)
    of[places] = number
    return places[new], of


def _answered(answers: pa.Table, level: int) -> np.ndarray:
    """How often training texts have each of the n-grams that a chunk listed, in its order."""
    at = np.flatnonzero(answers["level"].to_numpy() == level)
    parts = [_unpacked(answers["totals"][int(i)].as_py()) for i in at[np.argsort(answers["bucket"].to_numpy()[at])]]
    return np.concatenate([np.zeros(0, np.int64), *parts])


def _summed(group: pa.Table, level: int):
    """The rows of one order in a bucket: row numbers, ends of their lists, the totals of their n-grams, and the totals of the different ones."""
    at = np.flatnonzero(group["level"].to_numpy() == level)
    lists = [np.cumsum(_unpacked(group["grams"][int(i)].as_py(), np.uint64), dtype=np.uint64) for i in at]
    counts = [_unpacked(group["counts"][int(i)].as_py()) for i in at]
    if not lists:
        return at, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    found, of = np.unique(np.concatenate(lists), return_inverse=True)
    total = np.bincount(of, weights=np.concatenate(counts), minlength=len(found)).astype(np.int64)
    return at, np.cumsum([len(x) for x in lists]), total[of], total, found


def corpus_size(lists: DataFrame) -> DataFrame:
    """(one, n_tokens, n_types) of all training texts, in one row."""

    def run(group: pa.Table) -> pa.Table:
        *_, total, found = _summed(group, 1)
        real = total[found != _START_KEY]
        return pa.table({"n_tokens": pa.array([int(real.sum())], pa.int64()), "n_types": pa.array([int((real > 0).sum())], pa.int64())})

    sizes = lists.groupBy("bucket").applyInArrow(run, "n_tokens bigint, n_types bigint")
    return sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"), F.coalesce(F.sum("n_types"), F.lit(0)).alias("n_types")).select(F.lit(1).alias("one"), "n_tokens", "n_types")


def totals(lists: DataFrame) -> DataFrame:
    """(chunk, bucket, level, totals): for each list the number of each of its n-grams in all training texts, in the list's order."""

    def run(group: pa.Table) -> pa.Table:
        rows = []
        for level in sorted(set(group["level"].to_pylist())):
            at, ends, each, *_ = _summed(group, level)
            rows += [(int(i), part) for i, part in zip(at, np.split(each, ends[:-1]))] if len(at) else []
        at = pa.array([i for i, _ in rows], pa.int64())
        return pa.table([*(group[c].take(at) for c in ("chunk", "bucket", "level")), pa.array([_packed(x) for _, x in rows], pa.binary())], names=["chunk", "bucket", "level", "totals"])

    return lists.groupBy("bucket").applyInArrow(run, "chunk bigint, bucket int, level int, totals binary")


def compiled(chunk: Chunk, answers: pa.Table, n_tokens: int, n_types: int, order: int) -> tuple[Automaton, np.ndarray, np.ndarray]:
    """The part of the automaton that a chunk's texts run through, how often each of their tokens occurs, and the number of each token in its place.

    States are the tokens that training texts have and, with ``order`` 3, the pairs they have STATE times."""
    _, tokens = _numbered(chunk.tokens, np.ones(len(chunk.tokens), bool))
    single = _answered(answers, 1)
    alone = np.log10((single + ADDED) / (n_tokens + ADDED * (n_types + 1)))
    keys, there = chunk.keys(2)
    at, of = _numbered(keys, there)
    del keys  # each array of a chunk's length is dropped as soon as it has served: they are what a task's memory goes to
    pair, triples = _answered(answers, 2), None
    if order > 2:
        places, new = _ascending(*_of_states(chunk, there & (pair >= STATE)[of]))
        last = places[new]
        del places, new
        triples = of[last - 1], of[last], _answered(answers, 3)
        del last
    del there, of
    if (len(single), len(pair)) != (tokens.max() + 1, len(at)) or triples and len(triples[0]) != len(triples[2]):
        raise RuntimeError("a chunk's texts aren't those it listed")
    return Automaton(single, alone, (tokens[at - 1], tokens[at], pair), triples, MASS, STATE), single, tokens


SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _scored(group: pa.Table, answers: pa.Table, order: int) -> pa.Table:
    chunk = Chunk(group["text"])
    n_tokens, n_types = answers["n_tokens"][0].as_py(), answers["n_types"][0].as_py()
    automaton, single, tokens = compiled(chunk, answers, n_tokens, n_types, order)
    del chunk.tokens  # their numbers stand for them from here on

    def summed(x: np.ndarray, kind: type) -> pa.Array:
        return pa.array(np.add.reduceat(x, chunk.starts, dtype=kind))

    base, known = automaton.alone[tokens], (single > 0)[tokens]
    base[chunk.starts], known[chunk.starts] = 0.0, False  # a START is given
    sums = [summed(known, np.int64), summed(base, np.float64)]
    del base, known
    sums.append(summed(automaton.walk(tokens, chunk.starts, chunk.ends), np.float64))
    columns = [group["doc_id"], group["held_out"], pa.array(chunk.ends - chunk.starts - 1), sums[0], pa.array(np.full(group.num_rows, n_tokens, np.int64)), *sums[1:]]
    return pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, chunk: int = CHUNK, bucket: int = BUCKET) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of ``docs``.

    Learned from the rows with crc32(doc_id) mod 10 other than 0 (a null doc_id is neither learned from nor held out). Null and
    empty texts are one END. Without a row to learn from every token has probability 1. Repeated rows get equal scores.

    The model has every token and pair of tokens that training texts have, and with ``order`` 3 every token behind a pair that is a state
    (STATE times or more), at any size. ``chunk`` and ``bucket`` bound what a task
    holds and change no score; a text is held whole. Chunks are dealt by a hash, so a frequent word, n-gram or text is in as many
    lists as there are chunks with it, once in each, and buckets are ranges of hashes: none is larger for a frequent n-gram.
    """
    rest = crc_remainder(F.col("doc_id"), 10)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0)).cast("bigint")).first()[0]
    cores = docs.sparkSession.sparkContext.defaultParallelism
    n_chunks = max(ceil(size / chunk), min(2 * cores, ceil(size / (4 << 20))), 1)
    n_buckets = max(ceil(size / 4 / bucket), min(2 * cores, ceil(size / (4 << 20))), 1)  # about as many different n-grams as a quarter of the bytes
    # The partition's number parts even repeated rows; each partition is dealt alike whenever it is computed.
    dealt = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(n_chunks)).alias("chunk")
    texts = rows.select(dealt, "doc_id", "text", F.coalesce(rest != 0, F.lit(False)).alias("train"), F.coalesce(rest == 0, F.lit(False)).alias("held_out")).repartition(n_chunks, "chunk")
    lists = listed(texts, n_buckets).repartition(n_buckets, "bucket")  # exchanges that are used twice are made once
    known = totals(lists).repartition(n_chunks, "chunk")
    if order > 2:
        triples = listed_triples(texts, known, n_buckets).repartition(n_buckets, "bucket")
        known = known.unionByName(totals(triples).repartition(n_chunks, "chunk"))
    known = known.withColumn("one", F.lit(1)).join(F.broadcast(corpus_size(lists)), "one").select("chunk", "bucket", "level", "totals", "n_tokens", "n_types")
    return texts.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(lambda group, answers: _scored(group, answers, order), SCORED)


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, over all documents, as ``scores`` says it for nulls, empty texts and repeated rows."""
    return scores(documents(spark, sf_dir))
