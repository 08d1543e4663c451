"""Words of many texts at once as numpy arrays, hashes of their n-grams, and lists of hashes that tasks exchange.

A chunk (some texts) sends each bucket (a range of hashes) one row, however many n-grams there are, and gets one row back: what the
bucket knows of each, in the order of the list. So no key is hot, as a chunk lists it once, and nothing is broadcast.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = b" \t\n\v\f\r"
BLOCK = 1 << 20  # bytes whose words are hashed at once

U = np.uint64
#: Odd multipliers: of a byte's place in its word (two, for two hashes), of a word's length, of a word's place in an n-gram.
_IN_WORD, _LENGTH, _IN_GRAM = (U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)), U(0xA0761D6478BD642F), 0xE7037ED1A0B428DB


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Words:
    """The words of some texts, one text behind the other: where they start and end in ``bytes``, and the text they are of."""

    def __init__(self, texts: list[bytes], blanks: bytes = BLANKS):
        self.bytes = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        table = np.ones(256, bool)
        table[list(blanks)] = False
        self.inside = table[self.bytes]
        edges = np.flatnonzero(np.diff(self.inside, prepend=False))  # every text is followed by a blank, so words end
        self.starts, self.ends = edges[::2], edges[1::2]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.text_ends = np.cumsum(sizes)
        #: The first word of each text, and behind the last one the number of words.
        self.firsts = np.searchsorted(self.starts, np.concatenate([[0], self.text_ends]))
        self.counts = np.diff(self.firsts)

    def hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit hash of each word; 1 gives others than 0."""
        out = np.empty(len(self.starts), U)
        cuts = np.unique(np.searchsorted(self.starts, np.arange(0, len(self.bytes), BLOCK)))
        for i, j in zip(cuts, [*cuts[1:], len(self.starts)]):
            if i == j:
                continue
            a, starts = self.starts[i], self.starts[i:j]
            part, after = self.bytes[a : self.ends[j - 1]], np.append(starts[1:], self.ends[j - 1])
            place = np.arange(a, self.ends[j - 1]) - np.repeat(starts, after - starts)
            powers = np.cumprod(np.full(int(place.max()) + 1, _IN_WORD[which], U))
            values = np.where(self.inside[a : self.ends[j - 1]], part.astype(U) * powers[place], U(0))
            out[i:j] = np.add.reduceat(values, starts - a) + (self.ends[i:j] - starts).astype(U) * _LENGTH
        return mixed(out)

    def whole(self, width: int) -> np.ndarray:
        """Whether so many words from each word on are of its text."""
        return np.arange(len(self.starts)) + width <= np.repeat(self.firsts[1:], self.counts)


def rolled(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` numbers of ``h``, of the run that starts there; what starts later than a run fits is not to be read."""
    n, out, size, at = len(h), np.zeros(len(h), U), 1, 0
    power = h.copy()  # the hash of ``size`` numbers from each on
    while size <= width:
        if width & size:
            out[: max(n - at, 0)] += power[at:] * U(pow(_IN_GRAM, at, 1 << 64))
            at += size
        longer = power.copy()
        longer[: max(n - size, 0)] += power[size:] * U(pow(_IN_GRAM, size, 1 << 64))
        power, size = longer, 2 * size
    return mixed(out)


def packed(numbers: np.ndarray) -> bytes:
    """64-bit numbers as compressed bytes, the low bytes of all first: small numbers take little room."""
    return zstandard.compress(np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(data: bytes, kind: type = np.int64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1).T).view(kind).ravel()


def packed_ascending(numbers: np.ndarray) -> bytes:
    return packed(np.diff(numbers, prepend=U(0)))


def unpacked_ascending(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, U), dtype=U)


def packed_bytes(numbers: np.ndarray) -> bytes:
    return zstandard.compress(numbers.tobytes(), 1)


def unpacked_bytes(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), np.uint8, n)


def packed_flags(flags: np.ndarray) -> bytes:
    return packed_bytes(np.packbits(flags))


def unpacked_flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.decompress(data), np.uint8), count=n).astype(bool)


def cuts(ascending: np.ndarray, n_buckets: int, bits: int = 64) -> list[int]:
    """Where the part of each bucket starts in numbers of so many bits, and the end."""
    bounds = np.array([-(-(i << bits) // n_buckets) for i in range(1, n_buckets)], U)
    return [0, *np.searchsorted(ascending, bounds).tolist(), len(ascending)]


LISTED = "bucket int, chunk bigint, size bigint, {}"


def lists(chunk: int, at: list[int], columns: dict) -> pa.Table:
    """A row for each bucket that has any of a chunk's numbers: bucket, chunk, size, and each column packed by its function."""
    there = [(b, i, j) for b, (i, j) in enumerate(zip(at, at[1:])) if i < j]
    made = {name: pa.array([pack(numbers[i:j]) for _, i, j in there], pa.binary()) for name, (pack, numbers) in columns.items()}
    return pa.table({"bucket": pa.array([b for b, *_ in there], pa.int32()), "chunk": pa.array([chunk] * len(there), pa.int64()), "size": pa.array([j - i for _, i, j in there], pa.int64())} | made)


ANSWERED = "chunk bigint, bucket int, size bigint, answers binary"


def answers(group: pa.Table, values: np.ndarray, pack=packed_flags) -> pa.Table:
    """What a bucket says of the numbers of its lists, one list behind the other."""
    ends = np.cumsum(group["size"].to_numpy())
    made = pa.array([pack(x) for x in np.split(values, ends[:-1])], pa.binary())
    return pa.table([group["chunk"], group["bucket"], group["size"], made], names=["chunk", "bucket", "size", "answers"])


def answered(group: pa.Table, n: int, unpack=unpacked_flags) -> np.ndarray:
    """What buckets say of the ``n`` numbers that a chunk listed, in its order."""
    order = np.argsort(group["bucket"].to_numpy())
    parts = [unpack(group["answers"][int(i)].as_py(), group["size"][int(i)].as_py()) for i in order]
    values = np.concatenate([unpack(packed_bytes(np.zeros(0, np.uint8)), 0), *parts])
    if len(values) != n:
        raise RuntimeError("a chunk's texts aren't those it listed")
    return values


def dealt(rows: DataFrame, chunk: int, *by: str | Column) -> tuple[DataFrame, int, int]:
    """``rows`` (with text) in chunks of about so many bytes, the number of chunks, and the bytes of all texts.

    Chunks are dealt by a hash of ``by``. With the partition's number in it even repeated rows part, and a partition is dealt alike whenever it is computed.
    """
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0)).cast("bigint")).first()[0]
    cores = rows.sparkSession.sparkContext.defaultParallelism
    n_chunks = max(ceil(size / chunk), min(2 * cores, ceil(size / (4 << 20))), 1)
    named = rows.withColumn("chunk", F.pmod(F.xxhash64(*by), F.lit(n_chunks)))
    return named.repartition(n_chunks, "chunk"), n_chunks, size


def by_bytes(batches, column: int, limit: int = 4 << 20):
    """The batches in parts of about so many bytes of a text column, a row at least."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, end - at)
            at = end
