"""SimHash fingerprints of documents, their drift under edits, and search by permuted block tables."""

from __future__ import annotations

import hashlib
from itertools import combinations
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planwatch.llm.common import documents, written

BITS = 64
CHUNK = 1 << 15  # terms whose votes are counted at once
RADIUS = 3
BLOCKS = 6
_TURN, _MIX = np.uint64(31), np.uint64(0x9E3779B97F4A7C15)


def term_hashes(text: bytes) -> np.ndarray:
    """The 64-bit hashes of a text's terms: pairs of neighbouring words, the word itself if there is only one."""
    h = np.frombuffer(b"".join([xxhash.xxh64_digest(w) for w in text.lower().split()]), ">u8").astype(np.uint64)
    if len(h) > 1:
        h = (h[:-1] << _TURN | h[:-1] >> np.uint64(33)) ^ h[1:] * _MIX
        h = (h ^ h >> np.uint64(29)) * _MIX
        h ^= h >> np.uint64(32)
    return h


def fingerprint(text: bytes) -> int:
    """Each term votes on each bit, for it or against it, with weight 1 + log2 of how often it occurs. Unsigned."""
    terms, counts = np.unique(term_hashes(text), return_counts=True)
    votes, weights = np.zeros(BITS), 1 + np.log2(counts)
    for at in range(0, len(terms), CHUNK):
        bits = np.unpackbits(terms[at : at + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        more = np.flatnonzero(counts[at : at + CHUNK] > 1)
        votes += bits.sum(axis=0, dtype=np.int64) + (weights[at + more] - 1) @ bits[more]
    return int.from_bytes(np.packbits(votes * 2 > weights.sum()).tobytes(), "big")


def likeness(a: int, b: int) -> float:
    return 1 - (a ^ b).bit_count() / BITS


def _edited(text: str, following: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _bounds_below(x: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` lie below ``x``: runs of about the root of their number are counted first, then within one."""
    if not bounds:
        return F.lit(0)
    width = isqrt(len(bounds))
    runs = [F.array(*map(F.lit, bounds[i : i + width])) for i in range(0, len(bounds), width)]
    below = lambda values: F.size(F.filter(values, lambda b: b < x))
    begun = below(F.array(*map(F.lit, bounds[::width])))
    return F.when(begun == 0, 0).otherwise((begun - 1) * width + below(F.element_at(F.array(*runs), begun)))


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(part, doc_id, text, lent) in partitions by part, ordered by (doc_id, text): ``lent`` rows come last in a part and
    are the first of the next one, so each document's successor stands right behind it. The last is followed by the first.

    Parts are ranges of doc_id between quantiles, so no task sees more than its share, and texts are shuffled once. What
    the driver learns is a bound and a first id for each part.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.select(F.percentile_approx("doc_id", [i / n_parts for i in range(1, n_parts)] or [0.5], 10_000)).first()[0]
    bounds = sorted(set(cuts or []))
    part = F.when(F.col("doc_id").isNull(), 0).otherwise(_bounds_below(F.col("doc_id"), bounds) + 1)  # null ids first
    firsts = rows.select(part.alias("part"), "doc_id").groupBy("part").agg(F.min("doc_id").alias("first")).orderBy("part").collect()
    rows = rows.withColumn("part", part)
    if not firsts:
        return rows.withColumn("lent", F.lit(False))
    before = {b["part"]: a["part"] for a, b in zip([firsts[-1], *firsts], firsts)}
    first = {r["part"]: r["first"] for r in firsts}
    # Of a part's first document (rows may share an id) a copy goes to the part before.
    of_part = lambda d, kind: F.element_at(F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v).cast(kind))]), F.col("part"))
    lend, to = F.col("doc_id").eqNullSafe(of_part(first, "bigint")), of_part(before, "int")
    targets = F.when(lend, F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("lent")), F.struct(to.alias("part"), F.lit(True).alias("lent"))))
    targets = targets.otherwise(F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("lent"))))
    rows = rows.withColumn("at", F.explode(targets)).select("at.part", "doc_id", "text", "at.lent")
    return rows.repartition(n_parts, "part").sortWithinPartitions("part", "lent", "doc_id", "text")


def drift(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_chars, edited_sha256, fp, edited_fp, near_edited and near_next for each row of ``docs``.

    The edited text has its last quarter of code points replaced by the first as many of the next document, in order of
    doc_id, then text, null ids first; after the last comes the first. Null texts count as empty; a text without words has
    fingerprint 0. A lone row is its own successor. An empty table gives no rows.
    """

    def run(batches):
        held = None  # a row that waits for its successor: part, doc_id, text, fingerprint
        out: list[tuple] = []

        def pair(text: str, fp: int) -> None:
            part, doc_id, own, own_fp = held
            edited = _edited(own, text).encode()
            edited_fp = fingerprint(edited)
            out.append((doc_id, len(own), hashlib.sha256(edited).hexdigest(), f"{own_fp:016x}", f"{edited_fp:016x}", likeness(own_fp, edited_fp), likeness(own_fp, fp)))

        def flush():
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            columns = zip(*out) if out else [[] for _ in names]
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)
            out.clear()
            return batch

        for batch in batches:
            for part, doc_id, text, lent in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held and held[0] != part:
                    held = None
                if lent and held is None:
                    continue  # a lent row is a successor only
                fp = fingerprint(text.encode())
                if held:
                    pair(text, fp)
                held = None if lent else (part, doc_id, text, fp)
            yield flush()

    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, id_col, text_col).select("part", "doc_id", "text", "lent").mapInArrow(run, schema)


def _block_masks(n_blocks: int) -> list[int]:
    cuts = [round(i * BITS / n_blocks) for i in range(n_blocks + 1)]
    return [((1 << (e - s)) - 1) << s for s, e in zip(cuts, cuts[1:])]


def within_radius(fps: DataFrame, queries: DataFrame, radius: int = RADIUS, n_blocks: int = BLOCKS) -> DataFrame:
    """(query, fp, distance) for all distinct fingerprints ``fp`` (hex) within ``radius`` bits of a distinct ``query`` (hex). Exact.

    Of n_blocks blocks at least n_blocks - radius agree in a close pair. Each table permutes one such choice of blocks
    to the front and looks it up by equality; a pair is reported by the first table that finds it.
    """
    if not 0 <= radius < n_blocks <= BITS:
        raise ValueError("there must be more blocks than bits may differ")
    masks, k = _block_masks(n_blocks), n_blocks - radius
    signed = lambda x: x - (1 << BITS) if x >> (BITS - 1) else x
    tables = [F.struct(F.lit(t).alias("t"), F.lit(c[-1]).alias("last"), F.col("x").bitwiseAND(F.lit(signed(sum(masks[i] for i in c)))).alias("key")) for t, c in enumerate(combinations(range(n_blocks), k))]
    number = lambda c: F.expr(f"cast(conv({c}, 16, -10) as bigint)")

    def keyed(df: DataFrame, column: str) -> DataFrame:
        return df.select(number(column).alias("x")).distinct().withColumn("e", F.explode(F.array(*tables))).select("x", "e.*")

    a, b = keyed(queries, "query").alias("a"), keyed(fps, "fp").alias("b")
    differing = F.col("a.x").bitwiseXOR(F.col("b.x"))
    agree = sum(((differing.bitwiseAND(F.lit(signed(m))) == 0) & (F.lit(i) <= F.col("a.last"))).cast("int") for i, m in enumerate(masks))
    found = a.join(b, (F.col("a.t") == F.col("b.t")) & (F.col("a.key") == F.col("b.key")) & (F.bit_count(differing) <= radius) & (agree == k))
    text = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return found.select(text("a.x").alias("query"), text("b.x").alias("fp"), F.bit_count(differing).cast("int").alias("distance"))


def op8_simhash_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and near_docs: for each doc_id that 50 divides, the other rows within the radius; else null."""
    rows = written(drift(documents(spark, sf_dir)), "fingerprints")
    sizes = rows.groupBy("fingerprint").agg(F.count("*").alias("n"))
    asked = rows.where("doc_id % 50 = 0").select(F.col("fingerprint").alias("query")).distinct()
    found = within_radius(rows.select(F.col("fingerprint").alias("fp")), asked).join(sizes, F.col("fp") == F.col("fingerprint"))
    near = found.groupBy("query").agg((F.sum("n") - 1).alias("near_docs"))
    joined = rows.join(near.withColumnRenamed("query", "fingerprint"), "fingerprint", "left")
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return joined.select(*columns, F.when(F.col("doc_id") % 50 == 0, F.col("near_docs")).alias("near_docs"))
