"""SimHash near-duplicates, with pivot distance tables to discard candidate pairs."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from planwatch.llm import grams
from planwatch.llm.common import Numbered, documents, sized, slices, utf8, written
from planwatch.llm.graph import components

BITS = 64
PIVOTS = 16  # reference fingerprints, eight distances to a long
CHUNK = 1 << 15  # shingles whose bits are counted at once
CHUNK_BYTES = 6 << 20  # of texts that a task holds at a time
BUCKET = 1_500_000  # listed shingles that a task counts at a time


def _shingles(text: bytes, width: int) -> tuple[bytes, list[int], list[int]]:
    """The words joined by spaces, with the starts and ends of the shingles; a text of fewer words is one shingle, one without words none."""
    words = text.lower().split()  # bytes.lower() touches A-Z only
    n = len(words)
    joined = b" ".join(words)
    if n <= width:
        return joined, [0] * bool(n), [len(joined)] * bool(n)
    sizes = np.fromiter(map(len, words), np.int64, n)
    after = np.cumsum(sizes + 1) - 1
    return joined, (after - sizes)[: n - width + 1].tolist(), after[width - 1 :].tolist()


def fingerprint(text: bytes, width: int = 4) -> int:
    """The SimHash of a text's word shingles, as a signed 64-bit number; 0 for a text without words."""
    joined, starts, ends = _shingles(text, width)
    if not starts:
        return 0
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), CHUNK):
        hashes = b"".join([xxhash.xxh64_digest(joined[s:e], 42) for s, e in zip(starts[at : at + CHUNK], ends[at : at + CHUNK])])
        votes += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(starts)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, fp) for each row. A null text counts as empty; other columns are not read."""

    def run(batches):
        for batch in slices(batches):
            fps = [fingerprint(t, width) for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id bigint, fp bigint")


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _blocks(n_blocks: int) -> list[int]:
    """Masks of n_blocks runs of bits that cover 64 bits."""
    cuts = [round(i * BITS / n_blocks) for i in range(n_blocks + 1)]
    return [((1 << (e - s)) - 1) << s for s, e in zip(cuts, cuts[1:])]


def _blocks_for(n: int, radius: int) -> int:
    """The fewest blocks for which what must agree has about as many values as there are fingerprints."""
    return next((m for m in range(radius + 2, 17) if BITS * (m - radius) / m >= log2(max(n, 2))), 16)


def _pivot_table() -> list[Column]:
    """Hamming distances of ``fp`` to the reference fingerprints, packed eight to a long."""
    refs = [_signed(xxhash.xxh64_intdigest(f"pivot {i}".encode(), 42)) for i in range(PIVOTS)]
    far = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(r))).cast("bigint") for r in refs]
    return [sum((F.shiftleft(far[g + i], 8 * i) for i in range(1, 8)), far[g]).alias(f"pivots{g // 8}") for g in range(0, PIVOTS, 8)]


def _near(radius: int) -> Column:
    """No pivot coordinate of x and y differs by more than radius, and the fingerprints themselves do not."""
    byte = lambda side, i: F.shiftrightunsigned(F.col(f"{side}.pivots{i // 8}"), 8 * (i % 8)).bitwiseAND(F.lit(255))
    ok = F.lit(True)
    for i in range(PIVOTS):
        ok = ok & (F.abs(byte("x", i) - byte("y", i)) <= radius)
    return ok & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= radius)


def links(distinct: DataFrame, radius: int = 4, n_blocks: int | None = None, hot: int = 1024) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fp``, whose components are those of all pairs within ``radius``.

    A metric table can discard pairs but not find them, so candidates come from blocks: of m blocks, at least
    m - radius agree in a close pair. Rows meet on each choice of so many blocks; a pair is looked at in the first of its
    choices only. The pivot table then discards by the largest coordinate difference, and what survives is verified.
    m grows with the number of fingerprints, so that a bucket stays small.

    A bucket of more than ``hot`` fingerprints (a large group of near copies) is not paired. Its members list the
    points at half the radius around them instead: two fingerprints are within the radius just if they share such
    a point, and each point links its members to their smallest. This is exact and grows with the group, not its square.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    m = n_blocks or _blocks_for(distinct.count(), radius)
    masks, k = _blocks(m), m - radius
    tables = [F.struct(F.lit(t).alias("t"), F.lit(c[-1]).alias("last"), F.col("fp").bitwiseAND(F.lit(_signed(sum(masks[i] for i in c)))).alias("key")) for t, c in enumerate(combinations(range(m), k))]
    rows = distinct.select("fp", *_pivot_table()).withColumn("e", F.explode(F.array(*tables))).select("fp", "pivots0", "pivots1", "e.*")
    sizes = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")  # no task holds a bucket
    # Spark sizes what explode made as if it were the fingerprints, and would broadcast all of it; a merge is dealt by key whatever the sizes.
    rows = rows.join(sizes.hint("merge"), ["t", "key"])
    cold, crowd = rows.where(F.col("n") <= hot), rows.where(F.col("n") > hot).select("fp").distinct()
    differing = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    agree = sum(((differing.bitwiseAND(F.lit(_signed(mask))) == 0) & (F.lit(i) <= F.col("x.last"))).cast("int") for i, mask in enumerate(masks))
    same = (F.col("x.t") == F.col("y.t")) & (F.col("x.key") == F.col("y.key"))
    paired = cold.alias("x").join(cold.alias("y").hint("merge"), same & (F.col("x.fp") < F.col("y.fp")) & _near(radius) & (agree == k)).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    around = crowd.withColumn("point", F.col("fp")).withColumn("i", F.lit(-1))
    for _ in range(radius // 2):  # flips one more bit, or none (64)
        around = around.withColumn("i", F.explode(F.expr("if(i < 64, sequence(i + 1, 64), array(64))"))).withColumn("point", F.expr("if(i < 64, point ^ shiftleft(1L, i), point)"))
    starred = around.withColumn("a", F.min("fp").over(W.partitionBy("point"))).where("a < fp").select("a", F.col("fp").alias("b"))
    return paired.unionByName(starred.distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, n_blocks: int | None = None, hot: int = 1024) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``.

    Fingerprints within ``radius`` bits are linked; component_id is the smallest doc_id reachable by links, itself included.
    Null and empty texts have fingerprint zero and link like any other. Repeated rows stay and share a component. A null
    doc_id never names a component: where no member has an id, component_id is null. An empty table gives no rows.
    """
    fps = written(fingerprints(docs, id_col, text_col, width), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct-fingerprints")
    roots = components(links(nodes, radius, n_blocks, hot))
    linked = nodes.join(roots.withColumnRenamed("node", "fp"), "fp")
    named = linked.join(linked.groupBy("root").agg(F.min("least_id").alias("component_id")), "root").select("fp", "component_id")
    named = nodes.join(named.withColumn("linked", F.lit(True)), "fp", "left").select("fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least_id")).alias("component_id"))
    named = written(named, "components")  # so that both sides of the join are dealt anew, and a fingerprint of many copies can be split
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns over all documents, as ``near_duplicates`` says it for nulls, empty texts and repeated rows."""
    return near_duplicates(documents(spark, sf_dir))


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """The different 64-bit hashes of each text's word shingles, ascending; a text of fewer words is one shingle, one without words has none."""
    words = grams.Words([t.lower() for t in texts])  # bytes.lower() touches A-Z only
    h = words.hashes()
    r = grams.rolled(h, width)
    sets = []
    for a, b in zip(words.firsts.tolist(), words.firsts[1:].tolist()):
        sets.append(np.unique(r[a : b - width + 1]) if b - a >= width else grams.rolled(h[a:b], b - a)[:1])
    return sets


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with the sizes of their shingle sets' intersection and union, common and all."""
    sides = [sets.select(F.col("node").alias(x), F.col("shingles").alias(f"of_{x}")) for x in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b").withColumn("common", F.size(F.array_intersect("of_a", "of_b")))
    return both.select("a", "b", "common", (F.size("of_a") + F.size("of_b") - F.col("common")).alias("all"))


_LISTED = grams.LISTED.format("grams binary, counts binary")
_RARITY = 8  # steps a doubling of how many sets have a shingle


def _listed_sets(group: pa.Table, width: int, bits: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The shingle sets of a chunk's texts, and the high bits of their hashes: the different ones, which of them each shingle has, and in how many sets they are."""
    sets = shingle_sets(list(utf8(group["text"])), width)
    keys, of, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]) >> np.uint64(64 - bits), return_inverse=True, return_counts=True)
    return sets, keys, of, n


def _rarities(group: pa.Table) -> pa.Table:
    """Of a bucket's lists: how rare each shingle is, from 0 for one that a single set has."""
    _, of = np.unique(np.concatenate([grams.unpacked_ascending(x.as_py()) for x in group["grams"]]), return_inverse=True)
    n = np.bincount(of, weights=np.concatenate([grams.unpacked(x.as_py()) for x in group["counts"]]))
    return grams.answers(group, np.minimum(np.ceil(_RARITY * np.log2(n)), 255).astype(np.uint8)[of], grams.packed_bytes)


def prefixes(texts: DataFrame, width: int, similarity: float, chunk: int, bucket: int) -> DataFrame:
    """(key, node, size, pos) of (node, text): the shingles of each set that a similar one must share one of, rarest first, without those that no other set has.

    Sets are ordered by how many sets have a shingle (in steps, of the high bits of its hash), then by hash. Of two sets as similar, the first shingle in
    common is within the first n - similarity * n + 1 of either. Chunks list what they have, buckets of hashes answer with the rarity.
    """
    rows, n_chunks, size = grams.dealt(texts, chunk, "node")
    bits = min(64, ceil(log2(max(size, 2) / 4)) + 8)
    n_buckets = max(ceil(size / 6 / bucket), min(n_chunks, ceil(size / (4 << 20))), 1)

    def listed(group: pa.Table) -> pa.Table:
        _, keys, _, n = _listed_sets(group, width, bits)
        return grams.lists(group["chunk"][0].as_py(), grams.cuts(keys, n_buckets, bits), {"grams": (grams.packed_ascending, keys), "counts": (grams.packed, n.astype(np.int64))})

    def first(group: pa.Table, rarities: pa.Table) -> pa.Table:
        sets, keys, of, _ = _listed_sets(group, width, bits)
        rarity, at, parts = grams.answered(rarities, len(keys), grams.unpacked_bytes)[of], 0, []
        for node, x in zip(group["node"].to_pylist(), sets):
            own, at = rarity[at : at + len(x)], at + len(x)
            order = np.lexsort((x, own))[: len(x) - ceil(similarity * len(x) - 1e-9) + 1]
            pos = np.flatnonzero(own[order] > 0)
            parts.append((x[order][pos], np.full(len(pos), node), np.full(len(pos), len(x)), pos))
        key, node, n, pos = (np.concatenate([np.zeros(0, np.int64), *(np.asarray(c).view(np.int64) for c in x)]) for x in zip(*parts))
        return pa.table({"key": key, "node": node, "size": n, "pos": pos})

    each = rows.groupBy("chunk")
    rarities = each.applyInArrow(listed, _LISTED).repartition(n_buckets, "bucket").groupBy("bucket").applyInArrow(_rarities, grams.ANSWERED).repartition(n_chunks, "chunk")
    return each.cogroup(rarities.groupBy("chunk")).applyInArrow(first, "key bigint, node bigint, size bigint, pos bigint")


def _fingerprint_pairs(texts: DataFrame, width: int, radius: int = 4) -> DataFrame:
    """(a, b) of texts (node, text) that operator 1 links: each with the first of its fingerprint, and the firsts of fingerprints within ``radius``, found by blocks and told
    apart by their distances to the pivots."""
    fps = written(fingerprints(texts, "node", "text", width).withColumnRenamed("doc_id", "node"), "fingerprints")
    firsts = written(fps.groupBy("fp").agg(F.min("node").alias("first")), "distinct-fingerprints")
    same = fps.join(firsts, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    of = lambda c: firsts.select(F.col("fp").alias(c), F.col("first").alias(f"of_{c}"))
    near = links(firsts.select("fp"), radius).join(of("a"), "a").join(of("b"), "b")
    return same.unionByName(near.select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b")))


def near_copies(rows: DataFrame, id_col: str, text_col: str, row_col: str = "row", width: int = 5, similarity: float = 0.8, chunk: int = CHUNK_BYTES, bucket: int = BUCKET) -> DataFrame:
    """(node, least) for each different set of word shingles: node is the row number of the first row with that set, least the first row of
    the component, as a struct whose ``row`` is its number. Rows come first by doc_id, those without one last, then by number.

    Sets with at least that Jaccard similarity are linked, without loss. Texts without words share the empty set, which links to none.
    The first candidates are those that operator 1 links, by SimHash fingerprints and pivots. Similar sets may differ in more bits than it reaches; for these
    candidates share a shingle of their ``prefixes``, are of like size, and have enough shingles left behind it: for the first shingle that two
    sets share this bounds what they share, so texts that only share frequent shingles are no pair. They are verified by their exact similarity. Members of
    a shingle's bucket are verified against three of them first (the one that has it earliest, and two by hash), which is linear and joins a large group of near
    copies; then only pairs whose groups are still apart are, and whose distances to these three allow it.
    """
    texts = rows.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(row_col).alias("row"), F.col(text_col).cast("string").alias("text"))

    def hashed(batches):
        for batch in slices(batches):
            sets = [xxhash.xxh3_128_digest(x.tobytes()) for x in shingle_sets(list(utf8(batch.column(2))), width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], names=["doc_id", "row", "set"])

    def unrolled(batches):
        for batch in slices(batches):
            sets = shingle_sets(list(utf8(batch.column(1))), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["node", "shingles"])

    sets = texts.mapInArrow(hashed, "doc_id bigint, row bigint, set binary")
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row")
    nodes = sets.groupBy("set").agg(F.min(place).alias("first"))
    nodes = written(nodes.select(F.col("first.row").alias("node"), "first"), "distinct-sets")
    once = lambda some: texts.join(sized(some), F.col("row") == F.col("node")).select("node", F.coalesce("text", F.lit("")).alias("text"))

    found = written(prefixes(once(nodes.select("node")), width, similarity, chunk, bucket), "prefixes")
    one, by = F.struct("node", "size", "pos"), F.xxhash64("node", "key")
    pivots = F.array_distinct(F.array(F.min_by(one, F.struct(F.col("pos") / F.col("size"), "node")), F.min_by(one, by), F.max_by(one, by)))
    pivots = found.groupBy("key").agg(pivots.alias("pivots"), F.count("*").alias("n")).where("n > 1")  # no task holds a bucket
    members = written(found.join(pivots, "key").select("key", "node", "size", "pos", "pivots"), "buckets")

    def may(x, y):
        """Two sets whose first common shingle is at these places can be as similar."""
        left = F.least(x("size") - x("pos"), y("size") - y("pos"))
        return (F.least(x("size"), y("size")) >= similarity * F.greatest(x("size"), y("size")) - 1e-9) & (left * (1 + similarity) >= similarity * (x("size") + y("size")) - 1e-9)

    of = lambda side: lambda c: F.col(f"{side}{c}")
    to_pivots = members.select("node", "size", "pos", F.explode("pivots").alias("p")).where((F.col("p.node") != F.col("node")) & may(of(""), of("p.")))
    to_pivots = to_pivots.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b"))
    to_pivots = written(to_pivots.unionByName(_fingerprint_pairs(once(nodes.select("node")), width)).distinct(), "pairs-with-pivots")

    def arrays(*pairs: DataFrame) -> DataFrame:
        wanted = [p.select(F.col(c).alias("node")) for p in pairs for c in "ab"]
        return written(once(written(reduce(DataFrame.unionByName, wanted).distinct(), "wanted")).mapInArrow(unrolled, "node bigint, shingles array<bigint>"), "shingles")

    alike = lambda measured: measured.where(F.col("common") >= similarity * F.col("all")).select("a", "b")
    measured = written(_measured(to_pivots, arrays(to_pivots)), "pivot-similarities")
    linked = written(alike(measured), "links-to-pivots")
    grouped = members.join(components(linked), "node", "left").select("key", "node", "size", "pos", "pivots", F.coalesce("root", "node").alias("root"))
    mixed = grouped.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    grouped = written(grouped.join(mixed, "key", "left_semi"), "mixed-buckets")
    # Jaccard distance is a metric: a pair whose distances to a pivot differ by more than a link may be long is none.
    far = grouped.select("key", "node", F.posexplode("pivots").alias("i", "p")).select("key", "node", "i", F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b"))
    far = far.join(measured, ["a", "b"], "left").withColumn("d", F.when(F.col("a") == F.col("b"), 0.0).otherwise(1 - F.col("common") / F.col("all")))
    far = far.groupBy("key", "node").agg(*[F.max(F.when(F.col("i") == i, F.col("d"))).alias(f"d{i}") for i in range(3)])
    placed = written(grouped.drop("pivots").join(far, ["key", "node"]), "pivot-distances")
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.root") < F.col("y.root")) & may(of("x."), of("y."))
    for i in range(3):
        apart = apart & F.coalesce(F.abs(F.col(f"x.d{i}") - F.col(f"y.d{i}")) <= 1 - similarity + 1e-9, F.lit(True))
    rest = written(placed.alias("x").join(placed.alias("y"), apart).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct(), "pairs-apart")
    roots = written(components(linked.unionByName(alike(_measured(rest, arrays(rest))))), "roots")
    named = nodes.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return named.join(named.groupBy("root").agg(F.min("first").alias("least")), "root").select("node", "least")


def keep_one_of_each_group(docs: DataFrame) -> DataFrame:
    """Pipeline stage: of each group of near copies (five words, similarity 0.8) one row stays, the one with the smallest doc_id.

    Rows without an id come last, and of rows that share an id or have none the first as the table is written counts: repeated rows are copies of
    each other, two different texts under one id are not. Null and empty texts are copies of each other too. Other columns stay as they
    are, whatever their names; an empty table gives no rows.
    """
    own = Numbered(docs, "to-dedup")
    kept = written(near_copies(own.rows, own.of("doc_id"), own.of("text")).where("node = least.row").select(F.col("node").alias("kept")), "kept")
    return own.named(own.rows.join(sized(kept), F.col("row") == F.col("kept"), "left_semi"))
