"""Two readings of a price: status, review, recomputation from the pattern of its peers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAME = 0.005
SLACK = 1.2  # over what rounding to cents explains
APART = 0.03  # two estimates may differ by so much
PEERS = 2
TRANSITIONS = 6


def status(a: Column, b: Column, same: float = SAME) -> Column:
    """confirmed, divergent, only_a, only_b; null if neither reader has a price."""
    return F.when(a.isNotNull() & b.isNotNull(), F.when(F.abs(a - b) < same, "confirmed").otherwise("divergent")).when(a.isNotNull(), "only_a").when(b.isNotNull(), "only_b")


def effective(chosen: Column, a: Column, b: Column) -> Column:
    return F.coalesce(chosen, a, b)


def needs_review(cells: DataFrame, findings: DataFrame, column: list[str], dual: bool = True) -> DataFrame:
    """``cells`` (column, band, status) with review: divergent, read once where two readers were at work, or named by a finding
    (column, severity, bands) that is an error or alert; a finding that names no band is about the whole column."""
    f = findings.where(F.col("severity").isin("error", "alert"))
    whole = f.where(F.size("bands") == 0).select(*column).distinct().withColumn("_whole", F.lit(True))
    one = f.select(*column, F.explode("bands").alias("band")).distinct().withColumn("_one", F.lit(True))
    alone = F.col("status").isin("only_a", "only_b") if dual else F.lit(False)
    review = (F.col("status") == "divergent") | alone | F.coalesce("_whole", F.lit(False)) | F.coalesce("_one", F.lit(False))
    return cells.join(whole.hint("merge"), column, "left").join(one.hint("merge"), [*column, "band"], "left").withColumn("review", review).drop("_whole", "_one")


#: Which bands two columns of one pattern can differ in, by the bits of the transitions that differ: a band touches those into and out of it.
_BANDS_OF = {0: range(10)} | {1 << i: (i - 1, i) for i in range(1, 10)} | {3 << i: (i,) for i in range(1, 9)}
_TELLS = np.array([[b in _BANDS_OF.get(d, ()) for d in range(1 << 10)] for b in range(10)])
_PAIRS = 1 << 17  # that a task compares at a time


class _Columns:
    """Prices (rows, 10) with what is there of them, and their transitions: the ratio of each price to the one before it, and how much of it rounding explains."""

    def __init__(self, price: np.ndarray, there: np.ndarray):
        nonzero = there & (price != 0)
        with np.errstate(all="ignore"):
            error = 0.005 / price
            self.ratio, self.error = price[:, 1:] / price[:, :-1], error[:, :-1] + error[:, 1:]
        self.moved, self.exact = there[:, 1:] & nonzero[:, :-1], nonzero[:, 1:] & nonzero[:, :-1]

    def of(self, rows) -> _Columns:
        part = object.__new__(_Columns)
        part.ratio, part.error, part.moved, part.exact = (c[rows] for c in (self.ratio, self.error, self.moved, self.exact))
        return part


def _agreeing(x: _Columns, y: _Columns, others: np.ndarray) -> np.ndarray:
    """(rows of x, rows of y): the bits of the transitions in which two columns differ, -1 for pairs with too few to compare or that are none."""
    with np.errstate(all="ignore"):
        off = np.abs(x.ratio[:, None] / y.ratio - 1)
        near = off <= SLACK * (x.error[:, None] + y.error)
    comparable = x.exact[:, None] & (y.exact & (y.ratio != 0))
    differ = (comparable & ~near) @ (2 << np.arange(9))
    return np.where(others & (comparable.sum(axis=2) >= TRANSITIONS), differ, -1)


def _medians(peers: np.ndarray, values: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of peers (bands, rows, columns) the medians (bands, rows) of those ``values`` (bands, columns) that are there, and whether there is one."""
    told = peers & there[:, None]
    ordered, n = np.sort(np.where(told, values[:, None], np.nan), axis=2), told.sum(axis=2)
    low, high = (np.take_along_axis(ordered, np.clip(at, 0, ordered.shape[2] - 1)[:, :, None], 2)[:, :, 0] for at in ((n - 1) // 2, n // 2))
    return (low + high) / 2, n > 0


def _estimates(x: _Columns, x_codes: np.ndarray, x_keys: np.ndarray, y: _Columns, y_codes: np.ndarray):
    """One document's (row of x, band, support, up, whether it is there, down, whether it is there), where there are peers enough."""
    rows, edge = max(1, _PAIRS // max(len(y_codes), 1)), np.zeros((1, len(y_codes)))
    order = np.argsort(x_keys, kind="stable")
    whole = np.append(np.flatnonzero(np.diff(x_keys[order], prepend=-1)), len(order))
    single = np.diff(whole) == 1
    alone = order[whole[:-1][single]]
    parts = [(alone[at : at + rows], False) for at in range(0, len(alone), rows)] + [(order[a:b], True) for a, b in zip(whole[:-1][~single], whole[1:][~single])]
    rise, fall = (np.concatenate([edge, y.ratio.T]), np.concatenate([edge > 0, y.moved.T])), (np.concatenate([y.ratio.T, edge]), np.concatenate([y.moved.T, edge > 0]))
    for part, together in parts if len(y_codes) else []:
        differ = _agreeing(x.of(part), y, x_codes[part, None] != y_codes)
        peers, up, down = _TELLS[:, differ] & (differ >= 0), rise, fall
        if together:  # rows of one key count as one
            peers, up, down = peers.reshape(10, 1, -1), [np.tile(c, len(part)) for c in up], [np.tile(c, len(part)) for c in down]
        support = peers.sum(axis=2)
        of = [np.broadcast_to(c, (10, len(part))) for c in (support, *_medians(peers, *up), *_medians(peers, *down))]
        band, at = np.nonzero(of[0] >= PEERS)
        yield part[at], band, *(c[band, at] for c in of)


def recompute(columns: DataFrame, doc: str, column: str, prices: str = "prices", peers: DataFrame | None = None, trial: list[str] | None = None) -> DataFrame:
    """(doc, column, band, value, support): what each price should be by the ratios of the columns that share its pattern.

    A peer has at least six comparable transitions and differs from the column in none but those that touch the band. Two peers are
    needed. The medians of their ratios give an estimate from the band below and one from above, which must agree. Columns
    are compared within a document only: documents are dealt as they hash and read one behind the other, so a task holds the columns of one, and
    a bounded number of its pairs at a time.

    ``peers`` (doc, column, prices) are what columns are compared with, where these are not each other; ``trial`` names further keys of ``columns``, so
    that several versions of one column can be tried, each by itself. The result then has these keys, too.
    """
    trial = trial or []
    flat = [F.get(F.col(prices), F.lit(i)).cast("double").alias(f"p{i}") for i in range(10)]
    own = columns.select(F.col(doc).alias("d"), F.col(column).alias("c"), *[F.col(t).alias(f"t{i}") for i, t in enumerate(trial)], *flat, F.lit(True).alias("x"), F.lit(peers is None).alias("y"))
    if peers is not None:
        none = [F.lit(None).cast(columns.schema[t].dataType).alias(f"t{i}") for i, t in enumerate(trial)]
        own = own.unionByName(peers.select(F.col(doc).alias("d"), F.col(column).alias("c"), *none, *flat, F.lit(False).alias("x"), F.lit(True).alias("y")))
    keys = ["d", "c", *[f"t{i}" for i in range(len(trial))]]
    whole = F.col("d").isNotNull() & F.col("c").isNotNull()
    for k in keys[2:]:
        whole = whole & (F.col(k).isNotNull() | ~F.col("x"))
    spark = columns.sparkSession  # the rows are few for the work they make, so they are not left to be merged
    tasks = min(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = own.where(whole).repartition(tasks, "d").sortWithinPartitions("d")

    def told(table: pa.Table) -> pa.RecordBatch:
        """The estimates of the whole documents of a table."""
        table = table.combine_chunks()
        codes = [pc.dictionary_encode(table[k]).combine_chunks().indices.to_numpy(zero_copy_only=False) for k in keys]
        code = lambda c: np.nan_to_num(c, nan=-1).astype(np.int64)
        one = code(codes[1])
        key = np.zeros(len(one), np.int64)
        for c in codes[1:]:
            key = np.unique(np.stack([key, code(c)]), axis=1, return_inverse=True)[1].reshape(-1)
        price = np.stack([table[f"p{i}"].to_numpy() for i in range(10)], axis=1)
        there = np.stack([pc.is_valid(table[f"p{i}"]).to_numpy() for i in range(10)], axis=1)
        is_x, is_y = table["x"].to_numpy(), table["y"].to_numpy()
        starts = np.append(np.flatnonzero(np.diff(code(codes[0]), prepend=-1)), len(one))
        found, every = [], _Columns(price, there)
        for a, b in zip(starts, starts[1:]):
            xs, ys = a + np.flatnonzero(is_x[a:b]), a + np.flatnonzero(is_y[a:b])
            found += [(xs[row], *rest) for row, *rest in _estimates(every.of(xs), one[xs], key[xs], every.of(ys), one[ys])]
        row, band, support, up, has_up, down, has_down = map(np.concatenate, zip(*found)) if found else [np.zeros(0, np.int64)] * 7
        beside = lambda at: pa.array(price[row, np.clip(at, 0, 9)], mask=~(there[row, np.clip(at, 0, 9)] & (at >= 0) & (at <= 9)))
        made = [pa.array(band.astype(np.int32)), pa.array(support.astype(np.int64)), pa.array(up.astype(float), mask=~has_up.astype(bool)), pa.array(down.astype(float), mask=~has_down.astype(bool)), beside(band - 1), beside(band + 1)]
        taken = table.select(keys).take(pa.array(row)).combine_chunks()
        return pa.RecordBatch.from_arrays([*[c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in taken.columns], *made], names=[*keys, "band", "support", "up", "down", "lower", "upper"])

    def run(batches):
        held = []
        for batch in batches:
            ends = pc.indices_nonzero(pc.not_equal(batch["d"][1:], batch["d"][:-1])).to_numpy() + 1 if batch.num_rows else []
            if held and batch.num_rows and held[-1]["d"][-1] != batch["d"][0]:
                yield told(pa.Table.from_batches(held))
                held = []
            if len(ends):
                yield told(pa.Table.from_batches([*held, batch.slice(0, int(ends[-1]))]))
                held, batch = [], batch.slice(int(ends[-1]))
            if batch.num_rows:
                held.append(batch)
        if held:
            yield told(pa.Table.from_batches(held))

    schema = ", ".join(f"{k} {own.schema[k].dataType.simpleString()}" for k in keys) + ", band int, support bigint, up double, down double, lower double, upper double"
    below, above = F.col("lower") * F.col("up"), F.try_divide("upper", "down")
    value = F.when(below.isNull() | above.isNull(), F.coalesce(below, above)).when(F.abs(below - above) <= APART, (below + above) / 2)
    estimates = dealt.mapInArrow(run, schema).withColumn("value", F.round(value, 2)).where(F.col("value").isNotNull())
    return estimates.select(F.col("d").alias(doc), *[F.col(f"t{i}").alias(t) for i, t in enumerate(trial)], F.col("c").alias(column), "band", "value", "support")


def apply_recompute(cells: DataFrame, values: DataFrame, column: list[str], dual: bool = True, scanned: bool = False) -> DataFrame:
    """``cells`` (column, band, a, b, status) with value, chosen and outcome: an unresolved price that one reader has within 0.015 of the
    value is confirmed_calc and chosen (reader a first). Otherwise a trusted price that is over 0.10 off gives info, another one that is over
    0.025 off an alert; trusted are confirmed prices, and all where one reader read a text that is no scan. A value never replaces a
    price by itself, and one without a reading is a suggestion."""
    # Spark sizes values by the columns they were made of, ten times too low, and would broadcast them where only cells that were read are wanted.
    joined = cells.join(values.select(*column, "band", "value").hint("merge"), [*column, "band"], "full")
    near = lambda c: F.coalesce(F.abs(F.col(c) - F.col("value")) <= 0.015, F.lit(False))
    open_, off = F.col("status") != "confirmed", F.abs(F.coalesce("a", "b") - F.col("value"))
    trusted = ~open_ | F.lit(not (dual or scanned))
    outcome = F.when(F.col("value").isNull(), None).when(F.col("status").isNull(), "suggestion").when(open_ & (near("a") | near("b")), "confirmed_calc")
    outcome = outcome.when(trusted & (off > 0.10), "info").when(~trusted & (off > 0.025), "alert")
    return joined.withColumn("chosen", F.when(open_ & near("a"), F.col("a")).when(open_ & near("b"), F.col("b"))).withColumn("outcome", outcome)


def recompute_findings(applied: DataFrame, column: list[str]) -> DataFrame:
    """Findings (column, rule, severity, bands) of prices that the pattern of their peers contradicts."""
    return applied.where(F.col("outcome").isin("info", "alert")).select(*column, F.lit("off_calculation").alias("rule"), F.col("outcome").alias("severity"), F.array("band").alias("bands"))


def suggestions(applied: DataFrame, column: list[str]) -> DataFrame:
    """(column, suggested): the values of bands that nobody read, in order, for the finding about unread bands."""
    each = F.struct("band", "value")
    return applied.where("outcome = 'suggestion'").groupBy(*column).agg(F.array_sort(F.collect_list(each)).alias("suggested"))  # ten at most


def reviewed_anew(applied: DataFrame, findings: DataFrame, column: list[str], dual: bool = True) -> DataFrame:
    """The cells that were read, with their status after recomputation and review by it: what the value confirmed needs no review
    any more, what it contradicts does."""
    status_ = F.when(F.col("outcome") == "confirmed_calc", "confirmed_calc").otherwise(F.col("status"))
    cells = applied.where("status is not null").withColumn("status", status_)
    all_ = findings.select(*column, "severity", "bands").unionByName(recompute_findings(applied, column).select(*column, "severity", F.col("bands").cast("array<int>").alias("bands")))
    return needs_review(cells, all_, column, dual)


def summary(cells: DataFrame, by: list[str]) -> DataFrame:
    """Counts of cells by status, of those to review and of those corrected: refreshed after each review from the cells themselves."""
    kinds = ("confirmed", "confirmed_calc", "divergent", "only_a", "only_b")
    return cells.groupBy(*by).agg(F.count("*").alias("cells"), *[F.count_if(F.col("status") == k).alias(k) for k in kinds], F.count_if("review").alias("to_review"), F.count_if(F.col("chosen").isNotNull()).alias("chosen"))
