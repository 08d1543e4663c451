"""A quality classifier: histogram gradient-boosted trees over text statistics, flattened for vectorised traversal."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwatch.llm.common import crc_remainder, documents, share_of, written
from planwatch.llm.textstats import FEATURES, with_features, with_statistics

SAMPLE = 20_000  # labelled rows to learn from, at most in expectation
BINS, DEPTH, TREES, RATE = 64, 4, 80, 0.15


@dataclass
class Trees:
    """Complete trees side by side: node i of a tree has children 2i+1 and 2i+2; the last level holds the leaves."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # right if the value is larger
    leaf: np.ndarray  # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        return total

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, rate: float = RATE, l2: float = 1.0, least: int = 5) -> Trees:
    """Level by level: histograms of gradients for each open node and feature, the best split of each, Newton leaves.

    Without rows, or with one label only, there are no splits and every score is the smoothed share of label 1."""
    n, m, inner = len(x), x.shape[1], 2**DEPTH - 1
    share = (y.sum() + 1) / (n + 2)
    model = Trees(float(np.log(share / (1 - share))), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if not n or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])  # bin b: at most edge b
    margin = np.full(n, model.base)
    grown = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            at = (node - first) * BINS
            best, gain = np.full(width, -1), np.zeros(width)
            for j, e in enumerate(edges):
                hist = [np.bincount(at + binned[j], weights=w, minlength=width * BINS).reshape(width, BINS).cumsum(axis=1) for w in (g, h, None)]
                gl, hl, cl = (c[:, : len(e)] for c in hist)
                gt, ht, ct = (c[:, -1:] for c in hist)
                if len(e):
                    rise = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                    rise[(cl < least) | (ct - cl < least)] = 0
                    b = rise.argmax(axis=1)
                    r = rise[np.arange(width), b]
                    for k in np.flatnonzero(r > gain + 1e-9):
                        gain[k], best[k] = r[k], j
                        threshold[first + k], feature[first + k] = e[b[k]], j
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        sums = [np.bincount(leaf, weights=w, minlength=inner + 1) for w in (g, h)]
        value = rate * sums[0] / (sums[1] + l2)
        margin += value[leaf]
        grown.append((feature, threshold, value))
    return Trees(model.base, *(np.stack(a) for a in zip(*grown)))


def train(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Learns labels.quality from a bounded sample of the rows with crc32(doc_id) mod 5 other than 0, by a hash of doc_id."""
    marked = labels.where((crc_remainder(F.col("doc_id"), 5) != 0) & F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality")
    n = marked.count()
    chosen = marked.where(share_of(F.col("doc_id")) < min(1.0, sample / max(n, 1)))
    rows = sorted(map(tuple, chosen.join(stats, "doc_id").select("doc_id", "quality", *FEATURES).collect()))
    return fit(np.array([r[2:] for r in rows], float).reshape(-1, len(FEATURES)), np.array([r[1] for r in rows], float))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, score) for each row of ``docs``: the probability of label 1, from statistics of the whole text only.

    Null and empty texts are scored by their statistics, all of which are 0. Repeated rows get equal scores."""
    stats = written(with_features(with_statistics(docs, id_col, text_col)), "text-statistics")
    shared = docs.sparkSession.sparkContext.broadcast(train(stats, labels, sample))  # 80 trees of 31 numbers

    def run(batches):
        for b in batches:
            x = np.stack([b.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(FEATURES))], axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.predict(x))], names=["doc_id", "score"])

    return stats.select("doc_id", *FEATURES).mapInArrow(run, "doc_id bigint, score double")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns over all documents, as ``score`` says it for nulls, empty texts and repeated rows."""
    scored = score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.coalesce(crc_remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
