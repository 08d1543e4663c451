"""Learned decision lists: sequential covering over text statistics, emitted as ordered Spark conditions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planwatch.llm.common import documents, share_of, written
from planwatch.llm.textstats import FEATURES, with_features, with_statistics

SAMPLE = 20_000  # labelled rows to learn from, at most in expectation


@dataclass(frozen=True)
class Rule:
    """Bad if every (feature, at_least, threshold) holds: feature >= threshold or, with at_least False, feature <= threshold."""

    tests: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        c = F.lit(True)
        for name, at_least, t in self.tests:
            c = c & (F.col(name) >= t if at_least else F.col(name) <= t)
        return c

    def holds(self, x: np.ndarray, names: tuple[str, ...] = FEATURES) -> np.ndarray:
        ok = np.ones(len(x), bool)
        for name, at_least, t in self.tests:
            v = x[:, names.index(name)]
            ok &= v >= t if at_least else v <= t
        return ok


def _score(bad: float, all_: float, base: float) -> float:
    """Precision with a prior of two rows at the base rate, as the m-estimate has it."""
    return (bad + 2 * base) / (all_ + 2)


def learn_rules(x: np.ndarray, bad: np.ndarray, names: tuple[str, ...] = FEATURES, most_tests: int = 3, precision: float = 0.8, least: int = 8, bins: int = 64) -> list[Rule]:
    """A decision list of rules for ``bad`` rows, in the order found.

    Two thirds of the rows grow a rule test by test, each the threshold that raises the m-estimate most; the last third prunes
    it, dropping tests from the end while that doesn't lower its precision there. A rule stays if its m-estimate is ``precision``
    on the first part and at most 0.1 less on the last; the rows that it covers go, and the next one is grown until none is good
    enough, however many rows or rules there are. So a few rows, which can't show that a rule holds, give no rules.
    """
    rules: list[Rule] = []
    prune = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), bool)
    base = bad.mean() if len(bad) else 0.0
    while True:
        grow = left & ~prune
        gx, gy = x[grow], bad[grow]
        at, tests, best = np.ones(len(gx), bool), [], base
        while len(tests) < most_tests and at.any():
            found = None
            for j, name in enumerate(names):
                v = gx[at, j]
                for t in np.unique(np.quantile(v, np.linspace(0, 1, bins))):
                    for at_least, ok in ((True, v >= t), (False, v <= t)):
                        n, k = int(ok.sum()), int(gy[at][ok].sum())
                        if k >= least and n < len(v) and (s := _score(k, n, base)) > (found[0] if found else best + 1e-9):
                            found = (s, (name, at_least, float(t)))
            if not found:
                break
            best = found[0]
            tests.append(found[1])
            at &= Rule((found[1],)).holds(gx, names)
            if gy[at].all():
                break

        def precise(rule: Rule, part: np.ndarray) -> tuple[float, int]:
            hit = rule.holds(x[part], names)
            return (_score(bad[part][hit].sum(), hit.sum(), base), int(hit.sum()))

        while len(tests) > 1 and precise(Rule(tuple(tests[:-1])), left & prune)[0] >= precise(Rule(tuple(tests)), left & prune)[0]:
            tests.pop()
        if not tests:
            return rules
        rule = Rule(tuple(tests))
        if precise(rule, grow)[0] < precision or precise(rule, left & prune)[0] < precision - 0.1:
            return rules
        rules.append(rule)
        left &= ~rule.holds(x, names)


def verdict(rules: list[Rule]) -> Column:
    """0 if no rule holds, else the number of the first that does."""
    c = F.lit(0)
    for i, rule in reversed(list(enumerate(rules, 1))):
        c = F.when(rule.column(), F.lit(i)).otherwise(c)
    return c


def apply_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Text statistics, base_failed, rule (the first that holds, 0 for none) and kept for each row of ``docs``.

    base_failed: under 50 words, or over half of the words in repeated three-word windows. kept: not base_failed, and no rule.
    Null and empty texts have no words and fail. The rules are learned from a bounded sample of labels (doc_id, quality) with
    neither null; with no such row there are no rules. Labels that repeat or contradict each other all count.
    """
    stats = written(with_features(with_statistics(docs, id_col, text_col)), "text-statistics")
    marked = labels.where(F.col("quality").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.col("quality") == 0).alias("bad"))
    n = marked.count()
    chosen = marked.where(share_of(F.col("doc_id")) < min(1.0, sample / max(n, 1))).join(stats, "doc_id").select("doc_id", "bad", *FEATURES)
    rows = sorted(map(tuple, chosen.collect()), key=lambda r: hash(r[2:]) ^ r[0])
    x, bad = np.array([r[2:] for r in rows], float).reshape(-1, len(FEATURES)), np.array([r[1] for r in rows], bool)
    rules = learn_rules(x, bad) if len(rows) else []
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns and the rule that failed a document, over all documents, as ``apply_rules`` says it for nulls and repeated rows."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return apply_rules(documents(spark, sf_dir), labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
