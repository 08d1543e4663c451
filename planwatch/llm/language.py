"""Language identification: the family first, then one-versus-one linear support vector machines within it."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwatch.llm.common import Numbered, crc_remainder, documents, share_of, slices, utf8

DIMS = 2048
SAMPLE = 1000  # labelled documents to learn from, for each language, at most in expectation
CHUNK = 1 << 22  # bytes of a text whose n-grams are counted at once

_NOT_LETTERS = bytes(x for x in range(128) if not chr(x).isalpha())
_SPACED = bytes.maketrans(_NOT_LETTERS, b" " * len(_NOT_LETTERS))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def ngrams(text: bytes) -> np.ndarray:
    """Hashed counts of the byte trigrams of the lower-cased text, with all that isn't a letter as one space."""
    t = b" " + b" ".join(text.decode("utf-8", "replace").lower().encode().translate(_SPACED).split()) + b" "
    b = np.frombuffer(t, np.uint8).astype(np.uint32)
    counts = np.zeros(DIMS, np.int64)
    for at in range(0, max(len(b) - 2, 0), CHUNK):
        x = b[at : at + CHUNK + 2]
        code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
        counts += np.bincount((code * np.uint32(2654435761)) >> np.uint32(32 - DIMS.bit_length() + 1), minlength=DIMS)
    return counts


def scaled(counts: np.ndarray) -> np.ndarray:
    """Rows of square-rooted counts, of unit length."""
    x = np.sqrt(counts.astype(np.float32))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Weights, bias, and the slope that turns margins into probabilities. y is 1 or -1; both sides weigh the same.

    Squared hinge loss, by accelerated gradients."""
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w = look = np.zeros(x.shape[1], np.float32)
    for k in range(rounds):
        gap = np.maximum(0, 1 - y * (x @ look))
        step = look - (penalty * look - 2 * x.T @ (share * y * gap)) / (penalty + 4)
        w, look = step, step + k / (k + 3) * (step - w)
    m, slope = y * (x @ w), 1.0
    for _ in range(20):  # Newton steps for the slope of a logistic curve
        p = 1 / (1 + np.exp(-np.clip(slope * m, -30, 30)))
        slope = float(np.clip(slope + (share @ (m * (1 - p)) - 1e-3 * slope) / (share @ (m * m * p * (1 - p)) + 1e-3), 0.5, 30))
    return np.append(w, np.float32(slope))


@dataclass
class LanguageModel:
    """Families of languages, a machine for each pair of families, and one for each pair of languages in a family."""

    families: list[list[str]]
    between: dict[tuple[int, int], np.ndarray]
    within: dict[tuple[str, str], np.ndarray]

    @staticmethod
    def _vote(x: np.ndarray, names: list, machines: dict) -> tuple[np.ndarray, np.ndarray]:
        """The index of the winner by pairwise votes, ties by summed probability, and its mean probability against the rest."""
        votes, total = np.zeros((len(x), len(names))), np.zeros((len(x), len(names)))
        for i, j in combinations(range(len(names)), 2):
            w = machines[names[i], names[j]]
            p = 1 / (1 + np.exp(-np.clip(w[-1] * (x @ w[:-2] + w[-2]), -30, 30)))
            votes[:, i] += p >= 0.5
            votes[:, j] += p < 0.5
            total[:, i] += p
            total[:, j] += 1 - p
        best = np.argmax(votes + total / (len(names) + 1), axis=1)
        return best, np.take_along_axis(total, best[:, None], 1)[:, 0] / (len(names) - 1) if len(names) > 1 else np.ones(len(x))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        family, score = self._vote(x, list(range(len(self.families))), self.between)
        lang = np.empty(len(x), object)
        for f, names in enumerate(self.families):
            if (at := np.flatnonzero(family == f)).size:
                best, p = self._vote(x[at], names, self.within)
                lang[at] = np.array(names, object)[best]
                score[at] *= p
        return lang, score


def learn(langs: list[str], x: np.ndarray) -> LanguageModel:
    """Families are grown by joining the two whose mean texts are most alike, until about the root of the languages are left."""
    names, of = sorted(set(langs)), np.array(langs, object)
    means = {n: x[of == n].mean(axis=0) for n in names}
    families = [[n] for n in names]
    while len(families) > max(1, round(len(names) ** 0.5)):
        centres = [m / max(np.linalg.norm(m), 1e-9) for m in (np.mean([means[n] for n in f], axis=0) for f in families)]
        i, j = max(combinations(range(len(families)), 2), key=lambda p: float(centres[p[0]] @ centres[p[1]]))
        families[i] += families.pop(j)
    index = {n: f for f, members in enumerate(families) for n in members}
    fam = np.array([index[n] for n in langs])

    def machine(group: np.ndarray, a, b) -> np.ndarray:
        at = (group == a) | (group == b)
        return svm(x[at], np.where(group[at] == a, 1, -1).astype(np.float32))

    between = {(i, j): machine(fam, i, j) for i, j in combinations(range(len(families)), 2)}
    within = {(a, b): machine(of, a, b) for f in families for a, b in combinations(f, 2)}
    return LanguageModel(families, between, within)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> LanguageModel | None:
    """Learns from a bounded sample of the rows with crc32(doc_id) mod 3 other than 1 and a language: about ``sample`` of each
    language, taken by a hash of doc_id. None if no row is fit to learn from."""
    fit = docs.where((crc_remainder(F.col(id_col), 3) != 1) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in fit.groupBy(lang_col).count().collect()}
    if not sizes:
        return None
    share = F.create_map(*[F.lit(v) for lang, n in sizes.items() for v in (lang, min(1.0, sample / n))])

    def count(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([ngrams(t).astype("<u4").tobytes() for t in utf8(b.column(1))], pa.binary())], names=["lang", "counts"])

    chosen = fit.where(share_of(F.col(id_col)) < F.element_at(share, F.col(lang_col)))
    rows = chosen.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(count, "lang string, counts binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r[0], bytes(r[1])))
    langs, counts = [r[0] for r in rows], np.empty((len(rows), DIMS), np.float32)
    for i, r in enumerate(rows):
        counts[i] = np.frombuffer(r[1], "<u4")
    del r, rows  # the driver holds them once
    counts = scaled(counts)
    return learn(langs, counts)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: LanguageModel | None = None, keep: list[str] | None = None) -> DataFrame:
    """(kept columns, lang_pred, score) for each row of ``docs``; ``keep`` names the columns to carry, doc_id if None.

    A null text and one without a letter get ``und`` and score 0, as do all texts if there was nothing to learn from. The score is
    the family's mean probability in its pairwise contests times that of the language within it. Only the text is read.
    """
    model = model or train(docs, id_col, text_col, lang_col)
    keep = [id_col] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a vector for each pair of languages
    names = [f"c{i}" for i in range(len(keep))]

    def run(batches):
        for batch in slices(batches):
            column = batch.column(len(names))
            n = len(column)
            lang, score, at, counts = np.full(n, "und", object), np.zeros(n), [], []
            if shared.value:
                for i, t in enumerate(utf8(column)):
                    if has_letter(t.decode("utf-8", "replace")):
                        at.append(i)
                        counts.append(ngrams(t))
                for s in range(0, len(at), 1024):
                    lang[at[s : s + 1024]], score[at[s : s + 1024]] = shared.value.predict(scaled(np.stack(counts[s : s + 1024])))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(lang, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    schema = ", ".join([*(f"{n} {docs.schema[k].dataType.simpleString()}" for n, k in zip(names, keep)), "lang_pred string", "score double"])
    found = docs.select(*[F.col(k).alias(n) for n, k in zip(names, keep)], F.col(text_col).alias("t")).mapInArrow(run, schema)
    return found.select(*[F.col(n).alias(k) for n, k in zip(names, keep)], "lang_pred", "score")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns over all documents, as ``identify`` says it for nulls, texts without letters and repeated rows."""
    held_out = F.coalesce(crc_remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return identify(documents(spark, sf_dir)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def in_a_known_language(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """Pipeline stage: rows go whose text is null or has no letter, or whose language stays in doubt (a score under ``least``;
    between two languages 0.25 is the lowest there is). All columns stay as they are, whatever their names; repeated rows stay or
    go together, and an empty table gives no rows."""
    own = Numbered(docs)
    found = identify(own.rows, own.of("doc_id"), own.of("text"), own.of("lang"), keep=own.rows.columns)
    return own.named(found.where((F.col("lang_pred") != "und") & (F.col("score") >= least)))
