"""Statistics of whole texts, for the quality rules and the quality classifier."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planwatch.llm.common import slices, utf8

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_chars", "n_lines", "n_upper", "n_digits", "n_marks", "n_stops", "n_short_words", "n_long_words")
#: Shares that rules and trees are learned from. Each is 0 where it would divide by 0.
FEATURES = ("words", "word_length", "symbols_a_word", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "digit_share", "mark_share", "words_a_line", "words_a_stop", "short_share", "long_share")

_BLANK = b" \t\n\v\f\r"
_LATER = bytes(range(0x80, 0xC0))  # bytes of a code point after its first
_SYMBOLS = b"#*$%&|<>"


def _others(text: bytes, drop: bytes) -> int:
    return len(text.translate(None, drop))


def statistics(text: bytes) -> tuple[int, ...]:
    """The COUNTS of one text."""
    words = text.split()
    n, size = len(words), len(text)
    seen: dict[bytes, int] = {}
    ids = [seen.setdefault(w, len(seen)) for w in words]
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 0
    if n > 3:
        a, k = np.array(ids, np.int64), len(seen)
        if k < 2_000_000:
            code = (a[:-2] * k + a[1:-1]) * k + a[2:]
        else:  # the three numbers would not fit one long: number the pairs first
            _, pair = np.unique(a[:-1] * k + a[1:], return_inverse=True)
            code = pair[:-1] * np.int64(k) + a[2:]
        _, of, count = np.unique(code, return_inverse=True, return_counts=True)
        if len(count) < len(code):
            again, covered = count[of] > 1, np.zeros(n, bool)
            for shift in range(3):
                covered[shift : n - 2 + shift] |= again
            repeated = int(covered.sum())
    lengths = np.fromiter(map(len, words), np.int64, n)
    return (
        n, _others(text, _BLANK + _LATER), size - _others(text, _SYMBOLS), len(lines) - len(set(lines)), repeated, len(seen), _others(text, _LATER), len(lines),
        size - _others(text, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), size - _others(text, b"0123456789"), size - _others(text, b"!?"), size - _others(text, b"."), int((lengths <= 3).sum()), int((lengths > 20).sum()),
    )


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the COUNTS as longs) for each row; a null text has none of anything."""

    def run(batches):
        for b in slices(batches):
            rows = np.array([statistics(t) for t in utf8(b.column(1))], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(rows[:, i]) for i in range(len(COUNTS)))], names=["doc_id", *COUNTS])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS))


def with_features(stats: DataFrame) -> DataFrame:
    """``stats`` and the FEATURES as doubles."""
    over = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    made = {
        "words": F.col("n_words").cast("double"), "word_length": over("word_chars", "n_words"), "symbols_a_word": over("n_symbols", "n_words"), "symbol_share": over("n_symbols", "n_chars"),
        "dup_line_share": over("n_dup_lines", "n_lines"), "repeat_share": over("n_repeat_words", "n_words"), "distinct_share": over("n_distinct_words", "n_words"), "upper_share": over("n_upper", "n_chars"),
        "digit_share": over("n_digits", "n_chars"), "mark_share": over("n_marks", "n_chars"), "words_a_line": over("n_words", "n_lines"), "words_a_stop": over("n_words", "n_stops"), "short_share": over("n_short_words", "n_words"), "long_share": over("n_long_words", "n_words"),
    }
    return stats.withColumns({f: made[f] for f in FEATURES})
