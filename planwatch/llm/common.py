"""What the operators of this subpackage share: Arrow access to texts, stable fractions, names that clash with no column."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planwatch.session import shared_folder, written  # noqa: F401  for the operators

#: A word is a run of characters other than space, \t, \n, \v, \f and \r. ``bytes.split()`` cuts at the same characters.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


class Numbered:
    """A table under names of its own, so that what an operator adds clashes with none of its columns, in whichever case.

    ``rows`` has the columns c0, c1, ..., and, with ``name``, is written with ``row``, a number for each row that holds
    whenever the table is read, so that rows which share a doc_id or have none can be told apart.
    """

    def __init__(self, docs: DataFrame, name: str | None = None):
        self.names = docs.columns
        rows = docs.toDF(*[f"c{i}" for i in range(len(self.names))])
        self.rows = written(rows.withColumn("row", F.monotonically_increasing_id()), name) if name else rows

    def of(self, column: str) -> str:
        """The own name of a column of documents."""
        return f"c{self.names.index(column)}"

    def named(self, rows: DataFrame) -> DataFrame:
        """``rows`` under the table's names, in its order, without what was added."""
        return rows.select(*[f"c{i}" for i in range(len(self.names))]).toDF(*self.names)


def sized(df: DataFrame, few: int = 500_000) -> DataFrame:
    """A written table of narrow rows to join with: broadcast if it has few rows (some 20 MB at most), else to be shuffled, even if its files are small."""
    return F.broadcast(df) if df.count() <= few else df.hint("merge")


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows, so that a task holds few texts as Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def utf8(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text of an Arrow column; null reads as empty."""
    for x in column.cast(pa.binary()).to_pylist():
        yield x or b""


def crc_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; null for a null doc_id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def share_of(key: Column) -> Column:
    """A number in [0, 1) that depends on ``key`` only: ``share_of(key) < p`` keeps about p of the rows, the same on each run."""
    return F.pmod(F.xxhash64(F.lit("share"), key), F.lit(1 << 30)) / F.lit(float(1 << 30))
