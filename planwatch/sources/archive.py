"""A zipped register as a data source: a partition is a member, and filters drop lines before they leave the reader."""

from __future__ import annotations

import csv
import io
import json
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from planwatch.sources.files import _opened

ROWS = 4096  # of a batch


class Member(InputPartition):
    def __init__(self, archive: str, name: str):
        self.archive, self.name = archive, name


class ZippedRegister(DataSource):
    """Format ``zipped_register``: options ``archives`` (a JSON list of addresses), ``suffix`` (.csv) and ``sep`` (;).

    The schema is the user's, its fields by the names of the members' header lines, as strings; a field that a member lacks is null.
    """

    @classmethod
    def name(cls) -> str:
        return "zipped_register"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ZippedReader(self.options, schema)


class ZippedReader(DataSourceReader):
    """The driver reads the archives' directories, a row for each member. A task seeks its member and streams it, so neither is held whole.

    Equality and membership filters are taken over: a line's fields are looked at as bytes, and only lines that pass are parsed whole and go to
    Spark. A line that is broken, and so lacks the field, passes no filter.
    """

    def __init__(self, options: dict, schema: StructType):
        self.archives, self.suffix, self.sep = json.loads(options["archives"]), options.get("suffix", ".csv"), options.get("sep", ";")
        self.fields = schema.fieldNames()
        self.wanted: list[tuple[str, frozenset[bytes]]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            values = f.value if isinstance(f, In) else (f.value,) if isinstance(f, EqualTo) else None
            if values is None or len(f.attribute) != 1 or not all(isinstance(v, str) for v in values):
                yield f
            else:
                self.wanted.append((f.attribute[0], frozenset(v.encode() for v in values)))

    def partitions(self) -> list[Member]:
        found = []
        for archive in self.archives:
            with _opened(archive) as f, zipfile.ZipFile(f) as z:
                found += [Member(archive, n) for n in sorted(z.namelist()) if n.lower().endswith(self.suffix)]
        return found

    def read(self, member: Member | None) -> Iterator[pa.RecordBatch]:
        if member is None:  # there is no member at all
            return
        sep = self.sep.encode()
        with _opened(member.archive) as raw, zipfile.ZipFile(raw) as z, z.open(member.name) as lines:
            header = next(self._parsed(iter([next(iter(lines), b"")])), [])
            at = [header.index(f) if f in header else None for f in self.fields]
            wanted = [(header.index(c) if c in header else None, values) for c, values in self.wanted]
            kept = (line for line in lines if line.strip() and all(i is not None and self._field(line, sep, i) in values for i, values in wanted))
            rows: list[list[str | None]] = []
            for row in self._parsed(kept):
                rows.append([row[i] if i is not None and i < len(row) else None for i in at])
                if len(rows) == ROWS:
                    yield self._batch(rows)
                    rows = []
            if rows:
                yield self._batch(rows)

    def _field(self, line: bytes, sep: bytes, i: int) -> bytes | None:
        """A field of a line; only if a separator may be within quotes is the line parsed for it."""
        parts = line.rstrip(b"\r\n").split(sep, i + 1)
        if any(p.count(b'"') % 2 for p in parts[: i + 1]):
            parts = [p.encode() for p in next(self._parsed(iter([line])), [])]
        return parts[i].strip(b'"') if len(parts) > i else None

    def _parsed(self, lines: Iterator[bytes]) -> Iterator[list[str]]:
        """Each line for itself: a quote that isn't closed ends with its line."""
        for line in lines:
            yield next(csv.reader(io.StringIO(line.decode("utf-8-sig", "replace").rstrip("\r\n")), delimiter=self.sep), [])

    def _batch(self, rows: list[list[str | None]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=self.fields)


def zipped_register(spark: SparkSession, archives: list[str], fields: list[str], suffix: str = ".csv", sep: str = ";") -> DataFrame:
    """The rows of all members of ``archives`` with these fields. ``where`` on them with = or isin is answered inside the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ZippedRegister)
    return spark.read.format("zipped_register").schema(", ".join(f"`{f}` string" for f in fields)).options(archives=json.dumps(archives), suffix=suffix, sep=sep).load()
