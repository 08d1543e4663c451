"""Several tables of documents under one manifest: a commit writes new files beside the old ones and becomes visible by one rename."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another commit came first; read anew and try again."""


class Snapshots:
    """Tables (name -> schema with ``key``) in ``folder``, dealt by a hash of the key into ``buckets``.

    ``manifests/<n>.json`` names the files of commit n: of each table and bucket the folder that holds it. The highest number is what is read. A commit
    writes only the buckets of its documents, all tables', and then renames its manifest to the next number, which fails if that is taken: so readers see all
    tables as before or all as after, and a failure at any step leaves what was there. Folders that no manifest names are left to ``vacuum``.
    """

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, str], key: str = "doc", buckets: int = 64):
        self.spark, self.folder, self.tables, self.key, self.buckets = spark, folder.rstrip("/"), tables, key, buckets
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._store = self._at(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        at = self._at(f"{self.folder}/manifests")
        if not self._store.exists(at):
            return 0
        names = [s.getPath().getName() for s in self._store.listStatus(at)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict[str, dict[str, str]]:
        """table -> bucket -> folder below this one, as of the latest version or another."""
        version = self.version() if version is None else version
        if not version:
            return {t: {} for t in self.tables}
        stream = self._store.open(self._at(f"{self.folder}/manifests/{version}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, table: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table as one commit left it; a later commit doesn't disturb a reader."""
        held = self.manifest(version).get(table, {})
        paths = [f"{self.folder}/{p}" for b, p in held.items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self.tables[table]).parquet(*paths) if paths else self.spark.createDataFrame([], self.tables[table])

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def commit(self, rows: dict[str, DataFrame], docs: DataFrame, keep: dict[str, Column] | None = None, after: Callable[[str], None] = lambda step: None) -> int:
        """Replaces what the tables hold of the documents ``docs`` (key) by ``rows`` (table -> its new rows); of a table in ``keep`` the old rows of which
        that holds stay. The version it made. ``after`` is told of each step."""
        version = self.version()
        old, made = self.manifest(version), f"data/{uuid.uuid4().hex}"
        docs = docs.select(self.key).distinct()
        touched = sorted(r[0] for r in docs.select(self._bucket()).distinct().collect())  # as many as there are buckets, at most
        new = {t: dict(b) for t, b in old.items()}
        for table in self.tables:
            gone = docs.withColumn("_gone", F.lit(True))
            before = self.read(table, version, touched).join(gone, self.key, "left")
            kept = before.where(F.col("_gone").isNull() | F.coalesce((keep or {}).get(table, F.lit(False)), F.lit(False))).drop("_gone")
            whole = kept.unionByName(rows[table].select(*kept.columns)) if table in rows else kept
            whole.withColumn(BUCKET, self._bucket()).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.folder}/{made}/{table}")
            there = {int(s.getPath().getName().split("=")[1]) for s in self._store.listStatus(self._at(f"{self.folder}/{made}/{table}")) if "=" in s.getPath().getName()}
            if stray := there - set(touched):
                raise ValueError(f"{table} has rows of documents that aren't named (buckets {sorted(stray)})")
            new.setdefault(table, {})
            for b in touched:
                new[table].pop(str(b), None)
                if b in there:
                    new[table][str(b)] = f"{made}/{table}/{BUCKET}={b}"
            after(table)
        aside = self._at(f"{self.folder}/{made}/manifest")
        out = self._store.create(aside, True)
        out.write(json.dumps(new).encode())
        out.close()
        after("manifest")
        self._put(aside, version + 1)
        after("commit")
        return version + 1

    def _put(self, aside, version: int) -> None:
        """Renames a manifest into place, if no other has this number."""
        jvm = self.spark._jvm
        target = self._at(f"{self.folder}/manifests/{version}.json")
        self._store.mkdirs(target.getParent())
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._store.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._store.makeQualified(aside), self._store.makeQualified(target), none)
        except Exception as e:
            if self._store.exists(target):
                raise Conflict(f"version {version} is there already") from e
            raise

    def vacuum(self, keep: int = 10) -> list[str]:
        """Deletes the manifests but the latest ``keep``, and the data that none of these names; not to be run beside a commit. The folders deleted."""
        last = self.version()
        first = max(1, last - keep + 1)
        named = {p.split("/")[1] for v in range(first, last + 1) for held in self.manifest(v).values() for p in held.values()}
        for v in range(1, first):
            self._store.delete(self._at(f"{self.folder}/manifests/{v}.json"), False)
        data = self._at(f"{self.folder}/data")
        unused = [s.getPath() for s in self._store.listStatus(data) if s.getPath().getName() not in named] if self._store.exists(data) else []
        for path in unused:
            self._store.delete(path, True)
        return sorted(p.getName() for p in unused)


def save_documents(tables: Snapshots, events: DataFrame, columns: DataFrame, cells: DataFrame) -> int:
    """Columns, cells and events (doc, ...) of reconciled documents in one commit: each document's earlier columns and cells are replaced, of its
    earlier events (resolved) those that aren't resolved. Other documents stay as they are."""
    docs = columns.select(tables.key).unionByName(events.select(tables.key)).unionByName(cells.select(tables.key))
    return tables.commit({"columns": columns, "cells": cells, "events": events}, docs, {"events": F.col("resolved")})
