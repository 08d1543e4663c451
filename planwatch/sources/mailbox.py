"""A mailbox as a streaming source: offsets are the mailbox's validity and the last message number read under it."""

from __future__ import annotations

import email
import email.policy
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

MESSAGE = "validity bigint, uid bigint, sender string, subject string, dated string, headers array<string>, attachments array<struct<name: string, kind: string, content: binary>>"


class Mailbox(DataSource):
    """Format ``mailbox``: a folder ``path`` with a folder for each validity, in it a file ``<uid>.eml`` for each message, as a mail client mirrors it.
    ``limit`` messages a batch. The highest validity is the mailbox as it is now; a new one numbers all messages anew."""

    @classmethod
    def name(cls) -> str:
        return "mailbox"

    def schema(self) -> str:
        return "validity bigint, uid bigint, path string"

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return MailboxReader(self.options)


class MailboxReader(SimpleDataSourceStreamReader):
    """The driver lists numbers only, ``limit`` of them a batch; messages are read by tasks (``messages``). A batch that runs again gets the same
    numbers, without those deleted meanwhile. Spark moves the offset on once the batch ended well."""

    def __init__(self, options: dict):
        store, path = fs.FileSystem.from_uri(options["path"]) if ":" in options["path"] else (fs.LocalFileSystem(), options["path"])
        self.store, self.path, self.limit = store, path, int(options.get("limit", "200"))

    def initialOffset(self) -> dict:
        return {"validity": 0, "uid": 0}

    def _numbers(self, folder: str, kind: fs.FileType, suffix: str = "") -> list[int]:
        found = self.store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        names = [i.base_name.removesuffix(suffix) for i in found if i.type == kind and i.base_name.endswith(suffix)]
        return sorted(int(n) for n in names if n.isdigit())

    def _between(self, validity: int, after: int, last: int | None) -> list[tuple]:
        uids = self._numbers(f"{self.path}/{validity}", fs.FileType.File, ".eml")
        return [(validity, u, f"{self.path}/{validity}/{u}.eml") for u in uids if u > after and (last is None or u <= last)]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        validity = max(self._numbers(self.path, fs.FileType.Directory), default=start["validity"])
        after = start["uid"] if validity == start["validity"] else 0
        rows = self._between(validity, after, None)[: self.limit]
        return iter(rows), {"validity": validity, "uid": rows[-1][1] if rows else after}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        after = start["uid"] if start["validity"] == end["validity"] else 0
        return iter(self._between(end["validity"], after, end["uid"]))

    def commit(self, end: dict) -> None:
        """Nothing to do: the checkpoint has the offset, and reading marks nothing in the mailbox."""


def mailbox(spark: SparkSession, path: str, limit: int = 200) -> DataFrame:
    """A stream of (validity, uid, path) of a mailbox's messages, at most ``limit`` a run of available-now."""
    spark.dataSource.register(Mailbox)
    return spark.readStream.format("mailbox").option("path", path).option("limit", str(limit)).load()


def messages(numbers: DataFrame) -> DataFrame:
    """The messages (MESSAGE) of (validity, uid, path), each read and parsed by a task; a broken one has what could be read of it."""

    def run(batches):
        for batch in batches:
            out = []
            for validity, uid, path in zip(batch["validity"], batch["uid"], batch["path"]):
                store, at = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
                with store.open_input_stream(at) as f:
                    m = email.message_from_bytes(f.read(), policy=email.policy.default)
                held = [{"name": p.get_filename(), "kind": p.get_content_type(), "content": p.get_payload(decode=True)} for p in m.walk() if p.get_filename()]
                out.append((validity, uid, str(m["from"] or ""), str(m["subject"] or ""), str(m["date"] or ""), [str(x) for x in m.get_all("authentication-results", [])], held))
            yield pd.DataFrame(out, columns=["validity", "uid", "sender", "subject", "dated", "headers", "attachments"])

    return numbers.repartition(F.col("uid")).mapInPandas(run, MESSAGE)
