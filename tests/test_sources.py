"""Data sources of our own: zipped registers with filters inside the reader, and mailboxes with offsets."""

import zipfile
from email.message import EmailMessage

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from planwatch.sources import archive, mailbox
from planwatch.streaming import feeds


@pytest.fixture
def zipped(tmp_path):
    path = str(tmp_path / "network.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.csv", '﻿ID;NAME;"PLAN"\r\n' + "".join(f'{i};"n;{i}";{i % 10}\r\n' for i in range(9000)) + "broken\r\n\r\n7;\"open;3\r\n")
        z.writestr("sub/b.CSV", "PLAN;ID\n3;x\n4;y\n")
        z.writestr("empty.csv", "")
        z.writestr("notes.txt", "ID;PLAN\n1;3\n")
    return path


def test_filters_are_answered_by_the_reader(spark, zipped):
    rows = archive.zipped_register(spark, [zipped], ["ID", "NAME", "PLAN"])
    assert rows.count() == 9000 + 2 + 2  # with the broken lines
    some = rows.where("PLAN in ('3', '4')")
    assert some.count() == 900 * 2 + 2 and {r.PLAN for r in some.collect()} == {"3", "4"}
    assert [tuple(r) for r in rows.where("ID = '12'").collect()] == [("12", "n;12", "2")]
    assert [tuple(r) for r in rows.where("ID = 'x'").collect()] == [("x", None, "3")]
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert "IN (" not in plan and "IN (" in some._jdf.queryExecution().analyzed().toString()  # Spark has nothing left of it to do
    assert archive.zipped_register(spark, [], ["ID"]).count() == 0


def test_rows_that_leave_the_reader_are_those_asked_for(zipped):
    import json

    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([StructField(c, StringType()) for c in ("ID", "PLAN")])
    reader = archive.ZippedReader({"archives": json.dumps([zipped])}, schema)
    left = list(reader.pushFilters([In(("PLAN",), ("3",)), GreaterThan(("ID",), "1"), EqualTo(("ID",), "13")]))
    assert left == [GreaterThan(("ID",), "1")]
    members = reader.partitions()
    assert [m.name for m in members] == ["a.csv", "empty.csv", "sub/b.CSV"]
    assert [row for m in members for b in reader.read(m) for row in b.to_pylist()] == [{"ID": "13", "PLAN": "3"}]


def post(folder, validity, uids):
    for uid in uids:
        m = EmailMessage()
        m["From"], m["Subject"], m["Authentication-Results"] = f"Ann <ann{uid}@x.com>", f"table {uid}", "mx; dmarc=pass header.from=x.com"
        m.set_content("see attached")
        m.add_attachment(b"%PDF" + bytes([uid]), maintype="application", subtype="pdf", filename=f"t{uid}.pdf")
        (folder / str(validity)).mkdir(exist_ok=True, parents=True)
        (folder / str(validity) / f"{uid}.eml").write_bytes(m.as_bytes())


def test_mailbox_goes_on_after_a_restart_and_starts_anew_under_a_new_validity(spark, tmp_path):
    box, got = tmp_path / "box", []

    def run(limit):
        seen = []
        stream = mailbox.mailbox(spark, str(box), limit)
        feeds.available_now(stream, lambda batch, _: seen.extend(sorted((r.validity, r.uid) for r in batch.collect())), str(tmp_path / "state"))
        got.append(seen)

    box.mkdir()
    run(10)
    post(box, 7, [1, 2, 5])
    (box / "7" / "draft.txt").write_text("no message")
    run(2)
    run(2)
    run(2)
    post(box, 7, [9])
    run(5)
    post(box, 8, [1, 2])
    run(5)
    assert got == [[], [(7, 1), (7, 2)], [(7, 5)], [], [(7, 9)], [(8, 1), (8, 2)]]


def test_a_batch_that_fails_is_read_again(spark, tmp_path):
    box, seen = tmp_path / "box", []
    post(box, 3, [1, 2, 3])

    def fails(batch, number):
        raise ValueError("planted")

    with pytest.raises(Exception, match="planted"):
        feeds.available_now(mailbox.mailbox(spark, str(box), 2), fails, str(tmp_path / "state"))
    post(box, 3, [4])
    feeds.available_now(mailbox.mailbox(spark, str(box), 2), lambda batch, _: seen.extend(sorted(r.uid for r in batch.collect())), str(tmp_path / "state"))
    assert seen[:2] == [1, 2]


def test_messages_are_read_by_tasks(spark, tmp_path):
    post(tmp_path, 1, [4, 6])
    (tmp_path / "1" / "8.eml").write_bytes(b"\xff\xfe broken")
    numbers = spark.createDataFrame([(1, u, f"{tmp_path}/1/{u}.eml") for u in (4, 6, 8)], "validity bigint, uid bigint, path string")
    got = {r.uid: r for r in mailbox.messages(numbers).collect()}
    assert got[4].sender == "Ann <ann4@x.com>" and got[6].subject == "table 6" and got[6].headers == ["mx; dmarc=pass header.from=x.com"]
    assert [(a.name, a.kind, bytes(a.content)) for a in got[4].attachments] == [("t4.pdf", "application/pdf", b"%PDF\x04")] and got[8].attachments == []
