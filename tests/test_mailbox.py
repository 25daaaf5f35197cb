"""Mailboxes: ranges against whole files, odd messages, and a stream that goes on where it ended."""

import random
import time

import pytest
from pyspark.sql import functions as F

from gazette.operators import match
from gazette.sources import mailbox
from gazette.streaming import ingest


def box(rng, n, end="\n"):
    lines = []
    for k in range(n):
        lines += [f"From x{k}", f"Message-ID: <{k}@x>", "Subject: s", ""]
        lines += [rng.choice(["", "text", ">From quoted", "From inside" if lines and lines[-1] else "a", "é"]) for _ in range(rng.randrange(6))]
        while lines[-1].startswith("From "):
            lines.pop()
        lines.append("")
    return end.join(lines + [""]).encode()


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_ranges(tmp_path, end):
    for seed in range(12):
        data = box(random.Random(seed), 7, end)
        path = tmp_path / f"box{seed}"
        path.write_bytes(data)
        whole = list(mailbox.raw_messages(mailbox.Range(str(path), 0, len(data), len(data))))
        assert len(whole) == 7 and [mailbox.parsed(r, "")["uid"] for _, r in whole] == [f"{k}@x" for k in range(7)]
        for step in (1, 2, 3, 5, 11, 40, 64):
            assert [m for r in mailbox.ranges(str(path), 0, len(data), step) for m in mailbox.raw_messages(r)] == whole


def test_ranges_are_dealt():
    """Tasks follow the bytes of all files, not the ranges; each range is one task's, in order."""
    for k, size, step in ((3, 10_000_000, 100_000), (3000, 70, 50), (1, 90, 50), (2, 64 << 30, 16 << 20), (3, 1 << 30, 100_000), (1, 100 << 20, 50 << 20), (1, 0, 5)):
        parts = [r for n in range(k) for r in mailbox.ranges(f"f{n}", 0, size, step)]
        got = mailbox.dealt(parts)
        assert [r for t in got for r in t.parts] == parts and all(t.parts for t in got)
        assert len(got) <= min(len(parts), 2 * max(mailbox.TASKS, k * size // mailbox.RANGE) + 1)
        assert all(sum(r.end - r.begin for r in t.parts) <= max(mailbox.RANGE, step) for t in got)


def test_few_tasks(spark, tmp_path):
    """Many ranges, in batch and as a stream, are read by few tasks."""
    for k in range(3):
        (tmp_path / f"box{k}").write_bytes(box(random.Random(k), 200))
    batch = mailbox.mailbox(spark, str(tmp_path), 20)
    assert batch.count() == 600 and sum(p.stat().st_size for p in tmp_path.iterdir()) / 20 > 1000 and batch.rdd.getNumPartitions() < 300
    out = []
    ingest.start(mailbox.mailbox_stream(spark, str(tmp_path), 20), str(tmp_path / "_marks"), lambda df, n: out.append((df.count(), df.rdd.getNumPartitions()))).awaitTermination()
    assert sum(n for n, _ in out) == 600 and all(parts < 300 for _, parts in out)


def test_odd_messages():
    mail = b"From: =?utf-8?q?J=C3=BCrg?= <j@x.org>\nTo: a@x.org, \"B, C\" <b@x.org>\nDate: nonsense\nSubject: =?none?q?x?=\nContent-Type: text/plain; charset=unheard\n\n>text \xc3\xbc \xff\n"
    got = mailbox.parsed(mail, "box:7")
    assert got == {"uid": "box:7", "from_": "Jürg <j@x.org>", "subject": "=?none?q?x?=", "date": None, "html": None, "text": ">text ü �\n", "to": ["a@x.org", "b@x.org"], "seen": False}
    mixed = b'Content-Type: multipart/mixed; boundary=b\nStatus: RO\nDate: Mon, 1 Jan 2024 10:00:00\n\n--b\nContent-Type: text/plain\nContent-Disposition: attachment\n\nnot this\n--b\nContent-Type: text/html; charset=latin-1\nContent-Transfer-Encoding: quoted-printable\n\n=E9<b>x=\ny</b>\n--b--\n'
    got = mailbox.parsed(mixed, "u")
    assert got["html"].strip() == "é<b>xy</b>" and got["text"] is None and got["seen"] and got["date"].hour == 10 and got["from_"] is None
    assert mailbox.parsed(b"", "u")["to"] == []


def test_stream_of_mailboxes(spark, tmp_path):
    folder, marks, out = tmp_path / "mail", str(tmp_path / "marks"), []
    folder.mkdir()

    def read():
        stream = mailbox.mailbox_stream(spark, str(folder), 50)
        ingest.start(stream, marks, lambda df, n: out.extend((r.uid, r.text) for r in df.collect())).awaitTermination()

    message = lambda k: f"From x\nMessage-ID: <{k}>\n\nbody {k}\n\n".encode()
    (folder / "a").write_bytes(message(1) + message(2))
    (folder / ".hidden").write_bytes(message(9))
    read()
    read()
    with open(folder / "a", "ab") as f:
        f.write(message(3))
    (folder / "b").write_bytes(message(4))
    read()
    assert sorted(out) == [(str(k), f"body {k}\n\n") for k in (1, 2, 3, 4)]
    batch = mailbox.mailbox(spark, str(folder), 50)
    assert sorted(r.uid for r in batch.collect()) == ["1", "2", "3", "4"]
    (tmp_path / "none").mkdir()
    assert mailbox.mailbox(spark, str(tmp_path / "none")).count() == 0


# Senders and patterns


def fits(sender, pattern, compat):
    import re

    sender = (sender or "").lower()
    if pattern is None:
        return False
    pattern = pattern.lower()
    if not compat:
        return re.fullmatch("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern), sender) is not None
    if "%" not in pattern:
        return pattern in sender or sender in pattern
    try:
        return re.search(pattern.replace("%", ".*").replace(".", "\\."), sender) is not None
    except re.error:
        return False


@pytest.mark.parametrize("compat", [True, False])
def test_patterns(spark, compat):
    rng = random.Random(5)
    patterns = ["%@a.org", "%", "a+b%", "x%y", "%(a|b)%", "[ab]%", "a+(b%", "ward", "x@ward7.org.extra", "", "%.", "a.b", "%B?C%", "c%d%e", None, "%%", "a*%", "%a{2}%"]
    patterns += ["".join(rng.choice("ab.%@c_") for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    senders = ["".join(rng.choice("abc@.xd_") for _ in range(rng.randrange(8))) for _ in range(200)] + ["x@ward7.org", "WARD", "", None, "aab"]
    maps = spark.createDataFrame([(k + 1, p, k % 7 if k % 9 else None) for k, p in enumerate(patterns)], "id int, email_pattern string, source_id int")
    mails = spark.createDataFrame([(str(i), s, 1, 2) for i, s in enumerate(senders)], "email_uid string, from_email string, piece int, pattern int")
    got = match.source_of_sender(mails, maps, compat)
    assert got.columns == [*mails.columns, "source_id"] and "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    rows = {r.email_uid: r.source_id for r in got.collect()}
    for i, s in enumerate(senders):
        assert rows[str(i)] == next((k % 7 if k % 9 else None for k, p in enumerate(patterns) if fits(s, p, compat)), None), s
    if compat:
        assert {r.email_pattern for r in match.faulty_patterns(maps).collect()} == {None, "a+(b%"}


def test_many_patterns(spark):
    """100,000 mappings against 100,000 senders, without holding each against each."""
    k = F.col("id")
    maps = spark.range(100_000).select((k + 1).cast("int").alias("id"), F.concat(F.when(k % 2 == 0, "%@ward").otherwise("%news"), k.cast("string"), F.lit(".example.org")).alias("email_pattern"), k.cast("int").alias("source_id"))
    mails = spark.range(100_000).select(k.cast("string").alias("email_uid"), F.concat(F.lit("news@ward"), (k + 50_000).cast("string"), F.lit(".example.org")).alias("from_email"))
    began = time.time()
    assert match.source_of_sender(mails, maps).where("source_id is not null").count() == 25_000
    assert time.time() - began < 120
