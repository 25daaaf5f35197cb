"""Mailboxes (mbox files) as a data source of Spark, in batch and as a stream.

A file is cut into byte ranges, and each message belongs to the range that its first line begins in, so that a large mailbox is
read by many tasks. A task reads as many ranges as make up its share, of one file or of several: how many tasks there are rests on
the bytes of all files, not on the size of a range or the number of files. As a stream, how many bytes of each file have been read is the mark that the checkpoint keeps: a restart goes
on where it ended, and only what was appended or is new is read. Whoever writes appends whole messages. Files are opened by
path, so the folder has to be one that the driver and all executors see."""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import timezone
from email import policy
from email.header import decode_header, make_header
from email.message import EmailMessage
from email.parser import BytesParser
from email.utils import getaddresses, parsedate_to_datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..schemas import MAIL

#: Bytes of a range, if no other number is asked for, and of all ranges that a task reads, unless a single one is larger.
RANGE = 16 << 20
#: Tasks, about, as long as that leaves them less than RANGE each.
TASKS = 128


class Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int, size: int):
        self.path, self.begin, self.end, self.size = path, begin, end, size


class Ranges(InputPartition):
    """What one task reads, range by range."""

    def __init__(self, parts: list[Range]):
        self.parts = parts


def files(path: str) -> dict[str, int]:
    """The files of a folder, or one file, and their sizes; names that begin with . or _ are of other use."""
    path = path.removeprefix("file://")
    if os.path.isfile(path):
        return {path: os.path.getsize(path)}
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f[0] not in "._"}


def ranges(path: str, begin: int, size: int, step: int) -> list[Range]:
    return [Range(path, at, min(at + step, size), size) for at in range(begin, size, step)]


def dealt(parts: list[Range]) -> list[Ranges]:
    """Ranges dealt to tasks in their order."""
    share, out, held = min(sum(r.end - r.begin for r in parts) / TASKS, RANGE), [], 0
    for r in parts:
        if not out or held + r.end - r.begin > share:
            out.append(Ranges([]))
            held = 0
        out[-1].parts.append(r)
        held += r.end - r.begin
    return out


def raw_messages(part: Range) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of the messages that begin in a range. One begins at a line "From " at the start or after an empty line; lines
    that were quoted as ">From " get back what they were."""
    with open(part.path, "rb") as f:
        at, blank = part.begin, True
        if at:
            f.seek(max(at - 4, 0))
            before = f.read(min(at, 4))
            if before[-1:] != b"\n":
                rest = f.readline()  # of a line that began in the range before
                at, before = at + len(rest), before + rest
            blank = before in (b"\n", b"\r\n") or before.endswith((b"\n\n", b"\n\r\n"))
        place, held = None, []
        while at < part.size:
            line = f.readline(part.size - at)
            if blank and line.startswith(b"From "):
                if place is not None:
                    yield place, b"".join(held)
                    place = None
                if at >= part.end:
                    return
                place, held = at, []
            elif place is None and at >= part.end:
                return
            elif place is not None:
                held.append(line[1:] if line.startswith(b">") and line.lstrip(b">").startswith(b"From ") else line)
            at += len(line)
            blank = line in (b"\n", b"\r\n")
        if place is not None:
            yield place, b"".join(held)


def _decoded(value) -> str | None:
    if value is None:
        return None
    try:
        return str(make_header(decode_header(str(value)))).replace("\r", "").replace("\n", "")
    except (LookupError, UnicodeDecodeError, ValueError):
        return str(value)


def _body(message: EmailMessage, kind: str) -> str | None:
    """The first part of a kind that is no attachment; characters that its charset doesn't have are replaced."""
    for part in message.walk():
        if part.get_content_type() == kind and not part.is_multipart() and part.get_content_disposition() != "attachment":
            data = part.get_payload(decode=True) or b""
            try:
                return data.decode(part.get_content_charset() or "utf-8", "replace")
            except LookupError:
                return data.decode("utf-8", "replace")
    return None


def parsed(raw: bytes, fallback: str) -> dict:
    """The fields of a message; what can't be read is null, and the uid of one without Message-ID is where it stands."""
    message = BytesParser(policy=policy.compat32).parsebytes(raw)
    try:
        date = parsedate_to_datetime(message["Date"])
        date = date.replace(tzinfo=timezone.utc) if date.tzinfo is None else date
    except (TypeError, ValueError, IndexError, OverflowError):
        date = None
    to = [a for _, a in getaddresses([str(v) for v in message.get_all("To", [])]) if a]
    uid = (_decoded(message["Message-ID"]) or "").strip().strip("<>")
    return {"uid": uid or fallback, "from_": _decoded(message["From"]), "subject": _decoded(message["Subject"]), "date": date, "html": _body(message, "text/html"), "text": _body(message, "text/plain"), "to": to, "seen": "R" in (message["Status"] or "")}


def _rows(task: Ranges, names: list[str]) -> Iterator[tuple]:
    for part in task.parts:
        for place, raw in raw_messages(part):
            row = parsed(raw, f"{os.path.basename(part.path)}:{place}")
            yield tuple(row[n] for n in names)


class _Batch(DataSourceReader):
    def __init__(self, path: str, step: int, names: list[str]):
        self.path, self.step, self.names = path, step, names

    def partitions(self) -> list[Ranges]:
        return dealt([r for path, size in sorted(files(self.path).items()) for r in ranges(path, 0, size, self.step)]) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[tuple]:
        return _rows(partition, self.names)


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str, step: int, names: list[str]):
        self.path, self.step, self.names = path, step, names

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return files(self.path)

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        """What end has more than start; a file that has become shorter is another one and is read again."""
        return dealt([r for path, size in sorted(end.items()) for r in ranges(path, start.get(path, 0) if start.get(path, 0) <= size else 0, size, self.step)])

    def read(self, partition: Ranges) -> Iterator[tuple]:
        return _rows(partition, self.names)

    def commit(self, end: dict) -> None:
        pass


class Mailbox(DataSource):
    """spark.read.format("mailbox").load(folder), with the option bytes: those of a range."""

    @classmethod
    def name(cls) -> str:
        return "mailbox"

    def schema(self) -> str:
        return MAIL

    def _parts(self, schema) -> tuple[str, int, list[str]]:
        return self.options["path"], int(self.options.get("bytes", RANGE)), schema.fieldNames()

    def reader(self, schema) -> DataSourceReader:
        return _Batch(*self._parts(schema))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(*self._parts(schema))


def mailbox(spark: SparkSession, path: str, step: int = RANGE) -> DataFrame:
    """All messages of a folder of mailboxes, read ones too."""
    spark.dataSource.register(Mailbox)
    return spark.read.format("mailbox").option("bytes", step).load(path)


def mailbox_stream(spark: SparkSession, path: str, step: int = RANGE) -> DataFrame:
    spark.dataSource.register(Mailbox)
    return spark.readStream.format("mailbox").option("bytes", step).load(path)
