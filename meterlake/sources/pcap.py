"""Classic packet captures as a data source: spark.read.format("pcap"), and readStream over a folder that they land in.

A capture's record offsets are only known by reading it from its start, so a file is one partition; captures are split
by rotating them. The data source opens paths that every executor can open and reads them record by record, whatever
their size. packets() goes through Spark's own binaryFile reader instead, so any store that Spark reads will do, with
files of up to 2 GB, each in memory as a whole while it is split into rows. A cut last record ends a capture and is
counted by checked().
"""

from __future__ import annotations

import glob
import io
import itertools
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "pkt_no long, ts_ns long, orig_len long, link_type int, data binary"
# The magic numbers as bytes, with byte order and the unit of the fraction in ns.
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1000), b"\xa1\xb2\xc3\xd4": (">", 1000), b"\x4d\x3c\xb2\xa1": ("<", 1), b"\xa1\xb2\x3c\x4d": (">", 1)}


class NotACapture(ValueError):
    pass


def read_capture(source: bytes | BinaryIO, cut: list | None = None) -> Iterator[tuple[int, int, int, int, bytes]]:
    """The packets of a capture, numbered from 0, read one after another; a cut last record ends it and is put in ``cut``."""
    f = io.BytesIO(source) if isinstance(source, bytes) else source
    head = f.read(24)
    if len(head) < 24:
        raise NotACapture("a capture has a header of 24 bytes")
    if head[:4] not in MAGIC:
        raise NotACapture("not a classic capture")
    order, unit = MAGIC[head[:4]]
    link = struct.unpack_from(order + "I", head, 20)[0]
    record, number = struct.Struct(order + "4I"), 0
    while len(own := f.read(16)) == 16:
        seconds, fraction, held, length = record.unpack(own)
        data = f.read(held)
        if len(data) < held:
            own = data or b"\0"
            break
        yield number, seconds * 1_000_000_000 + fraction * unit, length, link, data
        number += 1
    if own and cut is not None:
        cut.append(number)


def malformed(content: bytes) -> int:
    """1 if the last record is cut, else 0."""
    cut: list = []
    for _ in read_capture(content, cut):
        pass
    return len(cut)


def capture_pieces(packets, link_type: int = 1, nanoseconds: bool = False, order: str = "<") -> Iterator[bytes]:
    """The bytes of a capture of (ts_ns, orig_len, data), piece by piece; microseconds cut nanoseconds off."""
    unit = 1 if nanoseconds else 1000
    magic = next(k for k, v in MAGIC.items() if v == (order, unit))
    yield magic + struct.pack(order + "HHiIII", 2, 4, 0, 0, 65535, link_type)
    for ts_ns, length, data in packets:
        yield struct.pack(order + "4I", ts_ns // 1_000_000_000, ts_ns % 1_000_000_000 // unit, len(data), length or len(data)) + data


def write_capture(packets, link_type: int = 1, nanoseconds: bool = False, order: str = "<") -> bytes:
    return b"".join(capture_pieces(packets, link_type, nanoseconds, order))


def _files(path: str) -> list[str]:
    found = sorted(glob.glob(os.path.join(path, "*.pcap"))) if os.path.isdir(path) else sorted(glob.glob(path))
    if not found:
        raise FileNotFoundError(path)
    return found


class _File(InputPartition):
    def __init__(self, path: str, first: int):
        self.path, self.first = path, first


#: Packet numbers of a file are its place among the files times this, plus the place within it.
PER_FILE = 1 << 40
#: Bytes that are read or written at once.
BLOCK = 1 << 20


def _rows(partition: _File):
    with open(partition.path, "rb", buffering=BLOCK) as f:
        for number, *rest in read_capture(f):
            yield (partition.first + number, *rest)


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [_File(p, i * PER_FILE) for i, p in enumerate(_files(self.path))]

    def read(self, partition):
        return _rows(partition)


class _Stream(DataSourceStreamReader):
    """Files in the order in which they landed, ``maxFilesPerTrigger`` (64 by default) at a time, each a partition.

    An offset is the last file's time of landing (its inode's change, which renaming or copying sets and nothing sets
    back) and path, and how many files came before: a file with a smaller name that lands later is read later, and
    none is read twice. Files have to land whole, by renaming.
    """

    def __init__(self, options):
        self.path, self.most, self.at = options["path"], int(options.get("maxFilesPerTrigger", 64)), None

    def initialOffset(self):
        return {"files": 0, "landed": 0, "path": ""}

    def _after(self, start: dict) -> list[tuple[int, str]]:
        try:
            found = sorted((os.stat(p).st_ctime_ns, p) for p in _files(self.path))
        except FileNotFoundError:
            return []
        return [x for x in found if x > (start["landed"], start["path"])]

    def latestOffset(self):
        start = self.at or self.initialOffset()
        new = self._after(start)[: self.most]
        if new:
            self.at = {"files": start["files"] + len(new), "landed": new[-1][0], "path": new[-1][1]}
        return self.at or start

    def partitions(self, start, end):
        self.at = max(self.at or end, end, key=lambda x: (x["landed"], x["path"]))  # after a restart: go on behind it
        new = [x for x in self._after(start) if x <= (end["landed"], end["path"])]
        return [_File(p, (start["files"] + i) * PER_FILE) for i, (_, p) in enumerate(new)]

    def read(self, partition):
        return _rows(partition)

    def commit(self, end):
        pass


@dataclass
class _Written(WriterCommitMessage):
    path: str


class _Writer(DataSourceWriter):
    """One capture a partition, under a name of its own; with overwrite the folder's other captures go at the end."""

    def __init__(self, options, overwrite: bool):
        self.path, self.link, self.nano, self.overwrite = options["path"], int(options.get("linkType", 1)), options.get("nanoseconds", "false") == "true", overwrite
        self.job = uuid.uuid4().hex[:12]

    def write(self, rows):
        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        name = os.path.join(self.path, f"part-{TaskContext.get().partitionId():05d}-{self.job}.pcap")
        own = f"{name}.{TaskContext.get().taskAttemptId()}"
        with open(own, "wb", buffering=BLOCK) as f:
            for piece in capture_pieces(((r.ts_ns, r.orig_len, bytes(r.data)) for r in rows), self.link, self.nano):
                f.write(piece)
        os.replace(own, name)  # a task that is run again leaves one whole file
        return _Written(name)

    def commit(self, messages):
        if self.overwrite:
            kept = {m.path for m in messages if m is not None}
            for old in set(glob.glob(os.path.join(self.path, "*.pcap"))) - kept:
                os.remove(old)

    def abort(self, messages):
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


class PcapSource(DataSource):
    @classmethod
    def name(cls):
        return "pcap"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"])

    def streamReader(self, schema):
        return _Stream(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PcapSource)


def _contents(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, first): first is the file's place by name times 2^40; the names are ranked where they are."""
    content = spark.read.format("binaryFile").load(path).select("path", "content")
    place = (F.row_number().over(Window.orderBy("path")) - 1).cast("long") * PER_FILE  # of names alone, a row a file
    return content.join(content.select("path").withColumn("first", place), "path")


def packets(spark: SparkSession, path: str) -> DataFrame:
    """Packets of the captures under ``path``, in any store: files are read by Spark, and split into rows where they are.

    pkt_no is the file's place by name times 2^40, plus the place within it.
    """
    import pyarrow as pa

    schema = pa.schema([("pkt_no", pa.int64()), ("ts_ns", pa.int64()), ("orig_len", pa.int64()), ("link_type", pa.int32()), ("data", pa.binary())])

    def run(batches):
        for batch in batches:
            for first, data in zip(batch.column("first").to_pylist(), batch.column("content"), strict=True):
                found = ((first + n, *rest) for n, *rest in read_capture(io.BytesIO(data.as_buffer())))
                while rows := list(itertools.islice(found, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return _contents(spark, path).select("first", "content").mapInArrow(run, SCHEMA)


def checked(spark: SparkSession, path: str) -> DataFrame:
    """Of the captures under ``path``: rows (path, packets, malformed_records), one a file."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                cut: list = []
                out.append((name, sum(1 for _ in read_capture(io.BytesIO(data.as_buffer()), cut)), len(cut)))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["path", "packets", "malformed_records"])

    return _contents(spark, path).select("path", "content").mapInArrow(run, "path string, packets long, malformed_records long")


def replayed(captured: DataFrame, loops: int) -> DataFrame:
    """The packets ``loops`` times over, each round numbered behind the one before; a table can't be endless (0)."""
    if loops < 1:
        raise ValueError("loops has to be 1 or more: replay without an end is no table")
    if captured.isEmpty():
        raise NotACapture("an empty capture can't be replayed")
    most = captured.agg(F.max("pkt_no")).first()[0] + 1
    rounds = captured.select("*", F.explode(F.sequence(F.lit(0), F.lit(loops - 1))).alias("_round"))
    return rounds.withColumn("pkt_no", F.col("_round") * most + F.col("pkt_no")).drop("_round")
