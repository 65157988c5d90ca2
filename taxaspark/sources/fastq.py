"""A Spark data source for FASTQ: spark.read.format("fastq").load(paths).

Plain files are cut into byte ranges; a range owns the records that begin in it, and finds the first
one by form (a line that starts with "@", with "+" two lines on and equal lengths between), since "@"
alone may begin a quality line. A .gz file, of any number of members, is one partition. Rows come as
Arrow batches. `numbered` adds each record's number in its file from the counts per range, which is
what pairs mates.
"""

from __future__ import annotations

import glob
import gzip
import io
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schemas import FASTQ
from ..session import ship
from .shared import kept

SPLIT_BYTES = 64 << 20
BATCH = 4096


class FastqError(ValueError):
    pass


def _files(path: str) -> list[str]:
    out: list[str] = []
    for p in path.split(","):
        p = p.removeprefix("file://")
        if "://" in p:
            out.append(p)
        elif os.path.isdir(p):
            out += sorted(f for f in glob.glob(f"{p}/**", recursive=True) if os.path.isfile(f) and not os.path.basename(f).startswith(("_", ".")))
        else:
            found = sorted(glob.glob(p)) or ([p] if os.path.exists(p) else [])
            if not found:
                raise FileNotFoundError(p)
            out += found
    return out


def _open(path: str):
    """(binary stream, size); remote paths go through Arrow's file systems."""
    if "://" in path:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        return system.open_input_file(inner), system.get_file_info(inner).size
    return open(path, "rb"), os.path.getsize(path)


def _line(raw: bytes) -> bytes:
    raw = raw[:-1] if raw.endswith(b"\n") else raw
    return raw[:-1] if raw.endswith(b"\r") else raw


def records(stream: io.BufferedIOBase, where: str, end: int | None = None, at: int = 0) -> Iterator[tuple]:
    """(id, desc, seq, sep, qual) of the records that begin before `end`; blank lines before a header are skipped."""
    while end is None or at < end:
        raw = stream.readline()
        if not raw:
            return
        at += len(raw)
        head = _line(raw)
        if not head.strip():
            continue
        if not head.startswith(b"@"):
            raise FastqError(f"{where}: invalid head, '@' expected: {head[:80]!r}")
        rest = [stream.readline() for _ in range(3)]
        at += sum(map(len, rest))
        if not all(rest):
            raise FastqError(f"{where}: incomplete record {head[:80]!r}")
        seq, sep, qual = map(_line, rest)
        if not sep.startswith(b"+"):
            raise FastqError(f"{where}: invalid separator, '+' expected: {sep[:80]!r}")
        if len(seq) != len(qual):
            raise FastqError(f"{where}: unequal length of sequence ({len(seq)}) and quality ({len(qual)}) in {head[:80]!r}")
        cut = min((i for i in (head.find(b" "), head.find(b"\t")) if i >= 0), default=len(head))
        text = lambda x: x.decode("utf-8", "replace")
        yield text(head[1:cut]), text(head[cut + 1 :]) or None, text(seq), text(sep), text(qual)


def first_record(stream, start: int) -> int:
    """The offset of the first record that begins at or behind `start`."""
    if start == 0:
        return 0
    stream.seek(start - 1)
    at = start - 1 + len(stream.readline())
    window: list[tuple[int, bytes]] = []
    while True:
        raw = stream.readline()
        if not raw:
            return at
        window.append((at, _line(raw)))
        at += len(raw)
        if len(window) == 4:
            (begin, head), (_, seq), (_, sep), (_, qual) = window
            if head.startswith(b"@") and sep.startswith(b"+") and len(seq) == len(qual):
                return begin
            window.pop(0)


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int | None):
        self.path, self.start, self.end = path, start, end


class FastqReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.size = int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))

    def partitions(self) -> list[Range]:
        out = []
        for f in _files(self.path):
            if f.lower().endswith(".gz"):
                out.append(Range(f, 0, None))
                continue
            stream, size = _open(f)
            stream.close()
            out += [Range(f, s, min(size, s + self.size)) for s in range(0, max(size, 1), self.size)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        stream, _ = _open(part.path)
        with stream:
            if part.end is None:
                found = records(io.BufferedReader(gzip.GzipFile(fileobj=stream)), part.path)
            else:
                at = first_record(stream, part.start)
                stream.seek(at)
                found = records(io.BufferedReader(stream) if not isinstance(stream, io.BufferedReader) else stream, part.path, part.end, at)
            batch, pos = [], 0
            for r in found:
                batch.append(r)
                if len(batch) == BATCH:
                    yield self._rows(batch, part, pos)
                    pos += len(batch)
                    batch = []
            if batch:
                yield self._rows(batch, part, pos)

    @staticmethod
    def _rows(batch: list[tuple], part: Range, pos: int) -> pa.RecordBatch:
        n = len(batch)
        cols = [pa.array(c, pa.string()) for c in zip(*batch, strict=True)]
        cols += [pa.array([part.path] * n), pa.array([part.start] * n, pa.int64()), pa.array(range(pos, pos + n), pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names=["id", "desc", "seq", "sep", "qual", "source", "split", "pos"])


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return FASTQ

    def reader(self, schema) -> FastqReader:
        return FastqReader(dict(self.options))


def read_fastq(spark: SparkSession, path: str | list[str], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    ship(spark)
    spark.dataSource.register(FastqSource)
    return spark.read.format("fastq").option("splitBytes", split_bytes).load(path if isinstance(path, str) else ",".join(path))


def numbered(reads: DataFrame) -> DataFrame:
    """Adds record_no, from 0 in order of file, range and place: only the counts per range are shuffled."""
    sizes = reads.groupBy("source", "split").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(F.lit(0)).orderBy("source", "split").rowsBetween(W.unboundedPreceding, -1)
    base = sizes.select(F.col("source").alias("_s"), F.col("split").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return reads.join(base, (F.col("source") == F.col("_s")) & (F.col("split") == F.col("_p"))).withColumn("record_no", F.col("_base") + F.col("pos")).drop("_s", "_p", "_base")


def pair_mates(reads1: DataFrame, reads2: DataFrame) -> DataFrame:
    """r1 and r2 structs of the records of one number; an error where one side lacks it or the ids differ.

    Both sides are written to the shared folder first, so each file is parsed once, for its counts and its records.
    """
    parts = F.struct("id", "desc", "seq", "sep", "qual")
    a = numbered(kept(reads1)).select("record_no", parts.alias("r1"))
    b = numbered(kept(reads2)).select("record_no", parts.alias("r2"))
    met = a.join(b, "record_no", "full_outer")
    return met.select("record_no", checked_pair(F.col("r1"), F.col("r2"), F.col("r1")).alias("r1"), F.col("r2"))


def checked_pair(r1: Column, r2: Column, value: Column) -> Column:
    lone = F.raise_error(F.lit("the files of mates have different numbers of records"))
    other = F.raise_error(F.concat(F.lit("ids of mates differ: "), r1["id"], F.lit(" and "), r2["id"]))
    return F.when(r1.isNull() | r2.isNull(), lone).when(r1["id"] != r2["id"], other).otherwise(value)
