"""Delimited members of ZIP archives as a data source whose partitions are ranges of a member's bytes.

A task opens the archive itself and unpacks its member as a stream, up to the range without parsing; so neither an archive nor a
member is ever whole in a row or in memory, and a large member is parsed by many tasks. A record belongs to the range in which its
first byte lies; quotes are counted from the member's start, so that line ends within quotes end no record.

Archives are read through pyarrow's file systems if their path has a scheme, else as files that all executors see. Members
that are packed in a way that Python can't unpack, such as Deflate64, are refused by name before any task starts.
"""

from __future__ import annotations

import csv
import glob
import json
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Ways of packing, by number: those that Python unpacks, and names of others.
KNOWN = {0: "stored", 8: "Deflate", 12: "bzip2", 14: "LZMA"}
OTHERS = {9: "Deflate64", 93: "Zstandard", 95: "XZ", 98: "PPMd"}


def opened(path: str):  # noqa: ANN201
    if "://" not in path:
        return open(path, "rb")
    from pyarrow import fs

    where, inside = fs.FileSystem.from_uri(path)
    return where.open_input_file(inside)


def listed(path: str) -> list[str]:
    """The archives that a path, a local pattern or a folder names, in order."""
    if "://" not in path:
        return sorted(glob.glob(path)) if glob.has_magic(path) else [path]
    from pyarrow import fs

    where, inside = fs.FileSystem.from_uri(path)
    if where.get_file_info(inside).type != fs.FileType.Directory:
        return [path]
    scheme = path.split("://", 1)[0]
    return sorted(f"{scheme}://{x.path.lstrip('/') if scheme != 'file' else x.path}" for x in where.get_file_info(fs.FileSelector(inside)) if x.path.lower().endswith(".zip"))


@dataclass
class Span(InputPartition):
    path: str
    member: str
    start: int
    end: int
    names: list[str]


def records(raw, start: int, end: int) -> Iterator[bytes]:  # noqa: ANN001
    """The records of a stream of bytes whose first byte lies in start to end."""
    at, odd = 0, 0
    while at < start - 1:
        block = raw.read(min(1 << 20, start - 1 - at))
        if not block:
            return
        at += len(block)
        odd ^= block.count(b'"') & 1
    if start:
        while True:  # the rest of the record before
            line = raw.readline()
            at += len(line)
            odd ^= line.count(b'"') & 1
            if not line:
                return
            if not odd and line.endswith(b"\n"):
                break
    while at < end:
        lines, odd = [], 0
        while True:
            line = raw.readline()
            at += len(line)
            odd ^= line.count(b'"') & 1
            lines.append(line)
            if not line or not odd:
                break
        record = b"".join(lines)
        if not record:
            return
        yield record


class Members(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.suffix = options["path"], options.get("suffix", "").lower()
        self.columns = json.loads(options["columns"])
        self.delimiter = options.get("delimiter", ",")
        self.header = options.get("header", "true").lower() == "true"
        self.every = options.get("members", "first").lower() == "all"
        self.split = int(options.get("splitBytes", 64 << 20))

    def parse(self, rows: Iterator[bytes]) -> Iterator[list[str]]:
        return csv.reader((r.decode("utf-8", "replace") for r in rows), delimiter=self.delimiter)

    def partitions(self) -> list[Span]:
        out = []
        for path in listed(self.path):
            with opened(path) as f, zipfile.ZipFile(f) as z:
                members = [m for m in z.infolist() if not m.is_dir() and m.filename.lower().endswith(self.suffix)]
                for m in members if self.every else members[:1]:
                    if m.compress_type not in KNOWN:
                        raise ValueError(f"{path}: {m.filename} is packed as {OTHERS.get(m.compress_type, f'method {m.compress_type}')}, which can't be unpacked here; unpack it first")
                    names = self.columns
                    if self.header:
                        with z.open(m) as raw:
                            first = next(self.parse(records(raw, 0, 1)), [])
                        names = [n.lstrip("\ufeff") for n in first]
                    out += [Span(path, m.filename, i, min(i + self.split, m.file_size), names) for i in range(0, m.file_size, self.split)]
        return out

    def read(self, span: Span) -> Iterator[tuple]:
        at = [span.names.index(c) if c in span.names else None for c in self.columns]
        with opened(span.path) as f, zipfile.ZipFile(f) as z, z.open(span.member) as raw:
            rows = self.parse(records(raw, span.start, span.end))
            if self.header and span.start == 0:
                next(rows, None)
            for r in rows:
                if r:
                    yield tuple(None if i is None or i >= len(r) else r[i] for i in at)


class ZipMembers(DataSource):
    """Format zip_members. Options: path, columns (a JSON list), suffix, delimiter, header, members (first or all of each archive), splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return ", ".join(f"`{c}` string" for c in json.loads(self.options["columns"]))

    def reader(self, schema) -> Members:  # noqa: ANN001
        return Members(self.options)


def read_zip_members(spark: SparkSession, path: str, suffix: str, columns: list[str], *, delimiter: str = ",", header: bool = True, members: str = "first", split_bytes: int = 64 << 20) -> DataFrame:
    """The first member ending in suffix of each archive (or all), as text columns; without a header columns are the fields in order. Missing fields are null."""
    spark.dataSource.register(ZipMembers)
    options = {"suffix": suffix, "columns": json.dumps(columns), "delimiter": delimiter, "header": str(header), "members": members, "splitBytes": str(split_bytes)}
    return spark.read.format("zip_members").options(**options).load(path)
