"""Tables in files and ZIP members of mixed formats: delimited text of unknown encoding and delimiter, JSON lines, XPORT.

A data source whose partitions are files and members of archives; a task streams its member and gives out rows in batches, so a member may be larger than memory.  Every
row is a map of its cells, so tables with different headers are one frame; `columns_of` makes columns of it.  A row that can't be read is kept aside as text in
`corrupt`, and the rest of its member goes on.

The source opens files itself, so every executor must see the folder.  `read_members` takes a store that only Spark reads (any path that isn't local) by Spark's
binary files instead, an archive a row of at most 2 GB.
"""
from __future__ import annotations

import codecs
import csv
import glob
import gzip
import io
import json
import os
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestone.sources.files import ibm_double

SCHEMA = "file string, member string, row long, cells map<string,string>, corrupt string"
TEXT, LINES, XPORT = (".csv", ".tsv", ".tab", ".txt"), (".jsonl", ".ndjson", ".json"), (".xpt",)
#: Texts that stand for no value.
MISSING = frozenset(["", "NA", "N/A", "n/a", "na", "NaN", "nan", "NULL", "null", "None", "#N/A", ".", "-"])
#: Bytes that encoding and delimiter are told from, rows of a batch, and lines that one quoted row may take.
SAMPLE, BATCH, QUOTED_LINES = 1 << 16, 5_000, 1_000


def safe(name: str) -> bool:
    """Whether an archive's member is a file that stays within the folder, and none of the system's own."""
    parts = name.replace("\\", "/").split("/")
    return not (name.endswith("/") or name.startswith(("/", "\\")) or ".." in parts or "__MACOSX" in parts or parts[-1].startswith(".") or parts[0].endswith(":"))


def encoding_of(sample: bytes, whole: bool) -> str:
    """utf-16 by its mark, else utf-8 if the sample is that (but for a letter cut at its end), else cp1252 if it has no undefined byte, else latin-1."""
    if sample.startswith((codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)):
        return "utf-16"
    for name in ("utf-8-sig", "cp1252"):
        try:
            codecs.getincrementaldecoder(name)("strict").decode(sample, final=whole)
            return name
        except UnicodeDecodeError:
            continue
    return "latin-1"


def delimiter_of(text: str, suffix: str) -> str:
    """The delimiter that the sample is regular in; else a tab for .tsv and .tab; else the commonest of the header."""
    try:
        return csv.Sniffer().sniff(text, delimiters=",\t;|").delimiter
    except csv.Error:
        first = text.splitlines()[0] if text else ""
        return "\t" if suffix in (".tsv", ".tab") else max(",\t;|", key=first.count)


def _lines(stream, encoding: str) -> Iterator[tuple[str, bool]]:
    """Lines with whether they could be decoded; a line that couldn't is given byte by byte."""
    if encoding == "utf-16":  # a line's end isn't a byte here
        for line in io.TextIOWrapper(stream, encoding, errors="replace", newline=""):
            yield line, "\ufffd" not in line
        return
    for k, raw in enumerate(iter(stream.readline, b"")):
        if not k and encoding == "utf-8-sig":
            raw = raw.removeprefix(codecs.BOM_UTF8)
        try:
            yield raw.decode("utf-8" if encoding == "utf-8-sig" else encoding), True
        except UnicodeDecodeError:
            yield raw.decode("latin-1"), False


def _records(lines: Iterator[tuple[str, bool]]) -> Iterator[tuple[str, bool]]:
    """Lines joined while a quotation is open; one that doesn't end within QUOTED_LINES is a broken line by itself, and the lines after it are read anew."""
    ahead: list[tuple[str, bool]] = []

    def following():
        return ahead.pop(0) if ahead else next(lines, None)

    while (first := following()) is not None:
        text, ok = first
        held = [first]
        while text.count('"') % 2 and len(held) <= QUOTED_LINES and (more := following()) is not None:
            held.append(more)
            text, ok = text + more[0], ok and more[1]
        if text.count('"') % 2:
            ahead[:0] = held[1:]
            text, ok = first[0], False
        yield text, ok


def _cells(names: list[str], values: list) -> list[tuple[str, str | None]]:
    clean = lambda v: None if v is None or (v := str(v).strip()) in MISSING else v
    return [(n, clean(v)) for n, v in zip(names, values, strict=False)]


def delimited(stream, suffix: str) -> Iterator[tuple[int, list | None, str | None]]:
    """Rows of a delimited text as (number, cells, corrupt): a row shorter than the header lacks its last cells, a longer one is corrupt; blank rows are left out."""
    sample = stream.peek(SAMPLE)[:SAMPLE]
    encoding = encoding_of(sample, len(sample) < SAMPLE)
    text = sample.decode("utf-16" if encoding == "utf-16" else encoding, errors="ignore")
    delimiter = delimiter_of(text, suffix)
    names: list[str] | None = None
    row = 0
    for line, ok in _records(_lines(stream, encoding)):
        if not line.strip():
            continue
        try:
            values = next(csv.reader([line.rstrip("\r\n")] if "\n" not in line.rstrip("\r\n") else io.StringIO(line, newline=""), delimiter=delimiter, strict=True)) if ok else None
        except (csv.Error, StopIteration):
            values = None
        if names is None:
            if values is None:
                yield row, None, line.rstrip("\r\n")
                return
            names, seen = [], {}
            for i, n in enumerate(values):
                n = n.strip() or f"column_{i + 1}"
                seen[n] = seen.get(n, 0) + 1
                names.append(n if seen[n] == 1 else f"{n}.{seen[n] - 1}")
            continue
        if values is None or len(values) > len(names):
            yield row, None, line.rstrip("\r\n")
        elif any(v.strip() for v in values):
            yield row, _cells(names, values + [None] * (len(names) - len(values))), None
        else:
            continue
        row += 1


def json_lines(stream, suffix: str) -> Iterator[tuple[int, list | None, str | None]]:
    """One object a line (a .json file may also be one array or one object); nested values stay JSON."""
    if suffix == ".json":
        try:
            whole = json.load(stream)
            lines = (json.dumps(x) for x in (whole if isinstance(whole, list) else [whole]))
        except ValueError as e:
            yield 0, None, str(e)
            return
    else:
        lines = (raw.decode("utf-8", errors="replace") for raw in stream)
    for row, line in enumerate(x for x in lines if x.strip()):
        try:
            value = json.loads(line)
        except ValueError:
            value = None
        if isinstance(value, dict):
            plain = [v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False) for v in value.values()]
            yield row, _cells(list(value), plain), None
        else:
            yield row, None, line.rstrip("\r\n")


def xport(stream, suffix: str) -> Iterator[tuple[int, list | None, str | None]]:
    """Records of the first table of a SAS XPORT v5 file, read one after another."""
    card = lambda n=1: stream.read(80 * n)
    head = b"HEADER RECORD*******"
    line = card()
    while line and not line.startswith(head + b"NAMESTR"):
        line = card()
    if not line:
        yield 0, None, "no table"
        return
    count = int(line[54:58])
    raw = stream.read(-(-140 * count // 80) * 80)
    columns = []
    for i in range(count):
        rec = raw[140 * i : 140 * (i + 1)]
        kind, _, length, _ = struct.unpack(">hhhh", rec[:8])
        columns.append((rec[8:16].decode("ascii").strip(), kind == 1, length, struct.unpack(">i", rec[84:88])[0]))
    size, row = sum(c[2] for c in columns), 0
    if not card().startswith(head + b"OBS"):
        yield 0, None, "no records"
        return
    while rec := stream.read(size):
        if rec.startswith(head):  # another table
            return
        if len(rec) < size:
            if rec.strip(b" "):
                yield row, None, rec.decode("latin-1")
            return
        if not rec.strip(b" "):
            continue
        cells = []
        for name, number, length, place in columns:
            value = rec[place : place + length]
            value = ibm_double(value) if number else value.decode("latin-1").strip()
            cells.append((name, None if value in (None, "") else (repr(int(value)) if isinstance(value, float) and value.is_integer() and abs(value) < 1e15 else str(value))))
        yield row, cells, None
        row += 1


def rows_of(stream, name: str) -> Iterator[tuple[int, list | None, str | None]]:
    suffix = os.path.splitext(name.lower().removesuffix(".gz"))[1]
    if name.lower().endswith(".gz"):
        stream = gzip.GzipFile(fileobj=stream)
    read = delimited if suffix in TEXT else json_lines if suffix in LINES else xport if suffix in XPORT else None
    if read is None:
        yield 0, None, f"unknown format: {suffix or 'none'}"
        return
    try:
        yield from read(io.BufferedReader(stream, SAMPLE) if not isinstance(stream, io.BufferedReader) else stream, suffix)
    except (OSError, EOFError, zipfile.BadZipFile, gzip.BadGzipFile, struct.error, ValueError) as e:
        yield -1, None, f"{type(e).__name__}: {e}"  # what was read before stays


def _batches(file: str, member: str | None, rows) -> Iterator[pa.RecordBatch]:
    kind = pa.map_(pa.string(), pa.string())
    held: list[tuple] = []

    def batch():
        n = len(held)
        return pa.RecordBatch.from_arrays(
            [pa.array([file] * n, pa.string()), pa.array([member] * n, pa.string()), pa.array([r[0] for r in held], pa.int64()), pa.array([r[1] for r in held], kind), pa.array([r[2] for r in held], pa.string())],
            ["file", "member", "row", "cells", "corrupt"],
        )

    for r in rows:
        held.append(r)
        if len(held) == BATCH:
            yield batch()
            held.clear()
    if held:
        yield batch()


def _in_archive(archive: zipfile.ZipFile, file: str, wanted: list[str] | None = None) -> Iterator[pa.RecordBatch]:
    for info in archive.infolist():
        if safe(info.filename) and (wanted is None or info.filename in wanted):
            try:
                with archive.open(info) as stream:
                    yield from _batches(file, info.filename, rows_of(stream, info.filename))
            except (RuntimeError, zipfile.BadZipFile, NotImplementedError) as e:  # encrypted, broken, or packed in an unknown way
                yield from _batches(file, info.filename, [(0, None, f"{type(e).__name__}: {e}")])


class Member(InputPartition):
    def __init__(self, file: str, member: str | None):
        self.file, self.member = file, member


class Members(DataSource):
    """spark.read.format("members").load(path): files, folders and globs of tables and ZIP archives of tables."""

    @classmethod
    def name(cls) -> str:
        return "members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.removeprefix("file://")

    def partitions(self) -> list[Member]:
        """One for each file and each safe member: only directories of archives are read here."""
        files = []
        for p in sorted(glob.glob(self.path)) or [self.path]:
            inside = sorted(os.path.join(d, f) for d, _, names in os.walk(p) for f in names if not f.startswith(".") and "__MACOSX" not in d) if os.path.isdir(p) else [p]
            files += inside
        out = []
        for f in files:
            if not os.path.exists(f):
                raise FileNotFoundError(f)
            if not f.lower().endswith(".zip"):
                out.append(Member(f, None))
                continue
            try:
                with zipfile.ZipFile(f) as z:
                    out += [Member(f, i.filename) for i in z.infolist() if safe(i.filename)]
            except zipfile.BadZipFile:
                out.append(Member(f, None))  # told as corrupt by its task
        return out

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        if partition.member is not None:
            with zipfile.ZipFile(partition.file) as z:
                yield from _in_archive(z, partition.file, [partition.member])
        elif partition.file.lower().endswith(".zip"):
            yield from _batches(partition.file, None, [(0, None, "BadZipFile: not an archive")])
        else:
            with open(partition.file, "rb") as stream:
                yield from _batches(partition.file, None, rows_of(stream, partition.file))


def _whole(batches):
    """Rows of files that came as bytes."""
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            stream = io.BytesIO(content.as_buffer())
            if not path.lower().endswith(".zip"):
                yield from _batches(path, None, rows_of(stream, path))
                continue
            try:
                with zipfile.ZipFile(stream) as z:
                    yield from _in_archive(z, path)
            except zipfile.BadZipFile:
                yield from _batches(path, None, [(0, None, "BadZipFile: not an archive")])


def read_members(spark: SparkSession, path: str) -> DataFrame:
    """file, member (null outside archives), row, cells, corrupt of all tables under a path; row counts from 0 in each table, -1 where reading broke off."""
    if path.startswith("file://") or "://" not in path:
        spark.dataSource.register(Members)
        return spark.read.format("members").load(path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return archive_rows(files)


def archive_rows(files: DataFrame) -> DataFrame:
    """The rows of files that are bytes (path, content), as read_members gives them; the path's ending tells the format."""
    return files.select("path", "content").mapInArrow(_whole, SCHEMA)


def columns_of(rows: DataFrame, names: list[str]) -> DataFrame:
    """The readable rows with these cells as text columns, null where a table lacks them."""
    return rows.filter("corrupt IS NULL").select("file", "member", "row", *[F.try_element_at("cells", F.lit(n)).alias(n) for n in names])
