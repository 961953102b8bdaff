"""CSV members of ZIP archives: every member of every archive is a table, opened by its own task."""

from __future__ import annotations

import codecs
import csv
import io
import itertools
import json
import posixpath
import zipfile
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tablewise.functions import rules
from tablewise.session import stage
from tablewise.sources.files import clean_header

ROW_SCHEMA = "archive string, member string, row_no long, fields array<string>, problem string"
ROWS_PER_BATCH = 5_000
_ROWS = T.StructType([
    T.StructField("archive", T.StringType()), T.StructField("member", T.StringType()), T.StructField("row_no", T.LongType()),
    T.StructField("fields", T.ArrayType(T.StringType())), T.StructField("problem", T.StringType()),
])
_PIECE = 1 << 18  # bytes of a member that are inflated at once
_HELD = 1 << 24  # characters of pieces that a task holds


def wanted_member(name: str) -> bool:
    base = posixpath.basename(name)
    hidden = name.startswith(".") or base.startswith(".") or rules.ZIP_METADATA in name
    return bool(base) and not hidden and base.lower().endswith(".csv")


def _decoded(raw: bytes) -> str:
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def _member_rows(archive: str, content: bytes, member: str | None, headers: bool) -> Iterator[tuple]:
    try:
        opened = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        raise ValueError(f"'{archive}' cannot be read as a ZIP archive") from None
    with opened:
        for name in filter(wanted_member, opened.namelist()):
            if member not in (None, name):
                continue
            try:
                text = _decoded(opened.read(name))
            except (zipfile.BadZipFile, RuntimeError, OSError) as problem:
                yield archive, name, -1, None, str(problem)  # a broken member does not stop the others
                continue
            filled = (row for row in csv.reader(io.StringIO(text, newline="")) if row)
            for number, fields in enumerate(filled):
                yield archive, name, number, fields, None
                if headers:
                    break


def unzip_rows(archives: DataFrame, member: str | None = None, headers: bool = False) -> DataFrame:
    """(archive, member, row_no, fields, problem) from a frame of (path, content), of one member or
    all, with ``headers`` the first row of each only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["archive", "member", "row_no", "fields", "problem"]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows = []
                for row in _member_rows(path, content, member, headers):
                    rows.append(row)
                    if len(rows) == ROWS_PER_BATCH:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
                yield pd.DataFrame(rows, columns=columns)

    return archives.select("path", "content").mapInPandas(run, ROW_SCHEMA)


def member_table(rows: DataFrame, member: str, header: list[str]) -> DataFrame:
    """One member as a table of text columns; surplus-field rows are skipped, short rows padded."""
    data = rows.filter(
        (F.col("member") == member) & (F.col("row_no") > 0) & (F.size("fields") <= len(header))
    )
    columns = []
    for i, name in enumerate(header):
        value = F.get("fields", F.lit(i))
        columns.append(F.when(~value.isin(*rules.CSV_MISSING), value).alias(clean_header(name)))
    return data.select(*columns)


def members(spark: SparkSession, path: str) -> list:
    """archive, member, fields (the header), problem of every member; metadata for the driver."""
    found = spark.read.format("binaryFile").load(path).select("path")  # the listing alone
    rows = rows_of_archives(spark, [r["path"] for r in found.collect()], headers=True)
    return rows.select("archive", "member", "fields", "problem").orderBy("archive", "member").collect()


def rows_of_archives(spark: SparkSession, archives: list[str], member: str | None = None, headers: bool = False) -> DataFrame:
    """The rows of archives, one task for each member, which is inflated as a stream. On stores that only Spark opens
    whole archives go to the tasks, which must hold them."""
    if not all(urlsplit(a).scheme in _STORES for a in archives):
        return unzip_rows(spark.read.format("binaryFile").load(archives), member, headers)
    spark.dataSource.register(ZipCsv)
    reader = spark.read.format("zip_csv").option("archives", json.dumps(archives)).option("headers", headers)
    return (reader if member is None else reader.option("member", member)).load()


def one_table(spark: SparkSession, archive: str, member: str, header: list[str]) -> DataFrame:
    return member_table(rows_of_archives(spark, [archive], member), member, header)


def surplus_rows(rows: DataFrame, header: list[str]) -> DataFrame:
    """How many rows of a member have more fields than its header, as one row."""
    return rows.filter((F.col("row_no") > 0) & (F.size("fields") > len(header))).agg(F.count(F.lit(1)).alias("skipped"))


# --- archives as a data source ------------------------------------------------------------------

_STORES = {"": "file", "file": "file", "s3": "s3", "s3a": "s3", "gs": "gs", "hdfs": "hdfs"}


def open_store(path: str):
    """A file that can be read from any place, wherever it lies."""
    parts = urlsplit(path)
    if _STORES[parts.scheme] == "file":
        return fs.LocalFileSystem().open_input_file(path.removeprefix("file://").removeprefix("file:"))
    store, name = fs.FileSystem.from_uri(f"{_STORES[parts.scheme]}://{parts.netloc}{parts.path}")
    return store.open_input_file(name)


@dataclass(frozen=True)
class Member(InputPartition):
    archive: str
    name: str | None
    problem: str | None = None


class _Whole(io.RawIOBase):
    """Bytes that a text reader takes from a member's stream, without a byte order mark."""

    def __init__(self, stream):
        self.stream = stream

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.stream.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


def encoding_of(stream) -> str:
    """UTF-8 where the whole stream is valid UTF-8, else Latin-1; read in pieces."""
    decoder = codecs.getincrementaldecoder("utf-8")()
    try:
        while piece := stream.read(_PIECE):
            decoder.decode(piece)
        decoder.decode(b"", final=True)
    except UnicodeDecodeError:
        return "latin-1"
    return "utf-8-sig"


class ZipCsvReader(DataSourceReader):
    """A partition for every CSV member, found in the central directories alone."""

    def __init__(self, options):
        self.archives = json.loads(options["archives"])
        self.member, self.headers = options.get("member"), str(options.get("headers", "false")).lower() == "true"

    def partitions(self) -> list[Member]:
        found = []
        for archive in self.archives:
            try:
                with open_store(archive) as file, zipfile.ZipFile(file) as opened:
                    names = [n for n in opened.namelist() if wanted_member(n) and self.member in (None, n)]
            except zipfile.BadZipFile:
                raise ValueError(f"'{archive}' cannot be read as a ZIP archive") from None
            found += [Member(archive, n) for n in names]
        return found or [Member("", None)]

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        if partition.name is None:
            return
        csv.field_size_limit(1 << 30)
        rows: list[list[str]] = []
        first = 0

        def batch(problem: str | None = None) -> pa.RecordBatch:
            n = len(rows) if problem is None else 1
            numbers = pa.array(range(first, first + n) if problem is None else [-1], pa.int64())
            same = [pa.array([v] * n, pa.string()) for v in (partition.archive, partition.name, problem)]
            fields = pa.array(rows if problem is None else [None], pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays([same[0], same[1], numbers, fields, same[2]], names=[f.name for f in _ROWS])

        try:
            with open_store(partition.archive) as file, zipfile.ZipFile(file) as opened:
                with opened.open(partition.name) as stream:
                    encoding = encoding_of(stream)
                with opened.open(partition.name) as stream:
                    text = io.TextIOWrapper(io.BufferedReader(_Whole(stream), _PIECE), encoding=encoding, newline="")
                    size = 0
                    for row in filter(None, csv.reader(text)):
                        rows.append(row)
                        size += sum(map(len, row))
                        if self.headers:
                            break
                        if len(rows) == ROWS_PER_BATCH or size > _PIECE * 16:
                            yield batch()
                            first, size = first + len(rows), 0
                            rows.clear()
        except (zipfile.BadZipFile, RuntimeError, OSError, EOFError, zlib.error) as problem:
            rows.clear()
            yield batch(str(problem) or type(problem).__name__)  # a broken member does not stop the others
            return
        if rows:
            yield batch()


class ZipCsv(DataSource):
    """``spark.read.format("zip_csv")``: rows of the CSV members of ZIP archives (options archives, member, headers)."""

    @classmethod
    def name(cls) -> str:
        return "zip_csv"

    def schema(self) -> T.StructType:
        return _ROWS

    def reader(self, schema: T.StructType) -> ZipCsvReader:
        return ZipCsvReader(self.options)


def _pieces(rows: DataFrame) -> DataFrame:
    """archive, text: the rows as CSV lines in pieces of about ``_PIECE`` characters, made where the rows lie (the archive is
    their first column). A task holds ``_HELD`` characters at most, however many archives and rows it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, io.StringIO] = {}

        def piece(name: str) -> pa.RecordBatch:
            text = held.pop(name).getvalue().encode()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([text], pa.binary())], names=["archive", "text"])

        for batch in batches:
            order = pc.sort_indices(batch.column(0))
            names, *columns = (c.take(order).to_pylist() for c in batch.columns)
            lines = zip(*columns)
            for name, run_of in itertools.groupby(names):
                out = held.setdefault(name, io.StringIO(newline=""))
                csv.writer(out).writerows(itertools.islice(lines, sum(1 for _ in run_of)))
                if out.tell() > _PIECE:
                    yield piece(name)
            if sum(out.tell() for out in held.values()) > _HELD:
                yield from map(piece, list(held))
        yield from map(piece, list(held))

    return rows.mapInArrow(run, "archive string, text binary")


def pack(rows: DataFrame, archive, member: str, folder: str) -> list[str]:
    """Write rows as CSV members of archives (named by the column ``archive``); their paths. All tasks make the lines; one
    task for each archive deflates them as a stream, piece by piece, so that it holds no more of a large archive."""
    columns = rows.columns

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        path = f"{folder}/{first.column(0)[0].as_py()}.zip"
        store = fs.LocalFileSystem()
        parts = urlsplit(path)
        target = path.removeprefix("file://").removeprefix("file:")
        if _STORES[parts.scheme] != "file":
            store, target = fs.FileSystem.from_uri(f"{_STORES[parts.scheme]}://{parts.netloc}{parts.path}")
        store.create_dir(posixpath.dirname(target), recursive=True)
        with store.open_output_stream(target) as file, zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as out:
            with out.open(member, "w", force_zip64=True) as stream:
                header = io.StringIO(newline="")
                csv.writer(header).writerow(columns)
                stream.write(header.getvalue().encode())
                for batch in itertools.chain([first], batches):
                    for text in batch.column(1):
                        stream.write(text.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

    name = F.coalesce(archive.cast("string"), F.lit("None"))
    texts = rows.select(name.alias("__archive"), *(F.col(f"`{c}`").cast("string").alias(c) for c in columns))
    pieces = stage(_pieces(texts), "archive-pieces")
    names = sorted(r["archive"] for r in pieces.select("archive").distinct().collect())
    if not names:
        return []
    number = F.array_position(F.lit(names), F.col("archive")).cast("int")
    apart = pieces.repartitionById(len(names), number)  # an archive to a task, unsorted
    return sorted(r["path"] for r in apart.mapInArrow(write, "path string").collect())


def archive_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """{member: table} of one archive or a pattern; members of one name in several archives are
    told apart by ``archive!member``. Only header rows are looked at on the driver."""
    found = [r for r in members(spark, path) if r["problem"] is None]
    times = Counter(r["member"] for r in found)
    return {
        r["member"] if times[r["member"]] == 1 else f"{posixpath.basename(r['archive'])}!{r['member']}":
            one_table(spark, r["archive"], r["member"], list(r["fields"]))
        for r in found
    }
