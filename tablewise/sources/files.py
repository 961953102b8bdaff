"""File listing, encoding probe and CSV tables.

CSV columns are read as text and typed later by the profile, so nothing is guessed from a
sample. Paths go to Hadoop file systems as they are (``s3a://``, ``hdfs://``, local).
"""

from __future__ import annotations

import posixpath
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.functions import names, rules

CORRUPT = "_corrupt_record"
QUOTED = r'"[^"]*"'


def list_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, length, extension) without reading any content."""
    listed = spark.read.format("binaryFile").load(paths)
    return listed.select(
        "path", "length", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("extension")
    )


def check_files(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """One row per rejected file with the reason; no size limit unless one is given."""
    unsupported = ~F.col("extension").isin(*rules.FILE_EXTENSIONS)
    reason = F.when(unsupported, F.concat(F.lit("Unsupported file type "), "extension"))
    if max_bytes is not None:
        reason = reason.when(F.col("length") > max_bytes, F.lit(f"File exceeds {max_bytes} bytes"))
    return files.select("path", reason.alias("reason")).filter(F.col("reason").isNotNull())


def probe_encodings(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, encoding): UTF-8 where every line of the file is valid UTF-8, else Latin-1.

    Whole files are checked line by line in the JVM, split over many tasks."""
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.is_valid_utf8("value").alias("valid")
    )
    per_file = lines.groupBy("path").agg(F.bool_and("valid").alias("valid"))
    return per_file.select("path", F.when(F.col("valid"), "UTF-8").otherwise("ISO-8859-1").alias("encoding"))


def has_line_breaks_in_quotes(spark: SparkSession, path: str | Sequence[str], encoding: str) -> bool:
    """Does any line hold an odd number of quotes, so that a field may go on in the next line?"""
    lines = spark.read.option("encoding", encoding).text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not lines.filter(quotes % 2 == 1).isEmpty()


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    encoding: str = "UTF-8",
    multi_line: bool | None = None,
    missing: Sequence[str] = rules.CSV_MISSING,
) -> DataFrame:
    """A CSV table, all columns text. Rows with too many fields are skipped (:func:`skipped_rows` counts them), short rows
    are filled with nulls. Files stay splittable unless a quoted field spans lines, which is
    looked up when ``multi_line`` is not given."""
    if multi_line is None:
        multi_line = has_line_breaks_in_quotes(spark, path, encoding)
    rows, header = _raw_rows(spark, path, encoding, multi_line)
    values = [F.col("`" + c.replace("`", "``") + "`") for c in header]
    # always true, but keeps a data column in the scan: Spark refuses to read the raw record alone
    anchored = F.coalesce(F.length(values[0]), F.lit(0)) >= 0
    kept = rows.filter(~_surplus(len(header)) & anchored)
    columns = [
        F.when(~value.isin(*missing), value).alias(clean_header(c)) for c, value in zip(header, values)
    ]
    return kept.select(*columns)


def _raw_rows(spark: SparkSession, path: str | Sequence[str], encoding: str, multi_line: bool) -> tuple[DataFrame, list[str]]:
    """The rows with the text of records whose fields are not those of the header, and the header."""
    reader = spark.read.options(
        header=True, inferSchema=False, encoding=encoding, multiLine=multi_line, quote='"', escape='"',
        mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, enforceSchema=True,
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
        columnPruning=False,  # keeps the check for surplus fields independent of the query
    )
    header = reader.csv(path).columns
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in header) + f", {CORRUPT} string"
    return reader.schema(schema).csv(path), header


def _surplus(fields: int) -> Column:
    """Does a record have more fields? Commas are counted once quoted parts are gone, in one pass over the record."""
    bare = F.regexp_replace(F.col(CORRUPT), QUOTED, "")
    commas = F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit("")))
    return F.coalesce(commas >= fields, F.lit(False))


def skipped_rows(spark: SparkSession, path: str | Sequence[str], encoding: str = "UTF-8", multi_line: bool | None = None) -> DataFrame:
    """How many records :func:`read_csv` skips because they have more fields than the header, as one row."""
    if multi_line is None:
        multi_line = has_line_breaks_in_quotes(spark, path, encoding)
    rows, header = _raw_rows(spark, path, encoding, multi_line)
    anchored = F.coalesce(F.length(F.col("`" + header[0].replace("`", "``") + "`")), F.lit(0)) >= 0
    return rows.filter(_surplus(len(header)) & anchored).agg(F.count(F.lit(1)).alias("skipped"))


def clean_header(name: str) -> str:
    return name.replace("\ufeff", "").replace("ï»¿", "").strip()


def read_tables(
    spark: SparkSession, paths: Sequence[str], session_id: str
) -> tuple[dict[str, DataFrame], dict[str, dict], list[str]]:
    """Tables by name, facts per file (name, size, encoding) and warnings for skipped files and rows.

    CSV files are read with the encoding probed for them, Parquet keeps its types, ZIP archives
    contribute one table per CSV member. Files and members of the same name are all kept: the later ones
    are named after their folder or archive too, or numbered."""
    from tablewise.sources.archives import members, one_table, rows_of_archives, surplus_rows

    tables: dict[str, DataFrame] = {}
    facts: dict[str, dict] = {}
    warnings: list[str] = []

    def free_name(file_name: str, parent: str) -> str:
        name = names.table_name(session_id, file_name)
        if name in tables:
            name = names.table_name(session_id, f"{parent}_{file_name}")
        number, base = 2, name
        while name in tables:
            name, number = f"{base}_{number}", number + 1
        return name

    def warn_of(file_name: str, counted: DataFrame) -> None:
        if skipped := counted.first()["skipped"]:
            warnings.append(f"'{file_name}': {skipped} rows with surplus fields are left out")

    csvs = [p for p in paths if p.lower().endswith(".csv")]
    encodings, sizes = {}, {}
    if csvs:
        encodings = {_plain_path(r["path"]): r["encoding"] for r in probe_encodings(spark, csvs).collect()}
        sizes = {_plain_path(r["path"]): r["length"] for r in list_files(spark, csvs).collect()}
    for path in paths:
        file_name = posixpath.basename(path.rstrip("/"))
        extension = posixpath.splitext(file_name)[1].lower()
        name = free_name(file_name, posixpath.basename(posixpath.dirname(path.rstrip("/"))))
        if extension == ".csv":
            encoding = encodings.get(_plain_path(path), "UTF-8")
            multi_line = has_line_breaks_in_quotes(spark, path, encoding)
            tables[name] = read_csv(spark, path, encoding, multi_line)
            warn_of(file_name, skipped_rows(spark, path, encoding, multi_line))
            facts[name] = {"file": file_name, "size": sizes.get(_plain_path(path)), "encoding": encoding}
        elif extension == ".parquet":
            tables[name] = spark.read.parquet(path)
            facts[name] = {"file": file_name, "size": None, "encoding": "binary"}
        elif extension == ".zip":
            for r in members(spark, path):
                base = posixpath.basename(r["member"])
                if r["problem"] is not None:
                    warnings.append(f"'{base}' of '{file_name}' is left out: {r['problem']}")
                    continue
                member_name, header = free_name(base, posixpath.splitext(posixpath.basename(r["archive"]))[0]), list(r["fields"])
                tables[member_name] = one_table(spark, r["archive"], r["member"], header)
                warn_of(base, surplus_rows(rows_of_archives(spark, [r["archive"]], r["member"]), header))
                facts[member_name] = {"file": base, "size": None, "encoding": "zip"}
        else:
            warnings.append(f"'{file_name}' is of no known kind and is left out")
    if not tables:
        raise ValueError("none of the files can be loaded")
    return tables, facts, warnings


def _plain_path(uri: str) -> str:
    return unquote(uri.removeprefix("file:")).replace("//", "/")
