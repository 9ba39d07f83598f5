"""Transaction files: CSV with columns by header name, encoding detection per file, dispatch by file
extension, and the read-or-sample fallback."""

from __future__ import annotations

import os
import re
from functools import reduce
from typing import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.schema import SUPPORTED_EXTENSIONS
from tillroll.session import store

BROADCAST_FILES = 100_000  # file names of some hundred bytes


def read_csv(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8", multiline: bool = False,
             glob: str | None = None) -> DataFrame:
    """CSV with header, every column read as text (``clean`` types it; dates day-first).

    Columns carry the names of the header, in any order; extra columns are kept and missing ones are
    found by the validation. All files below ``path`` must share one header: a file with another one
    fails when it is read, as its values would shift. This is not checked where a header name is blank,
    since Spark makes up a name then. ``multiline`` allows quoted line breaks inside fields; it makes
    each file one task (not splittable), so it is off for transaction files.
    """
    reader = (spark.read.option("header", True).option("encoding", encoding).option("mode", "PERMISSIVE")
              .option("multiLine", multiline).option("recursiveFileLookup", True))
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    schema = reader.csv(path).schema
    blank = any(re.fullmatch(r"_c\d+", name) for name in schema.names)
    return reader.schema(schema).option("enforceSchema", blank).csv(path)


def file_encodings(spark: SparkSession, path: str | list[str], glob: str = "*.csv") -> DataFrame:
    """Per file: is every line valid UTF-8?

    The text source keeps the raw bytes of each line, so ``is_valid_utf8`` sees them
    undecoded; lines are checked in parallel and whole files are never held in memory.
    """
    lines = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path)
    return (lines.groupBy(F.col("_metadata.file_path").alias("file"))
            .agg(F.bool_and(F.is_valid_utf8("value")).alias("utf8")))


def header_name(name: str) -> str:
    """A header name that was read as latin-1, decoded as UTF-8 where it is that, without byte order mark."""
    try:
        return name.encode("latin-1").decode("utf-8").removeprefix("\ufeff")
    except UnicodeDecodeError:
        return name


def headers(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """First line of each file (one pass over their lines; one row per file reaches the driver)."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("at"))
    return {r["file"]: r["line"] for r in lines.groupBy("file").agg(F.min_by("value", "at").alias("line")).collect()}


def read_uploads(spark: SparkSession, paths: list[str], file_column: str = "dataset_id") -> DataFrame:
    """Files of any headers and encodings as one table with columns by name; ``file_column`` holds the name of the file. Columns
    that a file lacks are null, which its validation finds. Files with one header are read together."""
    groups: dict[str, list[str]] = {}
    for file, line in sorted(headers(spark, paths).items()):
        groups.setdefault(line, []).append(file)
    parts = [read_csv_auto(spark, files, file_column=file_column) for files in groups.values()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_csv_auto(spark: SparkSession, path: str | list[str], glob: str = "*.csv", multiline: bool = False,
                  file_column: str | None = None) -> DataFrame:
    """UTF-8 files read as UTF-8, the others as latin-1; ``file_column`` adds the name of the file.

    Spark's CSV reader replaces bad bytes instead of failing. Latin-1 keeps every byte as one
    character, so all files are read that way and the texts of files that hold only valid UTF-8 (see
    :func:`file_encodings`) are decoded again. The names of the other files are stored, and the decision goes to the tasks
    that read the rows: up to ``BROADCAST_FILES`` names are broadcast, so the rows are not shuffled. Beyond that they are
    joined by file, where Spark splits the rows of a large file over several tasks.
    """
    raw = read_csv(spark, path, "ISO-8859-1", multiline, glob)
    latin = store(file_encodings(spark, path, glob).where(~F.col("utf8")).select(F.col("file").alias("_latin_file")), "latin-files")
    if latin.count() <= BROADCAST_FILES:
        latin = F.broadcast(latin)
    name = [F.col("_metadata.file_name").alias(file_column)] if file_column else []
    tagged = raw.select("*", *name, F.col("_metadata.file_path").alias("_file"))
    columns = [(F.col(f"`{name.replace('`', '``')}`"), header_name(name)) for name in raw.columns]
    return tagged.join(latin, F.col("_file") == F.col("_latin_file"), "left").select(*[
        F.when(F.col("_latin_file").isNull(), F.encode(c, "ISO-8859-1").cast("string")).otherwise(c).alias(name)
        for c, name in columns], *([file_column] if file_column else []))


def load_file(spark: SparkSession, path: str, extensions: Sequence[str] = SUPPORTED_EXTENSIONS) -> DataFrame:
    """S3: choose the reader from the file extension.

    ``.csv`` -> :func:`read_csv_auto`; ``.parquet`` -> Parquet (our tables). ``.xlsx`` /
    ``.xls`` are recognised but have no Spark reader here; anything else is rejected with
    the same message as the studied service.
    """
    name = os.path.basename(path.rstrip("/"))
    if name.endswith(".parquet"):
        return spark.read.parquet(path)
    if name.endswith(".csv"):
        return read_csv_auto(spark, path, glob="*.csv")
    if any(name.endswith(e) for e in extensions if e != ".csv"):
        raise NotImplementedError(f"Excel files are not read on Spark: {name}")
    raise ValueError(f"Unsupported file type: {name}")


def path_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path).schema  # noqa: B018  the path is looked up with the schema
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def load_or_sample(spark: SparkSession, path: str, n_rows: int = 10000) -> DataFrame:
    """The file when it exists, else generated sample transactions."""
    if path_exists(spark, path):
        return load_file(spark, path)
    from tillroll.sources.sample import sample_transactions
    return sample_transactions(spark, n_rows)
