"""Whole files as rows, in any store that Spark reads.

Formats whose records depend on order or on a header are parsed from the file's bytes, one
file a row. A file's rows come out only once it has parsed to its end; one that can't be parsed fails the
job, is left out whole, or is kept as a rejected row, as the reader's ``errors`` says.
"""

from __future__ import annotations

import os
import posixpath
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import shared_dir

#: Rows of a batch that a parser's rows are put into.
BATCH = 20_000


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, content), one row a file."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "content")


def parsed(files: DataFrame, parse: Callable[[str, bytes], Iterator[dict | pa.Table]], schema: str, errors: str = "keep") -> DataFrame:
    """The rows that ``parse(path, content)`` yields, as dictionaries or as Arrow tables of ``schema``.

    errors: "raise" fails the job with the file's name; "skip" leaves the whole file out; "keep" adds
    ``source`` and ``parse_error`` columns and gives a file that fails one row of nulls and its error."""
    if errors not in ("raise", "skip", "keep"):
        raise ValueError("errors is raise, skip or keep")
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    names = kinds.names

    def tables(path, content):
        rows = []
        for row in parse(path, content):
            if isinstance(row, pa.Table):
                yield from row.cast(kinds).to_batches(BATCH)
                continue
            rows.append({n: row.get(n) for n in names})
            if len(rows) >= BATCH:
                yield pa.RecordBatch.from_pylist(rows, kinds)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kinds)

    def with_source(batch, path, error):
        n = batch.num_rows
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([path] * n, pa.string()), pa.array([error] * n, pa.string())], names=[*names, "source", "parse_error"])

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    found, error = list(tables(path, content)), None
                except Exception as e:  # noqa: BLE001  whatever is wrong with a file, it is the file that is rejected
                    if errors == "raise":
                        raise ValueError(f"{path}: {type(e).__name__}: {e}") from e
                    found, error = [], f"{type(e).__name__}: {e}"
                if errors != "keep":
                    yield from found
                    continue
                yield from (with_source(x, path, None) for x in found)
                if error:
                    yield with_source(pa.RecordBatch.from_pylist([dict.fromkeys(names)], kinds), path, error)

    return files.select("path", "content").mapInArrow(run, schema + (", source string, parse_error string" if errors == "keep" else ""))


def good(df: DataFrame) -> DataFrame:
    return df.where("parse_error is null").drop("parse_error", "source")


def rejected(df: DataFrame) -> DataFrame:
    return df.where("parse_error is not null").select("source", F.col("parse_error").alias("error"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for files that are written and read again."""
    return f"{shared_dir(spark)}/terragrid-files/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _store(folder: str):
    """(file system, path) of a folder: a local path or any URI that Arrow knows (file, s3, gs, hdfs)."""
    from pyarrow import fs

    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), os.path.abspath(folder))


def file_at(path: str):
    """(file system, path) of a file that Spark has listed."""
    from urllib.parse import unquote

    return _store(unquote(path) if path.startswith("file:") else path)


def save_files(df: DataFrame, folder: str) -> int:
    """Writes (path, content) rows into a folder that driver and executors share, in any store that Arrow knows; returns
    how many. Each file appears at once, by a move, so that a task that runs again does no harm."""

    def run(batches):
        n = 0
        for pdf in batches:
            store, base = _store(folder)
            for path, content in zip(pdf["path"], pdf["content"]):
                to = posixpath.normpath(posixpath.join(base, path))
                if not to.startswith(posixpath.normpath(base) + "/"):
                    raise ValueError(f"{path} lies outside of the folder")
                store.create_dir(posixpath.dirname(to), recursive=True)
                part = f"{posixpath.dirname(to)}/_part-{uuid.uuid4().hex}"  # readers pass names with an underscore over
                with store.open_output_stream(part) as f:
                    f.write(content)
                store.move(part, to)
                n += 1
        yield pd.DataFrame({"n": [n]})

    return df.select("path", "content").mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
