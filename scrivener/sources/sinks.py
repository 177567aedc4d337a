"""Sinks: a file for each row, replaced as a whole: encoded texts, and archives.

Files go through Arrow's file systems (local and mounted folders, hdfs, s3, gs, abfs) from the executors, under a unique
name that readers skip, then renamed; object stores show a file only when it is complete, so there it is written in place.
A plain path must be one that all executors share. What can't be written comes back as rows.
"""

from __future__ import annotations

import posixpath
import uuid
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from scrivener.functions import encodings, rules
from scrivener.functions.dialect import SPARK

#: Failed rows that a job reports one by one.
FAILURES = 1000
WHOLE = ("s3", "gcs", "abfs")


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; a scheme without one is an error."""
    if path.startswith("file:"):
        path = path.removeprefix("file:")
        path = path.removeprefix("//") if path.startswith("///") else path
    if "://" not in path:
        return fs.LocalFileSystem(), path
    scheme, _, rest = path.partition("://")
    return fs.FileSystem.from_uri(f"{scheme}://{quote(rest, safe='/:@')}")


def replace_file(path: str, data: bytes) -> None:
    """Writes under another name, then renames; a folder in the file's place is an error."""
    store, target = located(path)
    if store.get_file_info(target).type == fs.FileType.Directory:
        raise IsADirectoryError(target)
    folder, name = posixpath.split(target)
    if folder:
        store.create_dir(folder, recursive=True)
    if store.type_name in WHOLE:
        with store.open_output_stream(target) as f:
            f.write(data)
        return
    part = posixpath.join(folder, f".{name[:100]}.{uuid.uuid4().hex}.tmp")
    try:
        with store.open_output_stream(part) as f:
            f.write(data)
        store.move(part, target)
    except BaseException:
        if store.get_file_info(part).type != fs.FileType.NotFound:
            store.delete_file(part)
        raise


def named(df: DataFrame, extracted: bool = False) -> DataFrame:
    """df with the column output: names beside the inputs."""
    return df.withColumn("output", F.expr(rules.text_output(SPARK, "path", not extracted)))


def text_rows(df: DataFrame, extracted: bool = False) -> DataFrame:
    """As named, with line ends as \\n."""
    return named(df, extracted).withColumn("text", F.expr(rules.newlines(SPARK, "text")))


def _write(df: DataFrame, payload: str, encode) -> list[Row]:
    """Writes each row's payload to its output; rows that fail: path, error_code, message, at most FAILURES + 1 by path."""

    def run(batches):
        to_bytes = encode()
        for b in batches:
            failed = []
            for path, output, data, code, message in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if data is None:
                    failed.append((path, code, message))
                    continue
                try:
                    replace_file(output, to_bytes(data))
                except (OSError, pa.ArrowException) as e:
                    failed.append((path, None, f"not written: {e}"))
            kinds = (pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in failed], t) for i, t in enumerate(kinds)], ["path", "error_code", "message"])

    given = [F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in (("path", "string"), ("error_code", "int"), ("message", "string"))]
    rows = df.select(given[0], "output", payload, *given[1:])
    return rows.mapInArrow(run, "path string, error_code int, message string").orderBy("path").limit(FAILURES + 1).collect()


def write_texts(df: DataFrame, charset: str = "UTF-8") -> list[Row]:
    """df: output, text, and path, error_code, message where there are any. A file a row; characters that the charset lacks
    become references. Rows without text aren't written and come back."""
    codec = encodings.codec_of(charset)
    return _write(df, "text", lambda: encodings.writer(codec))


def write_archives(df: DataFrame) -> list[Row]:
    """df: output, content, path, message; rows without content come back."""
    return _write(df, "content", lambda: bytes)
