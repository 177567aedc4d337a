"""Sources: whole texts, charsets, archive entries and PDF pages by a backend that the user registers."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.functions import encodings, rules
from scrivener.functions.dialect import SPARK
from scrivener.operators.office import ARCHIVE_ERRORS, read_entry

#: A PDF backend: bytes to (status, text) of each page in order; it raises PageError.
Backend = Callable[[bytes], Iterator[tuple[str, str]]]


class PageError(Exception):
    """A document that can't be opened; code as in rules.ERRORS."""

    def __init__(self, code: int):
        super().__init__(code)
        self.code = code


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text), a file a row."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def without_bom(content: Column) -> Column:
    return F.when(F.hex(F.substring(content, 1, 3)) == "EFBBBF", content.substr(F.lit(4), F.length(content))).otherwise(content)


def decode(files: DataFrame, charset: str = "UTF-8", drop_bom: bool = False) -> DataFrame:
    """(path, text); bad bytes become U+FFFD. "UTF-8" keeps a byte order mark unless told otherwise; other labels drop that
    of their charset. UTF-8 is native, other charsets go through Python's codecs; an unknown label fails here."""
    codec = encodings.codec_of(charset)
    if codec == encodings.UTF_8:
        content = without_bom(F.col("content")) if drop_bom or charset != "UTF-8" else F.col("content")
        return files.select("path", F.make_valid_utf8(content.cast("string")).alias("text"))

    def run(contents: pa.Array) -> pa.Array:
        read = encodings.reader(codec)
        return pa.array([None if c is None else read(c) for c in contents.to_pylist()], pa.string())

    return files.select("path", F.arrow_udf(run, "string").asNondeterministic()("content").alias("text"))


def archive_entries(files: DataFrame) -> DataFrame:
    """(path, entry_idx, name, is_dir, content, error) of zip archives; names with forward slashes. An archive that can't be
    read is one row with its error; an entry that can't is a row with its name and error."""

    def entries(path, content):
        try:
            z = zipfile.ZipFile(io.BytesIO(content or b""))
        except ARCHIVE_ERRORS as e:
            yield path, None, None, None, None, str(e)
            return
        for i, e in enumerate(z.infolist()):
            name = e.filename.replace("\\", "/")
            try:
                yield path, i, name, e.is_dir(), None if e.is_dir() else read_entry(z, e), None
            except ARCHIVE_ERRORS as error:
                yield path, i, name, e.is_dir(), None, str(error)

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = list(entries(path, content))
                kinds = (pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["path", "entry_idx", "name", "is_dir", "content", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, entry_idx int, name string, is_dir boolean, content binary, error string")


def pdf_pages(files: DataFrame, backend: Backend, page_header: bool = False) -> DataFrame:
    """(path, page_no, total_pages, text, error_code): pages from 1; a document without pages is one empty page, one that
    doesn't open a row with its error code and no text."""

    def run(batches):
        for b in batches:
            rows = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    pages = list(backend(content)) or [("no_pages", "")]
                    rows += [(path, i + 1, len(pages), status, text, None) for i, (status, text) in enumerate(pages)]
                except PageError as e:
                    rows.append((path, None, None, "error", None, e.code))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["path", "page_no", "total_pages", "status", "raw", "error_code"])

    pages = files.select("path", "content").mapInArrow(run, "path string, page_no int, total_pages int, status string, raw string, error_code int")
    return pages.select("path", "page_no", "total_pages", page_column(page_header).alias("text"), "error_code")


def page_column(page_header: bool) -> Column:
    return F.expr(f"CASE WHEN raw IS NOT NULL THEN {rules.page_row(SPARK, rules.compress_newlines(SPARK, rules.newlines(SPARK, 'raw')), 'status', 'page_no', 'total_pages', page_header)} END")


def assemble(pages: DataFrame, key: str = "path") -> DataFrame:
    """(key, n_pages, text, error_code): page texts joined in order; a document that didn't open has 0 pages, null text and its code."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("page_no", "text")))), lambda p: p["text"]), "")
    return pages.groupBy(key).agg(F.count("text").alias("n_pages"), F.when(F.count("text") > 0, joined).alias("text"), F.max("error_code").alias("error_code"))
