"""The jobs (convert, office, pdf, and reflow of text files) and their command line: python -m scrivener.plans.jobs

A document that can't be read or written is reported on standard error and makes the exit code 1; the others are done.
"""

from __future__ import annotations

import argparse
import sys
from importlib import import_module

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from scrivener.functions import encodings, rules
from scrivener.functions.dialect import SPARK
from scrivener.operators.convert import convert, read_dictionary
from scrivener.operators.office import convert_archives
from scrivener.operators.reflow import reflow
from scrivener.sources import pdfium, readers, sinks


def convert_job(files: DataFrame, dictionary: DataFrame, config: str, in_charset: str = "UTF-8", out_charset: str = "UTF-8", punct: bool = False) -> DataFrame:
    """(path, text, output); line ends stay as they are."""
    texts = readers.decode(files, in_charset, drop_bom=in_charset == "UTF-8" and out_charset != "UTF-8")
    return sinks.named(convert(texts, dictionary, config, "path", punct=punct))


def office_job(files: DataFrame, dictionary: DataFrame, config: str, fmt: str | None = None, keep_font: bool = False, auto_ext: bool = False, punct: bool = False) -> DataFrame:
    """A given format is taken as it is, lower-cased; else it comes from the extension, and other files are an error.
    With auto_ext the stem of the output's name is converted too."""
    ext = F.lit(fmt.lower()) if fmt else F.expr(rules.archive_format(SPARK, "path"))
    found = ext if fmt else F.coalesce(ext, F.raise_error(F.concat(F.lit("no format: "), F.col("path"))).cast("string"))
    done = convert_archives(files.withColumn("format", found), dictionary, config, keep_font, punct).withColumn("_ext", ext).withColumn("output", F.expr(rules.archive_output(SPARK, "path", "_ext"))).drop("_ext")
    if not auto_ext:
        return done
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?\z", 1)
    named = convert(done.select(F.struct("*").alias("_row"), stem.alias("text")), dictionary, config, "_row", punct=punct)
    output = F.concat(F.regexp_extract("_row.output", r"\A(.*/)?", 0), F.col("text"), F.regexp_extract("_row.output", r"_converted\.[^./]*\z", 0))
    return named.select("_row.*", output.alias("_named")).withColumn("output", F.col("_named")).drop("_named")


def pdf_job(files: DataFrame, backend: readers.Backend, dictionary: DataFrame | None = None, config: str | None = None, reflowed: bool = True, compact: bool = False, page_header: bool = False, punct: bool = False) -> DataFrame:
    """(path, text, error_code, output); a document that doesn't open has null text and its code."""
    texts = readers.assemble(readers.pdf_pages(files, backend, page_header)).select(F.struct("path", "error_code").alias("_row"), "text")
    if reflowed:
        texts = reflow(texts, "_row", "text", page_header, compact).select("_row", "text")
    if config:
        texts = convert(texts, dictionary, config, "_row", punct=punct)
    return sinks.text_rows(texts.select("_row.path", "text", "_row.error_code"), extracted=not config)


def placed(df: DataFrame, output: str | None, auto_ext: bool = False) -> DataFrame:
    """Outputs beside the inputs, in a given folder (ending in /), or, for a single input, in a given file; with auto_ext
    a file without extension gets that of the default name."""
    if not output:
        return df
    name = F.regexp_extract("output", r"[^/]*\z", 0)
    if output.endswith("/"):
        return df.withColumn("output", F.concat(F.lit(output), name))
    inputs = [r["path"] for r in df.select("path").limit(2).collect()]
    if len(inputs) > 1:
        raise ValueError(f"{output} is one file, but there are several inputs; end it in / for a folder")
    if [sinks.located(p) for p in inputs] == [sinks.located(output)]:
        raise ValueError(f"the output must differ from the input: {output}")
    bare = auto_ext and "." not in output.rsplit("/", 1)[-1]
    return df.withColumn("output", F.concat(F.lit(output), F.regexp_extract("output", r"\.[^./]*\z", 0)) if bare else F.lit(output))


def backend_of(name: str) -> readers.Backend:
    """module:function"""
    module, _, function = name.partition(":")
    return getattr(import_module(module), function)


def report(failures: list[Row], out=None) -> int:
    """Says what failed, with the PDF library's message and hint; 1 if anything did."""
    out = out or sys.stderr
    for r in failures[: sinks.FAILURES]:
        print(rules.failure(r["path"], r["error_code"], r["message"]), file=out)
    if len(failures) > sinks.FAILURES:
        print(f"Error: over {sinks.FAILURES} documents failed", file=out)
    return int(bool(failures))


def to_console(text: str, charset: str, out=None) -> None:
    """Encoded to standard output, with a line end."""
    (out or sys.stdout.buffer).write(encodings.writer(encodings.codec_of(charset))(text if text.endswith("\n") else text + "\n"))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="scrivener")
    p.add_argument("job", choices=["convert", "office", "pdf", "reflow"])
    p.add_argument("-i", "--input", help="files; convert and reflow read standard input without it")
    p.add_argument("-o", "--output", help="a folder, ending in /, or a file for a single input; else beside the inputs, or, for a single text, standard output")
    p.add_argument("-c", "--config")
    p.add_argument("-d", "--dictionary", help="parquet of config, src, dst; or text files (.txt, separated by commas) of src, tab, dst, each a round")
    p.add_argument("-p", "--punct", action="store_true", help="convert quotation marks too")
    p.add_argument("-f", "--format")
    p.add_argument("--in-enc", default="UTF-8")
    p.add_argument("--out-enc", default="UTF-8")
    p.add_argument("--keep-font", action="store_true")
    p.add_argument("--auto-ext", action="store_true", help="convert names of archives too, add missing extensions")
    p.add_argument("-r", "--reflow", action="store_true", help="reflow the text of PDF files")
    p.add_argument("-e", "--extract", action="store_true", help="no conversion of PDF files")
    p.add_argument("--backend", help="module:function that reads PDF files, in place of the PDFium library")
    p.add_argument("--pdfium", help="folder of the PDFium library on the executors")
    p.add_argument("--compact", action="store_true")
    p.add_argument("-H", "--page-header", action="store_true")
    a = p.parse_args(argv)
    plain = a.job == "reflow" or (a.job == "pdf" and a.extract)
    texts = a.job in ("convert", "reflow")
    if not plain and not (a.dictionary and a.config):
        p.error("this job needs --config and --dictionary")
    if not a.input and not texts:
        p.error("this job needs --input")
    for charset in (a.in_enc, a.out_enc):
        encodings.codec_of(charset)
    if a.output:
        sinks.located(a.output)
    spark = SparkSession.builder.getOrCreate()
    files = readers.read_files(spark, a.input) if a.input else spark.createDataFrame([("-", sys.stdin.buffer.read())], "path string, content binary")
    words = None
    if not plain and a.dictionary.endswith(".txt"):
        for k, path in enumerate(a.dictionary.split(",")):
            one = read_dictionary(spark, path, a.config, k)
            words = one if words is None else words.union(one)
    elif not plain:
        words = spark.read.parquet(a.dictionary)
    if a.job == "office":
        return report(sinks.write_archives(placed(office_job(files, words, a.config, a.format, a.keep_font, a.auto_ext, a.punct), a.output, a.auto_ext)))
    if a.job == "pdf":
        backend = backend_of(a.backend) if a.backend else pdfium.backend(a.pdfium)
        made = pdf_job(files, backend, words, None if plain else a.config, a.reflow, a.compact, a.page_header, a.punct)
    elif a.job == "reflow":
        made = sinks.text_rows(reflow(readers.decode(files, a.in_enc), "path", "text", a.page_header, a.compact))
    else:
        made = convert_job(files, words, a.config, a.in_enc, a.out_enc, a.punct)
    if texts and not a.output and (not a.input or len(files.select("path").limit(2).collect()) == 1):
        to_console(made.select("text").first()["text"], a.out_enc)
        return 0
    return report(sinks.write_texts(placed(made, a.output), "UTF-8" if a.job == "pdf" else a.out_enc))


if __name__ == "__main__":
    sys.exit(main())
