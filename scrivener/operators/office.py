"""Office and EPUB archives: entries are found, converted and written back; one archive is one row."""

from __future__ import annotations

import copy
import io
import re
import struct
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame

from scrivener.operators.convert import rounds_of, shared

FORMATS = ("docx", "xlsx", "pptx", "odt", "ods", "odp", "epub")
# What holds a font's name in each format, around the name.
_ODF = r"""((?:style:font-name(?:-asian|-complex)?|svg:font-family|style:name)=['"])([^'"]+)(['"])"""
FONTS = {
    "docx": r'(w:(?:eastAsia|ascii|hAnsi|cs)=")(.*?)(")',
    "xlsx": r'(val=")(.*?)(")',
    "pptx": r'(typeface=")(.*?)(")',
    "odt": _ODF,
    "ods": _ODF,
    "odp": _ODF,
    "epub": r"""(font-family\s*:\s*)([^;"']+)()""",
}
# Cells, their text nodes, and what marks a cell whose text stands in it.
CELL, TEXT_NODE = re.compile(r"<c\b[^>]*>.*?</c>"), re.compile(r"(<t\b[^>]*>)(.*?)(</t>)")
INLINE = re.compile(r"""\A[^>]*t=(?:"inlineStr"|'inlineStr')[^>]*>""", re.S)

#: What a broken, encrypted or unknown archive, or an entry that is no UTF-8, raises.
ARCHIVE_ERRORS = (zipfile.BadZipFile, zipfile.LargeZipFile, zlib.error, UnicodeError, EOFError, NotImplementedError, struct.error)


def is_target(fmt: str, name: str) -> bool:
    if fmt == "docx":
        return name == "word/document.xml"
    if fmt == "xlsx":
        return name == "xl/sharedStrings.xml" or (name.startswith("xl/worksheets/") and name.endswith(".xml"))
    if fmt == "pptx":
        return name.startswith(("ppt/slides/", "ppt/notesSlides/")) and name.endswith(".xml")
    if fmt in ("odt", "ods", "odp"):
        return name == "content.xml"
    return fmt == "epub" and name.lower().endswith((".xhtml", ".opf", ".ncx", ".html"))


def is_unsafe(name: str) -> bool:
    return name.startswith("/") or ".." in name.split("/")


def mask_fonts(xml: str, fmt: str) -> tuple[str, dict[str, str]]:
    """Font names become marks; the marks' names."""
    held: dict[str, str] = {}

    def mark(m: re.Match) -> str:
        key = f"__F_O_N_T_{len(held)}__"
        held[key] = m[2]
        return m[1] + key + m[3]

    return (re.sub(FONTS[fmt], mark, xml) if fmt in FONTS else xml), held


def unmask_fonts(xml: str, held: dict[str, str]) -> str:
    return re.sub(r"__F_O_N_T_\d+__", lambda m: held.get(m[0], m[0]), xml)


def convert_entry(xml: str, fmt: str, name: str, convert, keep_font: bool) -> str:
    sheet = fmt == "xlsx" and name != "xl/sharedStrings.xml"
    masked, held = mask_fonts(xml, fmt) if keep_font and not sheet else (xml, {})
    if sheet:
        node = lambda m: m[1] + convert(m[2]) + m[3] if m[2] else m[0]
        done = CELL.sub(lambda m: TEXT_NODE.sub(node, m[0]) if INLINE.match(m[0]) else m[0], masked)
    else:
        done = convert(masked)
    return unmask_fonts(done, held)


def read_entry(source: zipfile.ZipFile, info: zipfile.ZipInfo) -> bytes:
    if info.flag_bits & 1:
        raise zipfile.BadZipFile(f"{info.filename} is encrypted")
    return source.read(info)


def copy_entry(source: zipfile.ZipFile, info: zipfile.ZipInfo, target: zipfile.ZipFile, name: str) -> None:
    """The compressed bytes as they are, with the entry's times, attributes and extra fields."""
    source.fp.seek(info.header_offset)
    head = source.fp.read(30)
    if head[:4] != b"PK\3\4":
        raise zipfile.BadZipFile(f"no entry at the place of {info.filename}")
    source.fp.seek(sum(struct.unpack("<HH", head[26:30])), io.SEEK_CUR)
    data = source.fp.read(info.compress_size)
    if len(data) < info.compress_size:
        raise EOFError(f"{info.filename} ends early")
    made = copy.copy(info)
    made.filename = name
    made.flag_bits &= ~8  # sizes stand in the header, not after the data
    made.header_offset = target.start_dir
    target.fp.seek(target.start_dir)
    target.fp.write(made.FileHeader(None) + data)
    target.start_dir = target.fp.tell()
    target.filelist.append(made)
    target.NameToInfo[name] = made
    target._didModify = True


def convert_bytes(content: bytes, fmt: str, convert, keep_font: bool = False) -> tuple[bytes, int]:
    """The archive with its target entries converted, and their number. Unsafe entries go; an EPUB's mimetype comes first,
    stored; other entries are copied without being unpacked. A target entry must be UTF-8."""
    out, n = io.BytesIO(), 0
    with zipfile.ZipFile(io.BytesIO(content)) as source, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
        names = [(i, i.filename.replace("\\", "/")) for i in source.infolist()]
        first = next((i for i, name in names if fmt == "epub" and name == "mimetype"), None)
        for info, name in ([(first, "mimetype")] if first else []) + [x for x in names if x[0] is not first]:
            if is_unsafe(name):
                continue
            if name.endswith("/"):
                target.writestr(zipfile.ZipInfo(name), b"", zipfile.ZIP_STORED)
                continue
            if info is first:
                target.writestr(zipfile.ZipInfo(name), read_entry(source, info), zipfile.ZIP_STORED)
            elif is_target(fmt, name):
                done = convert_entry(read_entry(source, info).decode("utf-8"), fmt, name, convert, keep_font)
                target.writestr(zipfile.ZipInfo(name), done.encode(), zipfile.ZIP_DEFLATED)
                n += 1
            else:
                copy_entry(source, info, target, name)
    return out.getvalue(), n


def _archives(converter, keep_font: bool):
    def run(batches):
        convert = converter()
        for b in batches:
            rows = []
            for fmt, content in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                try:
                    data, n = convert_bytes(content or b"", fmt, convert, keep_font)
                    rows.append((True, f"converted {n} entries", n, data))
                except ARCHIVE_ERRORS as e:
                    rows.append((False, f"not converted: {e}", 0, None))
            kinds = (pa.bool_(), pa.string(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], ["path", "success", "message", "converted_count", "content"])

    return run


def convert_archives(archives: DataFrame, dictionary: DataFrame, config: str, keep_font: bool = False, punct: bool = False) -> DataFrame:
    """archives: path, format, content. path, success, message, converted_count, content; an archive that is null, broken or
    encrypted, or whose target entry is no UTF-8, is a row that says so."""
    converter = shared(archives.sparkSession, rounds_of(dictionary, config, punct))
    return archives.select("path", "format", "content").mapInArrow(_archives(converter, keep_font), "path string, success boolean, message string, converted_count int, content binary")
