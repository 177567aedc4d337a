"""Readers, archives, jobs, sinks and the stream, on files made here."""

import ctypes
import io
import random
import re
import sys
import time
import zipfile

import pytest
from pyspark import cloudpickle

from scrivener.functions import encodings, rules
from scrivener.operators import office
from scrivener.operators.convert import Converter, convert, read_dictionary
from scrivener.plans import jobs
from scrivener.sources import pdfium, readers, sinks
from scrivener.streaming.files import reflow_arriving

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS = [("s2t", "汉", "漢"), ("s2t", "语", "語"), ("s2t", "汉语", "漢語文")]


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name.replace("__", "/"), data)
    return out.getvalue()


def test_longest_match():
    assert Converter([{a: b for _, a, b in WORDS}])("汉语汉x语") == "漢語文漢x語"
    assert Converter([{"ab": "1", "abcd": "2"}, {"1c": "3"}])("abcab abcd ab") == "31 2 1"


def test_many_phrases():
    rng, letters = random.Random(4), [chr(0x4E00 + i) for i in range(400)]
    made = {"".join(rng.choices(letters, k=rng.randint(1, 5))) for _ in range(50_000)}
    table = {w: f"<{i}>" for i, w in enumerate(sorted(made))}
    text = "".join(rng.choices(letters, k=4000))
    plain = re.compile("|".join(sorted(made, key=len, reverse=True)))
    assert Converter([table])(text) == plain.sub(lambda m: table[m[0]], text)
    few = Converter([dict(list(table.items())[:100])])
    many, long = Converter([table]), text * 50

    def took(f):
        began = time.perf_counter()
        f(long)
        return time.perf_counter() - began

    assert min(took(many) for _ in range(3)) < 5 * min(took(few) for _ in range(3)) + 0.05


def test_dictionary_of_text_and_rounds(tmp_path, spark):
    (tmp_path / "words.txt").write_text("汉\t漢 汗\n\n# no entry\n语\t語\n没有\n")
    (tmp_path / "more.txt").write_text("漢語\t國語\n")
    d = read_dictionary(spark, str(tmp_path / "words.txt"), "s2tw").union(read_dictionary(spark, str(tmp_path / "more.txt"), "s2tw", 1))
    df = spark.createDataFrame([(1, "汉语“汉”"), (2, None)], "doc_id int, text string")
    assert [r["text"] for r in convert(df, d, "s2tw").collect()] == ["國語“漢”", None]
    assert [r["text"] for r in convert(df, d, "s2tw", punct=True).collect()] == ["國語「漢」", None]
    one = spark.createDataFrame(WORDS[:2], "config string, src string, dst string")
    assert convert(df, one, "s2t", punct=True).first()["text"] == "漢語「漢」"


def test_unknown_config(spark):
    d = spark.createDataFrame(WORDS, "config string, src string, dst string")
    with pytest.raises(ValueError, match="known: s2t"):
        convert(spark.createDataFrame([(1, "x")], "doc_id int, text string"), d, "t2s")


@pytest.mark.parametrize("cell", ['<c r="A1" t="inlineStr"><is><t>汉</t></is></c>', '<c r="B1"><f>CONCAT("汉")</f></c>', '<c t="inlineStr"><t></t></c>'])
def test_inline_cells(cell):
    got = office.convert_entry(cell, "xlsx", "xl/worksheets/sheet1.xml", lambda s: s.replace("汉", "漢"), False)
    assert got == (cell.replace("汉", "漢") if "inlineStr" in cell else cell)


def test_archive():
    z = zipped(a="1", mimetype="application/epub+zip", **{"x.xhtml": "<p style='font-family: 汉'>汉</p>", "..__bad": "y"})
    out, n = office.convert_bytes(z, "epub", lambda s: s.replace("汉", "漢"), keep_font=True)
    with zipfile.ZipFile(io.BytesIO(out)) as made:
        assert made.namelist() == ["mimetype", "a", "x.xhtml"]
        assert made.infolist()[0].compress_type == zipfile.ZIP_STORED
        assert made.read("x.xhtml").decode() == "<p style='font-family: 汉'>漢</p>"
    assert n == 1


def test_other_entries_are_copied():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, kind, data in (("a.bin", zipfile.ZIP_DEFLATED, b"z" * 1000), ("b.png", zipfile.ZIP_STORED, b"raw"), ("c\\d.txt", zipfile.ZIP_BZIP2, b"y" * 99), ("word/document.xml", zipfile.ZIP_STORED, "汉".encode())):
            info = zipfile.ZipInfo(name, (2001, 2, 3, 4, 5, 6))
            info.compress_type, info.external_attr, info.extra = kind, 0o644 << 16, b"\x99\x99\x02\x00ab"
            z.writestr(info, data)
    out.seek(0)
    made, n = office.convert_bytes(out.getvalue(), "docx", lambda s: s.replace("汉", "漢"))
    with zipfile.ZipFile(io.BytesIO(out.getvalue())) as old, zipfile.ZipFile(io.BytesIO(made)) as new:
        assert n == 1 and new.testzip() is None and new.namelist() == ["a.bin", "b.png", "c/d.txt", "word/document.xml"]
        for a, b in zip(old.infolist()[:3], new.infolist()[:3], strict=True):
            assert old.read(a) == new.read(b)
            assert (a.date_time, a.external_attr, a.extra, a.compress_type, a.CRC) == (b.date_time, b.external_attr, b.extra, b.compress_type, b.CRC)


def broken():
    """path, archive, what is wrong with it."""
    good = zipped(word__document="x", **{"word__document.xml": "<w>汉</w>" * 50})
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", "<w>汉</w>" * 50)
    damaged = bytearray(out.getvalue())
    damaged[50:60] = b"\xff" * 10
    locked = bytearray(good)
    for at in (m.start() for m in re.finditer(b"PK\3\4", good)):
        locked[at + 6] |= 1
    for at in (m.start() for m in re.finditer(b"PK\1\2", good)):
        locked[at + 8] |= 1
    return [("damaged.docx", bytes(damaged)), ("locked.docx", bytes(locked)), ("wide.docx", zipped(**{"word__document.xml": "<w>汉</w>".encode("utf-16")})), ("cut.docx", good[:40]), ("none.docx", None), ("empty.docx", b""), ("good.docx", good)]


def test_broken_archives_are_rows(spark):
    files = spark.createDataFrame(broken(), "path string, content binary")
    d = spark.createDataFrame(WORDS[:2], "config string, src string, dst string")
    got = {r["path"]: (r["success"], r["content"] is None) for r in jobs.office_job(files, d, "s2t").collect()}
    assert got == {p: (p == "good.docx", p != "good.docx") for p, _ in broken()}
    entries = [(r["path"], r["name"], r["error"] is None) for r in readers.archive_entries(files).collect()]
    assert set(entries) == {("damaged.docx", "word/document.xml", False), ("locked.docx", "word/document", False), ("locked.docx", "word/document.xml", False), ("wide.docx", "word/document.xml", True), ("cut.docx", None, False), ("none.docx", None, False), ("empty.docx", None, False), ("good.docx", "word/document", True), ("good.docx", "word/document.xml", True)}


@pytest.mark.parametrize(("label", "content", "text"), [("gb2312", "镕€".encode("gb18030") + b"\x80", "镕€€"), (" X-SJIS\n", "漢①".encode("cp932"), "漢①"), ("latin1", b"\x80\x81\xe9", "€\x81é"), ("utf-16", b"\xff\xfea\0", "a"), ("x-gbk", b"a\xffb", "a�b"), ("csgb2312", "汉".encode("gbk"), "汉"), ("UTF8", b"\xef\xbb\xbfa\xff", "a�"), ("windows-1253", b"\xaa", "�")])
def test_labels(spark, label, content, text):
    files = spark.createDataFrame([("a", content)], "path string, content binary")
    assert readers.decode(files, label).first()["text"] == text


def test_written_charsets():
    write = lambda label, s: encodings.writer(encodings.codec_of(label))(s)
    assert write("gbk", "汉€é😀") == "汉".encode("gbk") + b"\x80" + "é".encode("gbk") + b"&#128512;"
    assert write("latin1", "é汉\x81") == b"\xe9&#27721;\x81" and write("utf-16", "é") == "é".encode()
    for label in ("rot13", "utf-7", "no such charset"):
        with pytest.raises(LookupError, match="Unsupported encoding"):
            encodings.codec_of(label)


def test_decode(spark):
    files = spark.createDataFrame([("a", b"\xef\xbb\xbfab\xff"), ("b", None)], "path string, content binary")
    assert [r["text"] for r in readers.decode(files, drop_bom=True).collect()] == ["ab�", None]
    assert readers.decode(spark.createDataFrame([("a", "汉".encode("gbk"))], files.schema), "gbk").first()["text"] == "汉"
    with pytest.raises(LookupError):
        readers.decode(files, "no such charset")


def pages(content):
    if content == b"locked":
        raise readers.PageError(4)
    for p in content.decode().split("|") if content else []:
        yield ("null_page", "") if p == "-" else ("ok", p)


def test_pdf_job(spark):
    files = spark.createDataFrame([("a.pdf", "第一章 始|他的话还没有能够说完|-|就完了。".encode()), ("b.pdf", b"locked"), ("c.pdf", b"")], "path string, content binary")
    got = {(r["path"], r["page_no"]): (r["total_pages"], r["text"], r["error_code"]) for r in readers.pdf_pages(files, pages, True).collect()}
    assert got["a.pdf", 2] == (4, "=== [Page 2/4] ===\n他的话还没有能够说完\n\n", None)
    assert got["a.pdf", 3] == (4, "\n", None) and got["c.pdf", 1] == (1, "\n", None) and got["b.pdf", None] == (None, None, 4)
    out = {r["path"]: (r["output"], r["text"], r["error_code"]) for r in jobs.pdf_job(files, pages).collect()}
    assert out == {"a.pdf": ("a_extracted.txt", "第一章 始\n\n他的话还没有能够说完就完了。", None), "b.pdf": ("b_extracted.txt", None, 4), "c.pdf": ("c_extracted.txt", "\n", None)}


class FakePdfium:
    """A document is its pages' texts between bars; "-" and "=" are pages that don't load."""

    def __init__(self):
        self.open = []

    def FPDF_LoadMemDocument(self, content, size, password):
        assert size == len(content) and password is None
        return 0 if content == b"locked" else self.held(content.decode().split("|") if content else [])

    def held(self, x):
        self.open.append(x)
        return len(self.open)

    def closed(self, at):
        assert self.open[at - 1] is not None
        self.open[at - 1] = None

    FPDF_CloseDocument = FPDF_ClosePage = FPDFText_ClosePage = closed

    def FPDF_GetLastError(self):
        return 4

    def FPDF_GetPageCount(self, doc):
        return len(self.open[doc - 1])

    def FPDF_LoadPage(self, doc, n):
        page = self.open[doc - 1][n]
        return 0 if page == "-" else self.held(page)

    def FPDFText_LoadPage(self, page):
        text = self.open[page - 1]
        return 0 if text == "=" else self.held(text)

    def FPDFText_CountChars(self, text):
        return len(self.open[text - 1].encode("utf-16-le")) // 2

    def FPDFText_GetText(self, text, start, count, units):
        data = self.open[text - 1].encode("utf-16-le") + b"\0\0"
        ctypes.memmove(units, data, len(data))
        return len(data) // 2


def test_pdfium_pages():
    lib = FakePdfium()
    assert list(pdfium.pages(lib, "汉a|-|=||😀".encode())) == [("ok", "汉a"), ("null_page", ""), ("null_text", ""), ("ok", ""), ("ok", "😀")]
    assert list(pdfium.pages(lib, b"")) == []
    with pytest.raises(readers.PageError):
        list(pdfium.pages(lib, b"locked"))
    assert not any(x is not None for x in lib.open)
    assert [pdfium.decoded(x) for x in (b"\0\0", b"", b"a\0\0\0", b"\x00\xd8")] == ["\n", "\n", "a", "�"]


def test_pdfium_is_found(tmp_path, monkeypatch):
    import zstandard

    for k in ("PDFIUM_LIB_DIR", "LOCALAPPDATA"):
        monkeypatch.delenv(k, raising=False)
    monkeypatch.setenv("XDG_CACHE_HOME", str(tmp_path / "cache"))
    monkeypatch.chdir(tmp_path)
    assert [pdfium.platform_folder(*x) for x in (("Windows", "AMD64"), ("Linux", "aarch64"), ("Darwin", "x86_64"), ("Linux", "i686"))] == ["win-x64", "linux-arm64", "macos-x64", "linux-x86"]
    assert [pdfium.library_name(x) for x in ("Windows", "Linux", "Darwin")] == ["pdfium.dll", "libpdfium.so", "libpdfium.dylib"]
    with pytest.raises(pdfium.MissingLibrary):
        pdfium.find()
    packed = tmp_path / "packed" / "pdfium" / pdfium.platform_folder()
    packed.mkdir(parents=True)
    (packed / f"{pdfium.library_name()}.zst").write_bytes(zstandard.compress(b"library"))
    first = pdfium.find(str(tmp_path / "packed"))
    assert first.read_bytes() == b"library" and tmp_path / "cache" in first.parents and pdfium.find(str(tmp_path / "packed")) == first
    bundled = tmp_path / "pdfium" / pdfium.platform_folder() / pdfium.library_name()
    bundled.parent.mkdir(parents=True)
    bundled.write_bytes(b"no library")
    assert pdfium.find() == pdfium.find("/no/such/folder") == bundled and pdfium.find(str(bundled)) == bundled
    monkeypatch.setenv("PDFIUM_LIB_DIR", str(tmp_path / "cache"))
    with pytest.raises(pdfium.MissingLibrary):
        pdfium.find()
    for _ in range(2):
        with pytest.raises(pdfium.MissingLibrary):
            pdfium.load(str(bundled))
    with pytest.raises(pdfium.MissingLibrary, match="not a PDFium library"):
        pdfium.in_folder(first)


def test_office_job(spark):
    d = spark.createDataFrame(WORDS[:2], "config string, src string, dst string")
    files = spark.createDataFrame([("a.docx", zipped(word__document="x", **{"word__document.xml": "<w>汉</w>"})), ("b.docx", b"no")], "path string, content binary")
    got = {r["path"]: (r["success"], r["converted_count"], r["output"]) for r in jobs.office_job(files, d, "s2t").collect()}
    assert got == {"a.docx": (True, 1, "a_converted.docx"), "b.docx": (False, 0, "b_converted.docx")}


def test_command_line(tmp_path, spark, monkeypatch):
    (tmp_path / "pdf_of_tests.py").write_text("def read(content):\n    for p in content.decode().split('|'):\n        yield 'ok', p\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    import pdf_of_tests

    cloudpickle.register_pickle_by_value(pdf_of_tests)
    spark.createDataFrame(WORDS[:2], "config string, src string, dst string").write.parquet(str(tmp_path / "words"))
    common = ["-c", "s2t", "-d", str(tmp_path / "words")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "汉a.docx").write_bytes(zipped(word__document="x", **{"word__document.xml": "<w>汉</w>"}))
    (tmp_path / "in" / "b.pdf").write_text("他的话还没有能够说完|就完了汉。")
    (tmp_path / "in" / "c.pdf").write_text("汉")
    jobs.main(["office", "-i", str(tmp_path / "in" / "*.docx"), "-o", f"{tmp_path}/out/", "--auto-ext", *common])
    jobs.main(["office", "-i", str(tmp_path / "in" / "*.docx"), "-o", f"{tmp_path}/one", "--auto-ext", *common])
    for name in ("out/漢a_converted.docx", "one.docx"):
        with zipfile.ZipFile(tmp_path / name) as z:
            assert z.read("word/document.xml").decode() == "<w>漢</w>"
    pdf = ["pdf", "-i", str(tmp_path / "in" / "*.pdf"), "--backend", "pdf_of_tests:read"]
    jobs.main([*pdf, "-o", f"{tmp_path}/out/", "-r", *common])
    jobs.main([*pdf, "-e"])
    assert (tmp_path / "out" / "b_converted.txt").read_text() == "他的话还没有能够说完就完了漢。"
    assert (tmp_path / "in" / "c_extracted.txt").read_text() == "汉\n\n"
    with pytest.raises(ValueError, match="several inputs"):
        jobs.main([*pdf, "-e", "-o", f"{tmp_path}/one.txt"])
    with pytest.raises(ValueError, match="differ from the input"):
        jobs.main(["office", "-i", str(tmp_path / "in" / "*.docx"), "-o", str(tmp_path / "in" / "汉a.docx"), *common])
    with pytest.raises(LookupError):
        jobs.main(["convert", "--in-enc", "rot13", *common])
    with pytest.raises(SystemExit):
        jobs.main(["convert", "-i", "x"])


def locked_pages(content):
    if content == b"locked":
        raise readers.PageError(4)
    yield "ok", content.decode()


def test_failures_are_reported(tmp_path, spark, monkeypatch, capsys):
    monkeypatch.setattr(sys.modules[__name__], "read", locked_pages, raising=False)
    monkeypatch.setattr(jobs, "backend_of", lambda name: locked_pages)
    (tmp_path / "a.pdf").write_bytes(b"locked")
    (tmp_path / "b.pdf").write_text("好")
    assert jobs.main(["pdf", "-i", f"{tmp_path}/*.pdf", "-e", "--backend", "x:y"]) == 1
    assert (tmp_path / "b_extracted.txt").read_text() == "好\n\n" and not (tmp_path / "a_extracted.txt").exists()
    said = capsys.readouterr().err
    assert "Error: failed to open PDF\n  Path   : file:" in said and "  PDFium : Password — PDF is password protected\n  Hint   : Decrypt" in said and "b.pdf" not in said
    spark.createDataFrame(WORDS[:2], "config string, src string, dst string").write.parquet(str(tmp_path / "words"))
    (tmp_path / "c.docx").write_bytes(b"no zip")
    assert jobs.main(["office", "-i", f"{tmp_path}/c.docx", "-c", "s2t", "-d", f"{tmp_path}/words"]) == 1
    assert "c.docx: not converted" in capsys.readouterr().err
    assert rules.failure("p", 99, None).splitlines()[2] == "  PDFium : Other — unrecognized PDFium error code"


def test_convert_keeps_line_ends(tmp_path, spark, monkeypatch):
    spark.createDataFrame(WORDS[:2], "config string, src string, dst string").write.parquet(str(tmp_path / "words"))
    common = ["-c", "s2t", "-d", f"{tmp_path}/words"]
    (tmp_path / "a.txt").write_bytes("汉\r\n语\r".encode())
    assert jobs.main(["convert", "-i", f"{tmp_path}/a.txt", "-o", f"{tmp_path}/out/", *common]) == 0
    assert (tmp_path / "out" / "a_converted.txt").read_bytes() == "漢\r\n語\r".encode()

    class Console:
        def __init__(self, data=b""):
            self.buffer = io.BytesIO(data)

    for given, args, want in (("汉".encode(), [], "漢\n"), ("汉语\n".encode("gbk"), ["--in-enc", "gb2312"], "漢語\n")):
        out = Console()
        monkeypatch.setattr(sys, "stdin", Console(given))
        with monkeypatch.context() as m:
            m.setattr(sys, "stdout", out)
            assert jobs.main(["convert", *args, *common]) == 0
        assert out.buffer.getvalue().decode() == want


def test_sinks(tmp_path, spark):
    target = tmp_path / "o" / "a.txt"
    sinks.replace_file(str(target), b"1")
    sinks.replace_file(str(target), b"2")
    assert target.read_bytes() == b"2" and len(list(target.parent.iterdir())) == 1
    with pytest.raises(IsADirectoryError):
        sinks.replace_file(str(tmp_path), b"")
    assert sinks.write_texts(spark.createDataFrame([(str(tmp_path / "g h%.txt"), "汉é😀")], "output string, text string"), "gbk") == []
    assert (tmp_path / "g h%.txt").read_bytes() == "汉é😀".encode("gbk", "xmlcharrefreplace")
    (tmp_path / "folder").mkdir()
    failed = sinks.write_texts(spark.createDataFrame([("b", f"file:{tmp_path}/folder", "x"), ("a", f"file:{tmp_path}/ok.txt", "x"), ("c", "", None)], "path string, output string, text string"))
    assert [r["path"] for r in failed] == ["b", "c"] and (tmp_path / "ok.txt").read_bytes() == b"x"
    with pytest.raises(ValueError):
        sinks.located("nosuch://host/x")


def test_stream(tmp_path, spark):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(2):
        (folder / f"{i}.txt").write_text("第一章 始\n他的话还没有能够说完\n就完了。")
        reflow_arriving(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == i + 1
