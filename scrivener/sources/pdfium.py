"""A page backend over the PDFium library's C interface, found at run time on each executor (none ships here).

The library is looked for in a folder that is given (with a warning if it isn't there), else in PDFIUM_LIB_DIR and nowhere
else, else beside the interpreter, in the working folder and beside this package: as <folder>/<library> or as
<folder>/pdfium/<platform>/<library>, or the latter compressed (.zst), which is unpacked into the user's cache once.
A worker process loads it once and remembers a failure, too. It isn't safe for threads; a worker runs one task at a time.
"""

from __future__ import annotations

import ctypes
import logging
import os
import platform
import sys
import tempfile
from collections.abc import Iterator
from pathlib import Path

from scrivener.sources.readers import Backend, PageError

LOG = logging.getLogger("scrivener.pdfium")


class MissingLibrary(Exception):
    """The library isn't where it was looked for, or can't be loaded from there."""


def platform_folder(system: str | None = None, machine: str | None = None) -> str:
    system, machine = system or platform.system(), (machine or platform.machine()).lower()
    names = {"Windows": "win", "Linux": "linux", "Darwin": "macos"}
    kinds = {"x86_64": "x64", "amd64": "x64", "arm64": "arm64", "aarch64": "arm64", "i386": "x86", "i686": "x86", "x86": "x86"}
    if system not in names or machine not in kinds:
        raise MissingLibrary(f"no PDFium for {system} on {machine}")
    return f"{names[system]}-{kinds[machine]}"


def library_name(system: str | None = None) -> str:
    return {"Windows": "pdfium.dll", "Darwin": "libpdfium.dylib"}.get(system or platform.system(), "libpdfium.so")


def cache_folder() -> Path:
    base = os.environ.get("LOCALAPPDATA") or os.environ.get("XDG_CACHE_HOME") or os.path.join(os.path.expanduser("~"), ".cache")
    return Path(base) / "scrivener" / "natives"


def unpacked(packed: Path, cache: Path | None = None) -> Path:
    """The library of a .zst file, written to the cache by a rename; one of the right size stays."""
    import zstandard

    data = zstandard.ZstdDecompressor(max_window_size=1 << 27).decompressobj().decompress(packed.read_bytes())
    target = (cache or cache_folder()) / f"{packed.parent.name}-{packed.stem}"
    if not (target.is_file() and target.stat().st_size == len(data)):
        target.parent.mkdir(parents=True, exist_ok=True)
        with tempfile.NamedTemporaryFile(dir=target.parent, delete=False) as part:
            part.write(data)
        os.replace(part.name, target)
    return target


def in_folder(base: Path) -> Path:
    """The library in a folder, its bundled layout included, or a file of the library's name."""
    if base.is_file():
        if base.name != library_name():
            raise MissingLibrary(f"not a PDFium library: {base}")
        return base
    bundled = base / "pdfium" / platform_folder() / library_name()
    for place in (base / library_name(), bundled):
        if place.is_file():
            return place
    packed = bundled.with_name(f"{bundled.name}.zst")
    if packed.is_file():
        return unpacked(packed)
    raise MissingLibrary(f"no {library_name()} in {base}")


def find(given: str | None = None) -> Path:
    if given:
        try:
            return in_folder(Path(given))
        except MissingLibrary as e:
            LOG.warning("%s; looking elsewhere", e)
    if own := os.environ.get("PDFIUM_LIB_DIR"):
        return in_folder(Path(own))
    for base in (Path(sys.executable).parent, Path.cwd(), Path(__file__).parent.parent):
        try:
            return in_folder(base)
        except MissingLibrary:
            continue
    raise MissingLibrary(f"no pdfium/{platform_folder()}/{library_name()}")


def load(given: str | None = None) -> ctypes.CDLL:
    """The library, ready for use; of this process's first call."""
    held = sys.__dict__.setdefault("_scrivener_pdfium", {})
    if given not in held:
        try:
            path = find(given)
            held[given] = prepared(ctypes.CDLL(str(path)))
            LOG.info("PDFium: %s", str(path).replace("\\", "/"))
        except (MissingLibrary, OSError) as e:
            held[given] = MissingLibrary(str(e))
    if isinstance(held[given], MissingLibrary):
        raise held[given]
    return held[given]


def prepared(lib):
    """lib with the types of the functions that pages() calls."""
    p, i = ctypes.c_void_p, ctypes.c_int
    types = {
        "FPDF_InitLibrary": (None, []), "FPDF_LoadMemDocument": (p, [ctypes.c_char_p, i, ctypes.c_char_p]), "FPDF_CloseDocument": (None, [p]), "FPDF_GetLastError": (ctypes.c_ulong, []),
        "FPDF_GetPageCount": (i, [p]), "FPDF_LoadPage": (p, [p, i]), "FPDF_ClosePage": (None, [p]), "FPDFText_LoadPage": (p, [p]), "FPDFText_ClosePage": (None, [p]), "FPDFText_CountChars": (i, [p]),
        "FPDFText_GetText": (i, [p, i, i, ctypes.POINTER(ctypes.c_uint16)]),
    }
    for name, (made, given) in types.items():
        f = getattr(lib, name)
        f.restype, f.argtypes = made, given
    lib.FPDF_InitLibrary()
    return lib


def decoded(units: bytes) -> str:
    """UTF-16 code units of a page: one trailing NUL goes, nothing left is a line end."""
    return units.removesuffix(b"\0\0").decode("utf-16-le", "replace") or "\n"


def pages(lib, content: bytes) -> Iterator[tuple[str, str]]:
    """(status, text) of each page; a document that doesn't open raises PageError."""
    doc = lib.FPDF_LoadMemDocument(content, len(content), None)
    if not doc:
        raise PageError(lib.FPDF_GetLastError())
    try:
        for n in range(lib.FPDF_GetPageCount(doc)):
            page = lib.FPDF_LoadPage(doc, n)
            if not page:
                yield "null_page", ""
                continue
            try:
                text = lib.FPDFText_LoadPage(page)
                if not text:
                    yield "null_text", ""
                    continue
                try:
                    count = lib.FPDFText_CountChars(text)
                    units = (ctypes.c_uint16 * (max(count, 0) + 1))()
                    got = lib.FPDFText_GetText(text, 0, count, units) if count > 0 else 0
                finally:
                    lib.FPDFText_ClosePage(text)
            finally:
                lib.FPDF_ClosePage(page)
            yield "ok", decoded(bytes(units)[: 2 * got]) if got > 0 else ""
    finally:
        lib.FPDF_CloseDocument(doc)


def backend(given: str | None = None) -> Backend:
    return lambda content: pages(load(given), content)
