"""Charsets by the labels that web standards give them, over Python's codecs.

What a codec has no place for: of bytes, the C1 control of that number in a Windows page, the euro sign for 0x80 in GBK,
else U+FFFD; of characters, the same in reverse, else a numeric reference. UTF-16 is read and never written (UTF-8 is).
"""

from __future__ import annotations

import codecs

UTF_8 = "utf-8"
# Python's codec and the labels of its charset; those of numbered ISO and Windows pages that follow a rule are below.
_LABELS = {
    "utf-8": "unicode-1-1-utf-8 unicode11utf8 unicode20utf8 utf-8 utf8 x-unicode20utf8",
    "utf-16-be": "unicodefffe utf-16be",
    "utf-16-le": "csunicode iso-10646-ucs-2 ucs-2 unicode unicodefeff utf-16 utf-16le",
    "cp866": "866 cp866 csibm866 ibm866",
    "iso8859-2": "csisolatin2 iso-ir-101 l2 latin2 iso_8859-2:1987",
    "iso8859-3": "csisolatin3 iso-ir-109 l3 latin3 iso_8859-3:1988",
    "iso8859-4": "csisolatin4 iso-ir-110 l4 latin4 iso_8859-4:1988",
    "iso8859-5": "csisolatincyrillic cyrillic iso-ir-144 iso_8859-5:1988",
    "iso8859-6": "arabic asmo-708 csiso88596e csiso88596i csisolatinarabic ecma-114 iso-8859-6-e iso-8859-6-i iso-ir-127 iso_8859-6:1987",
    "iso8859-7": "csisolatingreek ecma-118 elot_928 greek greek8 iso-ir-126 iso_8859-7:1987 sun_eu_greek",
    "iso8859-8": "csiso88598e csiso88598i csisolatinhebrew hebrew iso-8859-8-e iso-8859-8-i iso-ir-138 iso_8859-8:1988 logical visual",
    "iso8859-10": "csisolatin6 iso-ir-157 l6 latin6",
    "iso8859-15": "csisolatin9 l9",
    "koi8-r": "cskoi8r koi koi8 koi8-r koi8_r",
    "koi8-u": "koi8-ru koi8-u",
    "mac_roman": "csmacintosh mac macintosh x-mac-roman",
    "mac_cyrillic": "x-mac-cyrillic x-mac-ukrainian",
    "cp874": "dos-874 iso-8859-11 iso8859-11 iso885911 tis-620 windows-874",
    "cp1252": "ansi_x3.4-1968 ascii cp819 csisolatin1 ibm819 iso-8859-1 iso-ir-100 iso8859-1 iso88591 iso_8859-1 iso_8859-1:1987 l1 latin1 us-ascii",
    "cp1254": "csisolatin5 iso-8859-9 iso-ir-148 iso8859-9 iso88599 iso_8859-9 iso_8859-9:1989 l5 latin5",
    "gbk": "chinese csgb2312 csiso58gb231280 gb2312 gb_2312 gb_2312-80 gbk iso-ir-58 x-gbk",
    "gb18030": "gb18030",
    "big5hkscs": "big5 big5-hkscs cn-big5 csbig5 x-x-big5",
    "euc_jp": "cseucpkdfmtjapanese euc-jp x-euc-jp",
    "iso2022_jp": "csiso2022jp iso-2022-jp",
    "cp932": "csshiftjis ms932 ms_kanji shift-jis shift_jis sjis windows-31j x-sjis",
    "cp949": "cseuckr csksc56011987 euc-kr iso-ir-149 korean ks_c_5601-1987 ks_c_5601-1989 ksc5601 ksc_5601 windows-949",
}


def labels() -> dict[str, str]:
    """Python's codec by label."""
    found = {label: codec for codec, names in _LABELS.items() for label in names.split()}
    for n in (2, 3, 4, 5, 6, 7, 8, 10, 13, 14, 15, 16):
        found |= dict.fromkeys((f"iso-8859-{n}",) if n == 16 else (f"iso-8859-{n}", f"iso8859-{n}", f"iso8859{n}"), f"iso8859-{n}")
        if n < 9 or n == 15:
            found[f"iso_8859-{n}"] = f"iso8859-{n}"
    for n in range(1250, 1259):
        found |= dict.fromkeys((f"cp{n}", f"windows-{n}", f"x-cp{n}"), f"cp{n}")
    return found


def codec_of(label: str) -> str:
    known = labels()
    key = label.strip("\t\n\f\r ").lower()
    if key not in known:
        raise LookupError(f"Unsupported encoding: {label}")
    return known[key]


def _read(codec: str):
    def other(e: UnicodeError):
        b = e.object[e.start]
        if codec.startswith(("cp125", "cp874")) and 0x80 <= b <= 0x9F:
            return chr(b), e.start + 1
        if codec == "gbk" and b == 0x80:
            return "€", e.start + 1
        return "�", e.end

    return other


def _write(codec: str):
    def other(e: UnicodeError):
        c = e.object[e.start]
        if codec.startswith(("cp125", "cp874")) and "\x80" <= c <= "\x9f":
            return bytes([ord(c)]), e.start + 1
        if codec == "gbk" and c == "€":
            return b"\x80", e.start + 1
        return f"&#{ord(c)};", e.start + 1

    return other


def reader(codec: str):
    """bytes to text; a byte order mark of the charset goes."""
    codecs.register_error(f"read-{codec}", _read(codec))
    mark = {"utf-8": codecs.BOM_UTF8, "utf-16-le": codecs.BOM_UTF16_LE, "utf-16-be": codecs.BOM_UTF16_BE}.get(codec, b"")
    # the decoder of GBK is that of its superset
    name = "gb18030" if codec == "gbk" else codec
    return lambda b: b.removeprefix(mark).decode(name, f"read-{codec}")


def writer(codec: str):
    """text to bytes."""
    codecs.register_error(f"write-{codec}", _write(codec))
    name = UTF_8 if codec.startswith("utf-16") else codec
    return lambda s: s.encode(name, f"write-{codec}")
