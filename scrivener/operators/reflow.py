"""CJK paragraph reflow: an ordered fold over a document's lines.

The input is read once. Guards are native: blank and Latin-leading texts pass unchanged and the kernel gets null in
their place, so they never reach Python. Other documents go through one Arrow kernel, a row each, without a shuffle.
The fold keeps summaries of the paragraph so far (bracket stack, counts, open dialogs, a tail), so its time follows the
text's length. Most lines are known to be plain text by one pattern, which takes runs of them at once; what the rules ask
of a paragraph is counted when they ask.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivener.functions import charsets as k
from scrivener.functions import rules
from scrivener.functions.charsets import CJK, WS, inside
from scrivener.functions.dialect import SPARK

OVERFLOW_BYTES = 360
_TAIL = 400


def _rx(p: str) -> re.Pattern:
    return re.compile(p, re.S)


_B = f"[{WS}]"
#: The white space that WS stands for, for strip().
_WS = "".join(c for c in map(chr, range(0x3001)) if re.match(_B, c))
_SPACES, _TRIM, _INDENT = _rx(f"{_B}+"), _rx(f"\\A{_B}+|{_B}+\\Z"), _rx("\\A +")
_TRIM_END = _rx(f"{_B}+\\Z")
_DIVIDER = _rx(f"\\A{_B}*(?:[{k.DIVIDERS}]{_B}*){{3,}}\\Z")
_PHRASES = _rx(rules.PHRASES.replace("\\z", "\\Z"))
_TOKEN = _rx(r"\A(.{4,10}?)\1{2,}\Z")
_MARKER = _rx("\\A=== .*===\\Z")
_HEAD_WORD = _rx(f"\\A(?:{'|'.join(k.HEADING_WORDS)})")
_VOLUME = _rx(f"\\A[卷章][{k.NUMERALS}]")
_META = _rx(f"\\A([^{k.METADATA_SEPARATORS}]{{1,10}})[{k.METADATA_SEPARATORS}]{_B}*[^{WS}{k.DIALOG_OPENERS}]")
_KEYS = frozenset(k.METADATA_KEYS)
_ASCII, _ALL_CJK, _ALL_CJK_WS = _rx("\\A[\x00-\x7f]*\\Z"), _rx(f"\\A[{CJK}]+\\Z"), _rx(f"\\A{_B}*(?:[{CJK}]{_B}*)+\\Z")
_OK = f"[ /:.\\-A-Za-z0-9０-９{CJK}]*"
_MIXED = _rx(f"\\A(?:{_OK}[{CJK}]{_OK}[A-Za-z0-9０-９]|{_OK}[A-Za-z0-9０-９]{_OK}[{CJK}])")
_CJK_1, _LETTER, _DIGITS = _rx(f"[{CJK}]"), _rx("[A-Za-z]"), _rx(f"\\A{_B}*(?:[0-9０-９]{_B}*)+\\Z")
_BRACKET, _QUOTE = _rx(f"[{inside(k.BRACKET_OPENERS + k.BRACKET_CLOSERS)}]"), _rx(f"[{k.DIALOG_OPENERS}{k.DIALOG_CLOSERS}]")
_PAIR = dict(zip(k.BRACKET_CLOSERS, k.BRACKET_OPENERS, strict=True))
_CLOSER = {o: c for c, o in _PAIR.items()}
_QUOTE_PAIR = dict(zip(k.DIALOG_PAIRED, k.DIALOG_OPENERS, strict=True))
_CHAPTER = _rx(f"[{k.CHAPTER_MARKERS}][{inside(k.CHAPTER_TRAIL)}]*\\Z")
_BARRED, _COMMA, _STOP = _rx(f"[{k.NOT_IN_HEADING}]"), _rx(f"[{k.COMMAS}]"), _rx(f"[{inside(k.COMMAS + k.CLAUSE_OR_END)}]")
_MARK = _rx(f"[{inside(k.BRACKET_OPENERS + k.BRACKET_CLOSERS + k.DIALOG_OPENERS + k.DIALOG_CLOSERS)}]")
#: A paragraph that ends in none of these doesn't end a sentence, a bracketed text or a chapter's name.
_MAY_END = frozenset(k.STRONG_END + ".:…" + k.COLONS + k.DIALOG_CLOSERS + k.BRACKET_CLOSERS + k.CHAPTER_MARKERS + k.CHAPTER_TRAIL)
_CHAPTER_END = frozenset(k.CHAPTER_MARKERS + k.CHAPTER_TRAIL)
#: Lines that no rule takes for anything but text, with their line ends: 1, a run of those of nine characters or more that end
#: in no mark but a comma; 2, one that ends a sentence. They hold no white space, bracket, quote, separator or character of
#: numbered headings and don't repeat a unit. That all rules agree is tested.
_NO_UNIT = r"(?!(.{4,10}?)\%d{2,}\n)"
_INNER = f"{WS}{inside(k.BRACKET_OPENERS + k.BRACKET_CLOSERS + k.DIALOG_OPENERS + k.DIALOG_CLOSERS + k.METADATA_SEPARATORS)}第A-Za-z0-9０-９"
_OUTER = _INNER + inside(k.CLAUSE_OR_END + k.STRONG_END + k.COLONS + "." + k.POSTFIX_CLOSERS) + k.DIVIDERS[:-1] + "\\-"
_PLAIN = _rx(
    f"((?:{_NO_UNIT % 2}(?!{'|'.join(k.HEADING_WORDS)}|[卷章][{k.NUMERALS}])[^{_INNER}]{{8,}}[^{_OUTER}]\\n)+)|({_NO_UNIT % 4}[^{_INNER}]*[。！？]\\n)"
)


def collapse(line: str) -> str:
    """A phrase or a token's unit said three times or more in a row stands once; white space becomes single spaces."""
    one = line.strip(_WS)
    if not _SPACES.search(one):
        return _one_unit(one)
    one = _SPACES.sub(" ", one)
    if one.count(" ") > 1:
        one = _PHRASES.sub(lambda m: m[1] + m[2] + m[3], one)
    return " ".join(map(_one_unit, one.split(" ")))


def _one_unit(token: str) -> str:
    m = _TOKEN.match(token) if 12 <= len(token) <= 200 else None
    return m[1] if m else token


def _mostly(n_cjk: int, n_letters: int) -> bool:
    return 0 < n_cjk >= n_letters


def _mostly_cjk(s: str) -> bool:
    return _mostly(len(_CJK_1.findall(s)), len(_LETTER.findall(s)))


class Brackets:
    """The stack of open brackets; once wrong it stays wrong."""

    def __init__(self):
        self.stack, self.wrong = [], False

    def add(self, s: str) -> Brackets:
        if not self.wrong:
            for ch in _BRACKET.findall(s):
                if ch in _CLOSER:
                    self.stack.append(ch)
                elif self.stack and self.stack[-1] == _PAIR[ch]:
                    self.stack.pop()
                else:
                    self.wrong = True
                    break
        return self

    @property
    def open(self) -> bool:
        return self.wrong or bool(self.stack)


def _quote_open(s: str) -> bool:
    n = dict.fromkeys(k.DIALOG_OPENERS, 0)
    for ch in _QUOTE.findall(s):
        if ch in n:
            n[ch] += 1
        else:
            o = _QUOTE_PAIR.get(ch, "“")
            if not n[o]:
                return True
            n[o] -= 1
    return any(n.values())


def title_heading(line: str) -> bool:
    s = line.strip(_WS)
    if not s or len(s) > 50 or _BARRED.search(s):
        return False
    if _HEAD_WORD.match(s) or (len(s) <= 17 and _VOLUME.match(s)):
        return True
    i = s.find("第", 0, 11)
    while i >= 0:
        for j in range(i + 1, min(i + 7, len(s))):
            if s[j] in k.CHAPTER_MARKERS:
                if s[j + 1 : j + 2] and s[j + 1] in k.NOT_AFTER_MARKER:
                    return False
                if len(s) - j - 1 <= 20:
                    return True
        i = s.find("第", i + 1, 11)
    return False


def heading_like(line: str) -> bool:
    s = line.strip(_WS)
    if not s or _MARKER.match(s):
        return False
    last = s[-1]
    if _MARK.search(s):
        if Brackets().add(s).open or _quote_open(s):
            return False
        if len(s) > 1 and _CLOSER.get(s[0]) == last and _mostly_cjk(s[1:-1]):
            return True
    # before the colon stand CJK characters alone, so at most 8 count
    if last in k.COLONS and len(s) < 8 and _ALL_CJK.match(s[:-1]):
        return True
    if last in k.POSTFIX_CLOSERS and not _COMMA.search(s):
        return True
    if len(s) > 16 or _STOP.search(s) or (len(s) > 8 and not _ASCII.match(s) and not _MIXED.match(s)):
        return False
    return bool(_DIGITS.match(s)) or not _ASCII.match(s) or bool(_LETTER.search(s))


def metadata_line(line: str) -> bool:
    s = line.strip(_WS)
    m = _META.match(s) if len(s) <= 30 else None
    return bool(m) and m[1].strip(_WS) in _KEYS


class Dialogs:
    """Open quotes by kind; closers without an opener are let pass."""

    def __init__(self):
        self.n = dict.fromkeys(k.DIALOG_OPENERS, 0)

    def add(self, s: str) -> None:
        for ch in _QUOTE.findall(s):
            if ch in self.n:
                self.n[ch] += 1
            elif ch in _QUOTE_PAIR:
                self.n[_QUOTE_PAIR[ch]] = max(0, self.n[_QUOTE_PAIR[ch]] - 1)

    @property
    def open(self) -> bool:
        return any(self.n.values())


class Paragraph:
    """What the rules ask of the paragraph so far. `done` parts are counted."""

    __slots__ = ("brackets", "bytes", "chars", "cjk", "depth", "dialogs", "dipped", "done", "letters", "parts", "speech", "torn")

    def __init__(self, line: str = ""):
        self.parts, self.chars, self.torn, self.speech = [], 0, False, False
        self.done = self.bytes = self.cjk = self.letters = self.depth = 0
        self.brackets = self.dialogs = None
        self.dipped = False
        if line:
            self.add(line)

    def add(self, line: str) -> None:
        self.parts.append(line)
        self.chars += len(line)
        if _MARK.search(line):
            if self.brackets is None:
                self.brackets, self.dialogs = Brackets(), Dialogs()
            self.torn = self.brackets.add(line).open
            self.dialogs.add(line)
            self.speech = self.dialogs.open

    def extend(self, lines: list[str]) -> None:
        """Lines without brackets and quotes."""
        self.parts += lines
        self.chars += sum(map(len, lines))

    def count(self) -> Paragraph:
        if self.done < len(self.parts):
            new = "".join(self.parts[self.done :])
            self.done = len(self.parts)
            self.bytes += len(new.encode("utf-8", "surrogatepass"))
            self.cjk += len(_CJK_1.findall(new))
            self.letters += len(_LETTER.findall(new))
            first = self.parts[0][0]
            if close := _CLOSER.get(first):
                for ch in _BRACKET.findall(new):
                    self.depth += (ch == first) - (ch == close)
                    self.dipped |= self.depth < 0
        return self

    def text(self) -> str:
        return "".join(self.parts)

    def tail(self) -> str:
        n, i = 0, len(self.parts)
        while i and n < _TAIL:
            i -= 1
            n += len(self.parts[i])
        return "".join(self.parts[i:])[-_TAIL:].rstrip(_WS)

    def last(self) -> str:
        """Lines have no white space at their end."""
        return self.parts[-1][-1] if self.parts else ""

    def mostly(self) -> bool:
        return _mostly(self.count().cjk, self.letters)

    def overflows(self) -> bool:
        return self.count().bytes > OVERFLOW_BYTES

    def sentence_ended(self) -> bool:
        t = self.tail()
        seen = _SPACES.sub("", t)
        if not seen:
            return False
        last, prev = seen[-1], seen[-2:-1]
        if last in k.STRONG_END:
            return True
        if not prev:
            return False
        if last in ".:" and _CJK_1.match(t[-2:-1]) and self.mostly():
            return True
        if last in k.DIALOG_CLOSERS or last in k.POSTFIX_CLOSERS:
            before = t[:-1].rstrip(_WS)
            if prev in k.STRONG_END or (prev == "." and _CJK_1.match(before[-2:-1]) and self.mostly()):
                return True
        return last == "…" or t.endswith("..") or (last in k.COLONS and self.mostly())

    def bracketed(self) -> bool:
        return self.chars > 1 and _CLOSER.get(self.parts[0][0]) == self.last() and self.mostly() and not self.dipped and self.depth == 0

    def chapter_ended(self) -> bool:
        return self.chars <= 40 and self.last() in _CHAPTER_END and len(t := self.text().strip(_WS)) <= 15 and bool(_CHAPTER.search(t))

    def ended(self) -> bool:
        """What comes next begins another paragraph."""
        if self.speech or not self.parts or self.parts[-1][-1] not in _MAY_END:
            return False
        return (not self.torn and self.sentence_ended()) or self.bracketed() or self.chapter_ended()


def fold(text: str, page_header: bool = False, heading: re.Pattern | None = None) -> list[tuple[str, str]]:
    """(kind, segment) of a text that the guards let in; kinds: divider, marker, metadata, heading, text."""
    kinds, texts = [], []
    fold_to(kinds, texts, text, page_header, heading)
    return list(zip(kinds, texts, strict=True))


def fold_to(kinds: list[str], texts: list[str], text: str, page_header: bool = False, heading: re.Pattern | None = None) -> None:
    """fold() that puts kinds and segments at the end of two lists."""
    p = Paragraph()

    def flush(*alone: str) -> None:
        nonlocal p
        if p.parts:
            kinds.append("text")
            texts.append("".join(p.parts))
            p = Paragraph()
        if alone:
            kinds.append(alone[0])
            texts.append(alone[1])

    text = text.replace("\r\n", "\n").replace("\r", "\n") + "\n"
    at, end = 0, len(text)
    while at < end:
        if (known := _PLAIN.match(text, at)) and known.start(3) < 0:
            lines = known[1].split("\n")
            lines.pop()
            if heading is not None and (i := next((i for i, line in enumerate(lines) if heading.search(line)), None)) is not None:
                del lines[i:]
            if lines:
                at += sum(map(len, lines)) + len(lines)
                for i, line in enumerate(lines):
                    if i and p.chars > 40:
                        p.extend(lines[i:])
                        break
                    if p.ended():
                        flush()
                    p.parts.append(line)
                    p.chars += len(line)
                continue
            known = None
        after = text.index("\n", at)
        raw, at = text[at:after], after + 1
        if known and (heading is None or not heading.search(raw)):
            line, like = raw, False
        else:
            seen = raw.rstrip(_WS).lstrip(" ")
            if _DIVIDER.match(seen):
                flush("divider", seen)
                continue
            line = collapse(seen)
            if not line:
                if page_header or not p.parts or not (p.speech or p.torn or p.last() not in k.STRONG_END):
                    flush()
                continue
            if line[0] == "=" and _MARKER.match(line):
                flush("marker", line)
                continue
            if metadata_line(line):
                flush("metadata", line)
                continue
            if title_heading(line) or (heading is not None and heading.search(line)):
                flush("heading", line)
                continue
            like = heading_like(line)
        torn = p.torn
        if like:
            last = p.last()
            goes_on = line[-1] in k.COLONS or line[-1] in k.POSTFIX_CLOSERS or _ALL_CJK_WS.match(line)
            if not last or (not torn and last not in k.COMMAS and not (goes_on and last not in k.CLAUSE_OR_END)):
                flush("heading", line)
                continue
        last = line[-1]
        if not p.parts:
            p.add(line)
        elif last in k.STRONG_END and not p.speech and (not torn or p.overflows()):
            p.add(line)
            flush()
        elif line[0] in k.DIALOG_OPENERS and not (p.last() in k.COMMAS or _CJK_1.match(p.last())):
            flush()
            p.add(line)
        elif last in k.DIALOG_CLOSERS and len(line) > 1:
            p.add(line)
            if not p.speech and line[:-1].rstrip(" ")[-1] in k.CLAUSE_OR_END and (not torn or Brackets().add(line).open or p.overflows()):
                flush()
        else:
            if p.ended():
                flush()
            p.add(line)
    flush()


KINDS = "array<struct<kind:string,text:string>>"
ROWS = 200


def _folded(page_header: bool, heading: str | None):
    def run(texts: pa.Array) -> pa.Array:
        rx = re.compile(heading) if heading else None
        made = []
        # some rows at a time, so that few segments are held as Python objects
        for i in range(0, len(texts), ROWS):
            kinds, said, ends, none = [], [], [0], []
            for t in texts[i : i + ROWS].to_pylist():
                if t is not None:
                    fold_to(kinds, said, t, page_header, rx)
                ends.append(len(said))
                none.append(t is None)
            parts = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(said, pa.string())], ["kind", "text"])
            made.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts, mask=pa.array(none, pa.bool_())))
        return pa.concat_arrays(made) if made else pa.array([], pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())])))

    # as a deterministic one, Spark would run it again for filters and sizes that it infers
    return F.arrow_udf(run, KINDS).asNondeterministic()


def passes(text: str) -> F.Column:
    """Blank or Latin-leading: reflow leaves it as it is."""
    return F.expr(f"{rules.blank(SPARK, text)} OR {rules.latin_block(SPARK, text)}")


def segments(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", page_header: bool = False, heading: str | None = None) -> DataFrame:
    """(doc_id, segments array<struct<kind, text>>); a text that passes is one segment of kind "unchanged". Null text stays null."""
    kept = docs.select(doc_id, F.col(text).cast("string").alias("text"))
    folded = _folded(page_header, heading)(F.when(~passes("text"), F.col("text")))
    same = F.when(F.col("text").isNotNull(), F.array(F.struct(F.lit("unchanged").alias("kind"), "text")))
    return kept.select(doc_id, F.coalesce(folded, same).alias("segments"))


def _joined(page_header: bool, heading: str | None, gap: str):
    """The number of segments, and these joined: no segment goes back to Spark."""

    def run(texts: pa.Array) -> pa.Array:
        rx = re.compile(heading) if heading else None
        made = []
        for i in range(0, len(texts), ROWS):
            counts, whole = [], []
            for t in texts[i : i + ROWS].to_pylist():
                kinds, said = [], []
                if t is not None:
                    fold_to(kinds, said, t, page_header, rx)
                counts.append(None if t is None else len(said))
                whole.append(None if t is None else gap.join(said))
            made.append(pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(whole, pa.string())], ["n", "text"]))
        return pa.concat_arrays(made) if made else pa.array([], pa.struct([("n", pa.int64()), ("text", pa.string())]))

    return F.arrow_udf(run, "struct<n:bigint,text:string>").asNondeterministic()


def reflow(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", page_header: bool = False, compact: bool = False, heading: str | None = None) -> DataFrame:
    """(doc_id, n_segments, text)."""
    kept = docs.select(doc_id, F.col(text).cast("string").alias("text"))
    made = _joined(page_header, heading, "\n" if compact else "\n\n")(F.when(~passes("text"), F.col("text")))
    same = F.when(F.col("text").isNotNull(), F.lit(1).cast("bigint"))
    return kept.select(doc_id, "text", made.alias("made")).select(doc_id, F.coalesce("made.n", same).alias("n_segments"), F.coalesce("made.text", "text").alias("text"))
