"""Text rules as SQL expressions over a column; d is a dialect, c the column's SQL. All stay native in Spark.

Null text gives null. Every function is one rule; the comments give what isn't in its name. For Spark most rules first ask
something cheap that most lines fail, since a pattern costs it more than anything else; DuckDB gets the rule alone.
"""

from __future__ import annotations

import re

from scrivener.functions import charsets as k
from scrivener.functions.charsets import CJK, WS, inside

_B = f"[{WS}]"
#: The white space that WS stands for.
SPACES = "".join(c for c in map(chr, range(0x3001)) if re.match(_B, c))
#: A few ranges with all white space, marks, ASCII and digits of the rules, but neither CJK nor other letters.
_ODD = "[\\x00-\\xBF\\u1680\\u2000-\\u33FF\\uFE00-\\uFFFF]"


def _ranges(chars):
    """chars as the inside of a class of Java's, neighbours as one range: it asks each range by itself."""
    out, codes = [], sorted(set(map(ord, chars)))
    for n in codes:
        if out and out[-1][1] == n - 1:
            out[-1][1] = n
        else:
            out.append([n, n])
    return "".join(f"\\u{a:04X}" if a == b else f"\\u{a:04X}-\\u{b:04X}" for a, b in out)


def trim_end(d, c):
    return f"trim(TRAILING {d.text(SPACES)} FROM {c})" if d.name == "spark" else d.sub(c, f"{_B}+\\z")


#: A column of this name is trimmed already; rules that trim then use it as it is.
TRIMMED = "trimmed"


def trim(d, c):
    if c == TRIMMED:
        return c
    return f"trim(BOTH {d.text(SPACES)} FROM {c})" if d.name == "spark" else d.sub(c, f"\\A{_B}+|{_B}+\\z")


def _last(d, c, n=1):
    """The last n characters that aren't white space."""
    return f"right({d.sub(c, f'{_B}+')}, {n})"


def _may_end(d, c, marks):
    """Spark's first question: the last character that isn't white space is one of marks, or there is none."""
    return f"instr({d.text(marks)}, right({trim_end(d, c)}, 1)) > 0"


def _len(d, c, drop):
    return f"length({d.sub(c, drop)})"


# page texts
def newlines(d, c):
    return d.sub(c, "\r\n?", "\n")


def compress_newlines(d, c):
    return d.sub(c, "\n{3,}", "\n\n")


def blank(d, c):
    return d.has(c, f"\\A{_B}*\\z")


def page_text(d, c):
    """White space only: one line end; else the text without trailing white space and an empty line."""
    return f"CASE WHEN {blank(d, c)} THEN {d.text(chr(10))} ELSE concat({trim_end(d, c)}, {d.text(chr(10) * 2)}) END"


def decoded_page(d, c):
    """Of decoded UTF-16 text: one trailing NUL goes, nothing left is a line end, then both rules on line ends."""
    body = d.sub(c, "\\x00\\z")
    return f"CASE WHEN {body} = '' THEN {d.text(chr(10))} ELSE {compress_newlines(d, newlines(d, body))} END"


def page_header(d, no, total):
    return f"concat('=== [Page ', cast({no} AS varchar(20)), '/', cast({total} AS varchar(20)), '] ===', {d.text(chr(10))})"


def page_row(d, c, status, no, total, header):
    """Degenerate pages are a line end without a header, even where one is asked for."""
    head = page_header(d, no, total) if header else "''"
    return f"CASE WHEN {status} <> 'ok' THEN {d.text(chr(10))} ELSE concat({head}, {page_text(d, c)}) END"


# guards
def latin_block(d, c, limit=100):
    """Of the first `limit` visible characters: none CJK, 40 at least, nine tenths Latin or ASCII marks."""
    seen = c if d.name == "duckdb" else d.part(c, f"\\A(?:{_B}*+[^{WS}]){{0,{limit}}}", 0)  # no further than the limit
    head = f"left({d.sub(seen, f'{_B}+')}, {limit})"
    let = (lambda body: f"transform(array({head}), head -> {body('head')})[0]") if d.name == "spark" else lambda body: body(head)
    latin = lambda h: _len(d, h, f"[^{k.LATINISH.replace(chr(39), chr(92) + 'x27')}{k.LATIN_LETTERS}]")
    return let(lambda h: f"(NOT {d.has(h, f'[{CJK}]')} AND length({h}) >= 40 AND {latin(h)} * 10 >= length({h}) * 9)")


# strings
def all_ascii(d, c):
    return d.has(c, "\\A[\\x00-\\x7F]*\\z")


def all_cjk(d, c, spaces=True):
    return d.has(c, f"\\A{_B}*(?:[{CJK}]{_B}*)+\\z" if spaces else f"\\A[{CJK}]+\\z")


def mixed_cjk_ascii(d, c):
    ascii_, neutral = "A-Za-z0-9０-９", " /:.\\-"
    ok = f"[{neutral}{ascii_}{CJK}]*"
    return f"({d.has(c, f'\\A{ok}[{CJK}]{ok}[{ascii_}]')} OR {d.has(c, f'\\A{ok}[{ascii_}]{ok}[{CJK}]')})"


def mostly_cjk(d, c):
    n = _len(d, c, f"[^{CJK}]")
    return f"({n} > 0 AND {n} >= {_len(d, c, '[^A-Za-z]')})"


def any_cjk(d, c):
    return d.has(c, f"[{CJK}]")


def without_indent(d, c):
    return d.sub(c, "\\A +")


def without_last(d, c):
    return f"substr({c}, 1, greatest(length({c}) - 1, 0))"


def first_n(d, c, n):
    """The first n characters, and where the rest begins."""
    return f"left({c}, {n})", f"least(length({c}), {n}) + 1"


def last_visible_place(d, c):
    """The place, from 1, of the last character that isn't white space; 0 without one."""
    return f"length({trim_end(d, c)})"


def wrapped(d, c):
    """Trimmed, the text begins and ends with one bracket pair."""
    t = trim(d, c)
    pair = f"translate(left({t}, 1), {d.text(k.BRACKET_OPENERS)}, {d.text(k.BRACKET_CLOSERS)})"
    return f"({d.has(t, f'\\A[{inside(k.BRACKET_OPENERS)}]')} AND length({t}) >= 2 AND right({t}, 1) = {pair})"


def ends_clause(d, c):
    """The last character that isn't white space ends a clause or sentence."""
    return d.has(c, f"[{inside(k.CLAUSE_OR_END)}]{_B}*\\z")


def last_two(d, c):
    """Null where there are fewer than two."""
    rule = f"CASE WHEN {_len(d, c, f'{_B}+')} >= 2 THEN {_last(d, c, 2)} END"
    return f"CASE WHEN length({c}) >= 2 AND NOT {d.has(f'right({c}, 2)', _B)} THEN right({c}, 2) ELSE {rule} END" if d.name == "spark" else rule


def ends_postfix_closer(d, c):
    return d.has(c, f"[{inside(k.POSTFIX_CLOSERS)}]{_B}*\\z")


def ends_colon(d, c):
    return d.has(c, f"[{k.COLONS}]{_B}*\\z")


def ends_ellipsis(d, c):
    return d.has(c, f"(?:…|\\.\\.){_B}*\\z")


def any_comma(d, c):
    return d.has(c, f"[{k.COMMAS}]")


def dialog_opener(d, c):
    return d.has(c, f"\\A[ \u3000]*[{k.DIALOG_OPENERS}]")


def divider(d, c):
    return d.has(c, f"\\A{_B}*(?:[{k.DIVIDERS}]{_B}*){{3,}}\\z")


def unclosed_bracket(d, c):
    """A stack of openers; '!' once a closer doesn't match."""
    op = f"translate(ch, {d.text(k.BRACKET_CLOSERS)}, {d.text(k.BRACKET_OPENERS)})"
    is_op = d.has("ch", f"[{inside(k.BRACKET_OPENERS)}]")
    body = f"CASE WHEN st = '!' OR ch = '' THEN st WHEN {is_op} THEN concat(st, ch) WHEN right(st, 1) = {op} THEN substr(st, 1, length(st) - 1) ELSE '!' END"
    return _left_open(d, c, k.BRACKET_OPENERS + k.BRACKET_CLOSERS, body)


def _left_open(d, c, chars, body):
    some = inside(chars) if d.name == "duckdb" else _ranges(chars)
    only = d.sub(c, f"[^{some}]")
    left = f"{d.fold(d.chars(only), d.text(''), body)} <> ''"
    if d.name == "duckdb":
        return f"({d.has(c, f'[{some}]')} AND {left})"
    return f"({d.has(c, _ODD)} AND {d.has(c, f'[{some}]')} AND (length({only}) % 2 = 1 OR {left}))"  # of an odd number one stays open


def unclosed_quote(d, c):
    """A bag of open quotes; '!' at a closer without its opener. Both low closers end the first kind."""
    op = f"translate(ch, {d.text(k.DIALOG_CLOSERS)}, {d.text(k.DIALOG_OPENERS + '““')})"
    at = f"instr(st, {op})"
    is_op = d.has("ch", f"[{k.DIALOG_OPENERS}]")
    body = f"CASE WHEN st = '!' OR ch = '' THEN st WHEN {is_op} THEN concat(st, ch) WHEN {at} = 0 THEN '!' ELSE concat(substr(st, 1, {at} - 1), substr(st, {at} + 1)) END"
    return _left_open(d, c, k.DIALOG_OPENERS + k.DIALOG_CLOSERS, body)


def dialog_open(d, c):
    """Of a paragraph: a quote is open. A closer without its opener is let pass, and the two low closers end nothing."""
    op = f"translate(ch, {d.text(k.DIALOG_PAIRED)}, {d.text(k.DIALOG_OPENERS)})"
    at = f"instr(st, {op})"
    is_op = d.has("ch", f"[{k.DIALOG_OPENERS}]")
    body = f"CASE WHEN ch = '' THEN st WHEN {is_op} THEN concat(st, ch) WHEN {at} = 0 THEN st ELSE concat(substr(st, 1, {at} - 1), substr(st, {at} + 1)) END"
    some = k.DIALOG_OPENERS + k.DIALOG_PAIRED
    return f"({d.has(c, f'[{k.DIALOG_OPENERS}]')} AND {d.fold(d.chars(d.sub(c, f'[^{some}]')), d.text(''), body)} <> '')"


def bracket_balanced(d, c, opener):
    """Depth of one kind never below zero and zero at the end; opener is SQL for the opening character."""
    close = f"translate({opener}, {d.text(k.BRACKET_OPENERS)}, {d.text(k.BRACKET_CLOSERS)})"
    only = d.sub(c, f"[^{inside(k.BRACKET_OPENERS + k.BRACKET_CLOSERS)}]")
    body = f"CASE WHEN st = '!' THEN st WHEN ch = {opener} THEN concat(st, '(') WHEN ch = {close} THEN CASE WHEN st = '' THEN '!' ELSE substr(st, 2) END ELSE st END"
    return f"({d.fold(d.chars(only), d.text(''), body)} = '')"


# ends of a paragraph
def sentence_boundary(d, c):
    last, mostly = _last(d, c), mostly_cjk(d, c)
    strong = f"[{k.STRONG_END}]"
    closer = f"[{k.DIALOG_CLOSERS}{inside(k.POSTFIX_CLOSERS)}]"
    # the character right before the mark must be CJK; the closers after it may be any but the last is a quote or a parenthesis
    first = f"CASE WHEN NOT {_may_end(d, c, k.STRONG_END + '.…' + k.COLONS + k.DIALOG_CLOSERS + k.POSTFIX_CLOSERS)} THEN false " if d.name == "spark" else "CASE "
    return first + (
        f"WHEN {blank(d, c)} THEN false WHEN {d.has(last, strong)} THEN true WHEN {_len(d, c, f'{_B}+')} < 2 THEN false "
        f"WHEN {d.has(c, f'[{CJK}][.:]{_B}*\\z')} AND {mostly} THEN true "
        f"WHEN {d.has(c, f'{strong}{_B}*{closer}{_B}*\\z')} THEN true WHEN {d.has(c, f'[{CJK}]\\.{_B}*{closer}{_B}*\\z')} AND {mostly} THEN true "
        f"WHEN {ends_colon(d, c)} AND {mostly} THEN true ELSE {ends_ellipsis(d, c)} END"
    )


def _wrapped(d, t):
    """t (trimmed) begins and ends with one bracket pair around something mostly CJK."""
    pair = f"translate(left({t}, 1), {d.text(k.BRACKET_OPENERS)}, {d.text(k.BRACKET_CLOSERS)})"
    inner = f"substr({t}, 2, greatest(length({t}) - 2, 0))"
    return f"({d.has(t, f'\\A[{inside(k.BRACKET_OPENERS)}]')} AND length({t}) >= 2 AND right({t}, 1) = {pair} AND NOT {blank(d, inner)} AND {mostly_cjk(d, inner)})"


def bracket_boundary(d, c):
    t = trim(d, c)
    return f"({_wrapped(d, t)} AND {bracket_balanced(d, t, f'left({t}, 1)')})"


def chapter_end(d, c):
    t = trim(d, c)
    return f"(length({t}) <= 15 AND {d.has(t, f'[{k.CHAPTER_MARKERS}][{inside(k.CHAPTER_TRAIL)}]*\\z')})"


# lines
def page_marker(d, c):
    return d.has(c, "(?s)\\A=== .*===\\z")


def title_heading(d, c):
    t = trim(d, c)
    words = "|".join(k.HEADING_WORDS)
    if d.name == "spark":
        begins = f"[第卷章{''.join(sorted({w[0] for w in k.HEADING_WORDS}))}]"
        # the first place that decides, and what follows it
        place = f"(?s)\\A(?>.{{0,10}}?第.{{0,5}}?[{k.CHAPTER_MARKERS}](?=[{k.NOT_AFTER_MARKER}]|.{{0,20}}\\z))(?![{k.NOT_AFTER_MARKER}])"
        return (
            f"CASE WHEN NOT {d.has(c, begins)} THEN false WHEN length({t}) > 50 OR {d.has(t, f'[{k.NOT_IN_HEADING}]')} THEN false WHEN {d.has(t, f'\\A(?:{words})')} THEN true "
            f"WHEN {d.has(t, f'\\A[卷章][{k.NUMERALS}]')} AND length({t}) <= 17 THEN true ELSE coalesce({d.has(t, place)}, false) END"
        )
    places = d.array(", ".join(str(100 * i + j) for i in range(11) for j in range(i + 1, i + 7)))
    at = lambda n: f"substr({t}, cast({n} AS int), 1)"
    i, j = f"({d.div('k', '100')} + 1)", "(k % 100 + 1)"
    marker = " OR ".join(f"{at(j)} = '{m}'" for m in k.CHAPTER_MARKERS)
    after = " OR ".join(f"{at('k % 100 + 2')} = '{m}'" for m in k.NOT_AFTER_MARKER)
    decisive = f"{at(i)} = '第' AND ({marker}) AND (({after}) OR length({t}) - {j} <= 20)"
    found = d.first(places, decisive)
    bad = d.has(f"substr({t}, cast({found} % 100 + 2 AS int), 1)", f"[{k.NOT_AFTER_MARKER}]")
    return (
        f"CASE WHEN {t} = '' OR length({t}) > 50 OR {d.has(t, f'[{k.NOT_IN_HEADING}]')} THEN false WHEN {d.has(t, f'\\A(?:{words})')} THEN true "
        f"WHEN {d.has(t, f'\\A[卷章][{k.NUMERALS}]')} AND length({t}) <= 17 THEN true WHEN NOT {d.has(t, '第')} THEN false ELSE coalesce(NOT {bad}, false) END"
    )


def heading_like(d, c):
    t = trim(d, c)
    most = f"CASE WHEN {all_ascii(d, t)} OR {mixed_cjk_ascii(d, t)} THEN 16 ELSE 8 END"
    end = f"[{inside(k.CLAUSE_OR_END)}]"
    rule = (
        f"CASE WHEN {t} = '' OR {page_marker(d, t)} OR {unclosed_bracket(d, t)} OR {unclosed_quote(d, t)} THEN false WHEN {_wrapped(d, t)} THEN true "
        f"WHEN {ends_colon(d, t)} AND length({t}) < {most} AND {d.has(t, f'\\A[{CJK}]+[{k.COLONS}]\\z')} THEN true "
        f"WHEN {ends_postfix_closer(d, t)} AND NOT {any_comma(d, t)} THEN true WHEN {d.has(t, f'{end}\\z')} THEN false WHEN {any_comma(d, t)} THEN false "
        f"WHEN length({t}) <= {most} THEN CASE WHEN {d.has(t, end)} THEN false ELSE {d.has(t, f'\\A{_B}*(?:[0-9０-９]{_B}*)+\\z')} OR NOT {all_ascii(d, t)} OR {d.has(t, '[A-Za-z]')} END ELSE false END"
    )
    if d.name == "duckdb":
        return rule
    marks = _ranges(k.BRACKET_OPENERS + k.BRACKET_CLOSERS + k.DIALOG_OPENERS + k.DIALOG_CLOSERS)
    stops = _ranges(k.COMMAS + k.CLAUSE_OR_END)
    unmarked = (  # what is left of the rule without brackets and quotes
        f"CASE WHEN length({t}) > 16 OR {t} = '' THEN false WHEN {d.has(t, f'[{stops}]')} THEN length({t}) < 8 AND {d.has(t, f'\\A[{CJK}]{{1,6}}[{k.COLONS}]\\z')} "
        f"ELSE (length({t}) < 8 AND {d.has(t, f'\\A[{CJK}]{{1,6}}[{k.COLONS}]\\z')}) OR {{rest}} END"
    ).replace("{rest}", f"((length({t}) <= 8 OR {all_ascii(d, t)} OR {mixed_cjk_ascii(d, t)}) AND NOT {page_marker(d, t)} AND ({d.has(t, f'\\A{_B}*(?:[0-9０-９]{_B}*)+\\z')} OR NOT {all_ascii(d, t)} OR {d.has(t, '[A-Za-z]')}))")
    return f"CASE WHEN NOT {d.has(t, _ODD)} THEN length({t}) BETWEEN 1 AND 8 WHEN NOT {d.has(t, f'[{marks}]')} THEN {unmarked} ELSE {rule} END"


def metadata_line(d, c):
    t = trim(d, c)
    shape = f"(?s)\\A([^{k.METADATA_SEPARATORS}]{{1,10}})[{k.METADATA_SEPARATORS}]{_B}*([^{WS}{k.DIALOG_OPENERS}]).*\\z"
    keys = ", ".join(f"'{x}'" for x in k.METADATA_KEYS)
    rule = f"length({t}) <= 30 AND {trim(d, d.part(t, shape))} IN ({keys})"
    return f"({d.has(c, f'[{k.METADATA_SEPARATORS}]')} AND {rule})" if d.name == "spark" else f"({rule})"


# repeats within a line
def token_collapse(d, c):
    """A unit of 4 to 10 characters that tiles the token three times or more stands once (Spark: by back reference)."""
    if d.name == "spark":
        return f"CASE WHEN length({c}) BETWEEN 12 AND 200 THEN {d.sub(c, '(?s)\\A(.{4,10}?)\\1{2,}\\z', '$1')} ELSE {c} END"
    units = " ".join(f"WHEN length({c}) % {u} = 0 AND length({c}) >= {3 * u} AND {c} = repeat(left({c}, {u}), length({c}) // {u}) THEN left({c}, {u})" for u in range(4, 11))
    return f"CASE WHEN length({c}) > 200 THEN {c} {units} ELSE {c} END"


PHRASES = r"\A(.*?)(?<![^ ])([^ ]+(?: [^ ]+){0,7}?)(?: \2){2,}(?![^ ])(.*)\z"


def segment_collapse(d, c):
    """White space becomes single spaces, the first phrase said three times stands once, then each token."""
    one = d.sub(trim(d, c), f"{_B}+", " ")
    if d.name == "duckdb":  # its patterns know no back-references
        return _collapse_by_lists(d, one)
    phrases = f"regexp_replace({one}, {d.lit('(?s)' + PHRASES)}, {d.lit('$1$2$3')})"
    return f"CASE WHEN NOT {d.has(c, _B)} THEN {token_collapse(d, c)} ELSE array_join(transform(split({phrases}, ' '), t -> {token_collapse(d, 't')}), ' ') END"


def _collapse_by_lists(d, one):
    """The words w as a list; f is the first place i, then least length n, of a phrase that two copies follow; r counts all copies."""
    let = lambda name, value, body: f"list_transform([{value}], lambda {name}: {body})[1]"
    copy = lambda at, k: f"w[{at}.i + ({k}) * {at}.n : {at}.i + ({k} + 1) * {at}.n - 1]"
    places = "flatten(list_transform(range(1, len(w) - 1), lambda i: list_transform(range(1, least(8, (len(w) - i + 1) // 3) + 1), lambda n: {'i': i, 'n': n})))"
    first = f"list_filter({places}, lambda p: {copy('p', 0)} = {copy('p', 1)} AND {copy('p', 0)} = {copy('p', 2)})[1]"
    copies = f"list_filter(range(1, len(w) + 2), lambda j: {copy('f', 'j')} <> {copy('f', 0)})[1]"
    words = let("f", first, f"CASE WHEN f IS NULL THEN w ELSE {let('r', copies, 'list_concat(w[1 : f.i + f.n - 1], w[f.i + r * f.n : len(w)])')} END")
    return f"array_to_string(list_transform({let('w', f"string_split({one}, ' ')", words)}, lambda t: {token_collapse(d, 't')}), ' ')"


# names of outputs
def text_output(d, c, converted=True):
    suffix = "_converted.txt" if converted else "_extracted.txt"
    return f"concat({d.sub(c, '(?<=[^/])\\.[^./]*\\z' if d.name == 'spark' else '([^/])\\.[^./]*\\z', '' if d.name == 'spark' else '$1')}, '{suffix}')"


def archive_format(d, c):
    """By extension, case-sensitive; null for others."""
    ext = d.part(c, "\\.([^./]+)\\z")
    return f"CASE WHEN {ext} IN ('docx', 'xlsx', 'pptx', 'odt', 'ods', 'odp', 'epub') THEN {ext} END"


def archive_output(d, c, fmt):
    return f"concat({text_output(d, c).removeprefix('concat(').rsplit(', ', 1)[0]}, '_converted.', {fmt})"


# archive entries
def entry_name(d, c):
    return f"replace({c}, {d.text(chr(92))}, '/')"


def target_entry(d, fmt, c):
    return (
        f"CASE {fmt} WHEN 'docx' THEN {c} = 'word/document.xml' WHEN 'xlsx' THEN {c} = 'xl/sharedStrings.xml' OR {d.has(c, '(?s)\\Axl/worksheets/.*\\.xml\\z')} "
        f"WHEN 'pptx' THEN {d.has(c, '(?s)\\Appt/(?:slides|notesSlides)/.*\\.xml\\z')} WHEN 'odt' THEN {c} = 'content.xml' WHEN 'ods' THEN {c} = 'content.xml' WHEN 'odp' THEN {c} = 'content.xml' "
        f"WHEN 'epub' THEN {d.has(f'lower({c})', '\\.(?:xhtml|opf|ncx|html)\\z')} ELSE false END"
    )


def unsafe_entry(d, c):
    return d.has(c, "\\A/|(?:\\A|/)\\.\\.(?:/|\\z)")


def inline_string_cell(d, c):
    return d.has(c, "\\A[^>]*t=[\"\\x27]inlineStr[\"\\x27][^>]*>")


def thousands(d, c):
    return f"format_number({c}, 0)" if d.name == "spark" else f"format('{{:,}}', {c})"


def progress(d, page, total, chars):
    percent = d.div(f"{page} * 100", f"greatest({total}, 1)")
    body = f"concat('Loading [', cast({page} AS varchar(20)), '/', cast({total} AS varchar(20)), '] (', lpad(cast({percent} AS varchar(20)), 3, ' '), '%) Extracted ', cast({chars} AS varchar(20)), ' chars')"
    return f"rpad({body}, cast(greatest(70, length({body})) AS int), ' ')"


#: code: (name, message, hint). Fixed values.
ERRORS = {
    0: ("Success", "no error reported"),
    1: ("Unknown", "unknown error"),
    2: ("File", "cannot open file (missing / permission / IO error)"),
    3: ("Format", "invalid or corrupted PDF format"),
    4: ("Password", "PDF is password protected"),
    5: ("Security", "PDF security handler blocked access"),
    6: ("Page", "page processing error"),
}
OTHER_ERROR = ("Other", "unrecognized PDFium error code")
HINTS = {
    2: "Check the file path and permissions. Network drives may fail; try copying the PDF to a local disk.",
    3: "Try opening the PDF in a viewer; re-export or re-download if it fails.",
    4: "Decrypt the PDF first or provide a password (if supported).",
}
OTHER_HINT = "Run with --verbose and include PDF path + pdfium version when reporting."


def error_name(d, c):
    return f"CASE {c} {' '.join(f'WHEN {i} THEN {d.text(n)}' for i, (n, _) in ERRORS.items())} ELSE {d.text(OTHER_ERROR[0])} END"


def error_message(d, c):
    return f"CASE {c} {' '.join(f'WHEN {i} THEN {d.text(m)}' for i, (_, m) in ERRORS.items())} ELSE {d.text(OTHER_ERROR[1])} END"


def error_hint(d, c):
    return f"CASE {c} {' '.join(f'WHEN {i} THEN {d.text(h)}' for i, h in HINTS.items())} ELSE {d.text(OTHER_HINT)} END"


def error_report(d, path, code):
    """Four lines about a document that doesn't open."""
    line = d.text(chr(10))
    return f"concat('Error: failed to open PDF', {line}, '  Path   : ', {path}, {line}, '  PDFium : ', {error_name(d, code)}, ' — ', {error_message(d, code)}, {line}, '  Hint   : ', {error_hint(d, code)})"


def failure(path: str | None, code: int | None, message: str | None) -> str:
    """error_report's text, or, without a code, one line."""
    if code is None:
        return f"Error: {path}: {message or 'no text'}"
    name, said = ERRORS.get(code, OTHER_ERROR)
    return f"Error: failed to open PDF\n  Path   : {path}\n  PDFium : {name} — {said}\n  Hint   : {HINTS.get(code, OTHER_HINT)}"
