"""The reflow as one SQL statement for DuckDB: a second, plain writing of the fold, against which the kernel is held.

Lines are classed by the rules' SQL. A list_reduce over the lines then holds the segments so far and the whole text of
the paragraph, and asks the rules of that text again at every line, where the kernel keeps summaries.
"""

from __future__ import annotations

from scrivener.functions import charsets as k
from scrivener.functions import rules as r
from scrivener.functions.charsets import CJK, WS, inside
from scrivener.functions.dialect import DUCK

OVERFLOW_BYTES = 360


def _let(names: dict[str, str], body: str) -> str:
    """body with names for values; each value may use the names before it."""
    for name, value in reversed(names.items()):
        body = f"list_transform([{value}], lambda {name}: {body})[1]"
    return body


def _class(line: str, heading: str | None) -> str:
    probe = DUCK.sub(line, "\\A[ \u3000]+")
    title = r.title_heading(DUCK, probe) + (f" OR {DUCK.has(probe, heading)}" if heading else "")
    return (
        f"CASE WHEN {r.blank(DUCK, probe)} THEN 'blank' WHEN {r.page_marker(DUCK, probe)} THEN 'marker' WHEN {r.metadata_line(DUCK, line)} THEN 'metadata' "
        f"WHEN {title} THEN 'heading' WHEN {r.heading_like(DUCK, line)} THEN 'like' ELSE 'text' END"
    )


#: Of a line: what it is, and what the rules ask of it. The state of the fold is a line, too.
_FIELDS = ("line", "kind", "opener", "closer", "strong", "goes", "prev", "torn", "out", "buf")


def _lines(source: str, heading: str | None) -> str:
    trimmed = r.without_indent(DUCK, r.trim_end(DUCK, "raw"))
    divider = r.divider(DUCK, DUCK.sub("seen", "\\A[ \u3000]+"))
    visible = DUCK.sub("line", f"[{WS}]+")
    goes = f"{r.all_cjk(DUCK, 'line')} OR {r.ends_colon(DUCK, 'line')} OR {r.ends_postfix_closer(DUCK, 'line')}"
    closes = f"length({visible}) > 1 AND {DUCK.has(visible, f'[{k.DIALOG_CLOSERS}]\\z')}"
    values = {
        "line": "line", "kind": "kind", "opener": r.dialog_opener(DUCK, "line"), "closer": closes, "strong": DUCK.has(visible, f"[{k.STRONG_END}]\\z"), "goes": goes,
        "prev": DUCK.has(visible, f"[{inside(k.CLAUSE_OR_END)}].\\z"), "torn": r.unclosed_bracket(DUCK, "line"), "out": "CAST([] AS STRUCT(kind VARCHAR, text VARCHAR)[])", "buf": "''",
    }
    struct = ", ".join(f"{f} := {values[f]}" for f in _FIELDS)
    return f"""SELECT doc_id, list(struct_pack({struct}) ORDER BY n) AS xs FROM (
        SELECT doc_id, n, line, CASE WHEN kind = 'divider' THEN kind ELSE {_class("line", heading)} END AS kind FROM (
        SELECT doc_id, n, CASE WHEN {divider} THEN seen ELSE {r.segment_collapse(DUCK, "seen")} END AS line, CASE WHEN {divider} THEN 'divider' ELSE '' END AS kind
        FROM (SELECT doc_id, n, {trimmed} AS seen FROM (
        SELECT doc_id, unnest(range(len(ls))) AS n, unnest(ls) AS raw FROM (
        SELECT doc_id, string_split({r.newlines(DUCK, "text")}, chr(10)) AS ls FROM {source}))))) GROUP BY doc_id"""


def _fold(page_header: bool) -> str:
    last = f"right({DUCK.sub('s.buf', f'[{WS}]+')}, 1)"
    both = "concat(s.buf, x.line)"
    joined = f"(NOT {r.dialog_open(DUCK, both)} AND x.prev AND (NOT torn OR x.torn OR strlen({both}) > {OVERFLOW_BYTES}))"
    act = f"""CASE WHEN x.kind IN ('divider', 'marker', 'metadata', 'heading') THEN 'alone'
        WHEN x.kind = 'blank' THEN CASE WHEN {str(not page_header).lower()} AND s.buf <> '' AND (speech OR torn OR NOT {DUCK.has("tail", f"[{k.STRONG_END}]")}) THEN 'skip' ELSE 'flush' END
        WHEN x.kind = 'like' AND (tail = '' OR (NOT torn AND NOT {DUCK.has("tail", f"[{k.COMMAS}]")} AND NOT (x.goes AND NOT {DUCK.has("tail", f"[{inside(k.CLAUSE_OR_END)}]")}))) THEN 'alone'
        WHEN s.buf <> '' AND NOT speech AND (NOT torn OR strlen(s.buf) > {OVERFLOW_BYTES}) AND x.strong THEN 'end'
        WHEN s.buf = '' THEN 'start'
        WHEN x.opener AND NOT {DUCK.has("tail", f"[{k.COMMAS}{CJK}]")} THEN 'start'
        WHEN x.closer THEN CASE WHEN {joined} THEN 'end' ELSE 'add' END
        WHEN NOT speech AND (({r.sentence_boundary(DUCK, "s.buf")} AND NOT torn) OR {r.bracket_boundary(DUCK, "s.buf")} OR {r.chapter_end(DUCK, "s.buf")}) THEN 'start'
        ELSE 'add' END"""
    seg = lambda kind, text: f"[struct_pack(kind := {kind}, text := {text})]"
    before = f"CASE WHEN s.buf = '' THEN s.out ELSE list_concat(s.out, {seg(DUCK.text('text'), 's.buf')}) END"
    alone = seg("CASE WHEN x.kind = 'like' THEN 'heading' ELSE x.kind END", "x.line")
    out = f"CASE act WHEN 'alone' THEN list_concat({before}, {alone}) WHEN 'flush' THEN {before} WHEN 'start' THEN {before} WHEN 'end' THEN list_concat(s.out, {seg(DUCK.text('text'), both)}) ELSE s.out END"
    buf = f"CASE act WHEN 'start' THEN x.line WHEN 'add' THEN {both} WHEN 'skip' THEN s.buf ELSE '' END"
    state = ", ".join(f"{f} := " + {"out": out, "buf": buf, "line": "''", "kind": "''"}.get(f, "false") for f in _FIELDS)
    step = _let({"torn": r.unclosed_bracket(DUCK, "s.buf"), "speech": r.dialog_open(DUCK, "s.buf"), "tail": last, "act": act}, f"struct_pack({state})")
    first = ", ".join(f"{f} := " + {"out": "CAST([] AS STRUCT(kind VARCHAR, text VARCHAR)[])", "buf": "''", "line": "''", "kind": "''"}.get(f, "false") for f in _FIELDS)
    # an empty line with a header always flushes, so it ends the last paragraph
    end = first.replace("kind := ''", "kind := 'end'")
    step = step.replace("CASE WHEN x.kind IN (", "CASE WHEN x.kind = 'end' THEN 'flush' WHEN x.kind IN (", 1)
    return f"list_reduce(list_append(xs, struct_pack({end})), lambda s, x: {step}, struct_pack({first})).out"


def segments_sql(source: str, page_header: bool = False, heading: str | None = None) -> str:
    """(doc_id, segs list of (kind, text)) of source (doc_id, text), where no text is null."""
    passes = f"({r.blank(DUCK, 'text')} OR {r.latin_block(DUCK, 'text')})"
    folded = f"SELECT doc_id, {_fold(page_header)} AS segs FROM ({_lines(f'(SELECT * FROM {source} WHERE NOT {passes})', heading)})"
    return f"SELECT doc_id, [struct_pack(kind := 'unchanged', text := text)] AS segs FROM {source} WHERE {passes} UNION ALL {folded}"


def reflow_sql(source: str, page_header: bool = False, compact: bool = False, heading: str | None = None) -> str:
    gap = "chr(10)" if compact else "chr(10) || chr(10)"
    return f"SELECT doc_id, CAST(len(segs) AS BIGINT) AS n_segments, coalesce(array_to_string(list_transform(segs, lambda g: g.text), {gap}), '') AS text FROM ({segments_sql(source, page_header, heading)})"
