"""Quality rules as a short-circuit cascade; DataFrame functions only.

Every rule is a predicate over text measures. Its cost (seconds a row) and its selectivity are estimated on a sample; the
cascade then tries the rules in the order of rejections per second, so that a cheap rule that rejects much runs first
and dear ones see few rows. The order never changes a verdict: it is the conjunction of all rules. A rule's measures
are taken only of the rows that the rules before it let pass, but for measures that the caller wants of every row.

The sample is one in SAMPLE_STEP rows of the first partitions that give SAMPLE_ROWS of them (of a small table: its first
rows), each cut to SAMPLE_CHARS characters, so at most SAMPLE_ROWS * SAMPLE_CHARS characters come to the driver. A rule is
timed in a run after one that compiles it, less what a run without any rule takes. It orders the rules and does nothing else.

Defined results: null text counts as empty; empty text has 0 words and fails; repeated rows are judged one by one;
null ids pass through; an empty table gives an empty table; other columns don't matter.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivener.llm.common import WORD, packed, text_of

SAMPLE_ROWS, SAMPLE_STEP, SAMPLE_CHARS = 300, 50, 4_000

#: rule: the measures it needs and the predicate that a kept document meets; m gives a measure's column.
RULES: dict[str, tuple[tuple[str, ...], Callable]] = {
    "enough_words": (("n_words",), lambda m: m("n_words") >= 50),
    "few_repeats": (("n_words", "n_repeat_words"), lambda m: 100 * m("n_repeat_words") <= 50 * m("n_words")),
    "word_length": (("n_words", "word_chars"), lambda m: m("word_chars").between(3 * m("n_words"), 12 * m("n_words"))),
    "few_symbols": (("n_words", "n_symbols"), lambda m: 10 * m("n_symbols") <= 2 * m("n_words")),
    "few_dup_lines": (("n_lines", "n_dup_lines"), lambda m: 100 * m("n_dup_lines") <= 50 * m("n_lines")),
    "few_capitals": (("word_chars", "n_capitals"), lambda m: 100 * m("n_capitals") <= 40 * m("word_chars")),
}
BASE = ("enough_words", "few_repeats")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that are found twice or more, the first included.

    Windows become codes of hash bits above position bits; after one primitive sort equal windows are neighbours.
    Where two different windows share their hash bits (in millions of words some do), the text's windows are sorted by two
    64-bit hashes instead, as long in proportion.
    """
    n = F.size(words)
    bits = F.greatest(F.lit(1), F.ceil(F.log2(n + F.lit(1)))).cast("int")
    return F.when(n < 4, F.lit(0)).otherwise(
        F.element_at(
            F.transform(
                F.array(F.struct(words.alias("w"), bits.alias("b"))),
                lambda s: _repeats(s["w"], s["b"]),
            ),
            1,
        )
    )


def _window(w: Column, i: Column) -> tuple[Column, ...]:
    return F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)


def _hash(w: Column, i: Column) -> Column:
    return F.xxhash64(*_window(w, i))


def _starts(w: Column) -> Column:
    return F.sequence(F.lit(0), F.size(w) - 3)


def _codes(w: Column, b: Column) -> Column:
    shift = lambda name, c: F.call_function(name, c, b)
    return F.sort_array(F.transform(_starts(w), lambda i: shift("shiftleft", shift("shiftrightunsigned", _hash(w, i))).bitwiseOR(i.cast("bigint"))))


def _repeats(w: Column, b: Column) -> Column:
    top = lambda c: F.call_function("shiftrightunsigned", c, b)
    low = lambda c: c.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), b) - 1).cast("int")
    text = lambda i: F.concat_ws(" ", *_window(w, i))

    def beside(xs: Column, same, place) -> Column:
        """Places of those that are the same as a neighbour."""
        near = lambda x, i: F.coalesce(same(x, F.get(xs, i - 1)), F.lit(False)) | F.coalesce(same(x, F.get(xs, i + 1)), F.lit(False))
        return F.transform(F.filter(xs, near), place)

    def from_codes(codes: Column) -> Column:
        clash = lambda x, i: (top(x) == top(F.get(codes, i + 1))) & (text(low(x)) != text(low(F.get(codes, i + 1))))
        quick = beside(codes, lambda x, y: top(x) == top(y), low)
        wide = F.sort_array(F.transform(_starts(w), lambda i: F.struct(_hash(w, i).alias("a"), F.xxhash64(F.lit("window"), *_window(w, i)).alias("b"), i.alias("i"))))
        sure = F.element_at(F.transform(F.array(wide), lambda xs: beside(xs, lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]), lambda x: x["i"])), 1)
        starts = F.when(F.exists(F.transform(codes, lambda x, i: F.coalesce(clash(x, i), F.lit(False))), lambda x: x), sure).otherwise(quick)
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))

    return F.element_at(F.transform(F.array(_codes(w, b)), from_codes), 1)


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))


_WORDS, _LINES = {"n_words", "word_chars", "n_repeat_words"}, {"n_lines", "n_dup_lines"}
#: Of the text, its words and its lines.
_MEASURES = {
    "n_words": lambda t, w, ls: F.size(w),
    "word_chars": lambda t, w, ls: F.length(F.array_join(w, "")),
    "n_symbols": lambda t, w, ls: F.regexp_count(t, F.lit("[#*$%&|<>]")),
    "n_lines": lambda t, w, ls: F.size(ls),
    "n_dup_lines": lambda t, w, ls: F.size(ls) - F.size(F.array_distinct(ls)),
    "n_repeat_words": lambda t, w, ls: repeated_words(w),
    "n_capitals": lambda t, w, ls: F.regexp_count(t, F.lit("[A-Z]")),
}


def _measure(name: str, columns: list[str]) -> Column:
    """The column of a measure, or the measure itself, over columns of words and lines where there are any."""
    if name in columns:
        return F.col(name)
    t = F.col("_t")
    return _MEASURES[name](t, F.col("_w") if "_w" in columns else _words(t), F.col("_l") if "_l" in columns else _lines(t)).cast("bigint")


def measured(rows: DataFrame, needed) -> DataFrame:
    """rows (with the text as _t) plus those of the needed measures that it lacks."""
    need = [m for m in _MEASURES if m in needed and m not in rows.columns]
    if _WORDS & set(need) and "_w" not in rows.columns:
        rows = rows.withColumn("_w", _words(F.col("_t")))
    if _LINES & set(need) and "_l" not in rows.columns:
        rows = rows.withColumn("_l", _lines(F.col("_t")))
    return rows.withColumns({m: _measure(m, rows.columns) for m in need})


def sample(docs: DataFrame, text: str) -> DataFrame:
    texts = docs.select(F.left(text_of(docs, text), F.lit(SAMPLE_CHARS)).alias("_t"))
    rows = texts.sample(1 / SAMPLE_STEP, 7).take(SAMPLE_ROWS)
    if len(rows) < SAMPLE_ROWS // 2:
        rows = texts.take(SAMPLE_ROWS)
    return docs.sparkSession.createDataFrame([tuple(r) for r in rows], "_t string").repartition(1)


def rule_order(docs: DataFrame, text: str = "text", given: tuple[str, ...] = ()) -> list[str]:
    """Rules by rejections per second on a sample, most first; measures that are given cost nothing."""
    base = measured(sample(docs, text), given)
    load = [F.sum(F.length("_t")), *(F.sum(m) for m in given)]

    def run(df: DataFrame) -> tuple[float, int]:
        df.first()
        began = time.perf_counter()
        bad = df.first()[0] or 0
        return time.perf_counter() - began, bad

    none, _ = run(base.agg(*load))
    rates = {}
    for rule, (measures, kept) in RULES.items():
        seconds, bad = run(measured(base, measures).agg(F.count_if(~kept(F.col)), *load))
        rates[rule] = bad / max(seconds - none, 1e-3)
    return sorted(RULES, key=lambda r: -rates[r])


def cascade(columns: list[str], order: list[str]) -> Column:
    """Whether a row passes all rules; a measure that has no column is taken where the rules before it let the row pass."""
    chain = F.when(F.lit(False), F.lit(False))
    for rule in order:
        chain = chain.when(~RULES[rule][1](lambda m: _measure(m, columns)), F.lit(False))
    return chain.otherwise(F.lit(True))


def quality_rules(docs: DataFrame, text: str = "text", report: tuple[str, ...] = tuple(_MEASURES)) -> DataFrame:
    """_row (struct of docs' columns but text), the measures to be reported (n_words and n_repeat_words among them),
    _base_failed and _kept."""
    rows = measured(docs.select(packed(docs, text), text_of(docs, text).alias("_t")), report)
    kept = cascade(rows.columns, rule_order(docs, text, report))
    base = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    return rows.select("_row", *report, base.alias("_base_failed"), kept.alias("_kept"))


def quality_filter(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that pass, with the columns they came with. A rule's measures are taken of the rows that the rules
    before it let pass; a generator stands for each filter, as Spark would move filters down and take measures twice."""
    rows = docs.select(packed(docs), text_of(docs, text).alias("_t"))
    for rule in rule_order(docs, text):
        measures, kept = RULES[rule]
        rows = measured(rows, measures)
        rows = rows.select(*rows.columns, F.explode(F.when(kept(F.col), F.array(F.lit(True)))).alias("_pass")).drop("_pass")
    return rows.select("_row.*")


#: What op8's contract has of every row; other measures are taken only where the cascade comes to them.
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def query(docs: DataFrame) -> DataFrame:
    return quality_rules(docs.select("doc_id", "text"), report=REPORTED).select("_row.doc_id", *REPORTED, F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))


ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t),
win AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
        FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM dup, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
ln AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
m AS (SELECT t.r, t.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words,
             CAST(length(array_to_string(w.ws, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(t.text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
             CAST(len(ln.ls) AS BIGINT) AS n_lines,
             CAST(len(ln.ls) - len(list_distinct(ln.ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(len(regexp_extract_all(t.text, '[A-Z]')) AS BIGINT) AS n_capitals
      FROM t JOIN w USING (r) JOIN ln USING (r) LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words
       AND word_chars BETWEEN 3 * n_words AND 12 * n_words AND 10 * n_symbols <= 2 * n_words
       AND 100 * n_dup_lines <= 50 * n_lines AND 100 * n_capitals <= 40 * word_chars AS kept
FROM m
"""
