"""Line dedup by winnowing over line hashes; DataFrame functions only.

The lines of a text that hold a word form a sequence (blank lines are no part of it and always stay). A *run* is
RUN consecutive lines of it. A line goes if it lies in a run that also starts earlier: at a smaller (id, text hash,
place). Runs are judged on the input.

That is op1's rule, as its SQL has it. The pipeline's stage has a wider one: a line of LONG or more words is a run by
itself, and so is a whole text of a single line. Such lines are counted, and joined to their first place, by
two 64-bit hashes of the line (salted as below); blank texts hold none.

Of every RUN consecutive line hashes the least (leftmost of equals) is a fingerprint, so each run holds one and two
equal runs hold the same one at the same place. Fingerprints are counted over the corpus; those found once are
dropped. Around each place of the others, the windows that chose it extend the match to both sides; a window's name
(two 64-bit hashes) joins its first place, and overlapping windows of later places make up the longest match, which
is deleted. Counts and first places are aggregated before the shuffle, and no pairs of places are made. Joins carry
(place, hash) rows; those of frequent fingerprints are split by their number, so a line that a third of all documents
share is dealt over as many tasks as it takes.

Defined results: null text counts as empty; a null id sorts first; rows that agree in id and text are one document
stated twice and get the same result; a copy of an earlier document of RUN or more lines loses all its lines and
stays as a row with an empty text; an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivener.llm.common import WORD, dealt, few, hot_keys, keyed, packed, written

#: Lines of a run, which is also the winnowing window: every run that long is found.
RUN = 2
#: Words of a line that is a run by itself, in the pipeline's stage.
LONG = 50


def _lines(text: Column) -> Column:
    """(place in the text, line) of the lines that hold a word."""
    every = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("s")))
    return F.filter(every, lambda x: x["s"].rlike(WORD))


def _windows(docs: DataFrame, run: int) -> DataFrame:
    """A row for each fingerprint of a document: its hash and the windows that chose it (place, two names)."""
    hashed = docs.select("_id", "_key", F.transform(_lines(F.col("_text")), lambda x: F.struct(F.xxhash64(x["s"]).alias("a"), F.xxhash64(F.lit("line"), x["s"]).alias("b"))).alias("h")).filter(F.size("h") >= run)

    def name(p: Column, side: str) -> Column:
        return F.xxhash64(*(F.get(F.col("h"), p + k)[side] for k in range(run)))

    def window(p: Column) -> Column:
        here = F.slice(F.col("h"), p + 1, run)
        least = F.array_min(F.transform(here, lambda x: x["a"]))
        at = p + F.array_position(F.transform(here, lambda x: x["a"]), least).cast("int") - 1
        return F.struct(least.alias("print"), at.alias("at"), p.alias("p"), name(p, "a").alias("a"), name(p, "b").alias("b"))

    windows = F.transform(F.sequence(F.lit(0), F.size("h") - run), window)
    return hashed.select("_id", "_key", F.explode(windows).alias("w")).select("_id", "_key", "w.*")


def _alone(docs: DataFrame, long: int) -> DataFrame:
    """As _windows, for lines that are runs by themselves."""
    lines = docs.select("_id", "_key", _lines(F.col("_text")).alias("l"))
    worded = F.transform("l", lambda x, p: F.struct(p.alias("p"), x["s"].alias("s")))
    # long or more words hold at least 2 * long - 1 characters
    enough = lambda x: (F.size("l") == 1) | ((F.length(x["s"]) >= 2 * long - 1) & (F.regexp_count(x["s"], F.lit(WORD)) >= long))
    each = lines.select("_id", "_key", F.explode(F.filter(worded, enough)).alias("w"))
    a = F.xxhash64("w.s")
    return each.select("_id", "_key", a.alias("print"), F.col("w.p").alias("at"), F.col("w.p").alias("p"), a.alias("a"), F.xxhash64(F.lit("line"), "w.s").alias("b"))


def _repeated(windows: DataFrame, run: int) -> DataFrame:
    """(_id, _key, p): places of the lines of later windows."""
    often = windows.groupBy("print").agg(F.count("*").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"), F.min("_id").alias("i0"), F.max("_id").alias("i1"), F.min("_key").alias("k0"), F.max("_key").alias("k1"))
    # a print of one place only is unique
    often = written(often.filter("n > 1 AND NOT (lo = hi AND i0 = i1 AND k0 = k1)").select("print", "n"), "prints")
    hot = hot_keys(often, "print")
    live = dealt(windows, hot, "print", F.xxhash64("_id", "_key", "p")).join(dealt(often.select("print"), hot, "print"), ["print", "salt"])
    first = live.groupBy("print", "a", "b").agg(F.min(F.struct("_id", "_key", "p")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = live.join(dealt(first, hot, "print"), ["print", "a", "b", "salt"]).filter(F.struct("_id", "_key", "p") > F.col("first"))
    return later.select("_id", "_key", F.explode(F.sequence(F.col("p"), F.col("p") + run - 1)).alias("p"))


def repeated_lines(docs: DataFrame, run: int = RUN, long: int | None = None) -> DataFrame:
    """(_id, _key, gone): places in the sequence of each document's lines that go, for documents that lose any."""
    texts = docs.select("_id", "_key", "_text")
    places = _repeated(_windows(texts, run), run)
    if long is not None:
        places = places.union(_repeated(_alone(texts, long), 1))
    return places.groupBy("_id", "_key").agg(F.collect_set("p").alias("gone"))


def line_dedup(docs: DataFrame, run: int = RUN, doc_id: str = "doc_id", text: str = "text", long: int | None = None) -> DataFrame:
    """_row (struct of the columns but text), _null (text was null), _text, _kept_text, _lines and _gone (counts)."""
    rows = docs.select(packed(docs, text), docs[text].isNull().alias("_null"), *keyed(docs, doc_id, text))
    gone = repeated_lines(rows, run, long).select(F.col("_id").alias("_gi"), F.col("_key").alias("_gk"), "gone")
    joined = rows.join(gone, (F.col("_id") == F.col("_gi")) & (F.col("_key") == F.col("_gk")), "left")
    out = F.coalesce(F.transform("gone", lambda p: F.get(F.col("_ls"), p)["i"]), F.array().cast("array<int>"))
    cut = joined.withColumn("_ls", _lines(F.col("_text"))).withColumns({"_out": out, "_all": F.split("_text", "\n")})
    rest = F.array_except(F.sequence(F.lit(0), F.size("_all") - 1), F.col("_out"))
    kept = F.when(F.size("_out") == 0, F.col("_text")).otherwise(F.array_join(F.transform(rest, lambda i: F.get(F.col("_all"), i)), "\n"))
    return cut.select("_row", "_null", "_text", kept.alias("_kept_text"), F.size("_ls").cast("bigint").alias("_lines"), F.size("_out").cast("bigint").alias("_gone"))


def without_repeats(docs: DataFrame, run: int = RUN, long: int | None = LONG) -> DataFrame:
    """docs with later repeated runs and long lines deleted from text (n_chars follows, where there is one)."""

    def column(c: str) -> Column:
        own = F.col("_row")[c] if c != "text" else F.when(~F.col("_null"), F.col("_text"))
        if c == "text":
            return F.when(F.col("_gone") == 0, own).otherwise(F.col("_kept_text")).alias(c)
        if c == "n_chars":
            return F.when(F.col("_gone") == 0, own).otherwise(F.length("_kept_text").cast(docs.schema[c].dataType)).alias(c)
        return own.alias(c)

    return line_dedup(docs, run, long=long).select(*(column(c) for c in docs.columns))


def query(docs: DataFrame) -> DataFrame:
    return line_dedup(docs.select("doc_id", "text")).select("_row.doc_id", F.col("_lines").alias("n_lines"), F.col("_gone").alias("n_removed"), F.sha2(F.col("_kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, doc_id, i, ls[i] AS s FROM (SELECT r, doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
      FROM (SELECT r, doc_id, string_split(text, chr(10)) AS ls FROM t))),
s AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY i) AS p, lead(s) OVER (PARTITION BY r ORDER BY i) AS s2
      FROM l WHERE regexp_matches(s, '[^\x20\x09-\x0D]')),
g AS (SELECT r, p, row_number() OVER (PARTITION BY s, s2 ORDER BY doc_id, p) AS nth FROM s WHERE s2 IS NOT NULL),
gone AS (SELECT DISTINCT r, p + k AS p FROM g, (SELECT unnest(range(0, {RUN})) AS k) WHERE nth > 1),
j AS (SELECT l.r, l.i, l.s, s.p, gone.p AS out FROM l LEFT JOIN s ON l.r = s.r AND l.i = s.i
      LEFT JOIN gone ON s.r = gone.r AND s.p = gone.p)
SELECT t.doc_id, CAST(count(j.p) AS BIGINT) AS n_lines, CAST(count(j.out) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(j.s, chr(10) ORDER BY j.i) FILTER (WHERE j.out IS NULL), '')) AS kept_sha256
FROM t JOIN j USING (r) GROUP BY t.r, t.doc_id
"""
