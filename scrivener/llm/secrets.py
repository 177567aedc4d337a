"""Secret scans with corpus-wide ownership frequency; DataFrame functions only.

Candidates are found by pattern in whole texts. Each candidate's value is hashed (two 64-bit hashes) and counted
over distinct repositories and distinct owners: a value that several owners hold is a copied example, a value of one
owner looks live. Base kinds (assign, access, hex) are always reported; the weak kind `token` (long strings of mixed
case and digits outside base spans) only where its value belongs to at most LIVE_OWNERS owners and LIVE_REPOS repositories.

In `documents` the owner is `source`; the repository is (source, lang).

Counts go through distinct (value, owner) and (value, repository) rows with partial aggregation, so a value that a
third of all rows share sends one row a task; where counts meet the spans, rows of frequent values are split by their
number. Only candidates are shuffled, never texts.

Defined results: null text counts as empty; null owner or repository is an owner of its own; each input row gives a
row, repeated rows and null ids included; an empty table gives an empty table; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from scrivener.llm.common import dealt, hot_keys, keyed, real_id, written

LIVE_OWNERS = 1
LIVE_REPOS = 2

KEYS = "(?i:password|passwd|secret|token|api_?key)"
#: kind: (pattern with one group around the value, least length of the value, pattern that a text with such a match surely meets)
KINDS: dict[str, tuple[str, int, str]] = {
    "assign": (KEYS + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, KEYS + r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}"""),
    "access": (r"(AKIA[A-Z0-9]+)", 18, "AKIA[A-Z0-9]{14}"),
    "hex": (r"([0-9a-f]{16,})", 16, "[0-9a-f]{16}"),
    "token": (r"([A-Za-z0-9+/_=-]{24,})", 24, "[A-Za-z0-9+/_=-]{24}"),
}
BASE = ("assign", "access", "hex")
RANK = {k: i for i, k in enumerate(KINDS)}


def _found(kind: str) -> Column:
    """(gap before, match, value) of the leftmost non-overlapping matches, in order.

    Every match begins where the one before ended, and the last takes the rest of the text, so a text is read in one go for
    the gaps and one for the matches; values are taken out of the matches.
    """
    pattern, _, sure = KINDS[kind]
    at = lambda g: F.regexp_extract_all(F.col("_text"), F.lit(rf"(?s)\G(.*?)({pattern}|\z)"), F.lit(g))
    parts = F.arrays_zip(at(1).alias("gap"), at(2).alias("all"))
    value = lambda x: F.regexp_extract(x["all"], pattern, 1)
    one = F.transform(F.filter(parts, lambda x: x["all"] != ""), lambda x: F.struct(F.lit(RANK[kind]).alias("kind"), F.length(x["gap"]).alias("gap"), F.length(x["all"]).alias("len"), value(x).alias("value")))
    return F.when(F.col("_text").rlike(sure), one)


def candidates(docs: DataFrame) -> DataFrame:
    """(_id, _key, kind, start, end, value, owner, repo) and a row of null kind for each input row."""
    arrays = [F.coalesce(_found(k), F.array().cast("array<struct<kind:int,gap:int,len:int,value:string>>")) for k in KINDS]
    scanned = docs.select("_id", "_key", "_owner", "_repo", *(a.alias(f"_{k}") for k, a in zip(KINDS, arrays, strict=True)))
    rows = [F.transform(f"_{k}", lambda x, i: F.struct(i.alias("nth"), x.alias("x"))) for k in KINDS]
    return scanned.select("_id", "_key", "_owner", "_repo", F.explode_outer(F.concat(*rows)).alias("c")).select("_id", "_key", "_owner", "_repo", "c.nth", "c.x.*")


def secret_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repo: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """A row for each span: _id, _key, kind (rank), start, end, value, n_owners, n_repos, live; with `copies`, the number of
    input rows of that (_id, _key); documents without any span have one row of null kind."""
    who = F.coalesce(docs[owner].cast("string"), F.lit("\0"))
    where = F.xxhash64(*(F.coalesce(docs[c].cast("string"), F.lit("\0")) for c in repo))
    base = docs.select(*keyed(docs, doc_id, text), who.alias("_owner"), where.alias("_repo"))
    found = written(candidates(base), "candidates")
    copies = found.filter("nth IS NULL OR nth = 0").groupBy("_id", "_key").agg(F.count("*").alias("rows"), F.count_distinct(F.coalesce("kind", F.lit(-1))).alias("kinds")).select("_id", "_key", F.expr("rows div kinds").alias("copies"))
    w = Window.partitionBy("_id", "_key", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    once = found.filter("kind IS NOT NULL").groupBy("_id", "_key", "kind", "nth").agg(F.first("gap").alias("gap"), F.first("len").alias("len"), F.first("value").alias("value"))
    placed = once.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(w)).withColumn("start", F.col("end") - F.col("len"))
    mixed = F.col("value").rlike("[A-Z]") & F.col("value").rlike("[a-z]") & F.col("value").rlike("[0-9]")
    placed = placed.filter((F.length("value") >= F.get(F.array(*(F.lit(n) for _, n, _ in KINDS.values())), F.col("kind"))) & ((F.col("kind") < len(BASE)) | mixed))
    # a weak candidate inside or across a base span isn't one
    b = Window.partitionBy("_id", "_key").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    a = Window.partitionBy("_id", "_key").orderBy(F.col("start").desc(), F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, -1)
    strong = F.col("kind") < len(BASE)
    placed = placed.withColumns({"_before": F.max(F.when(strong, F.col("end"))).over(b), "_after": F.min(F.when(strong, F.col("start"))).over(a)})
    placed = placed.filter(strong | ((F.coalesce("_before", F.lit(0)) <= F.col("start")) & (F.coalesce("_after", F.col("end")) >= F.col("end")))).drop("_before", "_after")
    names = lambda df: df.withColumns({"v1": F.xxhash64("value"), "v2": F.xxhash64(F.lit("value"), "value")})
    valued = names(found.filter("kind IS NOT NULL")).groupBy("v1", "v2", "_owner", "_repo").agg(F.count("*").alias("n"))
    owned = valued.groupBy("v1", "v2", "_owner").agg(F.count("*").alias("r"), F.sum("n").alias("n"))
    held = written(owned.groupBy("v1", "v2").agg(F.count("*").alias("n_owners"), F.sum("r").alias("n_repos"), F.sum("n").alias("n")), "held")
    hot = hot_keys(held.select("v1", "n"), "v1")
    spans = dealt(names(placed), hot, "v1", F.xxhash64("_id", "_key", "start")).join(dealt(held.drop("n"), hot, "v1"), ["v1", "v2", "salt"])
    spans = spans.withColumn("live", (F.col("n_owners") <= LIVE_OWNERS) & (F.col("n_repos") <= LIVE_REPOS)).filter(strong | F.col("live"))
    cols = ("_id", "_key", "kind", "start", "end", "value", "n_owners", "n_repos", "live")
    none = copies.select("_id", "_key", *(F.lit(None).cast(spans.schema[c].dataType).alias(c) for c in cols[2:]), "copies")
    return spans.select(*cols, F.lit(None).cast("bigint").alias("copies")).unionByName(none)


def query(docs: DataFrame) -> DataFrame:
    spans = secret_spans(docs)
    name = F.get(F.array(*(F.lit(k) for k in KINDS)), F.col("kind"))
    one = F.struct("start", "kind", F.concat_ws(":", name, F.col("start").cast("string"), F.col("end").cast("string")).alias("s"))
    count = lambda k: F.count(F.when(F.col("kind") == RANK[k], 1))
    per = spans.groupBy("_id", "_key").agg(
        *(count(k).alias(f"n_{k}") for k in BASE), F.count(F.when(F.col("live"), 1)).alias("n_live"), F.count(F.when(~F.col("live"), 1)).alias("n_example"),
        F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), one))).alias("all"), F.max("copies").alias("copies"),
    )
    joined = lambda xs: F.array_join(F.transform(xs, lambda x: x["s"]), ",")
    out = per.withColumns({"base_sha256": F.sha2(joined(F.filter("all", lambda x: x["kind"] < len(BASE))).cast("binary"), 256), "spans": joined(F.col("all"))})
    return out.select(real_id().alias("doc_id"), *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_live", "n_example", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_")).drop("_")


def _oracle() -> str:
    q = lambda s: s.replace("'", "''")
    key = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    parts = []
    for k, (p, n, _) in KINDS.items():
        rx = q("(?s)(.*?)(" + p.replace(KEYS, key) + ")")
        parts.append(f"""SELECT r, '{k}' AS kind, {RANK[k]} AS rank, {n} AS least, i, gaps[i] AS gap, ms[i] AS m, vs[i] AS v FROM (
            SELECT r, gaps, ms, vs, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT r, regexp_extract_all(text, '{rx}', 1) AS gaps,
            regexp_extract_all(text, '{rx}', 2) AS ms, regexp_extract_all(text, '{rx}', 3) AS vs FROM t))""")
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, source, lang FROM documents),
f AS ({" UNION ALL ".join(parts)}),
p AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY r, kind ORDER BY i) AS e FROM f),
c AS (SELECT r, kind, rank, CAST(e - length(m) AS BIGINT) AS s, CAST(e AS BIGINT) AS e, v FROM p WHERE length(v) >= least
      AND (rank < 3 OR (regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[0-9]')))),
x AS (SELECT * FROM c WHERE rank < 3 OR NOT EXISTS (SELECT 1 FROM c AS b WHERE b.r = c.r AND b.rank < 3 AND b.s < c.e AND b.e > c.s)),
h AS (SELECT v, count(DISTINCT coalesce(source, chr(0))) AS owners, count(DISTINCT (coalesce(source, chr(0)), coalesce(lang, chr(0)))) AS repos FROM f JOIN t USING (r) GROUP BY v),
k AS (SELECT x.*, owners <= {LIVE_OWNERS} AND repos <= {LIVE_REPOS} AS live FROM x JOIN h USING (v)),
z AS (SELECT r, rank, live, s, kind || ':' || s || ':' || e AS one FROM k WHERE rank < 3 OR live)
SELECT t.doc_id, CAST(count(*) FILTER (WHERE rank = 0) AS BIGINT) AS n_assign, CAST(count(*) FILTER (WHERE rank = 1) AS BIGINT) AS n_access,
       CAST(count(*) FILTER (WHERE rank = 2) AS BIGINT) AS n_hex,
       sha256(coalesce(string_agg(one, ',' ORDER BY s, rank) FILTER (WHERE rank < 3), '')) AS base_sha256,
       coalesce(string_agg(one, ',' ORDER BY s, rank), '') AS spans,
       CAST(count(*) FILTER (WHERE live) AS BIGINT) AS n_live, CAST(count(*) FILTER (WHERE NOT live) AS BIGINT) AS n_example
FROM t LEFT JOIN z USING (r) GROUP BY t.r, t.doc_id
"""


ORACLE = _oracle()
