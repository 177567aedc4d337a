"""Dictionary conversion of script variants: at each place the longest entry, from a table (config, src, dst) of the user's.

A config may go in rounds (an optional column `round`), each over what the one before made. Entries of one character alone
are a native translate(). Others go through an Arrow kernel: phrases are found by their first two characters and then by
length, longest first, so the time doesn't grow with their number; where few patterns of characters say all phrases, one
regular expression cuts the text instead. The table is checked to hold at most ENTRIES entries
and broadcast once. Quotation marks are converted on demand (the `punct` switch).

Defined results: null text stays null; of entries with the same src the least dst counts; entries with null or empty src
or null dst don't; what no entry covers stays as it is.
"""

from __future__ import annotations

import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRIES = 2_000_000
#: Of the pattern of all phrases: how many of them, alternatives at a place, characters, and characters of a phrase.
MANY, WIDE, LONG, DEEP = 100_000, 16, 20_000, 40
# Names of the known configs; a dictionary may have others.
CONFIGS = ("s2t", "t2s", "s2tw", "tw2s", "s2twp", "tw2sp", "s2hk", "hk2s", "t2tw", "tw2t", "t2twp", "tw2tp", "t2hk", "hk2t", "t2jp", "jp2t")
# Quotation marks of simplified and of traditional texts.
SIMPLIFIED_QUOTES, TRADITIONAL_QUOTES = "“”‘’", "「」『』"


def configs(dictionary: DataFrame) -> list[str]:
    return sorted(r["config"] for r in dictionary.select("config").distinct().collect())


def read_dictionary(spark: SparkSession, path: str, config: str, round_: int = 0) -> DataFrame:
    """Text files with a line for each entry: src, a tab, and dst or several of which the first counts."""
    line = F.split(F.col("value"), "\t")
    rows = spark.read.text(path).filter(F.col("value").rlike(r"\A[^#\t][^\t]*\t"))
    return rows.select(F.lit(config).alias("config"), F.lit(round_).alias("round"), F.get(line, 0).alias("src"), F.get(F.split(F.trim(F.get(line, 1)), " "), 0).alias("dst"))


def entries(dictionary: DataFrame, config: str) -> list[dict[str, str]]:
    """The entries of a config by round; a config that the dictionary lacks is an error that names those it has."""
    n = F.col("round").cast("int") if "round" in dictionary.columns else F.lit(0)
    valid = dictionary.filter((F.col("config") == config) & (F.col("src") != "") & F.col("dst").isNotNull())
    rows = valid.groupBy(F.coalesce(n, F.lit(0)).alias("round"), "src").agg(F.min("dst").alias("dst")).limit(ENTRIES + 1).collect()
    if len(rows) > ENTRIES:
        raise ValueError(f"dictionary {config} has over {ENTRIES} entries")
    if not rows:
        raise ValueError(f"unknown config {config}; known: {', '.join(configs(dictionary))}; supported: {' | '.join(CONFIGS)}")
    by_round: dict[int, dict[str, str]] = defaultdict(dict)
    for r in rows:
        by_round[r["round"]][r["src"]] = r["dst"]
    return [by_round[k] for k in sorted(by_round)]


def quotes(config: str) -> dict[str, str]:
    """Quotation marks that change with a config: of simplified texts to traditional ones, or back."""
    if config.startswith("s"):
        return dict(zip(SIMPLIFIED_QUOTES, TRADITIONAL_QUOTES, strict=True))
    return dict(zip(TRADITIONAL_QUOTES, SIMPLIFIED_QUOTES, strict=True)) if config.endswith(("2s", "2sp")) else {}


def rounds_of(dictionary: DataFrame, config: str, punct: bool = False) -> list[dict[str, str]]:
    return entries(dictionary, config) + ([q] if punct and (q := quotes(config)) else [])


def pattern_of(phrases: dict[str, str]) -> str | None:
    """A pattern that takes the longest of the phrases: their trie, where characters with the same continuations share one
    class. None if it would be wide or long, since alternatives are tried one after another."""
    if len(phrases) > MANY or max(map(len, phrases), default=0) > DEEP:
        return None
    root: dict = {}
    for phrase in phrases:
        node = root
        for ch in phrase:
            node = node.setdefault(ch, {})
        node[""] = {}

    def written(node: dict) -> str | None:
        by_rest: dict[str | None, list[str]] = defaultdict(list)
        for ch, child in node.items():
            if ch:
                by_rest[written(child)].append(ch)
        if None in by_rest or len(by_rest) > WIDE:
            return None
        said = "|".join(f"[{''.join(map(re.escape, sorted(chars)))}]{rest}" for rest, chars in by_rest.items())
        if len(said) > LONG:
            return None
        return f"(?:{said})" + "?" * ("" in node) if said else ""

    return written(root)


class Round:
    def __init__(self, table: dict[str, str]):
        self.single = str.maketrans({a: b for a, b in table.items() if len(a) == 1})
        self.phrases = {a: b for a, b in table.items() if len(a) > 1}
        sizes = defaultdict(set)
        for a in self.phrases:
            sizes[a[:2]].add(len(a))
        self.sizes = {a: sorted(n, reverse=True) for a, n in sizes.items()}
        self.table = {a: b for a, b in table.items() if a}
        self.cut = None
        if self.phrases and (pattern := pattern_of(self.phrases)):
            begins = "".join(map(re.escape, sorted({a[0] for a in self.table})))
            self.cut = re.compile(f"{pattern}|[^{begins}]+|.", re.S).findall

    def __call__(self, text: str) -> str:
        if not self.phrases:
            return text.translate(self.single)
        if self.cut:
            parts = self.cut(text)
            return "".join(map(self.table.get, parts, parts))
        sizes, phrases, out, at, i, end = self.sizes.get, self.phrases.get, [], 0, 0, len(text) - 1
        while i < end:
            for n in sizes(text[i : i + 2], ()):
                made = phrases(text[i : i + n])
                if made is not None and i + n <= end + 1:
                    out += text[at:i].translate(self.single), made
                    i += n
                    at = i
                    break
            else:
                i += 1
        return "".join([*out, text[at:].translate(self.single)])


class Converter:
    def __init__(self, rounds: list[dict[str, str]]):
        self.rounds = [Round(t) for t in rounds]

    def __call__(self, text: str) -> str:
        for r in self.rounds:
            text = r(text)
        return text


def shared(spark: SparkSession, rounds: list[dict[str, str]]):
    """A function that gives the converter, made once in each worker process from a broadcast table."""
    held = spark.sparkContext.broadcast(rounds)

    def converter() -> Converter:
        if not hasattr(held, "_converter"):
            held._converter = Converter(held.value)
        return held._converter

    return converter


def native(c: Column, rounds: list[dict[str, str]]) -> Column:
    """For entries of one character to one character."""
    for table in rounds:
        c = F.translate(c, "".join(table), "".join(table.values()))
    return c


def convert(docs: DataFrame, dictionary: DataFrame, config: str, doc_id: str = "doc_id", text: str = "text", punct: bool = False) -> DataFrame:
    """(doc_id, text) converted."""
    rounds = rounds_of(dictionary, config, punct)
    kept = docs.select(doc_id, F.col(text).cast("string").alias("text"))
    if all(len(a) == len(b) == 1 for table in rounds for a, b in table.items()):
        return kept.withColumn("text", native(F.col("text"), rounds))
    converter = shared(docs.sparkSession, rounds)

    def run(texts: pa.Array) -> pa.Array:
        convert_one = converter()
        return pa.array([t if t is None else convert_one(t) for t in texts.to_pylist()], pa.string())

    return kept.withColumn("text", F.arrow_udf(run, "string").asNondeterministic()("text"))
