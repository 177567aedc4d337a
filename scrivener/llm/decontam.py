"""Benchmark decontamination by size-partitioned MinHash containment search.

A benchmark item is contained in a document if at least CONTAINMENT of its distinct SHINGLE-word shingles (lower-cased
A-Z) occur in it. Items are partitioned by size (powers of two of their number of shingles). A partition of at most u
shingles keeps, of each item, the m least shingle hashes, m = floor((1 - CONTAINMENT) * u) + 1: a document that
contains the item lacks fewer than m of its shingles, so it holds at least one of the m, however long it is. Documents
are scanned once for these hashes, whole, by numpy over the bytes of a batch; a document that holds one is a candidate
for the item and is verified on the shingles themselves.

Items come to the driver in blocks of at most BLOCK characters (an item longer than that is a block), and each block is a
pass over the documents: a fixed query set in blocks. One block's index is held at a time: where there are several, what a
pass finds is written before the next block is read. Nothing is shuffled; where documents are to be taken out, the found
ones are broadcast if they are few (counted).

Defined results: null texts count as empty; an item without words is contained in nothing; an item of fewer than
SHINGLE words is one shingle of its own length; repeated rows give repeated results; null ids pass through; empty
tables give an empty table; other columns don't matter.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivener.llm.common import LEAST_ID, few, id_of, packed, text_of, written
from scrivener.llm.hashing import Powers, mix, word_hashes

SHINGLE, CONTAINMENT = 5, 0.8
#: Characters of benchmark text in one pass.
BLOCK = 8_000_000
#: Bytes of documents that numpy handles at once; a longer document is handled alone.
CHUNK = 1_000_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(0x2545F4914F6CDD1D) + words[k : len(words) - n + 1 + k])
    return out


def shingles(text: str, n: int = SHINGLE) -> list[bytes]:
    words = text.encode().translate(_LOWER).split()
    return [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


class Index:
    """A block of items: sketches by shingle length, and the shingles for verification."""

    def __init__(self, items: list[tuple[int, str]], containment: float = CONTAINMENT):
        self.items, self.containment = [], containment
        powers, by_length = Powers(), defaultdict(lambda: ([], []))
        for item_id, text in items:
            data = text.encode().translate(_LOWER)
            count = len(data.split())
            if not count:
                continue
            n = min(SHINGLE, count)
            own = frozenset(shingles(text, n))
            u = 1 << (len(own) - 1).bit_length()
            m = min(len(own), math.floor((1 - containment) * u + 1e-9) + 1)
            sketch = np.unique(gram_hashes(word_hashes(data, powers)[0], n))[:m]
            by_length[n][0].append(sketch)
            by_length[n][1].append(np.full(len(sketch), len(self.items)))
            self.items.append((item_id, n, own))
        self.sketches = {}
        for n, (values, owners) in by_length.items():
            v, o = np.concatenate(values), np.concatenate(owners)
            order = np.argsort(v, kind="stable")
            v, o = v[order], o[order]
            bits = np.zeros(1 << 20, bool)
            bits[(v >> np.uint64(44)).astype(np.int64)] = True
            self.sketches[n] = (v, o, bits)

    def candidates(self, texts: list[bytes], powers: Powers) -> set[tuple[int, int]]:
        """(text, item): the text holds a hash of the item's sketch."""
        data = b"\n".join(texts)
        offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        words, starts = word_hashes(data, powers)
        owner = np.searchsorted(offsets, starts, "right") - 1
        found = set()
        for n, (v, o, bits) in self.sketches.items():
            grams = gram_hashes(words, n)
            maybe = np.flatnonzero(bits[(grams >> np.uint64(44)).astype(np.int64)])
            maybe = maybe[owner[maybe] == owner[maybe + n - 1]]
            lo, hi = np.searchsorted(v, grams[maybe], "left"), np.searchsorted(v, grams[maybe], "right")
            for g, a, b in zip(maybe[hi > lo], lo[hi > lo], hi[hi > lo], strict=True):
                found.update((int(owner[g]), int(i)) for i in o[a:b])
        return found

    def verified(self, text: bytes, items: list[int]):
        """(item_id, shingles of the item, those found in the text) of the contained items."""
        words, grams = text.split(), {}
        for i in items:
            item_id, n, own = self.items[i]
            if n not in grams:
                grams[n] = {b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)}
            k = len(own & grams[n])
            if k >= self.containment * len(own) - 1e-9:
                yield item_id, len(own), k


def _search(index: Index):
    def run(batches):
        powers = Powers()
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [])
            texts = b.column(1).cast(pa.binary())
            group, rows, size = [], [], 0

            def flush():
                by_text = defaultdict(list)
                for t, i in index.candidates(group, powers):
                    by_text[t].append(i)
                for t in sorted(by_text):
                    for found in index.verified(group[t], by_text[t]):
                        for column, x in zip(out, (rows[t], *found), strict=True):
                            column.append(x)

            for r, t in enumerate(texts):
                t = t.as_py().translate(_LOWER)
                if group and size + len(t) > CHUNK:
                    flush()
                    group, rows, size = [], [], 0
                group.append(t)
                rows.append(r)
                size += len(t) + 1
            if group:
                flush()
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(out[0], pa.int64())) for k in (0, 2)), *(pa.array(x, pa.int64()) for x in out[1:])], ["doc_id", "_key", "item_id", "n_shingles", "n_found"])

    return run


def _blocks(benchmark: DataFrame, item_id: str, text: str, block: int):
    rows, size = [], 0
    for r in benchmark.select(id_of(benchmark, item_id).alias("i"), text_of(benchmark, text).alias("t")).toLocalIterator():
        if rows and size + len(r["t"]) > block:
            yield rows
            rows, size = [], 0
        rows.append((r["i"], r["t"]))
        size += len(r["t"])
    if rows:
        yield rows


def _found(docs: DataFrame, benchmark: DataFrame, doc_id: str, item_id: str, text: str, block: int) -> DataFrame:
    schema = "doc_id bigint, _key bigint, item_id bigint, n_shingles bigint, n_found bigint"
    t = text_of(docs, text)
    source = docs.select(id_of(docs, doc_id).alias("doc_id"), t.alias("t"), F.xxhash64(t).alias("_key"))
    found, now = [], None
    for rows in _blocks(benchmark, item_id, text, block):
        if now is not None:
            found.append(written(now, "contained"))
        now = source.mapInArrow(_search(Index(rows)), schema)
    if now is None:
        return docs.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.union, [*found, written(now, "contained")]) if found else now


def contained_items(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found) of the items that documents contain."""
    return _found(docs, benchmark, doc_id, item_id, text, block).drop("_key")


def decontaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those that contain a benchmark item."""
    bad = _found(docs, benchmark, doc_id, "item_id", "text", BLOCK).select(F.coalesce("doc_id", F.lit(LEAST_ID)).alias("_bi"), F.col("_key").alias("_bk"))
    bad = few(written(bad.distinct(), "contaminated"))
    rows = docs.select(packed(docs), F.coalesce(id_of(docs, doc_id), F.lit(LEAST_ID)).alias("_id"), F.xxhash64(text_of(docs, text)).alias("_key"))
    return rows.join(bad, (F.col("_id") == F.col("_bi")) & (F.col("_key") == F.col("_bk")), "left_anti").select("_row.*")


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contained_items(docs, benchmark)


def _sql() -> str:
    from scrivener.llm.common import sql_lower

    words = lambda t: f"regexp_extract_all({sql_lower(f"coalesce({t}, '')")}, '[^\\x20\\x09-\\x0D]+')"
    gram = lambda w: f"array_to_string({w}[i : i + n - 1], ' ')"
    return f"""
WITH b AS (SELECT row_number() OVER () AS q, item_id, {words('text')} AS ws FROM benchmark),
bn AS (SELECT q, item_id, ws, least({SHINGLE}, len(ws)) AS n FROM b WHERE len(ws) > 0),
bg AS (SELECT DISTINCT q, item_id, n, {gram('ws')} AS g FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS i FROM bn)),
bs AS (SELECT q, count(*) AS total FROM bg GROUP BY q),
d AS (SELECT row_number() OVER () AS r, doc_id, {words('text')} AS ws FROM documents),
dn AS (SELECT r, doc_id, ws, n FROM d, (SELECT DISTINCT n FROM bn) WHERE len(ws) >= n),
dg AS (SELECT DISTINCT r, doc_id, n, {gram('ws')} AS g FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS i FROM dn)),
hit AS (SELECT r, doc_id, q, item_id, count(*) AS found FROM dg JOIN bg USING (n, g) GROUP BY ALL)
SELECT doc_id, item_id, CAST(total AS BIGINT) AS n_shingles, CAST(found AS BIGINT) AS n_found
FROM hit JOIN bs USING (q) WHERE found * 10 >= total * 8
"""


ORACLE = _sql()
