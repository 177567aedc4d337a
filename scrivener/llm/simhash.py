"""SimHash near-dedup by a binary-trie self-join.

A fingerprint's bit is 1 if it is set in over half of the XXH64 values (seed 42) of a text's 3-word shingles.
Distinct fingerprints are put under tries by an equal block of bits: of three blocks at least one agrees within two
differing bits. A trie is traversed against itself, node pair by node pair; the differing bits of a pair's prefixes
add up and a pair over the error budget is left. A block that over GROUP fingerprints share is divided again by three
blocks of its remaining bits, which loses no pair for the same reason and ends where too few bits remain for more.
Rows of a frequent fingerprint (all texts without words have one) are split where components meet the documents.
Each trie gives a spanning forest of its links, so the output follows the number of fingerprints, not of pairs.

Wide fingerprints (`wide_links`) serve budgets that 64 bits can't tell from chance: WIDE words of 64 bits, tries under
equal blocks of the bits, traversed pairwise over two words of 128 bits with a budget of WITHIN bits. No block has to agree
within such a budget, so there are as many tries as keep the chance to miss a pair whose bits differ with chance APART
at MISS; a block's length follows the number of fingerprints, so that PER of them share a trie on average.

Defined results: null text counts as empty; a text without words has fingerprint zero; a null id sorts after all
others, and is a component's id only where nothing else is in it; repeated rows give repeated results; an empty table
gives an empty table; other columns don't matter.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivener.llm.common import dealt, hot_keys, id_of, packed, text_of, written
from scrivener.llm.components import components
from scrivener.llm.hashing import mix

SHINGLE, SEED, BUDGET = 3, 42, 2
#: Fingerprints of one trie; larger groups are divided.
GROUP = 2000
MOST_ID = 2**63 - 1
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Words of a wide fingerprint. The bits that may differ in the first word that a trie compares, and in both.
WIDE, FIRST, WITHIN = 16, 18, 28
#: Sets of a Jaccard similarity of 0.8 differ in a bit with chance 0.15, small ones with up to APART (four shingles against five).
APART, MISS = 0.1875, 1e-6
#: Wide fingerprints of a trie, on average; tries whose rows are dealt at once.
PER, ROUND = 1000, 40
_FACTORS = np.random.default_rng(10).integers(0, 2**63, WIDE, np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(text: bytes) -> int:
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    n = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    for a in range(0, n, 50_000):
        part = words[a : a + 50_000 + SHINGLE - 1]
        grams = zip(*(part[k:] for k in range(SHINGLE)), strict=False) if len(part) >= SHINGLE else [part]
        v = np.array([h(b" ".join(g), SEED) for g in grams], np.uint64)
        ones += np.unpackbits(v.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches):
    for b in batches:
        texts = b.column(1).cast(pa.binary())
        out = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out.view(np.int64))], ["_id", "_key", "fp"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, _key, fp), a row for each row of docs; _key is a hash of the text."""
    t = text_of(docs, text)
    return docs.select(F.coalesce(id_of(docs, doc_id), F.lit(MOST_ID)).alias("_id"), t.alias("t"), F.xxhash64(t).alias("_key")).mapInArrow(_fingerprints, "_id bigint, _key bigint, fp bigint")


def meetings(left: np.ndarray, right: np.ndarray | None = None, budget: int = BUDGET, leaf: int = 1024):
    """Index arrays (i, j) of the sorted uint64 values that differ in at most `budget` bits; of one array's pairs i < j."""
    alone = right is None
    right = left if alone else right
    todo = [(0, len(left), 0, len(right), 63, 0)]
    while todo:
        a, b, c, d, bit, spent = todo.pop()
        if a == b or c == d:
            continue
        same = alone and (a, b) == (c, d)
        if (b - a) * (d - c) <= leaf:
            i, j = np.nonzero(np.bitwise_count(left[a:b, None] ^ right[None, c:d]) <= budget)
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i + a, j + c
            continue
        if bit < 0:
            # equal values: nothing is left to tell them apart
            p, q = (a + b) // 2, (c + d) // 2
            todo += [(a, p, c, q, bit, spent), (a, p, q, d, bit, spent), (p, b, q, d, bit, spent)]
            if not same:
                todo.append((p, b, c, q, bit, spent))
            continue
        one = np.uint64(1) << np.uint64(bit)
        # values of a node agree above this bit, so a search for the bit splits it
        p = a + int(np.searchsorted((left[a:b] & one) > 0, True))
        q = c + int(np.searchsorted((right[c:d] & one) > 0, True))
        todo += [(a, p, c, q, bit - 1, spent), (p, b, q, d, bit - 1, spent)]
        if spent < budget:
            todo.append((a, p, q, d, bit - 1, spent + 1))
            if not same:
                todo.append((p, b, c, q, bit - 1, spent + 1))


def trie_pairs(values: np.ndarray, budget: int = BUDGET):
    """Index pairs of the sorted distinct uint64 values that differ in at most `budget` bits."""
    for i, j in meetings(values, budget=budget):
        yield from zip(i.tolist(), j.tolist(), strict=True)


def forest(values: np.ndarray) -> list[tuple[int, int]]:
    """Links (value, root) that join what trie_pairs joins."""
    up = list(range(len(values)))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in trie_pairs(values):
        a, b = find(i), find(j)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [(i, find(i)) for i in range(len(values)) if find(i) != i]


def _forests(batches):
    for b in batches:
        u, v = [], []
        for group in b.column(0):
            fps = np.unique(np.array(group.as_py(), np.int64).view(np.uint64))
            signed = fps.view(np.int64)
            for i, r in forest(fps):
                u.append(int(signed[i]))
                v.append(int(signed[r]))
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _thirds(bits: list[int]) -> list[list[int]]:
    n = len(bits)
    return [bits[: n // 3], bits[n // 3 : 2 * n // 3], bits[2 * n // 3 :]]


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def links(distinct: DataFrame, group: int = GROUP) -> DataFrame:
    """(u, v): links that join all fingerprints within the budget; distinct has one column fp."""
    found = None
    # a part: bits that agree within its groups, and those that are left
    parts = [([], list(range(64)))]
    rows, hot = distinct.select(F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("key"), "fp"), None
    while parts:
        deeper = [(agreed + third, [b for b in rest if b not in third]) for agreed, rest in parts for third in _thirds(rest)]
        source = rows if hot is None else rows.join(hot, ["part", "key"], "left_semi")
        masks = F.array(*(F.lit(_mask(agreed)) for agreed, _ in deeper))
        each = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.struct((F.col("part") * 3 + k).alias("part"), F.get(masks, F.col("part") * 3 + k).bitwiseAND(F.col("fp")).alias("key")))
        rows = source.select("fp", F.explode(each).alias("x")).select("x.part", "x.key", "fp")
        sizes = written(rows.groupBy("part", "key").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
        small = rows.join(sizes.filter(F.col("n") <= group), ["part", "key"], "left_semi")
        tries = small.groupBy("part", "key").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(_forests, "u bigint, v bigint")
        found = tries if found is None else found.union(tries)
        hot = sizes.filter(F.col("n") > group).select("part", "key")
        # a group holds at most 2^(bits left) fingerprints, so the division ends
        parts = deeper if not hot.isEmpty() else []
    return found


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """WIDE words: a bit is 1 if it is set in over half of the shingles' 64-bit hashes, mixed anew for each word."""
    ones = np.zeros(64 * WIDE, np.int64)
    for a in range(0, len(hashes), 255):
        v = mix(hashes[a : a + 255, None] * _FACTORS)
        # at most 255 ones, so a byte holds their sum
        ones += np.unpackbits(v.view(np.uint8).reshape(len(v), -1), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def block_width(n: int) -> int:
    """Bits of a block, for n fingerprints."""
    return min(20, max(2, round(math.log2(max(n, 1) / PER))))


def tries_for(width: int) -> int:
    """Tries under blocks of `width` bits that miss a pair whose bits differ with chance APART with chance MISS."""
    chance = [math.comb(64, k) * APART**k * (1 - APART) ** (64 - k) for k in range(WITHIN + 1)]
    within = sum(chance[k] * sum(chance[: WITHIN + 1 - k]) for k in range(FIRST + 1))
    return math.ceil(math.log(MISS) / math.log1p(-within * (1 - APART) ** width))


def _block(trie: int, width: int) -> np.ndarray:
    """The bits of a trie's block: equal blocks of a layout of all bits, then of another."""
    layout, place = divmod(trie, 64 * WIDE // width)
    return np.random.default_rng(layout).permutation(64 * WIDE)[place * width : (place + 1) * width]


def _trie_rows(tries: range, width: int):
    blocks, numbers = np.array([_block(t, width) for t in tries]), np.array(tries)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                words = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint64).reshape(-1, WIDE)
                bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
                keys = (numbers << width) + bits[:, blocks] @ (1 << np.arange(width))
                nodes = np.repeat(part.column(0).to_numpy(zero_copy_only=False), len(numbers))
                x, y = (words[:, (2 * numbers + k) % WIDE].view(np.int64) for k in range(2))
                yield pa.RecordBatch.from_arrays([pa.array(c.ravel()) for c in (keys, nodes, x, y)], ["key", "node", "x", "y"])

    return run


def _join(up: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the classes of i and j; up holds the root of each."""
    while len(i):
        a, b = up[i], up[j]
        i, j = i[a != b], j[a != b]
        a, b = up[i], up[j]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up != (above := up[up])).any():
            up[:] = above


def wide_forest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The root of each fingerprint's class, by the two words that are compared."""
    up, classes = np.arange(len(x)), []
    near = lambda i, j: np.bitwise_count(x[i] ^ x[j]) + np.bitwise_count(y[i] ^ y[j]) <= WITHIN
    rest = np.argsort(x, kind="stable")
    if len(x) > GROUP:
        # what is near one of a few fingerprints is joined by it, and not compared within
        for k in range(8):
            if not len(rest):
                break
            first = rest[k * len(rest) // 8]
            own = near(first, rest)
            if own.sum() * 16 > len(x):
                _join(up, rest[own], np.full(own.sum(), first))
                classes.append(rest[own])
                rest = rest[~own]
    sides = [(rest, None), *((c, rest) for c in classes), *((c, d) for k, c in enumerate(classes) for d in classes[:k])]
    for left, right in sides:
        for i, j in meetings(x[left], None if right is None else x[right], FIRST, 1 << 16):
            i, j = left[i], (left if right is None else right)[j]
            apart = up[i] != up[j]
            i, j = i[apart], j[apart]
            close = near(i, j)
            _join(up, i[close], j[close])
    return up


def _wide_forests(batches):
    """Batches sorted by key; a trie may go on in the next batch."""
    held = None
    for b in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        held = now if held is None else [np.concatenate(c) for c in zip(held, now, strict=True)]
        ends = np.flatnonzero(np.diff(held[0])) + 1
        yield _trie_links(held, [0, *ends])
        held = [c[ends[-1] :] if len(ends) else c for c in held]
    if held is not None:
        yield _trie_links(held, [0, len(held[0])])


def _trie_links(columns: list[np.ndarray], edges: list[int]) -> pa.RecordBatch:
    u, v = [], []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        nodes = columns[1][a:b]
        up = wide_forest(columns[2][a:b].view(np.uint64), columns[3][a:b].view(np.uint64))
        joined = np.flatnonzero(up != np.arange(b - a))
        u.append(nodes[joined])
        v.append(nodes[up[joined]])
    none = np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *c])) for c in (u, v)], ["u", "v"])


def wide_links(prints: DataFrame, width: int | None = None) -> DataFrame:
    """(u, v): links that join the nodes whose wide fingerprints are near; prints has node and fp, a binary of WIDE words."""
    width = width or block_width(prints.count())
    n, found = tries_for(width), []
    for a in range(0, n, ROUND):
        rows = prints.select("node", "fp").mapInArrow(_trie_rows(range(a, min(n, a + ROUND)), width), "key bigint, node bigint, x bigint, y bigint")
        found.append(written(rows.repartition("key").sortWithinPartitions("key").mapInArrow(_wide_forests, "u bigint, v bigint"), "tries"))
    return reduce(DataFrame.union, found).distinct()


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, _key, fp, label, component): a row for each row of docs; component is the least id that links reach."""
    fps = written(fingerprints(docs, doc_id, text), "fingerprints")
    first = written(fps.groupBy("fp").agg(F.min("_id").alias("id"), F.count("*").alias("n")), "distinct")
    labels = components(links(first.select("fp")))
    joined = first.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "id", F.coalesce("label", "fp").alias("label"))
    least = joined.groupBy("label").agg(F.min("id").alias("component"))
    per = joined.join(least, "label").select("fp", "label", "component")
    hot = hot_keys(first, "fp")
    return dealt(fps, hot, "fp", F.xxhash64("_id", "_key")).join(dealt(per, hot, "fp"), ["fp", "salt"]).select("_id", "_key", "fp", "label", "component")


def _real(c: str):
    return F.when(F.col(c) != F.lit(MOST_ID), F.col(c))


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the near copies: of each group the row of least (id, text hash) stays, once where it is repeated."""
    first = near_groups(docs, doc_id, text).groupBy("label").agg(F.min(F.struct("_id", "_key")).alias("f")).select(F.col("f._id").alias("_fi"), F.col("f._key").alias("_fk"))
    rows = docs.select(packed(docs), F.coalesce(id_of(docs, doc_id), F.lit(MOST_ID)).alias("_id"), F.xxhash64(text_of(docs, text)).alias("_key"))
    kept = rows.join(first, (F.col("_id") == F.col("_fi")) & (F.col("_key") == F.col("_fk")), "left_semi")
    return kept.groupBy("_id", "_key").agg(F.first("_row").alias("_row")).select("_row.*")


def query(docs: DataFrame) -> DataFrame:
    return near_groups(docs).select(_real("_id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), _real("component").alias("component_id"))
