"""Near-copy dedup: texts whose sets of 5-word shingles have a Jaccard similarity of SIMILARITY or more are linked.

Rows of equal shingle sets are one node (its number is a 64-bit hash of the set). Nodes get op10's operator on fingerprints
wide enough for that similarity: SimHash bits of the shingle hashes, under tries by equal blocks of the bits, traversed
pairwise (`simhash.wide_links`). What the tries join, directly or by others, is a bucket; a linked pair is in no bucket with
chance 1e-6 at most, for four shingles against five, and less for larger sets (computed up to 59 common shingles). Every pair of a bucket is then decided by its shingle
sets (64-bit hashes of all shingles), unless its nodes are joined already; components of the links are the groups.

A bucket is held whole by one task up to GROUP nodes and WEIGHT shingles. Larger ones are dealt into parts, each with the
bucket's least node; where that leaves several components in a bucket, all pairs of its parts are compared.
Tasks return spanning forests, so the output follows nodes, not pairs. Rows of a frequent node or label are split where they
are joined. Texts aren't shuffled while the documents to be compared, and those to be taken out, are few enough for a broadcast (counted).

Defined results: words are lower-cased (A-Z); a text of fewer than SHINGLE words is one shingle; null text counts as
empty; texts without words are equal; a null id sorts after all others; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivener.llm.common import dealt, few, hot_keys, id_of, packed, text_of, written
from scrivener.llm.components import components
from scrivener.llm.decontam import gram_hashes
from scrivener.llm.hashing import Powers, word_hashes
from scrivener.llm.simhash import wide_fingerprint, wide_links

SHINGLE, SIMILARITY = 5, 0.8
#: Nodes that one task compares at once, and the shingles (8 bytes each) that they may have in all.
GROUP, WEIGHT = 500, 8_000_000
#: Bytes of documents hashed at once; a longer document is handled alone.
CHUNK = 1_000_000
MOST_ID = 2**63 - 1
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_sets(texts: list[bytes], powers: Powers):
    """The sorted distinct shingle hashes of each text."""
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    words, starts = word_hashes(b"\n".join(texts).translate(_LOWER), powers)
    edges, grams = np.searchsorted(starts, offsets), gram_hashes(words, SHINGLE)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield np.unique(grams[a : b - SHINGLE + 1] if b - a >= SHINGLE else gram_hashes(words[a:b], b - a) if b > a else words[:0])


def _chunks(column):
    """(first row, texts) of about CHUNK bytes."""
    at, group, size = 0, [], 0
    for i, t in enumerate(column.cast(pa.binary())):
        t = t.as_py()
        if group and size + len(t) > CHUNK:
            yield at, group
            at, group, size = i, [], 0
        group.append(t)
        size += len(t) + 1
    if group:
        yield at, group


def _sketched(batches):
    powers = Powers()
    for b in batches:
        for at, texts in _chunks(b.column(2)):
            nodes, sizes, prints = [], [], []
            for own in shingle_sets(texts, powers):
                nodes.append(xxhash.xxh64_intdigest(own.tobytes()))
                sizes.append(len(own))
                prints.append(wide_fingerprint(own).tobytes())
            ids = (b.column(k).slice(at, len(texts)) for k in range(2))
            yield pa.RecordBatch.from_arrays([*ids, pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary())], ["_id", "_key", "node", "size", "fp"])


def _sets(batches):
    powers = Powers()
    for b in batches:
        for at, texts in _chunks(b.column(1)):
            own = [x.tobytes() for x in shingle_sets(texts, powers)]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), pa.array(own, pa.binary())], ["node", "own"])


def forest(sets: list[np.ndarray], labels: list[int]) -> list[tuple[int, int]]:
    """Links (i, j) of similar sets that join all such whose labels differ."""
    names: dict[int, int] = {}
    up = list(range(len(sets)))
    for i, label in enumerate(labels):
        up[i] = names.setdefault(label, i)

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    sizes = np.array([len(s) for s in sets])
    flat, starts = np.concatenate([*sets, np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum(sizes)])
    found = []
    for i in range(len(sets) - 1):
        root = find(i)
        apart = np.array([find(j) != root for j in range(i + 1, len(sets))])
        close = 10 * np.minimum(sizes[i + 1 :], sizes[i]) >= 10 * SIMILARITY * np.maximum(sizes[i + 1 :], sizes[i]) - 1e-6
        if not (apart & close).any():
            continue
        rest = flat[starts[i + 1] :]
        at = np.minimum(np.searchsorted(sets[i], rest), sizes[i] - 1)
        hits = np.concatenate([[0], np.cumsum(sets[i][at] == rest)])
        common = np.diff(hits[starts[i + 1 :] - starts[i + 1]])
        similar = 10 * common >= 10 * SIMILARITY * (sizes[i] + sizes[i + 1 :] - common) - 1e-6
        for j in np.flatnonzero(similar & apart) + i + 1:
            a, b = find(i), find(int(j))
            if a != b:
                up[max(a, b)] = min(a, b)
                found.append((i, int(j)))
    return found


def _linked(batches):
    for b in batches:
        u, v = [], []
        for group in b.column(0):
            members = sorted(group.as_py(), key=lambda m: m["node"])
            nodes = [m["node"] for m in members]
            for i, j in forest([np.frombuffer(m["own"], np.uint64) for m in members], [m["label"] for m in members]):
                u.append(nodes[i])
                v.append(nodes[j])
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _links(members: DataFrame, sets: DataFrame, *by: str) -> DataFrame:
    """members: node, label and the columns of a group."""
    held = members.join(sets, "node").groupBy(*by).agg(F.collect_list(F.struct("node", "label", "own")).alias("m"))
    return held.select("m").mapInArrow(_linked, "u bigint, v bigint")


def _keys(docs: DataFrame, doc_id: str, text: str):
    t = text_of(docs, text)
    return F.coalesce(id_of(docs, doc_id), F.lit(MOST_ID)).alias("_id"), F.xxhash64(t).alias("_key"), t.alias("_text")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", group: int = GROUP, weight: int = WEIGHT) -> DataFrame:
    """(_id, _key, label): a row for each row of docs; rows of a label are near copies."""
    own = docs.select(*_keys(docs, doc_id, text))
    rows = written(own.mapInArrow(_sketched, "_id bigint, _key bigint, node bigint, size bigint, fp binary"), "sketches")
    nodes = written(rows.groupBy("node").agg(F.min(F.struct("_id", "_key")).alias("f"), F.count("*").alias("n"), F.first("size").alias("size"), F.first("fp").alias("fp")), "nodes")
    hot = hot_keys(nodes, "node")
    near = components(wide_links(nodes.filter("size > 0")))
    sizes = near.join(nodes.select("node", "size"), "node").groupBy(F.col("label").alias("bucket")).agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    large = sizes.select("bucket", F.ceil(F.greatest(F.col("n") / group, F.col("size") / weight)).cast("int").alias("parts")).filter("parts > 1")
    live = near.join(few(written(large, "large")), F.col("label") == F.col("bucket"), "left").select(F.col("label").alias("bucket"), F.coalesce("parts", F.lit(1)).alias("parts"), "node")
    live = written(live.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")), "members")
    wanted = nodes.join(live.select("node"), "node", "left_semi").select("node", F.col("f._id").alias("_wi"), F.col("f._key").alias("_wk"))
    texts = own.join(few(written(wanted, "wanted")), (F.col("_id") == F.col("_wi")) & (F.col("_key") == F.col("_wk"))).select("node", "_text")
    # repeated rows have equal texts
    sets = written(texts.mapInArrow(_sets, "node bigint, own binary").dropDuplicates(["node"]), "sets")
    centres = live.filter("parts > 1").select("bucket", "part", F.col("bucket").alias("node"))
    members = live.select("bucket", "part", "node").union(centres).distinct().withColumn("label", F.col("node"))
    links = written(_links(members, sets, "bucket", "part"), "links")
    labels = components(links)
    large = live.filter("parts > 1").join(labels.withColumnRenamed("node", "m"), F.col("node") == F.col("m"), "left").select("bucket", "parts", "part", "node", F.coalesce("label", "node").alias("label"))
    torn = written(large.groupBy("bucket").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a < b").select("bucket"), "torn")
    if not torn.isEmpty():
        other = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: k != F.col("part"))
        pairs = large.join(torn, "bucket", "left_semi").select("bucket", "part", "node", "label", F.explode(other).alias("k"))
        pairs = pairs.select("bucket", F.least("part", "k").alias("a"), F.greatest("part", "k").alias("b"), "node", "label")
        labels = components(links.union(_links(pairs, sets, "bucket", "a", "b")))
    found = dealt(rows.select("_id", "_key", "node"), hot, "node", F.xxhash64("_id", "_key")).join(dealt(labels, hot, "node"), ["node", "salt"], "left")
    return found.select("_id", "_key", F.coalesce("label", "node").alias("label"))


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the near copies: of each group the row of least (id, text hash) stays, once where it is repeated."""
    groups = written(near_groups(docs, doc_id, text), "groups")
    # a label of one row has nothing to lose
    first = written(groups.groupBy("label").agg(F.min(F.struct("_id", "_key")).alias("f"), F.count("*").alias("n")).filter("n > 1"), "firsts")
    hot = hot_keys(first, "label")
    places = dealt(groups, hot, "label", F.xxhash64("_id", "_key")).join(few(dealt(first.drop("n"), hot, "label")), ["label", "salt"]).groupBy("_id", "_key").agg(F.first("f").alias("f"), F.count("*").alias("n"))
    gone = F.struct("_id", "_key") != F.col("f")
    changed = written(places.filter(gone | (F.col("n") > 1)).select(F.col("_id").alias("_gi"), F.col("_key").alias("_gk"), gone.alias("gone")), "changed")
    rows = docs.select(packed(docs), *_keys(docs, doc_id, text)[:2])
    same = (F.col("_id") == F.col("_gi")) & (F.col("_key") == F.col("_gk"))
    kept = rows.join(few(changed), same, "left_anti").select("_row.*")
    again = changed.filter("NOT gone")
    if again.isEmpty():
        return kept
    once = rows.join(few(again), same, "left_semi").groupBy("_id", "_key").agg(F.first("_row").alias("_row"))
    return kept.union(once.select("_row.*"))
