"""Exact substring dedup: names of positions that stand for ever longer strings, in rounds.

A byte goes if a string of LENGTH bytes that covers it also starts earlier (smaller id, or same document and earlier
start). This has the frame of prefix doubling over a suffix array: names of short strings first, then of longer ones, each
round over the positions that the one before left; a position leaves as soon as its name is unique or its string has
LENGTH bytes. It is not the literal form of it: positions are thinned first, names are hashes in place of sorted ranks,
and there are three rounds in place of one for each doubling. (Ranks need a row for each byte of text in every round; the
README says what that costs.) In no round are all positions shuffled:

1. Names of HEAD bytes. Of every LENGTH - HEAD + 1 positions in a row the one with the least name stands for all
   (equal strings of LENGTH bytes choose the same one, so nothing is lost). Names found once leave.
2. Names of the string from the first start that a position stands for to LENGTH bytes past the last. All starts of a
   later place of the same name are repeats at once, and leave. First places leave if no other name shares their HEAD.
3. The starts that remain, each with the name of its LENGTH bytes: repeats are those after the first of a name.

Names of the first round only say which positions may leave: a clash keeps one more. Those of the second decide with 64
bits among the places of one head (128 with it), those of the third with 96 bits of two polynomial hashes. Counts and
first places are aggregated before the shuffle and can spill; joins are of (name, place) rows that Spark can split, so a string that a third of all
documents hold makes one row a place and no pairs.

Defined results: null text counts as empty; a null id sorts first; rows that agree in id and text are one document
stated twice and get the same result; texts under LENGTH bytes keep everything; an empty table gives an empty table;
other columns don't matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivener.llm.common import Written, keyed, real_id
from scrivener.llm.hashing import OTHER_BASE, Hashed, Powers, mix

LENGTH, HEAD = 100, 51
#: Rows that a kernel holds before it passes them on.
ROWS = 100_000
ANCHOR = "head bigint, name bigint, _id bigint, _key bigint, lo int, more smallint"


def check_of(text: bytes, powers: Powers, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """32 further bits of names."""
    return (Hashed(text, powers).at(start, end) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def anchors(hashed: Hashed, length: int, head: int) -> tuple[np.ndarray, ...]:
    """(head's name, name, first start, further starts) of the positions that stand for the starts of a text."""
    h, w = hashed.every(head), length - head + 1
    bits = np.uint64(max(1, len(h).bit_length()))
    least = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= w:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < w:
        least = np.minimum(least[: len(least) - (w - width)], least[w - width :])
    at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    lo = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    hi = np.concatenate([lo[1:], [len(at)]]) - 1
    name = mix(hashed.at(lo, hi + length) + (at[lo] - lo).astype(np.uint64))
    return h[at[lo]], name, lo, hi - lo


def _long(b, length: int):
    for i, k, t in zip(*(b.column(j) for j in range(3)), strict=True):
        t = t.as_py()
        if len(t) >= length:
            yield i.as_py(), k.as_py(), t


def _heads(length: int, head: int):
    """Names of HEAD bytes, each at most twice a batch."""

    def run(batches):
        powers = Powers()
        for b in batches:
            names = [np.zeros(0, np.uint64), *(anchors(Hashed(t, powers), length, head)[0] for _, _, t in _long(b, length))]
            v, n = np.unique(np.concatenate(names), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([v, v[n > 1]]).view(np.int64))], ["head"])

    return run


def _anchors(length: int, head: int):
    names = ["head", "name", "_id", "_key", "lo", "more"]

    def run(batches):
        powers = Powers()
        for b in batches:
            cols, held = [[] for _ in names], 0
            for i, k, t in _long(b, length):
                h, name, lo, more = anchors(Hashed(t, powers), length, head)
                for c, x in zip(cols, (h.view(np.int64), name.view(np.int64), np.full(len(lo), i), np.full(len(lo), k), lo.astype(np.int32), more.astype(np.int16)), strict=True):
                    c.append(x)
                held += len(lo)
                if held >= ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names)
                    cols, held = [[] for _ in names], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names)

    return run


def _zipped(batches):
    """Texts compressed for the shuffle."""
    z = zstandard.ZstdCompressor(level=1)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([z.compress(t.as_py()) for t in b.column(2)], pa.binary())], ["_id", "_key", "z"])


def _unzip(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z) if z else b""


def _starts(length: int):
    """Names of LENGTH bytes for the starts of the ranges (lo, more) of a document."""
    names = ["name", "check", "_id", "_key", "lo"]

    def run(batches):
        powers, other = Powers(), Powers(OTHER_BASE)
        for b in batches:
            cols, held = [[] for _ in names], 0
            for i, k, z, ranges in zip(*(b.column(j) for j in range(4)), strict=True):
                t = _unzip(z.as_py())
                lo, more = (ranges.values.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in (0, 1))
                p = np.repeat(lo - np.concatenate([[0], np.cumsum(more + 1)[:-1]]), more + 1) + np.arange((more + 1).sum())
                g = Hashed(t, powers).at(p, p + length)
                for c, x in zip(cols, (g.view(np.int64), check_of(t, other, p, p + length), np.full(len(p), i.as_py()), np.full(len(p), k.as_py()), p.astype(np.int32)), strict=True):
                    c.append(x)
                held += len(p)
                if held >= ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names)
                    cols, held = [[] for _ in names], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names)

    return run


def _cut(length: int):
    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in range(4)]
            kept_texts = []
            for z, ranges in zip(b.column(1), b.column(2), strict=True):
                t = _unzip(z.as_py())
                kept, gone, spans = t, 0, 0
                if ranges.is_valid:
                    lo, more = (ranges.values.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in (0, 1))
                    edge = np.zeros(len(t) + 1, np.int64)
                    np.add.at(edge, lo, 1)
                    np.add.at(edge, lo + more + length, -1)
                    out_of = np.cumsum(edge[:-1]) > 0
                    gone = int(out_of.sum())
                    spans = int((np.diff(np.concatenate([[0], out_of.astype(np.int8)])) == 1).sum())
                    kept = np.frombuffer(t, np.uint8)[~out_of].tobytes()
                for c, x in zip(out, (len(t), gone, spans, hashlib.sha256(kept).hexdigest()), strict=True):
                    c.append(x)
                kept_texts.append(kept)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string()), pa.array(kept_texts, pa.binary())], ["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def repeats(docs: DataFrame, length: int = LENGTH, head: int = HEAD) -> DataFrame:
    """(_id, _key, ranges): starts (lo, further ones) of strings of `length` bytes that also start earlier; docs has _id, _key, _text (binary)."""
    place = F.struct("_id", "_key", "lo")
    heads = docs.mapInArrow(_heads(length, head), "head bigint").groupBy("head").agg(F.count("*").alias("n")).filter("n > 1").select("head")
    often = Written(heads, "heads")
    live = Written(docs.mapInArrow(_anchors(length, head), ANCHOR).join(often.df.hint("shuffle_hash"), "head"), "anchors")
    often.drop()
    first = Written(live.df.groupBy("head", "name").agg(F.min(F.struct("_id", "_key", "lo", "more")).alias("f"), F.count("*").alias("n")), "segments")
    again = first.df.filter("n > 1").select("head", "name", "f")
    later = live.df.join(again, ["head", "name"]).filter(place > F.struct("f._id", "f._key", "f.lo"))
    whole = Written(later.select("_id", "_key", "lo", F.col("more").cast("int").alias("more")), "later")
    live.drop()
    shared = first.df.groupBy("head").agg(F.count("*").alias("k")).filter("k > 1").select("head")
    open_ = first.df.join(shared, "head").select("f.*").groupBy("_id", "_key").agg(F.collect_list(F.struct(F.col("lo"), F.col("more").cast("int").alias("more"))).alias("ranges"))
    open_ = Written(open_, "open")
    first.drop()
    texts = docs.mapInArrow(_zipped, "_id bigint, _key bigint, z binary")
    starts = Written(texts.join(open_.df, ["_id", "_key"]).select("_id", "_key", "z", "ranges").mapInArrow(_starts(length), "name bigint, check int, _id bigint, _key bigint, lo int"), "starts")
    open_.drop()
    firsts = Written(starts.df.groupBy("name", "check").agg(F.min(place).alias("f"), F.count("*").alias("n")).filter("n > 1").select("name", "check", "f"), "firsts")
    single = starts.df.join(firsts.df, ["name", "check"]).filter(place > F.col("f")).select("_id", "_key", "lo", F.lit(0).alias("more"))
    found = whole.df.union(single).groupBy("_id", "_key").agg(F.collect_list(F.struct("lo", "more")).alias("ranges"))
    done = Written(found, "repeats")
    whole.drop()
    starts.drop()
    firsts.drop()
    return done.df


def without_repeats(docs: DataFrame, length: int = LENGTH, head: int = HEAD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes): a row for each row of docs."""
    i, k, t = keyed(docs, doc_id, text)
    # a place is (_id, _key, start); where ids are unique the key says nothing, and a constant shuffles at no cost
    unique = docs.select(i).groupBy("_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    own = docs.select(i, F.lit(0).cast("bigint").alias("_key") if unique else k, t.cast("binary").alias("_text"))
    ranges = repeats(own, length, head)
    joined = own.mapInArrow(_zipped, "_id bigint, _key bigint, z binary").join(ranges, ["_id", "_key"], "left").select("_id", "z", "ranges")
    return joined.mapInArrow(_cut(length), "_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def query(docs: DataFrame) -> DataFrame:
    return without_repeats(docs).select(real_id().alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
