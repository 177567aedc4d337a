"""Best-fit packing planned on the histogram of lengths.

Texts become ids (byte-level BPE, then id END); longer ones are cut into pieces of SIZE ids whose first may be shorter.
Only the number of pieces of each length (SIZE numbers at most) comes to the driver, where best fit runs over counts:
lengths from long to short, each into the fullest kind of bin that has room, many equal bins at a time. The plan is a
list of slot ranges for each length. Pieces are numbered within their length, in buckets so that no length meets in
one task, and take the slot of their number.

Defined results: null text counts as empty (a piece of the one id END); null ids pass through; repeated rows are
packed each; an empty table gives an empty table; other columns don't matter.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrivener.llm import bpe
from scrivener.llm.common import id_of, text_of, written

SIZE, END = 1024, 2
#: Pieces in a numbering bucket, roughly.
BUCKET = 20_000


def cut(total: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of `total` ids."""
    first = total if total <= size else total % size or size
    return [(0, first)] + [(s, size) for s in range(first, total, size)]


def _pieces(path: str, size: int):
    end = END.to_bytes(4, "little")

    def run(batches):
        enc = bpe.encoder(path)
        for b in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for r, t in enumerate(b.column(1)):
                ids = memoryview(enc.encode(t.as_py()) + end)
                for p, (s, n) in enumerate(cut(len(ids) // 4, size)):
                    rows.append(r)
                    piece.append(p)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(ids[4 * s : 4 * (s + n)]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, size: int = SIZE, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(id_of(docs, doc_id).alias("doc_id"), text_of(docs, text).alias("t")).mapInArrow(_pieces(path or bpe.default_path(), size), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Best fit over counts. Slot ranges (length, first number, per bin, first sequence, offset), by length and number.

    Number r of a range of m per bin lies in sequence first + (r - r0) // m, at offset + (r - r0) % m * length.
    """
    room: dict[int, list[list]] = {}  # by free space: kinds of bins [how many, ((length, per bin), ...)]
    spaces: list[int] = []

    def put(free: int, n: int, holds: tuple) -> None:
        if n:
            if free not in room:
                room[free] = []
                insort(spaces, free)
            room[free].append([n, holds])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = bisect_left(spaces, length)
            fits = k < len(spaces)
            free = spaces[k] if fits else size
            per = free // length
            full = left // per
            if fits:
                kind = room[free][-1]
                n, holds = kind
                full = min(full, n)
                kind[0] -= full
            else:
                holds = ()
            put(free - per * length, full, (*holds, (length, per)))
            left -= full * per
            if left and left < per and (not fits or kind[0]):
                if fits:
                    kind[0] -= 1
                put(free - left * length, 1, (*holds, (length, left)))
                left = 0
            if fits and not kind[0]:
                room[free].remove(kind)
                if not room[free]:
                    del room[free]
                    spaces.remove(free)
    ranges, sequence, number = [], 0, dict.fromkeys(counts, 0)
    for kinds in room.values():
        for n, holds in kinds:
            at = 0
            for length, per in holds:
                ranges.append((length, number[length], per, sequence, at))
                number[length] += n * per
                at += length * per
            sequence += n
    return sorted(ranges)


def _placed(ranges: list[tuple[int, int, int, int, int]]):
    # one sorted key for (length, number): length above 52 bits of number
    table = np.array(ranges, np.int64).reshape(-1, 5)
    keys = (table[:, 0] << 52) | table[:, 1]

    def run(batches):
        for b in batches:
            length, number = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            row = table[np.searchsorted(keys, (length << 52) | number, "right") - 1]
            k = number - row[:, 1]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(row[:, 3] + k // row[:, 2]), pa.array(row[:, 4] + k % row[:, 2] * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def numbered(rows: DataFrame, by: str, buckets: int, order: list[str], name: str = "number") -> DataFrame:
    """Numbers from 0 within each value of `by`, in two levels: buckets' counts, then places in a bucket."""
    b = rows.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = b.groupBy(by, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(by, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    placed = b.withColumn("_i", F.row_number().over(Window.partitionBy(by, "_b").orderBy(*order)) - 1)
    return placed.join(starts, [by, "_b"]).withColumn(name, F.col("_s") + F.col("_i")).drop("_b", "_s", "_i")


def best_fit(docs: DataFrame, size: int = SIZE, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece."""
    cutted = written(pieces(docs, size, path, doc_id, text), "pieces")
    counts = {r["length"]: r["n"] for r in cutted.groupBy("length").agg(F.count("*").alias("n")).toLocalIterator()}
    ranges = plan(counts, size)
    rows = numbered(cutted, "length", max(1, sum(counts.values()) // BUCKET), ["doc_id", "piece", "start", "ids_crc32"])
    cols = ("doc_id", "piece", "start", "length", "ids_crc32")
    return rows.select(*cols, "number").mapInArrow(_placed(ranges), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def query(docs: DataFrame) -> DataFrame:
    return best_fit(docs)
