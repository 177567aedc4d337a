"""Edit-aware token counts: a segment tree of pre-token runs for each document.

A space between two non-space characters always begins a pre-token, so a text can be cut there and its parts counted
apart. Leaves are parts of about LEAF characters; inner nodes sum characters and tokens. An edit descends to the
leaves it touches, re-encodes the text from the last such space that the edit leaves alone to the next one after it
(boundary context), and updates the sums above; leaves that an edit joins are merged into the first.

Edits are (start, stop, text) in code points of the text they apply to; the edits of a document apply in array order.
Defined results: null text counts as empty; a null array or null edit is no edit; places beyond the text are moved to
its end, a stop before its start to the start, null text of an edit deletes; repeated rows give repeated results;
null ids pass through; an empty table gives an empty table; other columns don't matter.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivener.llm import bpe
from scrivener.llm.common import id_of, text_of

LEAF = 2000
_CUT = re.compile(r"(?<=\S) (?=\S)")
EDITS = "array<struct<start:int,stop:int,text:string>>"


class TokenTree:
    def __init__(self, text: str, count, leaf: int = LEAF):
        self.count = count
        self.leaves, at = [], 0
        while at < len(text) or not self.leaves:
            m = _CUT.search(text, at + leaf) if at + leaf < len(text) else None
            end = m.start() if m else len(text)
            self.leaves.append(text[at:end])
            at = end
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.leaves += [""] * (self.size - len(self.leaves))
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, x in enumerate(self.leaves):
            self.chars[self.size + i], self.tokens[self.size + i] = len(x), count(x) if x else 0
        for i in range(self.size - 1, 0, -1):
            self._sum(i)
        self.encoded = 0

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds character `at`, and its first character's place."""
        i, before = 1, 0
        while i < self.size:
            i *= 2
            if at >= before + self.chars[i]:
                before += self.chars[i]
                i += 1
        return i - self.size, before

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf] = text
        i = self.size + leaf
        self.chars[i], self.tokens[i] = len(text), tokens
        while i > 1:
            i //= 2
            self._sum(i)

    def edit(self, start: int, stop: int, text: str) -> None:
        n = self.chars[1]
        start = min(max(start, 0), n)
        stop = min(max(stop, start), n)
        if not n:
            self._set(0, text, self.count(text) if text else 0)
            self.encoded += len(text)
            return
        first, before = self._leaf(min(max(start - 2, 0), n - 1))
        last, _ = self._leaf(min(stop, n - 1))
        old = "".join(self.leaves[first : last + 1])
        tokens = sum(self.tokens[self.size + i] for i in range(first, last + 1))
        a, b = start - before, stop - before
        new = old[:a] + text + old[b:]
        # a cut needs the characters on both sides of its space
        left = a - 1
        while left > 0:
            left = old.rfind(" ", 0, left)
            if left < 1:
                left = 0
                break
            if _CUT.match(old, left):
                break
        left = max(left, 0)
        m = _CUT.search(old, b + 1)
        right = m.start() if m else len(old)
        shift = len(new) - len(old)
        tokens += self.count(new[left : right + shift]) - self.count(old[left:right])
        self.encoded += right + shift - left
        for i in range(first + 1, last + 1):
            self._set(i, "", 0)
        self._set(first, new, tokens)

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(self.leaves)


def _counted(path: str):
    def run(batches):
        enc = bpe.encoder(path)
        count = lambda s: len(enc.encode(s)) // 4
        for b in batches:
            out: list[list[int]] = [[] for _ in range(5)]
            for t, edits in zip(b.column(1), b.column(2), strict=True):
                tree = TokenTree(t.as_py(), count)
                before, done = tree.total, 0
                for e in edits.as_py() or []:
                    if e is not None:
                        start = e["start"] or 0
                        tree.edit(start, start if e["stop"] is None else e["stop"], e["text"] or "")
                        done += 1
                for c, x in zip(out, (before, tree.total, tree.chars[1], done, tree.encoded), strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in out)], ["doc_id", "n_tokens_before", "n_tokens", "n_chars", "n_edits", "n_chars_encoded_again"])

    return run


def edited_counts(docs: DataFrame, edits: str = "edits", path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens_before, n_tokens, n_chars, n_edits, n_chars_encoded_again."""
    rows = docs.select(id_of(docs, doc_id).alias("doc_id"), text_of(docs, text).alias("t"), F.col(edits).cast(EDITS).alias("e"))
    return rows.mapInArrow(_counted(path or bpe.default_path()), "doc_id bigint, n_tokens_before bigint, n_tokens bigint, n_chars bigint, n_edits bigint, n_chars_encoded_again bigint")


def curation_edits(docs: DataFrame) -> DataFrame:
    """documents with edits: a language mark in front, the middle character replaced by a mark, the source at the end."""
    n = F.length(text_of(docs)).cast("int")
    front = F.concat(F.lit("["), F.coalesce("lang", F.lit("")), F.lit("] "))
    middle = (F.length(front) + F.floor(n / 2)).cast("int")
    edit = lambda a, b, t: F.struct(a.cast("int").alias("start"), b.cast("int").alias("stop"), t.alias("text"))
    far = F.lit(2**31 - 1)
    return docs.withColumn("edits", F.array(edit(F.lit(0), F.lit(0), front), edit(middle, middle + 1, F.lit(" <cut> ")), edit(far, far, F.concat(F.lit("\nsource: "), F.coalesce("source", F.lit(""))))))


def query(docs: DataFrame) -> DataFrame:
    return edited_counts(curation_edits(docs.select("doc_id", "text", "lang", "source")))
