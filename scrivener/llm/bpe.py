"""Byte-level BPE over a public vocabulary file (tokenizers' JSON), with a cache of space-led pieces of text.

A space between two non-space characters always begins a pre-token, so a text without two white-space characters in
a row falls into pieces at its spaces that can be encoded apart. Other texts are encoded whole. Strings of special
tokens become their ids, as the tokenizers library does by default.
"""

from __future__ import annotations

import json
import re
import sys
from array import array

#: Pieces that a worker remembers.
CACHE = 400_000
_RUN = re.compile(r"\s\s")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _bytes_of_letters() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for the letters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _bytes_of_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self._core = tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._split = re.compile("|".join(f"({re.escape(s)})" for s in self.special)) if self.special else None
        self._cache: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return array("I", self._core.encode_ordinary(text)).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if self.special and any(s in text for s in self.special):
            return b"".join(array("I", [self.special[p]]).tobytes() if p in self.special else self._plain(p) for p in self._split.split(text) if p)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if _RUN.search(text):
            return self._whole(text)
        first, *rest = text.split(" ")
        got = list(map(self._cache.get, rest))
        if None in got:
            if len(self._cache) > CACHE:
                self._cache.clear()
            for i, x in enumerate(got):
                if x is None:
                    got[i] = self._cache.get(rest[i])
                    if got[i] is None:
                        got[i] = self._whole(" " + rest[i])
                        if len(rest[i]) < 40:
                            self._cache[rest[i]] = got[i]
        return self._whole(first) + b"".join(got)


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    held = sys.__dict__.setdefault("_scrivener_encoders", {})
    if path not in held:
        held[path] = Encoder(path)
    return held[path]
