"""Phrase conversion: the pattern of all phrases against a plain search for the longest entry."""

import cProfile
import random

from scrivener.operators import convert as C

LETTERS = "一二三四五六七八九十的了在是有人这中大为"


def plainly(table, text):
    out, i = [], 0
    while i < len(text):
        n = next((n for n in range(max(map(len, table), default=1), 0, -1) if i + n <= len(text) and text[i : i + n] in table), 0)
        out.append(table[text[i : i + n]] if n else text[i])
        i += n or 1
    return "".join(out)


def test_longest_entry_at_each_place():
    rng, by_pattern = random.Random(4), 0
    for size in [3, 8, 15, 80] * 150:
        al = LETTERS[: rng.randint(3, 20)] + rng.choice(["", "]^-\\[", "a.*|é😀"])
        table = {"".join(rng.choice(al) for _ in range(rng.randint(1, 5))): "".join(rng.choice("xyz") for _ in range(rng.randint(0, 3))) for _ in range(size)}
        made = C.Round(table)
        by_pattern += made.cut is not None
        for _ in range(8):
            text = "".join(rng.choice(al + "\n Z") for _ in range(rng.randint(0, 40)))
            assert made(text) == plainly(table, text), (table, text)
    assert 100 < by_pattern < 600


def test_regular_phrases_take_no_steps_in_python():
    table = {a + b + c: "x" for a in LETTERS for b in LETTERS for c in ["", *LETTERS]} | {"一": "y"}
    rng = random.Random(5)
    text = "".join(rng.choice(LETTERS + "天地\n") for _ in range(20_000))
    made, said = C.Round(table), cProfile.Profile()
    assert said.runcall(made, text) == plainly(table, text)
    assert sum(e.callcount for e in said.getstats()) < 100
    assert C.Round({chr(0x4E00 + i) + "一" * (i % 30 + 1): "x" for i in range(3000)}).cut is None
