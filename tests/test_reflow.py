"""The fold on cases traced by hand, its line rules against the native ones, and properties of whole documents."""

import cProfile
import random
import re

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scrivener.functions import rules
from scrivener.functions.dialect import DUCK, SPARK
from scrivener.operators import reflow as R
from scrivener.plans.folding import segments_sql
from scrivener.plans.queries import cjk_documents


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("第一章 开始\n他走在路上，\n心里很高兴。\n然后", ["第一章 开始", "他走在路上，心里很高兴。", "然后"]),
        ("作者：张三\n正文在这里还没有写完\n\n继续说下去。", ["作者：张三", "正文在这里还没有写完继续说下去。"]),
        ("他说：\n“你好吗？”\n“很好。”", ["他说：", "“你好吗？”", "“很好。”"]),
        ("他走了很远的路才到\n-----\n第二天又走", ["他走了很远的路才到", "-----", "第二天又走"]),
        ("“话还没有说完\n\n现在说完了。”\n新的一段开始了", ["“话还没有说完现在说完了。”", "新的一段开始了"]),
        ("这一段里有（括号还没有\n\n关上）。下一句话。\n尾", ["这一段里有（括号还没有关上）。下一句话。", "尾"]),
        ("=== [Page 1/2] ===\n页面的正文从这里开始，还没有", ["=== [Page 1/2] ===", "页面的正文从这里开始，还没有"]),
        ("第十三章 背负着一切 背负着一切 背负着一切", ["第十三章 背负着一切"]),
    ],
)
def test_fold(text, expected):
    assert [s for _, s in R.fold(text)] == expected


def test_page_header_keeps_blank_lines_hard():
    assert [s for _, s in R.fold("正文在这里还没有写完\n\n继续说下去。", page_header=True)] == ["正文在这里还没有写完", "继续说下去。"]


def test_custom_heading():
    assert [s for _, s in R.fold("天黑下来，没有人\n路上行人都已经回家去了。", heading=re.compile("^天"))] == ["天黑下来，没有人", "路上行人都已经回家去了。"]


def test_overflow_counts_bytes():
    long = "字" * 121
    torn = "（" + long
    assert len(R.fold(torn + "\n" + "完了。\n又一段话")) == 2
    assert len(R.fold("（" + "字" * 100 + "\n完了。\n又一段话")) == 1


ALPHABET = "一第章节作者：:。，,!?.…“”‘’「」（）()[]【】 　\tAb1２-=分十卷前言〞"


def test_python_rules_agree_with_native(spark):
    rng = random.Random(5)
    lines = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    lines += ["第一章分", "第一二三四五六章", "作者：“x”", "书名:红", "（完）", "(test)", "卷一 始", "a" * 17, "A b", "１２ 3", "汉:", "汉字）"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "i int, raw string")
    native = df.select("i", *(F.expr(f(SPARK, "raw")).alias(n) for n, f in (("t", rules.title_heading), ("h", rules.heading_like), ("m", rules.metadata_line), ("s", rules.sentence_boundary), ("b", rules.bracket_boundary), ("c", rules.segment_collapse))))
    for row in native.collect():
        s = lines[row["i"]]
        assert row["t"] == R.title_heading(s), s
        assert row["h"] == R.heading_like(s), s
        assert row["m"] == R.metadata_line(s), s
        assert row["c"] == R.collapse(s), s
        p = R.Paragraph(s)
        assert row["s"] == p.sentence_ended(), s


def test_documents(spark):
    rows = [(1, "第一章 始\n他的话还没有能够说完\n就完了。"), (2, "Plain latin text stays. " * 5), (3, ""), (4, None), (5, " \n ")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    plain = {r["doc_id"]: r["text"] for r in R.reflow(df).collect()}
    tight = {r["doc_id"]: r["text"] for r in R.reflow(df, compact=True).collect()}
    assert plain == {1: "第一章 始\n\n他的话还没有能够说完就完了。", 2: rows[1][1], 3: "", 4: None, 5: " \n "}
    assert tight[1] == plain[1].replace("\n\n", "\n")


def test_segments_hold_every_character():
    rng = random.Random(6)
    for _ in range(300):
        text = "\n".join("".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(12))
        lines = [R._INDENT.sub("", R._TRIM_END.sub("", x)) for x in text.split("\n")]
        kept = [x if R._DIVIDER.match(x.lstrip(" 　")) else R.collapse(x) for x in lines]
        assert "".join(s for _, s in R.fold(text)) == "".join(k for k in kept if R._TRIM.sub("", k))


LETTERS = "一二三四五六七八九十的了在是有人这中大为上个国"


def written_line(rng):
    if rng.random() < 0.1:
        return rng.choice(["", "=== [Page 1/2] ===", "-----", "作者：三", "第一章 二", "三三三三" * 3, " "])
    body = "".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 26)))
    return rng.choice(["", "", "", "“", "「", "（", "【", "第", "　　", " "]) + body + rng.choice(["", "", "", "。", "，", "”", "。”", "」", "）", "：", "！", "章", "】", "……", "."])


@pytest.mark.parametrize(("page_header", "heading"), [(False, None), (True, None), (False, "^[一二].{0,3}[。！]")])
def test_fold_agrees_with_the_plain_fold(page_header, heading):
    rng = random.Random(9)
    texts = ["\n".join("".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(1, 14))) for _ in range(600)]
    texts += ["\n".join(written_line(rng) for _ in range(rng.randint(1, 30))) for _ in range(900)]
    given = pa.table({"doc_id": range(len(texts)), "text": texts})  # noqa: F841
    c = duckdb.connect()
    c.register("given", given)
    rows = dict(c.sql(segments_sql("given", page_header, heading)).fetchall())
    rx, folded = re.compile(heading) if heading else None, 0
    for i, text in enumerate(texts):
        got = [(g["kind"], g["text"]) for g in rows[i]]
        if got != [("unchanged", text)]:
            folded += 1
            assert got == R.fold(text, page_header, rx), text
    assert folded > 1000


def test_reads_its_input_once(spark):
    plan = R.reflow(cjk_documents(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("ArrowEvalPython") == 1 and "Union" not in plan


def test_fold_takes_few_steps_a_line():
    rng = random.Random(10)
    lines = ["".join(rng.choice(LETTERS) for _ in range(12)) if rng.random() < 0.6 else written_line(rng) for _ in range(5000)]
    said = cProfile.Profile()
    said.runcall(R.fold, "\n".join(lines))
    assert sum(e.callcount for e in said.getstats()) < 35 * len(lines)


def test_lines_known_as_plain_are_text_by_every_rule():
    rng = random.Random(11)
    marks = "卷章前言第，。！？；：、…—.!?,-=~＝ab１２）(（“”「」 　\t"
    given = ["".join(rng.choice(LETTERS[:20]) if rng.random() < 0.9 else rng.choice(marks) for _ in range(rng.choice([1, 8, 9, 10, 12, 17, 60]))) for _ in range(30000)]
    given += ["一二三四" * 3, "一二三四五。" * 3, "的" * 50, "前言一二三四五六七八", "卷一的的的的的的的的", "-----。", "的的的的的的的的-"]
    known = 0
    for line in given:
        m = R._PLAIN.match(line + "\n")
        if m:
            known += 1
            rules_say = R.title_heading(line), R.heading_like(line), R.metadata_line(line), R._DIVIDER.match(line), R._MARKER.match(line)
            assert R.collapse(line) == line and not any(rules_say) and not R._MARK.search(line), line
            assert m[3] or not R.Paragraph(line).sentence_ended(), line
    assert known > 5000


def test_reflowed_texts_come_joined_from_the_kernel(spark):
    rows = [(1, "第一章 始\n他的话还没有能够说完\n就完了。"), (2, "Plain latin text stays. " * 5), (3, None), (4, " ")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    assert "transform(" not in R.reflow(df.select("doc_id", "text"))._jdf.queryExecution().optimizedPlan().toString().replace("transform(array(", "")
    assert {r["doc_id"]: (r["n_segments"], r["text"]) for r in R.reflow(df).collect()} == {1: (2, "第一章 始\n\n他的话还没有能够说完就完了。"), 2: (1, rows[1][1]), 3: (None, None), 4: (1, " ")}


def test_guard_reads_no_further_than_its_limit(spark):
    texts = ["a" * 39, "a" * 40, "字" + "a" * 60, " \n" * 500 + "a" * 100 + "字", "a　" * 99 + "字", "a　" * 100 + "字", "é!" * 50, "ж" * 11 + "a" * 89, "ж" * 10 + "a" * 90, "", "　" * 9, "😀" * 5 + "a" * 95 + "字"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = df.select("i", F.expr(rules.latin_block(SPARK, "text")).alias("latin"))
    c = duckdb.connect()
    c.register("given", pa.table({"i": range(len(texts)), "text": texts}))
    assert sorted(map(tuple, got.collect())) == sorted(c.sql(f"SELECT i, {rules.latin_block(DUCK, 'text')} FROM given").fetchall())
    assert got._jdf.queryExecution().optimizedPlan().toString().count("{0,100}") == 1
