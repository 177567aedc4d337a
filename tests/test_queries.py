"""Every registered query with SQL against DuckDB, without the training-data operators."""

import os
import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scrivener.functions.dialect import DUCK, SPARK
from scrivener.plans.queries import LINE_RULES, LINE_TEXTS, registry

SF = "/root/testdata/sf0.001"
CASES = [(n, q, sql) for n, (q, sql) in registry().items()]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize(("name", "query", "sql"), CASES, ids=[n for n, _, _ in CASES])
def test_query(spark, duck, name, query, sql):
    got = query(spark, SF)
    cols = sorted(got.columns)
    rows = sorted(map(str, (tuple(r) for r in got.select(cols).collect())))
    assert rows
    if sql:
        assert rows == sorted(map(str, duck.sql(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()))


@pytest.mark.parametrize("name", ["page_header", "page_plain", "page_degenerate", "page_assemble", "progress_line", "last_two_chars", "segment_collapse"])
def test_a_document_is_a_row(spark, name):
    """Pages and digests take a document's lines from an array; one small file is dealt out, nothing goes by a key."""
    assert "hashpartitioning" not in registry()[name][0](spark, SF)._jdf.queryExecution().executedPlan().toString()


CHANGED = ("heading_like", "title_heading", "metadata_line", "sentence_boundary", "unclosed_bracket", "unclosed_quote")
TEXTS = ("last_two_chars", "trim_unicode", "last_visible_place", "segment_collapse")


def test_rules_agree_on_odd_lines(spark, duck):
    rng = random.Random(12)
    letters, marks = "一二三四的了在是ñж字𠀀", "第章节卷回前言分合作者：:・，,、。！？!?；…—.“”‘’「」〞〟（）()[]〔〕【】⟨⟩<> \t\xa0  　\x85=-=７9aB"
    odd = ["".join(rng.choice(marks if rng.random() < p else letters) for _ in range(rng.randint(0, 20))) for p in (0, 0.1, 0.3, 0.7, 1) for _ in range(2500)]
    odd += ["第一二三四五六章", "第一二三四五章分", "一二三四五六七八九十第一章", "一二三四五六七八九十一第章", "第章合第二章", "第一章" + "的" * 20, "第一章" + "的" * 21, "第第一章分", "=== [a] ===", "=== 一 ===", "的" * 8, "的" * 9, "作者　一", "汉汉汉汉汉汉：", "汉汉汉汉汉汉汉：", "a:", "汉:", "的的的的 的的的的 的的的的", " 的 "]
    duck.register("odd", pa.table({"i": range(len(odd)), "raw": odd}))
    df = spark.createDataFrame(list(enumerate(odd)), "i int, raw string")
    for name in (*CHANGED, *TEXTS):
        rule = (LINE_RULES | LINE_TEXTS)[name]
        got = dict(map(tuple, df.select("i", F.expr(rule(SPARK, "raw"))).collect()))
        for i, expected in duck.sql(f"SELECT i, {rule(DUCK, 'raw')} FROM odd").fetchall():
            assert got[i] == expected, (name, odd[i])


@pytest.mark.parametrize("name", ["heading_like", "title_heading", "metadata_line", "sentence_boundary", "custom_heading"])
def test_most_lines_meet_one_cheap_question(spark, name):
    """Of a line without marks few patterns are asked: the first question of the rule holds no alternative and decides."""
    rule = LINE_RULES[name](SPARK, "raw").lstrip("(")
    first = rule.removeprefix("CASE WHEN NOT ").split(" THEN ")[0].split(" AND ")[0]
    plain = spark.createDataFrame([("一二三四五六七八九十的了",), ("的了在是人他我要以上为一",)], "raw string")
    assert len(first) < 300 and plain.filter(F.expr(first)).count() == 0
