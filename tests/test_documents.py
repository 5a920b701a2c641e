"""Pages to chunks, tables, question sets, acquisition, ledgers: small cases and plain models."""

import random

import pytest
from pyspark.sql import functions as F

from folioflow import lineage
from folioflow.operators import acquisition, cleaning, incremental, qa, quality, sections, tables

HEADS = "标题行"


def test_running_lines_and_page_numbers_go(spark):
    pages = [("d", k, f"{HEADS}\n正文{k}没有完\n{k + 1}\n页脚文字") for k in range(4)] + [("e", 0, "独页标题\n正文。"), ("f", 0, None)]
    df = spark.createDataFrame(pages, "doc_id string, page_no int, text string")
    out = {(r.doc_id, r.page_no): r.lines for r in cleaning.without_running_lines(cleaning.page_lines(df)).collect()}
    assert out["d", 1] == ["正文1没有完"] and out["e", 0] == ["独页标题", "正文。"] and out["f", 0] == [""]
    text = {r.doc_id: r.text for r in cleaning.clean_pages(df).collect()}
    assert text["d"] == "正文0没有完\n正文1没有完\n正文2没有完\n正文3没有完" and text["f"] == ""


def plain_reflow(lines):
    out, held = [], ""
    for x in lines:
        if not x:
            out, held = out + [held] * bool(held), ""
            continue
        held += x
        if x[-1] in "。！？；：”" or len(x) <= 6:
            out, held = [*out, held], ""
    return out + [held] * bool(held)


def test_reflow_is_an_ordered_fold(spark):
    rng = random.Random(3)
    docs = [[rng.choice(["", "短句", "这是一个比较长的行", "句子到此结束了呢。", "引语的结尾在这里”"]) for _ in range(rng.randint(0, 15))] for _ in range(30)]
    rows = [(str(d), k, x) for d, lines in enumerate(docs) for k, x in enumerate(lines)]
    got = cleaning.reflow(spark.createDataFrame(rows, "doc_id string, line_no int, line string")).orderBy("doc_id", "para_no").collect()
    for d, lines in enumerate(docs):
        assert [r.text for r in got if r.doc_id == str(d)] == plain_reflow(lines)


def test_sections_are_ordered_and_the_lead_is_dropped(spark):
    t = "引言\n第二节 乙\n乙文\n第一节 甲\n甲文"
    df = spark.createDataFrame([("a", t), ("b", "没有标题的文字" * 20)], "doc_id string, text string")
    out = {r.doc_id: r for r in df.select("doc_id", sections.reorder(F.col("text")).alias("t"), sections.dropped_chars(F.col("text")).alias("n")).collect()}
    assert out["a"].t == "第一节\n甲\n甲文\n第二节\n乙\n乙文" and out["a"].n == 3
    assert out["b"].t == "没有标题的文字" * 20 and out["b"].n == 0


def test_chunks_tables_and_dedup(spark):
    body = "字" * 2500
    rows = [[["项目", "本期"], [None, "  "], ["收|入", "1"], ["多", "2", "3"]], [["只一行"]], [["x", "y"], ["1", "2"]]]
    found = spark.createDataFrame([("a", 12, 0, "合并利润表续", rows[0]), ("a", 13, 0, "合并利润表续", rows[1]), ("a", 14, 0, "别的页", rows[2])], "doc_id string, page_no int, table_no int, page_text string, rows array<array<string>>")
    kept = tables.labelled(found)
    assert [(r.title, r.page_no) for r in kept.collect()] == [("合并利润表", 12)]
    assert kept.first().markdown == "| 项目 | 本期 |\n| --- | --- |\n| 收/入 | 1 |\n| 多 | 2 |"
    out = sections.build_chunks(spark.createDataFrame([("a", body)], "doc_id string, text string"), kept).orderBy("chunk_id").collect()
    assert [(r.chunk_id, len(r.text), r.is_table) for r in out] == [(1, 1000, False), (2, len(out[1].text), True)]  # equal first characters: later pieces repeat the first
    many = spark.createDataFrame([(d, k, "same text") for d in "xyz" for k in range(3)] + [("y", 9, "other")], "doc_id string, chunk_id int, text string")
    assert sections.deduplicated(many).count() == 4
    across = sections.deduplicated(many, doc=None)
    assert sorted((r.doc_id, r.chunk_id) for r in across.collect()) == [("x", 0), ("y", 9)] and across.columns == many.columns


@pytest.mark.parametrize("budget", [0, 12, 40])
def test_packing_keeps_order_and_budget(spark, budget):
    rng = random.Random(budget)
    rows = [(d, k, "w" * rng.randint(1, 15), rng.random() < 0.2) for d in "ab" for k in range(1, 20)]
    got = {}
    for r in qa.packed(spark.createDataFrame(rows, "doc_id string, chunk_id int, text string, is_table boolean"), budget).collect():
        got[r.doc_id, r.group_id] = r
    for d in "ab":
        want, kind = [], None
        for _, k, t, table in (x for x in rows if x[0] == d):
            if not want or kind != table or not budget or sum(len(y) for _, y in want[-1]) + len(t) > budget:
                want.append([])
            want[-1].append((k, t))
            kind = table
        mine = [got[d, g] for g in sorted(g for x, g in got if x == d)]
        assert [(r.first_chunk, r.n_chunks, r.chars) for r in mine] == [(g[0][0], len(g), sum(len(t) for _, t in g)) for g in want]
        assert mine[0].text.startswith("【块1】\n")


def test_replies_become_pairs(spark):
    said = ['```json\n[{"instruction": " q ", "output": "a"}, {"instruction": "", "output": "b"}]\n```', "sorry", None, '[{"instruction": "x", "output": "y"}] done', "]["]
    pairs = qa.alpaca(spark.createDataFrame([(k, 0, s) for k, s in enumerate(said)], "doc_id int, group_id int, reply string"))
    assert sorted((r.doc_id, r.instruction, r.output) for r in pairs.collect()) == [(0, "q", "a"), (3, "x", "y")]
    talk = qa.sharegpt(pairs).where("doc_id = 3").first().conversations
    assert [(x.role, x.content) for x in talk] == [("user", "x"), ("assistant", "y")]


def test_quality_reports(spark):
    rows = [("q one?", "ab", None, None), ("Q  ONE?", "x" * 900, None, None), ("", "y", None, None)]
    df = spark.createDataFrame(rows, "instruction string, output string, source string, company string")
    from folioflow.functions import text as X

    assert tuple(quality.duplicate_rate(df, X.squeeze(F.col("instruction"))).first()) == (3, 2, round(1 / 3, 6))
    p = quality.length_profile(df, F.length("output")).first()
    assert (p.n, p.n_short, p.n_long, p.min_len, p.median_len, p.max_len, p.mean_len) == (3, 2, 1, 1, 2, 900, 301)
    four = spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "v int")
    assert quality.length_profile(four, F.col("v")).first().median_len == 3
    assert tuple(quality.alpaca_errors(df).first()) == (3, 1) and quality.short_answers(df).count() == 2
    empty = quality.length_profile(four.limit(0), F.col("v")).first()
    assert empty.n == 0 and empty.median_len is None


def test_acquisition(spark):
    rows = [("1", "甲", "甲2025年年度报告", 3000, "/a/x.PDF", "i", 1), ("1", "甲", "甲年度报告修订", 9000, "/b", "j", 2), ("2", "*ST乙", "乙年度报告", None, "c/d", "k", 3), (None, "丙", "年度报告", 1, "e", "l", 4), ("3", "丁", "年度报告摘要", 5, "f", "m", 5), ("4", "戊", "年度报告", 10**12, None, "n", 6)]
    df = spark.createDataFrame(rows, "secCode string, secName string, announcementTitle string, announcementTime long, adjunctUrl string, announcementId string, seen long")
    m = acquisition.manifest(acquisition.recent_reports(df, 5), "http://host/").orderBy("idx").collect()
    assert [(r.idx, r.code, r.url, r.file) for r in m] == [(1, "1", "http://host/a/x.PDF", "01_1_甲_1970-01-01.pdf"), (2, "2", "http://host/c/d", "02_2_ST乙_unknown.pdf")]


def test_round_robin_is_balanced(spark):
    rows = [(s, f"{s}{k}") for s, n in (("a", 9), ("b", 2), ("c", 5)) for k in range(n)]
    out = [r.s for r in acquisition.round_robin(spark.createDataFrame(rows, "s string, f string"), "s", "f", 10).collect()]
    assert out == ["a", "b", "c", "a", "b", "c", "a", "c", "a", "c"]


def test_numbering_and_drawing(spark):
    rng = random.Random(8)
    values = [(f"{k:04d}",) for k in range(500)]
    rng.shuffle(values)
    df = spark.createDataFrame(values, "v string").repartition(7)
    assert all(int(r.v) == r.n for r in lineage.numbered(df, ["v"], "n").collect())
    want = [f"{k:04d}" for k in random.Random(42).sample(range(500), 9)]
    assert [r.v for r in acquisition.drawn(df, "v", 9).collect()] == want
    assert lineage.numbered(df.limit(0), ["v"], "n").collect() == []


def test_ledgers(spark):
    old = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    new = spark.createDataFrame([("a", 9)], "k string, v int")
    assert sorted(map(tuple, incremental.replaced(old, new, "k").collect())) == [("a", 9), ("b", 3)]
    assert [r.k for r in incremental.pending(old, new, "k").collect()] == ["b"]
    assert incremental.last_wins(old, "k", "v").where("k = 'a'").first().v == 2
    reports = spark.createDataFrame([("vec", False), ("hr", True)], "cfg string, partial boolean")
    wanted = spark.createDataFrame([("vec",), ("hr",), ("hybrid",)], "cfg string")
    assert sorted(r.cfg for r in incremental.unfinished(reports, wanted).collect()) == ["hr", "hybrid"]
