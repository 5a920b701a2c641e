"""Scans and sinks, streaming, and the driver's entry points."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from folioflow import schemas
from folioflow.sources import readers, writers
from folioflow.streaming import ingest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def dump(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(value, ensure_ascii=False), encoding="utf-8")


def test_json_scans(spark, tmp_path):
    dump(tmp_path / "a" / "m.json", [{"instruction": "q", "output": "a"}, {"instruction": None, "output": None}])
    assert readers.json_objects(spark, f"{tmp_path}/a", schemas.QA).count() == 2
    assert readers.json_or_empty(spark, f"{tmp_path}/a", schemas.QA).count() == 1
    assert readers.json_or_empty(spark, f"{tmp_path}/none", schemas.QA).count() == readers.json_or_empty(spark, f"{tmp_path}/a", schemas.QA, fresh=True).count() == 0
    (tmp_path / "bad.json").write_text("[{")
    assert readers.json_or_empty(spark, f"{tmp_path}/bad.json", schemas.QA).count() == 0
    dump(tmp_path / "b" / "x.json", {"count": 1, "items": [{"idx": 1, "code": "600000", "file": "f"}]})
    assert readers.json_objects(spark, f"{tmp_path}/b", schemas.MANIFEST).select(F.inline("items")).first().code == "600000"


def test_chunk_files_keep_their_ordinals(spark, tmp_path):
    dump(tmp_path / "c" / "02_600002_乙_x_chunks.json", ["one", "  ", {"text": "three", "source": "03_600003_丙_x.pdf"}])
    dump(tmp_path / "c" / "01_600001_甲_x_chunks.json", ["zero"])
    dump(tmp_path / "c" / "03_none.json", {"not": "a list"})
    out = readers.chunk_records(spark, f"{tmp_path}/c").orderBy("rec_id").collect()
    assert [(r.rec_id, r.company, r.chunk_idx, r.text) for r in out] == [(0, "甲", 0, "zero"), (1, "乙", 0, "one"), (2, "丙", 2, "three")]
    assert [r.file for r in out][2] == "03_600003_丙_x.pdf"


class Parser:
    def pages(self, data):
        if data == b"broken":
            raise ValueError("not a document")
        return [x.decode() for x in data.split(b"\f")]

    def tables(self, data):
        return [(0, [["a", None], ["1", "2"]])] if b"table" in data else []


def test_document_scans(spark, tmp_path):
    for name, data in (("b.pdf", b"one\ftwo"), ("a.pdf", b"table"), ("c.pdf", b"broken"), ("d.txt", b"x")):
        (tmp_path / name).write_bytes(data)
    assert [r.file for r in readers.listing(spark, str(tmp_path)).collect()] == ["a.pdf", "b.pdf", "c.pdf"]
    assert [r.file for r in readers.listing(spark, str(tmp_path), limit=1).collect()] == ["a.pdf"]
    pages = readers.pdf_pages(spark, str(tmp_path), Parser).collect()
    assert sorted((r.doc_id, r.page_no, r.text) for r in pages if r.error is None) == [("a.pdf", 0, "table"), ("b.pdf", 0, "one"), ("b.pdf", 1, "two")]
    assert [r.doc_id for r in pages if r.error] == ["c.pdf"]
    t = {r.doc_id: r for r in readers.pdf_tables(spark, str(tmp_path), Parser).collect()}
    assert (t["a.pdf"].page_no, t["a.pdf"].rows) == (1, [["a", None], ["1", "2"]]) and "ValueError" in t["c.pdf"].error and set(t) == {"a.pdf", "c.pdf"}


def test_fetching_tries_hosts_in_turn(spark):
    def fetch(url):
        if url.startswith("http://down"):
            raise OSError("down")
        return url.encode()

    m = spark.createDataFrame([("1", "/x"), ("2", None)], "code string, adjunctUrl string")
    out = {r.code: r for r in readers.fetched(m, fetch, ["http://down/", "http://up/"], wait=0).collect()}
    assert (bytes(out["1"].content), out["1"].host, out["1"].status) == (b"http://up/x", "http://up/", "ok")
    assert out["2"].status == "skipped" and out["2"].content is None
    assert "failed" in readers.fetched(m, fetch, ["http://down"], wait=0).where("code = 1").first().status


def test_paged_source(spark, tmp_path):
    for k in (1, 2):
        dump(tmp_path / f"{k}.json", {"announcements": [{"secCode": str(k), "announcementTitle": "年度报告", "announcementTime": k * 1000}]})
    spark.dataSource.register(readers.PagedSource)
    rows = spark.read.format("paged_announcements").option("files", str(tmp_path)).option("pages", 3).load().collect()
    assert sorted((r.secCode, r.announcementTime) for r in rows) == [("1", 1000), ("2", 2000)]
    dump(tmp_path / "4.json", {"announcements": [{"secCode": "4", "announcementTitle": "年度报告"}]})
    read = lambda **o: sorted(r.secCode for r in spark.read.format("paged_announcements").options(files=str(tmp_path), **o).load().collect())
    assert read() == ["1", "2"]  # the third page fails, so the fourth is not asked for
    assert read(companies=1) == ["1"]


def test_draws_from_draws(spark):
    import random

    from folioflow.operators import acquisition

    want = random.Random(7).sample(random.Random(42).sample(range(50), 20), 8)
    assert [r.id for r in acquisition.redrawn(spark.range(50), "id", (20, 8)).orderBy("draw").collect()] == want


def test_command_lines(spark, tmp_path, capsys):
    from folioflow import __main__ as commands

    for n in range(3):
        (tmp_path / "pdf").mkdir(exist_ok=True)
        (tmp_path / "pdf" / f"0{n}_60000{n}_Firm{n}_x.pdf").write_bytes(f"Report of Firm{n}. ".encode() * 30 + b"\fsecond page")
    run = lambda *a: commands.main(list(map(str, a)), spark)
    run("chunks", "--pdf", tmp_path / "pdf", "--out", tmp_path / "chunks", "--parser", "tests.test_sources:Parser")
    run("index", "--chunks", tmp_path / "chunks", "--out", tmp_path / "index")
    run("ask", "--index", tmp_path / "index", "-q", "what of Firm1?", "-k", 2, "--hybrid", "--show-hits")
    assert "Firm1" in capsys.readouterr().out
    run("qa", "--chunks", tmp_path / "chunks", "--out", tmp_path / "qa", "--generator", "tests.test_sources:replies")
    run("qa", "--chunks", tmp_path / "chunks", "--out", tmp_path / "qa", "--generator", "tests.test_sources:replies")
    assert spark.read.json(f"{tmp_path}/qa/alpaca").count() == 3  # what is done is not asked again
    dump(tmp_path / "qa.json", [{"instruction": f"what of Firm{n}?", "output": "Report"} for n in range(3)])
    run("check", "--qa", tmp_path / "qa.json")
    run("ablation", "--index", tmp_path / "index", "--qa", tmp_path / "qa.json", "--out", tmp_path / "eval", "--configs", "vec,hr_route", "--workers", 2)
    assert {r.cfg for r in spark.read.parquet(f"{tmp_path}/eval/reports").collect()} == {"vec", "hr_route"}
    assert commands.arguments().parse_args(["ask", "--index", "x"]).candidates == 20


def replies():
    return lambda prompt: '[{"instruction": "q", "output": "a"}]'


def test_adapters_name_what_is_missing():
    from folioflow.operators import adapters

    with pytest.raises(RuntimeError, match="needs the library"):
        adapters.encoder("none")()
    with pytest.raises(RuntimeError, match="needs the library"):
        adapters.PdfFile().pages(b"")


def test_settings_and_chat():
    lines = ["# c", "", "A = 1", 'B="x=y"', "no"]
    assert readers.settings(lines) == {"A": "1", "B": "x=y"}
    assert "# c" not in readers.settings(lines) and readers.settings(["#A=1"], comments=False) == {"#A": "1"}
    assert list(readers.chat(iter([" a ", "b", "Exit", "c"]), str.upper)) == ["A", "B"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    writers.json_array(df, f"{tmp_path}/r", ["k"])
    assert json.loads("\n".join(r.value for r in spark.read.text(f"{tmp_path}/r").collect())) == [{"k": 1, "v": "a"}, {"k": 2, "v": "b"}]
    writers.per_document(df, f"{tmp_path}/d", "k")
    writers.per_document(spark.createDataFrame([(1, "new")], "k int, v string"), f"{tmp_path}/d", "k")
    assert sorted((r.k, r.v) for r in spark.read.parquet(f"{tmp_path}/d").collect()) == [(1, "new"), (2, "b")]
    writers.backup_once(df, f"{tmp_path}/raw")
    writers.backup_once(df.limit(0), f"{tmp_path}/raw")
    assert spark.read.parquet(f"{tmp_path}/raw").count() == 2
    writers.save(df, f"{tmp_path}/dry", dry=True)
    assert not readers.exists(spark, f"{tmp_path}/dry")
    writers.append_done(df.select("k"), f"{tmp_path}/done")
    writers.append_done(df.select("k"), f"{tmp_path}/done")
    assert spark.read.parquet(f"{tmp_path}/done").count() == 4
    writers.vector_index(df.withColumn("embedding", F.array(F.lit(1.0))), f"{tmp_path}/i", "m", "k")
    records, model = readers.vector_index(spark, f"{tmp_path}/i")
    assert model == "m" and "PartitionFilters: [isnotnull(k" in records.where("k = 1")._jdf.queryExecution().executedPlan().toString()


def test_new_files_are_chunked_once(spark, tmp_path):
    schema = "doc_id long, text string"
    add = lambda k: spark.createDataFrame([(k, f"{k} " + "x" * 200)], schema).write.mode("append").parquet(f"{tmp_path}/in")
    for k in (1, 2):
        add(k)
        ingest.chunk_stream(ingest.arriving(spark, f"{tmp_path}/in", schema), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(120)
        assert sorted(r.doc_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(1, k + 1))


def test_windowed_counts_over_a_stream(spark, sf_dir):
    import shutil
    import tempfile

    folder = tempfile.mkdtemp()
    shutil.copy(f"{sf_dir}/events.parquet", folder)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = ingest.windowed_counts(ingest.arriving(spark, folder, events.schema))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("counts").agg(F.sum("n")).first()[0] == events.count()


def test_every_query_matches_its_oracle(spark):
    import duckdb

    sf_dir = os.environ.get("TEST_ORACLE_DIR", "/root/testdata/sf0.01")
    sys.path.insert(0, ROOT)
    import __spark_entry__ as entry
    from folioflow.plans import registry

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    plain = lambda v: repr(round(v, 6) + 0.0) if isinstance(v, float) else "[" + ",".join(map(plain, v)) + "]" if isinstance(v, list | tuple) else str(v)
    assert set(registry.ORACLE) <= set(registry.QUERIES) <= set(entry.queries())
    wrong = []
    for name, sql in registry.ORACLE.items():
        df = registry.QUERIES[name](spark, sf_dir)
        cols = sorted(df.columns)
        want = con.execute(f"select {', '.join(f'\"{c}\"' for c in cols)} from ({sql})").fetchall()
        if sorted([[plain(r[c]) for c in cols] for r in df.collect()]) != sorted([list(map(plain, r)) for r in want]):
            wrong.append(name)
    assert not wrong


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    import shutil

    shutil.copytree(f"{ROOT}/folioflow", tmp_path / "folioflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0, out.stderr
    for folder, _, names in os.walk(f"{ROOT}/folioflow"):
        for name in names:
            if name.endswith(".py") and f"{os.sep}llm" not in folder:
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    assert "folioflow.llm" not in f.read(), name
