"""Search, fusion, routing, reports and whole runs on small corpora."""

import math
import random
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioflow.operators import evaluate, fusion, judging, models, retrieval, routing, runs, text_index, topk, vector

WORDS = "revenue profit asset board audit dividend share cost loan plant growth margin".split()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    return [" ".join(rng.choices(WORDS, k=rng.randint(0, 30))) for _ in range(60)]


@pytest.fixture(scope="module")
def records(spark, texts):
    rows = [(k, f"C{k % 4}", f"{k:02d}_{600000 + k % 4}_C{k % 4}_r.pdf", k // 4, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "rec_id long, company string, file string, chunk_idx int, text string")
    return models.embedded(df, "text").cache()


@pytest.fixture(scope="module")
def questions(spark):
    rows = [(0, "audit cost of C1", "12"), (1, "profit of 600002 margin margin", "profit"), (2, "dividend", None), (3, "nothing here", "")]
    return models.embedded(spark.createDataFrame(rows, "qid long, question string, reference string"), "question", is_query=True)


def okapi(texts, query):
    docs = [t.split() for t in texts]
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(w for d in docs for w in set(d))
    idf = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    low = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: x if x >= 0 else low for w, x in idf.items()}
    return [sum(idf[w] * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for w in query.split() if w in idf and w in d) for d in docs]


def test_bm25_is_okapi_over_the_whole_corpus(records, questions, texts):
    got = {(r.qid, r.rec_id): r.score for r in text_index.search(records, questions, 1000).collect()}
    some = {(r.qid, r.rec_id): r.score for r in text_index.search(records, questions, 1000, block_tokens=3).collect()}
    assert got == some
    for q, words in ((0, "audit cost of c1"), (1, "profit of 600002 margin margin")):
        want = okapi(texts, words)
        assert all(got.get((q, k), 0.0) == pytest.approx(s, abs=1e-6) for k, s in enumerate(want))


def test_vector_search_is_exact(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((80, 8)).astype(np.float32)
    v[10] = v[11]
    vectors = spark.createDataFrame([(k, x.tolist(), str(k % 3)) for k, x in enumerate(v)] + [(99, None, "0")], "rec_id long, embedding array<float>, scope string")
    queries = spark.createDataFrame([(k, v[k].tolist(), "1" if k % 2 else None) for k in range(12)], "qid long, embedding array<float>, scope string")
    for blocks in (1 << 20, 100):
        for scope in (None, "scope"):
            got = {(r.qid, r["rank"]): r.rec_id for r in vector.search(vectors, queries, 5, scope, block_bytes=blocks).collect()}
            for q in range(12):
                s = np.round(v.astype(float) @ v[q].astype(float), 9)
                pool = [k for k in range(80) if not (scope and q % 2) or k % 3 == 1]
                best = sorted(pool, key=lambda k: (-s[k], k))[:5]
                assert [got[q, n] for n in range(1, 6)] == best
    assert vector.search(vectors, queries.limit(0)).collect() == [] == vector.search(vectors.limit(0), queries).collect()
    with pytest.raises(ValueError):
        vector.search(vectors, queries.unionByName(spark.createDataFrame([(50, [1.0, 2.0], None)], queries.schema)))
    own = queries.where("scope is not null")
    assert "In(scope" in vector.search(vectors, own, 5, "scope")._jdf.queryExecution().executedPlan().toString() or "scope" in vector.search(vectors, own, 5, "scope")._jdf.queryExecution().optimizedPlan().toString()


def test_bm25_within_scopes(spark, records, questions, texts):
    q = questions.withColumn("scope", F.when(F.col("qid") == 0, "C1"))
    r = records.withColumn("scope", F.col("company"))
    out = text_index.search(r, q, 5, "scope").collect()
    want = okapi(texts, "audit cost of c1")
    best = sorted((k for k in range(1, 60, 4) if {"audit", "cost"} & set(texts[k].split())), key=lambda k: (-round(want[k], 9), k))[:5]
    assert [x.rec_id for x in sorted(out, key=lambda x: x["rank"]) if x.qid == 0] == best
    assert len({x.rec_id % 4 for x in out if x.qid == 1}) > 1


def test_words_in_all_records_and_in_scopes_at_one_go(records, questions, monkeypatch):
    q = questions.withColumn("scope", F.when(F.col("qid") == 0, "C1"))
    r = records.withColumn("scope", F.col("company"))
    plain = lambda df: sorted(map(tuple, df.select("qid", "rec_id", "score", "rank").collect()))
    scans = []
    scan = text_index._scan
    monkeypatch.setattr(text_index, "_scan", lambda *a: scans.append(1) or scan(*a))
    arms = retrieval.Arms(r, q, 5, "scope", both=True)
    once = {s: plain(arms.words(s)) for s in (False, True)}
    assert len(scans) == 1 and once[False] != once[True]
    for s in (False, True):
        assert once[s] == plain(text_index.search(r, q, 5, "scope" if s else None))
    few, more = arms.texts(5, False).count(), arms.texts(5, False, True).count()
    assert few == arms.best(5).select("rec_id").distinct().count() <= more


def test_best_keeps_the_first_of_ties():
    rng = np.random.default_rng(4)
    scores = rng.integers(0, 6, (300, 5)).astype(float)
    scores[scores == 0] = -np.inf
    best = topk.Best(np.arange(5), 7)
    for at in range(0, 300, 11):
        best.add(np.arange(300)[at : at + 11], scores[at : at + 11])
    for j in range(5):
        want = sorted((k for k in range(300) if scores[k, j] > -np.inf), key=lambda k: (-scores[k, j], k))[:7]
        assert best.ids[j].tolist() == want


def test_best_rounds_and_takes_some_queries():
    rng = np.random.default_rng(6)
    scores = np.round(rng.standard_normal((900, 4)), 2) + rng.uniform(-4e-4, 4e-4, (900, 4))
    best, ids = topk.Best(np.arange(6), 3, 2), rng.permutation(900)
    for at in range(0, 900, 300):
        best.add(ids[at : at + 300], scores[at : at + 300], np.array([5, 0, 3, 2]))
    for j, q in enumerate([5, 0, 3, 2]):
        assert best.ids[q].tolist() == [ids[k] for k in sorted(range(900), key=lambda k: (-np.round(scores[k, j], 2), ids[k]))[:3]]
    assert np.isneginf(best.scores[[1, 4]]).all()


def test_meetings_are_bounded_and_whole():
    own, scopes = pa.array(["a", None, "b", "c", "a"] * 30), ["a", None, "b", "x", None, "a", "a"]
    for most in (1, 7, 1000):
        got = [(i, j) for r, q in topk.meetings(own, topk.grouped(scopes), 150, 7, most) if len(r) * len(q) <= most for i in r for j in q]
        assert sorted(got) == [(i, j) for i, o in enumerate(own.to_pylist()) for j, s in enumerate(scopes) if s is None or s == o]
    assert len([0 for r, q in topk.meetings(None, None, 50, 40, 9) for _ in r for _ in q]) == 2000


@pytest.mark.parametrize("scoped", [False, True])
def test_vector_scan_holds_few_similarities(scoped):
    class Frame:
        class sparkSession:  # noqa: N801
            class sparkContext:  # noqa: N801
                broadcast = staticmethod(lambda v: SimpleNamespace(value=v))

        mapInArrow = staticmethod(lambda run, schema: run)  # noqa: N815

    rng = np.random.default_rng(3)
    rows = [SimpleNamespace(qid=j, embedding=x, scope=str(j % 2)) for j, x in enumerate(rng.standard_normal((6000, 4)))]
    run = vector._scan(Frame, rows, [r.scope for r in rows] if scoped else None, 2, 9)
    batch = pa.RecordBatch.from_pydict({"rec_id": np.arange(4096), "embedding": list(rng.standard_normal((4096, 4))), "scope": [str(k % 2) for k in range(4096)]})
    tracemalloc.start()
    assert sum(b.num_rows for b in run(iter([batch]))) == 12000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20  # all similarities at once are 197 MB


def test_fusion_is_symmetric_and_breaks_ties(spark):
    a = spark.createDataFrame([(0, 1, 1), (0, 2, 2)], "qid long, rec_id long, rank int")
    b = spark.createDataFrame([(0, 2, 1, 3.0), (0, 3, 2, 1.0), (0, 4, 3, 0.0)], "qid long, rec_id long, rank int, score double")
    out = fusion.fuse(a, b).orderBy("rank").collect()
    assert [(r.rec_id, r.vec_rank, r.bm25_rank) for r in out] == [(2, 2, 1), (1, 1, None), (3, None, 2)]
    assert out[0].score == pytest.approx(1 / 62 + 1 / 61)
    back = fusion.fuse(b.select("qid", "rec_id", "rank"), a.withColumn("score", F.lit(1.0)))
    assert {r.rec_id: r.score for r in back.collect() if r.rec_id < 4} == {r.rec_id: r.score for r in out}


def test_routing(spark, records):
    asked = ["what of 600002?", "about C 1 and C2", "number 6000021", "600099 and C3", "none"]
    q = spark.createDataFrame(list(enumerate(asked)), "qid long, question string")
    out = {r.qid: r.routed for r in routing.route(q, routing.companies(records), routing.codes(records)).collect()}
    assert out == {0: "C2", 1: "C1", 2: None, 3: "C3", 4: None}


def test_configurations_agree_where_they_must(records, questions):
    q = runs.routed(questions, records)
    r = records.withColumn("scope", F.col("company"))
    every = retrieval.retrieve_all(retrieval.CONFIGS, r, q, k=20, candidates=20).cache()
    ids = lambda cfg: {(x.qid, x.rec_id) for x in every.where(F.col("cfg") == cfg).collect()}
    assert ids("hr") == ids("hybrid")  # reranking changes the order alone
    company = {x.rec_id: x.company for x in records.collect()}
    assert {company[b] for a, b in ids("hr_route") if a == 0} == {"C1"} and {company[b] for a, b in ids("hr_route") if a == 1} == {"C2"}
    better = retrieval.rerank(every.where("cfg = 'hybrid'"), records, questions, 6, models.overlap_reranker)
    assert better.groupBy("qid").count().where("count > 6").count() == 0


def test_recall_grows_with_k(spark, records, questions):
    items = runs.routed(questions, records).withColumn("source", F.lit("01_600001_C1_r_chunks.json")).withColumn("output", F.when(F.col("qid") < 2, "见【块1】").otherwise("无"))
    out = runs.recall(items, records, ("vec", "hybrid")).collect()
    by = {(r.cfg, r.k): r for r in out}
    assert all(by[c, 6].doc_recall <= by[c, 20].doc_recall and by[c, 6].chunk_n == 2 and by[c, 6].n == 4 for c in ("vec", "hybrid"))
    with pytest.raises(ValueError):
        runs.recall(items, records, ks=(30,))


def test_ablation_skips_what_is_done_and_counts_errors(spark, records, questions):
    q = runs.routed(questions, records)

    def failing():
        def call(prompt):
            if "dividend" in prompt.rpartition("\n")[2]:
                raise RuntimeError("no answer")
            return prompt

        return call

    done = spark.createDataFrame([("vec", False), ("hr", True)], "cfg string, partial boolean")
    out = {r.cfg: r for r in runs.ablation(q, records, judging.overlap_judge, failing, ("vec", "hr_route"), done, tries=1).collect()}
    assert set(out) == {"hr_route"} and (out["hr_route"].n, out["hr_route"].errors, out["hr_route"].routed) == (4, 1, 2)
    assert out["hr_route"].evidence_n == 0 and out["hr_route"].evidence_hit is None
    with pytest.raises(ValueError):
        runs.ablation(q, records, judging.overlap_judge, configs=("vec",), done=done)


def test_answers_are_kept_and_failed_ones_asked_again(spark, records, questions, tmp_path):
    q = runs.routed(questions, records)
    store, log = f"{tmp_path}/answers", f"{tmp_path}/log"

    def generator(broken):
        def factory():
            def call(prompt):
                with open(log, "a") as f:
                    f.write(prompt.rpartition("\n")[2] + "\n")
                if broken and "dividend" in prompt.rpartition("\n")[2]:
                    raise OSError("down")
                return "answer"

            return call

        return factory

    first = runs.answered(q, records, "vec", generator(True), store=store, every=2, tries=1).collect()
    assert len(first) == 4 and sum(r.error for r in first) == 1
    second = runs.answered(q, records, "vec", generator(False), store=store, every=2, tries=1).collect()
    assert len(second) == 4 and not any(r.error for r in second)
    assert sorted(open(log).read().split("\n")).count("Question: dividend") == 2 and len(open(log).read().splitlines()) == 5


def test_one_question_with_its_seconds(spark, records):
    got = runs.asked(spark, records, "audit cost of C1", models.echo_generator(), models.hashing_embedder(), "hr", k=3)
    assert got["scope"] == "C1" and len(got["hits"]) == 3 and {h.company for h in got["hits"]} == {"C1"} and got["answer"] == "Question: audit cost of C1"
    assert got["total"] >= got["route"] + got["recall"] + got["rerank"] + got["generate"] - 1e-6 and got["recall"] > 0


def test_refusal_robustness_and_both_sides(spark, records, questions):
    q = runs.routed(questions, records).withColumn("type", F.when(F.col("qid") < 2, "a").otherwise("b")).withColumn("orig_judge", F.lit(1))
    no = lambda: lambda prompt: "There is no basis." if judging.GUARD in prompt else "It was 12."
    plain = {r.scope: r for r in runs.refusal(q, records, judging.phrase_triage, no).collect()}
    guarded = {r.scope: r for r in runs.refusal(q, records, judging.phrase_triage, no, guard=True).collect()}
    assert (plain["all"].n, plain["all"].n_H, guarded["all"].rate_R, guarded["b"].n) == (4, 4, 1.0, 2)
    p = runs.robustness(q, records, judging.overlap_judge, no).first()
    assert p.n == 4 and p.orig_acc == 1.0 and len(p.regressed) == round(4 * (1 - p.acc))
    two = runs.seen_and_unseen({"A": (q, records)}, judging.overlap_judge, models.echo_generator).first()
    assert two.side == "A" and two.ft == 1.0
    asked = spark.createDataFrame([("C1", "What was the profit of C1?")], "company string, question string")
    assert judging.rewritten(asked, models.echo_generator).first().company_kept


def test_question_sets_from_pages(spark):
    pages = spark.createDataFrame([(f"0{d}_60000{d}_公司{d}_x.pdf", p, "第一节 业务\n" + f"公司{d}第{p}页的业务说明，" * 9 + "到此结束。") for d in range(2) for p in range(3)], "doc_id string, page_no int, text string")
    chunks = runs.corpus(pages)
    r = runs.index(chunks)
    assert sorted(x.rec_id for x in r.collect()) == list(range(r.count())) and {x.company for x in r.collect()} == {"公司0", "公司1"}
    reply = lambda: lambda prompt: '[{"instruction": "q", "output": "a"}]' if "公司1" in prompt else 1 / 0
    pairs, status = runs.question_set(chunks, F.lit("x"), reply, tries=1)
    assert pairs.count() == status.where("error is null").count() > 0 and status.where("error like 'ZeroDivision%'").count() > 0


def test_reports(spark):
    rows = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 1)], "id long, a int, b int")
    p = evaluate.paired(rows, "id", "a", "b").first()
    assert (p.n, p.delta_pp, p.regressed, p.improved) == (3, 0.0, [1], [2])
    assert [r.running for r in evaluate.running_mean(rows, "a", "id").orderBy("id").collect()] == [1.0, 0.5, pytest.approx(2 / 3, abs=1e-6)]
    many = spark.createDataFrame([(k % 3, k, float(k % 7)) for k in range(400)], "g int, k int, v double")
    out = evaluate.running_mean(many, "v", "k", "g").collect()
    for r in out:
        own = [x % 7 for x in range(400) if x % 3 == r.g and x <= r.k]
        assert r.running == pytest.approx(sum(own) / len(own), abs=1e-6)
    none = evaluate.paired(rows.where("id = 3"), "id", "a", "b").first()
    assert (none.regressed, none.improved) == ([], [])
    with pytest.raises(Exception, match="too many flips"):
        evaluate.paired(rows, "id", "a", "b", most=1).collect()
    t = runs.timed(spark, {"count": lambda: rows.groupBy("a").count()}, repeats=2)
    assert t.count() == 2 and t.where("seconds > 0").count() == 2


def test_models():
    calls, waits = [], []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert models.with_retry(flaky, 3, 5.0, waits.append)("p") == "ok" and waits == [5.0, 10.0]
    with pytest.raises(OSError):
        models.with_retry(lambda: (_ for _ in ()).throw(OSError()), 2, 0.0, waits.append)()
    import io
    import json

    sent = []

    def opener(request, timeout):
        sent.append((json.loads(request.data), timeout))
        return io.BytesIO(json.dumps({"content": [{"text": "a"}, {"type": "other"}, "x", {"text": "b"}]}).encode())

    assert models.messages_service("http://x", "k", "m", opener=opener)("hi") == "ab"
    assert sent[0][1] == 60 and sent[0][0]["temperature"] == 0 and sent[0][0]["max_tokens"] == 1024
    with pytest.raises(ValueError):
        models.messages_service("", "k", "m")
    cut = models.bounded(lambda p: p, 4, str.split, " ".join, "~")
    assert cut("a b c d") == "a b c d" and cut("a b c d e f") == "a b~e f"
