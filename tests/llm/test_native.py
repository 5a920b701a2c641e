"""Sharding and mixing, the pipeline, and the registered queries."""

import random
from collections import Counter, defaultdict
from hashlib import md5

import pytest

from folioflow.llm import common, kd_shards, mixing, queries

DOCS = "doc_id long, text string, source string, size long, shard int"


def corpus(spark, n=3000, hot=0.3, seed=1):
    rng = random.Random(seed)
    rows = [(i, "same text" if rng.random() < hot else "w" * int(rng.paretovariate(1.3) * 20) + "\n" * rng.randint(0, 5) + rng.choice(["é", ""]) * rng.randint(0, 30), f"s{rng.randrange(7)}" if rng.random() < 0.6 else "hot", 0, 0) for i in range(n)]
    return rows, spark.createDataFrame(rows, DOCS)


def check_shards(rows, out, shards, tolerance):
    load, slots = defaultdict(int), defaultdict(list)
    for r in out:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert sum(load.values()) == sum(len((t or "").encode()) + 1 for _, t, *_ in rows)
    goal = sum(load.values()) / shards
    assert set(load) == set(range(shards)) and all(abs(x - goal) <= tolerance * goal for x in load.values()), load
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("shards", [8, 5, 1])
def test_shards_are_near_equal_and_keep_equal_texts_together(spark, shards):
    rows, df = corpus(spark, hot=0.05)
    rows = [r for r in rows if len(r[1]) < 5000]
    out = kd_shards.shard(spark.createDataFrame(rows, DOCS), shards).collect()
    check_shards(rows, out, shards, 0.05)
    text = {r[0]: r[1] for r in rows}
    where = defaultdict(set)
    for r in out:
        where[text[r.doc_id]].add(r.shard)
    assert all(len(x) == 1 for x in where.values())


def test_a_group_heavier_than_a_shard_is_divided(spark):
    rows = [(i, "x" * 100 if i % 2 else f"{i:05d}" * 20, None, 0, 0) for i in range(4000)]
    out = kd_shards.shard(spark.createDataFrame(rows, DOCS)).collect()
    check_shards(rows, out, 8, 0.05)


def test_shard_edges(spark):
    rows = [(None, None, None, None, None), (1, "", None, 0, 0), (1, "", None, 0, 0), (2, "x y", None, 0, 0)]
    out = kd_shards.shard(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(r.size for r in out) == [1, 1, 1, 4] and all(0 <= r.shard < 8 for r in out)
    assert kd_shards.shard(spark.createDataFrame([], DOCS)).collect() == []


def poured(sizes, weights=(3, 1, 2), total=1.5, most=2):
    """Step by step: give by weight, cut at the caps, share what is over."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    left, target, open_ = total * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while open_ and left > 1e-9:
        share = left / sum(w[s] for s in open_)
        full = {s for s in open_ if target[s] + share * w[s] >= most * sizes[s] - 1e-9}
        if not full:
            for s in open_:
                target[s] += share * w[s]
            break
        for s in full:
            left -= most * sizes[s] - target[s]
            target[s] = most * sizes[s]
        open_ -= full
    return target


@pytest.mark.parametrize("seed", range(3))
def test_mix_meets_its_targets(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 40))), rng.choice(["a", "b", "c", "é", None, "hot", "hot", "hot"]), 0, 0) for i in range(800)]
    df = spark.createDataFrame(rows, DOCS)
    out = mixing.mixed(df).collect()
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in out:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    want = poured(size)
    for s in size:
        assert target[s] == pytest.approx(want[s], abs=1e-6) and taken[s] == int(target[s] + 1e-9)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mixed(df.repartition(7)).collect()))
    whole = mixing.mixed(df, split_last=False).collect()
    assert all(r.taken in (0, r.size, 2 * r.size) for r in whole)
    assert mixing.mix(df).columns == df.columns and mixing.mix(df).count() == sum(r.taken // r.size for r in whole if r.size)


def test_mix_edges(spark):
    rows = [(None, None, None, None, None), (1, "", "a", 0, 0), (2, "x y", "b", 0, 0), (2, "x y", "b", 0, 0)]
    out = mixing.mixed(spark.createDataFrame(rows, DOCS)).collect()
    assert len(out) == 4 and sum(r.taken for r in out) == 6
    assert mixing.mixed(spark.createDataFrame([], DOCS)).collect() == [] == mixing.mix(spark.createDataFrame([], DOCS)).collect()


def test_rows_without_ids_are_mixed_one_by_one(spark):
    rows = [(None, f"{k} b c d", "a", 0, 0) for k in range(60)] + [(7, f"{k} b c d", "b", 0, 0) for k in range(60)]
    df = spark.createDataFrame(rows, DOCS)
    plan = mixing.mixed(df, split_last=False, max_epochs=3).collect()
    out = mixing.mix(df, max_epochs=3).collect()
    for s in "ab":
        target = next(r.target for r in plan if r.source == s)
        assert abs(4 * sum(r.source == s for r in out) - target) <= 4


def test_ranked_is_a_running_sum(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice("aab"), rng.random(), rng.randrange(9)) for k in range(500)]
    out = common.ranked(spark.createDataFrame(rows, "id long, g string, u double, n long"), ["g"], "u", ["id"], {"before": "n"}, 500).collect()
    for g in "ab":
        at = 0
        for r in sorted((r for r in out if r.g == g), key=lambda r: (r.u, r.id)):
            assert r.before == at
            at += r.n


def test_native_operators_run_no_python(spark, sf_dir):
    for q in (queries.op6_kd_shards, queries.op8_mix_sources):
        plan = q(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def plain_mix(rows):
    """How often each of ``rows (doc_id, text, source)`` is taken, whole documents only."""
    size = {r.doc_id: len([w for w in (r.text or "").replace("\n", " ").replace("\t", " ").split(" ") if w]) for r in rows}
    per = defaultdict(int)
    for r in rows:
        per[r.source] += size[r.doc_id]
    target, out = poured(per), {}
    for source in per:
        at, n = 0, int(target[source] / per[source] + 1e-12) if per[source] else 0
        for r in sorted((r for r in rows if r.source == source), key=lambda r: (int(md5(f"mix {r.doc_id}".encode()).hexdigest()[:13], 16), r.doc_id)):
            part = max(0, min(int(target[source]) - n * per[source] - at, size[r.doc_id]))
            out[r.doc_id] = (n + (2 * part > size[r.doc_id])) * (size[r.doc_id] > 0)
            at += size[r.doc_id]
    return out


def test_each_stage_of_the_pipeline_against_a_plain_version(spark, sf_dir):
    import corpus_pipeline as p

    from . import test_pairs as pairs
    from . import test_texts as texts

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(10**6, None, "en", "src1", 0), (10**6 + 1, "12 34", None, None, 0)], docs.schema))
    columns, seen = docs.columns, [docs.collect()]
    for k, (name, stage) in enumerate(p.STAGES):
        docs = common.written(stage(spark, docs, sf_dir), name)
        assert (docs.columns == columns) == (k < len(p.STAGES) - 1)
        seen.append(docs.collect())
    ids = [[r.doc_id for r in rows] for rows in seen]
    # language: here every document with letters is of a language
    assert sorted(ids[1]) == sorted(r.doc_id for r in seen[0] if any(map(str.isalpha, r.text or "")))
    # near copies: all pairs
    rows = [(r.doc_id, r.text) for r in seen[1]]
    prints = [(i, pairs.plain_fingerprint(t)) for i, t in rows]
    near = pairs.alike(rows) + [(a, b) for k, (a, x) in enumerate(prints) for b, y in prints[:k] if bin(x ^ y).count("1") <= 2]
    assert sorted(ids[2]) == sorted(set(pairs.closure([i for i, _ in rows], near).values()))
    # benchmark: items but for two words at either end
    words = lambda t: " ".join(w for x in t.lower().split() if (w := x.strip(".,;:!?*")))
    items = [" ".join(words(r.text).split()[2:-2]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert sorted(ids[3]) == sorted(r.doc_id for r in seen[2] if not any(x in words(r.text) for x in items)) and len(ids[3]) < len(ids[2])
    assert Counter(ids[4]) == Counter({i: n for i, n in plain_mix(seen[3]).items() if n})
    lib, at = texts.token_files.encoder(texts.token_files.TOKENIZER), 0
    text = {r.doc_id: r.text for r in seen[3]}
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in seen[5])
    for (i, start, n, crc), want in zip(got, sorted(ids[4])):
        each = [*lib.library(text[want]).tolist(), 2]
        assert (i, start, n, crc) == (want, at, len(each), texts.zlib.crc32(texts.np.array(each, "<u4").tobytes()))
        at += n
    assert len(got) == len(ids[4]) and sorted(map(tuple, p.run(spark, sf_dir).select("doc_id", "n_tokens", "ids_crc32").collect())) == sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in seen[5])


def test_stages_keep_columns_of_any_name(spark):
    import corpus_pipeline as p

    names = ["row", "row_", "ROW", "copy", "times", "taken", "size", "target", "source_size", "__id", "__row", "__copy", "__source", "__draw", "k", "code", "share", "fp", "s"]
    names = [n for k, n in enumerate(names) if n.lower() not in [x.lower() for x in names[:k]]]
    words = [f"w{i}" for i in range(40)]
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choices(words, k=60)) if k % 9 else None, "en", "ab"[k % 2], k, *(f"{n}{k}" for n in names)) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    for name, stage in p.STAGES[:-1]:
        if name == "benchmark_decontamination":
            stage = lambda spark, d, _: p.decontaminate.cleaned(d, spark.createDataFrame([(1, "an item of the benchmark that no document holds")], "item_id long, text string"))
        docs = common.written(stage(spark, docs, None), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *names]
        got = docs.collect()
        assert got and all(r[n] == f"{n}{r.doc_id}" for r in got for n in names)
    assert p.token_files.round_trip(docs).count() == len(got)
    few = docs.limit(0)
    for stage in (p.language.accepted, p.simhash.keep_first, p.mixing.mix):
        assert stage(few).collect() == [] and stage(few).columns == docs.columns


def test_splits_follow_the_widest_dimension_at_the_weighted_median(spark):
    rng = random.Random(5)
    rows = [(k, f"{k}" + "y" * rng.randint(1, 40) + "\n" * rng.randint(0, 3)) for k in range(4000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "octet_length(text) + 1L as size", "0 as wide", "length(text) - length(replace(text, '\n', '')) as lines", "xxhash64(text) as group")
    d = d.withColumn("tie", common.fraction("group")).cache()
    paths = dict((n, t) for t, n in kd_shards.tree(d, ["size", "wide", "lines"], {k: 1.0 for k in range(4)}))
    points = [({"size": r["size"] + r.tie, "wide": r.wide + r.tie, "lines": r.lines + r.tie}, r["size"]) for r in d.collect()]
    whole = {x: (min(p[x] for p, _ in points), max(p[x] for p, _ in points)) for x in ("size", "wide", "lines")}

    def widest(own):
        return max(("size", "wide", "lines"), key=lambda x: (max(p[x] for p, _ in own) - min(p[x] for p, _ in own)) / (whole[x][1] - whole[x][0]))

    for test in paths.values():
        for depth in range(len(test)):
            own = [p for p in points if all((p[0][x] < c) == left for x, c, left in test[:depth])]
            dim, cut, _ = test[depth]
            assert dim == widest(own)
            left = sum(w for p, w in own if p[dim] < cut)
            assert abs(left - sum(w for _, w in own) / 2) <= 50 + kd_shards.TOLERANCE * 2 * sum(w for _, w in own)  # within a document or two of the median
    assert len(paths) == 4


def test_very_long_texts(spark):
    rows = [(1, "word " * 1_000_000, "a"), (2, "word " * 10, "a"), (3, None, "b"), (4, "\n" * 100_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.doc_id: r.size for r in kd_shards.shard(docs, 2).collect()} == {1: 5_000_001, 2: 51, 3: 1, 4: 100_001}
    assert {r.doc_id: r.size for r in mixing.mixed(docs).collect()} == {1: 1_000_000, 2: 10, 3: 0, 4: 0}


def test_queries_are_registered_once_each():
    names = sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))
    assert set(queries.ORACLE) <= set(names)
