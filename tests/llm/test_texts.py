"""Operators on single texts: tokens, language, licenses, lines, benchmark items."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from folioflow.llm import bpe_count, decontaminate, language, licenses, line_dedup, token_files

DOCS = "doc_id long, text string, lang string"
ODD = [None, "", " ", "   a   b", "a" * 4000, "<s> </s> <unk> <0x0A> <|endoftext|>x", "x\u0085y\x1cz", "it's he'll don't!!", "漢字 émoji 🎉▁", "\r\n\t a.\n\nb", "İstanbul ΑΣ Σ ẞ K µ", "word*** WORD.!! 12,5 x_y", "é ́", "\x00"]


@pytest.fixture(scope="module")
def fuzz(sf_dir):
    import pyarrow.parquet as pq

    rng = random.Random(2)
    alphabet = "ab<s>/ un\n\t▁  éÉß漢🎉0x1A,.̀\x00'ingtheERN\r!"
    return ODD + ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(1500)] + pq.read_table(f"{sf_dir}/documents.parquet")["text"].to_pylist()


def test_counts_are_the_library_counts(fuzz):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(bpe_count.MODEL))
    count = bpe_count.counter(bpe_count.MODEL).count
    assert [count(x or "") for x in fuzz] == [len(model.encode(x or "")) for x in fuzz]


def test_merging_takes_the_lowest_rank_then_the_leftmost():
    ranks = {"ab": 2.0, "bc": 1.0, "aa": 0.0, "aab": 5.0}
    assert bpe_count.merges(ranks, "abc") == ["a", "bc"]
    assert bpe_count.merges(ranks, "aaab") == ["aa", "ab"]
    assert bpe_count.merges(ranks, "") == [] and bpe_count.merges(ranks, "z") == ["z"]


def test_token_counts_rows(spark):
    out = bpe_count.token_counts(spark.createDataFrame([(1, None, ""), (1, None, ""), (None, "é x", "")], DOCS), limit=2).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in out)[:2] == [("1", 0, 0, False)] * 2
    assert [r.n_bytes for r in out if r.doc_id is None] == [4]
    assert bpe_count.token_counts(spark.createDataFrame([], DOCS)).collect() == []


def test_ids_are_the_library_ids(fuzz):
    w = token_files.WordEncoder(public_tokenizers.path(token_files.TOKENIZER))
    for part in (fuzz, fuzz[:50], fuzz[::-1]):
        flat, n = w.encode(pa.array(part, pa.string()), 2)
        ends = np.cumsum(n)
        assert all(flat[e - k : e].tolist() == [*w.library(x or ""), 2] for x, k, e in zip(part, n, ends))


def test_caches_that_overflow_change_nothing(fuzz, monkeypatch):
    monkeypatch.setattr(token_files, "CACHE", 50)
    monkeypatch.setattr(bpe_count, "CACHE", 20)
    w = token_files.WordEncoder(public_tokenizers.path(token_files.TOKENIZER))
    for at in range(0, len(fuzz), 300):
        part = fuzz[at : at + 300]
        flat, n = w.encode(pa.array(part, pa.string()), 2)
        assert flat.tolist() == [t for x in part for t in [*w.library(x or ""), 2]]
    a, b = bpe_count.PieceCounter(public_tokenizers.path(bpe_count.MODEL)), bpe_count.counter(bpe_count.MODEL)
    assert [a.count(x or "") for x in fuzz] == [b.count(x or "") for x in fuzz]


def test_token_files_round_trip_and_selective_reads(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(60)
    docs = docs.unionByName(spark.createDataFrame([(10**6, None), (10**6, None), (10**6 + 1, "")], "doc_id long, text string"))
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    lib, at, want = token_files.encoder(token_files.TOKENIZER), 0, []
    for r in rows:
        ids = np.array([*lib.library(r.text or ""), 2], "<u4")
        want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = [tuple(r) for r in token_files.round_trip(docs).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got) == sorted(want)
    token_files.write_tokens(docs, f"{tmp_path}/t")
    some = token_files.read_tokens(spark, f"{tmp_path}/t").where("doc_id = 1000001").select("doc_id", "n_tokens")
    assert "ids" not in some._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    assert [r.n_tokens for r in some.collect()] == [1]
    assert token_files.round_trip(docs.limit(0)).collect() == []


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    p = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(p) > 100 and sum(r.lang == r.lang_pred for r in p) / len(p) > 0.97
    assert all(0 <= r.score <= 1 for r in p)
    assert language.accepted(docs).count() > 0.99 * docs.count()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in p)


def test_language_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 !?", "en"), (None, "some words here", None), (4, "some words here", "en")]
    rows += [(10 + k, x, None) for k, x in enumerate(["\u00b2 \u00bd", "\u2167", "\u2460", "_ 7"])]
    out = language.identify(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.doc_id: r.lang_pred for r in out if r.doc_id in (1, 2, 3, 10, 11, 12, 13)} == dict.fromkeys((1, 2, 3, 10, 11, 12, 13), "und") and all(r.score == 0 for r in out if r.lang_pred == "und")
    assert {(r.lang_pred, r.score) for r in out if r.doc_id in (None, 4)} == {("en", 0.0)}  # too few documents to learn from: the only language
    unlabelled = language.identify(spark.createDataFrame([(1, "words", None)], DOCS)).collect()
    assert unlabelled[0].lang_pred == "und"
    assert language.identify(spark.createDataFrame([], DOCS)).collect() == []


def test_filter_returns_all_languages_and_few_others(spark):
    sets = [np.arange(k * 1000, k * 1000 + 5000, dtype=np.int64) * 7919 for k in range(3)]
    members = spark.createDataFrame([(k, int(x)) for k, codes in enumerate(sets) for x in codes], "k int, gram long")
    m = language.Model(["a", "b", "c"], language._words(members, 3, 17), "a")
    for k, codes in enumerate(sets):
        assert ((m.slices(codes.view(np.uint64))[0] >> np.uint64(k)) & np.uint64(1)).all()
    rest = np.arange(10**6, 10**6 + 5000, dtype=np.uint64) * np.uint64(104729)
    assert (m.slices(rest)[0] > 0).mean() < 0.02
    assert m.counts(rest).tolist() == [int(((m.slices(rest)[0] >> np.uint64(k)) & np.uint64(1)).sum()) for k in range(3)]


def plain_grams(text):
    letters = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    for word in letters.split():
        word = f" {word} "
        for n in (2, 3, 4):
            yield from (word[i : i + n] for i in range(len(word) - n + 1))


def test_predictions_against_plain_sets_of_ngrams(spark, sf_dir):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + [(None, "only a few words of no language whatever", None)]
    own, n = {}, {}
    for text, lang in {(t, x) for i, t, x in rows if x and t and zlib.crc32(str(i).encode()) % 4 != 2}:
        n[lang] = n.get(lang, 0) + 1
        for g in set(plain_grams(text)):
            own.setdefault(g, {}).setdefault(lang, 0)
            own[g][lang] += 1
    member = {g: {x for x, c in each.items() if c >= language.MIN_DOCS and c / n[x] >= language.SHARE * max(k / n[y] for y, k in each.items())} for g, each in own.items()}
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, DOCS)).collect()}
    for i, text, _ in rows:
        every = list(plain_grams(text))
        hits = {x: sum(x in member.get(g, ()) for g in every) for x in sorted(n)}
        best = max(hits.values(), default=0)
        if not every:
            assert got[i].lang_pred == "und"
            continue
        assert hits[got[i].lang_pred] >= best - 0.01 * len(every), i  # but for false positives beyond what is expected
        assert abs(got[i].score - hits[got[i].lang_pred] / len(every)) < 0.05, i


def test_blocks_give_the_ngrams_of_the_whole(monkeypatch):
    text = "Some words, and\nmore of them: \u00e4\u00f6 \u4e2d\u6587 x y zz " * 5
    whole = np.sort(np.concatenate(list(language.grams(text))))
    assert len(whole) == len(list(plain_grams(text)))
    monkeypatch.setattr(language, "BLOCK", 7)
    assert np.sort(np.concatenate(list(language.grams(text)))).tolist() == whole.tolist()


def invented(rng, letters, n):
    return " ".join("".join(rng.choices(letters, k=rng.randint(3, 7))) for _ in range(n))


def test_more_than_64_languages_are_all_learned(spark):
    rng = random.Random(6)
    names = [f"l{k:02}" for k in range(70)]
    letters = {x: "".join(chr(0x4E00 + 20 * k + i) for i in range(6)) for k, x in enumerate(names)}
    rows = [(70 * i + k, invented(rng, letters[x], 30), x) for i in range(6) for k, x in enumerate(names)]
    model = language.train(spark.createDataFrame(rows, DOCS))
    assert model.languages == names and model.slots.shape[0] == 2
    for x in names:
        assert model.predict(invented(rng, letters[x], 30))[0] == x


def test_documents_stay_among_labels_that_are_alike(spark):
    rng = random.Random(8)
    words = [invented(rng, "abcdefgh", 1) for _ in range(60)]
    text = lambda: " ".join(rng.choices(words, k=40))
    rows = [(i, text(), f"en-{i % 5}") for i in range(200)] + [(200, "zyx wvu zzyw xxuv " * 9, None), (201, "1 2 3", None)]
    assert sorted(r.doc_id for r in language.accepted(spark.createDataFrame(rows, DOCS)).collect()) == list(range(200))
    bare = spark.createDataFrame([(1, "some words", None), (2, "12", None), (3, None, None)], DOCS)
    assert [r.doc_id for r in language.accepted(bare).collect()] == [1]


def plain_patience(a, b):
    """The numbers of words that patience alignment may align, whichever longest subsequence of anchors it takes."""
    if not a or not b:
        return {0}
    if a[0] == b[0]:
        return {1 + n for n in plain_patience(a[1:], b[1:])}
    if a[-1] == b[-1]:
        return {1 + n for n in plain_patience(a[:-1], b[:-1])}
    anchors = [(i, b.index(w)) for i, w in enumerate(a) if a.count(w) == 1 == b.count(w)]
    chosen = [[]]
    for x in anchors:
        chosen += [c + [x] for c in chosen if not c or c[-1][1] < x[1]]
    longest = max(map(len, chosen))
    if not longest:
        return {0}
    out = set()
    for c in chosen:
        if len(c) == longest:
            sums, i, j = {longest}, 0, 0
            for x, y in [*c, (len(a), len(b))]:
                sums = {s + n for s in sums for n in plain_patience(a[i:x], b[j:y])}
                i, j = x + 1, y + 1
            out |= sums
    return out


def test_patience_alignment():
    a, b = "x the quick brown fox the end y".split(), "the quick red fox the end".split()
    pairs = licenses.align(a, b)
    assert [(a[i], b[j]) for i, j in pairs] == [(w, w) for w in ("the", "quick", "fox", "the", "end")]
    rng = random.Random(4)
    for _ in range(600):
        a, b = ([rng.choice("abcdefghij") for _ in range(rng.randint(0, 10))] for _ in range(2))
        p = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in p) and all(x < y and u < v for (x, u), (y, v) in zip(p, p[1:]))
        assert len(p) in plain_patience(a, b)


def test_coverage_against_a_plain_scan(spark):
    rng = random.Random(9)
    scanner = licenses.Scanner({"L": ["alpha beta gamma delta epsilon zeta eta theta iota kappa"]})
    template = licenses.words("alpha beta gamma delta epsilon zeta eta theta iota kappa")
    for _ in range(200):
        own = list(template)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(10)] = rng.choice(["x", "alpha", "kappa"])
        text = ["pre"] * rng.randint(0, 5) + own + ["post"] * rng.randint(0, 5)
        got = scanner.scan(pa.array([" ".join(text)]))[0]
        # what patience alignment of the stretches that begin with a word of the template may give
        each = [plain_patience(text[i : i + 34], template) for i, w in enumerate(text) if w in template]
        if got:
            assert any(round(got[0][1] * 10) in n for n in each), (text, got)
        else:
            assert all(min(n) < 8 for n in each), text


def test_licenses_found_and_clean_texts_left(spark):
    rows = [(1, "intro text\nReleased under the MIT License.\nmore", None), (2, "Licensed under the apache license - Version 2.0", None), (3, "no licence at all in this text under the sun", None), (4, None, None), (5, "", None), (5, "", None)]
    rows += [(6, "word " * 5000 + licenses.TEMPLATES["MIT"][2] + " end", None), (7, "This work is licensed under CC BY-NC 4.0.", None)]
    out = {r.doc_id: r for r in licenses.licenses(spark.createDataFrame(rows, DOCS)).collect()}
    assert {k: r.license for k, r in out.items()} == {1: "MIT", 2: "Apache-2.0", 3: None, 4: None, 5: None, 6: "MIT", 7: "CC-BY-NC-4.0"}
    assert (out[6].first_word, out[6].coverage) == (5000, 1.0) and out[1].first_word == 2
    assert licenses.licenses(spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize("text, name", [
    ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"), ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
    ("This work is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"), ("Licensed under the GNU Lesser General Public License, version 2.1", "LGPL-2.1"),
    ("This library is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"), ("This work is licensed under the GNU General Public License, version 1.", None),
    ("Licensed under the BSD 2-Clause License.", "BSD-2-Clause"), ("Licensed under the BSD 3-Clause License.", "BSD-3-Clause"), ("Licensed under the BSD 4-Clause License.", None),
    ("Licensed under CC BY-ND 4.0.", "CC-BY-ND-4.0"), ("Licensed under CC BY 3.0.", "CC-BY-3.0"), ("Licensed under CC BY 2.5.", None), ("Licensed under CC BY 4.0.", "CC-BY-4.0"),
    ("This work is licensed under a Creative Commons Attribution Non-Commercial 4.0 International License.", None), ("Licensed under the ISC License.", "ISC"),
    ("Licensed under the Apache License.", None), ("released under the new license", None), ("Licensed under the Apache-2.0 License", "Apache-2.0"), ("All rights reserved.", "proprietary"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.", None),
    ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY THE AUTHORS", "BSD-2-Clause"),
    ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n3. Neither the name of the Some University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE IS PROVIDED BY THE AUTHORS", "BSD-3-Clause"),
])
def test_the_words_that_name_a_license_decide(text, name):
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for t in (text, f"some words first\n{text}\nother words then"):
        assert [x[0] for x in scanner.scan(pa.array([t]))[0]] == ([name] if name else [])


def test_every_notice_is_found_under_its_own_name():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name, each in licenses.TEMPLATES.items():
        for t in each:
            assert scanner.scan(pa.array([t]))[0][0][:2] == (name, 1.0), t


def plain_lines(texts, least):
    from collections import Counter
    from hashlib import sha256

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(lower)
    n = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) and n[key(x)] >= least)]
        out.append((len(lines), len(lines) - len(kept), sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("bounds", [{}, {"exact_bytes": 64}, {"filter_bytes": 0, "exact_bytes": 0}, {"filter_bytes": 0, "salts": 1}])
def test_lines_against_a_plain_count(spark, sf_dir, bounds):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()] + [None, "", "\n\n", " Same \r\nother", "same\n\x0bSAME\x0c", "ÄB\näb"] * 4
    texts += ["hot line\n" * 500 + f"tail {k}" for k in range(40)] + ["x " * 300_000 + "\nsame"]
    df = spark.createDataFrame([(k, t, k, "x") for k, t in enumerate(texts)], "doc_id long, text string, n_lines long, row string")
    got = line_dedup.line_digests(df, min_docs=4, **bounds).collect()
    assert sorted((r.n_lines, r.n_dropped, r.kept_sha256) for r in got) == plain_lines(texts, 4)


def test_beyond_the_broadcast_bounds_lines_pass_the_filters(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"common\nline {k}") for k in range(30)], "doc_id long, text string")
    state = line_dedup.started(docs, min_docs=10)
    lines = line_dedup._sifted(docs.selectExpr("md5(cast(doc_id as string)) as row", "text"), state, 4).collect()
    assert len(lines) == 30 and {r.line for r in lines} == {0}  # what is not frequent has gone before any join


def test_state_follows_insertions_and_deletions(spark):
    rng = random.Random(12)
    frame = lambda texts: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    text = lambda: "\n".join(f"l{int(rng.paretovariate(0.7)) % 400}" for _ in range(20))
    a, b, c = ([text() for _ in range(n)] for n in (60, 80, 30))
    state = line_dedup.started(frame(a), min_docs=4, shards=3)
    counts = lambda s: sorted(map(tuple, s.counts.collect()))
    for step, texts in (("insert", b), ("delete", a), ("insert", c), ("delete", b)):
        state = getattr(line_dedup, step)(state, frame(texts))
    fresh = line_dedup.started(frame(c), min_docs=4, shards=3)
    assert counts(state) == counts(fresh)
    front = line_dedup.Sharded({r.shard: bytes(r.slots) for r in state.filters.collect()}, 3)
    assert front.maybe(np.array(state.frequent.collect(), np.int64).view(np.uint64)).all()
    assert sum(int((f.slots > 0).sum()) for f in front.filters.values()) == state.frequent.count()
    got = line_dedup.clean(frame(c), state).select("n_lines", "n_dropped", line_dedup.F.sha2("text", 256)).collect()
    assert sorted(map(tuple, got)) == plain_lines(c, 4)
    assert line_dedup.line_digests(frame(a).limit(0)).collect() == []


def test_cuckoo_filter_inserts_finds_and_deletes():
    digests = lambda names: line_dedup._halves(line_dedup.xxh3_128_digest(str(k).encode()) for k in names)
    d, others = digests(range(3000)), digests(f"n{k}" for k in range(3000))
    f = line_dedup.build_filter(d)
    assert f.maybe(d).all() and f.maybe(others).sum() < 15
    one = line_dedup.CuckooFilter(3000)
    for k in range(0, 3000, 7):
        one.insert(d[k : k + 7])
    assert one.maybe(d).all() and (one.slots > 0).sum() == 3000
    assert f.delete(d) == 3000 and not f.slots.any() and f.delete(d[:1]) == 0
    small = line_dedup.CuckooFilter(4)
    with pytest.raises(OverflowError):
        small.insert(d)


ITEM = "If Mary has 12 apples and later gives Peter 5 kg of them, how many apples does Mary keep today?"


@pytest.mark.parametrize("text, found", [
    (f"before {ITEM} after", True), (ITEM.lower(), True), (ITEM.upper(), True), ("Paris London Rome Berlin 42 7", False), (ITEM.replace("Mary", "Anna").replace("12", "30"), True), ("quite other words " * 30, False), (None, False), ("", False),
    (ITEM[:40], False), (ITEM.replace("12 apples", "12 apples or pears"), False),  # neither 0.8 of the windows nor 13 words on end
])
def test_items_with_other_parameters(spark, text, found):
    b = spark.createDataFrame([(1, ITEM), (2, "too short"), (3, None)], "item_id long, text string")
    d = spark.createDataFrame([(7, text, "x")], DOCS)
    out = decontaminate.contaminated(d, b).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, decontaminate.contaminated(d, b, 0).collect()))
    assert [r.doc_id for r in out] == ([7] if found else [])
    assert decontaminate.cleaned(d, b).count() == (0 if found else 1)


@pytest.mark.parametrize("block", [1 << 24, 0])
def test_short_and_shared_items(spark, block):
    start = "Read the passage below with care and then give the one best answer to it"
    items = [(1, "E equals mc2"), (2, "Who wrote it?"), (3, "yes"), (None, "E equals mc2"), *((k, f"{start} {' '.join(f'w{k}x{j}' for j in range(20))}") for k in range(10, 40))]
    docs = [(1, "so e equals mc2, they say", 0), (1, "so e equals mc2, they say", 0), (2, "e equals mc", 0), (None, "Who wrote it", 0), (3, items[8][1].upper(), 0), (4, " ".join(start.split()[:11]), 0), (5, "YES!", 0), (6, None, 0), (7, "", 0)]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string, row int"), spark.createDataFrame(items, "item_id long, text string"), block).collect()
    pairs = sorted(((r.doc_id, r.item_id) for r in got if r.doc_id != 3), key=str)
    assert pairs == sorted([(1, 1), (1, 1), (1, None), (1, None), (None, 2), (5, 3)], key=str)
    assert {r.item_id for r in got if r.doc_id == 3 and r.coverage == 1.0} == {items[8][0]}
    kept = decontaminate.cleaned(spark.createDataFrame(docs, "doc_id long, text string, row int"), spark.createDataFrame(items, "item_id long, text string"), block)
    assert kept.columns == ["doc_id", "text", "row"] and sorted(r.doc_id for r in kept.collect()) == [2, 4, 6, 7]


def test_windows_of_very_long_texts(spark):
    text = "filler words of all kinds here " * 200_000 + ITEM
    b, d = spark.createDataFrame([(1, ITEM)], "item_id long, text string"), spark.createDataFrame([(7, text, "x"), (8, "short", "x")], DOCS)
    assert [tuple(r)[:3] for r in decontaminate.contaminated(d, b).collect()] == [(7, 1, 1.0)]
    assert licenses.licenses(d).where("license is not null").count() == 0
    assert [r.n_bytes for r in bpe_count.token_counts(d.where("doc_id = 7")).collect()] == [len(text)]
    assert language.identify(d).count() == 2


def test_an_item_of_placeholders_is_found_as_it_is():
    item = "Visit Paris London Rome Berlin 42 7 Oslo"
    index = decontaminate.Index([1], [item])
    assert [x[2] for x in index.hits(decontaminate.Words(pa.array([f"so {item.lower()} then"])))] == [1.0]
    assert index.hits(decontaminate.Words(pa.array(["Visit Vienna Madrid Lisbon Athens 3 9 Riga"]))) == []


def test_slots_must_map_one_to_one():
    words = decontaminate.Words
    index = decontaminate.Index([1], [ITEM])
    same = ITEM.replace("Mary", "Anna")
    mixed = "If Anna has 12 apples and later gives Peter 5 kg of them, how many apples does Zoe keep today?"
    a = index.hits(words(pa.array([same])))
    b = index.hits(words(pa.array([mixed])))
    assert a[0][2] == 1.0 and (not b or b[0][2] < 1.0)


def test_two_slots_may_hold_one_value():
    item = "add the 3 red ones to the 5 blue ones then count all of them now"
    index = decontaminate.Index([1], [item])
    got = index.hits(decontaminate.Words(pa.array([item.replace("3", "4").replace("5", "4")])))
    assert [x[2] for x in got] == [1.0]


def test_every_planted_item_is_found_and_nothing_else(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    words = lambda t: " ".join(w for x in t.lower().split() if (w := x.strip(".,;:!?*")))
    want = {(d, i) for d, t in docs for i, x in items.items() if " ".join(words(x).split()[2:-2]) in words(t)}
    df, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    for block in (1 << 24, 0):
        got = decontaminate.contaminated(df, b, block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want
        assert decontaminate.cleaned(df, b, block).count() == len(docs) - len({d for d, _ in want})
    assert decontaminate.contaminated(df, b.limit(0)).collect() == [] == decontaminate.contaminated(df.limit(0), b).collect()
