"""Near-duplicate operators against all pairs."""

import random

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from folioflow.llm import common, embeddings, jaccard, simhash

DOCS = "doc_id long, text string, extra string"


def closure(ids, linked):
    """Smallest id reachable of each."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = low.replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_masks_cover_every_pair_within_the_radius():
    m = simhash.masks()
    assert len(m) == 7
    for i in range(64):
        for j in range(64):
            assert any(not (x >> i & 1) and not (x >> j & 1) for x in m)


def test_spark_hash_is_the_library_hash(spark):
    assert spark.sql("select xxhash64('to be or')").first()[0] == simhash.signed(xxh64_intdigest(b"to be or", 42))


def test_fingerprints_follow_the_definition():
    for t in (None, "", "one", "One TWO", "a b c", "a b c d\te f\n\na b c Ünder É", "x " * 5000):
        assert simhash.fingerprint(t) == plain_fingerprint(t), t


@pytest.mark.parametrize("small", [32, 1])
def test_links_reach_what_all_pairs_reach(spark, small):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(20)]
    prints = set(base)
    for b in base[:4]:  # dense groups, chains of two-bit steps
        x = b
        for _ in range(40):
            x ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            prints.add(x)
            prints.add(b ^ (1 << rng.randrange(64)))
    prints = [simhash.signed(x) for x in prints]
    edges = simhash.links(spark.createDataFrame([(x,) for x in prints], "fp long"), small)
    got = closure(prints, [(r.u, r.v) for r in edges.collect()])
    near = [(a, b) for k, a in enumerate(prints) for b in prints[:k] if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2]
    assert got == closure(prints, near)


def test_near_duplicates_with_nulls_repeats_and_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(5, "a b c d", "x"), (3, "A b C d", "y"), (3, "A b C d", "y"), (9, None, None), (8, "", "z"), (None, "a b c d", ""), (1, long, ""), (2, long + " tail", "")]
    out = simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert (by[5].component_id, by[None].component_id, by[9].component_id) == (3, 3, 8)
    assert by[8].fingerprint == "0" * 16 and by[1].component_id == by[2].component_id == 1
    kept = simhash.keep_first(spark.createDataFrame(rows, DOCS))
    assert kept.columns == ["doc_id", "text", "extra"] and sorted(r.doc_id for r in kept.collect()) == [1, 3, 8]
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def test_a_hot_group_and_the_sample_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in docs] + [(10_000 + i, "the same text for all of them") for i in range(len(docs) // 2)]
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    prints = {i: simhash.fingerprint(t) for i, t in rows}
    assert {r.doc_id: int(r.fingerprint, 16) for r in out} == prints
    first = {}
    for i, f in prints.items():
        first[f] = min(i, first.get(f, i))
    fps = list(first)
    near = [(first[a], first[b]) for k, a in enumerate(fps) for b in fps[:k] if bin(a ^ b).count("1") <= 2]
    assert {r.doc_id: r.component_id for r in out} == closure(prints, near + [(i, first[f]) for i, f in prints.items()])


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200)] + [(7, 7)]
    random.Random(1).shuffle(edges)
    got = common.components(spark.createDataFrame(edges, "u long, v long")).collect()
    ids = {x for e in edges for x in e}
    want = closure(ids, edges)
    groups = {}
    for r in got:
        groups.setdefault(r.root, set()).add(r.node)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(i for i in ids if want[i] == k) for k in set(want.values()))
    assert common.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(3)
    a = rng.standard_normal((300, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    code, factor = embeddings.codes_of(a)
    est, bound = embeddings.estimates(code, factor, a @ embeddings.rotation(64, 0)), embeddings.bounds(factor, 64)
    err = (est - a @ a.T)[~np.eye(300, dtype=bool)]
    assert (np.abs(est - a @ a.T) <= bound[:, None] + 1e-5).mean() > 0.9999
    assert abs(err.mean()) < 0.003 and np.abs(err).max() < embeddings.SURE / 8
    other, step = embeddings.rounded(a)
    rough = embeddings.estimates(code, factor, other * step[:, None])
    assert (np.abs(rough - est) <= 4 * step[None, :] / factor[:, None] + 1e-6).all()


def planted(rng, labels, size, dim, pairs, crowd):
    """Unit vectors of several labels (in one direction's neighbourhood if ``crowd``) with pairs of cosine 0.9801 planted."""
    v = []
    for _ in range(labels):
        centre = crowd * rng.standard_normal(dim) / np.sqrt(dim)
        own = centre + rng.standard_normal((size, dim)) / np.sqrt(dim)
        own /= np.linalg.norm(own, axis=1, keepdims=True)
        away = rng.standard_normal((pairs, dim))
        away -= (away * own[:pairs]).sum(axis=1, keepdims=True) * own[:pairs]
        away /= np.linalg.norm(away, axis=1, keepdims=True)
        own[-pairs:] = 0.9801 * own[:pairs] + np.sqrt(1 - 0.9801**2) * away
        v.append(own)
    return np.concatenate(v)


@pytest.mark.parametrize("dim, crowd", [(16, 0), (64, 0), (64, 1.5), (256, 0)])
def test_recall_of_pairs_just_over_the_threshold(spark, dim, crowd):
    labels, size, pairs = 2, 5000, 1000
    v = planted(np.random.default_rng([dim, int(crowd * 2)]), labels, size, dim, pairs, crowd)
    rows = [(k, x.tolist(), k // size) for k, x in enumerate(v)]
    out = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    found = wanted = 0
    for label in range(labels):
        own = v[label * size : (label + 1) * size]
        near = own @ own.T >= 0.98
        want = near.sum(axis=1) - 1
        got = np.array([out[label * size + k].n_links for k in range(size)])
        assert (got <= want).all()
        found, wanted = found + got.sum(), wanted + want.sum()
    assert wanted >= 2 * labels * pairs and found >= 0.999 * wanted, found / wanted


@pytest.mark.parametrize("chunk", [2048, 16])
def test_embedding_links_against_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(embeddings, "CHUNK", chunk)
    rng = np.random.default_rng(7)
    centre = rng.standard_normal((12, 32))
    v = np.concatenate([c + 0.15 * rng.standard_normal((20, 32)) * s for c, s in zip(centre, np.linspace(0.2, 1.6, 12))])
    v = np.concatenate([v, v[:30], 3 * v[:5]]).astype(np.float32)
    label = [(k % 3) if k % 17 else None for k in range(len(v))]
    df = spark.createDataFrame([(k, x.tolist(), y) for k, (x, y) in enumerate(zip(v, label))], "vec_id long, embedding array<float>, label int")
    out = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = [(i, j) for i in range(len(v)) for j in range(i) if label[i] is not None and label[i] == label[j] and u[i] @ u[j] >= 0.98]
    n = np.bincount(np.array(near).ravel(), minlength=len(v))
    assert [out[k].n_links for k in range(len(v))] == n.tolist()
    want = closure(range(len(v)), near)
    assert {k: r.component_id for k, r in out.items()} == want
    assert all(r.kept == (r.vec_id == want[r.vec_id]) for r in out.values())


def test_vectors_that_link_with_nothing(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [0.0, 0.0], 1), (4, None, 1), (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 1), (7, [1.0, 0.0], None), (8, [1.0, None], 1), (9, [1.0, 0.0, 0.0], 1), (10, [], 1), (None, [1.0, 0.0], 1)]
    out = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert (out[1].n_links, out[2].component_id, out[2].kept) == (1, 1, False)
    assert all((out[k].n_links, out[k].component_id, out[k].kept) == (0, k, True) for k in range(3, 11))
    assert (out[None].n_links, out[None].component_id, out[None].kept) == (0, None, False)
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def plain_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def alike(texts):
    sets = {i: plain_shingles(t) for i, t in texts}
    return [(a, b) for k, a in enumerate(sets) for b in list(sets)[:k] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]


def edited(rng, n, share):
    """A text and copies of it with words replaced here and there."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    out = [" ".join(base)]
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(1, share)):
            words[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("few, centres", [(32, 8), (2, 1)])
def test_near_copies_beyond_two_bits_go(spark, few, centres):
    rng = random.Random(11)
    texts = list(enumerate([x for n in (3, 3, 40) for x in edited(rng, n, 12)] + ["a b", "a b c", "", "q w e r t y"]))
    near = alike(texts)
    far = [(a, b) for a, b in near if bin(simhash.fingerprint(texts[a][1]) ^ simhash.fingerprint(texts[b][1])).count("1") > 2]
    assert len(far) > 20
    want = closure([i for i, _ in texts], near)
    rows = [(i, jaccard.set_key(c), c) for i, t in texts for c in [jaccard.shingles(t)]]
    banded = spark.createDataFrame([(s, i, jaccard.bands(c)) for i, s, c in rows], "s long, row long, bands array<long>")
    of = {s: i for i, s, _ in rows}
    got = jaccard.links(banded, spark.createDataFrame(texts, "row long, text string"), few, centres).collect()
    assert closure(want, [(of[r.u], of[r.v]) for r in got]) == want
    kept = simhash.keep_first(spark.createDataFrame(texts, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_a_large_group_costs_a_few_rows_for_each_member(spark, monkeypatch):
    rng = random.Random(5)
    texts = list(enumerate(edited(rng, 400, 3)))
    near = alike(texts)
    want = closure([i for i, _ in texts], near)
    rows = [(i, jaccard.set_key(c), c) for i, t in texts for c in [jaccard.shingles(t)]]
    of = {s: i for i, s, _ in rows}
    banded = spark.createDataFrame([(s, i, jaccard.bands(c)) for i, s, c in rows], "s long, row long, bands array<long>")
    compared, joined, verified, closed = [], [], jaccard._verified, jaccard.components
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, sets: (compared.append(pairs.count()), verified(pairs, sets))[1])
    monkeypatch.setattr(jaccard, "components", lambda edges: (joined.append(edges.count()), closed(edges))[1])
    got = jaccard.links(banded, spark.createDataFrame(texts, "row long, text string")).collect()
    assert closure(want, [(of[r.u], of[r.v]) for r in got]) == want
    assert len(near) > 50 * len(rows) and len(got) < len(rows)
    # its members meet in every band at most once with the first centre, and pairwise in small buckets only
    assert sum(compared) < 60 * len(rows) and sum(joined) < 60 * len(rows)


def test_alike_sets_of_different_components_meet_in_their_first_codes(spark):
    rng = random.Random(17)
    sets = []
    for i in range(120):
        base = sets[rng.randrange(i)][1] if i % 4 else rng.sample(range(300), 40)
        sets.append((i, sorted({rng.randrange(300) if rng.random() < 0.04 else c for c in base}), rng.randrange(6)))
    found = {}
    for r in jaccard._prefixes(spark.createDataFrame(sets, "s long, codes array<long>, root long")).collect():
        assert r.n == len(sets[r.s][1]) and r.root == sets[r.s][2] and 0 <= r.at < r.n
        found.setdefault(r.s, {})[r.c] = r.at
    only = [c for c in range(300) if len({root for _, codes, root in sets if c in codes}) == 1]
    assert only and not any(c in x for c in only for x in found.values())
    met = 0
    for i, a, root in sets:
        for j, b, other in sets[:i]:
            shared = len(set(a) & set(b))
            if root != other and shared >= 0.8 * len(set(a) | set(b)):
                common = set(found.get(i, {})) & set(found.get(j, {}))
                assert any(min(len(a) - found[i][c], len(b) - found[j][c]) >= shared for c in common)
                met += 1
    assert met > 20


def test_one_row_of_each_group_stays_whatever_the_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(None, a, ""), (None, a, ""), (None, b, ""), (1, b, ""), (2, b, ""), (2, c, ""), (2, c, ""), (2, d, "")]
    kept = simhash.keep_first(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == [("1", b), ("2", c), ("2", d), ("None", a)]
