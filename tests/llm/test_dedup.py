"""Deduplication against brute force."""

import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tideline.llm import components, embeddings, exact, simhash

WORDS = [f"w{i}" for i in range(400)]


def smallest(n, links):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.fixture(scope="module")
def texts():
    r = np.random.default_rng(5)
    out = [None, "", " \n\t", "one", "one two", "One  TWO", "ÉÀ é", "a b c d", "a b c d e", "x " * 40_000]
    for _ in range(40):
        base = [WORDS[i] for i in r.integers(0, 400, r.integers(30, 200))]
        out.append(" ".join(base))
        for _ in range(r.integers(0, 6)):
            copy = list(base)
            for _ in range(r.integers(0, 4)):
                copy[r.integers(0, len(copy))] = WORDS[r.integers(0, 400)]
            out.append((" " if r.random() < 0.5 else "\n ").join(copy))
    hot = [WORDS[i] for i in r.integers(0, 400, 300)]
    for i in range(90):
        out.append(" ".join(hot[:i] + ["odd"] + hot[i:]))
    return out + ["same text"] * 60


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 3, t, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[12], (None, "same text", "x", "y"), (None, "alone", "x", "y")], "doc_id long, text string, id string, fp string").repartition(5)


def test_exact(spark, docs, texts):
    rows = [(r["doc_id"], re.sub(r"[\x20\x09-\x0d]+", " ", r["text"] or "")) for r in docs.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    least = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = sorted((((i is None, i or 0), least[t], len(groups[t]), i == least[t]) for i, t in rows), key=repr)
    for digest in (False, True):
        got = exact.exact_groups(docs, digest=digest).collect()
        assert sorted((((r["doc_id"] is None, r["doc_id"] or 0), r["keep_id"], r["group_size"], r["kept"]) for r in got), key=repr) == want
    kept = exact.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((i is None, i or 0) for i, in kept.select("doc_id").collect()) == sorted((i is None, i or 0) for i, t in rows if i == least[t])
    assert exact.exact_groups(docs.limit(0)).count() == 0 and exact.drop_copies(docs.limit(0)).count() == 0


def test_exact_without_broadcast(spark, docs, monkeypatch):
    from tideline.llm import shared

    want = exact.drop_copies(docs).count()
    monkeypatch.setattr(shared, "BROADCAST_ROWS", -1)
    assert exact.drop_copies(docs).count() == want


def plain_fingerprint(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint(texts):
    for t in texts:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


@pytest.mark.parametrize("tile", [simhash.TILE, 7])
def test_simhash(spark, docs, texts, tile):
    got = simhash.near_groups(docs, tile=tile).collect()
    assert len(got) == len(texts) + 3
    fps = [plain_fingerprint(t) for t in texts]
    comp = smallest(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    for r in got:
        if r["doc_id"] is not None:
            assert r["component_id"] == 3 * comp[r["doc_id"] // 3] and r["fp"] % (1 << 64) == fps[r["doc_id"] // 3]
    assert simhash.near_groups(docs.limit(0)).count() == 0


@pytest.mark.parametrize("frontier", [simhash.FRONTIER, 40])
def test_gray_index(monkeypatch, frontier):
    monkeypatch.setattr(simhash, "FRONTIER", frontier)
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 60).astype(np.uint64)
    fp = base[r.integers(0, 60, 500)]
    for _ in range(4):
        fp = fp ^ (np.uint64(1) << r.integers(0, 64, 500).astype(np.uint64)) * (r.random(500) < 0.6)
    for codes in (fp, np.stack([fp, fp[::-1]], 1)):
        key = (fp >> np.uint64(61)).astype(np.int64)
        g = simhash.GrayIndex(codes, key)
        c, k = codes[g.order], key[g.order]
        links = [(i, j) for i in range(500) for j in range(i) if k[i] == k[j] and int(np.bitwise_count(c[i] ^ c[j]).sum()) <= 4]
        assert g.labels(4).tolist() == smallest(500, links)
        known = np.arange(500) // 7
        joined = smallest(500, links + [(i, i - 1) for i in range(1, 500) if known[i] == known[i - 1]])
        assert g.labels(4, known=known).tolist() == joined


def shingles(t, n=5):
    w = t.lower().split()
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def test_similar_groups(spark, docs, texts):
    comp = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs).where("doc_id is not null").collect()}
    s = [shingles(t) if t and t.split() else None for t in texts]
    sure = missed = 0
    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j]:
                sim = len(s[i] & s[j]) / len(s[i] | s[j])
                together = comp[3 * i] == comp[3 * j]
                if sim >= 0.85:
                    sure, missed = sure + 1, missed + (not together)
                if sim < 0.3:
                    assert not together
    assert sure > 500 and missed < 0.05 * sure
    kept = simhash.drop_near(docs)
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert kept.columns == docs.columns and {i for i in ids if i is not None} == set(comp.values())


@pytest.fixture(scope="module")
def planted():
    """Texts by id: pairs whose exact similarity spreads from 0.6 to 0.95, of short and long texts, and unlike ones."""
    r, out = np.random.default_rng(11), {}
    for k in range(240):
        n = int(r.choice([40, 120, 400]))
        words = [f"w{x}" for x in r.integers(0, 10**9, n + 4)]
        goal = 0.6 + 0.35 * k / 239
        lost = round(n * (1 - goal) / (1 + goal))  # each of them in one and not in the other
        other = words[:]
        for x in range(lost // 5):
            other[4 + 5 * x] = f"x{k}-{x}"
        other[len(other) - lost % 5 :] = [f"y{k}-{x}" for x in range(lost % 5)]
        out[2 * k], out[2 * k + 1] = " ".join(words), " ".join(other)
    # four of five shingles, and three of four
    out[480], out[481], out[482], out[483] = "a b c d e f g h i", "a b c d e f g h", "k l m n o p q r", "k l m n o p q"
    return out


def test_similar_groups_are_exact(spark, planted):
    s = [shingles(planted[i]) for i in range(len(planted))]
    similar = [(i, j) for i in range(len(s)) for j in range(i) if len(s[i] & s[j]) / len(s[i] | s[j]) >= 0.8]
    assert 90 < len(similar) < 150 and (481, 480) in similar and (483, 482) not in similar
    want = smallest(len(s), similar)
    docs = spark.createDataFrame(list(planted.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs).collect()}
    assert [i for i in got if got[i] != i and got[i] != want[i]] == []
    missed = [i for i in got if got[i] == i and want[i] != i]
    assert len(missed) <= 0.01 * len(similar), missed
    assert {r["doc_id"] for r in simhash.drop_near(docs).collect()} == set(got.values())


def test_components(spark):
    r = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in r.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(300, 420)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    df = spark.createDataFrame([*links, (None, 3), (3, None)], "u long, v long")
    got = {r["node"]: r["label"] for r in components.components(df).collect()}
    want = smallest(600, links)
    ends = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: want[x] for x in ends}
    assert components.components(df.limit(0)).count() == 0


@pytest.mark.parametrize("tile", [embeddings.TILE, 16])
def test_embeddings(spark, tile):
    r = np.random.default_rng(4)
    base = r.standard_normal((30, 64))
    x = [(base[i % 30] + r.standard_normal(64) * (0.05, 0.3, 0.45)[i % 3]).tolist() for i in range(200)]
    x += [x[3]] * 12 + [[0.0] * 64, [float("nan")] * 64, [float("inf"), *[1.0] * 63], [None, *[1.0] * 63], None, [], [1.0, 2.0], [2.0, 4.0], [1e200] * 64, [1e-200] * 64]
    rows = [(i, v, None if i % 41 == 40 else i % 2, "x") for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, (None, x[3], 1, "x")], "vec_id long, embedding array<double>, label int, id string").repartition(3)
    ok = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) and rows[i][2] is not None for i, v in enumerate(x)]
    unit = [np.array(v) / np.abs(v).max() if o else None for v, o in zip(x, ok, strict=True)]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    n = len(x)
    links = [(i, j) for i in range(n) for j in range(i) if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]) and unit[i] @ unit[j] >= 0.93]
    count = [0] * n
    for i, j in links:
        count[i] += 1
        count[j] += 1
    for i in range(n):  # the row with a null id
        if ok[i] and rows[i][2] == 1 and len(x[i]) == 64 and unit[i] @ unit[3] >= 0.93:
            count[i] += 1
    comp = smallest(n, links)
    got = {r["vec_id"]: r for r in embeddings.near_vectors(df, tile=tile).collect()}
    assert len(got) == n + 1
    for i in range(n):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (count[i], comp[i], comp[i] == i), i
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    r = np.random.default_rng(0)
    a = r.standard_normal((400, 64))
    b = a + r.standard_normal((400, 64)) * r.uniform(0.1, 2, (400, 1))
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    found, bound = embeddings.Codes(a).estimate(embeddings.Codes(b))
    err = found - a @ b.T
    assert abs(err.mean()) < 0.003 and (np.abs(err) > bound + 0.03).mean() < 1e-3


def test_star_edges():
    u, v = components.star_edges(np.array([0, 0, 2, 0, 2, 5]), np.array([7, 3, 9, 5, 1, 0]))
    assert sorted(zip(u.tolist(), v.tolist(), strict=True)) == [(5, 3), (7, 3), (9, 1)]


def test_another_text_under_the_same_id_stays(spark):
    """A and B of equal length and equal first 128 characters; a near copy of A and a text unlike it."""
    head = " ".join(WORDS[:60])
    a, b = head + " end one", head + " end two"
    df = spark.createDataFrame([(3, b), (5, a), (5, b), (7, None), (7, ""), (8, " ")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in exact.drop_copies(df).where("doc_id < 7").collect()) == [(3, b), (5, a)]
    near, unlike = head + " more", " ".join(WORDS[200:300])
    df = spark.createDataFrame([(3, head), (5, near), (5, unlike), (6, head + " x"), (None, head), (3, head + " y")], "doc_id long, text string").repartition(3)
    for rows in (df, df.unionAll(df)):
        kept = {(r["doc_id"], r["text"]) for r in simhash.drop_near(rows).collect()}
        assert (5, unlike) in kept and (None, head) in kept and len([k for k in kept if k[0] == 3]) == 1 and len(kept) == 3


@pytest.mark.parametrize("parts", [5, 6, 7, 8])
def test_every_scheme_of_blocks_finds_all_links(spark, parts):
    r = np.random.default_rng(parts)
    base = r.integers(-(1 << 63), 1 << 63, 80)
    fp = np.concatenate([base, *[base ^ np.bitwise_or.reduce(np.int64(1) << r.integers(0, 64, (k, 80)), axis=0) for k in (1, 3, 4, 5)]])
    fp = np.unique(fp)
    apart = np.bitwise_count((fp[:, None] ^ fp[None, :]).view(np.uint64))
    want = smallest(len(fp), [(i, j) for i, j in np.argwhere(apart <= 4).tolist() if j < i])
    edges = simhash.links(spark.createDataFrame([(int(x),) for x in fp], "fp long"), parts=parts).collect()
    at = {int(x): i for i, x in enumerate(fp)}
    assert smallest(len(fp), [(at[e["u"]], at[e["v"]]) for e in edges]) == want
    assert len(simhash.masks(4, parts)) == [5, 15, 35, 70][parts - 5]
    assert simhash.scheme(10**6, 4) == simhash.masks(4, 5) and simhash.scheme(10**9, 4) == simhash.masks(4, 7)


def test_scratch_goes(spark, docs):
    import os

    from tideline.llm.shared import scratch
    from tideline.session import shared_dir

    folders = lambda: [n for n in os.listdir(shared_dir(spark).removeprefix("file:")) if n.startswith("run-")]
    with scratch(spark):
        n = exact.drop_copies(docs).count()
        assert len(folders()) == 1
    assert folders() == [] and n == exact.drop_copies(docs).count()
