"""Near duplicates, lines, links and neighbours against brute force."""

import random
import re

import numpy as np
import pytest
from conftest import DATA

from retrieval_jobs.llm import minhash, pivot_index, projection_forest
from retrieval_jobs.llm.components import connected_components
from retrieval_jobs.llm.line_spread import without_spread_lines
from retrieval_jobs.llm.shingles import shingle_sets


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_set(text, n):
    w = words_of(text)
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def plain_components(ids, linked):
    low = {i: i for i in ids}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in linked:
        x, y = root(a), root(b)
        low[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("seed", [0, 1])
def test_components(spark, seed):
    random.seed(seed)
    links = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2001 + k) for k in range(300)]
    got = {r.id: r.component_id for r in connected_components(spark.createDataFrame([*links, (5, None), (7, 7)], "a long, b long")).collect()}
    ids = {x for pair in links if pair[0] != pair[1] for x in pair}
    assert got == plain_components(ids, [p for p in links if p[0] != p[1]])
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_texts():
    random.seed(3)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = [None, "", "  \n ", "one", "One", "one two", "ONE\tTWO", " ", "x" * 50_000, "long " * 20_000]
    for _ in range(12):
        base = random.choices(vocabulary, k=random.choice([6, 40, 120]))
        texts.append(" ".join(base))
        for edits in (0, 1, 2, 4, 7):
            copy = list(base)
            for _ in range(edits):
                copy[random.randrange(len(copy))] = random.choice(vocabulary)
            texts.append(" ".join(copy))
    hot = random.choices(vocabulary, k=100)
    for _ in range(150):  # a large group, of which some pairs link and others don't
        copy = list(hot)
        for _ in range(random.randrange(12)):
            copy[random.randrange(100)] = random.choice(vocabulary)
        texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize(("words", "bound", "most"), [(2, "BLOCK", 16), (5, "BLOCK", 16), (5, "BLOCK_SHINGLES", 900)])
def test_near_duplicates(spark, words, bound, most, monkeypatch):
    monkeypatch.setattr(minhash, bound, most)
    texts = near_texts()
    rows = [(k, t, "x", 1) for k, t in enumerate(texts)] + [(None, texts[20], "x", 1), (20, texts[20], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket string, n_shingles int").repartition(3)
    got = minhash.near_duplicates(docs, words=words).collect()
    sets = [plain_set(t, words) for t in texts]
    linked = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = plain_components(range(len(texts)), linked)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
            assert r.kept is None
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert minhash.near_duplicates(docs.where("doc_id < 0"), words).count() == 0


def test_shingles_tell_texts_apart():
    texts = ["a b c", "a b  c", "A B C", "ab c", "a bc", "c b a", "a", ""]
    sets = [frozenset(s.tolist()) for s in shingle_sets(texts, 2)]
    assert sets[0] == sets[1] == sets[2]
    assert len({*sets}) == 6
    assert [len(s) for s in sets] == [2, 2, 2, 1, 1, 2, 1, 0]


def plain_lines(rows, min_sites, min_chars):
    sites, first = {}, {}
    for doc_id, text, source in rows:
        for line in (text or "").split("\n") if text is not None else []:
            if len(line) >= min_chars:
                sites.setdefault(line, set()).update([source] if source is not None else [])
                if doc_id is not None:
                    first[line] = min(first.get(line, doc_id), doc_id)
    spread = {x for x, s in sites.items() if len(s) >= min_sites}
    out = []
    for doc_id, text, _ in rows:
        lines = [] if text is None else text.split("\n")
        kept = [x for x in lines if not (x in spread and (doc_id is None or doc_id != first.get(x)))]
        out.append((doc_id, None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_line_spread(spark):
    random.seed(2)
    boiler = [f"this line number {k} is found on many sites" for k in range(12)]
    rows = [(None, boiler[0], "s1"), (900, None, "s2"), (901, "", "s3"), (902, boiler[1] + "\n\n" + boiler[1], None), (903, "short\n" * 9, "s4"), (903, "short\n" * 9, "s4"), (904, "x" * 100_000, "s5")]
    for k in range(200):
        lines = [random.choice(boiler[: k % 12 + 1]) for _ in range(3)] + [f"only here {k} " * 3, "tiny", ""]
        random.shuffle(lines)
        rows.append((k, "\n".join(lines), f"s{random.randrange(k % 12 + 2)}"))
    rows += [(1000 + k, "edge line with exactly the sites it needs", f"s{k}") for k in range(5)]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, source string, removed string, n_removed int, pos int").repartition(4)
    got = without_spread_lines(docs, min_sites=5)
    assert got.columns == ["doc_id", "text", "source", "removed", "pos", "n_lines", "n_removed"]
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()), key=str) == plain_lines(rows, 5, 20)
    assert without_spread_lines(docs.where("doc_id < 0")).count() == 0


@pytest.mark.parametrize("sources", [20, 6, 3])
def test_passages_under_a_hot_source(spark, sources):
    import corpus_pipeline

    random.seed(9)
    passages = [f"passage {k} " + "of more than fifty words " * 12 for k in range(8)]
    rows = [[k, [f"only in document {k} and nowhere else"], "s0" if k % 3 == 0 else f"s{random.randrange(1, sources)}"] for k in range(600)]
    for k, passage in enumerate(passages):
        for r in random.sample(rows, 14):
            r[1].append(passage)
        rows[k][1].append("a line of nine documents on several sources")
    for r in rows[300:330:3]:
        assert r[2] == "s0"
        r[1].append("a line of one source in ten documents")
    rows.append([600, [rows[8][1][0], "a line of nine documents on several sources"], "s1"])
    sites = {p: {r[2] for r in rows if p in r[1]} for p in passages}
    assert min(map(len, sites.values())) < 10 and min(map(len, sites.values())) >= 2
    docs = spark.createDataFrame([(i, "\n".join(x), s, 0) for i, x, s in rows], "doc_id long, text string, source string, n_chars long")
    got = {r.doc_id: r.text.split("\n") for r in corpus_pipeline.lines(spark, docs, DATA).collect()}
    first = {p: min(r[0] for r in rows if p in r[1]) for p in passages}
    assert got == {i: [x for x in lines if x not in first or first[x] == i] for i, lines, _ in rows}


def vector_rows():
    draw = np.random.default_rng(5)
    rows, n = [], 0
    for k in range(400):
        v = draw.standard_normal(16)
        rows.append((n, (v / np.linalg.norm(v)).tolist(), k % 3))
        n += 1
    for _ in range(200):  # near copies of one vector, some of them just past the threshold
        v = np.array(rows[0][1]) + draw.standard_normal(16) * 0.1 * draw.random()
        rows.append((n, (v * draw.uniform(0.5, 2)).tolist(), 0))
        n += 1
    rows += [(n + k, rows[3][1], 0) for k in range(60)]  # equal vectors
    n += 60
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 7]
    rows += [(n + k, v, 0) for k, v in enumerate(odd)]
    n += len(odd)
    return [*rows, (n, rows[0][1], None), (n + 1, rows[0][1], None), (None, rows[0][1], 0)]


def fine(v, size=16):
    return v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v) and any(v)


def test_linked_vectors(spark, monkeypatch):
    monkeypatch.setattr(pivot_index, "BLOCK", 32)
    rows = vector_rows()
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, pivot int, weight string").repartition(3)
    got = {r.vec_id: r for r in pivot_index.linked_vectors(table).collect()}
    assert len(got) == len(rows)
    ok = [r for r in rows if fine(r[1]) and r[2] is not None and r[0] is not None]
    unit = np.array([np.array(r[1]) / np.linalg.norm(r[1]) for r in ok])
    near = (unit @ unit.T >= 0.93) & (np.array([r[2] for r in ok])[:, None] == np.array([r[2] for r in ok])[None, :])
    np.fill_diagonal(near, False)
    found = sum(got[r[0]].n_links for r in ok)
    assert 0.99 * near.sum() <= found <= near.sum()
    want = plain_components([r[0] for r in ok], [(ok[a][0], ok[b][0]) for a, b in zip(*np.nonzero(near), strict=True)])
    assert np.mean([got[i].component_id == c for i, c in want.items()]) > 0.99
    for r in rows:
        if r[0] not in want and r[0] is not None:
            assert (got[r[0]].n_links, got[r[0]].component_id, got[r[0]].kept) == (0, r[0], True)
    assert got[None].kept is None
    assert pivot_index.linked_vectors(table.where("vec_id < 0")).count() == 0


def turned(one, cosine, draw):
    aside = draw.standard_normal(one.shape)
    aside -= (aside * one).sum(axis=1, keepdims=True) * one
    return cosine * one + np.sqrt(1 - cosine**2) * aside / np.linalg.norm(aside, axis=1, keepdims=True)


def test_descriptions_take_bounded_memory():
    import tracemalloc

    draw = np.random.default_rng(4)
    x, pivots = draw.standard_normal((1024, 16)), draw.standard_normal((40_000, 16))
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    tracemalloc.start()
    got = pivot_index.descriptions(x, pivots, 8)
    assert tracemalloc.get_traced_memory()[1] < 6 * pivot_index.SLICE_BYTES
    tracemalloc.stop()
    for row in (0, 500, 1023):
        assert got[row].tolist() == np.argsort(-(pivots @ x[row]), kind="stable")[:8].tolist()


@pytest.mark.parametrize(("n", "most"), [(2_000, 0.08), (8_000, 0.03)])
def test_pivots_find_links_and_compare_few(spark, n, most):
    """64 components, pairs at cosine 0.93 and a little more: hardly one is lost, and ever fewer of all pairs are compared."""
    draw = np.random.default_rng(n)
    one = draw.standard_normal((n // 2, 64))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    two = turned(one, draw.uniform(0.9301, 0.95, (len(one), 1)), draw)
    rows = [(k, v.tolist(), 0) for k, v in enumerate(np.concatenate([one, two]))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = pivot_index.vector_links(pivot_index.vector_classes(table), 0.93).collect()
    assert sum(r.links for r in found if r.a is not None) >= 0.995 * n
    assert sum(r.compared for r in found) <= most * n * (n - 1) / 2
    kept = pivot_index.linked_vectors(table).where("kept").count()
    assert n // 2 <= kept <= n // 2 + 0.005 * n


def test_vectors_of_different_sizes(spark):
    draw = np.random.default_rng(2)
    rows = []
    for size in (4, 7):
        for _ in range(30):
            v = draw.standard_normal(size)
            rows += [(len(rows), v.tolist(), 0), (len(rows) + 1, (v * 2 + draw.standard_normal(size) * 0.01).tolist(), 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = {r.vec_id: r for r in pivot_index.linked_vectors(table).collect()}
    for size in (4, 7):
        own = [r for r in rows if len(r[1]) == size]
        unit = np.array([np.array(r[1]) / np.linalg.norm(r[1]) for r in own])
        near = unit @ unit.T >= 0.93
        np.fill_diagonal(near, False)
        assert [got[r[0]].n_links for r in own] == near.sum(axis=1).tolist()
    hits = projection_forest.nearest_neighbours(table, table, k=20).collect()
    assert len(hits) == len(rows) * 20
    assert all(len(rows[r.query_id][1]) == len(rows[r.vec_id][1]) for r in hits)


def test_forest_compares_few_rows_of_clusters():
    """Work follows the leaves read: for clustered vectors a small part of the table, and a smaller one the larger it is."""
    shares = []
    for n in (4_000, 16_000):
        draw = np.random.default_rng(4)
        centers = draw.standard_normal((n // 50, 64))
        x = centers[draw.integers(0, len(centers), n)] + 0.35 * draw.standard_normal((n, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        forest = projection_forest.fit_forest(x, 1.0, 20)
        asked = draw.choice(n, 100, replace=False)
        probed = forest.probe(x[asked], forest.probes)
        places = forest.place(x)
        sizes = [np.bincount(places[:, t], minlength=tree.leaves) for t, tree in enumerate(forest.trees)]
        shares.append(np.mean([sum(sizes[t][own].sum() for t, own in enumerate(leaves)) for leaves in probed]) / n)
        met = projection_forest.candidates(forest.masks(probed), places)
        scores = x[asked] @ x.T
        scores[np.arange(len(asked)), asked] = -1
        best = np.argsort(-scores, axis=1)[:, :20]
        assert np.take_along_axis(met, best, axis=1).mean() >= 0.9
    assert shares[1] < 0.6 * shares[0]
    assert shares[1] < 0.15


def test_full_leaves_are_cut_again(spark, monkeypatch):
    """Past the sample leaves stay bounded: full ones get trees of their own, and queries read few rows of them."""
    monkeypatch.setattr(projection_forest, "SAMPLE", 1000)
    monkeypatch.setattr(projection_forest, "LEAF_ROWS", 100)
    monkeypatch.setattr(projection_forest, "LEAF_SAMPLE", 150)
    draw = np.random.default_rng(5)
    centers = draw.standard_normal((200, 32))
    x = centers[draw.integers(0, 200, 12_000)] + 0.3 * draw.standard_normal((12_000, 32))
    x[:60] = x[0]  # copies that nothing parts
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    seen = {}
    meetings = projection_forest._meetings

    def watch(*a):
        seen["rows"], seen["wanted"] = meetings(*a)
        return seen["rows"], seen["wanted"]

    monkeypatch.setattr(projection_forest, "_meetings", watch)
    asked = np.arange(0, 12_000, 40)
    got = {}
    for r in projection_forest.nearest_neighbours(table, table.where("vec_id % 40 = 0"), k=20).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert all(sorted(got[k]) == list(range(1, 21)) for k in asked)
    exact = x[asked] @ x.T
    exact[np.arange(len(asked)), asked] = -2
    worst = np.sort(exact, axis=1)[:, -20]
    assert np.mean([[got[k][r][1] >= worst[n] - 1e-9 for r in range(1, 21)] for n, k in enumerate(asked)]) >= 0.9
    held, read = ({r.leaf: r["count"] for r in df.groupBy("leaf").count().collect()} for df in (seen["rows"], seen["wanted"]))
    assert max(held.values()) <= 100
    assert seen["rows"].groupBy("vec_id").count().select("count").distinct().count() == 1
    assert sum(n * held.get(leaf, 0) for leaf, n in read.items()) < 0.5 * len(asked) * 12_000


def test_one_id_with_two_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [0.5, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in projection_forest.nearest_neighbours(table, table.where("vec_id <> 1"), k=20).collect())
    assert got == [(2, 1, 1, 1.0), (2, 2, 3, 0.5), (3, 1, 1, 0.5), (3, 2, 2, 0.5), (3, 3, 1, 0.0)]


def test_nearest_neighbours(spark, monkeypatch):
    monkeypatch.setattr(projection_forest, "VECTOR_BLOCK", 200)
    monkeypatch.setattr(projection_forest, "QUERY_BLOCK", 10)
    rows = vector_rows()
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, places string").repartition(3)
    got = {}
    for r in projection_forest.nearest_neighbours(table, table.where("vec_id % 20 = 0"), k=20).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    ok = [r for r in rows if fine(r[1]) and r[0] is not None]
    ids, x = np.array([r[0] for r in ok]), np.array([r[1] for r in ok])
    hits = total = 0
    asked = [k for k in range(len(ok)) if ids[k] % 20 == 0]
    assert set(got) == {ids[k] for k in asked}
    for k in asked:
        scores = (x * x[k]).sum(axis=1)
        order = [n for n in np.lexsort((ids, -scores)) if n != k][:20]
        own = got[ids[k]]
        assert sorted(own) == list(range(1, 21))
        listed = [own[r] for r in range(1, 21)]
        assert listed == sorted(listed, key=lambda p: (-p[1], p[0]))
        assert all(s == pytest.approx(scores[np.flatnonzero(ids == v)[0]], abs=1e-12) for v, s in listed)
        hits += len({v for v, _ in listed} & set(ids[order]))
        total += 20
    assert hits >= 0.9 * total
    few = table.where("vec_id < 5")
    assert projection_forest.nearest_neighbours(few, few, k=20).count() == 20
    assert projection_forest.nearest_neighbours(table.where("vec_id < 0"), table, 5).count() == 0
    assert projection_forest.nearest_neighbours(table, table.where("vec_id < 0"), 5).count() == 0
