"""Codes, draws and mixes against plain versions, and their edge cases."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from conftest import DATA
from oracle import differences

from retrieval_jobs.llm import box_codes, resampling, source_mix
from retrieval_jobs.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", ["op11_boxed_codes", "op12_importance_draw", "op13_golden_mix"])
def test_same_as_sql(spark, name):
    assert differences(QUERIES[name](spark, DATA), ORACLE_SQL[name], DATA) is None


# Vector codes ----------------------------------------------------------------------------------------------

ROWS = "vec_id long, embedding array<float>, label int, code string, error long"


def plain_codes(rows, parts, entries, rounds):
    q = {n: np.floor(np.array(v, np.float32).astype(np.float64) * 256).clip(-(2**24), 2**24).astype(np.int64).astype(object) for n, (_, v, _) in enumerate(rows)}
    bounds = box_codes.part_bounds(len(rows[0][1]), parts)
    order = sorted(q, key=lambda n: (rows[n][0] is None, rows[n][0] or 0, list(rows[n][1])))
    books = [[list(q[n][a:b]) for n in order[:entries]] for a, b in bounds]

    def near(p, n):
        a, b = bounds[p]
        return min((sum((x - y) ** 2 for x, y in zip(q[n][a:b], c, strict=True)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        for p, (a, b) in enumerate(bounds):
            own = {}
            for n in q:
                own.setdefault(near(p, n)[1], []).append(q[n][a:b])
            for e, members in own.items():
                books[p][e] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    out = []
    for n in q:
        found = [near(p, n) for p in range(len(bounds))]
        out.append((rows[n][0], "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    said = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return sorted(out, key=str), said


@pytest.mark.parametrize(("size", "parts", "spread"), [(8, 4, 0.2), (7, 3, 3.0), (3, 4, 1.0), (6, 2, 1e6)])
def test_codes(spark, size, parts, spread):
    random.seed(size)
    rows = [(k // 2 * 2 if k % 9 else None, [float(np.float32(round(random.gauss(0, spread), 2))) for _ in range(size)], random.choice([1, 2, None])) for k in range(300)]
    rows += rows[:40] + [(1000 + k, [0.0] * size, 1) for k in range(100)]
    df = spark.createDataFrame([(a, b, c, "x", 1) for a, b, c in rows], ROWS).repartition(7)
    coded, books = box_codes.compressed_vectors(df, parts=parts, entries=9, rounds=2)
    got = box_codes.with_label_errors(coded).collect()
    want, said = plain_codes(rows, parts, 9, 2)
    assert sorted(((r.vec_id, r.code, r.error) for r in got), key=str) == want
    assert {r.codebooks_sha256 for r in got} == {said}
    for label in (1, 2, None):
        assert {r.label_error for r in got if r.label == label} == {sum(r.error for r in got if r.label == label)}
    assert len(box_codes.decoded(got[0].code, books[size])) == size


def test_shortlists_leave_out_most_entries_and_no_nearest_one():
    rng = np.random.default_rng(1)
    rows = np.floor(rng.standard_normal((8192, 4)) * 32).astype(np.int64)
    book = rows[:64].copy()
    blocks = box_codes.Blocks.of(rows[box_codes.curve_order(rows)])
    possible = blocks.shortlists(book)
    entry, distance = blocks.assign(book)
    every = ((blocks.rows[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert (distance == every.min(axis=1)).all() and (entry == every.argmin(axis=1)).all()
    assert possible.mean() < 0.3
    clustered = np.concatenate([np.full((640, 4), 1000 * k) for k in range(10)])
    close = box_codes.Blocks.of(clustered[box_codes.curve_order(clustered)])
    assert (close.shortlists(clustered[::640]).sum(axis=1) == 1).mean() > 0.9


def test_codes_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None, 1), (2, [1.0, None], 1), (3, [nan, 1.0], 1), (4, [1.0, inf], None), (5, [], 2), (6, [0.0, 0.0], None), (7, [1.0, 2.0], None), (8, [3e38, -3e38], 2), (9, [1.0, 2.0, 3.0], 2)]
    coded, books = box_codes.compressed_vectors(spark.createDataFrame([(*r, "x", 1) for r in odd], ROWS), parts=2, entries=4)
    got = {r.vec_id: r for r in box_codes.with_label_errors(coded).collect()}
    assert set(got) == {5, 6, 7, 8, 9} and set(books) == {0, 2, 3}
    assert [got[k].code for k in (6, 7, 8)] == ["0000", "0101", "0202"] and got[5].code == "0000"
    assert books[2][0][2].tolist() == [2**24] and books[2][1][2].tolist() == [-(2**24)]
    none, books = box_codes.compressed_vectors(spark.createDataFrame([], ROWS))
    assert box_codes.with_label_errors(none).count() == 0 and not books


# Draws -----------------------------------------------------------------------------------------------------


def plain_features(text, grams):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [zlib.crc32(" ".join(words[k : k + n]).encode()) % 10000 for n in range(1, grams + 1) for k in range(len(words) - n + 1)]


def plain_draw(docs, target, grams, min_words=20, percent=10):
    own = [plain_features(t, grams) for _, t in docs]
    s, t = np.zeros(10000, int), np.zeros(10000, int)
    for _, f in own:
        np.add.at(s, f, 1)
    for text in target:
        np.add.at(t, plain_features(text, grams)[1], 1)
    gain = [math.floor(1000 * math.log((b + 1) * (int(s.sum()) + 10000) / ((a + 1) * (int(t.sum()) + 10000)))) for a, b in zip(s.tolist(), t.tolist(), strict=True)]
    rows = []
    for (doc_id, _), (words, f) in zip(docs, own, strict=True):
        weight = sum(gain[x] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    allowed = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    k = percent * len(allowed) // 100
    drawn = [(*r[:4], n + 1) for n, r in enumerate(allowed[:k])]
    left = [(*r[:4], None) for r in [*allowed[k:], *(r for r in rows if r[4] < min_words)]]
    return sorted(drawn + left, key=str)


@pytest.mark.parametrize("grams", [1, 3])
def test_draw(spark, grams):
    random.seed(grams)
    vocabulary = [f"W{k}" for k in range(300)] + ["ÄÖ", "x-y", "straße", "日本語", "a\x00b"]
    docs = [(k, " ".join(random.choices(vocabulary[: random.choice([20, 305])], k=random.choice([0, 5, 19, 20, 60])))) for k in range(500)]
    docs += [(900, None), (901, ""), (902, " \n"), (None, "Same words again " * 10), (None, None), (7, "one " * 400_000)] + [(903, "tied words here " * 8)] * 60
    target = [" ".join(random.choices(vocabulary[:20], k=30)) for _ in range(30)] + [None, ""]
    df = spark.createDataFrame([(a, b, 1, "s", 5) for a, b in docs], "doc_id long, text string, rank int, features string, score long").repartition(5)
    got = resampling.resampled(df, spark.createDataFrame([(x, 1) for x in target], "text string, n_words int"), grams=grams).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_draw(docs, target, grams)


def test_features_do_not_depend_on_segments(monkeypatch):
    text = " ".join(f"w{k % 97}" for k in range(3000)).encode()
    whole = resampling.feature_buckets(text, 3, 10_000)
    monkeypatch.setattr(resampling, "SEGMENT", 50)
    cut = resampling.feature_buckets(text, 3, 10_000)
    assert whole[0] == cut[0] and sorted(whole[1].tolist()) == sorted(cut[1].tolist())


@pytest.mark.parametrize("same", [1, 40])
def test_kth_key(spark, same):
    random.seed(same)
    keys = [(random.randrange(50), 0, random.randrange(40), 1) for _ in range(1000 // same) for _ in range(same)]
    rows = spark.createDataFrame(keys, "below long, unnamed long, named long, n_features long").repartition(4)
    for k in (1, 2, 333, 999, 1000):
        assert resampling.kth_key(rows, k, pivots=3) == sorted(keys)[k - 1]
    assert resampling.kth_key(rows, 1001) is None and resampling.kth_key(rows, 0) is None
    placed = resampling.ranked(rows).collect()
    assert [tuple(r)[:4] for r in sorted(placed, key=lambda r: r.rank)] == sorted(keys)
    assert sorted(r.rank for r in placed) == list(range(1, 1001))


def test_draw_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert resampling.resampled(none, some).count() == 0
    assert [tuple(r)[-1] for r in resampling.resampled(some, none.select("text")).collect()] == [None, None]


# Mixes -----------------------------------------------------------------------------------------------------


def mixed_table(spark):
    random.seed(5)
    sources = ["b", "a", "é", "Z", None, "tiny", "empty", "hot"]
    docs = [(k, random.choice(sources[:5] + ["hot"] * 4), " ".join(["w"] * random.choice([0, 1, 3, 40, 900]))) for k in range(800)]
    docs += [(900, "tiny", "one\ttwo"), (901, "empty", " \n "), (902, "empty", None), (903, "hot", "long " * 30_000), (None, "hot", "no id"), (None, None, None)] + [(904, "a", "same row twice")] * 50
    return docs, spark.createDataFrame([(*d, 1, "x", 2.0) for d in docs], "doc_id long, source string, text string, size int, slot string, target double").repartition(6)


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[n % 3] for n, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        target |= {s: 2.0 * sizes[s] for s in full}
        left, open_ = left - sum(2 * sizes[s] for s in full), open_ - full
    return target


def test_mix(spark):
    docs, df = mixed_table(spark)
    sizes = {}
    for _, source, text in docs:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = plain_targets(sizes)
    pieces = source_mix.mix_sources(df, block_words=64)
    got = source_mix.taken_words(pieces).collect()
    assert sorted(((r.doc_id, r.source, r["size"]) for r in got), key=str) == sorted(((d, s, len((t or "").split())) for d, s, t in docs), key=str)
    taken = {s: 0 for s in sizes}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert taken == {s: math.floor(t + 1e-6) for s, t in want.items()}
    again = source_mix.taken_words(source_mix.mix_sources(df.repartition(3), block_words=64)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_slots_are_spread_evenly_and_hold_one_block(spark):
    _, df = mixed_table(spark)
    pieces = [r for r in source_mix.mix_sources(df, block_words=16).collect() if r.slot is not None]
    slots = {}
    for r in pieces:
        slots.setdefault(r.slot, []).append(r)
        assert 0 <= r.first_word and r.first_word + r.n_words <= r["size"]
    assert all(len({r.source for r in own}) == 1 and sum(r.n_words for r in own) <= 16 for own in slots.values())
    order = [slots[s][0].source for s in sorted(slots)]
    share = {s: order.count(s) / len(order) for s in set(order)}
    for at in range(0, len(order), 500):
        for s, p in share.items():
            assert abs(order[:at].count(s) - p * at) < 12
    short = [own for own in slots.values() if sum(r.n_words for r in own) < 16]
    assert len(short) <= len(share)


def test_mix_of_nothing(spark):
    shape = "doc_id long, source string, text string"
    assert source_mix.taken_words(source_mix.mix_sources(spark.createDataFrame([], shape))).count() == 0
    empty = spark.createDataFrame([(1, "a", ""), (2, None, None)], shape)
    assert [(r["size"], r.target, r.taken) for r in source_mix.taken_words(source_mix.mix_sources(empty)).collect()] == [(0, 0.0, 0)] * 2
