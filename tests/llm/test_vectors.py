import numpy as np
import pytest

from tablewright.llm import ann, topk
from tablewright.llm import vectors as V

SCHEMA = "vec_id long, embedding array<float>, s int, rank string, id string"


def brute(rows, k):
    """Each length of vector by itself."""
    out = {}
    for d in {len(v) for _, v in rows if v}:
        out |= brute_length(rows, k, d)
    return out


def brute_length(rows, k, d):
    best = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v) or len(v) != d:
            continue
        v = tuple(float(np.float32(x)) for x in v)
        best[i] = min(best.get(i, v), v)
    ids = sorted(best)
    m = np.array([best[i] for i in ids])
    if not len(ids):
        return {}
    m = m / np.sqrt((m**2).sum(1))[:, None]
    s = np.round(m @ m.T, 6)
    out = {}
    for a, i in enumerate(ids):
        order = sorted((b for b in range(len(ids)) if b != a), key=lambda b: (-s[a, b], ids[b]))[:k]
        if order:
            out[i] = [(ids[b], round(float(s[a, b]), 6)) for b in order]
    return out


def odd_rows(n=150):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(n, 8)).round(3)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    rows += [(n + i, rows[0][1]) for i in range(30)]  # ties
    rows += [rows[1], (2, rows[3][1]), (None, rows[0][1]), (500, None), (501, []), (502, [0.0] * 8), (503, [1.0] * 7), (507, [1.0, 2.0] + [0.5] * 5), (508, [-1.0] * 7), (509, [2.0] * 3), (504, [1.0] * 7 + [None]), (505, [float("nan")] * 8), (506, [float("inf")] * 8)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "a", "b") for i, v in rows], SCHEMA).repartition(3)


def found(df):
    out = {}
    for r in df.orderBy("vec_id", "rank").collect():
        out.setdefault(r.vec_id, []).append((r.neighbour, round(r.score, 6)))
    return out


@pytest.mark.parametrize("k,shard_rows,blocks", [(5, 40, 2), (10, 4096, 3), (300, 64, 2)])
def test_top_k_matches_brute_force(spark, k, shard_rows, blocks):
    rows = odd_rows()
    assert found(topk.exact_top_k(frame(spark, rows), k=k, shard_rows=shard_rows, blocks=blocks)) == brute(rows, k)


def test_queries_are_those_asked_for(spark):
    rows = odd_rows()
    want = brute(rows, 10)
    got = found(topk.exact_top_k(frame(spark, rows), queries="id % 7 = 0", shard_rows=40))
    assert got == {i: v for i, v in want.items() if i % 7 == 0}
    near = found(ann.neighbours(frame(spark, rows), queries="id % 7 = 0", chunk=5))
    assert set(near) == set(got) and all(len(near[i]) == len(v) for i, v in got.items())
    assert topk.exact_top_k(frame(spark, rows), queries="id < 0").count() == 0 and ann.neighbours(frame(spark, rows), queries="id < 0").count() == 0


def test_ids_are_whole_numbers(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0])], "vec_id string, embedding array<float>")
    for f in (topk.exact_top_k, ann.neighbours):
        with pytest.raises(ValueError, match="whole numbers"):
            f(df)


@pytest.mark.parametrize("rows", [[], [(1, [1.0] * 8)], [(1, None)]])
def test_few_rows(spark, rows):
    for f in (topk.exact_top_k, ann.neighbours):
        out = f(spark.createDataFrame([(i, v, 1, "a", "b") for i, v in rows], SCHEMA))
        assert out.columns == ["vec_id", "neighbour", "rank", "score"] and out.count() == 0


def test_places_of_the_best():
    rng = np.random.default_rng(0)
    for n, m, k in ((3, 5, 10), (4, 100, 10), (5, 3001, 10), (2, 640, 10)):
        p = rng.integers(0, 50, (n, m)).astype(np.float32)
        got = np.sort(np.take_along_axis(p, V.top_places(p, k), 1), axis=1)
        assert (got == np.sort(p, axis=1)[:, -min(k, m) :]).all()


def recall(spark, m, **kw):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    true, got = found(topk.exact_top_k(df)), found(ann.neighbours(df, **kw))
    assert all(len(v) <= 10 and len({n for n, _ in v}) == len(v) and i not in {n for n, _ in v} for i, v in got.items())
    return sum(len({n for n, _ in v} & {n for n, _ in got.get(i, [])}) for i, v in true.items()) / sum(map(len, true.values()))


def test_recall_without_and_with_clusters(spark):
    rng = np.random.default_rng(1)
    assert recall(spark, rng.normal(size=(1500, 30)), chunk=40) >= 0.9
    centres = rng.normal(size=(20, 32)) * 4
    assert recall(spark, centres[rng.integers(0, 20, 1500)] + rng.normal(size=(1500, 32)), chunk=40) >= 0.9


def test_odd_rows_and_ties(spark):
    rows = odd_rows()
    got, want = found(ann.neighbours(frame(spark, rows), rerank=200)), brute(rows, 10)
    assert set(got) == set(want)
    hits = sum(len({n for n, _ in want[i]} & {n for n, _ in got[i]}) for i in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_recall_among_near_copies(spark):
    """With the query's own parameters: more near copies, and more equal vectors, than are compared exactly at first."""
    rng = np.random.default_rng(3)
    m = rng.normal(size=(6000, 64))
    m[:1500] = m[0] + 1e-3 * rng.normal(size=(1500, 64))
    m[1500:1900] = m[1500]
    m = m[rng.permutation(len(m))].astype(np.float32)
    u = m.astype(float) / np.sqrt((m.astype(float) ** 2).sum(1))[:, None]
    copies = np.flatnonzero(u @ u[(u @ u.T > 0.99).sum(1).argmax()] > 0.99)
    equal = np.flatnonzero((np.round(u @ u.T, 6) == 1).sum(1) == 400)
    assert len(copies) == 1500 and len(equal) == 400
    got = found(ann.neighbours(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<float>")))
    for group in (copies, equal):
        hits = 0
        for i in group:
            s = np.round(u @ u[i], 6)
            s[i] = -2
            hits += len(set(np.lexsort((np.arange(len(s)), -s))[:10].tolist()) & {n for n, _ in got[i]})
        assert hits / len(group) / 10 >= 0.9, hits / len(group) / 10
