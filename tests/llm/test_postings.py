import numpy as np
from pyspark.sql import functions as F

from flowloom.llm.postings import fit, nearest


def brute(rows, asks, top):
    rows = sorted({(i, tuple(v)) for i, v in rows})
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32).astype(np.float64)
    out = {}
    for j in np.flatnonzero(asks(ids)):
        s = (x * x[j]).sum(axis=1)
        out[int(ids[j])] = sorted((-s[k], int(ids[k])) for k in range(len(ids)) if ids[k] != ids[j])[:top]
    return out


def check(spark, rows, least, top=20, every=10):
    df = spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in rows], "vec_id long, embedding array<float>").withColumn("list", F.lit(1)).withColumn("score", F.lit(2))
    got = {}
    for r in nearest(df, F.col("vec_id") % every == 0, top).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(rows, lambda i: i % every == 0, top)
    assert set(got) == {q for q, w in want.items() if w}
    hit = total = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, len(want[q]) + 1))
        assert all((-a[2], a[1]) < (-b[2], b[1]) for a, b in zip(found, found[1:]))
        hit += len({f[1] for f in found} & {w[1] for w in want[q]})
        total += len(want[q])
    assert hit >= least * total
    return got, want


def test_recall(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(1500, 16)) * rng.uniform(0.5, 2, (1500, 1))  # of different norms
    check(spark, list(enumerate(vectors)), 0.9)


def test_copies_and_ties(spark):
    """A third of the rows are one vector: the smallest ids come first, exactly."""
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(90, 8))
    vectors[::3] = vectors[0]
    rows = list(enumerate(vectors)) + [(0, vectors[0]), (5, vectors[5])]
    got, want = check(spark, rows, 0.9, top=5)
    assert [f[1] for f in got[0]][:5] == [w[1] for w in want[0]]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.0]), (10, [0.5, 0.5]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (None, [1.0, 1.0]),
            (7, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in nearest(df, F.col("vec_id") % 10 == 0).collect()]
    assert sorted(got) == [(0, 1, 10, 0.5), (10, 1, 0, 0.5)]
    assert nearest(df.filter("vec_id = 3"), F.col("vec_id") % 10 == 0).collect() == []
    assert nearest(df.filter("vec_id = 0"), F.col("vec_id") % 10 == 0).collect() == []
    assert nearest(df.filter("vec_id = 0 OR vec_id = 1"), F.lit(False)).collect() == []


def test_lists_are_balanced():
    points = np.random.default_rng(3).normal(size=(2000, 8)).astype(np.float32)
    lists = fit(points, float(np.linalg.norm(points, axis=1).max()))
    homes = lists.homes(points)
    sizes = np.bincount([i for h in homes for i in h], minlength=len(lists.centroids))
    assert len(lists.centroids) >= 2000 / 80 and sizes.max() < 8 * sizes.mean() and all(homes)
    assert any(len(h) > 1 for h in homes)
