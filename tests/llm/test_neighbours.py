import numpy as np

from tessera.llm import neighbours as N

SCHEMA = "vec_id long, embedding array<float>, label int, block string, score string"


def rows(n=900, dims=24, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dims))
    x = (centres[rng.integers(0, 12, n)] + 0.6 * rng.standard_normal((n, dims))) * rng.uniform(0.5, 2, (n, 1))
    x[300:420] = x[300]  # equal vectors: ties
    return [(i, [float(v) for v in np.float32(x[i])], 0, "b", None) for i in range(n)]


def brute(data, every, k):
    ids = np.array([r[0] for r in data])
    x = np.array([r[1] for r in data], dtype=np.float32).astype(np.float64)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = (x * x[i]).sum(axis=1)
        keep = ids != ids[i]
        order = np.lexsort((ids[keep], -s[keep]))[:k]
        out[int(ids[i])] = [(int(v), float(w)) for v, w in zip(ids[keep][order], s[keep][order], strict=True)]
    return out


def got(df):
    found = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(found[r.query_id])
    return found


def test_recall_ties_and_scores(spark):
    data = rows()
    want = brute(data, 20, 20)
    odd = [(10_000, None, 0, "b", None), (10_020, [0.0] * 24, 0, "b", None), (10_040, [None] + [1.0] * 23, 0, "b", None), (10_060, [float("nan")] * 24, 0, "b", None), (10_080, [float("inf")] * 24, 0, "b", None), (None, data[0][1], 0, "b", None), (10_100, [1.0], 0, "b", None)]
    found = got(N.search(spark.createDataFrame(data + odd, SCHEMA), block_rows=256))
    assert found.keys() == want.keys()
    hits = sum(len({v for v, _ in found[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    scores = {(q, v): s for q in want for v, s in brute(data, 20, len(data))[q]}
    for q, near in found.items():
        assert near == sorted(near, key=lambda x: (-x[1], x[0])) and all(abs(scores[q, v] - s) < 1e-12 for v, s in near)
    assert [v for v, _ in found[300]] == [v for v, _ in want[300]]


def test_exact_when_all_is_verified(spark):
    data = rows(440, seed=3)
    found = got(N.search(spark.createDataFrame(data, SCHEMA), every=10, k=7, verify=1.0))
    want = brute(data, 10, 7)
    assert {q: [v for v, _ in x] for q, x in found.items()} == {q: [v for v, _ in x] for q, x in want.items()}


def test_few_rows_and_empty(spark):
    data = rows()[:3]
    assert {q: len(x) for q, x in got(N.search(spark.createDataFrame(data, SCHEMA))).items()} == {0: 2}
    assert N.search(spark.createDataFrame([], SCHEMA)).count() == 0
    twice = [data[0], data[0], data[1]]
    assert [v for v, _ in got(N.search(spark.createDataFrame(twice, SCHEMA)))[0]] == [1, 1]


def test_repeated_query_rows_lose_no_neighbours(spark):
    data = rows()[:60]
    want = {v for v, _ in brute(data, 1000, 20)[0]}
    found = got(N.search(spark.createDataFrame([data[0], data[0], *data], SCHEMA), every=1000, verify=1.0, block_rows=16))
    assert {v for v, _ in found[0]} == want and len(found[0]) == 3 * 20
