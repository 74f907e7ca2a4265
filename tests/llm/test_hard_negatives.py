import numpy as np
import pytest

from tessera.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, row long, id string, v int"


def brute(rows, every=100):
    data = []
    for i, e, label, *_ in rows:
        if i is None or e is None or label is None or any(x is None or not np.isfinite(x) for x in e):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        data.append((i, label, [int(np.floor(256 * float(np.float32(x)))) for x in e]))
    out = []
    for a, own, v in data:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, label) for i, label, w in data if i != a)  # noqa: B905 (a missing component is zero)
        for s, i, _ in [x for x in scored if x[2] == own][:5]:
            near = [x for x in scored if x[2] != own and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(a, i, rank, n, -s, -t) for rank, (t, n, _) in enumerate(near, 1)]
    return sorted(out)


def rows(n=900, dims=20, seed=4, scale=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((10, dims))
    label = rng.integers(0, 10, n)
    label[: n // 3] = 3  # one label holds a third
    x = (0.5 * centres[(label + rng.integers(0, 2, n)) % 10] + 0.4 * rng.standard_normal((n, dims))) * scale
    x[n // 4 : n // 4 + 30] = x[n // 4]  # ties
    return [(int(i), [float(v) for v in np.float32(x[i])], int(label[i]), 0, "", 0) for i in rng.permutation(n)]


def got(df):
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def test_against_brute_force(spark):
    data = rows()
    bad = [(2000, None, 1, 0, "", 0), (2100, [0.1] * 20, None, 0, "", 0), (2200, [None] + [0.1] * 19, 2, 0, "", 0), (2300, [float("nan")] * 20, 2, 0, "", 0), (2400, [float("inf")] * 20, 2, 0, "", 0), (None, data[0][1], 2, 0, "", 0)]
    want = brute(data)
    assert len(want) > 100
    assert got(H.hard_negatives(spark.createDataFrame(data + bad, SCHEMA))) == want


@pytest.mark.parametrize(("block", "part", "every"), [(50, 3, 10), (128, 40, 10), (1000, 1, 100)])
def test_blocks_and_parts_change_nothing(spark, monkeypatch, block, part, every):
    monkeypatch.setattr(H, "STRIPE_BLOCKS", 4)
    monkeypatch.setattr(H, "TILE_ANCHORS", 8)
    data = rows(600, seed=9)
    assert got(H.hard_negatives(spark.createDataFrame(data, SCHEMA), every, block, part)) == brute(data, every)


def test_repeats_lengths_few_rows_and_empty(spark):
    data = rows(60, seed=6)
    data = [*data, *data[:5], (100, data[3][1], data[3][2], 0, "", 0), (100, data[4][1], data[4][2], 0, "", 0), (61, [0.5], 3, 0, "", 0), (62, [], 3, 0, "", 0), (63, [0.2] * 25, 4, 0, "", 0)]
    assert got(H.hard_negatives(spark.createDataFrame(data, SCHEMA), 10)) == brute(data, 10)
    assert got(H.hard_negatives(spark.createDataFrame(data[:1], SCHEMA), 1)) == []
    assert got(H.hard_negatives(spark.createDataFrame([], SCHEMA))) == []


def test_large_components(spark):
    data = rows(120, dims=6, scale=3e4)
    assert got(H.hard_negatives(spark.createDataFrame(data, SCHEMA), 10)) == brute(data, 10)
    with pytest.raises(ArithmeticError):
        H.hard_negatives(spark.createDataFrame([(1, [1e20], 1, 0, "", 0)], SCHEMA))


def test_planes_give_the_number():
    rng = np.random.default_rng(0)
    x = rng.integers(-300, 300, (40, 9))
    row = {"ids": np.zeros(40, np.int64).tobytes(), "labels": np.zeros(40, np.int64).tobytes(), "planes": H.pack(x, 11)}
    planes = H.Planes(row, 11, 9)
    assert np.array_equal(sum(b.astype(np.int64) * w for b, w in zip(planes.bits, planes.weights, strict=True)), x)


def test_intervals_drop_pairs_early():
    """All pairs would need the last plane without intervals; with them few are left."""
    rng = np.random.default_rng(0)
    x, a = rng.integers(-200, 200, (2000, 32)), rng.integers(-200, 200, (16, 32))
    row = {"ids": np.arange(2000).tobytes(), "labels": np.zeros(2000, np.int64).tobytes(), "planes": H.pack(x, 9)}
    score = a @ x.T
    floor, ceiling = np.sort(score, axis=1)[:, -20], np.sort(score, axis=1)[:, -5]
    i, j, s = H.narrowed(a, H.Planes(row, 9, 32), np.ones(score.shape, bool), floor, ceiling, 0)
    assert len(i) == 16 * 16 and np.array_equal(score[i, j], s)
