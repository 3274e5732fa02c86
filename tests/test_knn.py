import numpy as np
import pytest

from marginalia.operators import knn


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(3)
    middles = draw.normal(size=(40, 16))
    some = [(int(k), [float(x) for x in middles[draw.integers(40)] + draw.normal(size=16) * 0.5]) for k in range(1500)]
    some += [(2000 + k, [1.0] * 16) for k in range(700)]  # a third alike: one hot list
    return spark.createDataFrame([*some, (9000, None), (None, [1.0] * 16)], "id long, embedding array<float>").cache()


def found(df):
    return {(r.id, r.neighbour, r.rank) for r in df.collect()}


def test_recall_and_all_lists(rows):
    exact = found(knn.nearest(rows.filter("id is not null"), rows.filter("id is not null"), k=3, above=0.2, block=256))
    lists = knn.centres(rows, list_rows=50)
    assert len(lists) > 20
    some = found(knn.nearest_listed(rows, rows, k=3, above=0.2, probes=8, block=256, found=lists))
    assert len({x[:2] for x in some} & {x[:2] for x in exact}) >= 0.9 * len(exact)
    assert found(knn.nearest_listed(rows, rows, k=3, above=0.2, probes=len(lists), block=256, found=lists)) == exact
    assert {k for k, *_ in some} >= set(range(2000, 2700))


def test_probes_follow_the_data(spark):
    draw = np.random.default_rng(4)
    noise = spark.createDataFrame([(k, [float(x) for x in draw.normal(size=16)]) for k in range(1200)], "id long, embedding array<float>").cache()
    lists = knn.centres(noise, list_rows=30)
    exact = {x[:2] for x in found(knn.nearest(noise, noise, above=0.2))}
    assert len({x[:2] for x in found(knn.nearest_listed(noise, noise, above=0.2, found=lists))} & exact) >= 0.9 * len(exact)
    assert 1 < knn.enough_probes(noise, noise, lists, above=0.2, queries=200) < len(lists)


def test_empty(spark, rows):
    none = rows.limit(0)
    assert knn.nearest_listed(none, none).count() == 0 and knn.nearest_listed(none, rows).count() == 0 and knn.nearest_listed(rows, none).count() == 0


def test_grid_moves_no_more_than_its_sides(spark):
    cores = spark.sparkContext.defaultParallelism
    for n in (50_000, 600_000):
        lefts, rights = knn._grid(spark, n, n, 64, knn.BLOCK)
        assert lefts + rights <= 2 * (4 * cores) ** 0.5 + 2, "each row is sent to every group of the other side: their number does not grow with the rows"
    assert knn._grid(spark, 200, 3_000_000, 256, knn.BLOCK)[0] == 1
    assert knn._grid(spark, 50_000_000, 1000, 64, knn.BLOCK)[0] * knn.HELD >= 50_000_000 * 64 * 4


def test_no_number_and_ties(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [0.5, 0.1])], "id long, embedding array<float>")
    near = {k: [n for i, n, _ in sorted(found(knn.nearest(rows, rows, k=2, above=0.2)), key=lambda x: x[2]) if i == k] for k in range(1, 7)}
    assert near == {1: [2, 3], 2: [1, 3], 3: [1, 2], 4: [], 5: [], 6: [1, 2]}
