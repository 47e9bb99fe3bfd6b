"""The sampler on fixed response surfaces, budgets, and searches by it."""

import hashlib
import itertools
import time

import pytest

from plumbline.operators import models, tuning

LISTS = {"depth": [2, 4, 6, 8, 10, 12], "rate": [0.001, 0.003, 0.01, 0.03, 0.1, 0.3], "kind": ["a", "b", "c"], "l2": [0.0, 1.0, 2.0, 4.0]}
GRID = [dict(zip(LISTS, v)) for v in itertools.product(*LISTS.values())]


def surface(p):
    d, r = LISTS["depth"].index(p["depth"]), LISTS["rate"].index(p["rate"])
    return 1 - 0.04 * (d - 4) ** 2 - 0.05 * (r - 3) ** 2 - {"a": 0.3, "b": 0.0, "c": 0.15}[p["kind"]] - 0.02 * abs(LISTS["l2"].index(p["l2"]) - 2)


def test_beats_a_hash_ordered_part_of_the_grid():
    """With a tenth of the grid, over ten seeds, the best found is better than the best of as many by hash, and on average
    better than the best of half the grid by hash with the optimum left out."""
    n = len(GRID) // 10
    got, by_hash = [], []
    for seed in range(10):
        found = tuning.search(lambda p: (p, surface(p), [surface(p)]), GRID, trials=n, seed=seed)
        assert len(found) == n == len({tuning.key(p) for p, _, _ in found})
        got.append(found[0][1])
        order = sorted(GRID, key=lambda p: hashlib.md5(f"{seed}{tuning.key(p)}".encode()).hexdigest())
        by_hash.append(max(map(surface, order[:n])))
    assert sum(a >= b for a, b in zip(got, by_hash)) >= 8 and sum(got) > sum(by_hash)
    assert sum(got) / 10 > 0.97


def test_beats_half_of_the_grid_by_hash():
    """Half of the grid by the sampler against half of it by hash."""
    grid = [p for p in GRID if p["l2"] == 0.0]
    wins = 0
    for seed in range(10):
        order = sorted(grid, key=lambda p: hashlib.md5(f"{seed}{tuning.key(p)}".encode()).hexdigest())
        half = max(map(surface, order[: len(grid) // 2]))
        found = tuning.search(lambda p: (p, surface(p), [surface(p)]), grid, trials=len(grid) // 2, seed=seed)[0][1]
        assert found >= half
        wins += found == max(map(surface, grid))
    assert wins == 10


def test_budgets_and_seeds():
    measure = lambda p: (p, surface(p), [surface(p)])
    one, two = (tuning.search(measure, GRID, trials=30, seed=3, parallel=1) for _ in range(2))
    assert one == two and one != tuning.search(measure, GRID, trials=30, seed=4, parallel=1)
    assert len(tuning.search(measure, GRID)) == len(GRID) == len(tuning.search(measure, GRID, trials=10_000))
    slow = lambda p: time.sleep(0.05) or measure(p)
    begun = time.monotonic()
    got = tuning.search(slow, GRID, trials=100, seconds=0.3)
    assert 4 <= len(got) < 60 and time.monotonic() - begun < 3
    assert len(tuning.search(slow, GRID, seconds=0.0)) == 4
    assert tuning.search(lambda p: (p, 0.5, []), []) == [({}, 0.5, [])]
    worst = tuning.search(lambda p: (p, float("nan") if p["kind"] == "a" else surface(p), []), GRID, trials=40)
    assert worst[0][1] == worst[0][1]


def test_search_of_a_model(spark):
    rows = spark.range(240).selectExpr("id as sample_id", "(id * 37 % 101) / 101.0D as a", "(id * 53 % 97) / 97.0D as b").selectExpr("*", "cast(a + 0.3D * b > 0.65D as int) as y")
    grid = [{"regParam": r, "elasticNetParam": 1.0} for r in (10.0, 1.0, 0.001)]
    got = models.search_history(rows, ["a", "b"], "y", "logistic", grid, k=2, budget=2)
    assert len(got) == 2 and all(len(each) == 2 for _, _, each in got) and got[0][1] >= got[1][1]
    assert models.search(rows, ["a", "b"], "y", "logistic", grid, k=2)[0][0]["regParam"] == 0.001
    assert [p for p, _ in models.search(rows, ["a", "b"], "y", "logistic", [], k=2)] == [{}]
    with pytest.raises(KeyError):
        models.search(rows, ["a"], "y", "nothing", [{}], k=2)
