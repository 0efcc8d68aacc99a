from collections import defaultdict

import pytest

from calorway.llm.links import linked_roots
from calorway.llm.mixing import mix_routes, source_targets


def level(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + ([None] if None in sizes else [])
    weight = {n: weights[k % 3] for k, n in enumerate(names)}
    target, left, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        total = sum(weight[n] for n in open_)
        over = {n for n in open_ if left * weight[n] / total > most * sizes[n]}
        if not over:
            target |= {n: left * weight[n] / total for n in open_}
            break
        target |= {n: most * sizes[n] for n in over}
        left -= sum(most * sizes[n] for n in over)
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 10, "b": 500, None: 60, "é": 3}, {"x": 0, "y": 7}, {"only": 9}])
def test_targets_equal_resharing(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "label string, source_size long")
    got = {r["label"]: r["target"] for r in source_targets(df).collect()}
    want = level(sizes)
    assert got.keys() == want.keys() and all(got[n] == pytest.approx(want[n]) for n in want)


def test_mix_meets_targets_and_bounds(spark):
    rows = [(i if i % 50 else None, None if i % 9 == 0 else f"s{i % 4}", " ".join(["w"] * (i % 37)), 1) for i in range(2000)] + [(5, "s1", None, 1), (5, "s1", None, 1)]
    df = spark.createDataFrame(rows, "route_id long, label string, text string, copies int")
    got = mix_routes(df).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mix_routes(df.repartition(3)).collect()))
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["label"]] += r["taken"]
    targets = {r["label"]: r["target"] for r in got}
    assert all(abs(taken[n] - t) <= 80 for n, t in targets.items())
    assert mix_routes(df.limit(0)).count() == 0


def test_targets_of_other_weights_and_limits(spark):
    """A limit that is no whole number, and weights that are none either."""
    rows = [(i, "ab"[i % 2], " ".join(["w"] * 10), 1) for i in range(1000)]
    df = spark.createDataFrame(rows, "route_id long, label string, text string, copies int")
    for weights, most in (((5, 2, 1), 1.5), ((0.5, 0.25, 0.1), 1.5), ((0.5, 2.5, 1), 2.0)):
        taken, target = defaultdict(int), {}
        for r in mix_routes(df, weights=weights, share=1.4, most=most).collect():
            taken[r["label"]] += r["taken"]
            target[r["label"]] = r["target"]
        want = level({"a": 5000, "b": 5000}, weights, 1.4, most)
        assert all(target[n] == pytest.approx(want[n]) and abs(taken[n] - want[n]) <= 20 for n in want)


def test_linked_roots_follow_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(500, 560)] + [(3, 3), (9, 2), (2, 9)]
    got = dict(map(tuple, linked_roots(spark.createDataFrame(links, "a long, b long")).collect()))
    assert all(got[k] == 100 for k in range(100, 161)) and all(got[k] == 7 for k in range(500, 560)) and got[9] == got[2] == 2 and 3 not in got
    assert linked_roots(spark.createDataFrame([], "a long, b long")).count() == 0
