import random

import pytest

from tagloom.operators import hierarchy as H


def brute(nodes):
    pid = dict(nodes)
    pid = {k: v if v in pid else None for k, v in pid.items()}
    kids = {}
    for k, v in pid.items():
        kids.setdefault(v, []).append(k)
    out = {}
    for k in pid:
        chain, x = [k], pid[k]
        while x is not None and x not in chain:
            chain.append(x)
            x = pid[x]
        below, todo = set(), list(kids.get(k, []))
        while todo:
            y = todo.pop()
            if y not in below:
                below.add(y)
                todo += kids.get(y, [])
        below.discard(k)
        if x is None:
            out[k] = (chain[-1], len(chain) - 1, "/".join(map(str, chain[::-1])), len(below), "none")
        else:
            out[k] = (-1, -1, "", len(below), "on" if x == k else "under")
    return out


def run(spark, nodes):
    df = spark.createDataFrame([(a, b, "x") for a, b in nodes], "id long, pid long, size string").select("id", "pid")
    rows = H.nested_sets(df).collect()
    for r in rows:
        if r.cycle_state == "none":
            assert r.range_right - r.range_left - 1 == r.n_descendants
    return {r.id: (r.root_id, r.depth, r.path, r.n_descendants, r.cycle_state) for r in rows}


CASES = {
    "empty": [],
    "one": [(1, None)],
    "own parent": [(1, 1)],
    "loop of two with a tail": [(1, 2), (2, 1), (3, 2), (4, 3), (5, None)],
    "parent unknown": [(1, 99), (2, 1)],
    "long chain": [(i, i - 1 if i else None) for i in range(70)],
    "long tail on a loop": [(0, 1), (1, 2), (2, 0)] + [(i, i - 1) for i in range(3, 40)],
    "hub": [(0, None)] + [(i, 0) for i in range(1, 300)],
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    assert run(spark, CASES[name]) == brute(CASES[name])


def test_random_graphs(spark):
    rnd = random.Random(3)
    nodes = [(i, rnd.choice([None, rnd.randint(0, 149), rnd.randint(max(0, i - 4), i)])) for i in range(150)]
    assert run(spark, nodes) == brute(nodes)


def test_descendants_by_range(spark):
    nodes = [(0, None), (1, 0), (2, 0), (3, 1), (4, 3), (9, None)]
    sets = H.nested_sets(spark.createDataFrame(nodes, "id long, pid long"))
    got = H.descendants(sets, spark.createDataFrame([(0,), (1,), (4,), (7,)], "id long")).collect()
    assert sorted((r.ancestor_id, r.id) for r in got) == [(0, 1), (0, 2), (0, 3), (0, 4), (1, 3), (1, 4)]
