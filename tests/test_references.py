from datetime import datetime, timedelta

import random

from tagloom.operators import references as R

T0 = datetime(2024, 1, 1)
P = "d long, space string, key string, valid_from timestamp_ntz, valid_to timestamp_ntz"
C = "d long, space string, key string, ref_table string, ref_field string, item_id long, at timestamp_ntz, period string, valid_from string"


def run(spark, parents, children):
    p = spark.createDataFrame(parents, P)
    c = spark.createDataFrame([(*x, "extra") for x in children], C).drop("valid_from")
    return sorted((r.item_id, r.ref_state) for r in R.dangling(p, c, ["d"]).collect())


def brute(parents, children):
    out = []
    for d, s, k, _, _, i, at, _ in children:
        t = [p for p in parents if None not in (d, s, k) and p[:3] == (d, s, k)]
        if any(f and at and f <= at and (e is None or e > at) for *_, f, e in t):
            continue
        if not t:
            out.append((i, "missing"))
        else:
            out.append((i, "deleted" if any(f and at and f <= at for *_, f, _ in t) else "late"))
    return sorted(out)


def at(h):
    return None if h is None else T0 + timedelta(hours=h)


def test_random_lifetimes_equal_brute_force(spark):
    rnd = random.Random(5)
    parents, children = [], []
    for _ in range(300):
        f = rnd.choice([None, *range(0, 200, 5)])
        e = None if rnd.random() < 0.4 or f is None else f + rnd.choice([-3, 0, 1, 30, 90])
        parents.append((rnd.randint(1, 3), rnd.choice("xy"), f"k{rnd.randint(0, 30)}", at(f), at(e)))
    for i in range(500):
        children.append((rnd.choice([1, 2, 3, None]), rnd.choice("xy"), rnd.choice([None, *[f"k{j}" for j in range(35)]]), "t", "f", i, at(rnd.choice([None, *range(0, 220, 3)])), "2024-01"))
    children += children[:20]  # told twice
    assert run(spark, parents, children) == brute(parents, children)


def test_one_key_holds_most_rows(spark):
    parents = [(1, "x", "hot", at(i), at(i + 0.5)) for i in range(400)]
    children = [(1, "x", "hot", "t", "f", i, at(i / 4), "p") for i in range(1600)]
    assert run(spark, parents, children) == brute(parents, children)


def test_empty_tables(spark):
    child = (1, "x", "k", "t", "f", 1, at(1), "p")
    assert run(spark, [], [child]) == [(1, "missing")]
    assert run(spark, [(1, "x", "k", at(0), None)], []) == []
    assert run(spark, [], []) == []


def test_report_and_what_a_reference_is(spark):
    c = spark.createDataFrame([("10-KA-1",), ("SEE SHEET 4 (off-page)",), ("4 OFF PAGE",), ("N/A",), ("",), (None,)], "c string")
    assert [r.c for r in c.where(R.is_reference(c.c)).collect()] == ["10-KA-1"]
    f = spark.createDataFrame([("t", "f", 1, "late", "2024-01"), ("t", "f", 2, "late", "2024-01")], "ref_table string, ref_field string, item_id long, ref_state string, period string")
    assert R.orphan_report(f).first()["n_references"] == 2
