import random

import pytest

from tagloom.llm import packing as P


def slots(plan):
    """container -> lengths, from a plan."""
    out = {}
    for length, a, b, first, each in plan:
        for r in range(a, b):
            out.setdefault(first + (r - a) // each, []).append(length)
    return out


def best_fit(lengths, capacity):
    """Best fit decreasing, item by item."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            r = min(fit)
            rooms.remove(r)
            rooms.append(r - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit_decreasing(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([5, 17, 64, 512])
    hist = {rnd.randint(1, capacity): rnd.choice([1, 2, 3, 40, 700]) for _ in range(rnd.randint(1, 25))}
    plan = P.plan(list(hist.items()), capacity)
    by = slots(plan)
    assert all(sum(v) <= capacity for v in by.values())
    flat = sorted(x for v in by.values() for x in v)
    assert flat == sorted(n for n, c in hist.items() for _ in range(c))
    assert sorted(by) == list(range(len(by))) and len(by) == best_fit(flat, capacity)


def test_plan_does_not_grow_with_the_corpus():
    small, large = (P.plan([(n, c * k) for n, c in ((300, 7), (211, 9), (90, 31), (13, 50))], 512) for k in (1, 1_000_003))
    assert len(large) < 4 * len(small) + 20


def check(rows, counts, capacity):
    held, seen = {}, {}
    for r in rows:
        held[r.container_id] = held.get(r.container_id, 0) + r.n_tokens
        seen.setdefault(r.doc_id, []).append((r.piece, r.token_from, r.n_tokens))
    assert max(held.values(), default=0) <= capacity
    assert len(seen) == len(counts)
    for i, n in counts.items():
        pieces = sorted(seen[i])
        assert sum(p[2] for p in pieces) == n and [p[0] for p in pieces] == list(range(len(pieces)))
        assert len(pieces) == max(1, -(-n // capacity)) and [p[1] for p in pieces] == [k * capacity for k in range(len(pieces))]
    return len([c for c, t in held.items() if t])


def test_every_token_has_one_place(spark):
    rnd = random.Random(4)
    counts = {i: rnd.choice([0, 1, 40, 40, 511, 512, 513, 5000, rnd.randint(1, 900)]) for i in range(700)}
    df = spark.createDataFrame([(i, n, "x") for i, n in counts.items()], "doc_id long, n_tokens long, capacity string")
    b = spark.createDataFrame([(1, "s", 512), (2, "t", 1), (3, "n", None), (4, "z", 0), (5, "l", 2048)], "budget_id int, budget_name string, capacity_tokens int")
    rows = P.pack(df.where("n_tokens < 600"), b.where("budget_id = 2")).collect()
    check(rows, {i: n for i, n in counts.items() if n < 600}, 1)
    rows = P.pack(df, b).where("budget_id in (1, 3, 4, 5)").collect()
    for i, cap in ((1, 512), (5, 2048)):
        used = check([r for r in rows if r.budget_id == i], counts, cap)
        assert used <= sum(counts.values()) / cap * 1.25 + 1
    assert {r.budget_id for r in rows} == {1, 5}
    u = {r.budget_id: r for r in P.usage(P.pack(df, b.where("budget_id = 1")), b).collect()}
    assert u[1]["n_tokens"] == sum(counts.values()) and u[1]["fill"] > 0.8


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, n_tokens long")
    b = spark.createDataFrame([(1, 512)], "budget_id int, capacity_tokens int")
    assert P.pack(df, b).count() == 0
    assert P.pack(spark.createDataFrame([(1, 5)], "doc_id long, n_tokens long"), b.limit(0)).count() == 0


def test_counts_are_of_whole_texts(spark):
    long = "word " * 60_000
    texts = [(1, "Hello world", 1), (2, "", 2), (3, None, 3), (4, long, 4), (5, "x" * 30_000, 5), (6, "<|endoftext|>", 6)]
    got = {r.doc_id: r.n_tokens for r in P.token_counts(spark.createDataFrame(texts, "doc_id long, text string, n_tokens int")).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] >= 60_000 and got[5] > 100 and got[6] > 1


def test_broken_packings_are_told(spark):
    counts = spark.createDataFrame([(1, 10), (2, 700), (3, 0), (4, 512)], "doc_id long, n_tokens long")
    b = spark.createDataFrame([(1, 512), (2, None)], "budget_id int, capacity_tokens int")
    good = P.pack(counts, b)
    assert P.broken(good, counts, b).count() == 0 and P.broken(good, counts, b.where("budget_id = 2")).count() == 0
    bad = spark.createDataFrame([(1, 0, 1, 0, 0, 10), (1, 0, 2, 0, 0, 512), (1, 1, 2, 1, 512, 100), (1, 2, 3, 0, 0, 0), (1, 3, 4, 0, 0, 500), (1, 4, 4, 1, 500, 12)], "budget_id int, container_id long, doc_id long, piece int, token_from long, n_tokens long")
    assert sorted(map(tuple, P.broken(bad, counts, b).collect())) == [(1, "cut", 4), (1, "full", 0), (1, "tokens", 2)]
