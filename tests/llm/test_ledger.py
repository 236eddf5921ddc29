from collections import Counter
from datetime import datetime
import random

import pytest
from pyspark.sql import functions as F

from tagloom.functions.tags import tag_key
from tagloom.llm import ledger as L
from tagloom.session import stage_path


def batch(spark, rows):
    return spark.createDataFrame([(k, i, "x", 7) for k, i in rows], "key string, item_id long, n_copies string, bucket int")


def book(spark, buckets=8):
    return L.Ledger(spark, stage_path(spark, "test-ledger"), ["key"], buckets)


def read(b):
    return {r.key: (r.n_copies, r.first_id) for r in b.read().collect()}


def test_batches_add_up_and_keep_the_earliest(spark):
    rnd = random.Random(1)
    b, all_rows = book(spark), []
    for n in (200, 0, 1, 300):
        rows = [(rnd.choice([None, *[f"k{i}" for i in range(60)]]), rnd.randint(1, 10**6)) for _ in range(n)]
        b.add(batch(spark, rows), "item_id")
        all_rows += rows
    count = Counter(k for k, _ in all_rows)
    assert read(b) == {k: (n, min(i for x, i in all_rows if x == k)) for k, n in count.items()}


def test_only_touched_buckets_are_written_anew(spark):
    b = book(spark, 16)
    b.add(batch(spark, [(f"k{i}", i) for i in range(100)]), "item_id")
    b.add(batch(spark, [("k5", 1)]), "item_id")
    m = b._manifest()["buckets"]
    assert sorted(m.values()).count(2) == 1 and read(b)["k5"] == (2, 1)


def test_a_run_that_dies_before_the_commit_leaves_the_ledger(spark, monkeypatch):
    b = book(spark)
    b.add(batch(spark, [("a", 1)]), "item_id")
    monkeypatch.setattr(b, "_commit", lambda m: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        b.add(batch(spark, [("a", 2), ("b", 3)]), "item_id")
    monkeypatch.undo()
    assert read(b) == {"a": (1, 1)}
    b.add(batch(spark, [("a", 2), ("b", 3)]), "item_id")
    assert read(b) == {"a": (2, 1), "b": (1, 3)}


@pytest.mark.parametrize("step", ["create", "rename", "delete"])
def test_a_run_that_dies_at_any_step_of_the_commit_loses_nothing(spark, monkeypatch, step):
    """Before the rename the ledger is as it was; after it the batch counts, whatever else fails."""
    b = book(spark)
    b.add(batch(spark, [("a", 1), ("b", 1)]), "item_id", "first")

    class Dying:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            def call(*args):
                if name == step:
                    raise RuntimeError("lost")
                return getattr(self.fs, name)(*args)

            return call

    b._fs = Dying(b._fs)
    with pytest.raises(RuntimeError):
        b.add(batch(spark, [("a", 2)]), "item_id", "second")
    again = L.Ledger(spark, b.path, ["key"], 8)
    assert read(again) == ({"a": (2, 1), "b": (1, 1)} if step == "delete" else {"a": (1, 1), "b": (1, 1)})
    assert again.add(batch(spark, [("a", 2)]), "item_id", "second") == (step != "delete")
    assert read(again) == {"a": (2, 1), "b": (1, 1)}


def test_a_batch_counts_once_and_buckets_stay(spark):
    b = book(spark, 8)
    assert b.add(batch(spark, [("a", 5), ("b", 2)]), "item_id", "x")
    other = L.Ledger(spark, b.path, ["key"], 3)
    assert not other.add(batch(spark, [("a", 5)]), "item_id", "x")
    assert other.add(batch(spark, [("a", 1)]), "item_id", "y") and read(other) == {"a": (2, 1), "b": (1, 2)}


def test_empty_first_batch_and_unread(spark):
    b = book(spark)
    with pytest.raises(ValueError):
        b.read()
    b.add(batch(spark, []), "item_id")
    assert read(b) == {}


def test_batches_by_year(spark):
    df = spark.createDataFrame([(1, datetime(2023, 5, 1)), (2, datetime(2024, 5, 1)), (3, None)], "item_id long, at timestamp_ntz")
    assert [[r.item_id for r in x.orderBy("item_id").collect()] for x in L.in_batches(df, "at")] == [[1, 3], [2]]
    assert len(L.in_batches(df.limit(0), "at")) == 1


def test_tag_keys(spark):
    same = ["26-PIT-9087A", "26 pit 9087 a", "9087–PIT–26A", "a26\tPIT//9087", "(PIT9087)26_A"]
    other = ["PIT-9087A", "26-PIT-9O87A", "26-PIT-9087B", "26-26-PIT-9087A", "26-PÏT-9087A"]
    df = spark.createDataFrame([(t,) for t in [*same, *other, "", "--", None, "9" * 100_000]], "t string")
    k = [r.k for r in df.select(tag_key("t").alias("k")).collect()]
    assert len(set(k[:5])) == 1 and len(set(k[:10])) == 6 and k[10:13] == ["", "", None] and len(k[13]) == 100_000
    assert df.groupBy(tag_key("t")).agg(F.count("*")).count() == 9
