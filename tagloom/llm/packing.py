"""Texts of varying length into containers of fixed capacity, planned on the histogram of lengths.

The plan never sees documents: best fit decreasing runs over (length, count), and as all texts of
a length are alike, whole runs of containers with the same room are filled in one step. The plan's
size depends on the capacity, not on the corpus. Each document then takes the slot that the plan
has for its rank within its length. A text longer than a container is cut into full containers and
a rest; no other text is cut.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators.prefix import salted_prefix
from tagloom.session import ship

TOKENIZERS = "/opt/tokenizers"


@lru_cache(1)
def _encoder(path: str):
    import tiktoken

    # Fixed value: the splitting pattern that belongs to the vocabulary.
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id, n_tokens of every row, over the whole text. A null text has 0 tokens, like an empty one. `tokenizer` must be readable by every executor."""
    ship(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(tokenizer)
        for b in batches:
            n = [len(e.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=[doc_id, "n_tokens"])

    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, n_tokens long")


def plan(histogram: list[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank + 1, first container, items a container): best fit decreasing over counts.

    Runs of neighbouring containers with the same room are kept together. The fullest container
    that still takes a length is filled with as many of that length as go in; then the next.
    """
    runs: dict[int, list[tuple[int, int]]] = {}  # room -> runs of (first container, number)
    rooms: list[int] = []
    out, opened = [], 0

    def keep(room: int, first: int, n: int) -> None:
        if room:
            if room not in runs:
                runs[room] = []
                insort(rooms, room)
            runs[room].append((first, n))

    for length, count in sorted(histogram, reverse=True):
        rank = 0
        while rank < count:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                first, n = runs[room].pop()
                if not runs[room]:
                    del runs[room]
                    rooms.pop(i)
            else:
                room, first = capacity, opened
                n = -(-(count - rank) // (capacity // length))
                opened += n
            each = room // length
            left = count - rank
            full = min(n, left // each)
            if full:
                out.append((length, rank, rank + full * each, first, each))
                keep(room - each * length, first, full)
                rank += full * each
                left -= full * each
            used = full
            if used < n and left:
                # Fewer items than this container takes: it is the last one of this length.
                out.append((length, rank, rank + left, first + used, left))
                keep(room - left * length, first + used, 1)
                rank += left
                used += 1
            if used < n:
                keep(room, first + used, n - used)
    return out


def pack(counts: DataFrame, budgets: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """budget_id, container_id, doc_id, piece, token_from, n_tokens for every document and budget.

    counts: doc_id, n_tokens; budgets: budget_id, capacity_tokens (a few rows; they and their
    histograms, at most one row per possible length, are gathered). Pieces count from 0;
    token_from is the piece's first token in the text. Documents without tokens need no room: one
    row, container 0. Budgets whose capacity is null or below 1 hold nothing and give no rows.
    Repeated document rows are packed each. Ranks follow a hash of the id, so they are the same in
    every run. Empty tables give none.
    """
    spark = counts.sparkSession
    b = budgets.where("capacity_tokens >= 1").select("budget_id", F.col("capacity_tokens").cast("long").alias("capacity"))
    caps = {r.budget_id: r.capacity for r in b.collect()}
    docs = counts.select(doc_id, F.coalesce("n_tokens", F.lit(0)).alias("total"))
    sized = docs.withColumn("b", F.explode(F.array(*[F.struct(F.lit(i).alias("budget_id"), F.lit(c).cast("long").alias("capacity")) for i, c in caps.items()]) if caps else F.expr("array()").cast("array<struct<budget_id:int,capacity:bigint>>")))
    pieces = sized.select(doc_id, "b.budget_id", "b.capacity", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("total") / F.col("b.capacity")) - 1, F.lit(0)))).alias("piece"))
    items = pieces.select("budget_id", doc_id, "piece", (F.col("piece") * F.col("capacity")).alias("token_from"), F.least(F.col("capacity"), F.col("total") - F.col("piece") * F.col("capacity")).alias("n_tokens"))
    histogram = items.where("n_tokens > 0").groupBy("budget_id", "n_tokens").count()
    hist: dict[int, list[tuple[int, int]]] = {}
    for r in histogram.collect():  # bounded by the sum of the capacities
        hist.setdefault(r.budget_id, []).append((r.n_tokens, r["count"]))
    slots = [(i, *row) for i, h in hist.items() for row in plan(h, caps[i])] + [(i, 0, 0, 2**62, 0, 2**62) for i in caps]
    kind = budgets.schema["budget_id"].dataType.simpleString()
    planned = spark.createDataFrame(slots, f"p_budget {kind}, p_length long, rank_from long, rank_to long, first_container long, each long")
    ranked = salted_prefix(items.withColumn("one", F.lit(1)), ["budget_id", "n_tokens"], [doc_id, "piece"], "one", "rank")
    taken = ranked.join(planned, (F.col("budget_id") == F.col("p_budget")) & (F.col("n_tokens") == F.col("p_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    container = F.col("first_container") + F.floor((F.col("rank") - F.col("rank_from")) / F.col("each"))
    return taken.select("budget_id", container.cast("long").alias("container_id"), doc_id, F.col("piece").cast("int").alias("piece"), "token_from", "n_tokens")


def usage(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """budget_id, capacity_tokens, n_containers, n_pieces, n_tokens, fill (tokens held by capacity opened)."""
    held = packed.where("n_tokens > 0").groupBy("budget_id", "container_id").agg(F.count(F.lit(1)).alias("k"), F.sum("n_tokens").alias("t"))
    by = held.groupBy("budget_id").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("k").alias("n_pieces"), F.sum("t").alias("n_tokens"), F.max("t").alias("fullest"))
    return by.join(budgets.select("budget_id", "capacity_tokens"), "budget_id").withColumn("fill", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6))


def broken(packed: DataFrame, counts: DataFrame, budgets: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """budget_id, what, id of all that breaks the rules of packing; empty if nothing does.

    `full`: a container above its capacity; `tokens`: a document whose pieces don't add up to its
    tokens as often as it is told, or aren't there; `cut`: one in several pieces that fits in a container.
    """
    b = budgets.where("capacity_tokens >= 1").select(F.col("budget_id").alias("b_id"), F.col("capacity_tokens").cast("long").alias("capacity"))
    held = packed.groupBy("budget_id", "container_id").agg(F.sum("n_tokens").alias("t")).where("t > 0")
    full = held.join(b, F.col("budget_id") == F.col("b_id")).where("t > capacity").select("budget_id", F.lit("full").alias("what"), F.col("container_id").alias("id"))
    # Both sides as sums by document and budget, in long form.
    want = counts.select(F.col(doc_id).cast("long").alias("id"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n"), F.explode(F.array(*[F.struct(F.lit(r.b_id).alias("budget_id"), F.lit(r.capacity).alias("capacity")) for r in b.collect()])).alias("b")) if not b.isEmpty() else None
    if want is None:
        return full
    want = want.select("b.budget_id", "id", F.lit(0).cast("long").alias("got"), "n", F.lit(0).cast("long").alias("pieces"), F.greatest(F.ceil(F.col("n") / F.col("b.capacity")), F.lit(1)).cast("long").alias("least"))
    got = packed.select("budget_id", F.col(doc_id).cast("long").alias("id"), F.col("n_tokens").cast("long").alias("got"), F.lit(0).cast("long").alias("n"), F.lit(1).cast("long").alias("pieces"), F.lit(0).cast("long").alias("least"))
    sums = want.unionByName(got).groupBy("budget_id", "id").agg(*[F.sum(c).alias(c) for c in ("got", "n", "pieces", "least")])
    tokens = sums.where("got <> n or pieces < least").select("budget_id", F.lit("tokens").alias("what"), "id")
    cut = sums.where("pieces > least").select("budget_id", F.lit("cut").alias("what"), "id")
    return full.unionByName(tokens).unionByName(cut)
