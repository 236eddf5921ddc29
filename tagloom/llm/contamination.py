"""Evaluation texts inside training texts, found with a generalised suffix automaton.

The test items' words become one automaton over all items. Each document streams its words
through it once; at every word the automaton knows the longest passage of any item that ends
there. Where that is long enough, the state that stands for the last `least` words names the
items that hold them. Whatever the corpus' size, the automaton is as large as the test items;
these are cut into blocks of bounded size, and every document meets every block, one block at a
time; what it shares with them is united before anything is counted or cut.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.session import ship, stage

_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Unbroken runs of letters or digits, each case folded: folding the text first could part a word."""
    return list(map(str.casefold, _WORD.findall(text)))


class Automaton:
    """A generalised suffix automaton over word sequences; `items_at` gives the items that hold a state's words."""

    def __init__(self, items: dict[int, list[str]], least: int) -> None:
        self.least = least
        self.ids: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: list[set[int]] = [set()]
        for item, ws in items.items():
            last = 0
            for w in ws:
                last = self._extend(last, self.ids.setdefault(w, len(self.ids)))
                while len(own) < len(self.next):
                    own.append(set())
            # Mark every prefix' state; links carry the mark to all shorter passages.
            at = 0
            for w in ws:
                at = self.next[at][self.ids[w]]
                own[at].add(item)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                own[self.link[s]] |= own[s]
        # The state of the last `least` words: the shortest link that is long enough.
        self.items_at: list[tuple[int, ...]] = [()] * len(own)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            if self.length[s] >= least:
                up = self.link[s]
                self.items_at[s] = self.items_at[up] if self.length[up] >= least else tuple(sorted(own[s]))

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            if self.length[q] == self.length[last] + 1:
                return q
            return self._clone(last, c, q)
        cur = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = new
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def matches(self, ws: list[str]) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """(index of the last word, length of the longest passage ending there, items that hold its last `least` words)."""
        nxt, link, length, least = self.next, self.link, self.length, self.least
        ids = list(map(self.ids.get, ws))
        i, n = 0, len(ids)
        while i < n:
            # A passage lies within a run of known words: shorter runs are passed over.
            try:
                j = ids.index(None, i)
            except ValueError:
                j = n
            if j - i >= least:
                s = m = 0
                for k in range(i, j):
                    c = ids[k]
                    while c not in nxt[s]:  # the root knows every word of the vocabulary
                        s = link[s]
                        m = length[s]
                    s = nxt[s][c]
                    m += 1
                    if m >= least:
                        # m may be shorter than the state's own passages: go up to the one that fits
                        t = s
                        while length[link[t]] >= m:
                            t = link[t]
                        yield k, m, self.items_at[t]
            i = j + 1


_held: list = [None, None]


def _automaton(block: Broadcast, name: str, least: int) -> Automaton:
    """The automaton of the block of this name; a worker holds one at a time."""
    if _held[0] != (name, least):
        _held[:] = [None, None]  # the old one goes before the new one is built
        _held[:] = [(name, least), Automaton({i: words(t) for i, t in block.value}, least)]
    return _held[1]


def _cover(auto: Automaton, ws: list[str]) -> tuple[list[int], list[list[int]]]:
    """The items that share a passage with these words, and the word ranges shared."""
    hit: set[int] = set()
    cover: list[list[int]] = []
    for k, m, its in auto.matches(ws):
        hit.update(its)
        start = k - m + 1
        if cover and start <= cover[-1][1] + 1:
            cover[-1] = [min(start, cover[-1][0]), k]
        else:
            cover.append([start, k])
    return sorted(hit), _united(cover)


_SPAN = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
_SPANS = "array<struct<first:int,last:int>>"


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "eval_item_id", item_text: str = "text", least: int = 12, block_chars: int = 4_000_000, clean: bool = False) -> DataFrame:
    """doc_id, items array<int>, n_words, leaked_words, spans array<struct<first,last>> [, clean_text] of each document that shares `least` consecutive words or more with a test item.

    spans are the word ranges covered by shared passages, leaked_words their total; clean_text is
    the text without them. Test items are gathered in blocks of about block_chars characters, a
    bound on what is sent around at a time. Several blocks change no column: each finds its
    documents in a run of its own, whose few hits are written to the shared folder; then items and
    spans are united by document before anything is counted or cut. Null texts and texts of fewer
    than `least` words share nothing. Repeated documents give their rows each. Empty tables give none.
    """
    spark = docs.sparkSession
    ship(spark)
    some = items.where(F.col(item_text).isNotNull()).select(F.col(item_id).alias("i"), F.col(item_text).alias("t"))
    total = some.agg(F.sum(F.length("t")).alias("n")).first()["n"] or 0
    n_blocks = -(-total // block_chars) or 1
    kind, ikind = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()

    def send(block: int) -> Broadcast:
        part = some if n_blocks == 1 else some.where(F.pmod(F.xxhash64("i"), F.lit(n_blocks)) == block)
        return spark.sparkContext.broadcast(tuple(sorted((r.i, r.t) for r in part.collect())))

    def found(block: Broadcast) -> DataFrame:
        name = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            auto = _automaton(block, name, least)
            for b in batches:
                rows = [(i, *_cover(auto, words(t))) for i, t in enumerate(b.column(1).to_pylist()) if t]
                yield _hits(b, [r for r in rows if r[1]])

        return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, __text string, __items array<bigint>, __spans {_SPANS}")

    if n_blocks == 1:
        hits = found(send(0))
    else:
        parts = []
        for n in range(n_blocks):
            block = send(n)
            parts.append(stage(found(block).select(doc_id, F.md5("__text").alias("__h"), "__items", "__spans").distinct(), "leaks"))
            block.destroy()
        every = reduce(DataFrame.unionByName, parts)
        both = every.groupBy(F.col(doc_id).alias("__d"), "__h").agg(F.array_distinct(F.flatten(F.collect_list("__items"))).alias("__items"), F.flatten(F.collect_list("__spans")).alias("__spans"))
        own = docs.select(doc_id, F.col(text).alias("__text"))
        hits = own.join(both, F.col(doc_id).eqNullSafe(F.col("__d")) & (F.md5("__text") == F.col("__h"))).select(doc_id, "__text", "__items", "__spans")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, leaked, spans, cleaned = [], [], [], []
            for t, s in zip(b.column(1).to_pylist(), b.column(3).to_pylist()):
                cover = _united([[x["first"], x["last"]] for x in s])
                n_words.append(len(_WORD.findall(t)))
                leaked.append(sum(z - a + 1 for a, z in cover))
                spans.append([{"first": a, "last": z} for a, z in cover])
                cleaned.append(_without(t, cover) if clean else None)
            its = pa.array([sorted(x) for x in b.column(2).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), its, pa.array(n_words, pa.int32()), pa.array(leaked, pa.int32()), pa.array(spans, _SPAN), pa.array(cleaned, pa.string())], names=[doc_id, "items", "n_words", "leaked_words", "spans", "clean_text"])

    out = hits.mapInArrow(count, f"`{doc_id}` {kind}, items array<bigint>, n_words int, leaked_words int, spans {_SPANS}, clean_text string").withColumn("items", F.col("items").cast(f"array<{ikind}>"))
    return out if clean else out.drop("clean_text")


def _hits(b: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
    at = pa.array([r[0] for r in rows], pa.int32())
    spans = pa.array([[{"first": a, "last": z} for a, z in r[2]] for r in rows], _SPAN)
    return pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array([r[1] for r in rows], pa.list_(pa.int64())), spans], names=[b.schema.names[0], "__text", "__items", "__spans"])


def _united(spans: list[list[int]]) -> list[list[int]]:
    """Word ranges in order; those that touch are one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _without(text: str, cover: list[list[int]]) -> str:
    """The text without the covered words and what stands between them."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, pos = [], 0
    for a, b in cover:
        out.append(text[pos : at[a][0]])
        pos = at[b][1]
    return "".join(out) + text[pos:]


def decontaminate(docs: DataFrame, items: DataFrame, max_coverage: float = 0.5, **how) -> DataFrame:
    """doc_id, leaked_words, n_words, action, clean_text of leaking documents: `drop` beyond max_coverage, else `cut`."""
    found = leaks(docs, items, clean=True, **how)
    share = F.col("leaked_words") / F.col("n_words")
    return found.withColumn("action", F.when(share > max_coverage, "drop").otherwise("cut")).withColumn("clean_text", F.when(F.col("action") == "cut", F.col("clean_text")))
