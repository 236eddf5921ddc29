"""Keyword-stuffed pages, link lists and product tags: bagged trees on content and link features.

The words of spam are learnt, not listed: of all pages those that are mostly links give the first words, these give further pages, and so on. With these words every page is
read once and whole; its features say how its words are spread over links, menus, product tags,
repeated phrases and other text. Clear pages, by the share of their words in spam passages, are
weak labels. The trees don't see that share: each is grown on a bootstrap of all labelled pages, each split from
a random part of the features, and all vote on all pages. A host's spam rate then moves the vote
of its pages, which settles those that the trees leave open.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.session import ship, stage

FEATURES = ("linked", "tagged", "menu", "stuffed", "listed", "captioned", "selling", "function", "coded", "top_pair", "pair_variety", "words_a_segment", "log_words")

_LINK = re.compile(r"\[url=[^\]]*\].*?\[/url\]|\[[^\]\n]*\]\((?:https?://|www\.)[^)\s]*\)|<a\s[^>]*>.*?</a>|(?:https?://|www\.)[^\s|•,;<>\"]+", re.I | re.S)
_MARK = re.compile(r"(?<![\w&/])[#@][^\s,;|]+")
_SPLIT = re.compile(r"\n+|[.!?:]\s+(?=[^\W\d_a-z]|¿|¡)")
_ITEM = re.compile(r"\s*[,;|•*·»>\t]\s*|\s[-–/]\s|(?<=[^\W\d]): |  +")
_WORD = re.compile(r"[^\W_]+(?:[&'’][^\W_]+)*")
_PLAIN = re.compile(r"[^\W_]+")
#: What parts the words of a text of ASCII alone is a blank, letters are small: words are told by it faster.
_ASCII = {i: chr(i).lower() if chr(i).isalnum() or chr(i) in "&'" else " " for i in range(128)}
_CODE = re.compile(r"[-‐-―]\d|\d\d[A-Za-z]{1,5}\d\d|\d:\d\d")
_SKU = re.compile(r"\W*[A-Za-z]{2,5}-\d{3,}\W*")
_DIGIT = re.compile(r"[0-9]")
_DIGITS = frozenset("0123456789")
_STEPS = "»>/›→"
_PATH = re.compile(rf"\s(?:[{_STEPS}])\s")


class Words(NamedTuple):
    """What is learnt of the corpus' words: those of spam, and those that run through all other text."""

    spam: frozenset[str] = frozenset()
    common: frozenset[str] = frozenset()


def told(text: str) -> tuple[int, int, set[str], set[str]]:
    """Words that plainly are spam, all words, the distinct words of links and marks, those of the rest.

    Plain spam, by structure alone, are the words of links and marks and, in a page of 20 words or
    more with hardly a number, those of pairs of words told three times or more.
    """
    inside: list[str] = []

    def take(m: re.Match) -> str:
        inside.append(m[0].lower())
        return " "

    rest = _LINK.sub(take, text) if _linked(text) else text
    rest = _MARK.sub(take, rest) if "#" in rest or "@" in rest else rest
    plain = _words_in(rest)
    linked = _PLAIN.findall(" ".join(inside)) if inside else []
    clear = len(linked)
    # A word that begins with a digit sorts before a colon, all others after it.
    if len(plain) >= 20 and sum(map(":".__gt__, plain)) * 20 <= len(plain):
        often = {g for g, n in Counter(zip(plain, plain[1:])).items() if n >= 3}
        if often:
            again = [g in often for g in zip(plain, plain[1:])]
            clear += sum(a or b for a, b in zip([*again, False], [False, *again]))
    return clear, len(linked) + len(plain), set(linked), set(plain)


def _words_in(text: str) -> list[str]:
    """The words of the text's small letters, as _WORD finds them."""
    if not text.isascii():
        if "\n" in text:  # no word runs over a line's end
            return [w for line in text.split("\n") for w in _words_in(line)]
        return _WORD.findall(text.lower())
    ws = text.translate(_ASCII).split()
    if "'" in text or "&" in text:
        return [x for w in ws for x in (_WORD.findall(w) if "'" in w or "&" in w else (w,))]
    return ws


def _linked(text: str) -> bool:
    low = text.lower()
    return "www." in low or "://" in low or "[url" in low or "<a" in low


def features(text: str, words: Words) -> tuple[list[float], float]:
    """The page's features, in the order of FEATURES, and the share of its words that the weak label goes by."""
    linked = tagged = 0

    def links(m: re.Match) -> str:
        nonlocal linked
        linked += len(_PLAIN.findall(m[0]))
        return " \x01 "

    def marks(m: re.Match) -> str:
        nonlocal tagged
        tagged += len(_PLAIN.findall(m[0]))
        return " \x02 "

    rest = _LINK.sub(links, text) if _linked(text) else text
    rest = _MARK.sub(marks, rest) if "#" in rest or "@" in rest else rest
    segments = []
    told_pairs: list[tuple[str, str]] = []
    pathy = any(c in rest for c in _STEPS) and _PATH.search(rest)
    selling = function = coded = plain = 0
    spam, common = words
    for raw in _SPLIT.split(rest):
        ws = _words_in(raw)
        if not ws and "\x01" not in raw and "\x02" not in raw:
            continue
        content = [w for w in ws if w not in common]
        nf = len(ws) - len(content)
        ns = sum(map(spam.__contains__, content))
        if _DIGIT.search(raw):
            codes = len(_CODE.findall(raw))
            keys = [w for w in content if w not in spam and w[0] not in _DIGITS and w[-1] not in _DIGITS]
        else:
            codes = 0
            keys = [w for w in content if w not in spam] if ns else content
        grams = list(zip(keys, keys[1:])) if len(keys) > 1 else []
        told_pairs += grams
        segments.append((raw, ws, content, keys, grams, nf, ns, codes))
        plain += len(ws)
        selling += ns
        function += nf
        coded += codes
    total = plain + linked + tagged
    if not total:
        return [0.0] * len(FEATURES), 0.0
    pairs = Counter(told_pairs)
    # Phrases told again and again; one in four words of a sentence belongs to them by chance, not one in two.
    often = {g for g, n in pairs.items() if n >= 3}
    single = Counter([w for s in segments for w in s[3] if len(w) >= 5])
    known = {w for w, n in single.items() if n >= 3}
    sells = selling * 30 >= plain + 1
    listing = sells or often or known  # else no item of a list is known
    menu = stuffed = listed = captions = 0
    kinds: list[int] = []
    for raw, ws, content, keys, grams, nf, ns, codes in segments:
        n = len(ws)
        kind = 0  # 1 spam of some kind, 2 a bare code that goes with its neighbours, 0 other
        if not n:
            kind = 1
        elif pathy and codes == 0 and (paths := len(_PATH.findall(raw))) and (ws[0] in spam or paths > 1) and sum(w[0].isupper() for w in _WORD.findall(raw)) * 2 > n:
            menu += n
            kind = 1
        elif codes * 8 <= n and sells and (_repeats(keys, grams, ns, n) or ns > 1 and ns * 2 >= len(content)):
            stuffed += n
            kind = 1
        elif listing and codes * 8 <= n and nf * 2 <= n and (hit := _items_known(raw, often, known, sells, n, words)):
            listed += hit
            kind = 1
        elif "\x01" in raw and n <= 8 and nf <= 3 and codes == 0:
            captions += n
            kind = 1
        elif n <= 3 and _SKU.fullmatch(raw):
            kind = 2
        kinds.append(kind)
    for i, k in enumerate(kinds):
        if k == 2 and (i and kinds[i - 1] == 1 or i + 1 < len(kinds) and kinds[i + 1] == 1):
            listed += len(segments[i][1])
            kinds[i] = 1
    covered = (menu + stuffed + listed + captions + linked + tagged) / total
    top = max(pairs.values(), default=0) * 2 / total
    return [linked / total, tagged / total, menu / total, stuffed / total, listed / total, captions / total, selling / total, function / total, coded / total, min(top, 1.0), len(pairs) / max(1, sum(pairs.values())), total / max(1, len(segments)), math.log1p(total)], covered


def _repeats(keys: list[str], grams: list, ns: int, n: int) -> bool:
    """A phrase told twice within one sentence, or a long word told so beside words of spam."""
    if len(keys) < 2 or len(set(keys)) == len(keys):
        return False
    if grams:
        g, k = Counter(grams).most_common(1)[0]
        if k >= 2 and k * 2 * 5 >= n:
            return True
    w, k = Counter(keys).most_common(1)[0]
    return len(w) >= 5 and (k >= 3 and k * 6 >= n or k >= 2 and ns > 0 and k * 8 >= n)


def _items_known(raw: str, often: set, known: set, sells: bool, n: int, words: Words) -> int:
    """How many words of a list stand in product items: the page's own keywords, bare, with a size or with a word of spam; 0 unless most do."""
    items = [x for x in _ITEM.split(raw) if x]
    if n > 8 and len(items) < 4:
        return 0
    hit = 0
    for item in items:
        ws = _WORD.findall(item.lower())
        if not ws or len(ws) > 8 or _CODE.search(item) and not _SKU.fullmatch(item):
            continue
        content = [w for w in ws if w not in words.common]
        keys = [w for w in content if w not in words.spam and w[0] not in _DIGITS and w[-1] not in _DIGITS]
        if _SKU.fullmatch(item):
            hit += len(ws) if sells else 0
        elif len(content) < len(ws) - 2 or len(keys) > 4:
            continue
        elif sells and len(content) > len(keys) or not set(zip(keys, keys[1:])).isdisjoint(often) or keys and len(keys) <= 2 and not known.isdisjoint(keys):
            hit += len(ws)
    return hit if hit * 2 > n else 0


def learn_words(pages: list[tuple[int, int, list[str], list[str]]], rounds: int = 3, ratio: float = 20.0) -> Words:
    """The words of spam and the common words, from pages as `told` has them. No list is given.

    Pages that are mostly links, marks and repeated pairs of words are the first examples of spam;
    their words that other pages hold rarely are the first words of spam. Pages of whose words
    three in ten are such are the next examples, and so on. A word belongs to spam if its share
    of pages there is `ratio` times that of the others (half that in the round before, and so on:
    at first the others still hold most of the spam); a word of one page in a hundred that is
    rarer in spam than elsewhere is common.
    """
    every: Counter = Counter()
    for _, _, _, plain in pages:
        every.update(plain)
    bad = {i for i, (n, total, _, _) in enumerate(pages) if total and n > 0.6 * total}
    spam: frozenset[str] = frozenset()
    here: Counter = Counter()
    for r in range(rounds + 1):
        here, plainly = Counter(), Counter()
        for i in bad:
            plainly.update(pages[i][3])
            here.update({*pages[i][2], *pages[i][3]} if r == 0 else pages[i][3])
        good = len(pages) - len(bad)
        spam = frozenset(w for w, n in here.items() if n >= 2 and n >= 0.003 * len(bad) and n * (good + 1) >= ratio / 2 ** (rounds - r) * len(bad) * (every[w] - plainly[w] + 1))
        if r < rounds:
            bad = {i for i, (n, total, _, plain) in enumerate(pages) if total and (n > 0.6 * total or len(plain) and sum(w in spam for w in plain) >= max(2, 0.3 * len(plain)))}
    least = max(2, 0.01 * len(pages))
    common = frozenset(w for w, n in every.items() if n >= least and here[w] * len(pages) < n * max(1, len(bad)) and w not in spam)
    return Words(spam, common)


class Trees:
    """Bagged decision trees as plain arrays: small enough to go to every worker."""

    def __init__(self, x: np.ndarray, y: np.ndarray, n_trees: int = 25, depth: int = 8, least: int = 3, tried: int = 4, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(n_trees):
            at = rng.integers(0, len(x), len(x))
            nodes: list[tuple] = []
            self._grow(x[at], y[at].astype(float), depth, least, tried, rng, nodes)
            self.trees.append(nodes)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, least: int, tried: int, rng: np.random.Generator, nodes: list) -> int:
        """Each split takes the best of `tried` features drawn anew, so no feature decides alone in all trees."""
        me = len(nodes)
        nodes.append(None)
        rate = float((y.sum() + 0.5) / (len(y) + 1))
        best = None
        if depth and len(y) >= 2 * least and 0 < y.sum() < len(y):
            for f in rng.permutation(x.shape[1])[:tried]:
                order = np.argsort(x[:, f], kind="stable")
                v, c = x[order, f], np.cumsum(y[order])
                k = np.arange(1, len(y))
                left, right = c[:-1], c[-1] - c[:-1]
                gini = left * (1 - left / k) + right * (1 - right / (len(y) - k))
                ok = (v[1:] > v[:-1]) & (k >= least) & (len(y) - k >= least)
                if ok.any():
                    i = int(np.argmin(np.where(ok, gini, np.inf)))
                    if best is None or gini[i] < best[0] - 1e-12:
                        best = (gini[i], int(f), (v[i] + v[i + 1]) / 2)
        if best is None:
            nodes[me] = (-1, 0.0, 0, 0, rate)
            return me
        _, f, cut = best
        go = x[:, f] <= cut
        a = self._grow(x[go], y[go], depth - 1, least, tried, rng, nodes)
        b = self._grow(x[~go], y[~go], depth - 1, least, tried, rng, nodes)
        nodes[me] = (f, float(cut), a, b, rate)
        return me

    def rate(self, x: np.ndarray) -> np.ndarray:
        """The trees' mean spam rate of each row."""
        total = np.zeros(len(x))
        for nodes in self.trees:
            f, cut, a, b, r = (np.array(c) for c in zip(*nodes))
            at = np.zeros(len(x), int)
            for _ in range(64):
                inner = f[at] >= 0
                if not inner.any():
                    break
                go = x[np.arange(len(x)), np.maximum(f[at], 0)] <= cut[at]
                at = np.where(inner, np.where(go, a[at], b[at]), at)
            total += r[at]
        return total / len(self.trees)


#: Distinct words that a task counts in memory before it hands them on.
_HELD = 200_000


def corpus_words(docs: DataFrame, text: str = "text", rounds: int = 3, ratio: float = 20.0) -> Words:
    """`learn_words` over all pages: read once, then counted once a round, in Arrow batches whose counts are added up.

    Only words told on enough pages to pass a threshold come to the driver, a few thousand at most.
    """
    kinds = "n long, total long, inside string, plain string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [told(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([" ".join(r[2]) for r in rows], pa.string()), pa.array([" ".join(r[3]) for r in rows], pa.string())], names=["n", "total", "inside", "plain"])

    pages = stage(docs.where(F.col(text).isNotNull()).select(text).mapInArrow(read, kinds), "told")

    def counted(spam: frozenset[str] | None) -> DataFrame:
        """w, here, plainly, every: pages of spam with the word, those with it outside links, all pages with it outside links. The row '' counts pages: here those of spam, every all.

        With words of spam, the links don't count and `every` stays as it was, so only the pages of spam are counted: w, here.
        """

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            here, plainly, every = Counter(), Counter(), Counter()

            def out() -> pa.RecordBatch:
                if spam is not None:
                    return pa.RecordBatch.from_arrays([pa.array(list(here), pa.string()), pa.array(list(here.values()), pa.int64())], names=["w", "here"])
                ws = list(every.keys() | here.keys())
                return pa.RecordBatch.from_arrays([pa.array(ws, pa.string()), *[pa.array([c.get(w, 0) for w in ws], pa.int64()) for c in (here, plainly, every)]], names=["w", "here", "plainly", "every"])

            for b in batches:
                insides = b.column(3).to_pylist() if spam is None else [""] * b.num_rows
                for n, total, plain, inside in zip(*[b.column(i).to_pylist() for i in range(3)], insides):
                    ws = plain.split(" ") if plain else []
                    if spam is None:
                        every.update(ws)
                        every[""] += 1
                    if total and (n > 0.6 * total or spam and ws and len(spam.intersection(ws)) >= max(2, 0.3 * len(ws))):
                        if spam is None:
                            plainly.update(ws)
                        here.update({*ws, *inside.split()} if spam is None else ws)
                        here[""] += 1
                if max(len(every), len(here)) > _HELD:
                    yield out()
                    here.clear(), plainly.clear(), every.clear()
            yield out()

        kinds = ("here", "plainly", "every") if spam is None else ("here",)
        asked = ["n", "total", "plain", *(["inside"] if spam is None else [])]
        return pages.select(*asked).mapInArrow(run, "w string, " + ", ".join(f"{c} long" for c in kinds)).groupBy("w").agg(*[F.sum(c).alias(c) for c in kinds])

    first = found = stage(counted(None), "words")
    told_all = first.select(F.col("w").alias("e_w"), "every")
    n_all = (top["every"] or 0) if (top := first.where("w = ''").first()) else 0
    spam: frozenset[str] = frozenset()
    for r in range(rounds + 1):
        if r:
            found = stage(counted(spam), "words")
        n_bad = (top["here"] or 0) if (top := found.where("w = ''").first()) else 0
        likely = found.where((F.col("w") != "") & (F.col("here") >= 2) & (F.col("here") >= 0.003 * n_bad))
        if r:
            likely = likely.join(told_all, F.col("w") == F.col("e_w")).withColumn("plainly", F.col("here"))
        seen = F.col("here") * (n_all - n_bad + 1) >= ratio / 2 ** (rounds - r) * n_bad * (F.col("every") - F.col("plainly") + 1)
        spam = frozenset(x["w"] for x in likely.where(seen).select("w").collect())
    some = told_all.where((F.col("e_w") != "") & (F.col("every") >= max(2, 0.01 * n_all))).join(found.select("w", "here"), F.col("w") == F.col("e_w"), "left")
    common = some.where(F.coalesce("here", F.lit(0)) * n_all < F.col("every") * max(1, n_bad)).select("e_w").collect()
    return Words(spam, frozenset(x["e_w"] for x in common) - spam)


#: Cut points tried for a feature.
BINS = 256


def binned(x: np.ndarray) -> np.ndarray:
    """The bin of each value: shares in 256ths, the two lengths by sixteenths of a logarithm; 0 only for 0."""
    y = np.where(np.arange(x.shape[1]) == FEATURES.index("words_a_segment"), np.log1p(np.maximum(x, 0)) * 16, np.where(np.arange(x.shape[1]) == FEATURES.index("log_words"), x * 16, x * (BINS - 1)))
    return np.clip(np.ceil(y), 0, BINS - 1).astype(np.int64)


def _matrix(x: pa.Array) -> np.ndarray:
    """The features of a batch's pages, none of them null."""
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def _drawn(h: np.ndarray, n_trees: int) -> np.ndarray:
    """How often each page (by the hash of its id) stands in each tree's bootstrap sample: 0, 1, 2, ... as a sample of all pages drawn with replacement has them."""
    with np.errstate(over="ignore"):
        z = h.astype(np.int64).view(np.uint64)[:, None] + (np.arange(1, n_trees + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    chance = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    return np.searchsorted(chance, (z >> np.uint64(11)).astype(float) / 2**53, side="right")


class Forest(Trees):
    """Bagged trees grown on all labelled pages, level by level: a pass counts the pages of each node by feature bin, in Arrow batches; only these counts come to the driver."""

    def __init__(self, labelled: DataFrame, n_trees: int = 25, depth: int = 8, least: int = 3, tried: int = 4, seed: int = 1) -> None:
        """labelled: h (a hash of the page's id), x, y (0 or 1). Both classes weigh the same."""
        n_y = {r["y"]: r["n"] for r in labelled.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
        self.trees = []
        if not (n_y.get(0) and n_y.get(1)):
            return
        fair = {y: sum(n_y.values()) / 2 / n for y, n in n_y.items()}
        rng = np.random.default_rng(seed)
        nodes: list[list] = [[None] for _ in range(n_trees)]
        open_: list[list[int]] = [[0] for _ in range(n_trees)]
        asked = {(t, 0): rng.permutation(len(FEATURES))[:tried].tolist() for t in range(n_trees)}
        for level in range(depth + 1):
            if not asked:
                break
            counts = self._count(labelled, nodes, asked)
            nxt = {}
            for (t, me), fs in asked.items():
                c = counts.get((t, me), np.zeros((len(fs), BINS, 2)))
                w0, w1 = c[:, :, 0] * fair[0], c[:, :, 1] * fair[1]
                s0, s1 = float(w0[0].sum()), float(w1[0].sum())
                best = None
                if level < depth and s0 and s1:
                    a0, a1, k = np.cumsum(w0, 1)[:, :-1], np.cumsum(w1, 1)[:, :-1], np.cumsum(c.sum(2), 1)[:, :-1]
                    all_k = c[0].sum()
                    ok = (k >= least) & (all_k - k >= least)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        gini = a0 * a1 / (a0 + a1) + (s0 - a0) * (s1 - a1) / (s0 + s1 - a0 - a1)
                    gini = np.where(ok, gini, np.inf)
                    i, j = np.unravel_index(int(np.argmin(gini)), gini.shape)
                    if gini[i, j] < np.inf:
                        # Between two values all cuts are as good: the middle one.
                        worse = np.flatnonzero(gini[i, j:] > gini[i, j] + 1e-12)
                        best = (fs[i], int(j + (worse[0] - 1 if len(worse) else gini.shape[1] - 1 - j) // 2))
                rate = (s1 + 0.5) / (s0 + s1 + 1)
                if best is None:
                    nodes[t][me] = (-1, 0.0, 0, 0, rate)
                    continue
                left, right = len(nodes[t]), len(nodes[t]) + 1
                nodes[t] += [None, None]
                nodes[t][me] = (best[0], float(best[1]), left, right, rate)
                for child in (left, right):
                    nxt[t, child] = rng.permutation(len(FEATURES))[:tried].tolist()
            asked = nxt
        self.trees = nodes

    @staticmethod
    def _count(labelled: DataFrame, nodes: list[list], asked: dict) -> dict:
        by_tree: dict[int, dict[int, list[int]]] = {}
        for (t, me), fs in asked.items():
            by_tree.setdefault(t, {})[me] = fs
        known = [[n if n else (-1, 0.0, 0, 0, 0.0) for n in tree] for tree in nodes]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict = {}
            for b in batches:
                if not b.num_rows:
                    continue
                x = binned(_matrix(b.column(1)))
                y, often = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64), _drawn(b.column(0).to_numpy(zero_copy_only=False), len(known))
                for t, wanted in by_tree.items():
                    i = np.flatnonzero(often[:, t])
                    xs, slot = x[i], np.full(len(known[t]), -1)
                    slot[list(wanted)] = np.arange(len(wanted))
                    at = slot[_reached(known[t], xs)]
                    i, xs, at = i[at >= 0], xs[at >= 0], at[at >= 0]
                    fs = np.array(list(wanted.values()))
                    tried = fs.shape[1]
                    got = np.zeros(len(wanted) * tried * BINS * 2)
                    for k in range(tried):
                        got += np.bincount(((at * tried + k) * BINS + xs[np.arange(len(xs)), fs[at, k]]) * 2 + y[i], often[i, t], len(got))
                    for me, v in zip(wanted, got.reshape(len(wanted), tried, BINS * 2)):
                        sums[t, me] = sums[t, me] + v if (t, me) in sums else v
            for (t, me), v in sums.items():
                flat = v.ravel()
                i = np.flatnonzero(flat)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), t)), pa.array(np.full(len(i), me)), pa.array(i), pa.array(flat[i].astype(np.int64))], names=["t", "node", "i", "n"])

        out: dict = {}
        for r in labelled.select("h", "x", "y").mapInArrow(run, "t long, node long, i long, n long").groupBy("t", "node", "i").agg(F.sum("n").alias("n")).toPandas().itertuples(index=False):
            out.setdefault((r.t, r.node), np.zeros(len(asked[r.t, r.node]) * BINS * 2))[r.i] = r.n
        return {k: v.reshape(-1, BINS, 2) for k, v in out.items()}

    def rate(self, x: np.ndarray) -> np.ndarray:
        b = binned(x)
        return sum(np.array([n[4] for n in nodes])[_reached(nodes, b)] for nodes in self.trees) / len(self.trees)


def _reached(nodes: list[tuple], x: np.ndarray) -> np.ndarray:
    """The node in which each row ends."""
    f, cut, a, b, _ = (np.array(c) for c in zip(*nodes))
    at = np.zeros(len(x), int)
    flat, width = np.ascontiguousarray(x).ravel(), x.shape[1]
    left = np.arange(len(x)) if f[0] >= 0 else np.zeros(0, int)
    while len(left):
        here = at[left]
        here = np.where(flat[left * width + f[here]] <= cut[here], a[here], b[here])
        at[left] = here
        left = left[f[here] >= 0]
    return at


def page_features(docs: DataFrame, words: Words, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """doc_id, host, x array<double> (FEATURES), covered (what the weak label goes by). A null text has the features of an empty one: all 0."""
    ship(docs.sparkSession)
    kinds = f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, host string, x array<double>, covered double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(t, words) if t else ([0.0] * len(FEATURES), 0.0) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in rows], pa.list_(pa.float64())), pa.array([c for _, c in rows], pa.float64())], names=[doc_id, "host", "x", "covered"])

    return docs.select(doc_id, F.col(host).cast("string").alias("host"), text).mapInArrow(run, kinds)


def weak_label(covered: str = "covered") -> Column:
    """1 for clear spam, 0 for clear text, null for what is open."""
    return F.when(F.col(covered) >= 0.65, 1).when(F.col(covered) <= 0.35, 0)


def classify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", max_labels: int | None = None, host_weight: float = 0.3, threshold: float = 0.5) -> DataFrame:
    """doc_id, host, page_rate, host_rate, spam_rate, is_spam for every page.

    The words are learnt from all pages, the trees from all weakly labelled ones. A caller may bound
    these by max_labels, half of each class at most, those with the smallest hashes of their ids. A host's rate is its pages' mean, drawn to that of all
    pages by 20 pages' weight; it shifts the log odds of its pages by host_weight times its own
    log odds against all pages'. Pages without a host form one host. Without both labels the weak label itself is the page's rate (0.5 where open). Empty and null texts are no
    spam. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    pages = stage(page_features(docs, corpus_words(docs, text), doc_id, text, host), "pages")
    labelled = pages.withColumn("y", weak_label()).where("y is not null")
    labelled = labelled.select(F.coalesce(F.xxhash64(doc_id), F.lit(0)).alias("h"), doc_id, "x", "y")
    if max_labels is not None:
        labelled = labelled.where("y = 0").orderBy("h", doc_id).limit(max_labels // 2).unionByName(labelled.where("y = 1").orderBy("h", doc_id).limit(max_labels // 2))
    trees = Forest(labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(2))
            c = b.column(3).to_numpy(zero_copy_only=False)
            r = trees.rate(x) if trees.trees else np.where(c >= 0.65, 0.98, np.where(c <= 0.35, 0.02, 0.5))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.clip(r, 0.02, 0.98)), pa.array(x[:, -1] > 0)], names=[doc_id, "host", "page_rate", "some"])

    # Rated once: the hosts and the whole both sum it.
    rated = stage(pages.mapInArrow(run, f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, host string, page_rate double, some boolean"), "rated")
    all_rate = rated.agg(F.avg("page_rate").alias("p")).first()["p"] or 0.5
    hosts = rated.groupBy(F.col("host").alias("h_host")).agg(((F.sum("page_rate") + 20 * all_rate) / (F.count(F.lit(1)) + 20)).alias("host_rate"))
    both = rated.join(hosts, F.col("host").eqNullSafe(F.col("h_host")))
    odds = lambda c: F.log(c / (1 - c))
    moved = odds(F.col("page_rate")) + host_weight * (odds(F.col("host_rate")) - math.log(all_rate / (1 - all_rate)))
    rate = F.when(F.col("some"), 1 / (1 + F.exp(-moved))).otherwise(0.0)
    return both.select(doc_id, "host", "page_rate", "host_rate", rate.alias("spam_rate"), (rate >= threshold).alias("is_spam"))
