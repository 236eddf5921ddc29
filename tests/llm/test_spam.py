import random

import numpy as np
import pytest

from tagloom.llm import spam as S

KEYS = ["gate valve", "cable tray", "earth rod", "flow meter", "pipe flange"]
SELL = ["buy", "cheap", "price", "supplier", "near me", "online"]


def sham(rnd, n=12):
    k = rnd.choice(KEYS)
    return " ".join(rnd.choice([f"A {k} is a {k}, so get {k} {rnd.choice(SELL)} here.", f"Looking for {k}? Our {k} is the {rnd.choice(SELL)} {k} for every {k} buyer."]) for _ in range(n))


def listing(rnd, n=40):
    return rnd.choice([" | ", ", ", "\n", " / "]).join(f"{rnd.choice(KEYS)} {rnd.choice(SELL)}" for _ in range(n))


def links(rnd, n=30):
    return "\n".join(f"https://{rnd.choice(KEYS).replace(' ', '-')}.example/a/b-{i}" for i in range(n))


def tags(rnd, n=40):
    return " ".join(f"#{rnd.choice(KEYS).replace(' ', '')}{rnd.choice(SELL)}" for _ in range(n))


def menu(rnd, n=20):
    return "\n".join(f"Home » {rnd.choice(KEYS).title()} » {rnd.choice(KEYS).title()}" for _ in range(n))


def prose(rnd, n=12):
    rooms = ["deck two", "the metering skid", "bay 14"]
    return " ".join(f"The pump {rnd.randint(20, 90)}-PA-{rnd.randint(1000, 9999)} in {rnd.choice(rooms)} was checked on day {rnd.randint(1, 300)} because the vendor had raised a query." for _ in range(n))


def schedule(rnd, n=25):
    return "VALVE | TYPE | SIZE\n" + "\n".join(f"{rnd.randint(20, 90)}CB{rnd.randint(1000, 9999)} | Check Valve | {rnd.randint(1, 24)}\" | 4\"-GI-{rnd.randint(20, 90)}-{rnd.randint(1000, 9999)}-AC21" for _ in range(n))


def log(rnd, n=20):
    return "\n".join(f"New earth rod EP-{rnd.randint(10, 99)} was tested in bay 14 at {rnd.randint(10, 23)}:{rnd.randint(10, 59)}, no leak seen." for _ in range(n))


def learnt(seed=5, n=600):
    """Words learnt from pages of all kinds, without labels."""
    return S.learn_words([(lambda r: (r[0], r[1], list(r[2]), list(r[3])))(S.told(t)) for _, t, _, _, _ in corpus(n, seed)])


@pytest.mark.parametrize("make,spam", [(sham, 1), (listing, 1), (links, 1), (tags, 1), (menu, 1), (prose, 0), (schedule, 0), (log, 0)])
def test_covered_share_of_clear_pages(make, spam):
    rnd = random.Random(1)
    x = [S.features(make(rnd), learnt())[1] for _ in range(30)]
    assert min(x) > 0.65 if spam else max(x) < 0.35


def corpus(n, seed):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        make = rnd.choice([sham, listing, links, tags, menu, prose, prose, prose, schedule, log, log])
        bad = make in (sham, listing, links, tags, menu)
        text = make(rnd)
        if bad and rnd.random() < 0.3:
            text += "\n" + prose(rnd, 1)
        if not bad and rnd.random() < 0.2:
            text += "\n" + listing(rnd, 5)
        out.append((i, text, f"h{rnd.randint(0, 5)}", int(bad), "extra"))
    return out


def test_held_out_accuracy(spark):
    rows = corpus(700, 2)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, truth int, host string")
    got = {r.doc_id: r for r in S.classify(df.drop("truth"), max_labels=200).collect()}
    right = sum(got[i].is_spam == bool(y) for i, _, _, y, _ in rows)
    assert len(got) == len(rows) and right / len(rows) >= 0.97


def test_trees_learn_and_bag():
    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(int)
    t = S.Trees(x[:400], y[:400], n_trees=9)
    assert ((t.rate(x[400:]) > 0.5) == y[400:]).mean() > 0.9 and len(t.trees) == 9


def test_a_host_moves_open_pages_only(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice([sham, links, listing])(rnd), "bad") for i in range(40)] + [(100 + i, prose(rnd), "good") for i in range(40)]
    rows += [(201, prose(rnd), "bad"), (202, sham(rnd), "good"), (203, sham(rnd), None)]
    got = {r.doc_id: r for r in S.classify(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not got[201].is_spam and got[202].is_spam and got[203].is_spam
    assert got[201].spam_rate > got[100].spam_rate and got[0].host_rate > got[100].host_rate


def test_odd_texts_and_empty_tables(spark):
    schema = "doc_id long, text string, source string"
    rows = [(1, None, "a"), (2, "", None), (3, "\n \t", "a"), (4, "x" * 200_000, "a"), (5, "#" * 5000, "a"), (6, "word", "a"), (6, "word", "a"), (7, prose(random.Random(1), 3000), "a")]
    got = S.classify(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 8 and not any(r.is_spam for r in got)
    assert S.classify(spark.createDataFrame([], schema)).count() == 0


def test_links_count_in_any_case_and_form():
    from tagloom.llm import spam

    for text in ('<a href="/about">Contact us</a>', '<A HREF="/about">Contact us</A>', "WWW.EXAMPLE.COM", "[URL=/x]Contact us[/URL]"):
        assert spam.features(text, spam.Words())[0][spam.FEATURES.index("linked")] == 1.0


def test_words_are_learnt_without_a_list():
    w = learnt()
    assert {"buyer", "looking", "here"} <= w.spam and not {"pump", "was", "the", "vendor", "rod"} & w.spam
    assert {"the", "was", "pump"} <= w.common and not w.common & w.spam
    assert S.learn_words([]) == S.Words(frozenset(), frozenset())


def test_trees_find_what_the_label_leaves_open():
    """With words learnt from too few pages the label's share misses spam that the trees still find by other features."""
    rows = corpus(900, 8)
    poor = S.Words(frozenset(sorted(learnt().spam)[::3]), learnt().common)
    x, c = map(np.array, zip(*[S.features(t, poor) for _, t, _, _, _ in rows]))
    y = np.array([v for *_, v, _ in rows])
    half = np.arange(len(rows)) < 600
    sure = half & ((c >= 0.65) | (c <= 0.35))
    trees = S.Trees(x[sure], (c[sure] >= 0.65).astype(int))
    held = ~half
    assert (((trees.rate(x) > 0.5) == y)[held]).mean() >= (((c > 0.5) == y)[held]).mean()
    used = {n[0] for t in trees.trees for n in t if n[0] >= 0}
    assert len(used) >= 4


def test_words_come_from_all_pages(spark, monkeypatch):
    """Counted in batches over the whole table, with handing on in between, they are those of `learn_words` over a list of all pages."""
    monkeypatch.setattr(S, "_HELD", 20)
    df = spark.createDataFrame([(i, t) for i, t, _, _, _ in corpus(600, 5)] + [(9999, None)], "doc_id long, text string").repartition(5)
    assert S.corpus_words(df) == learnt(5, 600)
    assert S.corpus_words(df.limit(0)) == S.Words(frozenset(), frozenset())


def test_trees_grow_on_all_labels(spark):
    """No page is left out of the counts: the first node of each tree has all pages, as often as they were drawn."""
    rng = np.random.default_rng(0)
    x = rng.random((6000, len(S.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(int)
    df = spark.createDataFrame([(i * 7919, x[i].tolist(), int(y[i])) for i in range(5000)], "h long, x array<double>, y int")
    got = S.Forest._count(df, [[None], [None]], {(0, 0): [0, 1], (1, 0): [2]})
    often = S._drawn(np.arange(5000) * 7919, 2)
    assert [got[t, 0][0].sum() for t in (0, 1)] == often.sum(0).tolist() and 0.95 < often.mean() < 1.05
    f = S.Forest(df, n_trees=5, tried=len(S.FEATURES))
    assert len(f.trees) == 5 and ((f.rate(x[5000:]) > 0.5) == y[5000:]).mean() > 0.9


def test_words_of_ascii_texts_are_those_of_the_pattern():
    """Words are told by translation where a text (or a line of it) is ASCII; joined, loose and odd ones stay as the pattern has them."""
    texts = ["", "R&D's don't-stop 'quoted' a & b &x y& rock'n'roll", "snake_case A1_b2 \x01 5-10", "Größe L&M’s\nplain LINE 'tis\nNAÏVE", "a''b &&", "1'2 x\ty\r\nz"]
    for t in texts:
        assert S._words_in(t) == S._WORD.findall(t.lower())
