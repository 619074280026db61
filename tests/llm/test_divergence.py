"""Source divergence against plain integers."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from lodestack.llm import divergence as div

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = {k: k + 32 for k in range(65, 91)}


def plain(rows, ranks=200):
    """Every (lang, source, part, item, value, rank) by the definition."""
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(FOLD))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [(s, w) for k, s, w in docs if k == lang]
        often = Counter(t for _, w in own for t in set(w))
        kept = [t for t in often if often[t] >= 3]
        count = {s: Counter() for s, _ in own}
        for s, w in own:
            count[s].update(t for t in w if often[t] >= 3)
        whole = sum(count.values(), Counter())

        def shares(c, kept=kept):
            return {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in count.items()}, shares(whole)
        for s in count:
            far = [(h, sum((p[s][t] - p[h][t]) ** 2 // p[h][t] for t in kept)) for h in count if h != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if count[s][t] > 0 and p[s][t] > q[t]]
            for part, items, most in (("pair", far, len(far)), ("term", terms, ranks)):
                order = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, t, v, k + 1) for k, (t, v) in enumerate(order)]
    return sorted(out)


def rows(seed=1, sources=12, n=260):
    rng = random.Random(seed)
    words = [f"w{'abcdefghij'[k % 10]}{chr(97 + k // 10)}" for k in range(120)] + ["Été", "ÜBER", "日本", "don't", "x9y"]
    out = []
    for _ in range(n):
        s = rng.randrange(sources)
        pool = words[:10] + words[s * 8 : s * 8 + 16] + words[-5:]
        out.append((" ".join(rng.choice(pool) for _ in range(rng.randrange(40))) + rng.choice(["", "!", "\n", " A-b"]), rng.choice(["en", "fr", None]), f"s{s}" if s else None))
    return out + [(None, "en", "silent"), ("", "zz", "a"), ("one two", "zz", "b"), (None, None, None), out[0], out[0], ("Solo " * 50, "yy", "only"), ("solo", "yy", "only"), ("solo", "yy", "only")]


SCHEMA = "text string, lang string, source string, value long, rank string, term int"


def frame(spark, data):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in data], SCHEMA)


@pytest.mark.parametrize("limits", [{}, {"tile": 3, "postings": 40}, {"tile": 1, "postings": 10**9, "ranks": 5}])
def test_all_rows(spark, limits):
    got = sorted(tuple(r) for r in div.divergence(frame(spark, rows()).repartition(4), **limits).collect())
    assert got == plain(rows(), limits.get("ranks", 200))


def test_empty_and_small(spark, monkeypatch):
    assert div.divergence(frame(spark, rows()).limit(0)).count() == 0
    data = [("a b c", "en", "x"), ("a", "en", "y")]
    assert sorted(tuple(r) for r in div.divergence(frame(spark, data)).collect()) == plain(data) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
    monkeypatch.setattr(div, "PIECE", 7)
    text = " ".join(t for t, _, _ in rows() if t)
    assert {k.decode(): v for k, v in div._counted(text.encode()).items()} == Counter(TERM.findall(text.translate(FOLD)))
    assert div._counted(b"A" * 100) == {b"a" * 100: 1}


@pytest.mark.parametrize("share", [0.0, 0.4, 1.0])
def test_heavy_and_light_terms_add_up(share):
    """The split decides the way, never the sum."""
    rng = np.random.default_rng(3)
    count = rng.integers(0, 4, (9, 50)) * (rng.random((9, 50)) < 0.5)
    total = count.sum(axis=1) + 60
    part = lambda c: (*np.nonzero(c), c[np.nonzero(c)])
    heavy = rng.random(50) < share
    got = div.tile_sums(part(count[:4]), part(count[3:]), heavy, total[:4], total[3:])
    p = np.array([[1 + 10**9 * (int(c) + 1) // int(n) for c in r] for r, n in zip(count, total, strict=True)])
    zero = [1 + 10**9 // int(n) for n in total]
    used = range(50)
    for i in range(4):
        for j in range(6):
            h = j + 3
            none = (zero[i] - zero[h]) ** 2 // zero[h]
            assert got[i, j] == sum((int(p[i, t]) - int(p[h, t])) ** 2 // int(p[h, t]) - none for t in used)


def test_shares_of_huge_counts(spark):
    many = [(0, 1), (5, 7), (10**12, 3 * 10**12 + 1), (9 * 10**15 - 1, 9 * 10**15), (10**15, 9 * 10**15 - 7)]
    want = [1 + 10**9 * (c + 1) // n for c, n in many]
    assert div.shares(np.array([c for c, _ in many]), np.array([n for _, n in many])).tolist() == want
    got = spark.createDataFrame(many, "c long, n long").select(div.share(div.F.col("c"), div.F.col("n")).alias("p")).collect()
    assert [r.p for r in got] == want
