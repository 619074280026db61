"""SimHash near-dedup against plain fingerprints and all pairs."""

import random

import numpy as np
import pytest
import xxhash

from lodestack.llm import simhash_dedup as sim
from lodestack.llm.queries import QUERIES
from tests import oracle

SCHEMA = "doc_id long, text string, fp int, label string"


def plain_print(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, ids, most=4):
    """The least id (None last) reachable over all pairs."""
    x = np.array(prints, dtype=np.uint64)
    seen, out = {}, [None] * len(x)
    for i in range(len(x)):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            for y in np.flatnonzero(np.bitwise_count(x ^ x[todo.pop()]) <= most).tolist():
                if y not in group:
                    group.add(y)
                    todo.append(y)
        least = min((ids[k] for k in group if ids[k] is not None), default=None)
        for k in group:
            seen[k], out[k] = True, least
    return out


def spoilt(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"w{rng.randrange(50)}"
    return " ".join(out)


def documents():
    rng = random.Random(5)
    base = [[f"w{rng.randrange(300)}" for _ in range(120)] for _ in range(20)]
    texts = [spoilt(rng, base[i % 20], i % 5) for i in range(300)]
    texts += [None, "", "  \n ", "one", "ONE", "one two three", "One\ttwo  three", "one two three four", "été ÉTÉ x a b", "x" * 3000, "a b " * 5]
    return [(None if i % 41 == 7 else i, t) for i, t in enumerate(texts)]


def test_fingerprints_and_components(spark):
    rows = documents()
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows + rows[:9]], SCHEMA)
    got = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in sim.simhash_components(frame.repartition(5)).collect()), key=str)
    rows = rows + rows[:9]
    prints = [plain_print(t) for _, t in rows]
    want = sorted(zip([i for i, _ in rows], prints, plain_components(prints, [i for i, _ in rows]), strict=True), key=str)
    assert got == want
    assert sim.simhash_components(frame.limit(0)).count() == 0
    lone = spark.createDataFrame([(None, "a b c d e"), (3, None)], "doc_id long, text string")
    assert sorted(map(str, sim.simhash_components(lone).select("doc_id", "component_id").collect())) == ["Row(doc_id=3, component_id=3)", "Row(doc_id=None, component_id=None)"]


def test_long_texts_in_pieces(monkeypatch):
    rng = random.Random(1)
    text = " ".join(rng.choice(["alpha", "Beta", "gamma\n", "d" * 90, "é"]) for _ in range(4000))
    whole = sim.fingerprint(text.encode())
    for piece in (1, 7, 50, 1000):
        monkeypatch.setattr(sim, "PIECE", piece)
        assert sim.fingerprint(text.encode()) == whole == plain_print(text)
    assert sim.fingerprint(b"y" * 500) == plain_print("y" * 500)


def clouds(rng, n):
    """Fingerprints in dense clouds, chains, and alone."""
    out = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(n):
            out.add(centre ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(5))}))
    for _ in range(5):
        at = rng.getrandbits(64)
        for _ in range(20):
            out.add(at)
            at ^= sum({1 << rng.randrange(64) for _ in range(rng.choice((3, 4, 5)))})
    return sorted(out | {rng.getrandbits(64) for _ in range(n)})


@pytest.mark.parametrize("heavy, leaders", [(10_000, 64), (40, 4), (6, 1)])
def test_buckets_of_any_size(spark, heavy, leaders):
    prints = clouds(random.Random(heavy), 60)
    frame = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in prints], "fp long")
    got = {r.node % (1 << 64): r.label % (1 << 64) for r in sim.links(frame, heavy=heavy, leaders=leaders).collect()}
    parts = lambda label: sorted(sorted(x for x in prints if label(x) == c) for c in {label(x) for x in prints})
    least = dict(zip(prints, plain_components(prints, prints), strict=True))
    assert parts(lambda x: got.get(x, x)) == parts(least.get)


@pytest.mark.parametrize("limits", [(0, 0, 0, 0, 0), (1, 0, 0, 0), (1, 2), (2, 0, 0), (3, -1, 0), (4,), (-1, 4)])
def test_unequal_thresholds_lose_no_link(spark, monkeypatch, limits):
    groups = sim.bit_groups(np.eye(64), 2, len(limits))
    if limits == (4,):
        limits, groups = (4, -1), [list(range(10)), list(range(10, 64))]
    elif limits == (-1, 4):
        groups = [list(range(56)), list(range(56, 64))]
    prints = clouds(random.Random(3), 30)
    if limits in ((4, -1), (-1, 4)):  # partitions left out must not matter to bits that never differ
        few = sum(1 << b for b in groups[limits.index(4)])
        prints = sorted({x & few for x in prints})
    monkeypatch.setattr(sim, "plan", lambda *_: [(sim._mask(g), t) for g, t in zip(groups, limits, strict=True) if t >= 0])
    frame = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in prints], "fp long")
    got = {r.node % (1 << 64): r.label % (1 << 64) for r in sim.links(frame).collect()}
    least = dict(zip(prints, plain_components(prints, prints), strict=True))
    pairs = [(x, y) for x in prints for y in prints]
    assert all((got.get(x, x) == got.get(y, y)) == (least[x] == least[y]) for x, y in pairs)


def test_thresholds_follow_costs():
    flat, skewed = np.array([1e-4, 1e-3, 1e-2, 0.1, 0.3]), np.array([0.9, 1, 1, 1, 1])
    groups = sim.bit_groups(np.eye(64), 2, 3)
    cost, limits = sim.thresholds(groups, [flat, flat, skewed], 1_000_000, 4)
    assert sum(limits) == 4 + 1 - 3 and limits[2] == -1
    every = [(a, b, 2 - a - b) for a in range(-1, 5) for b in range(-1, 5) if -1 <= 2 - a - b <= 4]
    probes = lambda t: sum(np.array([1, *np.cumprod([(21 - k) / (k + 1) for k in range(t)])])) if t >= 0 else 0
    price = lambda t, share: 1e6 * (1 + (probes(t) - 1) / 2) * sim.ROW + 5e11 * share[t] * sim.VERIFY if t >= 0 else 0
    widths = {tuple(g): len(g) for g in groups}
    assert sorted(widths.values()) == [21, 21, 22] and cost <= min(sum(price(t, s) for t, s in zip(e, [flat, flat, skewed], strict=True)) for e in every) * 1.2


def test_registered_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{oracle.SF}/documents.parquet").select("doc_id", "text").collect()]
    frame = QUERIES["op13_simhash"](spark, oracle.SF)
    assert frame.dtypes == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")]
    prints = [plain_print(t) for _, t in docs]
    want = sorted(zip([i for i, _ in docs], [f"{p:016x}" for p in prints], plain_components(prints, [i for i, _ in docs]), strict=True))
    assert sorted(tuple(r) for r in frame.collect()) == want
