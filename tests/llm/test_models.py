"""Language mixtures, quality model and dual-tree search."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import additive_quality, cover_tree, language_mixture

ENGLISH = "the of and to in that is was for with on as by this from are not but which have".split()
FRENCH = "le la les des une dans pour que qui avec sur est pas nous vous être leur où çà même".split()


def sample(words, n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) for _ in range(n))


def language_docs():
    docs = [(i, sample(ENGLISH if i % 2 else FRENCH, 30, i), "en" if i % 2 else "fr") for i in range(400)]
    docs += [(900, None, "en"), (901, "", None), (902, "123 !!! 456", "fr"), (903, sample(FRENCH, 40, 1) + " " + sample(ENGLISH, 60, 2), None), (904, sample(ENGLISH, 300_000, 3), None), (905, "ÊTRE OÙ MÊME", None), (905, "ÊTRE OÙ MÊME", None)]
    return docs


def test_languages_and_mixtures(spark, tmp_path):
    spark.createDataFrame([(*d, "s", 0.5) for d in language_docs()], "doc_id long, text string, lang string, source string, score double").write.parquet(str(tmp_path / "documents.parquet"))
    got = language_mixture.op6_language_mixture(spark, str(tmp_path)).toPandas()
    assert len(got) == len(language_docs())
    by = got.drop_duplicates("doc_id").set_index("doc_id")
    assert all(by.loc[i, "lang_pred"] == ("en" if i % 2 else "fr") for i in range(400))
    assert [by.loc[i, "lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and by.loc[900, "score"] == 0
    assert by.loc[903, "lang_pred"] == "en" and list(by.loc[903, "languages"]) == ["en", "fr"] and abs(by.loc[903, "score"] - 0.6) < 0.1
    assert by.loc[904, "lang_pred"] == "en" and by.loc[905, "lang_pred"] == "fr"
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = language_mixture.language_stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and kept.count() == len(language_docs()) - 3


def test_answers_do_not_depend_on_order_batches_or_partitions(spark):
    texts = [t for _, t, _ in language_docs() if t and len(t) < 5000] + ["la", "sur", "xx", "a", "", "of", "été", "x" * 40, "le the", None]
    schema = "doc_id long, text string, lang string"
    rows = [(i, t, ("en", "fr", None)[i % 3]) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, schema)
    model = language_mixture.train(frame.repartition(1))
    again = language_mixture.train(spark.createDataFrame(rows[::-1], schema).repartition(5))
    assert model.names == again.names and (model.logp == again.logp).all()
    answers = lambda f: {r.doc_id: tuple(map(str, r)) for r in language_mixture.identify(f, model, ["doc_id"]).collect()}
    want = answers(frame.coalesce(1))
    assert answers(spark.createDataFrame(rows[::-1], schema).coalesce(1)) == want
    assert answers(frame.repartition(len(rows))) == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert answers(frame.repartition(2)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def plain_trigrams(text):
    low = [32, *[c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in text.encode()], 32]
    mask = (1 << 32) - 1
    out = []
    for a, b, c in zip(low, low[1:], low[2:], strict=False):
        code = (a * 0x9E3779B1 & mask) ^ (b * 0x85EBCA6B & mask) ^ (c * 0xC2B2AE35 & mask)
        out.append(((code ^ code >> 15) * 0x2C1B3C6D & mask) >> 17 if b != 32 else None)
    return out


def plain_mixture(text, logp, penalty=3.0):
    """EM, word by word, over every nested language set."""
    words, run = [], []
    for t in [*plain_trigrams(text), None]:
        if t is None:
            words, run = words + [run] if run else words, []
        else:
            run.append(t)
    logs = np.array([logp[w].astype(np.float64).sum(axis=0) for w in words])
    like = np.exp(logs - logs.max(axis=1, keepdims=True))

    def em(allowed):
        share = allowed / allowed.sum()
        for _ in range(3000):
            part = like * share
            share = (part / part.sum(axis=1, keepdims=True)).mean(axis=0)
        return share, np.log((like * share).sum(axis=1)).sum()

    full, _ = em(np.ones(logp.shape[1]))
    order = np.argsort(-full)
    fits = []
    for size in range(1, len(full) + 1):
        allowed = np.zeros(len(full))
        allowed[order[:size]] = 1
        share, fit = em(allowed)
        fits.append((fit - size * penalty * np.log(len(words) + 1) / 2, -size, share))
    return max(fits, key=lambda f: f[:2])[2]


def test_mixtures_are_those_of_plain_expectation_maximisation():
    rng = np.random.default_rng(3)
    spanish = "el los una por con para como pero todo esta muy hasta donde cuando ellos".split()
    texts = [sample(ENGLISH, 30, 1), sample(FRENCH, 8, 2), sample(ENGLISH, 40, 3) + " " + sample(FRENCH, 25, 4), sample(ENGLISH, 9, 5) + " " + sample(spanish, 60, 6) + " " + sample(FRENCH, 30, 7), "of", "Où?"]
    import pyarrow as pa

    counts = np.zeros((language_mixture.BINS, 3))
    rows = pa.RecordBatch.from_pydict({"text": [sample(w, 400, k) for k, w in enumerate((ENGLISH, spanish, FRENCH))], "lang": ["0", "1", "2"]})
    for out in language_mixture._count(iter([rows])):
        counts[out.column("bin").to_numpy(), int(out.column("lang")[0].as_py())] = out.column("n").to_numpy()
    for k, text in enumerate(rows.column("text").to_pylist()):
        assert counts[:, k].sum() == sum(t is not None for t in plain_trigrams(text))
    counts += 0.5 + 0.01 * rng.random(counts.shape)
    logp = np.log(counts / counts.sum(axis=0)).astype(np.float32)
    raw = [t.encode() for t in texts]
    off = np.cumsum([0, *map(len, raw)])
    buf = np.frombuffer(b"".join(raw), dtype=np.uint8)
    logs, words = language_mixture._word_logs(language_mixture._folded(buf), off, logp)
    got = language_mixture.infer(logs, words)
    for own, text in zip(got, texts, strict=True):
        want = plain_mixture(text, logp)
        assert ((own > 0) == (want > 1e-6)).all() and np.abs(own - want).max() < 0.03


def test_stage_sets_the_language_it_found(spark):
    rows = [(i, t, lang, 0.5) for i, t, lang in language_docs() if i < 400] + [(500, sample(FRENCH, 30, 77), "en", 0.5), (501, sample(ENGLISH, 30, 78), None, 0.5), (502, "12 !", "en", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, __score double")
    kept = language_mixture.language_stage(spark, docs, "")
    assert kept.columns == docs.columns
    by = {r.doc_id: r.lang for r in kept.collect()}
    assert by[500] == "fr" and by[501] == "en" and 502 not in by and len(by) == len(rows) - 1
    with pytest.raises(ValueError):
        language_mixture.identify(docs.withColumn("score", F.lit(1)), language_mixture.train(docs), ["score"])


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    model = language_mixture.train(docs)
    assert language_mixture.identify(docs, model, ["doc_id"]).first()["lang_pred"] == "und"
    assert language_mixture.identify(docs.limit(0), model, ["doc_id"]).count() == 0


def quality_docs():
    good = [(i, sample(ENGLISH, 40, i).capitalize() + ".\n" + sample(FRENCH, 20, i) + ".") for i in range(300)]
    bad = [(1000 + i, " ".join(w + "$$$" for w in sample(ENGLISH, 40, i).split())) for i in range(200)]
    return good + bad + [(5000, None), (5001, ""), (5002, "word " * 200_000), (5003, sample(ENGLISH, 20, 1)), (5003, sample(ENGLISH, 20, 1))]


def test_quality_on_held_out_rows(spark, tmp_path):
    docs = quality_docs()
    spark.createDataFrame([(i, t, 7.0) for i, t in docs], "doc_id long, text string, upper double").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1 if i < 1000 else 0, 0) for i, _ in docs if i < 5000] + [(3, None, None), (7777, 1, 0), (4, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = additive_quality.op5_additive_quality(spark, str(tmp_path)).toPandas()
    assert len(got) == len(docs) and got["score"].between(0, 1).all() and got["score"].notna().all()
    known = got[got["doc_id"] < 5000]
    held = known[known["held_out"]]
    assert len(held) > 100 and ((held["doc_id"] < 1000) == (held["predicted"] == 1)).mean() > 0.99
    assert ((got["score"] >= 0.5) == (got["predicted"] == 1)).all()


def plain_features(text):
    raw = text.encode()
    words = [w.lower() for w in re.findall(rb"[^\x20\x09-\x0d]+", raw)]
    symbols = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"()-?")
    some, size = max(len(words), 1), max(len(raw), 1)
    count = lambda chars: sum(c in chars for c in raw)
    triples = list(zip(words, words[1:], words[2:], strict=False))
    return [
        np.log1p(len(raw)), np.log1p(len(words)), sum(map(len, words)) / some, sum(len(w) > 14 for w in words) / some, sum(len(w) < 4 for w in words) / some,
        count(bytes(range(65, 91))) / size, count(b"0123456789") / size, count(b".,;:'\"()-!?") / size, count(symbols) / size, sum(c >= 128 for c in raw) / size,
        sum(w[-1] in symbols for w in words) / some, sum(len(w) == 1 and w[0] in symbols for w in words) / some, count(b".?!") / some, count(b"\n") / some,
        len(set(words)) / len(words) if words else 0, max(map(words.count, words)) / len(words) if words else 0, sum(a == b for a, b in zip(words, words[1:], strict=False)) / some, len(set(triples)) / len(triples) if triples else 0,
    ]


def test_features_and_scores_are_those_of_plain_python(spark):
    texts = ["", "One", "The cat, the cat $$$ the CAT!! 12 % % %\nünï cödé supercalifragilistic end?", sample(ENGLISH, 50, 3) + " x" * 9, "a\tb\x0bc a b c a b c", "!"]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, upper string").coalesce(1)
    feats = additive_quality.feature_table(docs)
    got = {r.doc_id: [r[c] for c in additive_quality.FEATURES] for r in feats.collect()}
    for i, t in enumerate(texts):
        assert np.allclose(got[i], plain_features(t), atol=1e-5), t
    rng = np.random.default_rng(1)
    x = rng.random((300, len(additive_quality.FEATURES)))
    model = additive_quality.fit(x, (x[:, 0] + x[:, 3] * x[:, 4] > 0.8).astype(float), rounds=5, pair_rounds=3)
    want = []
    for row in x[:40]:
        total = model.base + sum(table[sum(c <= v for c in cuts)] for v, cuts, table in zip(row, model.cuts, model.tables, strict=True))
        total += sum(table[sum(c <= row[i] for c in ci), sum(c <= row[j] for c in cj)] for i, j, ci, cj, table in model.pairs)
        want.append(1 / (1 + np.exp(-total)))
    assert np.allclose(model.scores(x[:40]), want)


def test_contradicting_labels_count_for_neither(spark):
    docs = spark.createDataFrame([(i, sample(ENGLISH, 20, i) + (" $$$" * (i % 2) * 9)) for i in range(120)], "doc_id long, text string")
    feats = additive_quality.feature_table(docs).cache()
    good = [(i, 1 - i % 2) for i in range(100)]
    plain = additive_quality.train(feats, spark.createDataFrame(good, "doc_id long, quality int"))
    noisy = additive_quality.train(feats, spark.createDataFrame([*good, *good[:30], *[(i, q) for i in range(100, 120) for q in (0, 1)], (None, 1), (5, None)], "doc_id long, quality int"))
    scores = [[r.score for r in additive_quality.score(feats, m).orderBy("doc_id").collect()] for m in (plain, noisy)]
    assert scores[0] == scores[1]


def test_quality_without_labels(spark):
    feats = additive_quality.feature_table(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"))
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = additive_quality.train(feats, none)
    assert model is None and {r.score for r in additive_quality.score(feats, model).collect()} == {0.5}


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(0)
    x = np.zeros((4000, len(additive_quality.FEATURES)))
    x[:, :2] = rng.random((4000, 2))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = additive_quality.fit(x, y, rounds=20)
    assert ((model.scores(x) >= 0.5) == (y == 1)).mean() > 0.95
    assert {(i, j) for i, j, *_ in model.pairs[:1]} == {(1, 0)}


def vectors(n, seed, clusters=5):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(clusters, 8))
    x = (centers[rng.integers(clusters, size=n)] + 0.3 * rng.normal(size=(n, 8))).astype(np.float32)
    x[n // 2 : n // 2 + n // 4] = x[0]  # a very common vector
    return x


def brute_top(ids, x, asked, k):
    q = np.floor(1024 * x.astype(np.float64)).astype(np.int64)
    out = {}
    for i, own in enumerate(ids):
        if own in asked:
            score = q @ q[i]
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != own][:k]
            out |= {(int(own), r + 1): (int(ids[j]), int(score[j])) for r, j in enumerate(order)}
    return out


@pytest.mark.parametrize("n,data_block,query_block", [(600, 64, 3), (600, 4096, 1024), (7, 4, 2)])
def test_search_is_exact(spark, n, data_block, query_block):
    x, ids = vectors(n, n), np.arange(n) * 5
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)]
    bad = [(-1, None), (-2, [1.0, None] + [0.0] * 6), (-3, [float("nan")] * 8), (-4, [float("inf")] * 8), (None, [0.0] * 8)]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").repartition(3)
    usable = cover_tree.usable(frame, "vec_id", "embedding")
    got = cover_tree.dual_tree_top_k(usable, usable.filter(F.col("vec_id") % 100 == 0), 10, 256, data_block, query_block).collect()
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got} == brute_top(ids, x, {i for i in ids if i % 100 == 0}, 10)


def test_search_of_empty_short_and_large_vectors(spark):
    empty = cover_tree.usable(spark.createDataFrame([], "vec_id long, e array<float>"), "vec_id", "e")
    assert cover_tree.dual_tree_top_k(empty, empty).count() == 0
    rows = [(0, [1e9, 2.0]), (100, [3.0]), (200, []), (300, [-1e9, 1e9])]
    own = cover_tree.usable(spark.createDataFrame(rows, "vec_id long, e array<double>"), "vec_id", "e")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in cover_tree.dual_tree_top_k(own, own).collect()}
    big = 1024 * 10**9
    assert got[(100, 1)] == (0, 3072 * big) and got[(200, 1)] == (0, 0) and got[(200, 3)] == (300, 0)
    assert got[(100, 2)] == (200, 0) and got[(100, 3)] == (300, -3072 * big)


def test_components_beyond_64_bits(spark):
    rows = [(0, [1e30, 2.0]), (100, [3.0, 1e25]), (200, [-1e30, 5.0]), (300, [1.5, 0.25]), (5, [1e16, -1e16]), (7, [1e300, 1.0]), (8, [2e300, 1.0])]
    own = cover_tree.usable(spark.createDataFrame(rows, "vec_id long, e array<double>"), "vec_id", "e")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in cover_tree.dual_tree_top_k(own, own.filter("vec_id % 100 = 0")).collect()}
    whole = {i: [1024 * int(x) if abs(x) > 2**52 else int(np.floor(1024 * x)) for x in v] for i, v in rows}
    cut = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    for q in (0, 100, 200, 300):
        scores = {i: cut(sum(a * b for a, b in zip(v, whole[q], strict=True))) for i, v in whole.items() if i != q}
        order = sorted(scores, key=lambda i: (-scores[i], i))
        assert {r: (i, scores[i]) for r, i in enumerate(order, 1)} == {r: got[q, r] for r in range(1, 7)}


def test_scores_between_53_and_64_bits_are_exact(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(2**18, 2**18 + 40, size=(300, 8)).astype(np.float64)
    frame = cover_tree.usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, e array<double>"), "vec_id", "e")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in cover_tree.dual_tree_top_k(frame, frame.filter("vec_id % 100 = 0"), 10, 64, 32, 2).collect()}
    assert got == brute_top(np.arange(300), x, {0, 100, 200}, 10)


def test_cover_tree_invariants_hold_at_every_node():
    tree = cover_tree.CoverTree(vectors(500, 2).astype(np.float64))
    rows = tree.centers
    for k in range(len(tree.start)):
        own = tree.points[tree.start[k] : tree.stop[k]]
        assert np.sqrt(((own - rows[k]) ** 2).sum(axis=1)).max() <= tree.radii[k] + 1e-9
        kids = tree.children[k]
        if kids:
            assert sorted((tree.start[c], tree.stop[c]) for c in kids)[0][0] == tree.start[k] and sum(tree.stop[c] - tree.start[c] for c in kids) == len(own)
            reach = max(tree.radii[c] for c in kids)
            gaps = [np.sqrt(((rows[a] - rows[b]) ** 2).sum()) for i, a in enumerate(kids) for b in kids[:i]]
            assert not gaps or min(gaps) >= reach - 1e-9
            assert any(tree.center[c] == tree.center[k] for c in kids)
            assert len(kids) == cover_tree.FAN or reach <= tree.radii[k] / 2 + 1e-9


@pytest.mark.parametrize("kind, most", [("clustered", 0.25), ("spread", 1.0)])
def test_share_of_scored_pairs(kind, most):
    """Clusters are pruned to a small share of all pairs; directions without any structure in 64 dimensions cannot be."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 64)) * 300 if kind == "clustered" else np.zeros((40, 64))
    x = np.floor(centres[rng.integers(0, 40, 4000)] + rng.standard_normal((4000, 64)) * (20 if kind == "clustered" else 128)).astype(np.int64)
    ids = np.arange(4000)
    asked = ids[ids % 100 == 0]
    q, d = cover_tree.CoverTree(x[asked]), cover_tree.CoverTree(x)
    scored = []
    a, b, score = cover_tree.dual_search(q, asked[q.order], d, ids[d.order], 10, np.full(len(asked), -np.inf), scored)
    share = sum(scored) / (len(asked) * 4000)
    print(f"{kind}: {share:.3f} of all pairs are scored")
    assert share <= most
    got = {(int(asked[q.order][i]), int(s)) for i, s in zip(a, score, strict=True)}
    want = {(int(i), int(s)) for i in asked for s in sorted((x @ x[i])[ids != i])[-10:]}
    assert got == want
