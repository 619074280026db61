"""Sharding, packing, token rollups and revisits on small tables."""

import base64
import hashlib
import random
import zlib

import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from lodestack.llm import conflict_packing, histogram_shard, revisits, token_rollup
from lodestack.llm.common import scratch
from tests.llm import brute

DOCS = "doc_id long, text string, source string, hi string, bucket int"


def rows():
    out = [(i, f"text {i} " + "x" * (i * 37 % 400), f"s{i % 3}", "clash", 1) for i in range(200)]
    out += [(1000 + i, "the same text", "s0", None, None) for i in range(90)]
    out += [(2000, None, None, None, None), (2001, "", "s1", None, None), (2002, "y" * 50_000, None, "", 0), (2003, "twice", "s1", "", 0), (2003, "twice", "s1", "", 0), (None, "no id", "s2", None, None)]
    return out


def test_shards_are_even_gapless_and_keep_columns(spark):
    docs = spark.createDataFrame(rows(), DOCS)
    docs = docs.withColumns({"__hi": F.lit("kept"), "lead": F.lit(7), "row": F.lit("r")})
    got = histogram_shard.histogram_shard(docs, F.col("text"), "doc_id", F.octet_length(F.coalesce("text", F.lit(""))) + 1, shards=4, piece_bytes=4000).toPandas()
    assert sorted(got.columns) == sorted(["doc_id", "text", "source", "hi", "bucket", "__hi", "lead", "row", "size", "shard", "slot"])
    assert set(got["__hi"]) == {"kept"} and set(got["lead"]) == {7} and set(got["row"]) == {"r"}
    assert len(got) == len(rows()) and set(got["shard"]) == {0, 1, 2, 3}
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    assert set(got["hi"].dropna()) == {"clash", ""}


def test_hot_group_is_split_by_id(spark):
    docs = spark.createDataFrame([(i, "copy" if i % 2 else f"t{i}") for i in range(2000)], "doc_id long, text string")
    got = histogram_shard.histogram_shard(docs, F.col("text"), "doc_id", F.lit(10)).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() <= 0.03 * sizes.mean()
    copies = got[got["text"] == "copy"].sort_values(["shard", "slot"])
    assert 4 <= copies["shard"].nunique() <= 5


def spark_hash(text):
    value = xxhash.xxh64_intdigest((text or "").encode(), seed=42)
    return value - (1 << 64) if value >= 1 << 63 else value


@pytest.mark.parametrize("piece_bytes", [64 << 20, 700])
def test_shard_query_against_a_plain_sort(spark, tmp_path, monkeypatch, piece_bytes):
    rng = random.Random(6)
    texts = ["hot copy of a text"] * 400 + [f"text {i} " + "y" * rng.randrange(0, 300) for i in range(700)] + [None, "", "é" * 50, "z" * 9000]
    docs = list(enumerate(rng.sample(texts, len(texts)))) + [(None, "without an id")]
    spark.createDataFrame([(i, t, "s") for i, t in docs], "doc_id long, text string, source string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    shard = histogram_shard.histogram_shard
    monkeypatch.setattr(histogram_shard, "histogram_shard", lambda *a: shard(*a, piece_bytes=piece_bytes))
    got = histogram_shard.op8_histogram_shard(spark, str(tmp_path)).collect()
    raw = {i: (t or "").encode() for i, t in docs}
    assert {r.doc_id: (r["size"], r.text_crc32) for r in got} == {i: (len(b) + 1, zlib.crc32(b)) for i, b in raw.items()} and len(got) == len(docs)
    digest = {i: spark_hash(hashlib.md5(b).hexdigest()) for i, b in raw.items()}
    at = {r.doc_id: (r.shard, r.slot) for r in got}
    for n in range(8):
        assert sorted(s for k, s in at.values() if k == n) == list(range(sum(k == n for k, _ in at.values())))
    # Shards are ranges of (digest, id); each cut is near its share, or at the edge of a group, or between two rows of a hot one.
    order = sorted(digest, key=lambda i: (digest[i], i if i is not None else -(1 << 63)))
    assert [at[i][0] for i in order] == sorted(at[i][0] for i in order)
    if piece_bytes > 1 << 20:
        assert [i for i, _ in sorted(at.items(), key=lambda x: x[1])] == order
    size = {i: len(b) + 1 for i, b in raw.items()}
    total, below = sum(size.values()), 0
    share = total / 8
    for a, b in zip(order, order[1:], strict=False):
        below += size[a]
        for j in range(at[a][0] + 1, at[b][0] + 1):
            edge = digest[a] != digest[b]
            assert abs(below - total * j / 8) <= (0.01 * share if edge else max(size[a], size[b])) or max(size[a], size[b]) > 0.01 * share
    assert sum(at[a][0] != at[b][0] for a, b in zip(order, order[1:], strict=False) if digest[a] == digest[b]) <= 7


def test_pieces_follow_the_bytes(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    got = histogram_shard.histogram_shard(docs, F.col("text"), "doc_id", F.lit(10), shards=2, piece_bytes=500).toPandas()
    assert all(sorted(own["slot"]) == list(range(len(own))) for _, own in got.groupby("shard")) and len(got) == 4000
    keys = docs.select(F.xxhash64("text").alias("hi"), F.col("doc_id").alias("lo"), F.lit(10).cast("long").alias("size"))
    pieces = histogram_shard._pieced(keys, 2, [], 7, histogram_shard._hot(keys, 500))
    sizes = [r["count"] for r in pieces.groupBy(*histogram_shard.PIECE).count().collect()]
    assert max(sizes) <= 60 and sum(sizes) == 4000


def test_shards_of_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert histogram_shard.histogram_shard(docs, F.col("text"), "doc_id", F.lit(1)).count() == 0


def test_query_columns(spark, tmp_path):
    spark.createDataFrame(rows(), DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.text_crc32): r for r in histogram_shard.op8_histogram_shard(spark, str(tmp_path)).collect()}
    assert got[(2000, 0)].size == 1 and got[(2002, zlib.crc32(b"y" * 50_000))].size == 50_001
    assert {r.law for r in got.values()} == {"bytes"} and {r.grown_shard for r in got.values()} == {None}


def packed(spark, data, **kw):
    docs = spark.createDataFrame(data, DOCS)
    size = F.greatest(F.lit(1), F.floor(F.length(F.coalesce("text", F.lit(""))) / 4)).cast("long")
    return docs.toPandas(), conflict_packing.pack(docs, "doc_id", size, F.col("source"), F.when(F.length("text") > 0, F.lower("text")), **kw).toPandas()


@pytest.mark.parametrize("section", [64, 100_000])
def test_bins_respect_capacity_sources_and_clusters(spark, section):
    docs, got = packed(spark, rows(), capacity=256, per_source=2, section=section)
    size = got.groupby("bin_id")["length"].sum()
    assert size.max() <= 256 and (size + got.groupby("bin_id")["residual"].first() == 256).all()
    assert (got.groupby("bin_id")["position"].max() + 1 == got.groupby("bin_id").size()).all() and not got.duplicated(["bin_id", "position"]).any()
    want = docs["text"].fillna("").map(lambda t: max(1, len(t) // 4)).sum()
    assert got["length"].sum() == want
    one = docs.drop_duplicates("doc_id").set_index("doc_id")
    named = got[got["doc_id"].notna()].assign(source=lambda x: x["doc_id"].map(one["source"]).fillna("?"), text=lambda x: x["doc_id"].map(one["text"]).fillna("?"))
    assert named.groupby(["bin_id", "source"])["doc_id"].count().max() <= 2
    copies = named[named["text"] == "the same text"]
    assert copies.groupby("bin_id").size().max() == 1


def plain_packing(items, capacity, per_source):
    """[(id, source, cluster, size)] into bins, item by item: the bin with the least room, but some, that holds it and has no conflict."""
    bins, out = [], []
    rest = [(i, s, c, n - max(0, -(-n // capacity) - 1) * capacity) for i, s, c, n in items]
    for i, s, c, n in sorted(rest, key=lambda x: (-x[3], "" if x[0] is None else f"={x[0]}")):
        fits = [(b["room"], k) for k, b in enumerate(bins) if b["room"] >= max(n, 1) and b["sources"].count(s) < per_source and (c is None or c not in b["clusters"])]
        k = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append({"room": capacity, "sources": [], "clusters": []})
        bins[k]["room"] -= n
        bins[k]["sources"].append(s), bins[k]["clusters"].append(c)
        out.append((i, k))
    return out


def grouped(pairs):
    by = {}
    for i, k in pairs:
        by.setdefault(k, []).append(i)
    return sorted(sorted(map(str, v)) for v in by.values())


def test_one_section_is_packed_as_by_the_plain_rule(spark):
    rng = random.Random(8)
    items = [(k, f"s{rng.choice([0, 0, 0, 1, 2])}", rng.choice([None, None, "a", "b", "c"]), rng.randrange(0, 700)) for k in range(300)] + [(None, None, None, 10)]
    frame = spark.createDataFrame(items, "doc_id long, s string, c string, n long").repartition(4)
    for _ in range(2):
        got = conflict_packing.pack(frame, "doc_id", F.col("n"), F.col("s"), F.col("c"), capacity=256, per_source=3).collect()
        last = {}
        for r in got:
            if r.start >= last.get(r.doc_id, (-1, 0))[0]:
                last[r.doc_id] = (r.start, r.bin_id)
        assert grouped((i, k) for i, (_, k) in last.items()) == grouped(plain_packing(items, 256, 3))
        frame = frame.orderBy("n")


def test_bins_do_not_depend_on_the_layout_of_the_rows(spark):
    data = [(k, f"s{k % 3}", "c" if k % 5 == 0 else None, k * 37 % 700) for k in range(300)] + [(7, "s0", None, 90)] * 150 + [(None, None, None, 40)] * 60
    frame = spark.createDataFrame(data, "doc_id long, s string, c string, n long")
    seen = []
    for f in (frame.coalesce(1), frame.repartition(7), frame.orderBy(F.col("n").desc(), "doc_id").repartition(3, "s")):
        got = conflict_packing.pack(f, "doc_id", F.col("n"), F.col("s"), F.col("c"), capacity=256, per_source=3, section=40).collect()
        seen.append(sorted(map(str, got)))
    assert len(seen[0]) >= len(data) and seen[0] == seen[1] == seen[2]


@pytest.mark.parametrize("run", [7, 65536])
def test_equal_rows_are_numbered_whatever_the_run(spark, run):
    counts = spark.createDataFrame([(1, "a", 1), (2, "a", 7), (3, None, 8), (None, None, 50)], "_id long, _source string, _n long")
    got = conflict_packing._numbered(counts, 50, run).groupBy("_id", "_source").agg(F.count("*"), F.countDistinct("_place")).collect()
    assert {(r[0], r[1]): (r[2], r[3]) for r in got} == {(1, "a"): (1, 1), (2, "a"): (7, 7), (3, None): (8, 8), (None, None): (50, 50)}


def test_each_of_several_sections_is_packed_as_by_the_plain_rule(spark):
    rng = random.Random(9)
    data = [(k, f"s{rng.randrange(3)}", rng.choice([None, None, "a", "b"]), rng.randrange(1, 256)) for k in range(400)]
    frame = spark.createDataFrame(data, "doc_id long, s string, c string, n long")
    numbered = frame.select(F.col("doc_id").alias("_id"), F.xxhash64("s").alias("_source"), F.when(F.col("c").isNotNull(), F.xxhash64("c")).alias("_cluster"), F.xxhash64("doc_id").alias("_place"), F.lit(0).cast("long").alias("_whole"), F.lit(0).cast("long").alias("_start"), F.col("n").alias("_rest"))
    got = conflict_packing._sections(numbered, 0, 5, 256, 2).collect()
    item = {k: (k, s, c, n) for k, s, c, n in data}
    by = {}
    for r in got:
        by.setdefault(r.bin_id >> 32, []).append((r["_id"], r.bin_id))
    assert len(by) == 5
    for own in by.values():
        assert grouped(own) == grouped(plain_packing([item[i] for i, _ in own], 256, 2))


def test_equal_rows_spread_over_sections(spark):
    frame = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(100).alias("n"), F.lit("s").alias("s"))
    got = conflict_packing.pack(frame, "doc_id", F.col("n"), F.col("s"), F.lit(None).cast("string"), capacity=256, per_source=4, section=1000).toPandas()
    assert len(got) == 3000 and got["length"].sum() == 300_000
    sections = (got["bin_id"] // (1 << 32)).value_counts()
    assert len(sections) >= 3 and sections.max() < 1300


def test_items_of_loose_bins_are_packed_again_across_sections(spark):
    frame = spark.range(400).select(F.col("id").alias("doc_id"), F.lit(20).alias("n"), F.col("id").cast("string").alias("s"))
    got = conflict_packing.pack(frame, "doc_id", F.col("n"), F.col("s"), F.lit(None).cast("string"), capacity=1000, section=10).toPandas()
    assert len(got) == 400 and got.groupby("bin_id")["length"].sum().max() <= 1000 and not got.duplicated("doc_id").any()


def test_long_documents_are_cut_and_tokens_come_back(spark):
    enc = encoder()
    texts = {1: "some words and ünïcödé " * 700, 2: "q" * 40, 3: "", 4: None}
    docs = spark.createDataFrame([(i, t, "s", "", 0) for i, t in texts.items()], DOCS)
    sized = conflict_packing.measured(docs, ["doc_id", "source"])
    pieces = conflict_packing.pack(sized, "doc_id", F.col("_tokens"), F.col("source"), F.col("_copies"), capacity=256)
    want = {i: enc.encode_ordinary(t or "") for i, t in texts.items()}
    own = sorted((r.start, r.length) for r in pieces.filter("doc_id = 1").collect())
    assert [a for a, _ in own] == list(range(0, len(want[1]), 256)) and sum(n for _, n in own) == len(want[1])
    bins = {r.bin_id: r.tokens for r in conflict_packing.packed_tokens(docs, pieces).collect()}
    places = {}
    for r in pieces.collect():
        places.setdefault(r.bin_id, {})[r.position] = r
    back = {i: {} for i in texts}
    for b, own in places.items():
        at = 0
        for _, r in sorted(own.items()):
            back[r.doc_id][r.start] = bins[b][at : at + r.length]
            at += r.length
        assert at == len(bins[b])
    assert {i: [t for _, part in sorted(parts.items()) for t in part] for i, parts in back.items()} == want


def test_packing_query_is_the_plain_rule_over_tokens_and_classes(spark, tmp_path):
    enc, rng = encoder(), random.Random(4)
    texts = [" ".join(rng.choice("alpha beta gamma delta river stone".split()) for _ in range(rng.randrange(1, 900))) for _ in range(60)]
    docs = [(k, rng.choice(texts), f"s{k % 3}") for k in range(150)] + [(200, None, "s0"), (201, "", None), (None, "no id here", "s1")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = conflict_packing.op9_conflict_packing(spark, str(tmp_path)).collect()
    items = [(i, s, brute.shingles(t) or None, len(enc.encode_ordinary(t or ""))) for i, t, s in docs]
    assert sum(r.length for r in got) == sum(n for *_, n in items)
    assert grouped((r.doc_id, r.bin_id) for r in got) == grouped(plain_packing(items, 2048, 4))


def test_packing_of_empty_table(spark):
    _, got = packed(spark, [])
    assert len(got) == 0


def test_tightest_compatible_bin_wins():
    import numpy as np

    bins, room = conflict_packing.best_fit(np.array([7, 6, 3, 3]), np.array([0, 0, 1, 0]), np.array([-1, -1, 5, 5]), 10, 8)
    assert bins.tolist() == [0, 1, 0, 1] and room.tolist() == [0, 1]
    bins, _ = conflict_packing.best_fit(np.array([5, 5, 5]), np.array([0, 0, 0]), np.array([-1, -1, -1]), 10, 1)
    assert bins.tolist() == [0, 1, 2]


LEDGER = "doc_id long, source string, lang string, tokenizer string, tokens long, live boolean"


def test_rollups_are_signed_and_idempotent(spark):
    store = token_rollup.RollupStore(spark, scratch(spark, "rollup-test"))
    assert store.totals().count() == 0
    first = spark.createDataFrame([(1, "a", "en", "v1", 10, True), (2, "a", "en", "v1", 5, True), (3, None, None, "v1", 7, True), (3, None, None, "v1", 7, True), (None, "b", "en", "v1", None, True)], LEDGER)
    assert store.commit("one", first) and not store.commit("one", first)
    second = spark.createDataFrame([(1, "a", "fr", "v1", 12, True), (2, "a", "en", "v1", 5, False), (9, "z", "en", "v1", 3, False), (1, "a", "en", "v2", 99, True)], LEDGER)
    assert store.commit("two", second)
    assert store.commit("none", spark.createDataFrame([], LEDGER))
    got = {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in store.totals().collect()}
    assert got == {("a", "fr", "v1"): (1, 12), (None, None, "v1"): (1, 7), ("b", "en", "v1"): (1, 0), ("a", "en", "v2"): (1, 99)}


def plain_totals(batches):
    """Totals of batches of LEDGER rows (with a key in front), counted from scratch."""
    state = {}
    for rows in batches:
        best = {}
        for key, source, lang, tokenizer, tokens, live in rows:
            best[key, tokenizer] = max(best.get((key, tokenizer), (False, -1, "", "")), (live, tokens, source, lang))
        state |= best
    out = {}
    for (_, tokenizer), (live, tokens, source, lang) in state.items():
        if live:
            docs, sum_ = out.get((source, lang, tokenizer), (0, 0))
            out[source, lang, tokenizer] = (docs + 1, sum_ + tokens)
    return out


def test_totals_are_those_of_a_recount_and_survive_compaction(spark):
    rng = random.Random(2)
    row = lambda: (rng.randrange(30), f"s{rng.randrange(3)}", rng.choice(["en", "fr"]), f"v{rng.randrange(2)}", rng.randrange(50), rng.random() < 0.7)
    batches = [[row() for _ in range(25)] for _ in range(4)]
    store = token_rollup.RollupStore(spark, scratch(spark, "rollup-test"))
    for k, rows in enumerate(batches):
        assert store.commit(f"b{k}", spark.createDataFrame(rows, LEDGER))
        if k % 2:
            store.compact()
        got = {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in token_rollup.RollupStore(spark, store.root).totals().collect()}
        assert got == plain_totals(batches[: k + 1])
    assert not store.commit("b0", spark.createDataFrame(batches[0], LEDGER)) and store.committed() == ["b0", "b1", "b2", "b3"]


def test_two_writers_of_one_state_do_not_count_a_document_twice(spark, monkeypatch):
    store = token_rollup.RollupStore(spark, scratch(spark, "rollup-test"))
    other = token_rollup.RollupStore(spark, store.root)
    frame = lambda *rows: spark.createDataFrame(list(rows), LEDGER)
    store.commit("load", frame((1, "a", "en", "v1", 10, True)))
    publish, met = store._publish, []

    def late(number, entry):
        if not met:
            met.append(number)
            assert other.commit("theirs", frame((1, "a", "en", "v1", 99, False)))
        return publish(number, entry)

    monkeypatch.setattr(store, "_publish", late)
    assert store.commit("ours", frame((1, "a", "en", "v1", 12, True)))
    assert [(r.docs, r.tokens) for r in store.totals().collect()] == [(1, 12)] and store.committed() == ["load", "theirs", "ours"]
    assert not publish(0, {"batch": "x", "ledger": "x", "delta": "x"})


def test_small_batch_reads_the_buckets_of_its_own_keys(spark):
    schema = "doc_id long, source string, lang string, tokenizer string, tokens long, live boolean"
    store = token_rollup.RollupStore(spark, scratch(spark, "rollup-test"), buckets=16)
    store.commit("a", spark.createDataFrame([(i, "s", "en", "t", 1, True) for i in range(500)], schema))
    other = token_rollup.RollupStore(spark, store.root, buckets=5)
    other.commit("b", spark.createDataFrame([(3, "s", "en", "t", 5, True), (None, "s", "en", "t", 7, True)], schema))
    log = store._log()
    assert [(e["buckets"], len(e["held"])) for e in log] == [(16, 16), (5, len(log[1]["held"]))]
    touched = spark.createDataFrame([("3", "t"), (None, "t"), ("none", "t")], "k string, t string")
    found = store._current(log, touched)
    assert {(r.doc_key, r.tokens) for r in found.collect()} == {("3", 5), (None, 7)}
    near = {n: {r[0] for r in touched.select(token_rollup.bucket_of("k", n)).collect()} for n in (16, 5)}
    read = {(f.split("attempt=")[1].split("/")[0], int(f.split("bucket=")[1].split("/")[0])) for f in found.inputFiles()}
    assert read == {(e["ledger"], b) for e in log for b in near[e["buckets"]] & set(e["held"])} and len(read) <= 6
    other.commit("c", spark.createDataFrame([(3, "s", "en", "t", 0, False)], schema))
    store.compact()
    assert [tuple(r) for r in token_rollup.RollupStore(spark, store.root).totals().collect()] == [("s", "en", "t", 500, 506)]


def test_half_written_batch_is_written_anew(spark, monkeypatch):
    store = token_rollup.RollupStore(spark, scratch(spark, "rollup-test"))
    row = spark.createDataFrame([(1, "a", "en", "v1", 10, True)], LEDGER)

    def lost(number, entry):
        raise RuntimeError("lost")

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(store, "_publish", lost)
        store.commit("one", row)
    assert store.totals().count() == 0 and store.commit("one", row)
    assert store.totals().first()["tokens"] == 10


def encoder():
    with open(token_rollup.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("t", pat_str=token_rollup.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_token_counts_are_those_of_whole_texts(spark):
    enc = encoder()
    texts = ["", None, "Hello, world! <|endoftext|>", "é" * 300, "a b " * 20_000, "abcdefghij" * 50_000, "!" * 300_000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, doc_key string")
    got = {r.doc_id: r.tokens for r in token_rollup.counted(docs, ["doc_id", "doc_key"]).collect()}
    assert got == {i: len(enc.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    with pytest.raises(ValueError):
        token_rollup.counted(docs.withColumn("tokens", F.lit(1)), ["tokens"])


def test_very_long_white_space_is_counted_in_pieces():
    enc = encoder()

    class Weak:
        _encode_single_piece = staticmethod(enc._encode_single_piece)

        class PanicException(BaseException):
            pass

        def encode_ordinary(self, text):
            if " " * 1000 in text or "\n" * 1000 in text:
                raise self.PanicException
            return enc.encode_ordinary(text)

    for text in (" " * 5000 + "word", "a" + " " * 5000, "one" + "\n" * 2000 + "two " + "\t \u3000" * 700 + " three " + " " * 1500, " " * 1200):
        assert token_rollup.token_ids(Weak(), text) == enc.encode_ordinary(text)
    assert len(token_rollup.token_ids(enc, "x" + " " * 2_000_000 + "y")) == 2 + len(enc._encode_single_piece(" " * 1_999_999))


def test_rollup_query_is_a_recount(spark, tmp_path):
    enc = encoder()
    docs = [(i, f"word {i} " * (i % 7), f"s{i % 3}", ("en", "fr", None)[i % 3]) for i in range(40)] + [(None, "no id", "s1", "en"), (None, "no id at all", "s1", "en"), (None, "no id", "s1", "en"), (50, None, None, None), (3, f"word {3} " * 3, "s0", "en")]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(20)] + [(7, 0, 0), (900, 0, 1), (None, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    load = [(i if i is not None else t, s, lang, "byte_bpe_50k", len(enc.encode_ordinary(t or "")), True) for i, t, s, lang in docs]
    toxic, low = {i for i, _, t in labels if t}, {i for i, q, _ in labels if q == 0}
    best = {}
    for r in load:
        best[r[0]] = max(best.get(r[0], r), r, key=lambda x: (x[4], x[1] or "", x[2] or ""))
    want = {}
    for key, source, lang, tokenizer, tokens, _ in best.values():
        if key not in toxic:
            group = (source, "low" if key in low else lang, tokenizer)
            want[group] = (want.get(group, (0, 0))[0] + 1, want.get(group, (0, 0))[1] + tokens)
    got = {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in token_rollup.op1_token_rollup(spark, str(tmp_path)).collect()}
    assert got == want


CAPTURE = "record_id long, url string, seen long, status int, headers map<string,string>, digest string, length long"


def captures():
    return [
        (1, "http://WWW.Example.com:80/a/?b=2&a=1&utm_source=x#top", 10, 200, {"etag": '"v1"', "content-type": "text/html", "date": "d1"}, "D1", 100),
        (2, "https://example.com/a?a=1&b=2", 20, 304, {"etag": 'W/"v1"', "date": "d2", "content-length": "0"}, "D1", None),
        (3, "https://example.com/a?a=1&b=2", 30, 304, {"etag": '"v2"'}, None, None),
        (4, "https://example.com/a?a=1&b=2", 40, 200, {"last-modified": "L"}, "D4", 7),
        (5, "https://example.com/a?a=1&b=2", 40, 304, None, None, None),
        (6, "https://example.com/a?a=1&b=2", 40, 304, {"last-modified": "M"}, None, None),
        (7, "https://example.com/other", 5, 304, {}, None, None),
        (8, None, 50, 304, {}, None, None),
        (9, "https://example.com/a?a=1&b=2", None, 304, {}, None, None),
        (10, "https://example.com/a?a=1&b=2", 60, 503, {}, None, None),
        (10, "https://example.com/a?a=1&b=2", 60, 503, {}, None, None),
    ]


def test_revisits_resolve_to_the_latest_earlier_response(spark):
    for slice_rows in (50_000, 2):
        got = revisits.resolve_revisits(spark.createDataFrame(captures(), CAPTURE), slice_rows).collect()
        assert len(got) == 11
        by = {r.record_id: r for r in got}
        assert [(k, by[k].outcome, by[k].refers_to) for k in range(1, 11)] == [
            (1, "full", None), (2, "resolved", 1), (3, "mismatch", 1), (4, "full", None), (5, "resolved", 4),
            (6, "mismatch", 4), (7, "orphan", None), (8, "orphan", None), (9, "orphan", None), (10, "other", None),
        ]
        assert by[2].resolved_headers == {"etag": 'W/"v1"', "date": "d2", "content-type": "text/html"}
        assert (by[2].resolved_digest, by[2].resolved_length) == ("D1", 100)
    assert revisits.resolve_revisits(spark.createDataFrame([], CAPTURE)).count() == 0


def test_payload_of_revisits(spark):
    found = revisits.resolve_revisits(spark.createDataFrame(captures(), CAPTURE))
    bodies = spark.createDataFrame([(1, "one"), (4, "four")], "record_id long, body string")
    got = {r.record_id: r.body for r in revisits.with_payload(found, bodies).collect()}
    assert got[2] == "one" and got[5] == "four" and got[3] is None and got[1] == "one"


def plain_revisits(rows):
    """{(record_id, seen): (outcome, refers_to)} by looking through all earlier captures."""
    out = {}
    for rid, url, seen, status, headers, digest, _ in rows:
        if status != 304:
            out[rid, seen] = ("full" if 200 <= status < 300 else "other", None)
            continue
        base = max(((s, r, d or "") for r, u, s, st, _, d, _ in rows if u == url and u is not None and seen is not None and s is not None and 200 <= st < 300 and (s, r) < (seen, rid)), default=None)
        out[rid, seen] = ("orphan", None) if base is None else ("mismatch" if digest and base[2] and digest != base[2] else "resolved", base[1])
    return out


def test_hot_urls_cross_slices_as_by_the_plain_rule(spark):
    rng = random.Random(12)
    rows = []
    for k in range(1500):
        url = rng.choice(["https://hot.example/", "https://hot.example/", "https://hot.example/", "https://b.example/x", f"https://c.example/{rng.randrange(200)}", None])
        rows.append((k, url, rng.randrange(400) if rng.random() < 0.98 else None, rng.choice([200, 304, 304, 304, 304, 304, 503]), None, rng.choice([None, "D1", "D2"]), 5))
    frame = spark.createDataFrame(rows, CAPTURE)
    canonical = [(r[0], revisits and (r[1] and r[1].split("://")[1].rstrip("/")), *r[2:]) for r in rows]
    want = plain_revisits(canonical)
    for slice_rows in (1_000_000, 40, 7):
        got = {(r.record_id, r.seen): (r.outcome, r.refers_to) for r in revisits.resolve_revisits(frame, slice_rows).collect()}
        assert got == want


def test_captures_alike_in_time_and_id_have_a_defined_order(spark):
    twins = [(1, "u.example", 5, 200, None, "A", 1), (1, "u.example", 5, 200, None, "B", 1), (1, "u.example", 5, 304, None, None, None), (2, "u.example", 6, 304, None, None, None), (None, "u.example", 6, 304, None, None, None)]
    for rows in (twins, twins[::-1]):
        got = sorted((r.record_id or 0, r.status, r.outcome, r.resolved_digest) for r in revisits.resolve_revisits(spark.createDataFrame(rows, CAPTURE)).collect())
        assert got == [(0, 304, "resolved", "B"), (1, 200, "full", "A"), (1, 200, "full", "B"), (1, 304, "orphan", None), (2, 304, "resolved", "B")]


@pytest.mark.parametrize("odd", [[], [None], [None, -(1 << 62), 1 << 62], [10**15 + 7 * k for k in range(1500)]])
def test_parts_of_a_hot_group_follow_its_ids(spark, odd):
    """A null, a stray or a skewed id leaves the parts of a hot group even, and slots gapless."""
    ids = [*range(4000), *odd]
    frame = spark.createDataFrame([(i, "same text" * 10) for i in ids] + [(100_000 + k, f"other {k}") for k in range(300)], "doc_id long, text string")
    rows = histogram_shard.histogram_shard(frame, F.col("text"), "doc_id", F.octet_length("text") + 1, piece_bytes=8000).collect()
    assert len(rows) == len(ids) + 300
    for shard in range(8):
        own = [r.slot for r in rows if r.shard == shard]
        assert sorted(own) == list(range(len(own)))
    keys = frame.select(F.xxhash64("text").alias("hi"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("lo"), (F.octet_length("text") + 1).cast("long").alias("size"))
    hot = histogram_shard._hot(keys, 8000)
    parts = histogram_shard._pieced(keys, 8, [], 0, hot).filter("hot").groupBy("part").agg(F.sum("size").alias("b")).collect()
    assert len(parts) >= 0.8 * 91 * len(ids) / 8000 and max(r.b for r in parts) <= 3 * 8000
    assert hot.count() == 1 and histogram_shard._hot(keys, 1 << 30).count() == 0
