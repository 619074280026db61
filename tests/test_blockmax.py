"""Postings in blocks against BM25 over the whole table, and how many of them are decoded."""

import random

import pytest
from pyspark.sql import functions as F

from lodestack.operators import blockmax, index, retrieval


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    rng = random.Random(8)
    topics = [[f"t{t}w{k}" for k in range(30)] for t in range(12)]
    rows = [(f"c{i:05}", "d", ("manual", "api", "code")[i * 3 // 1500], ["5.0", "5.1"][i % 2], " ".join(rng.choice(topics[i * 12 // 1500] + ["the", "of", "a1"] * 8) for _ in range(rng.randrange(60)))) for i in range(1500)]
    rows += [("copy", *rows[700][1:]), ("empty", "d", "api", "5.0", "")]
    path = str(tmp_path_factory.mktemp("blocks"))
    index.build_table(spark.createDataFrame(rows, "id string, doc_id string, source_type string, version string, text string"), lambda text: F.array(F.length(text).cast("float")), path)
    return path


def asked(spark):
    rng = random.Random(9)
    rows = [(q, " ".join([f"t{q % 12}w{rng.randrange(30)}" for _ in range(4)] + ["the"] * (q % 2))) for q in range(24)]
    return spark.createDataFrame([*rows, (90, "the of"), (91, "unknown words"), (92, ""), (93, None), (None, "the t1w1")], "query_id long, query string")


@pytest.mark.parametrize("k, where", [(5, None), (40, None), (2000, None), (7, "version = '5.1'"), (3, "source_type = 'none'")])
def test_results_are_those_of_the_whole_table(spark, root, k, where):
    table, where = index.open_table(spark, root), None if where is None else F.expr(where)
    read = lambda found, id_: sorted((r.query_id, r[id_], round(r.score, 9), r["rank"]) for r in found.collect())
    want = read(retrieval.bm25(asked(spark), table, k, where, doc_id="id", text="embed_text"), "doc_id")
    assert read(index.lexical(spark, root, asked(spark), k, where, pruned=True), "id") == want
    assert read(index.lexical(spark, root, asked(spark), k, where), "id") == want


def test_most_blocks_are_not_decoded(spark, root):
    n, avgdl = index.open_table(spark, root, "stats").first()
    held = index.open_table(spark, root, "blocks")
    found = blockmax.Search(asked(spark).filter("query_id < 24 AND query_id % 2 = 1"), held, index.open_table(spark, root, "terms"), n, avgdl, 5, probe=1).decoded()
    blocks, decoded = found.agg(F.sum("blocks"), F.sum("decoded")).first()
    print(f"decoded {decoded} of {blocks} blocks: {decoded / blocks:.3f}")
    assert found.count() == 12 and decoded < 0.5 * blocks
    assert held.agg(F.max("n")).first()[0] <= 1 << blockmax.SEGMENT_BITS
    posts = index.open_table(spark, root, "postings")
    assert held.agg(F.sum("n")).first()[0] == posts.count() and held.select(F.size("docs") == F.col("n")).distinct().collect()[0][0]


def test_searches_with_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "a")], "doc_id long, text string")
    got = retrieval.bm25(spark.createDataFrame([(None, "a"), (7, "a")], "query_id long, query string"), docs)
    assert sorted((r.query_id, r.doc_id) for r in got.collect()) == [(7, 1), (7, 3)]
    table = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, None), (4, [1.0, None]), (5, [0.5, 0.5]), (6, [])], "id long, vector array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0, 0.0]), (3, [None, 1.0]), (None, [1.0, 0.0]), (4, None)], "query_id long, vector array<double>")
    got = sorted((r.query_id, r.id, round(r.score, 6), r["rank"]) for r in retrieval.knn(queries, table, 3).collect())
    assert got == [(1, 1, 1.0, 1), (1, 5, 0.707107, 2), (2, 2, 1.0, 1)]


def test_a_task_keeps_the_best_across_its_batches(spark):
    """Ties beyond k, many small batches and several tasks give what one sort over everything gives."""
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("abcd") for _ in range(rng.choice([2, 2, 3, 6])))) for i in rng.sample(range(5000), 3000)], "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame([(1, "a"), (2, "a b"), (3, "d c a"), (4, "zz")], "query_id long, query string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        few = retrieval.bm25(queries, docs, 15).collect()
        every = retrieval.bm25(queries, docs, 5000).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    key = lambda r: (r.query_id, r["rank"], r.doc_id, round(r.score, 9))
    assert sorted(map(key, few)) == sorted(key(r) for r in every if r["rank"] <= 15) and len(few) == 45
