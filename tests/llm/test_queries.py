"""The registered queries on the smallest tables: columns of the contracts, whole tables, the SQL there is."""

import os
import zlib

import numpy as np
import pytest

from lodestack.llm.queries import ORACLES, QUERIES
from tests import oracle
from tests.llm import brute

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.SF), reason="no tables here")

COLUMNS = {
    2: {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    4: {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    5: {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    6: {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    8: {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    10: {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    11: {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"},
    12: {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"},
    13: {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
}


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{oracle.SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("n", COLUMNS)
def test_contract_columns(spark, n):
    name = next(k for k in QUERIES if k.startswith(f"op{n}_"))
    assert COLUMNS[n].items() <= dict(QUERIES[name](spark, oracle.SF).dtypes).items()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_is_its_sql(spark, name):
    oracle.same(spark, oracle.connect(), QUERIES[name], ORACLES[name])


def test_suffix_dedup_query(spark, docs):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op2_suffix_dedup"](spark, oracle.SF).collect()}
    assert got == {i: (a, b, c, brute.digest(d)) for i, (a, b, c, d) in brute.repeats(docs).items()}


def test_ngram_join_query(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op4_ngram_join"](spark, oracle.SF).collect()}
    assert got == brute.components(docs)


def test_decontamination_query(spark, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{oracle.SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = {(r.doc_id, r.item_id) for r in QUERIES["op3_template_decontamination"](spark, oracle.SF).collect()}
    assert got == {(i, j) for i, t in docs for j, q in items if brute.holds(t, q)}
    assert got >= {(i, j) for i, t in docs for j, q in items if " ".join(q.lower().split()) in " ".join((t or "").lower().split())}


def test_models_on_held_out_rows(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{oracle.SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = QUERIES["op6_language_mixture"](spark, oracle.SF).collect()
    assert len(got) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id] for r in held) >= 0.97 * len(held)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{oracle.SF}/labels.parquet").collect()}
    got = QUERIES["op5_additive_quality"](spark, oracle.SF).collect()
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert len(got) == len(docs) and sum(r.predicted == labels[r.doc_id] for r in held) >= 0.9 * len(held)


def test_top_k_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{oracle.SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    ids = np.array([r[0] for r in rows])
    x = np.floor(1024 * np.array([r[1] for r in rows], dtype=np.float64)).astype(np.int64)
    want = {}
    for k in np.flatnonzero(ids % 100 == 0):
        score = x @ x[k]
        order = [j for j in np.lexsort((ids, -score)) if j != k][:10]
        want |= {(int(ids[k]), n + 1): (int(ids[j]), int(score[j])) for n, j in enumerate(order)}
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in QUERIES["op10_cover_tree"](spark, oracle.SF).collect()}
    assert got == want
