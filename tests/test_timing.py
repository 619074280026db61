"""Interval joins, session windows with late rows, sketches, versions, contexts that go on, counts taken while writing."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lodestack.operators import contexts, index, intervals, retrieval, sketches, sqltool
from lodestack.sources import jsonl, versions
from lodestack.streaming import windows


def test_points_in_intervals(spark):
    rng = random.Random(4)
    spans = [(rng.choice("ab"), i, a, a + rng.choice([1, 2, 7, 64, 65, 1000, 10**6, 1 << 40])) for i, a in enumerate(rng.randrange(-3000, 3000) for _ in range(150))]
    spans += [("a", 900, 5, 5), ("a", 901, 9, 3), (None, 902, 0, 9), ("a", 903, None, 9), ("b", 904, -(1 << 60), 1 << 60), spans[0]]
    points = [(rng.choice("abc"), i, rng.choice([rng.randrange(-4000, 4000), rng.randrange(1 << 41)])) for i in range(300)] + [(None, 800, 1), ("a", 801, None)]
    left, right = spark.createDataFrame(points, "k string, p long, at long"), spark.createDataFrame(spans, "k string, s long, low long, high long")
    want = sorted((p[1], s[1]) for p in points for s in spans if p[0] is not None and p[0] == s[0] and None not in (p[2], s[2]) and s[2] <= p[2] < s[3])
    found = intervals.stab_join(left, right, ["k"], "at", "low", "high")
    assert sorted((r.p, r.s) for r in found.collect()) == want and found.columns == ["k", "p", "at", "s", "low", "high"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    kept = [(r.p, r.s) for r in intervals.stab_join(left, right, ["k"], "at", "low", "high", "left").collect()]
    assert sorted(x for x in kept if x[1] is not None) == want and {p for p, s in kept if s is None} == {p[1] for p in points} - {p for p, _ in want}
    assert intervals.stab_join(left, right.limit(0), ["k"], "at", "low", "high", "left").count() == len(points)
    with pytest.raises(ValueError):
        intervals.stab_join(left, right.withColumnRenamed("s", "p"), ["k"], "at", "low", "high")


def test_overlaps(spark):
    rng = random.Random(6)
    make = lambda n, seed: [(rng.choice("ab"), i, a, a + rng.choice([0, 1, 5, 40, 900])) for i, a in enumerate(rng.randrange(800) for _ in range(n))]
    one, two = make(80, 1), make(90, 2)
    left, right = spark.createDataFrame(one, "k string, x long, a long, b long"), spark.createDataFrame(two, "k string, y long, c long, d long")
    got = sorted((r.x, r.y) for r in intervals.overlap_join(left, right, ["k"], ("a", "b"), ("c", "d")).collect())
    assert got == sorted((p[1], q[1]) for p in one for q in two if p[0] == q[0] and p[2] < q[3] and q[2] < p[3] and p[2] < p[3] and q[2] < q[3])


def test_sessions_of_a_shuffled_stream_are_those_of_the_batch(spark, tmp_path):
    rng, start = random.Random(3), dt.datetime(2024, 1, 1)
    rows = [(rng.choice(["a", "b", None]), start + dt.timedelta(seconds=sum(rng.choice([5, 60, 400]) for _ in range(2)) + i * 50), i) for i in range(400)]
    rows.sort(key=lambda r: r[1].timestamp() + rng.random() * 500)
    kind, totals = "k string, at timestamp, n long", (F.count("*").alias("rows"), F.sum("n").alias("total"))
    for k in range(0, 400, 50):
        spark.createDataFrame(rows[k : k + 50], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = windows.session_totals(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), "k", "at", "150 seconds", "10 minutes", *totals)
        windows.drained(stream, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    spark.createDataFrame([("end", start + dt.timedelta(days=3), 0)], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = windows.session_totals(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), "k", "at", "150 seconds", "10 minutes", *totals)
    windows.drained(stream, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    batch = windows.session_totals(spark.createDataFrame(rows, kind), "k", "at", "150 seconds", "10 minutes", *totals)
    got = sorted(tuple(r) for r in spark.read.schema(batch.schema).parquet(str(tmp_path / "out")).collect())
    assert got == sorted(tuple(r) for r in batch.collect()) and len(got) > 20


def test_sketches_merge_within_their_bounds(spark):
    rows = spark.range(60_000).select((F.col("id") % 3).alias("g"), F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, cast(id % 9 as int))").alias("at"), (F.col("id") % 17_000).alias("item"), (F.col("id") * 7919 % 60_000).cast("double").alias("v"))
    rows = rows.unionByName(spark.createDataFrame([(7, None, None, None)], rows.schema))
    daily = sketches.daily(rows, ["g"], F.col("at"), F.col("item"), F.col("v"))
    assert daily.count() == 10 and daily.columns == ["g", "day", "n", "items", "values"]
    some = sketches.merged(daily.filter("g < 3 AND day < '2024-01-04'"), ["g"]).select("g", "n", sketches.distinct(F.col("items")).alias("d"), *[sketches.quantile(F.col("values"), q).alias(f"q{i}") for i, q in enumerate((0.1, 0.5, 0.9))]).collect()
    exact = {r.g: r for r in rows.filter("at < '2024-01-04' AND g < 3").groupBy("g").agg(F.count("*").alias("n"), F.count_distinct("item").alias("d"), F.sort_array(F.collect_list("v")).alias("v")).collect()}
    for r in some:
        own = exact[r.g]
        assert r.n == own.n and abs(r.d - own.d) <= 3 * sketches.HLL_RSE * own.d
        for i, q in enumerate((0.1, 0.5, 0.9)):
            rank = sum(x <= r[f"q{i}"] for x in own.v) / len(own.v)
            assert abs(rank - q) <= sketches.KLL_RANK + 1 / len(own.v)


def test_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    spark.range(5).write.parquet(root)
    assert versions.current(spark, root) == 0 and versions.read(spark, root).count() == 5
    assert versions.publish(versions.read(spark, root).filter("id < 3"), root) == 1 and versions.read(spark, root).count() == 3
    held = versions.read(spark, root)
    assert versions.publish(held.union(held), root) == 2 and held.count() == 3 and versions.read(spark, root, 0).count() == 5
    with pytest.raises(FileExistsError):
        versions.publish(spark.range(1), root, after=1)
    with pytest.raises(Exception, match="(?i)boom"):
        versions.publish(spark.range(3).select(F.raise_error(F.lit("boom")).cast("long").alias("id")), root)
    assert versions.current(spark, root) == 2 and versions.read(spark, root).count() == 6
    assert versions.vacuum(spark, root, 1) >= 1 and versions.read(spark, root).count() == 6


def test_contexts_go_on_where_a_run_ended(spark, tmp_path):
    log, limit = tmp_path / "log", tmp_path / "limit"
    limit.write_text("40")

    def model(docs, texts):
        with open(log, "a") as f:
            f.writelines(t + "\n" for t in texts)
        if len(log.read_text().split()) > int(limit.read_text()):
            raise RuntimeError("the model is gone")
        return [f"{len(d)}:{t}" for d, t in zip(docs, texts, strict=True)]

    docs = spark.createDataFrame([("d0", "x" * 7), ("d1", "y" * 9)], "id string, text string")
    rows = [(f"c{i}", f"d{i % 3}", "manual" if i % 4 else "api", "old" if i == 5 else "", f"t{i}") for i in range(100)]
    chunks = spark.createDataFrame(rows, "id string, doc_id string, source_type string, context string, text string").repartition(3)
    with pytest.raises(Exception, match="model is gone"):
        contexts.generate(chunks, docs, model, str(tmp_path / "store"), 10, ["manual"])
    done = {r.id for r in contexts.finished(spark, str(tmp_path / "store")).collect()}
    assert 0 < len(done) < 60
    log.write_text("")
    limit.write_text("1000")
    got = {r.id: r.context for r in contexts.generate(chunks, docs, model, str(tmp_path / "store"), 10, ["manual"]).collect()}
    size = {"d0": 7, "d1": 9}
    assert got == {i: c or (f"{size.get(d, len(t))}:{t}" if s == "manual" else "") for i, d, s, c, t in rows}
    assert sorted(log.read_text().split()) == sorted(t for i, _, s, c, t in rows if s == "manual" and not c and i not in done)
    log.write_text("")
    assert contexts.generate(chunks, docs, model, str(tmp_path / "store"), 10, ["manual"]).count() == 100 and not log.read_text()


def test_counts_are_taken_while_writing(spark, tmp_path):
    rows = spark.range(100).select("id", F.concat(F.lit("t"), "id").alias("text"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("write", "")
    try:
        got = jsonl.write_jsonl(rows, str(tmp_path / "out"), chars=F.sum(F.length("text")))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {"rows": 100, "chars": 290} and len(tracker.getJobIdsForGroup("write")) == 1
    assert jsonl.write_jsonl(rows.limit(0), str(tmp_path / "none")) == 0 and jsonl.write_jsonl(rows, str(tmp_path / "one"), single=True) == 100


def test_search_in_sql(spark, tmp_path):
    rng = random.Random(2)
    vocabulary = "alpha beta gamma delta eps zeta eta mesh light bake".split()
    rows = [(f"c{i:03}", "d", ("manual", "api")[i % 2], ["5.0", "5.1"][i % 3 == 0], f"T{i}", " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 30)))) for i in range(200)]
    encode = retrieval.hashed_encoder(32)
    index.build_table(spark.createDataFrame(rows, "id string, doc_id string, source_type string, version string, title string, text string"), encode, str(tmp_path))
    asked = [(1, "mesh light"), (2, "Bake eta eta"), (3, "zzz"), (4, "")]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    queries.createOrReplaceTempView("asked")
    sqltool.register(spark, str(tmp_path), 32)
    fields = ["query_id", "rank", "id", "score", "title", "source_type", "version", "text"]
    read = lambda rows: sorted(tuple(r[c] for c in fields) for r in rows.collect())
    for kind, version in ((None, None), ("api", None), ("manual", "5.1")):
        given = "".join(f", {n} => '{v}'" for n, v in (("source_type", kind), ("version", version)) if v)
        got = spark.sql(f"SELECT asked.query_id, s.* FROM asked, LATERAL lodestack_search(asked.query, top_k => 5{given}) s")
        assert read(got) == read(index.search(spark, str(tmp_path), queries, encode, 5, kind, version))
    one = spark.sql("SELECT 1 AS query_id, * FROM lodestack_search('mesh light', source_type => 'api')")
    assert read(one) == read(index.search(spark, str(tmp_path), queries.filter("query_id = 1"), encode, 6, "api"))
    assert "source_type=api" in one.inputFiles()[0] or all("source_type=manual" not in f for f in one.inputFiles()) or "PartitionFilters: [isnotnull(source_type" in one._jdf.queryExecution().executedPlan().toString()
