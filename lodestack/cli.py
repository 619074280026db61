"""Command line: build a corpus, its chunks, contexts and index, search and evaluate it, and compare agent sessions.

`python -m lodestack.cli -h` lists the commands."""

from __future__ import annotations

import argparse
import importlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.config import Settings, load_settings
from lodestack.operators import ablation, chunking, contexts, evaluation, index, retrieval, sessions, sqltool
from lodestack.session import local_session
from lodestack.sources import documents as sources
from lodestack.sources import jsonl, registry, versions
from lodestack.sources.file_sink import write_files

DOCUMENT = "id string, text string, source_type string, source_url string, title string, version string, extra struct<" + ",".join(f"{k}:{t}" for k, t in sources.EXTRA.items()) + ">"
LABELLED = "query string, type string, expect array<string>, filter struct<version:string>"
TASK = "id string, prompt string, success_hints array<string>"
#: The ways to search that an evaluation compares.
CONFIGURATIONS = ("vector", "hybrid", "hybrid+symbol", "hybrid+rerank")


def build_corpus(spark: SparkSession, settings: Settings, out: str, names: list[str] | None = None) -> DataFrame:
    """Documents of the registered sources as JSON Lines; returns what was written."""
    jsonl.write_jsonl(registry.read(spark, settings, names), out)
    return spark.read.schema(DOCUMENT).json(out)


def corpus_report(docs: DataFrame) -> DataFrame:
    """what (type, version or all), value, docs, chars."""
    named = docs.select(F.col("source_type").alias("type"), "version", F.length("text").alias("n"))
    sums = named.groupingSets([["type"], ["version"], []], "type", "version").agg(F.grouping_id().alias("g"), F.count("*").alias("docs"), F.sum("n").alias("chars"))
    what = F.when(F.col("g") == 1, "type").when(F.col("g") == 2, "version").otherwise("all")
    return sums.select(what.alias("what"), F.coalesce("type", "version", F.lit("")).alias("value"), "docs", F.coalesce("chars", F.lit(0)).alias("chars")).orderBy("what", "value")


def gather(spark: SparkSession, settings: Settings, out: str, names: list[str]) -> DataFrame:
    """Each creative source as JSON Lines of its own, outside the index; source, version_status, docs."""
    parts = []
    for name in names:  # the sources named on the command line
        jsonl.write_jsonl(registry.read(spark, settings, [name], registry.CREATIVE), f"{out}/{name}.jsonl")
        rows = spark.read.schema(DOCUMENT).json(f"{out}/{name}.jsonl")
        parts.append(rows.groupBy(F.lit(name).alias("source"), F.coalesce("extra.version_status", F.lit("?")).alias("version_status")).agg(F.count("*").alias("docs")))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.orderBy("source", "version_status")


def build_chunks(spark: SparkSession, corpus: str, out: str) -> DataFrame:
    """Chunks of a JSONL corpus, with the metadata of their documents (a chunk's own fields come first)."""
    docs = jsonl.read_jsonl(spark, corpus, DOCUMENT, ["id", "text", "source_type"], "Document")
    chunks = chunking.chunk_corpus(docs.withColumnRenamed("id", "doc_id"))
    meta = docs.select(F.col("id").alias("doc_id"), "source_type", "source_url", "title", "version", F.col("extra.symbol").alias("_symbol"), F.col("extra.kind").alias("kind"))
    joined = chunks.join(meta, "doc_id").withColumn("symbol", F.coalesce("symbol", "_symbol")).withColumn("context", F.lit("")).drop("_symbol")
    joined.write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def build_context(spark: SparkSession, corpus: str, chunks: str, generate: Callable[[list[str], list[str]], list[str]], scope: list[str] | None = None, limit: int = 0, store: str = "", batches: int = 16, versioned: bool = False) -> tuple[int, int]:
    """Give the chunks contexts; (chunks with a context, chunks).

    limit: only the first by document and place, the rest stays untouched. store: where finished batches are kept (beside the
    chunks by default), so that a run that was cut off goes on where it ended. The table is replaced in place, which any
    Parquet reader sees, or (versioned) gets a new version that appears in one step, for readers of sources.versions."""
    table = versions.read(spark, chunks)
    docs = spark.read.schema(DOCUMENT).json(corpus)
    todo = table
    if limit:
        head = table.select("doc_id", "chunk_index").orderBy("doc_id", "chunk_index").limit(limit)
        todo = table.join(F.broadcast(head), ["doc_id", "chunk_index"], "left_semi")
    done = contexts.generate(todo, docs, generate, store or f"{chunks.rstrip('/')}.contexts", batches, scope)
    if limit:
        done = done.select(*table.columns).unionByName(table.join(F.broadcast(head), ["doc_id", "chunk_index"], "left_anti").select(*table.columns))
    if versioned:
        versions.publish(done, chunks)
    else:
        jsonl.rewrite(done, chunks)
    return versions.read(spark, chunks).agg(F.count_if(F.coalesce("context", F.lit("")) != ""), F.count("*")).first()


def statistics(chunks: DataFrame) -> DataFrame:
    size = F.greatest(F.lit(1), F.floor(F.length("text") / 4))
    return chunks.groupBy("source_type").agg(F.count("*").alias("chunks"), F.min(size).alias("least"), F.floor(F.avg(size)).alias("mean"), F.max(size).alias("most")).orderBy("source_type")


def build_index(spark: SparkSession, chunks: str, root: str) -> int:
    index.build_table(versions.read(spark, chunks).withColumnRenamed("chunk_index", "position"), retrieval.hashed_encoder(), root)
    return index.open_table(spark, root).count()


def search(spark: SparkSession, root: str, queries: DataFrame, top_k: int = 6, source_type: str | None = None, version: str | None = None, way: str = "hybrid", score: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """The hits of a table of queries (query_id, query), best first, by one of CONFIGURATIONS."""
    mode, _, extra = way.partition("+")
    if way not in CONFIGURATIONS or extra == "rerank" and score is None:
        raise ValueError(f"no way to search by {way}")
    return index.search(spark, root, queries, retrieval.hashed_encoder(), top_k, source_type, version, "symbol" if extra == "symbol" else mode, score if extra == "rerank" else None)


def search_tool(spark: SparkSession, root: str, query: str, top_k: int = 6, source_type: str | None = None, version: str | None = None) -> list[dict]:
    """The search as a tool: one question, its hits as plain dictionaries (what a server hands to an agent)."""
    if source_type is not None and source_type not in sources.SOURCE_TYPES:
        raise ValueError(f"unknown source type {source_type}")
    found = search(spark, root, spark.createDataFrame([(1, query)], "query_id long, query string"), top_k, source_type, version)
    return [{c: r[c] for c in (*retrieval.HIT_FIELDS, "score")} for r in found.orderBy("rank").collect()]  # top_k rows


def per_query(spark: SparkSession, root: str, labelled: str, k: int, way: str, score: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """evaluation.query_metrics() of a labelled query file, with query and expect; a query's version filter is obeyed."""
    rows = spark.read.schema(LABELLED).json(labelled).withColumn("query_id", F.monotonically_increasing_id())
    hits = None
    for r in rows.select("filter.version").distinct().collect():  # a handful of versions
        own = rows.filter(F.col("filter.version").eqNullSafe(F.lit(r[0])))
        found = search(spark, root, own, k, version=r[0], way=way, score=score)
        hits = found if hits is None else hits.unionByName(found)
    expects = rows.select("query_id", F.posexplode("expect").alias("expect_no", "e"))
    fields = [evaluation.text_of(F.col(c)) for c in evaluation.FIELDS]
    matches = hits.join(expects, "query_id").filter(evaluation.hit_matches(F.col("e"), *fields)).select("query_id", "rank", "expect_no")
    asked = rows.select("query_id", "type", F.coalesce(F.size("expect"), F.lit(0)).alias("n_expect"))
    return evaluation.query_metrics(asked, matches, k).join(rows.select("query_id", "query", "expect"), "query_id")


def evaluate(spark: SparkSession, root: str, labelled: str, k: int = 5, score: Callable[[Column, Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(way, type, hit_at_k, recall_at_k, mrr, n) of every way to search, and the queries that each misses (way, type, query, expect).

    Without a score to rerank with, that way is left out."""
    quality, missed = None, None
    for way in CONFIGURATIONS if score else CONFIGURATIONS[:-1]:
        own = per_query(spark, root, labelled, k, way, score)
        means = evaluation.macro(own, by_type=True).select(F.lit(way).alias("way"), "*")
        gone = own.filter("hit = 0").select(F.lit(way).alias("way"), F.coalesce("type", F.lit("?")).alias("type"), "query", "expect")
        quality, missed = (means, gone) if quality is None else (quality.unionByName(means), missed.unionByName(gone))
    return quality.orderBy("way", "type"), missed.orderBy("way", "query")


def scene_eval(spark: SparkSession, tasks: str, runs: int, out: str) -> str:
    """The demo ablation: a JSON file for each session, a report, and the summaries."""
    rows = ablation.demo_sessions(spark, spark.read.schema(TASK).json(tasks), runs)
    name = F.concat_ws("_", "task_id", F.when(F.col("rag_enabled"), "on").otherwise("off"), F.concat(F.col("run_index").cast("string"), F.lit(".json")))
    logs = rows.withColumn("note", F.lit("")).select(name.alias("name"), F.to_json(F.struct(*rows.columns, "note"), {"ignoreNullFields": "false"}).alias("text"))
    write_files(logs, f"{out}/sessions")
    scored = sessions.score(rows)
    text = ablation.report(scored, "demo", f"{scored.select('task_id').distinct().count()} tasks x {runs} runs/condition.")
    summary = json.dumps([r.asDict() for r in ablation.ablation(scored)[0].collect()], indent=2)  # a row for each task, condition and metric
    write_files(spark.createDataFrame([("report.md", text), ("summary.json", summary)], "name string, text string"), out)
    return text


def show_session(spark: SparkSession, path: str, code_lines: int = 6) -> str:
    """The transcripts of the session files at path."""
    rows = spark.read.schema(sessions.SESSION).option("multiLine", True).json(path)
    return "\n\n".join(r["text"] for r in ablation.transcripts(rows, code_lines).orderBy("task_id", "rag_enabled", "run_index").toLocalIterator())


def verify(spark: SparkSession, root: str, query: str, top_k: int = 3) -> str:
    """Ask the search tool and the search function of SQL the same question; a report, or ValueError where they differ."""
    tool = search_tool(spark, root, query, top_k)
    sqltool.register(spark, root)
    rows = spark.sql("SELECT * FROM lodestack_search(:query, top_k => :top_k)", {"query": query, "top_k": top_k}).orderBy("rank").collect()
    if [(h["id"], h["score"]) for h in tool] != [(r["id"], r["score"]) for r in rows]:
        raise ValueError("the search tool and lodestack_search() do not agree")
    return "\n".join([f"{len(tool)} hits, tool and SQL agree", *[f"  - {h['title']} | v{h['version']} | {h['source_type']}" for h in tool]])


def named(place: str) -> Callable:
    """The function that `module:name` names."""
    module, _, name = place.partition(":")
    if not name:
        raise ValueError(f"{place!r} is no module:name")
    return getattr(importlib.import_module(module), name)


def contextualise(spark: SparkSession, settings: Settings, generate: Callable[[list[str], list[str]], list[str]], limit: int = 0) -> str:
    """build_context() over the settings' corpus and chunks, in their scope; nothing unless `contextual.enabled` is set."""
    if not settings.section("contextual", "enabled", default=False):
        return "contextual.enabled is not set; nothing was done"
    done, total = build_context(spark, str(settings.path("corpus")), str(settings.path("chunks")), generate, settings.section("contextual", "scope"), limit)
    return f"{done} of {total} chunks have a context"


#: Positional arguments of the commands.
COMMANDS = {
    "build-corpus": ["settings"], "build-chunks": ["corpus", "chunks"], "build-index": ["chunks", "index"], "build-all": ["settings"], "gather": ["settings", "out"],
    "search": ["index", "query"], "eval": ["index", "labelled"], "scene-eval": ["tasks", "out"], "show-session": ["session"],
    "build-context": ["settings", "generator"], "verify": ["index", "query"],
}


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lodestack", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, wants in COMMANDS.items():
        own = commands.add_parser(name)
        for w in wants:
            own.add_argument(w)
        own.add_argument("--k", type=int, default=5)
        own.add_argument("--runs", type=int, default=3)
        own.add_argument("--code-lines", type=int, default=6)
        own.add_argument("--sources", nargs="+")
        own.add_argument("--source-type")
        own.add_argument("--version")
        own.add_argument("--symbol-boost", action="store_true")
        own.add_argument("--limit", type=int, default=0, help="chunks to give a context at most (0: all)")
        own.add_argument("--reranker", help="module:name of a model that scores (queries, texts)")
    got = parser.parse_args(args)
    spark = SparkSession.getActiveSession() or local_session()
    settings = load_settings(got.settings) if "settings" in got else None
    if got.command in ("build-corpus", "build-all"):
        corpus_report(build_corpus(spark, settings, str(settings.path("corpus")), got.sources)).show(truncate=False)
    if got.command == "build-all":
        got.corpus, got.chunks, got.index = (str(settings.path(p)) for p in ("corpus", "chunks", "index"))
    if got.command in ("build-chunks", "build-all"):
        statistics(build_chunks(spark, got.corpus, got.chunks)).show()
    if got.command in ("build-index", "build-all"):
        print(build_index(spark, got.chunks, got.index), "records")
    if got.command == "gather":
        gather(spark, settings, got.out, got.sources or list(registry.CREATIVE)).show(truncate=False)
    if got.command == "search":
        queries = spark.createDataFrame([(1, got.query)], "query_id long, query string")
        for r in search(spark, got.index, queries, got.k, got.source_type, got.version, "hybrid+symbol" if got.symbol_boost else "hybrid").orderBy("rank").collect():
            print(f"{r['rank']}. [{r.score:.6f}] ({r.version}) {r.title}\n   {r.source_url}\n   {r.text[:180]}")
    if got.command == "eval":
        quality, missed = evaluate(spark, got.index, got.labelled, got.k, retrieval.scorer(named(got.reranker)) if got.reranker else None)
        quality.show(1000, False)
        missed.show(1000, 60)
    if got.command == "build-context":
        print(contextualise(spark, settings, named(got.generator), got.limit))
    if got.command == "verify":
        print(verify(spark, got.index, got.query))
    if got.command == "scene-eval":
        print(scene_eval(spark, got.tasks, got.runs, got.out))
    if got.command == "show-session":
        print(show_session(spark, got.session, got.code_lines))


if __name__ == "__main__":
    main()
