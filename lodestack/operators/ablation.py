"""Demo sessions, reports and transcripts of agent runs, as tables.

Every line of a report is a row (task, block, pos, line) and every transcript a text column, made by expressions; the driver
only joins finished lines of a report, a few dozen for each task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators import sessions

#: The demo's story: (retrieval, on odd runs only, kind, source asked, query or code, error). %t: task, %h: its hints.
STORY = [
    (True, False, sessions.QUERY, "manual", "how to stage %t", None),
    (True, False, sessions.EXEC, None, "plan = '%h'", None),
    (True, False, sessions.QUERY, "api", "colour management", None),
    (True, False, sessions.EXEC, None, "view.view_transform = 'AgX'", None),
    (True, False, sessions.QUERY, "gotchas", "registering classes", None),
    (True, False, sessions.EXEC, None, "register_class(Panel)", None),
    (False, False, sessions.EXEC, None, "import bgl", "ImportError"),
    (False, False, sessions.EXEC, None, "register_module(name)", "AttributeError"),
    (False, False, sessions.EXEC, None, "view.view_transform = 'agx'", None),
    (False, True, sessions.EXEC, None, "glow.glare_type = 'BLOOM'", "AttributeError"),
]
SCENES = {True: (6, 5, 4, 20, 3), False: (1, 1, 0, 0, 1)}


def demo_sessions(spark: SparkSession, tasks: DataFrame, runs: int) -> DataFrame:
    """Deterministic sessions with and without retrieval (see STORY) for each task (id, success_hints) and run."""
    story = spark.createDataFrame([(k, *step) for k, step in enumerate(STORY)], "turn int, rag_enabled boolean, odd boolean, type string, source_type string, words string, error_type string")
    scenes = spark.createDataFrame([(flag, counts) for flag, counts in SCENES.items()], f"rag_enabled boolean, final_scene {sessions.SNAPSHOT}")
    grid = tasks.select(F.col("id").alias("task_id"), F.coalesce("success_hints", F.array().cast("array<string>")).alias("success_hints"), F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run_index"), F.lit(True).alias("completed"))
    told = grid.withColumn("rag_enabled", F.explode(F.array(F.lit(True), F.lit(False)))).join(F.broadcast(story), "rag_enabled").filter(~F.col("odd") | (F.col("run_index") % 2 == 1))
    words = F.replace(F.replace("words", F.lit("%t"), F.col("task_id")), F.lit("%h"), F.array_join("success_hints", " "))
    asks = F.col("type") == sessions.QUERY
    event = F.struct(
        "turn", "type", F.when(asks, words).alias("query"), "source_type", F.when(asks, 5).alias("top_k"), F.when(asks, 2).alias("n_hits"), F.when(~asks, words).alias("code"),
        F.when(~asks, F.col("error_type").isNull()).alias("ok"), "error_type", F.when(F.col("error_type").isNotNull(), F.concat(F.lit("demo "), F.col("error_type"))).alias("error_message"), F.lit(None).alias("hits"),
    )
    events = F.transform(F.sort_array(F.collect_list(event)), lambda e: e.dropFields("turn")).cast(f"array<{sessions.EVENT}>")
    told = told.groupBy("task_id", "rag_enabled", "run_index").agg(events.alias("events"), F.first("completed").alias("completed"), F.first("success_hints").alias("success_hints"))
    return told.join(F.broadcast(scenes), "rag_enabled").select("task_id", "rag_enabled", "run_index", F.lit("demo").alias("model"), "events", "final_scene", "completed", "success_hints")


def ablation(scored: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(summaries, deltas, verdicts, pooled error rates) by task and condition of scored sessions."""
    plain = scored.withColumns({c: F.col(c).cast("int") for c in ("clean_run", "completed")})
    summary = sessions.summaries(plain, ["task_id", "rag_enabled"], sessions.METRICS)
    delta = sessions.deltas(summary)
    return summary, delta, sessions.verdicts(delta), sessions.pooled_error_rate(scored, ["task_id", "rag_enabled"])


# Parts of a report and a transcript that their readers look for.
TITLE, SUMMARY, SYNTHETIC, HELPED = "# Scene-eval report", "## Summary", "Synthetic backend", "RAG helped on"
TASK_HEAD, METRIC_HEAD = "| task | Δ error_rate", "| metric | RAG-off | RAG-on | Δ (on−off) | |"
POOLED, SPREAD, LOW, ONE_SIDE, EFFECT = "Pooled error_rate", "Spread (±pop. stdev)", "directional only", "Only one condition present", "RAG effect:"
BETTER, WORSE, NEUTRAL = "✅", "⚠️", "·"
SIDES = {False: "RAG-off", True: "RAG-on"}

#: Metrics whose means decide a task, as the summary names them, and how a gain in them is told.
SHORT = {"error_rate": "error_rate", "gotcha_hits": "gotcha_hits", "task_signal_rate": "task_signal", "query_before_call_rate": "grounding"}
GAINS = {"error_rate": "fewer failed runs", "gotcha_hits": "fewer outdated calls", "query_before_call_rate": "more runs after a query"}
#: Sessions of each condition from which a difference counts as more than a direction.
ENOUGH = 3


def _change(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(0.0)) == 0, "0").otherwise(F.format_string("%+.3f", c))


def _facts(scored: DataFrame) -> DataFrame:
    """A row for each task and metric: off and on (mean, stdev, n), delta, and gain (the delta, positive where it is better)."""
    summary, *_ = ablation(scored)
    side = lambda flag: F.max(F.when(F.col("rag_enabled") == flag, F.struct("mean", "stdev", "n")))
    way = reduce(lambda c, m: c.when(F.col("metric") == m, sessions.DIRECTION[m]), sessions.DIRECTION, F.when(F.lit(False), 0)).otherwise(0)
    facts = summary.groupBy("task_id", "metric").agg(side(False).alias("off"), side(True).alias("on")).withColumn("delta", F.col("on.mean") - F.col("off.mean"))
    return facts.withColumn("gain", F.when(F.abs("delta") >= 1e-9, F.col("delta") * way).otherwise(0.0))


def report_lines(scored: DataFrame) -> DataFrame:
    """task_id, block, pos, line of the tasks' sections: a heading, a table of metrics, and notes; no order is promised."""
    facts = _facts(scored).cache()
    order = F.array_position(F.array(*[F.lit(m) for m in sessions.METRICS]), F.col("metric")).cast("int")
    pick = lambda metric, part: F.max(F.when(F.col("metric") == metric, F.col(part)))
    pooled = scored.groupBy("task_id").agg(*[F.try_divide(F.sum(F.when(F.col("rag_enabled") == flag, F.col("code_errors"))), F.sum(F.when(F.col("rag_enabled") == flag, F.col("code_executions")))).alias(name) for flag, name in ((False, "pool_off"), (True, "pool_on"))])
    gains = [F.when(pick(m, "gain") > 0, F.concat(F.lit(f"{told} ("), F.format_string("%+.2f", pick(m, "delta")), F.lit(")"))) for m, told in GAINS.items()]
    spread = [F.format_string(f"{m} %.2f and %.2f", pick(m, "off.stdev"), pick(m, "on.stdev")) for m in sessions.KEY_METRICS]
    tasks = facts.groupBy("task_id").agg(
        F.coalesce(F.max("off.n"), F.lit(0)).alias("n_off"), F.coalesce(F.max("on.n"), F.lit(0)).alias("n_on"),
        F.array_join(F.array_compact(F.array(*gains)), ", ").alias("gains"), F.concat_ws(", ", *spread).alias("spread"),
    ).join(pooled, "task_id")
    both = (F.col("n_off") > 0) & (F.col("n_on") > 0)
    fewest = F.least("n_off", "n_on")
    notes = F.when(~both, F.array(F.lit(f"_{ONE_SIDE}: nothing to compare._"))).otherwise(
        F.array_compact(F.array(
            F.format_string(f"{POOLED} (all errors over all runs of code): %.3f off, %.3f on.", F.coalesce("pool_off", F.lit(0.0)), F.coalesce("pool_on", F.lit(0.0))),
            F.concat(F.lit(f"{SPREAD}, off and on: "), F.col("spread"), F.lit(".")),
            F.when(fewest < ENOUGH, F.format_string(f"{WORSE} %d sessions a condition: {LOW}.", fewest)),
            F.concat(F.lit(f"**{EFFECT}** "), F.when(F.col("gains") != "", F.col("gains")).otherwise("none that counts here"), F.lit(".")),
        ))
    )
    heads = tasks.select("task_id", F.lit(0).alias("block"), F.lit(0).alias("pos"), F.concat(F.lit("## "), F.col("task_id"), F.format_string(f" ({SIDES[True]} n=%d, {SIDES[False]} n=%d)", "n_on", "n_off")).alias("line"))
    tops = tasks.filter(both).select("task_id", F.lit(1).alias("block"), F.posexplode(F.array(F.lit(METRIC_HEAD), F.lit("|---|---:|---:|---:|:-:|"))).alias("pos", "line"))
    mark = F.when(F.col("gain") > 0, BETTER).when(F.col("gain") < 0, WORSE).otherwise(NEUTRAL)
    values = facts.filter("delta is not null").select("task_id", F.lit(1).alias("block"), (order + 1).alias("pos"), F.format_string("| %s | %.3f | %.3f | %s | %s |", "metric", "off.mean", "on.mean", _change(F.col("delta")), mark).alias("line"))
    ends = tasks.select("task_id", F.lit(2).alias("block"), F.posexplode(notes).alias("pos", "line"))
    return reduce(DataFrame.unionByName, [heads, tops, values, ends])


def summary_lines(scored: DataFrame) -> DataFrame:
    """task_id, helped, line: a row of the summary for each task that has both conditions."""
    _, delta, verdict, _ = ablation(scored)
    means = delta.groupBy("task_id").agg(*[F.max(F.when(F.col("metric") == m, F.col("delta"))).alias(m) for m in SHORT])
    cells = [_change(F.col(m)) for m in SHORT]
    return means.join(verdict, "task_id").select("task_id", "helped", F.concat(F.lit("| "), F.concat_ws(" | ", "task_id", *cells, F.when(F.col("helped"), BETTER).otherwise("➖")), F.lit(" |")).alias("line"))


def report(scored: DataFrame, backend: str = "", note: str = "") -> str:
    """The Markdown report of an ablation, tasks in order of name. What is collected grows with tasks, not with sessions."""
    parts = [TITLE]
    if backend:
        parts.append(f"Backend: {backend}. {note}".strip())
    if backend.lower().startswith(("fake", "demo")):
        parts.append(f"> {SYNTHETIC}: these sessions are scripted. They show that the machinery works, and measure nothing.")
    rows = summary_lines(scored).orderBy("task_id").collect()
    if rows:
        heading = TASK_HEAD + "".join(f" | Δ {name}" for m, name in SHORT.items() if m != "error_rate") + " | RAG |"
        parts += [SUMMARY, f"{HELPED} {sum(r.helped for r in rows)}/{len(rows)} tasks, by {', '.join(SHORT.values())}.", "\n".join([heading, "|---" + "|---:" * len(SHORT) + "|:-:|", *[r.line for r in rows]])]
    blocks: dict[tuple, list[str]] = {}
    for r in report_lines(scored).orderBy("task_id", "block", "pos").collect():
        blocks.setdefault((r.task_id, r.block), []).append(r.line)
    parts += ["\n".join(lines) if block == 1 else "\n\n".join(lines) for (_, block), lines in blocks.items()]
    return "\n\n".join(parts) + "\n"


def transcripts(rows: DataFrame, code_lines: int = 6) -> DataFrame:
    """task_id, rag_enabled, run_index, text of session rows (SESSION): numbered events with the first lines of their code,
    their errors and what lint finds in them, and a line of scores."""
    shown = sessions.score(rows, keep=["model", "success_hints", "events"])
    none = F.array().cast("array<string>")
    events, hints = F.coalesce("events", F.array().cast(rows.schema["events"].dataType)), F.coalesce("success_hints", none)
    part = lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else F.coalesce(x.cast("string"), F.lit("")) for x in c])

    def told(e: Column, at: Column) -> Column:
        number = F.lpad((at + 1).cast("string"), 3, " ")
        search = part(number, ". SEARCH", F.when(F.coalesce(e["source_type"], F.lit("")) != "", part(" [", e["source_type"], "]")), ": ", e["query"], "  -> ", e["n_hits"], " hits")
        ok = F.coalesce(e["ok"], F.lit(False))
        code = F.coalesce(e["code"], F.lit(""))
        cut = F.filter(F.slice(F.split(code, "\r?\n"), 1, code_lines), lambda x: F.trim(x) != "")
        exec_ = F.concat(
            F.array(part(number, ". EXEC [", F.when(ok, "OK").otherwise(part("ERR ", e["error_type"])), "]")),
            F.transform(cut, lambda x: part("     | ", x)),
            F.when(~ok & e["error_message"].isNotNull(), F.array(part("     error: ", e["error_message"]))).otherwise(none),
            F.transform(sessions.lint(code), lambda h: part("     lint (", h["severity"], ") ", h["rule_id"], ": ", h["fix"])),
        )
        return F.when(e["type"] == sessions.QUERY, F.array(search)).otherwise(exec_)

    side = F.when(F.col("rag_enabled"), SIDES[True]).otherwise(SIDES[False])
    head = part("## ", F.col("task_id"), " (", side, ", run ", F.col("run_index"), F.when(F.coalesce("model", F.lit("")) != "", part(", model ", F.col("model"))), ")")
    numbers = [f"{name} " for name in ("executions", "errors", "error rate", "queries", "grounding", "lint hits", "task signal", "completed")]
    values = [F.col("code_executions"), F.col("code_errors"), F.format_string("%.2f", "error_rate"), F.col("rag_queries"), F.format_string("%.2f", "query_before_call_rate"), F.col("gotcha_hits"), F.format_string("%.2f", "task_signal_rate"), F.col("completed")]
    tail = F.concat(F.lit("summary: "), F.concat_ws(", ", *[part(n, v) for n, v in zip(numbers, values, strict=True)]))
    lines = F.concat(
        F.array(head), F.when(F.size(hints) > 0, F.array(part("brief concepts: ", F.array_join(hints, ", ")))).otherwise(none),
        F.flatten(F.transform(events, told)), F.array(tail),
    )
    return shown.select("task_id", "rag_enabled", "run_index", F.array_join(lines, "\n").alias("text"))
