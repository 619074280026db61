"""Scores of agent sessions: a session is a row with an ordered array of events; no event is shuffled to score it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENT = "struct<type:string,query:string,source_type:string,top_k:int,n_hits:int,code:string,ok:boolean,error_type:string,error_message:string,hits:array<struct<title:string,source_url:string,source_type:string,text:string>>>"
SNAPSHOT = "struct<objects:int,meshes:int,materials:int,material_nodes:int,lights:int>"
SESSION = f"task_id string, rag_enabled boolean, run_index int, model string, events array<{EVENT}>, final_scene {SNAPSHOT}, completed boolean, success_hints array<string>, note string"
QUERY, EXEC = "rag_query", "code_exec"
# Names of metrics, which way each is better (the others are neutral), and those that decide whether a task was helped.
METRICS = ["error_rate", "clean_run", "query_before_call_rate", "gotcha_hits", "task_signal_rate", "scene_total", "completed", "code_executions", "code_errors", "rag_queries", "iterations"]
DIRECTION = {"error_rate": -1, "clean_run": 1, "query_before_call_rate": 1, "gotcha_hits": -1, "task_signal_rate": 1, "scene_total": 1, "completed": 1, "code_errors": -1}
KEY_METRICS = ["error_rate", "gotcha_hits", "task_signal_rate", "query_before_call_rate"]

# Ids, patterns and severities of the lint rules. A pattern finds each use of what no longer works; the third entry says what to write instead.
RULES = [
    ("eevee_next_engine_id", r"(?U)\bBLENDER_EEVEE_NEXT\b", "The engine id is plain BLENDER_EEVEE again.", "raises"),
    ("nishita_sky_removed", r"(?U)\bNISHITA\b", "This sky model is gone; choose another sky_type.", "raises"),
    ("agx_view_transform_casing", r"(?U)view_transform\s*=\s*['\"](?!AgX['\"])(?i:agx)['\"]", "Spell it AgX.", "raises"),
    ("glare_type_attribute", r"(?U)\.glare_type\b", "The glare settings are input sockets of the node now.", "silent"),
    ("bgl_module_removed", r"(?U)\bimport\s+bgl\b|\bbgl\.", "Draw with the gpu module.", "raises"),
    ("register_module_removed", r"(?U)\b(?:un)?register_module\b", "Register each class by itself.", "raises"),
    ("new_effect_missing_length", r"(?U)new_effect\s*\((?:[^()]|\([^()]*\))*\)", "Name the length of the strip.", "raises"),
]


def strip_comments(code: Column) -> Column:
    """Each line up to its first # outside quotes; a quote ends with its line."""
    return F.regexp_replace(code, "(?m)^((?:[^'\"#\n]++|'[^'\n]*+'|\"[^\"\n]*+\")*+)#.*$", "$1")


def lint(code: Column) -> Column:
    """array<struct<rule_id, match, fix, severity>>: one entry for each use, in the order of the rules."""
    plain = strip_comments(code)
    found = []
    for rule, pattern, fix, severity in RULES:
        hits = F.regexp_extract_all(plain, F.lit(pattern), F.lit(0))
        if rule == "new_effect_missing_length":
            hits = F.filter(hits, lambda m: ~F.contains(m, F.lit("length=")))
        found.append(_entries(hits, rule, fix, severity))
    return F.concat(*found)


def _entries(hits: Column, rule: str, fix: str, severity: str) -> Column:
    return F.transform(hits, lambda m: F.struct(F.lit(rule).alias("rule_id"), m.alias("match"), F.lit(fix).alias("fix"), F.lit(severity).alias("severity")))


def query_before_call_rate(events: Column) -> Column:
    """Share of code runs whose event just before is a query; with two kinds of events that is 'a query is pending'."""
    n = F.size(F.filter(events, lambda e: e["type"] == EXEC))
    led = F.size(F.filter(events, lambda e, i: (e["type"] == EXEC) & (i > 0) & (F.get(events, i - 1)["type"] == QUERY)))
    return F.when(n > 0, led / n).otherwise(0.0)


def task_signal_rate(events: Column, hints: Column) -> Column:
    """Share of hints that occur in the code of all runs, whatever the case; 0 without hints."""
    code = F.lower(F.array_join(F.transform(F.filter(events, lambda e: e["type"] == EXEC), lambda e: F.coalesce(e["code"], F.lit(""))), "\n"))
    return F.when(F.size(hints) > 0, F.size(F.filter(hints, lambda h: F.contains(code, F.lower(h)))) / F.size(hints)).otherwise(0.0)


def score(sessions: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """task_id, rag_enabled, run_index and METRICS of each session row (SESSION), and the columns to keep."""
    events, hints = F.coalesce("events", F.array().cast(sessions.schema["events"].dataType)), F.coalesce("success_hints", F.array().cast("array<string>"))
    runs = F.filter(events, lambda e: e["type"] == EXEC)
    n, bad = F.size(runs), F.size(F.filter(runs, lambda e: ~F.coalesce(e["ok"], F.lit(False))))
    scene = [F.coalesce(F.col(f"final_scene.{c}"), F.lit(0)) for c in ("objects", "meshes", "materials", "material_nodes", "lights")]
    total = scene[0] + scene[1] + scene[2] + scene[3] + scene[4]
    return sessions.select(
        "task_id", "rag_enabled", "run_index", *(keep or []),
        F.when(n > 0, bad / n).otherwise(0.0).alias("error_rate"), ((n > 0) & (bad == 0)).alias("clean_run"), query_before_call_rate(events).alias("query_before_call_rate"),
        F.aggregate(runs, F.lit(0), lambda a, e: a + F.size(lint(F.coalesce(e["code"], F.lit(""))))).alias("gotcha_hits"), task_signal_rate(events, hints).alias("task_signal_rate"),
        total.alias("scene_total"), F.coalesce("completed", F.lit(False)).alias("completed"), n.alias("code_executions"), bad.alias("code_errors"),
        F.size(F.filter(events, lambda e: e["type"] == QUERY)).alias("rag_queries"), F.size(events).alias("iterations"),
    )


def summaries(metrics: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, metric, n, mean, median, min, max, stdev (of the population): one row for each metric."""
    wide = metrics.select(*keys, *[F.col(v).cast("double").alias(v) for v in values])
    long = wide.unpivot(keys, values, "metric", "value")
    return long.groupBy(*keys, "metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.median("value").alias("median"), F.min("value").alias("min"), F.max("value").alias("max"), F.stddev_pop("value").alias("stdev"))


def pooled_error_rate(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """All errors over all runs of code, 0 without any."""
    return metrics.groupBy(*keys).agg((F.when(F.sum("code_executions") > 0, F.sum("code_errors") / F.sum("code_executions")).otherwise(0.0)).alias("pooled_error_rate"))


def deltas(summary: DataFrame, key: str = "task_id", flag: str = "rag_enabled") -> DataFrame:
    """key, metric, delta: the mean with the flag less the mean without; no rows where one side is missing."""
    on = F.max(F.when(F.col(flag), F.col("mean")))
    off = F.max(F.when(~F.col(flag), F.col("mean")))
    return summary.groupBy(key, "metric").agg((on - off).alias("delta")).filter("delta is not null")


def verdicts(delta: DataFrame, key: str = "task_id") -> DataFrame:
    """key, good, bad, helped: how many key metrics got better and worse; a tie did not help."""
    better = F.lit(0)
    for metric in KEY_METRICS:
        better = F.when((F.col("metric") == metric) & (F.abs("delta") >= 1e-9), F.signum("delta") * DIRECTION[metric]).otherwise(better)
    own = delta.filter(F.col("metric").isin(KEY_METRICS)).withColumn("b", better)
    return own.groupBy(key).agg(F.count_if(F.col("b") > 0).alias("good"), F.count_if(F.col("b") < 0).alias("bad")).withColumn("helped", F.col("good") > F.col("bad"))
