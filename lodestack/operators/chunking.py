"""Structure-aware chunking as column expressions: sections, paragraphs, code windows. No Python runs for prose."""

from __future__ import annotations

import ast
import io
import re
import tokenize

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.functions.text import lstrip, rstrip, stable_id, strip, unix_lines

#: Kinds of document that are cut as code, and those of one symbol each.
CODE_TYPES = ("code", "blendermcp")
API_TYPES = ("api",)
_HEAD = r"(?U)^(#{1,6})[^\S\n]+"


def sections(text: Column) -> Column:
    """array<struct<path:array<string>, body:string>>: bodies under their heading trail; empty bodies are left out.

    The text is cut at heading lines; a fold over these few blocks keeps the trail. Headings in code fences count."""
    blocks = F.split(unix_lines(text), r"(?mU)^(?=#{1,6}[^\S\n])")
    kind = "struct<stack:array<struct<level:int,title:string>>,out:array<struct<path:array<string>,body:string>>>"
    start = F.struct(F.array().cast("array<struct<level:int,title:string>>").alias("stack"), F.array().cast("array<struct<path:array<string>,body:string>>").alias("out")).cast(kind)

    def step(acc: Column, block: Column) -> Column:
        marks = F.regexp_extract(block, _HEAD, 1)
        level = F.length(marks)
        title = strip(F.regexp_extract(block, r"(?U)^#{1,6}[^\S\n]+([^\n]*)", 1))
        own = F.array(F.struct(level.alias("level"), title.alias("title")))
        stack = F.when(level > 0, F.concat(F.filter(acc["stack"], lambda x: x["level"] < level), own)).otherwise(acc["stack"])
        body = strip(F.when(level > 0, F.regexp_replace(block, r"(?U)^#{1,6}[^\S\n]+[^\n]*\n?", "")).otherwise(block))
        one = F.array(F.struct(F.transform(stack, lambda x: x["title"]).alias("path"), body.alias("body")))
        return F.struct(stack.alias("stack"), F.when(body != "", F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out")).cast(kind)

    return F.aggregate(blocks, start, step, lambda acc: acc["out"])


def hard_split(text: Column, budget: Column | int) -> Column:
    """array<string>: cuts at the last blank before the budget, or at the budget where there is none."""
    b = F.lit(budget) if isinstance(budget, int) else budget
    inner = F.when(b > 1, F.concat(F.lit("|.{1,"), (b - 1).cast("string"), F.lit("}(?= )"))).otherwise("")
    pattern = F.concat(F.lit("(?s)(?U)\\s*+(.{1,"), b.cast("string"), F.lit("}\\z"), inner, F.lit("|.{"), b.cast("string"), F.lit("})"))
    return F.filter(F.transform(F.regexp_extract_all(text, pattern, F.lit(1)), rstrip), lambda x: x != "")


def pack_section(path: Column, body: Column, max_chars: int, overlap: int, least: int) -> Column:
    """array<string>: paragraphs filled up to max_chars under the trail, each chunk starting with the tail of the one before.

    A chunk may pass max_chars by the overlap and two line feeds."""
    trail = F.array_join(path, " > ")
    prefix = F.when(trail != "", F.concat(trail, F.lit("\n\n"))).otherwise("")
    budget = F.greatest(F.lit(1), F.lit(max_chars) - F.length(prefix))
    paras = F.filter(F.transform(F.split(body, r"\n(?U:\s)*\n"), strip), lambda p: p != "")
    paras = F.flatten(F.transform(paras, lambda p: F.when(F.length(p) > budget, hard_split(p, budget)).otherwise(F.array(p))))
    kind = "struct<out:array<string>,cur:string>"
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur")).cast(kind)

    def step(acc: Column, para: Column) -> Column:
        cur = acc["cur"]
        longer = F.when(cur != "", F.concat(cur, F.lit("\n\n"), para)).otherwise(para)
        over = (cur != "") & (F.length(longer) > budget)
        tail = lstrip(F.substring(cur, F.greatest(F.length(cur) - overlap + 1, F.lit(1)), F.lit(overlap))) if overlap else F.lit("")
        fresh = F.when(tail != "", F.concat(tail, F.lit("\n\n"), para)).otherwise(para)
        return F.struct(F.when(over, F.concat(acc["out"], F.array(cur))).otherwise(acc["out"]).alias("out"), F.when(over, fresh).otherwise(longer).alias("cur")).cast(kind)

    filled = F.aggregate(paras, start, step, lambda acc: F.when(strip(acc["cur"]) != "", F.concat(acc["out"], F.array(acc["cur"]))).otherwise(acc["out"]))
    chunks = F.when(F.length(body) <= budget, F.array(body)).otherwise(filled)
    return F.filter(F.transform(chunks, lambda c: F.concat(prefix, c)), lambda c: F.length(strip(c)) >= least)


def code_windows(code: Column, max_chars: int) -> Column:
    """array<string>: whole lines up to max_chars; a longer line is cut at exactly max_chars; a blank rest goes."""
    lines = F.filter(F.split(code, r"(?<=\n)|(?<=\r)(?!\n)|(?<=[\x0b\x0c\x1c-\x1e\x85\u2028\u2029])"), lambda x: x != "")
    kind = "struct<out:array<string>,cur:string>"
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur")).cast(kind)

    def step(acc: Column, line: Column) -> Column:
        full = (acc["cur"] != "") & (F.length(acc["cur"]) + F.length(line) > max_chars)
        out = F.when(full, F.concat(acc["out"], F.array(acc["cur"]))).otherwise(acc["out"])
        cur = F.when(full, line).otherwise(F.concat(acc["cur"], line))
        cuts = F.floor((F.length(cur) - 1) / max_chars).cast("int")
        pieces = F.when(cuts > 0, F.transform(F.sequence(F.lit(0), cuts - 1), lambda i: F.substring(cur, i * max_chars + 1, F.lit(max_chars)))).otherwise(F.array().cast("array<string>"))
        rest = F.substring(cur, F.greatest(cuts, F.lit(0)) * max_chars + 1, F.length(cur))
        return F.struct(F.concat(out, pieces).alias("out"), rest.alias("cur")).cast(kind)

    folded = F.aggregate(lines, start, step, lambda acc: F.when(strip(acc["cur"]) != "", F.concat(acc["out"], F.array(acc["cur"]))).otherwise(acc["out"]))
    return F.when(F.length(code) <= max_chars, F.array(code)).otherwise(folded)


_HEADER = re.compile(r"(?:async[ \t]+)?(?:def|class)[ \t]+(\w+)")


def _by_margin(source: str) -> list[tuple[str, str, int]]:
    """_top_level() of a source that does not parse: a definition reaches from its header at the margin (with decorators)
    to the next line at the margin that does not only close brackets; what is broken inside one leaves the others whole."""
    found, rest, open_ = [], [], None
    decorated: list[str] = []
    for number, line in enumerate(source.split("\n"), start=1):
        head = _HEADER.match(line)
        if head:
            open_ = (head[1], [*decorated, line], number - len(decorated))
            found.append(open_)
            decorated = []
        elif line.startswith("@"):
            decorated, open_ = [*decorated, line], None
        elif open_ and (not line.strip() or line[0] in " \t)]}"):
            open_[1].append(line)
        else:
            rest += [*decorated, line]
            decorated, open_ = [], None
    rest = [x for x in [*rest, *decorated] if x.strip()]
    return ([("<module>", "\n".join(rest), 1)] if rest else []) + [(name, "\n".join(lines).rstrip(), at) for name, lines, at in found]


def _top_level(source: str) -> list[tuple[str, str, int]]:
    """(name, code, line) of each top-level definition, and first all other top-level code as <module>."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _by_margin(source)
    lines = source.split("\n")

    def cut(node: ast.AST, line: int, col: int) -> str:
        own = lines[line - 1 : node.end_lineno]
        if not own:
            return ""
        own[-1] = own[-1].encode()[: node.end_col_offset].decode()
        own[0] = own[0].encode()[col:].decode() if len(own) > 1 or not col else own[0].encode()[col:].decode()
        return "\n".join(own)

    found, rest, spans = [], [], []
    for node in tree.body:
        deco = getattr(node, "decorator_list", [])
        line = deco[0].lineno if deco else node.lineno
        col = deco[0].col_offset - 1 if deco else node.col_offset
        spans.append((line, node.end_lineno))
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            found.append((node.name, cut(node, line, max(col, 0)), line))
        else:
            rest.append((line, cut(node, line, col)))
    try:
        for tok in tokenize.generate_tokens(io.StringIO(source).readline):
            if tok.type == tokenize.COMMENT and not any(a <= tok.start[0] <= b for a, b in spans):
                rest.append((tok.start[0], tok.string))
    except (tokenize.TokenError, IndentationError):
        pass
    rest = [text for _, text in sorted(rest, key=lambda x: x[0]) if text.strip()]
    return ([("<module>", "\n".join(rest), 1)] if rest else []) + found


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("code", T.StringType()), T.StructField("line", T.IntegerType())])))
def python_symbols(source: pd.Series) -> pd.Series:
    """Top-level definitions of Python sources; one that does not parse is cut at its margin."""
    return source.map(lambda s: [{"name": n, "code": c, "line": k} for n, c, k in _top_level(s or "")])


def _finished(rows: DataFrame) -> DataFrame:
    return rows.withColumn("id", stable_id(F.col("doc_id"), F.col("chunk_index"), F.col("text")))


def chunk_markdown(docs: DataFrame, max_chars: int = 2048, overlap: int = 256, least: int = 64) -> DataFrame:
    """doc_id, chunk_index, section, text, id of prose documents (doc_id, text)."""
    packed = F.transform(sections(F.col("text")), lambda s: F.transform(pack_section(s["path"], s["body"], max_chars, overlap, least), lambda t: F.struct(F.array_join(s["path"], " > ").alias("section"), t.alias("text"))))
    rows = docs.select("doc_id", F.posexplode(F.flatten(packed)).alias("chunk_index", "c"))
    return _finished(rows.select("doc_id", "chunk_index", F.col("c.section").alias("section"), F.col("c.text").alias("text")))


def chunk_api(docs: DataFrame, max_chars: int = 2048, overlap: int = 256) -> DataFrame:
    """One chunk for each symbol, more only where it is too long; short ones stay."""
    packed = pack_section(F.array().cast("array<string>"), F.col("text"), max_chars, overlap, 0)
    return _finished(docs.select("doc_id", F.posexplode(packed).alias("chunk_index", "text")))


def chunk_python(docs: DataFrame, max_chars: int = 6144) -> DataFrame:
    """doc_id, chunk_index, symbol, line, text, id of Python sources; windows of one symbol are numbered #part<i>."""
    parts = docs.select("doc_id", python_symbols("text").alias("s"))
    cut = F.transform("s", lambda s: F.transform(code_windows(s["code"], max_chars), lambda w, i: F.struct(s["name"].alias("name"), s["line"].alias("line"), w.alias("text"), i.alias("part"), (F.size(code_windows(s["code"], max_chars)) > 1).alias("many"))))
    rows = parts.select("doc_id", F.posexplode(F.flatten(cut)).alias("chunk_index", "c"))
    symbol = F.when(F.col("c.many"), F.concat(F.col("c.name"), F.lit("#part"), F.col("c.part").cast("string"))).otherwise(F.col("c.name"))
    return _finished(rows.select("doc_id", "chunk_index", symbol.alias("symbol"), F.col("c.line").alias("line"), F.col("c.text").alias("text")))


def chunk_corpus(docs: DataFrame, max_tokens: int = 512, overlap_tokens: int = 64, least: int = 64) -> DataFrame:
    """Chunks of all documents (doc_id, source_type, text) by kind: code, api, and prose for the rest."""
    most, overlap = max_tokens * 4, overlap_tokens * 4
    kind = F.coalesce(F.col("source_type"), F.lit(""))
    parts = [
        chunk_python(docs.filter(kind.isin(*CODE_TYPES)), most * 3),
        chunk_api(docs.filter(kind.isin(*API_TYPES)), most, overlap),
        chunk_markdown(docs.filter(~kind.isin(*CODE_TYPES, *API_TYPES)), most, overlap, least),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
