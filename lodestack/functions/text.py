"""String expressions with the semantics that document processing needs: Unicode white space, all line ends, stable ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line ends other than \n, as a character class body and the pair \r\n.
LINE_ENDS = r"\r\n|[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def strip(c: Column) -> Column:
    """Without white space (any in Unicode) at both ends."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\A\s+", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+\z", "")


def unix_lines(c: Column) -> Column:
    """Every kind of line end as \\n."""
    return F.regexp_replace(c, LINE_ENDS, "\n")


def approx_tokens(c: Column) -> Column:
    """A quarter of the characters, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("long")


def stable_id(*parts: Column) -> Column:
    """First 16 hex digits of SHA-256 over the parts joined by U+001F; a null part counts as empty."""
    joined = F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.substring(F.sha2(joined.cast("binary"), 256), 1, 16)


def words(c: Column) -> Column:
    """Lower-case ASCII words, the tokens of search."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def markdown_title(text: Column, fallback: Column) -> Column:
    """The first level-1 heading, else the fallback with underscores as blanks and a capital on each word."""
    heading = F.regexp_extract(unix_lines(text), r"(?m)^#[^\S\n]+([^\n]+?)[^\S\n]*$", 1)
    return F.when(heading != "", strip(heading)).otherwise(F.initcap(F.replace(fallback, F.lit("_"), F.lit(" "))))


def clean_rst_inline(c: Column) -> Column:
    """Links and roles become their visible text, double backticks single ones."""
    c = F.regexp_replace(c, r"`([^`<]+?)(?U:\s)*<[^>]*>`_+", "$1")
    c = F.regexp_replace(c, r":[a-zA-Z](?U:[\w:+-])*:`([^`<]+?)(?:(?U:\s)*<[^>]*>)?`", "$1")
    return F.replace(c, F.lit("``"), F.lit("`"))


def clean_tags(c: Column) -> Column:
    """`<a><b>` as `a b`."""
    return F.array_join(F.filter(F.split(F.regexp_replace(c, r"^[<>]+|[<>]+$", ""), "><"), lambda t: t != ""), " ")


def context_prompt(document: Column, chunk: Column, most: int = 6000) -> Column:
    """The question for a sentence that places a chunk in its document (the first `most` characters of it)."""
    # Fixed value: the wording of the prompt.
    template = "<document>\n%s\n</document>\n\nHere is a chunk taken from the document above:\n<chunk>\n%s\n</chunk>\n\nWrite ONE short sentence that situates this chunk within the document to improve\nsearch retrieval. Answer with only the sentence, no preamble."
    return F.format_string(template, F.substring(document, 1, most), chunk)


def embed_text(context: Column, text: Column) -> Column:
    """Context and text, for encoding; the text alone without a context."""
    has = F.coalesce(context, F.lit("")) != ""
    return F.when(has, strip(F.concat(context, F.lit("\n\n"), text))).otherwise(text)


def year_of(c: Column) -> Column:
    """The first four characters as a year, 0 if they are not digits."""
    return F.when(F.substring(c, 1, 4).rlike(r"^\d{4}$"), F.substring(c, 1, 4).cast("int")).otherwise(0)


def feed_year(c: Column) -> Column:
    """The first word of four digits, 0 without one."""
    found = F.regexp_extract(c, r"(?:^|\s)(\d{4})(?=\s|$)", 1)
    return F.when(found != "", found.cast("int")).otherwise(0)


def answer_status(year: Column) -> Column:
    return F.when(year >= 2024, "current").when(year >= 2021, "dated_valid").otherwise("stale")


def post_status(year: Column) -> Column:
    return F.when(year >= 2024, "current").otherwise("dated_valid")


def license_of_year(year: Column) -> Column:
    return F.when(year >= 2018, "cc-by-sa-4.0").otherwise("cc-by-sa-3.0")


def error_type(c: Column) -> Column:
    """The first word that ends in Error, else RuntimeError."""
    found = F.regexp_extract(c, r"(?U)\b(\w*Error)\b", 1)
    return F.when(found != "", found).otherwise("RuntimeError")


def exec_outcome(flag: Column, text: Column) -> Column:
    """struct(ok, error_type, error_message) of the output of a code run."""
    failed = F.coalesce(flag, F.lit(False)) | F.contains(text, F.lit("Traceback")) | F.contains(text, F.lit("Error:"))
    return F.struct((~failed).alias("ok"), F.when(failed, error_type(text)).alias("error_type"), F.when(failed, F.substring(text, 1, 500)).alias("error_message"))


def snapshot(c: Column) -> Column:
    """Counts of a scene from tolerant JSON: struct(objects, meshes, materials, material_nodes, lights), zeros for bad JSON."""
    data = F.from_json(c, "object_count int, materials_count int, material_count int, objects array<struct<type:string>>")
    things = F.coalesce(data["objects"], F.array().cast("array<struct<type:string>>"))
    of = lambda kind: F.size(F.filter(things, lambda o: o["type"] == kind))
    return F.struct(
        F.coalesce(data["object_count"], F.size(things)).alias("objects"), of("MESH").alias("meshes"),
        F.coalesce(data["materials_count"], data["material_count"], F.lit(0)).alias("materials"), F.lit(0).alias("material_nodes"), of("LIGHT").alias("lights"),
    )


def web_base(repo: Column, path: str) -> Column:
    """The address of a repository's files, from its clone address."""
    return F.concat(F.regexp_replace(repo, r"\.git$", ""), F.lit("/" + path.strip("/")))
