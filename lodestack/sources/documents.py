"""Readers that turn file trees, feeds and dumps into documents. Paths go through Spark, so any filesystem will do."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain, takewhile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions.html import each_text, html_text
from lodestack.functions.text import answer_status, clean_rst_inline, clean_tags, feed_year, license_of_year, markdown_title, post_status, stable_id, strip, year_of
from lodestack.sources.records import tagged

SOURCE_TYPES = ("manual", "api", "release_notes", "dev_docs", "code", "blendermcp", "gotchas", "stackexchange", "dev_blog")
EXTRA = {
    "path": "string", "file": "string", "topic": "string", "symbol": "string", "kind": "string", "section": "string", "line": "int", "addon": "string", "tier": "string",
    "license": "string", "version_status": "string", "source_date": "string", "score": "int", "author": "string", "question_id": "string", "tags": "string",
}
COLUMNS = ["id", "text", "source_type", "source_url", "title", "version", "extra"]
# Files and folders of a source tree that are no part of its library.
SKIP_FILES, SKIP_PARTS = ["conftest.py", "setup.py"], [".git", "__pycache__", "lib", "libs", "test", "tests", "vendor", "vendored"]


def documents(rows: DataFrame, source_type: str, url: Column, title: Column, text: Column, version: Column | str = "", **extra: Column) -> DataFrame:
    """Rows as documents; the id depends on source type, address and title, not on the text."""
    if source_type not in SOURCE_TYPES:
        raise ValueError(f"unknown source type {source_type}")
    version = F.lit(version) if isinstance(version, str) else version
    fields = [(extra.get(k, F.lit(None))).cast(t).alias(k) for k, t in EXTRA.items()]
    made = rows.select(text.alias("text"), F.lit(source_type).alias("source_type"), url.alias("source_url"), title.alias("title"), version.alias("version"), F.struct(*fields).alias("extra"))
    return made.withColumn("id", stable_id(F.col("source_type"), F.col("source_url"), F.col("title"))).select(*COLUMNS)


def files(spark: SparkSession, root: str, pattern: str = "*.md", deep: bool = False) -> DataFrame:
    """file, rel, stem, text of whole text files below root; a missing root gives none."""
    read = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", deep)
    try:
        rows = read.load(root)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], "file string, rel string, stem string, text string")
    place = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    base = re.sub(r"^[a-z][a-z0-9+.-]*:/*", "/", root).rstrip("/") + "/"
    rel = F.element_at(F.split(place, re.escape(base)), -1)
    name = F.element_at(F.split(rel, "/"), -1)
    return rows.select(place.alias("file"), rel.alias("rel"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.col("value").alias("text"))


def release_notes(spark: SparkSession, roots: dict[str, str], base_url: str, label: str = "Release Notes", product: str = "") -> DataFrame:
    """One level of Markdown for each version: roots maps versions to folders. Titles, which ids depend on, begin with the product's name where one is given."""
    parts = []
    for version, root in roots.items():
        rows = files(spark, root).withColumn("text", strip(F.col("text"))).filter("text <> ''")
        url = F.when(F.col("stem") == "index", F.lit(f"{base_url}/{version}/")).otherwise(F.concat(F.lit(f"{base_url}/{version}/"), F.col("stem"), F.lit("/")))
        title = F.concat(F.lit(f"{product} {version} {label} — ".lstrip()), markdown_title(F.col("text"), F.col("stem")))
        parts.append(documents(rows, "release_notes", url, title, F.col("text"), version, topic=F.col("stem")))
    return reduce(DataFrame.unionByName, parts)


def handbook(spark: SparkSession, root: str, base_url: str, least: int = 120, version: str = "") -> DataFrame:
    """Markdown at any depth; short pages are left out."""
    rows = files(spark, root, deep=True).withColumn("text", strip(F.col("text"))).filter(F.length("text") >= least)
    rel = F.regexp_replace("rel", r"\.md$", "")
    return documents(rows, "dev_docs", F.concat(F.lit(f"{base_url}/"), rel, F.lit("/")), markdown_title(F.col("text"), F.col("stem")), F.col("text"), version, path=F.col("rel"))


def curated(spark: SparkSession, root: str, web_root: str, version: str = "5.1") -> DataFrame:
    rows = files(spark, root).withColumn("text", strip(F.col("text"))).filter("text <> ''")
    return documents(rows, "gotchas", F.concat(F.lit(f"{web_root}/"), F.col("stem"), F.lit(".md")), markdown_title(F.col("text"), F.col("stem")), F.col("text"), version, file=F.concat(F.col("stem"), F.lit(".md")))


def manual(spark: SparkSession, root: str, base_url: str, least: int = 120, version: str = "") -> DataFrame:
    """RST at any depth, as Markdown; short pages (after conversion) are left out."""
    rows = files(spark, root, "*.rst", deep=True).withColumn("text", strip(rst_markdown("text"))).filter(F.length("text") >= least)
    rel = F.regexp_replace("rel", r"\.rst$", "")
    return documents(rows, "manual", F.concat(F.lit(f"{base_url}/"), rel, F.lit(".html")), markdown_title(F.col("text"), F.col("stem")), F.col("text"), version, path=F.col("rel"))


def python_tree(spark: SparkSession, root: str, web_base: str, source_type: str = "code", version: str = "", name: str | None = None, license_id: str | None = None, status: str = "current") -> DataFrame:
    """Python files at any depth; with a name, a third-party add-on without its tests, packaging and vendored code."""
    rows = files(spark, root, "*.py", deep=True).filter(F.col("text").rlike(r"(?U)\S"))
    url = F.concat(F.lit(web_base.rstrip("/") + "/"), F.col("rel"))
    if name is None:
        return documents(rows, source_type, url, F.col("rel"), F.col("text"), version, path=F.col("rel"))
    file = F.concat(F.col("stem"), F.lit(".py"))
    rows = rows.filter(~file.isin(*SKIP_FILES) & ~F.col("stem").startswith("test_") & ~F.arrays_overlap(F.split("rel", "/"), F.array(*[F.lit(p) for p in SKIP_PARTS])))
    return documents(rows, source_type, url, F.concat(F.lit(f"{name}/"), F.col("rel")), F.col("text"), version, tier=F.lit("creative"), addon=F.lit(name), license=F.lit(license_id), version_status=F.lit(status), path=F.col("rel"))


def _current(toml: str | None, floor: tuple[int, int], key: str) -> bool:
    try:
        least = tomllib.loads(toml or "").get(key)
        parts = [int(x) for x in least.split(".")[:2]] if isinstance(least, str) else []
    except ValueError:  # bad TOML is one, too
        return False
    return bool(parts) and (parts[0], parts[1] if len(parts) > 1 else 0) >= floor


def is_current_manifest(toml: str | Column, floor: tuple[int, int] = (4, 2), key: str = "blender_version_min") -> Column:
    """The manifest names a least version of at least `floor`."""

    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _current(t, floor, key))

    return run(toml)


def find_manifest(manifests: DataFrame, by: str = "addon") -> DataFrame:
    """The shallowest manifest of each add-on, then the first by path (by, rel, text)."""
    depth = F.size(F.split("rel", "/"))
    return manifests.groupBy(by).agg(F.min_by(F.struct("rel", "text"), F.struct(depth, F.col("rel"))).alias("m")).select(by, "m.rel", "m.text")


def vetted_addons(spark: SparkSession, addons: list[tuple[str, str, str, str]], manifest: str, floor: tuple[int, int] = (4, 2)) -> DataFrame:
    """Documents of listed add-ons (name, repository, license, local folder): MIT ones, and others with a current manifest."""
    parts = []
    for name, repo, license_id, root in addons:
        web = re.sub(r"\.git$", "", repo) + "/blob/HEAD" if repo else name
        if license_id != "mit":
            found = find_manifest(files(spark, root, manifest, deep=True).withColumn("addon", F.lit(name)))
            if found.filter(is_current_manifest("text", floor)).isEmpty():
                continue
        parts.append(python_tree(spark, root, web, name=name, license_id=license_id))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "id string, text string, source_type string, source_url string, title string, version string, extra struct<" + ",".join(f"{k}:{t}" for k, t in EXTRA.items()) + ">")


def answers(posts: DataFrame, url_base: str, default_title: str, least_score: int = 3, since: int = 2019, in_order: bool = False) -> DataFrame:
    """Answers of a question-and-answer dump with the titles of their questions.

    posts: Id, PostTypeId, ParentId, Score, OwnerUserId, CreationDate, Body, Title, Tags (strings) and, for in_order, pos. A
    missing or empty title falls back to default_title, which also enters the id. Of questions with one id the last counts;
    in_order sees only questions that stand before the answer (pos must tell posts apart, as that of posts_xml() does)."""
    asked = posts.filter("PostTypeId = '1'")
    order = F.col("pos") if "pos" in posts.columns else F.lit(0)
    given = posts.filter("PostTypeId = '2'").withColumn("score", F.coalesce(F.expr("try_cast(coalesce(Score, '0') as int)"), F.lit(0))).withColumn("year", year_of(F.coalesce("CreationDate", F.lit(""))))
    given = given.filter((F.col("score") >= least_score) & (F.col("year") >= since)).withColumn("body", html_text("Body", "\n")).filter("body <> ''")
    questions = asked.select(F.col("Id").alias("q_id"), order.alias("q_pos"), F.struct(F.coalesce("Title", F.lit("")).alias("title"), clean_tags(F.coalesce("Tags", F.lit(""))).alias("tags")).alias("q"))
    if in_order:
        # Bodies stay out of the join that looks for the latest question before an answer, and out of its shuffles.
        near = given.select("pos", "ParentId").join(questions, (F.col("ParentId") == F.col("q_id")) & (F.col("q_pos") < F.col("pos"))).groupBy("pos").agg(F.max_by("q", "q_pos").alias("q"))
        joined = given.join(near, "pos", "left")
    else:
        joined = given.join(questions.groupBy("q_id").agg(F.max_by("q", "q_pos").alias("q")), F.col("ParentId") == F.col("q_id"), "left")
    title = F.when(F.coalesce(F.col("q.title"), F.lit("")) != "", F.col("q.title")).otherwise(F.lit(default_title))
    return documents(
        joined, "stackexchange", F.concat(F.lit(f"{url_base}/"), F.coalesce("Id", F.lit(""))), title, F.concat(F.lit("Q: "), title, F.lit("\n\nA:\n"), F.col("body")),
        tier=F.lit("creative"), version_status=answer_status(F.col("year")), source_date=F.substring("CreationDate", 1, 10), score=F.col("score"),
        author=F.coalesce("OwnerUserId", F.lit("")), question_id=F.coalesce("ParentId", F.lit("")), tags=F.coalesce("q.tags", F.lit("")), license=license_of_year(F.col("year")),
    )


POST = ["Id", "PostTypeId", "ParentId", "Score", "OwnerUserId", "CreationDate", "Body", "Title", "Tags"]


def posts_xml(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a Posts.xml dump (or a folder of its parts) with their place pos in it; large files are split."""
    return tagged(spark, path, "row", POST)


def feed_items(spark: SparkSession, path: str) -> DataFrame:
    """title, link, pub, html of the items of an RSS feed."""
    rows = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, pubDate string, `content:encoded` string, description string").load(path)
    return rows.select(F.trim("title").alias("title"), F.trim("link").alias("link"), F.trim("pubDate").alias("pub"), F.coalesce(F.nullif(F.col("content:encoded"), F.lit("")), F.col("description"), F.lit("")).alias("html"))


def blog_posts(items: DataFrame, default_url: str, rest: bool = False) -> DataFrame:
    """Posts (title, link, pub, html) as documents; those without title or body are left out. rest: pub is an ISO date."""
    rows = items.withColumn("title", strip(F.coalesce("title", F.lit("")))).withColumn("body", html_text("html", "\n")).filter("title <> '' AND body <> ''")
    pub = F.coalesce("pub", F.lit(""))
    year = year_of(pub) if rest else feed_year(pub)
    url = F.when(F.coalesce("link", F.lit("")) != "", F.col("link")).otherwise(F.lit(default_url))
    return documents(rows, "dev_blog", url, F.col("title"), F.concat(F.col("title"), F.lit("\n\n"), F.col("body")), tier=F.lit("technical"), version_status=post_status(year), source_date=F.substring(pub, 1, 10 if rest else 16), license=F.lit("cc-by-sa-4.0"))


def rest_posts(spark: SparkSession, path: str) -> DataFrame:
    """title, link, pub, html of saved pages of a blog's REST archive."""
    rows = spark.read.option("multiLine", True).schema("title struct<rendered:string>, link string, date string, content struct<rendered:string>").json(path)
    return rows.select(F.col("title.rendered").alias("title"), "link", F.col("date").alias("pub"), F.coalesce("content.rendered", F.lit("")).alias("html"))


def paged(fetch: Callable[[int, int], tuple[int, list[dict]]], per_page: int = 100, most: int = 50) -> Iterator[list[dict]]:
    """Pages of an injected fetcher (page, per_page) -> (status, rows), until one fails, is empty or is short.

    A failure of the first page raises."""
    pages = (fetch(page, per_page) for page in range(1, most + 1))
    status, rows = next(pages, (200, []))
    if status != 200:
        raise RuntimeError(f"the first page gave status {status}")
    for status, rows in takewhile(lambda got: got[0] == 200 and got[1], chain([(status, rows)], pages)):
        yield rows
        if len(rows) < per_page:
            break


def combined(parts: list[DataFrame]) -> DataFrame:
    """All sources, in the order given."""
    return reduce(DataFrame.unionByName, parts)


# RST ------------------------------------------------------------------------------------------------------------------

# Characters of heading rules, directives that go with their blocks, and those that become a bold label.
RULE_CHARS = "#*=-^\"~+`:.'_"
DROPPED = ["figure", "image", "include", "index", "only", "raw", "toctree"]
LABELLED = ["admonition", "hint", "important", "note", "seealso", "tip", "warning"]

#: The grammar: kinds of blocks in order of precedence, each with the form of what it takes from the start of a line on.
#: Horizontal space is [^\\S\\n]; a block goes on with blank lines and lines that are further indented than its first.
_H = r"[^\S\n]*"
_RULE = rf"{_H}([{re.escape(RULE_CHARS)}])\%d{{2,}}{_H}"
_GRAMMAR = [(kind, re.compile(form, re.MULTILINE)) for kind, form in (
    ("overlined", rf"{_RULE % 1}\n(?={_H}\S)(?P<title>.*)\n{_H}\1{{3,}}{_H}$"),
    ("underlined", rf"(?!{_RULE % 1}$)(?={_H}\S)(?P<title>.*)\n(?P<rule>{_RULE % 4})$"),
    ("dropped", rf"({_H})\.\.[^\S\n]+(?:{'|'.join(DROPPED)})::.*(?:\n(?:{_H}$|\1[^\S\n].*))*"),
    ("labelled", rf"{_H}\.\.[^\S\n]+(?P<name>(?i:{'|'.join(LABELLED)}))::(?P<title>.*)"),
    ("directive", rf"{_H}\.\.[^\S\n]+[a-zA-Z-]+::.*"),
    ("option", r"[^\S\n]+:[\w-]+:.*"),
    ("comment", rf"{_H}\.\.(?:[^\S\n].*)?$"),
    ("text", r".*"),
)]


def _blocks(text: str) -> Iterator[tuple[str, re.Match]]:
    """The blocks of an RST text in order."""
    at = 0
    while at <= len(text):
        for kind, form in _GRAMMAR:
            found = form.match(text, at)
            # A rule shorter than the line above it is no heading.
            if found and not (kind == "underlined" and len(found["rule"].strip()) < len(found["title"].strip())):
                break
        yield kind, found
        at = found.end() + 1


def _rendered(text: str) -> str:
    """RST as Markdown but for links and roles, which stay as they are. A heading's level is the turn of its rule character."""
    levels: dict[str, int] = {}
    out = []
    for kind, found in _blocks(text):
        if kind in ("overlined", "underlined"):
            char = found[1] if kind == "overlined" else found["rule"].strip()[0]
            out.append("#" * min(6, levels.setdefault(char, len(levels) + 1)) + " " + found["title"].strip())
        elif kind == "labelled":
            out.append(f"**{found['name'].capitalize()}:** {found['title'].strip()}".rstrip())
        elif kind == "text":
            out.append(found[0])
    return "\n".join(out)


def rst_markdown(text: Column | str) -> Column:
    """RST as Markdown: headings by rule character, noisy directives dropped with their blocks, admonitions as bold labels,
    links and roles as their visible text (line by line)."""
    return F.array_join(F.transform(F.split(each_text(lambda t: None if t is None else _rendered(t), text), "\n"), clean_rst_inline), "\n")
