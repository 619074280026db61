"""The sources of a corpus by name, each read from what its section of the settings says."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.config import Settings
from lodestack.functions import html
from lodestack.sources import documents as sources

Loader = Callable[[SparkSession, Settings, str], DataFrame]

#: Sources that a corpus is built from, and those that are only gathered; in the order in which they are read.
CORPUS: dict[str, Loader] = {}
CREATIVE: dict[str, Loader] = {}


def source(name: str, registry: dict[str, Loader] = CORPUS) -> Callable[[Loader], Loader]:
    """Register a loader (spark, settings, folder) under the name of its section."""

    def keep(load: Loader) -> Loader:
        registry[name] = load
        return load

    return keep


def _option(settings: Settings, name: str, key: str, default=""):
    return settings.section("sources", name, key, default=default)


def read(spark: SparkSession, settings: Settings, names: Iterable[str] | None = None, registry: dict[str, Loader] = CORPUS) -> DataFrame:
    """Documents of the named sources (all that the settings have a section for, if none are named), one after another."""
    wanted = list(names) if names is not None else [n for n in registry if settings.section("sources", n) is not None]
    unknown = [n for n in wanted if n not in registry]
    if unknown:
        raise ValueError(f"unknown sources {unknown}; there are {list(registry)}")
    if not wanted:
        raise ValueError("the settings name no source")
    place = lambda n: str(settings.folder / _option(settings, n, "dir", n))
    return reduce(DataFrame.unionByName, [registry[n](spark, settings, place(n)) for n in wanted])


def _version(settings: Settings) -> str:
    return str(settings.section("version", default=""))


@source("release_notes")
def _release_notes(spark, settings, root):
    versions = [str(v) for v in _option(settings, "release_notes", "versions", [_version(settings)])]
    return sources.release_notes(spark, {v: f"{root}/{v}" for v in versions}, _option(settings, "release_notes", "base_url"), product=_option(settings, "release_notes", "product"))


@source("api")
def _api(spark, settings, root):
    """Symbols of all HTML pages below the folder."""
    spark.udtf.register("lodestack_api_symbols", html.ApiSymbols)
    name = f"lodestack_pages_{abs(hash(root))}"
    sources.files(spark, root, "*.html", deep=True).createOrReplaceTempView(name)
    rows = spark.sql(f"SELECT rel, s.* FROM {name}, LATERAL lodestack_api_symbols(text, rel) s")
    url = F.concat(F.lit(_option(settings, "api", "base_url") + "/"), F.col("anchor"))
    return sources.documents(rows, "api", url, F.col("title"), F.col("text"), _version(settings), symbol=F.col("symbol"), kind=F.col("kind"), file=F.col("rel"))


@source("manual")
def _manual(spark, settings, root):
    return sources.manual(spark, root, _option(settings, "manual", "base_url"), version=_version(settings))


@source("dev_docs")
def _dev_docs(spark, settings, root):
    return sources.handbook(spark, root, _option(settings, "dev_docs", "base_url"), version=_version(settings))


@source("code")
def _code(spark, settings, root):
    return sources.python_tree(spark, root, _option(settings, "code", "base_url"), version=_version(settings))


@source("blendermcp")
def _bridge(spark, settings, root):
    """Every Python file of the add-on that an agent drives the program through."""
    return sources.python_tree(spark, root, _option(settings, "blendermcp", "base_url"), "blendermcp", _version(settings))


@source("gotchas")
def _gotchas(spark, settings, root):
    return sources.curated(spark, root, _option(settings, "gotchas", "base_url"), version=_version(settings))


@source("stackexchange", CREATIVE)
def _answers(spark, settings, root):
    """Answers in the order of the dump, each with the question that stands before it."""
    own = lambda key, default: _option(settings, "stackexchange", key, default)
    dump = own("posts_xml", None) or (f"{root}/Posts.xml" if own("dir", None) else None)
    if not dump:
        raise RuntimeError("sources.stackexchange.posts_xml is not set; it names an extracted Posts.xml")
    dump = dump if "://" in dump else str(settings.folder / dump)
    return sources.answers(sources.posts_xml(spark, dump), own("base_url", ""), own("default_title", "Answer"), int(own("min_score", 3)), int(own("since_year", 2019)), in_order=True)


@source("dev_blog", CREATIVE)
def _blog(spark, settings, root):
    rest = _option(settings, "dev_blog", "mode", "archive") == "archive"
    rows = sources.rest_posts(spark, f"{root}/*.json") if rest else sources.feed_items(spark, f"{root}/*.xml")
    return sources.blog_posts(rows, _option(settings, "dev_blog", "base_url"), rest)


@source("addons", CREATIVE)
def _addons(spark, settings, root):
    listed = [(a["name"], a.get("repo", ""), a.get("license", ""), f"{root}/{a['name']}") for a in _option(settings, "addons", "list", [])]
    return sources.vetted_addons(spark, listed, _option(settings, "addons", "manifest", "manifest.toml"))
