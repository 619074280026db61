"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, names and units become typed placeholders, so that a question with other numbers or names has the same template; line
breaks, blanks and punctuation are nothing in it. A name is a word of one capital and small letters, wherever it stands. As a
text in capitals shows no names, an item is also read without them, so that it is found in any case; an item's readings are
judged apart. Windows of template words of every document meet those of the benchmark in a hash join; a document is contaminated
by an item when it holds enough of the windows of a reading, and, for readings with placeholders, when some alignment fills the
slots consistently: within its matched windows, one value of the item never stands for two values of the document, and where
values differ from the item's there are at least as many plain words as placeholders, so that a row of names or numbers is
evidence only if it is the item's own. Two values may fall together in the document. Alignments that alone meet the coverage
are judged; if none does, all of the pair's are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.sift import sieve

from .common import matched, staged

# Placeholders are private-use characters, which no letter class holds.
NUMBER, UNIT, NAME = "", "", ""
# Units of measure that may follow a number.
UNITS = [
    "mm", "cm", "m", "km", "in", "inch", "inches", "ft", "feet", "foot", "yd", "yards", "mi", "mile", "miles", "g", "kg", "mg", "lb", "lbs", "oz", "ton", "tons",
    "l", "ml", "liter", "liters", "litre", "litres", "gallon", "gallons", "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hr", "hour", "hours",
    "day", "days", "week", "weeks", "month", "months", "year", "years", "mph", "kmh", "percent", "dollar", "dollars", "euro", "euros", "cent", "cents", "degree", "degrees",
]
_NUM = r"\d(?:[\d.,]*\d)?"
_NUM_UNIT = rf"({_NUM})(?:\s{{1,4}}|-)?((?i:{'|'.join(sorted(UNITS, key=lambda u: -len(u)))}))(?![\p{{L}}\p{{N}}])"
#: A whole word of one capital and small letters.
_NAME = rf"(?<![\p{{L}}\p{{N}}{NUMBER}{UNIT}{NAME}])\p{{Lu}}\p{{Ll}}+(?![\p{{L}}\p{{N}}])"
_SPLIT = rf"[^\p{{L}}{NUMBER}{UNIT}{NAME}]+"


def _bare(text: Column) -> Column:
    """The text with blanks for characters that would pass for placeholders."""
    return F.translate(text, NUMBER + UNIT + NAME, "   ")


def template(text: Column, names: bool = True) -> Column:
    """The words of the text's template; without names, those are words like any other."""
    plain = F.regexp_replace(_bare(text), _NUM_UNIT, f" {NUMBER} {UNIT} ")
    plain = F.regexp_replace(plain, _NAME, f" {NAME} ") if names else plain
    return F.filter(F.split(F.lower(F.regexp_replace(plain, _NUM, f" {NUMBER} ")), _SPLIT), lambda w: w != "")


def slots(text: Column, names: bool = True) -> Column:
    """Template words with the value after the placeholder, one to one with template()."""
    plain = F.regexp_replace(_bare(text), _NUM_UNIT, f" {NUMBER}$1 {UNIT}$2 ")
    plain = F.regexp_replace(plain, _NAME, f" {NAME}$0 ") if names else plain
    plain = F.regexp_replace(plain, rf"(?<![\d{NUMBER}.,]){_NUM}", f" {NUMBER}$0 ")
    return F.filter(F.split(F.lower(plain), rf"(?:(?![{NUMBER}{UNIT}{NAME}\d.,])[^\p{{L}}])+|[.,]+(?!\d)|(?<!\d)[.,]+"), lambda w: w != "")


def _window(words: Column, at: Column, size: Column | int) -> Column:
    """Hash of the run of `size` word hashes that begins at place `at` (from 0)."""
    return F.xxhash64(F.slice(words, at + 1, size))


def _hashed(text: Column, names: bool = True) -> Column:
    return F.transform(template(text, names), lambda w: F.xxhash64(w))


def _is_mark(word: Column) -> Column:
    return F.substring(word, 1, 1).isin(NUMBER, UNIT, NAME)


def _places(words: Column, size: Column | int, whole: Column | bool) -> Column:
    """Where windows of `size` words begin; whole: only a text of exactly so many words has one."""
    size, whole = F.lit(size) if isinstance(size, int) else size, F.lit(whole) if isinstance(whole, bool) else whole
    there = F.when(whole, F.size(words) == size).otherwise(F.size(words) >= size)
    return F.when(there, F.sequence(F.lit(0), F.size(words) - size)).otherwise(F.array().cast("array<int>"))


def _row_key(row_id: str, text: str) -> Column:
    """A row's own name, never null: rows share it if they are alike in id and text."""
    return F.concat(F.coalesce(F.concat(F.lit("="), F.col(row_id).cast("string")), F.lit("-")), F.lit(":"), F.md5(F.col(text).cast("binary")))


def contaminated(
    docs: DataFrame, items: DataFrame, size: int = 8, coverage: float = 0.3, least: int = 4, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", broadcast_rows: int = 200_000,
) -> DataFrame:
    """Pairs (doc_id, item_id, n_windows, n_item_windows, coverage, n_slots) of documents and the items that they hold.

    size: words of a window; an item with fewer template words is one window of its own length. least: an item with fewer
    template words than this is no passage, and is found only in a document whose whole template is the item's, names as they
    are. coverage: least share of the distinct windows of one of the item's readings (the one that is met best is reported). broadcast_rows: up to so many windows of the benchmark are broadcast, and a
    document drops its other windows before any becomes a row; beyond, both sides are shuffled by window. Documents are read
    once, and whole.

    Nulls: a null or empty text, on either side, matches nothing; a null id is kept as a value. Rows of one id (or without
    one) and different texts are judged apart; of a pair of ids the verdict with the largest coverage is reported, and
    repeated rows give their pairs once. An item without letters and numbers has no window. Characters of a text that would
    pass for placeholders count as blanks. Columns besides id and text are not read. Empty tables give no rows."""
    own = items.filter(F.col(text).isNotNull()).select(F.col(item_id).alias("item"), _row_key(item_id, text).alias("ik"), F.col(text).alias("item_text")).dropDuplicates(["ik"])
    read = [F.struct(F.lit(names).alias("names"), _hashed(F.col("item_text"), names).alias("w"), slots(F.col("item_text"), names).alias("i")) for names in (False, True)]
    own = own.select("item", "ik", F.explode(F.array(*read)).alias("r"))
    own = own.select("item", F.concat("ik", F.when(F.col("r.names"), "n").otherwise("-")).alias("ik"), "r.names", "r.w", "r.i").filter(F.size("w") > 0)
    # Names make a reading of their own where there are any; short items have none.
    own = own.filter(~F.col("names") | (F.size("w") >= least) & F.exists("i", lambda x: F.substring(x, 1, 1) == NAME))
    own = staged(own.withColumn("len", F.least(F.lit(size), F.size("w"))), "bench-items")
    index = own.select("ik", "len", "w", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("len"))).alias("item_pos"))
    index = staged(index.select("ik", "len", "item_pos", _window(F.col("w"), F.col("item_pos"), F.col("len")).alias("h")), "bench-windows")
    lengths = sorted(r[0] for r in index.select("len").distinct().collect())  # at most `size` values
    if not lengths:
        return docs.sparkSession.createDataFrame([], f"{doc_id} {docs.schema[doc_id].dataType.simpleString()}, {item_id} {items.schema[item_id].dataType.simpleString()}, n_windows long, n_item_windows long, coverage double, n_slots long")
    held = sieve(index, index.count(), "h", broadcast_rows)
    few = held is not None
    words = docs.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc"), _row_key(doc_id, text).alias("dk"), _hashed(F.col(text)).alias("w"), F.col(text).alias("t"))
    if lengths[0] < least:  # texts as short as such items are read without names
        words = words.withColumn("w", F.when(F.size("w") < least, _hashed(F.col("t"), False)).otherwise(F.col("w")))
    words = words.drop("t")

    def probes(n: int) -> Column:
        places = _places(F.col("w"), n, n < least)
        if few:
            places = F.filter(places, lambda i: held(_window(F.col("w"), i, n)))
        return F.transform(places, lambda i: F.struct(F.lit(n).alias("len"), i.alias("pos"), _window(F.col("w"), i, n).alias("h")))

    # The outer form keeps the optimizer from testing the array in a filter, which would compute it twice.
    hits = words.select("doc", "dk", F.explode_outer(F.concat(*[probes(n) for n in lengths])).alias("x")).filter(F.col("x").isNotNull()).select("doc", "dk", "x.*")
    met = hits.join(F.broadcast(index) if few else index, ["len", "h"]).select("doc", "dk", "ik", (F.col("pos") - F.col("item_pos")).alias("shift"), "item_pos", "len", "h")
    # A shift is an alignment of document and item; its windows are made distinct before anything meets by key.
    met = staged(met.distinct(), "bench-met")
    total = index.groupBy("ik").agg(F.countDistinct("h").alias("n_item_windows"))
    total = F.broadcast(total) if few else total
    found = met.groupBy("dk", "ik").agg(F.countDistinct("h").alias("n_windows"), F.first("doc").alias("doc")).join(total, "ik").withColumn("coverage", F.col("n_windows") / F.col("n_item_windows")).filter(F.col("coverage") >= coverage)
    found = staged(found, "bench-found")
    marked = own.filter(F.exists("i", _is_mark)).select("ik", "i")
    slotted = staged(found.join(marked.select("ik"), "ik", "left_semi").select("dk", "ik"), "bench-slotted")
    out = found.withColumn("n_slots", F.lit(0).cast("long"))
    if not slotted.isEmpty():
        shifts = met.join(slotted, ["dk", "ik"], "left_semi").groupBy("dk", "ik", "shift").agg(F.size(F.collect_set("h")).alias("n"), F.collect_set(F.struct("item_pos", "len")).alias("held"))
        shifts = shifts.join(total, "ik").withColumn("enough", F.col("n") / F.col("n_item_windows") >= coverage)
        tries = shifts.groupBy("dk", "ik").agg(F.collect_list(F.struct("shift", "n", "held", "enough")).alias("t"))
        judged = F.when(F.exists("t", lambda x: x["enough"]), F.filter("t", lambda x: x["enough"])).otherwise(F.col("t"))
        tries = staged(tries.select("dk", "ik", judged.alias("t")), "bench-tries")
        texts = docs.filter(F.col(text).isNotNull()).select(_row_key(doc_id, text).alias("dk"), F.col(text).alias("doc_text"))
        texts = matched(texts, tries.select("dk").distinct(), "dk", "left_semi").dropDuplicates(["dk"])
        sides = tries.join(texts, "dk").join(marked, "ik")
        sides = sides.select("dk", "ik", slots(F.col("doc_text")).alias("d"), "i", F.explode("t").alias("t"))
        pairs = sides.select("dk", "ik", "t.shift", "t.held", "d", F.posexplode("i").alias("at", "want"))
        inside = F.exists("held", lambda x: (x["item_pos"] <= F.col("at")) & (F.col("at") < x["item_pos"] + x["len"]))
        pairs = pairs.filter(inside).withColumn("got", F.get("d", F.col("at") + F.col("shift")))
        plain = pairs.groupBy("dk", "ik", "shift").agg(F.count_if(~_is_mark(F.col("want"))).alias("plain"))
        pairs = pairs.filter(_is_mark(F.col("want"))).filter(F.substring("got", 1, 1) == F.substring("want", 1, 1))
        values = pairs.groupBy("dk", "ik", "shift", "want").agg((F.min("got") != F.max("got")).alias("torn"), F.max(F.col("got") != F.col("want")).alias("other"), F.count("*").alias("n_slots"))
        filled = values.groupBy("dk", "ik", "shift").agg(F.max("torn").alias("torn"), F.max("other").alias("other"), F.sum("n_slots").alias("n_slots"))
        filled = filled.join(plain, ["dk", "ik", "shift"]).withColumn("torn", F.col("torn") | F.col("other") & (F.col("plain") < F.col("n_slots")))
        each = tries.select("dk", "ik", F.explode("t").alias("t")).select("dk", "ik", "t.shift", "t.n").join(filled, ["dk", "ik", "shift"], "left")
        whole = ~F.coalesce("torn", F.lit(False))
        verdict = each.groupBy("dk", "ik").agg(F.max(whole).alias("whole"), F.max_by(F.coalesce("n_slots", F.lit(0)), F.struct(whole, "n", -F.col("shift"))).alias("n_slots_held"))
        out = found.join(verdict, ["dk", "ik"], "left").filter(F.coalesce("whole", F.lit(True))).select(*found.columns, F.coalesce("n_slots_held", F.lit(0)).cast("long").alias("n_slots"))
    named = out.join(own.select("ik", "item"), "ik")
    best = named.groupBy("doc", "item").agg(F.max(F.struct("coverage", "n_windows", "n_item_windows", "n_slots", "dk")).alias("x"))
    return best.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "x.n_windows", "x.n_item_windows", "x.coverage", "x.n_slots")


def op3_template_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it holds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def decontamination_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; the columns stay those of docs.

    Rows are judged by id and text: a row without an id, or one that shares its id with other texts, goes only if its own
    text holds an item."""
    columns = docs.columns
    named = docs.select("doc_id", "text").withColumn("row", _row_key("doc_id", "text"))
    pairs = contaminated(named.select("row", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), doc_id="row")
    gone = staged(pairs.select(F.col("row").alias("__row")).distinct(), "bench-gone")
    there = gone.count()
    if not there:
        return docs
    key = F.coalesce(_row_key("doc_id", "text"), F.lit(""))
    side = F.broadcast(gone) if there <= 1_000_000 else gone
    return docs.join(side, key == gone["__row"], "left_anti").select(*columns)
