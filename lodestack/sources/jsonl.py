"""JSON Lines with the line number of the first bad row, and a whole-table rewrite that may read what it replaces."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_jsonl(df: DataFrame, path: str, single: bool = False, **metrics: Column) -> int | dict:
    """Write one JSON object a line (nulls included) and return the number of rows; with metrics (aggregates by name), a dict
    of them and `rows`. They are taken while the rows are written, in the same job."""
    seen = Observation()
    rows = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in metrics.items()])
    (rows.coalesce(1) if single else rows).write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return seen.get if metrics else seen.get["rows"]


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, required: list[str] | None = None, name: str = "row") -> DataFrame:
    """Rows of a JSON Lines file; blank lines are skipped. The first row that is no object of the schema, or lacks a required
    field, raises ValueError with its file and line. Line numbers are counted only if there is a bad row."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    wide = T.StructType([*kind.fields, T.StructField("_bad", T.StringType())])
    parsed = lines.filter(F.trim("value") != "").withColumn("row", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    wrong = F.col("row").isNull() | F.col("row._bad").isNotNull()
    for field in required or []:
        wrong = wrong | F.col(f"row.{field}").isNull()
    bad = parsed.filter(wrong).orderBy("at").select("file", "at").first()
    if bad is not None:
        before = lines.filter((F.col("file") == bad["file"]) & (F.col("at") <= bad["at"])).count()
        raise ValueError(f"{bad['file'].rsplit('/', 1)[-1]}:{before}: invalid {name} row")
    return parsed.select("row.*").drop("_bad")


def rewrite(df: DataFrame, path: str) -> None:
    """Replace the Parquet table at path by df, which may read it: written beside it, then swapped by renaming."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, old = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}", f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
    df.write.parquet(new)
    place = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = place(path).getFileSystem(conf)
    if fs.exists(place(path)):
        fs.rename(place(path), place(old))
    fs.rename(place(new), place(path))
    fs.delete(place(old), True)
