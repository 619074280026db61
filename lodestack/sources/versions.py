"""A Parquet table that is replaced as a whole: versions beside each other, and a pointer that moves in one step.

Version 0 is the table at the folder itself. Later ones stand in hidden folders below it, and a file of their number, which is
created once and never changed, names the folder; the greatest number is the present version. So a reader finds a whole table at
any moment, a writer that dies leaves only a folder that nothing names, and of two writers one gets the number."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

POINTERS = "_versions"


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _numbers(spark: SparkSession, root: str) -> list[int]:
    fs, folder = _place(spark, f"{root}/{POINTERS}")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(folder)) if fs.exists(folder) else []


def _folder(spark: SparkSession, root: str, number: int) -> str:
    fs, pointer = _place(spark, f"{root}/{POINTERS}/{number}")
    found = fs.open(pointer)
    try:
        return bytes(found.readAllBytes()).decode()
    finally:
        found.close()


def current(spark: SparkSession, root: str) -> int:
    """The number of the present version."""
    return max(_numbers(spark, root), default=0)


def read(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """The present version, or the one of that number."""
    root = root.rstrip("/")
    number = current(spark, root) if number is None else number
    return spark.read.parquet(f"{root}/{_folder(spark, root, number)}" if number else root)


def publish(df: DataFrame, root: str, after: int | None = None) -> int:
    """Write df, which may read the table, as the version behind `after` (the present one when called); returns its number.

    Raises FileExistsError if another writer has published since."""
    spark, root = df.sparkSession, root.rstrip("/")
    number = (current(spark, root) if after is None else after) + 1
    folder = f"_v{number}-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{folder}")
    # Created beside, then renamed onto a name that must not exist: an unfinished pointer is never seen.
    fs, pointer = _place(spark, f"{root}/{POINTERS}/{number}")
    _, draft = _place(spark, f"{root}/_draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(folder.encode()))
    out.close()
    fs.mkdirs(pointer.getParent())
    if fs.exists(pointer) or not fs.rename(draft, pointer) or _folder(spark, root, number) != folder:
        for path in (draft, _place(spark, f"{root}/{folder}")[1]):
            fs.delete(path, True)
        raise FileExistsError(f"version {number} of {root} was published by another writer")
    return number


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Delete the folders of all but the last `keep` versions, and of writers that died; returns how many. Version 0 and the
    pointers stay. No writer may be at work."""
    root = root.rstrip("/")
    live = {_folder(spark, root, n) for n in _numbers(spark, root)[-keep:]}
    fs, folder = _place(spark, root)
    gone = [f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith(("_v", "_draft-")) and f.getPath().getName() not in live | {POINTERS}]
    for path in gone:
        fs.delete(path, True)
    return len(gone)
