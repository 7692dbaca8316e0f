"""Tables that cut lineage, written to the shared checkpoint folder and read back; names and row identity.

Rows have no key of their own that can be relied on: doc_ids may repeat or be null.  `marked` names a
row by its doc_id (the largest bigint for a null one) and the hash of its text, so rows are told apart
unless they repeat both; those are treated alike.
"""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NO_ID = (1 << 63) - 1
#: The temporary folder of each application that names none.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir when the session names one; without it a temporary folder, but only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = _LOCAL.setdefault(spark.sparkContext.applicationId, "") or f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
        _LOCAL[spark.sparkContext.applicationId] = named
    return f"{named.rstrip('/')}/lodestone-{spark.sparkContext.applicationId}"


class Tables:
    """The tables of one computation; `drop` deletes those that nothing reads any more."""

    def __init__(self):
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def table(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Write df as Parquet to the shared folder, in a folder for each value of `by`, and return the reread table."""
        spark = df.sparkSession
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of this computation; call it only when all that derives from them is written."""
        for df in tables:
            kept, path = self.paths.pop(id(df))
            hadoop = kept.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(kept.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def table(df: DataFrame, name: str) -> DataFrame:
    """One table that stays."""
    return Tables().table(df, name)


def few(df: DataFrame, limit: int) -> list | None:
    """The rows of df if there are at most `limit`, else None; never collects more than limit + 1."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def fresh(name: str, taken: list[str]) -> str:
    """A column name that is not taken, upper and lower case alike."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def marked(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> id, mark, text: id and mark name a row; id orders rows, null ones last."""
    return docs.select(identity(F.col("doc_id")).alias("id"), mark(F.col("text")).alias("mark"), F.col("text").cast("string").alias("text"))


def identity(doc_id):
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID))


def mark(text):
    return F.xxhash64(text.cast("string"))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows that gone (id, mark) names; all columns stay."""
    a, b = fresh("id", docs.columns), fresh("mark", docs.columns)
    named = docs.withColumn(a, identity(F.col("doc_id"))).withColumn(b, mark(F.col("text")))
    return named.join(gone.select(F.col("id").alias(a), F.col("mark").alias(b)).distinct(), [a, b], "left_anti").select(*docs.columns)
