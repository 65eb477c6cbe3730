"""Session settings, shared-folder tables and small relational helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_ROWS = "2000"
ARROW_BYTES = str(4 << 20)


def prepare(spark: SparkSession) -> SparkSession:
    """Bound what one Arrow batch holds, in rows and in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir; one of our own only where driver and executors are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="larkspur-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/larkspur/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """Write a frame to the shared folder and read it back, which cuts its lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def with_row_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a 64-bit key of each row's file and place in it, the same on every read, and the key's name.

    A frame that isn't read from files is stored first. Of 10^10 rows about
    three pairs may share a key.
    """
    name = free_name(docs, "_row")
    place = F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index")).alias(name)
    try:
        return docs.select("*", place), name
    except AnalysisException:
        return stored(docs, "rows").select("*", place), name


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links between longs → (node, component): the smallest node reachable.

    Labels fall along links and then jump to their own label's label, so that
    long chains settle in a logarithmic number of rounds; each round's labels
    are checkpointed. Nulls and self-links are left out; no links give no rows.
    """
    spark = edges.sparkSession
    shared_dir(spark)
    a, b = F.col("a"), F.col("b")
    both = edges.where(a != b).select("a", "b").union(edges.where(a != b).select(b.alias("a"), a.alias("b"))).distinct()
    both = stored(both, "links")
    labels = both.groupBy(a.alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"))
    labels = labels.checkpoint()
    while True:
        seen = labels.select(F.col("node").alias("b"), F.col("label").alias("other"))
        fallen = both.join(seen, "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        lower = labels.join(fallen, "node").select("node", F.least("label", "other").alias("near"), "label")
        jump = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        step = lower.join(jump, "near", "left").select("node", F.least("near", F.coalesce("far", "near")).alias("new"), "label")
        step = step.checkpoint()
        labels = step.select("node", F.col("new").alias("label"))
        if step.where(F.col("new") != F.col("label")).limit(1).count() == 0:
            return labels.select("node", F.col("label").alias("component"))
