"""What the corpus operators share: the checkpoint folder, cut lineage, and word rules."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space; bytes.split() splits on the same set.
WORD = r"[^\x20\x09-\x0D]+"


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for intermediate data: what the cluster names in spark.checkpoint.dir,
    or the context's own. Only a local session, whose executors are its own threads, gets a
    temporary one; on a cluster others would not see it, so there this raises."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root:
        return root
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Compute df once into the checkpoint folder, which survives lost executors."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def n_words(text: Column) -> Column:
    """The number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def free(df: DataFrame, name: str) -> str:
    """A column name like this one that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def write(df: DataFrame) -> tuple[DataFrame, str]:
    """df computed once as a table in the shared folder, and where it is. In loops this is better
    than cut(): what is read again has the table's size, while a checkpoint keeps the estimate of
    the plan behind it, which joins multiply round by round."""
    path = f"{checkpoint_root(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that is no longer read."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
