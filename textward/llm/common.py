"""Helpers shared by the training-data operators: staging, safe column access, words."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import spread

#: ASCII white space that separates words: space and the characters 9 to 13.
SPACES = r"[ \t-\r]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or what setCheckpointDir was given.

    A temporary folder is made only for a local master, whose executors are the driver's own; elsewhere a session
    without a shared folder is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir() or spark.conf.get("textward.shared.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="textward-")
        spark.conf.set("textward.shared.dir", found)
    return found.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system, in the JVM."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there.

    The files go when drop_staged is called, at the latest when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textward/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    p, files = hadoop_path(spark, path)
    files.deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete the files behind a staged table whose rows are no longer needed; other tables are left alone."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if re.search(r"/textward/[^/]+-[0-9a-f]{32}$", folder):
            path, files = hadoop_path(spark, folder)
            files.delete(path, True)


def on_path(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, installed or not."""
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if here not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, here])


def need(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns, matched by exact name; others (clashing in case, or repeated) are ignored."""
    on_path(df.sparkSession)
    safe = df.toDF(*[f"__c{i}" for i in range(len(df.columns))])
    return safe.select([F.col(f"__c{df.columns.index(n)}").alias(n) for n in names])


def carried(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """All columns under safe names, and those names in order; `names` keep theirs.

    An operator that hands documents on works on the safe names and ends with
    toDF(*df.columns), so extra columns of any name pass through unharmed.
    """
    on_path(df.sparkSession)
    first = {df.columns.index(n): n for n in names}
    safe = [first.get(i, f"__c{i}") for i in range(len(df.columns))]
    return df.toDF(*safe), safe


def whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Array of the words of a text; null has none."""
    return F.array_remove(F.split(whole(text), SPACES), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
