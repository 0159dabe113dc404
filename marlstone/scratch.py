"""Tables written to the folder that driver and executors share, to cut lineage.

The folder is the session's ``spark.checkpoint.dir``. Only where that is unset, as in
tests on one machine, a temporary folder is made and set. A written table survives lost
executors and is read like any other input.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder named by the session."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir is unset; on {master} a folder of this machine can't take its place")
        path = "file://" + tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


class Scratch:
    """A folder of intermediate tables of one query run."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/marlstone/{label}-{uuid.uuid4().hex}"
        self.written = 0

    def table(self, name: str, df: DataFrame) -> DataFrame:
        """Write ``df`` and return the table read back, with the same schema. A name may be used again; its earlier tables stay.

        Nothing reads the shuffles behind a written table any more. Spark deletes their files, and the broadcasts, only when the
        driver's heap is collected, which a large heap puts off until long after the query; so it is asked for here.
        """
        self.written += 1
        path = f"{self.path}/{name}/{self.written}"
        df.write.option("compression", "zstd").parquet(path)
        self.spark._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Delete the tables of a name, or the folder; DataFrames that read from it can't be used afterwards."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_all(spark: SparkSession) -> None:
    """Delete the intermediate tables of all runs under this session's shared folder."""
    run = Scratch(spark, "none")
    run.path = f"{shared_dir(spark)}/marlstone"
    run.drop()
