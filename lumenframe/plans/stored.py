"""Tables that cut a lineage: in the folder that driver and executors share."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of what was stored on the way.
MADE: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, on a local master only, a folder of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="lumenframe-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df, written once and read again: a plan that uses it several times does not repeat it, and a lost executor does not bring it back."""
    at = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    MADE.append(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def release(spark: SparkSession) -> None:
    """Deletes what this process has stored on the way. Results are read from it, so call this when they are written or no longer needed."""
    while MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(MADE.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
