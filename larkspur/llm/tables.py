"""Reading inputs, and cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of our own only where it is unset and all tasks run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-larkspur-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: survives lost executors, and cuts the lineage."""
    path = f"{shared_dir(df.sparkSession)}/larkspur-{name}-{uuid.uuid4().hex}"
    _left[path] = df.sparkSession
    df.write.option("compression", "zstd").parquet(path)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Folders that this process has written and that are still there.
_left: dict[str, SparkSession] = {}


def close() -> None:
    """Deletes every table that operators have left behind; frames that read them can't be used any more."""
    for path, spark in list(_left.items()):
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        spark.sql(f"DROP TABLE IF EXISTS `{folder.getName()}`")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        del _left[path]


def drop(*frames: DataFrame) -> None:
    """Deletes ``written`` or ``bucketed`` tables that nothing reads any more, with their catalog entries."""
    for df in frames:
        files = df.inputFiles()
        if files:
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            if not folder.getName().startswith("larkspur"):
                raise ValueError(f"{folder.toString()} is not a table of ours")
            spark.sql(f"DROP TABLE IF EXISTS `{folder.getName()}`")
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
            for path in [p for p in _left if p.endswith("/" + folder.getName())]:
                del _left[path]


def bucketed(df: DataFrame, name: str, n: int, key: str) -> DataFrame:
    """Like ``written``, with the rows in ``n`` buckets of the key: joins and groups by it then don't move them again."""
    spark, unique = df.sparkSession, f"larkspur_{name}_{uuid.uuid4().hex}"
    _left[f"{shared_dir(spark)}/{unique}"] = spark
    df.repartition(n, key).write.bucketBy(n, key).option("compression", "zstd").option("path", f"{shared_dir(spark)}/{unique}").saveAsTable(unique)
    release(spark)
    return spark.table(unique)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of finished jobs now: it acts when the driver has collected its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def buckets_for(df: DataFrame, column: str, bytes_each: int) -> int:
    """Number of shuffle buckets so that each gets about ``bytes_each`` bytes of ``column``: it grows with the input.

    There are at least as many as shuffle partitions: Spark shuffles a table of fewer buckets again for a join.
    """
    total = df.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // bytes_each))


def nested(docs: DataFrame, text: str = "text") -> DataFrame:
    """(rest, text): all other columns as one struct, so that what an operator adds can't have their names."""
    return docs.select(F.struct(*(c for c in docs.columns if c != text)).alias("rest"), F.col(text).alias("text"))


def unnested(df: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """The columns that ``nested`` has put away, in their order."""
    return df.select(*(F.col("text").alias(c) if c == text else F.col("rest").getField(c).alias(c) for c in columns))


def free(name: str, taken: list[str]) -> str:
    """A column's name that isn't taken."""
    while name in taken:
        name += "_"
    return name
