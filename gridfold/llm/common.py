"""Helpers shared by the corpus operators: scratch tables, text columns, partition counts."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of our own only in local mode where none is set (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="gridfold-"))
    return sc.getCheckpointDir()


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps, which go when the JVM collects
    what refers to them; a driver with much memory may else keep them for hours."""
    gc.collect()
    spark._jvm.System.gc()


class Scratch:
    """Parquet tables in the shared checkpoint folder that cut lineage.

    A lost executor then costs a reread of a written table, never a recomputation from the
    start. `drop` frees a table that no later result reads; the rest go as the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        release(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


#: Rows of one key that meet in a task at most, or the share 1 / MANY of all rows if that is more.
GROUP, MANY = 10_000, 50_000


def spread_join(big: DataFrame, small: DataFrame, key: list[str], counts: DataFrame, total: int) -> DataFrame:
    """The inner join on `key`, unique in `small`, with frequent keys dealt over several groups.

    `counts` (key, _n) holds at least the rows of `big` for each frequent key. At most MANY keys
    are frequent, so every task may know them; a frequent key's row of `small` is repeated once
    a group.
    """
    most = max(GROUP, total // MANY)
    often = F.broadcast(counts.where(F.col("_n") > most).select(*key, F.ceil(F.col("_n") / most).cast("int").alias("_groups")))
    one = F.coalesce("_groups", F.lit(1))
    big = big.join(often, key, "left").withColumn("_group", F.pmod(F.xxhash64(*big.columns), one).cast("int")).drop("_groups")
    small = small.join(often, key, "left").withColumn("_group", F.explode(F.sequence(F.lit(0), one - 1))).drop("_groups")
    return big.join(small, [*key, "_group"]).drop("_group")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of `df` has, made from `names`."""
    taken, out = {c.lower() for c in df.columns}, []
    for x in names:
        while x.lower() in taken:
            x += "_"
        out.append(x)
    return out


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def whole_text(df: DataFrame, col: str = "text") -> Column:
    return F.coalesce(df[col].cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
