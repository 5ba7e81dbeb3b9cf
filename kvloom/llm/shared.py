"""What several operators need: checkpoints in the shared folder and grouping."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster names its shared folder in spark.checkpoint.dir; only a local session without one, as in tests, gets its own."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="kvloom-checkpoints-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    context.setCheckpointDir(named)


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Writes the rows to the shared folder and reads them from there, so a lost executor costs nothing before this point."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def written(df: DataFrame) -> DataFrame:
    """As ``checkpoint``, but as Parquet, for rows of which later steps read some columns only."""
    path = stage_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Queries made inside give their shuffle files up when they end, as what later steps read of them is in checkpoints."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of the edges: the smallest node that it is connected with.

    Alternating large and small stars, in which every node points its neighbours to the smallest one it
    knows, until nothing changes; a logarithmic number of rounds. Each round is written to the
    shared folder and the one before goes; nothing but a count and a sum of hashes comes to the driver. Null ends are left out.
    """
    spark = edges.sparkSession
    folder = stage_folder(spark)

    def kept(df: DataFrame, number: int) -> DataFrame:
        df.write.parquet(f"{folder}/{number}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{number}")

    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    number = 0
    now = kept(edges, number)
    before = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = kept(small.union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct(), number + 1)
        remove_folder(spark, f"{folder}/{number}")
        number += 1
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def only_marked(df: DataFrame, key: str, ids: DataFrame, values: int = 1 << 20) -> DataFrame:
    """Fewer rows of df, with all of those whose key is in ids (a column ``id``).

    Ids are told by a hash of at most ``values`` values, so what is broadcast is bounded; the more
    ids there are, the less is left out.
    """
    mark = lambda c: F.pmod(F.xxhash64(c), F.lit(values))
    marks = ids.select(mark("id").alias("__mark")).distinct()
    return df.join(F.broadcast(marks), mark(key) == F.col("__mark"), "left_semi")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before each as it takes to be no column of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def remove_folder(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def stage_folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which the driver and all executors share.

    It stays, as what is returned is read from it later; it goes when the session's driver ends.
    """
    ensure_checkpoint_dir(spark)
    context = spark.sparkContext
    path = f"{context._jsc.sc().getCheckpointDir().get()}/stages-{uuid.uuid4().hex}"
    jvm = context._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path
