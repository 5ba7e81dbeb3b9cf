"""Entries as text and keyspaces as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = ("string", "list", "set", "zset", "hash")
ENTRY = "type string, str string, list array<string>, members array<string>, hash map<string,string>, scores map<string,double>"


def dump(entries: DataFrame) -> DataFrame:
    """key and payload: the type's number, a colon and the value as JSON."""
    number = F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("type")) - 1
    body = F.to_json(F.struct("str", "list", "members", "hash", "scores"))
    return entries.select("key", F.concat(number.cast("string"), F.lit(":"), body).alias("payload"))


def restore(payloads: DataFrame) -> DataFrame:
    """What ``dump`` wrote, as entries; a payload of no known type is refused."""
    at = F.instr("payload", ":")
    number = F.substring("payload", F.lit(1), at - 1).try_cast("int")
    kind = F.get(F.array(*[F.lit(t) for t in TYPES]), number)
    schema = ENTRY.split(", ", 1)[1]
    body = F.from_json(F.substring("payload", at + 1, F.length("payload")), schema)
    return payloads.select("key", kind.alias("type"), body.alias("b")).where("type is not null").select("key", "type", "b.*")


def save(keyspace: DataFrame, path: str, slots: int = 64) -> None:
    """A snapshot: Parquet, in folders by part of the slot range if the rows have a slot, so that readers of slots skip the others."""
    if "slot" in keyspace.columns:
        part = F.floor(F.col("slot") * slots / 16384).cast("int")
        keyspace.withColumn("part", part).repartition("part").write.mode("overwrite").partitionBy("part").parquet(path)
    else:
        keyspace.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_tiers(keyspace: DataFrame, path: str) -> None:
    """Rows with a tier, in a folder for each."""
    keyspace.write.mode("overwrite").partitionBy("tier").parquet(path)


def read_commands(spark: SparkSession, path: str, form: str = "json") -> DataFrame:
    """A command log from JSON lines or Parquet."""
    schema = "key string, op string, args array<string>, us long, seq long"
    return spark.read.schema(schema).format(form).load(path)


def save_cluster_state(slots: DataFrame, path: str) -> None:
    """slots (slot, owner, epoch, state) as one JSON object; a cluster has 16,384 of them at most."""
    slots.agg(F.lit(1).cast("long").alias("version"), F.sort_array(F.collect_list(F.struct("slot", "owner", "epoch", "state"))).alias("slots")).coalesce(1).write.mode("overwrite").json(path)


def cluster_state(spark: SparkSession, path: str) -> DataFrame:
    """Slots of a cluster's state file (JSON): slot, owner, epoch, state."""
    schema = "version long, slots array<struct<slot:int,owner:string,epoch:long,state:string>>"
    state = spark.read.schema(schema).option("multiLine", True).json(path)
    return state.select(F.explode("slots").alias("s")).select("s.*")
