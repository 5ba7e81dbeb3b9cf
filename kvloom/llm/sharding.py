"""Operator 1: shards by a hierarchical weighted hash tree.

The tree has regions, racks and shards with weights. A row's ticket for a shard
is -ln(u)/weight with u a hash of (key, shard), and a node's draw is the smallest
ticket below it, which is exponential with the node's weight as rate. A row
descends into the child with the smallest draw: region, then rack, then shard.
A changed weight changes draws on one path from the root only, so rows move only
into (or out of) that subtree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Region -> rack -> {shard: weight}.
Tree = dict[str, dict[str, dict[int, float]]]

#: Rows of one (shard, part) pair, which one task numbers.
PART_ROWS = 50_000
#: Bytes that a row takes besides its text.
ROW_BYTES = 16


def even_tree(shards: int, regions: int = 4, racks: int = 2) -> Tree:
    """Shards of weight 1 dealt over regions and racks."""
    tree: Tree = {f"region{r}": {f"rack{r}.{k}": {} for k in range(racks)} for r in range(regions)}
    places = [rack for region in tree.values() for rack in region.values()]
    for shard in range(shards):
        places[shard * len(places) // shards][shard] = 1.0
    return tree


def with_shard(tree: Tree, shard: int, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in its lightest rack."""
    out = {region: {rack: dict(leaves) for rack, leaves in racks.items()} for region, racks in tree.items()}
    racks = [leaves for region in out.values() for leaves in region.values()]
    min(racks, key=lambda leaves: sum(leaves.values()))[shard] = weight
    return out


def _ticket(key: Column, shard: int, weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11)
    return -F.log((bits.cast("double") + 0.5) * F.lit(2.0**-53)) / F.lit(float(weight))


def _least(nodes: list[Column]) -> Column:
    """The node that wins the draw among its siblings; of equal draws, the one with the smaller shard."""
    return F.least(*nodes) if len(nodes) > 1 else nodes[0]


def descend(key: Column, tree: Tree) -> Column:
    """The shard that a key's descent ends in.

    A node is (its draw, the shard that the descent from it reaches). The draw of a rack
    is that of its winning shard and the draw of a region that of its winning rack, so the
    descent from the root is one expression that names every ticket once.
    """
    regions = []
    for racks in tree.values():
        nodes = []
        for shards in racks.values():
            leaves = [F.struct(_ticket(key, s, w).alias("draw"), F.lit(s).alias("shard")) for s, w in shards.items() if w > 0]
            if leaves:
                nodes.append(_least(leaves))
        if nodes:
            regions.append(_least(nodes))
    if not regions:
        raise ValueError("the tree has no shard of positive weight")
    return _least(regions)["shard"].cast("int")


def assign(df: DataFrame, key: str, tree: Tree, out: str = "shard") -> DataFrame:
    """Adds the shard of each row, in a column ``out`` that replaces one of that name. A null key is as an empty one."""
    return df.withColumn(out, descend(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), tree))


def number(df: DataFrame, by: str, order: list[str], rows: int, out: str = "slot") -> DataFrame:
    """Adds gapless numbers from 0 within each value of ``by``.

    Each value's rows are dealt into parts by a hash of the ordering columns, so no task
    gets more than one part; the parts' counts give each part's first number.
    """
    parts = max(1, -(-rows // PART_ROWS))
    df = df.withColumn("__part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    own = Window.partitionBy(by, "__part")
    before = Window.partitionBy(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(by, "__part").agg(F.count(F.lit(1)).alias("__n"))
    counts = counts.select(F.col(by), "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    numbered = df.withColumn("__row", F.row_number().over(own.orderBy(*order)) - 1)
    return numbered.join(counts, [by, "__part"]).withColumn(out, (F.col("__before") + F.col("__row")).cast("long")).drop("__part", "__row", "__before")


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", tree: Tree | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row.

    ``grown_shard`` is the shard after one more has joined: the same, or the new one.
    A null text has size 16 and no CRC; an empty one the CRC 0. Rows with a null id share
    a shard, as do repeated ids; each row has its own slot. Other columns are ignored.
    """
    tree = tree or even_tree(shards)
    text = F.col(text_col).cast("string")
    rows = docs.count()
    df = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    df = assign(df, "doc_id", tree, "shard")
    df = assign(df, "doc_id", with_shard(tree, shards), "grown_shard")
    df = number(df, "shard", ["doc_id", "text_crc32", "size"], rows)
    return df.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
