import math
import zlib
from collections import Counter, defaultdict

import xxhash

from kvloom.llm import sharding as S

MASK = (1 << 64) - 1


def ticket(key, shard, weight=1.0):
    """As the plan has it: the hash of the key's text seeds that of the shard's four bytes."""
    h = xxhash.xxh64(key.encode(), seed=42).intdigest()
    h = xxhash.xxh64(shard.to_bytes(4, "little", signed=True), seed=h).intdigest()
    return -math.log(((h >> 11) + 0.5) * 2.0**-53) / weight


def brute(key, tree):
    """Descends by the smallest draw of each node."""
    draw = lambda node, leaf: min(ticket(key, s, w) for s, w in leaf(node))
    region = min(tree.values(), key=lambda racks: draw(racks, lambda n: [x for k in n.values() for x in k.items()]))
    rack = min(region.values(), key=lambda shards: draw(shards, lambda n: n.items()))
    return min(rack, key=lambda s: ticket(key, s, rack[s]))


def test_matches_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    tree, grown = S.even_tree(40), S.with_shard(S.even_tree(40), 40)
    slots = defaultdict(list)
    for r, text in ((r, r.text) for r in S.shard_documents(docs).join(docs.select("doc_id", "text"), "doc_id").collect()):
        assert r.size == len(text.encode()) + 16 and r.text_crc32 == zlib.crc32(text.encode()) and r.law == "key"
        assert r.shard == brute(str(r.doc_id), tree) and r.grown_shard == brute(str(r.doc_id), grown)
        assert r.grown_shard in (r.shard, 40)
        slots[r.shard].append(r.slot)
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())


def test_shares_follow_weights_and_moves_stay_in_the_changed_subtree(spark):
    tree = {"a": {"x": {0: 1.0, 1: 3.0}}, "b": {"y": {2: 2.0}, "z": {3: 2.0}}}
    heavier = {"a": {"x": {0: 1.0, 1: 3.0}}, "b": {"y": {2: 2.0}, "z": {3: 6.0}}}
    keys = spark.range(20000).withColumnRenamed("id", "k")
    rows = S.assign(S.assign(keys, "k", tree, "old"), "k", heavier, "new").collect()
    share = Counter(r.old for r in rows)
    assert all(abs(share[s] / 20000 - w / 8) < 0.015 for s, w in ((0, 1), (1, 3), (2, 2), (3, 2)))
    assert all(r.new == r.old or r.new == 3 for r in rows)
    assert abs(sum(r.new == 3 for r in rows) / 20000 - 0.5) < 0.015


def test_edges(spark, docs_of, monkeypatch):
    monkeypatch.setattr(S, "PART_ROWS", 3)
    rows = S.shard_documents(docs_of(["", None, "x", "x", "x"], [1, 2, 3, 3, None])).collect()
    by_id = defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append(r)
    assert by_id[1][0].size == 16 and by_id[1][0].text_crc32 == 0
    assert by_id[2][0].size == 16 and by_id[2][0].text_crc32 is None
    assert by_id[3][0].shard == by_id[3][1].shard and by_id[3][0].slot != by_id[3][1].slot
    assert by_id[None][0].shard is not None
    assert S.shard_documents(docs_of([])).count() == 0
