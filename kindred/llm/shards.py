"""Shards of near-equal bytes by Karmarkar-Karp differencing.

Documents with equal texts are a group that stays together; a group's size is the sum of its documents' sizes. Groups are dealt
into blocks of about BLOCK by a hash of the text. In a block every group starts as a partial partition (its size and nothing
else); the two partial partitions with the largest spread are combined again and again, the largest part of one with the
smallest of the other, until one is left. Blocks form a tree. A group belongs to the lowest level at which a part of a block
holds MARGIN times its size in groups that aren't larger (sizes are told by half powers of two); so of the sizes between two
powers of two, a block above the leaves takes 2 * MARGIN * BLOCK * shards groups on average at most. The tree is gone through from the top: what a block's parts differ by is cut into equal shares, and each
block below starts with its share as one more partial partition, which names the parts. So a large group is evened out by small
ones all over the tree. Last, FILL * BLOCK of the leaves' groups that have waited even out what the leaves' parts differ by in sum.
No task holds more than that, and only counts and one partition reach the driver.

The law is `bytes`. A group that is larger than a shard's fair part makes its shard that large. Slots number a shard's rows
from 0, in an order fixed by hashes of key and text; they come from counts of hash buckets, so no shard is numbered by one task.

A null text counts as an empty one. Ties of sizes go by a hash of the text, ties of slots by key. Very long texts are sizes like
others. Rows that repeat keep a slot each. An empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import frugal, materialize, prepare

BLOCK = 1024
#: Blocks' worth of groups that wait for the end; how often a group's size must go into a part of its block.
FILL, MARGIN = 16, 4
#: Rows that a hash bucket of slots holds on average.
BUCKET = 2000


def combine(parts: np.ndarray) -> np.ndarray:
    """Karmarkar-Karp: for rows of part sizes (ascending or not), the shard of each part so that the shards' sums are near equal."""
    n, k = parts.shape
    order = np.argsort(parts, axis=1, kind="stable")
    # A partial partition is its k sums, ascending, and for each the (row, part) lists under it, as a tree.
    sums = {i: [int(parts[i, j]) for j in order[i]] for i in range(n)}
    trees: dict[int, list] = {i: [[(i, int(j))] for j in order[i]] for i in range(n)}
    heap = [(sums[i][0] - sums[i][-1], i) for i in range(n)]
    heapq.heapify(heap)
    new = n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        sa, sb, ta, tb = sums.pop(a), sums.pop(b), trees.pop(a), trees.pop(b)
        joined = sorted(((x + y, i) for i, (x, y) in enumerate(zip(sa, reversed(sb), strict=True))), key=lambda t: t[0])
        sums[new] = [s for s, _ in joined]
        trees[new] = [(ta[i], tb[k - 1 - i]) for _, i in joined]
        heapq.heappush(heap, (sums[new][0] - sums[new][-1], new))
        new += 1
    shard = np.zeros((n, k), np.int32)
    for s, tree in enumerate(trees[heap[0][1]] if heap else []):
        stack = [tree]
        while stack:
            t = stack.pop()
            if isinstance(t, tuple):
                stack += t
            else:
                for i, j in t:
                    shard[i, j] = s
    return shard


@frugal
def _block(table: pa.Table) -> pa.Table:
    """The groups of one block and the partition that it starts with, if any (no text): each group's part, and on a row of its own what the parts hold."""
    table = table.sort_by([("text_key", "ascending")])
    parts = table.column("sums").combine_chunks().flatten().to_numpy().reshape(len(table), -1)
    # Equal parts of a start are taken in an order of the block's own, else all blocks would favour the same parts.
    order = np.random.default_rng(table.column("block")[0].as_py()).permutation(parts.shape[1])
    to = np.empty(parts.shape, np.int32)
    to[:, order] = combine(parts[:, order])
    held = np.zeros(parts.shape[1], np.int64)
    np.add.at(held, to.ravel(), parts.ravel())
    groups = table.column("text_key").is_valid().to_numpy()
    label = np.arange(len(held))
    for k in np.flatnonzero(~groups):  # its parts keep their numbers
        label[to[k]] = np.arange(len(held))
    ordered = np.empty_like(held)
    ordered[label] = held
    keys, n = table.column("text_key").filter(pa.array(groups)).to_pylist(), int(groups.sum())
    return pa.table({"text_key": pa.array([*keys, None], pa.binary()), "block": pa.array([table.column("block")[0].as_py()] * (n + 1)), "part": pa.array([*label[to[groups, -1]].tolist(), None], pa.int32()), "sums": pa.array([None] * n + [ordered.tolist()], pa.list_(pa.int64()))})


def placed(groups: DataFrame, shards: int) -> DataFrame:
    """(text_key, part) for groups (text_key, bytes)."""
    groups = groups.withColumn("bucket", F.floor(F.log2("bytes") * 2).cast("int"))
    sizes = sorted(groups.groupBy("bucket").agg(F.count("*"), F.sum("bytes")).collect())  # two buckets for each power of two
    n = sum(r[1] for r in sizes)
    levels = [max(1, -(-n // BLOCK))]
    while levels[-1] > 1:
        levels.append(-(-levels[-1] // BLOCK))
    last = len(levels) - 1
    level = F.lit(last)
    for k in reversed(range(last)):
        held, most = 0, -1
        for bucket, _, own in sizes:
            held += own
            if held >= 2 ** ((bucket + 1) / 2) * levels[k] * shards * MARGIN:
                most = bucket
        level = F.when(F.col("bucket") <= most, k).otherwise(level)
    groups = groups.withColumn("level", level)
    if last:
        small = groups.where("level = 0").count()
        waits = F.pmod(F.xxhash64("text_key", F.lit(1)), F.lit(1 << 30)) < (FILL * BLOCK << 30) // max(1, small)
        groups = groups.withColumn("level", F.when((F.col("level") == 0) & waits, -1).otherwise(F.col("level")))
    sums = F.concat(F.array_repeat(F.lit(0).cast("long"), shards - 1), F.array("bytes"))
    groups = groups.select("text_key", "bytes", sums.alias("sums"), "level")
    null = F.lit(None).cast("binary").alias("text_key")
    run = lambda rows: materialize(rows.groupBy("block").applyInArrow(_block, "text_key binary, block long, part int, sums array<long>"), "level")
    found = told = None
    for k in reversed(range(len(levels))):
        rows = groups.where(F.col("level") == k).select("text_key", F.pmod(F.xxhash64("text_key"), F.lit(levels[k])).alias("block"), "sums")
        if told is not None:
            # Block b of this level lies below block b modulo the number of blocks above; a share is what the parts hold beyond the least.
            above, b = levels[k + 1], F.col("block")
            below = F.ceil((F.lit(levels[k]) - b) / above)
            own = told.select(b, F.transform("sums", lambda x: x - F.array_min("sums")).alias("more"), F.explode(F.sequence(F.lit(0).cast("long"), below - 1)).alias("child"), below.alias("below"))
            share = F.transform("more", lambda x: F.floor(x / F.col("below")) + (F.col("child") < F.pmod(x, F.col("below"))).cast("long"))
            rows = rows.unionByName(own.select(null, (b + F.col("child") * above).alias("block"), share.alias("sums")))
        done = run(rows)
        new = done.where("text_key is not null").select("text_key", "part")
        found, told = new if found is None else found.unionByName(new), done.where("text_key is null").select("block", "sums")
    if last:
        held = dict(groups.join(found, "text_key").groupBy("part").agg(F.sum("bytes")).collect())  # one number a shard
        start = groups.sparkSession.createDataFrame([(None, 0, [held.get(j, 0) for j in range(shards)])], "text_key binary, block long, sums array<long>")
        late = groups.where("level = -1").select("text_key", F.lit(0).cast("long").alias("block"), "sums")
        found = found.unionByName(run(start.unionByName(late)).where("text_key is not null").select("text_key", "part"))
    return found


def byte_shards(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 16) -> DataFrame:
    """A row for each document: key, size, text_crc32, law, shard, slot, grown_shard (null: the law is `bytes`)."""
    prepare(docs.sparkSession)
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(whole.cast("binary"), 256)).alias("text_key"))
    rows = materialize(rows, "rows")
    groups = materialize(rows.groupBy("text_key").agg(F.sum("size").alias("bytes")), "groups")
    out = rows.join(placed(groups, shards).withColumnRenamed("part", "shard"), "text_key")
    out = out.withColumn("order", F.xxhash64("key", "text_key")).drop("text_key")
    total = rows.count()
    buckets = max(1, -(-total // (BUCKET * shards)))
    out = out.withColumn("bucket", F.pmod(F.col("order"), F.lit(buckets)))
    out = materialize(out, "placed")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = out.groupBy("shard", "bucket").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("shard", "bucket").orderBy("order", "key")
    numbered = out.withColumn("at", F.row_number().over(within)).join(offsets, ["shard", "bucket"])
    return numbered.select(F.col("key").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("at") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
