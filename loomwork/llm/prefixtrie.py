"""The trie of conversations that begin alike, and what its shared beginnings save.

A node is a distinct beginning of ``depth`` turns; the root is the empty one. Its
identity is 128 bits, four sums of hashes of (place, turn) modulo 2^32, so beginnings
are prefix sums and a long conversation is worked out in blocks like any other.

What a node has of itself (members, children, smallest member) are aggregates of
(conversation, depth) rows. What it has of its subtree comes from balanced parentheses:
every leaf's path, in order, is written into the shard it falls in. A shard of at most
``SHARD_NODES`` nodes opens a parenthesis for each node, puts a pair "()" at the end of
each path, and closes; excess is kept in blocks with their least and greatest value in
a tree, by which ``find_close`` delimits a subtree. The number of leaves in it is the
rank of pairs "10", and its savings are a difference in the array of running sums.
Spines that shards share come out of each with a part, and the parts are summed; what
a node itself saves is given to one of the paths through it, so nothing counts twice.

A long path is cut into bands of ``BAND`` nodes, each a path of its own; what lies below
a band goes to the pair at its end. So no group and no row grows with a conversation.

Shuffles carry ids, hashes and numbers only, never texts. A common beginning is a key
that is only aggregated, or looked up through salts. The digest of a node's members is
one hash over their ids in order and must be computed in sequence: ids are joined in
blocks of at most ``DIGEST_IDS`` first, and one task runs over a node's blocks.

Null role and text are empty. Turns stand by number, null first, equal ones by their
content's hash; a repeated row is a turn more. Rows without a conversation id belong to
none and are left out. A conversation without turns is a member of the root. An empty
table gives no rows. Turns with one number in one conversation, if very many, are
ordered in one task. Other columns are not carried, so their names cannot clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from loomwork.operators.running import running, with_ordinal
from loomwork.session import stored

SHARD_NODES = 200_000
BAND = 4096
BLOCK = 64
DIGEST_IDS = 1024
# Turns whose places share a block of the running sums.
_TURNS = 1024
_LANES = 4


def turn_keys(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, content, bytes): a turn's place, the hash of role and text, the text's UTF-8 length."""
    who, said = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    return turns.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("bigint").alias("conv"),
        F.col(turn).cast("bigint").alias("turn"),
        F.md5(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said)).alias("content"),
        F.octet_length(said).cast("bigint").alias("bytes"),
    )


def numbered(keys: DataFrame) -> DataFrame:
    """Append ``i``, the place of the turn in its conversation from 0."""
    block = F.coalesce(F.floor(F.col("turn") / _TURNS).cast("bigint"), F.lit(-(1 << 62)))
    return with_ordinal(keys, "turn", "i", ["conv"], block, ties=["content"])


def _node(lanes: list[Column]) -> Column:
    return F.unhex(F.concat(*[F.lpad(F.hex(lane.bitwiseAND(0xFFFFFFFF)), 8, "0") for lane in lanes]))


def beginnings(keys: DataFrame, members: DataFrame) -> DataFrame:
    """(conv, depth, node, parent, bytes): a row per conversation and beginning, the root included."""
    placed = numbered(keys)
    digest = F.md5(F.concat("content", F.lit(":"), F.col("i").cast("string")))
    for k in range(_LANES):
        placed = placed.withColumn(f"h{k}", F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint"))
    sums = {f"s{k}": ("sum", F.col(f"h{k}")) for k in range(_LANES)}
    summed = running(placed, "i", sums, ["conv"], block=F.floor(F.col("i") / _TURNS).cast("bigint"))
    rows = summed.select(
        "conv",
        (F.col("i") + 1).alias("depth"),
        _node([F.col(f"s{k}") for k in range(_LANES)]).alias("node"),
        _node([F.col(f"s{k}") - F.col(f"h{k}") for k in range(_LANES)]).alias("parent"),
        "bytes",
    )
    nothing = _node([F.lit(0).cast("bigint")] * _LANES)
    root = members.select("conv", F.lit(0).cast("bigint"), nothing, F.lit(None).cast("binary"), F.lit(0).cast("bigint"))
    return rows.unionAll(root)


class Parentheses:
    """Balanced parentheses of paths in order, with the tree of blocks' least and greatest excess."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.excess = np.cumsum(2 * bits.astype(np.int64) - 1)
        blocks = -(-len(bits) // BLOCK)
        padded = np.pad(self.excess, (0, blocks * BLOCK - len(bits)), mode="edge").reshape(blocks, BLOCK)
        self.low, self.high = [padded.min(axis=1)], [padded.max(axis=1)]
        while len(self.low[-1]) > 1:
            for tree, least in ((self.low, np.minimum), (self.high, np.maximum)):
                level = np.append(tree[-1], tree[-1][-1:]) if len(tree[-1]) % 2 else tree[-1]
                tree.append(least(level[0::2], level[1::2]))
        pairs = (bits == 1) & (np.append(bits[1:], 1) == 0)
        self.pairs = np.cumsum(pairs)

    def _scan(self, at: np.ndarray, target: np.ndarray) -> np.ndarray:
        """First place from ``at`` on, in its block, with the excess ``target``, or -1."""
        found = np.full(len(at), -1, dtype=np.int64)
        stop = np.minimum((at // BLOCK + 1) * BLOCK, len(self.excess))
        active = np.flatnonzero(at < stop)
        place = at.copy()
        while len(active):
            hit = self.excess[place[active]] == target[active]
            found[active[hit]] = place[active[hit]]
            active = active[~hit]
            place[active] += 1
            active = active[place[active] < stop[active]]
        return found

    def find_close(self, opens: np.ndarray) -> np.ndarray:
        """The parenthesis that closes each opening one."""
        target = self.excess[opens] - 1
        at = opens + 1
        close = np.where(at % BLOCK != 0, self._scan(at, target), -1)
        rest = np.flatnonzero(close < 0)
        # Up the tree to the first range on the right that holds the target, and down to its block.
        node, goal = opens[rest] // BLOCK, target[rest]
        level, done = np.zeros(len(rest), dtype=np.int64), np.zeros(len(rest), dtype=bool)
        for k, (low, high) in enumerate(zip(self.low, self.high)):
            right = np.minimum(node + 1, len(low) - 1)
            hit = ~done & (node % 2 == 0) & (node + 1 < len(low)) & (low[right] <= goal) & (goal <= high[right])
            node, level = np.where(hit, right, node), np.where(hit, k, level)
            done |= hit
            node = np.where(done, node, node // 2)
        for k in range(len(self.low) - 1, 0, -1):
            here = level == k
            left = np.minimum(2 * node, len(self.low[k - 1]) - 1)
            inside = (self.low[k - 1][left] <= goal) & (goal <= self.high[k - 1][left])
            node = np.where(here, np.where(inside, left, left + 1), node)
            level = np.where(here, k - 1, level)
        close[rest] = self._scan(node * BLOCK, goal)
        return close


def shard_sums(ids: np.ndarray, lengths: np.ndarray, weights: np.ndarray, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(leaves, savings) in the subtree of each node of a shard, by node id.

    ``ids`` are the paths, one after the other, nodes numbered in order of appearance;
    ``weights`` are what each path brings to its nodes and ``tails`` to what lies below.
    """
    starts = np.cumsum(lengths) - lengths
    path = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(ids)) - starts[path]
    before = np.maximum(path - 1, 0)
    known = (path > 0) & (place < lengths[before])
    same = known & (ids == ids[np.where(known, starts[before] + place, 0)])
    shared = np.add.reduceat(same, starts, dtype=np.int64)
    ones = lengths - shared + 1
    zeros = 1 + lengths - np.append(shared[1:], 0)
    bits = np.repeat(np.tile([1, 0], len(lengths)).astype(np.int8), np.stack([ones, zeros], axis=1).ravel())
    tree = Parentheses(bits)
    opens = np.flatnonzero(bits)
    ends = np.zeros(len(opens), dtype=bool)
    ends[np.cumsum(ones) - 1] = True
    weight = np.zeros(len(opens) - len(lengths), dtype=np.int64)
    np.add.at(weight, ids, weights)
    value = np.zeros(len(bits), dtype=np.int64)
    value[opens[~ends]], value[opens[ends]] = weight, tails
    total = np.cumsum(value)
    nodes = opens[~ends]
    close = tree.find_close(nodes)
    leaves = tree.pairs[close] - tree.pairs[nodes]
    return leaves, total[close] - total[nodes] + value[nodes]


def _shards(batches):
    """From ordered paths (nodes, weights, tail) to parts (node, leaves, saved) per shard."""

    def parts(held):
        table = pa.Table.from_batches(held).combine_chunks()
        nodes, weights, tails = (table.column(i).chunk(0) for i in range(3))
        coded = nodes.flatten().dictionary_encode()
        lengths = nodes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        leaves, saved = shard_sums(
            coded.indices.to_numpy(zero_copy_only=False).astype(np.int64),
            lengths,
            weights.flatten().to_numpy(zero_copy_only=False),
            tails.to_numpy(zero_copy_only=False),
        )
        return pa.RecordBatch.from_arrays([coded.dictionary, pa.array(leaves), pa.array(saved)], names=["node", "leaves", "saved"])

    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column(0)).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            limit = (ends[at - 1] if at else 0) + SHARD_NODES - size
            stop = int(np.searchsorted(ends, limit, side="right"))
            if stop > at or not held:
                stop = max(stop, at + 1)
                held.append(batch.slice(at, stop - at))
                size += int(ends[stop - 1] - (ends[at - 1] if at else 0))
                at = stop
            if at < batch.num_rows:
                yield parts(held)
                held, size = [], 0
    if held:
        yield parts(held)


def _digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the conversations (conv, node) that end in a node."""
    blocks = ends.groupBy("node", F.floor(F.col("conv") / DIGEST_IDS).alias("block")).agg(
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string"))).alias("ids")
    )

    def run(batches):
        node, digest = None, None
        for batch in batches:
            done = []
            for now, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if now != node:
                    if node is not None:
                        done.append((node, digest.hexdigest()))
                    node, digest = now, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield _digest_batch(done)
        if node is not None:
            yield _digest_batch([(node, digest.hexdigest())])

    placed = blocks.repartition("node").sortWithinPartitions("node", "block").select("node", "ids")
    return placed.mapInArrow(run, "node binary, ends_sha256 string")


def _digest_batch(rows: list) -> pa.RecordBatch:
    nodes, digests = zip(*rows) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(digests, pa.string())], names=["node", "ends_sha256"])


def _looked_up(rows: DataFrame, values: DataFrame, key: str, by: str, salts: int) -> DataFrame:
    """Left join of ``values`` (``key`` unique there) to ``rows``, where one key may be most rows."""
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)))
    asked = salted.select(key, "__salt").distinct().join(values, key)
    return salted.join(asked, [key, "__salt"], "left").drop("__salt")


def prefix_trie(keys: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Per node of the trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``keys`` are ``turn_keys`` rows; ``members`` (conv) adds conversations without turns.
    ``saved_tokens`` sums (n_convs - 1) x bytes of the last text over the subtree.
    """
    spark = keys.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    members = keys.select("conv").distinct() if members is None else members.select("conv").distinct()
    rows = stored(beginnings(keys, members), "beginnings")
    nodes = rows.groupBy("node", "depth", "parent", "bytes").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"))
    nodes = stored(nodes, "nodes")
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(children, "node", "left"), "nodes")

    # The paths of the leaves, by their smallest member, in bands.
    band = F.expr(f"depth div {BAND}")
    leaves = nodes.filter("n_children IS NULL").select(F.col("conv_id").alias("conv"), F.explode(F.sequence(F.lit(0), band)).alias("band"))
    paths = rows.select("conv", "depth", "node", band.alias("band")).join(leaves.withColumn("band", F.col("band").cast("bigint")), ["conv", "band"])
    paths = stored(paths, "paths")
    owners = paths.groupBy("node").agg(F.min("conv").alias("conv"))
    owned = owners.join(nodes, "node").select("conv", band.alias("band"), "depth", "node", ((F.col("n_convs") - 1) * F.col("bytes")).alias("w"))
    owned = stored(owned, "owned")
    below = owned.groupBy("conv", "band").agg(F.sum("w").alias("w"))
    deeper = Window.partitionBy("conv").orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    # A path may own nothing in a band; all its bands take part.
    bands = paths.select("conv", "band").distinct().join(below, ["conv", "band"], "left")
    tails = bands.select("conv", "band", F.sum(F.coalesce("w", F.lit(0))).over(deeper).alias("w")).filter("w > 0")
    parts = paths.select("conv", "band", "depth", "node", F.lit(0).cast("bigint").alias("w")).unionByName(owned)
    parts = parts.unionByName(tails.select("conv", "band", F.lit(-1).cast("bigint").alias("depth"), F.lit(None).cast("binary").alias("node"), "w"))
    units = parts.repartition("conv", "band").groupBy("conv", "band", "depth").agg(F.max("node").alias("node"), F.sum("w").alias("w"))
    step = F.when(F.col("node").isNotNull(), F.struct("depth", "node", "w"))
    units = units.groupBy("conv", "band").agg(
        F.sort_array(F.collect_list(step)).alias("p"), F.coalesce(F.sum(F.when(F.col("node").isNull(), F.col("w"))), F.lit(0)).alias("tail")
    )
    ordered = units.select("band", F.slice("p.node", 1, 8).alias("first"), F.col("p.node").alias("nodes"), F.col("p.w").alias("weights"), "tail")
    ordered = ordered.repartitionByRange("band", "first").sortWithinPartitions("band", "nodes").select("nodes", "weights", "tail")
    found = ordered.mapInArrow(_shards, "node binary, leaves bigint, saved bigint").groupBy("node")
    subtree = found.agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    last = rows.groupBy("conv").agg(F.max(F.struct("depth", "node")).alias("last")).select("conv", F.col("last.node").alias("node"))
    result = nodes.join(subtree, "node").join(_digests(last), "node", "left")
    parent = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return _looked_up(result, parent, "parent", "node", salts).select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )
