"""The prefix trie of conversations, built from range-sorted shards around a skeleton of splitter paths.

A turn is a digest of role and text, a conversation the path of its digests.  Conversations sorted by (path, id) keep every subtree of
the trie together, so a cut between two shards can only lie inside the subtrees of the nodes on the splitter's path.

1. Splitters are quantiles of a bounded sample (by a hash of the id), at most ``skeleton_nodes`` nodes deep in all.  Their paths are the
   skeleton, a trie small enough to be broadcast.
2. Each task sorts its shards (Spark's external sort) and walks them once with a stack of open nodes.  A node off the skeleton lies
   in one shard and is finished there; a skeleton node gives a partial aggregate from every shard that touches it.
3. Partials are reduced by node; what skeleton nodes add themselves (a leaf, saved tokens) is summed over the skeleton in its own order.

Conversations with one and the same path are cut by id, so a path that a third of all conversations share fills many shards.  The ids that
end at a skeleton node travel in ascending packs of 4,096 and are hashed in one stream: only the digest itself is sequential.

Defined results: rows without an id belong to no conversation; turns stand by turn number (null first), ties by role and then by the
digest of role and text, so that repeated rows are turns of their own; null roles and texts are empty; an id whose rebuilt conversation
has no turns ends at the root; an empty table has no nodes.  Texts of any length are hashed where they are read; a conversation's digests (24
bytes a turn) are one row.  Extra input columns are not read.
"""
from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, stored

SHARD_TURNS = 50_000
SAMPLE_PER_SHARD = 20
SKELETON_NODES = 200_000
PACK = 4096
_BEFORE_ALL = -(1 << 63)


def turn_digests(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(id, turns): for every conversation its turns (digest, size in code points) in order."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    turn = F.struct(F.col(turn_col).alias("turn"), role.alias("role"), digest.alias("digest"), F.length(text).alias("size"))
    lists = rows.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), turn.alias("t")).groupBy("id").agg(F.collect_list("t").alias("all"))
    return lists.select("id", F.transform(F.array_sort("all"), lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("turns"))


def rebuilt(turns: DataFrame, family: int = 100, heads: int = 6) -> DataFrame:
    """(id, path, sizes): the first h turns of the conversation at the start of the id's family, then the own turns after the first h."""
    h = F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(heads)).cast("int")
    first = turns.filter(F.col("id") % family == 0).select(F.col("id").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    met = turns.withColumn("h", h).withColumn("base", F.col("id") - F.col("id") % family).join(first, "base", "left")
    head = F.slice(F.coalesce("head", F.array().cast(turns.schema["turns"].dataType)), F.lit(1), F.col("h"))
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    whole = met.select("id", F.concat(head, own).alias("t"))
    return whole.select("id", F.col("t.digest").alias("path"), F.col("t.size").alias("sizes"))


class Skeleton:
    """The trie of the splitters' paths: node 0 is the root, ``find`` maps (node, digest) to a child; numbers follow a walk in order."""

    def __init__(self, paths: list[tuple]):
        self.find: dict[tuple[int, bytes], int] = {}
        self.parent, self.depth, self.children = [-1], [0], [0]
        last, nodes = (), [0]
        for path in sorted(set(paths)):
            same = 0
            while same < min(len(path), len(last)) and path[same] == last[same]:
                same += 1
            del nodes[same + 1 :]
            for digest in path[same:]:
                self.find[nodes[-1], digest] = len(self.parent)
                self.children[nodes[-1]] += 1
                self.parent.append(nodes[-1])
                self.depth.append(self.depth[nodes[-1]] + 1)
                self.children.append(0)
                nodes.append(len(self.parent) - 1)
            last = path
        self.end = [*range(1, len(self.parent) + 1)]
        for node in range(len(self.parent) - 1, 0, -1):
            self.end[self.parent[node]] = max(self.end[self.parent[node]], self.end[node])


def splitters_of(paths: DataFrame, shard_turns: int = SHARD_TURNS, skeleton_nodes: int = SKELETON_NODES) -> list[tuple[tuple, int]]:
    """Bounds (path, id) between shards in ascending order, from a sample of a bounded number of rows and digests."""
    total, turns = paths.agg(F.count(F.lit(1)), F.sum(F.size("path") + 1)).first()
    shards = min(max(total, 1), -(-(turns or 0) // shard_turns), skeleton_nodes // 16)
    if shards < 2:
        return []
    deep = max(16, skeleton_nodes // (shards * SAMPLE_PER_SHARD))
    cut = F.size("path") > deep
    sample = (paths.select(F.xxhash64("id").alias("h"), F.slice("path", 1, deep).alias("path"), F.when(~cut, F.col("id")).alias("id"))
              .orderBy("h").limit(SAMPLE_PER_SHARD * shards).select("path", "id").toArrow())
    rows = sorted((tuple(p), _BEFORE_ALL if i is None else i) for p, i in zip(sample.column("path").to_pylist(), sample.column("id").to_pylist()))
    return sorted({rows[k * len(rows) // shards] for k in range(1, shards)})


def finished_nodes(paths: DataFrame, bounds: list[tuple[tuple, int]], pack: int = PACK) -> tuple[DataFrame, Skeleton]:
    """What the shards give, as a stored table: finished nodes (kind 0), partials of skeleton nodes (1) and packs of ids that end at one (2)."""
    spark = paths.sparkSession
    skeleton = Skeleton([p for p, _ in bounds])
    shared = spark.sparkContext.broadcast((bounds, skeleton.find))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, _ = shared.value
        for b in batches:
            shard = [bisect_right(bounds, (tuple(p), i)) for p, i in zip(b.column("path").to_pylist(), b.column("id").to_pylist())]
            yield b.append_column("shard", pa.array(shard, pa.int32()))

    names = ["kind", "node", "conv_id", "depth", "parent_conv_id", "parent_node", "n_convs", "n_children", "n_leaves", "saved_tokens", "size", "ends"]
    schema = "kind int, node int, conv_id long, depth long, parent_conv_id long, parent_node int, n_convs long, n_children long, n_leaves long, saved_tokens long, size long, ends string"
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, find = shared.value
        out: list[tuple] = []
        # an open node: [digest, skeleton number or -1, size, smallest id, conversations, children, leaves, saved, ends, its finished children]
        stack: list[list] = []
        shard = None

        def give(node: list) -> None:
            if node[8]:
                out.append((2, node[1], node[8][0], None, None, None, None, None, None, None, None, ",".join(map(str, node[8]))))
                node[8] = []

        def close() -> None:
            node = stack.pop()
            _, number, size, least, convs, children, leaves, saved, ends, below = node
            depth = len(stack)
            if number >= 0:
                give(node)
                out.append((1, number, least, depth, None, None, convs, children, leaves, saved, size, None))
            else:
                leaves = leaves or 1
                saved += (convs - 1) * size
                for row in below:
                    row[4] = least
                    out.append(tuple(row))
                row = [0, None, least, depth, None, None, convs, children, leaves, saved, size, ends.hexdigest()]
                if stack[-1][1] >= 0:
                    row[5] = stack[-1][1]
                    out.append(tuple(row))
                else:
                    stack[-1][9].append(row)
            if stack:
                up = stack[-1]
                up[3] = min(up[3], least)
                up[4] += convs
                up[5] += number < 0
                up[6] += leaves
                up[7] += saved

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
            out.clear()
            return batch

        for b in batches:
            for s, path, sizes, conv in zip(b.column("shard").to_pylist(), b.column("path").to_pylist(), b.column("sizes").to_pylist(), b.column("id").to_pylist()):
                if s != shard:
                    while stack:
                        close()
                    stack.append([None, 0, 0, conv, 0, 0, 0, 0, [], []])
                    shard = s
                same, most = 0, min(len(path), len(stack) - 1)
                while same < most and stack[same + 1][0] == path[same]:
                    same += 1
                while len(stack) > same + 1:
                    close()
                for k in range(same, len(path)):
                    number = find.get((stack[-1][1], path[k]), -1) if stack[-1][1] >= 0 else -1
                    stack.append([path[k], number, sizes[k], conv, 0, 0, 0, 0, [] if number >= 0 else hashlib.sha256(), []])
                top = stack[-1]
                if top[1] >= 0:
                    top[8].append(conv)
                    if len(top[8]) == pack:
                        give(top)
                else:
                    top[8].update(b",%d" % conv if top[4] else b"%d" % conv)
                top[4] += 1
                top[3] = min(top[3], conv)
                if len(out) >= 10_000:
                    yield flush()
        while stack:
            close()
        if out:
            yield flush()

    dealt = paths.mapInArrow(deal, "id long, path array<binary>, sizes array<int>, shard int")
    sorted_ = dealt.repartition(len(bounds) + 1, "shard").sortWithinPartitions("shard", "path", "id")
    return stored(sorted_.mapInArrow(walk, schema), "trie"), skeleton


def ends_digests(packs: DataFrame) -> DataFrame:
    """(node, ends_sha256): the packs of a node in ascending order as one stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, running = None, None
        schema = pa.schema([("node", pa.int32()), ("ends_sha256", pa.string())])
        for b in batches:
            for n, text in zip(b.column("node").to_pylist(), b.column("ends").to_pylist()):
                if n != node:
                    if running:
                        yield pa.RecordBatch.from_pydict({"node": [node], "ends_sha256": [running.hexdigest()]}, schema)
                    node, running = n, hashlib.sha256(text.encode())
                else:
                    running.update(b"," + text.encode())
        if running:
            yield pa.RecordBatch.from_pydict({"node": [node], "ends_sha256": [running.hexdigest()]}, schema)

    return packs.repartition("node").sortWithinPartitions("node", "conv_id").select("node", "ends").mapInArrow(run, "node int, ends_sha256 string")


def prefix_trie(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", family: int = 100, heads: int = 6,
                shard_turns: int = SHARD_TURNS, skeleton_nodes: int = SKELETON_NODES, pack: int = PACK) -> DataFrame:
    """One row a node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = prepare(rows.sparkSession)
    paths = stored(rebuilt(turn_digests(rows, id_col, turn_col, role_col, text_col), family, heads), "paths")
    found, skeleton = finished_nodes(paths, splitters_of(paths, shard_turns, skeleton_nodes), pack)
    shape = spark.createDataFrame([(k, skeleton.parent[k], skeleton.end[k], skeleton.children[k]) for k in range(len(skeleton.parent))],
                                  "node int, up int, stop int, kept int")
    partial = found.filter("kind = 1").groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
                                                           F.max("size").alias("size"))
    digests = ends_digests(found.filter("kind = 2"))
    whole = (partial.join(F.broadcast(shape), "node").join(digests, "node", "left").withColumn("n_children", F.col("n_children") + F.col("kept"))
             .withColumn("own_leaf", (F.col("n_children") == 0).cast("long")).withColumn("own_saved", (F.col("n_convs") - 1) * F.col("size")))
    whole = stored(whole, "skeleton")
    # sums over the skeleton's own order: at most ``skeleton_nodes`` rows
    upto = whole.select("node", *[F.sum(c).over(Window.orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias(f"{c}_to") for c in ("own_leaf", "own_saved")])
    last = upto.select(F.col("node").alias("at"), F.col("own_leaf_to").alias("leaf_end"), F.col("own_saved_to").alias("saved_end"))
    sums = (whole.join(upto, "node").join(last, F.col("at") == F.col("stop") - 1)
            .withColumn("n_leaves", F.col("n_leaves") + F.col("leaf_end") - F.col("own_leaf_to") + F.col("own_leaf"))
            .withColumn("saved_tokens", F.col("saved_tokens") + F.col("saved_end") - F.col("own_saved_to") + F.col("own_saved")))
    names = F.broadcast(whole.select(F.col("node").alias("parent_node"), F.col("conv_id").alias("parent_id")))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    upper = (sums.withColumn("parent_node", F.col("up")).join(names, "parent_node", "left").withColumn("parent_conv_id", F.col("parent_id"))
             .withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))))
    lower = (found.filter("kind = 0").join(names, "parent_node", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "parent_id"))
             .withColumn("ends_sha256", F.col("ends")))
    return upper.select(columns).unionByName(lower.select(columns))
