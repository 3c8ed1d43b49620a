"""Near-duplicate classes by Order MinHash with verification by banded alignment.

A text is its sequence of runs of ``k`` words, each labelled with its occurrence number in the text, so that repeats stay apart.  A
sketch takes the few labelled runs with the smallest hashes and keeps them in text order: it agrees for two texts with a
probability that falls with their edit distance.  Texts that share a sketch meet in a bucket.

* Equal texts are one node (a 128-bit digest), so copies cost nothing beyond their own row.
* A bucket of up to ``small`` nodes gives its pairs.  A larger one gives a star around its most central node (most bucket mates),
  so no bucket makes pairs by the square.  Pairs that share too few of all sketches go before any text moves.
* A verified pair aligns: runs common to both texts, within the band that can still reach the threshold, form the longest chain in
  the order of both.  With ``m`` runs in the chain and n1, n2 in the texts, similarity is m / (n1 + n2 - m), at least ``threshold``.
* Large buckets that still hold several classes are compared in full.  The members outside a bucket's largest class are dealt into blocks
  of up to 1,024 texts; each block is one task's work together with one block of any members, so that a text moves once for each such
  block and no pair is a row.  A pair belongs to the bucket of the first sketch it shares; the task counts common runs of the pairs of
  different classes that share enough sketches and aligns those that can reach the threshold.  Members of the largest class never meet
  each other, and a bucket's rows are in proportion to its members while the others fill one block.
* Classes are connected components, by star contraction with a reliable checkpoint a round.

Misses are a matter of chance: at similarity 0.8 a pair shares fewer than 3 of 24 two-run sketches with probability below 1e-8.

Defined results: equal texts, empty ones too, are one class; a null text is a class of its own row; a text of fewer than ``k`` words is
one run, one without words resembles equal texts only; rows that repeat an id are separate rows of the class of their text.
"""
from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, stored
from .tokens import Words, chunks, free_buffers, mix

#: Tiers of (runs in a sketch, sketches, least and most runs in a text), and the sketches that a pair must share at least
LEVEL, SHARED = ((2, 24, 1, 1 << 60),), 3
SMALL = 16
#: Comparison in full: texts and runs of one side of a task's work
BLOCK, BLOCK_RUNS = 1024, 400_000
_STEP = np.uint64(0xD1B54A32D192ED03)
_TOP = np.uint64(2**64 - 1)


def node_of(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def word_runs(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(runs, labelled runs, offsets): hashes of every ``k`` words on, and the same told apart by occurrence within the text."""
    w = Words(texts)
    h, n = w.hashes(), np.diff(w.offsets)
    size = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    offsets = np.r_[0, np.cumsum(size)]
    doc = np.repeat(np.arange(len(texts)), size)
    at = w.offsets[doc] + np.arange(offsets[-1]) - offsets[doc]
    padded = np.r_[h, np.zeros(k, np.uint64)]
    run = np.zeros(at.size, np.uint64)
    for j in range(k):
        inside = j < n[doc]
        run = run * _STEP + np.where(inside, padded[at + j], np.uint64(j + 1))
    run = mix(run)
    own = run + doc.astype(np.uint64) * _STEP
    order = np.argsort(own, kind="stable")
    s = own[order]
    fresh = np.r_[True, s[1:] != s[:-1]][: s.size]
    nth = np.arange(s.size) - np.maximum.accumulate(np.where(fresh, np.arange(s.size), 0)) if s.size else np.zeros(0, np.int64)
    label = run.copy()
    again = nth > 0
    label[order[again]] = mix(run[order[again]] + nth[again].astype(np.uint64) * _STEP)
    return run, label, offsets


def sketches(run: np.ndarray, label: np.ndarray, offsets: np.ndarray, level: tuple) -> np.ndarray:
    """One row per text: a hash of the least labelled runs in text order, per sketch; 0 where the text is not of the tier."""
    n = np.diff(offsets)
    out = np.zeros((n.size, sum(t[1] for t in level)), np.uint64)
    column = 0
    for runs, count, low, high in level:
        docs = np.flatnonzero((n >= low) & (n <= high))
        size = n[docs]
        first = np.cumsum(size) - size
        total = int(size.sum())
        source = np.repeat(offsets[docs] - first, size) + np.arange(total)
        lab, rn = label[source], run[source]
        for t in range(count if docs.size else 0):
            seed = mix(np.array([runs * 1000 + t + 1], np.uint64))[0]
            v = (lab ^ seed) * (seed | np.uint64(1))
            v ^= v >> np.uint64(29)
            v = v * _STEP
            places = np.full((docs.size, runs), total, np.int64)
            for r in range(runs):
                least = np.minimum.reduceat(v, first)
                hit = np.flatnonzero(v == np.repeat(least, size))
                hit = hit[v[hit] != _TOP]
                owner = np.searchsorted(first, hit, "right") - 1
                places[owner, r] = hit
                v[hit] = _TOP
            places.sort(1)
            padded = np.r_[rn, np.uint64(7)]
            value = np.full(docs.size, np.uint64(runs * 1000 + t + 1))
            for r in range(runs):
                value = mix(value * _STEP + padded[places[:, r]])
            out[docs, column + t] = value | np.uint64(1)
        column += count
    return out


def sketch_rows(texts: DataFrame, level: tuple, k: int) -> DataFrame:
    """(node, n, sketch) of rows (node, body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, bodies in chunks(batch, "body"):
                r, label, offsets = word_runs(bodies, k)
                s = sketches(r, label, offsets, level)
                flat = pa.array(s.view(np.int64).ravel())
                at = pa.array(np.arange(len(bodies) + 1, dtype=np.int32) * s.shape[1])
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(at, flat)], names=["node", "n", "sketch"])
            free_buffers()

    return texts.mapInArrow(run, "node binary, n long, sketch array<long>")


def chain(places: np.ndarray) -> int:
    """Length of the longest increasing chain."""
    ends: list[int] = []
    for p in places.tolist():
        i = bisect_left(ends, p)
        ends[i : i + 1] = [p]
    return len(ends)


def aligned(left: list[str | None], right: list[str | None], k: int, threshold: float) -> np.ndarray:
    """Similarity of each pair of texts by banded alignment of their labelled runs; 0 where it cannot reach the threshold."""
    pairs = len(left)
    _, label, offsets = word_runs([*left, *right], k)
    n = np.diff(offsets)
    n1, n2 = n[:pairs], n[pairs:]
    doc = np.repeat(np.arange(2 * pairs), n)
    place = np.arange(label.size) - offsets[doc]
    key = label + (doc % pairs).astype(np.uint64) * _STEP if pairs else label
    cut = offsets[pairs]
    _, i, j = np.intersect1d(key[:cut], key[cut:], assume_unique=True, return_indices=True)
    pair, a, b = doc[i], place[i], place[cut + j]
    need = np.ceil(threshold / (1 + threshold) * (n1 + n2) - 1e-9)
    reach = np.minimum(a, b) + 1 + np.minimum(n1[pair] - 1 - a, n2[pair] - 1 - b)
    band = reach >= need[pair]
    pair, a, b = pair[band], a[band], b[band]
    enough = np.bincount(pair, minlength=pairs) >= need
    keep = enough[pair]
    order = np.lexsort((a[keep], pair[keep]))
    pair, b = pair[keep][order], b[keep][order]
    m = np.bincount(pair, minlength=pairs)
    back = np.flatnonzero((pair[1:] == pair[:-1]) & (b[1:] <= b[:-1]))
    for p in np.unique(pair[back]):
        lo, hi = np.searchsorted(pair, [p, p + 1])
        m[p] = chain(b[lo:hi])
    return np.where(enough & (n1 > 0) & (n2 > 0), m / np.maximum(n1 + n2 - m, 1), 0.0)


def verify(pairs: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs that reach the threshold."""
    met = (pairs.join(texts.select(F.col("node").alias("a"), F.col("body").alias("left")), "a")
           .join(texts.select(F.col("node").alias("b"), F.col("body").alias("right")), "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, left in chunks(batch, "left"):
                s = aligned(left, part.column("right").to_pylist(), k, threshold)
                hit = pa.array(s >= threshold)
                yield pa.RecordBatch.from_arrays([part.column("a").filter(hit), part.column("b").filter(hit), pa.array(s).filter(hit)], names=["a", "b", "similarity"])
            free_buffers()

    return met.select("a", "b", "left", "right").mapInArrow(run, "a binary, b binary, similarity double")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of an edge with the least node of its component, by alternating star contractions."""
    now, last = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()), None
    sign = F.xxhash64("u", "v")  # edges are distinct: count, sum and xor of their hashes tell when a round changes none
    marks = [F.count(F.lit(1)), F.sum(sign.cast("decimal(38,0)")), F.bit_xor(sign)]
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = cut_lineage(small)
        state = new.agg(*marks).first()
        now, same, last = new, state == last, state
        if same:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def candidate_pairs(sketched: DataFrame, small: int, least_shared: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(pairs a < b, large buckets)."""
    own = F.filter(F.transform("sketch", lambda v, t: F.struct(t.alias("t"), v.alias("value"))), lambda s: s["value"] != 0)
    rows = sketched.select("node", "n", F.explode(own).alias("s")).select("node", "n", "s.t", "s.value")
    sizes = rows.groupBy("t", "value").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    # sizes and hubs are tables of their own: an aggregate's partitioning would carry over to the joins and keep a large bucket in one task
    met = stored(rows.join(stored(sizes, "sizes"), ["t", "value"]), "buckets")
    lists = met.filter(F.col("size") <= small).groupBy("t", "value").agg(F.collect_list("node").alias("ms"))
    some = (lists.select("ms", F.explode("ms").alias("x")).select("x", F.explode("ms").alias("y"))
            .filter("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")))
    big = met.filter(F.col("size") > small)
    central = big.withColumn("mates", F.sum("size").over(Window.partitionBy("node")))  # a node has a row a sketch at most
    hubs = stored(central.groupBy("t", "value").agg(F.max(F.struct("mates", "node")).alias("hub")), "hubs")
    star = (big.join(hubs, ["t", "value"]).filter("hub.node <> node")
            .select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")))
    pairs = some.unionByName(star).distinct()
    side = sketched.select("node", "n", "sketch")
    met_pairs = (pairs.join(side.withColumnsRenamed({"node": "a", "n": "n1", "sketch": "s1"}), "a")
                 .join(side.withColumnsRenamed({"node": "b", "n": "n2", "sketch": "s2"}), "b")
                 .filter(F.least("n1", "n2") >= threshold * F.greatest("n1", "n2")))
    equal = F.aggregate(F.zip_with("s1", "s2", lambda x, y: ((x == y) & (x != 0)).cast("int")), F.lit(0), lambda s, x: s + x)
    return met_pairs.filter(equal >= least_shared).select("a", "b"), big


def open_blocks(big: DataFrame, roots: DataFrame) -> DataFrame:
    """(t, value, i, j, c, node, root) of the large buckets that hold several classes, once for each piece of work (i, j).

    Blocks from 0 on hold the members outside the bucket's largest class, the blocks after them that class."""
    named = big.select("t", "value", "node", "n").join(roots, "node", "left").select("t", "value", "node", F.coalesce("root", "node").alias("root"), "n")
    by_class = named.groupBy("t", "value", "root").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("runs"))
    most = F.max(F.struct("k", "root", "runs"))
    split = by_class.groupBy("t", "value").agg(most.alias("m"), F.sum("k").alias("k"), F.sum("runs").alias("runs"), F.count(F.lit(1)).alias("classes")).filter("classes > 1")
    blocks = lambda k, runs: F.greatest(F.lit(1), F.ceil(k / BLOCK), F.ceil(runs / BLOCK_RUNS)).cast("int")
    split = split.select("t", "value", F.col("m.root").alias("main"), blocks(F.col("k") - F.col("m.k"), F.col("runs") - F.col("m.runs")).alias("b"), blocks(F.col("m.k"), F.col("m.runs")).alias("bm"))
    rows = named.join(stored(split, "split"), ["t", "value"])
    c = F.when(F.col("root") == F.col("main"), F.col("b") + F.pmod(F.xxhash64("node", "t"), F.col("bm"))).otherwise(F.pmod(F.xxhash64("node", "t"), F.col("b"))).cast("int")
    rows = rows.withColumn("c", c).withColumn("o", F.explode(F.sequence(F.lit(0), F.when(F.col("c") < F.col("b"), F.col("b") + F.col("bm")).otherwise(F.col("b")) - 1)))
    return rows.select("t", "value", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", "node", "root")


def with_side(work: DataFrame, side: DataFrame) -> DataFrame:
    """Work rows with the columns of ``side`` (one row a node): a node's pieces of work meet its row as one list."""
    lists = work.groupBy("node").agg(F.collect_list(F.struct("t", "value", "i", "j", "c", "root")).alias("pieces"))
    return lists.join(side, "node").select("node", F.explode("pieces").alias("p"), *[c for c in side.columns if c != "node"]).select("p.*", "node", *[c for c in side.columns if c != "node"])


def meeting(group: pa.Table, i: int, j: int, t: int, least_shared: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (left, right) of the pairs of different classes that share enough sketches, none before sketch ``t``, and may be alike by length."""
    group = group.combine_chunks()
    n, side = group.column("n").to_numpy(), group.column("c").to_numpy()
    s = group.column("sketch").combine_chunks().flatten().to_numpy().reshape(n.size, -1)
    root = np.unique(np.array([r.hex() for r in group.column("root").to_pylist()]), return_inverse=True)[1]
    left, right, out = np.flatnonzero(side == i), np.flatnonzero(side == j), []
    for at in range(0, left.size, 128):
        x = left[at : at + 128]
        y = right[(n[right] >= threshold * n[x].min()) & (threshold * n[right] <= n[x].max())]
        shared, before = np.zeros((x.size, y.size), np.uint8), np.zeros((x.size, y.size), bool)
        for c in range(s.shape[1]):
            equal = (s[x, c][:, None] == s[y, c]) & (s[x, c] != 0)[:, None]
            shared += equal
            if c < t:
                before |= equal
        n1, n2 = n[x][:, None], n[y]
        met = (shared >= least_shared) & ~before & (root[x][:, None] != root[y]) & (np.minimum(n1, n2) >= threshold * np.maximum(n1, n2))
        if i == j:
            met &= x[:, None] < y
        a, b = np.nonzero(met)
        out.append((x[a], y[b]))
    return tuple(np.concatenate(z) for z in zip(*out)) if out else (np.zeros(0, np.int64),) * 2


def with_mates(work: DataFrame, sketched: DataFrame, least_shared: int, threshold: float) -> DataFrame:
    """The rows of ``open_blocks`` that have a pair to compare, so that no other text is moved."""
    names = work.columns

    def run(key: tuple, group: pa.Table) -> pa.Table:
        t, _, i, j = (x.as_py() for x in key)
        left, right = meeting(group, i, j, t, least_shared, threshold)
        return group.select(names).take(pa.array(np.union1d(left, right)))

    return with_side(work, sketched.select("node", "n", "sketch")).groupBy("t", "value", "i", "j").applyInArrow(run, work.schema)


def common_runs(label: np.ndarray, offsets: np.ndarray, left: np.ndarray, right: np.ndarray, slab: int = 4096) -> np.ndarray:
    """Number of labelled runs that each left text shares with each right one."""
    _, column, holders = np.unique(label, return_inverse=True, return_counts=True)
    doc = np.repeat(np.arange(offsets.size - 1), np.diff(offsets))
    several = holders[column] > 1
    doc, column = doc[several], (np.cumsum(holders > 1) - 1)[column[several]]
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    out = np.zeros((left.size, right.size), np.int64)
    for low in range(0, int(column[-1]) + 1 if column.size else 0, slab):
        a, b = np.searchsorted(column, [low, low + slab])
        held = np.zeros((offsets.size - 1, slab), np.float32)
        held[doc[a:b], column[a:b] - low] = 1
        out += (held[left] @ held[right].T).astype(np.int64)
    return out


def linked(root: list[bytes], bodies: list[str], left: np.ndarray, right: np.ndarray, k: int, threshold: float) -> list[tuple[int, int, float]]:
    """(left, right, similarity) of pairs of a pack that reach the threshold, without those whose classes others have joined by then."""
    _, label, offsets = word_runs(bodies, k)
    n = np.diff(offsets)
    ls, at_l = np.unique(left, return_inverse=True)
    rs, at_r = np.unique(right, return_inverse=True)
    common = common_runs(label, offsets, ls, rs)[at_l, at_r]
    keep = np.flatnonzero(common >= np.ceil(threshold / (1 + threshold) * (n[left] + n[right]) - 1e-9))
    keep = keep[np.argsort(-common[keep], kind="stable")]
    parent = {r: r for r in root}

    def find(r: bytes) -> bytes:
        while parent[r] != r:
            parent[r] = r = parent[parent[r]]
        return r

    out, todo = [], list(zip(left[keep].tolist(), right[keep].tolist()))
    while todo:
        batch, runs, at = [], 0, 0
        while at < len(todo) and len(batch) < 128 and (not batch or runs < BLOCK_RUNS):
            a, b = todo[at]
            if find(root[a]) != find(root[b]):
                batch.append((a, b))
                runs += int(n[a] + n[b])
            at += 1
        todo = todo[at:]
        for (a, b), s in zip(batch, aligned([bodies[a] for a, _ in batch], [bodies[b] for _, b in batch], k, threshold) if batch else ()):
            if s >= threshold and find(root[a]) != find(root[b]):
                parent[find(root[a])] = find(root[b])
                out.append((a, b, float(s)))
    return out


def compared_in_full(work: DataFrame, texts: DataFrame, k: int, threshold: float, least_shared: int) -> DataFrame:
    """(a, b, similarity): links between the classes of each piece of work."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("similarity", pa.float64())])

    def run(key: tuple, group: pa.Table) -> pa.Table:
        t, _, i, j = (x.as_py() for x in key)
        left, right = meeting(group, i, j, t, least_shared, threshold)
        nodes = group.column("node").to_pylist()
        found = linked(group.column("root").to_pylist(), group.column("body").to_pylist(), left, right, k, threshold) if left.size else []
        free_buffers()
        return pa.table({"a": [min(nodes[a], nodes[b]) for a, b, _ in found], "b": [max(nodes[a], nodes[b]) for a, b, _ in found],
                         "similarity": [s for _, _, s in found]}, schema=schema)

    return with_side(work, texts).groupBy("t", "value", "i", "j").applyInArrow(run, "a binary, b binary, similarity double")


def near_duplicates(docs: DataFrame, k: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, links).  members: (id, node, root), one row per input row; links: (a, b, similarity) between different texts, as many as were
    verified before both were of one class."""
    named = docs.select(F.col(id_col).alias("id"), node_of(F.col(text_col)).alias("node"), F.col(text_col).alias("body"))
    picks = named.filter("node is not null").groupBy("node").agg(F.min("id").alias("id"))
    sketched = stored(sketch_rows(named.filter("node is not null").select("node", "body"), LEVEL, k).dropDuplicates(["node"]), "sketches")
    pairs, big = candidate_pairs(sketched, SMALL, SHARED, threshold)
    candidates = stored(pairs, "pairs")
    wanted = candidates.select(F.col("a").alias("node")).unionByName(candidates.select(F.col("b").alias("node"))).distinct()
    links = stored(verify(candidates, stored(texts_of(named, picks, wanted), "texts"), k, threshold), "links")
    roots = components(links)
    work = stored(with_mates(open_blocks(big, roots), sketched, SHARED, threshold), "work")
    if not work.isEmpty():
        texts = stored(texts_of(named, picks, work.select("node").distinct()).join(sketched.select("node", "n", "sketch"), "node"), "texts")
        links = links.unionByName(stored(compared_in_full(work, texts, k, threshold, SHARED), "links"))
        roots = components(links)
    members = named.select("id", "node").join(roots, "node", "left").select("id", "node", F.coalesce("root", "node").alias("root"))
    return members, links


def texts_of(named: DataFrame, picks: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, body) for the given nodes, from one row of each."""
    one = picks.join(nodes, "node").withColumnsRenamed({"node": "n0", "id": "i0"})
    met = named.join(one, (F.col("node") == F.col("n0")) & F.col("id").eqNullSafe(F.col("i0")))
    return met.dropDuplicates(["n0", "i0"]).select("node", "body")


def classes(docs: DataFrame, k: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, node, root, class_id, n_rows, n_links): one row per input row; class_id is the least id of the class, n_links the verified links
    between its different texts.

    ``root`` tells classes apart whose least ids are equal or null; a null text has none."""
    members, links = near_duplicates(docs, k, threshold, id_col, text_col)
    members = stored(members, "members")
    of_class = members.filter("root is not null").groupBy("root").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n_rows"))
    linked_ = links.join(members.select(F.col("node").alias("a"), "root").distinct(), "a").groupBy("root").agg(F.count(F.lit(1)).alias("n_links"))
    named = stored(of_class.join(linked_, "root", "left"), "classes")
    return (members.join(named, "root", "left").select("id", "node", "root", F.coalesce("class_id", "id").alias("class_id"),
                                                       *[F.coalesce(c, F.lit(d)).cast("long").alias(c) for c, d in (("n_rows", 1), ("n_links", 0))]))


def first_of_each(docs: DataFrame, k: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows that stay: of each class the row with the least id (one of those that share it; a null id only where no row has another);
    null texts all stay."""
    members, _ = near_duplicates(docs, k, threshold, id_col, text_col)
    members = stored(members.filter("node is not null"), "members")
    first = members.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "node")).alias("m"))
    stay = stored(first.select(F.col("m.id").alias("i0"), F.col("m.node").alias("n0")), "stay")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), node_of(F.col(text_col)).alias("node"))
    kept = rows.join(stay, (rows["node"] == stay["n0"]) & rows["id"].eqNullSafe(stay["i0"]), "left_semi")
    repeated = (members.join(stay, (members["node"] == stay["n0"]) & members["id"].eqNullSafe(stay["i0"]), "left_semi")
                .groupBy("id", "node").count().filter("count > 1").isEmpty())
    kept = kept if repeated else kept.dropDuplicates(["id", "node"])
    return kept.unionByName(rows.filter("node is null")).select("row.*")
