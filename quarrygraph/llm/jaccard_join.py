"""N-gram Jaccard join: a MinHash LSH forest finds candidates, exact set comparison decides.

1. Every text becomes its set of five-word shingles (a shorter text is one shingle), a 64-bit
   name of that set, and TREES * DEPTH minimum hashes. Texts with equal sets are copies; only one
   of each goes on.
2. A tree's label is DEPTH hashes. Sorting by label puts the trie's nodes next to each other. Sets that share a prefix in a tree meet: those that
   agree on the whole label first (each attaches to a leader that looks alike), then the leaders. As Jaccard distance obeys the triangle
   inequality, wide enough limits on the estimates between leaders keep every pair's two leaders connected. A node with very many sets, or
   leaders, is dealt out by salt.
3. Connected groups of candidates are compared exactly, all against all, in blocks: what a
   task returns is a row for each set, never a row for each pair, and how similar the linked pairs are.
4. Matched prefixes begin at the whole label and are shortened as the data ask for: a pair of the lowest similarity found so far must
   share a prefix in some tree with probability TARGET. The search ends when the prefix is short enough for what it found; without any link it ends at
   the length that serves a pair at the threshold. So the target holds for every band of similarity in which there are links.
5. Linked sets form classes.

Defined cases: null, empty and blank texts have no shingle: each is a class of its own without
links. Rows without an id are searched and linked like others; a class of such rows alone has a null class_id.
Repeated rows are copies of each other; one id with several texts is as many texts. Other columns are ignored, whatever their names. A text of any
length is taken whole, in its task's memory with eight bytes a word. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, columns, materialize, read_table, slices, small_batches
from .textvec import U, mix, words

WORDS = 5
#: Similarity from which two texts are linked, as a fraction.
THRESHOLD = (4, 5)
TREES, DEPTH = 16, 8
#: Chance with which a pair at the threshold shares a prefix in one tree at least.
TARGET = 0.999
#: A set attaches to a leader whose estimated similarity is this or more; leaders are connected from that on.
ATTACH, CONNECT = 0.85, 0.35
#: Bands of similarity in which links are counted.
BANDS = 100
#: Sets of one trie node that a task handles together, and sets of a block of the exact comparison.
NODE, BLOCK = 2_048, 256
#: Edges that one task connects at the end of `components`, 16 bytes each; more are connected by rounds over all tasks.
AT_ONCE = 400_000

_RNG = np.random.default_rng(20_240_229)
_A = (_RNG.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _RNG.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32)


def prefix_for(similarity: float, target: float = TARGET) -> int:
    """The greatest depth at which a pair so similar meets in some tree with the target's probability."""
    return max([d for d in range(1, DEPTH + 1) if 1 - (1 - similarity**d) ** TREES >= target], default=1)


def shingle_sets(texts: pa.Array, n: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    h, counts = words(texts)
    ends = np.cumsum(counts)
    full = np.zeros(len(h), U)
    if len(h) >= n:
        for k in range(n):
            full[: len(h) - n + 1] = full[: len(h) - n + 1] * U(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
        full = mix(full)
    out = []
    for end, count in zip(ends.tolist(), counts.tolist(), strict=True):
        if count >= n:
            out.append(np.unique(full[end - count : end - n + 1]))
        elif count:
            x = U(count)
            for w in h[end - count : end]:
                x = mix(np.array([x * U(0x9E3779B97F4A7C15) + w], U))[0]
            out.append(np.array([x], U))
        else:
            out.append(np.zeros(0, U))
    return out


def name_of(s: np.ndarray) -> int:
    """A number for the set, whatever its order."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U) + U(len(s))], U)).view(np.int64)[0])


def signature(s: np.ndarray) -> np.ndarray:
    """Minimum hashes of the set, 16 bits of each."""
    low = (s ^ (s >> U(32))).astype(np.uint32)
    out = np.full(TREES * DEPTH, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2_048):
        x = low[at : at + 2_048, None] * _A[None, :] + _B[None, :]
        np.minimum(out, (x ^ (x >> np.uint32(15))).min(0), out=out)
    return ((out * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def _sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for whole in batches:
            for batch in slices(whole):
                sets = shingle_sets(batch.column("text"))
                node = pa.array([name_of(s) if len(s) else None for s in sets], pa.int64())
                sig = pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "a", "b")), node, sig], ["doc_id", "a", "b", "node", "sig"])


def _tree_keys(depth: int):
    """(key, node) for every tree: the key is the tree and a prefix of its label."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, TREES, DEPTH)[:, :, :depth].astype(U)
            key = np.broadcast_to(np.arange(TREES, dtype=U), sig.shape[:2]).copy()
            with np.errstate(over="ignore"):
                for d in range(depth):
                    key = mix(key * U(65_599) + sig[:, :, d] + U(1))
            node = np.repeat(batch.column("node").to_numpy(), TREES)
            tree = np.tile(np.arange(TREES, dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(node), pa.array(tree)], ["key", "node", "tree"])

    return run


def groups(batches: Iterable[pa.RecordBatch], keys: list[str], rest: list[str]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Groups of equal keys of rows that come sorted by them."""
    def rows() -> Iterator[tuple]:
        for b in batches:
            k = list(zip(*(b.column(c).to_pylist() for c in keys), strict=True))
            yield from zip(k, *(b.column(c).to_pylist() for c in rest), strict=True)

    return groupby(rows(), itemgetter(0))


def _roots(n: int, pairs: Iterable[tuple[int, int]]) -> list[int]:
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def _connect(ids: list[int], sigs: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges that span every group of leaders that look connected."""
    pairs = []
    for k in range(1, len(ids)):
        near = np.flatnonzero((sigs[:k] == sigs[k]).mean(1) >= CONNECT)
        pairs += [(k, int(x)) for x in near]
        if len(pairs) > 100_000:
            pairs = [(x, r) for x, r in enumerate(_roots(len(ids), pairs)) if x != r]
    for x, r in enumerate(_roots(len(ids), pairs)):
        if x != r:
            yield ids[x], ids[r]


_LINK = "key long, a long, b long, sig binary"


def _link_nodes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) inside each part of a trie node; for a node that was dealt out, also its leaders (b null)."""
    out: list[tuple] = []
    for (key, _salt, many), rows in groups(batches, ["key", "salt", "dealt"], ["label", "node", "sig"]):
        ids: list[int] = []
        sigs = np.zeros((16, TREES * DEPTH), np.uint16)
        for _label, members in groupby(rows, itemgetter(1)):
            first = len(ids)  # the longest prefix first: sets with the whole label attach to leaders of that label
            for _, _, node, sig in members:
                s = np.frombuffer(sig, np.uint16)
                if len(ids) > first:
                    near = (sigs[first : len(ids)] == s).mean(1)
                    # All leaders near enough are connected, so that a pair whose two sets attach apart isn't lost.
                    hits = np.flatnonzero(near >= 2 * ATTACH - 1 - 0.15)
                    out += [(key, node, ids[first + int(x)], None) for x in hits[:1]]
                    out += [(key, ids[first + int(x)], ids[first + int(hits[0])], None) for x in hits[1:]]
                    if near.max() >= ATTACH:
                        continue
                if len(ids) == len(sigs):
                    sigs = np.concatenate([sigs, np.zeros_like(sigs)])
                sigs[len(ids)] = s
                ids.append(node)
        out += [(key, a, b, None) for a, b in _connect(ids, sigs)]
        if many:
            out += [(key, x, None, s.tobytes()) for x, s in zip(ids, sigs, strict=False)]
        if len(out) >= 5_000:
            yield _edges(out)
            out = []
    yield _edges(out)


def _link_leaders(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges between the leaders of two parts of a trie node."""
    for (key, _, _), rows in groups(batches, ["key", "one", "two"], ["a", "sig"]):
        found = [(a, sig) for _, a, sig in rows]
        yield _edges([(key, a, b, None) for a, b in _connect([a for a, _ in found], np.frombuffer(b"".join(s for _, s in found), np.uint16).reshape(len(found), -1))])


def _edges(rows: list[tuple]) -> pa.RecordBatch:
    rows = list(dict.fromkeys(rows))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["key", "a", "b", "sig"])


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a, b), and for each the smallest node that it is connected with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        p, q = root[x], root[y]
        apart = p != q
        if not apart.any():
            return nodes, nodes[root]
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
        while (root[root] != root).any():
            root = root[root]


def _forests(own: bool):
    """Edges from every node to the smallest that the task's edges connect it with; with own also from that node to itself. The edges
    are cut down whenever so many have come together, so a task holds one for each node and some more."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 2]
        more = 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            more += batch.num_rows
            if more >= max(AT_ONCE, len(held[0][0])):
                held, more = [_forest(*map(np.concatenate, zip(*held, strict=True)))], 0
        nodes, roots = _forest(*map(np.concatenate, zip(*held, strict=True)))
        some = np.full(len(nodes), True) if own else nodes != roots
        yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(roots[some])], ["node", "root"])

    return run


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): the smallest node that it is connected with.

    Every task first connects its own edges. Up to AT_ONCE edges that are left are connected by one task; more go through alternating
    large-star and small-star rounds, each of which writes its edges to the shared folder. Hubs are only ever aggregated by minimum there, never gathered.
    """
    e = materialize(spark, edges.filter("a <> b").select("a", "b").mapInArrow(_forests(False), "a long, b long"), "edges")
    if e.count() <= AT_ONCE:
        return materialize(spark, e.coalesce(1).mapInArrow(_forests(True), "node long, root long"), "roots")
    seen = None
    while True:
        mark = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
        if mark == seen:
            break
        seen = mark
        both = e.union(e.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x"))
        e = materialize(spark, small.select("x.*").filter("a <> b").distinct(), "edges")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b").distinct())


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each pair of blocks: every set, the smallest set of the block pair that it is linked with through links, and its number of links. At the
    end, in rows without a set, the number of links by band of similarity."""
    out: list[tuple] = []
    bands = np.zeros(BANDS + 1, np.int64)
    for (_, one, two), rows in groups(batches, ["comp", "one", "two"], ["block", "node", "shingles"]):
        found = list({r[2]: r[1:] for r in rows}.values())
        if len(found) < 2:
            continue
        ids, block = [r[1] for r in found], np.array([r[0] for r in found])
        sets = [np.frombuffer(r[2], U) for r in found]
        links, shared = similar(sets)
        if one != two:
            links &= block[:, None] != block[None, :]
        a, b = np.nonzero(np.triu(links, 1))
        size = np.array([len(x) for x in sets])
        bands += np.bincount((BANDS * shared[a, b] / (size[a] + size[b] - shared[a, b])).astype(np.int64), minlength=BANDS + 1)
        roots = _roots(len(ids), zip(a.tolist(), b.tolist(), strict=True))
        low: dict[int, int] = {}
        for x, r in enumerate(roots):
            low[r] = min(low.get(r, ids[x]), ids[x])
        out += [(ids[x], low[roots[x]], n) for x, n in enumerate(links.sum(1).tolist()) if n]
        if len(out) >= 5_000:
            yield _linked(out)
            out = []
    yield _linked(out + [(None, k, int(n)) for k, n in enumerate(bands) if n])


def _linked(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["node", "root", "n"])


def similar(sets: list[np.ndarray], columns: int = 4_096) -> tuple[np.ndarray, np.ndarray]:
    """Which sets reach the threshold with which others (not with themselves), and how many elements they share: counted by matrix products."""
    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    number = np.cumsum(np.concatenate([[0], every[1:] != every[:-1]]))
    shared = np.bincount(number)[number] > 1
    _, number = np.unique(number[shared], return_inverse=True)
    owner, both = owner[shared], np.zeros((len(sets), len(sets)), np.float64)
    cuts = np.searchsorted(number, np.arange(0, (number[-1] if len(number) else 0) + columns + 1, columns))
    for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if y > x:
            m = np.zeros((len(sets), columns), np.float32)
            m[owner[x:y], number[x:y] - k * columns] = 1
            both += m @ m.T
    size = np.array([len(s) for s in sets], np.float64)
    out = both * THRESHOLD[1] >= (size[:, None] + size[None, :] - both) * THRESHOLD[0]
    np.fill_diagonal(out, False)
    return out, both


def _shingles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["comp", "one", "two", "block", "node"]
    with np.errstate(over="ignore"):
        for whole in batches:
            for batch in slices(whole, most=1 << 20):
                sets = shingle_sets(batch.column("text"))
                # An id may stand for several texts; the one that was meant has the right set.
                good = pa.array([len(s) > 0 and name_of(s) == n for s, n in zip(sets, batch.column("node").to_pylist(), strict=True)], pa.bool_())
                out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in ["comp", "block", "parts", "node"]), pa.array([s.tobytes() for s in sets], pa.binary())], ["comp", "block", "parts", "node", "shingles"])
                yield out.filter(good)


def _name() -> tuple[Column, Column]:
    """Two numbers that name a text."""
    return F.xxhash64("text").alias("a"), F.xxhash64(F.lit("text"), "text").alias("b")


def _rep() -> Column:
    """What orders rows: those with an id first, by id, then by text."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "a", "b")


def _candidates(spark: SparkSession, sets: DataFrame, depth: int) -> DataFrame:
    """(node, root): connected groups of the sets that share a prefix of this depth in some tree and look alike."""
    keys = sets.select("node", "sig").mapInArrow(_tree_keys(depth), "key long, node long, tree int")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = keys.join(shared, "key").join(sets.select("node", "sig"), "node")
    label = F.substring("sig", F.col("tree") * (2 * DEPTH) + (1 + 2 * depth), F.lit(2 * (DEPTH - depth)))
    parts = F.ceil(F.col("n") / NODE)
    members = members.select("key", "node", "sig", label.alias("label"), F.pmod(F.xxhash64("node"), parts).alias("salt"), (parts > 1).alias("dealt"))
    members = members.repartition("key", "salt").sortWithinPartitions("key", "salt", "label", "node")
    linked = materialize(spark, members.mapInArrow(_link_nodes, _LINK), "links")
    edges, leaders = linked.filter("b is not null").select("a", "b"), linked.filter("b is null").select("key", "a", "sig")
    if leaders.isEmpty():
        return components(spark, edges)
    # Leaders of a dealt node meet in pairs of parts, as one task could not hold them all.
    leaders = leaders.join(leaders.groupBy("key").agg(F.ceil(F.count("*") / NODE).cast("int").alias("parts")), "key")
    leaders = leaders.withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    leaders = leaders.select("key", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"), "a", "sig").repartition("key", "one", "two").sortWithinPartitions("key", "one", "two", "a")
    edges = edges.union(leaders.mapInArrow(_link_leaders, _LINK).select("a", "b"))
    return components(spark, edges)


def _verified(spark: SparkSession, docs: DataFrame, sets: DataFrame, found: DataFrame) -> DataFrame:
    """What `_compare` returns for the groups of candidates."""
    sized = found.groupBy(F.col("root").alias("comp")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    inside = found.join(sized, F.col("root") == F.col("comp")).join(sets.select("node", "rep"), "node")
    inside = inside.select("rep.*", "node", "comp", "parts", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("block"))
    inside = materialize(spark, inside, "candidates")
    rows, kept = docs.withColumns(dict(zip("ab", _name(), strict=True))), ["comp", "block", "parts", "node", "text"]
    side = broadcast_if_small(inside, inside.count())
    with_id = rows.join(side.filter("not none"), ["doc_id", "a", "b"]).select(*kept)
    # A text that stands in no row with an id may stand in very many without one; one of them serves.
    without = rows.filter("doc_id is null").drop("doc_id").join(side.filter("none").drop("doc_id"), ["a", "b"]).select(*kept).dropDuplicates(["node"])
    made = with_id.union(without).mapInArrow(_shingles, "comp long, block int, parts int, node long, shingles binary")
    dealt = made.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("comp", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "node", "shingles")
    dealt = dealt.repartition("comp", "one", "two").sortWithinPartitions("comp", "one", "two", "node")
    return materialize(spark, dealt.mapInArrow(_compare, "node long, root long, n long"), "verified")


def _search(spark: SparkSession, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """`_verified` at the greatest depth that serves the links found there."""
    depth, threshold = DEPTH, THRESHOLD[0] / THRESHOLD[1]
    while True:
        verified = _verified(spark, docs, sets, _candidates(spark, sets, depth))
        lowest = verified.filter("node is null").agg(F.min("root").alias("band")).first()["band"]
        needed = prefix_for(threshold if lowest is None else max(threshold, lowest / BANDS))
        if needed >= depth:
            return verified.filter("node is not null")
        depth = needed


def classified(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, the numbers a and b that name its text, class (null for a text without words), class_id, n_links and n_copies for every row of docs."""
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialize(spark, docs.select("doc_id", *_name(), "text").mapInArrow(_sign, "doc_id long, a long, b long, node long, sig binary"), "signatures")
    sets = materialize(spark, signed.filter("node is not null").groupBy("node").agg(F.min(_rep()).alias("rep"), F.count("*").alias("n_copies"), F.first("sig").alias("sig")), "sets")
    verified = _search(spark, docs, sets)
    roots = components(spark, verified.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = verified.groupBy("node").agg(F.sum("n").alias("n_links"))
    named = sets.select("node", F.col("rep.doc_id").alias("rep"), "n_copies").join(roots, "node", "left").join(links, "node", "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    ids = named.groupBy("root").agg(F.min("rep").alias("class_id"))
    named = named.join(ids, "root").select("node", F.col("root").alias("class"), "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    out = signed.select("doc_id", "a", "b", "node").join(named, "node", "left")
    return out.select("doc_id", "a", "b", "class", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))


def classes(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest id of the class), n_links and n_copies (texts with the same set) for every row of docs (doc_id, text)."""
    return classified(spark, docs).select("doc_id", "class_id", "n_links", "n_copies")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark, read_table(spark, sf_dir, "documents"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: that with the smallest id, or, in a class without ids, with the smallest name of its text; once, if its row is repeated.
    Texts without words all stay."""
    found = materialize(spark, classified(spark, docs).select("doc_id", "a", "b", "class"), "classified")
    first = found.filter("class is not null").groupBy("class").agg(F.min(_rep()).alias("r")).select("r.doc_id", "r.a", "r.b")
    kept = materialize(spark, found.filter("class is not null").join(first.withColumnsRenamed({"doc_id": "_d", "a": "_a", "b": "_b"}), (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")) & F.col("doc_id").eqNullSafe(F.col("_d"))).groupBy("_d", "_a", "_b").agg(F.count("*").alias("_rows")), "kept")
    facts = kept.agg(F.count("*").alias("n"), F.max("_rows").alias("most")).first()
    packed = docs.select(F.struct(*columns(docs)).alias("_row"), F.col("doc_id").cast("long").alias("_id"), "text").withColumns(dict(zip(("_ta", "_tb"), _name(), strict=True)))
    blank = ~F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    side = broadcast_if_small(kept.drop("_rows"), facts["n"])
    chosen = packed.filter(~blank).join(side, (F.col("_ta") == F.col("_a")) & (F.col("_tb") == F.col("_b")) & F.col("_id").eqNullSafe(F.col("_d")), "left_semi")
    if (facts["most"] or 0) > 1:
        chosen = chosen.dropDuplicates(["_id", "_ta", "_tb"])
    return chosen.select("_row.*").union(packed.filter(blank).select("_row.*"))
