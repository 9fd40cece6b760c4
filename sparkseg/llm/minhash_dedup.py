"""Near-duplicates by chosen-path set similarity join.

Texts become sets of word shingles; texts with equal sets are one class from then on.  In each of
`trees` independent trees a class goes to the child of its least shingle under the tree's own order.
A node of at most `leaf` classes is compared exhaustively by 128 minwise bytes, and so is a larger one
if that takes no more comparisons a class (as in a group of near copies); else it branches again by a
minwise token that its path selects, and by a second one often enough that similar sets stay together
in 1 / similarity children on average.  At some depths (COPIES) it branches several times,
independently, so that losses do not add up with the depth.  A node only names a spanning forest of
what it finds similar: joined over nodes, forests connect just what all the pairs would.  The clusters that
result are supersets of the wanted ones, and each is then settled on full shingle sets.

A node above leaf with more than 1 / HOT_SHARE of all rows is looked at where its rows lie (`_families`): if
it is one family of near copies and few others, it is settled by comparing its rows with some of them and with
the others, and never gathered.  If what is left exceeds what a task can hold, it branches in place too.

At a similarity s of s0 or more, a pair misses all the trees' first nodes with (1 - s0) ** trees
(6e-9 at 0.85 and 10, 1e-7 at 0.8), and fails the byte comparison at five standard deviations (3e-7).
With up to 12 branchings above leaf it meets in no node with 1e-8 at 0.85 and 3e-7 at 0.8 (`missed`).
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .frames import cut, drop_cut, partitions, row_key
from .textkernel import U64, blocks, gram_hashes, mix, span_hashes, text_bytes, tidy

TREES, LEAF, BYTES, DEPTH = 10, 1000, 128, 12
#: How many times a node above leaf branches, by its depth; once beyond.
COPIES = (4, 2, 1, 2, 1, 1, 2)
CLUSTER_SHINGLES = 4_000_000
#: At most so many nodes can each have more than 1 / HOT_SHARE of a level's rows, so at most 20,000 keys are broadcast.
HOT_SHARE = 20_000
#: Rows that travel with every task, 150 bytes each: pivots of hot nodes, and rows beside the families in them.
PIVOTS, REST = 40_000, 100_000
#: Rows that are compared with one, or branch, at once; rows of a node that are held before it branches untried.
_ROWS, _HELD = 1 << 14, 1 << 17
_SEED = np.random.Generator(np.random.PCG64(71)).integers(1, 2**63, 65 + 2 * BYTES, dtype=np.int64).astype(U64)


def shingles(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text of a block, ascending, and where each text's begin."""
    sizes = np.diff(offsets)
    counts = np.maximum(0, sizes - k + 1)
    at = np.repeat(offsets[:-1], counts) + (np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts))
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    value = np.concatenate([gram_hashes(words, k)[at], span_hashes(words, offsets[short], offsets[short + 1])])
    row = np.concatenate([np.repeat(np.arange(len(sizes)), counts), short])
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[new], np.searchsorted(row[new], np.arange(len(sizes) + 1))


_SIGNATURE = "id {}, k1 long, k2 long, n long, set1 long, set2 long, keys array<long>, sketch binary"


def _signatures(k: int, trees: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(x).to_numpy() for x in ("k1", "k2"))
            for block in blocks(batch.column("body"), lower=True):
                value, offsets = shingles(block.words, block.offsets, k)
                n = np.diff(offsets)
                full = np.flatnonzero(n)
                set1, set2 = np.zeros((2, len(block)), dtype=U64)
                keys = np.zeros((len(block), trees), dtype=U64)
                sketch = np.zeros((len(block), BYTES), dtype=np.uint8)
                if len(full):
                    at = offsets[full]
                    set1[full] = mix(np.add.reduceat(mix(value ^ _SEED[63]), at) + n[full].astype(U64))
                    set2[full] = mix(np.add.reduceat(mix(value ^ _SEED[64 + 2 * BYTES]), at))
                    for t in range(trees):
                        keys[full, t] = mix(np.minimum.reduceat((value ^ _SEED[t]) * (_SEED[t + 31] | U64(1)), at) + U64(t))
                    small = (value >> U64(32)).astype(np.uint32)
                    for c in range(BYTES):
                        a, b = np.uint32(_SEED[64 + c] >> U64(31)), np.uint32(_SEED[64 + BYTES + c] >> U64(31)) | np.uint32(1)
                        least = np.minimum.reduceat((small ^ a) * b, at)
                        sketch[full, c] = (least * np.uint32(0x9E3779B1)) >> np.uint32(24)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(block.first, len(block)), pa.array(k1[block.first : block.first + len(block)]), pa.array(k2[block.first : block.first + len(block)]), pa.array(n), pa.array(set1.view(np.int64)), pa.array(set2.view(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(len(block) + 1, dtype=np.int32) * trees), pa.array(keys.reshape(-1).view(np.int64))), pa.array([x.tobytes() for x in sketch], pa.binary())],
                    names=["id", "k1", "k2", "n", "set1", "set2", "keys", "sketch"],
                )

    return run


def _forest(node: np.ndarray, sketch: np.ndarray, least: int, work: float = np.inf) -> tuple[list, list] | None:
    """Edges of a spanning forest of what agrees in at least `least` bytes; None if that takes more than `work` comparisons."""
    left, a, b, todo = np.arange(len(node)), [], [], []
    while len(left):
        if not todo:
            todo, left = [left[0]], left[1:]
        p = todo.pop()
        work -= len(left)
        if work < 0:
            return None
        near = np.concatenate([(sketch[left[i : i + _ROWS]] == sketch[p]).sum(1) >= least for i in range(0, max(1, len(left)), _ROWS)])
        found = left[near]
        a += [node[p]] * len(found)
        b += node[found].tolist()
        todo += found.tolist()
        left = left[~near]
    return a, b


def missed(similarity: float, trees: int, depth: int) -> float:
    """How likely a pair of that similarity, which passes the byte comparison, meets in no tree after `depth` branchings."""
    least, total = _least(similarity), 0.0
    for same in range(least, BYTES + 1):
        p, lost = same / BYTES, 0.0
        for level in reversed(range(depth)):
            lost = ((1 - p * (1 - lost)) * (1 - (1 / similarity - 1) * p * (1 - lost))) ** _copies(level)
        total += comb(BYTES, same) * similarity**same * (1 - similarity) ** (BYTES - same) * (1 - similarity * (1 - lost)) ** trees
    return total


def _copies(level: int) -> int:
    return COPIES[level] if level < len(COPIES) else 1


def _least(similarity: float) -> int:
    """Bytes that must agree: five standard deviations below the mean."""
    return int(BYTES * similarity - 5 * np.sqrt(BYTES * similarity * (1 - similarity)))


def _children(key: np.ndarray, sketch: np.ndarray, similarity: float, copy: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Child keys, and the row of each: one selected token, and a second in 1 / similarity - 1 of the nodes; others for each copy."""
    key = mix(key.view(U64) + U64(copy) * _SEED[62]) if copy else key.view(U64)
    rows, keys = [], []
    second = mix(key ^ _SEED[60]) >> U64(11)
    for j, chosen in enumerate((np.arange(len(key)), np.flatnonzero(second < U64(int((1 / similarity - 1) * 2**53))))):
        place = (mix(key[chosen] + U64(j + 1)) % U64(BYTES)).astype(np.int64)
        rows.append(chosen)
        keys.append(mix(key[chosen] ^ mix((place * 256 + sketch[chosen, place]).astype(U64) + _SEED[61])))
    return np.concatenate(keys).view(np.int64), np.concatenate(rows)


_STEP = "key long, node long, sketch binary, other long"


def _matrix(sketches: pa.ChunkedArray | pa.Array) -> np.ndarray:
    chunks = sketches.chunks if isinstance(sketches, pa.ChunkedArray) else [sketches]
    return np.concatenate([text_bytes(x)[0].reshape(-1, BYTES) for x in chunks])


class _Sample:
    """Rows of some nodes, by key: at most a stated number, so that they can travel with every task."""

    def __init__(self, rows: pa.Table):
        order = np.argsort(rows.column("key").to_numpy(), kind="stable")
        self.keys, self.node = rows.column("key").to_numpy()[order], rows.column("node").to_numpy()[order]
        self.sketch = _matrix(rows.column("sketch"))[order] if len(order) else np.zeros((0, BYTES), np.uint8)

    def met(self, batch: pa.RecordBatch, least: int) -> Iterator[tuple[np.ndarray, slice, np.ndarray]]:
        """For each key of a batch that the sample has: its rows in the batch, its rows here, and which of them agree in `least` bytes."""
        keys, sketch = batch.column("key").to_numpy(), _matrix(batch.column("sketch")) if batch.num_rows else np.zeros((0, BYTES), np.uint8)
        for key in np.unique(keys):
            here = slice(*np.searchsorted(self.keys, [key, key + 1]).tolist()) if key < 2**63 - 1 else slice(int(np.searchsorted(self.keys, key)), len(self.keys))
            if here.start < here.stop:
                mine = np.flatnonzero(keys == key)
                yield mine, here, np.stack([(sketch[mine] == one).sum(1) >= least for one in self.sketch[here]], axis=1)


_NEAR = "key long, node long, sketch binary, pivot long, other long"


def _to_pivots(pivots: _Sample, least: int):
    """Rows with the first pivot that each has an edge to, if any; and pairs of pivots (node, other; no key) that some row has edges to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, pairs = np.full(batch.num_rows, -1, np.int64), set()
            for mine, here, edge in pivots.met(batch, least):
                some = edge.any(1)
                first[mine[some]] = here.start + edge[some].argmax(1)
                for pattern in np.unique(edge[edge.sum(1) > 1], axis=0):
                    both = pivots.node[here][pattern].tolist()
                    pairs |= set(zip(both[:-1], both[1:], strict=True))
            known = np.concatenate([pivots.node, [0]])[first]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("node"), batch.column("sketch"), pa.array(known, mask=first < 0), pa.nulls(len(first), pa.int64())], names=["key", "node", "sketch", "pivot", "other"])
            if pairs:
                a, b = zip(*sorted(pairs), strict=True)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a, pa.int64()), pa.nulls(len(a), pa.binary()), pa.nulls(len(a), pa.int64()), pa.array(b, pa.int64())], names=["key", "node", "sketch", "pivot", "other"])

    return run


def _to_rest(rest: _Sample, least: int):
    """Of each batch, one edge for every row of the rest that has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, a, b = batch.column("node").to_numpy(), [], []
            for mine, here, edge in rest.met(batch, least):
                some = np.flatnonzero(edge.any(0))
                a += rest.node[here][some].tolist()
                b += node[mine[edge[:, some].argmax(0)]].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _branched(similarity: float, copies: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                for copy in range(copies):
                    keys, rows = _children(part.column("key").to_numpy(), _matrix(part.column("sketch")), similarity, copy)
                    out = part.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(keys), out.column("node"), out.column("sketch")], names=["key", "node", "sketch"])

    return run


def _hot_keys(rows: DataFrame, least: int, total: int, share: int) -> DataFrame | None:
    """Keys of more than `least` rows and more than 1 / share of them all, at most `share` by that, to be broadcast; None if there are none."""
    counts = cut(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > max(least, total // share)).select("key"))
    return None if counts.isEmpty() else F.broadcast(counts)


def _families(rows: DataFrame, leaf: int, least: int, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without the families of near copies that fill hot nodes, and the edges that hold each family together and to the rest.

    Some rows of each node are pivots (PIVOTS in all at most, by count).  Rows with an edge to one pivot are
    connected, and so are pivots with a row in common.  Where all rows but at most `leaf` are connected so, in
    one family, these others travel to the family's rows (REST in all at most), are compared with every one of
    them where it lies, and stay in the node to be compared with each other.  Other nodes keep all their rows.
    """
    mine = cut(rows.join(keys, "key", "left_semi"))
    sizes = mine.groupBy("key").agg(F.count("*").alias("n"))  # at most HOT_SHARE
    each = max(1, min(64, PIVOTS // max(1, sizes.count())))
    pivots = _Sample(mine.join(F.broadcast(sizes), "key").where(F.pmod(F.xxhash64("node"), F.col("n")) < each).select("key", "node", "sketch").toArrow())
    near = cut(mine.mapInArrow(_to_pivots(pivots, least), _NEAR))
    drop_cut(mine)
    root = {int(x): int(x) for x in pivots.node}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    pairs = near.where("key is null").select("node", "other").distinct()
    for a, b in pairs.toArrow().to_pandas().itertuples(index=False):
        root[find(a)] = find(b)
    counts = near.where("key is not null").groupBy("key", "pivot").agg(F.count("*").alias("n")).toArrow().to_pydict()  # a row for each pivot and key
    total: dict[int, int] = {}
    family: dict[tuple[int, int], int] = {}
    for key, pivot, n in zip(counts["key"], counts["pivot"], counts["n"], strict=True):
        total[key] = total.get(key, 0) + n
        if pivot is not None:
            family[key, find(pivot)] = family.get((key, find(pivot)), 0) + n
    largest: dict[int, tuple[int, int]] = {}
    for (key, one), n in family.items():
        largest[key] = max(largest.get(key, (0, 0)), (n, one))
    settled, room = {}, REST
    for others, key in sorted((total[key] - n, key) for key, (n, _) in largest.items()):
        if others > leaf or others > room:
            break
        settled[key] = largest[key][1]
        room -= others
    members = [(key, pivot) for key, pivot in zip(counts["key"], counts["pivot"], strict=True) if pivot is not None and settled.get(key) == find(pivot)]
    spark = rows.sparkSession
    members = F.broadcast(spark.createDataFrame(members, "key long, pivot long"))
    done = F.broadcast(spark.createDataFrame([(key,) for key in settled], "key long"))
    placed = near.where("key is not null").join(done, "key", "left_semi")
    rest = cut(placed.join(members, ["key", "pivot"], "left_anti").select("key", "node", "sketch"))
    to_rest = placed.join(members, ["key", "pivot"], "left_semi").select("key", "node", "sketch").mapInArrow(_to_rest(_Sample(rest.toArrow()), least), "a long, b long")
    edges = near.where("key is not null and pivot is not null and node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).unionAll(near.where("key is null").select("node", "other")).unionAll(to_rest)
    return rows.join(done, "key", "left_anti").unionAll(rest), edges


def _compare(leaf: int, least: int, similarity: float, last: bool, copies: int = 1):
    """Rows in the order of keys.  Nodes of up to leaf rows, all at the last depth, and those whose forest takes at most leaf comparisons a row give edges (other is set); others give rows of their children."""

    def edges(a: list, b: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a, pa.int64()), pa.nulls(len(a), pa.binary()), pa.array(b, pa.int64())], names=["key", "node", "sketch", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        have, last_key, branched = 0, None, False

        def settle(a_out: list, b_out: list) -> Iterator[pa.RecordBatch]:
            """Compares the rows that are held, one node, or branches if that were dearer than in leaves."""
            nonlocal held, have
            found = None
            if have > 1 and not branched:
                table = pa.concat_tables(held)
                found = _forest(table.column("node").to_numpy(), _matrix(table.column("sketch")), least, np.inf if last or have <= leaf else leaf * have)
            if found:
                a_out += found[0]
                b_out += found[1]
            elif have and (branched or have > leaf):
                yield from branch()
            held, have = [], 0

        def branch() -> Iterator[pa.RecordBatch]:
            nonlocal held, have
            table = pa.concat_tables(held)
            held, have = [], 0
            for at in range(0, table.num_rows, _ROWS):
                part = table.slice(at, _ROWS)
                for copy in range(copies):
                    yield children(part, *_children(part.column("key").to_numpy(), _matrix(part.column("sketch")), similarity, copy))

        def children(table: pa.Table, keys: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
            out = table.take(pa.array(rows))
            return pa.RecordBatch.from_arrays([pa.array(keys), out.column("node").combine_chunks(), out.column("sketch").combine_chunks(), pa.nulls(len(rows), pa.int64())], names=["key", "node", "sketch", "other"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table, key = pa.Table.from_batches([batch]), batch.column("key").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            a, b = [], []
            for at, to in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if key[at] != last_key:
                    yield from settle(a, b)
                    last_key, branched = key[at], False
                    if to - at == 1 and to < len(key):  # most nodes hold one class
                        last_key = None
                        continue
                held.append(table.slice(at, to - at))
                have += to - at
                if have > max(leaf, _HELD) and not last:
                    branched = True
                    yield from branch()
            if a:
                yield edges(a, b)
        a, b = [], []
        yield from settle(a, b)
        if a:
            yield edges(a, b)

    return run


def _sets(table: pa.Table, k: int) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for block in blocks(table.column("body"), lower=True):
        value, offsets = shingles(block.words, block.offsets, k)
        out += np.split(value, offsets[1:-1])
    return out


def shared(one: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many members each set has in common with one."""
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    return np.add.reduceat(one[at] == flat, starts, dtype=np.int64)


def linked(one: np.ndarray, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ratio: Fraction) -> np.ndarray:
    """Which sets have ratio or more of intersection size to union size with one."""
    both = shared(one, flat, starts)
    return ratio.denominator * both >= ratio.numerator * (sizes + len(one) - both)


def exact_forest(sets: list[np.ndarray], ratio: Fraction, todo: list[int] | None = None) -> np.ndarray:
    """The root of each set's component, by exhaustive comparison of what isn't connected yet."""
    root = np.arange(len(sets))
    sizes = np.array([len(x) for x in sets])
    left = np.argsort(sizes, kind="stable")
    while len(left):
        first = left[0] if todo is None or not len(todo) else todo.pop()
        left = left[left != first]
        queue, members = [first], [first]
        while queue and len(left):
            p = queue.pop()
            lo, hi = np.searchsorted(sizes[left], [-(-sizes[p] * ratio.numerator // ratio.denominator), sizes[p] * ratio.denominator // ratio.numerator + 1])
            near = left[lo:hi]
            if not len(near):
                continue
            starts = np.cumsum(sizes[near]) - sizes[near]
            found = near[linked(sets[p], np.concatenate([sets[i] for i in near]), starts, sizes[near], ratio)]
            queue += found.tolist()
            members += found.tolist()
            left = left[~np.isin(left, found)]
        root[members] = first
    return root


def _settle(k: int, ratio: Fraction):
    """Rows in the order of cluster, block, node: one cluster (or block of one) after another; (cluster, node, root, apart) out, apart being the distance from the lead."""

    def group(rows: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(rows)
        node = table.column("node").to_numpy()
        once = np.concatenate([[True], node[1:] != node[:-1]])  # equal rows of the input share a key
        table, node = table.filter(pa.array(once)), node[once]
        lead = np.flatnonzero(table.column("lead").to_numpy(zero_copy_only=False)).tolist()
        sets = _sets(table, k)
        apart = np.zeros(len(sets))
        if lead and table.column("parts")[0].as_py() > 1:
            sizes, flat = np.array([len(x) for x in sets]), np.concatenate(sets)
            both = shared(sets[lead[0]], flat, np.cumsum(sizes) - sizes)
            apart = 1 - both / (sizes + len(sets[lead[0]]) - both)
        root = exact_forest(sets, ratio, lead)
        return pa.RecordBatch.from_arrays([table.column("cluster").combine_chunks(), pa.array(node), pa.array(node[root]), pa.array(apart)], names=["cluster", "node", "root", "apart"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            ids = np.stack([batch.column("cluster").to_numpy(), batch.column("block").to_numpy()])
            cuts = np.concatenate([[0], np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1, [batch.num_rows]])
            for at, to in zip(cuts[:-1], cuts[1:], strict=True):
                if last is not None and tuple(ids[:, at]) != last:
                    yield group(held)
                    held = []
                last = tuple(ids[:, at])
                held.append(table.slice(at, to - at))
        if held:
            yield group(held)

    return run


def _cross(k: int, ratio: Fraction):
    """Compares the rows that belong to no block's lead (query) with one block: edges out."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        asked = table.column("query").to_numpy(zero_copy_only=False)
        node, sets = table.column("node").to_numpy(), _sets(table, k)
        rows, a, b = np.flatnonzero(~asked), [], []
        if len(rows):
            sizes = np.array([len(sets[i]) for i in rows])
            starts, flat = np.cumsum(sizes) - sizes, np.concatenate([sets[i] for i in rows])
            for q in np.flatnonzero(asked):
                found = node[rows[linked(sets[q], flat, starts, sizes, ratio)]]
                a += [node[q]] * len(found)
                b += found.tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _settled(members: DataFrame, k: int, ratio: Fraction, most: int) -> DataFrame:
    """(cluster, node, n, body) in; (node, root) out.

    A cluster of more than `most` shingles is dealt into blocks that all hold its lead, the least node.  What
    a block doesn't connect to the lead is compared with every block, in as many shares as its shingles fill,
    but only with what isn't so near the lead that a link is impossible: Jaccard distances obey the triangle
    inequality.  The edges are joined up.
    """
    spark, n = members.sparkSession, partitions(members.sparkSession)
    sizes = members.select("cluster", "node", "n").groupBy("cluster").agg(F.sum("n").alias("total"), F.min("node").alias("first"))
    dealt = members.join(sizes.select("cluster", "first", F.ceil(F.col("total") / most).alias("parts")), "cluster")
    dealt = dealt.select("cluster", "node", "n", "body", "parts", (F.col("node") == F.col("first")).alias("lead"))
    own = dealt.select("cluster", F.when(F.col("lead"), F.lit(0)).otherwise(F.pmod(F.xxhash64("node"), "parts")).alias("block"), "node", "lead", "body", "parts", "n")
    more = dealt.where("lead and parts > 1").select("cluster", F.explode(F.sequence(F.lit(1), F.col("parts") - 1)).alias("block"), "node", "lead", "body", "parts", "n")
    deal = lambda df: df.repartition(n, "cluster", "block").sortWithinPartitions("cluster", "block", "node").select("cluster", F.col("block").cast("long").alias("block"), "node", "lead", "body", "parts")
    found = cut(deal(own.unionAll(more)).mapInArrow(_settle(k, ratio), "cluster long, node long, root long, apart double"))
    big = sizes.where(F.col("total") > most).select("cluster", "first")
    if big.isEmpty():
        return found.select("node", "root")
    own = own.where("parts > 1")
    inside = found.join(big, "cluster")
    apart = inside.groupBy("cluster", "node").agg(F.max(F.col("root") != F.col("first")).alias("odd"), F.max("apart").alias("apart"))
    own = own.join(apart, ["cluster", "node"])
    need = own.where("odd").groupBy("cluster").agg(F.min("apart").alias("odd_apart"), F.ceil(F.sum("n") / most).cast("int").alias("shares"))
    own = own.join(need, "cluster")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count).cast("int") - 1))
    asked = own.where("odd").select("cluster", every("parts").alias("block"), F.pmod(F.xxhash64("node"), "shares").cast("int").alias("share"), "node", F.lit(True).alias("query"), "body")
    rows = own.where(F.col("apart") >= F.col("odd_apart") - (1 - float(ratio)) - 1e-9).select("cluster", F.col("block").cast("int").alias("block"), every("shares").alias("share"), "node", F.lit(False).alias("query"), "body")
    pairs = asked.unionAll(rows).groupBy("cluster", "block", "share").applyInArrow(_cross(k, ratio), "a long, b long")
    whole = connected_components(pairs.unionAll(inside.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    return found.join(big, "cluster", "left_anti").select("node", "root").unionAll(whole.select("node", F.col("component").alias("root")))


def minhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: Fraction = Fraction(4, 5), k: int = 5, trees: int = TREES, leaf: int = LEAF, depth: int = DEPTH, cluster_shingles: int = CLUSTER_SHINGLES, hot_share: int = HOT_SHARE, held: int = _HELD) -> DataFrame:
    """Links texts whose sets of k-word shingles (A-Z lower-cased) have the similarity or more, and names their components.

    Returns the id, n_shingles, component_id (the least id that links reach, itself included) and kept.
    With fewer than k words the whole sequence is the one shingle; without words, or with a null text, the
    set is empty and linked with nothing.  Rows with equal sets (by 128 bits of hash and size) are one class, so repeated rows share a
    component; equal ids of different texts are different nodes.  A null id takes part in links but names no
    component: where all ids are null, component_id is null, and a row with a null id is never kept.
    Other columns are not read.
    """
    spark, n = docs.sparkSession, partitions(docs.sparkSession)
    least = _least(float(similarity))
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"))
    keyed = base.select("id", "body", *row_key("id", "body"))
    signed = cut(keyed.mapInArrow(_signatures(k, trees), _SIGNATURE.format(base.schema["id"].dataType.simpleString())))
    of_set = ["n", "set1", "set2"]
    classes = signed.where("n > 0").groupBy(*of_set).agg(F.min("id").alias("least"), F.min(F.struct("k1", "k2")).alias("one"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))  # numbers that can't collide, fixed by the table
    rows = classes.select(F.explode("keys").alias("key"), "node", "sketch")
    done: list[DataFrame] = []
    edges = None
    for level in range(depth + 1):
        found, spread, copies = None, None, _copies(level)
        total = rows.count()
        if (not level or total > held) and (keys := _hot_keys(rows, leaf, total, hot_share)) is not None:
            rows, found = _families(rows, leaf, least, keys)
        if level < depth and total > held and (keys := _hot_keys(rows, held, total, hot_share)) is not None:
            spread = cut(rows.join(keys, "key", "left_semi").mapInArrow(_branched(float(similarity), copies), "key long, node long, sketch binary"))
            rows = rows.join(keys, "key", "left_anti")
        out = cut(rows.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_compare(leaf, least, float(similarity), level == depth, copies), _STEP))
        done += [x for x in (out, spread) if x is not None]
        for one in (found, out.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))):
            edges = edges if one is None else one if edges is None else edges.unionAll(one)
        rows = out.where("other is null").select("key", "node", "sketch")
        if spread is not None:
            rows = rows.unionAll(spread)
        if rows.isEmpty():
            break
    clusters = connected_components(edges)
    drop_cut(*done)
    members = classes.join(clusters, "node").select(F.col("component").alias("cluster"), "node", "n", "one.k1", "one.k2")
    settled = _settled(members.join(keyed.where("body is not null").select("k1", "k2", "body"), ["k1", "k2"]), k, similarity, cluster_shingles)
    named = classes.select("node", "least", *of_set).join(settled, "node", "left").select("least", *of_set, F.coalesce("root", "node").alias("root"))
    named = named.select("root", *of_set).join(named.groupBy("root").agg(F.min("least").alias("component")), "root").select("component", *of_set)
    out = signed.select("id", *of_set).join(named, of_set, "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), similarity=Fraction(85, 100))


ORACLE_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: hash(array_to_string(words[i:i+4], ' '))) WHEN len(words) > 0 THEN [hash(array_to_string(words, ' '))] ELSE [] END) AS h FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
u AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, u.b FROM r JOIN u ON u.a = r.c)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.c AS component_id, c.c = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) c USING (doc_id)
"""
