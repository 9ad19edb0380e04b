"""Embedding near-dedup by cover trees and dual traversal: exact cosine-threshold links.

Equal vectors are one class. Classes are spread over cells by the nearest centre
of a net that is taken from a bounded sample, and a cell's classes over blocks
of a bounded size. Each block gets a cover tree: nested levels with halving
radii, and for each node the radius that really covers its members. Two cells, two
blocks, and two nodes of their trees, are compared further only if their centres are no
farther apart than both covering radii and the threshold's distance. What is
left is compared in double precision. Link counts leave a block pair as sums, and
links as spanning forests, so that a dense cluster's pairs are never written out.

Near cells make up groups of about equal bytes, large ones groups in parts. Each
pair of groups that the bounds leave is one task, so that a block is sent once for each
group that it is compared with, not for each block: groups are as many as the cores
ask for, or as their size in memory does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, map_arrow, skew_join

#: Classes that the cells' centres are chosen from, and how many cells there are at most.
SAMPLE, CELLS = 4096, 512
#: Bytes of a block's vectors, about, and its classes at least.
BLOCK_BYTES, BLOCK = 1 << 19, 64
#: Bytes of a group's vectors at most, about, and pairs of groups for each core at least.
GROUP_BYTES, PAIRS = 64 << 20, 3
#: Node pairs of at most so many member pairs are compared at once.
DIRECT = 1 << 16
SLACK = 1e-9


def unit_rows(vectors) -> np.ndarray:
    """Vectors of one length, as lists or an Arrow column of lists, as rows of length 1."""
    x = flat_values(vectors).reshape(len(vectors), -1) if isinstance(vectors, (pa.Array, pa.ChunkedArray)) else np.array(vectors, dtype=np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def flat_values(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.asarray(pc.list_flatten(vectors)).astype(np.float64, copy=False)


def net(x: np.ndarray, most: int) -> np.ndarray:
    """At most `most` rows of x by farthest-first choice: every prefix is a net of about halving radii."""
    chosen, near = [0], x @ x[0]
    while len(chosen) < min(most, len(x)):
        i = int(near.argmin())
        if near[i] >= 1 - SLACK:
            break
        chosen.append(i)
        near = np.maximum(near, x @ x[i])
    return x[chosen]


class Node:
    """Members lo..hi of the tree's order; centre: a position in it; radius: covers all members."""

    __slots__ = ("lo", "hi", "centre", "radius", "children")

    def __init__(self, lo: int, hi: int, centre: int, radius: float, children: list[Node]):
        self.lo, self.hi, self.centre, self.radius, self.children = lo, hi, centre, radius, children


def cover_tree(x: np.ndarray, least: float) -> tuple[np.ndarray, Node]:
    """An order of the rows of x, and the root over them. Levels' radii are 1, 1/2, 1/4 and so on down to about `least`."""
    order: list[int] = []
    all_ = np.sqrt(np.maximum(0.0, 2 - 2 * (x @ x.T))) if len(x) <= 2048 else None

    def distances(at: int, rest: np.ndarray) -> np.ndarray:
        return all_[at][rest] if all_ is not None else np.sqrt(np.maximum(0.0, 2 - 2 * (x[rest] @ x[at])))

    def build(members: np.ndarray, far: np.ndarray, radius: float) -> Node:
        """members[0] is the centre; far: distances from it."""
        lo = len(order)
        if len(members) == 1 or radius < least:
            order.extend(members.tolist())
            return Node(lo, len(order), lo, float(far.max()), [])
        children, rest = [], members
        while len(rest):
            d = distances(rest[0], rest)
            d[0] = 0.0
            inside = d <= radius
            children.append(build(rest[inside], d[inside], radius / 2))
            rest = rest[~inside]
        return Node(lo, len(order), lo, float(far.max()), children)

    everything = np.arange(len(x))
    d = distances(0, everything)
    d[0] = 0.0
    root = build(everything, d, 1.0)
    return np.array(order), root


def flat(root: Node) -> np.ndarray:
    """The tree as rows (lo, hi, centre, radius, number of children), parents before their children."""
    rows = []

    def add(node: Node) -> None:
        rows.append((node.lo, node.hi, node.centre, node.radius, len(node.children)))
        for c in node.children:
            add(c)

    add(root)
    return np.array(rows, dtype=np.float64)


def unflat(rows: np.ndarray) -> Node:
    at = 0

    def take() -> Node:
        nonlocal at
        lo, hi, centre, radius, n = rows[at]
        at += 1
        return Node(int(lo), int(hi), int(centre), float(radius), [take() for _ in range(int(n))])

    return take()


class Links:
    """Weighted link counts of two blocks' members, and a spanning forest of the links."""

    def __init__(self, x: np.ndarray, y: np.ndarray, wx: np.ndarray, wy: np.ndarray, same: bool, least: float):
        self.x, self.y, self.wx, self.wy, self.same, self.least = x, y, wx, wy, same, least
        self.nx, self.ny = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []  # (side and place) pairs; places of y follow those of x
        self.theta = math.sqrt(2 - 2 * least)

    def _star(self, rows: np.ndarray, cols: np.ndarray) -> None:
        members = np.concatenate([rows, cols if self.same else cols + len(self.x)])
        self.edges.append((np.full(len(members) - 1, members[0]), members[1:]))

    def all_pairs(self, a: Node, b: Node) -> None:
        self.nx[a.lo : a.hi] += int(self.wy[b.lo : b.hi].sum())
        if self.same:
            both = slice(max(a.lo, b.lo), min(a.hi, b.hi))  # a member isn't linked to itself
            if both.stop > both.start:
                self.nx[both] -= self.wy[both]
        else:
            self.ny[b.lo : b.hi] += int(self.wx[a.lo : a.hi].sum())
        self._star(np.arange(a.lo, a.hi), np.arange(b.lo, b.hi))

    def direct(self, a: Node, b: Node) -> None:
        step = max(1, DIRECT * 16 // (b.hi - b.lo))
        for lo in range(a.lo, a.hi, step):
            hi = min(a.hi, lo + step)
            hit = self.x[lo:hi] @ self.y[b.lo : b.hi].T >= self.least
            if self.same:
                own = np.arange(max(lo, b.lo), min(hi, b.hi))
                hit[own - lo, own - b.lo] = False
            if not hit.any():
                continue
            self.nx[lo:hi] += hit @ self.wy[b.lo : b.hi]
            if not self.same:
                self.ny[b.lo : b.hi] += self.wx[lo:hi] @ hit
            rows_left = hit.any(axis=1)
            while rows_left.any():
                rows = np.zeros(hi - lo, bool)
                rows[rows_left.argmax()] = True
                cols, new = np.zeros(b.hi - b.lo, bool), rows
                while new.any():
                    reached = hit[new].any(axis=0) & ~cols
                    cols |= reached
                    new = hit[:, reached].any(axis=1) & ~rows
                    rows |= new
                rows_left &= ~rows
                self._star(lo + np.flatnonzero(rows), b.lo + np.flatnonzero(cols))

    def run(self, a: Node, b: Node) -> None:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            pairs = (a.hi - a.lo) * (b.hi - b.lo)
            if pairs <= DIRECT or not (a.children or b.children):
                self.direct(a, b)
                continue
            left, right = a.children or [a], b.children or [b]
            todo += self.survivors(left, right)

    def survivors(self, left: list[Node], right: list[Node]) -> list[tuple[Node, Node]]:
        """Node pairs within reach; those that link as a whole are counted here, and single members compared."""
        out: list[tuple[Node, Node]] = []
        # nodes of radius 0, most of them in high dimensions, need no bound of their own; a few members are cheaper one by one than as a node with a wide bound
        left, right = self.opened(left), self.opened(right)
        for some in ([n for n in left if not n.radius], [n for n in left if n.radius]):
            for others in ([n for n in right if not n.radius], [n for n in right if n.radius]):
                if some and others:
                    self._survivors(some, others, out)
        return out

    @staticmethod
    def opened(nodes: list[Node], few: int = 16) -> list[Node]:
        """The nodes, small ones as their single members."""
        out = []
        for n in nodes:
            if n.radius and n.hi - n.lo <= few:
                out += [Node(i, i + 1, i, 0.0, []) for i in range(n.lo, n.hi)]
            else:
                out.append(n)
        return out

    def _survivors(self, left: list[Node], right: list[Node], out: list[tuple[Node, Node]]) -> None:
        cx, cy = self.x[[n.centre for n in left]], self.y[[n.centre for n in right]]
        fx, fy = cx.astype(np.float32), cy.astype(np.float32)
        rx, ry = np.array([n.radius for n in left], np.float32), np.array([n.radius for n in right], np.float32)
        plain = not left[0].radius and not right[0].radius
        for i in range(0, len(left), 512):
            near = fx[i : i + 512] @ fy.T
            if plain:
                ok = near >= np.float32(self.least - 1e-5)
            else:
                reach = rx[i : i + 512, None] + ry[None, :] + np.float32(self.theta)
                ok = near >= 1 - reach * reach / 2 - np.float32(1e-5)
            for p, q in zip(*np.nonzero(ok)):
                a, b = left[i + p], right[q]
                d = math.sqrt(max(0.0, 2 - 2 * float(cx[i + p] @ cy[q])))
                if d + a.radius + b.radius <= self.theta - 1e-7:
                    if not (self.same and a.lo == b.lo and a.hi - a.lo == 1 == b.hi - b.lo):
                        self.all_pairs(a, b)
                elif d <= a.radius + b.radius + self.theta + SLACK:
                    out.append((a, b))


def link_blocks(x: np.ndarray, y: np.ndarray, tx: Node, ty: Node, wx: np.ndarray, wy: np.ndarray, same: bool, least: float) -> Links:
    found = Links(x, y, wx, wy, same, least)
    apart = math.sqrt(max(0.0, 2 - 2 * float(x[tx.centre] @ y[ty.centre])))
    if same or apart <= tx.radius + ty.radius + found.theta + SLACK:
        found.run(tx, ty)
    return found


def valid(c: str):
    """Not null, not empty, all components present and finite, not all zero."""
    v = F.col(c)
    fine = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda e: e != 0)


def embedding_links(vectors: DataFrame, least: float = 0.95, sample: int = SAMPLE, block_bytes: int = BLOCK_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of vectors (vec_id, embedding).

    Vectors of equal length link at a cosine of at least `least`; equal vectors are one class whose
    copies count as links of each other. A vector that is null, empty, zero or has a null or non-finite component, or
    no vec_id, links with nothing; without a vec_id the component is null, and kept false. Rows with
    one vec_id are vectors of their own in n_links. An empty table gives an empty result.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).withColumn("ok", F.coalesce(valid("v") & F.col("vec_id").isNotNull(), F.lit(False)))
    plain = F.transform("v", lambda e: e + 0.0)  # -0.0 is 0.0
    keyed = rows.where("ok").select("vec_id", plain.alias("v")).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    classes = cut(keyed.groupBy("v", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    n = classes.count()
    keys = ["h1", "h2"]
    if n:
        counts, edges = class_links(classes, n, least, sample, block_bytes, group_bytes)
        roots = components(edges)
        named = cut(
            classes.drop("v")
            .join(counts.withColumnRenamed("h1", "h1_"), F.col("h1") == F.col("h1_"), "left")
            .join(roots, F.col("rep") == F.col("node"), "left")
            .select(*keys, "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
        )
    else:
        named = classes.select(*keys, "copies", F.lit(0).cast("long").alias("n_links"), F.col("rep").alias("component_id"))
    linked = skew_join(keyed.select("vec_id", *keys), named, keys, "copies").select("vec_id", "n_links", "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def in_order(centres: np.ndarray) -> list[int]:
    """The rows of centres, each the nearest to the one before that is left."""
    left, out = list(range(1, len(centres))), [0]
    while left:
        at = left.pop(int((centres[left] @ centres[out[-1]]).argmax()))
        out.append(at)
    return out


def class_links(classes: DataFrame, n: int, least: float, sample: int, block_bytes: int, group_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Link counts (h1, n), copies counted, and edges (a, b) that connect each component, between the n distinct vectors of classes."""
    spark = classes.sparkSession
    theta = math.sqrt(max(0.0, 2 - 2 * least))
    chosen = classes.orderBy(F.xxhash64("rep"), "rep", "h1").limit(sample).select("v").collect()
    by_size: dict[int, list] = {}
    for r in chosen:
        by_size.setdefault(len(r.v), []).append(r.v)
    block = lambda d: max(BLOCK, block_bytes // (8 * d))
    most = max(1, min(CELLS, math.ceil(n / block(max(by_size)))))
    centres = {d: net(unit_rows(vs), most) for d, vs in by_size.items()}
    first = dict(zip(centres, np.cumsum([0, *(len(c) for c in centres.values())])))
    held = spark.sparkContext.broadcast((centres, first))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, first = held.value
        for b in batches:
            cells, far = np.empty(b.num_rows, np.int64), np.zeros(b.num_rows)
            vs = b.column(0)
            sizes = pc.list_value_length(vs).to_numpy()
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                if d not in centres:  # a length that the sample has none of: a cell of its own without a bound
                    cells[at], far[at] = -d, 2.0
                    continue
                near = unit_rows(vs.take(pa.array(at))) @ centres[d].T
                best = near.argmax(axis=1)
                cells[at] = first[d] + best
                far[at] = np.sqrt(np.maximum(0.0, 2 - 2 * near[np.arange(len(at)), best]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells), pa.array(far)], names=["v", "rep", "copies", "h1", "cell", "far"])

    placed = cut(map_arrow(classes.select("v", "rep", "copies", "h1"), place, "v array<double>, rep long, copies long, h1 long, cell long, far double"))
    # one row for each cell: at most CELLS for each vector length
    cells = {r.cell: (r.n, r.far) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}
    at = {first[d] + i: (d, v) for d, cs in centres.items() for i, v in enumerate(cs)}
    size_of = {c: at[c][0] if c >= 0 else -c for c in cells}
    parts = {c: math.ceil(k / block(size_of[c])) for c, (k, _) in cells.items()}
    # groups: near cells together, up to a share of all bytes; a larger cell is a group in parts
    weight = {c: 8 * size_of[c] * k for c, (k, _) in cells.items()}
    share = min(group_bytes, max(1, sum(weight.values()) / math.ceil(math.sqrt(2 * PAIRS * spark.sparkContext.defaultParallelism))))
    groups: list[list[int]] = []
    for d, cs in centres.items():
        held = math.inf
        for c in (int(first[d]) + i for i in in_order(cs)):
            if c in cells:
                if held + weight[c] > share:
                    groups.append([])
                    held = 0
                groups[-1].append(c)
                held += weight[c]
    groups += [[c] for c in cells if c < 0]
    in_parts = [math.ceil(sum(weight[c] for c in g) / share) for g in groups]

    def near(a: int, b: int) -> bool:
        if a == b:
            return True
        if size_of[a] != size_of[b] or a < 0 or b < 0:
            return False
        apart = math.sqrt(max(0.0, 2 - 2 * float(at[a][1] @ at[b][1])))
        return apart <= cells[a][1] + cells[b][1] + theta + SLACK

    pairs = [(i, j, in_parts[i], in_parts[j]) for i, g in enumerate(groups) for j, h in enumerate(groups) if i <= j and any(near(a, b) for a in g for b in h)]
    # at most one row for each pair of cells
    table = F.broadcast(spark.createDataFrame(pairs, "a int, b int, parts_a int, parts_b int"))
    known = spark.createDataFrame([(c, parts[c], i, in_parts[i]) for i, g in enumerate(groups) for c in g], "cell long, parts int, grp int, in_parts int")
    sized = placed.join(F.broadcast(known), "cell").withColumn("part", F.pmod(F.xxhash64("rep", "h1"), F.col("parts")).cast("int"))

    def grow(t: pa.Table) -> pa.Table:
        x = unit_rows(t.column("v"))
        order, root = cover_tree(x, theta / 4)
        ids, copies, keys = (t.column(c).to_numpy()[order] for c in ("rep", "copies", "h1"))
        row = [t.column("grp")[0].as_py(), t.column("in_parts")[0].as_py(), t.column("cell")[0].as_py(), t.column("part")[0].as_py(), x[order].tobytes(), ids.tobytes(), copies.tobytes(), keys.tobytes(), flat(root).tobytes()]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5]
        return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["grp", "in_parts", "cell", "part", "x", "ids", "copies", "keys", "tree"])

    grown = sized.select("cell", "part", "grp", "in_parts", "v", "rep", "copies", "h1").groupBy("cell", "part").applyInArrow(grow, "grp int, in_parts int, cell long, part int, x binary, ids binary, copies binary, keys binary, tree binary")
    blocks = cut(grown.withColumn("own", F.pmod(F.xxhash64("cell", "part"), F.col("in_parts")).cast("int")))
    payload = ["cell", "part", "x", "ids", "copies", "keys", "tree"]
    # every pair of groups' parts once: the first of it is side 0, and a pair of one with itself has that alone
    sides = [
        blocks.join(table, F.col("grp") == F.col("a")).select("a", F.col("own").alias("p"), "b", F.explode(F.sequence(F.lit(0), F.col("parts_b") - 1)).alias("q"), F.lit(0).alias("side"), *payload).where("a < b or p <= q"),
        blocks.join(table, F.col("grp") == F.col("b")).select("a", F.explode(F.sequence(F.lit(0), F.col("parts_a") - 1)).alias("p"), "b", F.col("own").alias("q"), F.lit(1).alias("side"), *payload).where("a < b or p < q"),
    ]
    joined = sides[0].unionByName(sides[1]).repartition(max(1, min(100_000, sum(x * y for *_, x, y in pairs))), "a", "p", "b", "q").sortWithinPartitions("a", "p", "b", "q", "side", "cell", "part")

    def read(b: pa.RecordBatch, i: int) -> tuple:
        x, ids, copies, keys, tree = (np.frombuffer(b.column(j)[i].as_py(), t) for j, t in ((7, np.float64), (8, np.int64), (9, np.int64), (10, np.int64), (11, np.float64)))
        return x.reshape(len(ids), -1), unflat(tree.reshape(-1, 5)), ids, copies, keys

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, held, alone = None, [], True
        counts: list[tuple[np.ndarray, np.ndarray]] = []
        edges: list[np.ndarray] = []

        def compare(one: tuple, two: tuple, same: bool) -> None:
            if one[0].shape[1] != two[0].shape[1]:
                return
            found = link_blocks(one[0], two[0], one[1], two[1], one[3], two[3], same, least)
            for keys, k in ((one[4], found.nx), *(() if same else ((two[4], found.ny),))):
                some = np.flatnonzero(k)
                if len(some):
                    counts.append((keys[some], k[some]))
            if found.edges:
                ids = one[2] if same else np.concatenate([one[2], two[2]])
                edges.append(np.unique(ids[np.stack([np.concatenate(e) for e in zip(*found.edges)], axis=1)], axis=0))

        def flush() -> pa.RecordBatch:
            k, c = (np.concatenate(x) for x in zip(*counts)) if counts else (np.empty(0, np.int64),) * 2
            e = np.concatenate(edges) if edges else np.empty((0, 2), np.int64)
            counts.clear()
            edges.clear()
            key, turned = np.unique(k, return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, turned, c)
            none = np.arange(len(key) + len(e)) < len(key)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([key, e[:, 0]])), pa.array(np.concatenate([np.zeros(len(key), np.int64), e[:, 1]]), mask=none), pa.array(np.concatenate([total, np.zeros(len(e), np.int64)]), mask=~none)], names=["a", "b", "n"])

        for b in batches:
            for i in range(b.num_rows):
                now = tuple(b.column(j)[i].as_py() for j in range(4))
                if now != pair:
                    pair, held, alone = now, [], now[0] == now[2] and now[1] == now[3]
                new = read(b, i)
                for old in held:
                    if alone or b.column(4)[i].as_py() == 1:
                        compare(old, new, False)
                if alone:
                    compare(new, new, True)
                if b.column(4)[i].as_py() == 0:
                    held.append(new)
                if sum(map(len, edges)) > 100_000 or len(counts) > 5000:
                    yield flush()
        yield flush()

    found = cut(map_arrow(joined, traverse, "a long, b long, n long"))
    return found.where("n is not null").groupBy(F.col("a").alias("h1")).agg(F.sum("n").alias("n")), found.where("n is null").select("a", "b")


def op1_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """A null, zero or non-finite vector links with nothing; see embedding_links."""
    return embedding_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLES = {
    "op1_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS len FROM v WHERE list_dot_product(e, e) > 0),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.len * b.len) >= 0.95),
reach(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.x, p.y FROM reach JOIN p ON reach.y = p.x),
c AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x),
k AS (SELECT x AS vec_id, count(*) AS n FROM p GROUP BY x)
SELECT c.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN k USING (vec_id)"""
}
