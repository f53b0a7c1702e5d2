"""Exact k-nearest-neighbour join (euclidean) over a metric tree instead of all pairs.

Members are parted around pivots, and every part again, until a leaf holds at most ``BLOCK_ROWS`` vectors; a node knows how far its members lie from its
pivot. A query searches its own leaf first, which bounds its k-th distance; by the triangle inequality only nodes that reach into that bound are entered.
The nearest of the leaves that remain are searched next, the others only if the better bound still lets them in. Equal vectors are searched once; a leaf
that cannot be parted, and the queries of a leaf, are cut in blocks, so a dense place or a vector repeated by a third of the rows spreads over many tasks.

Where bounds prune little (many dimensions), the leaves that remain are searched in packs: queries and members are stored once, thousands to a row, and every block
of queries meets the packs it has to see one after the other, with the best so far as its bound. So neither copies of vectors nor lists of leaves are written for every
pair of blocks, and what is stored grows with the rows. Inside a block a matrix product finds the pairs that may be near enough, with its rounding error allowed for, and
only their distances are taken.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.runtime import attach_lookup, cut_lineage, small_batches

#: Members of a leaf, pivots of a node, levels of a tree, leaves that are searched together after the own one.
BLOCK_ROWS, FAN, MAX_LEVELS, NEXT_LEAVES = 2000, 32, 12, 4
#: Leaves of a query, on average, beyond which they are searched in packs of ``PACK`` times ``BLOCK_ROWS`` members.
MANY_LEAVES, PACK = 8, 4
#: Bytes of the vectors in a stored block, of the members that a task keeps beside its queries, and tasks for each core.
STORED_BYTES, HELD_BYTES, TASKS = 8 << 20, 64 << 20, 4
#: Distances of a step inside a block, and queries whose leaves are listed together.
STEP, LISTED = 1 << 20, 1000
#: Bytes of pivots that are broadcast. A tree stops growing there; its leaves are then cut in blocks, and searches stay exact.
TREE_BYTES = 128 << 20
_SLACK = 1e-9


def _heads(points: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` smallest keys of every distinct vector; partial top-k per task before the shuffle."""
    w = Window.partitionBy("vec").orderBy("key")
    return points.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= keep)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances between two blocks, by differences so that close points stay exact."""
    out = np.empty((len(a), len(b)))
    step = max(1, 4_000_000 // max(1, b.size))
    for start in range(0, len(a), step):
        diff = a[start : start + step, None, :] - b[None, :, :]
        out[start : start + step] = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
    return out


def _pair_distances(a: np.ndarray, b: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The distances between ``a[rows]`` and ``b[columns]``, by differences as well."""
    out = np.empty(len(rows))
    step = max(1, 4 * STEP // max(1, a.shape[1]))
    for start in range(0, len(rows), step):
        diff = a[rows[start : start + step]] - b[columns[start : start + step]]
        out[start : start + step] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
    return out


def _near_pairs(a: np.ndarray, b: np.ndarray, limit: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``a``, rows of ``b`` and their distance: for every row of ``a`` the ``keep`` nearest of ``b``, earlier ones first among equals.

    Pairs beyond ``limit`` may be left out. Squared distances from a matrix product choose the pairs to look at: what they may be wrong by is added to what they are
    compared with.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        centre = b.mean(axis=0)
        near_a, near_b = a - centre, b - centre
        square_a, square_b = np.einsum("ij,ij->i", near_a, near_a), np.einsum("ij,ij->i", near_b, near_b)
        # One product gives the square of a member less twice its product with the query.
        near_a, near_b = np.column_stack([near_a * -2, np.ones(len(a))]), np.column_stack([near_b, square_b])
    plain = not (np.isfinite(square_a).all() and np.isfinite(square_b).all())
    limit = np.where(np.isnan(limit), np.inf, limit)
    found = []
    for start in range(0, len(a), max(1, STEP // len(b))):
        part = slice(start, start + max(1, STEP // len(b)))
        if plain:
            d = _distances(a[part], b)
            columns = np.argsort(d, axis=1, kind="stable")[:, :keep]
            rows = np.repeat(np.arange(len(d)), columns.shape[1])
            found.append((rows + start, columns.ravel(), d[rows, columns.ravel()]))
            continue
        squares = near_a[part] @ near_b.T
        wrong = (8 * a.shape[1] + 64) * np.finfo(float).eps * (square_a[part] + square_b.max())
        most = (limit[part] * (1 + _SLACK) + _SLACK) ** 2 + wrong - square_a[part]
        near = squares <= most[:, None]
        many = np.flatnonzero(np.count_nonzero(near, axis=1) > 2 * keep)
        if len(many) and len(b) > keep:
            most[many] = np.minimum(most[many], np.partition(squares[many], keep - 1, axis=1)[:, keep - 1] + 2 * wrong[many])
            near[many] = squares[many] <= most[many, None]
        rows, columns = np.divmod(np.flatnonzero(near), len(b))
        d = _pair_distances(a[part], b, rows, columns)
        order = np.lexsort((columns, d, rows))
        rows, columns, d = rows[order], columns[order], d[order]
        first = np.arange(len(rows)) - np.searchsorted(rows, rows) < keep
        found.append((rows[first] + start, columns[first], d[first]))
    return tuple(np.concatenate(x) for x in zip(*found))


class PivotTree:
    """Nodes by number: pivots of their children, and of every child the farthest member and how many there are."""

    def __init__(self) -> None:
        self.children: dict[int, np.ndarray] = {}
        self.pivots: dict[int, np.ndarray] = {}
        self.radius, self.size = {0: np.inf}, {0: 0}

    def split(self, node: int, pivots: np.ndarray) -> None:
        self.children[node] = np.arange(len(pivots)) + node * FAN + 1
        self.pivots[node] = pivots
        for child in self.children[node].tolist():
            self.radius[child], self.size[child] = 0.0, 0

    def leaf_of(self, vectors: np.ndarray, keep: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The leaf of each vector, its distance from the leaf's pivot, and a distance within which ``keep`` members lie for certain."""
        node, to_pivot, bound = np.zeros(len(vectors), np.int64), np.zeros(len(vectors)), np.full(len(vectors), np.inf)
        open_rows = {0: np.arange(len(vectors))}
        while open_rows:
            at, rows = open_rows.popitem()
            if at not in self.children or not len(rows):
                continue
            d = _distances(vectors[rows], self.pivots[at])
            radius, size = (np.array([x[c] for c in self.children[at].tolist()]) for x in (self.radius, self.size))
            far = d + radius
            order = np.argsort(far, axis=1)
            enough = np.cumsum(size[order], axis=1) >= keep
            reached = far[np.arange(len(rows)), order[np.arange(len(rows)), enough.argmax(axis=1)]]
            bound[rows] = np.minimum(bound[rows], np.where(enough.any(axis=1), reached, np.inf))
            best = d.argmin(axis=1)
            node[rows], to_pivot[rows] = self.children[at][best], d.min(axis=1)
            for b in np.unique(best).tolist():
                open_rows[int(self.children[at][b])] = rows[best == b]
        return node, to_pivot, bound

    def leaves_within(self, vectors: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Rows and the leaves that may hold a member within their bound, the least distance such a member can have, and how many pivots were looked at."""
        limit = bound * (1 + _SLACK) + _SLACK
        found, looked = [], 0
        stack = [(0, np.arange(len(vectors)), np.zeros(len(vectors)))]
        while stack:
            at, rows, least = stack.pop()
            if at not in self.children:
                found.append((rows, np.full(len(rows), at), least))
                continue
            d = _distances(vectors[rows], self.pivots[at])
            looked += d.size
            for k, child in enumerate(self.children[at].tolist()):
                nearest = np.maximum(least, d[:, k] - self.radius[child])
                near = nearest <= limit[rows]
                if self.size[child] and near.any():
                    stack.append((child, rows[near], nearest[near]))
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return (*(np.concatenate(x) for x in zip(*(found or [empty]))), looked)

    def packs(self) -> dict[int, int]:
        """Every leaf's pack: leaves that lie side by side in the tree, with ``PACK * BLOCK_ROWS`` members or a single leaf."""
        out, pack, held, stack = {}, 0, 0, [0]
        while stack:
            node = stack.pop()
            if node in self.children:
                stack += reversed(self.children[node].tolist())
                continue
            if held and held + self.size[node] > PACK * BLOCK_ROWS:
                pack, held = pack + 1, 0
            out[node], held = pack, held + self.size[node]
        return out


def _routed(df: DataFrame, tree, id_type: str, keep: int = 1, only: set[int] | None = None) -> DataFrame:
    """``id, vec, cell, to_pivot, bound``: the leaf of every vector of ``id, vec``, or of those that come to the leaves ``only``."""

    def assign(batches):
        for pdf in batches:
            if len(pdf):
                pdf["cell"], pdf["to_pivot"], pdf["bound"] = tree.value.leaf_of(np.stack(pdf["vec"].to_numpy()), keep)
                yield pdf if only is None else pdf[pdf["cell"].isin(only)]

    return df.mapInPandas(assign, f"id {id_type}, vec array<double>, cell bigint, to_pivot double, bound double")


def grow_tree(members: DataFrame, id_type: str):
    """The metric tree of distinct vectors ``id, vec``, broadcast: leaves of at most ``BLOCK_ROWS`` members, as far as ``TREE_BYTES`` of pivots go.

    A level is one scan that counts the members of each new leaf, and one that draws pivots, by hash, of each leaf that holds too many: ``FAN``, or as many as
    leave about half of ``BLOCK_ROWS`` for each, so that leaves are never more than members over a part of ``BLOCK_ROWS``.
    """
    context, tree = members.sparkSession.sparkContext, PivotTree()
    tree.size[0], width = members.agg(F.count("*"), F.max(F.size("vec"))).first()
    wide = {0} if tree.size[0] > BLOCK_ROWS else set()
    held = 0
    for _ in range(MAX_LEVELS):
        held += len(wide) * FAN * 8 * (width or 1)
        if not wide or held > TREE_BYTES:
            break
        leaf = Window.partitionBy("cell").orderBy(F.xxhash64("vec"), "id")
        drawn = _routed(members, context.broadcast(tree), id_type, only=wide).withColumn("place", F.row_number().over(leaf)).where(F.col("place") <= FAN)
        pivots: dict[int, list] = {}
        for r in drawn.orderBy("cell", "place").select("cell", "vec").collect():
            pivots.setdefault(r["cell"], []).append(r["vec"])
        for node, rows in pivots.items():
            tree.split(node, np.array(rows[: max(2, -(-2 * tree.size[node] // BLOCK_ROWS))], dtype=float))
        fresh = {c for node in pivots for c in tree.children[node].tolist()}
        counted = _routed(members, context.broadcast(tree), id_type, only=fresh).groupBy("cell").agg(F.count("*").alias("n"), F.max("to_pivot").alias("radius"))
        wide = set()
        for r in counted.collect():
            tree.size[r["cell"]], tree.radius[r["cell"]] = r["n"], r["radius"]
            if r["n"] > BLOCK_ROWS:
                wide.add(r["cell"])
    return context.broadcast(tree)


def _block_search(queries: DataFrame, members: DataFrame, keep: int, id_type: str, block_rows: int | None = None) -> DataFrame:
    """Top ``keep`` members for each query in every (cell, block) it visits, those beyond its limit left out where it has one.

    ``queries`` has (id, vec, cell, limit), ``members`` has (id, vec, cell). Member blocks and query blocks hold about
    ``block_rows`` rows, whatever the size of the cell.
    """
    block_rows = block_rows or BLOCK_ROWS
    sizes = members.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    loads = queries.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("loads"))
    # One row per leaf, as the tree itself.
    grid = F.broadcast(sizes.join(loads, "cell"))
    q = (
        queries.join(grid, "cell")
        .withColumn("load", F.pmod(F.xxhash64("id"), F.col("loads")).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("cell", "block", "load", "id", "vec", F.col("limit").cast("double").alias("limit"))
    )
    m = (
        members.join(grid, "cell")
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("load", F.explode(F.sequence(F.lit(0), F.col("loads") - 1)))
        .select("cell", "block", "load", "id", "vec")
    )

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"id": left["id"][:0], "other": left["id"][:0], "distance": np.empty(0)})
        right = right.sort_values("id", kind="stable")
        ids, other = left["id"].to_numpy(), right["id"].to_numpy()
        limit = left["limit"].to_numpy(dtype=float, na_value=np.nan)
        rows, columns, d = _near_pairs(np.stack(left["vec"].to_numpy()), np.stack(right["vec"].to_numpy()), limit, keep)
        return pd.DataFrame({"id": ids[rows], "other": other[columns], "distance": d})

    keys = ["cell", "block", "load"]
    return q.groupBy(*keys).cogroup(m.groupBy(*keys)).applyInPandas(
        nearest, f"id {id_type}, other {id_type}, distance double"
    )


def _top(pairs: DataFrame, keep: int) -> DataFrame:
    w = Window.partitionBy("id").orderBy("distance", "other")
    return pairs.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= keep).drop("rn")


def _visits(queries: DataFrame, tree, id_type: str, first: int = 0, end: int | None = None) -> DataFrame:
    """``id, vec, cell, limit, visits, leaves, looked`` for queries ``id, vec, cell, limit``: other leaves than ``cell`` that may hold a member within the limit.

    ``visits`` are structs of ``cell`` and ``least``, the least distance of a member in it, nearest first, from place ``first`` to before ``end``; ``leaves`` counts all of
    them; ``looked`` are pivots that were compared for some queries, in their first row. A query's vector stands once beside all its leaves.
    """

    def other_leaves(batches):
        for whole in batches:
            for start in range(0, len(whole), LISTED):
                pdf = whole.iloc[start : start + LISTED]
                vectors = np.stack(pdf["vec"].to_numpy())
                row, leaf, least, looked = tree.value.leaves_within(vectors, pdf["limit"].to_numpy(dtype=float))
                other = leaf != pdf["cell"].to_numpy()[row]
                row, leaf, least = row[other], leaf[other], least[other]
                order = np.lexsort((leaf, least, row))
                row, leaf, least = row[order], leaf[order], least[order]
                leaves = np.bincount(row, minlength=len(pdf))
                place = np.arange(len(row)) - np.searchsorted(row, row)
                kept = (place >= first) & (place < (len(row) if end is None else end))
                row, leaf, least = row[kept], leaf[kept], least[kept]
                cuts = np.searchsorted(row, np.arange(1, len(pdf)))
                yield pdf.assign(
                    leaf=_pieces(leaf, cuts).to_numpy(), least=_pieces(least, cuts).to_numpy(), leaves=leaves, looked=np.where(np.arange(len(pdf)) == 0, looked, 0))

    found = queries.select("id", "vec", "cell", F.col("limit").cast("double").alias("limit")).mapInPandas(
        other_leaves, f"id {id_type}, vec array<double>, cell bigint, limit double, leaf array<bigint>, least array<double>, leaves bigint, looked bigint")
    return found.select("id", "vec", "cell", "limit", F.arrays_zip(F.col("leaf").alias("cell"), "least").alias("visits"), "leaves", "looked")


def _pieces(values: np.ndarray, cuts: np.ndarray) -> pd.Series:
    return pd.Series(np.split(values, cuts), dtype=object)


def _search(queries: DataFrame, members: DataFrame, keep: int, id_type: str) -> DataFrame:
    """``(id, other, distance)``: the ``keep`` nearest distinct member vectors of each distinct query vector."""
    tree = grow_tree(members, id_type)
    keep = min(keep, tree.value.size[0])
    if not tree.value.children:
        # New names keep the two sides of a self-join apart.
        q, m = (df.select(F.col("id").alias("id"), F.col("vec").alias("vec"), F.lit(0).cast("bigint").alias("cell")) for df in (queries, members))
        return _top(_block_search(q.withColumn("limit", F.lit(None).cast("double")), m, keep, id_type), keep)
    m = cut_lineage(_routed(members, tree, id_type).select("id", "vec", "cell"))
    q = cut_lineage(_routed(queries, tree, id_type, keep).select("id", "vec", "cell", "bound"))
    found = cut_lineage(_top(_block_search(q.select("id", "vec", "cell", F.col("bound").alias("limit")), m, keep, id_type), keep))
    reach = lambda rows: rows.groupBy("id").agg(F.when(F.count("*") >= keep, F.max("distance")).alias("reach"))
    limited = q.join(reach(found), "id", "left").withColumn("limit", F.least("bound", "reach"))
    visits = cut_lineage(_visits(limited, tree, id_type, end=NEXT_LEAVES))
    leaf = F.explode(F.transform("visits", lambda v: v["cell"])).alias("cell")
    found = _top(found.unionByName(_block_search(visits.select("id", "vec", leaf, "limit"), m, keep, id_type)), keep)
    later = visits.where(F.col("leaves") > NEXT_LEAVES)
    if later.isEmpty():
        return found
    found = cut_lineage(found)
    # A smaller limit leaves the first of the leaves, in the same order, so those that were searched come first again.
    closer = later.join(reach(found), "id", "left").select("id", "vec", "cell", F.least("limit", "reach").alias("limit"))
    rest = cut_lineage(_visits(closer, tree, id_type, end=0).where(F.col("leaves") > NEXT_LEAVES).select("id", "vec", "cell", "limit", "leaves"))
    asked, leaves = rest.agg(F.count("*"), F.coalesce(F.sum(F.col("leaves") - NEXT_LEAVES), F.lit(0))).first()
    if not asked:
        return found
    if leaves <= MANY_LEAVES * asked:
        others = cut_lineage(_visits(rest, tree, id_type, first=NEXT_LEAVES))
        return _top(found.unionByName(_block_search(others.select("id", "vec", leaf, "limit"), m, keep, id_type)), keep)
    # A pack may hold leaves that were searched before. One shuffle by query serves both steps.
    pairs = found.unionByName(_pack_search(rest, m, tree, keep, id_type, asked)).repartition("id")
    return _top(pairs.groupBy("id", "other").agg(F.min("distance").alias("distance")), keep)


def _pack_search(queries: DataFrame, members: DataFrame, tree, keep: int, id_type: str, asked: int) -> DataFrame:
    """``(id, other, distance)``: of queries ``id, vec, cell, limit`` and members ``id, vec, cell`` the nearest within the limit, at most ``keep`` from each part of the members.

    Both sides are stored once, as rows of many vectors. A task reads its queries and one part of the members, which are as many as ``HELD_BYTES`` asks for, and
    searches a pack after the other, so a query's limit falls as it goes.
    """
    spark = members.sparkSession
    cores, width = spark.sparkContext.defaultParallelism, 8 * max(1, next(iter(tree.value.pivots.values())).shape[1])
    rows = max(1, min(PACK * BLOCK_ROWS, STORED_BYTES // width))
    pack_of = tree.value.packs()
    # One row per leaf, as the tree itself.
    packs = F.broadcast(spark.createDataFrame(list(pack_of.items()), "cell bigint, pack bigint"))

    def blocks(df: DataFrame, size: int) -> DataFrame:
        df = df.join(packs, "cell")
        cut = F.broadcast(df.groupBy("pack").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks")))
        # Members without a key have blocks of their own, as whole numbers beside gaps would come to Python as floats.
        block = F.when(F.col("id").isNull(), -1 - F.pmod(F.xxhash64("vec"), F.col("blocks"))).otherwise(F.pmod(F.xxhash64("id"), F.col("blocks")))
        return df.join(cut, "pack").withColumn("block", block.cast("int"))

    def pack_members(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        others = [None] * len(pdf) if key[1] < 0 else pdf["id"].tolist()
        return pd.DataFrame({"pack": [key[0]], "others": [others], "members": [np.stack(pdf["vec"].to_numpy()).tobytes()]})

    def pack_queries(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        vectors, limit = np.stack(pdf["vec"].to_numpy()), pdf["limit"].to_numpy(dtype=float)
        asks = np.zeros((len(pdf), max(pack_of.values()) + 1), bool)
        for start in range(0, len(pdf), LISTED):
            part = slice(start, start + LISTED)
            row, leaf, _, _ = tree.value.leaves_within(vectors[part], limit[part])
            asks[row + start, np.fromiter((pack_of[x] for x in leaf.tolist()), np.int64, len(leaf))] = True
        asked_for = np.flatnonzero(asks.any(axis=0))
        return pd.DataFrame({
            "home": [key[0]], "load": [key[1]], "ids": [pdf["id"].tolist()], "vectors": [vectors.tobytes()], "limits": [limit.tobytes()],
            "packs": [asked_for.tolist()], "asks": [np.packbits(asks[:, asked_for], axis=0).tobytes()]})

    def nearest(batches):
        best = None
        for pdf in batches:
            for pair in pdf.itertuples(index=False):
                if best is None or best.block != (pair.home, pair.load):
                    if best is not None:
                        yield best.frame()
                    best = _Best(pair, keep)
                best.add(pair)
        if best is not None:
            yield best.frame()

    size = min(rows, max(-(-asked // (TASKS * cores)), BLOCK_ROWS // 4))
    # Queries without a key are left out: rows without one have no neighbours.
    left = blocks(queries.where(F.col("id").isNotNull()).select("id", "vec", "cell", "limit"), size).groupBy("pack", "block").applyInPandas(
        pack_queries, f"home bigint, load int, ids array<{id_type}>, vectors binary, limits binary, packs array<bigint>, asks binary")
    right = blocks(members, rows).groupBy("pack", "block").applyInPandas(pack_members, f"pack bigint, others array<{id_type}>, members binary")
    left = cut_lineage(left.repartition(max(1, min(-(-asked // size), 2 * TASKS * cores))))
    right = cut_lineage(right.repartition(-(-sum(tree.value.size[c] for c in pack_of) * width // HELD_BYTES) or 1))
    pairs = left.join(right.hint("shuffle_replicate_nl"), F.array_contains("packs", F.col("pack")))
    with small_batches(spark):
        return cut_lineage(pairs.mapInPandas(nearest, f"id {id_type}, other {id_type}, distance double"))


class _Best:
    """The nearest members so far of a block of queries: flat arrays in the order of query, distance and member."""

    def __init__(self, pair, keep: int) -> None:
        self.block, self.keep, self.packs = (pair.home, pair.load), keep, list(pair.packs)
        self.ids, self.limit = np.asarray(pair.ids), np.frombuffer(pair.limits).copy()
        self.vectors = np.frombuffer(pair.vectors).reshape(len(self.ids), -1)
        asks = np.frombuffer(pair.asks, np.uint8).reshape(-1, len(self.packs))
        self.asks = np.unpackbits(asks, axis=0, count=len(self.ids)).astype(bool)
        self.row, self.other, self.distance = np.zeros(0, np.int64), self.ids[:0], np.zeros(0)

    def add(self, pair) -> None:
        asking, others = np.flatnonzero(self.asks[:, self.packs.index(pair.pack)]), np.asarray(pair.others)
        if pd.isna(others[0]):
            others = np.full(len(others), None, object)
        rows, columns, distance = _near_pairs(self.vectors[asking], np.frombuffer(pair.members).reshape(len(others), -1), self.limit[asking], self.keep)
        if not len(rows):
            return
        row, other, distance = (np.concatenate(x) for x in ((self.row, asking[rows]), (self.other, others[columns]), (self.distance, distance)))
        place = other if other.dtype.kind in "iu" else pd.factorize(other, sort=True)[0]
        order = np.lexsort((place, distance, row))
        order = order[np.arange(len(row)) - np.searchsorted(row[order], row[order]) < self.keep]
        self.row, self.other, self.distance = row[order], other[order], distance[order]
        last = np.flatnonzero(np.arange(len(order)) - np.searchsorted(self.row, self.row) == self.keep - 1)
        self.limit[self.row[last]] = np.fmin(self.limit[self.row[last]], self.distance[last])

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame({"id": self.ids[self.row], "other": self.other, "distance": self.distance})


def search_effort(points: DataFrame, key: str, vec: Column, k: int) -> DataFrame:
    """``members, leaves, visits, pivots_compared, members_compared``: what a search of all distinct vectors of ``points`` for their k neighbours compares, in one row.

    Bounds are those of the own leaf; the search itself compares no more than this, plus one own path through the tree for each query.
    """
    clean = _points(points, key, vec)
    id_type = clean.schema["key"].dataType.simpleString()
    distinct = cut_lineage(clean.groupBy("vec").agg(F.min("key").alias("id")).select("id", "vec"))
    tree = grow_tree(distinct, id_type)
    keep = min(k + 1, tree.value.size[0])
    m = cut_lineage(_routed(distinct, tree, id_type, keep).select("id", "vec", "cell", "bound"))
    sizes = m.groupBy("cell").agg(F.count("*").alias("n"))
    own = m.join(F.broadcast(sizes), "cell").agg(F.sum("n").alias("own"), F.count_distinct("cell").alias("leaves"), F.count("*").alias("members"))
    own_leaf = [m.select(*[F.col(c).alias(c) for c in ("id", "vec", "cell")]) for _ in range(2)]
    found = _top(_block_search(own_leaf[0].withColumn("limit", F.lit(None).cast("double")), own_leaf[1], keep, id_type), keep)
    reach = found.groupBy("id").agg(F.when(F.count("*") >= keep, F.max("distance")).alias("reach"))
    visits = cut_lineage(_visits(m.join(reach, "id", "left").withColumn("limit", F.least("bound", "reach")), tree, id_type))
    leaves = visits.select(F.explode("visits").alias("v")).select("v.cell").join(F.broadcast(sizes), "cell")
    others = (*leaves.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first(), visits.agg(F.coalesce(F.sum("looked"), F.lit(0))).first()[0])
    return own.select(
        "members", "leaves", (F.col("members") + F.lit(others[1])).alias("visits"), F.lit(others[2]).alias("pivots_compared"),
        (F.col("own") + F.lit(others[0])).alias("members_compared"))


def nearest_neighbours(
    queries: DataFrame, members: DataFrame | None, key: str, vec: Column, k: int
) -> DataFrame:
    """``(key, neighbour, distance, rank)``: the k nearest members of every query row.

    Equal distances are ordered by the member key. With ``members=None`` the table is joined with itself and
    a row is not its own neighbour. Only rows without a vector are left out.
    """
    self_join = members is None
    points = _points(queries, key, vec)
    total = points.count()
    keep = k + 1 if self_join else k
    member_points = points if self_join else _points(members, key, vec)
    heads = cut_lineage(_heads(member_points, keep))
    lists = _lists(points, heads, keep)
    return _rows_with_lists(points, lists, total, k, self_join).withColumnsRenamed({"key": key})


def _points(df: DataFrame, key: str, vec: Column) -> DataFrame:
    # Adding zero turns -0.0 into 0.0, so equal vectors are equal arrays.
    clean = F.transform(vec.cast("array<double>"), lambda x: x + F.lit(0.0))
    return df.select(F.col(key).alias("key"), clean.alias("vec")).where(F.col("vec").isNotNull())


def _lists(points: DataFrame, heads: DataFrame, keep: int) -> DataFrame:
    """``(vec, n, near)``: per distinct query vector the first ``keep`` (distance, key) entries."""
    id_type = points.schema["key"].dataType.simpleString()
    members = heads.where("rn = 1").select(F.col("key").alias("id"), "vec")
    distinct = points.groupBy("vec").agg(F.min("key").alias("id"), F.count("*").alias("n"))
    found = _search(distinct.select("id", "vec"), members, keep, id_type)
    keys = heads.join(
        members.withColumnRenamed("id", "other"), "vec"
    ).select("other", F.col("key").alias("neighbour"))
    w = Window.partitionBy("id").orderBy("distance", "neighbour")
    entries = (
        found.join(keys, "other")
        .withColumn("rn", F.row_number().over(w))
        .where(F.col("rn") <= keep)
        .groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct("distance", "neighbour"))).alias("near"))
    )
    return distinct.join(entries, "id").select("vec", "n", "near")


def _rows_with_lists(points: DataFrame, lists: DataFrame, total: int, k: int, self_join: bool) -> DataFrame:
    rows = attach_lookup(points, lists, ["vec"], total, "n")
    near = F.col("near")
    if self_join:
        near = F.filter(near, lambda e: e["neighbour"] != F.col("key"))
    near = F.slice(near, 1, k)
    return rows.select("key", F.posexplode(near).alias("pos", "e")).select(
        "key", F.col("e.neighbour").alias("neighbour"), F.col("e.distance").alias("distance"),
        (F.col("pos") + 1).alias("rank"),
    )


def vector_of(df: DataFrame, columns: list[str]) -> Column:
    return F.array(*[F.col("`" + c + "`").cast("double") for c in columns])


def knn_classify(
    train: DataFrame, test: DataFrame, key: str, vec: Column, label: str, k: int = 5
) -> DataFrame:
    """Majority label of the k nearest training rows; the smaller label wins a tie."""
    return _knn_vote(train, test, key, vec, label, k).groupBy("key", "vote").agg(F.count("*").alias("n")).groupBy(
        "key"
    ).agg(F.min_by("vote", F.struct(-F.col("n"), F.col("vote"))).alias("prediction")).withColumnRenamed("key", key)


def knn_regress(train: DataFrame, test: DataFrame, key: str, vec: Column, label: str, k: int = 5) -> DataFrame:
    """Mean label of the k nearest training rows."""
    return _knn_vote(train, test, key, vec, label, k).groupBy("key").agg(
        F.avg("vote").alias("prediction")
    ).withColumnRenamed("key", key)


def _knn_vote(train: DataFrame, test: DataFrame, key: str, vec: Column, label: str, k: int) -> DataFrame:
    near = nearest_neighbours(test, train, key, vec, k).withColumnRenamed(key, "key")
    votes = train.select(F.col(key).alias("neighbour"), F.col(label).alias("vote"))
    return near.join(votes, "neighbour")


def local_outlier_factor(
    df: DataFrame, key: str, vec: Column, k: int = 20, limit: float = 1.5
) -> DataFrame:
    """``(key, lof, is_outlier)`` for every row.

    Rows with equal vectors have the same neighbours except for the first k+1 of them, so the factor is
    computed for those and one stand-in for the rest; no vector takes part more than k+2 times.
    """
    points = _points(df, key, vec)
    total = points.count()
    k = min(k, total - 1)
    heads = cut_lineage(_heads(points, k + 2))
    lists = _lists(points, heads.where(F.col("rn") <= k + 1), k + 1)
    shared = heads.join(lists, "vec").select(
        "key",
        F.slice(F.filter("near", lambda e: e["neighbour"] != F.col("key")), 1, k).alias("near"),
    )
    near = cut_lineage(
        shared.select("key", F.explode("near").alias("e")).select(
            "key", F.col("e.neighbour").alias("neighbour"), F.col("e.distance").alias("distance")
        )
    )
    k_distance = near.groupBy("key").agg(F.max("distance").alias("k_distance"))
    reach = near.join(k_distance.withColumnRenamed("key", "neighbour"), "neighbour").groupBy("key").agg(
        F.avg(F.greatest("k_distance", "distance")).alias("reach")
    )
    density = cut_lineage(reach.select("key", (1 / (F.col("reach") + F.lit(1e-10))).alias("lrd")))
    factors = (
        near.join(density.select(F.col("key").alias("neighbour"), F.col("lrd").alias("their")), "neighbour")
        .groupBy("key")
        .agg(F.avg("their").alias("their"))
        .join(density, "key")
        .select("key", (F.col("their") / F.col("lrd")).alias("lof"))
    )
    factors = cut_lineage(factors)
    own = points.join(factors, "key", "left")
    stand_ins = heads.where(F.col("rn") == k + 2).join(factors, "key").select("vec", F.col("lof").alias("shared_lof"))
    sizes = points.groupBy("vec").agg(F.count("*").alias("n"))
    scored = attach_lookup(own, stand_ins.join(sizes, "vec"), ["vec"], total, "n")
    lof = F.coalesce("lof", "shared_lof")
    return scored.select(F.col("key").alias(key), lof.alias("lof"), (lof > limit).alias("is_outlier"))
