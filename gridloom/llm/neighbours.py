"""The most similar vectors of every vector (problem 7).

Vectors are sharded by the cells of `vectors`. In each shard a vantage-point tree holds the vectors that live there and
answers for them and for the shard's guests. A branch is left out if the triangle inequality shows that nothing in it can
be nearer than what a query has already, a bound relaxed by `tree_factor`; `shard_factor` relaxes the same bound between
shards. With both at one the search is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.vectors import DIMENSION, MAX_CELL, Cells, chunks, make_cells, matrix, unit, usable_vectors
from gridloom.runtime import materialize

NEAREST, LEAST = 5, 0.70
#: Independent partitions; relaxation between shards and within a tree.
PARTITIONS, SHARD_FACTOR, TREE_FACTOR = 5, 150.0, 2.0
#: Vectors in a leaf; candidates for a vantage point; a gap between distances from which a node is cut there and not in half.
LEAF, CANDIDATES, GAP = 32, 12, 0.1
#: Points kept in single precision beyond those wanted, to be ordered in double precision.
SPARE = 4
_BLOCK = 1_024
#: In place of an owner: nobody's.
_NOBODY = -2
_RANKS = 10_000_000


class VantageTree:
    """A vantage-point tree over unit vectors, searched for many queries at once: in single precision, and what is kept is measured by the vectors as given.

    A node's ball about its vantage point ends at the widest gap between distances if there is one, as about a cluster, else
    at their median. `owner` numbers what a vector belongs to; a query leaves out its own owner's vectors. Vectors are given in
    order of their names: among equal similarities (six decimals) the earlier one is nearer. `compared` counts the
    distances that were computed.
    """

    def __init__(self, x: np.ndarray, owner: np.ndarray, factor: float = TREE_FACTOR, leaf: int = LEAF, gap: float = GAP, seed: int = 7):
        if len(x) >= _RANKS:
            raise ValueError(f"a tree holds fewer than {_RANKS} vectors")
        self.factor, self.leaf, self.gap, self.compared = factor, leaf, gap, 0
        self.exact, self._given = x, x.astype(np.float32)
        self._rng = np.random.default_rng(seed)
        self._points: list[int] = []
        self._order: list[np.ndarray] = []
        self._leaves: dict[int, slice] = {}
        self._done = 0
        root = self._build(np.arange(len(x)))
        # Vectors in order of the leaves, so that a leaf is a stretch of them.
        at = np.concatenate(self._order) if self._order else np.zeros(0, int)
        self.root, self.at, self.x, self.owner = root, at, self._given[at], np.asarray(owner)[at]
        self.vantage = self._given[self._points]
        del self._given, self._order

    def _build(self, at: np.ndarray):
        if len(at) <= self.leaf:
            self._order.append(np.sort(at))
            self._done += len(at)
            leaf = slice(self._done - len(at), self._done)
            self._leaves[leaf.start] = leaf
            return leaf
        some = self._rng.choice(at, CANDIDATES, replace=False)
        d = np.sqrt(np.maximum(0, 2 - 2 * self._given[at] @ self._given[some].T))
        gaps = np.diff(np.sort(d, axis=0), axis=0)
        edge = max(self.leaf // 4, len(at) // 64)  # no slivers: the depth stays bounded
        gaps[:edge], gaps[len(gaps) - edge :] = 0, 0
        cut, best = np.unravel_index(gaps.argmax(), gaps.shape)
        if gaps[cut, best] > self.gap:
            cut += 1
        else:  # the vantage point whose distances are spread most
            best, cut = d.std(axis=0).argmax(), len(at) // 2
        d = d[:, best]
        order = np.argsort(d, kind="stable")
        d = d[order]
        number = len(self._points)
        self._points.append(int(some[best]))
        return (number, d[0], d[cut - 1], d[cut], d[-1], self._build(at[order[:cut]]), self._build(at[order[cut:]]))

    def search(self, q: np.ndarray, leave_out: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Positions and similarities (k columns, best first; -1 where there is none) of each query."""
        keys = np.full((len(q), k + SPARE), -1.0)
        f = q.astype(np.float32)
        for i in range(0, len(q) if len(self.x) else 0, _BLOCK):
            b = slice(i, i + _BLOCK)
            far = np.sqrt(np.maximum(0, 2 - 2 * f[b] @ self.vantage.T))
            self.compared += far.size
            home = np.zeros(len(far), np.int64)
            self._descend(self.root, np.arange(len(far)), far, home)
            for start in np.unique(home):
                self._look(self._leaves[start], np.nonzero(home == start)[0], f[b], leave_out[b], keys[b], least)
            self._sweep(self.root, np.arange(len(far)), far, home, f[b], leave_out[b], keys[b], least)
        pos = np.where(keys >= 0, _RANKS - 1 - np.mod(keys, _RANKS), -1).astype(np.int64)
        return self._best(q, pos, k, least)

    def _best(self, q: np.ndarray, pos: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        sim = np.full(pos.shape, -1.0)
        row, col = np.nonzero(pos >= 0)
        for i in range(0, len(row), 50_000):
            r, c = row[i : i + 50_000], col[i : i + 50_000]
            sim[r, c] = np.round(np.einsum("ij,ij->i", q[r], self.exact[pos[r, c]]), 6)
        sim[sim < least] = -1
        order = np.lexsort((np.where(pos < 0, _RANKS, pos), -sim), axis=1)[:, :k]
        pos, sim = np.take_along_axis(pos, order, 1), np.take_along_axis(sim, order, 1)
        return np.where(sim < 0, -1, pos), sim

    def _descend(self, node, at: np.ndarray, far: np.ndarray, home: np.ndarray) -> None:
        """The leaf on whose side of every ball a query lies."""
        if isinstance(node, slice):
            home[at] = node.start
        elif len(at):
            number, _, near_hi, far_lo, _, near, beyond = node
            inside = far[at, number] <= (near_hi + far_lo) / 2
            self._descend(near, at[inside], far, home)
            self._descend(beyond, at[~inside], far, home)

    def _sweep(self, node, at: np.ndarray, far: np.ndarray, home: np.ndarray, q: np.ndarray, out: np.ndarray, keys: np.ndarray, least: float) -> None:
        """Through all that can hold something nearer than a query has; its home has been looked at."""
        if isinstance(node, slice):
            at = at[home[at] != node.start]
            if len(at):
                self._look(node, at, q, out, keys, least)
        elif len(at):
            number, near_lo, near_hi, far_lo, far_hi, near, beyond = node
            d = far[at, number]
            kth = np.partition(keys[at], SPARE, axis=1)[:, SPARE]
            bound = np.where(kth >= 0, np.maximum(np.floor(kth / _RANKS) / 1e6, least), least)
            r = np.sqrt(np.maximum(0, 2 - 2 * bound)) / self.factor + 1e-3
            self._sweep(near, at[(d - near_hi <= r) & (near_lo - d <= r)], far, home, q, out, keys, least)
            self._sweep(beyond, at[(far_lo - d <= r) & (d - far_hi <= r)], far, home, q, out, keys, least)

    def _look(self, leaf: slice, at: np.ndarray, q: np.ndarray, out: np.ndarray, keys: np.ndarray, least: float) -> None:
        s = q[at] @ self.x[leaf].T
        self.compared += s.size
        near = s >= least - 2e-6
        hit = np.nonzero(near.any(axis=1))[0]
        if len(hit):
            b = at[hit]
            good = near[hit] & (self.owner[leaf][None] != out[b][:, None])
            new = np.where(good, np.round(s[hit].astype(np.float64) * 1e6) * _RANKS + (_RANKS - 1 - self.at[leaf]), -1.0)
            both = np.concatenate((keys[b], new), axis=1)
            w = keys.shape[1]
            keys[b] = np.partition(both, both.shape[1] - w, axis=1)[:, -w:]


def _assign(cells: Cells, fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, _BLOCK):
                s = b.slice(lo, _BLOCK)
                x = unit(matrix(s.column(0)))
                lot = np.frombuffer(b"".join(s.column(1).to_pylist()), np.int64)[::2] & (2**62 - 1)
                for i, home, visits in cells.of(x):
                    row, cell = np.nonzero(visits)
                    parts = cells.parts[i][cell]
                    many = np.repeat(np.arange(len(row)), parts)  # a query looks into each part of a split cell,
                    part = np.concatenate([np.arange(p) for p in parts]) if len(parts) else parts
                    lives = (cell == home[row])[many] & (lot[row[many]] % parts[many] == part)  # of which it lives in one
                    pick = pa.array(row[many])
                    yield pa.RecordBatch.from_arrays([pa.array((i * 2**32 + cell[many]).astype(np.int64)), pa.array(part.astype(np.int64)), pa.array(lives), *(c.take(pick) for c in s.columns)], ["cell", "part", "lives", *fields])

    return run


def _search(k: int, least: float, tree_factor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, ["cell", "part"]):
            x = unit(matrix(t["vector"].combine_chunks()))
            items = t["items"].combine_chunks()
            count = np.diff(items.offsets.to_numpy())
            flat = items.flatten()
            names, owners = np.array(flat.field("name").to_pylist(), object), flat.field("owner").to_numpy()
            first = np.cumsum(count) - count
            row = np.repeat(np.arange(len(x)), count)
            rank = np.argsort(np.argsort(names.astype(str), kind="stable"))
            more = t["more"].to_numpy(zero_copy_only=False)
            # A point is left out for an owner only if all its copies are that owner's, those beyond the items, too.
            shared = t["sole"].is_null().to_numpy(zero_copy_only=False)
            sole = np.where(shared, _NOBODY, t["sole"].fill_null(_NOBODY).to_numpy())
            # The tree: the points that live here, by their first names.
            mine = np.nonzero(t["lives"].to_numpy(zero_copy_only=False))[0]
            if not len(mine):
                continue
            mine = mine[np.argsort(rank[first[mine]])]
            tree = VantageTree(x[mine], sole[mine], tree_factor)
            codes = t["code"].combine_chunks()
            # Queries: each point once per owner of its first copies, and once for all further owners.
            pair = np.unique(np.stack((row, owners), axis=1), axis=0)
            rest = np.nonzero(more)[0]
            for of, own, want, other in ((pair[:, 0], pair[:, 1], k, False), (rest, np.full(len(rest), -1), 2 * k, True)):
                for i in range(0, len(of), 8 * _BLOCK):
                    o, e = of[i : i + 8 * _BLOCK], own[i : i + 8 * _BLOCK]
                    pos, sim = tree.search(x[o], np.full(len(o), _NOBODY - 1) if other else e, want + 2, least)
                    q, c = np.nonzero(pos >= 0)
                    point = mine[pos[q, c]]
                    # The points' copies, nearest first, ties by name.
                    n = count[point]
                    at = np.repeat(first[point] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    q, s = np.repeat(q, n), np.repeat(sim[q, c], n)
                    good = np.full(len(at), True) if other else owners[at] != e[q]
                    q, s, at = q[good], s[good], at[good]
                    order = np.lexsort((rank[at], -s, q))
                    q, s, at = q[order], s[order], at[order]
                    keep = np.arange(len(q)) - np.searchsorted(q, q) < want
                    q, s, at = q[keep], s[keep], at[keep]
                    yield pa.RecordBatch.from_arrays([codes.take(pa.array(o[q])), pa.array(e[q]), pa.array(np.full(len(q), other)), pa.array(names[at].tolist(), pa.string()), pa.array(owners[at]), pa.array(s)], ["code", "owner", "other", "name", "name_owner", "cosine"])

    return run


_FOUND = "code binary, owner bigint, other boolean, name string, name_owner bigint, cosine double"


def nearest(records: DataFrame, key: str = "id", owner: list[str] | None = None, k: int = NEAREST, least: float = LEAST, partitions: int = PARTITIONS, shard_factor: float = SHARD_FACTOR, tree_factor: float = TREE_FACTOR, max_cell: int = MAX_CELL, dimension: int = DIMENSION) -> DataFrame:
    """key, neighbour, cosine: up to `k` nearest others of each usable record, of a cosine of `least` or more.

    The cosine is in double precision, rounded to six decimals; ties go to the smaller key. Records of the same owner
    (table_name, entity_id by default; null counts as a value) are left out. Copies of a row (same key) are one.
    Unusable vectors and null keys give no row and are no neighbours; an empty table gives none.

    Equal vectors are one point, found once: of its copies the first by key, at most k per owner and 2 k
    in all, suffice as neighbours of anything.
    """
    owner = owner or ["table_name", "entity_id"]
    source = records.dropna(subset=[key]).withColumn("owner_no", F.xxhash64(*[x for c in owner for x in (F.col(c).isNull(), F.col(c))]))
    rows = materialize(usable_vectors(source, [key, "owner_no"]), "usable")
    members = rows.select(F.col(key).alias("name"), F.col("owner_no").alias("owner"), "code").groupBy("code", "owner", "name").agg(F.lit(1).alias("one")).drop("one")
    per_owner = F.row_number().over(Window.partitionBy("code", "owner").orderBy("name"))
    in_all = F.row_number().over(Window.partitionBy("code").orderBy("name"))
    first = members.withColumn("r", per_owner).where(F.col("r") <= k).withColumn("r", in_all).where(F.col("r") <= 2 * k)
    items = first.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("name", "owner"))).alias("items"))
    counts = members.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("owner").alias("low"), F.max("owner").alias("high"))
    # The owner of all copies of a point, if it is one.
    known = items.join(counts, "code").select("code", "items", (F.col("n") > F.size("items")).alias("more"), F.when(F.col("low") == F.col("high"), F.col("low")).alias("sole"))
    points = rows.groupBy("code").agg(F.first("vector").alias("vector")).join(known, "code").select("vector", "code", "more", "sole", "items")
    points = materialize(points, "points")
    cells = make_cells(points, points.count(), (2 - 2 * least) ** 0.5, shard_factor, partitions, None, dimension=dimension, max_cell=max_cell)
    fields = "vector binary, code binary, more boolean, sole bigint, items array<struct<name string, owner bigint>>"
    placed = points.mapInArrow(_assign(cells, points.columns), f"cell bigint, part bigint, lives boolean, {fields}")
    got = placed.repartition("cell", "part").sortWithinPartitions("cell", "part").mapInArrow(_search(k, least, tree_factor), _FOUND)
    best = F.row_number().over(Window.partitionBy("code", "owner", "other").orderBy(F.desc("cosine"), "name"))
    got = got.distinct().withColumn("r", best).where(F.col("r") <= F.when(F.col("other"), 2 * k).otherwise(k)).drop("r")
    # Each record takes its point's answer for its owner, or the one for further owners.
    asked = members.join(known.where("more").select("code", F.transform("items", lambda x: x.owner).alias("asked")), "code", "left")
    asked = asked.select("name", "code", F.col("owner").alias("own"), F.coalesce(~F.array_contains("asked", F.col("owner")), F.lit(False)).alias("other"))
    asked = asked.withColumn("owner", F.when(F.col("other"), F.lit(-1)).otherwise(F.col("own")).cast("bigint"))
    answer = asked.join(got.withColumnRenamed("name", "neighbour"), ["code", "owner", "other"]).where("name_owner <> own")
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("cosine"), "neighbour"))
    return answer.withColumn("r", rank).where(F.col("r") <= k).select(F.col("name").alias(key), "neighbour", "cosine")


def pairs(found: DataFrame, key: str = "id") -> DataFrame:
    """id_a, id_b: each pair in which one takes the other, once, the smaller key first."""
    return found.select(F.least(key, "neighbour").alias("id_a"), F.greatest(key, "neighbour").alias("id_b")).distinct()
