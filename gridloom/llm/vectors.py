"""What clustering and neighbour search share: usable vectors, classes of equal ones, spatial cells.

Cells come from several independent partitions. Each has pivots, a bounded sample of the vectors; a vector's home is the
cell of its nearest pivot, and it is a guest of every cell whose pivot is hardly farther: by the triangle inequality a
vector within `radius` of it can lie in another cell only if that pivot is farther by at most 2 `radius`, a bound
that `factor` relaxes. Factor one loses nothing; more partitions make up for larger factors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers in a usable vector.
DIMENSION = 384
#: Vectors a cell should have, and pivots of a partition at most (they go to every task).
CELL, MAX_PIVOTS = 256, 8_192
#: Vectors in one task at once; cells expected to be larger are split into parts, all pairs of which are looked at.
MAX_CELL = 20_000
#: Vectors the expected sizes of cells are estimated from.
SIZE_SAMPLE = 8_000


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of float32 from vectors as bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable_vectors(rows: DataFrame, keep: list[str], column: str = "embedding", dimension: int = DIMENSION) -> DataFrame:
    """`keep`, code (16 bytes, the same for equal vectors only) and vector (float32 bytes) of the usable rows.

    Usable is a vector of `dimension` finite entries that are not all zero. Others give no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(len(keep))
            good = np.nonzero(pa.compute.fill_null(pa.compute.equal(pa.compute.list_value_length(v), dimension), False).to_numpy(zero_copy_only=False))[0]
            v = v.take(pa.array(good))
            flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False)  # a null entry becomes nan
            x = flat.reshape(len(good), dimension)
            with np.errstate(invalid="ignore"):
                ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            x = np.ascontiguousarray(x[ok]) + np.float32(0)  # minus zero becomes zero
            data = [r.tobytes() for r in x]
            heads = [b.column(i).take(pa.array(good[ok])) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*heads, pa.array([xxhash.xxh3_128_digest(d) for d in data], pa.binary()), pa.array(data, pa.binary())], [*keep, "code", "vector"])

    fields = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)
    return rows.select(*keep, column).mapInArrow(run, f"{fields}, code binary, vector binary")


@dataclass(frozen=True)
class Cells:
    """Pivots of each partition (unit vectors, reduced), the projection, and the parts of cells that are large."""

    projection: np.ndarray | None
    pivots: list[np.ndarray]
    parts: list[np.ndarray]
    margin: float

    def reduced(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.projection if self.projection is not None else x).astype(np.float32)

    def of(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per partition: its number, the home cell of each unit vector, and which cells it visits."""
        y = self.reduced(x)
        yy = (y * y).sum(axis=1)[:, None]
        for i, p in enumerate(self.pivots):
            d = np.sqrt(np.maximum(0.0, yy + (p * p).sum(axis=1)[None] - 2 * y @ p.T))
            home = d.argmin(axis=1)
            yield i, home, d <= d[np.arange(len(d)), home][:, None] + self.margin


def make_cells(classes: DataFrame, n: int, radius: float, factor: float, partitions: int, reduce_to: int | None, seed: int = 7, dimension: int = DIMENSION, max_cell: int = MAX_CELL) -> Cells:
    """Cells for `n` classes, from a sample of expected size partitions x MAX_PIVOTS + SIZE_SAMPLE at most.

    The sample is drawn by the vectors' codes, so equal inputs give equal cells.
    """
    count = int(min(MAX_PIVOTS, max(1, n // CELL)))
    want = partitions * count + SIZE_SAMPLE
    chance = min(1.0, 1.1 * want / max(n, 1))
    lot = F.xxhash64(F.lit(seed), F.col("code"))
    picked = classes.where(lot < F.lit(int(-(2**63) + chance * (2**64 - 1)))) if chance < 1 else classes
    rows = picked.select(lot.alias("lot"), "vector").collect()
    rows.sort(key=lambda r: r["lot"])
    x = unit(np.frombuffer(b"".join(r["vector"] for r in rows), np.float32).reshape(len(rows), -1)) if rows else np.zeros((0, dimension))
    projection = None
    scale = 1.0
    if reduce_to and reduce_to < dimension:
        q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(dimension, reduce_to)))
        projection, scale = q, (reduce_to / dimension) ** 0.5
    cells = Cells(projection, [], [], 2 * radius * scale / factor)
    y = cells.reduced(x)
    pivots = [y[i * count : (i + 1) * count] if len(y) >= (i + 1) * count else y[np.random.default_rng(seed + i).permutation(len(y))[:count]] for i in range(partitions)]
    sized = Cells(projection, pivots, [], cells.margin)
    sample = x[-SIZE_SAMPLE:]
    parts = [np.maximum(1, np.ceil(v.sum(axis=0) / max(len(sample), 1) * n / max_cell)).astype(int) for _, _, v in sized.of(sample)] if len(x) else []
    return Cells(projection, pivots, parts, cells.margin)


def chunks(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """One table for each run of equal keys, from rows in order of them."""
    held: list[pa.RecordBatch] = []
    now: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        new = np.zeros(b.num_rows, bool)
        for k in keys:
            c = b.column(b.schema.get_field_index(k))
            new[1:] |= pa.compute.not_equal(c.slice(1), c.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
        cuts = [0, *np.nonzero(new)[0].tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            part = b.slice(lo, hi - lo)
            key = tuple(part.column(part.schema.get_field_index(k))[0].as_py() for k in keys)
            if held and key != now:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            now = key
            held.append(part)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
