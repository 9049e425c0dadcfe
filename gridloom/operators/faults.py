"""Implausible measurements: spikes, stuck values, impossible readings (problem 4).

Spikes are found by phase-space thresholding: what a reading is off the level around it, with its first and
second differences, must lie in an ellipsoid whose axes are robust scatters times the universal threshold.
What lies outside is taken out of the levels and the search runs again. Then the sides are parted at lasting changes of
level, and the ellipsoid is asked once more. Only what lies outside is a candidate; of those, spikes are the readings that
stand apart from the level on either side of them by more than `APART` times the source's usual scatter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.time import micros
from gridloom.operators.blocks import ordered_blocks
from gridloom.operators.grid import SOURCE, usable_readings
from gridloom.runtime import materialize

#: A spike stands apart by more than so many usual scatters.
APART = 7.0
#: Successive equal readings that make a stuck run.
STUCK = 10
#: Readings on either side that make the level there.
AROUND = 9
#: A pause longer than this (hours), and than PAUSE_STEPS usual steps of the source, parts two sides.
PAUSE_HOURS, PAUSE_STEPS = 3.0, 12.0
#: Rounds of the search, at most.
ROUNDS = 5
#: Sources of more readings are cut into blocks of this many, with a margin of neighbours: what all rounds of levels reach over.
BLOCK_ROWS, MARGIN = 100_000, 128
#: Properties that hold a value by design.
HELD = ("SetPoint",)
_CHUNK_ROWS = 200_000


def _by_segment_median(seg: np.ndarray, n_seg: int, x: np.ndarray) -> np.ndarray:
    """The median of the finite x of each segment (nan where there is none). seg is ascending."""
    ok = np.isfinite(x)
    s, y = seg[ok], x[ok]
    order = np.lexsort((y, s))
    y = y[order]
    count = np.bincount(s, minlength=n_seg)
    start = np.concatenate(([0], np.cumsum(count)))[:-1]
    out = np.full(n_seg, np.nan)
    has = count > 0
    lo, hi = start[has] + (count[has] - 1) // 2, start[has] + count[has] // 2
    out[has] = (y[lo] + y[hi]) / 2
    return out


def _row_medians(a: np.ndarray, least: int) -> np.ndarray:
    """The median of each row without its nans; nan where fewer than `least` are left."""
    a = np.sort(a, axis=1)  # nans come last
    n = np.isfinite(a).sum(axis=1)
    rows = np.arange(len(a))
    k = np.maximum(n, 1)
    out = (a[rows, (k - 1) // 2] + a[rows, k // 2]) / 2
    out[n < least] = np.nan
    return out


def _scatter(seg: np.ndarray, n_seg: int, x: np.ndarray) -> np.ndarray:
    """Robust standard deviation about zero by segment; from the mean where more than half are zero."""
    size = np.abs(x)
    s = 1.4826 * _by_segment_median(seg, n_seg, size)
    ok = np.isfinite(size)
    total, count = np.bincount(seg[ok], size[ok], n_seg), np.bincount(seg[ok], minlength=n_seg)
    mean = 1.2533 * total / np.maximum(count, 1)
    return np.where(s > 0, s, mean)


def sides(seg: np.ndarray, t: np.ndarray, usual: np.ndarray | None = None) -> np.ndarray:
    """Ascending numbers of the stretches between pauses; seg is ascending, t ascending within it. usual: each segment's step where known."""
    n_seg = int(seg[-1]) + 1
    step = np.diff(t).astype(float)
    same = seg[1:] == seg[:-1]
    if usual is None:
        usual = _by_segment_median(seg[1:][same], n_seg, step[same])
    part = np.ones(len(seg), bool)
    part[1:] = ~same | ((step > PAUSE_HOURS * 3600e6) & ~(step <= PAUSE_STEPS * usual[seg[1:]]))
    return np.cumsum(part) - 1


def levels(side: np.ndarray, v: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Level before, after and around each reading, from others of its side that aren't in `out`."""
    w = AROUND
    x = np.where(out, np.nan, v)
    x = np.concatenate((np.full(w, np.nan), x, np.full(w, np.nan)))
    d = np.concatenate((np.full(w, -1), side, np.full(w, -1)))
    win = np.lib.stride_tricks.sliding_window_view
    a, b = win(x, 2 * w + 1).copy(), win(d, 2 * w + 1)
    a[b != side[:, None]] = np.nan
    before, after = a[:, :w], a[:, w + 1 :]
    return _row_medians(before, 3), _row_medians(after, 3), _row_medians(np.concatenate((before, after), axis=1), 5)


def new_levels(side: np.ndarray, v: np.ndarray, out: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    """Where a lasting change of level begins: AROUND readings on either side differ by more than APART scatters.

    Of neighbouring places that part the levels at all, the one that leaves the least (each reading counts up to APART scatters).
    """
    w = AROUND
    x = np.concatenate((np.full(w, np.nan), np.where(out, np.nan, v), np.full(w, np.nan)))
    d = np.concatenate((np.full(w, -1), side, np.full(w, -1)))
    win = np.lib.stride_tricks.sliding_window_view
    a, b = win(x, w), win(d, w)
    n = len(v)
    before, after = np.where(b[:n] == side[:, None], a[:n], np.nan), np.where(b[w : n + w] == side[:, None], a[w : n + w], np.nan)
    low, high = _row_medians(before, 5), _row_medians(after, 5)
    found = np.zeros(n, bool)
    step = np.nan_to_num(np.abs(high - low)) / np.where(sigma > 0, sigma, np.inf)
    at = np.nonzero(step > APART / 2)[0]
    if len(at):
        most = APART * sigma[at][:, None]
        cost = np.nansum(np.minimum(np.abs(before[at] - low[at][:, None]), most), axis=1) + np.nansum(np.minimum(np.abs(after[at] - high[at][:, None]), most), axis=1)
        first = np.concatenate(([True], (np.diff(at) > 1) | (side[at[1:]] != side[at[:-1]])))
        run = np.cumsum(first) - 1
        order = np.lexsort((at, np.round(cost / most[:, 0], 6), run))
        best = at[order[np.concatenate(([True], np.diff(run[order]) > 0))]]
        found[best[np.maximum.reduceat(step[at], np.nonzero(first)[0]) > APART]] = True
    return found


def _off(v: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """How far v is off the nearer of the two levels; nan without a level."""
    a, b = v - before, v - after
    return np.where(np.isnan(b) | (np.abs(a) <= np.abs(b)), a, b)


def _phase_space(side: np.ndarray, v: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How far each reading is off its level, and the first and second differences of that within its side."""
    u = _off(v, before, after)
    u = np.where(np.isnan(u), 0.0, u)
    d1, d2 = np.zeros_like(u), np.zeros_like(u)
    inner = side[2:] == side[:-2]
    d1[1:-1] = np.where(inner, (u[2:] - u[:-2]) / 2, 0)
    d2[1:-1] = np.where(inner, u[2:] - 2 * u[1:-1] + u[:-2], 0)
    return u, d1, d2


class Ellipsoid:
    """Of each segment: axes from the scatters of value, first and second difference, times the universal threshold of n readings.

    The ellipse of value and second difference is turned by their usual slope; its axes are such that it reaches as far as
    either scatter does. So a value beyond its own scatter times the threshold lies outside, whatever its differences are.
    """

    def __init__(self, sigma: np.ndarray, s1: np.ndarray, s2: np.ndarray, turn: np.ndarray, n: np.ndarray):
        self.reach2 = 2 * np.log(np.maximum(n, 2))
        self.cos, self.sin, self.s1 = np.cos(turn), np.sin(turn), s1
        c2, w2 = self.cos**2, self.sin**2
        det = c2 * c2 - w2 * w2
        det = np.where(np.abs(det) < 1e-6, 1e-6, det)
        a2 = np.maximum((sigma**2 * c2 - s2**2 * w2) / det, sigma**2 * 0.25)
        b2 = np.maximum((s2**2 * c2 - sigma**2 * w2) / det, s2**2 * 0.25)
        # Where an axis had to be set, the ellipse is shrunk to the value's own scatter again.
        shrink = np.minimum(1, sigma**2 / np.maximum(a2 * c2 + b2 * w2, 1e-300))
        self.a2, self.b2 = a2 * shrink, b2 * shrink

    def outside(self, seg: np.ndarray, u: np.ndarray, d1: np.ndarray | float = 0.0, d2: np.ndarray | float = 0.0) -> np.ndarray:
        p, q = u * self.cos[seg] + d2 * self.sin[seg], d2 * self.cos[seg] - u * self.sin[seg]
        with np.errstate(divide="ignore", invalid="ignore"):
            r = p**2 / self.a2[seg] + q**2 / self.b2[seg] + np.where(d1 == 0, 0, d1**2 / (self.s1**2)[seg])
        return (r > self.reach2[seg]) & (np.abs(u) > 0)


def phase_space_spikes(seg: np.ndarray, t: np.ndarray, v: np.ndarray, bad: np.ndarray, known: dict | None = None) -> dict[str, np.ndarray]:
    """Candidates among the readings of many sources (seg ascending, t ascending within it), and what they were judged by.

    bad: readings known to be wrong, which neither make a level nor count for the scatter.
    Returns candidate, before, after by reading, sigma by segment and the last ellipsoid.

    known: what holds for the whole sources that the segments are blocks of: `usual` (steps) and for each round `scales`
    (sigma, s1, s2, turn, n), all by segment. If `open` is set, what the next round's scales come from is returned instead.
    """
    n_seg = int(seg[-1]) + 1
    side = sides(seg, t, known and known["usual"])
    out = bad.copy()
    last = out
    for i in range(ROUNDS if known is None else len(known["scales"]) + bool(known.get("open"))):
        before, after, around = levels(side, v, out)
        u, d1, d2 = _phase_space(side, v, before, after)
        off, e1, e2 = (np.where(out, np.nan, x) for x in (v - around, d1, d2))
        good = ~out
        if known is None:
            sigma, s1, s2 = (_scatter(seg, n_seg, x) for x in (off, e1, e2))
            uu = np.bincount(seg[good], u[good] ** 2, n_seg)
            turn = np.arctan2(np.bincount(seg[good], (u * d2)[good], n_seg), uu)
            n = np.bincount(seg, minlength=n_seg)
        elif i == len(known["scales"]):
            return {"off": off, "d1": e1, "d2": e2, "uu": np.where(good, u**2, 0), "ud": np.where(good, u * d2, 0), "changed": out != last}
        else:
            sigma, s1, s2, turn, n = known["scales"][i]
        shape = Ellipsoid(sigma, s1, s2, turn, n)
        new = (shape.outside(seg, u, d1, d2) & (np.abs(u) > 3 * sigma[seg])) | bad
        if known is None and (new == out).all():
            break
        last, out = out, new
    # Levels are those of a reading's own side of any lasting change.
    side = np.cumsum(np.concatenate(([0], np.diff(side))) + new_levels(side, v, out, sigma[seg]))
    before, after, _ = levels(side, v, out)
    far = APART * np.where(sigma > 0, sigma, np.inf)[seg]
    u, d1, d2 = _phase_space(side, v, before, after)
    out = out | (shape.outside(seg, u, d1, d2) & (np.abs(u) > far))
    before, after, _ = levels(side, v, out)
    candidate, alone = out, np.isnan(before) & np.isnan(after)
    if alone.any():  # too few others between two pauses: the level beyond the pauses must do
        far_before, far_after, _ = levels(seg, v, out)
        before, after = np.where(alone, far_before, before), np.where(alone, far_after, after)
        candidate = out | (alone & shape.outside(seg, np.nan_to_num(_off(v, before, after))))
    return {"candidate": candidate, "before": before, "after": after, "sigma": sigma, "shape": shape}


def stuck_runs(seg: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Whether a reading belongs to STUCK or more successive ones of its segment with the same number."""
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (seg[1:] != seg[:-1])
    run = np.cumsum(new) - 1
    return np.bincount(run)[run] >= STUCK


def _chunks(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole segments, from rows in order of them."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
        if rows < _CHUNK_ROWS:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        last = t.num_rows - 1
        same = np.ones(t.num_rows, bool)
        for k in keys:
            same &= pc.equal(t[k], t[k][last]).to_numpy(zero_copy_only=False)
        cut = int(np.argmax(same))
        if cut:
            yield t.slice(0, cut)
        held, rows = t.slice(cut).to_batches(), t.num_rows - cut
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _segments(t: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    for k in keys:
        c = t[k]
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, t.num_rows - 1)).to_numpy(zero_copy_only=False)
    return np.cumsum(new)


def judge(t: pa.Table, keys: list[str], known: dict[tuple, dict] | None = None) -> dict[str, np.ndarray]:
    """Faults of whole segments in order of (keys, at, received_at, id): a row's is_stuck and is_spike.

    known: what holds for the sources that the segments are blocks of (see `phase_space_spikes`), by source.
    """
    seg = _segments(t, keys)
    v = t["number"].to_numpy()
    first, s1, at1, v1, bad, runs = _firsts(t, seg)
    of = np.cumsum(first) - 1
    held = None
    if known is not None:
        heads = t.take(pa.array(np.searchsorted(seg, np.arange(seg[-1] + 1)))).select(SOURCE).to_pylist()
        mine = [known[tuple(h.values())] for h in heads]
        held = {"usual": np.array([k["usual"] for k in mine]), "scales": [np.array(x).T for x in zip(*(k["scales"] for k in mine))]}
    got = phase_space_spikes(s1, at1, v1, bad, held)
    off = _off(v, got["before"][of], got["after"][of])
    apart = np.abs(off) > APART * got["sigma"][seg]
    # Another reading of the same instant is judged by its own number.
    candidate = np.where(first, got["candidate"][of], got["shape"].outside(seg, np.nan_to_num(off)))
    spike = apart & candidate & (got["sigma"][seg] > 0)
    stuck = runs[of] & (v == v1[of])
    return {"is_spike": spike, "is_stuck": stuck}


def _firsts(t: pa.Table, seg: np.ndarray) -> tuple[np.ndarray, ...]:
    """Which rows are the reading of their instant (the one received first); the segment, instant, number of those, whether known to be wrong, whether stuck."""
    at, v = t["at"].to_numpy(), t["number"].to_numpy()
    beyond = t["is_beyond"].to_numpy(zero_copy_only=False)
    first = np.ones(len(seg), bool)
    first[1:] = (seg[1:] != seg[:-1]) | (at[1:] != at[:-1])
    runs = stuck_runs(seg[first], v[first])
    return first, seg[first], at[first], v[first], beyond[first] | runs, runs


_OF_SOURCE = "table_name string, entity_id string, property_name string"
_VALUES = f"{_OF_SOURCE}, kind string, n bigint, total double, data binary"


def _pack(keys: list[str]):
    """A row for each block: its readings, one per instant, and which are its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _chunks(batches, keys):
            seg = _segments(t, keys)
            first, s1, at, v, bad, _ = _firsts(t, seg)
            own = ~t["is_margin"].to_numpy(zero_copy_only=False)[first]
            cuts = np.searchsorted(s1, np.arange(seg[-1] + 2))
            heads = t.take(pa.array(np.searchsorted(seg, np.arange(seg[-1] + 1)))).select(SOURCE)
            for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                data = [pa.array([x[lo:hi].tobytes()], pa.binary()) for x in (at, v.astype(float), bad, own)]
                yield pa.RecordBatch.from_arrays([*(heads[c].slice(k, 1).combine_chunks() for c in SOURCE), *data], [*SOURCE, "at", "v", "bad", "own"])

    return run


def _block_values(known: dict[tuple, dict] | None):
    """Of each packed block's own readings, the sizes that the next scales are medians of, and sums; without `known` their steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                source = tuple(row[c] for c in SOURCE)
                at, v = np.frombuffer(row["at"], np.int64), np.frombuffer(row["v"], float)
                bad, own = np.frombuffer(row["bad"], bool), np.frombuffer(row["own"], bool)
                if known is None:
                    values, sums = {"step": np.diff(at).astype(float)[own[1:]]}, {}
                else:
                    k = known[source]
                    scales = [np.array(x)[:, None] for x in k["scales"]]
                    got = phase_space_spikes(np.zeros(len(v), int), at, v, bad, {"usual": np.array([k["usual"]]), "scales": scales, "open": True})
                    values = {c: np.abs(got[c][own & np.isfinite(got[c])]) for c in ("off", "d1", "d2")}
                    sums = {c: float(got[c][own].sum()) for c in ("uu", "ud", "changed")}
                rows = [(c, int(own.sum()), 0.0, x.tobytes()) for c, x in values.items()] + [(c, 0, x, None) for c, x in sums.items()]
                kind, n, total, data = (list(x) for x in zip(*rows))
                yield pa.RecordBatch.from_arrays([*(pa.array([s] * len(rows), pa.string()) for s in source), pa.array(kind), pa.array(n, pa.int64()), pa.array(total, pa.float64()), pa.array(data, pa.binary())], [*SOURCE, "kind", "n", "total", "data"])

    return run


def _picked(bins: dict[tuple, tuple] | None):
    """Counts of the values of each block: by the leading bits of the number, or of the numbers themselves in the `bins` given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                key = tuple(row[c] for c in (*SOURCE, "kind"))
                x = np.frombuffer(row["data"], float)
                bits = x.view(np.int64) >> 44  # in the order of the numbers, as none is negative
                if bins is not None:
                    x = x[np.isin(bits, bins[key])] if key in bins else x[:0]
                    bits = x.view(np.int64)
                values, at, n = np.unique(bits, return_inverse=True, return_counts=True)
                total = np.bincount(at, x, len(values))
                yield pa.RecordBatch.from_arrays([*(pa.array([k] * len(values), pa.string()) for k in key), pa.array(values), pa.array(n), pa.array(total, pa.float64())], [*SOURCE, "kind", "bits", "n", "total"])

    return run


def exact_medians(values: DataFrame) -> dict[tuple, tuple[float, float]]:
    """(*source, kind): the median and the mean of all values of a source's blocks.

    Counts by leading bits (256 a doubling) find the bins of the two middle values; then only what lies in those is
    counted by value. No task sees more of a source than that.
    """
    keys = [*SOURCE, "kind"]
    held = values.where("data IS NOT NULL")
    running, whole = Window.partitionBy(*keys).orderBy("bits"), Window.partitionBy(*keys)

    def counts(bins: dict[tuple, tuple] | None) -> DataFrame:
        got = held.mapInArrow(_picked(bins), f"{_OF_SOURCE}, kind string, bits bigint, n bigint, total double")
        got = got.groupBy(*keys, "bits").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        return got.withColumn("upto", F.sum("n").over(running))

    ranked = counts(None).withColumn("all", F.sum("n").over(whole)).withColumn("sum", F.sum("total").over(whole))
    bins, rank, mean = {}, {}, {}
    for r in ranked.where("upto > (all - 1) div 2 AND upto - n <= all div 2").collect():
        key = tuple(r[c] for c in keys)
        bins[key] = (*bins.get(key, ()), r["bits"])
        skip = min(r["upto"] - r["n"], rank[key][2]) if key in rank else r["upto"] - r["n"]
        rank[key], mean[key] = ((r["all"] - 1) // 2, r["all"] // 2, skip), r["sum"] / r["all"]
    if not bins:
        return {}
    ranks = held.sparkSession.createDataFrame([(*k, lo - skip, hi - skip) for k, (lo, hi, skip) in rank.items()], f"{_OF_SOURCE}, kind string, lo bigint, hi bigint")
    middle: dict[tuple, list[float]] = {}
    for r in counts(bins).join(F.broadcast(ranks), keys).where("upto > lo AND upto - n <= hi").collect():
        middle.setdefault(tuple(r[c] for c in keys), []).append(float(np.int64(r["bits"]).view(np.float64)))
    return {k: ((min(x) + max(x)) / 2, mean[k]) for k, x in middle.items()}


def _known(packed: DataFrame) -> dict[tuple, dict]:
    """By source, the usual step and each round's scales over all own readings of its blocks, as for a source of one block."""
    steps = materialize(packed.mapInArrow(_block_values(None), _VALUES), "steps")
    medians = exact_medians(steps)
    known = {}
    for r in steps.groupBy(*SOURCE).agg(F.sum("n").alias("n")).collect():
        source = tuple(r[c] for c in SOURCE)
        known[source] = {"usual": medians.get((*source, "step"), (np.nan, 0))[0], "n": r["n"], "scales": []}
    for i in range(ROUNDS):
        values = materialize(packed.mapInArrow(_block_values(known), _VALUES), "scales")
        sums = {tuple(r[c] for c in (*SOURCE, "kind")): r["total"] for r in values.where("data IS NULL").groupBy(*SOURCE, "kind").agg(F.sum("total").alias("total")).collect()}
        if i and not any(x for k, x in sums.items() if k[-1] == "changed"):
            break
        medians = exact_medians(values)
        for source, k in known.items():
            scatter = [1.4826 * m if m > 0 else 1.2533 * mean for m, mean in (medians.get((*source, c), (0.0, 0.0)) for c in ("off", "d1", "d2"))]
            k["scales"].append((*scatter, float(np.arctan2(sums[(*source, "ud")], sums[(*source, "uu")])), k["n"]))
    return known


def _flag(keys: list[str], known: dict[tuple, dict] | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _chunks(batches, keys):
            got = judge(t, keys, known)
            beyond, held = (t[c].to_numpy(zero_copy_only=False) for c in ("is_beyond", "is_held"))
            spike, stuck = got["is_spike"] & ~held, got["is_stuck"] & ~held
            keep = (beyond | spike | stuck) & ~t["is_margin"].to_numpy(zero_copy_only=False)
            rows = t.select(["id", *SOURCE, "at", "number", "is_beyond"]).append_column("is_stuck", pa.array(stuck)).append_column("is_spike", pa.array(spike))
            yield from rows.filter(pa.array(keep)).to_batches()

    return run


def faulty_readings(values: DataFrame, limits: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The usable base values that are implausible: id, source, at, number, is_beyond, is_stuck, is_spike.

    * is_beyond: outside the property's limits (both ends allowed; a channel `Name.0001` has those of `Name`;
      a null limit or none is no bound).
    * is_stuck: of ten or more successive readings with the same number, one reading per instant (the one received
      first). Other readings of an instant count if they have the run's number.
    * is_spike: see the module. A source needs five readings, and some scatter, for a spike.
    * `SetPoint` sources hold a value by design: only limits apply.
    * Copies of a row (same id) are one. Values that are no numbers, lost clocks and null ids are not considered.

    A source that is cut into blocks is judged by the steps and scatters of all its readings, as one that isn't.
    """
    base = F.substring_index("property_name", ".", 1)
    known = limits.groupBy(F.col("property_name").alias("limited")).agg(F.max("min_value").alias("lo"), F.min("max_value").alias("hi"))
    rows = (
        usable_readings(values)
        .where("id IS NOT NULL")
        .groupBy("id", *SOURCE, micros("reading_timestamp").alias("at"), "number")
        .agg(F.min("received_at").alias("received_at"))
        .withColumn("limited", base)
        .join(known, "limited", "left")
        .withColumn("is_beyond", F.coalesce((F.col("number") < F.col("lo")) | (F.col("number") > F.col("hi")), F.lit(False)))
        .withColumn("is_held", F.col("limited").isin(*HELD))
        .select("id", *SOURCE, "at", "number", "received_at", "is_beyond", "is_held")
    )
    rows, cut = ordered_blocks(rows, SOURCE, "at", ["received_at", "id"], block_rows, MARGIN)
    keys = [*SOURCE, "block"]
    ordered = lambda df: df.repartition(*keys).sortWithinPartitions(*keys, "at", "received_at", "id").drop("received_at")
    schema = f"id string, {_OF_SOURCE}, at bigint, number double, is_beyond boolean, is_stuck boolean, is_spike boolean"
    found = ordered(rows).mapInArrow(_flag(keys), schema)
    if cut is None:
        return found
    cut = materialize(cut, "cut-sources")
    packed = materialize(ordered(cut).mapInArrow(_pack(keys), f"{_OF_SOURCE}, at binary, v binary, bad binary, own binary"), "blocks")
    return found.unionByName(ordered(cut).mapInArrow(_flag(keys, _known(packed)), schema))
