"""Exact statistics over all ordered pairs of a chart's control points, without a row for any pair.

A chart of n points has n² pairs and up to 12 n² samples, so none of them is shuffled or stored. A chart is a row of arrays, cut
into units of consecutive left points; a unit measures its pairs block by block with numpy, by the same arithmetic as
`pairwise.gcp_pairs`, and hands over counts only. Pairs in the order of emission are left points in the order of "key|",
each with all right points in the order of "key", so the trim, which depends on that order, is a scan over units; a unit
counts for both parities that the run of outliers before it can have. A median is counted into bins over the middle of
a sample (the sample only places the bins), then the values of the bin that holds it are gathered with their counts.

Memory of a task is one unit's block, one chart's points and at most UNITS histograms. Points with a null or NaN
coordinate take part as `pairwise.gcp_pairs` has it for null; points without a key don't. Keys that a chart repeats leave
the order of their pairs open.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyplate.functions.ratio import PROCEDURE, polynomial
from skyplate.session import tasks

from .pairwise import LAT_BANDS, LEAST_PIXELS, MOST_LON, WEIGHTED

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

SERIES = ("x", "y", "ul_x", "ul_y", "lr_x", "lr_y")
#: Pairs measured at once, pairs of a unit, units of a chart at most, bins of a histogram and pairs of the sample that places them.
BLOCK, UNIT, UNITS, BINS, SAMPLE = 1 << 15, 1 << 24, 256, 1 << 14, 1 << 15

_POINT = ("px", "py", "lon", "lat", "width", "height", "target")
_UNIT_SCHEMA = "unit int, series int, head array<double>, at array<double>, n array<double>, n1 array<double>"


class Chart:
    """A chart's points by key, its left points in the order of emission, and the samples of their pairs."""

    def __init__(self, keys: list[str], columns: dict[str, np.ndarray]):
        self.c = columns
        n = self.n = len(keys)
        self.id = np.cumsum([0] + [keys[t] != keys[t - 1] for t in range(1, n)])
        self.order = np.array(sorted(range(n), key=lambda t: keys[t] + "|"), dtype=np.int64)
        self.holes = bool(np.isnan(np.concatenate([columns[c] for c in _POINT[:4]])).any())

    def measure(self, i: np.ndarray, j: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray], np.ndarray]:
        """Values of each series and how often they are emitted, in the order of the pairs; and the pairs' counts of implausible scales. i is a column, j a row, or both are alike."""
        c = self.c
        i, j = np.asarray(i), np.asarray(j)
        dx, dy, dlon, dlat = (c[k][i] - c[k][j] for k in _POINT[:4])
        ax, ay, alat = np.abs(dx), np.abs(dy), np.abs(dlat)
        use_y, use_x = (ay > LEAST_PIXELS) & (dlat != 0), (ax > LEAST_PIXELS) & (dlon != 0)
        if self.holes:
            use_y &= ~np.isnan(dlat)
            use_x &= ~np.isnan(dlon)
        keep = (self.id[i] != self.id[j]) & ~(use_y & (dy * dlat > 0))
        if self.holes:  # the sign is unknown, and with it whether the pair says anything
            keep &= ~((np.isnan(dy) & ~(dlat == 0)) | (np.isnan(dlat) & ~(ay <= LEAST_PIXELS)))
        ry, rx = alat / ay, np.abs(dlon) / ax
        banded = np.zeros(ry.shape, dtype=bool)
        for low, high in LAT_BANDS:
            banded |= (ry >= low) & (ry <= high)
        use_y &= keep
        use_x &= keep & (dx * dlon > 0)
        has_y, has_x = use_y & banded, use_x & (rx <= MOST_LON)
        bad = (use_y & ~banded).astype(np.int8) + (use_x & (rx > MOST_LON))
        left = np.broadcast_to(i, ry.shape).ravel()
        fy, fx = np.flatnonzero(has_y), np.flatnonzero(has_x)
        iy, ix = left[fy], left[fx]
        ry, rx = ry.ravel()[fy], rx.ravel()[fx]
        values = {"x": rx, "y": ry, "ul_y": c["lat"][iy] + c["py"][iy] * ry, "lr_y": c["lat"][iy] - np.abs(c["height"][iy] - c["py"][iy]) * ry}
        values |= {"ul_x": c["lon"][ix] - c["px"][ix] * rx, "lr_x": c["lon"][ix] + np.abs(c["width"][ix] - c["px"][ix]) * rx}
        both_y, both_x = has_x.ravel()[fy], has_y.ravel()[fx]
        ul_x, lr_x, ul_y, lr_y = values["ul_x"][both_x], values["lr_x"][both_x], values["ul_y"][both_y], values["lr_y"][both_y]
        twice = np.abs((ul_x - lr_x) / (ul_y - lr_y)) - c["target"][ix[both_x]] < WEIGHTED
        twice &= (ul_x != 0) & (ul_y != 0) & (lr_x != 0) & (lr_y != 0)
        often = {}
        for axis, both in (("x", both_x), ("y", both_y)):
            times = np.ones(len(both), dtype=np.int64)
            times[both] += twice
            often[axis] = times
        return values, {s: often[s[-1]] for s in SERIES}, bad

    def blocks(self, unit: int, units: int) -> Iterator[np.ndarray]:
        """The left points of a unit, some at a time."""
        bounds = [self.n * k // units for k in (unit, unit + 1)]
        rows, step = self.order[bounds[0] : bounds[1]], max(1, BLOCK // max(self.n, 1))
        for at in range(0, len(rows), step):
            yield rows[at : at + step]

    def pairs(self, unit: int, units: int) -> Iterator[tuple[dict[str, np.ndarray], dict[str, np.ndarray]]]:
        right = np.arange(self.n)[None, :]
        with np.errstate(all="ignore"):
            for rows in self.blocks(unit, units):
                values, often, _ = self.measure(rows[:, None], right)
                yield values, often

    def sample(self) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        """Samples of some pairs, the same in each unit."""
        rnd = np.random.default_rng(self.n)
        i, j = rnd.integers(0, self.n, (2, SAMPLE)) if self.n * self.n > SAMPLE else np.divmod(np.arange(self.n * self.n), self.n)
        with np.errstate(all="ignore"):
            values, often, _ = self.measure(i, j)
        return values, often

    def zones(self, bounds: dict[str, tuple[float, float]] | None = None) -> dict[str, tuple[float, float, float]]:
        """For each series where its bins begin and end, and a value from their middle. bounds: beyond these half the samples count."""
        out = {}
        values, often = self.sample()
        for s in SERIES:
            v, w = values[s], often[s].astype(float)
            v, w = v[np.isfinite(v)], w[np.isfinite(v)]
            if bounds and s in bounds:
                w = np.where((v < bounds[s][0]) | (v > bounds[s][1]), w / 2, w)
            if not len(v):
                out[s] = (0.0, 0.0, 0.0)
                continue
            by = np.argsort(v, kind="stable")
            v, share = v[by], np.cumsum(w[by]) / w.sum()
            out[s] = tuple(float(v[min(np.searchsorted(share, q), len(v) - 1)]) for q in (0.25, 0.75, 0.5))
        return out


def _bins(v: np.ndarray, zone: tuple[float, float, float]) -> np.ndarray:
    """Bins, in the order of values: 0 below the zone, BINS + 1 from its end on."""
    low, high, _ = zone
    scale = BINS / (high - low) if high > low else 0.0
    if not np.isfinite(scale):
        scale = 0.0
    inner = 1 + np.minimum(((np.clip(v, low, high) - low) * scale).astype(np.int64), BINS - 1)
    return np.where(v < low, 0, np.where(v >= high, BINS + 1, inner))


def _runs(out: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, bool, int, int]:
    """For each value how many outliers precede it in its run within the block; whether a run ends in the block; its values' number up to the first that is none (or all), and the length of the last run."""
    end = np.cumsum(often)
    start = end - often
    last = np.maximum.accumulate(np.where(out, 0, end)) if len(out) else end
    broke = bool((~out).any())
    lead = int(np.argmin(out)) if broke else len(out)
    tail = int(end[-1] - last[-1]) if len(out) else 0
    return start - last, broke, lead, tail


def _kept(out: np.ndarray, often: np.ndarray, before: np.ndarray) -> np.ndarray:
    """How often each value stays: of a run of outliers the 2nd, 4th ... do, so of a value that is emitted twice one."""
    return np.where(out, np.where(often == 2, 1, before & 1), often)


class Trim:
    """Follows the runs of outliers of one series through the blocks of a unit, for both parities of the run before it."""

    def __init__(self, low: float, high: float):
        self.low, self.high, self.broke, self.run = low, high, False, 0

    def __call__(self, v: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = (v < self.low) | (v > self.high)
        before, broke, lead, tail = _runs(out, often)
        before[:lead] += self.run
        even = _kept(out, often, before)
        odd = even
        if not self.broke and lead:
            odd = even.copy()
            odd[:lead] = _kept(out[:lead], often[:lead], before[:lead] + 1)
        self.run = tail if broke else self.run + tail
        self.broke |= broke
        return even, odd


def _merged(at: list[np.ndarray], *counts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Distinct places or values in order, with their summed counts."""
    if not at:
        return (np.zeros(0), *(np.zeros(0) for _ in counts))
    places, back = np.unique(np.concatenate(at), return_inverse=True)
    return (places, *(np.bincount(back, weights=np.concatenate(c), minlength=len(places)) for c in counts))


# Each step measures units (below) and joins their figures into a row of state for each series (join_ functions).


def _count(chart: Chart, unit: int, units: int, state: np.ndarray | None) -> Iterator[tuple]:
    zones = chart.zones()
    hist = {s: np.zeros(BINS + 2) for s in SERIES}
    sums = {s: np.zeros(2) for s in SERIES}
    for values, often in chart.pairs(unit, units):
        for s in SERIES:
            v, w = values[s], often[s]
            hist[s] += np.bincount(_bins(v, zones[s]), weights=w, minlength=BINS + 2)
            off = v - zones[s][2]
            sums[s] += (np.dot(w, off), np.dot(w, off * off))
    for k, s in enumerate(SERIES):
        at = np.flatnonzero(hist[s])
        yield k, sums[s], at, hist[s][at], None


def _pick(at: np.ndarray, n: np.ndarray) -> list[float]:
    """Number of values, first and last bin that hold the middle ones, and how many values come before."""
    total = n.sum()
    end = np.cumsum(n)
    first, last = (np.searchsorted(end, rank, side="right") for rank in ((total - 1) // 2, total // 2))
    return [total, at[first], at[last], end[first] - n[first]]


def _join_count(rows: list[dict]) -> list[float]:
    at, n = _merged([r["at"] for r in rows], [r["n"] for r in rows])
    total = n.sum()
    if not total:
        return [0.0] * 5
    first, second = np.sum([r["head"] for r in rows], axis=0)
    dev = (max(second - first * first / total, 0.0) / (total - 1)) ** 0.5 if total > 1 else 0.0
    return [*_pick(at, n), dev]


def _gather(chart: Chart, unit: int, units: int, state: np.ndarray) -> Iterator[tuple]:
    zones = chart.zones()
    found = {s: ([], []) for s in SERIES}
    for values, often in chart.pairs(unit, units):
        for k, s in enumerate(SERIES):
            b = _bins(values[s], zones[s])
            hit = (b >= state[k, 1]) & (b <= state[k, 2])
            found[s][0].append(values[s][hit])
            found[s][1].append(often[s][hit])
    for k, s in enumerate(SERIES):
        yield k, state[k], *_merged(*found[s]), None


def _median(rows: list[dict]) -> tuple[float, np.ndarray]:
    """The middle of all values, from those of its bins."""
    head = rows[0]["head"]
    if not head[0]:
        return np.nan, head
    at, n = _merged([r["at"] for r in rows], [r["n"] for r in rows])
    end = np.cumsum(n) + head[3]
    low, high = (at[np.searchsorted(end, rank, side="right")] for rank in ((head[0] - 1) // 2, head[0] // 2))
    return low * 0.5 + high * 0.5, head


def _join_band(rows: list[dict]) -> list[float]:
    mid, head = _median(rows)
    return [mid - head[4], mid + head[4]]


def _trim(chart: Chart, unit: int, units: int, state: np.ndarray) -> Iterator[tuple]:
    zones = chart.zones({s: tuple(state[k]) for k, s in enumerate(SERIES)})
    trims = {s: Trim(*state[k]) for k, s in enumerate(SERIES)}
    even, odd = ({s: np.zeros(BINS + 2) for s in SERIES} for _ in range(2))
    for values, often in chart.pairs(unit, units):
        for s in SERIES:
            kept, other = trims[s](values[s], often[s])
            b = _bins(values[s], zones[s])
            counts = np.bincount(b, weights=kept, minlength=BINS + 2)
            even[s] += counts
            odd[s] += counts if other is kept else np.bincount(b, weights=other, minlength=BINS + 2)
    for k, s in enumerate(SERIES):
        at = np.flatnonzero(even[s] + odd[s])
        yield k, [*state[k], trims[s].broke, trims[s].run & 1], at, even[s][at], odd[s][at]


def _join_trim(rows: list[dict]) -> list[float]:
    """Adds the parity that each unit finds."""
    odd, at, n, parities = 0, [], [], []
    for r in rows:
        parities.append(float(odd))
        at.append(r["at"])
        n.append(r["n1"] if odd else r["n"])
        odd = int(r["head"][3]) if r["head"][2] else odd ^ int(r["head"][3])
    places, counts = _merged(at, n)
    held = counts > 0
    picked = _pick(places[held], counts[held]) if held.any() else [0.0] * 4
    return [*picked, *rows[0]["head"][:2], *parities]


def _gather_kept(chart: Chart, unit: int, units: int, state: np.ndarray) -> Iterator[tuple]:
    zones = chart.zones({s: tuple(state[k, 4:6]) for k, s in enumerate(SERIES)})
    trims = {s: Trim(*state[k, 4:6]) for k, s in enumerate(SERIES)}
    found = {s: ([], []) for s in SERIES}
    for values, often in chart.pairs(unit, units):
        for k, s in enumerate(SERIES):
            kept = trims[s](values[s], often[s])[int(state[k, 6 + unit])]
            b = _bins(values[s], zones[s])
            hit = (b >= state[k, 1]) & (b <= state[k, 2]) & (kept > 0)
            found[s][0].append(values[s][hit])
            found[s][1].append(kept[hit])
    for k, s in enumerate(SERIES):
        yield k, state[k, :4], *_merged(*found[s]), None


def _join_median(rows: list[dict]) -> list[float]:
    return [_median(rows)[0]]


def _sum(chart: Chart, unit: int, units: int, state: None) -> Iterator[tuple]:
    sums = np.zeros((len(SERIES), 2))
    for values, often in chart.pairs(unit, units):
        for k, s in enumerate(SERIES):
            sums[k] += (often[s].sum(), np.dot(often[s], values[s]))
    for k in range(len(SERIES)):
        yield k, sums[k], (), (), None


def _join_sum(rows: list[dict]) -> list[float]:
    return list(np.sum([r["head"] for r in rows], axis=0))


def _charts(gcps: DataFrame, by: str, key: str) -> DataFrame:
    """One row per chart: arrays of its points by key, and the number of its units."""
    rows = gcps.where(F.col(key).isNotNull() & F.col(by).isNotNull()).withColumns({"_k": F.col(key).cast("string"), "target": polynomial(F.col("airport_lat"), PROCEDURE)})
    points = F.array_sort(F.collect_list(F.struct("_k", *(F.col(c).cast("double").alias(c) for c in _POINT))))
    n = F.size("_p").cast("double")
    units = F.least(F.greatest(F.ceil(n * n / UNIT), F.lit(1)), F.lit(UNITS), F.size("_p")).cast("int")
    return rows.groupBy(by).agg(points.alias("_p")).select(by, F.col("_p._k").alias("_k"), *(F.col(f"_p.{c}").alias(c) for c in _POINT), units.alias("units"))


def _chart_of(batch: pa.RecordBatch, row: int) -> Chart:
    def array(name: str) -> pa.Array:
        return batch.column(batch.schema.get_field_index(name))[row].values

    return Chart(array("_k").to_pylist(), {c: np.asarray(array(c).to_numpy(zero_copy_only=False), dtype=float) for c in _POINT})


def _step(charts: DataFrame, by: str, unit_of: Callable, join: Callable, state: DataFrame | None) -> DataFrame:
    """by, state: what join makes of each series' units, a chart's series one after the other."""
    kind = charts.schema[by].dataType.simpleString()
    rows = charts if state is None else charts.join(state, by)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                at = {n: batch.column(k)[row] for k, n in enumerate(batch.schema.names)}
                own = None if "state" not in at else np.asarray(at["state"].values.to_numpy(zero_copy_only=False), dtype=float).reshape(len(SERIES), -1)
                unit = at["unit"].as_py()
                found = list(unit_of(_chart_of(batch, row), unit, at["units"].as_py(), own))
                lists = [pa.array([None if f[k] is None else np.asarray(f[k], dtype=float) for f in found], pa.list_(pa.float64())) for k in (1, 2, 3, 4)]
                key = pa.array([at[by].as_py()] * len(found), at[by].type)
                yield pa.RecordBatch.from_arrays([key, pa.array([unit] * len(found), pa.int32()), pa.array([f[0] for f in found], pa.int32()), *lists], names=[by, "unit", "series", "head", "at", "n", "n1"])

    def merge(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values(["series", "unit"])
        out = [x for _, part in found.groupby("series") for x in join(part.to_dict("records"))]
        return pd.DataFrame({by: [found[by].iloc[0]], "state": [np.asarray(out, dtype=float)]})

    dealt = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("units") - 1)).alias("unit")).repartition(tasks(charts))
    return dealt.mapInArrow(measure, f"`{by}` {kind}, {_UNIT_SCHEMA}").groupBy(by).applyInPandas(merge, f"`{by}` {kind}, state array<double>")


def _series(state: DataFrame, by: str, *names: str) -> DataFrame:
    """One row per chart and series with the figures that its state holds."""
    rows = F.explode(F.array(*(F.struct(F.lit(s).alias("series"), *(F.col("state")[k * len(names) + c].alias(n) for c, n in enumerate(names))) for k, s in enumerate(SERIES)))).alias("_s")
    return state.select(by, rows).select(by, "_s.*")


def medians(gcps: DataFrame, by: str, key: str) -> DataFrame:
    """by, series, median: that of `robust_location` over the `samples` of `gcp_pairs`, exactly; series without samples are left out."""
    charts, state = _charts(gcps, by, key), None
    for unit_of, join in ((_count, _join_count), (_gather, _join_band), (_trim, _join_trim), (_gather_kept, _join_median)):
        state = _step(charts, by, unit_of, join, state)
    return _series(state, by, "median").where(F.col("median").isNotNull() & ~F.isnan("median"))


def totals(gcps: DataFrame, by: str, key: str) -> DataFrame:
    """by, series, n, total of the `samples` of `gcp_pairs`; series without samples are left out."""
    out = _series(_step(_charts(gcps, by, key), by, _sum, _join_sum, None), by, "n", "total")
    return out.where("n > 0").withColumn("n", F.col("n").cast("bigint"))
