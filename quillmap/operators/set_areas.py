"""Areas of set operations on two layers of crossing regions, cell by cell, without noding what lies inside other regions.

A region sends a row for each cell that its border passes, and the runs of cells that it covers. Where one region of a layer
covers a cell, the borders of the others there do not matter, so only cells at the edge of a layer are looked into. Those are
cut into upright slabs between the corners and crossings in them, in numpy, all cells of a block side by side. Coordinates are
whole units and cell lines lie at half units; nothing is snapped.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .overlay import EDGE, OPERATIONS, snapped_segments
from .small_sheets import spread

#: Cells along each side of a block, whose cells are passed through together; cells with more border rows are quartered.
BLOCK, CROWD = 16, 24
#: About so many pairs of a slab and a segment are looked at side by side.
SIDE_BY_SIDE = 2_000_000


def areas(features: DataFrame, keys: Sequence[str], unit: float, layer: str = "layer", rings: str = "rings", cell: int | None = None) -> DataFrame:
    """(keys, union, intersection, ...): areas of the OPERATIONS on layers x and y, each the union of its rows.

    A row is one region, the points with an odd number of its rings around them. A key without area has no row.
    """
    keys = list(keys)
    f = features.select(*keys, F.when(F.col(layer) == "x", 0).when(F.col(layer) == "y", 1).alias("layer"), F.monotonically_increasing_id().alias("feature"), F.col(rings).alias("rings"))
    for k in keys:
        f = f.where(F.col(k).isNotNull())
    segs = snapped_segments(f.where("layer IS NOT NULL"), [*keys, "layer", "feature"], unit).drop("way")
    if cell is None:
        span = segs.agg(F.avg(F.greatest(F.col("bx") - F.col("ax"), F.abs(F.col("by") - F.col("ay"))))).first()[0]
        cell = 1 << max(2, int(np.log2(max(span or 1, 2))) - 1)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in segs.schema if f.name in keys)
    dealt = segs.mapInArrow(lambda b: _dealt(b, keys, cell), f"{types}, __bk int, __br int, layer int, feature long, __k int, __r int, __n int, __inside int, {', '.join(f'{c} long' for c in EDGE)}")
    found = dealt.groupBy(*keys, "__bk", "__br").applyInArrow(lambda t: _block(t, keys, cell), f"{types}, {', '.join(f'`{o}` double' for o in OPERATIONS)}")
    total = found.groupBy(*keys).agg(*[(F.sum(o) * (unit * unit)).alias(o) for o in OPERATIONS])
    return total.where(F.col("union") > 0)


def _dealt(batches: Iterator[pa.RecordBatch], keys: list[str], cell: int) -> Iterator[pa.RecordBatch]:
    """Rows of borders (n is 0) and runs of n covered cells. The segments of a feature stand side by side, maybe in two batches."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        feature = table.column("feature").to_numpy()
        whole = int(np.flatnonzero(feature != feature[-1])[-1]) + 1 if len(feature) and feature[0] != feature[-1] else 0
        rest = table.slice(whole)
        if whole:
            yield from _rows(table.slice(0, whole), keys, cell).to_batches()
    if rest is not None and len(rest):
        yield from _rows(rest, keys, cell).to_batches()


def _rows(table: pa.Table, keys: list[str], cell: int) -> pa.Table:
    ax, ay, bx, by = (table.column(c).to_numpy() for c in EDGE)
    feature = table.column("feature").to_numpy()
    of = np.concatenate([[0], np.cumsum(feature[1:] != feature[:-1])])
    at = lambda v: (v - 1) // cell
    i, k = spread(at(ax), at(bx) + 1)
    x0 = k * cell + 0.5
    dx, dy = (bx - ax)[i], (by - ay)[i]
    rise = lambda x: ay[i] + dy * (x - ax[i]) / np.maximum(dx, 1)
    y = rise(np.maximum(x0, ax[i])), np.where(dx == 0, by[i], rise(np.minimum(x0 + cell, bx[i])))
    low, high = (np.floor((m(*y) - 0.5 + e) / cell).astype(np.int64) for m, e in ((np.minimum, -1e-6), (np.maximum, 1e-6)))
    j, r = spread(low, high + 1)
    s, k2 = i[j], k[j]
    # Steps: where a segment crosses the left line of a column, corners at or above it have one more below them.
    cross = k > at(ax)[i]
    num = 2 * ay[i] * dx + (2 * k * cell + 1 - 2 * ax[i]) * dy - dx
    step = -((-num[cross]) // (2 * cell * dx[cross]))
    # Places within a feature, so that numbers stay small.
    begin = np.flatnonzero(np.append(True, of[i][1:] != of[i][:-1]))
    lo_k, lo_r = np.minimum.reduceat(k, begin), np.minimum.reduceat(low, begin) - 1
    wide_k, wide_r = (k - lo_k[of[i]]).max() + 1, (high - lo_r[of[i]]).max() + 3
    code = lambda f, k, r: (f * wide_k + (k - lo_k[f])) * wide_r + (r - lo_r[f])
    steps = np.sort(code(of[i[cross]], k[cross], step))
    odd = lambda f, k, r: (np.searchsorted(steps, code(f, k, r), "right") - np.searchsorted(steps, code(f, k, lo_r[f]))) % 2
    inside = odd(of[s], k2, r)
    # Cells between two border cells of a column are wholly inside or outside.
    held, nth = np.unique(code(of[s], k2, r), return_index=True)
    f, c, row = of[s][nth], k2[nth], r[nth]
    gap = np.flatnonzero((f[1:] == f[:-1]) & (c[1:] == c[:-1]) & (row[1:] > row[:-1] + 1))
    gap = gap[odd(f[gap], c[gap], row[gap] + 1) == 1]
    first, last = row[gap] + 1, row[gap + 1] - 1
    g, block = spread(first // BLOCK, last // BLOCK + 1)
    start, end = np.maximum(first[g], block * BLOCK), np.minimum(last[g], block * BLOCK + BLOCK - 1)
    src = np.concatenate([s, s[nth][gap][g]])
    zero = np.zeros(len(start), np.int64)
    kk, rr = np.concatenate([k2, c[gap][g]]), np.concatenate([r, start])
    n = np.concatenate([np.zeros(len(s), np.int64), end - start + 1])
    out = {
        "__bk": kk // BLOCK, "__br": rr // BLOCK, "layer": table.column("layer").to_numpy()[src], "feature": np.concatenate([feature[s], zero]), "__k": kk, "__r": rr, "__n": n, "__inside": np.concatenate([inside, zero]),
        **{e: np.concatenate([v[s], zero]) for e, v in zip(EDGE, (ax, ay, bx, by), strict=True)},
    }
    kinds = {"feature": pa.int64(), **dict.fromkeys(EDGE, pa.int64())}
    picked = table.select(keys).take(pa.array(src))
    return pa.table([*picked.columns, *[pa.array(v, kinds.get(c, pa.int32())) for c, v in out.items()]], names=[*keys, *out])


def _block(table: pa.Table, keys: list[str], cell: int) -> pa.Table:
    total = np.zeros(len(OPERATIONS))
    n, k, r, layer = (table.column(c).to_numpy() for c in ("__n", "__k", "__r", "layer"))
    k, r = k - (table.column("__bk")[0].as_py() * BLOCK), r - (table.column("__br")[0].as_py() * BLOCK)
    covers = np.zeros((2, BLOCK, BLOCK + 1), np.int64)
    run = n > 0
    np.add.at(covers, (layer[run], k[run], r[run]), 1)
    np.add.at(covers, (layer[run], k[run], (r + n)[run]), -1)
    cover = (np.cumsum(covers, 2) > 0)[:, :, :BLOCK].reshape(2, -1)
    place = k * BLOCK + r
    keep = ~run & ~cover[layer, place]
    rows = [table.column(c).to_numpy()[keep].astype(np.int64) for c in ("layer", "feature", "__inside", *EDGE)]
    corner = np.stack([np.repeat(np.arange(BLOCK), BLOCK) + table.column("__bk")[0].as_py() * BLOCK, np.tile(np.arange(BLOCK), BLOCK) + table.column("__br")[0].as_py() * BLOCK]) * cell + 0.5
    at = place[keep]
    while True:
        m = np.bincount(at, minlength=cover.shape[1])
        total += _sums(cover[0] & (m == 0), cover[1] & (m == 0), float(cell * cell))
        crowded = (m > CROWD) & (cell > 1)
        calm = (m > 0) & ~crowded
        which = calm[at]
        if which.any():
            total += _inside(at[which], [v[which] for v in rows], cover, corner, cell)
        if not crowded.any():
            break
        which = crowded[at]
        at, rows, cover, corner = _quartered(at[which], [v[which] for v in rows], cover, corner, cell, np.flatnonzero(crowded))
        cell //= 2
    first = table.select(keys).slice(0, 1)
    return pa.table([*first.columns, *[pa.array([float(v)]) for v in total]], names=[*keys, *OPERATIONS])


def _sums(x: np.ndarray, y: np.ndarray, size) -> np.ndarray:
    return np.array([(keep(x, y) * size).sum() for keep in OPERATIONS.values()])


def _bottom(rows: Sequence[np.ndarray], x0: np.ndarray, y0: np.ndarray) -> np.ndarray:
    """Where segments cross the lower line of their cell, right of its corner; infinite where they do not.

    The corner counts as moved upwards by a little: what passes through it is below, and rises past the line at once or not at all.
    """
    ax, ay, bx, by = rows[3:]
    dy = by - ay
    x = ax + (bx - ax) * (y0 - ay) / np.where(dy == 0, 1, dy)
    crosses = (np.minimum(ay, by) < y0) & (y0 < np.maximum(ay, by)) & ((x > x0) | ((x == x0) & (dy > 0) & (bx > ax)))
    return np.where(crosses, x, np.inf)


def _quartered(at, rows, cover, corner, cell, crowded):
    """Cells `crowded` in quarters: (place of each row, rows, cover, corners); a region that a quarter lies in covers it."""
    layer, feature, inside, ax, ay, bx, by = rows
    of = np.searchsorted(crowded, at)
    x0, y0 = corner[0][at], corner[1][at]
    half = cell // 2
    low = _bottom(rows, x0, y0)
    dx, dy = bx - ax, by - ay
    places, found = [], []
    pairs, first, member = np.unique(np.stack([of, feature]), axis=1, return_index=True, return_inverse=True)
    member = member.ravel()
    now = cover[:, crowded].repeat(4, axis=1)
    for q in range(4):
        left, floor = x0 + (q // 2) * half, y0 + (q % 2) * half
        # To the corner of the quarter along the lower line, then upwards.
        toggles = ((low < left) | ((low == left) & (dy < 0))).astype(np.int64)
        if q % 2:
            height = ay + dy * (left - ax) / np.where(dx == 0, 1, dx)
            toggles += (ax < left) & (left < bx) & (height > y0) & (height <= floor)
        odd = (inside[first] + np.bincount(member, toggles, len(first)).astype(np.int64)) % 2
        a, b = np.maximum(left, ax), np.minimum(left + half, bx)
        ya, yb = (ay + dy * (v - ax) / np.where(dx == 0, 1, dx) for v in (a, b))
        yb = np.where(dx == 0, by, yb)
        touches = (a <= b) & (np.minimum(ya, yb) <= floor + half + 1e-6) & (np.maximum(ya, yb) >= floor - 1e-6)
        whole = (np.bincount(member[touches], minlength=len(first)) == 0) & (odd == 1)
        now[layer[first][whole], pairs[0][whole] * 4 + q] = True
        keep = np.flatnonzero(touches)
        places.append(of[keep] * 4 + q)
        found.append([layer[keep], feature[keep], odd[member[keep]], ax[keep], ay[keep], bx[keep], by[keep]])
    at = np.concatenate(places)
    rows = [np.concatenate(c) for c in zip(*found, strict=True)]
    quarter = np.tile(np.arange(4), len(crowded))
    corner = np.stack([corner[0][crowded].repeat(4) + quarter // 2 * half, corner[1][crowded].repeat(4) + quarter % 2 * half])
    keep = ~now[rows[0], at]
    return at[keep], [v[keep] for v in rows], now, corner


def _inside(at: np.ndarray, rows: Sequence[np.ndarray], cover: np.ndarray, corner: np.ndarray, cell: int) -> np.ndarray:
    order = np.argsort(at, kind="stable")
    at, rows, total = at[order], [v[order] for v in rows], np.zeros(len(OPERATIONS))
    cells, start, m = np.unique(at, return_index=True, return_counts=True)
    batch = np.cumsum(m.astype(float) ** 3) // SIDE_BY_SIDE
    for group in np.split(np.arange(len(cells)), np.flatnonzero(np.diff(batch)) + 1):
        part = slice(start[group[0]], start[group[-1]] + m[group[-1]])
        of = np.repeat(np.arange(len(group)), m[group])
        total += _slabs(of, [v[part] for v in rows], cover[:, cells[group]], corner[:, cells[group]], cell)
    return total


def _slabs(of: np.ndarray, rows: Sequence[np.ndarray], cover: np.ndarray, corner: np.ndarray, cell: int) -> np.ndarray:
    """Sums over cells of what each operation keeps; of: the cell of each row, sorted."""
    layer, feature, inside, ax, ay, bx, by = rows
    dx, dy = bx - ax, by - ay
    x0, y0 = corner[0][of], corner[1][of]
    x1, y1 = x0 + cell, y0 + cell
    bounds = np.searchsorted(of, np.arange(cover.shape[1] + 1))
    low = _bottom(rows, x0, y0)
    run = np.where(dy == 0, 1, dy)
    # Corners, ways in and out, and crossings.
    events = [(np.arange(cover.shape[1]), corner[0]), (np.arange(cover.shape[1]), corner[0] + cell)]
    events += [(of, v) for v in (ax, bx, ax + dx * (y0 - ay) / run, ax + dx * (y1 - ay) / run)]
    i, j = spread(np.arange(1, len(of) + 1), bounds[of + 1])
    d = (dx[i] * dy[j] - dy[i] * dx[j]).astype(float)
    i, j, d = i[d != 0], j[d != 0], d[d != 0]
    t = (ax[j] - ax[i]) * dy[j] - (ay[j] - ay[i]) * dx[j]
    x, y = ax[i] + dx[i] * t / d, ay[i] + dy[i] * t / d
    near = (y > y0[i]) & (y < y1[i])
    events.append((of[i][near], x[near]))
    c, x = (np.concatenate(v) for v in zip(*events, strict=True))
    in_ = (x >= corner[0][c]) & (x <= corner[0][c] + cell)
    c, x = c[in_], x[in_]
    order = np.lexsort((x, c))
    c, x = c[order], x[order]
    slab = np.flatnonzero((c[1:] == c[:-1]) & (x[1:] > x[:-1]))
    wide, mid, sc = x[slab + 1] - x[slab], (x[slab] + x[slab + 1]) / 2, c[slab]
    s, i = spread(bounds[sc], bounds[sc + 1])
    # Whether the lower end of a slab lies in a region, and how many of a layer it lies in.
    name = np.unique(feature, return_inverse=True)[1].ravel()
    member, first, back = np.unique(s * (name.max() + 1) + name[i], return_index=True, return_inverse=True)
    back = back.ravel()
    base = (inside[i][first] + np.bincount(back, low[i] < mid[s], len(member)).astype(np.int64)) % 2
    floor = [np.bincount(s[first], base * (layer[i][first] == l), len(slab)) + cover[l][sc] for l in (0, 1)]
    height = ay[i] + dy[i] * (mid[s] - ax[i]) / np.where(dx[i] == 0, 1, dx[i])
    up = np.flatnonzero((ax[i] < mid[s]) & (mid[s] < bx[i]) & (height > y0[i]) & (height < y1[i]))
    up = up[np.lexsort((height[up], back[up]))]
    nth = np.arange(len(up)) - np.searchsorted(back[up], back[up])
    change = 1 - 2 * ((base[back[up]] + nth) % 2)
    where, level = np.concatenate([np.arange(len(slab)), s[up]]), np.concatenate([corner[1][sc], height[up]])
    order = np.lexsort((level, where))
    where, level = where[order], level[order]
    begin = np.searchsorted(where, where)
    counts = []
    for l in (0, 1):
        sums = np.cumsum(np.concatenate([floor[l], change * (layer[i][up] == l)])[order])
        counts.append(sums - np.where(begin > 0, sums[begin - 1], 0))
    top = np.append(level[1:], 0.0)
    last = np.append(where[1:] != where[:-1], True)
    top[last] = corner[1][sc][where[last]] + cell
    return _sums(counts[0] > 0, counts[1] > 0, (top - level) * wide[where])
