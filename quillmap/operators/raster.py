"""Raster kernels in numpy, and their DataFrame forms over one image or tile at a time.

A kernel takes a dense mask (rows are y) and is handed one image's foreground by applyInArrow, so a task's memory is
bounded by the size of an image. Borders are background.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EIGHT = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]
FOUR = [(-1, 0), (0, -1), (0, 1), (1, 0)]


def moved(mask: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """The mask's value at (y + dy, x + dx), 0 outside."""
    out = np.zeros_like(mask)
    h, w = mask.shape
    if abs(dy) < h and abs(dx) < w:
        out[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = mask[max(0, dy) : h - max(0, -dy), max(0, dx) : w - max(0, -dx)]
    return out


def neighbour_count(mask: np.ndarray) -> np.ndarray:
    m = mask.astype(np.uint8)
    return sum(moved(m, dy, dx) for dy, dx in EIGHT)


def box(height: int, width: int) -> np.ndarray:
    return np.ones((height, width), bool)


def ellipse(size: int) -> np.ndarray:
    c = (size - 1) / 2
    y, x = np.mgrid[:size, :size]
    return ((y - c) / max(c, 0.5)) ** 2 + ((x - c) / max(c, 0.5)) ** 2 <= 1 + 1e-9


def dilate(mask: np.ndarray, shape: np.ndarray) -> np.ndarray:
    h, w = shape.shape
    out = np.zeros_like(mask, bool)
    for dy, dx in np.argwhere(shape):
        out |= moved(mask.astype(bool), h // 2 - dy, w // 2 - dx)
    return out


def erode(mask: np.ndarray, shape: np.ndarray) -> np.ndarray:
    h, w = shape.shape
    out = np.ones_like(mask, bool)
    for dy, dx in np.argwhere(shape):
        out &= moved(mask.astype(bool), dy - h // 2, dx - w // 2)
    return out


def opened(mask: np.ndarray, shape: np.ndarray) -> np.ndarray:
    return dilate(erode(mask, shape), shape)


def closed(mask: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Closing over a border wide enough that the image's edge erodes nothing."""
    p = max(shape.shape)
    return erode(dilate(np.pad(mask.astype(bool), p), shape), shape)[p:-p, p:-p]


RING = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]


def _removable(turn: int) -> np.ndarray:
    """Whether a pixel may go in a subcycle, by its eight neighbours as the bits of a byte in the order of RING."""
    p = np.arange(256) >> np.arange(8)[:, None] & 1
    crossings = sum((p[k] == 0) & (p[(k + 1) % 8] == 1) for k in range(8))
    north, east, south, west = p[0], p[2], p[4], p[6]
    sides = (north * east * south == 0) & (east * south * west == 0) if turn == 0 else (north * east * west == 0) & (north * south * west == 0)
    return (p.sum(axis=0) >= 2) & (p.sum(axis=0) <= 6) & (crossings == 1) & sides


REMOVABLE = [_removable(0), _removable(1)]


def thinned_once(img: np.ndarray) -> np.ndarray:
    """One step of thin() on a mask of bytes with a border of zeros."""
    h, w = img.shape
    for table in REMOVABLE:
        wide = np.zeros((h + 2, w + 2), np.uint8)
        wide[1:-1, 1:-1] = img
        around = np.zeros((h, w), np.uint8)
        for k, (dy, dx) in enumerate(RING):
            around |= wide[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] << k
        gone = table[around] & (img == 1)
        if gone.any():
            img = np.where(gone, np.uint8(0), img)
    return img


def thin(mask: np.ndarray) -> np.ndarray:
    """Skeleton by parallel thinning in two subcycles: border pixels whose neighbourhood stays connected go until none can."""
    img = np.pad(mask.astype(np.uint8), 1)
    while (new := thinned_once(img)) is not img:
        img = new
    return _without_stairs(img.astype(bool))[1:-1, 1:-1]


def _without_stairs(img: np.ndarray) -> np.ndarray:
    """Drop the corners of stairs, whose two neighbours touch diagonally anyway; each kind of corner in its own pass."""
    for v, h in ((-1, 1), (-1, -1), (1, 1), (1, -1)):
        side = {(dy, dx): moved(img, dy, dx) for dy, dx in EIGHT}
        others_free = ~side[-v, 0] | ~side[0, -h]
        corner = img & side[v, 0] & side[0, h] & ~side[v, h] & ~side[-v, -h] & others_free
        # Of two corners that stand together only one goes.
        corner &= ~moved(corner, -v, h)
        img = img & ~corner
    return img


def morphological_skeleton(mask: np.ndarray) -> np.ndarray:
    """What openings of ever smaller erosions leave."""
    cross = np.array([[0, 1, 0], [1, 1, 1], [0, 1, 0]], bool)
    img, out = mask.astype(bool), np.zeros_like(mask, bool)
    while img.any():
        small = erode(img, cross)
        out |= img & ~dilate(small, cross)
        img = small
    return out


def label(mask: np.ndarray, connectivity: int = 8) -> np.ndarray:
    """Components numbered from 1 in the order of their first pixel; runs of rows joined by union-find."""
    h, w = mask.shape
    padded = np.zeros((h, w + 2), np.int8)
    padded[:, 1:-1] = mask.astype(bool)
    d = np.diff(padded, axis=1)
    ry, rs = np.nonzero(d == 1)
    _, re_ = np.nonzero(d == -1)
    parent = np.arange(len(ry))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(ry, np.arange(h + 1))
    reach = 1 if connectivity == 8 else 0
    for y in range(1, h):
        a, a_end, b, b_end = first[y - 1], first[y], first[y], first[y + 1]
        while a < a_end and b < b_end:
            if rs[a] < re_[b] + reach and rs[b] < re_[a] + reach:
                x, z = root(a), root(b)
                parent[max(x, z)] = min(x, z)
            if re_[a] < re_[b]:
                a += 1
            else:
                b += 1
    roots = np.array([root(i) for i in range(len(parent))], int)
    _, number = np.unique(roots, return_inverse=True)
    out = np.zeros((h, w), np.int32)
    for y, s, e, n in zip(ry, rs, re_, number, strict=True):
        out[y, s:e] = n + 1
    return out


def distance_to_background(mask: np.ndarray) -> np.ndarray:
    """Exact Euclidean distance: along columns first, then the lower envelope along each row."""
    h, w = mask.shape
    far = float(h + w)
    g = np.where(mask, far, 0.0)
    for y in range(1, h):
        g[y] = np.minimum(g[y], g[y - 1] + 1)
    for y in range(h - 2, -1, -1):
        g[y] = np.minimum(g[y], g[y + 1] + 1)
    x = np.arange(w)
    span = (x[:, None] - x[None, :]) ** 2
    return np.sqrt(np.stack([(span + g[y][None, :] ** 2).min(axis=1) for y in range(h)])) if h and w else g


def edges(grey: np.ndarray, axis: str, wrap: bool = True) -> np.ndarray:
    """Absolute 3x3 derivative as bytes; `wrap` keeps the low byte of larger values, else they are cut at 255."""
    g = np.pad(grey.astype(np.int64), 1, mode="reflect") if min(grey.shape) > 1 else np.pad(grey.astype(np.int64), 1, mode="edge")
    smooth = lambda m, ax: np.take(m, range(m.shape[ax] - 2), ax) + 2 * np.take(m, range(1, m.shape[ax] - 1), ax) + np.take(m, range(2, m.shape[ax]), ax)
    if axis == "x":
        d = smooth(g[:, 2:] - g[:, :-2], 0)
    else:
        d = smooth(g[2:] - g[:-2], 1)
    d = np.abs(d)
    return (d % 256 if wrap else np.minimum(d, 255)).astype(np.uint8)


def hough(mask: np.ndarray, votes: int, theta_step: float = np.pi / 180) -> list[tuple[float, float, int]]:
    """(rho, theta, votes) of straight lines with at least so many pixels, most voted first."""
    ys, xs = np.nonzero(mask)
    thetas = np.arange(0, np.pi, theta_step)
    size = int(np.ceil(np.hypot(*mask.shape)))
    out = []
    for t in thetas:
        rho = np.rint(xs * np.cos(t) + ys * np.sin(t)).astype(int) + size
        n = np.bincount(rho, minlength=2 * size + 1)
        out += [(float(r - size), float(t), int(n[r])) for r in np.flatnonzero(n >= votes)]
    return sorted(out, key=lambda v: (-v[2], v[1], v[0]))


def trace(skeleton: np.ndarray, least: int = 1) -> list[list[tuple[int, int]]]:
    """Ordered pixel paths (x, y): junctions (three neighbours or more) are cut out, each remaining piece is walked from an
    end, or anywhere if it is a ring; pieces under `least` pixels are dropped."""
    sk = skeleton.astype(bool)
    simple = sk & ~(sk & (neighbour_count(sk) >= 3))
    numbers = label(simple)
    paths = []
    ys, xs = np.nonzero(numbers)
    ids = numbers[ys, xs]
    order = np.argsort(ids, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(ids[order])) + 1) if len(order) else []:
        if len(part) < least:
            continue
        left = {(int(xs[i]), int(ys[i])) for i in part}
        degree = {p: sum((p[0] + dx, p[1] + dy) in left for dy, dx in EIGHT) for p in left}
        at = min(left, key=lambda p: (degree[p] > 1, p[1], p[0]))
        path = []
        while at is not None:
            path.append(at)
            left.discard(at)
            near = [(at[0] + dx, at[1] + dy) for dy, dx in FOUR + [d for d in EIGHT if 0 not in d]]
            at = next((p for p in near if p in left), None)
        paths.append(path)
    return paths


def end_heading(skeleton: np.ndarray, x: int, y: int, steps: int = 8) -> tuple[float, float] | None:
    """Outward unit vector (x, y) at an end, from a walk of `steps` pixels back; None for paths under three pixels."""
    seen, at = [(x, y)], (x, y)
    h, w = skeleton.shape
    for _ in range(steps):
        near = [(at[0] + dx, at[1] + dy) for dy, dx in EIGHT]
        at = next((p for p in near if 0 <= p[0] < w and 0 <= p[1] < h and skeleton[p[1], p[0]] and p not in seen), None)
        if at is None:
            break
        seen.append(at)
    if len(seen) < 3:
        return None
    d = np.array(seen[0], float) - np.array(seen[-1], float)
    n = np.hypot(*d)
    return (d[0] / n, d[1] / n) if n > 1e-6 else None


def bridge(skeleton: np.ndarray, most: int = 15) -> np.ndarray:
    """From each end (one neighbour) a ray of 2 to `most` pixels, probed 2 to either side; the first pixel of the skeleton
    that is no end itself is joined by a line one pixel wide."""
    sk = skeleton.astype(bool)
    h, w = sk.shape
    is_end = sk & (neighbour_count(sk) == 1)
    out = sk.copy()
    for y, x in np.argwhere(is_end):
        heading = end_heading(sk, int(x), int(y))
        if heading is None:
            continue
        ux, uy = heading
        hit = None
        for far in range(2, most + 1):
            for side in (0, -1, 1, -2, 2):
                px, py = int(round(x + ux * far - uy * side)), int(round(y + uy * far + ux * side))
                if 0 <= px < w and 0 <= py < h and sk[py, px] and not is_end[py, px] and max(abs(px - x), abs(py - y)) > 1:
                    hit = (px, py)
                    break
            if hit:
                break
        if hit:
            draw(out, (int(x), int(y)), hit, 1)
    return out


def draw(canvas: np.ndarray, a: tuple[float, float], b: tuple[float, float], thickness: int = 1, value=True) -> None:
    """A straight line of the given thickness with round ends, drawn in place."""
    n = int(max(abs(b[0] - a[0]), abs(b[1] - a[1]), 1) * (1 if thickness == 1 else 2)) + 1
    xs, ys = np.rint(np.linspace(a[0], b[0], n)).astype(int), np.rint(np.linspace(a[1], b[1], n)).astype(int)
    r = (thickness - 1) // 2
    offs = [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dx * dx + dy * dy <= r * r + r]
    for dy, dx in offs or [(0, 0)]:
        y, x = ys + dy, xs + dx
        ok = (y >= 0) & (y < canvas.shape[0]) & (x >= 0) & (x < canvas.shape[1])
        canvas[y[ok], x[ok]] = value


def rasterise(shapes: Sequence[tuple[np.ndarray, int]], height: int, width: int, thickness: int | dict[int, int] = 3, close: bool = False) -> np.ndarray:
    """Class mask of polylines (points, class) in order: a later shape covers earlier ones."""
    out = np.zeros((height, width), np.uint8)
    for pts, cls in shapes:
        ps = [tuple(p) for p in np.trunc(np.asarray(pts, float))]
        if close and len(ps) > 2:
            ps.append(ps[0])
        for a, b in zip(ps[:-1], ps[1:], strict=True):
            draw(out, a, b, thickness.get(cls, 3) if isinstance(thickness, dict) else thickness, cls)
    return out


def simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker without recursion: of each span the vertex furthest from its segment is kept while it lies over the tolerance."""
    pts = np.asarray(points, float)
    keep = np.zeros(len(pts), bool)
    if len(pts):
        keep[[0, -1]] = True
    spans = [(0, len(pts) - 1)]
    while spans:
        i, j = spans.pop()
        if j - i < 2:
            continue
        d, rel = pts[j] - pts[i], pts[i + 1 : j] - pts[i]
        along = np.clip(rel @ d / max(d @ d, 1e-300), 0, 1)[:, None]
        away = np.hypot(*(rel - along * d).T)
        k = int(away.argmax())
        if away[k] > tolerance:
            keep[i + 1 + k] = True
            spans += [(i, i + 1 + k), (i + 1 + k, j)]
    return pts[keep]


def kept_points(xy: np.ndarray, sizes: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points of lines of so many points, one after the other, simplify() keeps: all spans of a depth side by side."""
    last = np.cumsum(sizes) - 1
    first = last - sizes + 1
    keep = np.zeros(len(xy), bool)
    keep[first[sizes > 0]] = keep[last[sizes > 0]] = True
    i, j = first, last
    while (wide := j - i >= 2).any():
        i, j = i[wide], j[wide]
        inner = j - i - 1
        start = np.cumsum(inner) - inner
        span = np.repeat(np.arange(len(i)), inner)
        at = np.arange(len(span)) + (i + 1 - start)[span]
        d, rel = xy[j] - xy[i], xy[at] - xy[i][span]
        along = np.clip((rel * d[span]).sum(1) / np.maximum((d * d).sum(1), 1e-300)[span], 0, 1)[:, None]
        away = np.hypot(*(rel - along * d[span]).T)
        most = np.maximum.reduceat(away, start)
        furthest = np.flatnonzero((away == most[span]) & (most > tolerance)[span])
        cut, nth = np.unique(span[furthest], return_index=True)
        k = at[furthest[nth]]
        keep[k] = True
        i, j = np.concatenate([i[cut], k]), np.concatenate([k, j[cut]])
    return keep


def smooth_path(points: np.ndarray, window: int = 5, truncate: bool = True) -> np.ndarray:
    """Moving average of inner vertices; ends and short paths stay; whole numbers if truncate."""
    pts = np.asarray(points, float)
    half = window // 2
    if len(pts) <= window:
        return pts
    sums = np.vstack([np.zeros(2), np.cumsum(pts, axis=0)])
    out = pts.copy()
    out[half : len(pts) - half] = (sums[window:] - sums[:-window]) / window
    return np.trunc(out) if truncate else out


def _outward(path: np.ndarray, at_end: bool, look: int = 3) -> np.ndarray | None:
    tip, back = (path[-1], path[max(0, len(path) - 1 - look)]) if at_end else (path[0], path[min(look, len(path) - 1)])
    d = tip - back
    n = np.hypot(*d)
    return d / n if n >= 1e-6 else None


def chain(paths: Sequence[np.ndarray], radius: float = 15.0, angle: float = 90.0) -> list[np.ndarray]:
    """Join paths end to end: each line in turn takes the nearest free end strictly within the radius whose direction
    opposes its own (dot product of outward directions at most -cos(angle); no direction passes), one join for each line
    in a pass, until a pass joins none or max(50, 3n) passes are done. Ends are looked up in cells as wide as the radius."""
    lines = [np.asarray(p, float) for p in paths if len(p) >= 2]
    limit = -np.cos(np.radians(angle)) + 1e-12
    for _ in range(max(50, 3 * len(lines))):
        cells: dict[tuple[int, int], list[tuple[int, bool]]] = {}
        for i, p in enumerate(lines):
            for at_end in (False, True):
                q = p[-1] if at_end else p[0]
                cells.setdefault((int(q[0] // radius), int(q[1] // radius)), []).append((i, at_end))
        used, out, joined = [False] * len(lines), [], False
        for i, p in enumerate(lines):
            if used[i]:
                continue
            used[i], merged = True, p
            for at_end in (False, True):
                tip, mine = (p[-1] if at_end else p[0]), _outward(p, at_end)
                best = (radius, -1, False)
                cx, cy = int(tip[0] // radius), int(tip[1] // radius)
                for j, j_end in (e for dx in (-1, 0, 1) for dy in (-1, 0, 1) for e in cells.get((cx + dx, cy + dy), ())):
                    if used[j]:
                        continue
                    q = lines[j][-1] if j_end else lines[j][0]
                    d = float(np.hypot(*(q - tip)))
                    theirs = _outward(lines[j], j_end)
                    if (d, j) < best[:2] and d < radius and (mine is None or theirs is None or float(mine @ theirs) <= limit):
                        best = (d, j, j_end)
                if best[1] >= 0:
                    _, j, j_end = best
                    used[j] = joined = True
                    other = lines[j][::-1] if j_end == at_end else lines[j]
                    merged = np.vstack([merged, other]) if at_end else np.vstack([other, merged])
                    break
            out.append(merged)
        lines = out
        if not joined:
            break
    return lines


def merge_closest(paths: Sequence[np.ndarray], within: float = 200.0) -> list[np.ndarray]:
    """Paths joined at the closest of their ends, turned as needed: each in turn takes in, one after the other, the later ones
    within reach (inclusive) of what it has become; until a pass joins none. A pass is quadratic in the paths at most."""
    lines = [np.asarray(p, float) for p in paths]
    while True:
        waiting, out = lines, []
        while waiting:
            line, later = waiting[0], []
            for other in waiting[1:]:
                tips = np.array([line[-1], line[-1], line[0], line[0]]) - np.array([other[0], other[-1], other[0], other[-1]])
                k = int((gaps := np.hypot(*tips.T)).argmin())
                if gaps[k] > within:
                    later.append(other)
                else:
                    # At k of 0 and 1 the other goes on from the line's end, else it comes before the line's start.
                    line = np.vstack([line, other if k == 0 else other[::-1]] if k < 2 else [line[::-1], other] if k == 2 else [other, line])
            out.append(line)
            waiting = later
        if len(out) == len(lines):
            return out
        lines = out


def outline(mask: np.ndarray) -> list[np.ndarray]:
    """Outer borders of the 8-connected components as closed pixel paths (x, y), clockwise from the first pixel."""
    numbers = label(mask)
    padded = np.pad(numbers, 1)
    turn = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
    out = []
    for n in range(1, numbers.max() + 1 if numbers.size else 1):
        ys, xs = np.nonzero(padded == n)
        start = (int(ys[0]), int(xs[0]))
        path, at, heading = [], start, 0
        while True:
            path.append((at[1] - 1, at[0] - 1))
            for k in range(8):
                h = (heading + 6 + k) % 8
                nxt = (at[0] + turn[h][0], at[1] + turn[h][1])
                if padded[nxt] == n:
                    break
            else:
                break
            if at == start and len(path) > 1 and path[1] == (nxt[1] - 1, nxt[0] - 1):
                path.pop()
                break
            at, heading = nxt, h
            if len(path) > 4 * len(ys) + 8:
                break
        out.append(np.array(path, float))
    return out


def regions(height: int, width: int, walls: Sequence[np.ndarray], wall_pixels: np.ndarray | None = None, scale: int = 4, least: float = 0.02) -> list[dict]:
    """Areas that splitter lines part, largest box first; areas whose box is under `least` of the image are dropped.

    Walls are drawn three wide at a quarter of the size, wall pixels added, thickened by 5 x 5; free space is 4-connected.
    Without walls, or if all are dropped, the whole image is one region.
    """
    whole = [{"y_min": 0, "y_max": height, "x_min": 0, "x_max": width, "area": height * width, "group_id": 0, "mask": np.ones((height, width), bool)}]
    if not len(walls):
        return whole
    h, w = height // scale, width // scale
    wall = np.zeros((h, w), bool)
    for pts in walls:
        ps = [tuple(p) for p in np.trunc(np.asarray(pts, float) / scale)]
        for a, b in zip(ps[:-1], ps[1:], strict=True):
            draw(wall, a, b, 3)
    ys, xs = (np.arange(h) * height) // max(h, 1), (np.arange(w) * width) // max(w, 1)
    if wall_pixels is not None:
        wall |= wall_pixels[np.ix_(ys, xs)].astype(bool)
    free = label(~dilate(wall, box(5, 5)), 4)
    out = []
    for n in range(1, free.max() + 1):
        yy, xx = np.nonzero(free == n)
        y0, y1, x0, x1 = int(yy.min()) * scale, min(int(yy.max() + 1) * scale, height), int(xx.min()) * scale, min(int(xx.max() + 1) * scale, width)
        area = (y1 - y0) * (x1 - x0)
        if area >= height * width * least:
            big = (free == n)[np.ix_(np.minimum((np.arange(height) * h) // height, h - 1), np.minimum((np.arange(width) * w) // width, w - 1))]
            out.append({"y_min": y0, "y_max": y1, "x_min": x0, "x_max": x1, "area": area, "mask": big})
    out.sort(key=lambda r: -r["area"])
    return [r | {"group_id": k} for k, r in enumerate(out)] or whole


def vectorise(mask: np.ndarray, gap: int = 15, least: int = 10, window: int = 7, tolerance: float = 2.0) -> list[np.ndarray]:
    """Boundary mask to polylines: thin, bridge, thin, trace, chain, smooth, simplify, drop under three vertices, chain."""
    sk = thin(bridge(thin(mask), gap))
    paths = chain([np.array(p, float) for p in trace(sk, least)], 15.0, 120.0)
    paths = [simplify(smooth_path(p, window), tolerance) for p in paths]
    return chain([p for p in paths if len(p) >= 3], 10.0, 120.0)


def per_image(pixels: DataFrame, kernel: Callable[[np.ndarray], list[np.ndarray]], keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Run a kernel from a mask to paths on each key's foreground pixels (x, y): keys, line_id, points.

    Coordinates are taken relative to the foreground's box, so a task holds one box of pixels.
    """
    types = {f.name: f.dataType.simpleString() for f in pixels.schema}
    names = list(keys)

    def run(table: pa.Table) -> pa.Table:
        return _paths(table, table.column("x").to_numpy(), table.column("y").to_numpy(), kernel, names)

    return pixels.select(*names, "x", "y").groupBy(*names).applyInArrow(run, _path_schema(types, names))


def _path_schema(types: dict[str, str], keys: Sequence[str]) -> str:
    return ", ".join(f"{k} {types[k]}" for k in keys) + ", line_id int, points array<struct<x:double,y:double>>"


def _paths(table: pa.Table, x: np.ndarray, y: np.ndarray, kernel: Callable[[np.ndarray], list[np.ndarray]], keys: Sequence[str]) -> pa.Table:
    """What a kernel makes of the pixels (x, y) of one key, which the first row of table names."""
    kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
    paths, x0, y0 = [], 0, 0
    if len(x):
        x0, y0 = int(x.min()) - 1, int(y.min()) - 1
        mask = np.zeros((int(y.max()) - y0 + 2, int(x.max()) - x0 + 2), bool)
        mask[y - y0, x - x0] = True
        paths = kernel(mask)
    points = pa.array([[{"x": float(p[0] + x0), "y": float(p[1] + y0)} for p in path] for path in paths], kind)
    columns = [pa.array([table.column(k)[0].as_py()] * len(paths), table.column(k).type) for k in keys]
    return pa.table([*columns, pa.array(range(len(paths)), pa.int32()), points], names=[*keys, "line_id", "points"])


#: Pixels of a sheet's box up to which its shapes are drawn on a dense canvas.
CANVAS = 1 << 24


def _drawn(table: pa.Table, thickness: int, order: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x and y of the pixels that the polylines (points) of one sheet cover, and the row of the shape on top."""
    rank = np.argsort(np.array(table.column(order).to_pylist()), kind="stable")
    shapes = table.column("points").combine_chunks().take(pa.array(rank))
    flat, size = shapes.flatten(), np.array([0 if n is None else n for n in pc.list_value_length(shapes).to_pylist()], int)
    px, py = (flat.field(k).to_numpy(zero_copy_only=False).astype(float) for k in (0, 1))
    of = np.repeat(rank, size)
    inner = np.ones(len(of), bool)
    inner[np.cumsum(size)[size > 0] - 1] = False
    a = np.flatnonzero(inner)
    a = a[np.isfinite(px[a] + py[a] + px[a + 1] + py[a + 1])] if len(a) else a
    dx, dy = px[a + 1] - px[a], py[a + 1] - py[a]
    n = np.maximum(1, np.ceil(np.maximum(np.abs(dx), np.abs(dy)) * (1 if thickness == 1 else 2))).astype(np.int64)
    s = np.repeat(np.arange(len(a)), n + 1)
    i = np.arange(len(s)) - np.repeat(np.cumsum(n + 1) - n - 1, n + 1)
    x, y = np.rint(px[a][s] + dx[s] * i / n[s]).astype(np.int64), np.rint(py[a][s] + dy[s] * i / n[s]).astype(np.int64)
    if not len(x):
        return x, y, x
    r = (thickness - 1) // 2
    offs = np.array([(ox, oy) for oy in range(-r, r + 1) for ox in range(-r, r + 1) if ox * ox + oy * oy <= r * r + r] or [(0, 0)])
    new = np.concatenate([[True], (np.diff(x) != 0) | (np.diff(y) != 0) | (np.diff(s) != 0)])
    x, y, top = x[new], y[new], of[a][s][new]
    x0, y0, w, h = x.min() - r, y.min() - r, np.ptp(x) + 2 * r + 1, np.ptp(y) + 2 * r + 1
    at = ((y[:, None] + offs[:, 1] - y0) * w + (x[:, None] + offs[:, 0] - x0)).ravel()
    top = np.repeat(top, len(offs))
    if w * h <= CANVAS:
        # Shapes come in their order, and of equal places the last one written stays.
        canvas = np.full(w * h, -1, np.int64)
        canvas[at] = top
        at = np.flatnonzero(canvas >= 0)
        top = canvas[at]
    else:
        at, last = np.unique(at[::-1], return_index=True)
        top = top[::-1][last]
    return at % w + x0, at // w + y0, top


def per_drawing(shapes: DataFrame, kernel: Callable[[np.ndarray], list[np.ndarray]], thickness: int = 3, keys: Sequence[str] = ("image_id",), order: str = "shape_idx") -> DataFrame:
    """per_image() of the pixels that each key's polylines cover: they are drawn in the task that runs the kernel."""
    types, names = {f.name: f.dataType.simpleString() for f in shapes.schema}, list(keys)

    def run(table: pa.Table) -> pa.Table:
        x, y, _ = _drawn(table, thickness, order)
        return _paths(table, x, y, kernel, names)

    return shapes.select(*names, order, "points").groupBy(*names).applyInArrow(run, _path_schema(types, names))


def rasterised(shapes: DataFrame, thickness: int = 3, keys: Sequence[str] = ("image_id",), order: str = "shape_idx", cls: str = "cls") -> DataFrame:
    """Class pixels (keys, x, y, cls) of polylines: points along each segment, thickened, the last shape on top.

    Shapes move, pixels do not: a task draws a sheet at a time and holds its pixels.
    """
    types, names = {f.name: f.dataType.simpleString() for f in shapes.schema}, list(keys)

    def run(table: pa.Table) -> pa.Table:
        x, y, top = _drawn(table, thickness, order)
        columns = [pa.array([table.column(k)[0].as_py()] * len(x), table.column(k).type) for k in names]
        return pa.table([*columns, pa.array(x, pa.int32()), pa.array(y, pa.int32()), table.column(cls).take(pa.array(top))], names=[*names, "x", "y", "cls"])

    schema = ", ".join(f"`{k}` {types[k]}" for k in names) + f", x int, y int, cls {types[cls]}"
    return shapes.select(*names, order, cls, "points").groupBy(*names).applyInArrow(run, schema)


def band_region(mask: np.ndarray, dilate_size: int = 5, close_size: int = 9, least: int = 500) -> np.ndarray:
    """Band pixels to regions: specks opened away, dashes joined, holes closed, components of over `least` pixels kept."""
    band = closed(dilate(opened(mask, box(2, 2)), ellipse(dilate_size)), ellipse(close_size))
    numbers = label(band)
    size = np.bincount(numbers.ravel(), minlength=1)
    size[0] = 0
    return (size > least)[numbers]


def otsu_level(levels: np.ndarray, n: int = 256) -> int:
    """Level that parts a histogram of whole numbers with the largest variance between classes, the lowest on ties."""
    h = np.bincount(levels, minlength=n).astype(float)
    n0, s0 = np.cumsum(h), np.cumsum(h * np.arange(len(h)))
    with np.errstate(invalid="ignore", divide="ignore"):
        between = n0 * (n0[-1] - n0) * (s0 / n0 - (s0[-1] - s0) / (n0[-1] - n0)) ** 2
    return int(np.nan_to_num(between).argmax())


def split_by_width(mask: np.ndarray, gap: int = 20, empty: float = 6.0) -> tuple[np.ndarray, np.ndarray, float]:
    """Skeleton of thick and of thin lines, parted by Otsu over half widths in tenths; and the threshold."""
    half = distance_to_background(mask)
    sk = thin(bridge(thin(mask), gap))
    widths = half[sk]
    threshold = otsu_level(np.clip(widths * 10, 0, 255).astype(int)) / 10 if len(widths) else empty
    return sk & (half >= threshold), sk & (half < threshold), threshold


def dark_pixels(lightness: np.ndarray, region: np.ndarray, share: float = 0.7) -> np.ndarray:
    """Pixels of a region darker than a share of its Otsu level."""
    inside = lightness[region]
    return region & (lightness < share * otsu_level(inside.astype(int))) if len(inside) else np.zeros_like(region, bool)


def mask_polygons(mask: np.ndarray, least: int = 3, share: float | None = 0.001, tolerance: float = 1.0) -> list[np.ndarray]:
    """Outlines of components as polygons, simplified by a share of their perimeter (or by a fixed tolerance)."""
    out = []
    for path in outline(mask):
        if len(path) < least:
            continue
        ring = np.vstack([path, path[:1]])
        perimeter = float(np.hypot(*np.diff(ring, axis=0).T).sum())
        p = simplify(ring, perimeter * share if share is not None else tolerance)[:-1]
        if len(p) >= 3:
            out.append(p)
    return out


def to_edge(end: np.ndarray, inner: np.ndarray, width: int, height: int, reach: float) -> np.ndarray:
    """An end moved on along its heading to the nearest side of the image, if that is within reach and the heading is towards it."""
    heading = end - inner
    size = np.hypot(*heading)
    if size < 1:
        return end
    outward = np.array([(-1, 0), (1, 0), (0, -1), (0, 1)])
    gap = np.array([end[0], width - end[0], end[1], height - end[1]])
    side = int(gap.argmin())
    towards = heading @ outward[side] / size
    if gap[side] <= reach and towards > 0.3:
        end = end + heading / size * gap[side] / towards
    return np.clip(end, 0, (width, height))


def splitter_lines(mask: np.ndarray, reach: float = 200.0, coverage: float = 0.15) -> list[np.ndarray]:
    """Splitters from their class mask: closed, thinned, traced, joined end to end, simplified by 1 % of their length, and
    taken on to the edge. Under 100 pixels there are none; traces under 10 pixels go, and so do lines whose larger span is
    under `coverage` of the image's side."""
    if mask.sum() < 100:
        return []
    h, w = mask.shape
    paths = merge_closest([np.array(p, float) for p in trace(thin(closed(mask, ellipse(25))), 10)], reach)
    length = lambda p: float(np.hypot(*np.diff(p, axis=0).T).sum())
    out = []
    for p in (simplify(p, 0.01 * length(p)) for p in paths if len(p) >= 2):
        first, last = to_edge(p[0], p[1], w, h, reach), to_edge(p[-1], p[-2], w, h, reach)
        p[0], p[-1] = first, last
        if max(np.ptp(p[:, 0]) / w, np.ptp(p[:, 1]) / h) >= coverage:
            out.append(p)
    return out


def straight_splitters(grey: np.ndarray, dark: int = 80, coverage: float = 0.3, margin: int = 10) -> list[dict]:
    """Long dark horizontal and vertical bars: an opening by max(dim // 5, 100) keeps them, components covering enough of
    the image and away from its border are returned as boxes."""
    h, w = grey.shape
    out = []
    for kind, size, extent in (("horizontal", (1, max(w // 5, 100)), w), ("vertical", (max(h // 5, 100), 1), h)):
        numbers = label(_runs(grey < dark, size))
        for n in range(1, numbers.max() + 1):
            ys, xs = np.nonzero(numbers == n)
            span = (xs.max() - xs.min() + 1) if kind == "horizontal" else (ys.max() - ys.min() + 1)
            mid = float(ys.mean() if kind == "horizontal" else xs.mean())
            if span / extent >= coverage and margin <= mid < (h if kind == "horizontal" else w) - margin:
                out.append({"orientation": kind, "x_min": int(xs.min()), "x_max": int(xs.max()), "y_min": int(ys.min()), "y_max": int(ys.max()), "coverage": span / extent})
    return out


def _runs(mask: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """What an opening by a line keeps: runs along its axis of at least its length."""
    m, k = (mask, size[1]) if size[0] == 1 else (mask.T, size[0])
    padded = np.zeros((m.shape[0], m.shape[1] + 2), np.int8)
    padded[:, 1:-1] = m
    d = np.diff(padded, axis=1)
    y, s = np.nonzero(d == 1)
    _, e = np.nonzero(d == -1)
    out = np.zeros(m.shape, np.int8)
    keep = e - s >= k
    step = np.zeros((m.shape[0], m.shape[1] + 1), np.int32)
    np.add.at(step, (y[keep], s[keep]), 1)
    np.add.at(step, (y[keep], e[keep]), -1)
    out = np.cumsum(step, axis=1)[:, :-1] > 0
    return out if size[0] == 1 else out.T
