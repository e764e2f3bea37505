"""Clean-up of lines on many small sheets, side by side in numpy: what linework.clean_up() does before it clips.

Arrays hold the sheets of a task one after the other. Segments are rows (ax, ay, bx, by) in whole units, the smaller end first,
sorted by sheet; which of them may meet is found by their spans in x, so that no pairs of all with all are made.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from .raster import kept_points

#: Segments, squared and added up, of the sheets that are passed through side by side.
SIDE_BY_SIDE = 400_000


def spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) for every j from low[i] up to high[i]."""
    n = np.maximum(high - low, 0)
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n - low, n)


def _distinct(*columns: np.ndarray) -> list[np.ndarray]:
    """Distinct rows of the columns, sorted."""
    order = np.lexsort(columns[::-1])
    rows = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in rows], axis=0)
    return [c[new] for c in rows]


def _places(x: np.ndarray):
    """A key of (sheet, x) that sorts as the pair does, for x of the range given."""
    low, wide = x.min(initial=0) - 1, np.ptp(x) + 3 if len(x) else 1
    return lambda sheet, x: sheet * wide + (x - low)


def _turn(a, b, c) -> np.ndarray:
    return np.sign((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))


def _level(p: Sequence[np.ndarray], q: Sequence[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether segments p[i] and q[j] have a common height."""
    return (np.minimum(p[1], p[3])[i] <= np.maximum(q[1], q[3])[j]) & (np.minimum(q[1], q[3])[j] <= np.maximum(p[1], p[3])[i])


def noded(sheet: np.ndarray, ends: Sequence[np.ndarray], crossing: bool = True) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct pieces of segments, cut and snapped where they meet, as overlay.noded() does."""
    sheet, *ends = _distinct(sheet, *ends)
    ax, ay, bx, by = ends
    key = _places(np.concatenate([ax, bx]))
    hot = [(sheet, ax, ay), (sheet, bx, by)]
    if crossing:
        i, j = spread(np.arange(1, len(ax) + 1), np.searchsorted(key(sheet, ax), key(sheet, bx), "right"))
        near = _level(ends, ends, i, j)
        i, j = i[near], j[near]
        a, b, c, d = (ax[i], ay[i]), (bx[i], by[i]), (ax[j], ay[j]), (bx[j], by[j])
        met = (_turn(c, d, a) * _turn(c, d, b) < 0) & (_turn(a, b, c) * _turn(a, b, d) < 0)
        i, (a, b, c, d) = i[met], [(x[met], y[met]) for x, y in (a, b, c, d)]
        before, after = ((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) for p in (c, d))
        t = before.astype(float) / (before - after).astype(float)
        hot.append((sheet[i], *[np.floor(c[k] + (d[k] - c[k]) * t + 0.5).astype(np.int64) for k in (0, 1)]))
    hot_sheet, x, y = _distinct(*[np.concatenate(v) for v in zip(*hot, strict=True)])
    at = key(hot_sheet, x)
    i, j = spread(np.searchsorted(at, key(sheet, ax)), np.searchsorted(at, key(sheet, bx), "right"))
    near = (np.minimum(ay, by)[i] <= y[j]) & (y[j] <= np.maximum(ay, by)[i])
    i, x, y = i[near], x[j[near]], y[j[near]]
    dx, dy = 2 * (bx - ax)[i], 2 * (by - ay)[i]
    # A pixel is half open; on a tie the segment counts as moved by a little to the right and, much less, upwards.
    tie = np.where(dy != 0, np.sign(dy), -np.sign(dx))
    sides = 0
    for u in (-1, 1):
        for v in (-1, 1):
            turn = np.sign(dx * (2 * y + v - 2 * ay[i]) - dy * (2 * x + u - 2 * ax[i]))
            sides = sides + np.where(turn != 0, turn, tie)
    met = np.abs(sides) < 4
    i, x, y = i[met], x[met], y[met]
    order = np.lexsort((y * np.sign(by - ay)[i], x, i))
    i, x, y = i[order], x[order], y[order]
    next_ = np.flatnonzero(i[1:] == i[:-1])
    p, q = (x[next_], y[next_]), (x[next_ + 1], y[next_ + 1])
    ahead = (p[0] < q[0]) | ((p[0] == q[0]) & (p[1] < q[1]))
    pieces = [np.where(ahead, p[0], q[0]), np.where(ahead, p[1], q[1]), np.where(ahead, q[0], p[0]), np.where(ahead, q[1], p[1])]
    sheet, *pieces = _distinct(sheet[i[next_]], *pieces)
    return sheet, pieces


def walk(pairs: list[tuple]) -> list:
    """The nodes of one line in order, from its edges."""
    near: dict = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    # A line may touch itself where more edges of others meet, so ends are nodes of one edge of this line.
    at = min([n for n, m in near.items() if len(m) == 1] or near)
    out, left = [at], {frozenset(p) for p in pairs}
    while (step := next((n for n in sorted(near[at]) if frozenset((at, n)) in left), None)) is not None:
        left.discard(frozenset((at, step)))
        out.append(at := step)
    return out


def paths(sheet: np.ndarray, ends: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sheet of each line, its number of points, points of all lines): distinct edges joined where just two meet, as linework.paths()."""
    n = len(sheet)
    both = [np.concatenate([sheet, sheet]), np.concatenate([ends[0], ends[2]]), np.concatenate([ends[1], ends[3]])]
    order = np.lexsort(both[::-1])
    new = np.ones(2 * n, bool)
    new[1:] = np.any([c[order][1:] != c[order][:-1] for c in both], axis=0)
    node = np.empty(2 * n, np.int64)
    node[order] = np.cumsum(new) - 1
    xy = np.stack([both[1][order][new], both[2][order][new]], 1)
    a, b, joint = node[:n], node[n:], np.bincount(node, minlength=len(xy)) == 2
    # The two edges of a joint stand side by side among the ends in order.
    first = np.flatnonzero(new)[joint]
    p, q = order[first] % n, order[first + 1] % n
    label, done = np.arange(n), False
    while not done:
        now = label.copy()
        np.minimum.at(now, p, label[q])
        np.minimum.at(now, q, label[p])
        now = now[now]
        label, done = now, bool((now == label).all())
    size = np.bincount(label, minlength=n)
    alone, two = np.flatnonzero(size[label] == 1), np.flatnonzero(size[label] == 2)
    two = two[np.argsort(label[two], kind="stable")].reshape(-1, 2)
    left, right = two.T
    # Two edges of a line share one node, as they are distinct.
    mid = np.where((a[left] == a[right]) | (a[left] == b[right]), a[left], b[left])
    one, other = a[left] + b[left] - mid, a[right] + b[right] - mid
    shared = np.stack([np.minimum(one, other), mid, np.maximum(one, other)], 1)
    more = np.flatnonzero(size[label] > 2)
    more = more[np.argsort(label[more], kind="stable")]
    cuts = np.flatnonzero(np.diff(label[more])) + 1
    long = [walk(list(zip(a[rows].tolist(), b[rows].tolist(), strict=True))) for rows in np.split(more, cuts)] if len(more) else []
    starts = more[np.concatenate([[0], cuts])] if len(more) else more
    of = np.concatenate([sheet[alone], sheet[left], sheet[starts]])
    sizes = np.concatenate([np.full(len(alone), 2), np.full(len(left), 3), np.array([len(w) for w in long], np.int64)])
    nodes = np.concatenate([np.stack([a[alone], b[alone]], 1).ravel(), shared.ravel(), np.array([k for w in long for k in w], np.int64)])
    return of, sizes, xy[nodes]


def line_segments(of: np.ndarray, sizes: np.ndarray, xy: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(line, place, ends): segments of lines of the points kept, the smaller end first, without those of no length."""
    line = np.repeat(np.arange(len(of)), sizes)[keep]
    xy = xy[keep]
    i = np.flatnonzero(line[1:] == line[:-1])
    place = i - np.searchsorted(line, line[i])
    p, q = xy[i], xy[i + 1]
    ahead = ((p[:, 0] < q[:, 0]) | ((p[:, 0] == q[:, 0]) & (p[:, 1] < q[:, 1])))[:, None]
    ends = np.concatenate([np.where(ahead, p, q), np.where(ahead, q, p)], 1)
    some = (p != q).any(1)
    return line[i][some], place[some], list(ends[some].T)


def touching(sheets: Sequence[np.ndarray], names: Sequence[np.ndarray], ends: Sequence[Sequence[np.ndarray]], last: int) -> list[np.ndarray]:
    """(line, form, line2, form2) as overlay.touching(), of moving and of still segments; names: line, form, place of the moving ones, line2 -1 is a still one."""
    line, form, place = names
    order = np.lexsort((ends[0][0], sheets[0]))
    order = order[form[order] < last]
    s, p = sheets[0][order], [c[order] for c in ends[0]]
    line1, form1, place1 = line[order], form[order], place[order]
    still = np.full(len(sheets[1]), -1)
    s2, q = np.concatenate(sheets), [np.concatenate(c) for c in zip(*ends, strict=True)]
    line2, form2, place2 = (np.concatenate([c, still]) for c in names)
    order = np.lexsort((q[0], s2))
    s2, q, line2, form2, place2 = s2[order], [c[order] for c in q], line2[order], form2[order], place2[order]
    key = _places(np.concatenate([q[0], q[2]]))
    left, right = key(s, p[0]), key(s2, q[0])
    i, j = spread(np.searchsorted(right, left), np.searchsorted(right, key(s, p[2]), "right"))
    j2, i2 = spread(np.searchsorted(left, right, "right"), np.searchsorted(left, key(s2, q[2]), "right"))
    i, j = np.concatenate([i, i2]), np.concatenate([j, j2])
    l1, l2, f1, f2 = line1[i], line2[j], form1[i], form2[j]
    first = (l1 < l2) | ((l1 == l2) & (place1[i] < place2[j]))
    free = (l2 < 0) | np.where(f2 == last, l1 != l2, first & ((l1 != l2) | (f1 == f2)))
    near = free & _level(p, q, i, j)
    i, j = i[near], j[near]
    a, b, c, d = (p[0][i], p[1][i]), (p[2][i], p[3][i]), (q[0][j], q[1][j]), (q[2][j], q[3][j])
    ab_c, ab_d, cd_a, cd_b = _turn(a, b, c), _turn(a, b, d), _turn(c, d, a), _turn(c, d, b)
    same = lambda u, v: (u[0] == v[0]) & (u[1] == v[1])

    def on(side, u, v, x):
        """Whether x lies between u and v but at neither; side tells on which side of their line it is."""
        within = [(np.minimum(u[k], v[k]) <= x[k]) & (x[k] <= np.maximum(u[k], v[k])) for k in (0, 1)]
        return (side == 0) & within[0] & within[1] & ~same(u, x) & ~same(v, x)

    met = ((ab_c * ab_d < 0) & (cd_a * cd_b < 0)) | on(ab_c, a, b, c) | on(ab_d, a, b, d) | on(cd_a, c, d, a) | on(cd_b, c, d, b) | (same(a, c) & same(b, d))
    i, j = i[met], j[met]
    return _distinct(line1[i], form1[i], line2[j], form2[j])


def simplified_apart(of: np.ndarray, sizes: np.ndarray, xy: np.ndarray, tolerance: float, unit: float) -> np.ndarray:
    """Which points stay, as linework.simplified_apart(): every line in the first of its three forms in which it meets no other."""
    points = xy * unit
    forms = [kept_points(points, sizes, tolerance), kept_points(points, sizes, tolerance / 4), np.ones(len(xy), bool)]
    line = np.repeat(np.arange(len(of)), sizes)
    changed = np.bincount(line[~forms[0]], minlength=len(of)) > 0
    bent, moving, sheets = changed[line], [], []
    for k, keep in enumerate(forms):
        m, place, ends = line_segments(of, sizes, xy, keep & bent)
        moving.append((m, np.full(len(m), k), place, *ends))
        sheets.append(of[m])
    m, _, ends = line_segments(of, sizes, xy, ~bent)
    moving = [np.concatenate(c) for c in zip(*moving, strict=True)]
    meet = touching((np.concatenate(sheets), of[m]), moving[:3], (moving[3:], ends), 2)
    start = np.cumsum(sizes) - sizes
    ring = changed & (xy[start] == xy[start + sizes - 1]).all(1) & (sizes >= 4)
    flat = [np.flatnonzero(ring & (np.bincount(line[keep], minlength=len(of)) < 4)) for keep in forms]
    flat, which = np.concatenate(flat), np.repeat(np.arange(3), [len(f) for f in flat])
    a, fa, b, fb = (np.concatenate(c) for c in zip(meet, (flat, which, flat, which), strict=True))
    form, rounds, moved = np.zeros(len(of), np.int64), 0, True
    while moved:
        met = (form[a] == fa) & ((b < 0) | (form[b] == fb))
        back = np.zeros(len(of), bool)
        back[a[met]] = True
        back[b[met & (b >= 0)]] = True
        back &= form < 2
        form[back] = 1 if rounds == 0 else 2
        rounds, moved = rounds + 1, bool(back.any())
    own = np.where(changed, form, 2)[line]
    return np.where(own == 0, forms[0], np.where(own == 1, forms[1], True))


def arcs_of(sheet: np.ndarray, ends: Sequence[np.ndarray], first: float, tolerance: float, unit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sheet of each line, its number of points, points): segments united, joined, simplified by `first`, joined, simplified by `tolerance`."""
    n, out = np.bincount(sheet), []
    # Sheets are numbered in the order of their segments.
    batch = np.cumsum(n.astype(np.int64) ** 2) // SIDE_BY_SIDE
    for group in np.split(np.arange(len(n)), np.flatnonzero(np.diff(batch)) + 1):
        at = slice(*np.searchsorted(sheet, [group[0], group[-1] + 1]))
        of, sizes, xy = paths(*noded(sheet[at], [c[at] for c in ends]))
        line, _, again = line_segments(of, sizes, xy, simplified_apart(of, sizes, xy, first, unit))
        of, sizes, xy = paths(*noded(of[line], again, crossing=False))
        keep = simplified_apart(of, sizes, xy, tolerance, unit)
        out.append((of, np.bincount(np.repeat(np.arange(len(of)), sizes)[keep], minlength=len(of)), xy[keep]))
    of, sizes, xy = (np.concatenate(c) for c in zip(*out, strict=True))
    return of, sizes, xy * unit
