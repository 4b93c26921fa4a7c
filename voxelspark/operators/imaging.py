"""NumPy kernels of one slice, for use inside tasks. A slice is one bounded image.

Images are 2-D arrays, masks boolean. These functions know nothing of Spark; the
operators in ``segment`` and ``propagate`` spread slices over the cluster.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np


def dilate(mask: np.ndarray, kernel: list[tuple[int, int]]) -> np.ndarray:
    h, w = mask.shape
    out = np.zeros_like(mask)
    for dy, hw in kernel:
        rows = mask[max(0, -dy) : h - max(0, dy)]
        grown = rows.copy()
        for dx in range(1, min(hw, w - 1) + 1):
            grown[:, dx:] |= rows[:, :-dx]
            grown[:, :-dx] |= rows[:, dx:]
        out[max(0, dy) : h - max(0, -dy)] |= grown
    return out


def erode(mask: np.ndarray, kernel: list[tuple[int, int]]) -> np.ndarray:
    return ~dilate(~mask, kernel)


def label(mask: np.ndarray, diagonal: bool = True) -> tuple[np.ndarray, int]:
    """Components numbered from 1 in reading order, and their number."""
    out, n = np.zeros(mask.shape, np.int32), 0
    steps = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy or dx) and (diagonal or not (dy and dx))]
    for y, x in zip(*np.nonzero(mask), strict=True):
        if out[y, x]:
            continue
        n += 1
        out[y, x], stack = n, [(y, x)]
        while stack:
            cy, cx = stack.pop()
            for dy, dx in steps:
                a, b = cy + dy, cx + dx
                if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not out[a, b]:
                    out[a, b] = n
                    stack.append((a, b))
    return out, n


def chamfer(mask: np.ndarray) -> np.ndarray:
    """Distance to the background by a 5 x 5 chamfer; without background it is unbounded."""
    # Weights of straight, diagonal and knight's steps.
    a, b, c = 1.0, 1.4, 2.1969
    before = [(-1, 0, a), (0, -1, a), (-1, -1, b), (-1, 1, b), (-1, -2, c), (-1, 2, c), (-2, -1, c), (-2, 1, c)]
    d = np.where(mask, np.inf, 0.0)
    h, w = mask.shape
    for sign, ys, xs in ((1, range(h), range(w)), (-1, range(h - 1, -1, -1), range(w - 1, -1, -1))):
        for y in ys:
            for x in xs:
                if d[y, x]:
                    for dy, dx, cost in before:
                        p, q = y + sign * dy, x + sign * dx
                        if 0 <= p < h and 0 <= q < w:
                            d[y, x] = min(d[y, x], d[p, q] + cost)
    return d


def blur(gray: np.ndarray) -> np.ndarray:
    """5 x 5 binomial blur, mirrored at the border, rounded half up."""
    k = np.array([1, 4, 6, 4, 1])

    def fold(i: np.ndarray, n: int) -> np.ndarray:
        period = max(1, 2 * n - 2)
        i = np.abs(i) % period
        return np.where(i >= n, period - i, i)

    out = gray.astype(np.int64)
    for axis in (0, 1):
        n = out.shape[axis]
        out = sum(k[d + 2] * np.take(out, fold(np.arange(n) + d, n), axis) for d in range(-2, 3))
    return (out + 128) // 256


def outlines(mask: np.ndarray) -> list[list[tuple[int, int]]]:
    """Outer outlines of the 8-connected components as (x, y) points, straight stretches
    shortened to their ends. Holes have none."""
    labels, n = label(mask)
    ring = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]
    found = []
    for k in range(1, n + 1):
        ys, xs = np.nonzero(labels == k)
        own = {*zip(xs.tolist(), ys.tolist(), strict=True)}
        start = (int(xs[0]), int(ys[0]))
        path, at, back = [start], start, 4  # the first pixel's left neighbour is outside
        first = None
        while True:
            for turn in range(1, 9):
                d = (back + turn) % 8
                step = (at[0] + ring[d][0], at[1] + ring[d][1])
                if step in own:
                    break
            else:
                break
            if at == start and first is not None and d == first:
                break
            first = d if first is None else first
            path.append(step)
            at, back = step, (d + 4) % 8
        if len(path) > 1 and path[-1] == start:
            path.pop()
        m = len(path)
        turn = lambda i: (path[i][0] - path[i - 1][0], path[i][1] - path[i - 1][1])  # noqa: E731, B023
        found.append([path[i] for i in range(m) if m < 3 or turn(i) != turn((i + 1) % m)])
    return found


def area(points: list[tuple[int, int]]) -> float:
    return abs(sum(points[i - 1][0] * points[i][1] - points[i][0] * points[i - 1][1] for i in range(len(points)))) / 2


def polygons(mask: np.ndarray, min_area: float) -> list[list[tuple[int, int]]]:
    """Outlines of at least 3 points and this shoelace area."""
    return [p for p in outlines(mask) if len(p) >= 3 and area(p) >= min_area]


def fill(points: list[tuple[int, int]], h: int, w: int) -> np.ndarray:
    """The polygon's pixels, edges included."""
    out = np.zeros((h, w), bool)
    edges = [*zip(points, points[1:] + points[:1], strict=True)]
    for y in range(max(0, min(p[1] for p in points)), min(h - 1, max(p[1] for p in points)) + 1):
        at = lambda a, b: a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1])  # noqa: E731, B023
        cross = sorted(at(a, b) for a, b in edges if (a[1] <= y) != (b[1] <= y))
        spans = [*zip(cross[::2], cross[1::2], strict=True)]
        for a, b in edges:
            if a[1] == b[1] == y:
                spans.append((min(a[0], b[0]), max(a[0], b[0])))
            elif min(a[1], b[1]) <= y <= max(a[1], b[1]) and a[1] != b[1]:
                spans.append((at(a, b),) * 2)
        for lo, hi in spans:
            out[y, max(0, int(np.ceil(lo))) : max(0, min(w, int(np.floor(hi)) + 1))] = True
    return out


def polygon_runs(sizes: np.ndarray, x: np.ndarray, y: np.ndarray, known: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The runs (number of the polygon, y, x0, x1) of many polygons, given by their numbers of
    points and all points in a row, about ``most`` edges' rows at a time: what ``fill`` lights."""
    ends = np.cumsum(sizes)
    of = np.repeat(np.arange(sizes.size), sizes)
    after = np.arange(1, x.size + 1)
    after[ends[sizes > 0] - 1] = (ends - sizes)[sizes > 0]
    edge = np.flatnonzero(known & known[after])  # an edge with an unknown end is none
    low = np.minimum(y, y[after])
    rows = np.abs(y - y[after]) + 1
    part = np.cumsum(np.bincount(of[edge], rows[edge], sizes.size).astype(np.int64))[of[edge]] // most
    for cut in np.split(edge, np.flatnonzero(np.diff(part)) + 1):
        if not cut.size:
            continue
        # An edge has the rows of its own span only, one crossing in each.
        e = np.repeat(cut, rows[cut])
        at_y = low[e] + np.arange(e.size) - np.repeat(np.cumsum(rows[cut]) - rows[cut], rows[cut])
        ax, ay, bx, by = x[e], y[e], x[after[e]], y[after[e]]
        flat = ay == by
        at = ax + (at_y - ay) * (bx - ax) / np.where(flat, 1, by - ay)
        lo, hi = np.where(flat, np.minimum(ax, bx), np.ceil(at)).astype(np.int64), np.where(flat, np.maximum(ax, bx), np.floor(at)).astype(np.int64)
        crossing = np.flatnonzero((ay <= at_y) != (by <= at_y))
        crossing = crossing[np.lexsort((at[crossing], at_y[crossing], of[e[crossing]]))]
        line = np.stack([of[e[crossing]], at_y[crossing]])
        new = np.r_[True, (line[:, 1:] != line[:, :-1]).any(0)][: crossing.size]
        first = np.maximum.accumulate(np.where(new, np.arange(crossing.size), 0))
        left = np.flatnonzero(((np.arange(crossing.size) - first) % 2 == 0) & ~np.r_[new[1:], True][: crossing.size])
        pair = crossing[left], np.ceil(at[crossing[left]]).astype(np.int64), np.floor(at[crossing[left + 1]]).astype(np.int64)
        own, yy = np.r_[of[e], of[e[pair[0]]]], np.r_[at_y, at_y[pair[0]]]
        x0, x1 = np.r_[lo, pair[1]], np.r_[hi, pair[2]]
        order = np.lexsort((x1, x0, yy, own))
        order = order[x0[order] <= x1[order]]
        own, yy, x0, x1 = own[order], yy[order], x0[order], x1[order]
        if not own.size:
            continue
        # Rows of pixels follow each other, too far apart to touch: one running maximum serves all.
        row = np.cumsum(np.r_[False, (own[1:] != own[:-1]) | (yy[1:] != yy[:-1])]) * (x1.max() - x0.min() + 3)
        begins = np.flatnonzero(np.r_[True, (x0 + row)[1:] > np.maximum.accumulate(x1 + row)[:-1] + 1])
        yield own[begins], yy[begins], x0[begins], np.maximum.reduceat(x1, begins)


def committed(mask: np.ndarray, min_area: float) -> np.ndarray:
    """What a commit stores of a mask: outlines filled again, so holes are closed and
    small parts dropped."""
    out = np.zeros_like(mask)
    for p in polygons(mask, min_area):
        out |= fill(p, *mask.shape)
    return out


def otsu(gray: np.ndarray) -> int:
    n = np.bincount(gray.ravel(), minlength=256).astype(np.int64)
    below, total = np.cumsum(n), int(n.sum())
    mass = np.cumsum(n * np.arange(256))
    best, at = -1.0, 0
    for t in np.flatnonzero(n)[:-1].tolist():
        w0, w1 = int(below[t]), total - int(below[t])
        score = float((int(mass[-1]) * w0 - total * int(mass[t])) ** 2) / float(w0 * w1)
        if score > best:
            best, at = score, t
    return at


def flood(gray: np.ndarray, markers: np.ndarray) -> np.ndarray:
    """Watershed from markers (0 unknown): the closest grey step first, first come first
    served; pixels between regions and the border are -1 and do not spread."""
    h, w = gray.shape
    out = markers.astype(np.int32).copy()
    out[[0, -1], :] = -1
    out[:, [0, -1]] = -1
    queue, turn = [], 0

    def push(y: int, x: int) -> None:
        nonlocal turn
        for p, q in ((y, x - 1), (y, x + 1), (y - 1, x), (y + 1, x)):
            if out[p, q] == 0:
                heapq.heappush(queue, (abs(int(gray[p, q]) - int(gray[y, x])), turn, p, q))
                turn += 1

    for y, x in np.argwhere(out > 0).tolist():
        push(y, x)
    while queue:
        _, _, y, x = heapq.heappop(queue)
        if out[y, x]:
            continue
        near = {int(out[p, q]) for p, q in ((y, x - 1), (y, x + 1), (y - 1, x), (y + 1, x)) if out[p, q] > 0}
        out[y, x] = near.pop() if len(near) == 1 else -1
        if out[y, x] > 0:
            push(y, x)
    return out


def watershed(gray: np.ndarray, fg_ratio: float, open_iterations: int, bg_dilate: int) -> np.ndarray:
    """The foreground mask of the marker watershed."""
    box = lambda n: [(dy, n) for dy in range(-n, n + 1)]
    mask = gray > otsu(gray)
    if open_iterations:
        mask = dilate(erode(mask, box(open_iterations)), box(open_iterations))
    far = chamfer(mask)
    finite = far[np.isfinite(far)]
    top = float(finite.max()) if finite.size else 0.0
    sure = np.isinf(far) | (far > fg_ratio * top)
    labels, _ = label(sure & mask)
    markers = labels + 1
    markers[dilate(mask, box(bg_dilate)) & ~sure] = 0
    return flood(gray, markers) > 1


def level_set(gray: np.ndarray, iterations: int, kernel: list[tuple[int, int]]) -> np.ndarray:
    """Two-region iteration on the blurred slice; a mask that repeats has settled."""
    f = blur(gray)
    mask = f * f.size > f.sum()
    for _ in range(iterations):
        if mask.all() or not mask.any():
            break
        # Nearer to the inner mean than to the outer one, in whole numbers.
        n1, n0, s1, s0 = int(mask.sum()), int((~mask).sum()), int(f[mask].sum()), int(f[~mask].sum())
        twice, both = 2 * f * n1 * n0, s1 * n0 + s0 * n1
        new = twice > both if s1 * n0 > s0 * n1 else (twice < both) & (s1 * n0 != s0 * n1)
        new = dilate(erode(new, kernel), kernel)
        new = erode(dilate(new, kernel), kernel)
        if (new == mask).all():
            break
        mask = new
    return mask


def smoothed(stack: np.ndarray, volume: np.ndarray, before: np.ndarray | None) -> np.ndarray:
    """Each slice of a stack as the majority of the smoothed one before, itself and the one
    after, if all are of one volume and it is not empty. Volumes take a step together.
    ``before`` is the smoothed slice before the first one, null if that begins a volume.
    What the last slice becomes is not known here: it stays."""
    if len(stack) < 2:
        return stack
    size = stack[0].size
    bits = np.packbits(stack.reshape(len(stack), size), axis=1)
    out = bits.copy()
    begins = np.concatenate([[True], volume[1:] != volume[:-1]])
    place = np.arange(len(stack)) - np.maximum.accumulate(np.where(begins, np.arange(len(stack)), 0))
    inner = ~begins
    inner[0] = before is not None
    inner[:-1] &= ~begins[1:]
    inner[-1] = False
    chosen = np.flatnonzero(inner)
    chosen = chosen[np.argsort(place[chosen], kind="stable")]
    for step in np.split(chosen, np.flatnonzero(np.diff(place[chosen])) + 1):
        # The stack's first slice is alone in its step: others in this place begin their volumes.
        a = np.packbits(before)[None] if step[:1].tolist() == [0] else out[step - 1]
        b, c = bits[step], bits[step + 1]
        most = a & b | b & c | a & c
        out[step] = np.where(most.any(axis=1)[:, None], most, b)
    return np.unpackbits(out, axis=1, count=size).view(bool).reshape(stack.shape)
