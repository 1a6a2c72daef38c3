"""Edit distances held to a bound: of one pair by columns of bits, of many pairs at once by furthest-reaching diagonals."""

from __future__ import annotations

import numpy as np

#: Diagonals of one batch of pairs, about; pairs that are too few for a batch or have larger bounds are told singly.
CELLS, FEWEST, MOST = 1 << 16, 4, 800
_FAR = 1 << 30


def edits(a: list | str, b: list | str, most: int | None = None) -> int:
    """Edit distance of two sequences, a column of bits at a time (Hyyro's form of Myers' method), without what both share at the ends; more than most is told as most + 1."""
    a, b = trimmed(a, b)
    if len(a) < len(b):
        a, b = b, a
    if most is not None and len(a) - len(b) > most:
        return most + 1
    if not b:
        return len(a)
    at: dict = {}
    for i, c in enumerate(b):
        at[c] = at.get(c, 0) | 1 << i
    full, top = (1 << len(b)) - 1, 1 << (len(b) - 1)
    plus, minus, score, left = full, 0, len(b), len(a)
    for c in a:
        eq = at.get(c, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (full & ~(diagonal | plus)), plus & diagonal
        score += bool(up & top) - bool(down & top)
        left -= 1
        if most is not None and score - left > most:
            return most + 1
        up, down = (up << 1 | 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(diagonal | up)), up & diagonal
    return score


def _shared(a: list | str, b: list | str) -> int:
    """How many elements a and b begin with alike, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def trimmed(a: list | str, b: list | str) -> tuple[list | str, list | str]:
    """a and b without what both begin and end with; their edit distance is the same."""
    n = _shared(a, b)
    a, b = a[n:], b[n:]
    n = _shared(a[::-1], b[::-1])
    return (a[: len(a) - n], b[: len(b) - n]) if n else (a, b)


def word_edits(a: str, b: str) -> int:
    """What it takes at most to turn a into b where only words in place were changed; for other texts more than any bound."""
    x, y = a.split(" "), b.split(" ")
    return sum(max(len(p), len(q)) for p, q in zip(x, y) if p != q) if len(x) == len(y) else _FAR


def within(a: list[str], b: list[str], most: np.ndarray) -> np.ndarray:
    """For each pair whether its edit distance is at most its bound. What both share at the ends is left out; if what is left is within the bound, or the words of it that differ in place are, that is enough."""
    out = np.zeros(len(a), bool)
    cut: list[tuple[int, str, str, int]] = []
    for i, (x, y, m) in enumerate(zip(a, b, most.tolist())):
        if abs(len(x) - len(y)) <= m:
            x, y = trimmed(x, y)
            if max(len(x), len(y)) <= m or word_edits(x, y) <= m:
                out[i] = True
            else:
                cut.append((i, x, y, m))
    for i, x, y, m in cut:
        if m > MOST:
            out[i] = edits(x, y, m) <= m
    cut = [c for c in cut if c[3] <= MOST]
    for some in _batches(np.array([c[3] for c in cut], "i8")):
        rows = [cut[k] for k in some.tolist()]
        if len(rows) < FEWEST:
            out[[c[0] for c in rows]] = [edits(x, y, m) <= m for _, x, y, m in rows]
            continue
        out[[c[0] for c in rows]] = _batch([c[1] for c in rows], [c[2] for c in rows], np.array([c[3] for c in rows], "i8"))
    return out


def _batches(bounds: np.ndarray) -> list[np.ndarray]:
    """Places of pairs in batches of about equal bounds."""
    out, order = [], np.argsort(bounds, kind="stable")
    sizes, start = bounds[order] + 3, 0
    while start < len(order):
        # up to twice the median of what is left: a few large bounds would mean many more rounds for all
        stop = int(np.searchsorted(sizes, 2 * sizes[(start + len(order)) // 2], side="right"))
        stop = min(stop, start + max(1, CELLS // int(sizes[stop - 1])))
        out.append(order[start:stop])
        start = stop
    return out


def _characters(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "u4"), np.array([len(x) for x in lines])


def _coded(values: np.ndarray) -> np.ndarray:
    """Characters as codes of one byte if there are few different ones, or else of two or four; the two largest are free."""
    top = int(values.max(initial=0))
    if top < 0x10000:
        seen = np.zeros(0x10000, bool)
        seen[values] = True
        if np.count_nonzero(seen) < 0xFE:
            return (np.cumsum(seen) - 1).astype("u1")[values]
    return values.astype("u2" if top < 0xFFFE else "u4")


def _padded(codes: np.ndarray, size: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place the eight bytes from it on, and where each sequence starts; eight bytes of pad follow each."""
    wide = 8 // codes.itemsize
    first = np.cumsum(size + wide) - size - wide
    held = np.full(int((size + wide).sum()) + 10 * wide, pad, codes.dtype)
    held[np.arange(len(codes)) + np.repeat(np.arange(len(size)) * wide, size)] = codes
    return np.ascontiguousarray(np.ndarray(len(held) - wide + 1, "<u8", held, 0, (codes.itemsize,))), first


def _batch(a: list[str], b: list[str], most: np.ndarray) -> np.ndarray:
    """within() by furthest-reaching diagonals: with one edit more a round, how much of a each diagonal covers, for all pairs at once."""
    (x, n), (y, m) = _characters(a), _characters(b)
    codes = _coded(np.concatenate([x, y]))
    free, wide, shift = int(np.iinfo(codes.dtype).max), 8 // codes.itemsize, np.uint8(codes.itemsize.bit_length() + 2)
    (x, x_at), (y, y_at) = _padded(codes[: len(x)], n, free), _padded(codes[len(x) :], m, free - 1)
    # a diagonal is the characters of a less those of b; only those from which the bound can be met have a cell
    delta = n - m
    low, high = -((most - delta) // 2), (most + delta) // 2
    size = np.maximum(high - low + 1, 0) + 2  # and one that is never reached on either side
    base = np.cumsum(size) - size
    pair = np.repeat(np.arange(len(n)), size)
    diagonal = np.arange(len(pair)) - base[pair] - 1 + low[pair]
    cap = np.minimum(n[pair], m[pair] + diagonal)
    x_at, y_at = x_at[pair], y_at[pair] - diagonal
    start, stop = np.abs(diagonal), most[pair] - np.abs(delta[pair] - diagonal)
    edge = np.concatenate([base, base + size - 1])
    start[edge] = _FAR
    end = base + 1 + delta - low
    cap, start, stop, x_at, y_at = (v.astype("i4") for v in (cap, start, stop, x_at, y_at))
    reach, now = np.full(len(pair), -_FAR, "i4"), np.full(len(pair), -_FAR, "i4")
    good, block = np.zeros(len(n), bool), wide * np.arange(8)
    live = np.flatnonzero(np.abs(delta) <= most)
    for e in range(int(most.max(initial=-1)) + 1):
        if e:
            np.maximum(reach[:-2], reach[1:-1], out=now[1:-1])
            now[1:-1] += 1
            np.maximum(now[1:-1], reach[2:], out=now[1:-1])
            np.minimum(now, cap, out=now)
        else:
            now[(start == 0) & (stop >= 0)] = 0
        cells = np.flatnonzero((start <= e) & (stop >= e))
        i, of_x, of_y = now.take(cells), x_at.take(cells), y_at.take(cells)
        apart = x.take(of_x + i)
        apart ^= y.take(of_y + i)
        more = np.bitwise_count((apart & (~apart + np.uint64(1))) - np.uint64(1)) >> shift
        i += more
        left = np.flatnonzero(more == wide)
        while len(left):
            at = i[left, None] + block
            apart = x[of_x[left, None] + at] ^ y[of_y[left, None] + at]
            unlike = (apart != 0).argmax(axis=1)
            apart = apart[np.arange(len(left)), unlike]
            more = np.bitwise_count((apart & (~apart + np.uint64(1))) - np.uint64(1)) >> shift
            i[left] += np.where(apart != 0, unlike * wide + more, 8 * wide)
            left = left[apart == 0]
        now[cells] = i
        now[edge] = -_FAR
        done = now[end[live]] >= n[live]
        if done.any():
            good[live[done]] = True
            stop[good[pair]] = -1
        live = live[~done & (most[live] > e)]
        if not len(live):
            break
        reach, now = now, reach
    return good
