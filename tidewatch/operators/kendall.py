"""Kendall's S and the median of pairwise slopes of ordered series, without a row or a number for each pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHORT = 256  # points of a series whose pairs are all made
MOST = 1 << 22  # numbers of pairs held at once
HALVINGS = 80


def crossings(rank: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The pairs of places p < q of a permutation with rank[p] > rank[q], by the highest bit in which the two ranks differ: (ones, zeros, begin, count),
    where zeros[i] is the q of count[i] pairs, and their p are ones[begin[i]:begin[i] + count[i]]. One pass for each bit merges halves."""
    n = len(rank)
    order = np.arange(n)
    for bit in reversed(range(max(1, int(n - 1).bit_length()))):
        r = rank[order]
        one = (r >> bit & 1).astype(bool)
        group = r >> (bit + 1)
        first = np.flatnonzero(np.diff(group, prepend=-1))
        own = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
        ones = np.cumsum(one)
        base = (ones - one)[first][own]
        zero = ~one
        yield order[one], order[zero], base[zero], (ones - base)[zero]
        inside = np.arange(n) - first[own]  # stable: zeros of a group, then its ones
        many = np.bincount(own[zero], minlength=len(first))[own]
        to = first[own] + np.where(one, many + ones - base - 1, inside - (ones - base))
        new = np.empty(n, np.int64)
        new[to] = order
        order = new


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """Places in the order of the last key, then the one before it."""
    out = np.empty(len(keys[0]), np.int64)
    out[np.lexsort(keys)] = np.arange(len(keys[0]))
    return out


def kendall_s(x: np.ndarray) -> int:
    """Pairs that rise less pairs that fall."""
    n, down = len(x), sum(int(c.sum()) for _, _, _, c in crossings(_ranks(np.arange(len(x)), x)))
    same = np.unique(x, return_counts=True)[1].astype(np.int64)
    return n * (n - 1) // 2 - int((same * (same - 1) // 2).sum()) - 2 * down


def _level(x: np.ndarray, slope: float) -> np.ndarray:
    """Ranks of the points' heights over a line of this slope: two points are the other way round as soon as their own slope is not above it."""
    at = np.arange(len(x))
    return _ranks(-at, x - slope * at)


def _not_above(x: np.ndarray, slope: float) -> int:
    """How many pairs have a slope of at most this."""
    return sum(int(c.sum()) for _, _, _, c in crossings(_level(x, slope)))


def _pairs_between(x: np.ndarray, low: float, high: float, most: int | None = None) -> np.ndarray:
    """Slopes above low, up to high: those of the points that change places between the two lines. With most, about so many of them."""
    order = np.argsort(_level(x, low))
    found, n = [], 0
    for ones, zeros, begin, count in crossings(_level(x, high)[order]):
        if most is not None and n >= most:
            break
        if most is not None:
            keep = np.cumsum(count) <= max(most - n, int(count.max(initial=0)))
            zeros, begin, count = zeros[keep], begin[keep], count[keep]
        p = ones[np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
        i, j = order[p], order[np.repeat(zeros, count)]
        found.append((x[j] - x[i]) / (j - i))
        n += len(p)
    return np.concatenate([np.empty(0), *found])


def median_slope(x: np.ndarray, limit: int | None = None) -> float:
    """The median of (x[j] - x[i]) / (j - i) over all i < j, n log n for each halving.

    All slopes lie between the least and the largest of neighbours. A line's slope is compared with all pairs' by counting the pairs
    whose points are the other way round over it; the interval is halved until few slopes are left, which are then made and sorted.
    Where equal slopes keep it full, it is narrower than their rounding, and one of them is the median."""
    n = len(x)
    total = n * (n - 1) // 2
    if total == 0:
        return 0.0
    limit = max(4 * n, 1 << 16) if limit is None else limit
    ranks = ((total - 1) // 2, total // 2)
    steps = np.diff(x)
    high = float(steps.max())
    low = float(np.nextafter(steps.min(), -np.inf)) - 1e-12 * max(1.0, abs(high))
    below, upto = 0, total
    for _ in range(HALVINGS):
        middle = (low + high) / 2
        if upto - below <= limit or not low < middle < high:
            break
        here = _not_above(x, middle)
        if here <= ranks[0]:
            low, below = middle, here
        elif here > ranks[1]:
            high, upto = middle, here
        else:  # the two middle ranks are on either side: the largest below and the least above
            left = _middle(x, low, middle, below, here, here - 1 - below, limit)
            right = _middle(x, middle, high, here, upto, 0, limit)
            return (left + right) / 2
    return (_middle(x, low, high, below, upto, ranks[0] - below, limit) + _middle(x, low, high, below, upto, ranks[1] - below, limit)) / 2


def _middle(x: np.ndarray, low: float, high: float, below: int, upto: int, rank: int, limit: int) -> float:
    """The slope of a rank among those in an interval, which is halved further if too many are in it."""
    for _ in range(HALVINGS):
        middle = (low + high) / 2
        if upto - below <= limit or not low < middle < high:
            break
        here = _not_above(x, middle)
        if here - below <= rank:
            low, rank, below = middle, rank - (here - below), here
        else:
            high, upto = middle, here
    if upto - below <= limit:
        slopes = np.sort(_pairs_between(x, low, high))
        return float(slopes[min(max(rank, 0), len(slopes) - 1)]) if len(slopes) else high
    some = _pairs_between(x, low, high, 1)
    return float(some[0]) if len(some) else high


def _short(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """S and median slope of series of one length, by all their pairs."""
    i, j = np.triu_indices(rows.shape[1], 1)
    s, slope = np.empty(len(rows)), np.empty(len(rows))
    step = max(1, MOST // max(1, len(i)))
    for k in range(0, len(rows), step):
        up = rows[k : k + step, j] - rows[k : k + step, i]
        s[k : k + step], slope[k : k + step] = np.sign(up).sum(1), np.median(up / (j - i), axis=1)
    return s, slope


def trend_statistics(series: DataFrame) -> DataFrame:
    """(site, n, s, slope) of each site's points (site, t, x) in order of t: Kendall's S and the median slope per step. Points without x are left out.

    A site's points are one array of numbers in one task (eight bytes each); beyond `SHORT` points none of their pairs is made but those
    about the median."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("t", F.col("x").cast("double").alias("x")))), lambda p: p["x"])
    rows = series.where("x is not null").groupBy("site").agg(ordered.alias("xs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs = b.column("xs")
            flat, size = xs.flatten().to_numpy(zero_copy_only=False), xs.value_lengths().to_numpy(zero_copy_only=False)
            begin = np.cumsum(size) - size
            s, slope = np.zeros(len(size)), np.zeros(len(size))
            for n in np.unique(size[size > 1]):
                at = np.flatnonzero(size == n)
                if n <= SHORT:
                    s[at], slope[at] = _short(flat[begin[at][:, None] + np.arange(n)])
                else:
                    for k in at:
                        x = flat[begin[k] : begin[k] + n]
                        s[k], slope[k] = kendall_s(x), median_slope(x)
            yield pa.RecordBatch.from_arrays([b.column("site"), pa.array(size, pa.int64()), pa.array(s), pa.array(slope)], names=["site", "n", "s", "slope"])

    return rows.mapInArrow(run, f"site {series.schema['site'].dataType.simpleString()}, n long, s double, slope double")
