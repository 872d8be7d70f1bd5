"""One-dimensional partitions of a sorted sample: error of a bucket, and searches for good cuts.

Everything here works on a bounded sample in NumPy on the driver: ``x`` sorted predicate values,
``t`` targets, ``pos`` each sample row's position in the whole sorted table. A partition is a list of
cut positions in the sample; bucket b holds samples cuts[b] .. cuts[b+1]-1.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from tessera.operators.cuts import Peaks, Search

LEAST = 3  # samples in a bucket, and in an interval whose variance counts


MOST = 3000  # points up to which a search has a table of all pairs of cuts; beyond, errors are looked up as needed


def sliding_max(x: np.ndarray, w: int) -> np.ndarray:
    """Maximum of each ``w`` consecutive values: two running maxima over tiles of w."""
    n = len(x) - w + 1
    if w == 1:
        return x
    if n == 1:
        return x.max(keepdims=True)
    tiles = -(-len(x) // w)
    padded = np.full(tiles * w, -np.inf)
    padded[: len(x)] = x
    square = padded.reshape(tiles, w)
    ahead = np.maximum.accumulate(square, axis=1).ravel()
    behind = np.maximum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.maximum(behind[:n], ahead[w - 1 : w - 1 + n])


class BucketError:
    """Largest approximate variance of the total over any interval inside a bucket.

    All buckets of one size are worked out together, interval length by interval length. Longer
    intervals are left out once they can't matter: an interval of q samples has a spread of n ss / q**2
    at most, and its sum of squares ss is at most that of as many shorter intervals as cover it.
    ``share`` < 1 looks at that share of the sub-intervals only (a seeded choice), and always at the
    whole bucket.
    """

    def __init__(self, t: np.ndarray, pos: np.ndarray, share: float = 1.0, seed: int = 12345):
        t = np.asarray(t, dtype=float)
        self.pos, self.m = np.asarray(pos, dtype=float), len(t)
        self.s = np.concatenate(([0.0], np.cumsum(t)))
        self.ss = np.concatenate(([0.0], np.cumsum(t * t)))
        self.share, self.seed = share, seed
        self.memo: dict[int, np.ndarray] = {}
        self.sums: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray | None]] = {}

    def __call__(self, a: int, b: int) -> float:
        """Of the bucket of samples a..b, both included."""
        return float(self.of_size(b - a + 1)[a])

    def _intervals(self, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Sums and sums of squares of all intervals of q samples, and which of them are looked at."""
        if q not in self.sums:
            chosen = np.random.default_rng((self.seed, q)).random(self.m - q + 1) < self.share if self.share < 1 else None
            self.sums[q] = (self.s[q:] - self.s[:-q], self.ss[q:] - self.ss[:-q], chosen)
        return self.sums[q]

    def of_size(self, n: int) -> np.ndarray:
        """Errors of the buckets of n samples, by first sample."""
        if n not in self.memo:
            self.memo[n] = self._errors(n)
        return self.memo[n]

    def _errors(self, n: int) -> np.ndarray:
        rows = self.pos[n - 1 :] - self.pos[: self.m - n + 1]
        if n < LEAST:
            return np.zeros(len(rows))
        s, ss, _ = self._intervals(n)
        best = np.maximum(0.0, (n * ss - s * s) / (n * n))
        for q in range(LEAST, n if self.share > 0 else LEAST):
            s, ss, chosen = self._intervals(q)
            spread = (n * ss - s * s) / (q * q)
            best = np.maximum(best, sliding_max(spread if chosen is None else np.where(chosen, spread, 0.0), n - q + 1))
            if (2 * n / (q + 1) ** 2 * sliding_max(ss, n - q + 1) <= best).all():
                break
        return np.where(rows > 0, best / n * (1 - n / np.where(rows > 0, rows, 1)), 0.0).clip(0)

    def table(self) -> np.ndarray:
        """Error of the bucket of samples j..i-1 at [j, i]; infinite for less than ``LEAST`` samples."""
        if self.m > MOST:
            raise ValueError(f"{self.m} points; a table of all cuts takes {MOST} at most: search without one, or lower the rate of points")
        out = np.full((self.m + 1, self.m + 1), np.inf)
        flat = out.ravel()
        for n in range(LEAST, self.m + 1):
            flat[n : n + (self.m - n + 1) * (self.m + 2) : self.m + 2] = self._errors(n)
        return out


def equal_depth(m: int, k: int) -> list[int]:
    """Cuts after every m/k-th sample."""
    return [b * m // k for b in range(k)] if m >= k else list(range(m))


def worst(error: BucketError, cuts: list[int]) -> float:
    ends = [*cuts[1:], error.m]
    return max(error(a, b - 1) for a, b in zip(cuts, ends, strict=True))


def minimax(error: BucketError, k: int) -> list[int] | None:
    """Cuts of k buckets, each of ``LEAST`` samples or more, with the least largest error: dynamic
    programming with back pointers; beyond ``MOST`` samples a search that is as exact, whose cuts can
    differ where several have that error. None if there are too few samples."""
    if k < 1 or LEAST * k > error.m:
        return None
    if error.m > MOST:
        return Search(Peaks(error, LEAST)).best(k, equal_depth(error.m, k))
    cost = error.table()
    best, back = cost[0], []
    for _ in range(2, k + 1):
        worse = np.maximum(best[:, None], cost)
        back.append(worse.argmin(axis=0))
        best = worse.min(axis=0)
    return _unwind(back, error.m)


def minimax_fast(error: BucketError, k: int) -> list[int] | None:
    """The same by bisection: the left part's error rises with the cut and the last bucket's falls,
    so the best cut is where they cross. Exact where the errors are monotone."""
    m = error.m
    if k < 1 or LEAST * k > m:
        return None
    cost = _costs(error)
    ends = np.arange(m + 1)
    best, back = cost(np.zeros(m + 1, dtype=int), ends), []
    for b in range(2, k + 1):
        lo, hi = np.full(m + 1, LEAST * (b - 1)), ends - LEAST
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) // 2
            left = best[mid]
            crossed = left >= cost(mid, open_, lambda low, high: (low <= left) & (high > left))  # noqa: B023
            hi[open_], lo[open_] = np.where(crossed, mid, hi[open_]), np.where(crossed, lo[open_], mid + 1)
        tries = [np.clip(lo - 1, 0, m), np.clip(lo, 0, m)]
        found = [np.maximum(best[j], cost(j, ends, lambda _, high: high > best[j])) for j in tries]  # noqa: B023
        left = found[0] < found[1]
        back.append(np.where(left, *tries))
        best = np.where(left, *found)
    return _unwind(back, m)


def _costs(error: BucketError) -> Callable[..., np.ndarray]:
    """Errors by first sample and end, from a table or by look-up (exact where wanted)."""
    if error.m > MOST:
        return Peaks(error, LEAST).errors
    table = error.table()
    return lambda a, b, wanted=None: table[a, b]


def _unwind(back: list[np.ndarray], m: int) -> list[int]:
    cuts, i = [], m
    for pointers in reversed(back):
        i = int(pointers[i])
        cuts.append(i)
    return [0, *reversed(cuts)]


class SplitError:
    """Of a bucket: the larger sample variance of its two parts at the worst split, and that split."""

    def __init__(self, t: np.ndarray):
        t = np.asarray(t, dtype=float)
        self.m = len(t)
        self.s = np.concatenate(([0.0], np.cumsum(t)))
        self.ss = np.concatenate(([0.0], np.cumsum(t * t)))
        self.memo: dict[tuple[int, int], tuple[float, int]] = {}

    def variance(self, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray:
        n = np.asarray(b) - np.asarray(a)
        return ((self.ss[b] - self.ss[a]) - (self.s[b] - self.s[a]) ** 2 / n) / np.maximum(n - 1, 1)

    def __call__(self, l: int, r: int) -> tuple[float, int]:  # noqa: E741
        if (l, r) not in self.memo:
            mids = np.arange(l + 3, r - 1)
            if len(mids):
                e = np.maximum(self.variance(np.full(len(mids), l), mids), self.variance(mids, np.full(len(mids), r)))
                self.memo[l, r] = (float(e.max()), int(mids[e.argmax()]))
            else:
                self.memo[l, r] = (0.0, -1)
        return self.memo[l, r]


def hill_climb(t: np.ndarray, k: int, rounds: int = 1000) -> list[int]:
    """Cuts from equal depth on: the cut that is missed least moves into one of the two worst
    buckets, as long as the sum of the two largest bucket errors falls."""
    err = SplitError(t)
    cuts = equal_depth(err.m, k)

    def two_worst(c: list[int]) -> tuple[float, list[int]]:
        found = sorted((err(a, b) for a, b in zip(c, [*c[1:], err.m], strict=True)), reverse=True)[:2]
        return sum(e for e, _ in found), [mid for _, mid in found]

    total, targets = two_worst(cuts)
    for _ in range(rounds):
        tries = []
        for mid in targets:
            if mid > 0 and mid not in cuts:
                for gone in cuts[1:]:
                    c = sorted([x for x in cuts if x != gone] + [mid])
                    tries.append((two_worst(c)[0], c))
        if not tries or min(tries)[0] >= total:
            break
        cuts = min(tries)[1]
        total, targets = two_worst(cuts)
    return cuts


def bucket_report(error: BucketError, cuts: list[int], z: float = 2.576) -> list[tuple[int, int, float, float]]:
    """(first sample, last sample, largest variance, half width of its interval) of each bucket."""
    ends = [*cuts[1:], error.m]
    return [(a, b - 1, error(a, b - 1), z * error(a, b - 1) ** 0.5) for a, b in zip(cuts, ends, strict=True)]


def dimension_error(values: list[np.ndarray], t: np.ndarray, pos: list[np.ndarray], share: float = 0.1, seed: int = 7) -> float:
    """Error of a region: the mean over dimensions of the bucket error along it."""
    total = 0.0
    for v, p in zip(values, pos, strict=True):
        order = np.argsort(v, kind="stable")
        total += BucketError(t[order], np.sort(p), share, seed)(0, len(t) - 1)
    return total / len(values)
