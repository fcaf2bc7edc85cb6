"""Exact paired statistics on small aggregates (plain integers and fractions on the driver)."""

from __future__ import annotations

from collections import Counter
from fractions import Fraction
from math import comb


def sign_test(wins: int, losses: int) -> tuple[float, str]:
    """Two-sided exact sign test of two counts (McNemar's exact test of the discordant pairs)."""
    n = wins + losses
    if n == 0:
        return 1.0, "1/1"
    tail = sum(comb(n, i) for i in range(min(wins, losses) + 1))
    p = min(Fraction(2 * tail, 2**n), Fraction(1))
    return float(p), f"{p.numerator}/{p.denominator}"


def mid_p(wins: int, losses: int) -> float:
    """The two-sided mid-p value: half the weight of the observed outcome."""
    n, k = wins + losses, min(wins, losses)
    if n == 0:
        return 1.0
    p = 2 * (sum(comb(n, i) for i in range(k)) + Fraction(comb(n, k), 2)) / 2**n
    return float(min(p, Fraction(1)))


def paired_permutation(differences: list[int]) -> Fraction:
    """P(|sum| >= observed) over all sign flips, by the distribution of sums."""
    sums = Counter({0: 1})
    for d in differences:
        after: Counter = Counter()
        for s, n in sums.items():
            after[s + d] += n
            after[s - d] += n
        sums = after
    seen = abs(sum(differences))
    return Fraction(sum(n for s, n in sums.items() if abs(s) >= seen), 2 ** len(differences))


def two_sample_permutation(a: list[int], b: list[int]) -> Fraction:
    """P(|mean difference| >= observed) over all relabelings, by counting subset sums."""
    pool, n = a + b, len(a)
    ways: list[Counter] = [Counter() for _ in range(n + 1)]
    ways[0][0] = 1
    for x in pool:
        for k in range(n - 1, -1, -1):
            for s, c in ways[k].items():
                ways[k + 1][s + x] += c
    total, m = sum(pool), len(b)
    diff = lambda s: abs(s * m - (total - s) * n)
    seen = diff(sum(a))
    return Fraction(sum(c for s, c in ways[n].items() if diff(s) >= seen), comb(n + m, n))


def best_reachable(lengths: list[int], target: float, steps: int = 200_000) -> float:
    """The largest share at most `target` that some subset of the lengths reaches (lengths quantised to steps)."""
    total = sum(lengths)
    if total == 0:
        return 0.0
    scale = max(total / steps, 1.0)
    bits = 1
    for n in lengths:
        bits |= bits << int(n / scale)
    limit = int(target * total / scale)
    reach = (bits & ((1 << limit + 1) - 1)).bit_length() - 1
    return reach * scale / total


def decision(low: float, high: float, margin: float) -> str:
    """adopt if the whole interval exceeds the margin, not meaningful if it lies within, else inconclusive."""
    if low > margin:
        return "adopt"
    return "not meaningful" if -margin <= low and high <= margin else "inconclusive"
