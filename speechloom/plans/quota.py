"""Quotas of buckets: rounding half to even, cumulative."""

from __future__ import annotations

RATIOS = (("noop", 0.20), ("simple", 0.15), ("correction", 0.25), ("compositional", 0.30), ("formatting", 0.10))
REAL = 0.85


def quotas(total: int, ratios: tuple = RATIOS) -> list[tuple[str, int, int]]:
    """(bucket, first, after last); the first bucket takes what rounding leaves."""
    if abs(sum(r for _, r in ratios) - 1) > 1e-9:
        raise ValueError("ratios must sum to 1")
    n = {b: round(total * r) for b, r in ratios}
    n[ratios[0][0]] += total - sum(n.values())
    out, at = [], 0
    for b, _ in ratios:
        out.append((b, at, at + n[b]))
        at += n[b]
    return out
