"""Pair merging in the order of ranks, shared by the tokenizers."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence

SHORT = 48
NEVER = 1 << 60


def merge(symbols: Sequence[str], rank: Callable[[str, str], int]) -> list[str]:
    """Merge the adjacent pair of lowest rank, leftmost first, until all are ``NEVER``."""
    return _merge_short(symbols, rank) if len(symbols) <= SHORT else _merge_long(symbols, rank)


def _merge_short(symbols, rank):
    parts = list(symbols)
    ranks = list(map(rank, parts, parts[1:]))
    while ranks:
        best = min(ranks)
        if best == NEVER:
            break
        at = ranks.index(best)
        parts[at] += parts.pop(at + 1)
        del ranks[at]
        if at < len(ranks):
            ranks[at] = rank(parts[at], parts[at + 1])
        if at:
            ranks[at - 1] = rank(parts[at - 1], parts[at])
    return parts


def _merge_long(symbols, rank):
    """A heap over linked symbols: n log n for words of any length."""
    parts: list[str | None] = list(symbols)
    after = list(range(1, len(parts) + 1))
    before = list(range(-1, len(parts) - 1))
    heap = []

    def offer(i):
        j = after[i]
        if j < len(parts):
            r = rank(parts[i], parts[j])
            if r != NEVER:
                heapq.heappush(heap, (r, i, parts[i], parts[j]))

    for i in range(len(parts) - 1):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if parts[i] != a or j >= len(parts) or parts[j] != b:
            continue
        parts[i], parts[j] = a + b, None
        after[i] = after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [p for p in parts if p is not None]
