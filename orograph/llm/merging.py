"""Byte-pair merging with a heap and a linked list, for both tokenizers.

``merge`` takes the symbols of one unit and the rank of every joined pair. The heap holds adjacent
pairs by (rank, position); a popped pair that no longer exists is skipped. Every merge relinks two
neighbours and pushes at most two new pairs, so a unit of n symbols takes n log n steps.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush


def merge(symbols: list, ranks: dict) -> int:
    """Merge ``symbols`` in place (merged-away entries become None); returns the number of merges."""
    n = len(symbols)
    heap = []
    for i in range(n - 1):
        pair = symbols[i] + symbols[i + 1]
        rank = ranks.get(pair)
        if rank is not None:
            heap.append((rank, i, pair))
    if not heap:
        return 0
    heapify(heap)
    after, before, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
    while heap:
        _, i, pair = heappop(heap)
        left, j = symbols[i], after[i]
        if left is None or j >= n or left + symbols[j] != pair:
            continue
        symbols[i], symbols[j] = pair, None
        merges += 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            joined = pair + symbols[k]
            rank = ranks.get(joined)
            if rank is not None:
                heappush(heap, (rank, i, joined))
        h = before[i]
        if h >= 0:
            joined = symbols[h] + pair
            rank = ranks.get(joined)
            if rank is not None:
                heappush(heap, (rank, h, joined))
    return merges
