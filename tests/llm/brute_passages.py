"""Plain-loop counterpart of the character anchors and their matching."""

import bisect
import collections

import xxhash

from orograph.llm.fingerprints import CHAR_K, CHAR_S


def h(chars: str) -> int:
    v = xxhash.xxh64_intdigest(chars.encode("utf-32-be"), 42)
    return v - (1 << 64) if v >= 1 << 63 else v


def anchors(text: str | None) -> list[tuple[int, int]]:
    """(upper 32 bits of the hash, place) of the chosen windows."""
    text = text or ""
    if not text.strip(" \t\n\x0b\f\r"):
        return []
    if len(text) < CHAR_K:
        return [(h(text) >> 32, 0)]
    out = []
    for i in range(len(text) - CHAR_K + 1):
        inner = [h(text[i + j:i + j + CHAR_S]) for j in range(CHAR_K - CHAR_S + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((h(text[i:i + CHAR_K]) >> 32, i))
    return out


def matched(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> int:
    by_a, by_b = collections.defaultdict(list), collections.defaultdict(list)
    for by, side in ((by_a, a), (by_b, b)):
        for code, at in side:
            by[code].append(at)
    best = 0
    for back in (False, True):
        pairs = []
        for code in by_a.keys() & by_b.keys():
            x, y = by_a[code], by_b[code]
            m = min(len(x), len(y))
            pairs += zip(x[-m:], y[-m:]) if back else zip(x[:m], y[:m])
        ends = []
        for _, y in sorted(pairs):
            at = bisect.bisect_left(ends, y)
            ends[at:at + 1] = [y]
        best = max(best, len(ends))
    return best


def like(a: str | None, b: str | None) -> float:
    x, y = anchors(a), anchors(b)
    return 2 * matched(x, y) / (len(x) + len(y)) if x or y else 1.0
